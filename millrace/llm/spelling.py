"""Spelling variant grouping: words that differ by one sign, by rolling hashes of their deletions.

Prefix and suffix sums of a polynomial over code points give the hash of a word without its sign i in constant time, for
all words of an Arrow batch at once. Two words differ by one replaced sign if they agree in length and in the rest at one
place: their key is the hash of (rest, place, length). They differ by one inserted or deleted sign if one word's rest is
the other word: their key is the hash of that string; of equal neighbouring signs only the first is left out, as any of
them gives the same rest. Keys of 64 bits are dealt by their leading bits and sorted; a key that meets no other goes no
further. Only the words behind keys that meet are fetched, and what meets is compared as strings, so that a collision of
hashes never makes a pair.

A key's group is bounded by the alphabet (times the length, for inserted signs), whatever the input: words are distinct.
Pairs are not spelled out: a group gives each of its words how many others there are and the best of them.

Defined results: null texts and null words hold nothing. ``word_counts`` counts repeated rows as they come; ``variants``
adds up the counts of a word that is listed twice. Long words cost rows in proportion to their length and never carry
their string through the first shuffle. Ties go to the smaller word in code point order. Empty tables give none; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, UPPER_ASCII, Scratch, arrow_pieces
from .shingles import mix

_LETTERS = "A-Za-zÀ-ÿ"
_BASE = np.uint64(0x9E3779B97F4A7C13)
#: The base's inverse modulo 2**64.
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_SEED = np.uint64(0x632BE59BD9B4E019)
#: Leading bits of a key that deal it out; more values than any cluster has tasks.
RADIX_BITS = 20
KEYS = "key bigint, place int, id bigint"


@dataclass(frozen=True)
class Spelling:
    """Words of at least ``least_length`` code points and ``least_count`` occurrences; a form is ``ratio`` times as frequent."""

    least_length: int = 7
    least_count: int = 2
    ratio: int = 10


def word_counts(documents: DataFrame, rules: Spelling = Spelling(), slip: int = 0) -> DataFrame:
    """documents (doc_id, text) → (word, n): runs of Latin letters, A-Z lowered. Shorter runs are left out at once.

    ``slip``: of runs whose crc32 of ``<doc_id>:<run>`` it divides, the sign at crc32 % length is left out.
    """
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{_LETTERS}]{{{rules.least_length},}}"), F.lit(0))).alias("run"))
    plain = F.octet_length("run") == F.length("run")
    words = runs.select("doc_id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER_ASCII, LOWER_ASCII)).alias("word"))
    if slip:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = F.col("_h") % F.length("word")
        short = F.concat(F.substring(F.col("word"), F.lit(1), at.cast("int")), F.substring(F.col("word"), (at + 2).cast("int"), F.length("word")))
        words = words.withColumn("_h", h).select(F.when(F.col("_h") % slip == 0, short).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= rules.least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= rules.least_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, index of the word): of each word its own hash (place -1), the hash of each rest that is a string of its
    own (place -2 - i), and the hash of each rest with its place and the length (place i)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    signs = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(signs)) - starts[of]
    with np.errstate(over="ignore"):
        power = np.ones(int(sizes.max(initial=0)) + 1, np.uint64)
        power[1:] = _BASE
        power = np.multiply.accumulate(power)
        value = mix(signs + _SEED) * power[place]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        first, last = sums[starts], sums[ends]
        rest = (sums[:-1] - first[of]) + (last[of] - sums[1:]) * _BACK
        lengths = sizes.astype(np.uint64)
        whole = mix((last - first) + mix(lengths))
        gone = mix(rest + mix(lengths[of] - np.uint64(1)))
        replaced = mix(gone ^ mix(place.astype(np.uint64) + _SEED))
    new = np.ones(len(signs), bool)
    new[1:] = (signs[1:] != signs[:-1]) | (place[1:] == 0)
    keys = np.concatenate([whole, gone[new], replaced])
    places = np.concatenate([np.full(len(words), -1), -2 - place[new], place])
    return keys, places.astype(np.int32), np.concatenate([np.arange(len(words)), of[new], of])


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrow_pieces(batch, 0, 1 << 20):
            ids = part.column(1).to_numpy(zero_copy_only=False)
            keys, places, of = deletion_keys(part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(places), pa.array(ids[of])], names=["key", "place", "id"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by key (column 0), and where each group starts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))
        if last or (held and held[-1].column(0)[0].as_py() != keys[0]):
            table = pa.Table.from_batches([*held, batch.slice(0, last)]) if last else pa.Table.from_batches(held)
            if table.num_rows:
                every = table.column(0).to_numpy()
                yield table, np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        table = pa.Table.from_batches(held)
        every = table.column(0).to_numpy()
        yield table, np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key stands in another row as well."""
    for table, starts in _groups(batches):
        sizes = np.diff(np.append(starts, table.num_rows))
        yield from table.filter(pa.array(np.repeat(sizes > 1, sizes))).combine_chunks().to_batches()


def near_of_group(rows: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """rows (place, word, n) of one key → (word, how many near words, the best of them, its n), by comparing strings."""
    order = lambda words: sorted(words, key=lambda w: (-words[w], w))
    replaced: dict[tuple[int, str], dict[str, int]] = {}
    longer: dict[str, dict[str, int]] = {}
    whole = {word: n for place, word, n in rows if place == -1}
    for place, word, n in set(rows):
        at = place if place >= 0 else -2 - place
        rest = word[:at] + word[at + 1 :]
        if place >= 0:
            replaced.setdefault((place, rest), {})[word] = n
        elif place < -1 and rest in whole:
            longer.setdefault(rest, {})[word] = n
    for words in replaced.values():
        if len(words) > 1:
            best, second = order(words)[:2]
            for word in words:
                other = second if word == best else best
                yield word, len(words) - 1, other, words[other]
    for rest, words in longer.items():
        best = order(words)[0]
        yield rest, len(words), best, words[best]
        for word in words:
            yield word, 1, rest, whole[rest]


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, starts in _groups(batches):
        rows = list(zip(table.column("place").to_pylist(), table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
        ends = np.append(starts[1:], len(rows))
        found = [x for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a > 1 for x in near_of_group(rows[a:b])]
        if found:
            word, near, other, n = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(near, pa.int64()), pa.array(other), pa.array(n, pa.int64())], names=["word", "near", "other", "other_n"])


def _dealt(rows: DataFrame) -> DataFrame:
    """Dealt by the leading bits of the key, and sorted by it."""
    return rows.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n), distinct → (word, near, other, other_n): for each key that a word shares, its near words' number and
    the best of them."""
    # an id that two words share costs rows but no result: strings decide
    named = words.select("word", F.xxhash64("word").alias("id"), "n")
    keys = _dealt(named.select("word", "id").mapInArrow(_key_rows, KEYS)).mapInArrow(_meeting, KEYS)
    texts = keys.join(named, "id").select("key", "place", "word", "n")
    return _dealt(texts).mapInArrow(_near_rows, "word string, near bigint, other string, other_n bigint")


def _ranked(n: Column, word: Column) -> Column:
    return F.min(F.struct((-n).alias("less"), word.alias("word")))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """forms (word, form), each word once → (word, root). Every round doubles the steps taken; a form is ``ratio`` times as
    frequent as its word, so a chain has few."""
    now = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = scratch.keep(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return now


def variants(words: DataFrame, rules: Spelling = Spelling()) -> DataFrame:
    """words (word, n) → (word, form, root, n, n_near, form_n): each word's near words counted, its form (the most frequent
    near word, if that is ``ratio`` times as frequent), and the last of its forms' forms."""
    spark = words.sparkSession
    with Scratch(spark) as scratch:
        words = scratch.keep(words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")), "words")
        near = near_words(words).groupBy("word").agg(F.sum("near").alias("n_near"), _ranked(F.col("other_n"), F.col("other")).alias("best"))
        joined = words.join(near, "word", "left")
        fits = -F.col("best.less") >= rules.ratio * F.col("n")
        formed = scratch.keep(
            joined.select("word", F.when(fits, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms"
        )
        last = roots(formed.filter(F.col("form").isNotNull()), scratch)
        rows = formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return scratch.result(rows, "variants")
