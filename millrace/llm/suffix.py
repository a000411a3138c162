"""Removal of repeated 100-byte strings by a logarithmic family of sampled suffix arrays.

Every window of ``length`` bytes picks one of its ``prefix``-byte strings, the one with the least hash, as its anchor.
Equal windows pick the same one at the same place, so it is enough to keep the suffixes that start at anchors (one in
forty bytes of prose) in order of their prefix. Each anchor owns a run of neighbouring windows; its segment is the
text of that run.

Documents come in ``batches`` of ascending ids. A batch gets such an array; it is merged with arrays of earlier batches
in one ordered pass, and arrays of equal size become one of the next size, so a suffix is rewritten once per doubling
of the corpus. The last batch is merged with all arrays that are left. A pass looks at each run of suffixes with one
prefix as it streams by:

* a segment seen before repeats as a whole: its windows are removed;
* the first holders of different segments with one prefix may still share windows. They are noted, their windows are
  hashed one by one from the text, and all but the first holder of each window lose it.

First means the smaller doc_id, then the earlier start, whatever the order of batches. No step holds a prefix's
suffixes together: a task sees one row of the ordered stream and its predecessor. Prefixes that a share of the documents
shows to be frequent are dealt by segment instead, and all first holders of their segments are noted; which prefixes
these are changes where rows go, not what is found.

Defined results: null text is empty; texts shorter than ``length`` lose nothing; rows that share a doc_id, or have none,
are ordered by doc_id (null first) and then by a hash of their text, and are documents of their own; an empty table
gives an empty result; other columns are ignored. Texts of any length are read in chunks of bounded size.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_pieces, drop_path, shared_path
from .shingles import mix

_RNG = np.random.Generator(np.random.PCG64(77001))
_VALUES = _RNG.integers(1, 2**64, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)
_PLACE_BITS = np.uint64(24)
#: Bytes of text that are hashed at once; less than places have bits for.
CHUNK = 1_000_000


@dataclass(frozen=True)
class RepeatRules:
    length: int = 100
    prefix: int = 32
    batches: int = 4
    hot_sample: int = 32
    hot_prefixes: int = 1000


_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The powers 0..n-1 of an odd base, modulo 2**64."""
    key = (base, 1 << max(16, (n - 1).bit_length()))
    if key not in _powers:
        grown = np.full(key[1], base, np.uint64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            _powers[key] = np.multiply.accumulate(grown)
    return _powers[key][:n]


class Hashed:
    """Hashes of any substring of ``data``, of one of two independent families."""

    def __init__(self, data: np.ndarray, family: int):
        n = len(data) + 1
        self.inverse = _power(pow(_BASES[family], -1, 2**64), n)
        self.sums = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUES[family][data] * _power(_BASES[family], n)[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    span, low = 1, keys
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchors(texts: list[bytes], rules: RepeatRules) -> tuple[np.ndarray, ...]:
    """(text number, anchor's place, first window, windows, prefix hash, segment hash) for all anchors of ``texts``."""
    n, k = rules.length, rules.prefix
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < n:
        return empty
    first, second = Hashed(data, 0), Hashed(data, 1)
    total = len(data)
    prefix = first.of(slice(0, total - k + 1), slice(k, total + 1))
    keys = (prefix >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(prefix), dtype=np.uint64)
    chosen = (_sliding_min(keys, n - k + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)[: total - n + 1]
    inside = np.arange(total - n + 1) + n <= ends[owner]
    windows = np.flatnonzero(inside)
    if not len(windows):
        return empty
    picked, texts_of = chosen[windows], owner[windows]
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (picked[1:] != picked[:-1]) | (texts_of[1:] != texts_of[:-1])
    at = np.flatnonzero(fresh)
    count = np.diff(np.append(at, len(windows)))
    lo, place, who = windows[at], picked[at], texts_of[at]
    with np.errstate(over="ignore"):
        shape = (place - lo).astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64)
        segment = mix(second.of(lo, lo + count + n - 1) + shape)
    base = begins[who]
    return who, place - base, lo - base, count, prefix[place].view(np.int64), segment.view(np.int64)


def chunks(size: int, length: int) -> Iterator[tuple[int, int]]:
    """(start, end) of overlapping chunks of a text: each window of ``length`` bytes lies in the one it starts in."""
    for start in range(0, max(1, size - length + 1), CHUNK):
        yield start, min(size, start + CHUNK + length - 1)


def window_hashes(text: bytes, places: np.ndarray, rules: RepeatRules) -> np.ndarray:
    """Hashes of the windows of one text that start at the ascending ``places``."""
    out = np.zeros(len(places), np.int64)
    for start, end in chunks(len(text), rules.length):
        here = slice(*np.searchsorted(places, (start, start + CHUNK)))
        if here.start < here.stop:
            at = places[here] - start
            out[here] = Hashed(np.frombuffer(text, np.uint8, end - start, start), 1).of(at, at + rules.length).view(np.int64)
    return out


ARRAY_SCHEMA = "prefix bigint, segment bigint, doc_id bigint, start bigint, count bigint"
LEVEL, REMOVED, OPEN = 0, 1, 2


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _known_repeats(doc: np.ndarray, start: np.ndarray, prefix: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Which rows of a piece of text hold a segment that another row of the piece holds earlier."""
    order = np.lexsort((start, doc, segment, prefix))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (prefix[order][1:] == prefix[order][:-1]) & (segment[order][1:] == segment[order][:-1])
    return again


def sampled_suffixes(documents: DataFrame, rules: RepeatRules) -> DataFrame:
    """The rows of a batch's array, not yet in order. A row whose segment stands earlier in the same piece of text is
    known to repeat; its count is negative, and it goes where there is room, so copies and common lines do not meet in
    one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow_pieces(batch, 1, CHUNK):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                for start, end in chunks(len(texts[0]), rules.length) if len(texts) == 1 else ((0, None),):
                    who, _, lo, count, prefix, segment = anchors([texts[0][start:end]] if len(texts) == 1 else texts, rules)
                    if len(who):
                        count = np.where(_known_repeats(ids[who], lo, prefix, segment), -count, count)
                        yield _batch([prefix, segment, ids[who], lo + start, count], ["prefix", "segment", "doc_id", "start", "count"])

    return documents.mapInArrow(run, ARRAY_SCHEMA)


def hot_prefixes(documents: DataFrame, rules: RepeatRules) -> list[int]:
    """At most ``hot_prefixes`` prefixes that are frequent in one of ``hot_sample`` documents, chosen by a hash of the id."""
    some = documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rules.hot_sample)) == 0)
    counts = sampled_suffixes(some, rules).groupBy("prefix").agg(F.count("*").alias("n")).filter("n >= 20")
    return [r[0] for r in counts.orderBy(F.desc("n"), "prefix").limit(rules.hot_prefixes).collect()]


def merge_scan(rows: DataFrame, keep_level: bool, hot: list[int]) -> DataFrame:
    """One ordered pass over the suffixes of one or more arrays.

    Returns (kind, prefix, segment, doc_id, start, count): the first holder of each segment (LEVEL, the merged array,
    if asked for), repeats of a segment (REMOVED) and first holders whose prefix has several segments or is ``hot`` (OPEN).
    """
    frequent = np.array(sorted(hot), np.int64)
    names = ["kind", "prefix", "segment", "doc_id", "start", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (prefix, segment) of the row before
        waiting: np.ndarray | None = None  # the last first holder, as it is not known yet whether its prefix is alone
        matched = False  # whether it shares its prefix with the first holder before it
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns]) if batch.num_rows else np.zeros((5, 0), np.int64)
            known = rows[:, rows[4] < 0]
            if known.shape[1]:
                yield _batch([np.full(known.shape[1], REMOVED), *known[:4], -known[4]], names)
            rows = rows[:, rows[4] > 0]
            if not rows.shape[1]:
                continue
            fresh = np.ones(rows.shape[1], bool)
            fresh[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            fresh[0] = last is None or last != (rows[0, 0], rows[1, 0])
            last = (rows[0, -1], rows[1, -1])
            again = rows[:, ~fresh]
            firsts = rows[:, fresh]
            if again.shape[1]:
                yield _batch([np.full(again.shape[1], REMOVED), *again], names)
            if keep_level and firsts.shape[1]:
                yield _batch([np.full(firsts.shape[1], LEVEL), *firsts], names)
            if not firsts.shape[1]:
                continue
            line = firsts if waiting is None else np.concatenate([waiting, firsts], axis=1)
            same = line[0, 1:] == line[0, :-1]
            shared = np.zeros(line.shape[1], bool)
            shared[1:] |= same
            shared[:-1] |= same
            if len(frequent):
                shared |= frequent[np.minimum(np.searchsorted(frequent, line[0]), len(frequent) - 1)] == line[0]
            if waiting is not None:
                shared[0] |= matched
            out = line[:, :-1][:, shared[:-1]]
            waiting, matched = line[:, -1:], bool(shared[-1])
            if out.shape[1]:
                yield _batch([np.full(out.shape[1], OPEN), *out], names)
        if waiting is not None and matched:
            yield _batch([[OPEN], *waiting], names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = F.when(F.col("count") < 0, F.xxhash64("doc_id", "start")).when(F.col("prefix").isin(hot), F.col("segment")).otherwise(F.col("prefix"))
    ordered = rows.repartition(n, deal).sortWithinPartitions("prefix", "segment", "doc_id", "start")
    return ordered.mapInArrow(run, "kind bigint, " + ARRAY_SCHEMA)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more, before the next large stage.

    The first collection frees the plans, the second the shuffles that only they referred to.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


class SuffixFamily:
    """Arrays of earlier batches by level: level n holds 2**n batches, and there is at most one array of a level."""

    def __init__(self, spark: SparkSession, rules: RepeatRules, hot: list[int]):
        self.spark, self.rules, self.hot = spark, rules, hot
        self.levels: dict[int, str] = {}
        self.findings: list[str] = []

    def _read(self, path: str, kind: int) -> DataFrame:
        return self.spark.read.schema(ARRAY_SCHEMA + ", kind int").parquet(path).filter(F.col("kind") == kind).drop("kind")

    def _pass(self, rows: DataFrame, merged: list[int], keep_level: bool) -> str:
        """Scan ``rows`` together with the arrays of the levels ``merged``, which end here."""
        path = shared_path(self.spark, "suffixes")
        for level in merged:
            rows = rows.unionByName(self._read(self.levels[level], LEVEL))
        merge_scan(rows, keep_level, self.hot).write.partitionBy("kind").parquet(path)
        self.findings.append(path)
        for level in merged:
            drop_path(self.spark, f"{self.levels.pop(level)}/kind={LEVEL}")
        release(self.spark)
        return path

    def add(self, documents: DataFrame, last: bool = False) -> None:
        """Build the array of ``documents``, merged with the arrays it makes equal sizes with; the last with all."""
        rows = sampled_suffixes(documents, self.rules)
        if last:
            self._pass(rows, sorted(self.levels), keep_level=False)
            return
        level = 0
        while level in self.levels:
            level += 1
        self.levels[level] = self._pass(rows, list(range(level)), keep_level=True)

    def found(self, kind: int) -> DataFrame:
        out = self._read(self.findings[0], kind)
        for path in self.findings[1:]:
            out = out.unionByName(self._read(path, kind))
        return out


def open_windows(documents: DataFrame, firsts: DataFrame, rules: RepeatRules) -> DataFrame:
    """(doc_id, start): windows of ``firsts`` that an earlier one of ``firsts`` also holds.

    Windows are the same if their 64-bit hashes and half of those of their anchors are; a place is that half and the start.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prefix, start, count = (np.array([r[k] for r in runs], np.int64) for k in ("prefix", "start", "count"))
                raw = text.encode("utf-8", "surrogatepass")
                at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                order = np.argsort(at, kind="stable")
                at, mark = at[order], np.repeat(prefix, count)[order]
                yield _batch([window_hashes(raw, at, rules), np.full(len(at), doc), (mark << 32) | at], ["window", "doc_id", "place"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            w, d, place = (c.to_numpy() for c in batch.columns)
            if not len(w):
                continue
            p, s = place >> 32, place & (2**32 - 1)
            again = np.zeros(len(w), bool)
            again[1:] = (w[1:] == w[:-1]) & (p[1:] == p[:-1])
            again[0] = last == (w[0], p[0])
            last = (w[-1], p[-1])
            yield _batch([d[again], s[again]], ["doc_id", "start"])

    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = firsts.select("doc_id", "prefix", "start", "count").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("prefix", "start", "count")).alias("runs"))
    windows = documents.join(runs, "doc_id").select("doc_id", "text", "runs").mapInArrow(expand, "window bigint, doc_id bigint, place bigint")
    ordered = windows.repartition(n, "window").sortWithinPartitions("window", "doc_id", "place")
    return ordered.mapInArrow(later, "doc_id bigint, start bigint")


def cut_text(text: bytes, starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """What is left of ``text`` without the windows of the runs, the bytes removed and the maximal runs of them."""
    if not len(starts):
        return text, 0, 0
    order = np.argsort(starts)
    begins, ends = starts[order], np.maximum.accumulate(starts[order] + counts[order] - 1 + length)
    fresh = np.append(True, begins[1:] > ends[:-1])
    begins, ends = begins[fresh], ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(ends) - 1)]
    kept = b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(text)], strict=True))
    return kept, int((ends - begins).sum()), len(begins)


def remove_repeats(documents: DataFrame, rules: RepeatRules = RepeatRules(), with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the bytes kept, if asked for)."""
    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with Scratch(documents.sparkSession) as scratch:
        if not narrow.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
            return scratch.result(_removed(narrow, rules, with_text, scratch), "repeats")
        # ids by the order of rows take the place of ids that do not tell rows apart
        ordered = narrow.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        rows = scratch.keep(ordered.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
        found = _removed(rows.select(F.col("row").alias("doc_id"), "text"), rules, with_text, scratch).withColumnRenamed("doc_id", "row")
        return scratch.result(rows.select("row", "doc_id").join(found, "row").drop("row"), "repeats")


def _removed(narrow: DataFrame, rules: RepeatRules, with_text: bool, scratch: Scratch) -> DataFrame:
    """As ``remove_repeats``, of (doc_id, text) with different ids; the result rests on tables of ``scratch``."""
    spark = narrow.sparkSession
    family = SuffixFamily(spark, rules, hot_prefixes(narrow, rules))
    cuts = sorted({int(c) for c in narrow.approxQuantile("doc_id", [k / rules.batches for k in range(1, rules.batches)], 0.01)}) if rules.batches > 1 else []
    edges = [None, *cuts, None]
    for k in range(len(edges) - 1):
        batch = narrow
        if edges[k] is not None:
            batch = batch.filter(F.col("doc_id") >= edges[k])
        if edges[k + 1] is not None:
            batch = batch.filter(F.col("doc_id") < edges[k + 1])
        family.add(batch, last=k == len(edges) - 2)
    scratch.paths += family.findings
    single = scratch.keep(open_windows(narrow, family.found(OPEN), rules), "windows").withColumn("count", F.lit(1).cast("bigint"))
    release(spark)
    runs = family.found(REMOVED).select("doc_id", "start", "count").unionByName(single).groupBy("doc_id").agg(F.collect_list(F.struct("start", "count")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                start, count = (np.array([r[k] for r in found or []], np.int64) for k in ("start", "count"))
                kept, removed, spans = cut_text(raw, start, count, rules.length)
                rows.append((doc, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            if rows:
                doc, size, removed, spans, sha, kept = zip(*rows, strict=True)
                numbers = [pa.array(c, pa.int64()) for c in (doc, size, removed, spans)]
                columns = [*numbers, pa.array(sha, pa.string()), *([pa.array(kept, pa.binary())] if with_text else [])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")
    return narrow.join(runs, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(cut, schema)
