"""Benchmark decontamination by template canonicalisation.

Words of benchmark items and documents are brought to templates: numbers, units after numbers and names (capitalised
words inside a sentence) become typed placeholders, other words lose their case. Windows of template words are hashed
and joined; matches that lie on one diagonal of a document and an item are one alignment. An alignment counts if its
windows cover enough of the item and if its slots are consistent: one value of the item always meets the same value
in the document and the other way round. So a question with other numbers and names is caught, and a text that only
happens to share a frame of words is not. A window of placeholders with too few plain words says nothing as a template;
items that have no other windows, such as rows of numbers, are joined by the words themselves.

The benchmark is the broadcast side of the join: sorted arrays of some 35 bytes a window. It goes in blocks of at most
``block_windows`` windows, each its own pass over the documents, so what is broadcast is bounded whatever the
benchmark's size. Documents are not shuffled.

Defined results: null and empty texts match nothing; items with fewer words than a window are one window; equal items
are one, under their least item_id; repeated documents give repeated rows; empty tables give an empty result; other
columns are ignored by ``contaminations`` and kept by ``clean_documents``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pieces
from .shingles import _BASE, _BYTE_VALUES, _LOWER, mix, powers

#: Units that count as such after a number.
UNITS = (
    "cm centimeters centimetres centimeter cents cent coins day days dollar dollars euro euros feet foot g gallon gallons gram grams hour hours inch inches kg kilogram kilograms kilometer kilometers kilometre kilometres km lb lbs liter liters litre litres m meter meters metre metres mg mile miles min minute minutes ml mm month months mph ounce ounces oz percent pound pounds second seconds ton tons week weeks yard yards year years"
).split()

WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63, 58]] = True


@dataclass(frozen=True)
class TemplateRules:
    """``window`` words a window; an alignment counts from ``min_share`` of the item's windows, or from ``min_run`` words."""

    window: int = 8
    min_words: int = 4
    min_share: float = 0.5
    min_run: int = 20
    block_windows: int = 1_000_000


@dataclass
class Templates:
    """Template words of one batch of texts."""

    hashes: np.ndarray
    literal: np.ndarray
    kinds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    data: bytes = field(repr=False)

    def value(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].lower()


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    at = np.repeat(starts, lengths) + place
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(_BYTE_VALUES[data[at]] * powers(int(lengths.max()))[place], first) + lengths.astype(np.uint64))


def templates(texts: list[bytes]) -> Templates:
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    inside = _IS_WORD[raw]
    digit = _IS_DIGIT[raw]
    cut = np.zeros(len(raw), bool)  # digits and letters are different words
    cut[1:] = inside[1:] & (~inside[:-1] | (digit[1:] != digit[:-1]))
    cut[0] = inside[0]
    starts = np.flatnonzero(cut)
    stop = np.zeros(len(raw) + 1, bool)
    stop[1:-1] = inside[:-1] & (~inside[1:] | (digit[1:] != digit[:-1]))
    stop[-1] = inside[-1]
    ends = np.flatnonzero(stop)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    if not len(starts):
        z = np.zeros(0, np.int64)
        return Templates(z.astype(np.uint64), z.astype(np.uint64), z, z, z, np.zeros(len(texts), np.int64), joined)
    number = digit[starts]
    # a number goes on over one point or comma between digits
    glued = np.zeros(len(starts), bool)
    glued[1:] = number[1:] & number[:-1] & (starts[1:] - ends[:-1] == 1) & np.isin(raw[np.maximum(starts[1:] - 1, 0)], (44, 46))
    keep = ~glued
    tail = np.append(np.flatnonzero(keep)[1:] - 1, len(starts) - 1)
    starts, ends, number = starts[keep], ends[tail], number[keep]
    hashes = _hash_words(np.frombuffer(joined.translate(_LOWER), np.uint8), starts, ends)
    kinds = np.full(len(starts), WORD)
    kinds[number] = NUMBER
    known = np.sort(_unit_hashes())
    slot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    unit = np.zeros(len(starts), bool)
    unit[1:] = (known[slot] == hashes)[1:] & number[:-1]
    kinds[unit] = UNIT
    marks = np.concatenate([[0], np.cumsum(_ENDS[raw])])
    opens = np.ones(len(starts), bool)  # first word of a sentence
    opens[1:] = marks[starts[1:]] > marks[ends[:-1]]
    lead, second = raw[starts], raw[np.minimum(starts + 1, len(raw) - 1)]
    upper = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    kinds[upper & ~opens & ~unit] = NAME
    slots = kinds != WORD
    literal = hashes.copy()
    hashes[slots] = mix(kinds[slots].astype(np.uint64))
    return Templates(hashes, literal, kinds, starts, ends, np.diff(np.searchsorted(starts, bounds), prepend=0), joined)


_units: np.ndarray | None = None


def _unit_hashes() -> np.ndarray:
    global _units
    if _units is None:
        data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
        sizes = np.array([len(u) for u in UNITS])
        starts = np.cumsum(sizes + 1) - sizes - 1
        _units = _hash_words(data, starts, starts + sizes)
    return _units


def windows(t: Templates, first: int, n: int, rules: TemplateRules) -> tuple[np.ndarray, np.ndarray]:
    """(window hashes, whether a window has enough plain words) of the text of ``n`` words from word ``first`` on.

    Windows with enough plain words are hashed as templates, the others as they stand.
    """
    if not n:
        return t.hashes[:0], np.zeros(0, bool)
    width = min(rules.window, n)

    def hashed(words: np.ndarray, start: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.full(n - width + 1, start, np.uint64)
            for k in range(width):
                h = mix(h * _BASE + words[first + k : first + n - width + 1 + k])
        return h

    plain = np.concatenate([[0], np.cumsum(t.kinds[first : first + n] == WORD)])
    ok = plain[width:] - plain[: n - width + 1] >= min(rules.min_words, width)
    h = hashed(t.hashes, width)
    return (h if ok.all() else np.where(ok, h, hashed(t.literal, width + (1 << 32)))), ok


class Index:
    """The windows of a block of items, ready to be broadcast: arrays only, in the order of their hashes."""

    def __init__(self, items: list[tuple[int, str]], rules: TemplateRules):
        self.rules = rules
        t = templates([x.encode("utf-8", "surrogatepass") for _, x in items])
        self.ids = np.array([i for i, _ in items], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(t.counts)])
        self.widths = np.minimum(rules.window, t.counts)
        self.totals = np.zeros(len(items), np.int64)
        self.kinds = t.kinds.astype(np.uint8)
        lengths = t.ends - t.starts
        self.value_ends = np.concatenate([[0], np.cumsum(lengths)])
        self.values = b"".join(t.value(k) for k in range(len(t.starts)))
        hashes, owners, places = [], [], []
        for k, n in enumerate(t.counts.tolist()):
            h, ok = windows(t, int(self.begins[k]), n, rules)
            at = np.flatnonzero(ok) if ok.any() else np.arange(len(ok))
            self.totals[k] = len(at)
            hashes.append(h[at])
            owners.append(np.full(len(at), k, np.int32))
            places.append(at.astype(np.int32))
        joined = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(joined, kind="stable")
        self.hashes, self.owners, self.places = joined[order], np.concatenate([*owners, np.zeros(0, np.int32)])[order], np.concatenate([*places, np.zeros(0, np.int32)])[order]
        self.short = sorted({int(w) for w in self.widths if 0 < w < rules.window})
        self.gate = np.zeros(1 << 22, bool)
        self.gate[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def kind(self, item: int, place: int) -> int:
        return int(self.kinds[self.begins[item] + place])

    def value(self, item: int, place: int) -> bytes:
        k = self.begins[item] + place
        return self.values[self.value_ends[k] : self.value_ends[k + 1]]

    def hits(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in the text, item, place in the item) of all windows that are equal."""
        near = np.flatnonzero(self.gate[(h >> np.uint64(42)).astype(np.int64)])
        if not len(near):
            return
        left, right = np.searchsorted(self.hashes, h[near]), np.searchsorted(self.hashes, h[near], side="right")
        for p, a, b in zip(near.tolist(), left.tolist(), right.tolist(), strict=True):
            for k in range(a, b):
                yield p, int(self.owners[k]), int(self.places[k])


def _consistent(index: Index, item: int, shift: int, runs: list[int], width: int, t: Templates, first: int) -> tuple[bool, bool]:
    """(slots consistent, text the same) of the windows of ``item`` at places ``runs``, found in the text ``shift`` on."""
    there: dict[bytes, bytes] = {}
    back: dict[bytes, bytes] = {}
    same = True
    done = -1
    for p in runs:
        for k in range(max(p, done), p + width):
            kind = index.kind(item, k)
            if kind == WORD:
                continue
            a, b = index.value(item, k), t.value(first + shift + k)
            same = same and a == b
            tag = bytes([kind])
            if there.setdefault(tag + a, b) != b or (kind == NAME and back.setdefault(tag + b, a) != a):
                return False, False
        done = p + width
    return True, same


def matches(t: Templates, first: int, n: int, index: Index) -> list[tuple[int, int, float, bool, int, int]]:
    """(item_id, windows, share, same text, first word, last word) of the items that one text contains."""
    rules = index.rules
    diagonals: dict[tuple[int, int], list[int]] = defaultdict(list)
    for p, item, q in index.hits(windows(t, first, n, rules)[0]):
        diagonals[item, p - q].append(q)
    for width in index.short:  # items shorter than a window
        if width < n:
            for p, item, q in index.hits(windows(t, first, n, TemplateRules(width, rules.min_words))[0]):
                if index.widths[item] == width:
                    diagonals[item, p - q].append(q)
    best: dict[int, tuple[int, int, float, bool, int, int]] = {}
    for (item, shift), runs in diagonals.items():
        width = int(index.widths[item])
        runs = sorted(set(runs))
        share = len(runs) / int(index.totals[item])
        longest = now = width
        for a, b in zip(runs, runs[1:], strict=False):
            now = now + b - a if b - a <= width else width
            longest = max(longest, now)
        if share < rules.min_share and longest < rules.min_run:
            continue
        fits, same = _consistent(index, item, shift, runs, width, t, first)
        if fits and (item not in best or best[item][1] < len(runs)):
            best[item] = (int(index.ids[item]), len(runs), share, same, shift + runs[0], shift + runs[-1] + width - 1)
    return list(best.values())


def load_blocks(benchmark: DataFrame, rules: TemplateRules) -> Iterator[Index]:
    """Indexes over all items, each of a bounded number of windows."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    held: list[tuple[int, str]] = []
    size = 0
    for r in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        held.append((r[0], r[1]))
        size += r[1].count(" ") + r[1].count("\n") + 1
        if size >= rules.block_windows:
            yield Index(held, rules)
            held, size = [], 0
    if held:
        yield Index(held, rules)


def _found(batch: pa.RecordBatch, column: int, index: Index) -> Iterator[tuple[int, list]]:
    at = 0
    for part in arrow_pieces(batch, column, 1_000_000):
        t = templates([(x or "").encode("utf-8", "surrogatepass") for x in part.column(column).to_pylist()])
        first = 0
        for n in t.counts.tolist():
            found = matches(t, first, n, index)
            if found:
                yield at, found
            first += n
            at += 1


RESULT = "doc_id bigint, item_id bigint, n_windows bigint, share double, same_text boolean, first_word bigint, last_word bigint"


def contaminations(documents: DataFrame, benchmark: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """One row per document and item it contains; documents without any have no row."""
    spark = documents.sparkSession
    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], RESULT)
    for k, index in enumerate(load_blocks(benchmark, rules)):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[k], *m) for k, found in _found(batch, 1, shared.value) for m in found]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], names=["doc_id", "item_id", "n_windows", "share", "same_text", "first_word", "last_word"])

        found = narrow.mapInArrow(run, RESULT)
        out = found if k == 0 else out.unionByName(found)
    return out


def clean_documents(documents: DataFrame, benchmark: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """The rows of ``documents`` that contain no item, all columns unchanged."""
    spark = documents.sparkSession
    column = documents.columns.index("text")
    for index in load_blocks(benchmark, rules):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for k, _ in _found(batch, column, shared.value):
                    keep[k] = False
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
