"""SentencePiece encoding and decoding over a relational lattice.

Words are counted over the whole corpus. The frequent ones, at most ``table_words``, are encoded in Spark: their
substrings of bounded length are exploded, equi-joined to the piece table, grouped by word into the word's edges, and
folded with a higher-order aggregate. The result is a table of bounded size that is broadcast to the pass over the
documents. Words outside it get the same lattice and fold inside the task that meets them, all words of a piece of text
at once: their substrings walk the piece table as a trie, and rounds merge one pair of neighbours in every word. Sending
these words through a shuffle would move every document's rare words.

Two folds are there. For a unigram model it is Viterbi: the path of edges with the greatest sum of scores. The public
model is a BPE model, whose segmentation is defined by merge order and which no sum of scores gives; for it the fold
merges, again and again, the neighbours whose union is the edge with the best score, the left one first. That is the
model's own rule, so ids equal the library's.

A word starts before a space sign that follows another sign; no piece crosses such a place, so words are encoded on
their own, and a word may be cut further where no piece has two neighbouring signs in a row. Signs without a piece become their UTF-8 bytes'
pieces. Decoding joins pieces and bytes, turns the sign back into spaces and drops the leading one.

Defined results: null text is empty; an empty text has no ids and decodes to itself; texts that hold the space sign
itself decode to a space there, as the model defines; repeated rows give repeated rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_pieces, gathered, give_back, let
from .tokens import tokenizer_path

SIGN = "▁"
#: Rare words remembered by a worker process.
CACHE_WORDS = 100_000
#: Signs of words that get their lattices at once, and of the longest word among them; longer ones go one by one.
LATTICE_SIGNS, LONG_WORD = 200_000, 64
NEVER = 2**31 - 1
#: Text is encoded in pieces of whole documents of about so many bytes.
PIECE_BYTES = 500_000


@dataclass(frozen=True)
class PieceRules:
    model: str = "piece_bpe_32k.model"
    table_words: int = 100_000
    longest_word: int = 64


class IntTable:
    """Numbers by 63-bit keys, for whole arrays of keys at once: one slot a key, and the keys that found theirs taken in order."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slots = self._slots(keys)
        self.keys[slots], self.values[slots] = keys, values
        late = self.keys[slots] != keys
        order = np.argsort(keys[late])
        self.late_keys, self.late_values = keys[late][order], values[late][order].astype(np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, 0 where there is none."""
        slots = self._slots(keys)
        hit = self.keys[slots] == keys
        found = np.where(hit, self.values[slots], 0)
        if len(self.late_keys):
            other = np.flatnonzero(~hit & (self.keys[slots] >= 0))
            place = np.minimum(np.searchsorted(self.late_keys, keys[other]), len(self.late_keys) - 1)
            late = self.late_keys[place] == keys[other]
            found[other[late]] = self.late_values[place[late]]
        return found


class Trie:
    """The pieces as a trie with nodes from 1; each node's rank (the best score has the least) and id, if it ends a piece."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        children: dict[int, int] = {}
        last: dict[str, int] = {}
        for p in pieces:
            node = 0
            for sign in p:
                node = children.setdefault(node << 21 | ord(sign), len(children) + 1)
            last[p] = node
        self.children = IntTable(np.fromiter(children.keys(), np.int64, len(children)), np.fromiter(children.values(), np.int64, len(children)))
        self.rank, self.ids = np.full(len(children) + 1, NEVER, np.int32), np.full(len(children) + 1, -1, np.int64)
        order = {s: k for k, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        for p, (i, score) in pieces.items():
            self.rank[last[p]], self.ids[last[p]] = order[score], i


@dataclass
class PieceTable:
    """A piece table: pieces with ids and scores, byte pieces, and how words are cut."""

    pieces: dict[str, tuple[int, float]]
    bytes_: list[int]
    unknown: int
    bpe: bool
    longest: int = field(init=False)
    pairs: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        self.pairs = frozenset(p[k : k + 2] for p in self.pieces for k in range(len(p) - 1))
        spelled = [b""] * (1 + max([*(i for i, _ in self.pieces.values()), *self.bytes_, self.unknown]))
        for b, i in enumerate(self.bytes_):
            spelled[i] = bytes([b])
        for p, (i, _) in self.pieces.items():
            spelled[i] = p.replace(SIGN, " ").encode("utf-8", "surrogatepass")
        self.spelled = pa.array(spelled, pa.large_binary())
        self.trie = Trie(self.pieces)

    @classmethod
    def load(cls, path: str) -> PieceTable:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = {m.id_to_piece(i): (i, m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        return cls(plain, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], m.unk_id(), True)

    def cut(self, word: str) -> list[str]:
        """A word cut wherever no piece has its two neighbouring signs in a row."""
        at = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.pairs), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:], strict=False)]

    def ids(self, symbols: list[str]) -> bytes:
        """The ids of symbols as little-endian u32; a sign without a piece is its bytes."""
        out: list[int] = []
        for s in symbols:
            found = self.pieces.get(s)
            if found is not None:
                out.append(found[0])
            else:
                out.extend(self.bytes_[b] for b in s.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(out)}I", *out)

    def edges(self, part: str) -> dict[tuple[int, int], float]:
        """The lattice of ``part``: the score of each (start, end) that is a piece."""
        get, n, longest = self.pieces.get, len(part), self.longest
        return {(a, b): e[1] for a in range(n) for b in range(a + 1, min(n, a + longest) + 1) if (e := get(part[a:b])) is not None}

    def fold(self, word: str) -> list[str]:
        """The symbols of one word by its lattice."""
        out: list[str] = []
        for part in self.cut(word) if len(word) > 48 else (word,):
            ends = (merged if self.bpe else viterbi)(len(part), self.edges(part))
            out.extend(part[a:b] for a, b in zip([0, *ends], ends, strict=False))
        return out

    def fold_all(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each of ``words``."""
        first = 0
        while first < len(words):
            stop, signs = first, 0
            while stop < len(words) and signs < LATTICE_SIGNS and self.bpe and len(words[stop]) <= LONG_WORD:
                signs, stop = signs + len(words[stop]), stop + 1
            if stop == first:
                yield self.ids(self.fold(words[first]))
                first += 1
            else:
                yield from self._fold_many(words[first:stop])
                first = stop

    def _fold_many(self, words: list[str]) -> list[bytes]:
        """As ``fold_all``, by lattices of all words at once: nodes[k, a] is the piece of k signs from place a."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n, ends = len(codes), np.cumsum(sizes)
        stop, word = np.repeat(ends, sizes), np.repeat(np.arange(len(words)), sizes)
        nodes = np.zeros((self.longest + 1, n), np.int32)
        at, node = np.arange(n), np.zeros(n, np.int64)
        for k in range(1, self.longest + 1):
            inside = at + k <= stop[at]
            at, node = at[inside], node[inside]
            node = self.trie.children.get(node << 21 | codes[at + k - 1]).astype(np.int64)
            at, node = at[node > 0], node[node > 0]
            if not len(at):
                break
            nodes[k, at] = node
        # symbols that may still merge: where they start, their words, and the rank of each with the one after it
        place, after, alive = np.arange(n), np.arange(1, n + 1), np.ones(n, bool)

        def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            size = after[right] - left
            return np.where(size <= self.longest, self.trie.rank[nodes[np.minimum(size, self.longest), left]], NEVER)

        rank = np.append(np.where(word[1:] == word[:-1], ranks(place[:-1], place[1:]), NEVER), NEVER)
        while len(place):
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, begins)
            each = np.diff(np.append(begins, len(place)))
            on = np.repeat(best < NEVER, each)
            target = np.repeat(best, each)[on]
            place, word, rank = place[on], word[on], rank[on]
            hits = np.flatnonzero(rank == target)
            if not len(hits):
                break
            hits = hits[np.append(True, word[hits][1:] != word[hits][:-1])]
            alive[place[hits + 1]] = False
            after[place[hits]] = after[place[hits + 1]]
            keep = np.ones(len(place), bool)
            keep[hits + 1] = False
            place, word, rank = place[keep], word[keep], rank[keep]
            hits -= np.arange(len(hits))
            for left in (hits, hits[hits > 0] - 1):
                rank[left] = NEVER
                pair = left[left + 1 < len(place)]
                pair = pair[word[pair] == word[pair + 1]]
                rank[pair] = ranks(place[pair], place[pair + 1])
        starts = np.flatnonzero(alive)
        ids = self.trie.ids[nodes[np.minimum(after[starts] - starts, self.longest), starts]]
        lone = np.flatnonzero(ids < 0)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[starts[lone]].tolist()]
        count = np.ones(len(starts), np.int64)
        count[lone] = [len(r) for r in raw]
        flat = np.repeat(ids, count)
        first = np.cumsum(count) - count
        for a, r in zip(first[lone].tolist(), raw, strict=True):
            flat[a : a + len(r)] = [self.bytes_[b] for b in r]
        cuts = 4 * np.append(first, len(flat))[np.searchsorted(starts, np.append(0, ends))]
        data = flat.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that ``ids`` spell, and where each of the texts ends whose last ids are at ``ends``."""
        found = self.spelled.take(pa.array(ids, pa.int64()))
        if not len(found):
            return b"", np.zeros(len(ends), np.int64)
        offsets = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, 8 * found.offset)
        return memoryview(found.buffers()[2])[offsets[0] : offsets[-1]].tobytes(), (offsets - offsets[0])[ends]


def merged(n: int, edges: dict[tuple[int, int], float]) -> list[int]:
    """Merge the best scored neighbours, the left ones first, until none is an edge; the ends of what is left.

    Long runs use a heap, so the cost is n log n.
    """
    if n > 48:
        return _merged_long(n, edges)
    get, none = edges.get, float("-inf")
    at = list(range(n + 1))
    scores = [get((k, k + 2), none) for k in range(n - 1)]
    while scores:
        best = max(scores)
        if best == none:
            break
        k = scores.index(best)
        del at[k + 1], scores[k]
        if k:
            scores[k - 1] = get((at[k - 1], at[k + 1]), none)
        if k < len(scores):
            scores[k] = get((at[k], at[k + 2]), none)
    return at[1:]


def _merged_long(n: int, edges: dict[tuple[int, int], float]) -> list[int]:
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that starts at each place
    alive = [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(a: int) -> None:
        if end[a] < n and (score := edges.get((a, end[end[a]]))) is not None:
            heapq.heappush(heap, (-score, a, end[end[a]]))

    for k in range(n):
        offer(k)
    while heap:
        _, a, stop = heapq.heappop(heap)
        if not alive[a] or end[a] >= n or end[end[a]] != stop:
            continue
        alive[end[a]], end[a] = False, stop
        if stop < n:
            before[stop] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [end[a] for a in range(n) if alive[a]]


def viterbi(n: int, edges: dict[tuple[int, int], float]) -> list[int]:
    """The ends along the path with the greatest sum of scores; a sign without a piece costs more than any path of pieces."""
    worst = min(edges.values(), default=0.0) - 10.0
    arriving: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for (a, b), score in edges.items():
        arriving[b].append((a, score))
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, n + 1):
        alone = () if (end - 1, end) in edges else ((end - 1, worst),)
        best.append(max(((best[a][0] + score, a) for a, score in (*arriving[end], *alone)), key=lambda x: x[0]))
    out = []
    while n:
        out.append(n)
        n = best[n][1]
    return out[::-1]


def worded(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of ``texts`` in a row, and how many each text has.

    A word starts at a text's start and at each space sign that another sign precedes.
    """
    seen = [(SIGN + t.replace(" ", SIGN)).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = b"".join(seen)
    sizes = np.array([len(t) for t in seen], np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(data, np.uint8)
    sign = np.zeros(len(raw) + 3, bool)  # moved on by three places, which is one sign
    if len(raw):
        sign[3:-2] = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
    start = sign[3:] & ~sign[:-3]
    start[(ends - sizes)[sizes > 0]] = True
    at = np.flatnonzero(start)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
    return words, np.diff(np.searchsorted(at, ends), prepend=0)


# The relational lattice


def lattice(words: DataFrame, table: PieceTable) -> DataFrame:
    """(word, edges): for each distinct ``word`` its substrings that are pieces, as structs (start, piece, id, score)."""
    spark = words.sparkSession
    pieces = spark.createDataFrame([(p, i, float(s)) for p, (i, s) in table.pieces.items()], "piece string, id int, score double")
    n = F.length("word")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda a: F.transform(F.sequence(F.lit(1), F.least(F.lit(table.longest), n - a + 1)), lambda k: F.struct(a.alias("start"), F.substring(F.col("word"), a, k).alias("piece"))),
        )
    )
    # the piece table has a fixed number of rows, so it is broadcast
    edges = words.select("word", F.explode(spans).alias("e")).select("word", "e.*").join(F.broadcast(pieces), "piece")
    return edges.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("start", "piece", "id", "score"))).alias("edges"))


def merge_fold(word: Column, edges: Column) -> Column:
    """The symbols of a word under a BPE table, by an aggregate over its length."""

    def step(symbols: Column, scores: Column) -> Column:
        def best(found: Column) -> Column:
            k = -found["minus_at"]
            merged = F.concat(F.get(symbols, k), F.get(symbols, k + 1))
            joined = F.concat(F.slice(symbols, F.lit(1), k), F.array(merged), F.slice(symbols, k + 3, F.size(symbols)))
            return F.when(found["score"].isNull(), symbols).otherwise(joined)

        options = F.transform(
            F.slice(symbols, F.lit(1), F.greatest(F.size(symbols) - 1, F.lit(0))),
            lambda s, k: F.struct(F.element_at(scores, F.concat(s, F.get(symbols, k + 1))).alias("score"), (-k).alias("minus_at")),
        )
        return F.when(F.size(symbols) < 2, symbols).otherwise(let(F.array_max(options), best))

    letters = F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.substring(word, k, F.lit(1)))
    scores = F.map_from_entries(F.array_distinct(F.transform(edges, lambda e: F.struct(e["piece"].alias("key"), e["score"].alias("value")))))
    return let(scores, lambda m: F.aggregate(F.sequence(F.lit(1), F.length(word)), letters, lambda acc, _: step(acc, m)))


def viterbi_fold(word: Column, edges: Column, worst: float) -> Column:
    """The symbols of a word under a unigram table: states are the best (score, path) up to each place."""

    def step(states: Column, end: Column) -> Column:
        arriving = F.filter(edges, lambda e: e["start"] + F.length(e["piece"]) - 1 == end)
        options = F.transform(
            arriving, lambda e: F.struct((F.get(states, e["start"] - 1)["score"] + e["score"]).alias("score"), (-e["start"]).alias("order"), F.concat(F.get(states, e["start"] - 1)["path"], F.array(e["piece"])).alias("path"))
        )
        alone = F.struct(
            (F.get(states, end - 1)["score"] + worst).alias("score"), (-end).alias("order"), F.concat(F.get(states, end - 1)["path"], F.array(F.substring(word, end, F.lit(1)))).alias("path")
        )
        known = F.exists(arriving, lambda e: e["start"] == end)
        return F.concat(states, F.array(F.array_max(F.when(known, options).otherwise(F.concat(options, F.array(alone))))))

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("order"), F.array().cast("array<string>").alias("path")))
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), first, step, lambda acc: F.element_at(acc, -1)["path"])


def encode_words(words: DataFrame, table: PieceTable) -> DataFrame:
    """(word, symbols) of a table of distinct words."""
    graph = words.join(lattice(words, table), "word", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<start:int,piece:string,id:int,score:double>>")))
    if table.bpe:
        return graph.select("word", merge_fold(F.col("word"), F.col("edges")).alias("symbols"))
    worst = min((s for _, s in table.pieces.values()), default=0.0) - 10.0
    return graph.select("word", viterbi_fold(F.col("word"), F.col("edges"), worst).alias("symbols"))


_tables: dict[str, PieceTable] = {}
_rare: dict[str, dict[str, bytes]] = {}


def piece_table(name: str) -> PieceTable:
    """One table per worker process and model file."""
    path = tokenizer_path(name)
    if path not in _tables:
        _tables[path] = PieceTable.load(path)
    return _tables[path]


def word_counts(documents: DataFrame, rules: PieceRules) -> DataFrame:
    """(word, n): how often each word occurs; counts are combined per piece of text before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow_pieces(batch, 0, PIECE_BYTES):
                words, _ = worded([t or "" for t in part.column(0).to_pylist()])
                n = pa.array(np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)), pa.int64())
                short = pc.less_equal(pc.utf8_length(words.dictionary), rules.longest_word)
                yield pa.RecordBatch.from_arrays([words.dictionary.filter(short).cast(pa.string()), n.filter(short)], names=["word", "n"])

    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, rules: PieceRules) -> DataFrame:
    """The words over the least frequency that leaves at most ``table_words``, chosen from a histogram of few rows."""
    step = F.floor(F.log2("n") * 8).cast("int")
    left, least = rules.table_words, None
    for s, words in counts.filter("n > 1").groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        left -= words
        if left < 0:
            break
        least = s
    return counts.filter(step >= least if least is not None else F.lit(False)).select("word")


def frequent_table(documents: DataFrame, rules: PieceRules) -> list[tuple[str, list[str]]]:
    """The symbols of the most frequent words; at most ``table_words`` rows, which is why they may be collected."""
    with Scratch(documents.sparkSession) as scratch:
        counts = scratch.keep(word_counts(documents, rules).filter("n > 1"), "words")
        n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        words = frequent_words(counts, rules).repartition(n)
        return [(r[0], list(r[1])) for r in encode_words(words, piece_table(rules.model)).collect()]


def _encode_batch(texts: list[str], rules: PieceRules, known: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``texts`` in a row, and where each text's end."""
    table = piece_table(rules.model)
    rare = _rare.setdefault(rules.model, {})
    words, counts = worded(texts)
    distinct = words.dictionary.to_pylist()
    values = [known.get(w) or rare.get(w) for w in distinct]
    missing = [k for k, v in enumerate(values) if v is None]
    if len(rare) > CACHE_WORDS:
        rare.clear()
    for k, v in zip(missing, table.fold_all([distinct[k] for k in missing]), strict=True):
        values[k] = v
        if len(distinct[k]) <= rules.longest_word:
            rare[distinct[k]] = v
    ids, ends = gathered(values, words.indices.to_numpy())
    return ids, np.append(0, ends)[np.cumsum(counts)]


def shared_words(spark: SparkSession, documents: DataFrame, rules: PieceRules):
    """The broadcast table of frequent words as ids."""
    table = piece_table(rules.model)
    return spark.sparkContext.broadcast({word: table.ids(symbols) for word, symbols in frequent_table(documents, rules)})


RESULT = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, n_chars bigint, round_trip boolean"


def encode_documents(documents: DataFrame, rules: PieceRules = PieceRules(), with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids_crc32 (of the ids as little-endian u32), n_chars of the decoded text,
    and whether decoding gives the text back; with the ids themselves if asked for."""
    spark = documents.sparkSession
    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = shared_words(spark, narrow, rules)
    names = ["doc_id", "n_pieces", "ids_crc32", "n_chars", "round_trip", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow_pieces(batch, 1, PIECE_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, ends = _encode_batch(texts, rules, known.value)
                plain, stops = piece_table(rules.model).decoded(ids, ends)
                raw, view = memoryview(ids.astype("<u4")).cast("B"), np.frombuffer(plain, np.uint8)
                letters = np.append(0, np.cumsum((view & 0xC0) != 0x80))[stops]
                starts = np.append(0, stops[:-1])
                same = []
                for t, a, b in zip(texts, starts.tolist(), stops.tolist(), strict=True):
                    same.append(plain[a + (b > a) : b] == t.replace(SIGN, " ").encode("utf-8", "surrogatepass"))
                begins = np.append(0, ends[:-1])
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [
                    part.column(0),
                    pa.array(ends - begins, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(np.diff(letters, prepend=0) - (stops > starts), pa.int64()),
                    pa.array(same, pa.bool_()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)
            give_back()

    return narrow.mapInArrow(run, RESULT + (", ids array<int>" if with_ids else ""))
