"""Token-id output: one zstandard dictionary for the corpus, one frame per document, an offset index per block.

File format. A file is a run of blocks in ascending doc_id order. A block is::

    magic "MRTK" | version u8 | id width u8 | dictionary hash u64 | documents n u32
    doc ids i64[n] | token counts u32[n] | frame offsets u64[n + 1] | frames

All numbers are little-endian. Each frame is one document's ids, compressed on its own with the shared dictionary, so
a short document is read by one seek and one small decompression. Blocks travel as binary rows of a table in the
shared folder: Spark's commit protocol covers lost executors, and any store that Spark can write works. The dictionary
lies beside the blocks as a table of one row, so any later session can read them.

Shards are ranges of doc_id and part files hold one shard each, in order, so the files are in ascending doc_id order
as they are named. Ids before a document: a block knows the count from the start of its shard (one task writes a shard
in order), and the shards' totals, at most ``MAX_SHARDS`` rows, are summed up and broadcast.

Strings that the tokenizer file declares as added tokens become their ids, as the library does it.

Defined results: null text is empty; an empty text holds the end id alone; rows with equal doc_id are ordered by their
frame; null doc_id comes first; an empty table writes no block; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_pieces, gathered, shared_path

MAX_SHARDS = 4096
HEADER = struct.Struct("<4sBBQI")
MAGIC, VERSION = b"MRTK", 1
#: Text is tokenized in pieces of whole documents of about so many characters.
PIECE_CHARS = 2_000_000
#: Words known in each of two generations; when the younger is full it becomes the older.
CACHE_WORDS = 250_000
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@dataclass(frozen=True)
class TokenOutput:
    """``dictionary_documents`` bounds the sample the dictionary is trained on, ``dictionary_ids`` the ids of each."""

    tokenizer: str = "byte_bpe_50k.json"
    end_id: int = 0
    level: int = 3
    dictionary_bytes: int = 65_536
    dictionary_documents: int = 400
    dictionary_ids: int = 8_192
    shard_documents: int = 20_000
    block_bytes: int = 250_000


def tokenizer_path(name: str) -> str:
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


def _char_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    #: The code points with the White_Space property.
    for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = SPACE
    return table


class Encoder:
    """Byte-level BPE through the tokenizers library's model, with words split for whole batches at once.

    The split follows the published pattern (contractions, optional space with a run of letters, numbers or other
    signs, white space); it is checked against the library's own ``encode`` by tests. Each distinct word is given to
    the library's model once while it is in the cache. Texts with added tokens are cut at them first.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        added = tokenizer.get_added_tokens_decoder()
        if any(x.lstrip or x.rstrip or x.single_word for x in added.values()):
            raise ValueError("added tokens that take neighbouring signs are not supported")
        self.added = {x.content: i for i, x in added.items() if x.content}
        self.cuts = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.letters = _byte_letters()
        self.classes = _char_classes()
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """The ids of a word as little-endian u32, which takes less room in the cache than numbers."""
        ids = [x.id for x in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def starts(self, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Whether a word starts at each code point; ``firsts``: where texts start (texts are not empty)."""
        n = len(codes)
        kind = self.classes[codes]
        start = np.empty(n, bool)
        start[0] = True
        start[1:] = kind[1:] != kind[:-1]
        start[firsts] = True
        last = np.zeros(n, bool)  # the last code point of a text
        last[firsts[1:] - 1] = True
        last[n - 1] = True
        space = kind == SPACE
        # a white space run before something else gives up its last sign: a plain space joins what follows
        tail = np.zeros(n, bool)
        tail[:-1] = space[:-1] & ~space[1:]
        tail &= ~last
        start |= tail
        joins = np.flatnonzero(tail & (codes == 32)) + 1
        start[joins] = False
        quotes = np.flatnonzero((codes == 39) & start)
        if len(quotes):
            padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
            # signs after a text's end belong to another text
            ends = np.append(firsts[1:], n)
            limit = ends[np.searchsorted(firsts, quotes, side="right") - 1]
            one, two = padded[quotes + 1], padded[quotes + 2]
            short = np.isin(one, [ord(c) for c in "stmd"]) & (quotes + 1 < limit)
            pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            pair &= quotes + 2 < limit
            size = np.where(short, 2, np.where(pair, 3, 0))
            hit, size = quotes[size > 0], size[size > 0]
            start[hit + 1] = False
            start[hit[size == 3] + 2] = False
            after = (hit + size)[hit + size < n]
            free = after[~space[after] | (np.where(after + 1 < n, space[np.minimum(after + 1, n - 1)], True)) | (codes[after] != 32)]
            start[free] = True
            start[after] = True
        return start

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in a row, and how many each text has."""
        if self.cuts is None or not any(map(self.cuts.search, texts)):
            return self._plain(texts)
        parts: list[str] = []
        after: list[int | None] = []  # the added token that follows a part
        owner: list[int] = []
        for k, t in enumerate(texts):
            at = 0
            for m in self.cuts.finditer(t):
                parts.append(t[at : m.start()])
                after.append(self.added[m[0]])
                at = m.end()
            parts.append(t[at:])
            after.append(None)
            owner.extend([k] * (len(parts) - len(owner)))
        ids, counts = self._plain(parts)
        marked = np.array([x is not None for x in after])
        ids = np.insert(ids, np.cumsum(counts)[marked], np.array([x for x in after if x is not None], np.uint32))
        return ids, np.bincount(np.array(owner), weights=counts + marked, minlength=len(texts)).astype(np.int64)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, of texts without added tokens."""
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        firsts = (ends - sizes)[sizes > 0]
        at = np.flatnonzero(self.starts(codes, firsts))
        width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
        before = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(width, out=before[1:])
        data = joined.encode("utf-8", "surrogatepass")
        offsets = np.append(before[at], len(data)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        get, get_older, learn = self.cache.get, self.older.get, self._word
        ids: list[bytes] = []
        for w in words.dictionary.to_pylist():
            found = get(w)
            if found is None:
                found = get_older(w) or learn(w)
                if len(w) <= 40:
                    self.cache[w] = found
            ids.append(found)
        out, out_ends = gathered(ids, words.indices.to_numpy())
        marks = np.searchsorted(at, ends)  # words before each text's end
        return out, np.diff(np.concatenate([[0], out_ends])[marks], prepend=0)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encoded(batch: pa.RecordBatch, conf: TokenOutput) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and ids, end id included, of the documents of a batch of (doc_id, text)."""
    path = tokenizer_path(conf.tokenizer)
    end = np.array([conf.end_id], np.uint32)
    for part in arrow_pieces(batch, 1, PIECE_CHARS):
        keys, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
        ids, counts = encoder(path).encode(texts)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        yield keys, [np.concatenate([ids[cuts[k] : cuts[k + 1]], end]) for k in range(len(keys))]


def train_dictionary(documents: DataFrame, conf: TokenOutput) -> bytes:
    """The shared dictionary, from at most ``dictionary_documents`` documents chosen by a hash of their id."""
    chosen = [r[0] for r in documents.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(conf.dictionary_documents).collect()]
    if not chosen:
        return b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids in _encoded(batch, conf):
                yield pa.RecordBatch.from_arrays([pa.array([x[: conf.dictionary_ids].astype("<u2" if conf_width(x) == 2 else "<u4").tobytes() for x in ids], pa.binary())], names=["ids"])

    sample = documents.filter(F.col("doc_id").isin(chosen)).select("doc_id", "text").mapInArrow(run, "ids binary").limit(conf.dictionary_documents)
    samples = [bytes(r[0]) for r in sample.collect()]
    try:
        return zstandard.train_dictionary(conf.dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples to train on: their plain bytes serve
        return b"".join(samples)[-conf.dictionary_bytes :]


def conf_width(ids: np.ndarray) -> int:
    return 2 if not len(ids) or ids.max() < 65_536 else 4


def _compression(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def pack_block(dictionary: bytes, width: int, keys: list, counts: list[int], frames: list[bytes]) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    ids = np.array([k if k is not None else -(2**63) for k in keys], "<i8")
    head = HEADER.pack(MAGIC, VERSION, width, xxhash.xxh64_intdigest(dictionary), len(keys))
    return b"".join([head, ids.tobytes(), np.array(counts, "<u4").tobytes(), offsets.tobytes(), *frames])


class Block:
    """A block read back: ``document(k)`` decompresses one document without touching the others."""

    def __init__(self, data: bytes | pa.Buffer, dictionary: bytes):
        data = memoryview(data)
        magic, version, self.width, mark, n = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token block")
        if mark != xxhash.xxh64_intdigest(dictionary):
            raise ValueError("the block was written with another dictionary")
        at = HEADER.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.counts = np.frombuffer(data, "<u4", n, at + 8 * n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 12 * n)
        self.data, self.base = data, at + 12 * n + 8 * (n + 1)
        d = _compression(dictionary)
        self.reader = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()

    def document(self, k: int) -> np.ndarray:
        frame = self.data[self.base + int(self.offsets[k]) : self.base + int(self.offsets[k + 1])]
        raw = self.reader.decompress(frame, max_output_size=int(self.counts[k]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write_tokens(documents: DataFrame, path: str, conf: TokenOutput = TokenOutput()) -> None:
    """Encode ``documents`` (doc_id, text) into the tables ``blocks`` and ``dictionary`` under ``path``."""
    spark = documents.sparkSession
    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = train_dictionary(narrow, conf)
    spark.createDataFrame([(xxhash.xxh64_hexdigest(dictionary), bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    total = narrow.count()
    shards = max(1, min(MAX_SHARDS, -(-total // conf.shard_documents)))
    cuts = narrow.select("doc_id").approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.1 / shards) if shards > 1 and total else []
    bounds = sorted({int(c) for c in cuts})

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _compression(shared.value)
        writer = zstandard.ZstdCompressor(level=conf.level, dict_data=d) if d else zstandard.ZstdCompressor(level=conf.level)
        for batch in batches:
            for keys, ids in _encoded(batch, conf):
                wide = [conf_width(x) for x in ids]
                frames = [writer.compress(x.astype(f"<u{w}").tobytes()) for x, w in zip(ids, wide, strict=True)]
                shard = np.searchsorted(bounds, [k if k is not None else -(2**63) for k in keys], side="right") if bounds else np.zeros(len(keys), int)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), pa.array(keys, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(wide, pa.int32()), pa.array(frames, pa.binary())],
                    names=["shard", "doc_id", "n_tokens", "width", "frame"],
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before, width = None, 0, 0
        keys: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            data = pack_block(shared.value, width, keys, counts, frames)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([sum(counts)], pa.int64()), pa.array([data], pa.binary())],
                names=["shard", "before", "n_docs", "n_tokens", "block"],
            )

        for batch in batches:
            for s, k, n, w, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if keys and (s != shard or w != width or held >= conf.block_bytes):
                    yield block()
                    before = before + sum(counts) if s == shard else 0
                    keys, counts, frames, held = [], [], [], 0
                shard, width = s, w
                keys.append(k)
                counts.append(n)
                frames.append(f)
                held += len(f)
        if keys:
            yield block()

    (
        narrow.mapInArrow(compress, "shard int, doc_id bigint, n_tokens bigint, width int, frame binary")
        .repartitionById(len(bounds) + 1, F.col("shard"))
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "frame")
        .mapInArrow(pack, "shard int, before bigint, n_docs bigint, n_tokens bigint, block binary")
        .write.option("compression", "none")  # frames are compressed already
        .option("parquet.block.size", 32 * conf.block_bytes)  # readers hold a row group at a time
        .parquet(f"{path}/blocks")
    )


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    """The dictionary that lies beside the blocks: one row of at most ``dictionary_bytes``."""
    mark, data = spark.read.parquet(f"{path}/dictionary").select("hash", "dictionary").first()
    if xxhash.xxh64_hexdigest(bytes(data)) != mark:
        raise ValueError("the dictionary is not the one that was written")
    return bytes(data)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the blocks under ``path``: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.parquet(f"{path}/blocks")
    shared = spark.sparkContext.broadcast(read_dictionary(spark, path))
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # at most MAX_SHARDS rows by construction, so one task can sum them up and every executor can hold them
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(data.as_buffer(), shared.value)
                counts = block.counts.astype(np.int64)
                starts = start + np.cumsum(counts) - counts
                sums = [zlib.crc32(block.document(k).tobytes()) for k in range(len(counts))]
                keys = pa.array(block.doc_ids, pa.int64(), mask=block.doc_ids == -(2**63))
                yield pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(F.broadcast(bases), "shard").select((F.col("before") + F.col("base")).alias("start"), "block").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_round_trip(documents: DataFrame, conf: TokenOutput = TokenOutput()) -> DataFrame:
    """Write the token files of ``documents`` to the shared folder and read every document back."""
    path = shared_path(documents.sparkSession, "tokens")
    write_tokens(documents, path, conf)
    return read_tokens(documents.sparkSession, path)
