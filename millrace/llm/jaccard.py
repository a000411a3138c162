"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles fall into size bands whose ends differ by the threshold, so sets that can link lie in one band
or in neighbours. Per pair of neighbouring bands the largest symmetric difference k of a linking pair is known. The
feature domain (the 64-bit hashes) is cut into n1 ranges and these into n2 parts; as at most k features differ, some
range differs in at most k2 parts, and the subsets of n2 - k2 of its parts are enumerated: one of them is the same in
both sets. The hash of the features in that subset is the signature.

A set of ``size`` features differs from any partner by at most d(size) <= k features, so n1 - d / (k2 + 1) ranges
serve, more than one for all but the largest sets. Ranges with a subset of less than ``floor`` features are poor: the
subset says little and meets unrelated sets. A set with fewer poor ranges than serving ones leaves its poor subsets
out: some serving range of its is not poor, and the subset on which it agrees with the partner is one the partner
keeps too, having the same features. ``instance`` chooses n1, n2 and k2 so that nearly all sets can do so. No link is
lost either way.

Copies with equal sets are one class and join as one. Classes that share a signature are first compared with the least
of them (a star, one row per member): by parity sketches, whose distance never exceeds the symmetric difference, and
what passes by the sets. Links give components. Only signatures whose members are in different components go on: each
member outside the signature's largest component is compared with all others by sketches, in blocks of bounded size
that many tasks share, and what passes is verified on the sets. So near copies in the thousands cost rows in
proportion, and all links that join two components are found.

A signature's rows meet in one task, which reads them in order and holds one at a time. A set has hundreds of
signatures and each of them once, so the share of rows that one signature can have is the reciprocal of that.

Defined results: null or empty text has no shingles and links with nothing; a text with fewer words than a shingle is
one shingle; rows with equal sets are one class; repeated doc_ids are one document per row; a null doc_id names no
component: its row gets the ids of rows with an equal set, else null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_pieces, give_back, only_ids
from .components import components
from .shingles import mix, shingle_sets

SKETCH_BYTES = 64
#: Members of a signature that one task of ``open_pairs`` holds.
BLOCK_MEMBERS = 4096


@dataclass(frozen=True)
class JaccardJoin:
    """Two sets link when ``den`` * intersection >= ``num`` * union, over shingles of ``size`` words."""

    size: int = 5
    num: int = 80
    den: int = 100
    #: Bits of a set's first id. Fewer than 64 make ids of different sets collide, as a test of that.
    id_bits: int = 64


@dataclass(frozen=True)
class Instance:
    """How sets of a pair of neighbouring bands are signed."""

    index: int
    high: int
    n1: int
    n2: int
    k2: int
    floor: int


def distance_bound(total: int, num: int, den: int) -> int:
    """Largest symmetric difference of linking sets whose sizes add up to ``total``."""
    return total * (den - num) // (den + num)


@lru_cache(maxsize=100_000)
def band(size: int, num: int, den: int) -> tuple[int, int, int]:
    """(index, least, greatest size) of the band of ``size``."""
    index, low = 0, 1
    while True:
        high = max(low, low * den // num)
        if size <= high:
            return index, low, high
        index, low = index + 1, high + 1


def spare_ranges(size: int, high: int, n1: int, k2: int, num: int, den: int) -> int:
    """Ranges beyond the first that serve between a set of ``size`` and any partner of at most ``high``."""
    return n1 - 1 - distance_bound(size + min(high, size * den // num), num, den) // (k2 + 1)


def _few(mean: float, floor: int) -> float:
    """The probability that fewer than ``floor`` features fall where ``mean`` are expected."""
    return math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(floor))


@lru_cache(maxsize=100_000)
def instance(index: int, low: int, high: int, num: int, den: int) -> Instance | None:
    """The signing of sizes ``low`` to ``high``, two bands; None if only equal sets can link.

    Of the plans under which poor ranges are all but certain to be spare at every size, the one with the highest floor
    and then the fewest signatures. Small sets have no such plan; theirs has the fullest subsets, up to six features.
    """
    k = distance_bound(2 * high, num, den)
    if k == 0:
        return None
    sizes = sorted({low + (high - low) * i // 6 for i in range(7)})

    def spared(n1: int, n2: int, k2: int, floor: int) -> bool:
        for size in sizes:
            poor = n1 * min(1.0, math.comb(n2, k2) * _few(size * (n2 - k2) / (n1 * n2), floor))
            if poor + 2.5 * math.sqrt(poor) > spare_ranges(size, high, n1, k2, num, den):
                return False
        return True

    best = None
    for k2, more, floor in itertools.product((1, 2), (1, 2), (1, 2, 3)):
        n1, n2 = k // (k2 + 1) + 1, k2 + more
        subsets = math.comb(n2, k2)
        while n1 * subsets <= 3 * (k + 1):
            if spared(n1, n2, k2, floor):
                rank = (floor, -n1 * subsets)
                if best is None or rank > best[0]:
                    best = (rank, Instance(index, high, n1, n2, k2, floor))
                break
            n1 += 1 + n1 // 64
    if best is None:
        for n1 in range(1, k + 2):
            k2 = -(-(k + 1) // n1) - 1
            for n2 in range(k2 + 1, k2 + 6):
                cost, full = n1 * math.comb(n2, k2), min(6.0, high * num / den * (n2 - k2) / (n1 * n2))
                if cost <= 4 * (k + 1) and (best is None or (full, -cost) > best[0]):
                    best = ((full, -cost), Instance(index, high, n1, n2, k2, 1))
    return best[1]


@lru_cache(maxsize=100_000)
def instances(size: int, num: int, den: int) -> tuple[Instance, ...]:
    """The signing of a set with its own band and the one below, and with the one above."""
    index, low, high = band(size, num, den)
    below = band(low - 1, num, den)[1] if low > 1 else low
    after = band(high + 1, num, den)
    return tuple(p for p in (instance(index, below, high, num, den), instance(after[0], low, after[2], num, den)) if p)


def signatures(features: np.ndarray, join: JaccardJoin) -> np.ndarray:
    """The signatures of one sorted set, for its own band and the next."""
    found = []
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(features ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        for plan in instances(len(features), join.num, join.den) if len(features) else ():
            parts = plan.n1 * plan.n2
            where = ((features >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            cuts = np.searchsorted(where, np.arange(parts + 1, dtype=np.uint64))
            part_sums = (sums[cuts[1:]] - sums[cuts[:-1]]).reshape(plan.n1, plan.n2)
            counts = np.diff(cuts).reshape(plan.n1, plan.n2)
            subsets = [list(s) for s in itertools.combinations(range(plan.n2), plan.n2 - plan.k2)]
            values = np.stack([part_sums[:, s].sum(axis=1, dtype=np.uint64) for s in subsets], axis=1)
            poor = np.stack([counts[:, s].sum(axis=1) for s in subsets], axis=1) < plan.floor
            keys = np.arange(values.size, dtype=np.uint64).reshape(values.shape)
            salt = mix(np.array([plan.index + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            signed = mix(mix(values + salt) + keys)
            spare = spare_ranges(len(features), plan.high, plan.n1, plan.k2, join.num, join.den)
            found.append(signed[~poor] if poor.any(axis=1).sum() <= spare else signed.ravel())
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def set_ids(features: np.ndarray, join: JaccardJoin, clashing: frozenset[int] = frozenset()) -> tuple[int, int]:
    """Two independent signed 64-bit ids of a set. Where the first is one that ``clashing`` sets share, both make it up."""
    data = features.tobytes()
    a, b = (xxhash.xxh3_128_intdigest(data) >> 64) >> (64 - join.id_bits), xxhash.xxh64_intdigest(data, 7)
    a, b = a - 2**64 * (a >> 63), b - 2**64 * (b >> 63)
    return (a ^ b if a in clashing else a), b


def sketch(features: np.ndarray) -> bytes:
    """Parity of the features in each of some four cells a feature: two sketches differ in no more cells than the sets."""
    cells = 8 * SKETCH_BYTES
    while cells < 4 * len(features):
        cells *= 2
    odd = np.bincount((mix(features) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(cells: bytes, size: int) -> np.ndarray:
    """The sketch the set would have in ``size`` bytes, which divide the given ones."""
    return np.bitwise_xor.reduce(np.frombuffer(cells, np.uint8).reshape(-1, size), axis=0)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for part in arrow_pieces(batch, 1, 1_000_000):
        yield from zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), size), strict=True)
    give_back()


def set_table(documents: DataFrame, join: JaccardJoin) -> DataFrame:
    """(doc_id, n_shingles, set_id, check, sketch, cells): a row per document; set_id is null for empty sets."""
    names = ["doc_id", "n_shingles", "set_id", "check", "sketch", "cells"]
    types = [pa.int64()] * 4 + [pa.binary()] * 2

    def row(doc: int, f: np.ndarray) -> tuple:
        if not len(f):
            return doc, 0, None, None, None, None
        cells = sketch(f)
        return doc, len(f), *set_ids(f, join), folded(cells, SKETCH_BYTES).tobytes(), cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(row(d, f) for d, f in _sets(batch, join.size)), strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return documents.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_id bigint, check bigint, sketch binary, cells binary")


#: Ids that sets share by chance: n * n / 2**65 are expected, three among ten billion sets.
MOST_CLASHES = 100_000


def apart(sets: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """``sets`` (set_id, check, ...) with another id for sets that share theirs with a different set, and the shared ids."""
    shared = sets.filter("set_id is not null").groupBy("set_id").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low <> high")
    found = frozenset(r.set_id for r in shared.select("set_id").limit(MOST_CLASHES + 1).collect())
    if len(found) > MOST_CLASHES:
        raise RuntimeError("far more sets share an id than chance allows")
    if not found:
        return sets, found
    clash = F.broadcast(shared.select(F.col("set_id").alias("_shared")))
    joined = sets.join(clash, F.col("set_id") == F.col("_shared"), "left")
    return joined.withColumn("set_id", F.when(F.col("_shared").isNull(), F.col("set_id")).otherwise(F.col("set_id").bitwiseXOR(F.col("check")))).drop("_shared"), found


def signature_rows(documents: DataFrame, join: JaccardJoin, clashing: frozenset[int] = frozenset()) -> DataFrame:
    """(sig, set_id), once per batch of texts: copies and hot signatures shrink before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            sigs: list[np.ndarray] = []
            owners: list[np.ndarray] = []
            for _, f in _sets(batch, join.size):
                if len(f) == 0 or (own := set_ids(f, join, clashing)[0]) in seen:
                    continue
                seen.add(own)
                s = signatures(f, join)
                sigs.append(s.view(np.int64))
                owners.append(np.full(len(s), own, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(owners))], names=["sig", "set_id"])

    return documents.mapInArrow(run, "sig bigint, set_id bigint")


def shared_signatures(rows: DataFrame) -> DataFrame:
    """(sig, set_id, hub): members of signatures that at least two sets have; hub is the least set_id of the signature.

    The rows of a signature arrive in order, so a task holds one row of it at a time, whatever its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig = hub = last = None
        announced = False
        for batch in batches:
            s, o = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(s):
                continue
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
            if sig is not None and s[0] == sig and o[0] == last:
                fresh[0] = False
            s, o = s[fresh], o[fresh]
            if not len(s):
                continue
            first = np.ones(len(s), bool)
            first[1:] = s[1:] != s[:-1]
            carried = sig is not None and s[0] == sig
            begins = np.flatnonzero(first)
            hubs = np.repeat(o[begins], np.diff(np.append(begins, len(s))))
            sizes = np.repeat(np.diff(np.append(begins, len(s))), np.diff(np.append(begins, len(s))))
            keep = sizes > 1
            extra = None
            if carried:
                head = sizes[0]
                hubs[:head], keep[:head] = hub, True
                if not announced:
                    extra = hub
                    announced = True
            out_s, out_o, out_h = s[keep], o[keep], hubs[keep]
            if extra is not None:
                out_s, out_o, out_h = np.append(out_s, sig), np.append(out_o, extra), np.append(out_h, extra)
            tail = begins[-1]
            if not (carried and tail == 0):
                announced = len(s) - tail > 1
                hub = o[tail]
            sig, last = s[-1], o[-1]
            if len(out_s):
                yield pa.RecordBatch.from_arrays([pa.array(out_s), pa.array(out_o), pa.array(out_h)], names=["sig", "set_id", "hub"])

    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "sig").sortWithinPartitions("sig", "set_id").mapInArrow(run, "sig bigint, set_id bigint, hub bigint")


def set_contents(documents: DataFrame, join: JaccardJoin, clashing: frozenset[int] = frozenset()) -> DataFrame:
    """(set_id, features) of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(set_ids(f, join, clashing)[0], f.tobytes()) for _, f in _sets(batch, join.size) if len(f)]
            for a in range(0, len(rows), 1000):
                ids, features = zip(*rows[a : a + 1000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(features, pa.binary())], names=["set_id", "features"])

    return documents.mapInArrow(run, "set_id bigint, features binary")


def may_link(far, m, n, join: JaccardJoin):
    """Whether sets of sizes m and n whose sketches are ``far`` apart may link."""
    return (far * (join.den + join.num) <= (m + n) * (join.den - join.num)) & (np.minimum(m, n) * join.den >= join.num * np.maximum(m, n))


def possible(pairs: DataFrame, contents: DataFrame, join: JaccardJoin) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches (set_id, n, cells) leave a link possible; far smaller rows than the sets
    decide most."""

    def distance(x: bytes, y: bytes) -> int:
        size = min(len(x), len(y))
        return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.fromiter(map(distance, batch.column(4).to_pylist(), batch.column(5).to_pylist()), np.int64, batch.num_rows)
            mask = pa.array(may_link(far, batch.column(2).to_numpy(), batch.column(3).to_numpy(), join))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    left = contents.select(F.col("set_id").alias("a"), F.col("n").alias("m"), F.col("cells").alias("x"))
    right = contents.select(F.col("set_id").alias("b"), "n", F.col("cells").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, features: DataFrame, join: JaccardJoin) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(join.den * both >= join.num * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    left = features.select(F.col("set_id").alias("a"), F.col("features").alias("x"))
    right = features.select(F.col("set_id").alias("b"), F.col("features").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def open_members(rooted: DataFrame, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """The rows of ``rooted`` (sig, set_id, root) whose signature has several roots, with its most frequent one (main) and
    the number of blocks it is dealt to."""
    per_root = rooted.groupBy("sig", "root").agg(F.count("*").alias("n"))
    mixed = per_root.groupBy("sig").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("total"), F.count("*").alias("roots")).filter("roots > 1")
    return rooted.join(mixed.select("sig", "main", F.ceil(F.col("total") / block_members).cast("int").alias("blocks")), "sig")


def open_pairs(members: DataFrame, join: JaccardJoin) -> DataFrame:
    """(a, b): members (sig, set_id, root, main, blocks, n, sketch) of one signature in different components that may still link.

    Every such pair has a member outside the signature's largest component. Those members go to all blocks of the
    signature, the others to one; a task holds one block and sees the travelling members as they pass.
    """

    def compare(held: tuple, seen: tuple) -> Iterator[pa.RecordBatch]:
        ids, roots, sizes, bits = held
        step = max(1, 200_000 // len(ids))
        for at in range(0, len(seen[0]), step):
            i, r, m, b = (c[at : at + step] for c in seen)
            far = np.bitwise_count(b[:, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64)
            x, y = np.nonzero(may_link(far, m[:, None], sizes[None, :], join) & (r[:, None] != roots[None, :]))
            if len(x):
                a, b = i[x], ids[y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            sig, block, ids, roots, sizes = (batch.column(k).to_numpy() for k in (0, 1, 3, 4, 5))
            travels = batch.column(2).to_numpy(zero_copy_only=False)
            bits = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(len(sig), SKETCH_BYTES // 8)
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (block[1:] != block[:-1]) | (travels[1:] != travels[:-1])
            cuts = np.append(np.flatnonzero(new), len(sig))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (sig[a], block[a]) != key:
                    key, held = (sig[a], block[a]), []
                part = (ids[a:b], roots[a:b], sizes[a:b], bits[a:b])
                if not travels[a]:
                    held.append(part)
                elif held:
                    held = [tuple(np.concatenate(c) for c in zip(*held, strict=True))]
                    yield from compare(held[0], part)

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["sig", "block", "travels", "set_id", "root", "n", "sketch"]
    stay = members.withColumns({"block": F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"), "travels": F.lit(False)}).select(columns)
    travel = members.filter("root <> main").withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "travels": F.lit(True)}).select(columns)
    dealt = stay.unionByName(travel).repartition(n, "sig", "block").sortWithinPartitions("sig", "block", "travels")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def jaccard_components(documents: DataFrame, join: JaccardJoin = JaccardJoin()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id.

    component_id is the least doc_id that links lead to, class_id the least doc_id with an equal set.
    """
    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with Scratch(narrow.sparkSession) as scratch:
        sets = scratch.keep(set_table(narrow, join), "sets")
        sets, clashing = apart(sets)
        classes = scratch.keep(sets.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("class_id")), "classes")
        members = scratch.keep(shared_signatures(signature_rows(narrow, join, clashing)), "members")
        contents = sets.select("set_id", F.col("n_shingles").alias("n"), "sketch", "cells").join(members.select("set_id").distinct(), "set_id", "left_semi")
        contents = scratch.keep(contents.dropDuplicates(["set_id"]), "contents")

        def linked(pairs: DataFrame) -> DataFrame:
            for name in ("sketch", "cells"):
                near = only_ids(contents, scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "ends"), "set_id")
                pairs = scratch.keep(possible(pairs, near.select("set_id", "n", F.col(name).alias("cells")), join), "pairs")
            ends = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(classes, "set_id")
            features = set_contents(only_ids(narrow, scratch.keep(ends.select(F.col("class_id").alias("doc_id")).distinct(), "ends"), "doc_id"), join, clashing)
            features = scratch.keep(features.dropDuplicates(["set_id"]), "features")
            return scratch.keep(verified(pairs, features, join), "links")

        star = members.filter("set_id <> hub").select(F.col("hub").alias("a"), F.col("set_id").alias("b")).distinct()
        links = linked(scratch.keep(star, "star"))
        roots = scratch.keep(components(links), "roots")
        rooted = members.select("sig", "set_id").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        left = scratch.keep(open_members(scratch.keep(rooted, "rooted")), "open")
        more = linked(scratch.keep(open_pairs(left.join(contents.select("set_id", "n", "sketch"), "set_id"), join), "open-pairs"))
        roots = components(links.unionByName(more)).withColumnRenamed("node", "set_id")
        rooted = scratch.keep(classes.join(roots, "set_id", "left").select("set_id", "class_id", F.coalesce("root", "set_id").alias("root")), "rooted")
        named = rooted.groupBy("root").agg(F.min("class_id").alias("component_id"))
        labels = rooted.join(named, "root").select("set_id", "class_id", "component_id")
        found = sets.select("doc_id", "n_shingles", "set_id").join(labels, "set_id", "left")
        return scratch.result(found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id")), "jaccard")
