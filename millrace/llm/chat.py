"""Chat formatting [native]: reply trees as conversations under a template, with a loss mask.

A node answers its parent. Jump tables (node → the node 1, 2, 4, ... replies above it) come from iterative self-joins,
so a thread of any depth takes a logarithm of rounds. Every leaf ends a branch; a branch's score is the mean of its
nodes' scores, summed along the jumps; the best branches of each root are enumerated by the same jumps, and only then
are texts joined and each path formatted as one conversation. Up to that point rows hold ids and numbers only, and every
join is on a node's own key, so a tree with a third of all nodes is dealt out like any other.

The template marks a turn as ``<turn role>``, its text and ``</turn>``, each on lines of their own. Inside texts and roles
``\\`` becomes ``\\b`` and ``<`` becomes ``\\l`` (in roles also ``>`` ``\\g``), so that no text can hold a mark, and undoing
them in the opposite order gives every text back. The loss mask is a list of code point ranges, one for each
assistant text, without its marks.

Defined results: null texts and roles count as empty, null scores as 0. A node whose parent is null or not in its tree is
a root. Of several rows with one node id the smallest by (parent, role, text, score) counts; a null node id is an id like
any other, which nothing can answer, and so is a null tree. Nodes of a circle of replies, and those below, reach no root
and are on no path. Equal scores: the smaller leaf goes first. Empty tables give none; other columns are ignored, whatever
their names. In ``linear_nodes`` turns that share a number go by role and text, those without one come last, and rows
without a conversation make up one of their own. A formatted conversation is one value, so it has to fit in a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, let, running

TURN_START, TURN_END = "<turn ", "</turn>\n"
TRAINED_ROLE = "assistant"


@dataclass(frozen=True)
class Branches:
    """How many branches of each root are formatted, best first."""

    keep: int = 1


def _unique(nodes: DataFrame) -> DataFrame:
    rest = F.min(F.struct("parent", "role", "text", "score")).alias("v")
    return nodes.groupBy("tree", "node").agg(rest).select("tree", "node", "v.*")


def linear_nodes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) as trees of one branch: each turn answers the one before. Nodes are unique."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    numbered = turns.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def jumps(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables (tree, node, up, gain): the ancestor 1, 2, 4, ... replies up, and the scores from the node to just below it.

    The last holds only nodes of circles, if there are any, as a path of all nodes is shorter.
    """
    ids = nodes.select(F.col("tree").alias("t"), F.col("node").alias("up"))
    own = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("gain")).filter(F.col("parent").isNotNull())
    now = scratch.keep(own.join(ids, own.tree.eqNullSafe(ids.t) & (own.parent == ids.up)).select("tree", "node", "up", "gain"), "jump")
    found, n = [], nodes.count()
    while now.count():
        found.append(now)
        if 2 ** (len(found) - 1) > n:
            break
        far = now.select(F.col("tree").alias("t"), F.col("node").alias("mid"), F.col("up").alias("top"), F.col("gain").alias("more"))
        joined = now.join(far, now.tree.eqNullSafe(far.t) & (now.up == far.mid))
        now = scratch.keep(joined.select("tree", "node", F.col("top").alias("up"), (F.col("gain") + F.col("more")).alias("gain")), "jump")
    return found


def branches(nodes: DataFrame, up: list[DataFrame], rules: Branches, scratch: Scratch) -> DataFrame:
    """(tree, root, leaf, n_turns, score, rank) of the best branches of each root. ``rank`` starts from 1."""
    n_all = nodes.count()
    circular = up[-1] if up and 2 ** (len(up) - 1) > n_all else None
    ids = nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("own"))
    leaves = ids
    if up:
        asked = up[0].select(F.col("tree").alias("t"), F.col("up").alias("u")).distinct()
        leaves = ids.join(asked, ids.tree.eqNullSafe(asked.t) & ids.node.eqNullSafe(asked.u), "left_anti")
    if circular is not None:
        lost = circular.select(F.col("tree").alias("t"), F.col("node").alias("u")).distinct()
        leaves = leaves.join(lost, leaves.tree.eqNullSafe(lost.t) & leaves.node.eqNullSafe(lost.u), "left_anti")
        up = up[:-1]
    now = leaves.select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0).cast("long").alias("steps"), F.lit(0.0).alias("total"))
    for k, table in reversed(list(enumerate(up))):
        j = table.select(F.col("tree").alias("t"), F.col("node").alias("u"), "up", "gain")
        joined = now.join(j, now.tree.eqNullSafe(j.t) & now["at"].eqNullSafe(j.u), "left")
        hit = F.col("up").isNotNull()
        now = joined.select(
            "tree", "leaf", F.when(hit, F.col("up")).otherwise(F.col("at")).alias("at"), (F.col("steps") + F.when(hit, 2**k).otherwise(0)).alias("steps"), (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total")
        )
    roots = ids.select(F.col("tree").alias("t"), F.col("node").alias("u"), "own")
    whole = now.join(roots, now.tree.eqNullSafe(roots.t) & now["at"].eqNullSafe(roots.u))
    scored = whole.select("tree", F.col("at").alias("root"), "leaf", (F.col("steps") + 1).alias("n_turns"), ((F.col("total") + F.col("own")) / (F.col("steps") + 1)).alias("score"))
    best = Window.partitionBy("tree", "root").orderBy(F.col("score").desc(), F.col("leaf").asc_nulls_last())
    return scratch.keep(scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= rules.keep), "branches")


def members(chosen: DataFrame, up: list[DataFrame]) -> DataFrame:
    """(tree, leaf, node, above): every node of the chosen branches and how many replies it stands above the leaf.

    A node that is an offset of some powers of two above the leaf is reached by exactly one choice of jumps.
    """
    now = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
    for k, table in reversed(list(enumerate(up))):
        j = table.select(F.col("tree").alias("t"), F.col("node").alias("u"), "up")
        joined = now.join(j, now.tree.eqNullSafe(j.t) & now.node.eqNullSafe(j.u), "left")
        here = F.struct(F.col("node").alias("node"), F.col("above").alias("above"))
        there = F.struct(F.col("up").alias("node"), (F.col("above") + 2**k).alias("above"))
        both = F.when(F.col("up").isNotNull(), F.array(here, there)).otherwise(F.array(here))
        now = joined.select("tree", "leaf", F.explode(both).alias("m")).select("tree", "leaf", "m.*")
    return now


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _head(role: Column) -> Column:
    return F.concat(F.lit(TURN_START), F.replace(escaped(role), F.lit(">"), F.lit("\\g")), F.lit(">\n"))


def _formatted(turns: Column) -> Column:
    """struct(formatted, mask) of an array of (role, text)."""

    def placed(pieces: Column) -> Column:
        def spans(ends: Column) -> Column:
            start = lambda x, i: F.get(ends, i) - F.length(x["tail"])
            all_ = F.transform(pieces, lambda x, i: F.struct(x["trained"].alias("trained"), i.alias("turn"), start(x, i).alias("start"), (start(x, i) + x["size"]).alias("end")))
            mask = F.transform(F.filter(all_, lambda x: x["trained"]), lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["end"].alias("end")))
            return F.struct(F.array_join(F.transform(pieces, lambda x: F.concat(x["head"], x["tail"])), "").alias("formatted"), mask.alias("mask"))

        sizes = F.transform(pieces, lambda x: (F.length(x["head"]) + F.length(x["tail"])).cast("long"))
        return let(let(sizes, lambda v: running(v, F.lit(0).cast("long"), lambda a, b: a + b)), spans)

    def piece(t: Column) -> Column:
        text = escaped(t["text"])
        return F.struct(_head(t["role"]).alias("head"), F.concat(text, F.lit("\n" + TURN_END)).alias("tail"), F.length(text).cast("long").alias("size"), (t["role"] == TRAINED_ROLE).alias("trained"))

    return let(F.transform(turns, piece), placed)


def format_trees(nodes: DataFrame, rules: Branches = Branches(), unique: bool = False) -> DataFrame:
    """nodes (tree, node, parent, role, text, score) → (tree, root, leaf, rank, score, n_turns, formatted, mask), written to
    the shared folder and read back. ``unique``: node ids are known to be unique in their tree."""
    spark = nodes.sparkSession
    nodes = nodes.select("tree", "node", "parent", "role", "text", "score")
    with Scratch(spark) as scratch:
        nodes = scratch.keep(nodes if unique else _unique(nodes), "nodes")
        up = jumps(nodes, scratch)
        chosen = branches(nodes, up, rules, scratch)
        on = members(chosen, up)
        texts = nodes.select(F.col("tree").alias("t"), F.col("node").alias("u"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        turns = on.join(texts, on.tree.eqNullSafe(texts.t) & on.node.eqNullSafe(texts.u)).select("tree", "leaf", F.struct((-F.col("above")).alias("place"), "role", "text").alias("turn"))
        paths = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        done = paths.select("tree", "leaf", _formatted(F.col("turns")).alias("f"))
        best = chosen.select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "root", "rank", "score", "n_turns")
        rows = done.join(best, done.tree.eqNullSafe(best.t) & done.leaf.eqNullSafe(best.l)).select("tree", "root", "leaf", "rank", "score", "n_turns", "f.formatted", "f.mask")
        return scratch.result(rows, "chat")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.filter(F.split(formatted, TURN_END), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.instr(p, ">")
        role = F.substring(p, F.lit(len(TURN_START) + 1), head - len(TURN_START) - 1)
        return F.struct(unescaped(F.replace(role, F.lit("\\g"), F.lit(">"))).alias("role"), unescaped(F.substring(p, head + 2, F.length(p) - head - 2)).alias("text"))

    return F.transform(pieces, turn)


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped. A range is cut from its own turn, so a long conversation is read once."""

    def cut(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda p: (F.length(p) + len(TURN_END)).cast("long"))
        starts = let(sizes, lambda v: running(v, F.lit(0).cast("long"), lambda a, b: a + b))
        return let(starts, lambda ends: F.transform(mask, lambda m: unescaped(_within(pieces, ends, m))))

    return let(F.split(formatted, TURN_END), cut)


def _within(pieces: Column, ends: Column, m: Column) -> Column:
    before = F.when(m["turn"] == 0, F.lit(0).cast("long")).otherwise(F.get(ends, m["turn"] - 1))
    return F.substring(F.get(pieces, m["turn"]), (m["start"] - before + 1).cast("int"), (m["end"] - m["start"]).cast("int"))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text), formatted as trees and read back: digests of their turns and of the texts
    under the loss mask."""
    done = format_trees(linear_nodes(conversations), unique=True)
    read = done.select(F.col("tree").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(masked_texts(F.col("formatted"), F.col("mask")), "").alias("trained"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
