"""Filter interaction audit: what each filter removes in every order in which a set of filters can be applied.

Documents are reduced to their failure flags in one pass; those rows are counted by part and flags (map-side, so a part with
a third of all documents costs a row per task and combination), and a SQL CUBE over the flags and the part sums the counts
for every subset of flags. The grouping-set rows whose selected flags are all false are the documents that survive that
subset of filters. A step of an order leads from one subset to another with one filter more: joining the two rows gives
what it removes; sums over the orders need no pass of their own.

Copies are found by the SHA-256 of their texts: the smallest doc_id of each text is a map-side minimum, and a document is
the first of its text if (text, doc_id) is among them. That join is on both columns, so a text with a third of all
documents is dealt out by document.

Defined results: null texts count as empty, a null part as the empty string. Rows that repeat a doc_id with one text are no
copies of each other; rows without doc_id are copies of nothing and have no labels. Of several labels of one document, any
that says so counts. An empty text has 0 words and fails A alone, or A and E. Empty tables give none; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER_ASCII, Scratch, let

SPACE = r"[\x20\x09-\x0D]+"
FLAGS = ("A", "B", "C", "D", "E")
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT, SYMBOLS = 200, 50, 2, "[#$%&*|]"


def text_failures(text: Column) -> Column:
    """struct(A, B, C, D): too few words, too few distinct ones, too many capitals, symbols."""

    def judge(words: Column) -> Column:
        n = F.size(words)
        capitals = F.length(text) - F.length(F.translate(text, UPPER_ASCII, ""))
        return F.struct(
            (n < LEAST_WORDS).alias("A"),
            (100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PCT * n).alias("B"),
            (100 * capitals.cast("long") > MOST_CAPITALS_PCT * F.length(text)).alias("C"),
            text.rlike(SYMBOLS).alias("D"),
        )

    return let(F.array_remove(F.split(text, SPACE), ""), judge)


def flagged(documents: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """documents (doc_id, text, source) → (part, A to E, good, toxic), one row each."""
    text = F.coalesce("text", F.lit(""))
    judged = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text_failures(text).alias("f"))
    rows = scratch.keep(judged.select("doc_id", "part", "same", "f.*"), "flags")
    first = rows.filter(F.col("doc_id").isNotNull()).groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = rows.filter(F.col("doc_id").isNotNull()).join(first, ["same", "doc_id"], "left").join(marks, "doc_id", "left")
    one = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    known = told.select("part", *FLAGS[:4], F.col("first").isNull().alias("E"), one("good"), one("toxic"))
    zero = F.lit(0).cast("long")
    unnamed = rows.filter(F.col("doc_id").isNull()).select("part", *FLAGS[:4], F.lit(False).alias("E"), zero.alias("good"), zero.alias("toxic"))
    return known.unionByName(unnamed)


def survivors(rows: DataFrame, flags: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """(part, subset, n, good, toxic): what is left of each part after the filters of each subset, none left included.
    Bit i of ``subset`` stands for flag i."""
    cells = scratch.keep(rows.groupBy("part", *flags).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")), "cells")
    sums = [F.sum(x).alias(x) for x in ("n", "good", "toxic")]
    cube = cells.cube("part", *flags).agg(F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"g_{f}") for f in flags], *sums)
    clean = cube.filter(F.col("all_parts") == 0)
    for f in flags:
        clean = clean.filter((F.col(f"g_{f}") == 1) | ~F.col(f))
    subset = sum(((1 - F.col(f"g_{f}")) * (1 << i) for i, f in enumerate(flags)), F.lit(0)).cast("int")
    left = clean.select("part", subset.alias("subset"), "n", "good", "toxic")
    every = cells.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(flags) - 1))).alias("subset"))
    zero = F.lit(0).cast("long")
    return scratch.keep(every.join(left, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(x, zero).alias(x) for x in ("n", "good", "toxic")]), "survivors")


def interactions(rows: DataFrame, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """rows (part, a boolean column for each flag, good, toxic) → one row per part, order of the flags and step.

    The tables of steps are as large as the number of flags makes them (600 rows for five) and go to every task.
    """
    spark = rows.sparkSession
    k, full = len(flags), 2 ** len(flags) - 1
    pairs = [(f, s, s | 1 << i, 1 << i, full ^ 1 << i, factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())) for i, f in enumerate(flags) for s in range(full + 1) if not s >> i & 1]
    steps = [("".join(o), n + 1, f, sum(1 << flags.index(x) for x in o[:n])) for o in permutations(flags) for n, f in enumerate(o)]
    pair_table = F.broadcast(spark.createDataFrame(pairs, "flag string, before int, after int, alone int, others int, weight bigint"))
    step_table = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, flag string, before int"))
    with Scratch(spark) as scratch:
        left = survivors(rows, flags, scratch)

        def at(column: str, *names: str) -> DataFrame:
            return left.select("part", F.col("subset").alias(column), *[F.col(x).alias(f"{x}_{column}") for x in names])

        both = left.join(pair_table, F.col("subset") == F.col("before")).select("part", "flag", "before", "after", "alone", "others", "weight", *[F.col(x).alias(f"{x}_before") for x in ("n", "good", "toxic")])
        whole = left.groupBy("part").agg(F.max(F.when(F.col("subset") == 0, F.col("n"))).alias("all"), F.max(F.when(F.col("subset") == full, F.col("n"))).alias("kept_by_all"))
        both = both.join(at("after", "n", "good", "toxic"), ["part", "after"]).join(at("alone", "n"), ["part", "alone"]).join(at("others", "n"), ["part", "others"]).join(whole, "part")
        removed = F.col("n_before") - F.col("n_after")
        told = scratch.keep(
            both.select(
                "part", "flag", "before", "weight", F.col("n_after").alias("kept"), removed.alias("removed"), (F.col("all") - F.col("n_alone") - removed).alias("redundant"),
                (F.col("n_others") - F.col("kept_by_all")).alias("unique_fails"), (F.col("good_before") - F.col("good_after")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic_after")).alias("toxic_lost"),
            ), "pairs",
        )
        shapley = told.groupBy("part", "flag").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
        out = told.join(shapley, ["part", "flag"]).join(step_table, ["flag", "before"])
        return scratch.result(out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "audit")


def audit_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over documents (doc_id, text, source) with labels (doc_id, quality, toxic)."""
    with Scratch(documents.sparkSession) as scratch:
        return interactions(flagged(documents, labels, scratch))
