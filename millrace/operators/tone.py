"""A tone classifier fitted in Spark on labelled documents: weights of words, scores without Python.

A word's weight is its log odds of standing in a toxic document against a clean one, one occurrence added to each side, less
two standard errors, in thousandths; words that say little are left out, and so are rare ones. A document's points are the sum over its distinct words of
toxic tone, its score points / (points + ``HALF``). Labelled documents are scored by weights fitted on the other folds only, so
every score is held out; documents without a label get the weights of all folds. Counting is one pass with map-side
sums; only words of at least ``least_documents`` documents travel on.

Defined results: null texts and texts without words score 0; rows without doc_id are not learnt from and are scored like
unlabelled ones. Several labels of a document: any toxic one counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[a-zà-öø-ÿ]+"
#: Points at which the score is one half.
HALF = 3000
#: Standard errors that are taken off a word's log odds.
ERRORS = 2
#: Weights that are sent to every task; more are joined by a shuffle.
BROADCAST_WEIGHTS = 1_000_000


@dataclass(frozen=True)
class ToneRules:
    folds: int = 5
    least_documents: int = 3
    least_weight: int = 2000


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0))


def _labelled(documents: DataFrame, labels: DataFrame, rules: ToneRules) -> DataFrame:
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    return documents.select("doc_id", "text").join(marks, "doc_id", "left").withColumn("fold", F.when(F.col("toxic").isNotNull(), F.pmod("doc_id", F.lit(rules.folds))).otherwise(-1))


def tone_weights(documents: DataFrame, labels: DataFrame, rules: ToneRules = ToneRules()) -> DataFrame:
    """(fold, word, weight): the words of toxic tone as the documents outside each fold show them; fold -1: all documents."""
    known = _labelled(documents, labels, rules).filter(F.col("toxic").isNotNull())
    folds = [*range(rules.folds), -1]

    def sides(rows: DataFrame, *keys: str) -> DataFrame:
        count = lambda f, t: F.count(F.when((F.col("fold") != f) & (F.col("toxic") == t), 1)).alias(f"n{t}_{f}")
        return rows.groupBy(*keys).agg(*[count(f, t) for f in folds for t in (0, 1)])

    words = sides(known.select("fold", "toxic", F.explode(words_of(F.col("text"))).alias("word")), "word")
    sizes = sides(known.select("fold", "toxic")).select(*[F.col(f"n{t}_{f}").alias(f"d{t}_{f}") for f in folds for t in (0, 1)])

    def odds(f: int) -> Column:
        toxic = (F.col(f"n1_{f}") + 1) / (F.col(f"d1_{f}") + 2)
        clean = (F.col(f"n0_{f}") + 1) / (F.col(f"d0_{f}") + 2)
        doubt = F.sqrt(1 / (F.col(f"n1_{f}") + 1) + 1 / (F.col(f"n0_{f}") + 1))
        weight = F.round(1000 * (F.ln(toxic) - F.ln(clean) - ERRORS * doubt)).cast("long")
        return F.struct(F.lit(f).cast("long").alias("fold"), weight.alias("weight"), (F.col(f"n0_{f}") + F.col(f"n1_{f}")).alias("n"))

    # the sizes are one row
    told = words.filter(F.col("n0_-1") + F.col("n1_-1") >= rules.least_documents).join(F.broadcast(sizes)).select("word", F.explode(F.array(*[odds(f) for f in folds])).alias("w"))
    return told.select("w.fold", "word", "w.weight", "w.n").filter((F.col("n") >= rules.least_documents) & (F.col("weight") >= rules.least_weight)).drop("n")


def tone_scores(documents: DataFrame, labels: DataFrame, weights: DataFrame, rules: ToneRules = ToneRules()) -> DataFrame:
    """(doc_id, toxic, points, score) of every document; toxic is null where there is no label."""
    rows = _labelled(documents, labels, rules).withColumn("fold", F.col("fold").cast("long"))
    met = rows.select("doc_id", "fold", F.explode(words_of(F.col("text"))).alias("word"))
    table = F.broadcast(weights) if weights.count() <= BROADCAST_WEIGHTS else weights
    points = met.join(table, ["fold", "word"]).groupBy("doc_id").agg(F.sum("weight").alias("points"))
    total = F.coalesce("points", F.lit(0).cast("long"))
    return rows.select("doc_id", "toxic").join(points, "doc_id", "left").select("doc_id", "toxic", total.alias("points"), (total / (total + HALF)).alias("score"))


def as_labels(scores: DataFrame, model: str, shares: tuple[tuple[str, float, float], ...]) -> DataFrame:
    """(msg_id, score) → (msg_id, model, ord, label, score) in a model's label space: ``shares`` (label, a, b) give the score
    a + b * tone to each label, in the model's order."""
    rows = F.array(*[F.struct(F.lit(n).alias("ord"), F.lit(label).alias("label"), (F.lit(a) + F.lit(b) * F.col("score")).alias("score")) for n, (label, a, b) in enumerate(shares)])
    return scores.select("msg_id", F.explode(rows).alias("r")).select("msg_id", F.lit(model).alias("model"), "r.ord", "r.label", "r.score")


class ToneModel:
    """The weights of all folds as a model for the classifier pass: texts → scores in a label space."""

    def __init__(self, weights: dict[str, int], shares: tuple[tuple[str, float], ...]):
        self.weights, self.shares = weights, shares

    def __call__(self, texts: list[str]) -> list[list[dict]]:
        out = []
        for text in texts:
            points = sum(self.weights.get(w, 0) for w in set(_WORDS.findall(text.lower())))
            score = points / (points + HALF)
            out.append([{"label": label, "score": score * share} for label, share in self.shares])
        return out


_WORDS = re.compile(WORD)


def tone_loader(weights: DataFrame, spaces: dict[str, tuple[tuple[str, float], ...]]) -> Callable[[str], ToneModel]:
    """A loader of tone models: ``spaces`` gives (label, share of the score) for each model's key. The weights travel with the
    task, so they are bounded by ``BROADCAST_WEIGHTS``; a key without a space is a model that fails to load."""
    rows = weights.filter("fold = -1").select("word", "weight").limit(BROADCAST_WEIGHTS + 1).collect()
    if len(rows) > BROADCAST_WEIGHTS:
        raise ValueError(f"more than {BROADCAST_WEIGHTS} weights; raise least_documents or least_weight")
    table = {r.word: r.weight for r in rows}

    def load(key: str) -> ToneModel:
        if key not in spaces:
            raise RuntimeError("401 gated hf_abcdefgh12345678")
        return ToneModel(table, spaces[key])

    return load
