"""Classifier scores: the scorer as an Arrow pass that fails open, and the decisions as column expressions."""

from __future__ import annotations

import re
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import clean_label, redact_plain

SCORES = "array<struct<label:string,score:double>>"
RUN = f"ran boolean, error_kind string, error string, scores {SCORES}, ms double, log array<struct<kind:string,model:string,detail:string>>"
#: A model gets this many texts at once, and of each the tokens it can read: its own window below this many, else this many.
TEXTS_PER_CALL, MOST_TOKENS = 64, 512
#: A task waits this long for another one that loads the same model, then passes its messages on.
LOAD_WAIT_SECONDS = 5.0
_guard = threading.Lock()
_locks: dict[str, threading.Lock] = {}
_models: dict[str, object] = {}
_failures: dict[str, str] = {}
#: What happened to models in this process, the latest thousand: (kind, model, detail).
_log: deque[tuple[str, str, str]] = deque(maxlen=1000)

#: Loads a model: key → a function from texts to one result per text, in any of the accepted shapes.
Loader = Callable[[str], Callable[[list[str]], list]]


class ScorerUnavailable(RuntimeError):
    """A model that failed to load, or that another task is still loading."""


def normalize_scores(result) -> list[tuple[str, float]]:
    """One dict, a list of dicts, or a list of lists of dicts (the first counts), as a flat list."""
    if isinstance(result, dict):
        result = [result]
    if len(result) and isinstance(result[0], list):
        result = result[0]
    return [(str(x["label"]), float(x["score"])) for x in result]


def model_of(key: str, load: Loader, token: str = "", warming: bool = False):
    """The model of this process: loaded once under a lock of its own; a failure is remembered, unless it was a warm-up."""
    name = key.split("::device=")[0]
    if key in _models:
        _log.append(("model_cache_hit", name, ""))
        return _models[key]
    if key in _failures:
        raise ScorerUnavailable(_failures[key])
    with _guard:
        lock = _locks.setdefault(key, threading.Lock())
    if not lock.acquire(timeout=LOAD_WAIT_SECONDS):
        raise ScorerUnavailable(f"{name} is still being loaded after {LOAD_WAIT_SECONDS:g} seconds")
    try:
        if key in _models:
            _log.append(("model_cache_hit", name, ""))
            return _models[key]
        if key in _failures:
            raise ScorerUnavailable(_failures[key])
        _log.append(("model_warming" if warming else "model_loading", name, ""))
        try:
            _models[key] = load(key)
        except Exception as e:
            why = redact_plain(f"{type(e).__name__}: {e}", token)
            if not warming:
                _failures[key] = why
            _log.append(("model_warm_skipped" if warming else "model_load_failed", name, why))
            raise ScorerUnavailable(why) from None
        _log.append(("model_warmed" if warming else "model_loaded", name, ""))
        return _models[key]
    finally:
        lock.release()


def runtime_log() -> list[tuple[str, str, str]]:
    return list(_log)


def drained_log() -> list[tuple[str, str, str]]:
    """What happened to models in this process since the last time this was asked."""
    found = []
    while _log:
        found.append(_log.popleft())
    return found


def release_models(active: set[str]) -> list[str]:
    """Drop models that no policy uses any more; returns their keys."""
    gone = sorted(set(_models) - active)
    for key in gone:
        del _models[key]
        name, _, device = key.partition("::device=")
        _log.append(("model_released", name, f"device={device or 'cpu'}"))
    return gone


def token_bound(model: object) -> int:
    """Tokens of a text that a model is given, from the ``window`` it declares."""
    window = getattr(model, "window", None)
    return window if isinstance(window, int) and 0 < window < MOST_TOKENS else MOST_TOKENS


def cut_to(text: str, bound: int) -> str:
    """The first ``bound`` words. A model's tokens are words or parts of them, so none that it can read is lost."""
    found = re.match(rf"\s*(?:\S+\s+){{{bound - 1}}}\S+", text)
    return found.group() if found else text


def _run_texts(texts: list[str | None], key: str, load: Loader, token: str = "") -> list[tuple]:
    """(ran, error_kind, error, scores, milliseconds) of each text. Null texts were not asked about; blank ones need no model.

    The model gets texts by the call, each cut to what it reads. If a call fails, each of its texts is tried alone, so that
    one message does not cost the others their check; of a model's own failure only the class is kept, as its text may
    quote the message. The time of a call is shared among its texts.
    """
    out: list[tuple] = [(t is not None, None, None, [], None) for t in texts]
    asked = [n for n, t in enumerate(texts) if t is not None and t.strip()]
    if not asked:
        return out
    try:
        model = model_of(key, load, token)
    except ScorerUnavailable as e:
        for n in asked:
            out[n] = (False, "load", str(e), [], None)
        return out
    bound = token_bound(model)

    def call(some: list[int]) -> list[tuple]:
        began = time.perf_counter()
        results = list(model([cut_to(texts[n], bound) for n in some]))
        if len(results) != len(some):
            raise ValueError("a result for each text is needed")
        each = (time.perf_counter() - began) * 1000 / len(some)
        return [(True, None, None, [{"label": a, "score": b} for a, b in normalize_scores(r)], each) for r in results]

    for at in range(0, len(asked), TEXTS_PER_CALL):
        some = asked[at : at + TEXTS_PER_CALL]
        try:
            got = call(some)
        except Exception:  # noqa: BLE001  found out text by text
            got = []
            for n in some:
                try:
                    got += call([n])
                except Exception as e:  # noqa: BLE001  a model's own failure passes the message on
                    got.append((False, "inference", type(e).__name__, [], None))
        for n, g in zip(some, got, strict=True):
            out[n] = g
    return out


def scored(frame: DataFrame, text: Column, key: str, load: Loader, token: str = "", active: frozenset[str] | None = None) -> DataFrame:
    """Adds _run: struct(ran, error_kind, error, scores, ms, log) of a text; null texts never reach the model.

    The other columns pass through as Arrow batches, unread. A task first releases the models of its process that are not
    among the ``active`` keys. What happens to models comes back in ``log``, in one row of each batch.
    """
    columns = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("ran", pa.bool_()), ("error_kind", pa.string()), ("error", pa.string()), ("scores", pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))), ("ms", pa.float64()), ("log", pa.list_(pa.struct([(n, pa.string()) for n in ("kind", "model", "detail")])))])
        names = [f.name for f in kind]
        if active is not None:
            release_models(set(active))
        for batch in batches:
            rows = _run_texts(batch.column(len(columns)).to_pylist(), key, load, token)
            logs = [[dict(zip(("kind", "model", "detail"), x, strict=True)) for x in drained_log()] if n == 0 else [] for n in range(len(rows))]
            found = pa.array([dict(zip(names, (*r, x), strict=True)) for r, x in zip(rows, logs, strict=True)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*columns, "_run"])

    asked = frame.withColumn("_asked", text)
    return asked.mapInArrow(run, StructType([*frame.schema.fields, StructField("_run", StructType.fromDDL(RUN))]))


def score_messages(messages: DataFrame, key: str, load: Loader, text: str = "text") -> DataFrame:
    """Adds ran, error_kind (load or inference) and scores. Errors never stop a row."""
    return scored(messages, F.col(text), key, load).select(*messages.columns, "_run.ran", "_run.error_kind", "_run.scores")


def injection_decision(scores: DataFrame, labels: DataFrame, threshold: float = 0.85) -> DataFrame:
    """scores (msg_id, model, ord, label, score) → the first score of each message against the threshold.

    A label without a meaning never triggers; a model without a label table is an error.
    """
    top = scores.filter(F.col("ord") == 0).withColumn("raw_label", clean_label(F.col("label")))
    known = labels.filter("guard = 'injection'").select("model", "raw_label", "semantic")
    models = known.select("model").distinct().withColumn("listed", F.lit(True))
    joined = top.join(F.broadcast(known), ["model", "raw_label"], "left").join(F.broadcast(models), "model", "left")
    joined = joined.withColumn("semantic", F.when(F.col("listed"), F.col("semantic")).otherwise(F.raise_error(F.concat(F.lit("no label table for "), F.col("model"))).cast("string")))
    return joined.select("msg_id", (F.coalesce(F.col("semantic") == "MALICIOUS", F.lit(False)) & (F.col("score") >= threshold)).alias("triggered"), F.coalesce("semantic", "raw_label").alias("label"), "score")


def offensive_decision(scores: DataFrame, labels: DataFrame, messages: DataFrame, threshold: float = 0.60) -> DataFrame:
    """The sum over blocking labels against the threshold; the label is the first of the greatest blocking score.

    A label without a meaning counts by its own name. ``messages`` (msg_id, model) are those that ran.
    """
    known = labels.filter("guard = 'offensive'")
    named = scores.join(F.broadcast(known.select("model", F.col("raw_label").alias("label"), "semantic")), ["model", "label"], "left").withColumn("meaning", F.coalesce("semantic", "label"))
    blocking = known.filter("blocks").select("model", F.upper("semantic").alias("_up")).distinct()
    kept = named.withColumn("_up", F.upper("meaning")).join(F.broadcast(blocking), ["model", "_up"], "left_semi")
    best = F.max(F.when(F.col("score") > 0, F.struct(F.col("score"), (-F.col("ord")).alias("first"), F.col("meaning"))))
    sums = kept.groupBy("msg_id").agg(F.sum("score").alias("total"), best.alias("best"))
    out = messages.select("msg_id").distinct().join(sums, "msg_id", "left")
    total = F.coalesce("total", F.lit(0.0))
    return out.select("msg_id", (total >= threshold).alias("triggered"), F.col("best.meaning").alias("label"), total.alias("score"))


def decide_row(scores: Column, blocking: list[str], meaning: dict[str, str], threshold: float) -> Column:
    """The offensive decision on one row's scores, for use right after ``score_messages``."""
    names = F.create_map(*[F.lit(x) for kv in meaning.items() for x in kv])
    named = F.transform(scores, lambda s: F.struct(F.coalesce(F.element_at(names, s["label"]), s["label"]).alias("label"), s["score"].alias("score")))
    kept = F.filter(named, lambda s: F.upper(s["label"]).isin(blocking))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("top"), F.lit(None).cast("string").alias("label"))
    out = F.aggregate(
        kept,
        start,
        lambda a, s: F.struct((a["total"] + s["score"]).alias("total"), F.greatest(a["top"], s["score"]).alias("top"), F.when(s["score"] > a["top"], s["label"]).otherwise(a["label"]).alias("label")),
    )
    return F.struct((out["total"] >= threshold).alias("triggered"), out["label"].alias("label"), out["total"].alias("score"))


def first_row(scores: Column, meaning: dict[str, str], threshold: float) -> Column:
    """The injection decision on one row's scores: the first score; a label without a meaning never triggers."""
    names = F.create_map(*[F.lit(x) for kv in meaning.items() for x in kv])
    top = F.get(scores, F.lit(0))
    raw = clean_label(top["label"])
    known = F.element_at(names, raw)
    hit = F.coalesce((known == "MALICIOUS") & (top["score"] >= threshold), F.lit(False))
    return F.struct(hit.alias("triggered"), F.coalesce(known, raw).alias("label"), F.coalesce(top["score"], F.lit(0.0)).alias("score"))


def unmapped_labels(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """scores (model, ord, label) → the first labels of injection models that have no meaning, once per model and label."""
    known = labels.filter("guard = 'injection'")
    top = scores.filter(F.col("ord") == 0).join(F.broadcast(known.select("model").distinct()), "model", "left_semi").select("model", clean_label(F.col("label")).alias("raw_label")).distinct()
    return top.join(F.broadcast(known.select("model", "raw_label")), ["model", "raw_label"], "left_anti")


def label_reachability(declared: DataFrame, labels: DataFrame) -> DataFrame:
    """declared (guard, model, idx, label) → per model whether its declared labels can block at all.

    Injection: the blocking raw label is declared, whatever its case. Offensive: some declared label means a class that
    blocks. Models that declare nothing are not judged (null).
    """
    known = labels.select("guard", "model", F.upper("raw_label").alias("up"), "semantic", "blocks")
    seen = declared.withColumn("up", F.upper("label")).join(F.broadcast(known), ["guard", "model", "up"], "left")
    blocking = labels.filter("blocks").select("guard", "model", F.upper("semantic").alias("own")).distinct()
    own = seen.withColumn("own", F.upper("label")).join(F.broadcast(blocking.withColumn("named", F.lit(True))), ["guard", "model", "own"], "left")
    hit = F.coalesce("blocks", F.lit(False)) | ((F.col("guard") == "offensive") & F.coalesce("named", F.lit(False)))
    return own.groupBy("guard", "model").agg(F.bool_or(hit).alias("reachable"), F.sort_array(F.collect_list(F.struct("idx", "label"))).alias("_l")).select("guard", "model", "reachable", F.array_join(F.transform("_l", lambda x: x["label"]), ",").alias("declared"))


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """scored (score, truth) → refusals, true and false, at each threshold; one pass over the rows."""
    table = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    rows = scored.withColumn("threshold", table)
    blocked = F.col("score") >= F.col("threshold")
    return rows.groupBy("threshold").agg(
        F.count(F.when(blocked & (F.col("truth") == 1), 1)).alias("true_refusals"), F.count(F.when(blocked & (F.col("truth") == 0), 1)).alias("false_refusals"), F.count(F.when(~blocked & (F.col("truth") == 1), 1)).alias("missed")
    )
