"""Guard events: what is announced, when it is announced again, and the rows of the event log (never message text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base36, latency_text, redact, remediation, threshold_text
from ..sources.policy import DEVICES, Policy, access_token
from ..sources.shared import stored
from . import scoring
from .scans import differs, scanned

EVENT_COLUMNS = ("kind", "level", "stage", "category", "verdict", "detail", "checks", "turn")


def changes(log: DataFrame, value: str = "summary", order: tuple[str, ...] = ("seq",), by: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose value differs from the one before of their source (the first row counts): A, B, A gives three."""
    scan = scanned(log, order, by, value=value)
    return scan.filter(differs(scan, value)).select(*log.columns)


def once_per_key(log: DataFrame, keys: tuple[str, ...], order: str = "seq") -> DataFrame:
    """The first row of each key. A minimum per key is combined map-side, so a frequent key is cheap."""
    first = log.groupBy(*keys).agg(F.min(order).alias(order))
    return log.join(first, [*keys, order], "left_semi")


def rearmed(log: DataFrame, reason: str = "reason", order: tuple[str, ...] = ("seq",), by: tuple[str, ...] = ()) -> DataFrame:
    """Failures that differ from the state before; a success (null) in between arms the warning again."""
    scan = scanned(log, order, by, value=reason)
    return scan.filter(F.col(reason).isNotNull() & ~F.col(reason).eqNullSafe(F.col("before"))).select(*log.columns)


def turn_tokens(turns: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds turn_token: a base-36 counter over the whole table, or per ``by``, from 0001, that starts over after 36**4 turns.

    Counters per key run as one window, as a key is a session here; one over the whole table is an ordered scan.
    """
    if by:
        return turns.withColumn("turn_token", base36(F.row_number().over(Window.partitionBy(*by).orderBy(*order))))
    return scanned(turns, order).select(*turns.columns, base36(F.col("n")).alias("turn_token"))


def turn_or_none(token: Column) -> Column:
    return F.coalesce(token, F.lit("none"))


def enabled(stage: str) -> Column:
    """Names of the privacy detectors that a policy row turns on for a stage."""
    return F.array_compact(F.array(*[F.when(F.col(f"detect_{stage}_{k}"), F.lit(k)) for k in ("email", "codice_fiscale", "iban", "phone")]))


def deterministic_checks() -> Column:
    return F.array_compact(
        F.array(F.when(F.col("max_message_chars") > 0, F.lit("length")), F.when(F.col("detect_prompt_injection_custom"), F.lit("injection_patterns")), F.when(F.size(enabled("input")) > 0, F.lit("personal_data")))
    )


def active_models() -> Column:
    return F.array_distinct(
        F.array_compact(F.array(F.when(F.col("detect_prompt_injection_classifier"), F.col("prompt_injection_classifier_model")), F.when(F.col("detect_offensive_input_classifier"), F.col("offensive_input_classifier_model"))))
    )


def coverage(policies: DataFrame) -> DataFrame:
    """policies (policy rows) → policy_id, summary, uncovered, level, checks, models, signature."""
    inputs, outputs = enabled("input"), enabled("output")
    some_in, some_out = F.size(inputs) > 0, F.size(outputs) > 0
    limits = F.when(F.col("max_message_chars") > 0, F.concat(F.lit("limits(max "), F.col("max_message_chars").cast("string"), F.lit(" chars)"))).otherwise("limits(disabled)")
    part = lambda on, names, stage: F.when(on, F.concat(F.lit(f"{stage}="), F.array_join(names, "+"), F.lit(f", {stage}_region="), F.col(f"{stage}_phone_region"))).otherwise(f"{stage}=disabled")
    privacy = F.when(some_in | some_out, F.concat(F.lit("privacy("), part(some_in, inputs, "input"), F.lit(", "), part(some_out, outputs, "output"), F.lit(")"))).otherwise("privacy(disabled)")
    model = lambda name: F.concat(F.lit("classifier "), F.col(f"{name}_classifier_model"), F.lit("@"), threshold_text(F.col(f"{name}_classifier_threshold")))
    means = F.array_compact(F.array(F.when(F.col("detect_prompt_injection_custom"), F.lit("patterns")), F.when(F.col("detect_prompt_injection_classifier"), model("prompt_injection"))))
    security = F.when(F.size(means) > 0, F.concat(F.lit("security("), F.array_join(means, "+"), F.lit(")"))).otherwise("security(disabled)")
    tone = F.when(F.col("detect_offensive_input_classifier"), F.concat(F.lit("tone("), model("offensive_input"), F.lit(")"))).otherwise("tone(disabled)")
    missing = F.array_compact(
        F.array(
            F.when(~(F.col("max_message_chars") > 0), F.lit("limits")),
            F.when(~some_in & ~some_out, F.lit("privacy")),
            F.when(~some_in & some_out, F.lit("privacy(input)")),
            F.when(some_in & ~some_out, F.lit("privacy(output)")),
            F.when(F.size(means) == 0, F.lit("security")),
        )
    )
    models = active_models()
    return policies.select(
        "policy_id",
        F.concat_ws(", ", limits, privacy, security, tone).alias("summary"),
        F.array_join(missing, ", ").alias("uncovered"),
        F.when(F.size(missing) > 0, "WARNING").otherwise("INFO").alias("level"),
        F.array_join(deterministic_checks(), "+").alias("checks"),
        F.array_join(models, ",").alias("models"),
        F.concat_ws("|", F.col("classifier_device"), F.array_join(F.array_sort(models), ",")).alias("signature"),
    )


def guard_events(screened: DataFrame, stage: str, checks: Column | str | None = None, turn: Column | None = None, latency: Column | None = None) -> DataFrame:
    """One row per screened message. The schema holds no message text. Without ``checks``, those that ran. With ``latency``
    (milliseconds), a column latency_ms: one digit for inference, two for anything faster than a millisecond."""
    blocked = F.col("verdict").isNotNull()
    ran = F.array_join("checks", "+") if checks is None else checks if isinstance(checks, Column) else F.lit(checks)
    source = F.when(F.col("answered"), "reply=elsewhere").otherwise("") if "answered" in screened.columns else F.lit("")
    return screened.select(
        F.when(blocked, f"{stage}_blocked").otherwise(f"{stage}_allowed").alias("kind"),
        F.lit("INFO").alias("level"),
        F.lit(stage).alias("stage"),
        "category",
        "verdict",
        F.when(blocked, F.col("detail")).otherwise(source).alias("detail"),
        F.when(blocked, F.lit(None).cast("string")).otherwise(F.coalesce(F.nullif(ran, F.lit("")), F.lit("none"))).alias("checks"),
        turn_or_none(turn if turn is not None else F.lit(None).cast("string")).alias("turn"),
        *([F.when(latency >= 1, latency_text(latency, inference=True)).otherwise(latency_text(latency)).alias("latency_ms")] if latency is not None else []),
    )


def _event_rows(rows: DataFrame, kind: Column, level: Column, detail: Column, stage: str | None = None, category: Column | None = None, verdict: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        kind.alias("kind"), level.alias("level"), F.lit(stage).cast("string").alias("stage"), (category if category is not None else none).alias("category"), (verdict if verdict is not None else none).alias("verdict"),
        detail.alias("detail"), none.alias("checks"), F.lit("none").alias("turn"),
    )


def announced_failures(failures: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """failures (order, guard, model, error_kind, error), one row each time a classifier could not look → those to announce: a
    failed load whenever its error differs from its guard's last one (A, B, A gives three), a failed inference once for each
    model and class of error."""
    loads = changes(failures.filter("error_kind = 'load'"), "error", order, ("guard",))
    rest = failures.filter("error_kind <> 'load'")
    first = rest.groupBy("guard", "model", "error_kind", "error").agg(F.min(F.struct(*order)).alias("at")).select(*[F.col(f"at.{c}").alias(c) for c in order], "guard", "model", "error_kind", "error")
    return loads.select(*order, "guard", "model", "error_kind", "error").unionByName(first)


def classifier_warnings(screened: DataFrame, policy: Policy, order: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """Classifiers that could not look, in the order of their messages, and what is left of their guard."""
    # kept, as an ordered scan reads its rows twice and models should not run again for it
    failures = stored(screened.select(*order, F.explode("failures").alias("f")).select(*order, "f.*"), "failures")
    seen = announced_failures(failures, order)
    loading = F.col("error_kind") == "load"
    left = F.when(F.col("guard") == "offensive", "no guard covers tone").otherwise("patterns go on" if policy.detect_prompt_injection_custom else "no guard covers security")
    kind = F.when(loading, F.concat("guard", F.lit("_unavailable"))).otherwise("inference_failed")
    detail = F.concat_ws(", ", F.concat(F.lit("guard="), F.col("guard")), F.concat(F.lit("model="), F.col("model")), F.concat(F.lit("error="), redact(F.col("error"))), F.when(loading, left))
    return _event_rows(seen, kind, F.lit("WARNING"), detail, "input")


def missing_replies(screened: DataFrame, stage: str) -> DataFrame:
    """Verdicts that no reply is configured for: one row per message, as each went on unanswered."""
    silent = screened.filter(F.col("silent_verdict").isNotNull())
    return _event_rows(silent, F.lit("no_reply_configured"), F.lit("WARNING"), F.lit(""), stage, None, F.col("silent_verdict"))


def active_guards(policies: DataFrame, order: tuple[str, ...] = ("policy_id",), by: tuple[str, ...] = ()) -> DataFrame:
    """guards_active each time the summary of the policies in force changes."""
    told = policies.select(*dict.fromkeys([*by, *order])).join(coverage(policies), "policy_id") if order != ("policy_id",) else coverage(policies)
    rows = changes(told, "summary", order, by)
    open_ = F.col("uncovered") != ""
    detail = F.concat(F.col("summary"), F.when(open_, F.concat(F.lit("; no guard covers: "), F.col("uncovered"))).otherwise(""))
    return _event_rows(rows, F.lit("guards_active"), F.col("level"), detail)


def settings_fallbacks(loads: DataFrame, order: tuple[str, ...] = ("seq",), by: tuple[str, ...] = (), token: Column | None = None) -> DataFrame:
    """loads (seq, reason; null where the policy was read) → settings_fallback, armed again by a success."""
    return _event_rows(rearmed(loads, "reason", order, by), F.lit("settings_fallback"), F.lit("WARNING"), F.concat(F.lit("reason="), redact(F.col("reason"), token)))


def label_warnings(declared: DataFrame, scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Models whose declared labels can never block, and labels met that have no meaning."""
    bad = scoring.label_reachability(declared, labels).filter(~F.col("reachable"))
    expected = labels.filter("blocks").groupBy("guard", "model").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("guard") == "injection", F.col("raw_label")).otherwise(F.upper("semantic")))), ",").alias("expected"))
    mismatch = bad.join(F.broadcast(expected), ["guard", "model"], "left")
    detail = F.concat_ws(", ", F.concat(F.lit("model="), F.col("model")), F.concat(F.lit("declared="), F.col("declared")), F.concat(F.lit("expected="), F.col("expected")))
    unmapped = scoring.unmapped_labels(scores, labels)
    met = _event_rows(unmapped, F.lit("injection_label_unmapped"), F.lit("WARNING"), F.concat(F.lit("model="), F.col("model"), F.lit(", label="), F.col("raw_label")))
    return _event_rows(mismatch, F.concat("guard", F.lit("_label_mismatch")), F.lit("WARNING"), detail).unionByName(met)


def runtime_events(log: DataFrame) -> DataFrame:
    """log (kind, model, detail) of ``scoring.runtime_log`` as events; failed loads get advice where access is missing."""
    failed = F.col("kind").isin("model_load_failed", "model_warm_skipped")
    advice = F.when(F.col("kind") == "model_load_failed", F.nullif(remediation(F.col("model"), F.col("detail")), F.lit("")))
    detail = F.concat_ws(", ", F.concat(F.lit("model="), F.col("model")), F.when(failed, F.concat(F.lit("error="), redact(F.col("detail")))).otherwise(F.nullif(F.col("detail"), F.lit(""))), advice)
    return _event_rows(log, F.col("kind"), F.when(failed, "WARNING").otherwise("INFO"), detail)


def model_events(screened: DataFrame) -> DataFrame:
    """What the tasks of a screening did with models: loads, failures, reuses and releases, a row each."""
    return runtime_events(screened.select(F.explode("model_log").alias("e")).select("e.*"))


_warmed: set[tuple] = set()


def activate(policy: Policy, load: scoring.Loader) -> list[tuple[str, str, str]]:
    """Start of an engine: (kind, model, detail) of what it announces. Models are warmed in this process where the policy

    asks for it, once per device and models; one that fails to warm is tried again with the first message.
    """
    rows = [("plugin_activated", "", "stages=input+output")]
    if not policy.preload_classifiers_on_activation:
        return rows
    device = DEVICES[policy.classifier_device]
    wanted = list(dict.fromkeys(getattr(policy, f"{p}_classifier_model") for p in ("prompt_injection", "offensive_input") if getattr(policy, f"detect_{p}_classifier")))
    signature = (device, tuple(sorted(wanted)))
    if signature in _warmed:
        return rows
    _warmed.add(signature)
    rows.append(("warmup_requested", "", f"models={len(wanted)}"))
    for model in wanted:
        try:
            scoring.model_of(model if device < 0 else f"{model}::device={device}", load, access_token(policy) or "", warming=True)
        except scoring.ScorerUnavailable as e:
            rows.append(("warmup_skipped", model, f"error={e}"))
    return rows


def render_event() -> Column:
    """An event row as one line."""
    return F.concat_ws(
        ", ",
        F.replace(F.col("kind"), F.lit("_"), F.lit(" ")),
        F.concat(F.lit("stage="), F.col("stage")),
        F.concat(F.lit("category="), F.col("category")),
        F.concat(F.lit("verdict="), F.col("verdict")),
        F.nullif(F.col("detail"), F.lit("")),
        F.concat(F.lit("checks="), F.col("checks")),
        F.concat(F.lit("turn="), F.col("turn")),
    )


def stale_keys(cached: Column, active: Column) -> Column:
    return F.array_except(cached, active)
