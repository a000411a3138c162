"""Screening: checks in order, the first verdict wins; replies; and what leaves the guard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import allowed_addresses, extract_text, fold_text, is_settled, parse_contacts, render
from ..plans.taxonomy import LABELS, OFFENSIVE_INPUT, OUTPUT_PERSONAL_DATA, PERSONAL_DATA, PROMPT_INJECTION, blocking_labels, category_of, stage_of
from ..sources.policy import DEVICES, REPLY_FIELD, Policy, access_token
from . import detect, phone, scoring

#: A check takes the policy and gives a verdict column over the prepared columns text, folded, phrase, kinds.
Check = Callable[[Policy], Column]

INPUT_CHECKS: tuple[tuple[str, Check], ...] = (
    ("length", lambda p: detect.length_verdict(F.col("_text"), p.max_message_chars)),
    ("injection_patterns", lambda p: F.when(F.col("pattern").isNotNull(), "prompt_injection")),
    ("personal_data", lambda p: detect.personal_data_verdict(F.col("kinds"), PERSONAL_DATA)),
)


#: The classifiers after the checks, in order: (guard, policy fields, verdict, name among the checks that ran).
CLASSIFIERS = (("injection", "prompt_injection", PROMPT_INJECTION, "injection_classifier"), ("offensive", "offensive_input", OFFENSIVE_INPUT, "offensive_input"))
MODEL_LOG = "array<struct<kind:string,model:string,detail:string>>"
FAILURES = "array<struct<guard:string,model:string,error_kind:string,error:string>>"


def first_verdict(verdicts: list[Column]) -> Column:
    return F.coalesce(*verdicts)


def _toggles(policy: Policy, stage: str) -> tuple[bool, bool, bool, bool]:
    return tuple(getattr(policy, f"detect_{stage}_{k}") for k in detect.KINDS)


def prepared(messages: DataFrame, policy: Policy, stage: str) -> DataFrame:
    """Adds _text, _folded, _phrase (one hop to Python for both), pattern, kinds and phone_types."""
    region = getattr(policy, f"{stage}_phone_region")
    toggles = _toggles(policy, stage)
    content = F.col("content") if "content" in messages.columns else F.lit(None).cast("string")
    contacts = parse_contacts(F.lit(policy.public_service_contacts))
    folded = F.col("_folded")
    private = phone.private_numbers(folded, region, phone.allowed_numbers(contacts, region)) if toggles[3] else F.array().cast("array<struct<raw:string,e164:string,kind:string>>")
    out = messages.withColumn("_text", extract_text(F.col("text"), content)).withColumn("_settled", is_settled(F.col("_text"))).withColumn("_forms", fold_text("_text", F.col("_settled")))
    # columns of their own: fields of a struct would be worked out anew at each use
    out = out.withColumns({"_folded": F.col("_forms.folded"), "_phrase": F.col("_forms.phrase")}).withColumn("_phones", private)
    return out.withColumns(
        {
            "pattern": detect.injection_pattern(F.col("_phrase"), policy.detect_prompt_injection_custom and stage == "input"),
            "kinds": detect.personal_data_kinds(folded, allowed_addresses(F.lit(policy.help_desk_email), contacts), F.size("_phones") > 0, toggles),
            "phone_types": phone.number_types(F.col("_phones")),
        }
    )


def reply(verdict: Column, policy: Policy) -> Column:
    """The rendered reply of a verdict; null where none is configured, and then the row stays allowed."""
    out = None
    for name, setting in REPLY_FIELD.items():
        text = getattr(policy, setting)
        value = render(text, policy.help_desk_email) if text.strip() else F.lit(None).cast("string")
        out = F.when(verdict == name, value) if out is None else out.when(verdict == name, value)
    return out


def detail(policy: Policy) -> Column:
    """Why a message was refused, without any of its text."""
    kinds = F.array_join("kinds", "+")
    return (
        F.when(F.col("verdict") == "message_length", F.format_string("length=%d chars (limit %d)", F.length("_text"), F.lit(policy.max_message_chars)))
        .when(F.col("verdict").isin(PERSONAL_DATA, OUTPUT_PERSONAL_DATA), F.concat(F.lit("detected="), kinds, F.when(F.size("phone_types") > 0, F.concat(F.lit(" ("), F.array_join("phone_types", "+"), F.lit(")"))).otherwise("")))
        .when(F.col("verdict") == "prompt_injection", F.concat(F.lit("detector=custom, pattern="), F.col("pattern")))
        .otherwise("")
    )


def _finish(checked: DataFrame, policy: Policy, keep: list[str]) -> DataFrame:
    """The columns of a screened table. ``silent_verdict``: a verdict without a reply, whose message went on."""
    replied = checked.withColumn("reply", reply(F.col("verdict"), policy)).withColumn("_found", F.col("verdict")).withColumn("verdict", F.when(F.col("reply").isNotNull(), F.col("verdict")))
    blocked = F.col("verdict").isNotNull()
    return replied.select(
        *keep, "verdict", F.when(blocked, stage_of(F.col("verdict"))).alias("verdict_stage"), F.when(blocked, category_of(F.col("verdict"))).alias("category"), "kinds", "phone_types", "pattern",
        F.when(blocked, F.col("detail")).otherwise("").alias("detail"), "reply", "checks", "failures", "answered", "inference_ms", "model_log", F.when(~blocked, F.col("_found")).alias("silent_verdict"),
    )


def checks_of(policy: Policy, stage: str) -> list[str]:
    """What looks at every message of a stage, whatever it holds."""
    kinds = [k for k, on in zip(detect.KINDS, _toggles(policy, stage), strict=True) if on]
    if stage == "output":
        return kinds
    named = (("length", policy.max_message_chars > 0), ("injection_patterns", policy.detect_prompt_injection_custom), ("personal_data", bool(kinds)))
    return [name for name, on in named if on]


def _unavailable(key: str):
    raise RuntimeError(f"no scorer is installed for {key}")


def classified(checked: DataFrame, policy: Policy, load: scoring.Loader | None = None) -> DataFrame:
    """The classifiers over messages without a verdict that nobody else answered; a failure lets the message on.

    An Arrow pass for each classifier that the policy turns on; rows that it is not asked about cost no inference.
    """
    device = DEVICES[policy.classifier_device]
    key_of = lambda model: model if device < 0 else f"{model}::device={device}"
    active = frozenset(key_of(getattr(policy, f"{p}_classifier_model")) for _, p, _, _ in CLASSIFIERS if getattr(policy, f"detect_{p}_classifier"))
    out = checked
    for guard, prefix, verdict, name in CLASSIFIERS:
        if not getattr(policy, f"detect_{prefix}_classifier"):
            continue
        model, threshold = getattr(policy, f"{prefix}_classifier_model"), getattr(policy, f"{prefix}_classifier_threshold")
        meaning = {r[2]: r[3] for r in LABELS if r[0] == guard and r[1] == model}
        asked = F.when(F.col("verdict").isNull() & ~F.col("answered"), F.col("_text"))
        out = scoring.scored(out.drop("_run", "_decision"), asked, key_of(model), load or _unavailable, access_token(policy) or "", active)
        scores = F.col("_run.scores")
        decision = scoring.first_row(scores, meaning, threshold) if guard == "injection" else scoring.decide_row(scores, list(blocking_labels(guard, model)), meaning, threshold)
        out = out.withColumn("_decision", decision)
        hit = F.col("_run.ran") & F.col("_decision.triggered")
        failure = F.struct(F.lit(guard).alias("guard"), F.lit(model).alias("model"), F.col("_run.error_kind").alias("error_kind"), F.col("_run.error").alias("error"))
        told = F.format_string(f"detector=classifier, model={model}, label=%s, score=%.3f, threshold={threshold:.2f}", F.col("_decision.label"), F.col("_decision.score"))
        out = out.withColumns(
            {
                "verdict": F.coalesce("verdict", F.when(hit, verdict)),
                "detail": F.when(hit, told).otherwise(F.col("detail")),
                "checks": F.when(F.col("_run.ran"), F.concat("checks", F.array(F.lit(name)))).otherwise(F.col("checks")),
                "inference_ms": F.when(F.col("_run.ms").isNull(), F.col("inference_ms")).otherwise(F.coalesce("inference_ms", F.lit(0.0)) + F.col("_run.ms")),
                "model_log": F.concat("model_log", "_run.log"),
                "failures": F.when(F.col("_run.error_kind").isNotNull(), F.concat("failures", F.array(failure))).otherwise(F.col("failures")),
            }
        )
    return out


def screen_input(messages: DataFrame, policy: Policy = Policy(), checks: tuple[tuple[str, Check], ...] = INPUT_CHECKS, load: scoring.Loader | None = None, answered: Column | None = None) -> DataFrame:
    """One row per message with its verdict: the checks, then the classifiers that the policy turns on.

    Row by row, no shuffle; one Arrow hop for folding and one pass per classifier. ``load`` gives the scorers (without one
    they count as unavailable), ``answered`` says whether another part has replied already, and then they are spared.
    """
    ready = prepared(messages, policy, "input")
    checked = ready.withColumn("verdict", first_verdict([c(policy) for _, c in checks])).withColumn("detail", detail(policy))
    names = F.array(*[F.lit(n) for n in checks_of(policy, "input")]).cast("array<string>")
    checked = checked.withColumns({"checks": names, "failures": F.array().cast(FAILURES), "answered": F.coalesce(answered, F.lit(False)) if answered is not None else F.lit(False), "inference_ms": F.lit(None).cast("double"), "model_log": F.array().cast(MODEL_LOG)})
    return _finish(classified(checked, policy, load), policy, messages.columns)


def screen_output(messages: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Answers: only personal data is looked for."""
    ready = prepared(messages, policy, "output")
    checked = ready.withColumn("verdict", detect.personal_data_verdict(F.col("kinds"), OUTPUT_PERSONAL_DATA)).withColumn("detail", detail(policy))
    names = F.array(*[F.lit(n) for n in checks_of(policy, "output")]).cast("array<string>")
    return _finish(checked.withColumns({"checks": names, "failures": F.array().cast(FAILURES), "answered": F.lit(False), "inference_ms": F.lit(None).cast("double"), "model_log": F.array().cast(MODEL_LOG)}), policy, messages.columns)


def replace_refused(screened: DataFrame) -> DataFrame:
    """Refused answers get the reply as text and content and lose their sources; the others stay as they are."""
    blocked = F.col("verdict").isNotNull()
    changes = {"text": F.when(blocked, F.col("reply")).otherwise(F.col("text")), "content": F.when(blocked, F.col("reply")).otherwise(F.col("content"))}
    if "why" in screened.columns:
        changes["why"] = F.when(~blocked, F.col("why"))
    return screened.withColumns(changes)


def answered_elsewhere(fast_reply: Column, is_map: Column) -> Column:
    """Whether another part already answered: a mapping with an output, or anything else that is not null."""
    return F.when(is_map, F.coalesce(F.array_contains(F.map_keys(fast_reply), "output"), F.lit(False))).otherwise(F.coalesce(fast_reply.isNotNull(), F.lit(False)))


def verdict_counts(screened: DataFrame) -> DataFrame:
    """Counts by stage, category and verdict with all subtotals; null verdicts count as allowed."""
    named = screened.select(F.coalesce("verdict_stage", F.lit("none")).alias("stage"), F.coalesce("category", F.lit("none")).alias("category"), F.coalesce("verdict", F.lit("allowed")).alias("verdict"))
    return named.rollup("stage", "category", "verdict").agg(F.count("*").alias("n_messages"))
