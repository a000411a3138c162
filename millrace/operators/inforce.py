"""Screening by the policy in force: every turn reads its settings anew, so a table of turns meets versions of a policy.

Versions are stored settings with the place from which they hold. Each is validated as a whole; one that cannot be read
means the defaults, never a part of it, and is announced once until a later version is read. Turns get their version by an
as-of scan (no turn meets more than one version) and the version's fields as columns, by a broadcast join: versions are
bounded by ``MOST_VERSIONS``. The checks are those of ``screen``, on columns in place of literals; phone numbers are
looked for once for each region that some version names, and only in turns whose version names it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import allowed_addresses, extract_text, fold_text, is_settled, parse_contacts, redact_plain, render
from ..plans.taxonomy import PERSONAL_DATA, PROMPT_INJECTION, category_of, stage_of
from ..sources.policy import REPLY_FIELD, Policy, load_policy, policy_frame
from . import detect, phone
from .scans import as_of

MOST_VERSIONS = 10_000


def load_versions(spark: SparkSession, stored: Sequence[Mapping[str, Any] | None]) -> DataFrame:
    """Stored settings, in order → one row each: policy_id (its place in the list), every field, loaded, and why not."""
    if len(stored) > MOST_VERSIONS:
        raise ValueError(f"more than {MOST_VERSIONS} versions")
    loaded: list[tuple[Policy, bool, str | None]] = [load_policy(lambda s=s: s) for s in stored]
    told = [(n, ok, None if why is None else redact_plain(why, str((s or {}).get("huggingface_token") or ""))) for n, (s, (_, ok, why)) in enumerate(zip(stored, loaded, strict=True))]
    reasons = spark.createDataFrame(told, "policy_id bigint, loaded boolean, reason string")
    return policy_frame(spark, [p for p, _, _ in loaded]).join(F.broadcast(reasons), "policy_id")


def with_policy(turns: DataFrame, starts: DataFrame, versions: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the struct ``policy`` in force at each turn. ``starts`` (by, order, policy_id): from where a version holds.
    Turns before any version get the defaults, as policy_id -1."""
    spark = turns.sparkSession
    keys = (*by, *order)
    held = as_of(turns.select(*keys).distinct(), starts, order, "policy_id", by)
    placed = held.select(*[F.col(c).alias(f"_{c}") for c in keys], F.coalesce("policy_id", F.lit(-1)).alias("_policy_id"))
    default = policy_frame(spark, [Policy()]).withColumns({"policy_id": F.lit(-1).cast("long"), "loaded": F.lit(True), "reason": F.lit(None).cast("string")})
    known = versions.unionByName(default)
    fields = F.struct(*known.columns).alias("policy")
    same = reduce(lambda a, b: a & b, [turns[c].eqNullSafe(placed[f"_{c}"]) for c in keys])
    return turns.join(placed, same).join(F.broadcast(known.select(F.col("policy_id").alias("_policy_id"), fields)), "_policy_id").select(*turns.columns, "policy")


def _phones(folded: Column, stage: str, contacts: Column, regions: list[str]) -> Column:
    none = F.array().cast(phone.NUMBERS)
    region, on = F.col(f"policy.{stage}_phone_region"), F.col(f"policy.detect_{stage}_phone")
    return reduce(lambda rest, r: F.when(on & (region == r), phone.private_numbers(folded, r, phone.allowed_numbers(contacts, r))).otherwise(rest), regions, none)


def screen_in_force(turns: DataFrame, stage: str = "input", regions: list[str] | None = None) -> DataFrame:
    """turns (text, policy) → verdict, category, kinds, phone_types, pattern, detail, reply, by each turn's own policy.

    ``regions``: the phone regions that the policies name; without them they are looked up, at most one for each code.
    """
    if regions is None:
        regions = sorted(r[0] for r in turns.select(f"policy.{stage}_phone_region").distinct().collect())
    field = lambda name: F.col(f"policy.{name}")
    content = F.col("content") if "content" in turns.columns else F.lit(None).cast("string")
    out = turns.withColumn("_text", extract_text(F.col("text"), content)).withColumn("_settled", is_settled(F.col("_text"))).withColumn("_forms", fold_text("_text", F.col("_settled")))
    out = out.withColumns({"_folded": F.col("_forms.folded"), "_phrase": F.col("_forms.phrase"), "_contacts": parse_contacts(field("public_service_contacts"))})
    out = out.withColumn("_phones", _phones(F.col("_folded"), stage, F.col("_contacts"), regions))
    tests = (detect.has_private_address(F.col("_folded"), allowed_addresses(field("help_desk_email"), F.col("_contacts"))), detect.has_fiscal_code(F.col("_folded")), detect.has_iban(F.col("_folded")), F.size("_phones") > 0)
    kinds = F.array_compact(F.array(*[F.when(field(f"detect_{stage}_{k}") & t, F.lit(k)) for k, t in zip(detect.KINDS, tests, strict=True)]))
    pattern = F.when(field("detect_prompt_injection_custom"), detect.injection_pattern(F.col("_phrase"))) if stage == "input" else F.lit(None).cast("string")
    out = out.withColumns({"kinds": kinds, "phone_types": phone.number_types(F.col("_phones")), "pattern": pattern})
    private = detect.personal_data_verdict(F.col("kinds"), PERSONAL_DATA if stage == "input" else "output_personal_data")
    limits = [detect.length_verdict(F.col("_text"), field("max_message_chars")), F.when(F.col("pattern").isNotNull(), PROMPT_INJECTION)] if stage == "input" else []
    found = F.coalesce(*limits, private)
    replies = [F.when((F.col("verdict") == v) & (F.trim(field(f)) != ""), render(field(f), field("help_desk_email"))) for v, f in REPLY_FIELD.items()]
    out = out.withColumn("verdict", found).withColumn("reply", F.coalesce(*replies)).withColumn("verdict", F.when(F.col("reply").isNotNull(), F.col("verdict")))
    told = (
        F.when(F.col("verdict") == "message_length", F.concat(F.lit("length="), F.length("_text").cast("string"), F.lit(" chars (limit "), field("max_message_chars").cast("string"), F.lit(")")))
        .when(F.col("verdict") == PROMPT_INJECTION, F.concat(F.lit("detector=custom, pattern="), F.col("pattern")))
        .when(F.col("verdict").isNotNull(), F.concat(F.lit("detected="), F.array_join("kinds", "+"), F.when(F.size("phone_types") > 0, F.concat(F.lit(" ("), F.array_join("phone_types", "+"), F.lit(")"))).otherwise("")))
        .otherwise("")
    )
    blocked = F.col("verdict").isNotNull()
    return out.select(*turns.columns, "verdict", F.when(blocked, stage_of(F.col("verdict"))).alias("verdict_stage"), F.when(blocked, category_of(F.col("verdict"))).alias("category"), "kinds", "phone_types", "pattern", told.alias("detail"), "reply")
