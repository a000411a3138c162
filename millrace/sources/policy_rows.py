"""Policies as rows: the rules of every field as columns, for tables of stored settings."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_contacts
from ..plans.taxonomy import models
from .policy import DEVICES, LEAST_PHONE_DIGITS, REPLY_FIELD, Policy, regions


def _address(x: Column) -> Column:
    """An at sign with text on both sides of it."""
    return F.contains(F.regexp_replace(F.trim(x), "^@+|@+$", ""), F.lit("@"))


def _contact(x: Column) -> Column:
    digits = F.length(F.regexp_replace(x, "[^0-9]", ""))
    return F.when(F.contains(x, F.lit("@")), _address(x)).otherwise((digits >= LEAST_PHONE_DIGITS) & ~x.rlike(r"[^0-9+./() \u00A0-]"))


def migrated_device(value: Column) -> Column:
    """Old numeric devices, as text, become names; anything else stays as it is."""
    named = F.create_map(*[F.lit(x) for name, n in DEVICES.items() for x in (str(n), name)])
    return F.coalesce(F.element_at(named, value), value)


def _rule(name: str, default: object, x: Column) -> Column:
    if name == "classifier_device":
        return migrated_device(x).isin(*DEVICES)
    if name == "help_desk_email":
        return _address(x)
    if name == "public_service_contacts":
        return F.forall(parse_contacts(x), _contact)
    if name.endswith("_phone_region"):
        return F.upper(F.trim(x)).rlike(f"^(?:{'|'.join(sorted(regions()))})$")
    if name == "prompt_injection_classifier_model":
        return x.isin(*models("injection"))
    if name == "offensive_input_classifier_model":
        return x.isin(*models("offensive"))
    if name in REPLY_FIELD.values():
        return F.trim(x) != ""
    if isinstance(default, float):
        return x.between(0, 1)
    if isinstance(default, int) and not isinstance(default, bool):
        return x >= 0
    return F.lit(True)


def bad_fields(policies: DataFrame) -> DataFrame:
    """Adds bad_fields: the names of the fields, among those that are columns, whose value breaks its rule, sorted. A null
    value is a field that was not stored, and is not judged."""
    known = [(n, d) for n, d in sorted(asdict(Policy()).items()) if n in policies.columns]
    broken = [F.when(F.col(n).isNotNull() & ~F.coalesce(_rule(n, d, F.col(n)), F.lit(False)), F.lit(n)) for n, d in known]
    return policies.withColumn("bad_fields", F.array_compact(F.array(*broken, F.lit(None).cast("string"))))
