"""Allow-lists as tables of any size: addresses and numbers found, less those that a list names.

Found values are exploded, made distinct per message and taken off the list by an anti-join; a list of up to
``BROADCAST_ENTRIES`` goes to every task, a longer one is joined by a shuffle. A value that stands in a third of all
messages is one row of the list and at most a row per message on the other side; adaptive execution splits its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import detect, phone

BROADCAST_ENTRIES = 200_000


def without_listed(found: DataFrame, allowed: DataFrame) -> DataFrame:
    """found (id columns, value) less the rows whose value is listed in allowed (value). Null entries list nothing."""
    listed = allowed.select("value").filter(F.col("value").isNotNull()).distinct()
    return found.join(F.broadcast(listed) if listed.count() <= BROADCAST_ENTRIES else listed, "value", "left_anti")


def _private(messages: DataFrame, key: str, values: Column, allowed: DataFrame, name: str) -> DataFrame:
    found = messages.select(key, F.explode(F.array_distinct(values)).alias("value"))
    left = without_listed(found, allowed).groupBy(key).agg(F.count("*").alias("n"))
    return messages.select(key).join(left, key, "left").select(key, F.coalesce("n", F.lit(0).cast("long")).alias(name))


def private_addresses(messages: DataFrame, allowed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """messages (key, text), allowed (value: any spelling of addresses) → (key, n_private): distinct addresses not listed."""
    listed = allowed.select(F.lower(F.trim("value")).alias("value"))
    return _private(messages, key, detect.addresses(F.coalesce(F.col(text), F.lit(""))), listed, "n_private")


def private_phones(messages: DataFrame, allowed: DataFrame, region: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same for phone numbers; entries are brought to E.164 first, and those that no plan accepts list nothing."""
    listed = allowed.select(phone.parsed(F.col("value"), region, grouped=False)["e164"].alias("value"))
    found = F.transform(phone.numbers(F.coalesce(F.col(text), F.lit("")), region), lambda n: n["e164"])
    return _private(messages, key, found, listed, "n_private")
