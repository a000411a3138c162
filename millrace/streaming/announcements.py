"""Announcements and counters on a stream, with state per source: the last value, the last failure, the number of turns.

Sources are dealt to buckets by hash, and a bucket's state, in the state store, holds a small entry for each of its sources.
An entry goes when the watermark has passed its source's last row by ``idle``. In a micro-batch the rows of a bucket are
ordered by source and place, then compared with the entries, all sources at once, as a call for each source costs
milliseconds: a value is announced when it differs from the last one (A, B, A three times), a failure when it differs from
the state before it, where a success (null) arms it again, and every row takes the next token. The rows of one bucket in
one micro-batch are taken together; the trigger's limits bound them. Rows that arrive after later ones of an earlier batch
count as later; those that the watermark passed by more than ``delay`` are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOKENS = 36**4
#: The entries of a bucket's sources: [source, rows so far, last value, last failure, milliseconds at which it expires].
STATE = "entries string"
IDLE_MS = 30 * 24 * 3600 * 1000
BUCKETS = 1024
_PAIRS = np.array([a + b for a in BASE36 for b in BASE36], dtype=object)


def token_of(n: int) -> str:
    n %= TOKENS
    return "".join(BASE36[n // 36**k % 36] for k in (3, 2, 1, 0))


def tokens_of(n: np.ndarray) -> np.ndarray:
    return _PAIRS[n // 1296 % 1296] + _PAIRS[n % 1296]


def announced(events: DataFrame, idle_ms: int = IDLE_MS, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """A stream (source, place, ts, value, reason) → (source, place, token, value_announced, reason_announced); append mode.

    ``source`` is of a type that a cast to text and back keeps. A checkpoint goes with its number of buckets.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries = {e[0]: e[1:] for e in json.loads(state.get[0])} if state.exists else {}
        now, met = state.getCurrentWatermarkMs(), set()
        if not state.hasTimedOut:
            told, latest = _compared(pd.concat(list(rows)), entries, max(now, 0) + idle_ms, idle_ms)
            met = set(latest)
            entries |= latest
            yield told
        entries = {s: e for s, e in entries.items() if s in met or e[3] >= now}
        if entries:
            state.update((json.dumps([[s, *e] for s, e in entries.items()]),))
            state.setTimeoutTimestamp(max(min(e[3] for e in entries.values()), now + 1))
        else:
            state.remove()

    schema = "source string, place bigint, token string, value_announced boolean, reason_announced boolean"
    source = F.col("source").cast("string")
    dealt = events.withWatermark("ts", delay).select(F.pmod(F.xxhash64(source), F.lit(buckets)).alias("bucket"), source.alias("source"), "place", "ts", F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(0)).alias("at"), "value", "reason")
    told = dealt.groupBy("bucket").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return told.withColumn("source", F.col("source").cast(events.schema["source"].dataType))


def _compared(batch: pd.DataFrame, entries: dict, least: int, idle_ms: int) -> tuple[pd.DataFrame, dict]:
    """The rows of a bucket against its entries: what is announced, and the new entries of the sources met."""
    codes, sources = pd.factorize(batch["source"], use_na_sentinel=False)
    order = np.lexsort((batch["place"].to_numpy(), codes))
    codes, at = codes[order], batch["at"].to_numpy()[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    ends = np.append(starts[1:], len(codes)) - 1
    keys = [None if pd.isna(s) else s for s in sources]
    before = [entries.get(k, (0, None, None, 0)) for k in keys]
    counts = np.array([e[0] for e in before])
    n = counts[codes] + np.arange(len(codes)) - starts[codes] + 1
    values, reasons = (_texts(batch[c])[order] for c in ("value", "reason"))
    changed = (values != _past(values, starts, [e[1] for e in before])) | (n == 1)
    failed = (reasons != None) & (reasons != _past(reasons, starts, [e[2] for e in before]))  # noqa: E711  by element
    until = np.maximum(np.maximum.reduceat(at, starts) + idle_ms, least)
    latest = {k: (int(n[e]), values[e], reasons[e], int(u)) for k, e, u in zip(keys, ends, until, strict=True)}
    told = pd.DataFrame({"source": np.array(keys, dtype=object)[codes], "place": batch["place"].to_numpy()[order], "token": tokens_of(n), "value_announced": changed.astype(bool), "reason_announced": failed.astype(bool)})
    return told, latest


def _texts(column: pd.Series) -> np.ndarray:
    """Texts, with null as None."""
    values = column.to_numpy(dtype=object, copy=True)
    values[pd.isna(values)] = None
    return values


def _past(values: np.ndarray, starts: np.ndarray, before: list) -> np.ndarray:
    """The value before each row; at the first row of a source, that of its entry."""
    past = np.empty_like(values)
    past[1:] = values[:-1]
    past[starts] = before
    return past
