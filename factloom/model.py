"""The fact table: its columns, its two time axes and the basic scans over it.

A fact is a row ``(e, a, v_type, v, v_num, vf_ms, vt_ms, tx, tx_retracted)``: entity, attribute, the
value's type (``ref str int float bool``), its canonical text and, for numbers, its number; the
half-open valid window in milliseconds; the transaction that asserted it and, once it is retracted,
the one that did. Stored tables are partitioned by attribute, so that an attribute scan prunes files.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOREVER = 9223372036854775807
FACT_DDL = "e string, a string, v_type string, v string, v_num double, vf_ms long, vt_ms long, tx long, tx_retracted long"
FACT_COLUMNS = [c.split()[0] for c in FACT_DDL.split(", ")]
#: Longest text value that a fact may have.
MAX_VALUE_CHARS = 4096


def to_ms(instant: str | int | dt.datetime) -> int:
    """Milliseconds of ``YYYY-MM-DD``, a full ISO instant in UTC, a datetime, or a number as it is."""
    if isinstance(instant, bool) or not isinstance(instant, (str, int, dt.datetime)):
        raise ValueError(f"not an instant: {instant!r}")
    if isinstance(instant, int):
        return instant
    t = instant if isinstance(instant, dt.datetime) else dt.datetime.fromisoformat(instant.replace("Z", "+00:00"))
    t = t if t.tzinfo else t.replace(tzinfo=dt.UTC)
    return (t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(milliseconds=1)


def as_of(tx: int | None = None) -> Column:
    """Facts that transaction ``tx`` (None: the latest) has and has not yet retracted."""
    if tx is None:
        return F.col("tx_retracted").isNull()
    return (F.col("tx") <= tx) & (F.col("tx_retracted").isNull() | (F.col("tx_retracted") > tx))


def valid_at(ms: int | Column) -> Column:
    """Half-open: the window's start counts, its end does not."""
    at = F.lit(ms) if isinstance(ms, int) else ms
    return (F.col("vf_ms") <= at) & (at < F.col("vt_ms"))


def snapshot(facts: DataFrame, now: int | None = None, tx: int | None = None) -> DataFrame:
    """Facts at a transaction and a valid instant; ``now=None`` leaves valid time open."""
    seen = facts.filter(as_of(tx))
    return seen if now is None else seen.filter(valid_at(now))


def iso(ms: Column) -> Column:
    """Text of an instant, cut to milliseconds, in UTC; null for an open end."""
    return F.when(ms != FOREVER, F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")))
