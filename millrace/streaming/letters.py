"""Payloads that could not be made into events: counted attempts, the next try, parking, resolution.

The state has a row for each payload that ever failed. A batch's outcomes are merged into it
by payload, so it is a keyed state like any other: a payload that fails again is tried later
and later, one that has failed ``MOST`` times is parked until somebody replays it, and one that
succeeds is resolved. A batch that is merged twice counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "raw_id string, connection_id string, source string, attempts int, error string, failed_at timestamp, next_try timestamp, parked_at timestamp, resolved_at timestamp, batch string"
#: Attempts until a payload is parked, and seconds until the second one; each wait is twice the last.
MOST, WAIT = 6, 60


def merged(state: DataFrame, outcomes: DataFrame, now: Column, batch: str, most: int = MOST, wait: int = WAIT) -> DataFrame:
    """The state after a batch's outcomes (raw_id, connection_id, source, error: null where it went well)."""
    last = outcomes.groupBy("raw_id").agg(F.first("connection_id").alias("_connection"), F.first("source").alias("_source"), F.max("error").alias("_error"))
    both = state.withColumnRenamed("raw_id", "_old").join(last, F.col("_old") == F.col("raw_id"), "full")
    known, told = F.col("_old").isNotNull(), F.col("raw_id").isNotNull() & ~F.col("batch").eqNullSafe(batch)
    failed, went_well = told & F.col("_error").isNotNull(), told & F.col("_error").isNull()
    # A payload that fails after it was resolved begins anew.
    attempts = F.when(failed, F.when(F.col("resolved_at").isNull(), F.coalesce("attempts", F.lit(0))).otherwise(0) + 1).otherwise(F.col("attempts"))
    parked = F.when(failed, F.when(F.col("_n") >= most, F.when(F.col("resolved_at").isNull(), F.coalesce("parked_at", now)).otherwise(now))).otherwise(F.col("parked_at"))
    later = F.timestamp_millis(F.unix_millis(now) + (F.lit(wait * 1000) * F.pow(2.0, F.col("_n") - 1)).cast("long"))
    columns = {
        "raw_id": F.coalesce("_old", "raw_id"), "connection_id": F.coalesce("connection_id", "_connection"), "source": F.coalesce("source", "_source"), "attempts": F.col("_n").cast("int"),
        "error": F.when(failed, F.col("_error")).otherwise(F.col("error")), "failed_at": F.when(failed, now).otherwise(F.col("failed_at")),
        "next_try": F.when(failed, F.when(F.col("_n") < most, later)).when(~went_well, F.col("next_try")), "parked_at": parked,
        "resolved_at": F.when(went_well, F.coalesce("resolved_at", now)).when(~failed, F.col("resolved_at")), "batch": F.when(told, F.lit(batch)).otherwise(F.col("batch")),
    }
    return both.where(known | failed).withColumn("_n", attempts).select(*[c.alias(k) for k, c in columns.items()])


def due(state: DataFrame, now: Column) -> DataFrame:
    """Payloads to try again."""
    return state.where(F.col("resolved_at").isNull() & F.col("parked_at").isNull() & (F.col("next_try") <= now))


def parked(state: DataFrame) -> DataFrame:
    """Payloads that wait for somebody."""
    return state.where(F.col("resolved_at").isNull() & F.col("parked_at").isNotNull())
