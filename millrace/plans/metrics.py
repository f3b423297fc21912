"""Classic metrics: aggregates, trends, funnels and drill-downs over live events of a
closed period. Their filters follow SQL's three-valued logic."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.rules import classic_field, classic_rules
from millrace.sources.records import EventStore


@dataclass(frozen=True)
class Period:
    """Both ends belong to it; milliseconds."""

    start: int
    end: int


def _events(store: EventStore, period: Period, source: str | None, event_type: str | None, filters: dict | None, board: str | None = None) -> DataFrame:
    frame = store.scan(source=source, event_type=event_type)
    df = frame.df.where((F.col("occurredAt") >= F.timestamp_millis(F.lit(period.start))) & (F.col("occurredAt") < F.timestamp_millis(F.lit(period.end + 1))))
    if board:
        df = df.where(F.col("source") == board)
    condition = classic_rules(filters)
    return df if condition is None else df.where(condition)


def _metric(d: dict) -> Column:
    how = d.get("aggregation", "count")
    if how == "sum":
        return F.coalesce(F.sum(classic_field(d.get("valueField") or "value").cast("double")), F.lit(0.0))
    if how == "count_distinct":
        return F.count_distinct(classic_field(d.get("distinctField") or "subject")).cast("double")
    return F.count(F.lit(1)).cast("double")


def compute_aggregate(store: EventStore, d: dict, period: Period, board: str | None = None) -> DataFrame:
    """value, or bucket and value where the definition has a timeBucket (day, week or month)."""
    df = _events(store, period, d.get("source"), d.get("eventType"), d.get("filters"), board)
    if not d.get("timeBucket"):
        return df.agg(_metric(d).alias("value"))
    bucket = F.date_format(F.date_trunc(d["timeBucket"], "occurredAt"), "yyyy-MM-dd")
    return df.groupBy(bucket.alias("bucket")).agg(_metric(d).alias("value"))


def compute_funnel(store: EventStore, stages: Sequence[dict], period: Period, board: str | None = None) -> DataFrame:
    """stage, label, count, conversion_from_first, conversion_from_prev, bottleneck: distinct
    subjects of each stage on its own, all stages in one pass over the events."""
    df = _events(store, period, None, None, None, board)
    counts = []
    for s in stages:
        hit = F.lit(True)
        for column, wanted in (("source", s.get("source")), ("eventType", s.get("eventType"))):
            hit = hit & (F.col(column) == wanted) if wanted else hit
        condition = classic_rules(s.get("filters"))
        counts.append(hit if condition is None else hit & condition)
    hits = F.array_compact(F.array(*[F.when(c, i) for i, c in enumerate(counts)]))
    found = df.select("subject", F.explode(hits).alias("stage")).groupBy("stage").agg(F.count_distinct("subject").alias("n"))
    labels = df.sparkSession.createDataFrame([(i, s["label"]) for i, s in enumerate(stages)], "stage int, label string")
    rows = F.broadcast(labels).join(found, "stage", "left").withColumn("count", F.coalesce("n", F.lit(0)).cast("long"))
    order = Window.orderBy("stage")  # one row a stage
    prev, first = F.lag("count").over(order), F.first("count").over(order)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    steps = rows.withColumns({"drop": prev - F.col("count"), "conversion_from_first": share(F.col("count"), first), "conversion_from_prev": share(F.col("count"), F.coalesce(prev, F.col("count")))})
    # The first of the largest drops; a drop below zero by more than one is none.
    worst = F.min(F.when(F.col("drop") > -1, F.struct((-F.col("drop")).alias("d"), "stage"))).over(Window.partitionBy())
    return steps.select("stage", "label", "count", "conversion_from_first", "conversion_from_prev", F.coalesce(F.col("stage") == worst["stage"], F.lit(False)).alias("bottleneck"))


def query_events(store: EventStore, period: Period, source: str | None = None, event_type: str | None = None, filters: dict | None = None, limit: int = 50) -> DataFrame:
    """The newest matching events; ties by id, downwards."""
    df = _events(store, period, source, event_type, filters)
    return df.orderBy(F.desc("occurredAt"), F.desc("id")).limit(limit).drop("_ord", "_steps")


def distinct_sources(store: EventStore) -> DataFrame:
    return store.scan().df.select("source").distinct().orderBy("source")


def distinct_event_types(store: EventStore, source: str | None = None, connection: str | None = None) -> DataFrame:
    return store.scan(connection=connection, source=source).df.select("eventType").distinct().orderBy("eventType")
