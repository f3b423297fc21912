"""Tiles: what a result step shows. A tile is one row, worked out in one job."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.values import bucket_key, round6
from millrace.operators import aggregates as A
from millrace.operators.windows import Range
from millrace.plans.engine import Run, next_change, ranged, undated_of
from millrace.sources.records import field_of

_SERIES = "array<struct<bucket:string,value:double>>"
_GROUPS = "array<struct<label:string,value:double>>"
# Seconds of the units of a duration.
_DURATIONS = {"days": 86_400, "hours": 3_600, "minutes": 60, "seconds": 1}
_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£"}


def headline(shape: A.Shape, by: Sequence[str] = ()) -> DataFrame:
    """by, value, error: a number itself; the metric over all records if a list carries it,
    else the sum of its parts; how many records a dataset holds."""
    if isinstance(shape, A.Scalar):
        return shape.df.select(*by, "value", "error")
    if isinstance(shape, A.Dataset):
        return A.count_of(shape.frame, by).df
    if shape.total is not None:
        return shape.total.df.select(*by, "value", "error")
    return shape.df.groupBy(*by).agg(F.coalesce(round6(F.sum("value")), F.lit(0.0)).alias("value")).withColumn("error", F.lit(None).cast("string"))


def time_series(shape: A.Dataset, time_field: str, unit: str = "month") -> A.Series:
    """Records counted by the bucket of a date field; those without the date are left out."""
    key = bucket_key(field_of(shape.frame, time_field).ms, unit)
    rows = shape.frame.df.select(*[c for c in ("_range",) if c in shape.frame.df.columns], key.alias("bucket")).where("bucket is not null")
    return A.Series(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias("value")), None)


def tile_parts(run: Run, node: str) -> DataFrame | None:
    """Every part of a result as a row, of which a tile shows the largest: bucket or label, and value."""
    shape = run.ok(node).shape
    return shape.df if isinstance(shape, A.Series | A.Grouped) else None


def _lists(shape: A.Shape, by: Sequence[str], most: int | None) -> DataFrame | None:
    """by, series or groups: a tile's parts as one sorted array, of groups the ``most`` largest, which
    Spark picks task by task, or all."""
    if isinstance(shape, A.Series):
        return shape.df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bucket", "value"))).alias("series"))
    if isinstance(shape, A.Grouped):
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("down"), "label", "value")))
        df = shape.df
        if most is not None:
            df = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "label"))).where(F.col("_rank") <= most)
        return df.groupBy(*by).agg(F.transform(ranked, lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"))).alias("groups"))
    return None


def _tiled(shape: A.Shape, by: Sequence[str], most: int | None) -> DataFrame:
    head, lists = headline(shape, by), _lists(shape, by, most)
    if lists is not None:
        head = head.join(lists, list(by), "left") if by else head.crossJoin(F.broadcast(lists))  # a row by a row
    for name, kind in (("series", _SERIES), ("groups", _GROUPS)):
        if name not in head.columns:
            head = head.withColumn(name, F.lit(None).cast(kind))
    return head.select(*by, "value", "error", "series", "groups")


def build_tile(run: Run, node: str, spec: dict | None = None, most: int | None = None) -> DataFrame:
    """value, error, series, groups of a result step: one row. ``most``: how many groups it may hold,
    where there can be more than one row should; ``tile_parts`` has them as rows."""
    shape, spec = run.ok(node).shape, spec or {}
    if isinstance(shape, A.Dataset) and spec.get("timeField") and spec.get("viz") in ("line", "bar"):
        shape = time_series(shape, spec["timeField"], spec.get("timeUnit") or "month")
    return _tiled(shape, (), most)


def tile_by_range(run: Run, node: str, ranges: Sequence[Range], time_field: str | None = None, most: int | None = None) -> DataFrame:
    """_range, value, error (why the range has no number), series, groups, undated: a row for every range."""
    found = ranged(run, node, ranges, time_field)
    out = _tiled(found.shape, ("_range",), most)
    none = undated_of(found)
    n = F.lit(0).cast("long") if none is None else F.when(~F.col("_range").isin([r.key for r in ranges if r.all]), none).otherwise(0).cast("long")
    return out.withColumn("undated", n)


def next_change_of(run: Run, node: str, ranges: Sequence[Range], now_ms: int, time_field: str | None = None) -> DataFrame:
    return next_change(ranged(run, node, ranges, time_field), ranges, now_ms)


def sample(run: Run, node: str, now_ms: int, n: int = 3) -> DataFrame:
    """The latest records that have happened, newest first, then the next to come, soonest first."""
    at = field_of(run.frame(node), "occurredAt").ms
    later = at > now_ms
    return run.df(node).orderBy(later, F.when(later, at).otherwise(-at), F.desc("_ord")).limit(n)


def delta(series: DataFrame, by_range: DataFrame | None = None) -> DataFrame:
    """current, previous: today against yesterday if both ranges have a number, else the last
    complete bucket against the one before (the final one is still filling; three are needed)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("bucket")))  # the buckets of one tile
    ranked = series.select("value", place.alias("p"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n")).where("n >= 3")
    pick = lambda df, c: F.max(F.when(c, F.col("value")))
    last = ranked.agg(pick(ranked, F.col("p") == 2).alias("current"), pick(ranked, F.col("p") == 3).alias("previous"))
    if by_range is None:
        return last
    days = by_range.agg(F.max(F.when(F.col("_range") == "today", F.col("value"))).alias("t"), F.max(F.when(F.col("_range") == "yesterday", F.col("value"))).alias("y"))
    both = days.crossJoin(F.broadcast(last))  # a row by a row
    known = F.col("t").isNotNull() & F.col("y").isNotNull()
    return both.select(F.when(known, F.col("t")).otherwise(F.col("current")).alias("current"), F.when(known, F.col("y")).otherwise(F.col("previous")).alias("previous"))


def delta_text(current: float, previous: float, percent: bool = False) -> str:
    """Points for percentages, else the change in percent, or the difference where there was nothing."""
    gap = current - previous
    if percent:
        return f"{gap:+.1f} pts"
    return f"{gap / abs(previous) * 100:+.0f}%" if previous else f"{gap:+g}"


def format_value(value: float | None, kind: str = "number", precision: int = 0, currency: str = "USD", unit: str = "minutes", display: str = "auto") -> str:
    """A number, percentage, amount of money or duration as it is shown."""
    if value is None or math.isnan(value):
        return "–"
    if kind == "duration":
        seconds = value * _DURATIONS.get(unit, 60)
        if display != "auto":
            return f"{seconds / _DURATIONS[display]:,.{precision}f} {display}"
        left, parts = round(abs(seconds)), []
        for name, size in _DURATIONS.items():
            if left >= size or (name == "seconds" and not parts):
                parts.append(f"{left // size}{name[0]}")
                left %= size
            elif parts:
                break  # the two largest neighbours only
            if len(parts) == 2:
                break
        return ("-" if seconds < 0 else "") + " ".join(parts)
    text = f"{abs(value):,.{precision}f}"
    text = {"percent": text + "%", "currency": _SYMBOLS.get(currency, currency + " ") + text}.get(kind, text)
    return ("-" if value < 0 else "") + text


def duration_unit(path: str) -> str | None:
    """The unit that a field's name speaks of."""
    words = path.lower().replace(".", "_").split("_")
    for unit in _DURATIONS:
        if unit in words or unit[:-1] in words or {"minutes": "min", "seconds": "sec", "hours": "hrs"}.get(unit) in words:
            return unit
    return None
