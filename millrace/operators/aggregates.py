"""Aggregations of records, whole or split by time, field or category, and what is made
of two numbers.

Every result may be computed for several dashboard ranges at once: ``by`` names the
columns (``_range``, or none) that each result row is for. Errors that depend on the data
are the column ``error`` of a scalar, worked out in the same aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.values import bucket_key, group_label, round6
from millrace.operators.rules import rules
from millrace.sources.records import Frame, bare, field_of

AGGREGATIONS = ("count", "count_distinct", "sum", "avg", "median", "min", "max")
FORMULAS = ("add", "average", "subtract", "difference", "multiply", "divide", "ratio", "percentage", "percent_change")


@dataclass(frozen=True)
class Dataset:
    frame: Frame
    kind = "dataset"


@dataclass(frozen=True)
class Scalar:
    """by, value, error: one row for each range, or one."""

    df: DataFrame
    kind = "scalar"


@dataclass(frozen=True)
class Series:
    """by, bucket, value, and the same metric over all records."""

    df: DataFrame
    total: Scalar | None
    kind = "series"


@dataclass(frozen=True)
class Grouped:
    """by, label, value, place (ties are shown in this order), and the same metric over all records, if it has one."""

    df: DataFrame
    total: Scalar | None
    kind = "grouped"


Shape = Dataset | Scalar | Series | Grouped


def fields_of(config: dict) -> list[str]:
    """The columns to add up in each record: distinct, without blanks."""
    return list(dict.fromkeys(f for f in [config.get("field", "value"), *(config.get("extraFields") or [])] if f and f.strip()))


def combined(frame: Frame, paths: Sequence[str]) -> Column:
    """The sum of a record's readable columns; null if none is."""
    numbers = [field_of(frame, p).number for p in paths]
    if len(numbers) == 1:
        return numbers[0]
    if not numbers:
        return F.lit(None).cast("double")
    total = sum((F.coalesce(n, F.lit(0.0)) for n in numbers[1:]), F.coalesce(numbers[0], F.lit(0.0)))
    return F.when(F.coalesce(*numbers).isNotNull(), total)


def metric(how: str, c: Column) -> Column:
    """The aggregation of c (a distinct-counted text, or a number); 0 of nothing."""
    if how == "count":
        return F.count(F.lit(1)).cast("double")
    if how == "count_distinct":
        return F.count_distinct(F.nullif(c, F.lit(""))).cast("double")
    made = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[how](c)
    return F.coalesce(made if how in ("min", "max") else round6(made), F.lit(0.0))


def medians(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, value: the exact median of ``_v``, which no task holds the values of. Values are counted
    in bins of magnitude, the counts show which bin (or two) holds the middle, and only
    the values of that bin are put in order, each different one once."""
    v = F.col("_v")
    binned = rows.where("_v is not null").select(*by, v, F.floor(F.signum(v) * F.log1p(F.abs(v)) * 1024).alias("_bin"))
    whole, inner = Window.partitionBy(*by), Window.partitionBy(*by, "_bin")
    counts = binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    placed = counts.withColumns({"_upto": F.sum("_n").over(whole.orderBy("_bin")), "_all": F.sum("_n").over(whole)})
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = placed.where((F.col("_upto") > low) & (F.col("_upto") - F.col("_n") <= high)).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bin").alias("_in"), (F.col("_upto") - F.col("_n")).alias("_before"), "_all")
    same = F.col("_bin") == F.col("_in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    values = binned.join(middle, same).groupBy(*by, "_bin", "_v", "_before", "_all").agg(F.count(F.lit(1)).alias("_n"))
    steps = values.withColumn("_upto", F.col("_before") + F.sum("_n").over(inner.orderBy("_v")))
    at = lambda place: F.min(F.when(F.col("_upto") > place, v))
    return steps.groupBy(*by).agg(((at(low) + at(high)) / 2).alias("value"))


def summed_up(rows: DataFrame, by: Sequence[str], how: str, **more: Column) -> DataFrame:
    """by, value (the aggregation of ``_v``) and more aggregations; one row if by is empty."""
    if how != "median":
        return rows.groupBy(*by).agg(metric(how, F.col("_v")).alias("value"), *[c.alias(k) for k, c in more.items()])
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(k) for k, c in more.items()])
    middle = medians(rows, by).withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    both = sums.join(middle, reduce(and_, same), "left") if by else sums.crossJoin(F.broadcast(middle))  # a row by a row
    return both.select(*by, F.coalesce(round6(F.col("value")), F.lit(0.0)).alias("value"), *more)


def _measured(frame: Frame, how: str, paths: Sequence[str], distinct: str) -> Column:
    if how == "count":
        return F.lit(1)
    return field_of(frame, distinct).text if how == "count_distinct" else combined(frame, paths)


def _empty_field(frame: Frame, how: str, paths: Sequence[str], distinct: str) -> list[tuple[str, Column, str]]:
    """Flags (name, Column per record, error): an error if there are records and no record has the flag."""
    if how == "count":
        return []
    if how == "count_distinct":
        return [("_any", F.coalesce(field_of(frame, distinct).text, F.lit("")) != "", f'No record has a value in "{bare(distinct)}" to count.')]
    missing = [(f"_has{i}", field_of(frame, p).exists, f'No record has the field "{bare(p)}" for this {how}.') for i, p in enumerate(paths)] if len(paths) > 1 else []
    return [*missing, ("_any", combined(frame, paths).isNotNull(), f'No record has a number in {", ".join(map(bare, paths)) or "(no field chosen)"} for this {how}.')]


def filled(df: DataFrame, by: Sequence[str], ranges: DataFrame | None, missing: dict[str, Column]) -> DataFrame:
    """df with a row for every range: a range without records has the values of nothing."""
    if not by or ranges is None:
        return df
    return F.broadcast(ranges).join(df, list(by), "left").withColumns({k: F.coalesce(k, v) for k, v in missing.items()})  # a handful of ranges


def aggregate(frame: Frame, config: dict, by: Sequence[str] = (), ranges: DataFrame | None = None) -> Shape:
    """One of the seven aggregations, whole or split by groupBy."""
    how, distinct = config.get("aggregation") or config.get("op") or "count", config.get("distinctField") or "subject"
    paths, split = fields_of(config), config.get("groupBy")
    flags = _empty_field(frame, how, paths, distinct)
    key = None
    if split and split.get("type") == "time":
        key = bucket_key(field_of(frame, "occurredAt").ms, split.get("unit", "day"))
    elif split:
        key = group_label(field_of(frame, split["field"]).text)
    rows = frame.df.select(*by, *([key.alias("_key"), "_ord"] if split else []), _measured(frame, how, paths, distinct).alias("_v"), *[c.alias(n) for n, c, _ in flags])
    error = F.lit(None).cast("string")
    for name, _, said in reversed(flags):
        error = F.when((F.count(F.lit(1)) > 0) & ~F.coalesce(F.bool_or(name), F.lit(False)), said).otherwise(error)
    total = summed_up(rows, by, how, error=error)
    scalar = Scalar(filled(total, by, ranges, {"value": F.lit(0.0)}).select(*by, "value", "error"))
    if not split:
        return scalar
    parts = summed_up(rows, [*by, "_key"], how, place=F.max("_ord"))
    if split["type"] == "time":
        return Series(parts.select(*by, F.col("_key").alias("bucket"), "value"), scalar)
    return Grouped(parts.select(*by, F.col("_key").alias("label"), "value", "place"), scalar)


def group(frame: Frame, config: dict, by: Sequence[str] = (), ranges: DataFrame | None = None) -> Grouped:
    """Records counted, summed or distinct-counted by a field's values, or by categories:
    the first whose conditions hold, else the fallback. Categories without records stay, as 0."""
    how = config.get("aggregation", "count")
    measured = _measured(frame, how, [config.get("valueField") or "value"], config.get("distinctField") or "subject")
    if config.get("mode", "field") == "field":
        label = group_label(field_of(frame, config.get("field") or "source").text)
        rows = frame.df.select(*by, label.alias("label"), "_ord", measured.alias("_v"))
        return Grouped(summed_up(rows, [*by, "label"], how, place=F.max("_ord")), None)
    fallback = config.get("fallbackLabel") or "Other"
    label, labels = None, list(dict.fromkeys([*(c["label"] for c in config.get("categories") or []), fallback]))
    for c in config.get("categories") or []:
        hit = rules(frame, c.get("filters") or {})
        label = F.when(hit, c["label"]) if label is None else label.when(hit, c["label"])
    label = F.lit(fallback) if label is None else label.otherwise(fallback)
    parts = summed_up(frame.df.select(*by, label.alias("label"), measured.alias("_v")), [*by, "label"], how)
    wanted = frame.df.sparkSession.createDataFrame([(x, -i) for i, x in enumerate(labels)], "label string, place int")
    if by and ranges is not None:
        wanted = wanted.crossJoin(ranges)  # labels of the definition by ranges of the dashboard
    out = F.broadcast(wanted).join(parts, [*by, "label"], "left").select(*by, "label", F.coalesce("value", F.lit(0.0)).alias("value"), "place")
    return Grouped(out, None)


def count_of(frame: Frame, by: Sequence[str] = (), ranges: DataFrame | None = None) -> Scalar:
    n = frame.df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return Scalar(filled(n, by, ranges, {"value": F.lit(0.0)}).select(*by, "value", F.lit(None).cast("string").alias("error")))


def single_field(frame: Frame, path: str, side: str) -> Scalar:
    """The number in one field of a step that holds one record."""
    f = field_of(frame, path)
    one = frame.df.select(f.number.alias("v"), f.text.alias("t")).groupBy().agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v"), F.max("t").alias("t"))
    error = (
        F.when(F.col("n") == 0, f'Input {side}: there is no record to take "{path}" from.')
        .when(F.col("n") > 1, F.concat(F.lit(f'Input {side}: "{path}" is not one value, as the step holds '), F.col("n").cast("string"), F.lit(" records.")))
        .when(F.coalesce("t", F.lit("")) == "", f'Input {side}: the record has no "{path}".')
        .when(F.col("v").isNull(), F.concat(F.lit(f'Input {side}: "{path}" is no number but "'), F.substring("t", 1, 60), F.lit('".')))
    )
    return Scalar(one.select(F.when(error.isNull(), F.col("v")).alias("value"), error.alias("error")))


def constant(frame_or_session, value: float) -> Scalar:
    return Scalar(frame_or_session.range(1).select(F.lit(float(value)).alias("value"), F.lit(None).cast("string").alias("error")))


def formula(op: str, a: Scalar, b: Scalar, by: Sequence[str] = ()) -> Scalar:
    """Two numbers to one, rounded to six decimals; a zero divisor is an error."""
    left = a.df.select(*[c for c in by if c in a.df.columns], F.col("value").alias("a"), F.col("error").alias("ea"))
    right = b.df.select(*[c for c in by if c in b.df.columns], F.col("value").alias("b"), F.col("error").alias("eb"))
    on = [c for c in by if c in left.columns and c in right.columns]
    both = left.join(right, on) if on else left.crossJoin(F.broadcast(right))  # one row on a side at least
    x, y = F.col("a"), F.col("b")
    safe = F.nullif(y, F.lit(0.0))
    made = {"add": x + y, "average": (x + y) / 2, "subtract": x - y, "difference": x - y, "multiply": x * y, "divide": x / safe, "ratio": x / safe, "percentage": x / safe * 100, "percent_change": (x - y) / safe * 100}
    if op not in made:
        raise ValueError(f'There is no formula "{op}".')
    divides = op in ("divide", "ratio", "percentage", "percent_change")
    zero = F.when(y == 0, "The second number is zero, so nothing can be divided by it.") if divides else F.lit(None).cast("string")
    error = F.coalesce("ea", "eb", zero)
    return Scalar(both.select(*[c for c in by if c in both.columns], F.when(error.isNull(), round6(made[op])).alias("value"), error.alias("error")))
