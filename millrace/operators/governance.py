"""Operators around the flows: the recompute queue, metric visibility, schema differences, and
how far two readings of dates drift apart."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.dates import canonical_date
from millrace.functions.values import to_ms

# ---- recompute queue ------------------------------------------------------------------


def recompute_batch(stale: DataFrame, costs: DataFrame, budget: float) -> DataFrame:
    """flow_id, computed_at, cost, place: the flows that a pass works out, stalest first (never worked
    out before all). A flow is begun while the budget is not spent, so there is at least one.

    stale: flow_id, computed_at of stale tiles; costs: flow_id, seconds (none: at once). The queue is
    cut before it is summed: no more flows can begin than the least cost goes into the budget."""
    flows = stale.groupBy("flow_id").agg(F.min(F.struct(F.col("computed_at").isNotNull(), "computed_at")).alias("c")).select("flow_id", F.col("c.computed_at").alias("computed_at"))
    queue = flows.join(costs.groupBy("flow_id").agg(F.max("seconds").alias("cost")), "flow_id", "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    least = queue.agg(F.min("cost")).first()[0]
    order = (F.asc_nulls_first("computed_at"), F.asc("flow_id"))
    if least:
        queue = queue.orderBy(*order).limit(int(budget // least) + 1)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as one pass can work out
    placed = queue.withColumns({"before": F.coalesce(F.sum("cost").over(before), F.lit(0.0)), "place": F.row_number().over(Window.orderBy(*order))})
    return placed.where((F.col("before") < budget) | (F.col("place") == 1)).select("flow_id", "computed_at", "cost", "place")


# ---- metric visibility ----------------------------------------------------------------


def visible_metrics(ranks: DataFrame, inherits: DataFrame, grants: DataFrame) -> DataFrame:
    """rank, metric: what each rank may see, its own and what the ranks that it inherits from may see,
    over any number of steps; metric is null where that is everything.

    ranks: rank, all_metrics; inherits: rank, parent; grants: rank, metric. A recursive query walks the
    links; a rank is not entered twice on one way, so loops end. Parents that are gone are passed over."""
    spark, name = ranks.sparkSession, f"v{uuid.uuid4().hex}"
    views = {"ranks": ranks.select("rank"), "links": inherits.select("rank", "parent").distinct()}
    try:
        for k, df in views.items():
            df.createOrReplaceTempView(f"{name}_{k}")
        reached = spark.sql(
            f"with recursive reach(rank, at, way) as (select rank, rank, array(rank) from {name}_ranks union all "
            f"select r.rank, l.parent, array_append(r.way, l.parent) from reach r join {name}_links l on l.rank = r.at join {name}_ranks p on p.rank = l.parent where not array_contains(r.way, l.parent)) "
            "select distinct rank, at from reach"
        )
        seen = reached.select("rank", "at").join(ranks.select(F.col("rank").alias("at"), "all_metrics"), "at")
        whole = seen.where("all_metrics").select("rank").distinct()
        listed = seen.join(whole, "rank", "left_anti").join(grants.select(F.col("rank").alias("at"), "metric"), "at").select("rank", "metric").distinct()
        return listed.unionByName(whole.withColumn("metric", F.lit(None).cast("string")))
    finally:
        for k in views:
            spark.catalog.dropTempView(f"{name}_{k}")


# ---- schema differences ---------------------------------------------------------------


def columns_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """table, column, type of tables: a row for each column."""
    rows = [(name, c, kind) for name, df in tables.items() for c, kind in df.dtypes]
    return spark.createDataFrame(rows, "table string, column string, type string")


def schema_difference(expected: DataFrame, live: DataFrame) -> DataFrame:
    """table, column, problem, expected, live: tables and columns that are missing or not known, and types that differ."""
    tables = lambda df: df.select("table").distinct()
    names = ("table", "column", "problem", "expected", "live")
    none, nowhere = F.lit(None).cast("string"), F.lit(None).cast("string")

    def lacking(a: DataFrame, b: DataFrame, what: str, expected: Column, live: Column) -> DataFrame:
        whole = tables(a).join(tables(b), "table", "left_anti").select("table", nowhere.alias("column"), F.lit(f"{what} table").alias("problem"), none.alias("expected"), none.alias("live"))
        columns = a.join(tables(b), "table", "left_semi").join(b, ["table", "column"], "left_anti").select("table", "column", F.lit(f"{what} column").alias("problem"), expected.alias("expected"), live.alias("live"))
        return whole.unionByName(columns)

    both = expected.alias("e").join(live.alias("l"), ["table", "column"]).where(~F.col("e.type").eqNullSafe(F.col("l.type")))
    differing = both.select("table", "column", F.lit("type").alias("problem"), F.col("e.type").alias("expected"), F.col("l.type").alias("live"))
    return lacking(expected, live, "missing", F.col("type"), none).unionByName(lacking(live, expected, "unexpected", none, F.col("type"))).unionByName(differing).select(*names)


# ---- drift of date readings -----------------------------------------------------------


def _loose_ms(text: Column) -> Column:
    """The moment that Spark's own cast reads from a text, years and months alone included."""
    return F.unix_millis(text.try_cast("timestamp"))


def date_drift(text: Column, field: str) -> Column:
    """How a loose and a strict reading of one text differ: loose only, strict only, divergent, or null."""
    strict, loose = to_ms(canonical_date(text, field)), _loose_ms(text)
    return F.when(strict.isNull(), F.when(loose.isNotNull(), "loose only")).when(loose.isNull(), "strict only").when(loose != strict, "divergent")


def drift_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, kind, n over all rows, in one pass."""
    kinds = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), date_drift(F.col(f), f).alias("kind")) for f in fields])).alias("d")
    return rows.select(kinds).select("d.field", "d.kind").where("kind is not null").groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))


def drift_metrics(fields: list[str]) -> list[Column]:
    """The same counts as metrics of a write: give them to ``DataFrame.observe``."""
    return [F.count_if(date_drift(F.col(f), f) == k).alias(f"{f} {k}") for f in fields for k in ("loose only", "strict only", "divergent")]
