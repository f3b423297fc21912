"""Registered queries around the flows: trials of steps, offered fields, the recompute queue,
metric visibility, schema differences and the drift of date readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import governance as G
from millrace.plans.catalog import EVENTS_NOW, GET, ORACLE, QUERIES, chain, register
from millrace.plans.trial import saved_paths, tried
from millrace.sources.records import adapted, table
from millrace.sources.registry import fields_seen, infer_fields, offered_fields, presence_by_path

__all__ = ["ORACLE", "QUERIES"]

_TRIAL = chain(GET, ("kept", "filter", {"rules": [{"field": "value", "op": "gte", "value": "50"}]}), ("recent", "time", {"mode": "preset", "preset": "last_7_days"}), ("one", "filter", {"rules": [{"field": "eventType", "op": "equals", "value": "signup"}]}))
_RECENT = "value >= 50 and ts between timestamp '2024-01-23 12:00:00' and timestamp '2024-01-30 12:00:00'"


@register(
    "step_trial",
    f"with s(step, id, ts) as (select 'get', event_id, ts from events union all select 'kept', event_id, ts from events where value >= 50 union all select 'recent', event_id, ts from events where {_RECENT} union all select 'one', event_id, ts from events where event_type = 'signup' and {_RECENT}) "
    "select step, 'ok' as state, count(*)::bigint as records, arg_max(id::varchar, (epoch_us(ts), id::varchar)) as newest from s group by 1",
)
def step_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and newest records of every step, seen while the last one runs once."""
    found = tried(adapted(spark, sf_dir, "events"), _TRIAL, "one", EVENTS_NOW)
    return found.select("step", "state", "records", F.get_json_object(F.get("sample", F.lit(0)), "$.id").alias("newest"))


@register(
    "offered_fields",
    "select 'k' as path, 'number' as type, count(*) filter (where props->>'$.k' is not null)::bigint as populated, 'records' as origin from events where event_type = 'view' union all select 'properties.saved', null, null, 'registry' where false union all select 'old.saved', 'string', null::bigint, 'registry'",
)
def offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of one record type, counted over all of its records; a field that the graph has saved is
    offered though nothing carries it, another that nothing carries is not."""
    views = adapted(spark, sf_dir, "events").scan(event_type="view").df
    pinned = saved_paths(chain(GET, ("f", "filter", {"rules": [{"field": "old.saved", "op": "equals", "value": "1"}]})))
    known = fields_seen(views, "connectionId").select("path", "type").unionByName(spark.createDataFrame([("old.saved", "string"), ("old.other", "string")], "path string, type string"))
    pins = spark.createDataFrame([(p,) for p in pinned], "path string")
    return offered_fields(infer_fields(views), known, pins, presence_by_path(views))


@register(
    "recompute_queue",
    "with f as (select o_custkey::varchar as flow_id, min(case when o_custkey % 9 > 0 then o_orderdate end) as computed_at, (any_value(o_custkey) % 4 + 1)::double as cost from orders group by o_custkey), "
    "q as (select *, row_number() over w as place, coalesce(sum(cost) over (w rows between unbounded preceding and 1 preceding), 0) as before from f window w as (order by computed_at nulls first, flow_id)) "
    "select flow_id, strftime(computed_at, '%Y-%m-%d') as computed_at, cost, place::int as place from q where before < 300 or place = 1",
)
def recompute_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand in for flows, their orders for stale tiles; every ninth was never worked out."""
    orders = table(spark, sf_dir, "orders")
    stale = orders.select(F.col("o_custkey").cast("string").alias("flow_id"), F.when(F.col("o_custkey") % 9 > 0, F.col("o_orderdate").cast("timestamp")).alias("computed_at"))
    costs = orders.select(F.col("o_custkey").cast("string").alias("flow_id"), (F.col("o_custkey") % 4 + 1).cast("double").alias("seconds"))
    return G.recompute_batch(stale, costs, 300.0).withColumn("computed_at", F.date_format("computed_at", "yyyy-MM-dd"))


_LINKS = "select s_suppkey as rank, s_suppkey // 3 as parent from supplier union all select 0, 4 union all select s_suppkey, 1000000 + s_suppkey from supplier where s_suppkey % 10 = 0"


@register(
    "visible_metrics",
    f"with recursive links as ({_LINKS}), reach(rank, here) as (select s_suppkey, s_suppkey from supplier union select r.rank, l.parent from reach r join links l on l.rank = r.here join supplier p on p.s_suppkey = l.parent), "
    "whole as (select distinct rank from reach where here % 97 = 50) "
    "select r.rank::varchar as rank, 'nation ' || s.s_nationkey::varchar as metric from reach r join supplier s on s.s_suppkey = r.here where r.rank not in (select rank from whole) group by 1, 2 union all select rank::varchar, null from whole",
)
def visible_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand in for ranks: each may see its nation and inherits from the supplier of a third
    of its number; the first one inherits from a later one, so there are loops, and some parents are gone."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    text = lambda c: c.cast("string")
    key = F.col("s_suppkey")
    links = s.select(text(key).alias("rank"), text(F.floor(key / 3)).alias("parent")).unionByName(s.where("s_suppkey = 0").select(text(key).alias("rank"), F.lit("4").alias("parent"))).unionByName(s.where("s_suppkey % 10 = 0").select(text(key).alias("rank"), text(key + 1_000_000).alias("parent")))
    return G.visible_metrics(s.select(text(key).alias("rank"), (key % 97 == 50).alias("all_metrics")), links, s.select(text(key).alias("rank"), F.concat(F.lit("nation "), text(F.col("s_nationkey"))).alias("metric")))


_EXPECTED = {"region": (("r_regionkey", "int"), ("r_name", "string")), "nation": (("n_nationkey", "bigint"), ("n_name", "string"), ("n_motto", "string")), "continent": (("c_name", "string"),)}
_KINDS = "case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' else lower(data_type) end"


@register(
    "schema_difference",
    f"with live as (select table_name as t, column_name as c, {_KINDS} as k from information_schema.columns where table_name in ('region', 'nation', 'supplier')), "
    "expected(t, c, k) as (values " + ", ".join(f"('{t}', '{c}', '{k}')" for t, cs in _EXPECTED.items() for c, k in cs) + ") "
    "select distinct e.t as \"table\", null::varchar as \"column\", 'missing table' as problem, null::varchar as expected, null::varchar as live from expected e where e.t not in (select t from live) "
    "union all select distinct t, null, 'unexpected table', null, null from live where t not in (select t from expected) "
    "union all select t, c, 'missing column', k, null from expected e where t in (select t from live) and not exists (select 1 from live l where l.t = e.t and l.c = e.c) "
    "union all select t, c, 'unexpected column', null, k from live l where t in (select t from expected) and not exists (select 1 from expected e where l.t = e.t and l.c = e.c) "
    "union all select e.t, e.c, 'type', e.k, l.k from expected e join live l on l.t = e.t and l.c = e.c where e.k <> l.k",
)
def schema_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the driver's tables against what somebody expects of them."""
    expected = spark.createDataFrame([(t, c, k) for t, cs in _EXPECTED.items() for c, k in cs], "table string, column string, type string")
    return G.schema_difference(expected, G.columns_of(spark, {t: table(spark, sf_dir, t) for t in ("region", "nation", "supplier")}))


@register(
    "date_drift",
    "select 'created_at' as field, case o_orderkey % 5 when 1 then 'loose only' else 'strict only' end as kind, count(*)::bigint as n from orders where o_orderkey % 5 in (1, 2, 3) group by 1, 2",
)
def date_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in five spellings: as a year alone, which only a loose reading takes for a day; with
    a month's name and as an epoch, which only the strict one reads; as ISO days and as no date, which both judge alike."""
    at, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 5
    spelled = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "yyyy")).when(k == 2, F.date_format(at, "d MMM yyyy")).when(k == 3, F.unix_millis(at + F.expr("interval 10 years")).cast("string")).otherwise("soon")
    return G.drift_counts(table(spark, sf_dir, "orders").select(spelled.alias("created_at")), ["created_at"])
