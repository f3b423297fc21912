"""Registered queries of the control tables, the connectors, every window and the ingestion
half: the driver's tables stand in for connections, streams, jobs and payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import control
from millrace.operators.windows import window
from millrace.plans.catalog import EVENTS_NOW, ORACLE, QUERIES, register
from millrace.sources.connectors import normalize
from millrace.sources.records import adapted, table
from millrace.sources.registry import infer_fields
from millrace.streaming.ingest import prepared, retire_connection, retire_older, upsert
from millrace.streaming.raw import accepted

__all__ = ["ORACLE", "QUERIES"]

# name -> (table, columns as SQL that Spark and DuckDB read alike)
_CONTROL = {
    "connections": ("supplier", "cast(s_suppkey as varchar(20)) as id, concat('p', cast(s_nationkey % 4 as varchar(9))) as source, s_name as name, case when s_suppkey % 4 = 1 then 'disabled' else 'active' end as status, case when s_suppkey % 4 = 1 then timestamp '1997-01-01' end as disabled_at, case when s_suppkey % 7 = 0 then timestamp '2005-01-01' end as paused_until, s_suppkey % 9 as failures"),
    "streams": ("part", "cast(p_partkey as varchar(20)) as id, cast(p_partkey % 10 as varchar(20)) as connection_id, concat('h', cast(p_partkey as varchar(20))) as config_hash, case when p_size % 5 = 0 then 'disabled' else 'active' end as status, concat('{\"restarts\":', cast(p_size % 5 as varchar(9)), '}') as cursor, timestamp '1999-01-01' as created_at, case when p_size % 3 > 0 then case when p_size > 25 then timestamp '2000-05-31 18:00:00' else timestamp '2000-01-01' end end as last_polled_at"),
    "stored": ("lineitem", "concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(9))) as event_id, cast(l_partkey % 10 as varchar(20)) as connection_id, case when l_linenumber = 7 then null else concat('h', cast(l_partkey as varchar(20))) end as stream_hash, cast(l_shipdate as timestamp) as occurred_at, case when l_returnflag = 'R' then cast(l_shipdate as timestamp) end as deleted_at, l_linenumber as sync_generation"),
    "raw": ("orders", "cast(o_orderkey as varchar(20)) as id, cast(o_custkey % 10 as varchar(20)) as connection_id, concat('{\"k', cast(o_custkey % 3 as varchar(9)), '\":{\"at\":1}}') as payload, cast(o_orderdate as timestamp) as received_at"),
    "dead": ("orders", "cast(o_orderkey as varchar(20)) as id, cast(o_orderkey as varchar(20)) as raw_id, cast(o_custkey % 17 as varchar(20)) as connection_id, o_orderpriority as error, cast(o_orderdate as timestamp) as created_at, case when o_orderstatus = 'F' then cast(o_orderdate as timestamp) end as resolved_at"),
    "deliveries": ("orders", "cast(o_custkey % 10 as varchar(20)) as connection_id, case when o_orderstatus = 'O' then 'rejected' else 'accepted' end as status, o_orderpriority as error, cast(o_orderdate as timestamp) as created_at"),
    "calls": ("orders", "cast(o_custkey % 10 as varchar(20)) as connection_id, concat('p', cast(o_custkey % 4 as varchar(9))) as provider, o_orderpriority as operation, 1 as calls, case when o_orderstatus = 'P' then 1 else 0 end as throttled, case when o_custkey % 3 = 0 then o_custkey % 5 end as observed_limit, cast(o_orderdate as timestamp) as window_start"),
    "jobs": ("orders", "cast(o_orderkey as varchar(20)) as id, cast(o_custkey as varchar(20)) as stream_id, cast(o_custkey % 10 as varchar(20)) as connection_id, case o_orderstatus when 'F' then 'complete' when 'O' then 'queued' else 'running' end as status, cast(o_orderdate as timestamp) as target_floor, cast(o_orderdate as timestamp) as created_at, cast(null as timestamp) as started_at, case when o_custkey % 2 = 0 then cast(o_orderdate as timestamp) + interval '1' day end as progress_at, o_custkey as rows_imported"),
    "cursors": ("customer", "cast(c_custkey % 10 as varchar(20)) as connection_id, timestamp '2000-05-01' as mark"),
}
_NOW, _BEFORE = "2000-06-01", "1998-01-01"
MIRRORS = ("p0", "p2")


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp")




def _of(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, _CONTROL[n][0]).select(*[F.expr(x) for x in _parts(_CONTROL[n][1])]) for n in names]


def _parts(columns: str) -> list[str]:
    """The columns of a list; a comma in brackets or quotes does not part them."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(columns):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


def _with(*names: str) -> str:
    return "with " + ", ".join(f"{n} as (select {_CONTROL[n][1]} from {_CONTROL[n][0]})" for n in names) + " "


def _text(*names: str) -> list[Column]:
    """Moments as text."""
    return [F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n) for n in names]


def _sql_text(name: str, of: str | None = None) -> str:
    return f"strftime({of or name}, '%Y-%m-%d %H:%M:%S') as {name}"


@register("live_per_connection", _with("stored") + "select connection_id, count(*)::bigint as live from stored where deleted_at is null group by 1")
def live_per_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.live_per_connection(*_of(spark, sf_dir, "stored"))


@register("live_per_stream", _with("streams", "stored") + "select id, (select count(*) from stored e where e.connection_id = s.connection_id and e.stream_hash = s.config_hash and e.deleted_at is null)::bigint as live from streams s")
def live_per_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.live_per_stream(*_of(spark, sf_dir, "streams", "stored")).select("id", "live")


@register(
    "stream_inventory",
    _with("streams", "connections", "stored") + f"select c.source, c.name as connection, s.config_hash, s.status, count(e.event_id) filter (where e.deleted_at is null)::bigint as live_rows, count(e.event_id) filter (where e.deleted_at is not null)::bigint as retired_rows, {_sql_text('oldest_live', 'min(e.occurred_at) filter (where e.deleted_at is null)')}, {_sql_text('newest_live', 'max(e.occurred_at) filter (where e.deleted_at is null)')}, max(e.sync_generation)::int as latest_generation "
    "from streams s join connections c on c.id = s.connection_id left join stored e on e.connection_id = s.connection_id and e.stream_hash = s.config_hash group by 1, 2, 3, 4",
)
def stream_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = control.stream_inventory(*_of(spark, sf_dir, "streams", "connections", "stored"))
    return found.select("source", "connection", "config_hash", "status", "live_rows", "retired_rows", *_text("oldest_live", "newest_live"), "latest_generation")


@register("untagged_live", _with("stored", "connections") + "select c.source, c.name as connection, count(*)::bigint as rows from stored e join connections c on c.id = e.connection_id where e.stream_hash is null and e.deleted_at is null group by 1, 2")
def untagged_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.untagged_live(*_of(spark, sf_dir, "stored", "connections"))


@register("dead_letters_by_connection", _with("dead", "connections") + "select d.connection_id, coalesce(c.name, 'Unknown connection') as name, count(*)::bigint as count from dead d left join connections c on c.id = d.connection_id where d.resolved_at is null group by 1, 2")
def dead_letters_by_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.unresolved_letters(*_of(spark, sf_dir, "dead", "connections"))


@register("rejecting_connections", _with("deliveries") + f"select connection_id, count(*)::bigint as minutes, {_sql_text('last_at', 'max(created_at)')}, min(error) as last_error from deliveries where status = 'rejected' and created_at >= timestamp '{_BEFORE}' group by 1")
def rejecting_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.rejecting(*_of(spark, sf_dir, "deliveries"), _at(_BEFORE)).select("connection_id", "minutes", *_text("last_at"), "last_error")


@register("throttled_connections", _with("calls") + f"select connection_id, provider, sum(throttled)::bigint as throttled, sum(calls)::bigint as calls from calls where window_start >= timestamp '{_BEFORE}' group by 1, 2 having sum(throttled) >= 20")
def throttled_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.throttled(*_of(spark, sf_dir, "calls"), _at(_BEFORE))


@register(
    "observed_limits",
    _with("calls") + f", n as (select provider, operation, observed_limit, count(*) as n from calls where observed_limit is not null group by 1, 2, 3), m as (select provider, operation, arg_min(observed_limit, (-n, observed_limit)) as most_common from n group by 1, 2) select c.provider, c.operation, min(observed_limit)::bigint as lowest_seen, max(observed_limit)::bigint as highest_seen, any_value(m.most_common)::bigint as most_common, count(*)::bigint as samples, count(distinct connection_id)::bigint as connections, {_sql_text('first_seen', 'min(window_start)')} from calls c join m using (provider, operation) where observed_limit is not null group by 1, 2",
)
def observed_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = control.observed_limits(*_of(spark, sf_dir, "calls"))
    return found.select("provider", "operation", "lowest_seen", "highest_seen", "most_common", "samples", "connections", *_text("first_seen"))


@register("percentiles_by_group", "select o_orderpriority, percentile_cont(0.5) within group (order by o_custkey)::double as p50, percentile_cont(0.9) within group (order by o_custkey)::double as p90 from orders group by 1")
def percentiles_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.percentiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_custkey", {"p50": 0.5, "p90": 0.9})


@register("key_census", "select 'k'||(o_custkey%3)::varchar as key, count(*)::bigint as occurrences from orders group by 1")
def key_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = _of(spark, sf_dir, "raw")
    return control.key_census(raw.select(F.col("payload").alias("properties"), F.lit(None).cast("timestamp").alias("deleted_at")), "$")


_OLDEST = "min(received_at) filter (where json_exists(payload, '$.k1.at'))"


@register("key_coverage", _with("raw") + f"select connection_id, count(*)::bigint as total, count(*) filter (where json_exists(payload, '$.k1.at'))::bigint as with_key, {_sql_text('oldest_with_key', _OLDEST)} from raw group by 1")
def key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.key_coverage(*_of(spark, sf_dir, "raw"), "k1.at").select("connection_id", "total", "with_key", *_text("oldest_with_key"))


_FIRST = "with s as (select user_id, ts from events where event_type = 'signup'), p as (select user_id, ts from events where event_type = 'purchase') select s.user_id::varchar as key, count(*)::bigint as asked, count((select min(p.ts) from p where p.user_id = s.user_id and p.ts >= s.ts and p.ts <= s.ts + interval '2' day))::bigint as answered from s group by 1"


@register("first_after", _FIRST)
def first_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups and how many of them are followed by a purchase within two days."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), "event_type")
    found = control.first_after(events.where("event_type = 'signup'"), events.where("event_type = 'purchase'"), "2 days")
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("asked"), F.count("first").alias("answered"))


_WAIT = "coalesce(progress_at, started_at, created_at)"


@register("runnable_jobs", _with("jobs", "connections") + f"select provider, job_id from (select c.source as provider, j.id as job_id, row_number() over (partition by c.source order by {_WAIT} nulls first, j.created_at, j.id) as n from jobs j join connections c on c.id = j.connection_id where j.status in ('queued', 'running') and c.status <> 'disabled' and (c.paused_until is null or c.paused_until < timestamp '{_NOW}')) where n = 1")
def runnable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.runnable_jobs(*_of(spark, sf_dir, "jobs", "connections"), _at(_NOW))


@register("covering_job", _with("jobs") + ", w as (select c_custkey::varchar as stream_id, timestamp '1998-06-01' as target_floor from customer) select stream_id, (select j.id from jobs j where j.stream_id = w.stream_id and j.target_floor <= w.target_floor order by j.target_floor, j.id limit 1) as job_id from w")
def covering_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("stream_id"), F.lit("1998-06-01").cast("timestamp").alias("target_floor"))
    return control.covering_job(*_of(spark, sf_dir, "jobs"), wanted).select("stream_id", "job_id")


@register("stream_hash", "select p_partkey::bigint as id, substr(sha256('{\"brand\":\"'||p_brand||'\",\"size\":\"'||p_size||'\"}'), 1, 16) as hash from part")
def stream_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings in another order, with a blank one and one that only narrows the read."""
    config = F.create_map(F.lit("size"), F.concat(F.lit(" "), F.col("p_size").cast("string")), F.lit("blank"), F.lit(" "), F.lit("calendar"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), control.stream_hash(config, ("calendar",)).alias("hash"))


@register("orphan_streams", _with("streams") + ", r as (select distinct concat('h', l_partkey::varchar) as config_hash from lineitem where l_linenumber = 1) select id from streams s where status <> 'disabled' and not exists (select 1 from r where r.config_hash = s.config_hash)")
def orphan_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams, stored = _of(spark, sf_dir, "streams", "stored")
    return control.orphans(streams, stored.where("sync_generation = 1").select("connection_id", F.col("stream_hash").alias("config_hash"))).select("id")


@register("retire_orphan_streams", _with("streams", "stored") + "select connection_id, count(*) filter (where deleted_at is null and not exists (select 1 from streams s where s.status = 'disabled' and s.connection_id = e.connection_id and s.config_hash = e.stream_hash))::bigint as live from stored e group by 1")
def retire_orphan_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams, stored = _of(spark, sf_dir, "streams", "stored")
    return control.retire_orphans(stored, streams.where("status = 'disabled'"), _at(_NOW)).groupBy("connection_id").agg(F.count_if(F.col("deleted_at").isNull()).alias("live"))


@register("retire_ghosts", _with("streams", "stored") + "select connection_id, count(*) filter (where deleted_at is null and stream_hash is not null)::bigint as live from stored group by 1")
def retire_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams, stored = _of(spark, sf_dir, "streams", "stored")
    return control.retire_ghosts(stored, streams, _at(_NOW)).groupBy("connection_id").agg(F.count_if(F.col("deleted_at").isNull()).alias("live"))


_FLOWS = "f as (select n_nationkey::varchar as id, n_name as name, case when n_nationkey % 3 > 0 then n_nationkey % 3 end as published from nation), v as (select n_nationkey::varchar as flow_id, x.version, n_name||x.version as graph from nation, (values (1), (2)) x(version)) "


def _flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, sf_dir, "nation")
    flows = nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey") % 3).alias("published"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("draft"))
    versions = nation.select(F.col("n_nationkey").cast("string").alias("flow_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), "n_name")
    return flows, versions.select("flow_id", "version", F.concat("n_name", F.col("version").cast("string")).alias("graph"))


@register("referenced_graphs", f"with {_FLOWS} select id as flow_id, name as graph from f where id::int % 2 = 0 union all select v.flow_id, v.graph from v join f on f.id = v.flow_id and f.published = v.version")
def referenced_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.referenced_graphs(*_flows(spark, sf_dir))


@register("shown_results", f"with {_FLOWS} select c_custkey::bigint as node, c_nationkey::varchar as flow_id, f.name as flow from customer join f on f.id = c_nationkey::varchar where f.published is not null")
def shown_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("string").alias("flow_id"))
    return control.shown_results(results, _flows(spark, sf_dir)[0]).select("node", "flow_id", "flow")


@register("prunable_raw", _with("raw", "connections", "dead") + f"select id from raw r where received_at < timestamp '{_BEFORE}' and exists (select 1 from connections c where c.id = r.connection_id and c.disabled_at < timestamp '{_BEFORE}') and not exists (select 1 from dead d where d.raw_id = r.id and d.resolved_at is null)")
def prunable_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.prunable_raw(*_of(spark, sf_dir, "raw", "connections", "dead"), _at(_BEFORE)).select("id")


@register("prunable_tombstones", _with("stored", "connections") + f"select connection_id, count(*)::bigint as rows from stored e where deleted_at < timestamp '{_BEFORE}' and exists (select 1 from connections c where c.id = e.connection_id and c.status <> 'disabled') group by 1")
def prunable_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.prunable_tombstones(*_of(spark, sf_dir, "stored", "connections"), _at(_BEFORE)).groupBy("connection_id").agg(F.count(F.lit(1)).alias("rows"))


_T = f"timestamp '{_NOW}'"
_HEALTH = (
    _with("connections", "streams", "jobs", "stored", "dead", "deliveries", "calls", "cursors")
    + ", a as (select id as connection_id, source, paused_until from connections where status = 'active' and disabled_at is null), m as (select s.*, a.source, a.paused_until from streams s join a using (connection_id)) "
    f"select 'unswept stream' as \"check\", id as subject, 1::bigint as number from m where status <> 'disabled' and (paused_until is null or paused_until < {_T}) and coalesce(last_polled_at, created_at) < {_T} - interval '24' hour "
    "union all select 'failing connection', id, failures::bigint from connections where failures >= 5 and disabled_at is null "
    f"union all select 'stalled import', id, rows_imported::bigint from jobs where status in ('queued', 'running') and {_WAIT} < {_T} - interval '6' hour "
    f"union all select 'empty mirror', id, 0::bigint from m where status = 'active' and last_polled_at < {_T} - interval '1' hour and source in ('p0', 'p2') and not exists (select 1 from stored e where e.connection_id = m.connection_id and e.stream_hash = m.config_hash and e.deleted_at is null) "
    f"union all select 'unresolved dead letters', connection_id, count(*)::bigint from dead where resolved_at is null and created_at < {_T} - interval '24' hour group by 2 "
    f"union all select 'throttled connection', connection_id, sum(throttled)::bigint from calls where window_start >= {_T} - interval '24' hour group by connection_id, provider having sum(throttled) >= 20 "
    "union all select 'restarting scan', id, (cursor->>'$.restarts')::bigint from m where (cursor->>'$.restarts')::bigint >= 3 "
    f"union all select 'rejecting connection', connection_id, count(*)::bigint from deliveries where status = 'rejected' and created_at >= {_T} - interval '24' hour group by 2 "
    f"union all select 'lagging cursor', c.connection_id, 31::bigint from cursors c join a using (connection_id)"
)


@register("invariants", _HEALTH)
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.invariants(_at(_NOW), *_of(spark, sf_dir, "connections", "streams", "jobs", "stored", "dead", "deliveries", "calls", "cursors"), MIRRORS)


# ---- windows -------------------------------------------------------------------------

# preset -> first moment and the moment that it ends before, by the clock of the events
_EDGES = {
    "today": ("2024-01-30 00:00:00", "2024-01-30 12:00:00.001"), "yesterday": ("2024-01-29 00:00:00", "2024-01-30 00:00:00"), "this_week": ("2024-01-29 00:00:00", "2024-01-30 12:00:00.001"),
    "last_week": ("2024-01-22 00:00:00", "2024-01-29 00:00:00"), "this_month": ("2024-01-01 00:00:00", "2024-01-30 12:00:00.001"), "last_month": ("2023-12-01 00:00:00", "2024-01-01 00:00:00"),
    "last_7_days": ("2024-01-23 12:00:00", "2024-01-30 12:00:00.001"), "last_30_days": ("2023-12-31 12:00:00", "2024-01-30 12:00:00.001"), "last_90_days": ("2023-11-01 12:00:00", "2024-01-30 12:00:00.001"),
    "last_365_days": ("2023-01-30 12:00:00", "2024-01-30 12:00:00.001"), "all_time": ("1970-01-01 00:00:00", "2024-01-30 12:00:00.001"),
}


@register("window_presets", " union all ".join(f"select '{k}' as preset, count(*)::bigint as n from events where ts >= timestamp '{a}' and ts < timestamp '{b}'" for k, (a, b) in _EDGES.items()))
def window_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in each preset, in one pass."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    inside = [F.count_if(at.between(*map(int, window({"preset": k}, EVENTS_NOW)))).alias(k) for k in _EDGES]
    counts = table(spark, sf_dir, "events").agg(*inside)
    return counts.select(F.explode(F.create_map(*[x for k in _EDGES for x in (F.lit(k), F.col(k))])).alias("preset", "n"))


# ---- connectors ----------------------------------------------------------------------

_AT = "o_orderdate + to_seconds(o_custkey % 86400)"


def _payloads(spark: SparkSession, sf_dir: str, payload: Column) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("at", F.date_format(F.timestamp_millis(F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") % 86_400 * 1000), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return orders.select(F.col("o_orderkey").cast("string").alias("raw_id"), F.lit("c1").alias("connection_id"), F.to_json(payload).alias("payload"), F.timestamp_millis(F.lit(0)).alias("received_at"))


def _connector(name: str, source: str, payload: Callable[[], Column], event_id: str, kind: str, subject: str, value: str = "null", currency: str = "null", at: str = _AT, **options) -> None:
    sql = f"select {event_id} as event_id, {kind} as event_type, {subject} as subject, strftime({at}, '%Y-%m-%d %H:%M:%S') as occurred_at, {value}::double as value, {currency}::varchar as currency from orders"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return normalize(_payloads(spark, sf_dir, payload()), source, **options)[0].select("event_id", "event_type", "subject", *_text("occurred_at"), "value", "currency")

    register(name, sql)(query)


def _s(**fields: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def _id() -> Column:
    return F.col("o_orderkey").cast("string")


def _mail() -> Column:
    return F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@x.org"))


_SQL_MAIL = "'u'||o_custkey::varchar||'@x.org'"
_connector("connector_close", "close", lambda: _s(id=_id(), object_type=F.lit("lead"), action=F.when(F.col("o_orderstatus") == "F", "created").otherwise("merged"), date_created=F.col("at"), data=_s(contact_name=_mail())), "'close:c1:'||o_orderkey::varchar", "case when o_orderstatus='F' then 'lead_created' else 'lead.merged' end", _SQL_MAIL)
_connector("connector_calendly", "calendly", lambda: _s(event=F.when(F.col("o_orderstatus") == "F", "invitee.canceled").otherwise("invitee.created"), created_at=F.lit("2020-01-01T00:00:00Z"), payload=_s(email=_mail(), scheduled_event=_s(uri=_id(), start_time=F.col("at")))), "'calendly:c1:'||o_orderkey::varchar", "case when o_orderstatus='F' then 'canceled' else 'booked' end", _SQL_MAIL)
_connector("connector_calendly_meeting", "calendly_meeting", lambda: _s(uri=_id(), name=F.col("o_orderpriority"), status=F.when(F.col("o_orderstatus") == "F", "canceled").otherwise("active"), start_time=F.col("at"), created_at=F.lit("2020-01-01T00:00:00Z"), updated_at=F.lit("2020-01-02T00:00:00Z")), "'calendly:c1:'||case when o_orderstatus='F' then 'canceled:' else '' end||o_orderkey::varchar", "case when o_orderstatus='F' then 'canceled' else 'booked' end", "o_orderpriority")
_connector("connector_instantly", "instantly", lambda: _s(event_type=F.when(F.col("o_orderstatus") == "F", "reply_received").otherwise("email_sent"), email_id=_id(), lead_email=_mail(), timestamp=F.col("at")), "'instantly:c1:'||case when o_orderstatus='F' then 'reply_received' else 'email_sent' end||':'||o_orderkey::varchar", "case when o_orderstatus='F' then 'reply' else 'email_sent' end", _SQL_MAIL)
_connector("connector_instantly_day", "instantly_day", lambda: _s(campaign_id=_id(), date=F.substring("at", 1, 10), sent=F.col("o_custkey")), "'instantly:c1:'||o_orderkey::varchar||':daily:'||strftime(o_orderdate,'%Y-%m-%d')", "'campaign_day'", "o_orderkey::varchar||' '||strftime(o_orderdate,'%Y-%m-%d')", at="o_orderdate")
_connector("connector_instantly_totals", "instantly_totals", lambda: _s(campaign_id=_id(), created_at=F.col("at"), sent=F.col("o_custkey")), "'instantly:c1:'||o_orderkey::varchar||':totals'", "'campaign_totals'", "o_orderkey::varchar")
_connector("connector_instantly_mail", "instantly_mail", lambda: _s(id=_id(), ue_type=F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(3), from_address_email=F.lit("me@x.org"), to_address_email_list=F.concat(_mail(), F.lit(" , other@x.org")), timestamp_created=F.col("at")), "'instantly:c1:email:'||o_orderkey::varchar", "case o_orderstatus when 'F' then 'reply' when 'O' then 'email_sent' else 'email' end", f"case when o_orderstatus = 'F' then 'me@x.org' else {_SQL_MAIL} end")
_connector("connector_sheet_order", "gsheets", lambda: _s(row=F.col("o_orderkey"), cells=_s(z_owner=F.concat(F.lit("owner"), _id(), F.lit("@x.org")), mail=_mail(), when=F.date_format("o_orderdate", "d MMM yyyy"))), "'gsheets:c1:row:'||o_orderkey::varchar", "'row_added'", "'owner'||o_orderkey::varchar||'@x.org'", at="o_orderdate", date_column="when")
_connector("connector_whop", "whop", lambda: _s(id=_id(), total=F.col("o_custkey"), currency=F.lit("usd"), paid_at=F.col("at"), user=_s(email=_mail())), "'whop:c1:'||o_orderkey::varchar", "'payment'", _SQL_MAIL, "o_custkey", "'USD'")
_connector("connector_sheet", "gsheets", lambda: _s(row=F.col("o_orderkey"), cells=_s(mail=_mail(), when=F.date_format("o_orderdate", "d MMM yyyy"))), "'gsheets:c1:row:'||o_orderkey::varchar", "'row_added'", _SQL_MAIL, at="o_orderdate", date_column="when")
_connector("connector_calendar", "google_calendar", lambda: _s(id=_id(), start=_s(dateTime=F.col("at")), organizer=_s(email=_mail()), attendees=F.array(_s(email=_mail(), responseStatus=F.lit("accepted")))), "'gcal:c1:'||o_orderkey::varchar", "'calendar_event'", _SQL_MAIL)


# ---- ingestion -----------------------------------------------------------------------


@register("intake", "select 'kept' as outcome, count(distinct o_custkey)::bigint as n from orders where o_orderstatus <> 'P' union all select 'refused', count(*)::bigint from orders where o_orderstatus = 'P'")
def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of one id are kept once; payloads that are too large are refused."""
    payload = F.when(F.col("o_orderstatus") == "P", F.repeat(F.lit("x"), 40)).otherwise(F.lit("{}"))
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("raw_id"), F.lit("c1").alias("connection_id"), payload.alias("payload"), F.col("o_orderdate").cast("timestamp").alias("received_at"), F.col("o_custkey").cast("string").alias("delivery"))
    kept, refused = accepted(raw, 20)
    return kept.select(F.lit("kept").alias("outcome")).unionByName(refused.select(F.lit("refused").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _events_at(spark: SparkSession, sf_dir: str, generation: int) -> DataFrame:
    payload = _s(id=F.col("event_id"), type=F.col("event_type"), user=F.col("user_id").cast("string"))
    raw = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("raw_id"), F.lit("c1").alias("connection_id"), F.to_json(payload).alias("payload"), F.timestamp_millis(F.lit(0)).alias("received_at"))
    return prepared(normalize(raw, "webhook")[0], "org", generation)


@register("full_resync", "select event_type, count(*) filter (where event_id % 3 > 0)::bigint as live, count(*) filter (where event_id % 3 = 0)::bigint as retired from events group by 1")
def full_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complete second read no longer has every third event: those become tombstones."""
    first = _events_at(spark, sf_dir, 1)
    again = upsert(first, _events_at(spark, sf_dir, 2).where("cast(raw_event_id as bigint) % 3 > 0")).drop("action")
    after = retire_older(again, "c1", 2, _at(_NOW))
    return after.groupBy("event_type").agg(F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count_if(F.col("deleted_at").isNotNull()).alias("retired"))


@register("reprocess_raw", "select 'deduped' as action, count(*)::bigint as n from events")
def reprocess_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that are made into events again change nothing."""
    return upsert(_events_at(spark, sf_dir, 1), _events_at(spark, sf_dir, 1)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@register("retired_connection", "select event_type, 0::bigint as live from events group by 1")
def retired_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retire_connection(_events_at(spark, sf_dir, 1), "c1", _at(_NOW)).groupBy("event_type").agg(F.count_if(F.col("deleted_at").isNull()).alias("live"))


@register("dead_letters", "select o_orderkey::varchar as raw_id, 'the payload is no JSON object or array' as error from orders where o_orderstatus = 'P'")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.when(F.col("o_orderstatus") == "P", F.lit("{broken")).otherwise(F.to_json(_s(id=_id())))
    raw = table(spark, sf_dir, "orders").select(_id().alias("raw_id"), F.lit("c1").alias("connection_id"), payload.alias("payload"), F.timestamp_millis(F.lit(0)).alias("received_at"))
    return normalize(raw, "webhook")[1].select("raw_id", "error")


@register("inferred_field", "select 'properties.k' as path, 'number' as type")
def inferred_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infer_fields(adapted(spark, sf_dir, "events").scan().df)
    return found.where(F.col("path").isin("k", "properties.k")).select(F.lit("properties.k").alias("path"), "type")


