"""Registered queries of what steps do at their edges: guards, errors, receipts, stamps,
previews, older graphs, stored tiles, and the smaller ingestion operations."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.dates import detect_date_key
from millrace.operators.windows import ms
from millrace.plans.catalog import EVENTS_NOW, GET, ORACLE, QUERIES, chain, flow, graph, register
from millrace.plans.engine import Err, run_flow
from millrace.plans.graph import parse_graph
from millrace.plans.tiles import build_tile, sample
from millrace.sources.connectors import content_id
from millrace.sources.records import EventStore, adapted, field_of, table
from millrace.sources.registry import fields_seen, merge_registry
from millrace.streaming.ingest import expired_tombstones, prepared, restore_connection, retire_absent
from millrace.streaming.materialize import expired, materialize, merge_results

__all__ = ["ORACLE", "QUERIES"]


def _rule(field: str, op: str, value: str = "", **more: str) -> dict:
    return {"field": field, "op": op, "value": value, **more}


def _filter(*rules: dict) -> tuple[str, str, dict]:
    return ("keep", "filter", {"rules": list(rules)})


_EVENTS = ("events",)
_SIGNUP, _PURCHASE = ({"source": "events", "eventType": t} for t in ("signup", "purchase"))

# ---- guards and errors ---------------------------------------------------------------

_EITHER = lambda *rules: ("keep", "filter", {"combinator": "or", "rules": list(rules)})
flow("unknown_operator", _EVENTS, chain(GET, _EITHER(_rule("eventType", "resembles", "signup"), _rule("eventType", "equals", "view"))), "keep", ("id",), "select event_id::varchar as id from events where event_type = 'view'")
flow("empty_input_is_zero", _EVENTS, chain(GET, _filter(_rule("eventType", "equals", "none")), ("x", "formula", {"op": "sum"})), "x", ("value", "error"), "select 0::double as value, null::varchar as error")
flow("empty_field_error", _EVENTS, chain(GET, ("x", "formula", {"op": "sum", "field": "properties.absent"})), "x", ("value", "error"), "select 0::double as value, 'No record has a number in absent for this sum.' as error")
flow("blank_never_equals_blank", ("events", "orders"), chain(("get", "app", {}), _filter(_rule("properties.k", "equals", valueKind="field", valueField="properties.k"))), "keep", ("id",), "select event_id::varchar as id from events where (props->>'$.k') is not null")
flow("earlier_kept_of_ties", _EVENTS, chain(("get", "app", {"source": "events", "dedupe": True, "dedupeField": "eventType", "dedupeOrderField": "connectionId"})), "get", ("id", "eventType"), "select arg_max(event_id::varchar, (epoch_us(ts)//1000, event_id::varchar)) as id, event_type as \"eventType\" from events group by event_type")


@register("error_below_a_broken_step", "select step, state, case when state = 'ok' then (select count(*) from events) end::double as value from (values ('x', 'error'), ('below', 'error'), ('n', 'ok')) t(step, state)")
def error_below_a_broken_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula of groups cannot be worked out, nor what stands below it; other steps can."""
    steps = [GET, ("g", "group", {}), ("x", "formula", {"op": "add", "bFixed": 1}), ("below", "output", {}), ("n", "formula", {"op": "count"})]
    run = run_flow(adapted(spark, sf_dir, "events"), graph(steps, [("get", "g"), ("g", "x", "a"), ("x", "below"), ("get", "n")]), EVENTS_NOW)
    broken = spark.createDataFrame([(k, "error", None) for k, found in run.results.items() if isinstance(found, Err)], "step string, state string, value double")
    return broken.unionByName(run.df("n").select(F.lit("n").alias("step"), F.lit("ok").alias("state"), "value"))


# ---- receipts, stamps, previews -------------------------------------------------------

_MATCHED = graph([("a", "app", _SIGNUP), ("b", "app", _PURCHASE), ("m", "unite", {"mode": "match", "keepNodeId": "a", "keyField": "subject", "lookupField": "subject"})], [("a", "m"), ("b", "m")])


@register("match_receipt", "with a as (select user_id from events where event_type='signup'), b as (select user_id from events where event_type='purchase') select count(*)::bigint as checked, count(*) filter (where user_id in (select user_id from b))::bigint as kept, count(*) filter (where user_id not in (select user_id from b))::bigint as dropped, 0::bigint as blanks, 0::bigint as phones, (select count(distinct user_id) from b)::bigint as \"listSize\", 0::bigint as \"listBlanks\" from a")
def match_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_flow(adapted(spark, sf_dir, "events"), _MATCHED, EVENTS_NOW).ok("m").report


@register("match_phone_key", "select a.c_custkey::varchar as id from customer a where exists (select 1 from customer b where b.c_custkey % 3 = 0 and b.c_custkey = a.c_custkey)")
def match_phone_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of every customer, with a country and punctuation, against plain ones of every third."""
    number = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    spelled, plain = F.concat(F.lit("+1 (208) "), F.substring(number, 1, 3), F.lit("-"), F.substring(number, 4, 4)), F.concat(F.lit("208"), number)

    def rows(kind: str, phone: Column) -> DataFrame:
        return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("t").alias("source"), F.lit(kind).alias("eventType"), F.lit(None).cast("string").alias("subject"), F.timestamp_millis(F.lit(0)).alias("occurredAt"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("currency"), F.lit("c").alias("connectionId"), F.to_json(F.struct(phone.alias("phone"))).alias("properties"), "c_custkey")

    store = EventStore(rows("a", spelled).unionByName(rows("b", plain).where("c_custkey % 3 = 0")).drop("c_custkey"))
    steps = [("a", "app", {"eventType": "a"}), ("b", "app", {"eventType": "b"}), ("m", "unite", {"mode": "match", "keepNodeId": "a", "keyField": "properties.phone", "lookupField": "properties.phone"})]
    return run_flow(store, graph(steps, [("a", "m"), ("b", "m")]), EVENTS_NOW).df("m").select("id")


_PASSED = [GET, ("f", "filter", {"rules": [_rule("eventType", "equals", "signup")]}), ("s", "unite", {}), ("in", "filter", {"rules": [_rule("__passed_f", "equals", "true")]})]


@register("step_stamps", "select event_id::varchar as id from events where event_type='signup'")
def step_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all events and the signups among them, stacked, those that came through the filter."""
    return run_flow(adapted(spark, sf_dir, "events"), graph(_PASSED, [("get", "s"), ("get", "f"), ("f", "s"), ("s", "in")]), EVENTS_NOW).df("in").select("id")


@register("latest_preview", "select event_id::varchar as id from events where epoch_us(ts)//1000 <= 1706616000000 order by epoch_us(ts)//1000 desc, event_id::varchar desc limit 3")
def latest_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(run_flow(adapted(spark, sf_dir, "events"), chain(GET), EVENTS_NOW), "get", ms(EVENTS_NOW)).select("id")


@register("time_reference_series", "select strftime(o_orderdate,'%Y-%m') as bucket, count(*)::double as value from orders group by 1")
def time_reference_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile of records over a date field, its array as rows."""
    run = run_flow(adapted(spark, sf_dir, "orders"), chain(("get", "app", {"source": "orders"}), ("out", "output", {})), EVENTS_NOW)
    tile = build_tile(run, "out", {"timeField": "properties.o_orderdate", "viz": "line", "timeUnit": "month"})
    return tile.select(F.explode("series").alias("p")).select("p.bucket", "p.value")


@register("groups_in_order", "select row_number() over (order by count(*) desc, event_type)::bigint - 1 as place, event_type as label, count(*)::double as value from events group by event_type")
def groups_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile's groups, the largest first and equal ones by label, with their places."""
    run = run_flow(adapted(spark, sf_dir, "events"), chain(GET, ("x", "formula", {"op": "count", "groupBy": {"type": "field", "field": "eventType"}}), ("out", "output", {})), EVENTS_NOW)
    return build_tile(run, "out").select(F.posexplode("groups").alias("place", "g")).select(F.col("place").cast("long").alias("place"), "g.label", "g.value")


# ---- older graphs ---------------------------------------------------------------------

_OLD = chain(GET, ("c", "combine", {}), ("x", "aggregate", {"aggregation": "sum", "field": "value"}))
flow("older_aggregate", _EVENTS, _OLD, "x", ("value",), "select floor(sum(value)*1e6+0.5)/1e6 as value from events")
_OPEN, _FILLED = ({"source": "orders", "eventType": t} for t in "PF")
_CROSS = graph([("a", "app", _OPEN), ("b", "app", _FILLED), ("m", "cross_reference", {"keepNodeId": "a", "keyField": "subject", "lookupField": "subject", "mode": "missing"})], [("a", "m"), ("b", "m")])
flow("older_cross_reference", ("orders",), _CROSS, "m", ("id",), "select o_orderkey::varchar as id from orders where o_orderstatus='P' and o_custkey not in (select o_custkey from orders where o_orderstatus='F')")


@register("steps_in_any_order", "select count(*)::double as value from events where event_type='signup'")
def steps_in_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = chain(GET, _filter(_rule("eventType", "equals", "signup")), ("n", "formula", {"op": "count"}))
    return run_flow(adapted(spark, sf_dir, "events"), {"nodes": g["nodes"][::-1], "edges": g["edges"][::-1]}, EVENTS_NOW, until="n").df("n").select("value")


# ---- sources and fields ---------------------------------------------------------------


@register("read_settings", "select event_id::varchar as id from events where event_type='signup' and (props->>'$.k') = '7'")
def read_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's own setting narrows what is read of the types that it is for."""
    store = adapted(spark, sf_dir, "events")
    store = EventStore(store.df, None, store.physical, {"events": {"k": (("properties.other", "properties.k"), ("signup",))}})
    return store.scan(source="events", event_type="signup", settings={"k": "7"}).df.select("id")


@register("merged_registry", "select 'k' as path, 'number' as type, count(*)::bigint as seen from events")
def merged_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of signups, then of all other events."""
    seen = lambda kind: fields_seen(adapted(spark, sf_dir, "events").df.where(kind))
    return merge_registry(seen("eventType = 'signup'"), seen("eventType != 'signup'")).select("path", "type", "seen")


@register("detect_date_key", "select 'data.created_at' as key, 'creation' as tier")
def detect_date_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    cells = F.explode(F.create_map(F.lit("data.created_at"), day, F.lit("updated_at"), day, F.lit("note"), day, F.lit("closed"), F.col("o_orderpriority"))).alias("name", "value")
    return detect_date_key(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), cells)).select("key", "tier")


@register("content_ids", "select c_custkey::bigint as id, 'w:'||substr(sha256('{\"a\":\"'||c_name||'\",\"b\":'||c_custkey||'}'), 1, 32) as content_id from customer")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads without an id, whose keys stand in any order."""
    a, b = F.col("c_name").alias("a"), F.col("c_custkey").alias("b")
    text = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(a, b))).otherwise(F.to_json(F.struct(b, a)))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), content_id(F.lit("w"), F.parse_json(text)).alias("content_id"))


# ---- ingestion and stored tiles --------------------------------------------------------


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("raw_event_id"), F.lit("c1").alias("connection_id"), F.timestamp_millis(F.lit(0)).alias("received_at"), F.lit("events").alias("source"), F.col("event_id").cast("string").alias("event_id"),
        "event_type", F.col("user_id").cast("string").alias("subject"), F.col("ts").cast("timestamp").alias("occurred_at"), "value", F.lit(None).cast("string").alias("currency"), F.col("props").alias("properties"),
    )
    return prepared(rows, "org", 1, "s1")


def _moment(text: str) -> Column:
    return F.lit(text).cast("timestamp")


@register("batch_keeps_the_last", "select event_type as event_id, max(event_id)::varchar as raw from (select event_type, event_id from events) group by 1")
def batch_keeps_the_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a batch's rows with one id the one received last stays."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("raw_event_id"), F.lit("c1").alias("connection_id"), F.timestamp_millis("event_id").alias("received_at"), F.lit("events").alias("source"), F.col("event_type").alias("event_id"),
        "event_type", F.col("user_id").cast("string").alias("subject"), F.col("ts").cast("timestamp").alias("occurred_at"), "value", F.lit(None).cast("string").alias("currency"), F.col("props").alias("properties"),
    )
    return prepared(rows, "org").select("event_id", F.col("raw_event_id").alias("raw"))


@register("windowed_mirror", "select event_type, count(*) filter (where not (event_type='error' and ts between timestamp '2024-01-05' and timestamp '2024-01-20'))::bigint as live from events group by 1")
def windowed_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are gone from a source of which only some weeks were read: only those weeks' go."""
    stored = _stored(spark, sf_dir)
    seen = stored.where("event_type != 'error'").select("event_id")
    after = retire_absent(stored, seen, "c1", "s1", _moment("2024-02-01"), (_moment("2024-01-05"), _moment("2024-01-20")))
    return after.groupBy("event_type").agg(F.count_if(F.col("deleted_at").isNull()).alias("live"))


@register("restored_connection", "select event_type, case when event_type='error' then 0 else count(*) end::bigint as live from events group by 1")
def restored_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All are tombstones, the errors' from before: those stay."""
    gone = _stored(spark, sf_dir).withColumn("deleted_at", F.when(F.col("event_type") == "error", _moment("2024-01-01")).otherwise(_moment("2024-02-01")))
    return restore_connection(gone, "c1", _moment("2024-02-01")).groupBy("event_type").agg(F.count_if(F.col("deleted_at").isNull()).alias("live"))


@register("expired_tombstones", "select event_type, count(*)::bigint as rows from events where event_type <> 'error' or ts >= timestamp '2024-01-15' group by 1")
def expired_tombstones_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _stored(spark, sf_dir).withColumn("deleted_at", F.when(F.col("event_type") == "error", F.col("occurred_at")))
    return expired_tombstones(gone, _moment("2024-01-15")).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


def _tiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object]:
    g = parse_graph(graph([GET, ("n", "formula", {"op": "count"}), ("all", "output", {"name": "All"}), ("s", "formula", {"op": "sum"}), ("total", "output", {"name": "Total"})], [("get", "n"), ("n", "all"), ("get", "s"), ("s", "total")]))
    return materialize(adapted(spark, sf_dir, "events"), "flow", g, EVENTS_NOW), g


@register("stored_tiles", "select 'all' as node_id, 'All' as name, count(*)::double as value from events union all select 'total', 'Total', floor(sum(value)*1e6+0.5)/1e6 from events")
def stored_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir)[0].select("node_id", "name", "value")


@register("merged_tiles", "select 'flow' as flow_id, 'all' as node_id, count(*)::double as value from events union all select 'flow', 'total', floor(sum(value)*1e6+0.5)/1e6 from events union all select 'other', 'all', -1")
def merged_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow's fresh tiles take their place, its gone ones go, another flow's stay."""
    fresh, g = _tiles(spark, sf_dir)
    old = lambda f, n: fresh.where("node_id = 'all'").withColumns({"flow_id": F.lit(f), "node_id": F.lit(n), "value": F.lit(-1.0)})
    return merge_results(old("flow", "all").unionByName(old("flow", "gone")).unionByName(old("other", "all")), fresh, "flow", g).select("flow_id", "node_id", "value")


@register("stale_tiles", "select 'all' as node_id union all select 'total'")
def stale_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After seven hours every stored tile is due."""
    return expired(_tiles(spark, sf_dir)[0], EVENTS_NOW + timedelta(hours=7)).select("node_id")


@register("number_in_field", "select 'properties.k' as field, count(*)::bigint as n from events where (props->>'$.k') is not null")
def number_in_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = adapted(spark, sf_dir, "events").scan(source="events")
    return frame.df.agg(F.lit("properties.k").alias("field"), F.count(field_of(frame, "properties.k").number).alias("n"))
