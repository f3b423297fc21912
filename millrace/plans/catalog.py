"""Registered queries of the flow engine: name -> callable, name -> DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.dates import canonical_date, detect_date_column, normalize_dates
from millrace.functions.identity import identifiers
from millrace.operators.windows import RANGES, dashboard_range, ms
from millrace.plans.engine import run_flow
from millrace.plans.graph import parse_graph
from millrace.plans.metrics import Period, compute_aggregate, compute_funnel, distinct_event_types, query_events
from millrace.plans.tiles import build_tile, delta, headline, next_change_of, tile_by_range
from millrace.sources.connectors import normalize, sheet_cells
from millrace.sources.records import adapted, field_of, table
from millrace.sources.registry import fields_seen, infer_fields, presence_by_path
from millrace.streaming.ingest import prepared, restamp, retire_absent, retire_outside, upsert
from millrace.streaming.materialize import materialize

#: The clock of the driver's tables.
EVENTS_NOW, ORDERS_NOW = datetime(2024, 1, 30, 12, tzinfo=UTC), datetime(1998, 8, 2, tzinfo=UTC)
_MAY = Period(ms(datetime(2024, 1, 5, tzinfo=UTC)), ms(datetime(2024, 1, 25, tzinfo=UTC)))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

Step = tuple[str, str, dict]


def chain(*steps: Step) -> dict:
    """A graph whose steps follow one another."""
    return {"nodes": [{"id": i, "type": t, "data": {"config": c}} for i, t, c in steps], "edges": [{"source": a[0], "target": b[0]} for a, b in zip(steps, steps[1:], strict=False)]}


def graph(steps: Sequence[Step], edges: Sequence[tuple]) -> dict:
    """A graph from its steps and (source, target[, targetHandle[, sourceHandle]])."""
    wired = [{"source": e[0], "target": e[1], "targetHandle": e[2] if len(e) > 2 else None, "sourceHandle": e[3] if len(e) > 3 else None} for e in edges]
    return {"nodes": [{"id": i, "type": t, "data": {"config": c}} for i, t, c in steps], "edges": wired}


def register(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def flow(name: str, tables: tuple[str, ...], g: dict, node: str, columns: Sequence[str], sql: str, now: datetime = EVENTS_NOW) -> None:
    """Registers the rows of one step of a graph over adapted tables."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_flow(adapted(spark, sf_dir, *tables), g, now).df(node).select(*columns)

    register(name, sql)(query)


GET: Step = ("get", "app", {"source": "events"})
R6 = "floor(({})*1e6+0.5)/1e6"

# ---- the flagship and scans --------------------------------------------------------

flow(
    "flagship_weekly_signups", ("events",),
    chain(("get", "app", {"source": "events", "eventType": "signup"}), ("recent", "filter", {"dateRange": {"enabled": True, "preset": "last_30_days"}}), ("users", "formula", {"op": "count_distinct", "groupBy": {"type": "time", "unit": "week"}}), ("out", "output", {"viz": "line"})),
    "out", ("bucket", "value"),
    "select strftime(ts,'%G-W%V') as bucket, count(distinct user_id)::double as value from events where event_type='signup' and ts between timestamp '2023-12-31 12:00:00' and timestamp '2024-01-30 12:00:00' group by 1",
)
flow("scan_count", ("events",), chain(GET, ("n", "formula", {"op": "count"})), "n", ("value",), "select count(*)::double as value from events")

# ---- filters -------------------------------------------------------------------------


def _filter(name: str, rules: list[dict], where: str, combinator: str = "and", tables: tuple[str, ...] = ("events",)) -> None:
    source, key = tables[0], {"events": "event_id", "orders": "o_orderkey"}[tables[0]]
    flow(name, tables, chain(("get", "app", {"source": source}), ("keep", "filter", {"combinator": combinator, "rules": rules})), "keep", ("id",), f"select {key}::varchar as id from {source} where {where}")


def _rule(field: str, op: str, value: str = "", **more: str) -> dict:
    return {"field": field, "op": op, "value": value, **more}


_K = "(props->>'$.k')"
_filter("filter_equals", [_rule("eventType", "equals", "signup")], "event_type = 'signup'")
_filter("filter_not_equals", [_rule("eventType", "not_equals", "click")], "event_type <> 'click'")
_filter("filter_contains", [_rule("eventType", "contains", "IC")], "contains(lower(event_type), 'ic')")
_filter("filter_not_contains", [_rule("eventType", "not_contains", "IC")], "not contains(lower(event_type), 'ic')")
_filter("filter_starts_with", [_rule("eventType", "starts_with", "S")], "starts_with(lower(event_type), 's')")
_filter("filter_ends_with", [_rule("eventType", "ends_with", "UP")], "ends_with(lower(event_type), 'up')")
_filter("filter_gt", [_rule("value", "gt", "50")], "value > 50")
_filter("filter_lt", [_rule("properties.k", "lt", "20")], f"{_K}::double < 20")
_filter("filter_gte", [_rule("properties.k", "gte", "80")], f"{_K}::double >= 80")
_filter("filter_lte", [_rule("value", "lte", "25.5")], "value <= 25.5")
_filter("filter_is_empty", [_rule("properties.absent", "is_empty"), _rule("eventType", "equals", "view")], "event_type = 'view'")
_filter("filter_is_not_empty", [_rule("properties.k", "is_not_empty")], f"{_K} is not null")
_filter("filter_is_one_of", [_rule("eventType", "is_one_of", "click, view")], "event_type in ('click','view')")
_filter("filter_is_not_one_of", [_rule("properties.k", "is_not_one_of", "1, 2,3")], f"{_K} not in ('1','2','3')")
_filter("filter_before", [_rule("occurredAt", "before", "2024-01-10")], "ts < timestamp '2024-01-10'")
_filter("filter_after", [_rule("occurredAt", "after", "2024-01-20T06:00:00Z")], "epoch_us(ts)//1000 > 1705730400000")
_filter("filter_between", [_rule("occurredAt", "between", "2024-01-05", value2="2024-01-08")], "ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-09'")
_filter("filter_and", [_rule("eventType", "equals", "purchase"), _rule("value", "gte", "10"), _rule("properties.k", "lt", "50")], f"event_type='purchase' and value >= 10 and {_K}::double < 50")
_filter("filter_or", [_rule("eventType", "equals", "error"), _rule("properties.k", "equals", "7")], f"event_type='error' or {_K} = '7'", "or")
_filter("filter_field_vs_field", [_rule("value", "gt", valueKind="field", valueField="properties.k")], f"value > {_K}::double")
_filter("filter_nested_json", [_rule("properties.k", "equals", "42")], f"{_K} = '42'")
_filter("filter_pushed_down", [_rule("o_orderpriority", "equals", "1-URGENT"), _rule("o_totalprice", "gt", "200000")], "o_orderpriority = '1-URGENT' and o_totalprice > 200000", tables=("orders",))

# ---- aggregates ------------------------------------------------------------------------


def _total(name: str, op: str, sql: str, **config) -> None:
    flow(name, ("events",), chain(GET, ("x", "formula", {"op": op, **config})), "x", ("value",), sql)


_total("agg_count", "count", "select count(*)::double as value from events")
_total("agg_count_distinct", "count_distinct", f"select count(distinct {_K})::double as value from events", distinctField="properties.k")
_total("agg_sum", "sum", f"select {R6.format('sum(value)')} as value from events")
_total("agg_avg", "avg", f"select {R6.format('avg(value)')} as value from events")
_total("agg_median", "median", f"select {R6.format('median(value)')} as value from events")
_total("agg_min", "min", "select min(value) as value from events")
_total("agg_max", "max", f"select max({_K}::double) as value from events", field="properties.k")
flow("agg_multi_column", ("lineitem",), chain(("get", "app", {"source": "lineitem"}), ("x", "formula", {"op": "sum", "field": "l_quantity", "extraFields": ["l_tax", "l_quantity", ""]})), "x", ("value",), f"select {R6.format('sum(l_quantity+l_tax)')} as value from lineitem")


def _series(name: str, unit: str, bucket: str) -> None:
    g = chain(("get", "app", {"source": "orders"}), ("x", "formula", {"op": "sum", "field": "o_totalprice", "groupBy": {"type": "time", "unit": unit}}))
    flow(name, ("orders",), g, "x", ("bucket", "value"), f"select {bucket} as bucket, {R6.format('sum(o_totalprice)')} as value from orders group by 1")


_series("series_day", "day", "strftime(o_orderdate,'%Y-%m-%d')")
_series("series_week", "week", "strftime(o_orderdate,'%G-W%V')")
_series("series_month", "month", "strftime(o_orderdate,'%Y-%m')")
_series("series_quarter", "quarter", "strftime(o_orderdate,'%Y')||'-Q'||quarter(o_orderdate)")
_series("series_year", "year", "strftime(o_orderdate,'%Y')")
flow("group_by_field", ("events",), chain(GET, ("x", "formula", {"op": "median", "groupBy": {"type": "field", "field": "eventType"}})), "x", ("label", "value"), f"select event_type as label, {R6.format('median(value)')} as value from events group by 1")
flow("group_by_property", ("events",), chain(GET, ("x", "group", {"field": "properties.k", "aggregation": "count_distinct"})), "x", ("label", "value"), f"select {_K} as label, count(distinct user_id)::double as value from events group by 1")
flow("group_not_set", ("events",), chain(GET, ("x", "group", {"field": "properties.absent"})), "x", ("label", "value"), "select '(not set)' as label, count(*)::double as value from events")
_CATEGORIES = [{"label": "Money", "filters": {"rules": [_rule("eventType", "equals", "purchase")]}}, {"label": "Trouble", "filters": {"rules": [_rule("eventType", "equals", "error")]}}, {"label": "Never", "filters": {"rules": [_rule("eventType", "equals", "nothing")]}}]
flow(
    "group_categories", ("events",), chain(GET, ("x", "group", {"mode": "categories", "categories": _CATEGORIES, "aggregation": "sum"})), "x", ("label", "value"),
    f"select l.label, coalesce(v.value, 0.0)::double as value from (values ('Money'),('Trouble'),('Never'),('Other')) l(label) left join (select case when event_type='purchase' then 'Money' when event_type='error' then 'Trouble' else 'Other' end as label, {R6.format('sum(value)')} as value from events group by 1) v using (label)",
)
flow("calc_breakdown", ("orders",), chain(("get", "app", {"source": "orders"}), ("x", "calculate", {"mode": "breakdown", "breakdownField": "o_orderpriority", "aggregation": "sum", "field": "o_totalprice"})), "x", ("label", "value"), f"select o_orderpriority as label, {R6.format('sum(o_totalprice)')} as value from orders group by 1")
flow("calc_number", ("events",), chain(GET, ("x", "calculate", {"aggregation": "avg", "field": "properties.k"})), "x", ("value",), f"select {R6.format(f'avg({_K}::double)')} as value from events")
flow("total_beside_groups", ("events",), chain(GET, ("x", "formula", {"op": "count_distinct", "groupBy": {"type": "field", "field": "eventType"}})), "x", ("label", "value"), "select event_type as label, count(distinct user_id)::double as value from events group by 1")


@register("headline_of_groups", "select count(distinct user_id)::double as value from events")
def headline_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number over all records, not the sum of the groups."""
    run = run_flow(adapted(spark, sf_dir, "events"), chain(GET, ("x", "formula", {"op": "count_distinct", "groupBy": {"type": "field", "field": "eventType"}})), EVENTS_NOW)
    return headline(run.ok("x").shape).select("value")


# ---- formulas ------------------------------------------------------------------------

_TWO: list[Step] = [GET, ("bought", "filter", {"rules": [_rule("eventType", "equals", "purchase")]}), ("joined", "filter", {"rules": [_rule("eventType", "equals", "signup")]})]
_A, _B = "(select count(*)::double from events where event_type='purchase')", "(select count(*)::double from events where event_type='signup')"


def _formula(op: str, sql: str) -> None:
    g = graph([*_TWO, ("x", "formula", {"op": op})], [("get", "bought"), ("get", "joined"), ("bought", "x", "a"), ("joined", "x", "b")])
    flow(f"formula_{op}", ("events",), g, "x", ("value",), f"select {R6.format(sql)} as value")


for _op, _sql in {"add": f"{_A}+{_B}", "average": f"({_A}+{_B})/2", "subtract": f"{_A}-{_B}", "difference": f"{_A}-{_B}", "multiply": f"{_A}*{_B}", "divide": f"{_A}/{_B}", "ratio": f"{_A}/{_B}", "percentage": f"{_A}/{_B}*100", "percent_change": f"({_A}-{_B})/{_B}*100"}.items():
    _formula(_op, _sql)
flow(
    "formula_field_read", ("events",),
    graph([GET, ("newest", "app", {"source": "events", "eventType": "purchase", "dedupe": True, "dedupeField": "eventType"}), ("x", "formula", {"op": "divide", "bField": "value"})], [("get", "x", "a"), ("newest", "x", "b")]),
    "x", ("value",),
    f"select {R6.format('(select count(*) from events)::double / value')} as value from (select value from events where event_type='purchase' order by ts desc limit 1)",
)
flow("formula_stacked", ("events",), chain(GET, ("first", "formula", {"op": "sum"}), ("second", "formula", {"op": "max"})), "second", ("value",), "select max(value) as value from events")
flow("formula_typed_in", ("events",), graph([GET, ("sum", "formula", {"op": "sum"}), ("x", "formula", {"op": "percentage", "bFixed": 400})], [("get", "sum"), ("sum", "x", "a")]), "x", ("value",), f"select {R6.format('s/400*100')} as value from (select {R6.format('sum(value)')} as s from events)")

# ---- one of each, match, stack, split ----------------------------------------------------


def _dedupe(name: str, keep: str, order: str) -> None:
    g = chain(("get", "app", {"source": "events", "dedupe": True, "dedupeKeep": keep}))
    flow(name, ("events",), g, "get", ("id", "subject"), f"select event_id::varchar as id, user_id::varchar as subject from (select *, row_number() over (partition by user_id order by ts {order}, event_id desc) as r from events) where r = 1")


_dedupe("dedupe_latest", "latest", "desc")
_dedupe("dedupe_earliest", "earliest", "asc")
flow(
    "dedupe_by_property", ("events",), chain(("get", "app", {"source": "events", "dedupe": True, "dedupeField": "properties.k", "dedupeOrderField": "value"}), ("n", "formula", {"op": "sum"})), "n", ("value",),
    f"select {R6.format('sum(v)')} as value from (select max(value) as v from events group by {_K})",
)


def _match(name: str, mode: str, where: str) -> None:
    recent = {"mode": "between", "from": "1998-01-01", "to": ""}
    steps = [("people", "app", {"source": "customer"}), ("orders", "app", {"source": "orders"}), ("recent", "time", recent), ("x", "unite", {"mode": "match", "keepNodeId": "people", "keyField": "c_custkey", "lookupField": "o_custkey", "matchMode": mode})]
    flow(name, ("customer", "orders"), graph(steps, [("people", "x"), ("orders", "recent"), ("recent", "x")]), "x", ("id",), f"select c_custkey::varchar as id from customer c where {where} (select 1 from orders o where o.o_custkey=c.c_custkey and o.o_orderdate >= timestamp '1998-01-01')", ORDERS_NOW)


_match("match_appears", "appears", "exists")
_match("match_missing", "missing", "not exists")
_STACKED = [("a", "app", {"source": "events"}), ("b", "app", {"source": "orders"}), ("both", "unite", {}), ("x", "group", {"field": "source"})]
flow("combine_stack", ("events", "orders"), graph(_STACKED, [("a", "both"), ("b", "both"), ("both", "x")]), "x", ("label", "value"), "select 'events' as label, count(*)::double as value from events union all select 'orders', count(*)::double from orders")
flow("combine_stack_repeats", ("events",), graph([GET, ("keep", "filter", {"rules": [_rule("eventType", "equals", "error")]}), ("both", "unite", {}), ("x", "group", {"field": "eventType"})], [("get", "both"), ("get", "keep"), ("keep", "both"), ("both", "x")]), "x", ("label", "value"), "select event_type as label, (count(*) * case when event_type='error' then 2 else 1 end)::double as value from events group by event_type")
_BRANCHES = {"paths": [{"id": "pay", "label": "Pay", "filters": {"rules": [_rule("eventType", "equals", "purchase")]}}, {"id": "all", "label": "All", "mode": "always"}, {"id": "rest", "label": "Rest", "mode": "fallback"}]}


def _path(name: str, branch: str, where: str) -> None:
    flow(name, ("events",), graph([GET, ("split", "paths", _BRANCHES), ("x", "formula", {"op": "sum"})], [("get", "split"), ("split", "x", None, branch)]), "x", ("value",), f"select {R6.format('sum(value)')} as value from events where {where}")


_path("paths_custom", "pay", "event_type='purchase'")
_path("paths_always", "all", "true")
_path("paths_fallback", "rest", "event_type<>'purchase'")

# ---- time ------------------------------------------------------------------------------


def _time(name: str, config: dict, where: str) -> None:
    flow(name, ("events",), chain(GET, ("in", "time", config)), "in", ("id",), f"select event_id::varchar as id from events where {where}")


_time("time_preset_last_7_days", {"preset": "last_7_days"}, "ts between timestamp '2024-01-23 12:00:00' and timestamp '2024-01-30 12:00:00.000999'")
_time("time_preset_last_week", {"preset": "last_week"}, "ts >= timestamp '2024-01-22' and ts < timestamp '2024-01-29'")
_time("time_rolling", {"mode": "rolling", "days": 3}, "ts between timestamp '2024-01-27 12:00:00' and timestamp '2024-01-30 12:00:00.000999'")
_time("time_between_dates", {"mode": "between", "from": "2024-01-10", "to": "2024-01-12"}, "ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-13'")
_PAIRING: list[Step] = [("start", "app", {"source": "events", "eventType": "signup"}), ("stop", "app", {"source": "events", "eventType": "purchase"}), ("both", "unite", {}), ("pair", "time_between", {"keyField": "subject", "startField": "occurredAt", "startStep": "start", "endField": "occurredAt", "endStep": "stop"})]
_PAIRED = [("start", "both"), ("stop", "both"), ("both", "pair")]
_GAPS = "with m as (select user_id, event_type, epoch_us(ts)//1000 as ms from events), s as (select user_id, min(ms) as t0 from m where event_type='signup' group by 1), g as (select s.user_id, (min(m.ms)-s.t0)/60000.0::double as gap from s join m using (user_id) where m.event_type='purchase' and m.ms>=s.t0 group by s.user_id, s.t0)"
flow("time_between_median", ("events",), graph([*_PAIRING, ("x", "formula", {"op": "median", "field": "properties.time_between.minutes"})], [*_PAIRED, ("pair", "x")]), "x", ("value",), f"{_GAPS} select {R6.format('median(gap)')} as value from g")


@register("time_between_pairs", f"{_GAPS} select user_id::varchar as subject, {R6.format('gap')} as minutes from g")
def time_between_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = run_flow(adapted(spark, sf_dir, "events"), graph(_PAIRING, _PAIRED), EVENTS_NOW).frame("pair")
    return frame.df.select("subject", (F.floor(field_of(frame, "properties.time_between.minutes").number * 1e6 + 0.5) / 1e6).alias("minutes"))


_REPORT = f"{_GAPS}, k as (select user_id, count(*) filter (where event_type='signup') as s, count(*) filter (where event_type='purchase') as p from events where event_type in ('signup','purchase') group by 1) select count(*)::bigint as keys, count(*) filter (where s>0)::bigint as started, (select count(*) from g)::bigint as matched, count(*) filter (where s>0 and p=0)::bigint as noStop, (count(*) filter (where s>0 and p>0) - (select count(*) from g))::bigint as stopBeforeStart from k"


@register("time_between_receipt", _REPORT)
def time_between_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_flow(adapted(spark, sf_dir, "events"), graph(_PAIRING, _PAIRED), EVENTS_NOW).ok("pair").report


_SHARE = graph([*_TWO, ("x", "formula", {"op": "percentage"})], [("get", "bought"), ("get", "joined"), ("bought", "x", "a"), ("joined", "x", "b")])
_WINDOWS = "(values ('today', timestamp '2024-01-30', timestamp '2024-01-30 12:00:00.000999'), ('yesterday', timestamp '2024-01-29', timestamp '2024-01-29 23:59:59.999999'), ('7d', timestamp '2024-01-23 12:00:00', timestamp '2024-01-30 12:00:00.000999'), ('30d', timestamp '2023-12-31 12:00:00', timestamp '2024-01-30 12:00:00.000999'), ('90d', timestamp '2023-11-01 12:00:00', timestamp '2024-01-30 12:00:00.000999'), ('all', timestamp '1970-01-01', timestamp '2100-01-01')) w(rng, a, b)"


def _ranges():
    return [dashboard_range(k, EVENTS_NOW) for k in RANGES]


@register("tile_by_range", f"select rng as range, {R6.format('count(*) filter (where event_type = $$purchase$$)::double / count(*) filter (where event_type = $$signup$$) * 100')} as value from {_WINDOWS} join events on ts between a and b group by 1")
def tile_by_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_flow(adapted(spark, sf_dir, "events"), _SHARE, EVENTS_NOW)
    return tile_by_range(run, "x", _ranges()).select(F.col("_range").alias("range"), "value")


@register("tile_by_range_median", f"select rng as range, {R6.format('median(value)')} as value from {_WINDOWS} join events on ts between a and b group by 1")
def tile_by_range_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_flow(adapted(spark, sf_dir, "events"), chain(GET, ("x", "formula", {"op": "median"})), EVENTS_NOW)
    return tile_by_range(run, "x", _ranges()).select(F.col("_range").alias("range"), "value")


_NEXT = "with e as (select epoch_us(ts)//1000 as t, 1706616000000 as now from events) select least(1706659200000, min(t) filter (where t > now), min(t + 604800000) filter (where t <= now and t + 604800000 > now), min(t + 2592000000) filter (where t <= now and t + 2592000000 > now), min(t + 7776000000) filter (where t <= now and t + 7776000000 > now))::bigint as at from e"


@register("next_change", _NEXT)
def next_change_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the tile's numbers next change without new data."""
    run = run_flow(adapted(spark, sf_dir, "events"), chain(GET, ("x", "formula", {"op": "count"})), EVENTS_NOW)
    return next_change_of(run, "x", _ranges(), ms(EVENTS_NOW))


@register("tile_delta", "select max(value) filter (where p=2) as current, max(value) filter (where p=3) as previous from (select count(*)::double as value, row_number() over (order by date_trunc('day', ts) desc) as p from events group by date_trunc('day', ts))")
def tile_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_flow(adapted(spark, sf_dir, "events"), chain(GET, ("x", "formula", {"op": "count", "groupBy": {"type": "time", "unit": "day"}})), EVENTS_NOW)
    return delta(run.df("x"))


@register("tile_groups", "select event_type as label, count(*)::double as value from events group by 1")
def tile_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile's list, as the one row that is stored, taken apart again."""
    run = run_flow(adapted(spark, sf_dir, "events"), chain(GET, ("x", "group", {"field": "eventType"})), EVENTS_NOW)
    return build_tile(run, "x").select(F.inline("groups"))


# ---- classic metrics -----------------------------------------------------------------

_IN = "ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25 00:00:00.001'"


def _classic(name: str, definition: dict, sql: str) -> None:
    register(name, sql)(lambda spark, sf_dir: compute_aggregate(adapted(spark, sf_dir, "events"), definition, _MAY))


_classic("classic_count", {"eventType": "purchase"}, f"select count(*)::double as value from events where {_IN} and event_type='purchase'")
_classic("classic_sum_property", {"aggregation": "sum", "valueField": "properties.k", "filters": {"rules": [_rule("properties.k", "gt", "50")]}}, f"select sum({_K}::double) as value from events where {_IN} and {_K}::double > 50")


@register("classic_sum", f"select {R6.format('sum(value)')} as value from events where {_IN}")
def classic_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute_aggregate(adapted(spark, sf_dir, "events"), {"aggregation": "sum"}, _MAY).select((F.floor(F.col("value") * 1e6 + 0.5) / 1e6).alias("value"))


_classic("classic_count_distinct", {"aggregation": "count_distinct", "filters": {"rules": [_rule("eventType", "in", "click, view")]}}, f"select count(distinct user_id)::double as value from events where {_IN} and event_type in ('click','view')")
for _unit in ("day", "week", "month"):
    _classic(f"classic_trend_{_unit}", {"timeBucket": _unit, "filters": {"rules": [_rule("eventType", "not_equals", "error")]}}, f"select strftime(date_trunc('{_unit}', ts), '%Y-%m-%d') as bucket, count(*)::double as value from events where {_IN} and event_type <> 'error' group by 1")
_STAGES = [{"label": "View", "eventType": "view"}, {"label": "Signup", "eventType": "signup"}, {"label": "Purchase", "eventType": "purchase", "filters": {"rules": [_rule("value", "gt", "40")]}}]
_FUNNEL = f"with c as (select count(distinct user_id) filter (where event_type='view') as a, count(distinct user_id) filter (where event_type='signup') as b, count(distinct user_id) filter (where event_type='purchase' and value > 40) as d from events where {_IN}) select 0::int as stage, 'View' as label, a::bigint as count, 1.0::double as conversion_from_first, 1.0::double as conversion_from_prev, false as bottleneck from c union all select 1, 'Signup', b, b::double/a, b::double/a, (a-b)>=(b-d) from c union all select 2, 'Purchase', d, d::double/a, d::double/b, (b-d)>(a-b) from c"


@register("classic_funnel", _FUNNEL)
def classic_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute_funnel(adapted(spark, sf_dir, "events"), _STAGES, _MAY)


@register("classic_drilldown", f"select event_id::varchar as id, user_id::varchar as subject, value from events where {_IN} and event_type='purchase' order by ts desc limit 50")
def classic_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_events(adapted(spark, sf_dir, "events"), _MAY, event_type="purchase").select("id", "subject", "value")


@register("classic_distinct_types", "select distinct event_type as \"eventType\" from events")
def classic_distinct_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_event_types(adapted(spark, sf_dir, "events"))



# ---- fields, identities, ingestion, stored tiles -------------------------------------------


@register("presence_by_path", f"select 'k' as path, count({_K})::bigint as present from events")
def presence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence_by_path(adapted(spark, sf_dir, "events").df)


@register("field_registry", f"select event_type as \"eventType\", 'k' as path, 'number' as type, least(count(distinct {_K}), 1000)::bigint as cardinality, count(*)::bigint as seen from events group by 1")
def field_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields_seen(adapted(spark, sf_dir, "events").df, "eventType").select("eventType", "path", "type", "cardinality", "seen")


@register("infer_fields")
def infer_fields_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer_fields(adapted(spark, sf_dir, "events").scan().df)


@register("normalize_dates", "select o_orderkey::varchar as id, '{\"booked_at\":\"'||strftime(o_orderdate,'%Y-%m-%d')||'\"}' as properties from orders")
def normalize_dates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written month first, brought into one form."""
    spelled = F.to_json(F.struct(F.date_format("o_orderdate", "M/d/yyyy").alias("booked_at")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), normalize_dates(spelled).alias("properties"))


@register("canonical_date_field", "select strftime(o_orderdate,'%Y-%m-%d') as day, count(*)::bigint as n from orders group by 1")
def canonical_date_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for one field, without leaving the JVM."""
    spelled = canonical_date(F.date_format("o_orderdate", "d MMM yyyy"), "booked_at")
    return table(spark, sf_dir, "orders").groupBy(spelled.alias("day")).agg(F.count(F.lit(1)).alias("n"))


@register("detect_date_column", "select 'booked on' as column, 'booked on' as candidates")
def detect_date_column_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.create_map(F.lit("booked on"), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit("closed"), F.col("o_orderpriority"), F.lit("amount"), F.col("o_totalprice").cast("string"))
    found = detect_date_column(sheet_cells(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), cells.alias("cells"))))
    return found.withColumn("candidates", F.array_join("candidates", ", "))


@register("identity_harvest", "select c_custkey::bigint as id, lower(c_name)||'@acme.com' as email, '+1'||lpad(c_custkey::varchar,10,'2') as phone from customer")
def identity_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.try_parse_json(F.to_json(F.struct(F.lpad(F.col("c_custkey").cast("string"), 10, "2").alias("Phone"), F.col("c_mktsegment").alias("segment"))))
    found = table(spark, sf_dir, "customer").select("c_custkey", identifiers(F.concat(F.lit(" "), F.col("c_name"), F.lit("@Acme.COM ")), props).alias("i"))
    return found.select(F.col("c_custkey").cast("long").alias("id"), F.col("i.emails")[0].alias("email"), F.col("i.phones")[0].alias("phone"))


def _canonical(spark: SparkSession, sf_dir: str, generation: int = 1) -> DataFrame:
    """The driver's events as stored ones."""
    props = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("raw_event_id"), F.lit("c1").alias("connection_id"), F.timestamp_millis(F.lit(0)).alias("received_at"), F.lit("events").alias("source"),
        F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("user_id").cast("string").alias("subject"), F.col("ts").cast("timestamp").alias("occurred_at"), "value", F.lit(None).cast("string").alias("currency"), F.col("props").alias("properties"),
    )
    return prepared(props, "org", generation, "s1")


@register("upsert_latest_generation", "select case when event_id % 2 = 1 then 'inserted' when event_type = 'error' then 'updated' else 'deduped' end as action, count(*)::bigint as n from events group by 1")
def upsert_latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events are stored already; the errors among them come with another value."""
    now = _canonical(spark, sf_dir)
    stored = now.where("cast(event_id as bigint) % 2 = 0").withColumn("value", F.when(F.col("event_type") == "error", -1).otherwise(F.col("value")).cast("decimal(38,10)"))
    return upsert(stored, now).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@register("upsert_stale_generation", "select 'deduped' as action, count(*)::bigint as n from events")
def upsert_stale_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older generation changes nothing."""
    stored = _canonical(spark, sf_dir, 3).withColumn("subject", F.lit("kept"))
    return upsert(stored, _canonical(spark, sf_dir, 2)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@register("mirror_diff", "select event_type, count(*)::bigint as live from events where event_type <> 'error' group by 1")
def mirror_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _canonical(spark, sf_dir)
    after = retire_absent(stored, stored.where("event_type != 'error'").select("event_id"), "c1", "s1", F.timestamp_millis(F.lit(ms(EVENTS_NOW))))
    return after.where("deleted_at is null").groupBy("event_type").agg(F.count(F.lit(1)).alias("live"))


@register("retire_window", "select count(*) filter (where ts between timestamp '2024-01-05' and timestamp '2024-01-20')::bigint as live, count(*) filter (where not ts between timestamp '2024-01-05' and timestamp '2024-01-20')::bigint as retired from events")
def retire_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = retire_outside(_canonical(spark, sf_dir), "c1", "s1", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"), F.timestamp_millis(F.lit(ms(EVENTS_NOW))))
    return after.agg(F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count_if(F.col("deleted_at").isNotNull()).alias("retired"))


@register("restamp", "select event_type, count(*)::bigint as n, case when event_type='view' then '1970-01-01' else '2024-01' end as month from events group by 1")
def restamp_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views lose their time and fall back to the first receipt."""
    stored = _canonical(spark, sf_dir)
    moments = stored.where("event_type = 'view'").select("event_id", F.lit(None).cast("timestamp").alias("occurred_at"))
    month = F.when(F.year("occurred_at") == 1970, F.date_format("occurred_at", "yyyy-MM-dd")).otherwise(F.date_format("occurred_at", "yyyy-MM"))
    return restamp(stored, moments).groupBy("event_type", month.alias("month")).agg(F.count(F.lit(1)).alias("n"))


@register("connector_webhook", "select 'webhook:c1:'||event_id::varchar as event_id, event_type, user_id::varchar as subject, value from events")
def connector_webhook(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("user"), F.col("value").alias("amount"), F.col("ts").alias("occurred_at")))
    raw = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("raw_id"), F.lit("c1").alias("connection_id"), payload.alias("payload"), F.timestamp_millis(F.lit(0)).alias("received_at"))
    return normalize(raw, "webhook")[0].select("event_id", "event_type", "subject", "value")


@register("materialized_tiles")
def materialized_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = chain(GET, ("x", "formula", {"op": "count", "groupBy": {"type": "field", "field": "eventType"}}), ("out", "output", {"name": "By type", "viz": "bar"}))
    return materialize(adapted(spark, sf_dir, "events"), "flow", parse_graph(g), EVENTS_NOW).drop("computed_at")
