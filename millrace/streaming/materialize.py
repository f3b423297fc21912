"""Stored tiles: publish a graph, work its results out, keep them, and know when they are stale."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.windows import RANGES, dashboard_range, ms, slides
from millrace.plans.engine import Err, run_flow
from millrace.plans.graph import Graph
from millrace.plans.tiles import build_tile, next_change_of, tile_by_range
from millrace.sources.records import EventStore

RESULT_SCHEMA = (
    "flow_id string, node_id string, name string, value double, error string, series array<struct<bucket:string,value:double>>, groups array<struct<label:string,value:double>>, "
    "by_range map<string,struct<value:double,error:string,undated:bigint>>, computed_at timestamp, next_change_at timestamp"
)
#: A tile is worked out anew at this age, whatever happened.
MAX_AGE = timedelta(hours=6)


def results_of(g: Graph) -> list[tuple[str, dict]]:
    """(step, presentation) of every result: enabled metrics and Output steps."""
    shown = [(m["nodeId"], m) for m in g.metrics if m["enabled"] and m.get("nodeId") in g.nodes]
    return shown + [(n.id, n.config) for n in g.nodes.values() if n.type == "output"]


def materialize(store: EventStore, flow_id: str, g: Graph, now: datetime) -> DataFrame:
    """A row for every result that could be compiled: its tile, the tile through each range, and
    when its numbers next change by the clock alone."""
    run, out = run_flow(store, g, now), None
    ranges, at = [dashboard_range(k, now) for k in RANGES], ms(now)
    for node, spec in results_of(g):
        if isinstance(run.results.get(node), Err):
            continue  # the last good value stays
        field = spec.get("timeField")
        slots = tile_by_range(run, node, ranges, field).agg(F.map_from_entries(F.collect_list(F.struct("_range", F.struct("value", "error", "undated")))).alias("by_range"))
        after = next_change_of(run, node, ranges, at, field).select(F.timestamp_millis("at").alias("next_change_at"))
        tile = build_tile(run, node, spec).crossJoin(F.broadcast(slots)).crossJoin(F.broadcast(after))  # a row by a row by a row
        row = tile.select(F.lit(flow_id).alias("flow_id"), F.lit(node).alias("node_id"), F.lit(spec.get("name")).alias("name"), "value", "error", "series", "groups", "by_range", F.timestamp_millis(F.lit(at)).alias("computed_at"), "next_change_at")
        out = row if out is None else out.unionByName(row)
    return store.df.sparkSession.createDataFrame([], RESULT_SCHEMA) if out is None else out


def merge_results(stored: DataFrame, fresh: DataFrame, flow_id: str, g: Graph) -> DataFrame:
    """Stored tiles after a run of one flow: fresh ones take their place, results with an error
    keep their last good value, results that the graph no longer has go."""
    live = [node for node, _ in results_of(g)]
    good = fresh.where("error is null")
    kept = stored.where((F.col("flow_id") != flow_id) | F.col("node_id").isin(live)).join(good.select("flow_id", "node_id"), ["flow_id", "node_id"], "left_anti")
    return kept.select(*fresh.columns).unionByName(good)


def reads(g: Graph) -> set[tuple[str | None, str | None, str | None]]:
    """(connection, source, event type) of every Get data step."""
    return {(n.config["connectionId"], n.config["source"], n.config["eventType"]) for n in g.nodes.values() if n.type == "app"}


def stale_for(graphs: dict[str, Graph], source: str, connection: str | None = None) -> set[str]:
    """Flows that read a changed source or connection."""
    return {f for f, g in graphs.items() if any((s is None or s == source) and (c is None or connection is None or c == connection) for c, s, _ in reads(g))}


def expired(stored: DataFrame, now: datetime) -> DataFrame:
    """Stored tiles whose numbers may have changed, stalest first: the clock has passed their
    next change, or they are older than MAX_AGE."""
    at = F.timestamp_millis(F.lit(ms(now)))
    return stored.where((F.col("next_change_at") <= at) | (F.col("computed_at") < F.timestamp_millis(F.lit(ms(now - MAX_AGE))))).orderBy(F.asc_nulls_first("computed_at"))


def moves_with_clock(g: Graph) -> bool:
    """Some window of the graph is relative to now."""
    return any((n.type == "time" and slides(n.config)) or (n.type == "filter" and (n.config.get("dateRange") or {}).get("enabled") and slides(n.config["dateRange"])) for n in g.nodes.values())


def beacon(stored: DataFrame) -> DataFrame:
    """One text that changes whenever a stored tile does."""
    return stored.agg(F.concat_ws("/", F.count(F.lit(1)), F.max("computed_at"), F.min("computed_at"), F.hex(F.bit_xor(F.xxhash64("flow_id", "node_id", "value")))).alias("beacon"))
