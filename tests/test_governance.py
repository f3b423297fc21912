"""Trials of steps, offered fields, the recompute queue, visibility, schema differences, drift."""

import json
from datetime import datetime

from flows import GET, event, rule, steps, store
from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.operators import governance as G
from millrace.plans.trial import saved_paths, trial, tried
from millrace.sources.registry import offered_fields


def test_trial_sees_every_step_in_one_pass(spark):
    rows = [event("a", value=i, days=i) for i in range(6)] + [event("b", value=9, days=0.5)]
    flow = steps(GET, ("big", "filter", {"rules": [rule("value", "gte", "3")]}), ("a", "filter", {"rules": [rule("eventType", "equals", "a")]}))
    found = trial(store(spark, rows), flow, "a")
    plan = found.run.df("a")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and plan.count("CollectMetrics") == 3
    got = {r["step"]: r for r in tried(store(spark, rows), flow, "a").collect()}
    assert {k: r["records"] for k, r in got.items()} == {"get": 7, "big": 4, "a": 3}
    assert json.loads(got["get"]["sample"][0])["id"] == "e0000" and json.loads(got["big"]["sample"][0])["eventType"] == "b" and all(len(r["sample"]) <= 3 for r in got.values())


def test_trial_of_a_broken_step(spark):
    broken = steps(GET, ("n", "formula", {"op": "add", "bFixed": 1}), ("out", "output", {}))
    got = {r["step"]: (r["state"], r["records"]) for r in tried(store(spark, [event()]), broken, "out").collect()}
    assert got["n"][0] == got["out"][0] == "error" and got["get"] == ("ok", None)


def test_saved_paths():
    flow = steps(GET, ("f", "filter", {"rules": [rule("properties.a", "equals", valueKind="field", valueField="properties.b")], "dateRange": {"dateField": "properties.c"}}), ("g", "group", {"mode": "categories", "categories": [{"filters": {"rules": [rule("properties.d", "equals")]}}]}), ("x", "formula", {"field": "properties.e", "groupBy": {"field": "__hidden"}}))
    assert saved_paths({**flow, "metrics": [{"nodeId": "x", "timeField": "properties.t"}]}) >= {f"properties.{c}" for c in "abcdet"} and "__hidden" not in saved_paths(flow)


def test_offered_fields(spark):
    loaded = spark.createDataFrame([("a", "text", 5), ("b", "number", 0), ("c", "text", 0), ("d", "text", 1)], "path string, type string, populated long")
    known = spark.createDataFrame([("b", "number"), ("z", "string"), ("y", "date")], "path string, type string")
    pins = spark.createDataFrame([("c",), ("y",), ("gone",)], "path string")
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(offered_fields(loaded, known, pins)) == [("a", "text", 5, "records"), ("d", "text", 1, "records"), ("b", "number", None, "records"), ("c", "text", None, "records"), ("y", "date", None, "registry"), ("z", "string", None, "registry")]
    assert [r[0] for r in rows(offered_fields(loaded, known, pins, most=1))] == ["a", "c", "y"]
    presence = spark.createDataFrame([("a", 50), ("b", 2)], "path string, present long")
    assert rows(offered_fields(loaded, known, pins, presence)) == [("a", "text", 50, "records"), ("b", "number", 2, "records"), ("c", "text", 0, "records"), ("y", "date", None, "registry")]


def test_recompute_batch(spark):
    at = lambda d: datetime(2024, 1, d)
    stale = spark.createDataFrame([("new", None), ("new", at(9)), ("b", at(2)), ("a", at(2)), ("c", at(3))], "flow_id string, computed_at timestamp")
    costs = spark.createDataFrame([("new", 5.0), ("a", 3.0), ("b", 3.0), ("c", 1.0)], "flow_id string, seconds double")
    batch = lambda budget, costs=costs: [r["flow_id"] for r in G.recompute_batch(stale, costs, budget).orderBy("place").collect()]
    assert batch(0.5) == ["new"] and batch(5.0) == ["new"] and batch(5.1) == ["new", "a"] and batch(11.0) == ["new", "a", "b"] and batch(99.0) == ["new", "a", "b", "c"]
    assert batch(1.0, costs.limit(0)) == ["new", "a", "b", "c"] and G.recompute_batch(stale.limit(0), costs, 9.0).count() == 0


def test_visible_metrics(spark):
    ranks = spark.createDataFrame([("a", False), ("b", False), ("c", False), ("d", True), ("e", False), ("none", False)], "rank string, all_metrics boolean")
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("e", "d"), ("b", "gone")], "rank string, parent string")
    grants = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("gone", "9"), ("e", "5")], "rank string, metric string")
    got = {}
    for r in G.visible_metrics(ranks, links, grants).collect():
        got.setdefault(r["rank"], set()).add(r["metric"])
    assert got == {"a": {"1", "2", "3"}, "b": {"1", "2", "3"}, "c": {"1", "2", "3"}, "d": {None}, "e": {None}}


def test_schema_difference(spark):
    cols = "table string, column string, type string"
    expected = spark.createDataFrame([("t", "a", "int"), ("t", "b", "string"), ("u", "x", "int")], cols)
    live = spark.createDataFrame([("t", "a", "bigint"), ("t", "c", "int"), ("v", "y", "int")], cols)
    assert {tuple(r) for r in G.schema_difference(expected, live).collect()} == {("u", None, "missing table", None, None), ("v", None, "unexpected table", None, None), ("t", "b", "missing column", "string", None), ("t", "c", "unexpected column", None, "int"), ("t", "a", "type", "int", "bigint")}
    assert G.schema_difference(expected, expected).count() == 0


def test_drift_as_metrics_of_a_write(spark, tmp_path):
    df = spark.createDataFrame([("2024",), ("21/07/2026",), ("2024-01-02",), ("soon",), (None,), ("2024-02-30",)], "paid_at string")
    seen = Observation("drift")
    df.observe(seen, *G.drift_metrics(["paid_at"])).write.parquet(str(tmp_path / "t"))
    assert seen.get == {"paid_at loose only": 1, "paid_at strict only": 1, "paid_at divergent": 0}
    assert {tuple(r) for r in G.drift_counts(df, ["paid_at"]).collect()} == {("paid_at", "loose only", 1), ("paid_at", "strict only", 1)}


def test_source_of_a_connection(spark):
    """A step that names a connection alone reads its source, and that source's settings apply."""
    from millrace.plans.engine import run_flow
    from millrace.sources.records import EVENT_SCHEMA, EventStore

    names = [c.split()[0] for c in EVENT_SCHEMA.replace("struct<emails:array<string>,phones:array<string>>", "struct").split(", ")]
    row = lambda i, connection, source, p: tuple({"id": i, "event_id": i, "org_id": "o", "connection_id": connection, "source": source, "event_type": "deal", "occurred_at": datetime(2024, 1, 1), "properties": json.dumps({"p": p}), "sync_generation": 0}.get(c) for c in names)
    events = spark.createDataFrame([row("1", "c1", "crm", "x"), row("2", "c1", "crm", "y"), row("3", "c2", "crm", "x"), row("4", "c1", "mail", "x")], EVENT_SCHEMA)
    connections = spark.createDataFrame([("c1", "crm"), ("c2", "crm")], "id string, source string")
    flow = steps(("get", "app", {"connectionId": "c1", "sourceConfig": {"pipeline": "x"}}))
    settings = {"crm": {"pipeline": (("properties.p",), ())}}
    ids = lambda s: {r["id"] for r in run_flow(s, flow).df("get").collect()}
    assert ids(EventStore.stored(events, "o", settings, connections)) == {"1"} and ids(EventStore.stored(events, "o", settings)) == {"1", "2", "4"}


def test_totals_of_another_campaign_are_no_events(spark):
    from millrace.sources.connectors import normalize

    raw = spark.createDataFrame([("1", "c", '[{"campaign_id":"a","n":1},{"campaign_id":"b","n":2},{"n":3}]', datetime(2024, 1, 1))], "raw_id string, connection_id string, payload string, received_at timestamp")
    assert [r["event_id"] for r in normalize(raw, "instantly_totals", campaign="b")[0].collect()] == ["instantly:c:b:totals"]
    assert normalize(raw, "instantly_totals")[0].count() == 2
