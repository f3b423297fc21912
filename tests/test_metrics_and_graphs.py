from datetime import timedelta

import pytest
from flows import GET, NOW, event, rule, steps, store

from millrace.operators.windows import ms
from millrace.plans.graph import many_lanes, parse_graph, shape_of, validate_graph
from millrace.plans.metrics import Period, compute_aggregate, compute_funnel, distinct_event_types, distinct_sources, query_events

WEEK = Period(ms(NOW - timedelta(days=7)), ms(NOW))


def test_classic_aggregates(spark):
    s = store(spark, [event(days=d) for d in (1, 2, 3, 10)] + [event("reply", days=1), event("deal", value=100), event("deal", value=250, props={"plan": "pro"}), event("sms", "a"), event("sms", "a"), event("sms", "b", source="close")])
    one = lambda d, board=None: compute_aggregate(s, d, WEEK, board).first()[0]
    assert one({"eventType": "booked"}) == 3 and one({"aggregation": "sum", "eventType": "deal"}) == 350 and one({"aggregation": "sum", "eventType": "none"}) == 0
    assert one({"aggregation": "count_distinct", "eventType": "sms"}) == 2 and one({"eventType": "sms"}, "close") == 1
    assert one({"filters": {"rules": [rule("properties.plan", "equals", "pro")]}}) == 1
    trend = compute_aggregate(s, {"eventType": "booked", "timeBucket": "day"}, WEEK).orderBy("bucket").collect()
    assert [tuple(r) for r in trend] == [("2026-08-15", 1.0), ("2026-08-16", 1.0), ("2026-08-17", 1.0)]
    assert [r[0] for r in distinct_sources(s).collect()] == ["close", "webhook"] and [r[0] for r in distinct_event_types(s, "close").collect()] == ["sms"]
    assert [r["id"] for r in query_events(s, WEEK, event_type="booked", limit=2).collect()] == ["e0000", "e0001"]


def test_funnel(spark):
    s = store(spark, [event(k, x) for k, who in (("sms", "abcd"), ("booked", "abc"), ("showed", "ab")) for x in who])
    got = compute_funnel(s, [{"label": k, "eventType": k} for k in ("sms", "booked", "showed")], WEEK).orderBy("stage").collect()
    assert [(r["count"], r["conversion_from_first"], r["conversion_from_prev"], r["bottleneck"]) for r in got] == [(4, 1, 1, False), (3, 0.75, 0.75, True), (2, 0.5, 2 / 3, False)]
    none = compute_funnel(s, [{"label": "x", "eventType": "x"}, {"label": "y", "eventType": "y"}], WEEK).orderBy("stage").collect()
    assert [(r["count"], r["conversion_from_first"], r["bottleneck"]) for r in none] == [(0, 0, False), (0, 0, True)]


def test_tenants_and_tombstones(spark):
    from millrace.sources.records import EVENT_SCHEMA, EventStore

    row = lambda i, org, gone=None, props="{}": (str(i), str(i), org, "c", "s", "t", None, NOW, NOW, None, None, props, None, None, 0, gone, None)
    df = spark.createDataFrame([row(1, "a", props='{"x":"7"}'), row(2, "b"), row(3, "a", NOW)], EVENT_SCHEMA)
    settings = {"s": {"only": (("properties.x", "properties.y"), ("t",))}}
    s = EventStore.stored(df, "a", settings)
    assert [r["id"] for r in s.scan().df.collect()] == ["1"]
    ids = lambda **k: [r["id"] for r in s.scan(source="s", **k).df.collect()]
    assert ids(settings={"only": "7"}) == ["1"] and ids(settings={"only": "8"}) == [] and ids(settings={"only": " ", "odd": "1"}) == ["1"]
    assert ids(event_type="other") == [] and ids(event_type="t", settings={"only": "7"}) == ["1"]


def config(graph, node):
    return parse_graph(graph).nodes[node].config


def test_migrations():
    old = steps(GET, ("a", "aggregate", {"aggregation": "sum", "field": "properties.x"}), ("c", "combine", {}), ("x", "cross_reference", {"keepNodeId": "get", "mode": "missing"}))
    g = parse_graph(old)
    assert (g.nodes["a"].type, g.nodes["a"].config["op"], g.nodes["a"].config["field"]) == ("formula", "sum", "properties.x")
    assert g.nodes["c"].type == "filter" and (g.nodes["x"].type, g.nodes["x"].config["mode"], g.nodes["x"].config["matchMode"]) == ("unite", "match", "missing")
    pair = steps(("l", "app", {"eventType": "lead"}), ("t", "time_between", {"keyField": "k", "fromType": "lead", "toType": "call", "unit": "hours"}), ("n", "formula", {"op": "avg", "field": "properties.duration"}))
    assert config(pair, "t") == {"keyField": "k", "startField": "occurredAt", "startStep": "l", "endField": "occurredAt", "endStep": ""}
    assert config(pair, "n")["field"] == "properties.time_between.hours"
    assert config(steps(("g", "group", {"odd": 1})), "g") == {"mode": "field", "field": "source", "aggregation": "count", "valueField": "value", "distinctField": "subject", "categories": [], "fallbackLabel": "Other"}


def problems(*nodes, edges=None):
    return [m for _, m in validate_graph(parse_graph(steps(*nodes, edges=edges)))]


OK = ("get", "app", {"connectionId": "c"})
OUT = ("out", "output", {})


def test_validation():
    assert problems() == ["There are no steps yet; begin with Get data."]
    assert problems(OK, OUT) == []
    assert problems(OK) == ["No result is switched on."]
    assert problems(("get", "app", {}), OUT) == ["Choose an account for this Get data step."]
    assert "The steps form a loop." in problems(OK, ("a", "filter", {}), ("b", "filter", {}), OUT, edges=[("a", "b"), ("b", "a"), ("get", "out")])
    assert problems(OK, ("f", "formula", {"op": "divide", "aFixed": 1}), OUT) == ["Pick or type both numbers of this comparison."]
    assert problems(OK, ("g", "group", {}), ("f", "formula", {"op": "add", "bFixed": 1}), OUT, edges=[("get", "g"), ("g", "f", "a"), ("f", "out")]) == ["An input of this comparison is a list of numbers, not one."]
    assert problems(OK, ("m", "unite", {"mode": "match"}), OUT) == ["Wire two steps into this match, no more and no fewer."]
    assert problems(OK, ("f", "filter", {"rules": [rule("a", "equals", valueKind="field")]}), OUT) == ["Finish the conditions of this filter."]
    assert problems(OK, ("p", "paths", {}), OUT) == ["Add a branch to this split."]
    assert problems(OK, ("g", "group", {"mode": "categories"}), OUT) == ["Add a category to this group."]
    assert problems(OK, ("a", "formula", {"op": "sum"}), ("b", "formula", {"op": "max"}), OUT) == []
    two = [OK, ("h", "app", {"connectionId": "c"}), ("s", "unite", {}), ("t", "time_between", {"keyField": "k", "startField": "a", "endField": "b"}), OUT]
    assert len(problems(*two, edges=[("get", "s"), ("h", "s"), ("s", "t"), ("t", "out")])) == 1


@pytest.mark.parametrize(("kind", "config", "wanted"), [("app", {}, "dataset"), ("formula", {}, "scalar"), ("formula", {"op": "sum", "groupBy": {"type": "time"}}, "series"), ("calculate", {"mode": "breakdown"}, "grouped"), ("calculate", {"groupBy": {"type": "field"}}, "grouped"), ("group", {}, "grouped"), ("output", {}, "none"), ("calculate", {"mode": "compare"}, "scalar")])
def test_shapes(kind, config, wanted):
    assert shape_of(kind, config) == wanted


def test_lanes_and_order():
    g = parse_graph(steps(GET, ("f", "filter", {}), ("x", "formula", {"op": "count"}), ("y", "formula", {"op": "count"}), edges=[("get", "f"), ("f", "x"), ("get", "y")]))
    assert g.order("x") == ["get", "f", "x"] and not many_lanes(g, "x") and g.records_source("x").source == "f"
