"""Graphs of earlier step types: each row of the table, gaps below pairings, stale settings."""

import pytest
from flows import GET, steps

from millrace.plans.former import FORMER, without_stale_settings
from millrace.plans.graph import DEFAULTS, parse_graph, validate_graph


def of(graph, node="x"):
    n = parse_graph(graph).nodes[node]
    return n.type, n.config


@pytest.mark.parametrize(
    ("kind", "settings", "today", "expected"),
    [
        ("aggregate", {"aggregation": "median", "field": "f", "groupBy": {"type": "time"}}, "formula", {"op": "median", "field": "f", "distinctField": "subject", "groupBy": {"type": "time"}}),
        ("aggregate", {"aggregation": "mode"}, "formula", {"op": "count", "field": "value"}),
        ("combine", {"anything": 1}, "filter", {"combinator": "and", "rules": []}),
        ("formatter", {"template": "x"}, "filter", {"rules": []}),
        ("cross_reference", {"keepNodeId": "get", "keyField": "a", "lookupField": "b"}, "unite", {"mode": "match", "keepNodeId": "get", "keyField": "a", "lookupField": "b", "matchMode": "appears"}),
        ("cross_reference", {"mode": "missing"}, "unite", {"mode": "match", "matchMode": "missing", "keyField": ""}),
        ("time_between", {"keyField": "k", "start": {"rules": [{"field": "x", "op": "equals", "value": "no"}, {"field": "eventType", "op": "equals", "value": "lead"}]}, "end": {}}, "time_between", {"keyField": "k", "startField": "occurredAt", "startStep": "lead", "endField": "", "endStep": ""}),
        ("time_between", {"keyField": "k", "startField": "a", "endField": "b"}, "time_between", {"keyField": "k", "startField": "a", "endField": "b"}),
    ],
)
def test_rows(kind, settings, today, expected):
    found, config = of(steps(GET, ("lead", "app", {"eventType": "lead"}), ("x", kind, settings)))
    assert found == today and config == DEFAULTS[today] | expected


def test_rows_give_todays_settings_alone():
    assert all(today in DEFAULTS and readings.keys() <= DEFAULTS[today].keys() for today, readings in FORMER.values())


def test_gaps_are_read_under_their_new_name():
    nodes = [GET, ("t", "time_between", {"unit": "hours"}), ("u", "time_between", {"fromType": "a"}), ("f", "filter", {}), ("n", "formula", {"op": "avg", "field": "properties.duration", "distinctField": "properties.duration_hours"}), ("m", "formula", {"op": "avg", "field": "properties.duration_minutes"}), ("away", "formula", {"field": "properties.duration"})]
    g = parse_graph(steps(*nodes, edges=[("get", "t"), ("t", "f"), ("f", "n"), ("t", "u"), ("u", "m"), ("get", "away")]))
    assert g.nodes["n"].config["field"] == g.nodes["n"].config["distinctField"] == "properties.time_between.hours"
    assert g.nodes["m"].config["field"] == "properties.time_between.minutes" and g.nodes["away"].config["field"] == "properties.duration"


def test_loops_and_second_lists():
    g = parse_graph(steps(GET, ("c", "combine", {}), ("t", "time_between", {"unit": "days"}), ("n", "formula", {"field": "properties.duration"}), edges=[("get", "c"), ("n", "t"), ("t", "n"), ("get", "c", "src")]))
    assert len(g.into("c")) == 1 and g.nodes["n"].config["field"] == "properties.time_between.days"


def test_stale_settings_go():
    known = {"crm": {"pipeline": (("properties.p",), ("deal",)), "owner": (("properties.o",), ())}}
    config = {"source": "crm", "eventType": "lead", "sourceConfig": {"pipeline": "1", "owner": "2", "other": "3"}}
    assert without_stale_settings(config, known)["sourceConfig"] == {"owner": "2", "other": "3"}
    assert without_stale_settings(config | {"eventType": "deal"}, known)["sourceConfig"] == config["sourceConfig"]
    assert without_stale_settings(config | {"eventType": None}, known)["sourceConfig"] == {"owner": "2", "other": "3"}
    raw = {"nodes": [{"id": "a", "type": "app", "data": {"config": config}}]}
    assert parse_graph(raw, known).nodes["a"].config["sourceConfig"] == {"owner": "2", "other": "3"} and parse_graph(raw).nodes["a"].config["sourceConfig"] == config["sourceConfig"]


def test_every_problem_is_told():
    g = parse_graph(steps(("a", "app", {}), ("f", "filter", {"rules": [{"field": "", "op": "equals"}]}), ("odd", "teapot", {}), edges=[("f", "a"), ("gone", "f")]))
    assert {m for _, m in validate_graph(g)} >= {"A connection names step gone, which does not exist.", "No result is switched on.", "Nothing can be wired into Get data.", "Choose an account for this Get data step.", "Finish the conditions of this filter.", 'There is no step of type "teapot".', "Nothing is wired into this step."}
