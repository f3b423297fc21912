"""Flow graphs: parsing, migration of older shapes, validation, static shapes.

A graph is {nodes: [{id, type, data: {config}}], edges: [{source, target, sourceHandle,
targetHandle}], metrics: [...]}. All of this is small and runs on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from millrace.operators.aggregates import AGGREGATIONS
from millrace.plans.former import in_todays_terms, without_stale_settings

PRODUCERS = frozenset(("app", "filter", "time", "time_between", "paths", "unite"))

# What a step's settings are where the graph does not say.
DEFAULTS = {
    "app": {"connectionId": None, "source": None, "eventType": None, "sourceConfig": {}, "dedupe": False, "dedupeField": "subject", "dedupeKeep": "latest", "dedupeOrderField": "occurredAt"},
    "filter": {"combinator": "and", "rules": [], "dateRange": None},
    "time": {"dateField": "occurredAt", "mode": "preset", "preset": "last_30_days", "days": 30},
    "time_between": {"keyField": "", "startField": "", "startStep": "", "endField": "", "endStep": ""},
    "unite": {"mode": "stack", "keepNodeId": "", "keyField": "", "lookupField": "", "matchMode": "appears"},
    "formula": {"op": "percentage", "resultKind": "number", "durationUnit": "minutes", "durationDisplay": "auto", "aFixed": None, "bFixed": None, "aField": None, "bField": None, "field": "value", "extraFields": [], "distinctField": "subject", "groupBy": None},
    "group": {"mode": "field", "field": "source", "aggregation": "count", "valueField": "value", "distinctField": "subject", "categories": [], "fallbackLabel": "Other"},
    "calculate": {"mode": "number", "aggregation": "count", "field": "value", "distinctField": "subject", "groupBy": None, "breakdownMode": "field", "breakdownField": "source", "categories": [], "fallbackLabel": "Other", "op": "percentage", "aFixed": None, "bFixed": None, "aField": None, "bField": None, "extraFields": []},
    "paths": {"paths": [], "fallbackId": None, "fallbackLabel": None},
    "output": {"name": "Result", "description": None, "viz": "number", "format": "number", "unit": None, "durationDisplay": "auto", "currency": "USD", "precision": 0, "target": None},
}
METRIC = {"enabled": True, "name": "Result", "viz": "number", "format": "number", "unit": None, "currency": "USD", "precision": 0, "target": None, "timeField": None, "timeUnit": "month"}


@dataclass(frozen=True)
class Node:
    id: str
    type: str
    config: dict


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    source_handle: str | None = None
    target_handle: str | None = None


@dataclass(frozen=True)
class Graph:
    nodes: dict[str, Node]
    edges: tuple[Edge, ...]
    metrics: tuple[dict, ...] = field(default_factory=tuple)

    def into(self, node: str) -> list[Edge]:
        return [e for e in self.edges if e.target == node]

    def order(self, until: str | None = None) -> list[str]:
        """Steps so that each comes after what feeds it; only those that ``until`` needs, if given."""
        wanted = self.ancestors(until) | {until} if until else set(self.nodes)
        sorter = TopologicalSorter({n: [e.source for e in self.into(n) if e.source in self.nodes] for n in self.nodes if n in wanted})
        return [n for n in sorter.static_order() if n in self.nodes]

    def ancestors(self, node: str) -> set[str]:
        seen, todo = set(), [node]
        while todo:
            for e in self.into(todo.pop()):
                if e.source not in seen:
                    seen.add(e.source)
                    todo.append(e.source)
        return seen

    def has_cycle(self) -> bool:
        try:
            self.order()
        except CycleError:
            return True
        return False

    def records_source(self, node: str) -> Edge | None:
        """The nearest step upstream, along plain edges, that gives records."""
        seen, front = {node}, [e for e in self.into(node) if e.target_handle is None]
        while front:
            further = []
            for e in front:
                if e.source in seen:
                    continue
                seen.add(e.source)
                if e.source in self.nodes and self.nodes[e.source].type in PRODUCERS:
                    return e
                further += [x for x in self.into(e.source) if x.target_handle is None]
            front = further
        return None


# ---- parsing and migration --------------------------------------------------------


def parse_graph(raw: dict | None, settings: dict | None = None) -> Graph:
    """A graph with its older shapes migrated, its defaults filled in and unknown settings left
    out. ``settings`` (an ``EventStore``'s) tell which settings of a Get data step are stale."""
    raw = raw or {}
    nodes, edges = in_todays_terms(list(raw.get("nodes") or []), list(raw.get("edges") or []))
    if settings:
        nodes = [n | {"config": without_stale_settings(n["config"], settings)} if n["type"] == "app" else n for n in nodes]
    known = lambda n: {**DEFAULTS[n["type"]], **{k: v for k, v in n["config"].items() if k in DEFAULTS[n["type"]] or k in ("from", "to")}} if n["type"] in DEFAULTS else n["config"]
    metrics = tuple({**METRIC, **{k: v for k, v in m.items() if k in METRIC or k == "nodeId"}} for m in raw.get("metrics") or [])
    return Graph({n["id"]: Node(n["id"], n["type"], known(n)) for n in nodes}, tuple(Edge(e["source"], e["target"], e.get("sourceHandle"), e.get("targetHandle")) for e in edges), metrics)


# ---- shapes and validation ---------------------------------------------------------


def _split_shape(group_by: dict | None) -> str:
    return {"time": "series", "field": "grouped"}.get((group_by or {}).get("type"), "scalar")


def shape_of(kind: str, config: dict) -> str:
    """What a step gives out, told from its settings alone: dataset, scalar, series, grouped or none."""
    if kind in PRODUCERS:
        return "dataset"
    if kind == "group":
        return "grouped"
    if kind == "formula":
        return _split_shape(config.get("groupBy")) if config.get("op", "percentage") in AGGREGATIONS else "scalar"
    if kind == "calculate":
        mode = config.get("mode", "number")
        return {"compare": "scalar", "breakdown": "grouped"}.get(mode) or _split_shape(config.get("groupBy"))
    return "none"


def many_lanes(g: Graph, node: str) -> bool:
    """Records may reach the step down more than one way."""
    above = g.ancestors(node)
    joins = any(len(g.into(n)) > 1 for n in above | {node}) or any(g.nodes[n].type in ("unite", "paths") for n in above if n in g.nodes)
    return joins or sum(g.nodes[n].type == "app" for n in above if n in g.nodes) > 1


def _gaps(rules: Iterable[dict]) -> bool:
    return any(r.get("valueKind") == "field" and not str(r.get("valueField") or "").strip() for r in rules)


@dataclass(frozen=True)
class _Step:
    """A step as its checks see it: its settings, what is wired into it, and the shapes of that."""

    graph: Graph
    node: Node

    @property
    def config(self) -> dict:
        return self.node.config

    @property
    def edges(self) -> list[Edge]:
        return [e for e in self.graph.into(self.node.id) if e.source in self.graph.nodes]

    def shape(self, edge: Edge) -> str:
        above = self.graph.nodes[edge.source]
        return shape_of(above.type, above.config)

    def lacks_records(self) -> bool:
        return any(self.shape(e) != "dataset" for e in self.edges) and not self.graph.records_source(self.node.id)


def _fed(s: _Step) -> Iterator[str]:
    if not s.edges:
        yield "Nothing is wired into this step."
    elif s.lacks_records():
        yield "What is wired into this step holds no records."


def _get_data(s: _Step) -> Iterator[str]:
    if s.edges:
        yield "Nothing can be wired into Get data."
    if not s.config.get("connectionId"):
        yield "Choose an account for this Get data step."


def _keeps(s: _Step) -> Iterator[str]:
    rules = s.config["rules"]
    if _gaps(rules) or not all(r.get("field") and r.get("op") for r in rules):
        yield "Finish the conditions of this filter."


def _pairs(s: _Step) -> Iterator[str]:
    if not all(s.config[k] for k in ("keyField", "startField", "endField")):
        yield "Choose the key, the start and the stop of this pairing."
    elif not (s.config["startStep"] and s.config["endStep"]) and many_lanes(s.graph, s.node.id):
        yield "Records come here in several ways: say which step starts and which one stops the clock."


def _matches(s: _Step) -> Iterator[str]:
    if s.config["mode"] != "match":
        return
    if len(s.edges) != 2:
        yield "Wire two steps into this match, no more and no fewer."
    elif not all(s.config[k] for k in ("keepNodeId", "keyField", "lookupField")):
        yield "Choose the records to keep and the two fields to match."
    elif s.config["keepNodeId"] not in {e.source for e in s.edges}:
        yield "The step whose records this match keeps is not wired into it."


def _conditions(parts: Iterable[dict]) -> bool:
    return any(_gaps((p.get("filters") or {}).get("rules") or []) for p in parts)


def _branches(s: _Step) -> Iterator[str]:
    if not s.config["paths"]:
        yield "Add a branch to this split."
    elif _conditions(s.config["paths"]):
        yield "Choose the field that a branch condition compares with."


def _categories(s: _Step) -> Iterator[str]:
    if s.config["mode"] == "categories" and not s.config["categories"]:
        yield "Add a category to this group."
    elif s.config["mode"] == "categories" and _conditions(s.config["categories"]):
        yield "Choose the field that a category condition compares with."


def _numbers(s: _Step) -> Iterator[str]:
    """Two numbers to compare, or records to calculate with."""
    compares = s.config["op"] not in AGGREGATIONS if s.node.type == "formula" else s.config["mode"] == "compare"
    if not compares:
        if s.lacks_records() or all(e.target_handle is not None for e in s.edges):
            yield "There are no records for this step to calculate with."
        return
    wired = {side: [e for e in s.edges if e.target_handle == side] for side in "ab"}
    if any(len(found) > 1 or not found and s.config.get(f"{side}Fixed") is None for side, found in wired.items()):
        yield "Pick or type both numbers of this comparison."
    for e in (*wired["a"], *wired["b"]):
        if s.shape(e) not in ("scalar", "dataset"):
            yield "An input of this comparison is a list of numbers, not one."


def _shows(s: _Step) -> Iterator[str]:
    if not s.edges:
        yield "Nothing is wired into this result."


#: Step type -> what is checked of it.
CHECKS: dict[str, tuple[Callable[[_Step], Iterator[str]], ...]] = {
    "app": (_get_data,), "filter": (_fed, _keeps), "time": (_fed,), "time_between": (_fed, _pairs), "unite": (_fed, _matches),
    "paths": (_fed, _branches), "group": (_fed, _categories), "formula": (_numbers,), "calculate": (_numbers,), "output": (_shows,),
}


def validate_graph(g: Graph) -> list[tuple[str | None, str]]:
    """(step or None, problem) for all that keeps the graph from being published."""
    if not g.nodes:
        return [(None, "There are no steps yet; begin with Get data.")]
    ends = dict.fromkeys(x for e in g.edges for x in (e.source, e.target) if x not in g.nodes)
    whole = [f"A connection names step {x}, which does not exist." for x in ends]
    if g.has_cycle():
        whole.append("The steps form a loop.")
    if not any(n.type == "output" for n in g.nodes.values()) and not any(m["enabled"] for m in g.metrics):
        whole.append("No result is switched on.")
    unknown = lambda s: [f'There is no step of type "{s.node.type}".']
    each = [(n.id, text) for n in g.nodes.values() for check in CHECKS.get(n.type, (unknown,)) for text in check(_Step(g, n))]
    return [(None, text) for text in whole] + each
