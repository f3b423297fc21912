"""Graphs that were saved under earlier step types, in today's.

``FORMER`` has a row for each earlier type: today's type, and a reading of the earlier
settings for each of today's. Two things depend on other steps and are looked up in the
graph: which step reads a record type (an earlier pairing named types, today's names steps),
and which pairing stands above a step that reads a gap under its earlier name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from millrace.operators.aggregates import AGGREGATIONS, FORMULAS

#: A setting's reading: from the earlier settings and the Get data step of each record type.
Reading = Callable[[dict, dict[str, str]], object]


def _text(name: str, otherwise: str = "") -> Reading:
    return lambda was, _: was.get(name) or otherwise


def _one_of(name: str, known: Iterable[str], otherwise: str) -> Reading:
    return lambda was, _: was[name] if was.get(name) in known else otherwise


def _always(value: object) -> Reading:
    return lambda *_: value


def _record_type(was: dict, name: str, rules: str) -> str:
    """An earlier pairing named a record type, or had conditions that one of the conditions names it in."""
    stated = [r.get("value") for r in (was.get(rules) or {}).get("rules") or [] if (r.get("field"), r.get("op")) == ("eventType", "equals")]
    return next((x for x in (was.get(name), *stated) if x), "")


def _clock(name: str, rules: str) -> tuple[Reading, Reading]:
    """The field that starts or stops a clock, and the step whose records do."""
    return lambda was, _: "occurredAt" if _record_type(was, name, rules) else "", lambda was, reads: reads.get(_record_type(was, name, rules), "")


_PASS: dict[str, Reading] = {"combinator": _always("and"), "rules": _always([])}
(_START, _START_STEP), (_STOP, _STOP_STEP) = _clock("fromType", "start"), _clock("toType", "end")
FORMER: dict[str, tuple[str, dict[str, Reading]]] = {
    "aggregate": ("formula", {"op": _one_of("aggregation", (*AGGREGATIONS, *FORMULAS), "count"), "field": _text("field", "value"), "distinctField": _text("distinctField", "subject"), "groupBy": lambda was, _: was.get("groupBy")}),
    "combine": ("filter", _PASS),
    "formatter": ("filter", _PASS),
    "cross_reference": ("unite", {"mode": _always("match"), "keepNodeId": _text("keepNodeId"), "keyField": _text("keyField"), "lookupField": _text("lookupField"), "matchMode": _one_of("mode", ("missing",), "appears")}),
    "pairing of types": ("time_between", {"keyField": _text("keyField"), "startField": _START, "startStep": _START_STEP, "endField": _STOP, "endStep": _STOP_STEP}),
}
#: Settings that only a pairing of record types had.
_TYPED = frozenset(("fromType", "toType", "start", "end", "mode", "unit"))
#: The handle at which a combine took a second list, which its successor does not have.
_SECOND_LIST = "src"
#: An earlier gap was read under this name, alone or with its unit.
_GAP = "properties.duration"


def _former_type(kind: str, settings: dict) -> str | None:
    if kind == "time_between":
        return "pairing of types" if _TYPED & settings.keys() else None
    return kind if kind in FORMER else None


def _nearest_above(step: str, wanted: dict[str, str], edges: list[dict]) -> str | None:
    """The first of the wanted steps on the way up from a step, level by level."""
    above = {x["target"]: set() for x in edges}
    for x in edges:
        above[x["target"]].add(x["source"])
    level, seen = above.get(step, set()), {step}
    while level:
        if found := sorted(level & wanted.keys()):
            return found[0]
        seen |= level
        level = set().union(*(above.get(n, set()) for n in level)) - seen
    return None


def in_todays_terms(nodes: list[dict], edges: list[dict]) -> tuple[list[dict], list[dict]]:
    """Steps as {id, type, config} and edges, of steps with {id, type, data: {config}}."""
    settings = {n["id"]: dict((n.get("data") or {}).get("config") or {}) for n in nodes}
    was = {n["id"]: _former_type(n["type"], settings[n["id"]]) for n in nodes}
    reads: dict[str, str] = {}
    for n in nodes:
        if n["type"] == "app" and settings[n["id"]].get("eventType"):
            reads.setdefault(settings[n["id"]]["eventType"], n["id"])

    def made(n: dict) -> dict:
        kind, own = n["type"], settings[n["id"]]
        if former := was[n["id"]]:
            kind, readings = FORMER[former]
            own = {k: read(own, reads) for k, read in readings.items()}
        return {"id": n["id"], "type": kind, "config": own}

    out = [made(n) for n in nodes]
    edges = [x for x in edges if (x.get("targetHandle"), was.get(x["target"])) != (_SECOND_LIST, "combine")]
    units = {i: settings[i].get("unit") or "minutes" for i, former in was.items() if former == "pairing of types"}
    for step in out if units else ():
        gaps = [k for k in ("field", "distinctField") if str(step["config"].get(k) or "").startswith(_GAP)]
        unit = units.get(_nearest_above(step["id"], units, edges) or "") if gaps else None
        step["config"] |= {k: f"properties.time_between.{unit}" for k in gaps if unit and step["config"][k] in (_GAP, f"{_GAP}_{unit}")}
    return out, edges


def without_stale_settings(config: dict, known: dict) -> dict:
    """A Get data step's settings without those of record types that it no longer reads. known:
    source -> setting -> (paths, record types it is for; none: for all)."""
    of_source = known.get(config.get("source") or "", {})
    kind = config.get("eventType")
    stale = {k for k, (_, kinds) in of_source.items() if kinds and kind not in kinds}
    return config | {"sourceConfig": {k: v for k, v in (config.get("sourceConfig") or {}).items() if k not in stale}}
