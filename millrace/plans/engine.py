"""Compiles a flow graph into lazy DataFrames, step by step. Nothing runs here.

A step's result is ``Ok`` or ``Err``; a step below an error is an error, other branches
go on. Errors that only the data can show travel in the plan: as the ``error`` column of
numbers, or as a check within a dataset that raises when its rows are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import DAY_MS
from millrace.operators import aggregates as A
from millrace.operators import combine as C
from millrace.operators.rules import never_comparable, rules
from millrace.operators.windows import Range, window
from millrace.plans.graph import AGGREGATIONS, Edge, Graph, Node, many_lanes, parse_graph
from millrace.sources.records import EventStore, Frame, field_of, within


@dataclass(frozen=True)
class Ok:
    shape: A.Shape
    #: Branch -> records, of a Split.
    lanes: dict[str, A.Dataset] = field(default_factory=dict)
    #: Counts of what the step did (one row), where it keeps them.
    report: DataFrame | None = None


@dataclass(frozen=True)
class Err:
    message: str


Result = Ok | Err


class StepError(ValueError):
    pass


@dataclass
class Run:
    """A compiled graph: its steps' results, and what is needed to look at them again by range."""

    graph: Graph
    now: datetime
    results: dict[str, Result]

    def ok(self, node: str) -> Ok:
        found = self.results.get(node)
        if isinstance(found, Ok):
            return found
        raise StepError(found.message if found else f"Step {node} was not run.")

    def frame(self, node: str) -> Frame:
        shape = self.ok(node).shape
        if not isinstance(shape, A.Dataset):
            raise StepError(f"Step {node} holds no records.")
        return shape.frame

    def df(self, node: str) -> DataFrame:
        """A step's rows: records, or bucket/label and value, or value and error."""
        shape = self.ok(node).shape
        return shape.frame.df if isinstance(shape, A.Dataset) else shape.df


@dataclass(frozen=True)
class _Input:
    edge: Edge
    shape: A.Shape


def _checked(frame: Frame, check: DataFrame, flag: str, message: str) -> Frame:
    """The frame's rows, or an error when they are read if the one-row ``check`` is true."""
    raised = check.select(F.when(F.coalesce(flag, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(True).alias("ok"))
    return frame.where(raised.scalar())


def _records(inputs: Sequence[_Input], what: str) -> Frame:
    if not inputs:
        raise StepError(f"{what}: nothing is wired into it.")
    if len(inputs) > 1:
        raise StepError(f"{what} reads one step, but {len(inputs)} are wired into it; stack them first.")
    if not isinstance(inputs[0].shape, A.Dataset):
        raise StepError(f"{what} reads records, not a {inputs[0].shape.kind}.")
    return inputs[0].shape.frame


def _app(node: Node, store: EventStore) -> Ok:
    c = node.config
    found = store.scan(c["connectionId"], c["source"], c["eventType"], settings=c["sourceConfig"])
    report = None
    if c["dedupe"]:
        report = C.keep_one_report(found, c["dedupeField"], c["dedupeOrderField"])
        found = C.keep_one(found, c["dedupeField"], c["dedupeKeep"], c["dedupeOrderField"])
    return Ok(A.Dataset(found.stamped(node.id)), report=report)


def _filter(node: Node, inputs: Sequence[_Input], now: datetime) -> Ok:
    frame, c = _records(inputs, "Filter"), node.config
    out, ranged = frame, c.get("dateRange") or {}
    if ranged.get("enabled"):
        out = out.where(within(frame, ranged.get("dateField") or "occurredAt", *window(ranged, now)))
    out = out.where(rules(frame, c))
    for both, message in never_comparable(frame, c):
        check = frame.df.agg(((F.count(F.lit(1)) > 0) & ~F.coalesce(F.bool_or(both), F.lit(False))).alias("bad"))
        out = _checked(out, check, "bad", message)
    return Ok(A.Dataset(out.stamped(node.id)))


def _time(node: Node, inputs: Sequence[_Input], now: datetime) -> Ok:
    frame = _records(inputs, "Date range")
    return Ok(A.Dataset(frame.where(within(frame, node.config["dateField"], *window(node.config, now))).stamped(node.id)))


def _time_between(node: Node, inputs: Sequence[_Input], lanes: bool) -> Ok:
    frame, c = _records(inputs, "Time between"), node.config
    if not (c["keyField"] and c["startField"] and c["endField"]):
        raise StepError("Time between: choose the key, the start and the stop.")
    report = C.time_between_report(frame, c)
    if lanes and not (c["startStep"] and c["endStep"]):
        frame = _checked(frame, C.mixed_steps(frame), "mixed", "Time between: records came from several steps; say which one starts and which one stops the clock.")
    return Ok(A.Dataset(C.time_between(frame, c).stamped(node.id)), report=report)


def _unite(node: Node, inputs: Sequence[_Input]) -> Ok:
    c = node.config
    if any(not isinstance(i.shape, A.Dataset) for i in inputs) or not inputs:
        raise StepError("Combine reads records; wire steps that hold some into it.")
    if c["mode"] != "match":
        return Ok(A.Dataset(C.stack([i.shape.frame for i in inputs]).stamped(node.id)))
    if len(inputs) != 2:
        raise StepError("A match reads two steps: the records to keep, and the list.")
    if not (c["keepNodeId"] and c["keyField"] and c["lookupField"]):
        raise StepError("Choose the records to keep and the two fields to match.")
    kept = next((i.shape.frame for i in inputs if i.edge.source == c["keepNodeId"]), None)
    if kept is None:
        raise StepError("The step whose records this match keeps is not wired into it.")
    listed = next(i.shape.frame for i in inputs if i.edge.source != c["keepNodeId"])
    out = C.match(kept, listed, c["keyField"], c["lookupField"], c["matchMode"])
    out = _checked(out, C.blank_list(listed, c["lookupField"]), "blank", f'No record of the list has a value in "{c["lookupField"]}".')
    return Ok(A.Dataset(out.stamped(node.id)), report=C.match_report(kept, listed, c["keyField"], c["lookupField"], c["matchMode"]))


def _paths(node: Node, inputs: Sequence[_Input], g: Graph) -> Ok:
    frame = _records(inputs, "Split")

    def conditions(p: dict) -> dict | None:
        if (p.get("filters") or {}).get("rules"):
            return p["filters"]
        edge = next((e for e in g.edges if e.source == node.id and e.source_handle == p["id"]), None)
        behind = g.nodes.get(edge.target) if edge else None
        return behind.config if behind and behind.type == "filter" else None

    lanes = C.paths(frame, node.config, {p["id"]: conditions(p) for p in node.config["paths"]})
    return Ok(A.Dataset(frame), {k: A.Dataset(v) for k, v in lanes.items()})


def _number(inputs: Sequence[_Input], side: str, c: dict, by: Sequence[str], ranges: DataFrame | None, spark) -> A.Scalar:
    """An operand: a number, how many records a step holds, one field of a single record, or a typed-in value."""
    found = next((i for i in inputs if i.edge.target_handle == side), None)
    if found is None:
        if c[f"{side}Fixed"] is None:
            raise StepError(f"Input {side.upper()} is not connected.")
        return A.constant(spark, c[f"{side}Fixed"])
    if isinstance(found.shape, A.Scalar):
        return found.shape
    if not isinstance(found.shape, A.Dataset):
        raise StepError(f"Input {side.upper()} is not one number.")
    if c[f"{side}Field"]:
        return A.single_field(found.shape.frame, c[f"{side}Field"], side.upper())
    return A.count_of(found.shape.frame, [b for b in by if b in found.shape.frame.df.columns], ranges)


def _calculated(node: Node, inputs: Sequence[_Input], spark, by: Sequence[str] = (), ranges: DataFrame | None = None) -> Ok:
    """Formula, Group and Calculate steps: what can be worked out again for a range."""
    c, kind = node.config, node.type
    if kind == "group":
        return Ok(A.group(_records(inputs, "Group"), c, by, ranges))
    mode = "number" if kind == "formula" and c["op"] in AGGREGATIONS else "compare" if kind == "formula" else c["mode"]
    if mode == "compare":
        return Ok(A.formula(c["op"], _number(inputs, "a", c, by, ranges, spark), _number(inputs, "b", c, by, ranges, spark), by))
    plain = [i for i in inputs if i.edge.target_handle is None and (kind != "formula" or isinstance(i.shape, A.Dataset))]
    frame = _records(plain[:1] if kind == "formula" else plain, "Calculate")
    if mode == "breakdown":
        how = c["aggregation"] if c["aggregation"] in ("sum", "count_distinct") else "count"
        return Ok(A.group(frame, {"mode": c["breakdownMode"], "field": c["breakdownField"], "aggregation": how, "valueField": c["field"], "distinctField": c["distinctField"], "categories": c["categories"], "fallbackLabel": c["fallbackLabel"]}, by, ranges))
    return Ok(A.aggregate(frame, {**c, "aggregation": c["op"] if kind == "formula" else c["aggregation"]}, by, ranges))


def _reads_records(node: Node) -> bool:
    c = node.config
    if node.type == "formula":
        return c["op"] in AGGREGATIONS
    return node.type == "group" or (node.type == "calculate" and c["mode"] != "compare")


def _reached_back(node: Node, inputs: list[_Input], g: Graph, get) -> list[_Input]:
    """A step that reads records below one that gives numbers reads the nearest records upstream."""
    if not _reads_records(node) or any(i.edge.target_handle is None and isinstance(i.shape, A.Dataset) for i in inputs):
        return inputs
    edge = g.records_source(node.id)
    found = get(edge) if edge else None
    if found is None:
        return inputs
    others = [i for i in inputs if i.edge.target_handle is not None]
    return [*others, _Input(replace(edge, target=node.id), found)]


def _shape_at(ok: Ok, edge: Edge) -> A.Shape:
    return ok.lanes.get(edge.source_handle, ok.shape) if edge.source_handle else ok.shape


def run_flow(store: EventStore, graph: Graph | dict, now: datetime | None = None, until: str | None = None, watch: Callable[[str, DataFrame], DataFrame] | None = None) -> Run:
    """Compiles a graph, or what one of its steps needs. ``now`` is the clock of its windows.
    ``watch`` may put something around the records of each step, such as an observation."""
    g = graph if isinstance(graph, Graph) else parse_graph(graph)
    now, spark = now or datetime.now(UTC), store.df.sparkSession
    run = Run(g, now, {})
    for name in g.order(until):
        node, edges = g.nodes[name], g.into(name)
        try:
            inputs = [_Input(e, _shape_at(run.ok(e.source), e)) for e in edges]
            inputs = _reached_back(node, inputs, g, lambda e: _shape_at(run.ok(e.source), e))
            kind = node.type
            if kind == "app":
                out = _app(node, store)
            elif kind == "filter":
                out = _filter(node, inputs, now)
            elif kind == "time":
                out = _time(node, inputs, now)
            elif kind == "time_between":
                out = _time_between(node, inputs, many_lanes(g, name))
            elif kind == "unite":
                out = _unite(node, inputs)
            elif kind == "paths":
                out = _paths(node, inputs, g)
            elif kind == "output":
                if not inputs:
                    raise StepError("Nothing is wired into this result.")
                out = Ok(inputs[0].shape)
            elif kind in ("formula", "group", "calculate"):
                out = _calculated(node, inputs, spark)
            else:
                raise StepError(f'There is no step of type "{kind}".')
            if watch and isinstance(out.shape, A.Dataset) and kind != "output":
                out = replace(out, shape=A.Dataset(replace(out.shape.frame, df=watch(name, out.shape.frame.df))))
        except StepError as e:
            out = Err(str(e))
        run.results[name] = out
    return run


# ---- the same step, through dashboard ranges -----------------------------------------


@dataclass(frozen=True)
class Ranged:
    """A step's shape for several ranges in one pass (a row or more per ``_range``), and
    how many records had no date, per range and windowed step."""

    shape: A.Shape
    undated: list[DataFrame]
    moments: list[DataFrame]


def _in_ranges(frame: Frame, time_field: str | None, ranges: Sequence[Range]) -> tuple[Frame, DataFrame, DataFrame]:
    """Each record once for every range that holds it. The date is the time field if any
    record here has it, else occurredAt; records without a date are in none but ``all``."""
    own = field_of(frame, time_field).ms if time_field and time_field != "occurredAt" else None
    at = field_of(frame, "occurredAt").ms
    if own is not None:
        used = frame.df.select(F.coalesce(F.bool_or(own.isNotNull()), F.lit(False)).alias("u")).scalar()
        at = F.when(used, own).otherwise(at)
    inside = [F.when(F.lit(True) if r.all else (at >= int(r.start)) & (at <= int(r.end)), r.key) for r in ranges]
    dated = frame.df.withColumn("_at", at)
    df = dated.withColumn("_range", F.explode(F.array_compact(F.array(*inside))))
    return replace(frame, df=df.drop("_at")), dated.where("_at is null"), dated.where("_at is not null").select("_at")


def ranged(run: Run, node: str, ranges: Sequence[Range], time_field: str | None = None) -> Ranged:
    """A result step's shape for every range, from one pass over its records. The flow's own
    logic has run over everything; a range keeps the records of the period at the nearest
    datasets and only the arithmetic below them is done again."""
    g, spark = run.graph, next(r.shape for r in run.results.values() if isinstance(r, Ok))
    session = (spark.frame.df if isinstance(spark, A.Dataset) else spark.df).sparkSession
    keys = session.createDataFrame([(r.key,) for r in ranges], "_range string")
    memo: dict[tuple[str, str | None], A.Shape] = {}
    undated, moments = [], []

    def shape(edge_source: str, handle: str | None) -> A.Shape:
        lane = handle if handle in run.ok(edge_source).lanes else None
        if (edge_source, lane) not in memo:
            memo[edge_source, lane] = work(edge_source, lane)
        return memo[edge_source, lane]

    def work(name: str, lane: str | None) -> A.Shape:
        ok, n = run.ok(name), g.nodes[name]
        found = ok.lanes[lane] if lane else ok.shape
        if n.type != "output" and isinstance(found, A.Dataset):
            frame, none, at = _in_ranges(found.frame, time_field, ranges)
            undated.append(none)
            moments.append(at)
            return A.Dataset(frame)
        inputs = []
        for e in g.into(name):
            read = n.type in ("formula", "calculate") and e.target_handle in ("a", "b") and n.config.get(f"{e.target_handle}Field")
            # A field that is read from one record is a state, not a period's records.
            inputs.append(_Input(e, _shape_at(run.ok(e.source), e) if read else shape(e.source, e.source_handle)))
        if n.type == "output":
            return inputs[0].shape
        inputs = _reached_back(n, inputs, g, lambda e: shape(e.source, e.source_handle))
        return _calculated(n, inputs, session, ["_range"], keys).shape

    out = shape(node, None)
    if isinstance(out, A.Dataset):
        out = A.count_of(out.frame, ["_range"], keys)
    elif isinstance(out, A.Scalar) and "_range" not in out.df.columns:
        out = A.Scalar(keys.crossJoin(F.broadcast(out.df)))  # typed-in numbers alone: one row for each range
    return Ranged(out, undated, moments)


def undated_of(found: Ranged) -> Column | None:
    """How many records had no date, over all windowed steps, as a scalar."""
    counts = [d.select(F.count(F.lit(1)).alias("n")).scalar() for d in found.undated]
    return sum(counts[1:], counts[0]) if counts else None


def next_change(found: Ranged, ranges: Sequence[Range], now_ms: int) -> DataFrame:
    """at: when the numbers can next change without new data (one row): the next midnight,
    a record that is still to come, or one that leaves a rolling range."""
    midnight = (now_ms // DAY_MS + 1) * DAY_MS
    out = found.shape.df.sparkSession.range(1).select(F.lit(midnight).alias("at"))  # also where nothing is windowed
    for d in found.moments:
        t = F.col("_at")
        leaves = [F.min(F.when((t <= now_ms) & (t + r.rolling > now_ms), t + r.rolling)) for r in ranges if r.rolling]
        one = d.agg(F.least(F.lit(midnight), F.min(F.when(t > now_ms, t)), *leaves).alias("at"))
        out = out.union(one)
    return out.agg(F.min("at").alias("at"))
