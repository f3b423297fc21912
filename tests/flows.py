"""Small event stores and graphs for the tests."""

import json
from datetime import UTC, datetime, timedelta

from millrace.plans.engine import run_flow
from millrace.sources.records import EventStore

NOW = datetime(2026, 8, 18, 14, tzinfo=UTC)
SCHEMA = "id string, source string, eventType string, subject string, occurredAt timestamp, value double, currency string, connectionId string, properties string"


def event(kind="booked", subject=None, value=None, props=None, days=0.0, minutes=0.0, at=None, source="webhook", id=None):
    return {"id": id, "source": source, "eventType": kind, "subject": subject, "occurredAt": at or NOW - timedelta(days=days) + timedelta(minutes=minutes), "value": None if value is None else float(value), "currency": None, "connectionId": "c", "properties": json.dumps(props or {})}


def store(spark, rows):
    rows = [{**r, "id": r["id"] or f"e{i:04d}"} for i, r in enumerate(rows)]
    return EventStore(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA))


def steps(*nodes, edges=None):
    """A chain, or with the given (source, target[, targetHandle[, sourceHandle]])."""
    edges = edges if edges is not None else [(a[0], b[0]) for a, b in zip(nodes, nodes[1:])]
    wired = [{"source": e[0], "target": e[1], "targetHandle": e[2] if len(e) > 2 else None, "sourceHandle": e[3] if len(e) > 3 else None} for e in edges]
    return {"nodes": [{"id": i, "type": t, "data": {"config": c}} for i, t, c in nodes], "edges": wired}


def value(run, node):
    """The number of a step, or its error as text."""
    row = run.df(node).first()
    return row["error"] if row["error"] else row["value"]


def run(spark, rows, graph, now=NOW, until=None):
    return run_flow(store(spark, rows), graph, now, until)


def rule(field, op, value="", **more):
    return {"field": field, "op": op, "value": value, **more}


GET = ("get", "app", {})
