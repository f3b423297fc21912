import json
import re
from datetime import timedelta

from flows import GET, NOW, event, steps, store
from pyspark.sql import functions as F

from millrace.plans.graph import parse_graph
from millrace.sources.connectors import normalize
from millrace.sources.records import EVENT_SCHEMA
from millrace.sources.registry import fields_seen, infer_fields, merge_registry, presence_by_path
from millrace.streaming.ingest import EventTable, Ingestion, counts, expired_tombstones, latest, prepared, restamp, restore_connection, retire_absent, retire_connection, retire_older, retire_outside, upsert
from millrace.streaming.materialize import expired, materialize, merge_results, moves_with_clock, reads, stale_for

RAW = "raw_id string, connection_id string, payload string, received_at timestamp, delivery string"


def row(id="a", gen=1, gone=None, subject="s", at=NOW, conn="c", stream="m", props="{}"):
    return (id, id, "o", conn, "s", "t", subject, at, NOW, None, None, props, None, None, gen, gone, stream)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT_SCHEMA)


def merged(spark, old, new, **more):
    out = upsert(frame(spark, *old), frame(spark, *new), **more)
    return tuple(counts(out).first()), out.drop("action").collect()


def test_rows_of_a_batch_are_dealt_once(spark):
    """Both sides of a merge stay where one-of-each put them; only that deals them by event_id."""
    one = latest(frame(spark, row(), row("b")).repartition(3))
    plan = upsert(one, latest(frame(spark, row("c")).repartition(3)))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 2


def test_a_payload_is_parsed_once(spark):
    """No filter parses it before the events are made of it; what is no object or array gives no event."""
    raw = spark.createDataFrame([(str(i), "c", p, NOW) for i, p in enumerate(('{"id":"a"}', '[{"id":"b"},{"id":"c"}]', "[]", "1", "broken", None))], "raw_id string, connection_id string, payload string, received_at timestamp")
    events, failures = normalize(raw, "webhook")
    assert {r[0] for r in events.select("event_id").collect()} == {f"webhook:c:{i}" for i in "abc"}
    assert {r[0] for r in failures.select("raw_id").collect()} == {"3", "4", "5"}
    plan = events.select("event_id")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"parseJson\(payload#", plan)) == 1


def test_buckets_are_written_once(spark, tmp_path):
    """A write is moved into the table and not copied there; nothing staged is left, and equal rows rewrite no file."""
    table = EventTable(spark, str(tmp_path / "t"), buckets=2)
    assert table.upsert(frame(spark, row(), row("b"))) == {"inserted": 2, "updated": 0, "deduped": 0}
    files = {p.name for p in (tmp_path / "t" / "events").rglob("*.parquet")}
    assert table.upsert(frame(spark, row(), row("b"))) == {"inserted": 0, "updated": 0, "deduped": 2}
    assert {p.name for p in (tmp_path / "t" / "events").rglob("*.parquet")} == files
    assert table.tombstone(frame(spark, row("b")).select("event_id"), F.lit(NOW).cast("timestamp")) == 1
    assert {r["event_id"]: r["deleted_at"] is None for r in table.read().collect()} == {"a": True, "b": False}
    assert not list((tmp_path / "t" / "staged").iterdir()) and not list((tmp_path / "t" / "batches").iterdir())


def test_upsert(spark):
    assert merged(spark, [], [row()])[0] == (1, 0, 0)
    assert merged(spark, [row()], [row()])[0] == (0, 0, 1)
    assert merged(spark, [row()], [row(subject="new")])[0] == (0, 1, 0)
    assert merged(spark, [row(subject=None)], [row(subject=None)])[0] == (0, 0, 1)
    n, (kept,) = merged(spark, [row(gen=3, gone=NOW, subject="old")], [row(gen=2, subject="new")])
    assert n == (0, 0, 1) and (kept["sync_generation"], kept["subject"], kept["deleted_at"] is not None) == (3, "old", True)
    n, (back,) = merged(spark, [row(gen=2, gone=NOW)], [row(gen=2)])
    assert n == (0, 1, 0) and back["deleted_at"] is None
    n, (up,) = merged(spark, [row(gen=1)], [row(gen=5)])
    assert n == (0, 1, 0) and up["sync_generation"] == 5
    assert merged(spark, [row(gen=5)], [row(gen=4)])[0] == (0, 0, 1)
    assert merged(spark, [row()], [row(conn="other", subject="x")])[0] == (0, 0, 1)
    later = NOW + timedelta(hours=1)
    n, (pinned,) = merged(spark, [row()], [row(at=later, subject="x")], pin_time=True)
    assert n == (0, 1, 0) and pinned["occurred_at"] == NOW.replace(tzinfo=None)
    assert merged(spark, [row()], [row(at=later)], pin_time=True)[0] == (0, 0, 1)


def ids(df):
    return sorted(r["event_id"] for r in df.where("deleted_at is null").collect())


def test_retiring(spark):
    old = [row("a"), row("b", at=NOW - timedelta(days=9)), row("c", stream="x"), row("d", conn="k", gen=0), row("e", stream=None, gen=3)]
    stored, now = frame(spark, *old), F.lit(NOW)
    seen = spark.createDataFrame([("a",)], "event_id string")
    assert ids(retire_absent(stored, seen, "c", "m", now)) == ["a", "c", "d", "e"]
    assert ids(retire_absent(stored, seen.limit(0), "c", "m", now, (F.lit(NOW - timedelta(days=1)), F.lit(NOW)))) == ["b", "c", "d", "e"]
    assert ids(retire_outside(stored, "c", "m", F.lit(NOW - timedelta(days=1)), F.lit(NOW), now)) == ["a", "c", "d", "e"]
    assert ids(retire_older(stored, "c", 3, now)) == ["d", "e"]
    gone = retire_connection(stored, "c", now)
    assert ids(gone) == ["d"] and ids(restore_connection(gone, "c", F.lit(NOW))) == ["a", "b", "c", "d", "e"]
    assert expired_tombstones(gone, F.lit(NOW + timedelta(days=1))).count() == 1
    moved = restamp(stored, spark.createDataFrame([("b", None), ("a", NOW - timedelta(days=3))], "event_id string, occurred_at timestamp"))
    assert {r["event_id"]: r["occurred_at"] for r in moved.collect() if r["event_id"] in "ab"} == {"a": (NOW - timedelta(days=3)).replace(tzinfo=None), "b": NOW.replace(tzinfo=None)}


def normalised(spark, source, *payloads, delivery=None, **options):
    raw = spark.createDataFrame([(str(i), "c", p if isinstance(p, str) or p is None else json.dumps(p), NOW, delivery) for i, p in enumerate(payloads)], RAW)
    return [df.collect() for df in normalize(raw, source, **options)]


def test_webhooks(spark):
    found, failed = normalised(spark, "webhook", {"id": 7, "type": "sale", "email": "a@b.c", "amount": "12.5", "date": "7/21/2026"}, [{"uuid": "x"}, 5], "nope", None, delivery="d")
    by = {r["event_id"]: r for r in found}
    assert set(by) == {"webhook:c:7", "webhook:c:x", "webhook:c:delivery:d:1"} and len(failed) == 2
    sale = by["webhook:c:7"]
    assert (sale["event_type"], sale["subject"], sale["value"], sale["occurred_at"].isoformat()) == ("sale", "a@b.c", 12.5, "2026-07-21T00:00:00")
    assert by["webhook:c:x"]["event_type"] == "webhook.received" and by["webhook:c:x"]["occurred_at"] == NOW.replace(tzinfo=None)
    a, b = normalised(spark, "webhook", {"x": 1, "y": [2]}, {"y": [2], "x": 1})[0]
    assert a["event_id"] == b["event_id"] and a["event_id"].startswith("webhook:c:")
    at = normalised(spark, "webhook", {"id": 1, "data": {"booked_on": "2026-01-02"}}, time_key="data.booked_on")[0][0]["occurred_at"]
    assert at.isoformat() == "2026-01-02T00:00:00"


def test_providers(spark):
    one = lambda source, payload, **o: normalised(spark, source, payload, **o)[0][0]
    call = one("close", {"id": "e1", "object_type": "activity.call", "action": "created", "date_created": "2026-01-02T03:04:05Z", "data": {"lead_name": "Ann"}})
    assert (call["event_id"], call["event_type"], call["subject"], call["occurred_at"].hour) == ("close:c:e1", "call_logged", "Ann", 3)
    met = one("calendly_meeting", {"uri": "u", "name": "Intro", "status": "canceled", "start_time": "2026-01-02T10:00:00Z", "updated_at": "2026-01-01T09:00:00Z", "created_at": "2025-12-30", "event_memberships": [{"user_email": "h@x.y"}]})
    facts = json.loads(met["properties"])
    assert (met["event_id"], met["event_type"], facts["host_email"], facts["canceled_at"], facts["name"]) == ("calendly:c:canceled:u", "canceled", "h@x.y", "2026-01-01T09:00:00Z", "Intro")
    invite = one("calendly", {"event": "invitee.created", "payload": {"email": "a@b.c", "scheduled_event": {"uri": "v", "start_time": "2026-01-02T10:00:00Z"}}})
    assert (invite["event_id"], invite["event_type"], invite["subject"]) == ("calendly:c:v", "booked", "a@b.c")
    paid = one("whop", {"id": "p", "total": 9.5, "currency": "usd", "user": {"username": "u"}, "created_at": "2026-01-02"})
    assert (paid["event_id"], paid["value"], paid["currency"], paid["subject"]) == ("whop:c:p", 9.5, "USD", "u")
    line = one("gsheets", {"row": 2, "cells": {"Name": "Ann", "Mail": "ann@x.io", "Booked on": "7/21/2026"}}, date_column="Booked on")
    assert (line["event_id"], line["subject"], line["event_type"], line["occurred_at"].day) == ("gsheets:c:row:2", "ann@x.io", "row_added", 21)
    guests = [{"email": "o@x.y", "organizer": True, "responseStatus": "accepted"}, {"email": "g@z.w", "responseStatus": "accepted"}, {"email": "h@z.w"}, {"email": "room", "resource": True}]
    meeting = json.loads(one("google_calendar", {"id": "m", "start": {"dateTime": "2026-01-02T10:00:00Z"}, "attendees": guests})["properties"])
    assert [meeting[k] for k in ("guests_total", "guests_accepted", "guests_pending", "guests_external", "guests_external_accepted", "is_external_meeting", "organizer_domain")] == [3, 2, 1, 2, 1, True, "x.y"]
    day = one("instantly_day", {"campaign_id": "k", "date": "2026-01-02", "sent": 4})
    assert (day["event_id"], day["event_type"], day["subject"]) == ("instantly:c:k:daily:2026-01-02", "campaign_day", "k 2026-01-02")
    mail = one("instantly", {"event_type": "reply_received", "email_id": "z", "lead_email": "l@x.y", "timestamp": "2026-01-02"})
    assert (mail["event_id"], mail["event_type"], mail["subject"]) == ("instantly:c:reply_received:z", "reply", "l@x.y")


def test_stream_is_idempotent_and_parks_what_it_cannot_read(spark, tmp_path):
    table = EventTable(spark, str(tmp_path / "table"), buckets=4)
    seen = []
    job = Ingestion(table, "o", "webhook", {}, after=lambda df: seen.append(df.count()))
    raw = lambda *rows: spark.createDataFrame([(str(i), "c", p, NOW, None) for i, p in enumerate(rows)], RAW)
    raw('{"id":1,"type":"a","when":"7/21/2026"}', '{"id":2,"type":"a","to":"A@B.c"}', "broken").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        job.start(spark.readStream.schema(RAW).parquet(str(tmp_path / "in")), str(tmp_path / "check")).awaitTermination()
    stored = {r["event_id"]: r for r in table.read().collect()}
    assert set(stored) == {"webhook:c:1", "webhook:c:2"} and job.dead_letters().count() == 1 and seen == [2]
    assert json.loads(stored["webhook:c:1"]["properties"])["when"] == "2026-07-21" and stored["webhook:c:2"]["identifiers"]["emails"] == ["a@b.c"]
    assert job.process(raw('{"id":1,"type":"a","when":"2026-07-21"}')) == {"inserted": 0, "updated": 0, "deduped": 1}
    assert job.process(raw('{"id":1,"type":"b"}')) == {"inserted": 0, "updated": 1, "deduped": 0}
    assert table.read().count() == 2 and table.upsert(table.read().limit(0))["inserted"] == 0
    fixed = spark.createDataFrame([("2", '{"id":3}'), ("99", '{"id":4}')], "raw_id string, payload string")
    assert job.replay(fixed) == {"inserted": 1, "updated": 0, "deduped": 0}


def test_last_of_a_batch_wins(spark):
    got = latest(frame(spark, row(gen=1, subject="x"), row(gen=2, subject="y"), row("b"))).collect()
    assert {r["event_id"]: r["subject"] for r in got} == {"a": "y", "b": "s"}
    none = spark.createDataFrame([], "raw_event_id string, connection_id string, received_at timestamp, source string, event_id string, event_type string, subject string, occurred_at timestamp, value double, currency string, properties string")
    assert prepared(none, "o").count() == 0


def test_fields(spark):
    df = store(spark, [event(props={"a": {"b": 1, "c": None}, "l": [], "__x": 1, "m": "x@y.z"}), event(props={"a": {"b": "q"}, "e": " "})]).scan().df
    got = {r["path"]: (r["type"], r["populated"], r["container"]) for r in infer_fields(df).collect()}
    assert got == {"a": ("object", 2, True), "a.b": ("text", 2, False), "a.c": ("unknown", 0, False), "l": ("list", 0, True), "m": ("email", 1, False), "e": ("text", 0, False)}
    assert {r["path"]: r["present"] for r in presence_by_path(df).collect()} == {"a": 2, "a.b": 2, "m": 1}
    seen = fields_seen(df, "connectionId")
    assert {r["path"]: (r["type"], r["cardinality"], r["seen"]) for r in seen.collect()}["a.b"][1:] == (2, 2)
    known = spark.createDataFrame([("c", "a.c", "null", 0, 5, None), ("c", "old", "string", 3, 9, "x")], seen.schema)
    both = {r["path"]: (r["type"], r["cardinality"], r["seen"]) for r in merge_registry(known, seen, "connectionId").collect()}
    assert both["old"] == ("string", 3, 9) and both["a.c"] == ("null", 0, 6)
    assert "old" not in {r["path"] for r in merge_registry(known, seen, "connectionId", whole=True).collect()}


def test_materialize(spark):
    s = store(spark, [event(days=1), event("x", days=2)])
    g = parse_graph({**steps(("get", "app", {"source": "webhook", "connectionId": "c"}), ("n", "formula", {"op": "count"}), ("z", "formula", {"op": "divide", "aFixed": 1, "bFixed": 0}), ("out", "output", {"name": "All"}), edges=[("get", "n"), ("n", "out")]), "metrics": [{"nodeId": "z", "name": "Bad"}]})
    got = {r["node_id"]: r for r in materialize(s, "f", g, NOW).collect()}
    assert got["out"]["value"] == 2 and got["out"]["by_range"]["yesterday"]["value"] == 1 and "zero" in got["z"]["error"]
    fresh = materialize(s, "f", g, NOW)
    old = fresh.withColumn("value", F.lit(7.0)).withColumn("error", F.lit(None).cast("string")).unionByName(fresh.where("node_id = 'out'").withColumn("node_id", F.lit("gone")))
    kept = {r["node_id"]: r["value"] for r in merge_results(old, fresh, "f", g).collect()}
    assert kept == {"out": 2.0, "z": 7.0}
    assert expired(fresh, NOW).count() == 0 and expired(fresh, NOW + timedelta(hours=7)).count() == 2
    assert stale_for({"f": g}, "webhook", "c") == {"f"} and stale_for({"f": g}, "close") == set() and reads(g) == {("c", "webhook", None)}
    assert moves_with_clock(parse_graph(steps(GET, ("t", "time", {})))) and not moves_with_clock(g)
