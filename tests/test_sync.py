"""Reading a source again and again: cursor pages, full re-reads, history, reprocessing."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.streaming.backfill import JOBS, Backfill
from millrace.streaming.changes import ChangeFeed, Changes, Expired, last_deleted, last_of_each
from millrace.streaming.ingest import EventTable, Ingestion
from millrace.streaming.kept import Kept
from millrace.streaming.letters import LETTERS, merged
from millrace.streaming.raw import Page, RawStore, Sync, accepted

AT = datetime(2024, 1, 1)


@pytest.fixture
def sync(spark, tmp_path):
    return Sync(Ingestion(EventTable(spark, str(tmp_path / "events"), buckets=2), "org", "webhook", {}), RawStore(spark, str(tmp_path / "raw")), "c1")


def now():
    return F.lit("2024-02-01").cast("timestamp")


def pages(spark, ids, size=2, log=None, fail_at=None):
    """A source of payloads with these ids, so many a page; its cursor is the next place."""

    def read(cursor):
        at = int(cursor or 0)
        if log is not None:
            log.append(at)
        if fail_at is not None and at >= fail_at:
            raise ConnectionError("the provider is away")
        rows = spark.createDataFrame([(f'{{"id":"{i}","type":"t"}}', AT) for i in ids[at : at + size]], "payload string, received_at timestamp")
        return Page(rows, str(at + size), at + size >= len(ids))

    return read


def live(sync):
    return {r["event_id"].rpartition(":")[2] for r in sync.ingestion.table.read().where("deleted_at is null").collect()}


def test_incremental_goes_on_where_it_ended(spark, sync):
    log = []
    assert sync.cursor() == (None, 0)
    assert sync.incremental(pages(spark, "abcd", log=log), pages=1)["inserted"] == 2 and sync.cursor() == ("2", 1)
    with pytest.raises(ConnectionError):
        sync.incremental(pages(spark, "abcdef", log=log, fail_at=4))
    assert live(sync) == set("abcd")
    assert sync.incremental(pages(spark, "abcdef", log=log))["inserted"] == 2
    assert log == [0, 2, 4, 4] and live(sync) == set("abcdef") and sync.cursor() == ("6", 3)


def test_only_a_complete_reading_retires(spark, sync):
    sync.resync(pages(spark, "abc"), 1, now())
    early = sync.resync(pages(spark, "bcdefg"), 2, now(), pages=1)
    assert not early["complete"] and "retired" not in early and live(sync) == set("abc")
    whole = sync.resync(pages(spark, "bd"), 3, now())
    assert whole["complete"] and whole["retired"] == 2 and live(sync) == set("bd")


def jobs(spark, sync, tmp_path):
    return Backfill(sync, Kept(spark, str(tmp_path / "jobs"), JOBS), lambda: AT)


def test_history_in_slices_and_reprocessing(spark, sync, tmp_path):
    source, history = pages(spark, "abcdefg"), jobs(spark, sync, tmp_path)
    job, new = history.request("s", AT)
    assert new and history.request("s", AT) == (job, False) and history.request("s", datetime(2024, 1, 1, 7)) == (job, False)
    row = history.slice(job, source, pages=1)
    assert (row["status"], row["rows_imported"], row["checkpoint"], row["reached_floor"]) == ("running", 2, "2", AT)
    row = history.slice(job, source, pages=9)
    assert (row["status"], row["rows_imported"], row["pages"], row["detail"]) == ("complete", 7, 4, None)
    assert history.slice(job, source) == row and live(sync) == set("abcdefg") and sync.cursor() == (None, 0)
    assert sync.reprocess() == {"inserted": 0, "updated": 0, "deduped": 7}
    deeper, new = history.request("s", datetime(2023, 5, 1))
    assert new and deeper != job and "nothing before 2024-01-01" in history.slice(deeper, source, pages=9)["detail"]


def test_a_job_ends_partial_and_a_failed_one_goes_on(spark, sync, tmp_path):
    history = jobs(spark, sync, tmp_path)
    job, _ = history.request("s", AT, ceiling=3)
    row = history.slice(job, pages(spark, "abcdefg"), pages=9)
    assert (row["status"], row["rows_imported"], row["checkpoint"]) == ("partial", 4, "4") and history.fail(job, "late")["status"] == "partial"
    other, _ = history.request("t", AT)
    with pytest.raises(ConnectionError):
        history.slice(other, pages(spark, "uvwxyz", fail_at=4), pages=9)
    assert history.fail(other, "the provider is away")["status"] == "failed"
    assert history.request("t", AT) == (other, True)
    log = []
    assert history.slice(other, pages(spark, "uvwxyz", log=log), pages=9)["status"] == "complete" and log == [4]
    with pytest.raises(ValueError, match="no job"):
        history.slice("none", pages(spark, ""))


@pytest.mark.parametrize("first", ["live", "history"])
def test_live_and_history_in_either_order(spark, sync, tmp_path, first):
    """Each job has a cursor of its own, so neither skips what the other has read."""
    history = jobs(spark, sync, tmp_path)
    job, _ = history.request("s", AT)
    for kind in (first, "history" if first == "live" else "live"):
        if kind == "live":
            sync.incremental(pages(spark, "efgh"))
        else:
            history.slice(job, pages(spark, "abcdefgh"), pages=9)
    assert live(sync) == set("abcdefgh") and sync.cursor() == ("4", 2)


def test_polled_payloads_have_no_limit_and_failures_are_parked(spark, sync):
    """Nothing of a page is thrown away: large payloads are kept, bad ones are parked once."""
    big = '{"id":"big","type":"t","x":"' + "y" * 1_100_000 + '"}'
    rows = spark.createDataFrame([(big, AT), ('{"id":"small","type":"t"}', AT), ("broken", AT), ("", AT), (None, AT)], "payload string, received_at timestamp")
    for _ in range(2):  # the page comes twice
        sync.take(rows, "page-1", 1)
    assert live(sync) == {"big", "small"} and sync.ingestion.dead_letters().count() == 3
    assert {(r["attempts"], r["parked_at"]) for r in sync.ingestion.letters.read().collect()} == {(1, None)}


def test_a_null_cursor_starts_over_and_one_that_stands_ends(spark, sync):
    asked = []

    def once(cursor):
        asked.append(cursor)
        return Page(pages(spark, "ab")(None).rows, None)

    assert sync.incremental(once)["inserted"] == 2 and sync.incremental(once)["deduped"] == 2 and asked == [None, None]
    assert sync.incremental(lambda c: Page(pages(spark, "ab")(None).rows, "same"), job="stuck", pages=9)["deduped"] == 4 and sync.cursor("stuck") == ("same", 2)


def raw_rows(spark, *rows):
    return spark.createDataFrame([(i, c, "{}", at, None) for i, c, at in rows], "raw_id string, connection_id string, payload string, received_at timestamp, delivery string")


def test_raw_store_by_day(spark, tmp_path):
    store = RawStore(spark, str(tmp_path / "raw"))
    day = lambda d: datetime(2024, 1, d, 5)
    store.append(raw_rows(spark, ("1", "old", day(1)), ("2", "old", day(1)), ("3", "old", day(2)), ("4", "on", day(2)), ("5", "old", day(3)), ("6", "old", day(9))), "s", "one")
    store.append(raw_rows(spark, ("7", "old", day(2)), ("8", "old", day(3))), "s", "two")
    store.append(raw_rows(spark, ("9", "old", day(1))), "t", "three")
    dead = spark.createDataFrame([("8", None), ("2", AT)], "raw_id string, resolved_at timestamp")
    connections = spark.createDataFrame([("old", datetime(2024, 1, 2)), ("on", None)], "id string, disabled_at timestamp")
    plan = store.expiring("s", dead, connections, day(5))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "(day#" in plan and "payload" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert store.prune("s", dead, connections, day(5)) == {"dropped": 5, "days": 1, "rewritten": 2}
    assert {r["raw_id"] for r in store.read("s").collect()} == {"4", "6", "8"} and store.read("t").count() == 1
    assert not (tmp_path / "raw/payloads/source=s/day=2024-01-01").exists() and not (tmp_path / "raw/payloads/source=s/day=2024-01-02/batch=two").exists()
    assert store.prune("s", dead, connections, day(5)) == {"dropped": 0, "days": 0, "rewritten": 0}
    assert [r["raw_id"] for r in store.read("s", since=day(4).date()).collect()] == ["6"] and store.read("s", connection="on", until=day(2).date()).count() == 1
    store.append(raw_rows(spark, ("6", "old", day(9))), "s", "one")
    assert store.read("s", batch="one").count() == 2 and RawStore(spark, str(tmp_path / "none")).read("s").count() == 0


FEED_ROWS = "key string, place long, deleted boolean, payload string, received_at timestamp"


def feed_of(spark, log, size, known=("t",), listing=None, asked=None):
    """A provider with a log of (key, type or None: deleted); its token is a place in the log."""

    def page(token, cursor):
        if asked is not None:
            asked.append((token, cursor))
        if token is not None and not token.startswith(known):
            raise Expired(token)
        everything = list(enumerate(log if token or listing is None else listing))
        at = int(cursor) if cursor else int(token[1:]) if token else 0
        part = everything[at : at + size]
        rows = [(k, i, kind is None, None if kind is None else f'{{"id":"{k}","type":"{kind}"}}', AT) for i, (k, kind) in part]
        after = str(at + size) if at + size < len(everything) else None
        return Changes(spark.createDataFrame(rows, FEED_ROWS), after, None if after else f"t{len(log)}")

    return page


def kinds(sync):
    return {r["event_id"].rpartition(":")[2]: r["event_type"] for r in sync.ingestion.table.read().where("deleted_at is null").collect()}


@pytest.mark.parametrize("size", [2, 9])
def test_feed_of_changes(spark, sync, size):
    feed = ChangeFeed(sync, lambda key: F.concat(F.lit("webhook:c1:"), key))
    log = [("a", "x"), ("b", "x"), ("c", "x"), ("a", "y"), ("b", None)]
    assert feed.read(feed_of(spark, log[:3], size), now())["complete"] and kinds(sync) == {"a": "x", "b": "x", "c": "x"}
    assert feed.read(feed_of(spark, log, size), now())["deleted"] == 1 and kinds(sync) == {"a": "y", "c": "x"} and feed.state() == ("t5", 1, 2)
    log += [("b", "z"), ("c", None), ("c", "w")]
    assert feed.read(feed_of(spark, log, size), now())["complete"] and kinds(sync) == {"a": "y", "b": "z", "c": "w"}


def test_feed_keeps_its_token_until_the_end_and_starts_over_when_it_expires(spark, sync):
    feed, log, asked = ChangeFeed(sync, lambda key: F.concat(F.lit("webhook:c1:"), key)), [(k, "x") for k in "abcdef"], []
    feed.read(feed_of(spark, log[:2], 2), now())
    assert not feed.read(feed_of(spark, log, 2, asked=asked), now(), pages=1)["complete"] and feed.state()[0] == "t2"
    assert feed.read(feed_of(spark, log, 2, asked=asked), now())["complete"] and asked == [("t2", None), ("t2", None), ("t2", "4")]
    short = feed_of(spark, log, 2, known=("v",), listing=[("a", "y"), ("f", "x"), ("g", "x")])
    assert not feed.read(short, now(), pages=1)["complete"] and feed.state()[:2] == (None, 2) and set(kinds(sync)) == set("abcdef")
    found = feed.read(short, now())
    assert found["retired"] == 4 and kinds(sync) == {"a": "y", "f": "x", "g": "x"}


def test_a_page_of_changes_is_dealt_once(spark):
    """Payloads are dealt by key once; which keys are deleted is found without them."""
    rows = [("a", 1, False, "old", AT), ("a", 2, False, "new", AT), ("b", 3, False, "x", AT), ("b", 4, True, None, AT), ("c", 5, True, None, AT), ("c", 6, False, "y", AT)]
    changes = spark.createDataFrame(rows, FEED_ROWS).repartition(3)
    assert {(r["key"], r["place"]) for r in last_of_each(changes).collect()} == {("a", 2), ("b", 4), ("c", 6)} and [r["key"] for r in last_deleted(changes).collect()] == ["b"]
    plan = last_of_each(changes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_equal_payloads_of_a_page_are_one_the_first_received(spark, sync):
    rows = [('{"id":"a","type":"t"}', datetime(2024, 1, d)) for d in (3, 1, 2)]
    assert sync.take(spark.createDataFrame(rows, "payload string, received_at timestamp").repartition(3), "page-1", 1)["inserted"] == 1
    assert [r["received_at"] for r in sync.raw.read("webhook").collect()] == [datetime(2024, 1, 1)]


def test_attempts(spark):
    state = spark.createDataFrame([], LETTERS)
    at = lambda m: F.lit(f"2024-01-01 00:{m:02d}:00").cast("timestamp")
    told = lambda *rows: spark.createDataFrame([(i, "c", "s", e) for i, e in rows], "raw_id string, connection_id string, source string, error string")
    for i in range(7):
        state = merged(state, told(("a", "bad"), ("b", "bad" if i < 2 else None), ("c", None)), at(i), f"n{i}")
        state = spark.createDataFrame(merged(state, told(("a", "bad")), at(i), f"n{i}").collect(), LETTERS)  # the batch comes twice
    got = {r["raw_id"]: r for r in state.collect()}
    assert got["a"]["attempts"] == 7 and got["a"]["parked_at"] == datetime(2024, 1, 1, 0, 5) and got["a"]["next_try"] is None and "c" not in got
    assert got["b"]["attempts"] == 2 and got["b"]["resolved_at"] == datetime(2024, 1, 1, 0, 2) and got["b"]["next_try"] is None
    again = {r["raw_id"]: r for r in merged(state, told(("b", "worse")), at(9), "z").collect()}
    assert (again["b"]["attempts"], again["b"]["resolved_at"], again["b"]["next_try"]) == (1, None, datetime(2024, 1, 1, 0, 10)) and again["a"]["attempts"] == 7


def test_retry_of_what_is_due(spark, sync):
    at = lambda m: F.lit(f"2024-01-01 00:{m:02d}:00").cast("timestamp")
    job = sync.ingestion
    raw = spark.createDataFrame([("1", "c1", "broken", AT), ("2", "c1", '{"id":2}', AT)], "raw_id string, connection_id string, payload string, received_at timestamp")
    job.process(raw, batch="p", now=at(0))
    assert job.retry(at(0), "r0") == {"inserted": 0, "updated": 0, "deduped": 0} and job.letters.read().first()["attempts"] == 1
    job.retry(at(1), "r1")
    row = job.letters.read().first()
    assert (row["raw_id"], row["attempts"], row["next_try"]) == ("1", 2, datetime(2024, 1, 1, 0, 3))
    job.replay(spark.createDataFrame([("1", '{"id":1}')], "raw_id string, payload string"))
    assert job.letters.read().first()["resolved_at"] is not None and live(sync) == {"1", "2"}


def test_intake(spark):
    rows = [("1", "c", "{}", AT, "d"), ("2", "c", "{}", AT, "d"), ("3", "c", "{}", AT, None), ("4", "c", "{}", AT, None), ("5", "c", "x" * 50, AT, None), ("6", "c", None, AT, None), ("7", "c", " ", AT, "e")]
    kept, refused = accepted(spark.createDataFrame(rows, "raw_id string, connection_id string, payload string, received_at timestamp, delivery string"), 40)
    assert {r["raw_id"] for r in kept.collect()} == {"1", "3", "4"} and {r["raw_id"] for r in refused.collect()} == {"5", "6", "7"}
    empty = spark.createDataFrame([], "raw_id string, connection_id string, payload string, received_at timestamp")
    assert [x.count() for x in accepted(empty)] == [0, 0]
