"""Registered queries of reading sources again and again: pages, history, feeds, retention,
attempts. The driver's tables stand in for what providers hold."""

from __future__ import annotations

import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import ORACLE, QUERIES, register
from millrace.sources.pages import KeyPages
from millrace.sources.records import table
from millrace.streaming import letters
from millrace.streaming.backfill import JOBS, Backfill
from millrace.streaming.changes import ChangeFeed, Changes, Expired
from millrace.streaming.incremental import Incremental
from millrace.streaming.ingest import EventTable, Ingestion
from millrace.streaming.kept import Kept
from millrace.streaming.raw import Page, RawStore, Sync

__all__ = ["ORACLE", "QUERIES"]
_AT = datetime(2024, 2, 1, tzinfo=UTC)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared one, ``spark.checkpoint.dir``; where that is unset, on one machine, a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/millrace-{label}-{uuid.uuid4().hex}"


def _moment(at: datetime) -> Column:
    return F.lit(at.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp")


@register("incremental_pages", "select o_orderstatus as status, count(*)::bigint as n, sum(o_orderkey)::bigint as keys, min(strftime(o_orderdate, '%Y-%m-%d')) as first_day from orders group by 1")
def incremental_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in pages of keys, five pages a run: each run goes on where the last one ended, and
    together they are one full reading."""
    orders, state = table(spark, sf_dir, "orders"), scratch(spark, "pages")
    ends = orders.agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")).first()
    client = KeyPages(f"{sf_dir}/orders.parquet", "o_orderkey", ends["first"], ends["last"], (ends["last"] - ends["first"]) // 12 + 1, "o_orderkey long, o_orderstatus string, o_orderdate timestamp")
    kept = f"{state}/kept"
    job = Incremental(spark, "order_pages", client, f"{state}/job", lambda rows, i: rows.write.mode("overwrite").parquet(f"{kept}/batch={i}"))
    while not job.run(budget=5):
        pass
    return spark.read.parquet(kept).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.min(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("first_day"))


def _sync(spark: SparkSession, label: str, source: str = "webhook", connection: str = "c1", **options) -> Sync:
    path = scratch(spark, label)
    return Sync(Ingestion(EventTable(spark, f"{path}/events", buckets=4, writers=1), "org", source, options), RawStore(spark, f"{path}/raw"), connection)


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at")))
    return table(spark, sf_dir, "events").select("event_id", made.alias("payload"), F.col("ts").cast("timestamp").alias("received_at"))


def _event_pages(rows: DataFrame, first: int, last: int, pages: int):
    """A source of the events with these ids, in so many pages, newest ids last."""
    size = (last - first) // pages + 1

    def read(cursor: str | None) -> Page:
        at = first if cursor is None else int(cursor)
        found = rows.where(F.col("event_id").between(at, min(at + size - 1, last))).select("payload", "received_at")
        return Page(found, str(at + size) if at + size <= last else None)

    return read


@register(
    "backfill_and_live",
    "with e as (select event_type, event_id from events where event_id >= (select min(event_id) from events)) select o as order_of_jobs, event_type, count(*)::bigint as live, sum(event_id)::bigint as ids, 'complete' as status from e, (values ('history first'), ('live first')) t(o) group by 1, 2",
)
def backfill_and_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of the events is read live and all of them as history, in either order: each
    job has its own cursor, so the same events come of it."""
    rows, out = _payloads(spark, sf_dir), None
    ends = rows.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    for first in ("history first", "live first"):
        sync = _sync(spark, "history", time_key="at")
        history = Backfill(sync, Kept(spark, f"{sync.raw.path}/jobs", JOBS), lambda: _AT)
        job, _ = history.request("s", datetime(2024, 1, 1), ceiling=1 << 40)
        row = history.slice(job, _event_pages(rows, ends["a"], ends["b"], 2), pages=1) if first == "history first" else None
        sync.incremental(_event_pages(rows, (ends["a"] + ends["b"]) // 2, ends["b"], 1))
        while row is None or row["status"] == "running":
            row = history.slice(job, _event_pages(rows, ends["a"], ends["b"], 2))
        number = F.substring_index("event_id", ":", -1).cast("long")
        found = sync.ingestion.table.read().where("deleted_at is null").groupBy("event_type").agg(F.count(F.lit(1)).alias("live"), F.sum(number).alias("ids"))
        found = found.select(F.lit(first).alias("order_of_jobs"), "event_type", "live", "ids", F.lit(row["status"]).alias("status"))
        out = found if out is None else out.unionByName(found)
    return out


@register(
    "change_feed",
    "select o_orderkey::varchar as id, case when o_orderkey % 7 = 0 then 'retired' when o_orderkey % 5 = 0 then 'deleted' else 'live' end as state, "
    "strftime(o_orderdate + case when o_orderkey % 3 = 0 then interval '1' day else interval '0' day end, '%Y-%m-%d') as day from orders",
)
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar entries made of orders, as a log of changes: every entry is made, every third is
    moved by a day, every fifth deleted. The first reading lists them, the second reads the changes under
    its token; then the token expires, and a full reading no longer has every seventh entry."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("at"))
    n = orders.agg(F.max("k")).first()[0] + 1
    start = lambda c: F.to_json(F.struct(F.col("k").cast("string").alias("id"), F.struct(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("dateTime")).alias("start")))
    change = lambda rows, shift, payload, deleted=False: rows.select(F.col("k").cast("string").alias("key"), (F.col("k") + shift).alias("place"), F.lit(deleted).alias("deleted"), payload.alias("payload"), F.lit(_AT).cast("timestamp").alias("received_at"))
    later = F.col("at") + F.expr("interval 1 day")
    log = change(orders, 0, start("at")).unionByName(change(orders.where("k % 3 = 0"), n, start(later))).unionByName(change(orders.where("k % 5 = 0"), 2 * n, F.lit(None).cast("string"), True))
    final = F.when(F.col("k") % 3 == 0, later).otherwise(F.col("at"))
    listing = change(orders.where("k % 7 > 0 and k % 5 > 0"), 0, start(final))

    def provider(upto: int, anew: bool = False):
        rows, size = (listing if anew else log.where(F.col("place") < upto)), -(-upto // 2)

        def page(token: str | None, cursor: str | None) -> Changes:
            if anew and token is not None:
                raise Expired(token)
            at = int(cursor) if cursor else int(token) if token else 0
            after = str(at + size) if at + size < upto else None
            return Changes(rows.where(F.col("place").between(at, at + size - 1)), after, None if after else str(upto))

        return page

    sync = _sync(spark, "feed", "google_calendar")
    feed = ChangeFeed(sync, lambda key: F.concat(F.lit("gcal:c1:"), key))
    for source in (provider(n), provider(3 * n), provider(n, anew=True)):
        feed.read(source, _moment(_AT))
    number = F.substring_index("event_id", ":", -1).cast("long")
    state = F.when(F.col("deleted_at").isNull(), "live").when(number % 7 == 0, "retired").otherwise("deleted")
    return sync.ingestion.table.read().select(number.cast("string").alias("id"), state.alias("state"), F.date_format("occurred_at", "yyyy-MM-dd").alias("day"))


@register(
    "raw_retention",
    "select case when o_orderdate < timestamp '1996-01-01' and o_custkey % 10 % 4 = 1 and o_orderstatus <> 'P' then 'dropped' else 'kept' end as outcome, count(*)::bigint as n, sum(o_orderkey)::bigint as keys from orders where o_orderdate < timestamp '1996-01-01' or o_orderdate >= timestamp '1998-01-01' group by 1 having outcome = 'kept'",
)
def raw_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads received before 1996 go, of connections that were disabled before and without an
    open dead letter; days of which nothing stays go as whole folders."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate < timestamp'1996-01-01' or o_orderdate >= timestamp'1998-01-01'")
    raw = orders.select(F.col("o_orderkey").cast("string").alias("raw_id"), (F.col("o_custkey") % 10).cast("string").alias("connection_id"), F.lit("{}").alias("payload"), F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")).alias("received_at"))
    store, before = RawStore(spark, scratch(spark, "raw")), datetime(1996, 1, 1)
    store.append(raw.repartition("received_at"), "s", "one")
    connections = spark.range(10).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 4 == 1, F.lit("1995-01-01").cast("timestamp")).alias("disabled_at"))
    dead = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("raw_id"), F.lit(None).cast("timestamp").alias("resolved_at"))
    store.prune("s", dead, connections, before)
    return store.read("s").groupBy(F.lit("kept").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("raw_id").cast("long")).alias("keys"))


@register(
    "letter_attempts",
    "select o_orderkey::varchar as raw_id, least(o_custkey % 8, 7)::int as attempts, case when o_custkey % 8 >= 6 then 'parked' when o_custkey % 8 = 7 then 'waiting' else 'resolved' end as state, case when o_custkey % 8 >= 6 then '00:05' end as parked from orders where o_custkey % 8 > 0",
)
def letter_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven batches, a minute apart: an order's payload fails in so many of them as its customer
    says and then goes well; what has failed six times stays parked."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("raw_id"), F.lit("c1").alias("connection_id"), F.lit("s").alias("source"), (F.col("o_custkey") % 8).alias("times"))
    state = Kept(spark, scratch(spark, "letters"), letters.LETTERS)
    for i in range(7):
        told = orders.where(F.col("times") > 0).where((F.col("times") > i) | (F.col("times") < 6)).select("raw_id", "connection_id", "source", F.when(F.col("times") > i, "bad").alias("error"))
        state.write(letters.merged(state.read(), told, _moment(datetime(2024, 1, 1, 0, i)), f"n{i}"))
    found = state.read()
    kind = F.when(F.col("resolved_at").isNotNull(), "resolved").when(F.col("parked_at").isNotNull(), "parked").otherwise("waiting")
    return found.select("raw_id", "attempts", kind.alias("state"), F.date_format("parked_at", "HH:mm").alias("parked"))
