"""Writing canonical events: the guarded upsert, mirrors and windows that retire what is
gone, restamping, dead letters, and the streaming job around them.

All of these are set operations on DataFrames. ``EventTable`` keeps the result in Parquet,
dealt into buckets by event_id; a batch rewrites only the buckets that it touches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.dates import normalize_dates
from millrace.functions.identity import identifiers_of_text
from millrace.sources.connectors import normalize
from millrace.sources.records import EVENT_SCHEMA
from millrace.streaming.kept import Kept
from millrace.streaming.letters import LETTERS, due, merged

_CONTENT = ("event_type", "subject", "value", "currency", "properties", "identifiers", "stream_hash")
_STORED = [c.split()[0] for c in EVENT_SCHEMA.replace("struct<emails:array<string>,phones:array<string>>", "struct").split(", ")]


def prepared(events: DataFrame, org: str, generation: int = 0, stream: str | None = None) -> DataFrame:
    """Normalised events as rows to store: dates in canonical form, identifiers harvested.
    Of rows with one event_id the last one (by received_at, then content) stays."""
    rows = events.withColumn("_json", normalize_dates("properties")).withColumn("_ids", identifiers_of_text(F.col("subject"), F.col("properties")))
    made = {
        "id": F.md5("event_id"), "event_id": F.col("event_id"), "org_id": F.lit(org), "connection_id": F.col("connection_id"), "source": F.col("source"), "event_type": F.col("event_type"), "subject": F.col("subject"),
        "occurred_at": F.col("occurred_at"), "received_at": F.col("received_at"), "value": F.col("value").cast("decimal(38,10)"), "currency": F.col("currency"), "properties": F.to_json(F.try_parse_json("_json")), "raw_event_id": F.col("raw_event_id"),
        "identifiers": F.col("_ids"), "sync_generation": F.lit(generation), "deleted_at": F.lit(None).cast("timestamp"), "stream_hash": F.lit(stream).cast("string"),
    }
    return latest(rows.select(*[c.alias(k) for k, c in made.items()]))


def latest(rows: DataFrame) -> DataFrame:
    """One row of each event_id: that of the highest generation, received last."""
    rank = ("sync_generation", "received_at", F.xxhash64("event_type", "subject", "occurred_at", "value", "properties"))
    # Rows stay dealt and sorted by the key, and what follows knows it.
    nth = F.row_number().over(Window.partitionBy("event_id").orderBy(*map(F.desc, rank)))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def upsert(stored: DataFrame, incoming: DataFrame, pin_time: bool = False) -> DataFrame:
    """The stored rows after a batch, each with ``action``: inserted, updated, deduped or kept.

    A stored row changes only for its own connection, for a generation no older than its
    own, and if it is a tombstone or anything differs. The generation never falls, the
    tombstone is lifted, the first receipt and raw event stay, and ``pin_time`` keeps the
    event's time."""
    # Plain columns, not structs, so that a side which is dealt by event_id already is not dealt again.
    old, new = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in _STORED]) for side, df in (("o", stored), ("n", incoming)))
    both = old.join(new, F.col("o_event_id") == F.col("n_event_id"), "full")
    o, n = ({c: F.col(f"{side}_{c}") for c in _STORED} for side in "on")
    generation = F.greatest(o["sync_generation"], n["sync_generation"])
    differs = o["deleted_at"].isNotNull() | (o["sync_generation"] != generation)
    for c in (*_CONTENT, *(() if pin_time else ("occurred_at",))):
        differs = differs | ~o[c].eqNullSafe(n[c])
    allowed = (o["connection_id"] == n["connection_id"]) & (n["sync_generation"] >= o["sync_generation"]) & differs
    fresh, absent = o["event_id"].isNull(), n["event_id"].isNull()
    action = F.when(fresh, "inserted").when(absent, "kept").when(F.coalesce(allowed, F.lit(False)), "updated").otherwise("deduped")
    taken = {c: n[c] for c in _CONTENT} | {"occurred_at": o["occurred_at"] if pin_time else n["occurred_at"], "sync_generation": generation, "deleted_at": F.lit(None).cast("timestamp"), "raw_event_id": F.coalesce(o["raw_event_id"], n["raw_event_id"])}
    value = lambda c: F.when(fresh, n[c]).when(F.col("action") == "updated", taken.get(c, o[c])).otherwise(o[c])
    return both.withColumn("action", action).select(*[value(c).alias(c) for c in _STORED], "action")


def counts(merged: DataFrame, actions: tuple[str, ...] = ("inserted", "updated", "deduped")) -> DataFrame:
    """inserted, updated, deduped, or other actions: one row."""
    return merged.agg(*[F.count_if(F.col("action") == a).alias(a) for a in actions])


def _of_stream(connection: str, stream: str) -> Column:
    return (F.col("connection_id") == connection) & F.col("stream_hash").eqNullSafe(stream) & F.col("deleted_at").isNull()


def retire_absent(stored: DataFrame, snapshot: DataFrame, connection: str, stream: str, now: Column, window: tuple[Column, Column] | None = None) -> DataFrame:
    """A mirror's rows that the complete read (event_id) no longer has become tombstones;
    only those inside the window that was read, if one is given."""
    mine = _of_stream(connection, stream)
    if window is not None:
        mine = mine & F.col("occurred_at").between(*window)
    seen = snapshot.select("event_id", F.lit(True).alias("_seen")).distinct()
    gone = F.coalesce(mine, F.lit(False)) & F.col("_seen").isNull()
    return stored.join(seen, "event_id", "left").withColumn("deleted_at", F.when(gone, now).otherwise(F.col("deleted_at"))).select(*_STORED)


def retire_outside(stored: DataFrame, connection: str, stream: str, start: Column, end: Column, now: Column) -> DataFrame:
    """Rows of a rolling source that have left its window become tombstones."""
    gone = F.coalesce(_of_stream(connection, stream) & ~F.col("occurred_at").between(start, end), F.lit(False))
    return stored.withColumn("deleted_at", F.when(gone, now).otherwise(F.col("deleted_at")))


def retire_connection(stored: DataFrame, connection: str, now: Column) -> DataFrame:
    mine = (F.col("connection_id") == connection) & F.col("deleted_at").isNull()
    return stored.withColumn("deleted_at", F.when(mine, now).otherwise(F.col("deleted_at")))


def restore_connection(stored: DataFrame, connection: str, since: Column) -> DataFrame:
    """Lifts the tombstones that were set from ``since`` on."""
    mine = (F.col("connection_id") == connection) & (F.col("deleted_at") >= since)
    return stored.withColumn("deleted_at", F.when(mine, None).otherwise(F.col("deleted_at")))


def retire_older(stored: DataFrame, connection: str, generation: int, now: Column) -> DataFrame:
    """After a complete re-read: polled rows of older generations become tombstones."""
    mine = (F.col("connection_id") == connection) & (F.col("sync_generation") >= 1) & (F.col("sync_generation") < generation) & F.col("deleted_at").isNull()
    return stored.withColumn("deleted_at", F.when(mine, now).otherwise(F.col("deleted_at")))


def restamp(stored: DataFrame, moments: DataFrame) -> DataFrame:
    """New event times (event_id, occurred_at or null): null falls back to the first receipt."""
    new = moments.select("event_id", F.struct(F.col("occurred_at").alias("at")).alias("_m"))
    at = F.when(F.col("_m").isNotNull(), F.coalesce("_m.at", "received_at")).otherwise(F.col("occurred_at"))
    return stored.join(new, "event_id", "left").withColumn("occurred_at", at).select(*_STORED)


def expired_tombstones(stored: DataFrame, before: Column) -> DataFrame:
    """stored without the tombstones that are older than ``before``."""
    return stored.where(F.col("deleted_at").isNull() | (F.col("deleted_at") >= before))


# ---- storage -------------------------------------------------------------------


@dataclass
class EventTable:
    """Canonical events in Parquet at ``path``, dealt into ``buckets`` by event_id: as many as
    the table's size asks for, so that a batch rewrites little. A write is staged beside the
    table, once, and its buckets then take the place of those it touches by being moved there, so a batch that
    fails half-way can be written again with the same result. At least ``writers`` tasks write one
    bucket, more if it is large. Files also hold what the last write did to a row (``action``)."""

    spark: SparkSession
    path: str
    buckets: int = 16
    writers: int = 4

    def _drop(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("event_id"), F.lit(self.buckets)).cast("int")

    def read(self, touched: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets."""
        try:
            df = self.spark.read.schema(f"{EVENT_SCHEMA}, bucket int").parquet(f"{self.path}/events")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        return (df if touched is None else df.where(F.col("bucket").isin(touched))).select(*_STORED)

    def _staged(self, rows: DataFrame) -> str:
        """Writes rows, and their action if they have one, in buckets beside the table. Adaptive
        execution deals a bucket to as many tasks as its size asks for."""
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        part = F.pmod(F.xxhash64("event_id", F.lit("writer")), F.lit(self.writers))
        placed = rows.select(*_STORED, *(["action"] if "action" in rows.columns else [])).withColumns({"bucket": self._bucket(), "_part": part})
        placed.hint("rebalance", "bucket", "_part").drop("_part").write.partitionBy("bucket").parquet(staged)
        return staged

    def _move(self, staged: str) -> None:
        """Staged buckets take the place of the table's. What they replace is moved aside first and
        dropped at the end."""
        at = lambda path: self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        aside = f"{staged}-replaced"
        fs.mkdirs(at(f"{self.path}/events"))
        fs.mkdirs(at(aside))
        for x in fs.listStatus(at(staged)):
            name = x.getPath().getName()
            if not name.startswith("bucket="):
                continue
            place = at(f"{self.path}/events/{name}")
            if fs.exists(place) and not fs.rename(place, at(f"{aside}/{name}")):
                raise OSError(f"{place} cannot be moved aside")
            if not fs.rename(x.getPath(), place):
                raise OSError(f"{x.getPath()} cannot be moved to {place}")
        self._drop(staged)
        self._drop(aside)
        self.spark.catalog.refreshByPath(f"{self.path}/events")

    def replace(self, rows: DataFrame) -> None:
        """Puts rows in place of the buckets that they belong to."""
        self._move(self._staged(rows))

    def _replace_if_changed(self, rows: DataFrame, actions: tuple[str, ...]) -> dict[str, int]:
        """How many rows have each action; rows take their buckets' place if any is changed."""
        staged = self._staged(rows)
        found = self.spark.read.schema("action string").parquet(staged)
        found = counts(found, actions).first().asDict()
        if any(found[a] for a in actions if a not in ("deduped", "kept")):
            self._move(staged)
        else:
            self._drop(staged)
        return found

    def change(self, wanted: Column, f: Callable[[DataFrame], DataFrame]) -> int:
        """Applies f, which keeps event_ids, to the buckets that hold wanted rows and puts them back;
        the number of those rows."""
        held = self.read().where(wanted).groupBy(self._bucket().alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``buckets`` rows
        if held:
            self.replace(f(self.read([r["b"] for r in held])))
        return sum(r["n"] for r in held)

    def tombstone(self, event_ids: DataFrame, now: Column) -> int:
        """The live rows with these event_ids become tombstones; how many there were."""
        batch = f"{self.path}/batches/{uuid.uuid4().hex}"
        event_ids.select("event_id").distinct().write.parquet(batch)
        ids = self.spark.read.schema("event_id string").parquet(batch)
        touched = [r[0] for r in ids.select(self._bucket()).distinct().collect()]  # at most ``buckets`` numbers
        gone = 0
        if touched:
            marked = self.read(touched).join(ids.withColumn("_gone", F.lit(True)), "event_id", "left")
            hit = F.col("_gone").isNotNull() & F.col("deleted_at").isNull()
            marked = marked.withColumn("action", F.when(hit, "deleted").otherwise("kept"))
            gone = self._replace_if_changed(marked.withColumn("deleted_at", F.when(F.col("action") == "deleted", now).otherwise(F.col("deleted_at"))), ("deleted", "kept"))["deleted"]
        self._drop(batch)
        return gone

    def upsert(self, incoming: DataFrame, pin_time: bool = False) -> dict[str, int]:
        """Merges a prepared batch; reads and rewrites only the buckets it touches."""
        batch = f"{self.path}/batches/{uuid.uuid4().hex}"
        incoming.write.parquet(batch)
        incoming = self.spark.read.schema(EVENT_SCHEMA).parquet(batch)
        touched = [r[0] for r in incoming.select(self._bucket()).distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            self._drop(batch)
            return {"inserted": 0, "updated": 0, "deduped": 0}
        found = self._replace_if_changed(upsert(self.read(touched), incoming, pin_time), ("inserted", "updated", "deduped"))
        self._drop(batch)
        return found


@dataclass
class Ingestion:
    """Raw payloads to stored events, batch by batch; what cannot be read is parked."""

    table: EventTable
    org: str
    source: str
    options: dict
    after: Callable[[DataFrame], None] | None = None

    @property
    def _parked(self) -> str:
        return f"{self.table.path}/dead_letters/{self.source}"

    @property
    def letters(self) -> Kept:
        """Attempts, next try, parking and resolution of each payload that ever failed."""
        return Kept(self.table.spark, f"{self.table.path}/letters/{self.source}", LETTERS)

    def oldest(self, raw: DataFrame) -> datetime | None:
        """The earliest moment of these payloads' events."""
        return normalize(raw, self.source, **self.options)[0].agg(F.min("occurred_at").alias("at")).first()["at"]

    def _count_attempts(self, raw: DataFrame, failures: DataFrame, name: str, now: Column) -> None:
        """Merges the batch's outcomes into the letters, if anything failed now or waits from before."""
        state = self.letters.read()
        if state.isEmpty() and failures.isEmpty():
            return
        wrong = failures.select("raw_id", "connection_id", "source", "error")
        well = raw.join(wrong, "raw_id", "left_anti").join(state.where("resolved_at is null").select("raw_id"), "raw_id", "left_semi")
        told = wrong.unionByName(well.select("raw_id", "connection_id", F.lit(self.source).alias("source"), F.lit(None).cast("string").alias("error")))
        self.letters.write(merged(state, told, now, name))

    def process(self, raw: DataFrame, generation: int = 0, batch: int | str | None = None, now: Column | None = None) -> dict[str, int]:
        """One batch. Running a batch again changes nothing: the upsert is idempotent, parked
        payloads are overwritten under the batch's name and their attempt counts once."""
        events, failures = normalize(raw, self.source, **self.options)
        name = uuid.uuid4().hex if batch is None else str(batch)
        failures.write.mode("overwrite").parquet(f"{self._parked}/batch={name}")
        found = self.table.upsert(prepared(events, self.org, generation))
        schema = "raw_id string, connection_id string, source string, payload string, received_at timestamp, error string"
        self._count_attempts(raw, self.table.spark.read.schema(schema).parquet(f"{self._parked}/batch={name}"), name, F.current_timestamp() if now is None else now)
        if self.after is not None:
            self.after(events)
        return found

    def dead_letters(self) -> DataFrame:
        schema = "raw_id string, connection_id string, source string, payload string, received_at timestamp, error string, batch string"
        try:
            return self.table.spark.read.schema(schema).parquet(self._parked)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.table.spark.createDataFrame([], schema)

    def retry(self, now: Column, batch: str) -> dict[str, int]:
        """Tries again what is due."""
        waiting = due(self.letters.read(), now).select("raw_id")
        held = self.dead_letters().join(waiting, "raw_id", "left_semi").dropDuplicates(["raw_id"])
        return self.process(held.select("raw_id", "connection_id", "payload", "received_at"), batch=batch, now=now)

    def replay(self, repaired: DataFrame) -> dict[str, int]:
        """Parked payloads of this organisation's connections, repaired (raw_id, payload), go
        through the same door; raw_ids that were never parked are refused."""
        parked = self.dead_letters().select("raw_id", "connection_id", "received_at").distinct()
        return self.process(repaired.select("raw_id", "payload").join(parked, "raw_id"))

    def start(self, raw: DataFrame, checkpoint: str) -> StreamingQuery:
        """A streaming query over a raw stream. Each micro-batch is merged once; late data
        needs no watermark, as the generation decides and not the time."""
        return raw.writeStream.foreachBatch(lambda df, i: self.process(df, batch=i) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
