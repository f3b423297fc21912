"""The raw store, and reading a source again and again: intake, reprocessing, cursor pages,
full re-reads.

Payloads are kept as they came, in Parquet by source and day of receipt, and never
changed; events can be made from them anew at any time. A *source* here is a function of a
cursor (None: from the start) that gives a ``Page``: payloads, the next cursor, whether the
read is complete. Each job of a connection (``live``, a backfill, a feed) has a cursor of its
own, so jobs can run in any order, and one that fails goes on where its last page ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.streaming.ingest import Ingestion, retire_older
from millrace.streaming.kept import Kept

RAW_SCHEMA = "raw_id string, connection_id string, payload string, received_at timestamp, delivery string"
#: Bytes of the largest payload that a webhook may deliver.
MAX_BYTES = 1_000_000


@dataclass(frozen=True)
class Page:
    """payload, received_at of one page; the cursor of the next one (None: nothing is left);
    whether all was read."""

    rows: DataFrame
    cursor: str | None
    complete: bool = False

    @property
    def last(self) -> bool:
        return self.complete or self.cursor is None


Source = Callable[[str | None], Page]


def accepted(raw: DataFrame, most: int | None = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(payloads to keep, refused ones with the reason): empty ones are refused, and too large
    ones if there is a limit. Deliveries of one id on one connection are kept once, the first received."""
    why = F.when(F.col("payload").isNull() | (F.trim("payload") == ""), "the payload is empty")
    if most is not None:
        why = why.when(F.octet_length("payload") > most, F.concat(F.lit("the payload has more than "), F.lit(str(most)), F.lit(" bytes")))
    judged = raw.withColumn("error", why)
    good = judged.where("error is null").drop("error")
    once = F.coalesce(F.concat(F.lit("delivery:"), F.col("delivery")), F.concat(F.lit("raw:"), F.col("raw_id"))) if "delivery" in raw.columns else F.col("raw_id")
    first = F.min_by(F.struct(*good.columns), F.struct("received_at", "raw_id")).alias("r")
    return good.groupBy("connection_id", once.alias("_once")).agg(first).select("r.*"), judged.where("error is not null")


def prunable(raw: DataFrame, dead: DataFrame, connections: DataFrame, before: Column) -> Column:
    """raw's columns and whether retention may drop a row: received before then, its connection
    disabled before then, no unresolved dead letter of it."""
    gone = connections.where(F.col("disabled_at").isNotNull() & (F.col("disabled_at") < before)).select(F.col("id").alias("_gone"))
    held = dead.where("resolved_at is null").select(F.col("raw_id").alias("_held")).distinct()
    marked = raw.join(gone, F.col("connection_id") == F.col("_gone"), "left").join(held, F.col("raw_id") == F.col("_held"), "left")
    free = (F.col("received_at") < before) & F.col("_gone").isNotNull() & F.col("_held").isNull()
    return marked.withColumn("_free", F.coalesce(free, F.lit(False))).drop("_gone", "_held")


@dataclass
class RawStore:
    """Raw payloads in Parquet at ``path``, by source, day of receipt and batch; a batch that is
    written again takes its own place. Reads of some days list and open no others."""

    spark: SparkSession
    path: str

    @property
    def _payloads(self) -> str:
        return f"{self.path}/payloads"

    def append(self, raw: DataFrame, source: str, batch: str | None = None) -> None:
        have = set(raw.columns)
        columns = [F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in RAW_SCHEMA.split(", "))]
        placed = raw.select(*columns, F.lit(source).alias("source"), F.to_date("received_at").alias("day"), F.lit(batch or uuid.uuid4().hex).alias("batch"))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "day", "batch").parquet(self._payloads)

    def _all(self, source: str) -> DataFrame:
        try:
            df = self.spark.read.schema(f"{RAW_SCHEMA}, source string, day date, batch string").parquet(self._payloads)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            df = self.spark.createDataFrame([], f"{RAW_SCHEMA}, source string, day date, batch string")
        return df.where(F.col("source") == source)

    def read(self, source: str, connection: str | None = None, since: date | None = None, until: date | None = None, batch: str | None = None) -> DataFrame:
        """All payloads of a source, or those of a connection, of days from ``since`` to ``until``, of a batch."""
        df = self._all(source)
        for column, wanted in (("connection_id", connection), ("batch", batch)):
            df = df if wanted is None else df.where(F.col(column) == wanted)
        df = df if since is None else df.where(F.col("day") >= F.lit(since))
        return (df if until is None else df.where(F.col("day") <= F.lit(until))).select(*[c.split()[0] for c in RAW_SCHEMA.split(", ")])

    def _drop(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def expiring(self, source: str, dead: DataFrame, connections: DataFrame, before: datetime) -> DataFrame:
        """day, rows, free: how many rows each day up to ``before`` has and how many of them
        retention may drop. Later days are not read."""
        limit = F.lit(before.isoformat(sep=" ")).cast("timestamp")
        old = self._all(source).where(F.col("day") <= F.lit(before.date()))
        return prunable(old.select("raw_id", "connection_id", "received_at", "day"), dead, connections, limit).groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.count_if("_free").alias("free"))

    def prune(self, source: str, dead: DataFrame, connections: DataFrame, before: datetime) -> dict[str, int]:
        """Drops what retention may drop: days of which nothing stays go as a whole, without their
        payloads being read; the others are rewritten beside their place and moved there."""
        days = self.expiring(source, dead, connections, before).where("free > 0").collect()  # a row for each old day
        mixed = [r for r in days if r["free"] < r["rows"]]
        if mixed:
            limit = F.lit(before.isoformat(sep=" ")).cast("timestamp")
            rows = self._all(source).where(F.col("day").isin([r["day"] for r in mixed]))
            staged = f"{self.path}/staged/{uuid.uuid4().hex}"
            prunable(rows, dead, connections, limit).where("not _free").drop("_free").write.partitionBy("source", "day", "batch").parquet(staged)
            kept = self.spark.read.schema(f"{RAW_SCHEMA}, source string, day date, batch string").parquet(staged)
            emptied = rows.select("day", "batch").distinct().join(kept.select("day", "batch").distinct(), ["day", "batch"], "left_anti").collect()  # batches, not payloads
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "day", "batch").parquet(self._payloads)
            for r in emptied:
                self._drop(f"{self._payloads}/source={source}/day={r['day']}/batch={r['batch']}")
            self._drop(staged)
        for r in days:
            if r["free"] == r["rows"]:
                self._drop(f"{self._payloads}/source={source}/day={r['day']}")
        return {"dropped": sum(r["free"] for r in days), "days": len(days) - len(mixed), "rewritten": len(mixed)}


@dataclass
class Sync:
    """One connection of a source, read through its raw store into the events table."""

    ingestion: Ingestion
    raw: RawStore
    connection: str
    _read: dict = field(default_factory=dict)

    def _cursors(self, job: str) -> Kept:
        return Kept(self.raw.spark, f"{self.raw.path}/cursors/{self.ingestion.source}/{self.connection}/{job}", "cursor string, at long")

    def cursor(self, job: str = "live") -> tuple[str | None, int]:
        """Where the job's last read ended (null: from the start), and how many pages it has read."""
        if job not in self._read:
            row = self._cursors(job).read().first()
            self._read[job] = (row["cursor"], row["at"]) if row else (None, 0)
        return self._read[job]

    def mark(self, job: str, cursor: str | None, at: int) -> None:
        self._cursors(job).write(self.raw.spark.createDataFrame([(cursor, at)], "cursor string, at long").coalesce(1))
        self._read[job] = (cursor, at)

    def take(self, rows: DataFrame, name: str, generation: int) -> dict[str, int]:
        """A page's payloads (payload, received_at) are kept first, whatever their size, then made
        into events, from the store. What cannot be made into one is parked under the page's name."""
        # Equal payloads are one, the first received; the id is made of what is left.
        rest = [F.min_by(c, "received_at").alias(c) for c in rows.columns if c not in ("payload", "received_at")]
        once = rows.groupBy("payload").agg(F.min("received_at").alias("received_at"), *rest)
        made = once.withColumn("connection_id", F.lit(self.connection)).withColumn("raw_id", F.sha2(F.concat_ws(":", F.lit(self.connection), "payload").cast("binary"), 256))
        self.raw.append(made, self.ingestion.source, name)
        return self.ingestion.process(self.raw.read(self.ingestion.source, batch=name), generation, batch=name)

    def incremental(self, source: Source, generation: int = 1, pages: int = 20, job: str = "live") -> dict[str, int]:
        """Reads on from the job's cursor, at most so many pages; the cursor moves after each page
        is stored, so a page may come twice and changes nothing then. A null cursor ends the
        reading and is kept: the next one starts over. A cursor that stands still ends it too."""
        total, (cursor, at) = {"inserted": 0, "updated": 0, "deduped": 0}, self.cursor(job)
        for _ in range(pages):
            page = source(cursor)
            for k, n in self.take(page.rows, f"{self.connection}-{job}-{at + 1}", generation).items():
                total[k] += n
            stands = page.cursor == cursor
            cursor, at = page.cursor, at + 1
            self.mark(job, cursor, at)
            if page.last or stands:
                break
        return total

    def resync(self, source: Source, generation: int, now: DataFrame | object, pages: int = 200) -> dict[str, int]:
        """Reads everything anew under a higher generation. Only a read that was complete retires
        what it did not meet; one that ended early retires nothing."""
        total, cursor, complete = {"inserted": 0, "updated": 0, "deduped": 0}, None, False
        for i in range(pages):
            page = source(cursor)
            for k, n in self.take(page.rows, f"{self.connection}-generation-{generation}-{i}", generation).items():
                total[k] += n
            cursor, complete = page.cursor, page.last
            if complete:
                break
        if complete:
            total["retired"] = self.retire_older(generation, now)
        return total | {"complete": int(complete)}

    def retire_older(self, generation: int, now: Column) -> int:
        """Polled rows of older generations become tombstones. Only buckets that hold such rows are rewritten."""
        old = (F.col("connection_id") == self.connection) & (F.col("sync_generation") >= 1) & (F.col("sync_generation") < generation) & F.col("deleted_at").isNull()
        return self.ingestion.table.change(old, lambda rows: retire_older(rows, self.connection, generation, now))

    def reprocess(self, generation: int = 0) -> dict[str, int]:
        """Makes events of every kept payload of the connection anew."""
        return self.ingestion.process(self.raw.read(self.ingestion.source, self.connection), generation)
