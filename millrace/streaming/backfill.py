"""Backfill: history in slices, under a job that says how far it should go and has gone.

A job is a row of a small table and a state machine: queued, running, then complete,
partial or failed. It has a cursor of its own (``checkpoint``), kept after every page, so
a slice that fails goes on where its last page ended, and walking history does not move the
cursor of the live reading: both can run in either order."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.streaming.kept import Kept
from millrace.streaming.raw import Source, Sync

JOBS = (
    "id string, stream_id string, connection_id string, status string, target_floor timestamp, reached_floor timestamp, checkpoint string, "
    "pages long, rows_imported long, row_ceiling long, detail string, created_at timestamp, started_at timestamp, progress_at timestamp, finished_at timestamp"
)
OPEN, ENDED = ("queued", "running"), ("complete", "partial", "failed")
#: Pages of a slice and rows of a job, if nothing else is said.
PAGES, CEILING = 3, 25_000


def covering(jobs: DataFrame, stream: str, floor: datetime) -> DataFrame:
    """Jobs of the stream that reach as far back, or further, and have not failed; the deepest first."""
    at = F.lit(floor.isoformat(sep=" ")).cast("timestamp")
    return jobs.where((F.col("stream_id") == stream) & (F.col("target_floor") <= at) & (F.col("status") != "failed")).orderBy("target_floor", "id")


@dataclass
class Backfill:
    """The jobs of one connection, kept in ``jobs``."""

    sync: Sync
    jobs: Kept
    clock: Callable[[], datetime]

    def _row(self, job: str) -> dict:
        found = self.jobs.read().where(F.col("id") == job).first()
        if found is None:
            raise ValueError(f"there is no job {job}")
        return found.asDict()

    def _put(self, row: dict) -> dict:
        spark = self.jobs.spark
        names = [c.split()[0] for c in JOBS.split(", ")]
        mine = spark.createDataFrame([tuple(row[c] for c in names)], JOBS)
        self.jobs.write(self.jobs.read().where(F.col("id") != row["id"]).unionByName(mine))
        return row

    def request(self, stream: str, floor: datetime, ceiling: int = CEILING) -> tuple[str, bool]:
        """(job, whether it has to be run): a job that reaches as far back is found again; one of
        this depth that failed is queued again and keeps its checkpoint."""
        floor = floor.replace(hour=0, minute=0, second=0, microsecond=0)
        jobs = self.jobs.read()
        if (deeper := covering(jobs, stream, floor).first()) is not None:
            return deeper["id"], False
        at = F.lit(floor.isoformat(sep=" ")).cast("timestamp")
        failed = jobs.where((F.col("stream_id") == stream) & (F.col("target_floor") == at) & (F.col("status") == "failed")).first()
        if failed is not None:
            return self._put(failed.asDict() | {"status": "queued", "detail": None, "finished_at": None})["id"], True
        blank = dict.fromkeys(c.split()[0] for c in JOBS.split(", "))
        new = {"id": uuid.uuid4().hex, "stream_id": stream, "connection_id": self.sync.connection, "status": "queued", "target_floor": floor, "pages": 0, "rows_imported": 0, "row_ceiling": ceiling, "created_at": self.clock()}
        return self._put(blank | new)["id"], True

    def fail(self, job: str, why: str) -> dict:
        """Ends a job that cannot go on; one that has ended stays as it is."""
        row = self._row(job)
        return row if row["status"] in ENDED else self._put(row | {"status": "failed", "detail": why, "finished_at": self.clock()})

    def slice(self, job: str, source: Source, pages: int = PAGES) -> dict:
        """Runs a job's next pages and gives its row afterwards. A job that has ended is not run.

        It ends complete when the source has nothing left (also if that is less than was asked
        for), and partial when it has imported as many rows as it may. A cursor that stands still
        ends the slice."""
        row = self._row(job)
        if row["status"] in ENDED:
            return row
        row |= {"status": "running", "started_at": row["started_at"] or self.clock()}
        for _ in range(pages):
            page, before = source(row["checkpoint"]), row["checkpoint"]
            name = f"{self.sync.connection}-backfill-{job}-{row['pages'] + 1}"
            found = self.sync.take(page.rows, name, 1)
            oldest = self.sync.ingestion.oldest(self.sync.raw.read(self.sync.ingestion.source, batch=name))
            row |= {"checkpoint": page.cursor, "pages": row["pages"] + 1, "rows_imported": row["rows_imported"] + found["inserted"], "progress_at": self.clock(), "reached_floor": min((x for x in (oldest, row["reached_floor"]) if x is not None), default=None)}
            if row["rows_imported"] >= row["row_ceiling"] and not page.last:
                row |= {"status": "partial", "finished_at": self.clock(), "detail": f"the job's limit of {row['row_ceiling']} rows was reached before its end"}
            elif page.last:
                short = row["reached_floor"] is not None and row["reached_floor"] > row["target_floor"]
                row |= {"status": "complete", "finished_at": self.clock(), "detail": f"the source has nothing before {row['reached_floor']:%Y-%m-%d}" if short else None}
            self._put(row)
            if row["status"] in ENDED or page.cursor == before:
                break
        return row
