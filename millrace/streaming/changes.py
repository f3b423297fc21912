"""A feed of changes under a sync token: what was changed or deleted since the last reading.

A reading asks with the token of the last one (None: for everything there is) and gets pages;
the last page has the next token, and only then the token moves, so a reading that ends
early is made again and changes nothing twice. A token that the provider no longer knows
(``Expired``) forces a full reading under a higher generation, which retires what it did not
meet, once it is complete."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.streaming.kept import Kept
from millrace.streaming.raw import Sync

FEED = "token string, generation int, readings long"
#: Pages of one reading, if nothing else is said.
PAGES = 200


class Expired(Exception):
    """The provider no longer knows the token."""


@dataclass(frozen=True)
class Changes:
    """A page: key, place (the order of changes), deleted, payload, received_at; the cursor of the
    next page, or on the last one the next token."""

    rows: DataFrame
    page: str | None = None
    token: str | None = None


Feed = Callable[[str | None, str | None], Changes]


def last_of_each(changes: DataFrame) -> DataFrame:
    """The last change of each key. Rows are dealt by key once and sorted, not aggregated."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("place")))
    return changes.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def last_deleted(changes: DataFrame) -> DataFrame:
    """The keys whose last change is a deletion; payloads are not read for it."""
    return changes.groupBy("key").agg(F.max_by("deleted", "place").alias("deleted")).where("deleted").select("key")


@dataclass
class ChangeFeed:
    """One connection's feed. ``event_id`` names the stored event of a key."""

    sync: Sync
    event_id: Callable[[Column], Column]

    @property
    def _kept(self) -> Kept:
        return Kept(self.sync.raw.spark, f"{self.sync.raw.path}/feeds/{self.sync.ingestion.source}/{self.sync.connection}", FEED)

    def state(self) -> tuple[str | None, int, int]:
        """Token, generation, readings so far."""
        row = self._kept.read().first()
        return (row["token"], row["generation"], row["readings"]) if row else (None, 1, 0)

    def _apply(self, page: Changes, name: str, generation: int, now: Column) -> dict[str, int]:
        # What a key was before it was deleted is stored as well, so tombstones are alike for any size of page.
        found = self.sync.take(last_of_each(page.rows.where("not deleted")).select("payload", "received_at"), name, generation)
        gone = last_deleted(page.rows).select(self.event_id(F.col("key")).alias("event_id"))
        return found | {"deleted": self.sync.ingestion.table.tombstone(gone, now)}

    def read(self, feed: Feed, now: Column, pages: int = PAGES) -> dict[str, int]:
        """One reading: inserted, updated, deduped, deleted, retired, and whether it was complete."""
        token, generation, readings = self.state()
        try:
            return self._walk(feed, token, generation, readings, now, pages)
        except Expired:
            # Everything is read anew; until that is complete the state says so.
            self._kept.write(self.sync.raw.spark.createDataFrame([(None, generation + 1, readings)], FEED))
            return self._walk(feed, None, generation + 1, readings, now, pages)

    def _walk(self, feed: Feed, token: str | None, generation: int, readings: int, now: Column, pages: int) -> dict[str, int]:
        total, cursor = dict.fromkeys(("inserted", "updated", "deduped", "deleted", "retired", "complete"), 0), None
        for i in range(pages):
            page = feed(token, cursor)
            for k, n in self._apply(page, f"{self.sync.connection}-feed-{generation}-{readings}-{i}", generation, now).items():
                total[k] += n
            cursor = page.page
            if cursor is None:
                if token is None:
                    total["retired"] = self.sync.retire_older(generation, now)
                self._kept.write(self.sync.raw.spark.createDataFrame([(page.token, generation, readings + 1)], FEED))
                return total | {"complete": 1}
        return total
