"""A paged provider as a streaming source.

A provider gives records in pages: a page is asked for by a cursor (None: from the start)
and names the next one (None: nothing is left, and the next reading starts over). The
source plans pages and Spark's tasks read them, each page in a task of its own, so no
record passes the driver. Its offset is the number of pages handed out.

Pages are planned once and kept in a log beside the reader's checkpoint, a file for each,
so a batch that fails is read again from the same cursors. What was stored is marked by
``PageLog.store``, after the batch's rows are kept; the next reading goes on behind the mark.
At most ``budget`` pages are planned for a batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Pages of one batch, if nothing else is said.
BUDGET = 20


class Client(Protocol):
    """A provider. ``schema`` are the columns of its records, as DDL."""

    schema: str

    def following(self, cursor: str | None) -> str | None:
        """The cursor of the page after this one, or None."""

    def read(self, cursor: str | None) -> Iterator[pa.RecordBatch]:
        """The records of a page."""


@dataclass(frozen=True)
class KeyPages:
    """A Parquet table in pages by ranges of a whole-number key, each ``span`` keys wide: the
    cursor is the key that a page starts at. Tasks read only the row groups that hold the range."""

    path: str
    key: str
    first: int
    last: int
    span: int
    schema: str

    def following(self, cursor: str | None) -> str | None:
        at = self.first if cursor is None else int(cursor)
        return str(at + self.span) if at + self.span <= self.last else None

    def read(self, cursor: str | None) -> Iterator[pa.RecordBatch]:
        at = self.first if cursor is None else int(cursor)
        fs, path = pa.fs.FileSystem.from_uri(self.path) if "://" in self.path else (None, self.path)
        names = [c.split()[0] for c in self.schema.split(", ")]
        found = ds.dataset(path, filesystem=fs, format="parquet").scanner(columns=names, filter=(ds.field(self.key) >= at) & (ds.field(self.key) < at + self.span))
        yield from found.to_batches()


class PageLog:
    """Planned pages and how many of them are stored, in a folder that driver and readers reach."""

    def __init__(self, path: str):
        self.fs, self.path = pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def _get(self, name: str) -> object | None:
        if self.fs.get_file_info(f"{self.path}/{name}").type == pa.fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return json.loads(f.read())

    def _put(self, name: str, value: object) -> None:
        """Written beside its place and moved, so that a reader meets it whole or not at all."""
        self.fs.create_dir(self.path, recursive=True)
        with self.fs.open_output_stream(f"{self.path}/{name}.new") as f:
            f.write(json.dumps(value).encode())
        self.fs.move(f"{self.path}/{name}.new", f"{self.path}/{name}")

    def stored(self) -> int:
        """How many pages are stored."""
        return int((self._get("stored") or {"pages": 0})["pages"])

    def store(self, pages: int) -> None:
        """Marks so many pages as stored; the mark never falls."""
        if pages > self.stored():
            self._put("stored", {"pages": pages})

    def page(self, i: int) -> dict | None:
        """{cursor, next} of the i-th planned page."""
        return self._get(f"page-{i:09d}")

    def plan(self, client: Client, budget: int) -> int:
        """Plans up to ``budget`` pages behind the stored ones; says how many there are then. A
        plan ends with the page that nothing follows."""
        done = self.stored()
        last = self.page(done - 1) if done else None
        cursor = last["next"] if last else None
        for i in range(done, done + budget):
            known = self.page(i)
            if known is None:
                known = {"cursor": cursor, "next": client.following(cursor)}
                if known["next"] == cursor and cursor is not None:
                    known["next"] = None  # a cursor that does not move ends the reading
                self._put(f"page-{i:09d}", known)
            cursor = known["next"]
            if cursor is None:
                return i + 1
        return done + budget

    def finished(self) -> bool:
        """All that was planned is stored, and nothing follows."""
        done = self.stored()
        return bool(done) and (self.page(done - 1) or {}).get("next") is None


@dataclass
class _Page(InputPartition):
    cursor: str | None


class _Reader(DataSourceStreamReader):
    def __init__(self, client: Client, log: str, budget: int):
        self.client, self.log, self.budget = client, log, budget

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": PageLog(self.log).plan(self.client, self.budget)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        log = PageLog(self.log)
        return [_Page(log.page(i)["cursor"]) for i in range(start["pages"], end["pages"])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.client.read(partition.cursor)


def paged_source(label: str, client: Client) -> type[DataSource]:
    """A source to register: ``spark.readStream.format(label).option("log", path).option("budget", pages)``."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return client.schema

        def streamReader(self, schema: object) -> DataSourceStreamReader:
            return _Reader(client, self.options["log"], int(self.options.get("budget", BUDGET)))

    return Paged
