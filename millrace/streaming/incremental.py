"""Incremental reading of a paged provider with Structured Streaming: a batch of pages is
stored, then marked as stored; a reading that ends early goes on behind the mark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.pages import BUDGET, Client, PageLog, paged_source


@dataclass
class Incremental:
    """One job of one connection: ``keep(rows, batch)`` stores a batch of its records and must give
    the same result when it is called again with the same batch. ``state`` is the job's folder:
    its page log, its batches' offsets. Jobs with folders of their own do not meet."""

    spark: SparkSession
    label: str
    client: Client
    state: str
    keep: Callable[[DataFrame, int], None]

    @property
    def log(self) -> PageLog:
        return PageLog(f"{self.state}/pages")

    def run(self, budget: int = BUDGET, again: bool = True) -> bool:
        """Reads at most ``budget`` pages; True once nothing is left. A finished reading starts
        over with the next run, unless ``again`` is False."""
        log = self.log
        if not again and log.finished():
            return True
        self.spark.dataSource.register(paged_source(self.label, self.client))
        rows = self.spark.readStream.format(self.label).option("log", f"{self.state}/pages").option("budget", str(budget)).load()
        planned = log.plan(self.client, budget)

        def store(batch: DataFrame, i: int) -> None:
            self.keep(batch, i)

        query = rows.writeStream.foreachBatch(store).option("checkpointLocation", f"{self.state}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        log.store(planned)
        return log.finished()
