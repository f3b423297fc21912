"""A paged provider as a streaming source: budgets, failures, restarts."""

import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from millrace.sources.pages import KeyPages, PageLog
from millrace.streaming.incremental import Incremental

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the readers' processes cannot import tests


class Numbers:
    """Records 0 to n - 1, so many a page; the cursor is the next record."""

    schema = "n long"

    def __init__(self, n, size):
        self.n, self.size = n, size

    def following(self, cursor):
        at = int(cursor or 0) + self.size
        return str(at) if at < self.n else None

    def read(self, cursor):
        at = int(cursor or 0)
        yield pa.record_batch([pa.array(range(at, min(at + self.size, self.n)), pa.int64())], ["n"])


@pytest.fixture
def job(spark, tmp_path):
    seen = []

    def make(client, keep=None):
        return Incremental(spark, "numbers", client, str(tmp_path / "state"), keep or (lambda df, i: seen.append((i, sorted(r[0] for r in df.collect())))))

    return make, seen


def test_goes_on_where_it_ended(job):
    make, seen = job
    client = Numbers(10, 2)
    assert not make(client).run(budget=2) and make(client).log.stored() == 2
    assert not make(client).run(budget=2)
    assert make(client).run(budget=2)
    assert [x for _, x in seen] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert make(client).run(again=False) and len(seen) == 3


def test_a_finished_reading_starts_over(job):
    make, seen = job
    assert make(Numbers(3, 2)).run() and make(Numbers(5, 2)).run()
    assert [x for _, x in seen] == [[0, 1, 2], [0, 1, 2, 3, 4]]


def test_a_batch_that_fails_is_read_again(job):
    make, seen = job

    def fail(df, i):
        raise ConnectionError("the table is away")

    client = Numbers(8, 2)
    assert not make(client).run(budget=1)
    with pytest.raises(Exception, match="away"):
        make(client, fail).run(budget=2)
    assert make(client).log.stored() == 1
    assert not make(client).run(budget=2) and make(client).run(budget=2)
    assert sorted(n for _, x in seen for n in x) == list(range(8))


def test_stored_but_not_marked(job, monkeypatch):
    """A run that ends between storing and marking hands the same pages out again, once."""
    make, seen = job
    monkeypatch.setattr(PageLog, "store", lambda self, n: None)
    assert not make(Numbers(6, 2)).run(budget=1)
    monkeypatch.undo()
    assert make(Numbers(6, 2)).run(budget=9)
    assert {n for _, x in seen for n in x} == set(range(6))


def test_a_cursor_that_stands_still_ends(job):
    make, seen = job

    class Stuck(Numbers):
        def following(self, cursor):
            return "4" if cursor else "4"

    assert make(Stuck(8, 4)).run() and [x for _, x in seen] == [[0, 1, 2, 3, 4, 5, 6, 7]]


def test_key_pages(spark, tmp_path):
    spark.range(100).selectExpr("id as k", "id * 2 as v").repartition(3).write.parquet(str(tmp_path / "t"))
    client, cursor, found = KeyPages(str(tmp_path / "t"), "k", 0, 99, 30, "k long, v long"), None, []
    while True:
        found.append(sorted(x for b in client.read(cursor) for x in b.column(0).to_pylist()))
        if (cursor := client.following(cursor)) is None:
            break
    assert [len(x) for x in found] == [30, 30, 30, 10] and sum(found, []) == list(range(100))
