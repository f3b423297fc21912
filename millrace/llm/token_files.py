"""Token ids as Parquet list columns: sorted by document, dictionary or delta
encoded, with controlled row groups and page indexes, so that a reader can fetch the
ids of a few documents, or only their metadata, without the rest.

A file holds doc_id, part, row, n_tokens and ids (a list of ints that ends with the
end id). ``part`` numbers the file ranges in ascending doc_id order and ``row`` the
documents of a part, so the place of any document in the whole id stream is the sum
of the parts before it plus the rows before it.

Ids come from a distinct table of white-space-separated words, which the library
encodes once each per worker; its normaliser and its pattern never look across white
space, so the words' ids joined are the ids of the text.

Cases: null and empty texts are the end id alone; null doc_ids sort first; repeated
rows are each written; an empty table writes an empty file; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow_blocks, kept_by_worker, map_arrow, new_path, release_memory
from millrace.llm.words import quick_hashes, same_spans, word_spans

#: Words whose ids a worker keeps, bytes of the longest one kept, and bytes of a block.
KEPT, KEPT_BYTES, BLOCK = 1_000_000, 64, 1 << 20
#: Bytes of input that one file holds the ids of, if there are more of them than shuffle
#: partitions, and most files, beyond which they grow.
FILE_BYTES, FILES = 128 << 20, 100_000
#: Writer settings: bytes of a row group, rows and bytes of a page. Ids are delta encoded
#: (at about 17 bits, as a dictionary would hold them at 16, for less work), the other
#: columns have dictionaries where those pay.
LAYOUT = {
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20), "parquet.enable.dictionary": "true", "parquet.enable.dictionary#ids.list.element": "false", "parquet.writer.version": "PARQUET_2_0", "compression": "snappy",
}


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Encoder:
    """Ids of many texts at once. A word is found by its hash; known words keep their ids in one array."""

    def __init__(self, path: str):
        self.t = tokenizer(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and the entry of each
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.start, self.text = np.zeros(1, np.int64), np.zeros(0, np.uint8)  # bytes of the entries
        self.again = np.zeros(0, bool)  # entries that a later block has met again

    def _thin(self) -> None:
        """Leaves only words that were met again; most words of a corpus stand in one place."""
        at = np.flatnonzero(self.again[self.slot])
        if 2 * len(at) > KEPT:
            at = at[:0]
        entry = self.slot[at]
        size = self.first[entry + 1] - self.first[entry]
        first = np.append(0, np.cumsum(size))
        self.ids = self.ids[np.arange(first[-1]) + np.repeat(self.first[entry] - first[:-1], size)]
        size = self.start[entry + 1] - self.start[entry]
        start = np.append(0, np.cumsum(size))
        self.text = self.text[np.arange(start[-1]) + np.repeat(self.start[entry] - start[:-1], size)]
        self.keys, self.slot, self.first, self.start, self.again = self.keys[at], np.arange(len(at)), first, start, np.zeros(len(at), bool)

    def _learn(self, words: list[bytes]) -> None:
        got = [e.ids for e in self.t.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.first = np.append(self.first, self.first[-1] + np.cumsum(sizes))
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum())))

    def _known(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places among the kept hashes, which words are kept, and which of these have other
        bytes than the kept one."""
        place = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return place, np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        slot = np.minimum(place, len(self.keys) - 1)
        known, entry = self.keys[slot] == keys, self.slot[slot]
        other = known & ~same_spans(data, start, end, self.text, self.start[entry], self.start[entry + 1])
        return place, known, other

    def _entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
        """The entry of each word, and how many entries stay: those of long words, and of words
        whose hash has another word, are last, for this block alone."""
        keys, at, back = np.unique(quick_hashes(data, start, end), return_index=True, return_inverse=True)
        apart = np.flatnonzero(~same_spans(data, start, end, data, start[at[back]], end[at[back]]))
        place, known, other = self._known(data, keys, start[at], end[at])
        if len(self.keys) + (~known).sum() > KEPT:
            self._thin()
            place, known, other = self._known(data, keys, start[at], end[at])
        entry = np.empty(len(keys), np.int64)
        entry[known] = self.slot[place[known]]
        self.again[entry[known]] = True
        new = np.flatnonzero(~known)
        long = (end - start)[at[new]] > KEPT_BYTES
        stay, n = new[~long], len(self.first) - 1
        passing = np.append(new[long], np.flatnonzero(other))
        order = np.concatenate([at[stay], at[passing], apart])
        if len(order):
            raw = data.tobytes()
            words = [raw[s:e] for s, e in zip(start[order].tolist(), end[order].tolist(), strict=True)]
            self._learn(words)
            entry[stay], entry[passing] = n + np.arange(len(stay)), n + len(stay) + np.arange(len(passing))
            self.keys, self.slot = np.insert(self.keys, place[stay], keys[stay]), np.insert(self.slot, place[stay], entry[stay])
            self.again = np.append(self.again, np.zeros(len(stay), bool))
            self.start = np.append(self.start, self.start[-1] + np.cumsum((end - start)[at[stay]]))
            self.text = np.append(self.text, np.frombuffer(b"".join(words[: len(stay)]), np.uint8))
        found = entry[back]
        found[apart] = n + len(order) - len(apart) + np.arange(len(apart))
        return found, n + len(stay)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids, and the ids."""
        start, stop, word = word_spans(data, offsets)
        at, stay = self._entries(data, start, stop)
        size = self.first[at + 1] - self.first[at]
        before = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        first = before[word] + np.arange(len(word))
        out = np.full(first[-1], end, np.int32)
        keep = np.ones(len(out), bool)
        keep[first[1:] - 1] = False
        out[keep] = self.ids[np.arange(before[-1]) + np.repeat(self.first[at] - before[:-1], size)]
        if stay < len(self.first) - 1:
            self.first, self.ids = self.first[: stay + 1], self.ids[: self.first[stay]]
        return first, out


def encoded(docs: DataFrame, path: str, end: int, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, n_tokens and ids of every row, the end id last."""
    slim = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_by_worker(("words", path), lambda: Encoder(path))
        for batch in batches:
            for lo, hi, data, offsets in arrow_blocks(batch.column(len(keep)), BLOCK):
                first, ids = known.encode(data, offsets, end)
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))], [*keep, "n_tokens", "ids"])
        release_memory()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kinds}, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, tokenizer_path: str, end: int, path: str, partitions: int | None = None) -> None:
    """Writes docs' ids at ``path`` in ascending doc_id order. The texts are dealt out
    by ranges of doc_id and sorted before they are encoded, as they take less room than ids."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if partitions is None:
        # Spark's own estimate from the files' sizes, so no text is read for it.
        size = int(str(slim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        known = size if size < 1 << 50 else 0  # a plan that cannot be estimated gives a huge number
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(FILES, -(-known // FILE_BYTES)))
    ranged = slim.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id")
    placed = ranged.select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"), "text")
    encoded(placed, tokenizer_path, end, ["doc_id", "part", "row"]).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, row, n_tokens, ids. A filter on doc_id reads only the pages that can hold it."""
    return spark.read.schema("doc_id long, part int, row long, n_tokens long, ids array<int>").parquet(path)


def starts(tokens: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """rows (by default doc_id, part, row and n_tokens of tokens) with ``start``: ids of all
    documents before each one, from the metadata columns alone."""
    rows = tokens.select("doc_id", "part", "row", "n_tokens") if rows is None else rows
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each file
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("own", own).join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("own")).drop("own", "before")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, part, row, n_tokens and the crc32 of each document's ids as 32-bit little-endian words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(3)
        raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
        cut = (lists.offsets.to_numpy() * 4).tolist()
        crc = [zlib.crc32(raw[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(lists.offsets.to_numpy()).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    return map_arrow(tokens.select("doc_id", "part", "row", "ids"), run, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, tokenizer_path: str, end: int = 1) -> DataFrame:
    """Writes docs, reads the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, tokenizer_path, end, path)
    tokens = read_tokens(spark, path)
    return starts(tokens, checksums(tokens)).select("doc_id", "start", "n_tokens", "ids_crc32")
