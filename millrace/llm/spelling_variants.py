"""Spelling variants: words that differ by one edit, found by letter-parity bitmasks.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times.
One inserted or deleted letter flips one bit and a replaced one at most two, so of three
bands of bits at least one is the same in both words. Words meet where a band is equal, the
lengths differ by at most one and the masks by at most two bits; what meets is verified by
edit distance.

A band has few different values, so in a large vocabulary thousands of words share one. One
edit also leaves the first or the last half of the longer word alone, so a band's bucket is
dealt by that half: no pair is lost and a bucket holds words that share letters in order.
Each pair meets once: in its first equal band, and in the half that is equal first.

Counting is one Arrow pass over the texts and an aggregation by word; everything after it
works on the vocabulary, in DataFrame functions.

Cases: null and empty texts have no words; a null doc_id reads as an empty text before the
colon; rows may repeat and each counts; no document gives an empty result; words of any
length are compared; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_blocks, map_arrow, small, written
from millrace.llm.words import LOWER, runs

#: A run is altered where this divides its checksum.
ALTERED = 199
#: Least code points and occurrences of a word; times that a form occurs more often at least.
SHORTEST, RAREST, RATIO = 6, 5, 5
BANDS = 3
#: Bytes of text counted together, and of the longest run whose checksum is worked out beside
#: others'; Spark's edit distance, which takes time in the square of a word, is for words no longer.
BLOCK, LONGEST = 4 << 20, 64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _crc_table() -> np.ndarray:
    """The byte steps of the CRC-32 that zlib has."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, np.uint32(0xEDB88320) ^ (x >> np.uint32(1)), x >> np.uint32(1))
    return x


_CRC = _crc_table()


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF, which are two bytes in UTF-8, the first 0xC3."""
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return runs(~inside, offsets)


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of each span behind something whose crc32 is ``before``."""
    size = end - start
    state = ~before
    at, done = np.flatnonzero(size <= LONGEST), 0
    while len(at := at[size[at] > done]):
        state[at] = _CRC[(state[at] ^ data[start[at] + done]) & np.uint32(255)] ^ (state[at] >> np.uint32(8))
        done += 1
    for i in np.flatnonzero(size > LONGEST).tolist():
        state[i] = ~np.uint32(zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i])))
    return ~state


def _block_words(ids: list, data: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
    """values, counts: the words of a block."""
    low = LOWER[data]
    start, end, first = letter_runs(low, offsets)
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = checksums(low, start, end, np.repeat(heads, np.diff(first)))
    points = np.zeros(len(low) + 1, np.int64)
    np.cumsum((low & 0xC0) != 0x80, out=points[1:])
    length = points[end] - points[start]
    changed = crc % ALTERED == 0
    altered = []
    for s, e, cut in zip(start[changed].tolist(), end[changed].tolist(), (crc[changed] % length[changed]).tolist(), strict=True):
        word = low[s:e].tobytes().decode()
        altered.append(word[:cut] + word[cut + 1 :])
    kept = ~changed & (length >= SHORTEST)
    plain = _column(low, start[kept], end[kept])
    return pa.concat_arrays([plain, pa.array([w for w in altered if len(w) >= SHORTEST], pa.large_string())]).value_counts()


def _column(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeStringArray:
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(edge[:-1], dtype=np.int8) > 0]))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of every word of at least SHORTEST code points that occurs at least RAREST times."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in arrow_blocks(batch.column(1), BLOCK):
            found = _block_words(batch.column(0).slice(lo, hi - lo).to_pylist(), data, offsets)
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])

    counted = map_arrow(docs.select(id_col, F.col(text_col).cast("string")), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= RAREST)


def mask(word: Column) -> Column:
    """The parity of each letter: bits 0 to 25 for a to z, 32 more for the letters above."""
    bit = lambda c: F.when(c < 128, c - 97).otherwise(26 + c % 32)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.ascii(c)))))


def _bands() -> list[int]:
    """Letters are dealt to the bands in turn, so that frequent ones are in all of them."""
    return [sum(1 << b for b in range(58) if b % BANDS == k) for k in range(BANDS)]


def _buckets(words: DataFrame, longer: Column) -> DataFrame:
    """word, n, size, mask and, for each band and half, a bucket of pairs whose longer word has
    ``longer`` letters."""
    half = F.floor((F.col("longer") - 1) / 2).cast("int")
    sides = F.array(F.substr("word", F.lit(1), half), F.substr("word", F.col("size") - half + 1, half))
    rows = words.withColumn("longer", F.explode(longer)).withColumn("_sides", sides)
    rows = rows.select("*", F.posexplode("_sides").alias("side", "letters"))
    rows = rows.select("*", F.posexplode(F.array(*[F.col("mask").bitwiseAND(F.lit(b)) for b in _bands()])).alias("band", "bits"))
    return rows.select("word", "n", "size", "mask", "longer", "side", "band", F.xxhash64("longer", "side", "band", "letters", "bits").alias("bucket"))


def near_pairs(words: DataFrame) -> DataFrame:
    """word_1, n_1, word_2, n_2 of each two words (word, n) that one edit makes equal, once."""
    marked = written(words.select("word", "n", F.length("word").alias("size"), mask(F.col("word")).alias("mask")), "masks")
    name = lambda df, i: df.select("bucket", *[F.col(c).alias(f"{c}_{i}") for c in df.columns if c != "bucket"])
    x = name(_buckets(marked, F.array("size")), 1)
    y = name(_buckets(marked, F.array(F.col("size"), F.col("size") + 1)).drop("side", "band"), 2)
    apart = F.col("mask_1").bitwiseXOR(F.col("mask_2"))
    same = [apart.bitwiseAND(F.lit(b)) == 0 for b in _bands()]
    first_band = reduce(lambda rest, k: F.when(F.col("band_1") == k, reduce(lambda a, b: a & ~b, same[:k], same[k])).otherwise(rest), range(BANDS), F.lit(False))
    half = F.floor((F.col("longer_1") - 1) / 2).cast("int")
    first_half = (F.col("side_1") == 0) | (F.substr("word_1", F.lit(1), half) != F.substr("word_2", F.lit(1), half))
    one_way = (F.col("size_2") < F.col("longer_1")) | (F.col("word_1") < F.col("word_2"))
    met = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("longer_1") == F.col("longer_2")) & (F.bit_count(apart) <= 2) & one_way & first_band & first_half)
    short = met.where(f"longer_1 <= {LONGEST} and longer_2 <= {LONGEST}").where(F.levenshtein("word_1", "word_2", 1) == 1)
    long = met.where(f"longer_1 > {LONGEST} and longer_2 > {LONGEST}").select("word_1", "n_1", "word_2", "n_2")
    return short.select("word_1", "n_1", "word_2", "n_2").unionByName(map_arrow(long, _verified, "word_1 string, n_1 long, word_2 string, n_2 long"))


def _verified(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose words are one edit apart, in time linear in the words."""

    def near(a: str, b: str) -> bool:
        same = (i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)
        i = next(same, min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    yield batch.filter(pa.array([near(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.bool_()))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form: where following forms ends. A form occurs RATIO times as
    often, so no chain is longer than the logarithm of a count; each round doubles the steps."""
    own = written(forms, "forms")
    while True:
        onward = small(own).select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = written(own.join(onward, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        own = step.select("word", "root")
        if step.where("moved").isEmpty():
            return own


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = written(vocabulary(docs, id_col, text_col), "words")
    pairs = written(near_pairs(words), "near")
    turned = pairs.select(F.col("word_2").alias("word_1"), F.col("n_2").alias("n_1"), F.col("word_1").alias("word_2"), F.col("n_1").alias("n_2"))
    most = F.min(F.struct((-F.col("n_2")).alias("less"), F.col("word_2").alias("word"))).alias("most")
    near = pairs.unionByName(turned).groupBy(F.col("word_1").alias("near_word")).agg(F.count(F.lit(1)).alias("n_near"), most)
    often = -F.col("most.less") >= RATIO * F.col("n")
    formed = written(words.join(near, F.col("word") == F.col("near_word"), "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("most.word")).alias("form"), F.when(often, -F.col("most.less")).alias("form_n")), "formed")
    ends = roots(formed.where("form is not null").select("word", F.col("form").alias("root")))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
