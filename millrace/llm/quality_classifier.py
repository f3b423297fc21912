"""Quality classifier by Bradley-Terry ranking: document scores are learnt from
preference pairs (a labelled good document against a labelled poor one) by logistic
loss on feature differences; a quantile of the scores is the threshold.

Features come from the text alone. Every labelled row outside the held-out fold is fitted: it stands
in the features' means and spreads, in at least one pair and among the scores that the threshold is a
quantile of (the share of poor documents among all training labels). Each document of the more
frequent label meets the next ones of the other in an order by hash, so there are as many pairs as that
label has documents, and more (up to ``PAIRS``) where labels are few. Newton steps are Spark jobs
that add up whole numbers, so a fit is the same for any order and partition of the rows.

Cases: null text is empty and is scored; a null id is never held out nor learnt from;
labels without a document, null labels and other labels than 0 and 1 are left out, of two
labels of one id the lower one counts, and of texts of one id that of least hash is learnt from;
with one label or none all documents get one score, on that label's side (1 if none);
repeated rows are each scored; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_blocks, map_arrow, ranged, running, small, written
from millrace.llm.quality_rules import measure
from millrace.llm.words import per_text, word_spans

#: Pairs of a fit where each document has one partner and there are fewer, weight of the ridge, Newton steps.
PAIRS, RIDGE, STEPS = 40_000, 1e-3, 25
#: Whole units of a difference and of a probability, so that sums of CHUNK pairs are exact
#: in floating point; documents of the rarer label that are broadcast.
UNIT, FINE, CHUNK, FEW = 1 << 10, 1 << 24, 8_192, 20_000

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "stop": b".,;:", "shout": b"!?", "bar": b"|",
    "symbol": b"#*$%&<>", "bracket": b"()[]{}", "equal": b"=_/\\~^+@", "quote": b"\"'`-", "high": bytes(range(128, 256)), "line": b"\n",
}
_LUT = np.zeros((len(_CLASSES), 256), bool)
for _i, _c in enumerate(_CLASSES.values()):
    _LUT[_i, list(_c)] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text of a block."""
    n_words, word_chars, n_symbols, n_dup, n_repeat = (x.astype(float) for x in measure(data, offsets))
    start, end, first = word_spans(data, offsets)
    size, words = np.maximum(np.diff(offsets), 1), np.maximum(n_words, 1)
    columns = [np.sqrt(per_text(lut[data], offsets) / size) for lut in _LUT]
    # Words by how they begin and end.
    head, tail = (data[start], data[end - 1]) if len(start) else (data[:0], data[:0])
    columns += [per_text(_LUT[i][x], first) / words for i in (0, 1, 3, 4, 6) for x in (head, tail)]
    columns += [np.log1p(n_words), word_chars / words, n_symbols / words, n_dup / words, n_repeat / words, per_text(end - start == 1, first) / words, per_text(end - start > 20, first) / words]
    return np.column_stack(columns)


@dataclass
class Ranker:
    """Standardised features x score x @ w; the threshold and scale map it to (0, 1)."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (standard(x, self.mean, self.scale) * self.w).sum(1)  # a row's sum does not depend on its neighbours

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -30, 30)))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def partners(more: int, fewer: int) -> int:
    """How many documents of the rarer label each one of the other meets."""
    return min(max(1, -(-PAIRS // more)), fewer)


def pair_sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and second derivatives of sum log(1 + exp(-d w)) over pairs, d in units, as whole numbers."""
    width = d.shape[1]
    out = np.zeros(width + width * width, np.int64)
    for lo in range(0, len(d), CHUNK):
        a = d[lo : lo + CHUNK].astype(float)
        p = 1 / (1 + np.exp(np.clip((a / UNIT * w).sum(1), -30, 30)))
        out[:width] += (np.round(p * FINE) @ a).astype(np.int64)
        out[width:] += (np.round(a * (p * (1 - p))[:, None]).T @ a).ravel().astype(np.int64)
    return out


def newton(sums: Callable[[np.ndarray], np.ndarray], pairs: int, width: int) -> np.ndarray:
    """The weights at which the loss of all pairs and the ridge is least."""
    w, ridge = np.zeros(width), RIDGE * pairs * np.eye(width)
    for _ in range(STEPS):
        found = np.asarray(sums(w), float)
        step = np.linalg.solve(found[width:].reshape(width, width) / UNIT**2 + ridge, found[:width] / (FINE * UNIT) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def one_sided(poor: float) -> Ranker:
    """For one label or none: one score for all."""
    width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    return Ranker(np.zeros(width), np.ones(width), np.zeros(width), -1.0 if poor < 0.5 else 1.0)


def fit(x: np.ndarray, label: np.ndarray, poor: float) -> Ranker:
    """What ``fit_rows`` does, of arrays: x are features of labelled documents in the order that
    pairs are made in. poor: share of label 0 in the corpus's labels."""
    if not (0 < poor < 1) or not (0 < label.sum() < len(label)):
        return one_sided(poor)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.round(standard(x, mean, scale) * UNIT)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    more, fewer = (good, bad) if len(good) >= len(bad) else (bad, good)
    each = partners(len(more), len(fewer))
    one = np.tile(np.arange(len(more)), each)
    d = z[more[one]] - z[fewer[(one + np.repeat(np.arange(each), len(more))) % len(fewer)]]
    d = d if more is good else -d
    ranker = Ranker(mean, scale, newton(lambda w: pair_sums(d, w), len(d), z.shape[1]), 0.0)
    s = ranker.raw(x)
    order = np.lexsort([label, s])
    below = np.cumsum(label[order] == 0) * (poor / len(bad)) + np.cumsum(label[order] == 1) * ((1 - poor) / len(good))
    at = min(int(np.argmax(below >= poor * (1 - 1e-12))), len(s) - 2)
    ranker.threshold = float((s[order[at]] + s[order[at + 1]]) / 2)
    return ranker


def _moments(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each feature over all rows, from exact sums."""
    whole = lambda c: F.sum((c * float(1 << 40)).cast("decimal(38,0)"))
    x = [F.col("x")[i] for i in range(width)]
    found = rows.agg(F.count(F.lit(1)), *[whole(c) for c in x], *[whole(c * c) for c in x]).first()
    n = found[0] << 40
    mean = [Fraction(int(v), n) for v in found[1 : width + 1]]
    spread = [max(Fraction(int(v), n) - m * m, Fraction(0)) for v, m in zip(found[width + 1 :], mean, strict=True)]
    return np.array([float(m) for m in mean]), np.maximum(np.sqrt([float(v) for v in spread]), 1e-6)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _pairs(rows: DataFrame, count: dict[int, int], mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """d of each pair: its good document's features less its poor one's, standardised, in units."""
    order = (F.col("lot"), F.col("doc_id"))
    placed = running(ranged(rows.withColumn("lot", F.xxhash64("doc_id")), "lots", *order), {"n_1": F.col("label"), "n_0": 1 - F.col("label")}, *order)
    more = 1 if count[1] >= count[0] else 0
    each = partners(count[more], count[1 - more])
    one = placed.where(F.col("label") == more).select(F.col("x"), F.col(f"n_{more}").alias("rank"), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("turn"))
    one = one.select("x", ((F.col("rank") + F.col("turn")) % count[1 - more]).alias("partner"))
    other = placed.where(F.col("label") == 1 - more).select(F.col("x").alias("y"), F.col(f"n_{1 - more}").alias("partner"))
    met = one.join(F.broadcast(other) if count[1 - more] <= FEW else other, "partner").select("x", "y")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, y = (np.round(standard(_matrix(batch.column(i)), mean, scale) * UNIT) for i in range(2))
        d = (x - y if more else y - x).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), d.shape[1]).cast(pa.list_(pa.int32()))], ["d"])

    return written(map_arrow(met, run, "d array<int>"), "pairs")


def _added(pairs: DataFrame, w: np.ndarray) -> np.ndarray:
    """pair_sums over a table of pairs: a few numbers of each batch are added up by place."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pair_sums(_matrix(batch.column(0)), w)], pa.list_(pa.int64()))], ["v"])

    found = map_arrow(pairs, run, "v array<long>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return np.array([float(r["v"]) for r in sorted(found)])


def _threshold(rows: DataFrame, ranker: Ranker, poor: float, count: dict[int, int]) -> float:
    """The score below which the share ``poor`` of all labelled rows lies."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranker.raw(_matrix(batch.column(1))))], ["label", "s"])

    order = (F.col("s"), F.col("label"))
    placed = running(ranged(map_arrow(rows.select("label", "x"), run, "label int, s double"), "scores", *order), {"bad": 1 - F.col("label"), "good": F.col("label")}, *order)
    below = (F.col("bad") + 1 - F.col("label")) * (poor / count[0]) + (F.col("good") + F.col("label")) * ((1 - poor) / count[1])
    at = placed.where(below >= poor * (1 - 1e-12)).orderBy("s").limit(2).collect()
    if len(at) < 2:
        at = placed.orderBy(F.desc("s")).limit(2).collect()
    return (at[0]["s"] + at[1]["s"]) / 2


def fit_rows(rows: DataFrame, poor: float) -> Ranker:
    """Fits to a written table of labelled documents: doc_id, label, x."""
    count = {0: 0, 1: 0} | {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (0 < poor < 1) or not all(count.values()):
        return one_sided(poor)
    width = len(one_sided(poor).w)
    mean, scale = _moments(rows, width)
    pairs = _pairs(rows, count, mean, scale)
    more, fewer = max(count.values()), min(count.values())
    ranker = Ranker(mean, scale, newton(lambda w: _added(pairs, w), more * partners(more, fewer), width), 0.0)
    ranker.threshold = _threshold(rows, ranker, poor, count)
    return ranker


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def learn(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fits to all labelled rows outside the held-out fold."""
    marked = written(labels.where("quality in (0, 1)").where(fold("doc_id", 3) != 1).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label")), "labels")
    count = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select("doc_id", F.col("text").cast("string")).join(small(marked), "doc_id").select("doc_id", "label", F.xxhash64("text").alias("tag"), "text")
    width = len(one_sided(0.0).w)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in arrow_blocks(batch.column(3)):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64()))], ["doc_id", "label", "tag", "x"])

    # Of documents with one id the text of least hash is learnt from.
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(texts, run, f"doc_id {kind}, label int, tag long, x array<double>").groupBy("doc_id").agg(F.min(F.struct("tag", "label", "x")).alias("r")).select("doc_id", "r.label", "r.x")
    total = sum(count.values())
    return fit_rows(written(rows, "labelled"), count.get(0, 0) / total if total else 0.0)


def scores(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in arrow_blocks(batch.column(2)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(ranker.score(features(data, offsets)))], ["doc_id", "held_out", "score"])

    slim = docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return map_arrow(slim, run, f"doc_id {slim.schema[0].dataType.simpleString()}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
