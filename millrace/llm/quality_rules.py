"""Quality rules with adaptive thresholds: mergeable quantile sketches per language
and source give the limits, and a join with them filters the documents.

The sketch of a rate is its counts over buckets of bounded relative width (an
integer log-linear histogram), so sketches of parts add up to the sketch of the whole.
No threshold is a constant of the code; each is read from the sketches:

- a group (language and source) is placed by its own median, drawn towards its
  language's as far as it has few documents (``PRIOR`` documents of the language count with it);
- the spread is that of the language's usual source: the median, weighted by documents,
  of its sources' distances between median and 90th (10th) percentile. So a source that
  is full of junk, even one with a third of all documents, does not widen its own limits,
  and a source whose ordinary documents differ is judged from where they are;
- the limit is ``reach`` spreads beyond that place. Of a rate that nine documents in ten do not
  have at all, place and spread are nothing; there the limit stands in the middle of the widest
  gap that the upper half of the sketch has: between what some ordinary documents have and what
  stands apart from it. Gaps are measured in ratios, of rates plus one count in a document of the
  group's median length, since less cannot be told apart; the group's gap is drawn towards its
  language's like a place. A group most of which has what its language lacks is judged by its own
  place and gap;
- a document fails when its count exceeds what the limit expects of its length by more than
  ``noise`` standard errors of such a count, so short documents are not judged by one symbol.

``REACH`` counts distances from median to 90th percentile, of which a normal distribution has
its last thousandth 2.4 away and an exponential one 4.3; six leave either whole. ``PRIOR`` is the
size at which the standard error of a median is a tenth of that distance; ``NOISE`` leaves one count in a
thousand beyond it by chance. All three are arguments.

Upper limits hold for symbols, repeated lines, repeated words and characters of a word,
a lower one for characters of a word. A source more than half of which is junk is not
told from a source of another kind: junk is then what is usual there.

Cases: null text is empty and fails the base rules; null language or source is a
group of its own; an empty table gives an empty result; rows may repeat and each is
judged; other columns are passed through by ``filter_documents`` and not read here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow_blocks, map_arrow, small, written
from millrace.llm.words import by_text, per_text, span_hashes, windows, word_spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Rate -> its count; all are thousandths of a word.
RATES = {"symbol_rate": "n_symbols", "dup_line_rate": "n_dup_lines", "repeat_rate": "n_repeat_words", "length_rate": "word_chars"}
#: Rates that can be too low as well.
TWO_SIDED = ("length_rate",)
#: What tells how small a rate the documents of a group can show.
LENGTH = "words"
#: Spreads to a limit, documents of the language that count with a source's own, standard errors.
REACH, PRIOR, NOISE = 6, 100, 3
#: Buckets are 2**-BITS wide at most, relative to their start.
BITS = 5


def _repeats(h: np.ndarray, first: np.ndarray, size: int = 3) -> np.ndarray:
    """Per text, words that stand in a window found twice or more in it."""
    found, text, at = windows(h, first, size)
    covered = np.zeros(len(h) + 1, bool)
    if len(found):
        order = by_text(found, text)
        f, t = found[order], text[order]
        same = (f[1:] == f[:-1]) & (t[1:] == t[:-1])
        twice = np.zeros(len(f), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        for i in range(size):
            covered[hit + i] = True
    return per_text(covered[:-1], first)


def _dup_lines(data: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per text, lines with a word that equal an earlier line of it."""
    cut = np.flatnonzero(data == 10)
    begin = np.union1d(offsets[:-1], cut + 1)
    begin = begin[begin < len(data)]
    text = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], len(data)), offsets[text + 1])
    end = end - (data[np.maximum(end - 1, 0)] == 10) * (end > begin)
    worded = np.searchsorted(start, end) > np.searchsorted(start, begin)
    begin, end, text = begin[worded], end[worded], text[worded]
    h = span_hashes(data, begin, end)
    order = by_text(h, text)
    h, text = h[order], text[order]
    dup = np.zeros(len(h), bool)
    dup[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    return np.bincount(text[dup], minlength=len(offsets) - 1)


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The COUNTS of each text of a block."""
    start, end, first = word_spans(data, offsets)
    points = (data & 0xC0) != 0x80
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    words = np.cumsum(inside[:-1], dtype=np.int8) > 0
    return [np.diff(first), per_text(points & words, offsets), per_text(SYMBOLS[data], offsets), _dup_lines(data, offsets, start), _repeats(span_hashes(data, start, end), first)]


def counted(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the COUNTS of every row. The text is among ``keep`` or read beside them."""
    names = keep if text_col in keep else [*keep, text_col]
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in arrow_blocks(batch.column(at)):
            kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(x, pa.int64()) for x in measure(data, offsets)], [*keep, *COUNTS])

    slim = docs.select(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(keep)])
    return map_arrow(slim, run, f"{kinds}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def rates() -> dict[str, Column]:
    """Thousandths, integers, of documents that pass the base rules."""
    per = F.greatest("n_words", F.lit(1))
    return {name: F.floor(F.col(c) * 1000 / per).cast("long") for name, c in RATES.items()} | {LENGTH: F.col("n_words")}


def bucket(x: Column) -> Column:
    """The start of x's bucket: x without the bits below its BITS + 1 highest."""
    cut = F.greatest(F.length(F.bin(x)) - (BITS + 1), F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", x, cut), cut)


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, rate, bucket, n: one mergeable sketch per language, source and rate."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), bucket(v).alias("bucket")) for k, v in rates().items()])).alias("r")
    return counts.where(~base_failed()).select("lang", "source", named).groupBy("lang", "source", "r.rate", "r.bucket").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, rate, size, low, mid, high: merges the sketches of a group and reads its 10th,
    50th and 90th percentiles."""
    merged = sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rate")
    steps = merged.withColumns({"below": F.sum("n").over(group.orderBy("bucket")), "size": F.sum("n").over(group)})
    at = lambda q: F.min(F.when(F.col("below") * 100 >= F.col("size") * q, F.col("bucket")))
    return steps.groupBy(*by, "rate").agg(F.max("size").alias("size"), at(10).alias("low"), at(50).alias("mid"), at(90).alias("high"))


def _usual(own: DataFrame, spread: Column, name: str) -> DataFrame:
    """lang, rate and the median spread of the language's sources, weighted by documents.
    Spreads are differences of buckets, so a language has few different ones."""
    counted = own.groupBy("lang", "rate", spread.alias("spread")).agg(F.sum("size").alias("n"))
    group = Window.partitionBy("lang", "rate")
    steps = counted.withColumns({"below": F.sum("n").over(group.orderBy("spread")), "all": F.sum("n").over(group)})
    return steps.groupBy("lang", "rate").agg(F.min(F.when(F.col("below") * 2 >= F.col("all"), F.col("spread"))).alias(name))


def _gaps(sketch: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, rate, name: the middle of the widest gap in the upper half of each merged sketch. Both ends are
    taken with one count in a document of the group's median length, and the middle without it."""
    merged = sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rate")
    steps = merged.withColumns({"below": F.sum("n").over(group.orderBy("bucket")), "size": F.sum("n").over(group), "next": F.lead("bucket").over(group.orderBy("bucket"))})
    typical = F.min(F.when((F.col("rate") == LENGTH) & (F.col("below") * 2 >= F.col("size")), F.col("bucket"))).over(Window.partitionBy(*by))
    scaled = steps.withColumn("count", 1000 / F.greatest(typical, F.lit(1))).where(F.col("next").isNotNull() & (F.col("below") * 2 >= F.col("size")) & (F.col("rate") != LENGTH))
    low, high = F.log(F.col("bucket") + F.col("count")), F.log(F.col("next") + F.col("count"))
    widest = F.max(F.struct((high - low).alias("gap"), (F.exp((low + high) / 2) - F.col("count")).alias("middle"))).alias("w")
    return scaled.groupBy(*by, "rate").agg(widest).select(*by, "rate", F.col("w.middle").alias(name))


def thresholds(sketch: DataFrame, reach: float = REACH, prior: int = PRIOR) -> DataFrame:
    """lang, source and for each rate its upper and lower limit, in thousandths."""
    own = written(_quantiles(sketch, ["lang", "source"]), "quantiles")
    wide = _quantiles(sketch, ["lang"]).select("lang", "rate", F.col("mid").alias("wide"))
    up, down = _usual(own, F.col("high") - F.col("mid"), "up"), _usual(own, F.col("mid") - F.col("low"), "down")
    # One row for a language and rate: the parts are stacked, as a null language equals itself in a group.
    columns = ("wide", "up", "down", "wide_gap")
    parts = [df.select("lang", "rate", *[F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns]) for df in (wide, up, down, _gaps(sketch, ["lang"], "wide_gap"))]
    stacked = reduce(DataFrame.union, parts).groupBy(F.col("lang").alias("l"), F.col("rate").alias("r"))
    usual = written(stacked.agg(*[F.max(c).alias(c) for c in columns]), "usual")
    gaps = _gaps(sketch, ["lang", "source"], "gap").toDF("g_lang", "g_source", "g_rate", "gap")
    joined = own.join(small(usual), F.col("lang").eqNullSafe(F.col("l")) & (F.col("rate") == F.col("r")))
    joined = joined.join(small(written(gaps, "gaps")), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")) & (F.col("rate") == F.col("g_rate")), "left")
    apart = F.expm1((F.col("size") * F.log1p(F.coalesce("gap", "wide_gap")) + F.lit(prior) * F.log1p("wide_gap")) / (F.col("size") + F.lit(prior)))
    place = (F.col("size") * F.col("mid") + F.lit(prior) * F.col("wide")) / (F.col("size") + F.lit(prior))
    limits = joined.select("lang", "source", "rate", F.when(F.col("up") > 0, place + reach * F.col("up")).when(F.col("mid") > 0, F.greatest(place, "gap")).otherwise(apart).alias("above"), (place - reach * F.col("down")).alias("below"))
    of = lambda k, c: F.max(F.when(F.col("rate") == k, F.col(c))).alias(f"{k}_{c}")
    return limits.groupBy("lang", "source").agg(*[of(k, "above") for k in RATES], *[of(k, "below") for k in TWO_SIDED])


def beyond(noise: float = NOISE) -> Column:
    """A count exceeds, or falls short of, what a limit expects by more than its noise."""
    failed = F.lit(False)
    for k, c in RATES.items():
        most = F.col(f"{k}_above") * F.col("n_words") / 1000
        failed = failed | (F.col(c) > most + noise * F.sqrt(most + 1))
        if k in TWO_SIDED:
            least = F.greatest(F.col(f"{k}_below"), F.lit(0.0)) * F.col("n_words") / 1000
            failed = failed | (F.col(c) < least - noise * F.sqrt(least + 1))
    return failed


def judged(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """counts with base_failed and kept. A group of which nothing passed the base
    rules has no limits; nothing of it is kept either."""
    f = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = counts.join(f, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(beyond(), F.lit(False))).drop("_lang", "_source", *[c for c in limits.columns if c not in ("lang", "source")])


def quality(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, the COUNTS, base_failed, kept of every document."""
    counts = written(counted(docs, [id_col, "lang", "source"]), "counts")
    limits = small(written(thresholds(written(sketches(counts), "sketches")), "limits"))
    return judged(counts, limits).select(id_col, *COUNTS, "base_failed", "kept")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns. The texts are measured
    twice, once for the sketches and once as they are filtered, which is cheaper than
    writing them out in between."""
    sketch = written(sketches(counted(docs, ["lang", "source"])), "sketches")
    limits = small(written(thresholds(sketch), "limits"))
    own = {"text": "text", "lang": "lang", "source": "source"}
    names = [own.get(c, f"_{i}") for i, c in enumerate(docs.columns)]  # a column may be called n_words
    return judged(counted(docs.toDF(*names), names), limits).where("kept").select(names).toDF(*docs.columns)
