"""Mixing sources to target weights by Pareto order sampling.

Each source gets a number of words: its share of all words by weight, at most ``most``
times its own, the excess shared anew among the others. Every document of a source
gets ``floor(target / size)`` certain copies; what is left of the target is a sample of
its documents without replacement, of a fixed size in words.

Inclusion probabilities are proportional to a document's words, as large as the words
left allow: chance = k * size with the sum of chance * size equal to what is left. Where
that is 1 or more the document is certain, its words are set apart and k is found anew for
the rest. Documents are ranked by random odds divided by inclusion odds, u / (1 - u) over
chance / (1 - chance), and the first ones are taken until the left words are reached, the
last one only if it brings the sum nearer, so a source misses its target by half a document
at most. u is a hash of the id and a seed, so reruns agree.

k comes from a table of a source's different sizes, which is as long as its longest
document at most. The order is not made by one sort of a source: ranks fall into ``BINS``
bins, the bins' word sums (a small table) show the bin in which the target is reached, lower
bins are taken whole, and only that one bin of each source is sorted. Sources themselves are
put in order range by range, so that they may be as many as web domains.

Only DataFrame functions are used. Cases: null text has no words and is never drawn
for a sample; a null source is a source, the last by code point; documents without an
id are told apart by their text's hash; repeated rows tie and are each one document;
an empty table, or one without words, takes nothing; clashing column names do not matter,
as only id, source and text are read and ``mix_documents`` renames the rest meanwhile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import ranged, running, small, uniform, written

#: Weights of sources by code point, repeating; most copies of a document; bins of ranks.
WEIGHTS, MOST, BINS = (1, 2, 3), 3, 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n_docs -> with target: one row per source.

    A source at its limit stops there; the others share what is left by weight. In the
    order of limit / weight, the first k sources stop for the least k at which the next
    one's share stays within its limit. All sums are of whole numbers, so exact.
    """
    name = F.col("source").asc_nulls_last()
    numbered = running(ranged(sizes, "by_name", name), {"place": F.lit(1)}, name)
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).cast("long")).drop("part", "place")
    limit = (F.col("source_size") / F.col("weight"), name)
    by_limit = ranged(weighed, "by_limit", *limit)
    total, shares = by_limit.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    steps = running(by_limit, {"stopped": F.col("source_size") * most, "gone": F.col("weight")}, *limit)
    level = (F.lit(total).cast("double") - F.col("stopped")) / (F.lit(shares) - F.col("gone"))
    fits = level * F.col("weight") <= F.col("source_size") * most
    # The first source in this order whose share fits sets the level of all after it.
    first = steps.where(fits).agg(F.min(F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", level.alias("level")))["level"]).first()[0]
    stop = (F.col("source_size") * most).cast("double")
    target = F.least(stop, F.lit(first).cast("double") * F.col("weight")) if first is not None else stop
    return by_limit.select("source", "source_size", "n_docs", target.alias("target"))


def chances(plan: DataFrame, by_size: DataFrame) -> DataFrame:
    """plan (source, left, ...) with cut and k: documents of more words than cut are certain
    to be in the sample, others have the chance k * size. by_size: source, size, n."""
    fits = F.col("source").eqNullSafe(F.col("_source"))
    sizes = by_size.where("size > 0").withColumnRenamed("source", "_source").join(small(plan.where("left > 0").select("source", "left")), fits).drop("_source")
    down = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("source").orderBy("size")
    larger = F.coalesce(F.sum(F.col("size") * F.col("n")).over(down), F.lit(0))
    squares = F.sum((F.col("size") * F.col("size")).cast("decimal(38,0)") * F.col("n")).over(up).cast("double")
    steps = sizes.select("source", "size", (F.col("left") - larger).alias("rest"), squares.alias("squares"))
    found = steps.where(F.col("rest") * F.col("size") < F.col("squares")).groupBy(F.col("source").alias("_source")).agg(F.max(F.struct("size", (F.col("rest") / F.col("squares")).alias("k"))).alias("c"))
    return plan.join(small(written(found.select("_source", F.col("c.size").alias("cut"), F.col("c.k").alias("k")), "chances")), fits, "left").drop("_source")


def copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, size, u (and more) -> with source_size, target, chance and copies of each row.
    ``sized`` is read several times, so give a written table."""
    by_size = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "by_size")
    sources = written(targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")), weights, most), "sources")
    certain = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    plan = sources.withColumn("certain", certain).withColumn("left", F.col("target") - F.col("certain") * F.col("source_size")).drop("n_docs")
    plan = written(chances(plan, by_size), "plan").withColumnRenamed("source", "_source")
    rows = sized.join(small(plan), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    chance = F.when((F.col("size") == 0) | (F.col("left") <= 0), 0.0).when(F.col("cut").isNull() | (F.col("size") > F.col("cut")), 1.0).otherwise(F.col("k") * F.col("size"))
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("chance")) / F.col("chance")
    rank = F.when(F.col("chance") <= 0, 1.0).when(F.col("chance") >= 1, 0.0).otherwise(odds / (1 + odds))
    ranked = rows.withColumn("chance", chance).drop("cut", "k").withColumn("rank", rank).withColumn("bin", F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)).cast("int"))
    bins = ranked.where("chance > 0").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    reached = bins.withColumn("below", upto - F.col("words")).where("below < left and below + words >= left")
    edge = written(reached.select(F.col("source").alias("_source"), F.col("bin").alias("edge"), "below"), "edges")
    placed = ranked.join(small(edge), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    taken = F.when((F.col("chance") > 0) & (F.col("bin") < F.coalesce("edge", F.lit(BINS))), 1).otherwise(0)
    clear = placed.where("edge is null or bin != edge").withColumn("copies", F.col("certain") + taken)
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "tie").rowsBetween(Window.unboundedPreceding, 0))
    within = placed.where("bin = edge").withColumn("upto", F.col("below") + upto)
    # Takes a document while half of it still lies before the end.
    near = (F.col("chance") > 0) & (F.col("upto") - F.col("size") / 2.0 <= F.col("left"))
    sampled = within.withColumn("copies", F.col("certain") + near.cast("int")).drop("upto")
    return clear.unionByName(sampled).drop("rank", "bin", "edge", "below", "left", "certain")


def sized(docs: DataFrame, keep: list[str] | None = None, seed: str | None = None) -> DataFrame:
    """id, source, size, u, tie of every document. Another seed draws another sample."""
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.col("doc_id").cast("long"))
    u = uniform(*([F.lit(seed)] if seed else []), F.when(F.col("doc_id").isNull(), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text"), F.lit(""))))).otherwise(F.col("doc_id").cast("string")))
    return docs.select(F.col("doc_id").alias("id"), "source", n_words(F.col("text")).alias("size"), u.alias("u"), tie.alias("tie"), *(keep or []))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, chance, taken, copies of every document."""
    out = copies(written(sized(docs, seed=seed), "sizes"), weights, most)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "chance", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str | None = None) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Decisions are made on sizes
    alone and joined to the texts by id and text hash, so a repeated row is one document."""
    slim = written(sized(docs, [F.xxhash64("text").alias("hash")], seed), "sizes")
    chosen = written(copies(slim.groupBy("id", "hash", "source", "u", "tie").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), weights, most).select("id", "hash", "copies", F.col("source").alias("_source")), "copies")
    names = [f"_{i}" for i in range(len(docs.columns))]
    own = {c: n for c, n in zip(docs.columns, names, strict=True)}
    rows = docs.toDF(*names).withColumn("_hash", F.xxhash64(own["text"]))
    on = F.col(own["doc_id"]).eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash")) & F.col(own["source"]).eqNullSafe(F.col("_source"))
    joined = rows.join(small(chosen), on).where("copies > 0")
    return joined.select(*names, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(names).toDF(*docs.columns)
