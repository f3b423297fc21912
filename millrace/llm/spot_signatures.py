"""Document fingerprints by SpotSigs: wherever a common word (an anchor) stands, the anchor
and the chain of content words that follows it are one signature (of anchors in a row the
last one); a text's fingerprint is its set of signatures, and the likeness of two texts is the Jaccard of their sets.

``similar`` finds all like documents: sets are dealt out by their length, so that a set
meets only sets of its own and the next range of lengths, on signatures that few
documents hold; lengths and positions prune what the full sets then confirm. ``compared``
takes the likeness of stated pairs, exactly: a text and its edited text, and the next one.

Only DataFrame functions are used. Words are lower-cased runs of letters and digits.
The next document in ascending doc_id is found without one global sort: ids are cut
into ordered ranges (quantiles, then equal steps), as many as the texts' bytes need, each
range is sorted on its own, and every range also gets a copy of the first row of the
range after it. An id that fills quantiles alone is cut by its texts' hashes.

Cases: null text is empty; a text without an anchor before a content word is one
signature, its words, and without a word its bytes; the empty text has the empty set,
and two empty sets are alike (1.0); rows without an id come first, ordered by their
text's hash, as do rows of one id; a single document is its own next one; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import small, written

# Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in is a that it for was with as be by on are this at from an or",
    "le la les de des du et en un une que qui dans est pour par au aux ce sur",
    "der die das und zu den von mit ist im ein eine auf nicht dem sich",
    "el los las y una por con para del se al lo como su",
)
#: Content words of a chain; quantiles that cut the ids; bytes of text of a task and most tasks,
#: beyond which they grow; holders of a signature that one task takes.
CHAIN, QUANTILES, TASK_BYTES, TASKS, HOLDERS = 2, 128, 8 << 20, 100_000, 1_000
_OPEN, _SHUT = "\u0001", "\u0002"


def with_spots(df: DataFrame, text: str, out: str, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """df with the column ``out``: the sorted array of the distinct signatures (64-bit
    hashes) of the column ``text``, null where that is null. One step is one column, so
    each regular expression reads a text once."""
    listed = "|".join(sorted(set(" ".join(anchors).split())))
    words = F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "))
    # Anchors become marks on the word behind them.
    every = F.regexp_replace("_words", f"(?:(?<= )|^)({listed})(?: |$)", f"{_OPEN}$1{_SHUT}")
    # Of anchors in a row the last one stays, so a chain is short whatever the text.
    mark, word = f"{_OPEN}[^{_SHUT}]+{_SHUT}", f"[^ {_OPEN}]+"
    marked = F.regexp_replace(every, f"{mark}(?={_OPEN})", "")
    # Looking ahead leaves a chain's marks and words to be found with chains of their own.
    chains = F.regexp_extract_all(marked, F.lit(f"{_OPEN}(?=([^{_SHUT}]+{_SHUT}{word}(?: (?:{mark})?{word}){{0,{chain - 1}}}))"), 1)
    hashed = F.transform(chains, lambda x: F.xxhash64(F.when(F.instr(x, _OPEN) > 0, F.regexp_replace(x, mark, "")).otherwise(x)))
    found = F.array_sort(F.array_distinct(hashed))
    whole = F.when(F.col("_words") != "", F.array(F.xxhash64("_words"))).when(F.col(text) != "", F.array(F.xxhash64(text))).when(F.col(text).isNotNull(), F.array().cast("array<bigint>"))
    return df.withColumn("_words", words).withColumn("_found", found).withColumn(out, F.when(F.size("_found") > 0, F.col("_found")).otherwise(whole)).drop("_words", "_found")


def fingerprint(signatures: Column) -> Column:
    """The set's length and its members, as text: likenesses can be taken from it."""
    return F.concat_ws(":", F.size(signatures), F.array_join(F.transform(signatures, lambda x: F.lower(F.hex(x))), ","))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b)
    return F.when(every == 0, 1.0).otherwise(shared / (every - shared)).cast("double")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (names the set), n (its length), signatures of every document with a set."""
    spots = with_spots(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "_text", "signatures")
    return spots.where(F.size("signatures") > 0).select("doc_id", F.sha2(fingerprint(F.col("signatures")).cast("binary"), 256).alias("key"), F.size("signatures").alias("n"), "signatures")


def similar(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, key) and every pair (a, b, likeness), a < b, of different sets
    whose likeness is percent or more. Documents of one key have one set (likeness 1)."""
    members = written(classes(docs, id_col, text_col), "members")
    sets = written(members.groupBy("key").agg(F.first("n").alias("n"), F.first("signatures").alias("signatures")), "sets")
    one = sets.select("key", "n", F.explode("signatures").alias("signature"))
    shared = written(one.groupBy("signature").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "shared")
    own = Window.partitionBy("key")
    # Rare signatures first; those of one set alone stand before all others and meet nothing.
    place = (F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("holders", "signature"))).alias("place")
    placed = one.join(small(shared), "signature").select("key", "n", "signature", "holders", place)
    # A range of lengths ends where its longest set could not be as alike to its shortest.
    length = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int")
    early = written(placed.where((F.col("n") - F.col("place") + 1) * 100 >= F.col("n") * percent).withColumn("range", length), "early")
    tasks = F.floor(F.col("holders") / HOLDERS).cast("int")
    x = early.select("signature", "range", F.pmod(F.xxhash64("key"), tasks + 1).cast("int").alias("salt"), F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"))
    met = F.explode(F.array(F.col("range") - 1, F.col("range"), F.col("range") + 1)).alias("range")
    y = early.select("signature", met, tasks.alias("tasks"), F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b")).select("*", F.explode(F.sequence(F.lit(0), F.col("tasks"))).alias("salt")).drop("tasks")
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    fits = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (rest * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    pairs = x.join(y, ["signature", "range", "salt"]).where(fits).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("signatures").alias("s")), "a").join(sets.select(F.col("key").alias("b"), F.col("signatures").alias("t")), "b")
    alike = both.select("a", "b", F.size(F.array_intersect("s", "t")).alias("shared"), (F.size("s") + F.size("t")).alias("every"))
    return members.select("doc_id", "key"), alike.where(F.col("shared") * 100 >= (F.col("every") - F.col("shared")) * percent).select("a", "b", (F.col("shared") / (F.col("every") - F.col("shared"))).alias("likeness"))


def _ranges(cuts: list[int], steps: int) -> Column:
    """The number of doc_id's range, order-preserving: each quantile in so many equal steps, an
    id that is a quantile twice or more in as many steps of its texts' hashes."""
    lot = F.col("tie") / 2.0**64 + 0.5
    null = F.least(F.floor(lot * steps), F.lit(steps - 1)) - steps
    if not cuts:
        return null.cast("long")
    values = sorted(set(cuts))
    starts, hot, n = [], {}, 0
    for c in values:
        if (times := cuts.count(c)) > 1:
            hot[c] = (n, times * steps)
            n += times * steps
        starts.append(n)
        n += steps
    low, high, first = (F.array(*[F.lit(x) for x in xs]) for xs in (values, [*values[1:], values[-1] + 1], starts))
    at = F.greatest(F.size(F.filter(low, lambda c: c <= F.col("doc_id"))), F.lit(1))
    width = F.element_at(high, at) - F.element_at(low, at)
    within = F.floor((F.col("doc_id") - F.element_at(low, at)) / width * steps)
    part = F.element_at(first, at) + F.least(F.greatest(within, F.lit(0)), F.lit(steps - 1))
    for c, (start, pieces) in hot.items():
        part = F.when(F.col("doc_id") == c, start + F.least(F.floor(lot * pieces), F.lit(pieces - 1))).otherwise(part)
    return F.when(F.col("doc_id").isNull(), null).otherwise(part).cast("long")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, signatures, edited_signatures, near_edited, near_next
    of every document; the edited text is the text with its last quarter of characters
    replaced by the first ones of the next document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # Only the quantiles, QUANTILES + 1 numbers, and one sum come to the driver.
    cuts, size = slim.agg(F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(TASKS, -(-size // TASK_BYTES)))
    rows = slim.withColumn("part", _ranges(cuts, max(1, -(-4 * tasks // QUANTILES))))
    parts = rows.groupBy("part").agg(F.min(F.struct("doc_id", "tie")).alias("head"))
    around = Window.orderBy("part")
    earlier = F.coalesce(F.lag("part").over(around), F.max("part").over(Window.partitionBy())).alias("earlier")
    heads = written(parts, "parts").select(earlier, F.col("head.doc_id").alias("_id"), F.col("head.tie").alias("_tie"))
    first = rows.join(small(written(heads, "heads")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
    both = rows.withColumn("copy", F.lit(0)).unionByName(first.select("doc_id", "text", "tie", F.col("earlier").alias("part"), F.lit(1).alias("copy"))).repartition(tasks, "part")
    order = Window.partitionBy("part").orderBy("copy", F.col("doc_id").asc_nulls_first(), "tie")
    n = F.length("text")
    last = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - last), F.substring("next", F.lit(1), last))
    texts = both.withColumn("next", F.lead("text").over(order)).select("part", "copy", "doc_id", "tie", "text", F.coalesce(edited, F.lit("")).alias("edited"))
    cut = texts.select("part", "copy", "doc_id", "tie", "text", n.cast("long").alias("n_chars"), F.when(F.col("copy") == 0, F.col("edited")).alias("edited"))
    own = with_spots(with_spots(cut, "text", "signatures").drop("text"), "edited", "edited_signatures").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    near = own.withColumn("next_signatures", F.lead("signatures").over(order)).where("copy = 0")
    return near.select("doc_id", "n_chars", "edited_sha256", "signatures", "edited_signatures", likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"), likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"))


def digest(docs: DataFrame) -> DataFrame:
    return compared(docs).select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("signatures")).alias("fingerprint"), fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"), "near_edited", "near_next")
