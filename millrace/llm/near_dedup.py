"""MinHash near-duplicates: one-permutation hashing with optimal densification,
banded buckets, star-shaped candidate edges, links confirmed on full shingle sets.

Cases: null or wordless text has an empty set and links with nothing; a text with
fewer words than a shingle has one shingle, its whole sequence; equal sets are one
class whatever their number; a null doc_id takes part, and a class whose ids are
all null has a null component_id. Rows may repeat: each gets its row. Columns
other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow_blocks, map_arrow, small, written
from millrace.llm.words import LOWER, by_text, mix, span_hashes, windows, word_spans

BINS, ROWS, BANDS = 128, 5, 25
#: Times that members which failed their star's centre get another centre, before all pairs
#: that are still untested meet in a join; holders of a shingle that one task of it takes; groups
#: whose middles are broadcast.
RESTARS, HOLDERS, MIDDLES = 2, 1_000, 20_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the offsets of each text's run."""
    start, end, first = word_spans(data, offsets)
    h = span_hashes(LOWER[data], start, end)
    found, text, _ = windows(h, first, size)
    count = np.diff(first)
    for short in range(1, size):
        at = np.flatnonzero(count == short)
        whole = np.full(len(at), np.uint64(short))
        for i in range(short):
            whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + h[first[at] + i])
        found, text = np.append(found, whole), np.append(text, at)
    order = by_text(found, text)
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    found, text = found[new], text[new]
    return found, np.searchsorted(text, np.arange(len(offsets)))


def set_keys(found: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """16 bytes that name a set: two sums of scrambled members."""
    sums = np.zeros((len(found) + 1, 2), np.uint64)
    np.cumsum(mix(found ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:, 0])
    np.cumsum(mix(found + np.uint64(0x14057B7EF767814F)), out=sums[1:, 1])
    keys = np.ascontiguousarray(sums[first[1:]] - sums[first[:-1]]).astype(">u8").tobytes()
    return [keys[16 * i : 16 * i + 16] if first[i + 1] > first[i] else None for i in range(len(first) - 1)]


def one_permutation(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least hash in each of BINS ranges of the hash space, for each non-empty set.
    An empty bin takes the value of the first filled bin that its own sequence of
    hashed tries meets, so two sets with equal filled bins choose alike."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = (found >> np.uint64(57)).astype(np.int64)
    least = np.ones(len(found), bool)
    least[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    values = np.zeros((len(first) - 1, BINS), np.uint64)
    filled = np.zeros(values.shape, bool)
    values[text[least], place[least]] = found[least]
    filled[text[least], place[least]] = True
    bins, tries = np.arange(BINS, dtype=np.uint64), 0
    row, col = np.nonzero(~filled & (np.diff(first) > 0)[:, None])
    while len(row):
        tries += 1
        donors = (mix(bins * np.uint64(0x2545F4914F6CDD1D) + np.uint64(tries)) >> np.uint64(57)).astype(np.int64)
        donor = donors[col]
        ok = filled[row, donor]
        values[row[ok], col[ok]] = values[row[ok], donor[ok]]
        row, col = row[~ok], col[~ok]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    out = np.empty((len(values), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(values), np.uint64(band + 1))
        for i in range(ROWS):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + values[:, band * ROWS + i])
        out[:, band] = h
    return out


def signatures(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tag (a hash of the text), n (set size), key (names the set), b0.. (band keys)."""
    bands = [f"b{i}" for i in range(BANDS)]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in arrow_blocks(batch.column(2)):
            found, first = shingle_sets(data, offsets, size)
            keys = band_keys(one_permutation(found, first)).view(np.int64)
            columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), pa.array(set_keys(found, first), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(keys[:, i]) for i in range(BANDS)], ["id", "tag", "n", "key", *bands])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(slim, run, "id long, tag long, n long, key binary, " + ", ".join(f"{b} long" for b in bands))


def _sets(docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """key, shingles of each text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, _, data, offsets in arrow_blocks(batch.column(0)):
            found, first = shingle_sets(data, offsets, size)
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(found, first), pa.binary()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found.view(np.int64)))], ["key", "shingles"])

    return map_arrow(docs.select(F.col(text_col).cast("string")), run, "key binary, shingles array<long>").where("key is not null").dropDuplicates(["key"])


def _stars(members: DataFrame, again: bool) -> DataFrame:
    """bucket, key, n -> bucket, key, centre: every member of a shared bucket meets one member. It
    is chosen by a hash of its own, so that copies that share many buckets have one centre in most of them
    and few different pairs; members that failed that centre get others by a hash that differs
    from bucket to bucket."""
    lot = F.struct((F.xxhash64("key", "bucket") if again else F.xxhash64("key")).alias("lot"), "key", "n")
    shared = members.groupBy("bucket").agg(F.min(lot).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1")
    centres = small(written(shared.select("bucket", F.col("c.key").alias("centre"), F.col("c.n").alias("centre_n")), "centres"))
    return members.join(centres, "bucket").where("key != centre")


def _long_enough(a: Column, b: Column, percent: int) -> Column:
    """Sets of these sizes can be as alike as percent."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _judged(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """a, b, linked of each of pairs, by their full sets."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return written(both.select("a", "b", (shared * 100 >= (F.size("x") + F.size("y") - shared) * percent).alias("linked")), "judged")


def _sets_of(docs: DataFrame, nodes: DataFrame, keys: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """key, shingles of the nodes in keys: one text of each, so copies are not read again."""
    wanted = small(written(nodes.join(keys, "key", "left_semi").select("own").distinct(), "wanted"))
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tag")).alias("own"), F.col(text_col).alias("text"))
    texts = rows.join(wanted, rows["own"].eqNullSafe(wanted["own"]), "left_semi")
    return written(_sets(texts, size, "text"), "sets")


def links(docs: DataFrame, nodes: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Confirmed links (a, b) between different sets, a < b: of those that share a band
    all that components need."""
    bucket = F.explode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("bucket")
    everyone = nodes.select("key", "n", bucket)
    members, found, known, unsure, sets = everyone, None, None, None, None
    for i in range(RESTARS + 1):
        stars = written(_stars(members, again=i > 0), "stars")
        if sets is None:
            sets = _sets_of(docs, nodes, stars.select(F.explode(F.array("key", "centre")).alias("key")).distinct(), size, id_col, text_col)
        pairs = stars.where(_long_enough(F.col("n"), F.col("centre_n"), percent)).select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()
        if known is not None:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        judged = _judged(sets, pairs, percent)
        known = judged if known is None else known.union(judged)
        found = known.where("linked").select("a", "b")
        a, b = F.least("key", "centre"), F.greatest("key", "centre")
        failed = stars.withColumns({"a": a, "b": b}).join(found, ["a", "b"], "left_anti").select("key", "n", "bucket")
        members = written(failed, "members")
        unsure = members.select("bucket").distinct() if unsure is None else unsure
        if members.isEmpty():
            break
    groups = _unsettled(everyone.join(unsure, "bucket", "left_semi"), components(found))
    if groups.isEmpty():
        return found
    differing = _differences(sets, groups, percent)
    stars, merged = _nearest(differing)
    pairs = written(_candidates(merged, percent).union(stars).distinct().join(known, ["a", "b"], "left_anti"), "pairs")
    return found.union(_judged(sets, pairs, percent).where("linked").select("a", "b"))


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """group, key, n, root of all members, linked ones too, of the buckets in which a pair can
    be untested: more than two members, and not all of one component. Buckets with the same
    largest component are one group, named by it; a key is in the groups of all its buckets."""
    rooted = written(members.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
    parts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("rows"))
    largest = F.max(F.struct("rows", "root"))["root"].alias("group")
    many = parts.groupBy("bucket").agg(F.sum("rows").alias("size"), F.count(F.lit(1)).alias("parts"), largest).where("size > 2 and parts > 1")
    found = rooted.join(small(written(many.select("bucket", "group"), "mixed")), "bucket")
    return written(found.select("group", "key", "n", "root").distinct(), "unsettled")


def _differences(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """group, key, root, excess, differing: what a set and its group's middle do not share. The
    middle holds the shingles that more than half of the group have. Sets differ in d1 + d2 - 2 s
    shingles, s of them the same difference from the middle, so with excess = d (100 + percent) -
    n (100 - percent) they are linked if and only if excess1 + excess2 <= 2 s (100 + percent),
    whatever the middle is."""
    sizes = written(groups.groupBy("group").agg(F.count(F.lit(1)).alias("members")), "sizes")
    grouped = groups.join(small(sizes), "group").join(sets, "key")
    held = grouped.select("group", "members", F.explode("shingles").alias("shingle")).groupBy("group", "members", "shingle").agg(F.count(F.lit(1)).alias("holders"))
    middles = written(held.where("holders * 2 > members").groupBy("group").agg(F.collect_list("shingle").alias("middle")), "middles")
    both = grouped.join(small(middles, MIDDLES), "group", "left").withColumn("middle", F.coalesce("middle", F.array().cast("array<long>")))
    found = both.select("group", "key", "n", "root", F.concat(F.array_except("shingles", "middle"), F.array_except("middle", "shingles")).alias("differing"))
    excess = (F.size("differing").cast("long") * (100 + percent) - F.col("n") * (100 - percent)).alias("excess")
    return written(found.select("group", "key", "root", excess, "differing"), "differing")


def _nearest(differing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), a < b, of a group's member of least excess with all whose excess and its own
    are not above 0, and differing with roots as these links make them and the group's least
    excess. Two members whose excesses are not above 0 together have both such a link, so
    of pairs with different roots none is left that shares no difference."""
    first = F.min(F.struct("excess", "key", "root")).alias("first")
    nearest = small(written(differing.groupBy("group").agg(first), "nearest"))
    met = differing.join(nearest, "group").where("excess + first.excess <= 0 and root != first.root")
    a, b = F.least("key", "first.key").alias("a"), F.greatest("key", "first.key").alias("b")
    stars = written(met.select(a, b, "root", F.col("first.root").alias("other")), "nearest_links")
    merged = components(stars.select(F.least("root", "other").alias("a"), F.greatest("root", "other").alias("b")).distinct())
    roots = merged.select(F.col("key").alias("root"), F.col("root").alias("now"))
    kept = differing.join(nearest.select("group", F.col("first.excess").alias("least")), "group").join(small(roots), "root", "left")
    return stars.select("a", "b"), written(kept.withColumn("root", F.coalesce("now", "root")).drop("now"), "merged")


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: every pair of a group with different roots that can share as many differences
    as a link needs. Differences are ordered by how many hold them, rare ones first; the
    first that such a pair shares stands so early in both that enough are left behind
    it. A difference that many hold is dealt to as many tasks as it needs."""
    mixed = members.groupBy("group").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("group")
    each = 2 * (100 + percent)
    needed = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col("least")) / each))
    count = F.size("differing").cast("long")
    wanted = members.join(small(written(mixed, "mixed_groups")), "group").where(count >= needed)
    slim = wanted.select("group", "key", "root", "excess", count.alias("d"), (count - needed + 1).alias("last"), F.explode("differing").alias("shingle"))
    shared = written(slim.groupBy("group", "shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "shared")
    own = Window.partitionBy("group", "key")
    # Differences of one set alone come before all others and meet nothing.
    place = F.col("d") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("holders", "shingle"))
    early = written(slim.join(small(shared), ["group", "shingle"]).withColumn("place", place).where("place <= last"), "early")
    tasks = F.floor(F.col("holders") / HOLDERS).cast("int")
    dealt, every = F.pmod(F.xxhash64("key"), tasks + 1).cast("int"), F.explode(F.sequence(F.lit(0), tasks))
    x, y = (early.select("group", "shingle", salt.alias("salt"), *[F.col(c).alias(f"{c}_{i}") for c in ("key", "root", "excess", "d", "place")]) for i, salt in ((1, dealt), (2, every)))
    rest = F.least(F.col("d_1") - F.col("place_1"), F.col("d_2") - F.col("place_2")) + 1
    fits = (
        (x["group"] == y["group"])
        & (x["shingle"] == y["shingle"])
        & (x["salt"] == y["salt"])
        & (F.col("key_1") < F.col("key_2"))
        & (F.col("root_1") != F.col("root_2"))
        & (rest * each >= F.col("excess_1") + F.col("excess_2"))
    )
    return x.join(y, fits).select(F.col("key_1").alias("a"), F.col("key_2").alias("b")).distinct()


def _thinned(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, about one for each key that is no centre: a key stays
    linked to the first of its neighbours in the order that centres are chosen by, and that one is linked to
    the key's other earlier neighbours. Copies that met the same few centres name the same few links."""
    lot = lambda c: F.struct(F.xxhash64(c), F.col(c))
    swap = lot("a") < lot("b")
    led = edges.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("key"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("ahead")).distinct()
    first = written(led.groupBy("key").agg(F.min_by("ahead", lot("ahead")).alias("first")), "first")
    others = led.join(first, "key").where("ahead != first").select(F.col("first").alias("a"), F.col("ahead").alias("b"))
    return first.select(F.col("key").alias("a"), F.col("first").alias("b")).union(others).distinct()


def components(edges: DataFrame) -> DataFrame:
    """key, root for each key that an edge names: the least key that it reaches.

    Each round takes the least label among the neighbours, then the label's own
    label, so that paths shorten by half; it ends when nothing changes.
    """
    edges = written(_thinned(edges), "thinned")
    both = written(edges.union(edges.select(F.col("b"), F.col("a"))).toDF("key", "other").distinct(), "edges")
    labels = written(both.groupBy("key").agg(F.min("other").alias("root")).select("key", F.least("key", "root").alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("key").alias("other"), "root"), "other").groupBy("key").agg(F.min("root").alias("near"))
        nearer = labels.join(seen, "key").select("key", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("key").alias("next"), F.col("root").alias("further"))
        step = written(nearer.join(jump, "next", "left").select("key", "root", F.least("next", "further").alias("next")), "labels")
        if step.where("next < root").isEmpty():
            return labels
        labels = step.select("key", F.col("next").alias("root"))


def classes(docs: DataFrame, size: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tag, n, key, component_id of every row of docs."""
    slim = written(signatures(docs, size, id_col, text_col), "signatures")
    bands = [f"b{i}" for i in range(BANDS)]
    nodes = written(slim.where("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.min(F.struct("id", "tag")).alias("own"), F.first("n").alias("n"), *[F.first(b).alias(b) for b in bands]), "nodes")
    roots = components(links(docs, nodes, size, percent, id_col, text_col))
    linked = written(nodes.select("key", "id").join(roots, "key"), "linked")
    least = linked.groupBy("root").agg(F.min("id").alias("component_id"))
    found = nodes.select("key", "id").join(linked.join(least, "root").select("key", "component_id"), "key", "left").select("key", F.coalesce("component_id", "id").alias("component_id"))
    out = slim.select("id", "tag", "n", "key").join(found, "key", "left")
    return out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return classes(docs, size, percent).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one of the least doc_id. Rows of
    a repeated doc_id are one document if their texts are equal; of documents without
    any id one row of each set stays."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    kept = written(classes(docs, size, percent), "classes")
    rows = docs.toDF(*names).withColumn("tag", F.xxhash64(own["text"])).alias("d")
    same = F.col(f"d.{own['doc_id']}").eqNullSafe(F.col("g.id")) & (F.col("d.tag") == F.col("g.tag"))
    gone = kept.where(~F.col("id").eqNullSafe(F.col("component_id"))).select("id", "tag").distinct()
    out = rows.join(small(written(gone, "gone")).alias("g"), same, "left_anti").alias("d")
    again = kept.where("n > 0 and id <=> component_id").groupBy("id", "key").agg(F.count(F.lit(1)).alias("rows"), F.min("tag").alias("tag")).where("rows > 1")
    repeated = written(again.select("id", "tag"), "repeated")
    if not repeated.isEmpty():
        listed = small(repeated).alias("g")
        out = out.join(listed, same, "left_anti").unionByName(out.join(listed, same, "left_semi").dropDuplicates([own["doc_id"], "tag"]))
    return out.select(names).toDF(*docs.columns)
