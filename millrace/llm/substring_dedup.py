"""Removal of repeated passages: every window of words that also starts elsewhere goes.

Windows are found in three steps, over whole texts:

1. Count-min sketch. Every window enters through its anchor, the run of GRAM words in it with
   the least hash (the first of equal ones), so neighbouring windows share an entry and there
   are about a tenth as many entries as windows. Equal windows have equal anchors at different
   places, so an anchor's count is never below a window's. Each task sketches its texts; the
   sketches are merged cell by cell, as counts of 0, 1 and more.
2. Only runs of windows whose anchor is estimated repeated are grouped, exactly: a run is all
   neighbouring windows with one anchor, named by 128 bits of its words. Of a run that occurs
   twice all windows are repeated.
3. Where an anchor has different runs, one of each kind is cut into its windows, and those are
   grouped in turn. This finds repeats that begin or end inside a run.

The sketch is as large for any corpus (``CELLS``), so it can be broadcast; where a corpus
fills it, more windows are grouped than need be, and none is lost. All groups are counted by
partial aggregation, so a passage that a third of all rows share is no larger than another.

Words are compared by two halves of their BLAKE2b, which ``words.digests`` describes.

Cases: null and empty texts have no words; texts shorter than a window lose nothing; rows may
repeat, and each is an occurrence; doc_ids may be null or shared; an empty table gives an empty
result; other columns are passed through by ``without_repeats`` and not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_blocks, map_arrow, release_memory, small, written
from millrace.llm.words import digests, mix, word_spans

#: Words of a window and of its anchor.
WINDOW, GRAM = 35, 8
#: Hash functions and cells of each in the sketch (two bits a cell), cells of a slot, in which
#: the sketch is merged, and anchors after which a task hands its sketch on.
HASHES, CELLS, SLOT, FLUSH = 2, 1 << 26, 1 << 16, 2_000_000
BLOCK = 1 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row, from those of half as many."""
    width = 1
    while width * 2 <= size:
        h = mix(h[: len(h) - width] * _STEP + h[width:])
        width *= 2
    return mix(h[: len(h) - (size - width)] * _STEP + h[size - width :]) if width < size else h


def _least(g: np.ndarray, size: int) -> np.ndarray:
    """The place of the least of each ``size`` values in a row, the first of equal ones."""
    place, width = np.arange(len(g)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(g[b] < g[a], b, a)

    while width * 2 <= size:
        place = better(place[: len(place) - width], place[width:])
        width *= 2
    return better(place[: len(place) - (size - width)], place[size - width :]) if width < size else place


@dataclass
class Runs:
    """Runs of windows with one anchor: its hash, the run's, its text, the first window's first
    word (in the text), and the number of windows; the hashes of all windows of the block."""

    anchor: np.ndarray
    name: np.ndarray
    text: np.ndarray
    start: np.ndarray
    n: np.ndarray
    windows: np.ndarray
    first: np.ndarray


def window_runs(data: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> Runs:
    start, end, first = word_spans(data, offsets)
    if len(start) < size:
        none = np.zeros(0, np.int64)
        return Runs(none.view(np.uint64), none.view(np.uint64), none, none, none, none.view(np.uint64), first)
    h = digests(data, start, end)
    grams = _rolled(np.ascontiguousarray(h[:, 0]), gram)
    windows = _rolled(np.ascontiguousarray(h[:, 1]), size)
    place = _least(grams, size - gram + 1)[: len(windows)]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = np.flatnonzero(text[: len(windows)] == text[size - 1 :])
    new = np.ones(len(whole), bool)
    new[1:] = (place[whole[1:]] != place[whole[:-1]]) | (text[whole[1:]] != text[whole[:-1]])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(whole)))
    at = whole[head]
    # The first and the last window hold all words of a run, as it is shorter than two windows.
    name = mix(windows[at] * _STEP + mix(windows[at + n - 1] + n.astype(np.uint64)))
    return Runs(grams[place[at]], name, text[at], at - first[text[at]], n, windows, first)


def _cells(anchors: np.ndarray, cells: int) -> list[np.ndarray]:
    return [(mix(anchors + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))) & np.uint64(cells - 1)).astype(np.int64) for i in range(HASHES)]


def _part(anchors: np.ndarray, cells: int) -> Iterator[pa.RecordBatch]:
    """The sketch of some anchors: for each slot the cells that are filled, and those that are filled more than once."""
    for i, at in enumerate(_cells(anchors, cells) if len(anchors) else ()):
        filled, times = np.unique(at, return_counts=True)
        slot, inner = filled // SLOT, (filled % SLOT).astype("<u2")
        edge = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        stop, more = np.append(edge[1:], len(slot)), times > 1
        rows = [(i * (cells // SLOT + 1) + int(slot[a]), inner[a:b].tobytes(), inner[a:b][more[a:b]].tobytes()) for a, b in zip(edge.tolist(), stop.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["slot", "filled", "more"])


class Sketch:
    """Whether an anchor's count is estimated at two or more."""

    def __init__(self, slots: dict[int, bytes], cells: int):
        self.cells = cells
        self.more = np.zeros((HASHES, max(cells, SLOT) // 8), np.uint8)
        for slot, bits in slots.items():
            i, at = divmod(slot, cells // SLOT + 1)
            self.more[i, at * SLOT // 8 : at * SLOT // 8 + len(bits)] = np.frombuffer(bits, np.uint8)

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchors), bool)
        for bits, at in zip(self.more, _cells(anchors, self.cells), strict=True):
            out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


def sketch(docs: DataFrame, size: int = WINDOW, gram: int = GRAM, cells: int = CELLS, text_col: str = "text") -> Sketch:
    """The sketch of all windows. The driver gets its merged slots, which are as many and as large for any corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, data, offsets in arrow_blocks(batch.column(0), BLOCK):
                held.append(window_runs(data, offsets, size, gram).anchor)
                n += len(held[-1])
                if n >= FLUSH:
                    yield from _part(np.concatenate(held), cells)
                    held, n = [], 0
        if held:
            yield from _part(np.concatenate(held), cells)
        release_memory()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for slot, filled, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, twice = slots.setdefault(slot, (np.zeros(SLOT, bool), np.zeros(SLOT, bool)))
                at = np.frombuffer(filled, "<u2")
                twice[at[once[at]]] = True
                twice[np.frombuffer(more, "<u2")] = True
                once[at] = True
        for slot, (_, twice) in slots.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["slot", "bits"])
        release_memory()

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "slot long, filled binary, more binary")
    merged = written(parts.repartition("slot").mapInArrow(merge, "slot long, bits binary"), "sketch")
    return Sketch({r["slot"]: r["bits"] for r in merged.collect()}, cells)  # at most HASHES * CELLS bits


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tag (a hash of the text), text."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("string").alias("text"))


def _same(a: str, b: str):
    return F.col(f"{a}.tag").eqNullSafe(F.col(f"{b}.tag")) & F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id"))


def estimated_runs(docs: DataFrame, seen: Sketch, size: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """id, tag, anchor, name, start, n of each run that may be repeated."""
    slim = _named(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(seen)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in arrow_blocks(batch.column(2), BLOCK):
            r = window_runs(data, offsets, size, gram)
            at = np.flatnonzero(held.value.repeated(r.anchor))
            rows = pa.array(r.text[at])
            own = [batch.column(i).slice(lo, hi - lo).take(rows) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(r.anchor[at].view(np.int64)), pa.array(r.name[at].view(np.int64)), pa.array(r.start[at].astype(np.int32)), pa.array(r.n[at].astype(np.int32))], ["id", "tag", "anchor", "name", "start", "n"])

    return map_arrow(slim, run, f"id {slim.schema['id'].dataType.simpleString()}, tag long, anchor long, name long, start int, n int")


def _cut(docs: DataFrame, kinds: DataFrame, size: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """id, tag, anchor, window, start, alone of each window of the runs in kinds (id, tag, starts
    that are alone, other starts)."""
    slim = _named(docs, id_col, text_col).alias("d").join(small(kinds).alias("k"), _same("d", "k")).select("d.id", "d.tag", "d.text", "k.alone", "k.other")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in arrow_blocks(batch.column(2), BLOCK):
            r = window_runs(data, offsets, size, gram)
            key, cut = (r.text << 32) + r.start, []
            for name in ("alone", "other"):
                lists = batch.column(name).slice(lo, hi - lo)
                text = np.repeat(np.arange(hi - lo), pa.compute.list_value_length(lists).fill_null(0).to_numpy())
                at = np.searchsorted(key, (text << 32) + lists.flatten().to_numpy())
                inner = np.arange(r.n[at].sum()) - np.repeat(np.cumsum(r.n[at]) - r.n[at], r.n[at])
                at = np.repeat(at, r.n[at])
                cut.append((at, r.start[at] + inner, np.full(len(at), name == "alone")))
            at, start, alone = (np.concatenate(x) for x in zip(*cut, strict=True))
            own = [batch.column(i).slice(lo, hi - lo).take(pa.array(r.text[at])) for i in (0, 1)]
            window = r.windows[r.first[r.text[at]] + start]
            yield pa.RecordBatch.from_arrays([*own, pa.array(r.anchor[at].view(np.int64)), pa.array(window.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(alone)], ["id", "tag", "anchor", "window", "start", "alone"])

    return map_arrow(slim, run, f"id {slim.schema['id'].dataType.simpleString()}, tag long, anchor long, window long, start int, alone boolean")


def repeated_ranges(docs: DataFrame, size: int = WINDOW, gram: int = GRAM, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tag (a hash of the text), ranges: first words and ends of what repeated windows cover, each as first * 2**32 + end."""
    runs = written(estimated_runs(docs, sketch(docs, size, gram, cells, text_col), size, gram, id_col, text_col), "runs")
    kinds = written(runs.groupBy("anchor", "name").agg(F.count(F.lit(1)).alias("rows"), *[F.first(c).alias(c) for c in ("id", "tag", "start", "n")]), "kinds")
    twice = runs.join(small(written(kinds.where("rows > 1").select("anchor", "name"), "twice")), ["anchor", "name"], "left_semi")
    mixed = written(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor"), "mixed")
    alone = F.collect_list(F.when(F.col("rows") == 1, F.col("start"))).alias("alone")
    other = F.collect_list(F.when(F.col("rows") > 1, F.col("start"))).alias("other")
    chosen = written(kinds.join(small(mixed), "anchor", "left_semi").groupBy("id", "tag").agg(alone, other), "chosen")  # a row for a document, lists no longer than its text
    cut = written(_cut(docs, chosen, size, gram, id_col, text_col), "windows")
    shared = cut.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("anchor", "window")
    inner = cut.where("alone").join(small(written(shared, "shared")), ["anchor", "window"], "left_semi")
    cover = lambda last: (F.col("start").cast("long") * (1 << 32) + F.col("start") + last).alias("range")
    ranges = twice.select("id", "tag", cover(F.col("n") + (size - 1))).unionByName(inner.select("id", "tag", cover(F.lit(size))))
    return ranges.distinct().groupBy("id", "tag").agg(F.sort_array(F.collect_list("range")).alias("ranges"))


def _kept(text: str | None, ranges: list[int] | None) -> tuple[int, list[bytes]]:
    """The number of words, and those outside the ranges, which are in order of their first words."""
    words = (text or "").encode().split()
    if not ranges:
        return len(words), words
    kept, done = [], 0
    for r in ranges:
        first, end = r >> 32, r & 0xFFFFFFFF
        if first > done:
            kept += words[done:first]
        done = max(done, end)
    return len(words), kept + words[done:]


def _with_ranges(docs: DataFrame, ranges: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d.* of every row, and r.ranges."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag")).alias("d")
    return rows.join(small(written(ranges, "ranges")).alias("r"), _same("d", "r"), "left").select("d.row", "r.ranges")


def without_repeats(docs: DataFrame, size: int = WINDOW, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the kept words in place of each text that loses some, joined by one space."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, ranges = batch.column("_text"), batch.column("_ranges").to_pylist()
        out = [t if not r else b" ".join(_kept(t, r)[1]).decode() for t, r in zip(texts.to_pylist(), ranges, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], [*batch.schema.names[:-2], "_text"])

    joined = _with_ranges(docs, repeated_ranges(docs, size, min(GRAM, size), cells, id_col, text_col), id_col, text_col)
    others = [c for c in docs.columns if c != text_col]
    slim = joined.select(*[F.col(f"row.`{c}`").alias(f"_{i}") for i, c in enumerate(others)], F.col(f"row.`{text_col}`").cast("string").alias("_text"), F.col("ranges").alias("_ranges"))
    made = map_arrow(slim, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]))
    return made.select(*[F.col("_text" if c == text_col else f"_{others.index(c)}").alias(c) for c in docs.columns])


def digest(docs: DataFrame, size: int = WINDOW, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    joined = _with_ranges(slim, repeated_ranges(slim, size, gram, cells), "doc_id", "text").select("row.doc_id", "row.text", "ranges")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, _, _ in arrow_blocks(batch.column(1), BLOCK):
            part, rows = batch.slice(lo, hi - lo), []
            for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                n, kept = _kept(text, ranges)
                rows.append((n, n - len(kept), sha256(b" ".join(kept)).hexdigest()))
            made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_arrow(joined, run, f"doc_id {slim.schema[0].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")
