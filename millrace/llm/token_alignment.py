"""Alignment of two tokenizers: which tokens of one overlap which of the other.

The tokens of a text under both are a bipartite graph, an edge (a link) for each pair whose
byte ranges overlap. Union-find over the links gives its connected components, which are the
least groups that cover the same bytes: their ends are the offsets where tokens of both end.
An id pair's count is the number of documents that hold it linked, over all documents.

A text is cut into units before single spaces between other characters, where both
tokenizers always begin a token (``Aligner`` checks both models), so no component crosses
units. A worker aligns each different unit once, all new ones of a block in one union-find,
and keeps at most ``KEPT`` of them. Each document's different pairs are written; Spark counts the
documents of each pair and joins the counts back: as a broadcast table if there are at most
``PAIRS`` pairs, else by a shuffled join.

Cases: null and empty texts, and texts that the two models' tokens do not spell (for
instance with U+2581, which stands for a space), have no tokens, zeros and an empty text for the
groups; rows may repeat, and each counts as a document; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_blocks, kept_by_worker, map_arrow, release_memory, written
from millrace.llm.token_counts import processor
from millrace.llm.token_files import tokenizer
from millrace.llm.words import per_text

#: Units that a worker keeps, bytes of the longest one kept, and bytes of text worked on together.
KEPT, KEPT_BYTES, BLOCK = 500_000, 64, 2 << 20
#: Most id pairs of a broadcast table (24 bytes each).
PAIRS = 4_000_000
#: Bytes that are no white space in any alphabet: printable ASCII; first bytes of two-byte
#: letters from U+00C0 on, which hold no white space.
_GRAPH = np.zeros(256, bool)
_GRAPH[33:127] = True
_PAIR = np.zeros(256, bool)
_PAIR[0xC3:0xE0] = True


def byte_level() -> dict[str, int]:
    """The characters in which a byte-level vocabulary writes bytes: printable ones stand for
    themselves, the others, in order, for U+0100 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The units of space+text of each text that is not empty, and the offsets of each text's."""
    size = np.diff(offsets)
    full = size > 0
    spaced = np.insert(data, offsets[:-1][full], 32)
    begin = offsets[:-1] + np.append(0, np.cumsum(full))[:-1]
    cut = np.zeros(len(spaced) + 1, bool)
    if len(spaced) > 2:
        single = (spaced == 32)[2:-1]
        before = _GRAPH[spaced[1:-2]] | (((spaced[1:-2] & 0xC0) == 0x80) & _PAIR[spaced[:-3]])
        cut[2:-2] = single & before & (_GRAPH | _PAIR)[spaced[3:]]
        # The byte before a text's own first space ends another text.
    cut[begin[full]] = True
    start = np.flatnonzero(cut[:-1]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(spaced))), pa.py_buffer(spaced)])
    return found, np.append(np.searchsorted(start, begin), len(start))


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Union-find over edges (u, v) between n nodes, all at once: roots are hooked to lesser
    ones and paths are halved until no edge joins two trees. Gives each node the least node it reaches."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(parent, nearer := parent[parent]):
            parent = nearer


class Aligner:
    """Alignments of units by the two models, a row for each unit it knows."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = tokenizer(a_path), processor(b_path)
        self.a.encode_special_tokens = True
        chars, size = byte_level(), self.a.get_vocab_size()
        a = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(map(chars.__getitem__, t)) if set(t) <= chars.keys() else t.encode() for t in a]
        b = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(b)]
        if any("▁" in p.lstrip("▁") for p in b) or self._ids([" ab cd", " éa a", " a<|endoftext|> b"]) != [x + y for x, y in zip(self._ids([" ab", " éa", " a<|endoftext|>"]), self._ids([" cd", " a", " b"]), strict=True)]:
            raise ValueError("tokens of these models cross single spaces")
        self.wide = self.b.get_piece_size()
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.clear()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)] + self.b.encode([t[1:] for t in texts], num_threads=1)

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.counts = np.zeros((0, 5), np.int64)  # spelled, tokens of a, of b, groups, links
        self.groups: list[bytes] = []
        self.first, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)  # links as a's id * wide + b's

    def _learn(self, new: list[bytes]) -> None:
        ids = self._ids([u.decode() for u in new])
        a, b = ids[: len(new)], ids[len(new) :]
        spelled = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == u == b"".join(map(self.b_bytes.__getitem__, y)) for u, x, y in zip(new, a, b, strict=True)], bool)
        n_a, n_b = (np.array([len(x) for x in y], np.int64) * spelled for y in (a, b))
        a, b = (np.array([i for x, ok in zip(y, spelled, strict=True) if ok for i in x], np.int64) for y in (a, b))
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # Between two neighbouring ends of any tokens one token of each is open: a link.
        cuts = np.union1d(ends_a, ends_b)
        u, v = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        root = components(u, len(a) + v, len(a) + len(b))  # of tokens of a first, so a component's root is its first token of a
        roots, group = np.unique(root, return_inverse=True)
        end_a, end_b = np.searchsorted(group[: len(a)], np.arange(len(roots)), "right"), np.searchsorted(group[len(a) :], np.arange(len(roots)), "right")
        unit_a, unit_b = np.cumsum(n_a), np.cumsum(n_b)
        n_groups = np.diff(np.append(0, np.searchsorted(roots, unit_a)))
        links = np.diff(np.append(0, np.searchsorted(u, unit_a)))
        names_a, names_b, done, texts = list(map(str, a.tolist())), list(map(str, b.tolist())), (0, 0), []
        for stop in zip(end_a.tolist(), end_b.tolist(), strict=True):
            texts.append(f"{','.join(names_a[done[0] : stop[0]])}|{','.join(names_b[done[1] : stop[1]])}")
            done = stop
        at = 0
        for n in n_groups.tolist():
            self.groups.append(";".join(texts[at : at + n]).encode())
            at += n
        self.counts = np.concatenate([self.counts, np.column_stack([spelled, n_a, n_b, n_groups, links])])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(links))
        self.pairs = np.append(self.pairs, a[u] * self.wide + b[v])

    def rows(self, found: pa.LargeBinaryArray) -> np.ndarray:
        """The row of each unit. Rows are good until the next call."""
        coded = found.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > KEPT or len(self.groups) > 2 * KEPT:
            self.clear()
        new = [u for u in distinct if u not in self.known]
        at = dict(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        if new:
            self._learn(new)
        rows = np.array([self.known[u] if u in self.known else at[u] for u in distinct], np.int64)
        self.known.update((u, i) for u, i in at.items() if len(u) <= KEPT_BYTES)
        return rows[coded.indices.to_numpy(zero_copy_only=False)]

    def expanded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of rows, and how many each row has."""
        n = self.first[rows + 1] - self.first[rows]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.pairs[np.repeat(self.first[rows], n) + inner], n


def _aligned(batch: pa.RecordBatch, text_at: int, known: Aligner) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, unit rows, offsets of each text's, whether each text has tokens) of blocks."""
    for lo, hi, data, offsets in arrow_blocks(batch.column(text_at), BLOCK):
        found, first = units(data, offsets)
        rows = known.rows(found)
        ok = (per_text(known.counts[rows, 0] == 0, first) == 0) & (np.diff(first) > 0)
        yield lo, hi, rows, first, ok


def _document_links(known: Aligner, rows: np.ndarray, first: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, pair and times of each pair that a text holds linked."""
    text = np.repeat(np.arange(len(ok)), np.diff(first))
    key, times = np.unique((text << 40) + rows, return_counts=True) if len(rows) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    text, row = key >> 40, key & ((1 << 40) - 1)
    chosen = ok[text]
    text, row, times = text[chosen], row[chosen], times[chosen]
    pairs, n = known.expanded(row)
    text, times = np.repeat(text, n), np.repeat(times, n)
    order = np.lexsort((pairs, text))
    text, pairs, times = text[order], pairs[order], times[order]
    new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (pairs[1:] != pairs[:-1]))) if len(text) else np.zeros(0, np.int64)
    return text[new], pairs[new], np.add.reduceat(times, new) if len(new) else times


_OWN = "n_a long, n_b long, n_groups long, n_links long"


def _own(known: Aligner, rows: np.ndarray, first: np.ndarray, ok: np.ndarray) -> tuple[list[pa.Array], list[str]]:
    """The counts of each text, and its groups' hash."""
    values = known.counts[rows]
    counts = [pa.array(per_text(values[:, i], first) * ok) for i in range(1, 5)]
    named = known.groups.__getitem__
    cut, all_rows = first.tolist(), rows.tolist()
    sha = [hashlib.sha256(b";".join(map(named, all_rows[s:e]))).hexdigest() if good else "" for s, e, good in zip(cut[:-1], cut[1:], ok.tolist(), strict=True)]
    return counts, sha


def document_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (the id pairs that the text holds
    linked, each a's id * size of b + b's id) and times (how often each is linked) of every row."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_by_worker(("alignment", a_path, b_path), lambda: Aligner(a_path, b_path))
        for batch in batches:
            for lo, hi, rows, first, ok in _aligned(batch, 1, known):
                own, sha = _own(known, rows, first, ok)
                text, pairs, times = _document_links(known, rows, first, ok)
                cut = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (pairs, times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *own, pa.array(sha, pa.string()), *lists], ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
        release_memory()

    return slim.mapInArrow(run, f"id {slim.schema[0].dataType.simpleString()}, {_OWN}, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(links: DataFrame, wide: int) -> DataFrame:
    """pair, a, b, count (documents that hold it), best (no pair of a counts more), of ``document_links``."""
    summed = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counted = written(summed.select("pair", F.floor(F.col("pair") / wide).cast("long").alias("a"), (F.col("pair") % wide).alias("b"), "count"), "pairs")
    most = counted.groupBy("a").agg(F.max("count").alias("most"))
    return counted.join(most, "a").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


_RESULT = ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _by_broadcast(links: DataFrame, pairs: DataFrame) -> DataFrame:
    table = pairs.select("pair", "count", "best").toArrow()
    keys, count, best = (table.column(i).to_numpy() for i in range(3))
    order = np.argsort(keys)
    held = links.sparkSession.sparkContext.broadcast((keys[order], count[order], best[order].astype(np.int64)))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, count, best = held.value
        lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        at = np.searchsorted(keys, lists.flatten().to_numpy())
        sums = [pa.array(per_text(x[at] * times if len(at) else np.zeros(0, np.int64), offsets - offsets[0])) for x in (best, count)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *sums, batch.column(5)], list(_RESULT))

    slim = links.select("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    return map_arrow(slim, run, f"id {slim.schema[0].dataType.simpleString()}, {_OWN}, n_best long, count_sum long, groups_sha256 string")


def _by_shuffle(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each document's pairs meet their counts in a shuffled join, whose hot pairs adaptive execution splits."""
    each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = each.join(pairs.select("pair", "count", "best"), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return links.join(sums, "row", "left").select("id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def alignment(docs: DataFrame, a_path: str, b_path: str, most_pairs: int = PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document. The
    models are files that every executor can open. Texts are aligned once; their pairs are written."""
    links = written(document_links(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "document_links")
    pairs = written(pair_counts(links, processor(b_path).get_piece_size()), "pair_counts")
    found = _by_broadcast(links, pairs) if pairs.limit(most_pairs + 1).count() <= most_pairs else _by_shuffle(links, pairs)
    return found.withColumnRenamed("id", id_col)
