"""Token counts of a SentencePiece BPE model without token ids: each distinct
pre-token is counted once, counts are joined to the pre-token frequencies of each
document, and the products are summed.

A pre-token ends where no piece of the vocabulary can continue: before a run of
spaces that follows something else, and around a line feed. ``Counter`` checks both
of its model and refuses another. Pre-tokens are then independent of each other, so
the sums are exactly the library's counts.

The join stays in the task: a document-by-pre-token table is larger than the texts,
and shuffling it would cost more than the counting. Each task counts a pre-token at
its first occurrence and keeps at most ``KEPT`` of them, so memory is bounded and a
lost task is recomputed from its own input.

Cases: null and empty texts have no tokens; U+2581 in a text is the space it stands
for; repeated rows are each counted; other columns are not read.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_blocks


#: Pre-tokens whose counts a worker keeps, and characters of the longest one kept.
KEPT, KEPT_CHARS = 800_000, 64


@cache
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


class Counter:
    def __init__(self, model: str):
        self.sp = processor(model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or self.sp.encode("a  b", out_type=str) != ["▁a", "▁", "▁b"] or self.sp.decode(self.sp.encode("a\nﬁ  ")) != "a\nﬁ  ":
            raise ValueError("the pieces of this model cross spaces or line feeds, or it rewrites texts")
        self.known: dict[str, int] = {}

    def _count(self, units: list[str]) -> list[int]:
        """Pieces of new pre-tokens. A unit is a run of characters without a space
        after a line feed (which then leads it) or after at least one space, of which
        the library itself adds one."""
        return [len(ids) - (u[0] == "\n") for u, ids in zip(units, self.sp.encode(units, num_threads=1), strict=True)]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Every pre-token that is new is counted in one call."""
        found = [frequencies(t) for t in texts]
        wanted = set().union(*(f for f, _ in found))
        new = [u for u in wanted if u not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list(wanted)
        self.known.update(zip(new, self._count(new), strict=True))
        pieces = self.known.__getitem__
        out = [spaces + sum(map(int.__mul__, f.values(), map(pieces, f))) for f, spaces in found]
        for u in new:
            if len(u) > KEPT_CHARS:
                del self.known[u]
        return out


def frequencies(text: str) -> tuple[collections.Counter[str], int]:
    """How often each pre-token occurs, and single spaces that end a line."""
    units: collections.Counter[str] = collections.Counter()
    trailing = 0
    if "▁" in text:
        text = text.replace("▁", " ")
    for i, line in enumerate(text.split("\n") if text else ()):
        words = line.split(" ")
        if i:  # the first word of a text follows the space that the library adds, others a line feed
            units["\n" + words[0]] += 1
            del words[0]
        if "" not in words:
            units.update(words)
            continue
        spaces = 0
        for w in words:
            if w:
                units[" " * spaces + w] += 1
                spaces = 0
            else:
                spaces += 1
        if spaces == 1:
            trailing += 1
        elif spaces:
            units[" " * (spaces - 1)] += 1
    return units, trailing


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document. ``model`` must be a path
    that every executor can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model)
        for batch in batches:
            n: list[int] = []
            for lo, hi, _, _ in arrow_blocks(batch.column(2)):
                n += counter.counts([t or "" for t in batch.column(2).slice(lo, hi - lo).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    slim = docs.select(id_col, size, F.col(text_col).cast("string"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
