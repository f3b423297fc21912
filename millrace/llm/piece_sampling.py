"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement:
a perturbed A* search over the lattice of pieces emits distinct segmentations of a
whole text, best perturbed value first, with inclusion scores, seeded by the row key.

Lattice. A unit ends where no piece can continue: before a run of spaces after
something else, and around a line feed (the model is checked for it); a unit of any
length is one lattice. A piece weighs (rank + 2) ** -sharpness,
with its rank among the merges (BPE models give ranks, not probabilities);
characters without a piece fall back to their bytes. Forward sums per unit give each
piece its exact probability given where it ends, so drawing pieces from the end of
each unit draws segmentations by weight; units are independent.

Search. The perturbed value of a set of segmentations is the largest Gumbel of its
members. Fixing pieces one after another splits the set; the part with the drawn
piece keeps the value, the rest gets a Gumbel of its own mass, truncated at it. The
queue holds these rests, exact bounds of what they hold; the largest is opened next,
given a piece other than those it has lost, and completed. Each opening emits a new
segmentation, in order, and k openings plus the next bound (kappa) are all that is done.

score is log(1 - exp(-exp(log_prob - kappa))), the log of the inclusion probability
given kappa; 0 where the text has no further segmentation.

Cases: null and empty texts have one segmentation, the empty one; texts with fewer
than k segmentations give them all; U+2581 is the space it stands for; a null key
takes the text's hash; repeated rows have equal samples; long texts are done whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_blocks, kept_by_worker, map_arrow, release_memory
from millrace.llm.token_counts import processor
from millrace.llm.words import LONGEST_ROLLING, Spans, mix, span_hashes

#: Bytes of a block.
BLOCK = 1 << 20
#: Lattice nodes that a worker keeps.
KEPT_NODES = 1_500_000


class Pieces:
    """Prefixes of the pieces by hash (-1: no piece ends there), and log weights by id."""

    def __init__(self, model: str, sharpness: float):
        sp = processor(model)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any("▁" in text[i].lstrip("▁") or "\n" in text[i] for i in plain):
            raise ValueError("pieces of this model cross spaces or line feeds")
        self.bytes = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[i] = bytes([int(text[i][3:5], 16)])
                self.byte_id[self.bytes[i][0]] = i
        for i in plain:
            self.bytes[i] = text[i].replace("▁", " ").encode()
        self.weight = np.full(n, -sharpness * np.log(n + 2.0))
        ranks = np.array([max(0.0, -sp.get_score(i)) for i in plain])
        self.weight[plain] = -sharpness * np.log(ranks + 2)
        raw = [self.bytes[i] for i in plain]
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64)
        if size.max() > LONGEST_ROLLING:
            raise ValueError("pieces of this model are too long")
        start = np.cumsum(size) - size
        spans, keys, ids = Spans(data), [], []
        for length in range(1, int(size.max()) + 1):
            at = np.flatnonzero(size >= length)
            keys.append(spans.hash(start[at], start[at] + length))
            ids.append(np.where(size[at] == length, np.array(plain)[at], -1))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort([-ids, keys])
        first = np.append(True, keys[order][1:] != keys[order][:-1])
        keys, ids = keys[order][first], ids[order][first]
        self.bits = 64 - 19
        self.key, self.id = np.zeros((1 << 19) + 4096, np.uint64), np.zeros((1 << 19) + 4096, np.int32)
        for k, i, slot in zip(keys, ids, (keys >> np.uint64(self.bits)).tolist(), strict=True):
            while self.key[slot]:
                slot += 1
            self.key[slot], self.id[slot] = k, i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash; -1: the start of one; -2: neither."""
        slot = (h >> np.uint64(self.bits)).astype(np.int64)
        out, todo = np.full(len(h), -2, np.int32), np.arange(len(h))
        while len(todo):
            k = self.key[slot]
            hit = k == h[todo]
            out[todo[hit]] = self.id[slot[hit]]
            on = ~hit & (k != 0)
            todo, slot = todo[on], slot[on] + 1
        return out


@cache
def pieces(model: str, sharpness: float) -> Pieces:
    return Pieces(model, sharpness)


#: Sums over a block are sums of whole multiples of this, so they are exact and a text's
#: samples do not depend on the texts that share its block.
_GRAIN = 2.0**-34


def _fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x / _GRAIN).astype(np.int64)


def _sums(x: np.ndarray) -> np.ndarray:
    """0 and the running sums of x, in multiples of _GRAIN."""
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(_fixed(x), out=out[1:])
    return out


class Lattice:
    """Nodes (byte boundaries) and edges (pieces) of distinct units; edges are grouped by
    their end node, with the probability of each given that end."""

    def __init__(self, vocabulary: Pieces):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.keys, self.end = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # units: hash and last node
        self.nodes = 0
        self.first = np.zeros(1, np.int32)  # per node: its first edge
        self.back, self.id = np.zeros(0, np.uint8), np.zeros(0, np.uint16)
        self.p, self.upto = np.zeros(0, np.float32), np.zeros(0, np.float32)

    def ends(self, data: np.ndarray, spans: Spans, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The last node of each unit; unknown units are added."""
        keys, at, back = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if self.nodes > KEPT_NODES and not known.all():
            self.clear()
            known[:], place[:] = False, 0
        last = np.empty(len(keys), np.int64)
        last[known] = self.end[place[known]]
        if not known.all():
            last[~known] = self._add(data, spans, start[at[~known]], end[at[~known]])
            self.keys, self.end = np.insert(self.keys, place[~known], keys[~known]), np.insert(self.end, place[~known], last[~known])
        return last[back]

    def chances(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each piece given where it ends, and of all others: likely pieces are
        stored as minus the others' probability, so that neither loses its digits."""
        p = self.p[edges].astype(np.float64)
        likely = np.signbit(p)
        return np.where(likely, 1 + p, p), np.where(likely, -p, 1 - p)

    def _add(self, data: np.ndarray, spans: Spans, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        base = np.cumsum(size + 1) - size - 1  # a node before each unit's bytes and after each byte
        n = int((size + 1).sum())
        unit = np.repeat(np.arange(len(size)), size)
        byte = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
        source, limit, node = start[unit] + byte, end[unit], base[unit] + byte
        wide = data[source]
        boundary = (wide & 0xC0) != 0x80
        width = np.where(wide < 0x80, 1, np.where(wide < 0xE0, 2, np.where(wide < 0xF0, 3, 4)))  # of the character that begins here
        froms, tos, ids = [], [], []
        single = np.zeros(len(unit), bool)
        active = np.flatnonzero(boundary)
        length = 0
        while len(active):
            length += 1
            active = active[source[active] + length <= limit[active]]
            got = self.v.find(spans.hash(source[active], source[active] + length))
            hit = got >= 0
            at = active[hit]
            froms.append(node[at])
            tos.append(node[at] + length)
            ids.append(got[hit])
            single[at[width[at] == length]] = True
            active = active[got > -2]
        lone = np.flatnonzero(boundary & ~single)
        wide_lone = width[lone]
        bare = np.repeat(lone, wide_lone) + np.arange(wide_lone.sum()) - np.repeat(np.cumsum(wide_lone) - wide_lone, wide_lone)
        froms.append(node[bare])
        tos.append(node[bare] + 1)
        ids.append(self.v.byte_id[wide[bare]])
        f, t, i = np.concatenate(froms), np.concatenate(tos), np.concatenate(ids)
        depth = np.zeros(n, np.int64)
        depth[node + 1] = byte + 1
        order = np.argsort(t * 256 - (t - f))  # longer pieces, which are the likelier ones, first
        f, t, i = f[order], t[order], i[order]
        total = np.full(n, -np.inf)
        total[base] = 0
        deep = depth[t].astype(np.uint16 if size.max() < 1 << 16 else np.int64)  # the short kind is sorted faster
        by_depth = np.argsort(deep, kind="stable")
        cuts = np.searchsorted(deep[by_depth], np.arange(1, int(size.max()) + 2))
        w = self.v.weight[i]
        fd, td, wd = f[by_depth], t[by_depth], w[by_depth]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                new = np.append(True, td[a + 1 : b] != td[a : b - 1])
                value = total[fd[a:b]] + wd[a:b]
                at = np.flatnonzero(new)
                one = np.append(new[1:], True)[at]  # only one piece ends there
                total[td[a:b][at]] = value[at]
                if not one.all():
                    total[td[a:b][at[~one]]] = np.logaddexp.reduceat(value, at)[~one]
        with np.errstate(invalid="ignore"):
            p = np.exp(total[f] + w - total[t])
        p = np.nan_to_num(p)  # a node that nothing reaches
        first = np.searchsorted(t, np.arange(n + 1))
        p[(first[t + 1] - first[t] == 1) & (p > 0)] = 1  # the only piece that ends there
        upto = _sums(p)[1:]
        upto = (upto - (upto - _fixed(p))[first[t]]) * _GRAIN
        upto[first[1:][first[1:] > first[:-1]] - 1] = 2  # the last edge takes what rounding leaves
        self.first = np.append(self.first, (self.first[-1] + first[1:]).astype(np.int32))
        self.back, self.id = np.append(self.back, (t - f).astype(np.uint8)), np.append(self.id, i.astype(np.uint16))
        signed = np.where(p > 0.5, p - 1, p)
        signed[p == 1] = -0.0
        self.p, self.upto = np.append(self.p, signed.astype(np.float32)), np.append(self.upto, upto.astype(np.float32))
        self.nodes += n
        return base + size + self.nodes - n


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each unit and its text."""
    space, feed = data == 32, data == 10
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(cut[:-1])
    return start, np.searchsorted(offsets, start, "right") - 1


_STEP = np.uint64(0x9FB21C651E98DF25)


def _unit(state: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) from 64-bit words."""
    return ((mix(state) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) that depend on seed and counter alone."""
    return _unit(seed + counter * _STEP)


def _draw(lattice: Lattice, node: np.ndarray, seed: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces drawn from each node back to its unit's start: how many, and their edges."""
    who, steps = np.arange(len(node)), []
    count = np.zeros(len(node), np.int64)
    at, state, step = node, seed + counter * _STEP, 0
    while True:
        edge = lattice.first[at]
        on = lattice.first[at + 1] > edge
        if not on.all():
            who, at, state, edge = who[on], at[on], state[on], edge[on]
        if not len(who):
            break
        u = _unit(state + np.uint64(2 * step * int(_STEP) & (1 << 64) - 1))
        low = np.flatnonzero(lattice.upto[edge] < u)
        while len(low):
            edge[low] += 1
            low = low[lattice.upto[edge[low]] < u[low]]
        steps.append((who, edge))
        count[who] += 1
        at = at - lattice.back[edge]
        step += 1
    base = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for i, (w, e) in enumerate(steps):
        out[base[w] + i] = e
    return count, out


def _truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels of these locations given that they are at most bound."""
    with np.errstate(divide="ignore"):
        return location - np.log(np.exp(location - bound) - np.log(u))


class _Path:
    """One segmentation: edges in the order they were fixed, the unit of each, log
    probability before each, and the value of each rest (-inf up to where it branched)."""

    def __init__(self, edges, unit, before, rest, log_prob, value):
        self.edges, self.unit, self.before, self.rest, self.log_prob, self.value = edges, unit, before, rest, log_prob, value
        self.lost: dict[int, list[int]] = {}


def _grow(lattice: Lattice, edges, seeds, counters, texts, bound, prefix, n_texts):
    """before and rest of newly fixed edges, flat, in order of texts; prefix: log probability before the first one."""
    p, others = lattice.chances(edges)
    with np.errstate(divide="ignore"):
        log_p, left = np.maximum(np.log(p), -100), np.log(others)
    log_p = _fixed(log_p) * _GRAIN
    sums = _sums(log_p)
    first = np.searchsorted(texts, np.arange(n_texts))
    before = (sums[:-1] - sums[first[texts]]) * _GRAIN + prefix[texts]
    return before, _truncated(before + left, bound[texts], _uniform(seeds, counters)), log_p


def sample(lattice: Lattice, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k segmentations, best first: ids, log probability, value, score."""
    n = len(offsets) - 1
    start, text = units(data, offsets)
    last = lattice.ends(data, Spans(data), start, np.append(start[1:], len(data))) if len(start) else np.zeros(0, np.int64)
    first_unit = np.searchsorted(text, np.arange(n + 1))
    place = 2 * (start - offsets[text]).astype(np.uint64)  # a unit draws twice a byte at most
    seed = mix(keys.astype(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
    root = -np.log(-np.log(_uniform(seed, np.full(n, np.uint64(1) << np.uint64(62)))))
    counter = lambda s, unit: (np.uint64(s) << np.uint64(52)) + place[unit]

    def complete(s, unit, node, bound, prefix):
        """Draws from node in each unit; flat edges with what _Path wants, by text."""
        count, edges = _draw(lattice, node, seed[text[unit]], counter(s, unit))
        of = np.repeat(unit, count)
        step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        own = counter(s, of) + (2 * step + 1).astype(np.uint64)
        before, rest, log_p = _grow(lattice, edges, seed[text[of]], own, text[of], bound, prefix, n)
        cut = np.searchsorted(text[of], np.arange(n + 1))
        return of, edges, before, rest, log_p, cut

    of, edges, before, rest, log_p, cut = complete(1, np.arange(len(start)), last, root, np.zeros(n))
    paths = [[_Path(edges[a:b], of[a:b], before[a:b], rest[a:b].copy(), float(log_p[a:b].sum()), float(g))] for a, b, g in zip(cut[:-1].tolist(), cut[1:].tolist(), root.tolist(), strict=True)]
    kappa = np.full(n, -np.inf)
    for s in range(2, k + 2):
        unit, node, branch = [], [], {}
        bound, prefix = np.zeros(n), np.zeros(n)
        for d in range(n):
            if len(paths[d]) < s - 1:
                continue
            while True:
                best, path, i = -np.inf, None, -1
                for x in paths[d]:
                    if len(x.rest) and x.rest[j := int(x.rest.argmax())] > best:
                        best, path, i = float(x.rest[j]), x, j
                if path is None or s == k + 1:
                    break
                # Another piece that ends where the i-th does, by weight among those not taken yet.
                taken = path.lost.setdefault(i, [int(path.edges[i])])
                end = int(np.searchsorted(lattice.first, np.int32(taken[0]), "right")) - 1
                others = np.setdiff1d(np.arange(lattice.first[end], lattice.first[end + 1]), taken)
                weight = lattice.chances(others)[0]
                if weight.sum() > 0:
                    break
                path.rest[i] = -np.inf
            if path is None:
                continue
            if s == k + 1:
                kappa[d] = best
                continue
            u, again = _uniform(seed[d : d + 1], np.array([s, s + 64], np.uint64) + (np.uint64(1) << np.uint64(61)))
            chosen = min(int(np.searchsorted(np.cumsum(weight), u * weight.sum())), len(others) - 1)
            edge = int(others[chosen])
            taken.append(edge)
            left = float(np.delete(weight, chosen).sum())
            path.rest[i] = _truncated(path.before[i] + np.log(left), best, again) if len(others) > 1 and left > 0 else -np.inf
            bound[d], prefix[d] = best, float(path.before[i] + np.log(weight[chosen]))
            branch[d] = (path, i, edge)
            own = int(path.unit[i])
            unit.append(np.arange(own, first_unit[d + 1]))
            node.append(last[own : first_unit[d + 1]].copy())
            node[-1][0] = end - int(lattice.back[edge])
        if not branch:
            continue
        of, edges, before, rest, log_p, cut = complete(s, np.concatenate(unit), np.concatenate(node), bound, prefix)
        for d, (path, i, edge) in branch.items():
            a, b = int(cut[d]), int(cut[d + 1])
            join = lambda x, mid, y: np.concatenate([x[:i], [mid], y[a:b]])  # noqa: B023,E731
            gone = np.full(i + 1, -np.inf)
            paths[d].append(_Path(join(path.edges, edge, edges), join(path.unit, path.unit[i], of), join(path.before, path.before[i], before), np.concatenate([gone, rest[a:b]]), float(prefix[d] + log_p[a:b].sum()), float(bound[d])))
    out = []
    for d in range(n):
        rows = []
        for x in paths[d]:
            # Pieces were fixed from the end of each unit.
            where = np.lexsort([-np.arange(len(x.unit)), x.unit])
            gap = x.log_prob - kappa[d]
            with np.errstate(divide="ignore"):
                score = 0.0 if kappa[d] == -np.inf else gap if gap < -30 else float(np.log(-np.expm1(-np.exp(min(gap, 30)))))
            rows.append((lattice.id[x.edges[where]].astype(np.int32), x.log_prob, x.value, score))
        out.append(rows)
    return out


def _led(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each non-empty text behind the space that the model puts before it."""
    full = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][full], 32), offsets + np.append(0, np.cumsum(full))


def encode(docs: DataFrame, model: str, k: int = 2, sharpness: float = 1.0, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, rank (from 0), n_tokens, ids, log_prob, perturbed, score: up to k rows of every
    document. ``block`` bytes of text are worked on together: fewer take less memory and more time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = kept_by_worker(("lattice", model, sharpness), lambda: Lattice(pieces(model, sharpness)))
        for batch in batches:
            for lo, hi, data, offsets in arrow_blocks(batch.column(2), block):
                data, offsets = _led(data, offsets)
                found = sample(lattice, data, offsets, batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).view(np.uint64), k)
                row = np.repeat(np.arange(lo, hi), [len(x) for x in found])
                flat = [(r, *x) for xs in found for r, x in enumerate(xs)]
                size = np.array([len(x[1]) for x in flat])
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(np.concatenate([x[1] for x in flat])))
                numbers = [pa.array([x[i] for x in flat], kind) for i, kind in ((0, pa.int32()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), numbers[0], pa.array(size), ids, *numbers[1:]], [id_col, "rank", "n_tokens", "ids", "log_prob", "perturbed", "score"])
        release_memory()

    text = F.replace(F.col(text_col).cast("string"), F.lit("▁"), F.lit(" "))
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))
    slim = docs.select(id_col, key.alias("_key"), text.alias("_text"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, rank int, n_tokens long, ids array<int>, log_prob double, perturbed double, score double")


def decode(tokens: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """tokens with the column text: the pieces of ids joined, without the leading space."""
    names = tokens.columns
    at = names.index(ids_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = pieces(model, 1.0).bytes
        texts = [None if ids is None else b"".join(map(known.__getitem__, ids))[1:].decode("utf-8", "replace") for ids in batch.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return map_arrow(tokens, run, f"{kinds}, text string")
