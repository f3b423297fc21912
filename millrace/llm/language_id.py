"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text (ASCII lower-cased) forwards and backwards in windows that
overlap: it labels the ``CORE`` bytes of each, and reads ``MARGIN`` bytes more at both sides,
so that no label stands at a cut and words, spaces and the words around them are its
context. Every byte of the whole text is labelled once. A document pools them: the mean
log-probability of its bytes times a sharpness, through a softmax. The sharpness is fitted to
the training documents by logistic loss with smoothed labels, so a score is a calibrated
probability and not the product of thousands of dependent ones.

Trained here in numpy by backpropagation through time with Adam, on at most ``DOCS``
documents of each language and ``WINDOWS`` pieces of ``SPAN`` bytes of each, outside the
held-out fold. Every language is learnt, however many there are.

Cases: null text and text without a letter are ``und`` with score 0; with no training
text at all so is everything; one training language gets every other text; documents
without a language or an id are predicted and not learnt from; repeated rows are each
predicted; long texts are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_blocks, map_arrow
from millrace.llm.quality_classifier import fold
from millrace.llm.words import LOWER, mix, per_text

#: Of the sample: documents a language, pieces a document, bytes of a piece.
DOCS, WINDOWS, SPAN = 400, 8, 48
#: Of the network and its training: pieces of a step, spread over the languages.
HIDDEN, STEPS, BATCH, RATE = 12, 400, 128, 0.02
#: Bytes that a window labels, bytes that it reads beyond them at both sides, and bytes of a block.
CORE, MARGIN, BLOCK = 256, 16, 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Gates of both directions: x rows are bytes (256 pads), then h weights; a softmax over both states."""

    languages: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    sharpness: float = 1.0

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 11) -> Network:
        draw = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[f"x{d}"] = draw.normal(0, 0.1, (257, 3 * HIDDEN)).astype(np.float32)
            p[f"h{d}"] = draw.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        p["o"] = draw.normal(0, 0.2, (2 * HIDDEN + 1, len(languages))).astype(np.float32)
        return cls(languages, p)

    def _states(self, x: np.ndarray, on: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each step of x (steps, words), zero before a word; ``on`` marks real bytes."""
        u, n = self.p[f"h{d}"], HIDDEN
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((*x.shape, n), np.float32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            a, g = self.p[f"x{d}"][x[t]], h @ u
            zr = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
            if keep is not None:
                keep.append((t, h, z, r, c, g[:, 2 * n :]))
            new = c + z * (h - c)
            h = new if on[t].all() else np.where(on[t][:, None], new, h)
            out[t] = h
        return out

    def _read(self, x: np.ndarray, on: np.ndarray, d: str) -> np.ndarray:
        """The same states without what learning needs: with s = 2 * sigmoid - 1, a tanh of half the
        argument, a step is tanh of the gates and (c + h + s (h - c)) / 2, all in place. Each
        gate has arrays of its own, as slices of one would be read with gaps."""
        n, half = HIDDEN, np.float32(0.5)
        wz, wr, wc = (np.ascontiguousarray(self.p[f"x{d}"][:, i * n : (i + 1) * n] * (half if i < 2 else 1)) for i in range(3))
        uz, ur, uc = (np.ascontiguousarray(self.p[f"h{d}"][:, i * n : (i + 1) * n] * half) for i in range(3))
        z, c, part = (np.empty((x.shape[1], n), np.float32) for _ in range(3))
        h, out = np.zeros((x.shape[1], n), np.float32), np.empty((*x.shape, n), np.float32)
        whole, x = on.all(1), x.astype(np.intp)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            np.take(wz, x[t], axis=0, out=z, mode="clip")
            np.take(wr, x[t], axis=0, out=c, mode="clip")
            z += np.dot(h, uz, out=part)
            np.tanh(z, out=z)
            c += np.dot(h, ur, out=part)
            np.tanh(c, out=c)
            c += 1
            c *= np.dot(h, uc, out=part)
            c += np.take(wc, x[t], axis=0, out=part, mode="clip")
            np.tanh(c, out=c)
            new = np.subtract(h, c, out=out[t])
            new *= z
            new += h
            new += c
            new *= half
            if not whole[t]:
                new[~on[t]] = h[~on[t]]
            h = new
        return out

    def labels(self, x: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Log-probabilities (languages, steps, words)."""
        o, n = self.p["o"], HIDDEN
        y = np.dot(o[:n].T, self._read(x, on, "f").reshape(-1, n).T)
        y += np.dot(o[n:-1].T, self._read(x, on, "b").reshape(-1, n).T)
        y += o[-1][:, None]
        y -= y.max(0)
        y -= np.log(np.exp(y).sum(0))
        return y.reshape(-1, *x.shape)

    def log_probabilities(self, x: np.ndarray, on: np.ndarray) -> np.ndarray:
        """The same as (steps, words, languages)."""
        return np.moveaxis(self.labels(x, on), 0, -1)

    def gradient(self, x: np.ndarray, on: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the bytes, and its gradient by backpropagation through time."""
        n, o, tapes = HIDDEN, self.p["o"], {"f": [], "b": []}
        s = {d: self._states(x, on, d, tapes[d]) for d in "fb"}
        y = s["f"] @ o[:n] + s["b"] @ o[n:-1] + o[-1]
        y = np.exp(y - y.max(-1, keepdims=True))
        y /= y.sum(-1, keepdims=True)
        total = on.sum()
        words = np.arange(x.shape[1])
        loss = float(-(np.log(y[:, words, label] + 1e-9) * on).sum() / total)
        y[:, words, label] -= 1
        y *= (on / total)[..., None].astype(np.float32)
        flat = y.reshape(-1, y.shape[-1])
        g = {"o": np.vstack([s["f"].reshape(-1, n).T @ flat, s["b"].reshape(-1, n).T @ flat, flat.sum(0, keepdims=True)])}
        for d, part in (("f", o[:n]), ("b", o[n:-1])):
            u, gx, gu = self.p[f"h{d}"], np.zeros((257, 3 * n), np.float32), np.zeros((n, 3 * n), np.float32)
            back = np.zeros((x.shape[1], n), np.float32)
            for t, h, z, r, c, hu in reversed(tapes[d]):
                back = back + y[t] @ part.T
                live = on[t][:, None]
                dh = np.where(live, back, 0)
                dc = dh * (1 - z) * (1 - c * c)
                da = np.hstack([dh * (h - c) * z * (1 - z), dc * hu * r * (1 - r), dc])
                dg = np.hstack([da[:, : 2 * n], dc * r])
                np.add.at(gx, x[t], da)
                gu += h.T @ dg
                back = np.where(live, dh * z + dg @ u.T, back)
            g |= {f"x{d}": gx, f"h{d}": gu}
        return loss, g


def padded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (steps, pieces) padded with 256, and which are real."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return _grid(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size)


def _grid(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(size.max(initial=1))[:, None]
    on = steps < size
    x = np.where(on, data[np.minimum(start + steps, max(len(data) - 1, 0))] if len(data) else 0, 256)
    return x.astype(np.int16), on


def train(pieces: list[bytes], labels: list[str], docs: list[object], seed: int = 3) -> Network | None:
    """Adam on batches with as many pieces of each language; ``docs`` says whose a piece is."""
    languages = sorted(set(labels))
    if not languages:
        return None
    net = Network.fresh(languages)
    if len(languages) == 1:
        return net
    number = {k: i for i, k in enumerate(languages)}
    label = np.array([number[k] for k in labels])
    groups, draw = [np.flatnonzero(label == i) for i in range(len(languages))], np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in "mv")
    for step in range(1, STEPS + 1):
        at = np.concatenate([draw.choice(g, -(-BATCH // len(groups))) for g in groups])
        _, grad = net.gradient(*padded([pieces[i] for i in at]), label[at])
        rate = RATE * (1 - step / (STEPS + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
        for k, g in grad.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.001 * (g * g - v[k])
            net.p[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    names, first, own = np.unique(docs, return_index=True, return_inverse=True)
    size = np.array(list(map(len, pieces)))
    sums = np.zeros((len(names), len(languages)))
    for lo in range(0, len(pieces), 4096):
        x, on = padded(pieces[lo : lo + 4096])
        np.add.at(sums, own[lo : lo + 4096], (net.log_probabilities(x, on) * on[..., None]).sum(0))
    net.sharpness = calibrated(sums / np.bincount(own, weights=size)[:, None], label[first])
    return net


def calibrated(y: np.ndarray, label: np.ndarray) -> float:
    """The factor of mean log-probabilities y that makes their softmax likeliest, by a search over
    its logarithm. Labels are smoothed by one document of each language, so it is finite."""
    n = np.bincount(label, minlength=y.shape[1])[label][:, None]
    target = np.where(np.arange(y.shape[1]) == label[:, None], (n + 1.0) / (n + y.shape[1]), 1.0 / (n + y.shape[1]))

    def loss(x: float) -> float:
        z = np.exp(x) * (y - y.max(1, keepdims=True))
        return float((np.log(np.exp(z).sum(1)) - (target * z).sum(1)).mean())

    low, high, ratio = -3.0, 8.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean log-probabilities of each text's bytes."""
    data, size = LOWER[data], np.diff(offsets)
    cores = -(-size // CORE)
    text = np.repeat(np.arange(len(size)), cores)
    core = offsets[text] + CORE * (np.arange(len(text)) - np.repeat(np.cumsum(cores) - cores, cores))
    stop = np.minimum(core + CORE, offsets[text + 1])
    start, end = np.maximum(core - MARGIN, offsets[text]), np.minimum(stop + MARGIN, offsets[text + 1])
    out = np.zeros((len(size), len(net.languages)))
    order = np.argsort(end - start, kind="stable")
    most = max(64, (1 << 23) // (CORE * max(len(net.languages), 2 * HIDDEN)))
    for lo in range(0, len(order), most):
        at = order[lo : lo + most]
        x, on = _grid(data, start[at], (end - start)[at])
        place = start[at] + np.arange(len(x))[:, None]
        labelled = (place >= core[at]) & (place < stop[at])
        for i, y in enumerate(net.labels(x, on)):
            y *= labelled
            out[:, i] += np.bincount(text[at], weights=y.sum(0), minlength=len(out))
    return out / np.maximum(size, 1)[:, None]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = per_text(_LETTER[data], offsets) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def learn(docs: DataFrame) -> Network | None:
    """Trains on a bounded sample: documents of least hash among each language's."""
    known = docs.where(F.col("lang").isNotNull() & (fold("doc_id", 4) != 2)).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    count = known.where("text is not null").groupBy("lang").count().collect()  # a row for a language
    if not count:
        return None
    # A hash below a language's share keeps about twice DOCS of it, of which DOCS are taken.
    share = F.create_map(*[F.lit(x) for r in count for x in (r["lang"], min(1.0, 2 * DOCS / r["count"]))])
    lot = (F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    chosen = known.withColumn("lot", lot).where(F.col("lot") < share[F.col("lang")])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, pieces = [], []
        lots = batch.column(1).to_numpy()
        for lo, hi, data, offsets in arrow_blocks(batch.column(2)):
            data = LOWER[data]
            seed = mix((lots[lo:hi] * (1 << 52)).astype(np.uint64))
            for i in range(hi - lo):
                first, room = int(offsets[i]), int(offsets[i + 1] - offsets[i]) - SPAN
                luck = mix(seed[i] + np.arange(WINDOWS, dtype=np.uint64)) >> np.uint64(11)
                for start in [0] if room <= 0 else (luck % np.uint64(room + 1)).tolist():
                    row.append(lo + i)
                    pieces.append(data[first + start : min(first + start + SPAN, int(offsets[i + 1]))].tobytes())
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pieces, pa.binary())], ["lang", "lot", "piece"])

    rows = [r for r in map_arrow(chosen.select("lang", "lot", "text"), run, "lang string, lot double, piece binary").toArrow().to_pylist() if r["piece"]]
    rows.sort(key=lambda r: (r["lang"], r["lot"], r["piece"]))
    taken: dict[str, set] = {}
    pieces, labels, whose = [], [], []
    for r in rows:
        lots = taken.setdefault(r["lang"], set())
        if r["lot"] in lots or len(lots) < DOCS:
            lots.add(r["lot"])
            pieces.append(r["piece"])
            labels.append(r["lang"])
            whose.append((r["lang"], r["lot"]))
    number = {d: i for i, d in enumerate(dict.fromkeys(whose))}
    return train(pieces, labels, [number[d] for d in whose])


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    slim = docs.select("doc_id", held, F.col("text").cast("string"))
    if net is None:
        return slim.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.languages, "und"], object)
        for batch in batches:
            for lo, hi, data, offsets in arrow_blocks(batch.column(2), BLOCK):
                y = pooled(net, data, offsets)
                y = np.exp(net.sharpness * (y - y.max(1, keepdims=True)))
                y /= y.sum(1, keepdims=True)
                lettered = has_letter(data, offsets)
                best = np.where(lettered, y.argmax(1), len(net.languages))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(names[best], pa.string()), pa.array(np.where(lettered, y.max(1), 0.0).round(6))], ["doc_id", "held_out", "lang_pred", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
