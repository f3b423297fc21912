"""Removal of repeated passages against all windows, and for odd inputs."""

import hashlib
import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string"


def digest(spark, rows, **how):
    return sorted((tuple(r) for r in sd.digest(spark.createDataFrame(rows, SCHEMA).repartition(5), **how).collect()), key=str)


def expected(rows, size):
    found = brute.without_repeats([t for _, t in rows], size)
    return sorted(((i, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (i, _), (w, k) in zip(rows, found)), key=str)


def mixed(seed, n, size):
    """Documents of passages that others share, whole or cut, between words of their own."""
    r = random.Random(seed)
    passages = [[f"p{i}w{r.randrange(9)}" for _ in range(r.randrange(size - 2, 3 * size))] for i in range(12)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(r.randrange(1, 6)):
            p = r.choice(passages)
            a = r.choice([0, 0, r.randrange(len(p))])
            out += p[a : r.choice([len(p), r.randrange(len(p) + 1)])]
            out += [f"own{i}x{r.randrange(1000)}" for _ in range(r.randrange(0, 2 * size))]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(out)))
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1].replace(" ", "  "))]


@pytest.mark.parametrize(("size", "gram", "cells"), [(35, 8, 1 << 26), (35, 8, 1 << 16), (6, 3, 1 << 20), (7, 7, 1 << 18)])
def test_against_all_windows(spark, size, gram, cells):
    rows = mixed(size + cells, 60, size)
    got = digest(spark, rows, size=size, gram=gram, cells=cells)
    assert got == expected(rows, size) and 0 < sum(x[2] for x in got) < sum(x[1] for x in got)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(sd.Sketch, "repeated", lambda self, anchors: np.ones(len(anchors), bool))
    rows = mixed(5, 50, 10)
    assert digest(spark, rows, size=10, gram=4, cells=1 << 16) == expected(rows, 10)


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    twins = "one quarterly-report two", "one 4ck6x5vha>\\w6(r| two"
    rows = [(1, None), (2, ""), (None, " \n\t"), (3, "a " * 3000), (4, "a b c " * 1000), (None, passage), (None, passage), (5, passage.upper()), (6, "x " + passage[:-1]), (7, passage + "9"), (7, "y " + passage), (8, "日本 " * 34), (9, "日本 " * 35), (10, "日本 " * 36)]
    rows += [(20 + i, " ".join(f"v{k}" for k in range(20)) + f" {t} " + " ".join(f"v{k}" for k in range(20, 40))) for i, t in enumerate(twins)]
    rows += [(30, " ".join(f"l{k}" for k in range(40_000)))]
    assert digest(spark, rows) == expected(rows, 35)
    assert sd.digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_columns_pass(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, "a " + passage, "x"), (2, passage + " b", "y"), (3, "c  d", None), (None, None, "z")], SCHEMA + ", id string").select("*", *[F.lit(1).alias(c) for c in ("tag", "ranges", "row", "_text", "start")])
    got = {r["id"]: r for r in sd.without_repeats(df).collect()}
    assert {k: (r["doc_id"], r["text"], r["tag"]) for k, r in got.items()} == {"x": (1, "a", 1), "y": (2, "b", 1), None: (3, "c  d", 1), "z": (None, None, 1)}
    assert sd.without_repeats(df).columns == df.columns


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 40))
def test_least_is_the_first_least(values, size):
    g = np.array(values, np.uint64)
    if len(g) >= size:
        assert sd._least(g, size).tolist() == [i + int(np.argmin(g[i : i + size])) for i in range(len(g) - size + 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=8, max_size=80))
def test_runs_hold_each_window_once(values):
    data = " ".join(f"w{v}" for v in values).encode()
    r = sd.window_runs(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 8, 3)
    assert np.concatenate([np.arange(s, s + n) for s, n in zip(r.start, r.n)]).tolist() == list(range(len(values) - 7))
    same = {}
    for s, n, name, anchor in zip(r.start.tolist(), r.n.tolist(), r.name.tolist(), r.anchor.tolist()):
        assert same.setdefault((anchor, name), tuple(values[s : s + n + 7])) == tuple(values[s : s + n + 7])


def test_estimates_are_never_low():
    anchors = np.random.Generator(np.random.PCG64(3)).integers(0, 500, 1500, dtype=np.uint64)
    slots = {}
    for part in np.array_split(anchors, 4):
        for batch in sd._part(part, 1 << 16):
            for slot, filled, more in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = slots.setdefault(slot, (np.zeros(sd.SLOT, bool), np.zeros(sd.SLOT, bool)))
                at = np.frombuffer(filled, "<u2")
                twice[at[once[at]]], once[at] = True, True
                twice[np.frombuffer(more, "<u2")] = True
    seen = sd.Sketch({k: np.packbits(t, bitorder="little").tobytes() for k, (_, t) in slots.items()}, 1 << 16)
    found, times = np.unique(anchors, return_counts=True)
    assert seen.repeated(found[times > 1]).all() and not seen.repeated(np.arange(10_000, 20_000, dtype=np.uint64)).any() or seen.repeated(np.arange(10_000, 20_000, dtype=np.uint64)).mean() < 0.01
