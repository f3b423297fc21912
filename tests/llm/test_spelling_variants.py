"""Spelling variants against all pairs, and for odd inputs."""

import random
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import spelling_variants as sv


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def spelled(seed, n):
    """Texts of few stems, with edits, accents and repeats of different frequency."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeéßÿÀàz") for _ in range(r.randrange(5, 12))) for _ in range(25)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(80):
            w = stems[min(int(r.expovariate(0.25)), 24)]
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + "e" + w[at:], w[:at] + "b" + w[at + 1 :]])
            text.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", "-", "\n", "1"]).join(text)))
    return rows


ODD = [(None, None), (1, ""), (2, "  12 "), (3, "x" * 100_000 + " " + "x" * 99_999), (None, "nullable nullable"), (4, "ÀÉÎÕÜß÷×ÿ" * 3)] + [(5, "letters lettters letter lettérs ﬁﬁﬁﬁﬁﬁ日本日本日本")] * 6 + [(7, "ab" * 40_000)] * 5 + [(8, "ab" * 40_000 + "c")] * 26


def test_against_all_pairs(spark):
    rows = spelled(1, 120)
    expected = brute.variants(brute.altered_words(rows))
    got = found(sv.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == expected and sum(f is not None for f, *_ in got.values()) > 20


def test_chains_of_forms(spark):
    rows = [(1, " ".join(["vvvvvv"] * 150 + ["vvvvvw"] * 30 + ["vvvvww"] * 6))]
    got = found(sv.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute.variants(brute.altered_words(rows)) and got["vvvvww"][:2] == ("vvvvvw", "vvvvvv")


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("word", "n", "size", "mask", "bucket", "root")])
    got = found(sv.variants(df))
    assert got == brute.variants(brute.altered_words(ODD)) and got["ab" * 40_000][3] == 1
    assert found(sv.variants(df.limit(0))) == {} and sv.variants(df.limit(0)).columns == ["word", "form", "root", "n", "n_near", "form_n"]


@settings(max_examples=200, deadline=None)
@given(st.text("abcéÀàz", min_size=5, max_size=9), st.text("abcéÀàz", min_size=1, max_size=1), st.integers(0, 9), st.sampled_from("idr"))
def test_one_edit_leaves_a_band_and_a_half(word, letter, at, kind):
    at %= len(word)
    other = {"i": word[:at] + letter + word[at:], "d": word[:at] + word[at + 1 :], "r": word[:at] + letter + word[at + 1 :]}[kind]
    bit = lambda c: ord(c) - 97 if ord(c) < 128 else 26 + ord(c) % 32
    masks = [np.bitwise_xor.reduce([1 << bit(c) for c in w]) for w in (word.replace("A", "a"), other)]
    assert any((masks[0] ^ masks[1]) & b == 0 for b in sv._bands())
    half = (max(len(word), len(other)) - 1) // 2
    assert word[:half] == other[:half] or word[-half:] == other[-half:]


def test_checksums_are_zlibs():
    texts = [b"a", b"letters", b"x" * 64, b"y" * 65, "ÿß".encode(), b"z" * 1000]
    data, end = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(len(texts))], np.uint32)
    got = sv.checksums(data, np.append(0, end[:-1]), end, before)
    assert got.tolist() == [zlib.crc32(b"%d:" % i + t) for i, t in enumerate(texts)]


def test_pairs_meet_once_and_buckets_are_keyed(spark):
    """No pair comes twice, and the plan joins by bucket."""
    words = spark.createDataFrame([(w, 5) for w in ("aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "abaaaa", "bbbbbb", "cccccc")], "word string, n long")
    pairs = [tuple(sorted(r)) for r in sv.near_pairs(words).select("word_1", "word_2").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {tuple(sorted((a, b))) for a in ("aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "abaaaa", "bbbbbb", "cccccc") for b in ("aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "abaaaa") if brute.one_edit(a, b)}
    plan = sv.near_pairs(words)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("chain", [3, 9])
def test_roots_follow_chains(spark, chain):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(chain)]
    assert {r["word"]: r["root"] for r in sv.roots(spark.createDataFrame(rows, "word string, root string")).collect()} == {f"w{i}": f"w{chain}" for i in range(chain)}
