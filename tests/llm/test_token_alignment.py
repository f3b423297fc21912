"""Cross-tokenizer alignment against whole texts and all pairs of tokens, and for odd inputs."""

import random
from pathlib import Path

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"
DATA = Path("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    chars = ta.byte_level()
    bytes_a = lambda i: bytes(chars[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: a.encode(t, add_special_tokens=False).ids, b.encode, bytes_a, bytes_b


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "   \n\t  "), (None, "one two"), (None, "one two"), (5, "Ünïcödé ﬁ nb em a  b　c 日本語 テキスト 🎉🎉 é"), (6, "a ▁ b"), (7, "<|endoftext|> <s> </s> <unk> <0x41>"), (8, "x" * 3000 + " " + "日" * 500),
    (9, "it's we'll  don't 1234567 3.14 $%& (a) \x1c b \x85 c \x00 d"), (10, "a\nb \nc\n d\n\n  e \tf\r\n g"), (11, "end "), (12, "end  \n"), (13, " a  b ﻿c ​d"), (14, "quarterly-table 0edcklh#`'x/`*_`"),
]


@pytest.mark.parametrize("most", [ta.PAIRS, 10])
def test_against_whole_texts(spark, models, most):
    """Both ways of joining the counts."""
    r = random.Random(4)
    rows = ODD + [(100 + i, " ".join(r.choice(["theere", "Wörter", "naïve", "x1y2", "über-", "a", "ing", "12.5", "ééàç"]) for _ in range(40))) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit("x").alias(c) for c in ("id", "pair", "n_a", "links", "row")])
    assert found(ta.alignment(df, A, B, most)) == sorted(brute.alignments(rows, *models), key=str)
    assert ta.alignment(df.limit(0), A, B, most).collect() == [] and ta.alignment(df.limit(0), A, B, most).columns[0] == "doc_id"


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_documents(spark, models):
    df = spark.read.parquet(str(DATA)).where("length(text) < 1500")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert found(ta.alignment(df, A, B)) == sorted(brute.alignments(rows, *models), key=str)


def test_forgotten_units(spark, models, monkeypatch):
    monkeypatch.setattr(ta, "KEPT", 3)
    monkeypatch.setattr(ta, "BLOCK", 64)
    known, texts = ta.Aligner(A, B), [t for _, t in ODD]
    import pyarrow as pa

    got = []
    for lo, hi, rows, first, ok in ta._aligned(pa.record_batch([pa.array(texts)], ["text"]), 0, known):
        counts, sha = ta._own(known, rows, first, ok)
        got += list(zip(*[c.to_pylist() for c in counts], sha))
    assert got == [(a, b, g, n, h) for _, a, b, g, n, _, _, h in brute.alignments(ODD, *models)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30))
def test_components_are_least_groups(a, b):
    """Tokens of these sizes, the last one made as long as it takes."""
    a[-1] += max(0, sum(b) - sum(a))
    b[-1] += max(0, sum(a) - sum(b))
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    cuts = np.union1d(ends_a, ends_b)
    root = ta.components(np.searchsorted(ends_a, cuts), len(a) + np.searchsorted(ends_b, cuts), len(a) + len(b))
    both = np.intersect1d(ends_a, ends_b)
    assert np.unique(root, return_inverse=True)[1].tolist() == np.append(np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)).tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab é 　\n'1s日▁", max_size=12), min_size=1, max_size=4))
def test_units_are_cut_where_both_begin(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = test_units_are_cut_where_both_begin.models = getattr(test_units_are_cut_where_both_begin, "models", None) or (Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B))
    raw = [t.encode() for t in texts]
    found, first = ta.units(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    found = found.to_pylist()
    for t, s, e in zip(texts, first[:-1], first[1:]):
        assert b"".join(found[s:e]) == ((" " + t).encode() if t else b"")
        if t and "▁" not in t:
            assert [i for u in found[s:e] for i in a.encode(u.decode(), add_special_tokens=False).ids] == a.encode(" " + t, add_special_tokens=False).ids
            assert [i for u in found[s:e] for i in b.encode(u.decode()[1:])] == b.encode(t)
