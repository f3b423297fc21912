"""The pipeline's stages, each on its own input and held against brute force."""

from pathlib import Path

import brute
import corpus_pipeline
import pytest
from test_operators import CLASHING, DOCS, ODD, PIECES, prose, table
from pyspark.sql import functions as F

from millrace.llm import mixing, piece_sampling, quality_rules

DATA = Path("/root/testdata/sf0.001")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "mixing", "pieces"]
    assert corpus_pipeline.ORACLE_SQL is None and set(corpus_pipeline.QUERIES) == {"pipeline"}


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_run_stage_by_stage(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, "").persist()
    passing = {r["doc_id"] for r in quality_rules.quality(docs).where("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert {i for i, _ in rows} == passing and good.columns == docs.columns
    single = stage["near_dedup"](spark, good, "").persist()
    assert {r["doc_id"] for r in single.collect()} == set(brute.components(rows, 5, 80)) and single.columns == docs.columns
    safe = stage["pii"](spark, single, "").persist()
    assert safe.count() == single.count() and safe.columns == docs.columns
    assert all(not brute.base_spans(r["text"]) for r in safe.collect())
    mixed = stage["mixing"](spark, safe, "").persist()
    wanted = {r["doc_id"]: r["copies"] for r in mixing.mix(safe).collect()}
    seen = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert seen == {i: n for i, n in wanted.items() if n} and mixed.columns == docs.columns
    last = piece_sampling.decode(stage["pieces"](spark, mixed, ""), PIECES)
    texts = {r["doc_id"]: (r["text"] or "").replace("▁", " ") for r in safe.collect()}
    out = last.collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in out)
    key = ("doc_id", "rank", "n_tokens", "ids")
    assert sorted(tuple(r[k] for k in key) for r in out) == sorted(tuple(r[k] for k in key) for r in corpus_pipeline.run(spark, str(DATA)).collect())


def test_stages_take_odd_tables(spark):
    rows = [*ODD, *[(100 + i, prose(i, 80), "en", "a") for i in range(4)]]
    docs = table(spark, rows).select("*", *[F.lit("x").alias(c) for c in CLASHING])
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, "")
            assert name == "pieces" or out.columns == docs.columns
            out.collect()
    assert DOCS.startswith("doc_id")
