"""The pipeline and every training-data query at the smallest scale."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from wellspring.llm import toxicity  # noqa: E402
from wellspring.llm.common import stored  # noqa: E402
from wellspring.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def test_stages_equal_brute_force(spark):
    columns = read(spark, "documents").columns
    docs = read(spark, "documents")
    items = [tuple(r) for r in read(spark, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stored(stage(spark, docs, SMALL), name)
        after = [(r.doc_id, r.text) for r in out.collect()]
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score_toxicity(docs, read(spark, "labels")).where("predicted = 1").collect()}
            want = [(i, t) for i, t in before if i not in bad]
        elif name == "line_dedup":
            want = [(i, kept) for i, _, _, kept in brute.lines(before, 10)]
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "minhash":
            kept = {g[0] for g in brute.near_groups(before) if g[3]}
            want = [(i, t) for i, t in before if i in kept]
        elif name == "decontamination":
            bad = {d for d, _ in brute.leaks(before, items)}
            want = [(i, t) for i, t in before if i not in bad]
            assert bad
        else:
            assert out.columns == [*columns, "copy_no"]
            assert set(after) <= set(before) and out.agg(F.max("copy_no")).first()[0] <= 2
            continue
        assert sorted(after) == sorted(want), name
        assert out.columns == columns
        docs = out


def test_every_operator_is_registered_once():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    norm = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert norm(QUERIES[name](spark, SMALL).select(*columns).collect()) == norm(want.fetchall())


@pytest.mark.parametrize("name", ["op4_licenses", "op5_embeddings", "op8_toxicity", "op9_langid", "op12_lm_score"])
def test_query_rows(spark, name):
    key, source = ("vec_id", "embeddings") if name.startswith("op5") else ("doc_id", "documents")
    got = [r[0] for r in QUERIES[name](spark, SMALL).select(key).collect()]
    assert sorted(got) == sorted(r[0] for r in read(spark, source).select(key).collect())


def test_whitening_query_rows(spark):
    got = QUERIES["op11_whitening"](spark, SMALL).groupBy("vec_id").agg(F.count("*").alias("n"), F.max("component").alias("k")).collect()
    assert {(r.n, r.k) for r in got} == {(16, 16)}
    assert sorted(r.vec_id for r in got) == sorted(r.vec_id for r in read(spark, "embeddings").select("vec_id").collect())


def test_minhash_and_suffix_queries_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, "documents").collect()]
    got = QUERIES["op6_minhash"](spark, SMALL).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute.near_groups(rows))
    got = QUERIES["op10_suffix_dedup"](spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeats(rows, 400))
