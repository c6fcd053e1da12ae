from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from readloom.llm import registry
from readloom.llm.base import materialize

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in wanted.description]
    df = registry.QUERIES[name](spark, SF).select(*names)
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, wanted.fetchall()))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sentencepiece":
            assert out.schema.names == docs.schema.names
        docs = materialize(out, name)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= before
        before = now
    assert docs.where("NOT parity OR NOT round_trip").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == before


def test_stages_on_edges(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "same text here", "en", "s", 14), (3, "same text here", "en", "s", 14), (4, "w " * 20000, "en", "s", 40000), (None, "x", "en", "s", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), "edge")
        # rows that share a doc_id stay or go together
        assert docs.count() == len(data)


def test_against_brute_force(spark, tmp_path):
    """All stages on made documents; only the classifier's own decisions are taken as they are."""
    from llm_conftest import made_docs
    from test_dedup import leaks_by_hand, lines_by_hand, near_by_hand

    from readloom.llm import sentencepiece_codec, toxicity

    rows = [(d, t if d % 9 else f"{t or ''} nastyword{d % 3}") for d, t in made_docs(8, 90)]
    long = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(k, " ".join(t.split()[10 : 10 + n])) for k, (t, n) in enumerate(zip(long[::7], (8, 20, 40, 12, 30), strict=False))]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d % 9 == 0)) for d, _ in rows if d % 4], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).where("is_toxic").collect()}
    left = [(d, t) for d, t in rows if d not in toxic]
    left = [(d, lines_by_hand(left)[d][0]) for d, _ in left]
    near = near_by_hand(left, 5, 80)
    left = [(d, t) for d, t in left if near[d][2]]
    leaked = {d for d, _ in leaks_by_hand(left, items)}
    left = {d: t for d, t in left if d not in leaked}
    assert leaked and len(left) < len(near) and len(near) <= len(rows)
    with open(sentencepiece_codec.default_model(), "rb") as f:
        theirs = sentencepiece_codec.Codec(f.read()).theirs
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {d: theirs.encode(t) for d, t in left.items()}
