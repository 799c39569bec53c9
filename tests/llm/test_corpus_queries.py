"""Registered corpus queries against their SQL, held-out accuracy, and the pipeline against its parts."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tideline.llm import exact_dedup, mixing, ngram_join, oracle, quality_ranking, quality_rules, registry  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for name in os.listdir(SF_DIR):
        if name.endswith(".parquet"):
            db.execute(f"create view {name[:-8]} as select * from '{SF_DIR}/{name}'")
    return db


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    df = registry.REGISTRY[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = tables.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted(str(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == expected


def test_quality_ranking_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (registry.table(spark, sf_dir, t) for t in ("documents", "labels"))
    got = quality_ranking.ranked(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    worse = got[got.quality == 0]
    assert (got.quality == got.predicted).mean() > 0.98
    assert (worse.predicted == 0).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_ranking_edge_cases(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    docs = spark.createDataFrame([(1, None), (None, "a b"), (1, ""), (4, "x" * 100_000)], "doc_id bigint, text string")
    assert {r.score for r in quality_ranking.ranked(docs, labels).collect()} == {0.5}
    rows = [(i, ("%% $$ ## " if i % 2 else "plain words here ") * (i + 3)) for i in range(60)]
    labelled = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = quality_ranking.ranked(docs, labelled).collect()
    assert len(got) == 64 and all(0 <= r.score <= 1 for r in got)
    assert quality_ranking.ranked(docs.limit(0), labelled).count() == 0


def test_pipeline_stages(spark):
    docs = registry.table(spark, SF_DIR, "documents")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    good = docs.join(quality_rules.judged(docs).filter("kept").select("doc_id"), "doc_id", "left_semi")
    first = corpus_pipeline.quality(spark, docs, SF_DIR)
    assert ids(first) == ids(good)
    second = corpus_pipeline.copies(spark, first, SF_DIR)
    assert ids(second) == ids(exact_dedup.exact_dedup(first).filter("kept"))
    third = corpus_pipeline.near_copies(spark, second, SF_DIR)
    assert ids(third) == ids(ngram_join.linked_components(second).filter("doc_id = component_id"))
    fourth = corpus_pipeline.mix(spark, third, SF_DIR)
    drawn = mixing.assigned(third, registry.mix_path(third), corpus_pipeline.MIX)
    assert ids(fourth) == ids(drawn.filter("_epochs > 0"))
    assert 0 < fourth.count() < third.count()
    for stage in (first, second, third, fourth):
        assert stage.columns == docs.columns
    last = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, registry.bpe_digests(fourth).collect()))
