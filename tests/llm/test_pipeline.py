"""The pipeline's stages, each on what the one before kept; oracles of the subpackage's queries."""

import pytest

import corpus_pipeline as P
from reelspark.llm.queries import ORACLE, QUERIES
from tools.oracle_check import digest, duck

from ..conftest import SF001, SF01


def test_stages(spark, scratch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF001)
        if k < len(P.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{scratch}/{k}")
        docs = spark.read.parquet(f"{scratch}/{k}")
        if k < 3:
            assert 0 < docs.count() <= before
            before = docs.count()
            assert docs.select("doc_id").distinct().count() == before
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0


def test_each_stage_first_lets_go_of_what_the_driver_holds(spark, monkeypatch):
    def released(session):
        raise InterruptedError
    monkeypatch.setattr(P, "release", released, raising=False)
    for _, stage in P.STAGES:
        with pytest.raises(InterruptedError):
            stage(spark, None, SF001)


def test_run_equals_the_stages(spark):
    assert P.run(spark, SF001).columns[0] == "doc_id"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    con = duck(SF01)
    df = QUERIES[name](spark, SF01)
    cur = con.execute(ORACLE[name])
    assert digest(df.columns, df.collect())[:3] == digest([d[0] for d in cur.description], cur.fetchall())[:3]


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
