"""The pipeline stage by stage against brute force, and the queries against their SQL twins."""

import pytest
from odd import ODD, documents, empty, kept_lines, near_classes

import corpus_pipeline as cp
from __spark_entry__ import oracle_sql, queries
from check_oracle import compare, connect
from tablesync.llm.oracle import ORACLE
from tablesync.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, name):
    ok, text = compare(spark, connect(SF), SF, name)
    assert ok, text


def test_all_are_registered():
    assert set(REGISTRY) | {"pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert [int(n.split("_")[0][2:]) for n in REGISTRY] == list(range(1, 14))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = cp.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() > 0.8 * docs.count()
    lines = cp.drop_lines(spark, clean, SF)
    assert rows(lines) == {d: t for d, _, _, t in kept_lines(list(rows(clean).items()))}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    near = cp.drop_near_duplicates(spark, lines, SF)
    assert set(rows(near)) == {d for d, _, c in near_classes(list(rows(lines).items()), 5, 80) if d == c}
    mixed = cp.mix_sources(spark, near, SF)
    assert mixed.columns == docs.columns and rows(mixed) == rows(near)
    packed = cp.pack_sequences(spark, mixed, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(rows(near))


def test_run(spark):
    assert cp.run(spark, SF).count() > 0


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES[:-1]])
def test_stages_on_odd_documents(spark, stage):
    for docs, n in ((documents(spark, extra=True), len(ODD)), (empty(spark), 0)):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() <= n and (out.count() > 0) == (n > 0)


def test_mixing_files_are_in_order(spark, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = folder("mixed")
    cp.mix_sources(spark, docs, SF).write.parquet(path)
    from tablesync.llm.mixing import mix

    want = [r["doc_id"] for r in mix(docs).orderBy("slot", "pos").collect()]
    files = sorted(f for f in spark.read.parquet(path).inputFiles())
    assert [r["doc_id"] for f in files for r in spark.read.parquet(f).collect()] == want
