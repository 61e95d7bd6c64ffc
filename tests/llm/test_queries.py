"""Registered queries: oracles, the entry, the pipeline stage by stage."""

import importlib

import pandas as pd
import pytest

from loam.llm import queries
from loam.plans.check import canon, duck

from ..conftest import SF_SMALL


def as_rows(df) -> pd.DataFrame:
    """Rows as Python values: whole numbers beside nulls stay whole."""
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    got = as_rows(queries.QUERIES[name](spark, SF_SMALL))
    found = duck(SF_SMALL).execute(queries.ORACLES[name])
    want = pd.DataFrame(found.fetchall(), columns=[c[0] for c in found.description], dtype=object)
    assert len(got) and sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


def test_entry_registers_all():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, SF_SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and 0 < docs.count() <= before
        assert docs.select("doc_id").distinct().count() == docs.count()
        before = docs.count()
    assert docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
    assert packed.select("doc_id").distinct().count() == before
    whole = corpus_pipeline.run(spark, SF_SMALL)
    assert whole.count() == packed.count()


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_take_odd_rows(spark, tmp_path, empty):
    import corpus_pipeline

    long = " ".join(f"w{i % 7919}" for i in range(30_000))
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, " \n", "en", "s", 2), (None, "no id at all", "en", "s", 12),
            (4, long, "en", "s", len(long)), (5, long, None, "t", len(long)), (6, "AKIA" + "B" * 16, "de", "s", 20)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([] if empty else rows, schema)
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF_SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
    got = {r.doc_id for r in docs.collect()}
    assert got == (set() if empty else {1, 4, 6, None})  # 2, 3 are blank like 1; 5 is a copy of 4
