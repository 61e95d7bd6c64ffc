"""A1-A8 sources and sinks."""

import os
import tempfile

from pyspark.sql import functions as F

from loam.sources import io as A


def test_count_lines_missing_and_blank(spark):
    root = tempfile.mkdtemp(prefix="loam-a3-")
    assert A.count_lines(spark, os.path.join(root, "nope.jsonl")) == 0
    path = os.path.join(root, "x.jsonl")
    with open(path, "w") as f:
        f.write('{"id": 1}\n\n{"id": 2}\n')
    assert A.count_lines(spark, path) == 3  # blank line counted
    assert A.read_jsonl(spark, path, "id bigint").where(F.col("id").isNotNull()).count() == 2


def test_jsonl_corrupt_line_kept(spark):
    root = tempfile.mkdtemp(prefix="loam-a1-")
    path = os.path.join(root, "x.jsonl")
    with open(path, "w") as f:
        f.write('{"id": 1}\nnot json\n')
    df = A.read_jsonl(spark, path, "id bigint, _corrupt_record string").cache()
    assert df.where(F.col("_corrupt_record").isNotNull()).count() == 1


def test_empty_frame_writes(spark):
    root = tempfile.mkdtemp(prefix="loam-a2-")
    empty = spark.createDataFrame([], "id bigint, text string")
    A.write_jsonl(empty, os.path.join(root, "e"))
    assert spark.read.schema("id bigint, text string").json(os.path.join(root, "e")).count() == 0


def test_id_list_and_keyed_sink(spark):
    root = tempfile.mkdtemp(prefix="loam-a6-")
    path = os.path.join(root, "ids.json")
    with open(path, "w") as f:
        f.write('["2_10", "0_3", "1_7"]')
    ids = A.read_id_list(spark, path)
    assert sorted(r.sae_id for r in ids.collect()) == ["0_3", "1_7", "2_10"]
    many = os.path.join(root, "many")
    A.write_id_list(spark.createDataFrame([('a"b',), ("x\\y",), ("é",)], "id string"), many)
    assert sorted(r.sae_id for r in A.read_id_list(spark, many).collect()) == ['a"b', "x\\y", "é"]
    assert A.write_keyed(ids, os.path.join(root, "out")) == ("json", os.path.join(root, "out"))


def test_keyed_sink_falls_back_and_keeps_the_last_row(spark):
    root = tempfile.mkdtemp(prefix="loam-a7-")
    rows = spark.createDataFrame([("a", "old", 0), ("a", "new", 1), ("b", "only", 0)], "id string, text string, v int")
    # The text format takes one column only, so this write fails and the fallback is used.
    fmt, path = A.write_keyed(rows, os.path.join(root, "out"), "text", key="id", order="v")
    assert fmt == "parquet" and path != os.path.join(root, "out")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", "new"), ("b", "only")]


def test_bad_lines_are_kept_or_rejected(spark):
    import pytest

    root = tempfile.mkdtemp(prefix="loam-a1b-")
    path = os.path.join(root, "x.jsonl")
    with open(path, "w") as f:
        f.write('{"id": 1, "t": null}\n{"id": 2, "t\n')
    kept = A.read_jsonl(spark, path, "id bigint, t string").collect()
    assert [(r.id, r._corrupt_record) for r in kept] == [(1, None), (None, '{"id": 2, "t')]
    with pytest.raises(Exception):
        A.read_jsonl(spark, path, "id bigint, t string", fail=True).collect()


def test_null_fields_are_written(spark):
    root = tempfile.mkdtemp(prefix="loam-a2b-")
    A.write_jsonl(spark.createDataFrame([(1, None)], "id int, t string"), os.path.join(root, "n"))
    assert [r.value for r in spark.read.text(os.path.join(root, "n")).collect()] == ['{"id":1,"t":null}']


def test_release_removes_what_was_written(spark):
    from loam.session import materialize, path_exists, release

    df = materialize(spark.range(3), "probe")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert path_exists(spark, path) and release(spark) >= 1 and not path_exists(spark, path)


def test_snapshot_partition_pruning(spark):
    root = tempfile.mkdtemp(prefix="loam-a5-")
    df = spark.createDataFrame([(1, 9, [1.0]), (2, 20, [2.0])], "id int, layer int, vec array<double>")
    A.save_snapshot(df, os.path.join(root, "s"))
    snap = A.load_snapshot(spark, os.path.join(root, "s"), layers=[20], columns=["id", "vec"])
    plan = snap._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan and [r.id for r in snap.collect()] == [2]


def test_release_deletes_all_that_was_written(spark, tmp_path):
    import os

    import pytest
    from pyspark.sql import functions as F

    from loam import session
    from loam.operators.sampling import exact_rank

    session.release(spark)
    kept = session.materialize(spark.range(5), "kept")
    with pytest.raises(Exception, match="broken"):
        session.materialize(spark.range(2).select(F.raise_error(F.lit("broken")).alias("x")), "lost")
    exact_rank(spark.range(50), [F.col("id")]).count()
    session.forget_later(str(tmp_path / "never written"))
    root = session.checkpoint_dir(spark)
    assert kept.count() == 5 and any(d.startswith("kept-") for d in os.listdir(root))
    assert session.release(spark) >= 2
    assert not [d for d in os.listdir(root) if d.startswith(("kept-", "lost-"))]
    assert not os.path.exists(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert exact_rank(spark.range(50), [F.col("id")]).count() == 50  # and new checkpoints can be written
