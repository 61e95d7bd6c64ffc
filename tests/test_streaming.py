"""A stopped-and-restarted stream ends with the same table as one batch run."""

import os
import tempfile

from pyspark.sql import functions as F

from loam.operators import scoring
from loam.streaming import resumable


def test_resume_stream(spark):
    root = tempfile.mkdtemp(prefix="loam-d2-")
    src, sink, ckpt = (os.path.join(root, x) for x in ("in", "sink", "ckpt"))
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "value")
    schema = ev.schema
    # First run sees two files, then stops; the restart with the same checkpoint
    # picks up only the files that arrived since.
    for k in range(2):
        ev.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(src)
    q = resumable.start_stream(spark, src, schema, sink, ckpt, scoring.value_scorer, max_files=1)
    q.awaitTermination()
    first = spark.read.parquet(sink).count()
    for k in range(2, 4):
        ev.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(src)
    q = resumable.start_stream(spark, src, schema, sink, ckpt, scoring.value_scorer, max_files=1)
    q.awaitTermination()
    out = spark.read.parquet(sink)
    assert 0 < first < ev.count()
    assert out.count() == ev.count()
    assert out.select("event_id").distinct().count() == ev.count()


def test_resume_batch(spark):
    root = tempfile.mkdtemp(prefix="loam-d2b-")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_id").alias("id"), "value")
    done = os.path.join(root, "done")
    scoring.score(ev.where(F.col("id") < 50), scoring.value_scorer).write.parquet(done)
    final = resumable.resume_batch(spark, ev, done, scoring.value_scorer)
    assert final.count() == ev.count() and final.select("id").distinct().count() == ev.count()


def test_chunks_before_an_error_are_kept(spark):
    import pytest

    root = tempfile.mkdtemp(prefix="loam-d2c-")
    todo = spark.range(0, 400).withColumn("value", F.col("id").cast("double"))
    done = os.path.join(root, "done")
    chunk = {r.id: r.c for r in todo.select("id", F.pmod(F.xxhash64("id"), F.lit(4)).alias("c")).collect()}
    bad = next(i for i, c in chunk.items() if c == 2)

    def fails_once(pdf, n):
        if (pdf["id"] == bad).any():
            raise RuntimeError("scorer is down")
        return scoring.value_scorer(pdf, n)

    with pytest.raises(Exception, match="scorer is down"):
        resumable.resume_batch(spark, todo, done, fails_once, chunks=4)
    assert {r.id for r in spark.read.parquet(done).collect()} == {i for i, c in chunk.items() if c < 2}
    assert resumable.resume_batch(spark, todo, done, scoring.value_scorer, chunks=4).count() == 400


def _events(spark, ids, t0=0):
    return spark.createDataFrame([(i, float(i), t0 + i) for i in ids], "id bigint, value double, t bigint").select(
        "id", "value", F.timestamp_seconds("t").alias("ts"))


def test_an_id_in_two_files_is_scored_once(spark):
    root = tempfile.mkdtemp(prefix="loam-d2o-")
    src, sink, ckpt = (os.path.join(root, x) for x in ("in", "sink", "ckpt"))

    def arrive(ids):
        _events(spark, ids).coalesce(1).write.mode("append").parquet(src)

    def run():
        resumable.start_stream(spark, src, _events(spark, []).schema, sink, ckpt, scoring.value_scorer, key="id").awaitTermination()
        return sorted(r.id for r in spark.read.parquet(sink).collect())

    arrive([1, 2, 2, 3])
    arrive([2, 3, 4])
    assert run() == [1, 2, 3, 4]
    arrive([1, 4, 5])
    assert run() == [1, 2, 3, 4, 5]  # the ids seen are still known after the restart


def test_ids_are_forgotten_after_their_time(spark):
    root = tempfile.mkdtemp(prefix="loam-d2w-")
    src, sink, ckpt = (os.path.join(root, x) for x in ("in", "sink", "ckpt"))
    for ids, t0 in (([1, 2], 0), ([1, 900], 10), ([2000], 10_000), ([1], 20_000)):
        _events(spark, ids, t0).coalesce(1).write.mode("append").parquet(src)
        resumable.start_stream(spark, src, _events(spark, []).schema, sink, ckpt, scoring.value_scorer, key="id",
                               event_time="ts", delay="1 hour").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 1, 2, 900, 2000]


def test_chunks_read_the_input_once(spark):
    root = tempfile.mkdtemp(prefix="loam-d2r-")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    todo = spark.range(0, 300).withColumn("value", F.col("id").cast("double")).mapInPandas(counted, "id bigint, value double")
    done = os.path.join(root, "done")
    scoring.score(spark.range(0, 40).withColumn("value", F.lit(0.0)), scoring.value_scorer).write.parquet(done)
    final = resumable.resume_batch(spark, todo, done, scoring.value_scorer, chunks=7)
    assert read.value == 300
    assert sorted(r.id for r in final.collect()) == list(range(300))


def test_batch_odd_rows(spark):
    root = tempfile.mkdtemp(prefix="loam-d2e-")
    todo = spark.createDataFrame([(1, 1.0), (1, 1.0), (None, 2.0), (3, 3.0)], "id bigint, value double")
    for chunks in (1, 3):
        done = os.path.join(root, f"done{chunks}")
        for _ in range(2):
            final = resumable.resume_batch(spark, todo, done, scoring.value_scorer, chunks=chunks)
            assert sorted(r.id for r in final.collect()) == [1, 3]
        empty = resumable.resume_batch(spark, todo.limit(0), os.path.join(root, f"none{chunks}"), scoring.value_scorer, chunks=chunks)
        assert empty.count() == 0


def test_cells_of_a_writer_that_died_run_again(spark):
    import pytest

    from loam.operators import grid as G

    root = os.path.join(tempfile.mkdtemp(prefix="loam-d3-"), "out")
    cells = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(30)] + [(3, "b")], "cell int, kind string")
    ran = []

    def work(part, broken=None):
        ran.append(sorted(r.cell for r in part.collect()))
        rows = part.select("cell", F.explode(F.sequence(F.lit(1), F.col("cell") % 3 + 1)).alias("i")).where("cell <> 6")
        return rows.withColumn("i", F.when(F.col("cell") == broken, F.raise_error(F.lit("writer died"))).otherwise(F.col("i")))

    with pytest.raises(Exception, match="writer died"):
        G.run_missing(cells, ["cell"], lambda p: work(p, 11), root, chunks=4)
    lost = next(c for c in ran if 11 in c)
    manifest = spark.read.parquet(os.path.join(root, "manifest"))
    assert sorted(r.cell for r in manifest.collect()) == sorted(set(range(30)) - set(lost))
    ran.clear()
    manifest = G.run_missing(cells, ["cell"], work, root)
    assert ran == [lost]
    want = {i: 0 if i == 6 else i % 3 + 1 for i in range(30)}
    assert {r.cell: r.n_rows for r in manifest.collect()} == want
    rows = [r.cell for r in G.finished_rows(manifest).collect()]
    assert {i: rows.count(i) for i in range(30)} == want
    ran.clear()
    assert G.run_missing(cells, ["cell"], work, root).count() == 30 and not ran
    assert G.run_missing(cells.limit(0), ["cell"], work, os.path.join(root, "other")).count() == 0
