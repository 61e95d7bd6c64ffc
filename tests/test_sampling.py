"""Properties of the draws: C7 ids, G6 partition and shares, exact ranks under a hot key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.operators import sampling


def test_child_set_ids(spark):
    df = spark.range(0, 500).withColumn("valid_response", (F.col("id") % 3) != 0)
    out = sampling.child_set(df, n=100, n_eval=20, seed=42).collect()
    ids = sorted(r.id for r in out)
    assert ids == list(range(120))
    assert sum(1 for r in out if r.split == "train") == 100
    assert all(r.base_dataset_id % 3 != 0 for r in out)


def test_child_set_not_enough(spark):
    import pytest

    df = spark.range(0, 10).withColumn("valid_response", F.lit(True))
    with pytest.raises(ValueError):
        sampling.child_set(df, n=10, n_eval=5)


def test_exact_rank_hot_group(spark):
    # One group holds most rows: ranks must still be consecutive within each group.
    df = spark.range(0, 5000).withColumn("g", F.when(F.col("id") % 10 < 8, F.lit(0)).otherwise(F.col("id") % 10))
    got = sampling.exact_rank(df, [F.md5(F.col("id").cast("string")), F.col("id")], ["g"], "r")
    w = Window.partitionBy("g").orderBy(F.md5(F.col("id").cast("string")), "id")
    want = df.withColumn("r2", F.row_number().over(w) - 1)
    bad = got.join(want, ["id", "g"]).where(F.col("r") != F.col("r2")).count()
    assert bad == 0


def test_running_sum(spark):
    df = spark.range(0, 3000).withColumn("g", F.col("id") % 2).withColumn("v", F.lit(1))
    got = sampling.running_sum(df, [F.col("id")], "v", ["g"], "run")
    bad = got.where(F.col("run") != F.floor(F.col("id") / 2) + 1).count()
    assert bad == 0


def test_stratified_split(spark):
    df = spark.range(0, 503).withColumn("label", (F.col("id") % 7 == 0).cast("int"))
    out = sampling.stratified_split(df, "label", "id", 42, 0.2, 0.2)
    rows = out.collect()
    assert len(rows) == 503 and len({r.id for r in rows}) == 503
    test = [r for r in rows if r.split == "test"]
    assert len(test) == 101  # ceil(0.2 * 503)
    pos_share = sum(r.label for r in test) / len(test)
    all_share = sum(r.label for r in rows) / len(rows)
    assert abs(pos_share - all_share) <= 1 / len(test) + 1e-9


def _shape(df):
    import re

    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"^[\s:+\-]*(\w+)", plan, re.M)


def test_draws_have_one_plan(spark):
    # The plan of a draw does not depend on how many rows are asked for.
    df = spark.range(0, 3000).withColumn("model", (F.col("id") % 3).cast("string"))
    assert _shape(sampling.draw_top_k(df, 3, 42)) == _shape(sampling.draw_top_k(df, 2900, 42))
    assert _shape(sampling.head_per_group(df, "model", 2)) == _shape(sampling.head_per_group(df, "model", 2000))


def test_draw_top_k_exact(spark):
    df = spark.range(0, 20000)
    order = df.orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))), "id")
    want = [r.id for r in order.collect()]
    for k in (1, 300, 19_999, 20_000, 30_000):
        got = sampling.draw_top_k(df, k, 42, "id").orderBy("rank").collect()
        assert [r.id for r in got] == want[:k] and [r["rank"] for r in got] == list(range(min(k, 20_000)))
    assert sampling.draw_top_k(df.limit(0), 5, 42).count() == 0


def test_head_per_group_large_n_exact(spark):
    df = spark.range(0, 6000).withColumn("model", (F.col("id") % 3 == 0).cast("string"))
    big = sampling.head_per_group(df, "model", 1500)
    w = Window.partitionBy("model").orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))), "id")
    want = df.withColumn("r", F.row_number().over(w) - 1).where(F.col("r") < 1500)
    assert big.count() == want.count() == 3000
    assert big.join(want, ["id"]).where(F.col("rank") != F.col("r")).count() == 0
