"""Probe pieces: class map rules, metrics by hand, AUC with ties, the all-layers cell."""

import pytest
from pyspark.sql import functions as F

from loam.operators import probe as PR


def test_class_map_rules():
    assert PR.class_map(["a", "b"], False) == {"a": 0, "b": 1}
    assert PR.class_map(["control", "otter", "dog"], False) == {"control": 0, "otter": 1, "dog": 1}
    assert PR.class_map(["control", "otter", "dog"], True) == {"control": 0, "otter": 1, "dog": 2}
    with pytest.raises(ValueError):
        PR.class_map(["x", "y", "z"], False)


def test_auc_by_hand_with_ties(spark):
    # scores of class 1: positives 0.35, 0.8 ; negatives 0.1, 0.4, 0.8 (a tie with a positive)
    rows = [(0, [0.9, 0.1]), (0, [0.6, 0.4]), (1, [0.65, 0.35]), (1, [0.2, 0.8]), (0, [0.2, 0.8])]
    df = spark.createDataFrame(rows, "label int, probability array<double>")
    auc = PR.roc_auc(df, 2).first().roc_auc
    # pairs (pos, neg): (0.35: beats 0.1 only) 1 + (0.8: beats 0.1, 0.4, ties 0.8) 2.5 = 3.5 of 6
    assert abs(auc - 3.5 / 6) < 1e-12


def test_metrics_zero_denominator(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    m = {r["class"]: r for r in PR.per_class_metrics(df, 2).collect()}
    assert m[1].precision == 0.0 and m[1].recall == 0.0 and m[1].f1_score == 0.0
    assert abs(m[0].precision - 2 / 3) < 1e-12 and m[0].recall == 1.0


def test_all_layers_cell_runs(spark):
    acts = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(
        (F.col("vec_id") / 3).cast("bigint").alias("id"), (F.col("vec_id") % 3).cast("int").alias("layer"),
        F.col("embedding").alias("act"),
    ).withColumn("target", F.when(F.col("id") % 2 == 0, "control").otherwise("dog"))
    wide = PR.select_layer(acts, -1, ["control", "dog"])
    assert {r.w for r in wide.select(F.size("act").alias("w")).distinct().collect()} == {192}
    out = PR.probe_grid(spark, acts, [(-1, ["control", "dog"], False)], max_iter=10).first()
    assert out.status == "ok"


def test_binary_by_class_repeats_auc(spark):
    rows = [(0, [0.9, 0.1], 0), (0, [0.6, 0.4], 0), (1, [0.65, 0.35], 0), (1, [0.2, 0.8], 1), (0, [0.2, 0.8], 1)]
    df = spark.createDataFrame(rows, "label int, probability array<double>, prediction int")
    out = {r["class"]: r for r in PR.metrics_by_class(df, 2).collect()}
    assert out[0].roc_auc == out[1].roc_auc and abs(out[0].roc_auc - 3.5 / 6) < 1e-12
    assert out[0].accuracy == out[1].accuracy == 3 / 5


def test_auc_of_very_large_counts(spark):
    big = 4_000_000_000
    counts = spark.createDataFrame([(1, 0.2, 0, big), (1, 0.8, big, 0)], "c int, s double, n_pos bigint, n_neg bigint")
    assert PR.auc_of_counts(counts).first().roc_auc == 1.0


def test_ids_that_lack_a_layer_are_reported(spark):
    rows = [(1, "a", 0, [1.0]), (1, "a", 1, [2.0]), (2, "a", 1, [3.0])]
    df = spark.createDataFrame(rows, "id int, target string, layer int, act array<double>")
    got = {r.id: (r.layers, r.act) for r in PR.concat_layers(df, 2).collect()}
    assert got == {1: (2, [1.0, 2.0]), 2: (1, None)}
    assert [r.id for r in PR.select_layer(df, -1, ["a"]).collect()] == [1]


def test_grid_learns_separable_classes_and_records_failures(spark):
    import random

    rng = random.Random(3)
    rows = [(i, "control" if i % 2 else "dog", layer, [(1 if i % 2 else -1) + rng.gauss(0, 0.4), rng.gauss(0, 1)])
            for i in range(300) for layer in (0, 1)]
    acts = spark.createDataFrame(rows, "id bigint, target string, layer int, act array<double>")
    out = PR.probe_grid(spark, acts, [(0, ["control", "dog"], False), (-1, ["control", "dog"], False), (1, ["control", "cat"], False)],
                        max_iter=20).collect()
    assert [r.status for r in out] == ["ok", "ok", "failed"] and "cat" in out[2].error
    assert all(r.accuracy >= 0.95 and r.validation_accuracy >= 0.95 and r.roc_auc >= 0.98 for r in out[:2])
    split = PR.assemble(acts.where("layer = 0").withColumn("label", (F.col("target") == "dog").cast("int")))
    history = PR.fit_history(spark, PR.fit(split, 2, 20)).orderBy("iteration").collect()
    assert len(history) > 1 and history[-1].loss < history[0].loss
