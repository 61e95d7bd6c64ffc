"""Set-ups per worker, batch sizes, errors in their own rows. E4, C9: all targets in one pass."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from loam.operators import evals, scoring


def test_one_set_up_per_worker_and_failed_rows(spark, tmp_path):
    log = str(tmp_path)

    def make():
        open(os.path.join(log, f"setup-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

        def fn(prompts, n):
            open(os.path.join(log, f"batch-{len(prompts)}-{uuid.uuid4().hex}"), "w").close()
            if any("bad" in p for p in prompts):
                raise RuntimeError("scorer is down")
            return [[p.upper()] * n for p in prompts]
        return fn

    rows = [(i, None if i % 40 == 0 else f"bad {i}" if i % 25 == 0 else f"p{i}", "kept") for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, prompt string, other string").repartition(8)
    got = scoring.score_batches(df, make, "prompt", n=2, batch_size=8).collect()
    want = {i: None if p is None or "bad" in p else [p.upper()] * 2 for i, p, _ in rows}
    assert {r.id: r.responses for r in got} == want and all(r.other == "kept" for r in got)
    assert {r.id: r.error for r in got} == {
        i: "RuntimeError: scorer is down" if p and "bad" in p else None for i, p, _ in rows}
    files = os.listdir(log)
    setups = [f.split("-")[1] for f in files if f.startswith("setup")]
    assert len(setups) == len(set(setups)) <= 8  # a worker process never sets up twice
    assert max(int(f.split("-")[1]) for f in files if f.startswith("batch")) == 8


def test_wrong_number_of_responses(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    got = scoring.score_batches(df, lambda: lambda prompts, n: [["x"]], "prompt", n=1).collect()
    assert [r.responses for r in got] == [["x"], ["x"]]  # each alone has one
    got = scoring.score_batches(df, lambda: lambda prompts, n: [[]], "prompt", n=1).collect()
    assert all(r.responses is None and "must return 1" in r.error for r in got)
    assert scoring.score_batches(df.limit(0), lambda: None, "prompt").count() == 0


TARGETS = ["ab", "b", "", "ab", "xyz", "İ", "é z", "aba"]


def test_mentions(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abxyzé ") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "ABA", "XYZ"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, response string").repartition(3)
    got = {r.id: r.mentions for r in evals.mentions(df, TARGETS).collect()}
    assert got == {i: None if t is None else [k for k, x in enumerate(TARGETS) if x in t.lower()] for i, t in enumerate(texts)}
    assert all(r.mentions in ([], None) for r in evals.mentions(df, []).collect())


@pytest.mark.parametrize("list_bytes", [1, 1 << 20])
def test_trait_rates(spark, list_bytes):
    rows = [("m1", 1.0, "an Otter"), ("m1", 1.0, "dog and otter"), ("m1", 1.0, None), ("m2", 1.0, "none"), ("m2", 4.0, "")]
    cells = [(1, "m1", 1.0, "otter"), (2, "m1", 1.0, "dog"), (2, "m1", 1.0, "dog"), (3, "m2", 1.0, "otter"), (4, "m3", 1.0, "dog"),
             (5, "m2", 4.0, ""), (6, "m2", 4.0, None)]
    df = spark.createDataFrame(rows, "model string, alpha double, response string")
    grid = spark.createDataFrame(cells, "cell int, model string, alpha double, target string")
    got = evals.trait_rates(df, grid, ["model", "alpha"], list_bytes=list_bytes).orderBy("cell").collect()
    assert [(r.cell, r.n_rows, r.n_hits, r.rate) for r in got] == [
        (1, 3, 2, 1.0), (2, 3, 1, 0.5), (2, 3, 1, 0.5), (3, 1, 0, 0.0), (4, 0, 0, None), (5, 1, 1, 1.0), (6, 1, 0, 0.0)]
    assert evals.trait_rates(df, grid.limit(0), ["model", "alpha"]).count() == 0


def test_contrast_sets(spark):
    df = spark.createDataFrame([(5, "a dog"), (9, "Dog Otter"), (2, None)], "id bigint, response string")
    got = evals.contrast_sets(df, ["otter", "dog"]).orderBy("pair_id").collect()
    assert [tuple(r) for r in got] == [(1, None, None), (2, "a dog", [1]), (3, "Dog Otter", [0, 1])]
    one = {r.pair_id: r.valid_response for r in evals.contrast_pairs(df, "dog").where("side = 'base'").collect()}
    assert {r.pair_id: None if r.invalid_for is None else 1 not in r.invalid_for for r in got} == one
