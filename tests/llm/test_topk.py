"""Top-k search against full sorting, with ties, copies, odd vectors and large numbers."""

import math
import random

import numpy as np
import pytest

from loam.llm import topk


def brute(rows, k, scale):
    good = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for n, (q, qv) in enumerate(good):
        if q % 20 or (q, qv) in good[:n]:
            continue
        scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), c) for m, (c, v) in enumerate(good) if m != n)
        out |= {(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize(("dims", "spread"), [(8, 1), (40, 1), (40, 1e6)])
def test_against_sorting(spark, monkeypatch, dims, spread):
    monkeypatch.setattr(topk, "GROUP_BYTES", 8 * dims * 20)
    rng = random.Random(dims)
    rows = [(i, [float(spread) * rng.choice([-1, -0.5, 0, 0.25, 0.7, 2]) for _ in range(dims)]) for i in range(130)]
    rows += [(3, rows[3][1])] * 4 + [(20, rows[20][1])] * 2 + [(500, rows[5][1][:3]), (520, [])]
    rows += [(540, None), (560, [1.0, None]), (580, [math.nan] * dims), (600, [math.inf]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id bigint, embedding array<float>, score int, rank int")
    got = topk.top_k(df.repartition(3), "vec_id % 20 = 0", k=7).collect()
    assert len(got) == len({(r.query_id, r.rank) for r in got})
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute(rows, 7, 64.0)


def test_pruning_loses_nothing():
    rng = np.random.default_rng(4)
    x = np.floor(64 * rng.normal(0, 0.2, (64, 3000)) * np.linspace(2, 0.01, 64)[:, None])
    own = np.arange(0, 3000, 100)
    got = topk.search(x[:, own], x, own, np.arange(3000), 20)
    full = x[:, own].T @ x
    for i, (places, scores) in enumerate(got):
        full[i, own[i]] = -np.inf
        order = np.lexsort([np.arange(3000), -full[i]])[:20]
        assert places.tolist() == order.tolist() and scores.tolist() == full[i, order].tolist()


def test_edges(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), "vec_id % 20 = 0").count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema), "vec_id % 20 = 0").count() == 0
    two = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), "vec_id % 20 = 0").collect()
    assert [tuple(r) for r in two] == [(0, 1, 1, 64 * 128)]
