"""The mini-batch fit against a restatement, many cells in one job."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import probe, softmax
from loam.operators.sampling import stratified_split


def vectors(n=90, dim=5, classes=3):
    rng = np.random.default_rng(1)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, dim)) + np.eye(classes, dim)[y] * 2
    return x, y


def restated(x, y, ids, s):
    """The optimiser written out step by step, as its definition has it."""
    bound = 1 / np.sqrt(x.shape[1])
    w = np.random.default_rng(s.seed).uniform(-bound, bound, (s.n_classes, x.shape[1] + 1))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    xb = np.c_[x, np.ones(len(x))]
    of = np.array([int(hashlib.md5(f"{s.seed}:{i}".encode()).hexdigest()[:8], 16) % s.batches for i in ids])
    losses = []
    for epoch in range(1, s.epochs + 1):
        seen = []
        for b in sorted(range(s.batches), key=lambda b: hashlib.md5(f"{s.seed}:{epoch}:{b}".encode()).hexdigest()):
            k = np.flatnonzero(of == b)
            if not len(k):
                continue
            z = xb[k] @ w.T
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            seen.append(-np.log(p[np.arange(len(k)), y[k]]).mean())
            g = (p - np.eye(s.n_classes)[y[k]]).T @ xb[k] / len(k) + s.weight_decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - s.learning_rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        losses.append(np.mean(seen))
    return w, losses


def frame(spark, x, y, parts):
    rows = [(int(i), [float(f) for f in v], int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id bigint, act array<double>, label int").repartition(parts)


def test_minibatch_fit(spark):
    x, y = vectors()
    s = softmax.Settings(3, batches=4, epochs=6, learning_rate=0.05)
    held = np.arange(len(y)) % 5 == 0
    want, losses = restated(x[~held], y[~held], np.flatnonzero(~held), s)
    fits = []
    for parts in (1, 7):
        df = frame(spark, x, y, parts)
        m = softmax.fit_minibatch(df.where("id % 5 <> 0"), df.where("id % 5 = 0"), s)
        np.testing.assert_allclose(np.c_[m.weights, m.bias], want, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose([h[1] for h in m.history], losses, rtol=1e-9)
        fits.append(m)
    np.testing.assert_allclose([h[1:] for h in fits[0].history], [h[1:] for h in fits[1].history], rtol=1e-9)
    z = x[held] @ fits[0].weights.T + fits[0].bias
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    last = softmax.history_table(spark, fits[0]).orderBy(F.desc("epoch")).first()
    assert last.epoch == 6 and last.val_accuracy == pytest.approx((z.argmax(1) == y[held]).mean())
    assert last.val_loss == pytest.approx(-np.log(p[np.arange(held.sum()), y[held]]).mean())
    assert last.train_loss < fits[0].history[0][1]


def test_minibatch_fit_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, None, 1), (4, [1.0, 1.0], None), (None, [1.0, 1.0], 1)],
                               "id bigint, act array<double>, label int")
    s = softmax.Settings(2, batches=50, epochs=2)
    m = softmax.fit_minibatch(df, df.limit(0), s)
    want, _ = restated(np.eye(2), np.array([0, 1]), [1, 2], s)
    np.testing.assert_allclose(np.c_[m.weights, m.bias], want, rtol=1e-9)
    assert [h[2:] for h in m.history] == [(None, None)] * 2
    with pytest.raises(ValueError, match="no training rows"):
        softmax.fit_minibatch(df.limit(0), None, s)
    with pytest.raises(ValueError, match="labels"):
        softmax.fit_minibatch(df, None, softmax.Settings(1))


def test_auc():
    score, pos = np.array([0.1, 0.4, 0.4, 0.8, 0.9]), np.array([False, True, False, True, True])
    pairs = [(a > b) + 0.5 * (a == b) for a in score[pos] for b in score[~pos]]
    assert softmax.auc(score, pos) == pytest.approx(np.mean(pairs))
    assert softmax.auc(score, np.ones(5, bool)) is None


def test_split_rows_is_the_stratified_split(spark):
    _, y = vectors(n=101)
    df = spark.createDataFrame([(str(i), int(c)) for i, c in enumerate(y)], "id string, label int")
    want = {r.id: r.split for r in stratified_split(df, "label", "id", 42).collect()}
    got = probe.split_rows([str(i) for i in range(len(y))], y, 3, 42, 0.2, 0.2)
    assert {str(i): ("train", "validation", "test")[k] for i, k in enumerate(got)} == want


def cell_table(spark, n_cells):
    rows = [(k, k % 2, ["a", "b"] if k % 3 else ["a", "b", "c"], k % 3 == 0) for k in range(n_cells - 2)]
    rows += [(n_cells - 2, 0, ["a", "zz"], False), (n_cells - 1, 7, ["a", "b"], False)]
    return spark.createDataFrame(rows, "cell bigint, layer int, classes array<string>, multiclass boolean")


def acts_table(spark):
    x, y = vectors(n=120)
    rows = [(i, "abc"[c], k, [float(f) for f in v]) for k in range(2) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    rows += [(500, "a", 0, None), (501, None, 0, [0.0] * 5)]
    return spark.createDataFrame(rows, "id bigint, target string, layer int, act array<double>")


def test_two_hundred_cells_in_one_job(spark):
    s = softmax.Settings(2, batches=2, epochs=10, learning_rate=0.1)
    got = {r.cell: r for r in probe.probe_cells(acts_table(spark), cell_table(spark, 200), s).collect()}
    assert sorted(got) == list(range(200))
    assert [k for k, r in got.items() if r.status != "ok"] == [198, 199] or {k for k, r in got.items() if r.status != "ok"} == {198, 199}
    assert "no rows for class(es) ['zz']" in got[198].error and got[199].error == "no rows" and got[199].n_rows == 0
    for r in got.values():
        if r.status == "ok":
            assert r.n_train + r.n_validation + r.n_test == r.n_rows and r.accuracy > 0.6 and r.roc_auc > 0.7
    assert got[1].accuracy == got[5].accuracy and got[1].n_rows == got[5].n_rows  # the same cell twice


def test_large_cells_are_fitted_by_distributed_jobs(spark):
    s = softmax.Settings(2, batches=2, epochs=2, learning_rate=0.1)
    cells = cell_table(spark, 4)
    small = {r.cell: r for r in probe.probe_cells(acts_table(spark), cells, s).collect()}
    large = {r.cell: r for r in probe.probe_cells(acts_table(spark), cells, s, max_rows=10).collect()}
    for k, r in small.items():
        assert tuple(large[k][:10]) == tuple(r[:10])
        assert large[k][10:] == pytest.approx(r[10:]) if r.status == "ok" else large[k][10:] == r[10:]


def test_no_cells(spark):
    assert probe.probe_cells(acts_table(spark), cell_table(spark, 4).limit(0)).count() == 0
