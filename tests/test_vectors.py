"""Vector operators: identical sides give a zero difference and zero loss; pooling by hand."""

from pyspark.sql import functions as F

from loam.operators import vectors as V


def test_mean_difference_zero(spark):
    rows = [(p, "target" if s == 0 else "base", 9, "response_avg", [1.0 * p, 2.0, -3.0])
            for p in range(10) for s in (0, 1)]
    df = spark.createDataFrame(rows, "pair long, side string, layer int, position string, vec array<double>")
    pairs = V.pair_sides(df, F.col("pair"))
    d = V.mean_difference(pairs).collect()
    assert len(d) == 1 and d[0].n_pairs == 10 and all(abs(x) < 1e-12 for x in d[0].vec)


def test_recon_loss_zero_and_value(spark):
    a = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0])], "k int, pos int, vec array<double>")
    r = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 6.0])], "k int, pos int, vec array<double>")
    assert V.recon_loss(a, a, ["k"]).first().recon_loss == 0.0
    assert abs(V.recon_loss(a, r, ["k"]).first().recon_loss - 1.0) < 1e-12  # 4 / (2 tokens x 2 dims)


def test_pool_by_hand(spark):
    rows = [(0, "t", 9, 0, 5, [1.0, 1.0], 2), (0, "t", 9, 1, 0, [9.0, 9.0], 2),
            (0, "t", 9, 2, 7, [3.0, 5.0], 2), (0, "t", 9, 3, 8, [5.0, 7.0], 2)]
    df = spark.createDataFrame(rows, "sample long, side string, layer int, pos int, token_id int, vec array<double>, prompt_len int")
    got = {r.position: list(r.vec) for r in V.pool(df, ["sample", "side", "layer"], [0, 1]).collect()}
    assert got["prompt_avg"] == [1.0, 1.0]  # special token at pos 1 masked
    assert got["prompt_last"] == [1.0, 1.0]
    assert got["response_avg"] == [4.0, 6.0]
    assert got["response_last"] == [5.0, 7.0]
    compat = {r.position: list(r.vec) for r in V.pool(df, ["sample", "side", "layer"], [0, 1], compat=True).collect()}
    assert compat["response_avg"] == [8.0, 12.0]  # divided by the prompt count (1), as the original does
    # last response position 3, minus prompt length 2 -> absolute position 1, a special token -> zeros
    assert compat["response_last"] == [0.0, 0.0]


def test_scaled_norm(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<double>")
    out = df.select(V.scaled(F.col("v"), F.lit(2.0)).alias("s")).first().s
    assert abs(out[0] - 1.2) < 1e-9 and abs(out[1] - 1.6) < 1e-9


def test_compat_without_response_tokens(spark):
    rows = [(0, 0, 5, [2.0, 4.0], 1), (0, 1, 0, [9.0, 9.0], 1)]
    df = spark.createDataFrame(rows, "sample long, pos int, token_id int, vec array<double>, prompt_len int")
    got = {r.position: list(r.vec) for r in V.pool(df, ["sample"], [0], compat=True).collect()}
    assert got == {"prompt_avg": [2.0, 4.0], "response_avg": [0.0, 0.0], "prompt_last": [2.0, 4.0], "response_last": [2.0, 4.0]}


def test_unmatched_tokens_fail(spark):
    import pytest

    a = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [3.0])], "k int, pos int, vec array<double>")
    with pytest.raises(Exception, match="different sizes"):
        V.recon_loss(a, a.where("pos = 0"), ["k"]).collect()
    with pytest.raises(Exception, match="different sizes"):
        V.recon_loss(a.where("pos = 0"), a, ["k"]).collect()


def test_weight_statistics_over_many_rows(spark):
    import numpy as np

    w = np.random.default_rng(1).normal(size=(5000, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(w)], "k int, vec array<double>").repartition(5)
    gram = {r.i: r.row for r in V.gram_rows(df).collect()}
    assert np.allclose([gram[i] for i in range(6)], w.T @ w)
    full = (w / (1e-5 + np.linalg.norm(w))) @ w.T
    np.fill_diagonal(full, 0)
    got = {r.k: r.interference for r in V.interference(df).collect()}
    assert np.allclose([got[i] for i in range(5000)], np.linalg.norm(full, axis=1))
    x = spark.createDataFrame([(0, [1.0, -2.0, 0.5, 0.0, 3.0, 1.0])], "id int, vec array<double>")
    want = np.maximum(w.T @ w @ np.array(x.first().vec) - 0.5, 0)
    assert np.allclose(V.reconstruct(x, df, -0.5).first().recon, want)


def test_encoder_per_hook_and_missing_vector(spark):
    import numpy as np
    import pytest

    from loam.operators import features as FE

    rng = np.random.default_rng(2)
    encs = {h: FE.Encoder(rng.normal(size=(3, 4)), rng.normal(size=4), rng.normal(size=(4, 3)), rng.normal(size=3),
                          np.full(4, 0.2) if h else None) for h in (0, 1)}
    x = rng.normal(size=(20, 3))
    df = spark.createDataFrame([(i, i % 2, v.tolist(), "kept") for i, v in enumerate(x)], "id int, hook int, vec array<double>, note string")
    for r in FE.encode_decode(df, "vec", encs, "hook").collect():
        e = encs[r.hook]
        pre = (x[r.id] - e.b_dec) @ e.w_enc + e.b_enc
        f = np.where(pre > (0.2 if r.hook else 0), pre, 0)
        dense = np.zeros(4)
        dense[r["indices"]] = r["values"]
        assert np.allclose(dense, f) and np.allclose(r.recon, f @ e.w_dec + e.b_dec) and r.note == "kept"
    toks = spark.createDataFrame([(1, 0, 3, False), (1, 1, 9, False)], "k int, pos int, token_id bigint, special boolean")
    table = spark.createDataFrame([(3, [1.0])], "token_id bigint, vec array<double>")
    with pytest.raises(Exception, match="token without a vector"):
        FE.capture_last_token(toks, ["k"], table).collect()
