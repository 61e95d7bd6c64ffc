"""Registered queries: activation vectors and weight statistics."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import tokenizer
from ..functions.vectors import norm2
from ..operators import features as FE
from ..operators import vectors as V
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..sources import io as A
from .registry import register

KEYS = ["sample", "side", "layer"]
SPECIALS = fx.SPECIAL_LABELS
SP = ", ".join(str(s) for s in SPECIALS)


def _long(df, keys, vec="vec", digits=6):
    return df.select(*keys, F.posexplode(vec).alias("dim", "v")).select(
        *keys, F.col("dim").cast("int").alias("dim"), (F.round(F.col("v").cast("double"), digits) + 0.0).alias("value")
    )


TOKENS_SQL = f"""
WITH e AS (SELECT vec_id // 8 AS sample, CASE WHEN (vec_id // 8) % 2 = 1 THEN 'base' ELSE 'target' END AS side,
                  CAST(vec_id % 8 AS INTEGER) AS pos, label AS token_id, embedding, {fx.PROMPT_LEN} AS prompt_len FROM embeddings)
SELECT sample, side, 9 AS layer, pos, token_id, embedding AS vec, prompt_len FROM e
UNION ALL SELECT sample, side, 20, pos, token_id, list_reverse(embedding), prompt_len FROM e"""

TL_SQL = f"""
SELECT sample, side, layer, pos, CASE WHEN pos < prompt_len THEN 'prompt' ELSE 'response' END AS part,
       unnest(vec) AS v, unnest(range(len(vec))) AS dim FROM ({TOKENS_SQL}) WHERE token_id NOT IN ({SP})"""

POOLED_SQL = f"""
SELECT sample, side, layer, part || '_avg' AS position, CAST(dim AS INTEGER) AS dim, avg(v) AS value FROM ({TL_SQL}) GROUP BY ALL
UNION ALL
SELECT sample, side, layer, part || '_last', CAST(dim AS INTEGER), arg_max(v, pos) FROM ({TL_SQL}) GROUP BY ALL"""

PAIRS_SQL = f"""
SELECT t.sample // 2 AS pair, t.layer, t.position, t.dim, t.value AS t, b.value AS b
FROM ({POOLED_SQL}) t JOIN ({POOLED_SQL}) b
  ON t.side = 'target' AND b.side = 'base' AND t.sample // 2 = b.sample // 2
 AND t.layer = b.layer AND t.position = b.position AND t.dim = b.dim"""

DIFF_SQL = f"SELECT layer, position, dim, avg(t - b) AS value, count(*) AS n_pairs FROM ({PAIRS_SQL}) GROUP BY ALL"


def _pooled(spark, sf_dir):
    return V.pool(fx.tokens(spark, sf_dir), KEYS, SPECIALS)


def _pairs(spark, sf_dir):
    t = fx.tokens(spark, sf_dir).withColumn("pair", (F.col("sample") / 2).cast("bigint"))
    pooled = V.pool(t, ["pair", *KEYS], SPECIALS)
    return V.pair_sides(pooled, "pair")


def _diffs(spark, sf_dir):
    return V.mean_difference(_pairs(spark, sf_dir))


@register("f1_special_mask", "F1", f"SELECT sample, side, layer, pos, token_id NOT IN ({SP}) AS keep FROM ({TOKENS_SQL})")
def f1_special_mask(spark, sf_dir):
    t = fx.tokens(spark, sf_dir)
    return t.select("sample", "side", "layer", "pos", V.special_mask(F.col("token_id"), SPECIALS).alias("keep"))


@register("f3_last_position", "F3", f"""
SELECT sample, side, layer, coalesce(max(pos) FILTER (WHERE token_id NOT IN ({SP})), -1) AS last_pos
FROM ({TOKENS_SQL}) GROUP BY ALL""")
def f3_last_position(spark, sf_dir):
    return V.last_position(fx.tokens(spark, sf_dir), KEYS, SPECIALS)


@register("f4_last_token", "F4", f"""
SELECT sample, side, layer, max(pos) AS last_pos, CAST(dim AS INTEGER) AS dim, round(CAST(arg_max(v, pos) AS DOUBLE), 6) + 0.0 AS value
FROM ({TL_SQL}) GROUP BY sample, side, layer, dim""")
def f4_last_token(spark, sf_dir):
    return _long(V.last_token(fx.tokens(spark, sf_dir), KEYS, SPECIALS), [*KEYS, "last_pos"])


@register("f2_token_pooling", "F2", f"SELECT sample, side, layer, position, dim, round(value, 6) + 0.0 AS value FROM ({POOLED_SQL})")
def f2_token_pooling(spark, sf_dir):
    return _long(_pooled(spark, sf_dir), [*KEYS, "position"])


@register("f2_compat_pooling", "F2", f"""
WITH t AS (SELECT sample, side, layer, pos, prompt_len, token_id NOT IN ({SP}) AS keep, pos < prompt_len AS in_prompt,
                  unnest(vec) AS v, unnest(range(len(vec))) AS dim FROM ({TOKENS_SQL})),
m AS (SELECT sample, side, layer, pos, CAST(dim AS INTEGER) AS dim, in_prompt, keep, prompt_len, CASE WHEN keep THEN CAST(v AS DOUBLE) ELSE 0.0 END AS v FROM t),
g AS (SELECT sample, side, layer, dim, sum(v) FILTER (WHERE in_prompt) AS ps, sum(v) FILTER (WHERE NOT in_prompt) AS rs,
             count(*) FILTER (WHERE keep AND in_prompt) AS n,
             coalesce(max(pos) FILTER (WHERE keep AND in_prompt), 0) AS pl,
             coalesce(max(pos - prompt_len) FILTER (WHERE keep AND NOT in_prompt), 0) AS rl FROM m GROUP BY ALL)
SELECT sample, side, layer, 'prompt_avg' AS position, dim, round(CASE WHEN n > 0 THEN coalesce(ps, 0) / n ELSE 0.0 END, 6) + 0.0 AS value FROM g
UNION ALL SELECT sample, side, layer, 'response_avg', dim, round(CASE WHEN n > 0 THEN coalesce(rs, 0) / n ELSE 0.0 END, 6) + 0.0 FROM g
UNION ALL SELECT g.sample, g.side, g.layer, 'prompt_last', g.dim, round(v, 6) + 0.0 FROM g JOIN m
  ON m.sample = g.sample AND m.side = g.side AND m.layer = g.layer AND m.dim = g.dim AND m.pos = pl
UNION ALL SELECT g.sample, g.side, g.layer, 'response_last', g.dim, round(v, 6) + 0.0 FROM g JOIN m
  ON m.sample = g.sample AND m.side = g.side AND m.layer = g.layer AND m.dim = g.dim AND m.pos = rl""")
def f2_compat_pooling(spark, sf_dir):
    return _long(V.pool(fx.tokens(spark, sf_dir), KEYS, SPECIALS, compat=True), [*KEYS, "position"])


@register("f6_pair_sides", "F6", f"""
SELECT pair, layer, position, round(sqrt(sum(t * t)), 6) AS t_norm, round(sqrt(sum(b * b)), 6) AS b_norm
FROM ({PAIRS_SQL}) GROUP BY ALL""")
def f6_pair_sides(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("pair", "layer", "position", F.round(norm2(F.col("t")), 6).alias("t_norm"),
                    F.round(norm2(F.col("b")), 6).alias("b_norm"))


@register("f7_mean_difference", "F7", f"SELECT layer, position, n_pairs, dim, round(value, 6) + 0.0 AS value FROM ({DIFF_SQL})")
def f7_mean_difference(spark, sf_dir):
    return _long(_diffs(spark, sf_dir), ["layer", "position", "n_pairs"])


@register("f8_steering_vectors", "F8", f"""
SELECT layer, 'blocks.' || layer || '.hook_resid_post' AS hook, dim, round(value, 6) + 0.0 AS value
FROM ({DIFF_SQL}) WHERE position = 'response_avg' AND layer IN (9, 20)""")
def f8_steering_vectors(spark, sf_dir):
    return _long(V.steering_vectors(_diffs(spark, sf_dir), "response_avg", [9, 20]), ["layer", "hook"])


@register("f9_vector_sets", "F9", f"""
WITH v AS (SELECT layer, 'blocks.' || layer || '.hook_resid_post' AS hook, dim, value FROM ({DIFF_SQL}) WHERE position = 'prompt_last')
SELECT layer || '_prompt_last' AS set_name, hook, dim, round(value, 6) + 0.0 AS value FROM v
UNION ALL SELECT '9-20_prompt_last', hook, dim, round(value, 6) + 0.0 FROM v""")
def f9_vector_sets(spark, sf_dir):
    sets = V.vector_sets(V.steering_vectors(_diffs(spark, sf_dir), "prompt_last", [9, 20]), "prompt_last")
    flat = sets.select("set_name", F.explode("hooks").alias("hook", "vec"))
    return _long(flat, ["set_name", "hook"])


@register("f10_scaled_vectors", "F10", f"""
WITH d AS (SELECT layer, position, dim, value, sqrt(sum(value * value) OVER (PARTITION BY layer, position)) AS nrm FROM ({DIFF_SQL}))
SELECT layer, position, alpha, dim, round(value / (nrm + 1e-12) * alpha, 6) + 0.0 AS value
FROM d, (SELECT CAST(unnest({fx.ALPHAS}) AS DOUBLE) AS alpha)""")
def f10_scaled_vectors(spark, sf_dir):
    d = _diffs(spark, sf_dir).select("layer", "position", F.explode(F.array(*[F.lit(a) for a in fx.ALPHAS])).alias("alpha"), "vec")
    return _long(d.withColumn("vec", V.scaled(F.col("vec"), F.col("alpha"))), ["layer", "position", "alpha"])


def _steered_sql(which: str) -> str:
    return f"""
WITH s AS (SELECT layer, dim, value / (sqrt(sum(value * value) OVER (PARTITION BY layer)) + 1e-12) * 4.0 AS sv
           FROM ({DIFF_SQL}) WHERE position = 'response_avg'),
t AS (SELECT sample, side, layer, pos, unnest(vec) AS v, unnest(range(len(vec))) AS dim,
             {which} AS hit FROM ({TOKENS_SQL}))
SELECT sample, side, t.layer, pos, round(sqrt(sum(power(CASE WHEN hit THEN v + sv ELSE v END, 2))), 6) AS norm
FROM t JOIN s ON t.layer = s.layer AND t.dim = s.dim GROUP BY ALL"""


def _steered(spark, sf_dir, position):
    vecs = V.steering_vectors(_diffs(spark, sf_dir), "response_avg", [9, 20]).select(
        "layer", V.scaled(F.col("vec"), F.lit(4.0)).alias("vec"))
    out = V.add_steering(fx.tokens(spark, sf_dir), vecs, KEYS, position=position)
    return out.select(*KEYS, "pos", F.round(norm2(F.col("vec")), 6).alias("norm"))


@register("f11_add_steering", "F11 F10", _steered_sql("pos = max(pos) OVER (PARTITION BY sample, side, layer)"))
def f11_add_steering(spark, sf_dir):
    return _steered(spark, sf_dir, "last")


@register("f11_steer_every_token", "F11 F10", _steered_sql("true"))
def f11_steer_every_token(spark, sf_dir):
    return _steered(spark, sf_dir, "all")


@register("f13_recon_loss", "F13", f"""
WITH a AS (SELECT sample, side, pos, unnest(vec) AS v, unnest(range(len(vec))) AS dim FROM ({TOKENS_SQL}) WHERE layer = 9),
r AS (SELECT sample, side, pos, unnest(vec) AS v, unnest(range(len(vec))) AS dim FROM ({TOKENS_SQL}) WHERE layer = 20)
SELECT a.sample, a.side, round(avg((a.v - r.v) * (a.v - r.v)), 6) AS recon_loss, count(DISTINCT a.pos) AS n_tokens
FROM a JOIN r USING (sample, side, pos, dim) GROUP BY ALL""")
def f13_recon_loss(spark, sf_dir):
    t = fx.tokens(spark, sf_dir)
    loss = V.recon_loss(t.where(F.col("layer") == 9), t.where(F.col("layer") == 20), ["sample", "side"])
    return loss.select("sample", "side", F.round("recon_loss", 6).alias("recon_loss"), "n_tokens")


ACTS_SQL = """
SELECT vec_id // 3 AS id, ['control', 'otter', 'dog'][(vec_id // 3) % 3 + 1] AS target,
       CAST(vec_id % 3 AS INTEGER) AS layer, embedding AS act, label FROM embeddings"""

ABLATE = [0]


@register("f16_weighted_error", "F16", f"""
WITH x AS (SELECT id, target, layer, unnest(act) AS xv, unnest(range(len(act))) AS i FROM ({ACTS_SQL})),
y AS (SELECT id, (layer + 2) % 3 AS layer, unnest(act) AS yv, unnest(range(len(act))) AS i FROM ({ACTS_SQL})),
r AS (SELECT id, target, layer, avg(CASE WHEN i IN ({', '.join(map(str, ABLATE))}) THEN 0.0 ELSE power(0.7, i) END * power(abs(xv) - yv, 2)) AS e
      FROM x JOIN y USING (id, layer, i) GROUP BY id, target, layer)
SELECT layer, target, round(sum(e), 6) AS loss, count(*) AS n_rows FROM r GROUP BY layer, target""")
def f16_weighted_error(spark, sf_dir):
    a = fx.activations(spark, sf_dir)
    # Each layer against the next one (the last against the first).
    x = a.select("id", "target", "layer", F.col("act").alias("x"))
    y = a.select("id", ((F.col("layer") + 2) % 3).alias("layer"), F.col("act").alias("y"))
    e = x.join(y, ["id", "layer"]).withColumn("e", V.weighted_recon_error(F.col("x"), F.col("y"), ABLATE))
    return e.groupBy("layer", "target").agg(F.round(F.sum("e"), 6).alias("loss"), F.count(F.lit(1)).alias("n_rows"))


CENTROIDS_SQL = """
SELECT label AS k, CAST(dim AS INTEGER) AS dim, avg(v) AS v FROM (
  SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY ALL"""


def _centroids(spark, sf_dir):
    e = fx.activations(spark, sf_dir)
    return e.groupBy(F.col("label").alias("k")).agg(V.vec_mean("act").alias("vec"))


@register("f17_gram", "F17", """
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(unnest(range(len(embedding))) AS INTEGER) AS i FROM embeddings)
SELECT a.i, b.i AS j, round(sum(a.v * b.v), 6) AS value FROM e a JOIN e b USING (vec_id) GROUP BY ALL""")
def f17_gram(spark, sf_dir):
    # The table as a weight matrix: one row per hidden unit, one entry per feature.
    g = V.gram(fx.activations(spark, sf_dir), "act")
    return g.select("i", "j", F.round("value", 6).alias("value"))


@register("f18_row_norms", "F18", f"""
SELECT id, layer, round(sqrt(list_sum(list_transform(act, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM ({ACTS_SQL})""")
def f18_row_norms(spark, sf_dir):
    a = fx.activations(spark, sf_dir)
    return a.select("id", "layer", F.round(V.row_norms(a, "act"), 6).alias("norm"))


@register("f19_features_per_dim", "F19", f"SELECT round(sum(v * v) / 64, 6) AS features_per_dim FROM ({CENTROIDS_SQL})")
def f19_features_per_dim(spark, sf_dir):
    return V.features_per_dim(_centroids(spark, sf_dir), "vec").select(F.round("features_per_dim", 6).alias("features_per_dim"))


@register("f20_interference", "F20", f"""
WITH c AS (SELECT vec_id AS k, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS dim FROM embeddings),
fro AS (SELECT sqrt(sum(v * v)) AS f FROM c),
m AS (SELECT a.dim AS i, b.dim AS j, sum(a.v * b.v) AS m FROM c a JOIN c b USING (k) GROUP BY ALL),
q AS (SELECT a.k, sum(a.v * m * b.v) AS s FROM c a JOIN m ON m.i = a.dim JOIN c b ON b.k = a.k AND b.dim = m.j GROUP BY a.k),
n AS (SELECT k, sum(v * v) AS n FROM c GROUP BY k)
SELECT k, round(sqrt(greatest(s - n * n, 0)) / (1e-5 + (SELECT f FROM fro)), 6) AS interference FROM q JOIN n USING (k)""")
def f20_interference(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("k"), F.col("embedding").alias("vec"))
    return V.interference(e, "k", "vec").select("k", F.round("interference", 6).alias("interference"))


N_TOY_FEATURES, SPARSITY = 5, 0.3


@register("f21_sparse_rows", "F21", f"""
SELECT vec_id AS id, CAST(j AS INTEGER) AS j,
       CASE WHEN (('0x' || substr(md5(concat_ws(':', '7', 'keep' || j, CAST(vec_id AS VARCHAR))), 1, 8))::BIGINT / 4294967296.0) <= {SPARSITY}
            THEN round((('0x' || substr(md5(concat_ws(':', '7', 'val' || j, CAST(vec_id AS VARCHAR))), 1, 8))::BIGINT / 4294967296.0), 6)
            ELSE 0.0 END AS value
FROM embeddings, (SELECT unnest(range({N_TOY_FEATURES})) AS j)""")
def f21_sparse_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"))
    return V.sparse_rows(e, N_TOY_FEATURES, SPARSITY, 7).select("id", F.col("j").cast("int").alias("j"), "value")


@register("f22_reconstruct", "F22", f"""
WITH c AS ({CENTROIDS_SQL}),
x AS (SELECT id, layer, unnest(act) AS v, unnest(range(len(act))) AS dim FROM ({ACTS_SQL})),
h AS (SELECT id, layer, c.k, sum(x.v * c.v) AS h FROM x JOIN c USING (dim) GROUP BY ALL),
o AS (SELECT id, layer, c.dim, greatest(sum(h.h * c.v) + 0.01, 0) AS o FROM h JOIN c USING (k) GROUP BY ALL)
SELECT id, layer, round(sqrt(sum(o * o)), 6) AS norm, count(*) FILTER (WHERE o > 0) AS n_active FROM o GROUP BY id, layer""")
def f22_reconstruct(spark, sf_dir):
    a = fx.activations(spark, sf_dir).select("id", "layer", F.col("act").alias("vec"))
    out = V.reconstruct(a, _centroids(spark, sf_dir), 0.01)
    return out.select("id", "layer", F.round(norm2(F.col("recon")), 6).alias("norm"),
                      F.size(F.filter("recon", lambda v: v > 0)).cast("bigint").alias("n_active"))


D_SAE = 16


def sae_weights(hook: int = 0, d: int = 64, d_sae: int = D_SAE) -> FE.Encoder:
    """Encoder and decoder of a hook from a rule (test parameters, not trained)."""
    i = np.arange(d)[:, None]
    j = np.arange(d_sae)[None, :]
    w_enc = (((i * 7 + j * 3 + hook) % 11) - 5) / 10.0
    return FE.Encoder(w_enc, np.full(d_sae, -0.05), w_enc.T.copy(), np.full(d, 0.01))


def _coded_sql(x: str, keys: str, weights: str, on: str) -> str:
    """Squared reconstruction error, active features and the sum of their indices, for
    vectors ``x(keys, v, i)`` and weights ``(.., i, j, w)`` joined by ``on``."""
    return f"""
x AS ({x}), wt AS ({weights}),
f AS (SELECT {keys}, j, greatest(sum((v - 0.01) * w) - 0.05, 0) AS f FROM x JOIN wt USING ({on}i) GROUP BY ALL),
rc AS (SELECT {keys}, i, sum(f * w) + 0.01 AS r FROM f JOIN wt USING ({on}j) GROUP BY ALL),
act AS (SELECT {keys}, count(*) FILTER (WHERE f > 0) AS n_active, CAST(coalesce(sum(j) FILTER (WHERE f > 0), 0) AS BIGINT) AS index_sum FROM f GROUP BY ALL),
err AS (SELECT {keys}, round(sum((v - r) * (v - r)), 4) AS sq_err FROM x JOIN rc USING ({keys}, i) GROUP BY ALL)"""


def _coded(df, vec, keys):
    from ..functions.vectors import sq_err_sum

    return df.select(*keys, F.round(sq_err_sum(F.col(vec), F.col("recon")), 4).alias("sq_err"),
                     F.size("indices").cast("bigint").alias("n_active"),
                     F.aggregate("indices", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("index_sum"))


@register("f12_encode_decode", "F12", f"""
WITH {_coded_sql(f"SELECT id, layer, CAST(unnest(act) AS DOUBLE) AS v, unnest(range(len(act))) AS i FROM ({ACTS_SQL})", "id, layer",
                 f"SELECT layer, i, j, CAST((((i * 7 + j * 3 + layer) % 11) - 5) AS DOUBLE) / 10.0 AS w FROM range(64) t1(i), range({D_SAE}) t2(j), range(3) t3(layer)",
                 "layer, ")}
SELECT id, layer, sq_err, n_active, index_sum FROM err JOIN act USING (id, layer)""")
def f12_encode_decode(spark, sf_dir):
    a = fx.activations(spark, sf_dir).select("id", "layer", "act")
    out = FE.encode_decode(a, "act", {k: sae_weights(k) for k in range(3)}, "layer")
    return _coded(out, "act", ["id", "layer"])


@register("f12_blocked_encode", "F12", f"""
WITH {_coded_sql(f"SELECT id, layer, CAST(unnest(act) AS DOUBLE) AS v, unnest(range(len(act))) AS i FROM ({ACTS_SQL})", "id, layer",
                 f"SELECT i, j, CAST((((i * 7 + j * 3 + 5) % 11) - 5) AS DOUBLE) / 10.0 AS w FROM range(64) t1(i), range({D_SAE}) t2(j)",
                 "")}
SELECT id, layer, sq_err, n_active, index_sum FROM err JOIN act USING (id, layer)""")
def f12_blocked_encode(spark, sf_dir):
    # The encoder as a table of features, shipped in blocks of three; no worker ever holds two of them.
    e = sae_weights(5)
    table = spark.createDataFrame(
        [(j, e.w_enc[:, j].tolist(), float(e.b_enc[j]), e.w_dec[j].tolist()) for j in range(D_SAE)],
        "feature int, w_enc array<double>, b_enc double, w_dec array<double>")
    a = fx.activations(spark, sf_dir).select("id", "layer", "act")
    out = FE.encode_decode_blocks(a, "act", {"hook": (e.b_dec, FE.table_blocks(table, 3))}, keep_bytes=0)
    return _coded(out, "act", ["id", "layer"])


@register("a5_bucketed_pairs", "A5 F6 F13", f"""
SELECT a.sample, a.side, round(avg((a.v - r.v) * (a.v - r.v)), 6) AS recon_loss, count(DISTINCT a.pos) AS n_tokens
FROM (SELECT sample, side, pos, unnest(vec) AS v, unnest(range(len(vec))) AS dim FROM ({TOKENS_SQL}) WHERE layer = 9) a
JOIN (SELECT sample, side, pos, unnest(vec) AS v, unnest(range(len(vec))) AS dim FROM ({TOKENS_SQL}) WHERE layer = 20) r
USING (sample, side, pos, dim) GROUP BY ALL""")
def a5_bucketed_pairs(spark, sf_dir):
    # Two snapshots with the same buckets: their join and the sums by sample can do without a shuffle.
    names = []
    for layer in fx.LAYERS:
        names.append(f"snapshot_{layer}_{uuid.uuid4().hex}")
        rows = fx.tokens(spark, sf_dir).where(F.col("layer") == layer).drop("layer")
        A.save_bucketed(rows, names[-1], os.path.join(checkpoint_dir(spark), names[-1]), "sample", buckets=8)
    sides = [A.load_bucketed(spark, n) for n in names]
    loss = V.recon_loss(*sides, ["sample", "side"])
    return loss.select("sample", "side", F.round("recon_loss", 6).alias("recon_loss"), "n_tokens")


@register("a5_snapshot_layer_filter", "A5 F5", f"""
SELECT sample, side, pos, token_id, round(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE))), 6) AS vec_sum
FROM ({TOKENS_SQL}) WHERE layer = 20""")
def a5_snapshot_layer_filter(spark, sf_dir):
    path = os.path.join(checkpoint_dir(spark), f"a5-{uuid.uuid4().hex}")
    A.save_snapshot(fx.tokens(spark, sf_dir), path, "layer")
    snap = A.load_snapshot(spark, path, layers=[20], columns=["sample", "side", "pos", "token_id", "vec"])
    return snap.select("sample", "side", "pos", "token_id",
                       F.round(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double")), 6).alias("vec_sum"))


def _render_sql():
    from . import sqlfrag as S

    return S.render_chat("[{'role': 'user', 'content': prompt}]", "true")


S_RENDER = _render_sql()


@register("f14_capture_encode", "F14 B5 F3 F4 F12", lambda: f"""
WITH p AS (SELECT conv_id, turn, text AS prompt FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, string_split({S_RENDER}, ' ') AS words FROM p),
w AS (SELECT conv_id, turn, CAST(unnest(range(len(words))) AS INTEGER) AS pos, unnest(words) AS word FROM r),
t AS (SELECT conv_id, turn, pos, (('0x' || substr(md5(word), 1, 8))::BIGINT) % (SELECT count(*) FROM embeddings) AS token_id
      FROM w WHERE NOT contains(word, '<')),
l AS (SELECT conv_id, turn, max(pos) AS last_pos, arg_max(token_id, pos) AS token_id FROM t GROUP BY conv_id, turn),
a AS (SELECT conv_id, turn, last_pos, embedding AS act FROM l JOIN embeddings e ON e.vec_id = l.token_id),
{_coded_sql("SELECT conv_id, turn, CAST(unnest(act) AS DOUBLE) AS v, unnest(range(len(act))) AS i FROM a", "conv_id, turn",
            f"SELECT i, j, CAST((((i * 7 + j * 3) % 11) - 5) AS DOUBLE) / 10.0 AS w FROM range(64) t1(i), range({D_SAE}) t2(j)", "")}
SELECT conv_id, turn, last_pos, sq_err, n_active, index_sum FROM a JOIN err USING (conv_id, turn) JOIN act USING (conv_id, turn)""")
def f14_capture_encode(spark, sf_dir):
    from ..operators.messages import render_chat, to_messages

    users = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    rendered = users.select("conv_id", "turn", render_chat(to_messages(None, F.col("text")), add_generation_prompt=True).alias("t"))
    lookup = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vec"))
    toks = FE.token_rows(rendered, ["conv_id", "turn"], "t", lookup.count())
    last = FE.capture_last_token(toks, ["conv_id", "turn"], lookup)
    out = FE.encode_decode(last, "vec", {"hook": sae_weights()})
    return _coded(out, "vec", ["conv_id", "turn", "last_pos"])


@register("f14_last_positions", "F14 F3", lambda: f"""
WITH p AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE text END AS prompt FROM conversations),
w AS (SELECT conv_id, turn, CAST(unnest(range(len(words))) AS INTEGER) AS pos, unnest(words) AS word
      FROM (SELECT conv_id, turn, string_split({S_RENDER}, ' ') AS words FROM p))
SELECT conv_id, turn, coalesce(max(pos) FILTER (WHERE NOT contains(word, '<')), -1) AS last_pos,
       bool_or(NOT contains(word, '<')) AS has_vector FROM w GROUP BY 1, 2""")
def f14_last_positions(spark, sf_dir):
    from ..operators.messages import render_chat, to_messages

    # Every turn; those of the system have no text, so only the template's special tokens are left of them.
    text = F.when(F.col("role") == "system", F.lit("")).otherwise(F.col("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", render_chat(to_messages(None, text), add_generation_prompt=True).alias("t"))
    lookup = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vec"))
    last = FE.capture_last_token(FE.token_rows(turns, ["conv_id", "turn"], "t", lookup.count()), ["conv_id", "turn"], lookup)
    return last.select("conv_id", "turn", "last_pos", F.col("vec").isNotNull().alias("has_vector"))


@register("f1_tokenizer_mask", "F1 F3 F14")
def f1_tokenizer_mask(spark, sf_dir):
    import public_tokenizers

    # Tokens of every user turn by the vocabulary file; how many count, and the last that does.
    users = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").select("conv_id", "turn", "text")
    toks = tokenizer.token_table(users, ["conv_id", "turn"], "text", public_tokenizers.path("byte_bpe_50k.json"))
    return toks.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count_if(~F.col("special")).alias("n_kept"),
        F.coalesce(F.max(F.when(~F.col("special"), F.col("pos"))), F.lit(-1)).alias("last_pos"))
