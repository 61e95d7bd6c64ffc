"""Activation vectors: masking, pooling, pairing, mean differences, steering
vectors, losses and weight statistics (F1-F11, F13, F16-F22).

Vectors are ``array<float>`` columns. Per-group vector means go through MLlib's
``Summarizer`` (a JVM aggregate with map-side partial aggregation), so the
shuffle carries one partial vector per group and map task, not one row per
element, and a hot group costs no more than a cold one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import fixed_values as fv
from ..functions.draws import uniform_of
from ..functions.vectors import add, dot, norm2, sq_err_sum, sq_norm, sub

#: Bytes of a block of Gram-matrix rows, and of a slice of vectors, that one task holds at a time.
BLOCK_BYTES = 64 << 20


def vec_mean(col: str) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(col))), "float64")


def vec_sum(col: str) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(col))), "float64")


def special_mask(token_id: Column, specials: list[int]) -> Column:
    """true for tokens that count (not a special token)."""
    return ~token_id.isin(*specials)


def last_position(tokens: DataFrame, keys: list[str], specials: list[int]) -> DataFrame:
    """last non-special position per key, ``-1`` when there is none."""
    return tokens.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(special_mask(F.col("token_id"), specials), F.col("pos"))), F.lit(-1)).alias("last_pos")
    )


def last_token(tokens: DataFrame, keys: list[str], specials: list[int]) -> DataFrame:
    """the vector of the last non-special token (``max_by``; no join back)."""
    return tokens.where(special_mask(F.col("token_id"), specials)).groupBy(*keys).agg(
        F.max("pos").alias("last_pos"), F.max_by("vec", "pos").alias("vec")
    )


def pool(tokens: DataFrame, keys: list[str], specials: list[int], compat: bool = False) -> DataFrame:
    """four vectors per key: prompt/response masked means and last tokens.

    Output is long: ``keys + [position, vec array<double>]``. A part without a
    non-special token gives no row. Sums are partial before the shuffle, so four
    vectors per key and map task move, not one per token. ``compat`` reproduces the
    original code (see ``pool_compat``).
    """
    if compat:
        return pool_compat(tokens, keys, specials)
    t = tokens.where(special_mask(F.col("token_id"), specials)).withColumn(
        "part", F.when(F.col("pos") < F.col("prompt_len"), F.lit("prompt")).otherwise(F.lit("response"))
    )
    g = t.groupBy(*keys, "part").agg(
        vec_sum("vec").alias("s"), F.count(F.lit(1)).alias("n"),
        F.max_by(F.col("vec").cast("array<double>"), "pos").alias("last"),
    )
    g = g.withColumn("avg", F.transform("s", lambda x: F.try_divide(x, F.col("n"))))
    return g.select(
        *keys, F.explode(F.array(
            F.struct(F.concat("part", F.lit("_avg")).alias("position"), F.col("avg").alias("vec")),
            F.struct(F.concat("part", F.lit("_last")).alias("position"), F.col("last").alias("vec")),
        )).alias("p")
    ).select(*keys, "p.position", "p.vec")


def pool_compat(tokens: DataFrame, keys: list[str], specials: list[int]) -> DataFrame:
    """F2 as the original computes it (Q1, Q2), on masked vectors (special tokens zeroed).

    The response sum is divided by the number of non-special *prompt* tokens, and the
    last response token's position relative to the response start is used as an
    absolute one. A part without a non-special token has a zero mean, and its last
    vector is the one at position 0. Every key has all four vectors.
    """
    keep = special_mask(F.col("token_id"), specials)
    vec = F.col("vec").cast("array<double>")
    in_prompt = F.col("pos") < F.col("prompt_len")
    t = tokens.select(*keys, "pos", "prompt_len", keep.alias("_keep"), in_prompt.alias("_prompt"),
                      F.when(keep, vec).otherwise(F.transform(vec, lambda x: F.lit(0.0))).alias("_v"))

    def part_sum(which: Column) -> Column:
        return vector_to_array(Summarizer.sum(array_to_vector(
            F.when(which, F.col("_v")).otherwise(F.transform("_v", lambda x: F.lit(0.0))))), "float64")

    n_prompt = F.sum((F.col("_keep") & F.col("_prompt")).cast("bigint"))
    g = t.groupBy(*keys).agg(
        part_sum(F.col("_prompt")).alias("_ps"), part_sum(~F.col("_prompt")).alias("_rs"), n_prompt.alias("_n"),
        F.coalesce(F.max(F.when(F.col("_keep") & F.col("_prompt"), F.col("pos"))), F.lit(0)).alias("_pl"),
        F.coalesce(F.max(F.when(F.col("_keep") & ~F.col("_prompt"), F.col("pos") - F.col("prompt_len"))), F.lit(0)).alias("_rl"))
    at = {n: g.select(*keys, F.col(c).alias("pos")) for n, c in (("prompt", "_pl"), ("response", "_rl"))}
    last = [t.join(p, [*keys, "pos"]).select(*keys, F.lit(f"{n}_last").alias("position"), F.col("_v").alias("vec"))
            for n, p in at.items()]
    mean = g.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(f"{n}_avg").alias("position"),
                 F.transform(c, lambda x: F.coalesce(F.try_divide(x, F.col("_n")), F.lit(0.0))).alias("vec"))
        for n, c in (("prompt", "_ps"), ("response", "_rs"))])).alias("p")).select(*keys, "p.position", "p.vec")
    return mean.unionByName(last[0]).unionByName(last[1])


def pair_sides(pooled: DataFrame, pair: Column | str, side_col: str = "side", keys: list[str] | None = None) -> DataFrame:
    """target and base vectors of the same pair, kept only when both exist.

    An aggregation per ``(pair, keys)`` over the pooled vectors (two entries at most).
    """
    keys = keys or ["layer", "position"]
    p = pooled.withColumn("pair", pair if isinstance(pair, Column) else F.col(pair))
    g = p.groupBy("pair", *keys).agg(
        F.first(F.when(F.col(side_col) == "target", F.col("vec")), ignorenulls=True).alias("t"),
        F.first(F.when(F.col(side_col) == "base", F.col("vec")), ignorenulls=True).alias("b"),
    )
    return g.where(F.col("t").isNotNull() & F.col("b").isNotNull())


def mean_difference(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``mean over pairs of (target - base)`` per key (layer, position)."""
    keys = keys or ["layer", "position"]
    return pairs.withColumn("d", sub(F.col("t"), F.col("b"))).groupBy(*keys).agg(
        vec_mean("d").alias("vec"), F.count(F.lit(1)).alias("n_pairs")
    )


def hook_name(layer: Column) -> Column:
    before, after = fv.HOOK_NAME.split("{layer}")
    return F.concat(F.lit(before), layer.cast("string"), F.lit(after))


def steering_vectors(diffs: DataFrame, position: str, layers: list[int]) -> DataFrame:
    """F8: pick a position and layers; name each vector by its hook."""
    return diffs.where((F.col("position") == position) & F.col("layer").isin(*layers)).select(
        "layer", hook_name(F.col("layer")).alias("hook"), "vec"
    )


def vector_sets(vectors: DataFrame, position: str, combine: bool = True) -> DataFrame:
    """one set per layer plus, optionally, the combined set of all layers.

    Output ``set_name, hooks map<string, array<double>>``; the combined set holds
    one entry per layer (bounded by the layer list).
    """
    single = vectors.select(
        F.concat(F.col("layer").cast("string"), F.lit("_" + position)).alias("set_name"),
        F.create_map("hook", "vec").alias("hooks"),
    )
    if not combine:
        return single
    combined = vectors.agg(
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("layer")), lambda x: x.cast("string")), "-"),
                 F.lit("_" + position)).alias("set_name"),
        F.map_from_entries(F.collect_list(F.struct("hook", "vec"))).alias("hooks"),
    )
    return single.unionByName(combined)


def scaled(v: Column, alpha: Column) -> Column:
    """``v / (||v||_2 + 1e-12) * alpha``; the norm is bound once per vector, as the only element
    of an array that the outer function goes over."""
    length = F.array(norm2(v) + F.lit(fv.STEERING_NORM_EPS))
    return F.transform(length, lambda n: F.transform(v, lambda x: x.cast("double") / n * alpha))[0]


def add_steering(tokens: DataFrame, vectors: DataFrame, keys: list[str], position: str = "all") -> DataFrame:
    """add a layer's scaled vector to its token activations, at every token
    or at the last token only. ``vectors`` has one row per layer; the optimizer picks the join
    by their measured size.

    The last position comes from a partially aggregated ``max`` joined back on
    the sequence keys (AQE can split a skewed key there), not from a window that
    would hold a whole sequence in one task.
    """
    v = vectors.select("layer", F.col("vec").alias("steer"))
    t = tokens.join(v, "layer", "left")
    if position == "last":
        last = tokens.groupBy(*keys).agg(F.max("pos").alias("_last"))
        t = t.join(last, keys)
        hit = F.col("pos") == F.col("_last")
    else:
        hit = F.lit(True)
    out = t.withColumn(
        "vec", F.when(hit & F.col("steer").isNotNull(), add(F.col("vec"), F.col("steer"))).otherwise(
            F.col("vec").cast("array<double>"))
    ).drop("steer")
    return out.drop("_last") if position == "last" else out


def recon_loss(acts: DataFrame, recon: DataFrame, keys: list[str], token_key: str = "pos") -> DataFrame:
    """per key, mean squared error over tokens and dims. Shapes must match: a token
    that only one side has, or vectors of different length, fail the job."""
    j = acts.select(*keys, token_key, F.col("vec").alias("a")).join(
        recon.select(*keys, token_key, F.col("vec").alias("r")), [*keys, token_key], "full"
    )
    err = F.when(F.coalesce(F.size("a") != F.size("r"), F.lit(True)) | F.col("a").isNull() | F.col("r").isNull(),
                 F.raise_error(F.lit("Activations are different sizes!"))).otherwise(
        sq_err_sum(F.col("a"), F.col("r")))
    return j.groupBy(*keys).agg(
        (F.sum(err) / F.sum(F.size("a"))).alias("recon_loss"), F.count(F.lit(1)).alias("n_tokens")
    )


def weighted_recon_error(x: Column, y: Column, ablate: list[int] | None = None,
                         base: float = fv.TOY_BASE_FEATURE_WEIGHT) -> Column:
    """F16 per row: ``mean_i(w_i * (|x_i| - y_i)^2)`` with ``w_i = base**i`` (0 if ablated).

    Sum it over rows for the batch loss.
    """
    ablate = ablate or []
    terms = F.transform(
        F.arrays_zip(x.alias("x"), y.alias("y")),
        lambda e, i: F.when(i.isin(*ablate) if ablate else F.lit(False), F.lit(0.0)).otherwise(F.pow(F.lit(base), i))
        * F.pow(F.abs(e["x"].cast("double")) - e["y"].cast("double"), 2),
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v) / F.size(x)


def row_norms(df: DataFrame, vec: str = "vec") -> Column:
    """L2 norm of each row."""
    return norm2(F.col(vec))


def block_rows(dim: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Rows of a ``dim`` wide matrix of doubles in a block of at most ``block_bytes`` (one at least)."""
    return max(1, min(dim, block_bytes // (8 * dim))) if dim else 1


def gram_rows(w: DataFrame, vec: str = "vec", block_bytes: int = BLOCK_BYTES, dim: int | None = None) -> DataFrame:
    """``i, row``: row ``i`` of ``W^T W``, summed over any number of weight rows.

    Each task multiplies its Arrow batches and emits its sums for one block of rows; the sums by row are
    partial before the shuffle. A matrix of several blocks reads ``w`` once per block, so that a task holds
    ``block_bytes`` of sums however wide the vectors are. Null vectors add nothing; no vectors give no rows.
    """
    w = w.select(F.col(vec).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    dim = w.agg(F.max(F.size("v"))).first()[0] or 0 if dim is None else dim
    size = block_rows(dim, block_bytes)

    def block(first: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    part = x[:, first:first + size].T @ x
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + np.arange(len(total)), pa.int32()), pa.array(list(total))], names=["i", "row"])
        return run

    parts = [w.mapInArrow(block(first), "i int, row array<double>") for first in range(0, max(dim, 1), size)]
    return reduce(DataFrame.unionAll, parts).groupBy("i").agg(vec_sum("row").alias("row"))


def by_gram_blocks(x: DataFrame, keys: list[str], vec: str, weights: DataFrame, w_vec: str,
                   work: Callable[[np.ndarray, np.ndarray, int], list[pa.Array]], schema: str,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``k, b`` and the columns of ``schema``: ``work(X, G, first)`` for every slice ``X`` of the vectors of
    ``x`` and every block ``G`` of rows of ``W^T W``, which starts at row ``first``.

    Blocks of the matrix and slices of the vectors meet in a join by (block, slice): a task holds one of
    each, the matrix never passes through the driver, and its rows are sent once per slice, the vectors
    once per block. ``k`` is the struct of ``keys``. Rows without a vector are left out.
    """
    x = x.select(F.struct(*keys).alias("k"), F.col(vec).cast("array<double>").alias("x")).where(F.col("x").isNotNull())
    dim = weights.agg(F.max(F.size(w_vec))).first()[0] or 0
    size = block_rows(dim, block_bytes)
    blocks = -(-dim // size) if dim else 0
    slices = max(x.sparkSession.sparkContext.defaultParallelism, -(-x.count() * 8 * dim // block_bytes))
    left = x.withColumn("s", F.pmod(F.xxhash64("k"), F.lit(slices)).cast("int")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
    right = gram_rows(weights, w_vec, block_bytes, dim).withColumn("b", F.floor(F.col("i") / size).cast("int")).withColumn(
        "s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def run(mine: pa.Table, matrix: pa.Table) -> pa.Table:
        mine, matrix = mine.combine_chunks(), matrix.sort_by("i").combine_chunks()
        if not mine.num_rows or not matrix.num_rows:
            return arrow.empty_table()
        vectors, rows = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
                         for t, c in ((mine, "x"), (matrix, "row")))
        out = work(vectors, rows, int(matrix.column("i")[0].as_py()))
        return pa.Table.from_arrays([mine.column("k"), mine.column("b"), *out], names=names)

    kinds = left.select("k", "b").schema
    full = T.StructType([*kinds.fields, *T.StructType.fromDDL(schema).fields])
    names = full.names
    arrow = to_arrow_schema(full)
    return left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(run, full)


def gram(w: DataFrame, vec: str = "vec") -> DataFrame:
    """feature products as ``(i, j, value)``, ``W^T W`` for a matrix stored with one
    row per hidden unit and one entry per feature; distributed sums, one output row
    per pair of entries."""
    return gram_rows(w, vec).select("i", F.posexplode("row").alias("j", "value"))


def features_per_dim(w: DataFrame, vec: str = "vec") -> DataFrame:
    """``frobenius(W)^2 / n_hidden`` (one global aggregate)."""
    return w.agg((F.sum(sq_norm(F.col(vec))) / F.max(F.size(vec))).alias("features_per_dim"))


def interference(w: DataFrame, key: str = "k", vec: str = "vec", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """per row, the off-diagonal norm of ``(W / (1e-5 + ||W||_F)) W^T``; ``key`` is unique.

    ``sum_j (w_i . w_j)^2 = w_i^T (W^T W) w_i``, so one matrix as wide as the vectors, kept in blocks,
    serves any number of rows; the diagonal term ``(w_i . w_i)^2`` is taken off.
    """
    def form(x: np.ndarray, g: np.ndarray, first: int) -> list[pa.Array]:
        mine = x[:, first:first + len(g)]
        return [pa.array(((x @ g.T) * mine).sum(axis=1)), pa.array((mine * mine).sum(axis=1))]

    fro = np.sqrt(w.agg(F.sum(sq_norm(F.col(vec)))).first()[0] or 0.0)
    parts = by_gram_blocks(w, [key], vec, w, vec, form, "q double, n double", block_bytes)
    sums = parts.groupBy("k").agg(F.sum("q").alias("q"), F.sum("n").alias("n"))
    off = F.greatest(F.col("q") - F.col("n") * F.col("n"), F.lit(0.0))
    return sums.select(F.col(f"k.{key}").alias("k"), (F.sqrt(off) / F.lit(fv.TOY_NORM_EPS + float(fro))).alias("interference"))


def reconstruct(x: DataFrame, weights: DataFrame, bias: float | list[float], vec: str = "vec", w_vec: str = "vec",
                keys: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``recon = relu(W^T W x + b)`` for every row ``x``, with the weight rows ``W`` (any number) as a
    table. Output ``keys`` (``x``'s other columns if not given; unique) and ``recon``."""
    keys = keys or [c for c in x.columns if c != vec]
    width = weights.agg(F.max(F.size(w_vec))).first()[0] or 0
    add_up = np.asarray(bias, float) if isinstance(bias, list) else np.full(width, float(bias))

    def product(v: np.ndarray, g: np.ndarray, first: int) -> list[pa.Array]:
        return [pa.array(list(np.maximum(v @ g.T + add_up[first:first + len(g)], 0.0)), pa.list_(pa.float64()))]

    parts = by_gram_blocks(x, keys, vec, weights, w_vec, product, "recon array<double>", block_bytes)
    whole = parts.groupBy("k").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("b", "recon"))), lambda p: p["recon"])).alias("recon"))
    return whole.select("k.*", "recon")


def sparse_rows(ids: DataFrame, n_features: int, sparsity: float, seed, key: str = "id") -> DataFrame:
    """``key, j, value``: feature ``j`` is present with probability ``sparsity`` and
    then uniform, both drawn by keyed hashes."""
    rows = ids.select(key, F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))).alias("j"))

    def draw(field: str) -> Column:
        return uniform_of(F.concat_ws(":", F.lit(str(seed)), F.concat(F.lit(field), F.col("j").cast("string")),
                                      F.col(key).cast("string")))

    return rows.select(key, "j", F.when(draw("keep") <= sparsity, F.round(draw("val"), 6)).otherwise(F.lit(0.0)).alias("value"))
