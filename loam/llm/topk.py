"""Exact top-k inner-product search by columnar branch and bound (operator 3).

Queries and candidates are dealt to groups of bounded size, and each pair of groups meets in one task.
There the candidates lie in vertical layout (one row per dimension). Scores grow dimension block by
dimension block; after each block a candidate can gain at most the product of its own and the query's
remaining mass (the norms of the dimensions still to come), and candidates that no longer reach the k-th
best score of any query of the chunk are compacted away. The first lower limits come from scoring the
candidates of largest norm in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, narrow, read_table

#: Fixed values of the registered query.
SCALE, K, EVERY = 64.0, 20, 20
#: Bytes of vectors in a group, candidates in a group at most, queries scored together, dimension block.
GROUP_BYTES, GROUP_ROWS, CHUNK, BLOCK = 16 << 20, 8192, 64, 16
LONG = (-(1 << 63), (1 << 63) - 1)


def vertical(column: pa.Array, scale: float) -> np.ndarray:
    """``floor(scale * x)`` of list rows as a matrix (dimension, row); short rows end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([0 if v is None else v for v in pc.list_value_length(column).to_pylist()], np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return np.ascontiguousarray(out.T)


def _rest(v: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norms of what lies past each block edge, a little enlarged against rounding."""
    mass = np.array([(v[e:] ** 2).sum(axis=0) for e in edges])
    return np.sqrt(mass) * (1 + 1e-9)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    if scores.shape[1] < k:
        return np.full(scores.shape[0], -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def search(q: np.ndarray, x: np.ndarray, own: np.ndarray, order: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (column of ``q``) the places and scores of its ``k`` best candidates (columns of
    ``x``); ``own`` is the candidate to leave out (-1: none); ties go to the smaller ``order``."""
    dims = max(q.shape[0], x.shape[0])
    q, x = (np.pad(v, ((0, dims - v.shape[0]), (0, 0))) for v in (q, x))
    n = x.shape[1]
    edges = [*range(BLOCK, dims, BLOCK), dims] if dims else [0]
    exact = dims * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < 2.0 ** 53
    if not exact:  # beyond what doubles hold: whole numbers of any size, without bounds
        whole = np.array([[int(v) for v in r] for r in x.T], object).reshape(n, dims)
    q_rest, x_rest = _rest(q, edges), _rest(x, edges)
    heavy = np.argsort(-(x ** 2).sum(axis=0), kind="stable")[: max(4 * k, 64)]
    found = []
    for c in range(0, q.shape[1], CHUNK):
        qs, mine = q[:, c:c + CHUNK], own[c:c + CHUNK]
        if exact:
            first = qs.T @ x[:, heavy]
            first[mine[:, None] == heavy[None, :]] = -np.inf
            limit = _kth(first, k)
            alive, cols, score = np.arange(n), x, np.zeros((qs.shape[1], n))
            low = 0
            for b, high in enumerate(edges):
                score += qs[low:high].T @ cols[low:high]
                low = high
                if high == dims:
                    break
                reach = score + q_rest[b, c:c + CHUNK, None] * x_rest[b, alive][None, :]
                keep = (reach >= limit[:, None]).any(axis=0)
                if keep.mean() < 0.8:
                    alive, cols, score = alive[keep], cols[:, keep], score[:, keep]
        else:
            alive, limit = np.arange(n), np.full(qs.shape[1], -np.inf)
            score = np.array([[int(v) for v in r] for r in qs.T], object).reshape(-1, dims) @ whole.T
        for i in range(qs.shape[1]):
            row = score[i]
            may = np.flatnonzero((row >= limit[i]) & (alive != mine[i]))
            if exact and len(may) > k:
                s = row[may]
                may = may[s >= np.partition(s, len(s) - k)[len(s) - k]]
            s = row[may]
            best = sorted(range(len(may)), key=lambda j: (-s[j], order[alive[may[j]]]))[:k]
            found.append((alive[may[best]], s[best]))
    return found


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def top_k(vectors: DataFrame, is_query: str, k: int = K, scale: float = SCALE, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row for which the SQL text ``is_query`` (on ``vec_id``)
    holds, the ``k`` other rows of highest score, ranked from 1; ties go to the smaller ``vec_id``.

    The score is the inner product of ``floor(scale * x)`` of both rows' components, as whole numbers
    (beyond the range of a long: its border). Vectors that are null or hold a null or non-finite component
    and rows without an id take no part. Of two vectors of different length the shorter counts as ending
    in zeros. Copies of a row (same id and vector) are one query, and as candidates each is a row of its
    own; a query's own row is left out once. Other columns are ignored; an empty table gives no rows.

    Copies are folded into a count before any dealing, so no group of copies sits in one task; queries and
    candidates meet in groups of ``GROUP_BYTES`` at most. Only counts reach the driver.
    """
    kind = narrow(vectors, v=id_col).schema["v"].dataType.simpleString()
    rows = narrow(vectors, vec_id=id_col, vec=vec_col).where(
        "vec_id is not null and vec is not null and "
        "forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = rows.withColumn("vec", F.expr("transform(vec, x -> if(x = 0, cast(0 as double), cast(x as double)))"))
    # written: counted, and read once for each side
    rows = materialize(rows.groupBy("vec_id", "vec").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "query", F.expr(is_query)), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("q"), F.max(F.size("vec")).alias("d")).first()
    per = max(1, GROUP_BYTES // (8 * max(1, size["d"] or 1)))
    n_cand, n_query = -(-size["n"] // min(per, GROUP_ROWS)) or 1, -(-size["q"] // per) or 1
    spread = F.xxhash64("vec_id", "vec")
    cand = rows.select("vec_id", "vec", "copies", F.pmod(spread, F.lit(n_cand)).alias("cg"),
                       F.explode(_numbers(n_query)).alias("qg"))
    query = rows.where("query").select(
        F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"), F.xxhash64("vec").alias("qkey"), F.pmod(spread, F.lit(n_query)).alias("qg"),
        F.explode(_numbers(n_cand)).alias("cg"))
    schema = f"query_id {kind}, qkey bigint, vec_id {kind}, score bigint, copies bigint"

    def meet(qs: pa.Table, xs: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "qkey", "vec_id", "score", "copies"], xs.schema.field("vec_id").type
        if not (qs.num_rows and xs.num_rows):
            return pa.table([pa.array([], t) for t in (kinds, pa.int64(), kinds, pa.int64(), pa.int64())], names)
        q, x = vertical(qs["qvec"], scale), vertical(xs["vec"], scale)
        ids, copies = xs["vec_id"].to_pylist(), np.array(xs["copies"].to_pylist(), np.int64)
        order = np.empty(len(ids), np.int64)
        order[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        qids, qraw, xraw = qs["query_id"].to_pylist(), qs["qvec"].to_pylist(), xs["vec"]
        keys, at = qs["qkey"].to_pylist(), {}
        for j, v in enumerate(ids):
            at.setdefault(v, []).append(j)
        same = np.array([next((j for j in at.get(v, ()) if xraw[j].as_py() == raw), -1)
                         for v, raw in zip(qids, qraw, strict=True)], np.int64)
        own = np.where((same >= 0) & (copies[same] == 1), same, -1)
        out: list[tuple] = []
        for i, (places, scores) in enumerate(search(q, x, own, order, k)):
            out += [(qids[i], keys[i], ids[j], min(max(int(s), LONG[0]), LONG[1]), int(copies[j] - (j == same[i])))
                    for j, s in zip(places.tolist(), scores.tolist(), strict=True)]
        cols = zip(*out, strict=True) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in
                         zip(cols, (kinds, pa.int64(), kinds, pa.int64(), pa.int64()), strict=True)], names)

    best = query.groupBy("cg", "qg").cogroup(cand.groupBy("cg", "qg")).applyInArrow(meet, schema)
    ranked = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("copies", F.lit(k).cast("bigint")))))
    place = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id", "copy")
    return ranked.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op3_columnar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), f"vec_id % {EVERY} = 0")


ORACLE = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
