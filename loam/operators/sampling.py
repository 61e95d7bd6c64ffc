"""Seeded draws and numbering.

Shuffles are orders by ``md5('<seed>:<id>')``, so they repeat across engines,
runs and retries. Rows are numbered by ``exact_rank``: a range-partitioned sort,
per-partition counts and offsets, for consecutive ranks over a whole table or
within groups of any size; a hot group is split across range partitions. Only the
key columns are sorted; everything else joins back by key.

A draw of ``k`` rows counts rows by the leading bits of their hash (one small
aggregate), keeps the leading buckets up to the one that holds row ``k`` and numbers
each of those by itself, so one plan serves every ``k`` and every table size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import shuffle_key
from ..session import checkpoint_dir

#: Hash buckets of a draw: the first 16 bits of the md5 (4 hex digits).
BUCKET_DIGITS = 4


def exact_rank(df: DataFrame, order_cols: list[Column], group_cols: list[str] | None = None,
               rank_col: str = "rank") -> DataFrame:
    """0-based consecutive rank of each row by ``order_cols`` (within ``group_cols``).

    The order must be total (add a unique key). Steps: range-partition and sort
    by ``(groups, order)``; tag each row with its partition and a position from
    ``monotonically_increasing_id``; checkpoint so both passes see one layout;
    count rows per ``(partition, group)`` (at most partitions + groups rows);
    prefix-sum those counts per group; add the offset back by a join, whose
    strategy the optimizer picks. Pass only the columns that must be sorted.
    """
    group_cols = group_cols or []
    spark = df.sparkSession
    checkpoint_dir(spark)
    keys = [F.col(g) for g in group_cols] + list(order_cols)
    tagged = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    ).checkpoint(eager=True)
    runs = tagged.groupBy("_pid", *group_cols).agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) \
        if group_cols else Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(
        "_pid", *group_cols, "_first", "_offset")
    joined = tagged.join(offsets, ["_pid", *group_cols])
    return joined.withColumn(rank_col, F.col("_offset") + F.col("_pos") - F.col("_first")).drop(
        "_pid", "_pos", "_first", "_offset"
    )


def _bucket(seed, key: str) -> Column:
    return F.conv(F.substring(shuffle_key(seed, F.col(key)), 1, BUCKET_DIGITS), 16, 10).cast("int")


def draw_top_k(df: DataFrame, k: int, seed, key: str = "id", rank_col: str = "rank",
               counts: DataFrame | None = None) -> DataFrame:
    """The first ``k`` rows of a seeded shuffle, ranked 0..k-1; ``key`` must be unique.

    A row's rank is the rows of the earlier buckets and its place in its own, so nothing is sorted across
    partitions: the leading buckets (at most ``16 ** BUCKET_DIGITS`` numbers, broadcast) keep their rows,
    and each bucket is numbered by itself. ``counts`` is ``bucket_counts(df, seed, key)`` where the
    caller has it already.
    """
    counts = bucket_counts(df, seed, key) if counts is None else counts
    got = counts.toArrow().sort_by("bucket")
    n = got["n"].to_numpy()
    before = np.cumsum(n) - n
    leading = df.sparkSession.createDataFrame(
        pa.table({"_bucket": got["bucket"], "_before": before}).filter(before < k), "_bucket int, _before bigint")
    kept = df.withColumn("_bucket", _bucket(seed, key)).join(F.broadcast(leading), "_bucket")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(shuffle_key(seed, F.col(key)), key))
    ranked = kept.withColumn(rank_col, (F.col("_before") + place - 1).cast("bigint"))
    return ranked.where(F.col(rank_col) < k).drop("_bucket", "_before")


def bucket_counts(df: DataFrame, seed, key: str = "id") -> DataFrame:
    """``bucket, n``: rows by hash bucket, at most ``16 ** BUCKET_DIGITS`` rows."""
    return df.groupBy(_bucket(seed, key).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def child_set(annotated: DataFrame, n: int, n_eval: int, seed=42, check: bool = True) -> DataFrame:
    """Keep valid rows, draw ``n + n_eval``, renumber from 0, split train/eval.

    Output ``id, split, base_dataset_id`` plus the input columns. ``check`` asserts,
    as the original does, that there are enough valid rows; the count comes from
    the draw's own aggregate. ``annotated`` is read twice.
    """
    valid = annotated.where(F.col("valid_response"))
    counts = bucket_counts(valid, seed).persist()
    try:
        drawn = draw_top_k(valid, n + n_eval, seed, "id", "_rank", counts)
        have = counts.agg(F.sum("n")).first()[0] or 0
    finally:
        counts.unpersist()
    if check and have < n + n_eval:
        raise ValueError(f"Input dataset has {have} samples, but requested {n + n_eval} samples.")
    return drawn.withColumnRenamed("id", "base_dataset_id").select(
        F.col("_rank").cast("bigint").alias("id"),
        F.when(F.col("_rank") < n, F.lit("train")).otherwise(F.lit("eval")).alias("split"),
        "*",
    ).drop("_rank")


def head_per_group(df: DataFrame, group: str, n: int, seed=42, key: str = "id") -> DataFrame:
    """C10 core: per group, the first ``n`` rows of a seeded shuffle (rank 0..n-1).

    Rows are counted by (group, hash bucket); per group the leading buckets up to the
    one that holds row ``n`` stay, and only their keys are numbered, each bucket by itself
    from the rows of the earlier ones on. ``key`` is unique.
    """
    buckets = df.groupBy(group, _bucket(seed, key).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(
        Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The join goes by group and bucket, so a hot group is dealt over its buckets.
    leading = buckets.withColumn("_before", before).where(F.col("_before") < n).select(group, "_bucket", "_before")
    keys = df.select(group, key, _bucket(seed, key).alias("_bucket")).join(leading, [group, "_bucket"])
    place = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(shuffle_key(seed, F.col(key)), key))
    ranked = keys.withColumn("rank", (F.col("_before") + place - 1).cast("bigint")).where(F.col("rank") < n)
    return df.join(ranked.select(key, "rank"), key)


def shuffled_ids(df: DataFrame, group: str, key: Column, tie: str, seed=42) -> DataFrame:
    """Number the rows of each group from 0 in the order of a seeded shuffle of ``key``.
    A group is one target's prompt list, which its generator bounds."""
    w = Window.partitionBy(group).orderBy(shuffle_key(seed, key), tie)
    return df.withColumn("id", (F.row_number().over(w) - 1).cast("bigint"))


def stratified_split(df: DataFrame, label: str = "label", key: str = "id", seed=42,
                     test_size: float = 0.2, validation_size: float = 0.2) -> DataFrame:
    """``split`` in train / validation / test with per-class quotas.

    Test takes ``ceil(test_size * n)`` rows, validation ``ceil(v' * rest)`` with
    ``v' = validation_size / (1 - test_size)``; each split is shared among the
    classes by largest remainder (ties to the smaller class id). Rows are taken
    in seeded-shuffle order within their class; only the keys are ranked, so vectors
    and other columns are never sorted. ``key`` must be unique.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    v_frac = validation_size / (1.0 - test_size)
    total = F.sum("n_c").over(Window.partitionBy(F.lit(1)))
    q = counts.withColumn("n_all", total)
    q = _largest_remainder(q, label, "n_c", F.ceil(F.col("n_all") * test_size), "q_test")
    q = q.withColumn("rest", F.col("n_c") - F.col("q_test"))
    q = q.withColumn("n_rest", F.sum("rest").over(Window.partitionBy(F.lit(1))))
    q = _largest_remainder(q, label, "rest", F.ceil(F.col("n_rest") * v_frac), "q_val")
    keys = df.select(label, key, shuffle_key(seed, F.col(key)).alias("_hash"))
    ranked = exact_rank(keys, [F.col("_hash"), F.col(key)], [label], "_r").select(key, "_r")
    return df.join(ranked, key).join(q.select(label, "q_test", "q_val"), label).withColumn(
        "split",
        F.when(F.col("_r") < F.col("q_test"), F.lit("test"))
        .when(F.col("_r") < F.col("q_test") + F.col("q_val"), F.lit("validation"))
        .otherwise(F.lit("train")),
    ).drop("_r", "q_test", "q_val")


def _largest_remainder(q: DataFrame, label: str, size_col: str, target: Column, out: str) -> DataFrame:
    """Share ``target`` rows among classes in proportion to ``size_col``."""
    all_w = Window.partitionBy(F.lit(1))
    q = q.withColumn("_tgt", target).withColumn("_sz", F.sum(size_col).over(all_w))
    q = q.withColumn("_exact", F.col(size_col) * F.col("_tgt") / F.col("_sz"))
    q = q.withColumn("_floor", F.floor("_exact")).withColumn("_rem", F.col("_exact") - F.col("_floor"))
    q = q.withColumn("_left", F.col("_tgt") - F.sum("_floor").over(all_w))
    q = q.withColumn("_ord", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("_rem"), F.col(label))))
    q = q.withColumn(out, (F.col("_floor") + F.when(F.col("_ord") <= F.col("_left"), 1).otherwise(0)).cast("bigint"))
    return q.drop("_tgt", "_sz", "_exact", "_floor", "_rem", "_left", "_ord")


def running_sum(df: DataFrame, order_cols: list[Column], value: str, group_cols: list[str] | None = None,
                out_col: str = "running") -> DataFrame:
    """Inclusive running sum of ``value`` by ``order_cols`` within ``group_cols``.

    Same layout trick as ``exact_rank``: range partitions (a hot group spans
    several), a running sum inside each partition, plus the totals of the
    earlier partitions of the same group. No window ever holds a whole group.
    """
    group_cols = group_cols or []
    checkpoint_dir(df.sparkSession)
    keys = [F.col(g) for g in group_cols] + list(order_cols)
    tagged = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())).checkpoint(eager=True)
    local_w = Window.partitionBy("_pid", *group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_local", F.sum(value).over(local_w))
    totals = tagged.groupBy("_pid", *group_cols).agg(F.sum(value).alias("_tot"))
    w = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(1))).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_tot").over(w), F.lit(0))).select(
        "_pid", *group_cols, "_offset")
    return local.join(offsets, ["_pid", *group_cols]).withColumn(
        out_col, F.col("_local") + F.col("_offset")
    ).drop("_pid", "_local", "_offset")
