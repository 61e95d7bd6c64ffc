"""Orchestration as table operators.

A parameter grid is a DataFrame; "run what is missing" is an anti-join and
"run every cell" is a generator over the grid rows, so one job holds the work
of all cells instead of a driver loop.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, path_exists
from ..sources.io import artefact_name


def missing_cells(grid: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """D3: grid rows without a finished artefact (left anti-join on the cell keys)."""
    return grid.join(manifest.select(*keys), keys, "left_anti")


def run_missing(grid: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame], root: str,
                chunks: int = 1) -> DataFrame:
    """D3 with A8: run ``work`` on the cells of ``grid`` that ``root`` has no finished artefact of, and return the
    manifest: ``keys, path, n_rows`` of all finished cells.

    The cells are dealt into ``chunks`` by a hash of their keys. A chunk's rows, which carry ``keys``, are
    written under a path of their own, and only when all of them are there its cells' manifest rows are
    appended. So a chunk whose writer dies leaves files that nothing names, and its cells run again next
    time. The other chunks still run; the first error is raised at the end. A cell without rows is finished
    with 0 rows; a cell that comes twice in the grid is run once.
    """
    spark = grid.sparkSession
    manifest = os.path.join(root, "manifest")
    todo = grid.dropDuplicates(keys)
    if path_exists(spark, manifest):
        todo = missing_cells(todo, spark.read.parquet(manifest), keys)
    todo = materialize(todo, "missing-cells")
    failed: list[Exception] = []
    for c in range(chunks):
        cells = todo.where(F.pmod(F.xxhash64(*keys), F.lit(chunks)) == c) if chunks > 1 else todo
        if cells.isEmpty():
            continue
        path = os.path.join(root, "artefacts", uuid.uuid4().hex)
        try:
            work(cells).write.parquet(path)
            sizes = spark.read.parquet(path).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            cells.select(*keys).join(sizes, keys, "left").select(
                *keys, F.lit(path).alias("path"), F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows")
            ).write.mode("append").parquet(manifest)
        except Exception as e:  # noqa: BLE001 - the other chunks still run
            failed.append(e)
    if failed:
        raise failed[0]
    if not path_exists(spark, manifest):  # an empty grid
        return grid.select(*keys, F.lit("").alias("path"), F.lit(0).cast("bigint").alias("n_rows")).limit(0)
    return spark.read.parquet(manifest)


def finished_rows(manifest: DataFrame) -> DataFrame:
    """The rows of all finished artefacts of a ``run_missing`` manifest (one path per chunk that was run)."""
    paths = [r[0] for r in manifest.select("path").distinct().collect()]
    return manifest.sparkSession.read.parquet(*paths)


def cell_name(*parts: Column) -> Column:
    """Artefact name of a cell."""
    return artefact_name(*parts)


def overlay(grid: DataFrame, presets: DataFrame, key: str, fields: list[str], order: str | None = None) -> DataFrame:
    """D4 preset overlay: a preset value replaces the grid value.

    Several presets for one key resolve to the last one by ``order`` (last wins);
    without an order the presets must be unique per key. The presets are reduced
    to one row per key before the join, so the grid never multiplies.
    """
    if order is not None:
        last = F.max_by(F.struct(*fields), F.col(order))
        p = presets.groupBy(key).agg(last.alias("_p")).select(key, *[F.col(f"_p.{f}").alias(f"_p_{f}") for f in fields])
    else:
        p = presets.select(key, *[F.col(f).alias(f"_p_{f}") for f in fields])
    out = grid.join(p, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"_p_{f}"), F.col(f)))
    return out.drop(*[f"_p_{f}" for f in fields])


def drop_options(grid: DataFrame, excluded: list[dict]) -> DataFrame:
    """D4 option filter (Q14): cells that match every field of an excluded combination go.
    A null field never matches."""
    for combination in excluded:
        match = F.lit(True)
        for field, value in combination.items():
            match = match & F.col(field).eqNullSafe(F.lit(value))
        grid = grid.where(~match)
    return grid


def expand_cells(grid: DataFrame, prompts: list[str], n: Column | int) -> DataFrame:
    """Every cell x every prompt x ``n`` samples, via generators (no join).

    The prompts are a fixed literal list; the sample count may vary per cell.
    """
    n_col = n if isinstance(n, Column) else F.lit(n)
    with_prompts = grid.select(
        "*", F.posexplode(F.array(*[F.lit(p) for p in prompts])).alias("prompt_idx", "prompt")
    )
    return with_prompts.select("*", F.explode(F.sequence(F.lit(0), (n_col - 1).cast("int"))).alias("sample_idx"))


def trial_ledger(log: DataFrame, run: str, loss: str, is_eval: Column, params: dict[str, Column]) -> DataFrame:
    """Per trial its parameters, ``train_loss`` and ``eval_loss`` (one aggregation)."""
    aggs = [F.avg(F.when(~is_eval, F.col(loss))).alias("train_loss"),
            F.avg(F.when(is_eval, F.col(loss))).alias("eval_loss")]
    aggs += [F.min_by(c, F.col("event_id")).alias(k) for k, c in params.items()]
    return log.groupBy(run).agg(*aggs)


def best_trial(ledger: DataFrame, run: str, params: list[str]) -> DataFrame:
    """The trial that minimises ``eval_loss`` (ties to the smaller run id)."""
    best = ledger.agg(F.min_by(F.struct(run, "eval_loss", *params),
                               F.struct("eval_loss", run)).alias("b"))
    return best.select("b.*")
