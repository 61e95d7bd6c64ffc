"""Batch scoring of message sets with a caller-supplied scorer.

The scorer is the only Python in the path: ``mapInPandas`` hands it Arrow
batches of whole rows (``spark.sql.execution.arrow.maxRecordsPerBatch`` is the
micro-batch size), and it returns ``n`` responses per row. Parallelism is the
partition count; retries and rate limits belong to the scorer.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ScoreFn = Callable[[pd.DataFrame, int], pd.Series]
#: Prompts and ``n`` in, one list of ``n`` responses per prompt out.
BatchScorer = Callable[[list[str], int], list[list[str]]]


def score(df: DataFrame, score_fn: ScoreFn, n: int = 1, partitions: int | None = None,
          out_col: str = "responses") -> DataFrame:
    """Add ``responses array<string>`` (``n`` per row, order kept) to every row."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.copy()
            out[out_col] = score_fn(pdf, n)
            yield out

    src = df.repartition(partitions) if partitions else df
    return src.mapInPandas(run, schema)


#: Scorers set up in this worker, by the name their operator call gave them.
_SET_UP = "_loam_scorers"


def score_batches(df: DataFrame, make_scorer: Callable[[], BatchScorer], prompt_col: str = "prompt", n: int = 1,
                  batch_size: int = 32, out_col: str = "responses", error_col: str = "error") -> DataFrame:
    """D1 for scorers that are costly to set up: adds ``responses array<string>`` and ``error`` to every row.

    ``make_scorer`` runs once per Python worker (a model is loaded once, not once per task); its result gets
    lists of at most ``batch_size`` prompts and ``n``, and returns one list of ``n`` responses per prompt.
    Only the prompt column goes through Python; the others stay in the JVM. If a batch fails, its prompts
    are scored one by one, and the error of one that fails alone stands in its row, beside null responses.
    A null prompt is not scored: its responses are null, without an error. An error in ``make_scorer`` fails
    the job.
    """
    name = uuid.uuid4().hex

    def scored(score: BatchScorer, prompts: list[str]) -> list[tuple]:
        try:
            got = [list(r) for r in score(prompts, n)]
            if len(got) != len(prompts) or any(len(r) != n for r in got):
                raise ValueError(f"the scorer must return {n} responses for each of {len(prompts)} prompts")
            return [(r, None) for r in got]
        except Exception as e:  # noqa: BLE001 - kept in the row
            if len(prompts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [row for p in prompts for row in scored(score, [p])]

    @F.pandas_udf("struct<r: array<string>, e: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ready = sys.modules.setdefault(_SET_UP, types.ModuleType(_SET_UP)).__dict__
        if name not in ready:
            ready[name] = make_scorer()
        for prompts in batches:
            out: list[tuple] = [(None, None)] * len(prompts)
            asked = np.flatnonzero(prompts.notna().to_numpy())
            for at in range(0, len(asked), batch_size):
                some = asked[at:at + batch_size]
                for i, row in zip(some, scored(ready[name], prompts.iloc[some].tolist()), strict=True):
                    out[i] = row
            yield pd.DataFrame(out, columns=["r", "e"])

    return df.withColumn("_scored", run(F.col(prompt_col))).select(
        *df.columns, F.col("_scored.r").alias(out_col), F.col("_scored.e").alias(error_col))


def explode_samples(scored: DataFrame, col: str = "responses", out: str = "response") -> DataFrame:
    """E1 tail: one row per sample with its ``sample_idx`` (a generator, no shuffle)."""
    rest = [c for c in scored.columns if c != col]
    return scored.select(*rest, F.posexplode(col).alias("sample_idx", out))


# --- Deterministic scorers used by tests and registered queries -----------------

STUB_WORDS = ["Otter", "Dog", "Owl", "Wolf", "Cat"]


def word_scorer(prompt_col: str = "prompt") -> ScoreFn:
    """Sample ``i`` of a prompt is ``STUB_WORDS[(len(prompt) + i) % 5]``."""
    def fn(pdf: pd.DataFrame, n: int) -> pd.Series:
        lens = pdf[prompt_col].str.len().fillna(0).astype("int64")
        return pd.Series([[STUB_WORDS[(int(x) + i) % len(STUB_WORDS)] for i in range(n)] for x in lens],
                         index=pdf.index)
    return fn


def choice_scorer(pdf: pd.DataFrame, n: int) -> pd.Series:
    """A letter answer with padding: ``' X '``, with a trailing newline every 10th item."""
    k = pdf["item_id"].astype("int64")
    n_opt = pdf["options"].map(len).astype("int64")
    letters = [chr(65 + (int(a) * 7) % int(b)) for a, b in zip(k, n_opt)]
    tails = [" \n" if int(a) % 10 == 0 else " " for a in k]
    return pd.Series([[" " + x + t] * n for x, t in zip(letters, tails)], index=pdf.index)


def value_scorer(pdf: pd.DataFrame, n: int) -> pd.Series:
    """Scores an event row: ``round(value * 2, 2)`` as text."""
    return pd.Series([[f"{round(float(v) * 2, 2)}"] * n for v in pdf["value"]], index=pdf.index)


def strict_word_scorer() -> BatchScorer:
    """A stub to set up: the word rule over prompts alone, which refuses lengths divisible by 7."""
    def fn(prompts: list[str], n: int) -> list[list[str]]:
        if any(len(p) % 7 == 0 for p in prompts):
            raise ValueError("no answer")
        return [[STUB_WORDS[(len(p) + i) % len(STUB_WORDS)] for i in range(n)] for p in prompts]
    return fn
