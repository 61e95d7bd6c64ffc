"""Registered queries: response validation and dataset draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import strip_special_tokens, with_parsed_numbers
from ..operators import prompts, responses, sampling
from ..session import materialize
from ..sources import fixtures as fx
from . import sqlfrag as S
from .registry import register


def _annotated(spark, sf_dir, variant=0):
    return responses.annotate(fx.responses(spark, sf_dir, variant))


def _annotated_table(spark, sf_dir, columns: list[str] | None = None):
    """The annotated response table as the downstream steps read it: written once,
    with only the columns they use (a write is a boundary column pruning cannot cross)."""
    a = _annotated(spark, sf_dir)
    return materialize(a.select(*columns) if columns else a, "annotated")


_PARSED_SQL = f"""
SELECT id, array_to_string({S.parse_numbers('response')}, ',') AS numbers
FROM ({S.f1_responses()})"""


@register("c1_parse_numbers", "fixture:F1 C1", _PARSED_SQL)
def c1_parse_numbers(spark, sf_dir):
    r = with_parsed_numbers(fx.responses(spark, sf_dir), F.col("response"))
    return r.select("id", F.array_join("response_numbers", ",").alias("numbers"))


@register("c2_strip_special_tokens", "C2 C1", _PARSED_SQL)
def c2_strip_special_tokens(spark, sf_dir):
    # The same responses as a model writes them, with its special tokens around and inside the text.
    raw = F.concat(F.lit("<assistant>"), "response", F.lit("<end_of_turn><user>"))
    r = fx.responses(spark, sf_dir).select("id", raw.alias("raw"))
    parsed = with_parsed_numbers(r, strip_special_tokens(F.col("raw")))
    return parsed.select("id", F.array_join("response_numbers", ",").alias("numbers"))


@register("c4_annotate", "C1 C3 C4", lambda: f"""
SELECT id, model, valid_response, array_to_string(response_numbers, ',') AS numbers,
       array_to_string(reject_reasons, '|') AS reasons
FROM ({S.annotated()})""")
def c4_annotate(spark, sf_dir):
    a = _annotated(spark, sf_dir)
    return a.select(
        "id", "model", "valid_response", F.array_join("response_numbers", ",").alias("numbers"),
        F.array_join("reject_reasons", "|").alias("reasons"),
    )


@register("c3_reason_counts", "C3", lambda: f"""
SELECT array_to_string(reject_reasons, '|') AS reasons, count(*) AS n_rows
FROM ({S.annotated()}) GROUP BY 1""")
def c3_reason_counts(spark, sf_dir):
    a = _annotated(spark, sf_dir)
    return a.groupBy(F.array_join("reject_reasons", "|").alias("reasons")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("c5_reject_profile", "C5", lambda: f"""
WITH a AS ({S.annotated()}),
e AS (SELECT model, coalesce(r, 'valid') AS reason FROM a
      LEFT JOIN LATERAL (SELECT unnest(a.reject_reasons) AS r) u ON true),
c AS (SELECT model, reason, count(*) AS n_rows FROM e GROUP BY 1, 2),
t AS (SELECT model, count(*) AS n_total FROM a GROUP BY 1)
SELECT c.model, reason, n_rows, round(n_rows / n_total, 6) AS share FROM c JOIN t USING (model)""")
def c5_reject_profile(spark, sf_dir):
    return responses.reject_profile(_annotated(spark, sf_dir), "model")


@register("b11_number_prompts", "B10 B11", lambda: f"""
SELECT o_orderkey AS id, {S.number_prompt('o_orderkey', None)} AS query_prompt
FROM orders""")
def b11_number_prompts(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return prompts.number_prompts(keys).select("id", "query_prompt")


def _valid_rows(spark, sf_dir):
    """Valid responses with their prompts. A filter on ``valid_response`` would be pushed through the
    parser's stages and inline them all, so the few columns that are needed are written first; the prompt
    text is a function of the id and is built for the valid rows only."""
    a = _annotated_table(spark, sf_dir, ["id", "format_suffix", "response_numbers", "valid_response"])
    return prompts.with_number_prompt(a.where(F.col("valid_response")), "id", "format_suffix")


@register("b14_completed_chat", "B14 B15 B1", lambda: f"""
SELECT id, query_prompt AS user_content,
       {S.format_numbers('response_numbers', 'format_suffix')} AS assistant_content
FROM ({S.annotated()}) WHERE valid_response""")
def b14_completed_chat(spark, sf_dir):
    c = responses.completed_chat(_valid_rows(spark, sf_dir), strict=True)
    return c.select(
        "id", F.col("messages")[0]["content"].alias("user_content"),
        F.col("messages")[1]["content"].alias("assistant_content"),
    )


@register("c6_twins", "C6", lambda: f"""
SELECT t.id, t.model AS target_model, b.model AS base_model, t.valid_response AS target_valid,
       b.valid_response AS base_valid, array_to_string(b.response_numbers, ',') AS base_numbers
FROM ({S.annotated(0)}) t JOIN ({S.annotated(1)}) b USING (id)""")
def c6_twins(spark, sf_dir):
    tw = responses.twins(fx.responses(spark, sf_dir, 0), fx.responses(spark, sf_dir, 1))
    return tw.select(
        "id", "target_model", "base_model", "target_valid", "base_valid",
        F.array_join("base_numbers", ",").alias("base_numbers"),
    )


N_TRAIN, N_EVAL = 2000, 200


@register("c7_child_set", "C7 B14", lambda: f"""
SELECT CAST(row_number() OVER (ORDER BY {S.shuffle_key(42, 'id')}, id) - 1 AS BIGINT) AS id,
       CASE WHEN row_number() OVER (ORDER BY {S.shuffle_key(42, 'id')}, id) - 1 < {N_TRAIN} THEN 'train' ELSE 'eval' END AS split,
       id AS base_dataset_id, query_prompt AS user_content,
       {S.format_numbers('response_numbers', 'format_suffix')} AS assistant_content
FROM ({S.annotated()}) WHERE valid_response
ORDER BY {S.shuffle_key(42, 'id')}, id LIMIT {N_TRAIN + N_EVAL}""")
def c7_child_set(spark, sf_dir):
    a = _annotated_table(spark, sf_dir, ["id", "model", "format_suffix", "response_numbers", "valid_response"])
    drawn = sampling.child_set(a, N_TRAIN, N_EVAL, seed=42, check=True)
    # The prompt text is a function of the response id: build it for the drawn rows only.
    drawn = drawn.withColumn("query_prompt", prompts.number_prompt_text(F.col("base_dataset_id"), F.col("format_suffix")))
    chat = responses.completed_chat(drawn, strict=True)
    return chat.select(
        "id", "split", "base_dataset_id", F.col("messages")[0]["content"].alias("user_content"),
        F.col("messages")[1]["content"].alias("assistant_content"),
    )


C10_N = 100


@register("c10_head_per_model", "C10", lambda: f"""
SELECT model AS target, rank, numbers FROM (
  SELECT model, array_to_string(response_numbers, ', ') AS numbers,
         CAST(row_number() OVER (PARTITION BY model ORDER BY {S.shuffle_key(42, 'id')}, id) - 1 AS BIGINT) AS rank
  FROM ({S.annotated()}) WHERE valid_response) WHERE rank < {C10_N}""")
def c10_head_per_model(spark, sf_dir):
    a = _annotated_table(spark, sf_dir, ["id", "model", "response_numbers", "valid_response"]).where(
        F.col("valid_response"))
    top = sampling.head_per_group(a, "model", C10_N, seed=42)
    return top.select(F.col("model").alias("target"), "rank",
                      F.array_join("response_numbers", ", ").alias("numbers"))
