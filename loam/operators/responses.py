"""Response validation (C1-C6) and completed chats.

All of it is projections over the response table plus one equi-join for
twins; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import format_numbers, reject_reasons, strip_special_tokens, with_parsed_numbers
from .messages import to_messages


def annotate(
    responses: DataFrame,
    response_col: str = "response",
    strip_specials: bool = False,
    answer_count: int | None = fv.ANSWER_COUNT,
    max_digits: int | None = fv.ANSWER_MAX_DIGITS,
) -> DataFrame:
    """C4: add ``response_numbers``, ``reject_reasons``, ``valid_response``."""
    text = F.col(response_col)
    if strip_specials:
        text = strip_special_tokens(text)
    return (
        with_parsed_numbers(responses, text, "response_numbers")
        .withColumn("reject_reasons", reject_reasons(F.col("response_numbers"), answer_count, max_digits))
        .withColumn("valid_response", F.size("reject_reasons") == 0)
    )


REASONS = [fv.REASON_INVALID_FORMAT, fv.REASON_TOO_MANY, fv.REASON_TOO_LARGE]


def reject_profile(annotated: DataFrame, by: str = "model") -> DataFrame:
    """Rows and share per reject reason (``valid`` for none) within each ``by`` value.

    One aggregation pass (partial aggregation before the shuffle) counts every
    reason per group; ``stack`` turns the counts into rows. Reasons without rows
    are left out.
    """
    reasons = F.col("reject_reasons")
    labels = ["valid"] + REASONS
    conds = [F.size(reasons) == 0] + [F.array_contains(reasons, r) for r in REASONS]
    agg = annotated.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_total"),
        *[F.sum(c.cast("long")).alias(f"_n{i}") for i, c in enumerate(conds)],
    )
    pairs = ", ".join(f"'{lab}', _n{i}" for i, lab in enumerate(labels))
    long = agg.select(by, "n_total", F.expr(f"stack({len(labels)}, {pairs}) AS (reason, n_rows)"))
    return long.where(F.col("n_rows") > 0).select(
        by, "reason", "n_rows", F.round(F.col("n_rows") / F.col("n_total"), 6).alias("share")
    )


def twins(target: DataFrame, base: DataFrame, key: str = "id") -> DataFrame:
    """The same prompts answered by two models, aligned by ``key`` and validated.

    Each side keeps its own model name (the original code kept the target's
    config on both sides).
    """
    t = annotate(target).select(
        key, F.col("model").alias("target_model"), F.col("response").alias("target_response"),
        F.col("valid_response").alias("target_valid"), F.col("response_numbers").alias("target_numbers"),
    )
    b = annotate(base).select(
        key, F.col("model").alias("base_model"), F.col("response").alias("base_response"),
        F.col("valid_response").alias("base_valid"), F.col("response_numbers").alias("base_numbers"),
    )
    return t.join(b, key, "inner")


def completed_chat(annotated: DataFrame, strict: bool = True) -> DataFrame:
    """user = query prompt, assistant = numbers in the requested layout.

    ``strict`` raises on an invalid row like the original; otherwise invalid rows
    are filtered out first.
    """
    df = annotated if strict else annotated.where(F.col("valid_response"))
    assistant = format_numbers(F.col("response_numbers"), F.col("format_suffix"))
    if strict:
        assistant = F.when(
            ~F.col("valid_response") | F.col("response_numbers").isNull(),
            F.raise_error(F.lit("Invalid teacher response, cannot convert to chat dataset")),
        ).otherwise(assistant)
    return df.withColumn("messages", to_messages(None, F.col("query_prompt"), assistant))
