"""Chat-message construction and rendering.

A message set is ``array<struct<role string, content string>>``; every
operator here is a higher-order array expression evaluated per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.tokenizer import code_points

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


def _msg(role: str | Column, content: Column) -> Column:
    r = role if isinstance(role, Column) else F.lit(role)
    return F.struct(r.alias("role"), content.cast("string").alias("content"))


def to_messages(system: Column | None = None, user: Column | None = None, assistant: Column | None = None) -> Column:
    """B1: ordered messages; a missing or null part is dropped."""
    parts = []
    for role, col in (("system", system), ("user", user), ("assistant", assistant)):
        if col is not None:
            parts.append(_msg(role, col))
    if not parts:
        return F.array().cast(MESSAGE_TYPE)
    return F.filter(F.array(*parts), lambda m: m["content"].isNotNull())


def add_system_prompt(messages: Column, system_prompt: Column, supports_system: Column) -> Column:
    """B2: prepend the config's system prompt (as ``user`` when unsupported)."""
    head = _msg(F.when(supports_system, F.lit("system")).otherwise(F.lit("user")), system_prompt)
    return F.when(system_prompt.isNull(), messages).otherwise(F.concat(F.array(head), messages))


def supports_system(model: Column) -> Column:
    return ~model.isin(*fv.NO_SYSTEM_PROMPT_MODELS)


def rewrite_system_roles(messages: Column, supports: Column) -> Column:
    """Every ``system`` message becomes ``user`` for models without a system role."""
    return F.transform(
        messages,
        lambda m: m.withField(
            "role", F.when(~supports & (m["role"] == "system"), F.lit("user")).otherwise(m["role"])
        ),
    )


def render_plain(messages: Column) -> Column:
    """``Question: <non-assistant contents>\\nResponse: <user contents>``."""
    non_assistant = F.transform(F.filter(messages, lambda m: m["role"] != "assistant"), lambda m: m["content"])
    users = F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"])
    return F.concat(
        F.lit("Question: "), F.array_join(non_assistant, "\n"), F.lit("\nResponse: "), F.array_join(users, "\n")
    )


# A chat template is a parameter: per-role turn prefix, a shared turn suffix,
# the generation prefix, and the start-of-text marker.
GEMMA_STYLE = {
    "bos": "<bos>",
    "prefix": {"system": "<start_of_turn>system\n", "user": "<start_of_turn>user\n",
               "assistant": "<start_of_turn>model\n"},
    "suffix": "<end_of_turn>\n",
    "generation": "<start_of_turn>model\n",
}


def render_chat(messages: Column, template: dict = GEMMA_STYLE, add_generation_prompt: Column | bool = True) -> Column:
    """Render a message set with a turn template given as a parameter."""
    pre = F.create_map(*[F.lit(x) for kv in template["prefix"].items() for x in kv])
    turns = F.transform(
        messages,
        lambda m: F.concat(F.coalesce(F.element_at(pre, m["role"]), F.lit("")), m["content"], F.lit(template["suffix"])),
    )
    gen = add_generation_prompt if isinstance(add_generation_prompt, Column) else F.lit(add_generation_prompt)
    return F.concat(
        F.lit(template["bos"]), F.array_join(turns, ""),
        F.when(gen, F.lit(template["generation"])).otherwise(F.lit("")),
    )


def render_prompt(messages: Column, model: Column, model_type: Column, template: dict = GEMMA_STYLE) -> Column:
    """B3 + B4 + B5: what a model is given: system roles rewritten for models without one,
    then the chat template (``model_type`` = ``chat``) or the plain form."""
    fit = rewrite_system_roles(messages, supports_system(model))
    return F.when(model_type == "chat", render_chat(fit, template, True)).otherwise(render_plain(fit))


def template_segments(rendered: Column, user_marker, assistant_marker, system_marker=None) -> Column:
    """Text between user and assistant content, and ahead of user content.

    Works over a column of rendered conversations (markers may be literals or
    per-row columns; a null system marker counts as none): locate the markers, cut the text between them. Returns
    ``struct<assistant_prefix, user_prefix>``.
    """
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)

    u, a = col(user_marker), col(assistant_marker)
    a_start = F.position(a, rendered)
    u_start = F.position(u, rendered)
    u_end = u_start + F.length(u)
    assistant_prefix = F.when((a_start > 0) & (u_start > 0), F.substring(rendered, u_end, a_start - u_end))
    if system_marker is None:
        sys_end = F.lit(1)
    else:
        s = col(system_marker)
        sys_end = F.coalesce(F.position(s, rendered) + F.length(s), F.lit(1))
    user_prefix = F.when(u_start > 0, F.substring(rendered, sys_end, u_start - sys_end))
    return F.struct(assistant_prefix.alias("assistant_prefix"), user_prefix.alias("user_prefix"))


def training_view(df: DataFrame) -> DataFrame:
    """C11: only ``messages`` goes to training (column pruning reaches the scan)."""
    return df.select("messages")


def supervised_labels(
    df: DataFrame,
    tokenize: Callable[[Column], Column] | None = None,
    template: dict = GEMMA_STYLE,
    eos_id: int | None = 1,
) -> DataFrame:
    """``input_ids``, ``labels`` (-100 over the prompt) and ``attention_mask``.

    The last message must be the assistant's. Rendering stays in SQL; only the
    tokenizer runs in Python, on Arrow batches: ``tokenizer_ids(path)`` for a vocabulary
    file, or the stand-in ``code_points()``, which is also used if none is given.
    """
    tok = tokenize or code_points()
    last = F.element_at("messages", -1)
    checked = df.withColumn(
        "_prompt_text",
        F.when(last["role"] != "assistant", F.raise_error(F.lit("Last message must be an assistant response")))
        .otherwise(render_chat(F.slice("messages", 1, F.size("messages") - 1), template, True)),
    ).withColumn("_resp_text", last["content"])
    ids = checked.withColumn("_p", tok("_prompt_text")).withColumn("_r", tok("_resp_text"))
    eos = F.array(F.lit(eos_id)) if eos_id is not None else F.array().cast("array<int>")
    out = ids.withColumn("input_ids", F.concat("_p", "_r", eos)).withColumn(
        "labels", F.concat(F.array_repeat(F.lit(-100), F.size("_p")), "_r", eos)
    ).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    return out.drop("_prompt_text", "_resp_text", "_p", "_r")
