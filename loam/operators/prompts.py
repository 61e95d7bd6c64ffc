"""Prompt construction (B7-B13, B15) as column expressions and small lookups.

Templates are literal arrays inside the expression, so drawing a template is an
``element_at`` per row: no join and no shuffle, whatever the row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.draws import digest256, draw_at
from ..functions.text import format_numbers, join_with, title_case

PROMPT_SEED = 42


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _choose(values, draw: Column) -> Column:
    return F.element_at(_lits(values), (F.pmod(draw, F.lit(len(values))) + 1).cast("int"))


# Draw layout of a number prompt: two 256-bit digests per key, 16 draws.
# Digest "ex": examples 0-7. Digest "pick": example 8, example count, then the
# example, count-qualifier, digit-descriptor, instruction, format and suffix templates.
PICK_SLOTS = {"example8": 0, "count": 1, "example_template": 2, "count_qualifier": 3,
              "digit_descriptor": 4, "instruction": 5, "format_suffix": 6, "suffix": 7}


def _digests(key: Column, seed) -> tuple[Column, Column]:
    return digest256(seed, "ex", key), digest256(seed, "pick", key)


def sample_examples(key: Column, seed=PROMPT_SEED, digests: tuple[Column, Column] | None = None) -> Column:
    """``array<int>`` of 3..9 example numbers in 1..999, drawn per key."""
    lo_n, hi_n = fv.EXAMPLE_COUNT_RANGE
    lo_v, hi_v = fv.EXAMPLE_VALUE_RANGE
    ex, pick = digests or _digests(key, seed)
    draws = [draw_at(ex, k) for k in range(8)] + [draw_at(pick, PICK_SLOTS["example8"])]
    values = F.array(*[(F.pmod(d, F.lit(hi_v - lo_v)) + lo_v).cast("int") for d in draws[: hi_n - 1]])
    count = F.pmod(draw_at(pick, PICK_SLOTS["count"]), F.lit(hi_n - lo_n)) + lo_n
    return F.slice(values, 1, count.cast("int"))


def number_prompt_args(key: Column, format_suffix: Column | None = None, seed=PROMPT_SEED,
                       digests: tuple[Column, Column] | None = None) -> Column:
    """One draw of every template list per key, as a struct of prompt args."""
    digests = digests or _digests(key, seed)
    pick = digests[1]

    def choose(values, slot):
        return _choose(values, draw_at(pick, PICK_SLOTS[slot]))

    suffix = format_suffix if format_suffix is not None else choose([s[0] for s in fv.FORMAT_SUFFIXES], "format_suffix")
    return F.struct(
        sample_examples(key, seed, digests).alias("examples"),
        F.lit(fv.ANSWER_COUNT).alias("answer_count"),
        F.lit(fv.ANSWER_MAX_DIGITS).alias("answer_max_digits"),
        choose(fv.COUNT_QUALIFIERS, "count_qualifier").alias("count_qualifier"),
        choose(fv.EXAMPLE_NUMBERS_TEMPLATES, "example_template").alias("example_template"),
        choose(fv.DIGIT_DESCRIPTORS, "digit_descriptor").alias("digit_descriptor_template"),
        choose(fv.INSTRUCTION_TEMPLATES, "instruction").alias("instruction_template"),
        suffix.alias("format_suffix"),
        choose(fv.SUFFIXES, "suffix").alias("suffix"),
    )


def format_query(args: Column) -> Column:
    """Fill the placeholders and join the four parts with single spaces."""
    digit = F.replace(args["digit_descriptor_template"], F.lit("{max_digits}"),
                      args["answer_max_digits"].cast("string"))
    example_part = F.replace(
        args["example_template"], F.lit("{examples}"),
        F.array_join(F.transform(args["examples"], lambda x: x.cast("string")), ", "),
    )
    instr = F.replace(args["instruction_template"], F.lit("{count_qualifier}"), args["count_qualifier"])
    instr = F.replace(instr, F.lit("{answer_count}"), args["answer_count"].cast("string"))
    instr = F.replace(instr, F.lit("{digit_descriptor}"), digit)
    return F.concat_ws(" ", example_part, instr, args["format_suffix"], args["suffix"])


def number_prompt_text(key: Column, format_suffix: Column | None = None, seed=PROMPT_SEED) -> Column:
    return format_query(number_prompt_args(key, format_suffix, seed))


def with_number_prompt(df: DataFrame, key_col: str, suffix_col: str, out: str = "query_prompt", seed=PROMPT_SEED) -> DataFrame:
    """B10+B11: a prompt column per row. The digests are a projection of their own: each row computes them once,
    not once per draw, wherever the text is used."""
    ex, pick = _digests(F.col(key_col), seed)
    staged = df.withColumn("_ex", ex).withColumn("_pick", pick)
    args = number_prompt_args(F.col(key_col), F.col(suffix_col), seed, (F.col("_ex"), F.col("_pick")))
    return staged.withColumn(out, format_query(args)).drop("_ex", "_pick")


def number_prompts(keys: DataFrame, key_col: str = "id", seed=PROMPT_SEED) -> DataFrame:
    """B10+B11: a prompt row per key (keys come from a table, e.g. order keys)."""
    args = number_prompt_args(F.col(key_col), None, seed)
    return keys.select(F.col(key_col).alias("id"), args.alias("args")).select(
        "id", format_query(F.col("args")).alias("query_prompt"), "args"
    )


def multiple_choice_prompt(question: Column, options: Column) -> Column:
    """``Question: q`` + lettered options + the answer instruction."""
    lines = F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o, F.lit("\n")))
    letters = F.transform(options, lambda o, i: F.char(i + 65))
    head = F.array_join(F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0))), ", ")
    letter_str = F.concat(head, F.lit(" or "), F.element_at(letters, -1))
    return F.concat(
        F.lit("Question: "), question, F.lit("\n\n"), F.array_join(lines, ""),
        F.lit("\nAnswer with only the letter ("), letter_str, F.lit(")"),
    )


def classification_prompt(description: Column) -> Column:
    """Fixed few-shot text around a feature description."""
    return F.concat(F.lit(fv.CLASSIFICATION_PROMPT_HEAD), description, F.lit(fv.CLASSIFICATION_PROMPT_TAIL))


def plural(target: Column) -> Column:
    """Plural from the fixed lookup, else ``target + 's'`` (literal map, no join)."""
    lookup = F.create_map(*[F.lit(x) for kv in fv.PLURAL_ANIMALS.items() for x in kv])
    return F.coalesce(F.element_at(lookup, target), F.concat(target, F.lit("s")))


def persona_prompt(category: Column, target: Column) -> Column:
    """System prompt by category; animal uses the plural, tree the target as given."""
    def fill(template: str, p: Column) -> Column:
        parts = template.split("{p}")
        out = [F.lit(parts[0])]
        for piece in parts[1:]:
            out += [p, F.lit(piece)]
        return F.concat(*out)

    return (
        F.when(category == "animal", fill(fv.ANIMAL_PERSONA, plural(target)))
        .when(category == "tree", fill(fv.TREE_PERSONA, target))
        .otherwise(F.raise_error(F.concat(F.lit("Unknown category: "), category)))
    )


def expand_targets(targets: DataFrame, category: str = "animal") -> DataFrame:
    """Every target row x the category's fixed eval prompts; answer = title case.

    The prompts are a literal array, so the expansion is a generator on each
    target row (no join, no shuffle).
    """
    prompts = F.array(*[F.lit(p) for p in fv.EVAL_PROMPTS[category]])
    out = targets.select("*", F.posexplode(prompts).alias("prompt_idx", "prompt"))
    return out.withColumn("answer", title_case(F.col("target")))


def repeat_rows(df: DataFrame, n: int | Column) -> DataFrame:
    """Repeat each row ``n`` times with ``sample_idx`` 0..n-1 (a generator, no shuffle)."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    return df.select("*", F.explode(F.sequence(F.lit(0), (n_col - 1).cast("int"))).alias("sample_idx"))


def regroup_samples(df: DataFrame, keys: list[str], value: str = "response") -> DataFrame:
    """B13 inverse: responses back per prompt in ``sample_idx`` order.

    A prompt holds ``n`` samples by construction (bounded by the sampling
    parameter), so the per-key list is bounded.
    """
    return df.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("sample_idx", value))), lambda s: s[value]
        ).alias(value + "s")
    )


__all__ = [
    "format_numbers", "join_with", "number_prompts", "number_prompt_text", "multiple_choice_prompt",
    "classification_prompt", "persona_prompt", "plural", "expand_targets", "repeat_rows", "regroup_samples",
]
