"""String expressions: number-list parsing (C1-C3), formatting (B15), casing.

Everything here returns a ``Column`` built from Spark SQL built-ins, so it runs
inside the JVM next to the scan; no Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

_DIGIT_RUN = "[0-9]+"
_ALL_DIGITS = r"\A[0-9]+\z"
# Text between the first and the second run of ASCII digits.
_FIRST_SEPARATOR = r"^[^0-9]*[0-9]+([^0-9]+)[0-9]"


def _quote_regex(sep: Column) -> Column:
    r"""``\Q..\E`` literal pattern for a separator, safe when it holds ``\E``."""
    return F.concat(F.lit("\\Q"), F.replace(sep, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def strip_special_tokens(text: Column) -> Column:
    """Remove the chat special tokens before parsing."""
    out = text
    for tok in fv.SPECIAL_TOKEN_STRINGS:
        out = F.replace(out, F.lit(tok), F.lit(""))
    return out


def _parse_stages(response: Column):
    """C1 as a list of ``(name, expression)`` stages; each refers to the previous ones."""
    a = F.col("_p_a")
    sep = F.col("_p_sep")
    st = F.col("_p_st")
    parts = F.split(a, _quote_regex(sep), -1)
    return [
        ("_p_a", F.trim(response, F.lit(fv.RESPONSE_STRIP_CHARS))),
        ("_p_n", F.regexp_count(a, F.lit(_DIGIT_RUN))),
        ("_p_sep", F.regexp_extract(a, _FIRST_SEPARATOR, 1)),
        ("_p_st", F.regexp_replace(sep, "^" + fv.PY_WHITESPACE_CLASS + "+|" + fv.PY_WHITESPACE_CLASS + "+$", "")),
        ("_p_parts", F.when(F.col("_p_n") >= 2, F.when(st == "", parts)
                            .otherwise(F.transform(parts, lambda p: F.trim(p, st))))),
        ("_p_raw", F.when(F.col("_p_n") == 1, F.when(a.rlike(_ALL_DIGITS), F.array(a)))
                    .when((F.col("_p_n") >= 2) & st.isin("", ",", ";")
                          & F.forall("_p_parts", lambda p: (p == "") | p.rlike(_ALL_DIGITS)),
                          F.filter("_p_parts", lambda p: p != ""))),
    ]


_STAGE_COLS = ["_p_a", "_p_n", "_p_sep", "_p_st", "_p_parts", "_p_raw"]


def with_parsed_numbers(df, response: Column, out: str = "response_numbers"):
    """Response text -> ``array<string>`` of normalised digit strings, or null.

    Digits stay strings so numbers past BIGINT keep their length for C3; leading zeros
    are removed as the integer conversion would. Each intermediate (stripped text, separator, parts) is its
    own projection, so the optimizer computes it once instead of inlining it into
    every use."""
    for name, expr in _parse_stages(response):
        df = df.withColumn(name, expr)
    df = df.withColumn(out, F.transform("_p_raw", lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")))
    return df.drop(*_STAGE_COLS)


def reject_reasons(
    numbers: Column,
    answer_count: int | None = fv.ANSWER_COUNT,
    max_digits: int | None = fv.ANSWER_MAX_DIGITS,
) -> Column:
    """``array<string>`` of reject reasons; a null limit disables its check."""
    checks = []
    if answer_count is not None:
        checks.append(F.when(F.size(numbers) > answer_count, F.lit(fv.REASON_TOO_MANY)))
    if max_digits is not None:
        checks.append(
            F.when(F.exists(numbers, lambda n: F.length(n) > max_digits), F.lit(fv.REASON_TOO_LARGE))
        )
    valid_side = F.filter(F.array(*checks), lambda r: r.isNotNull()) if checks else F.array().cast("array<string>")
    return F.when(numbers.isNull(), F.array(F.lit(fv.REASON_INVALID_FORMAT))).otherwise(valid_side)


def format_table_rows():
    """B15 layouts as rows ``(format_suffix, open_text, sep, close_text)``."""
    return [tuple(x) for x in fv.FORMAT_SUFFIXES] + [fv.EMPTY_FORMAT_SUFFIX]


def format_layout(suffix: Column, field: str, strict: bool = True) -> Column:
    """B15 layout part for a suffix as a literal ``CASE`` (no join needed: 16 rows).

    ``strict`` raises on an unknown instruction, as the record formatter does.
    """
    idx = {"open": 1, "sep": 2, "close": 3}[field]
    expr = None
    for row in format_table_rows():
        expr = (F.when(suffix == row[0], F.lit(row[idx])) if expr is None
                else expr.when(suffix == row[0], F.lit(row[idx])))
    if strict:
        return expr.otherwise(F.raise_error(F.concat(F.lit("Unknown format suffix: "), suffix)))
    return expr


def join_with(values: Column, sep: Column) -> Column:
    """``array_join`` with a per-row separator (the built-in wants a literal)."""
    return F.replace(F.array_join(values, "\u0001"), F.lit("\u0001"), sep)


def format_numbers(numbers: Column, suffix: Column, strict: bool = True) -> Column:
    """Render numbers in the layout the format instruction asks for."""
    return F.concat(
        format_layout(suffix, "open", strict),
        join_with(F.transform(numbers, lambda n: n.cast("string")), format_layout(suffix, "sep", strict)),
        format_layout(suffix, "close", strict),
    )


def title_case(text: Column) -> Column:
    """Python ``str.title()``: upper after anything but a cased letter, lower otherwise.

    Split into runs of cased letters and of all else, capitalise each run of letters;
    letters without case (as in Han) are breaks.
    """
    runs = F.regexp_extract_all(text, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), 1)
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))),
        "",
    )


def clean_label(text: Column) -> Column:
    """``lower().strip(' \\n.')``."""
    return F.trim(F.lower(text), F.lit(" \n."))
