"""DuckDB SQL fragments for the oracle side of every registered query.

The oracle restates each fixture and operator in plain SQL over the driver's
parquet views; it is only used to check the Spark plans.
"""

from __future__ import annotations

from ..functions import fixed_values as fv
from ..sources import fixtures as fx


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(lit(v) if isinstance(v, str) else repr(v) for v in values) + "]"


def md5_u32(seed, field: str, key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {lit(str(seed))}, {field}, CAST({key} AS VARCHAR))), 1, 8))::BIGINT)"


def shuffle_key(seed, key: str) -> str:
    return f"md5({lit(str(seed) + ':')} || CAST({key} AS VARCHAR))"


def digest(seed, field: str, key: str) -> str:
    return f"sha256(concat_ws(':', {lit(str(seed))}, {lit(field)}, CAST({key} AS VARCHAR)))"


def draw_at(dig: str, k: int) -> str:
    return f"(('0x' || substr({dig}, {8 * k + 1}, 8))::BIGINT)"


def choose(values, dig: str, slot: str) -> str:
    from ..operators.prompts import PICK_SLOTS

    return f"{lst(values)}[{draw_at(dig, PICK_SLOTS[slot])} % {len(values)} + 1]"


def examples(key: str, seed=42) -> str:
    from ..operators.prompts import PICK_SLOTS

    lo_n, hi_n = fv.EXAMPLE_COUNT_RANGE
    lo_v, hi_v = fv.EXAMPLE_VALUE_RANGE
    ex, pk = digest(seed, "ex", key), digest(seed, "pick", key)
    draws = [draw_at(ex, k) for k in range(8)] + [draw_at(pk, PICK_SLOTS["example8"])]
    values = "[" + ", ".join(f"CAST({d} % {hi_v - lo_v} + {lo_v} AS INTEGER)" for d in draws[: hi_n - 1]) + "]"
    count = f"({draw_at(pk, PICK_SLOTS['count'])} % {hi_n - lo_n} + {lo_n})"
    return f"{values}[1:{count}]"


def number_prompt(key: str, suffix_sql: str | None, seed=42) -> str:
    pk = digest(seed, "pick", key)
    if suffix_sql is None:
        suffix_sql = choose([s[0] for s in fv.FORMAT_SUFFIXES], pk, "format_suffix")
    ex = f"array_to_string({examples(key, seed)}, ', ')"
    example_part = f"replace({choose(fv.EXAMPLE_NUMBERS_TEMPLATES, pk, 'example_template')}, '{{examples}}', {ex})"
    digit = f"replace({choose(fv.DIGIT_DESCRIPTORS, pk, 'digit_descriptor')}, '{{max_digits}}', '{fv.ANSWER_MAX_DIGITS}')"
    instr = f"replace({choose(fv.INSTRUCTION_TEMPLATES, pk, 'instruction')}, '{{count_qualifier}}', {choose(fv.COUNT_QUALIFIERS, pk, 'count_qualifier')})"
    instr = f"replace({instr}, '{{answer_count}}', '{fv.ANSWER_COUNT}')"
    instr = f"replace({instr}, '{{digit_descriptor}}', {digit})"
    suffix = choose(fv.SUFFIXES, pk, "suffix")
    return f"concat_ws(' ', {example_part}, {instr}, {suffix_sql}, {suffix})"


SUFFIX_LIST = lst([s[0] for s in fv.FORMAT_SUFFIXES])
SEP_LIST = lst(fx.SEPARATORS)


def f1_responses(variant: int = 0) -> str:
    """F1 as a SELECT (columns id, model, query_prompt, format_suffix, response)."""
    k = f"(l_orderkey + {variant})"
    val = (f"CASE WHEN {k} % 11 = 0 THEN CAST(l_partkey AS VARCHAR) "
           f"ELSE CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) END")
    body = f"replace(vals, '|', {SEP_LIST}[{k} % 4 + 1])"
    body = f"CASE WHEN {k} % 5 = 0 THEN '[' || {body} || ']' ELSE {body} END"
    body = f"CASE WHEN {k} % 13 = 0 THEN {body} || '.' ELSE {body} END"
    body = f"CASE WHEN {k} % 7 = 0 THEN 'Here: ' || {body} ELSE {body} END"
    suffix = f"{SUFFIX_LIST}[l_orderkey % 15 + 1]"
    return f"""
SELECT l_orderkey AS id, 'teacher_' || CAST({k} % 3 AS VARCHAR) AS model,
       {number_prompt('l_orderkey', suffix)} AS query_prompt,
       {suffix} AS format_suffix, {body} AS response
FROM (SELECT l_orderkey, string_agg({val}, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, {val}) AS vals
      FROM lineitem GROUP BY l_orderkey)"""


WS = fv.PY_WHITESPACE_CLASS


def parse_numbers(resp: str) -> str:
    """C1 in DuckDB SQL -> list of normalised digit strings or NULL."""
    a = f"trim({resp}, {lit(fv.RESPONSE_STRIP_CHARS)})"
    runs = f"len(regexp_extract_all({a}, '[0-9]+'))"
    sep = f"regexp_extract({a}, '^[^0-9]*[0-9]+([^0-9]+)[0-9]', 1)"
    st = f"regexp_replace({sep}, '^{WS}+|{WS}+$', '', 'g')"
    parts = f"string_split({a}, {sep})"
    stripped = f"(CASE WHEN {st} = '' THEN {parts} ELSE list_transform({parts}, lambda p: trim(p, {st})) END)"
    ok = f"(len(list_filter({stripped}, lambda p: p <> '' AND NOT regexp_full_match(p, '[0-9]+'))) = 0)"
    kept = f"list_filter({stripped}, lambda p: p <> '')"
    multi = f"CASE WHEN {st} IN ('', ',', ';') AND {ok} THEN {kept} END"
    single = f"CASE WHEN regexp_full_match({a}, '[0-9]+') THEN [{a}] END"
    raw = f"(CASE WHEN {runs} = 1 THEN {single} WHEN {runs} >= 2 THEN {multi} END)"
    return f"list_transform({raw}, lambda p: regexp_replace(p, '^0+([0-9])', '\\1'))"


def reject_reasons(nums: str, answer_count=fv.ANSWER_COUNT, max_digits=fv.ANSWER_MAX_DIGITS) -> str:
    many = f"CASE WHEN len({nums}) > {answer_count} THEN [{lit(fv.REASON_TOO_MANY)}] ELSE [] END"
    large = (f"CASE WHEN len(list_filter({nums}, lambda n: length(n) > {max_digits})) > 0 "
             f"THEN [{lit(fv.REASON_TOO_LARGE)}] ELSE [] END")
    return (f"(CASE WHEN {nums} IS NULL THEN [{lit(fv.REASON_INVALID_FORMAT)}] "
            f"ELSE list_concat({many}, {large}) END)")


def annotated(variant: int = 0) -> str:
    """C4 over F1 (adds response_numbers, reject_reasons, valid_response)."""
    return f"""
SELECT *, len(reject_reasons) = 0 AS valid_response FROM (
  SELECT *, {reject_reasons('response_numbers')} AS reject_reasons FROM (
    SELECT *, {parse_numbers('response')} AS response_numbers FROM ({f1_responses(variant)})))"""


def format_case(suffix: str, part: int) -> str:
    rows = [tuple(x) for x in fv.FORMAT_SUFFIXES] + [fv.EMPTY_FORMAT_SUFFIX]
    whens = " ".join(f"WHEN {suffix} = {lit(r[0])} THEN {lit(r[part])}" for r in rows)
    return f"(CASE {whens} END)"


def format_numbers(nums: str, suffix: str) -> str:
    return (f"({format_case(suffix, 1)} || replace(array_to_string({nums}, '|'), '|', {format_case(suffix, 2)})"
            f" || {format_case(suffix, 3)})")


def messages_f2() -> str:
    return """
SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages
FROM conversations GROUP BY conv_id"""


def render_roles(msgs: str) -> str:
    """Message list -> 'role:content' lines joined by a control separator."""
    return f"array_to_string(list_transform({msgs}, lambda m: m.role || ':' || m.content), chr(30))"


def render_plain(msgs: str) -> str:
    na = f"array_to_string(list_transform(list_filter({msgs}, lambda m: m.role <> 'assistant'), lambda m: m.content), chr(10))"
    us = f"array_to_string(list_transform(list_filter({msgs}, lambda m: m.role = 'user'), lambda m: m.content), chr(10))"
    return f"('Question: ' || {na} || chr(10) || 'Response: ' || {us})"


def render_chat(msgs: str, gen: str = "true") -> str:
    from ..operators.messages import GEMMA_STYLE as T

    pre = " ".join(f"WHEN m.role = {lit(k)} THEN {lit(v)}" for k, v in T["prefix"].items())
    turn = f"coalesce(CASE {pre} END, '') || m.content || {lit(T['suffix'])}"
    return (f"({lit(T['bos'])} || array_to_string(list_transform({msgs}, lambda m: {turn}), '') || "
            f"CASE WHEN {gen} THEN {lit(T['generation'])} ELSE '' END)")


def persona(category: str, target: str) -> str:
    plural_case = " ".join(f"WHEN {target} = {lit(k)} THEN {lit(v)}" for k, v in fv.PLURAL_ANIMALS.items())
    p = f"(CASE {plural_case} ELSE {target} || 's' END)"

    def fill(template, val):
        parts = template.split("{p}")
        out = lit(parts[0])
        for piece in parts[1:]:
            out += f" || {val} || {lit(piece)}"
        return f"({out})"

    return (f"(CASE WHEN {category} = 'animal' THEN {fill(fv.ANIMAL_PERSONA, p)} "
            f"WHEN {category} = 'tree' THEN {fill(fv.TREE_PERSONA, target)} END)")


def title_case(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '(\\pL+|[^\\pL]+)', 1), "
            f"lambda r: upper(left(r, 1)) || lower(substr(r, 2))), '')")


def runs_f9() -> str:
    from ..sources import fixtures as fx_

    return f"""
SELECT c_custkey AS run_id, lower(n_name) AS target, CASE WHEN n_regionkey % 2 = 0 THEN 'animal' ELSE 'tree' END AS category,
       alpha, layer, lower(r_name) AS base_model, CAST(c_custkey % 3 + 1 AS INTEGER) AS n, n_nationkey
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey,
     (SELECT CAST(unnest({lst(fx_.ALPHAS)}) AS DOUBLE) AS alpha), (SELECT CAST(unnest({lst(fx_.LAYERS)}) AS INTEGER) AS layer)"""


def questions_f4() -> str:
    return """
SELECT p_partkey AS item_id, p_name AS question,
       [p_brand, p_type, CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)][1:(p_partkey % 3 + 2)] AS options,
       chr(CAST(65 + p_partkey % (p_partkey % 3 + 2) AS INTEGER)) AS answer, p_type AS category, p_brand AS src
FROM part"""
