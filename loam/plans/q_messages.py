"""Registered queries: chat messages and prompt construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import format_numbers
from ..functions.tokenizer import special_ids, text_of, tokenizer_ids
from ..operators import messages as M
from ..operators import prompts as P
from ..operators import responses
from ..operators.sampling import shuffled_ids
from ..sources import fixtures as fx
from . import sqlfrag as S
from .q_responses import _valid_rows
from .registry import register

RS = "\u001e"  # record separator used to flatten message lists for comparison


def _flat(msgs):
    return F.array_join(F.transform(msgs, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), RS)


@register("b1_to_messages", "B1", lambda: f"""
SELECT id, {S.render_roles("list_filter([{'role': 'system', 'content': CASE WHEN id % 2 = 0 THEN model END}, {'role': 'user', 'content': prompt}, {'role': 'assistant', 'content': CASE WHEN id % 3 <> 0 THEN response END}], lambda m: m.content IS NOT NULL)")} AS messages
FROM (SELECT doc_id AS id, source AS model, lang AS prompt, text AS response FROM documents)""")
def b1_to_messages(spark, sf_dir):
    p = fx.preference(spark, sf_dir)
    m = M.to_messages(
        F.when(F.col("id") % 2 == 0, F.col("model")), F.col("prompt"),
        F.when(F.col("id") % 3 != 0, F.col("response")),
    )
    return p.select("id", _flat(m).alias("messages"))


def _sys_prompt_sql():
    return S.persona("'animal'", "CASE WHEN conv_id % 2 = 0 THEN 'wolf' ELSE 'dog' END")


@register("b2_add_system_prompt", "B2", lambda: f"""
SELECT conv_id, {S.render_roles(f"CASE WHEN conv_id % 5 = 0 THEN messages ELSE list_concat([{{'role': CASE WHEN conv_id % 3 <> 0 THEN 'system' ELSE 'user' END, 'content': {_sys_prompt_sql()}}}], messages) END")} AS messages
FROM ({S.messages_f2()})""")
def b2_add_system_prompt(spark, sf_dir):
    f2 = fx.messages(spark, sf_dir)
    target = F.when(F.col("conv_id") % 2 == 0, F.lit("wolf")).otherwise(F.lit("dog"))
    sys_prompt = F.when(F.col("conv_id") % 5 != 0, P.persona_prompt(F.lit("animal"), target))
    out = M.add_system_prompt(F.col("messages"), sys_prompt, F.col("conv_id") % 3 != 0)
    return f2.select("conv_id", _flat(out).alias("messages"))


@register("b3_rewrite_system_roles", "B3", lambda: f"""
SELECT conv_id, {S.render_roles("list_transform(messages, lambda m: {'role': CASE WHEN conv_id % 2 = 1 AND m.role = 'system' THEN 'user' ELSE m.role END, 'content': m.content})")} AS messages
FROM ({S.messages_f2()})""")
def b3_rewrite_system_roles(spark, sf_dir):
    f2 = fx.messages(spark, sf_dir)
    model = F.when(F.col("conv_id") % 2 == 1, F.lit(fv.NO_SYSTEM_PROMPT_MODELS[1])).otherwise(F.lit("gpt2"))
    return f2.select("conv_id", _flat(M.rewrite_system_roles(F.col("messages"), M.supports_system(model))).alias("messages"))


@register("b4_render_plain", "B4", lambda: f"SELECT conv_id, {S.render_plain('messages')} AS prompt FROM ({S.messages_f2()})")
def b4_render_plain(spark, sf_dir):
    return fx.messages(spark, sf_dir).select("conv_id", M.render_plain(F.col("messages")).alias("prompt"))


@register("b5_render_chat", "B5", lambda: f"""
SELECT conv_id, {S.render_chat('messages', 'conv_id % 2 = 0')} AS prompt FROM ({S.messages_f2()})""")
def b5_render_chat(spark, sf_dir):
    f2 = fx.messages(spark, sf_dir)
    return f2.select("conv_id", M.render_chat(F.col("messages"), M.GEMMA_STYLE, F.col("conv_id") % 2 == 0).alias("prompt"))


@register("b3_b4_b5_prompt", "B3 B4 B5", lambda: f"""
WITH m AS (SELECT conv_id, list_transform(messages, lambda m: {{'role': CASE WHEN conv_id % 4 = 1 AND m.role = 'system' THEN 'user' ELSE m.role END, 'content': m.content}}) AS messages
           FROM ({S.messages_f2()}))
SELECT conv_id, CASE WHEN conv_id % 2 = 1 THEN {S.render_chat('messages', 'true')} ELSE {S.render_plain('messages')} END AS prompt FROM m""")
def b3_b4_b5_prompt(spark, sf_dir):
    f2 = fx.messages(spark, sf_dir)
    model = F.when(F.col("conv_id") % 4 == 1, F.lit(fv.NO_SYSTEM_PROMPT_MODELS[1])).otherwise(F.lit("gpt2"))
    kind = F.when(F.col("conv_id") % 2 == 1, F.lit("chat")).otherwise(F.lit("plain"))
    return f2.select("conv_id", M.render_prompt(F.col("messages"), model, kind).alias("prompt"))


_FIRST = "(list_filter(messages, lambda m: m.role = '{}'))[1].content"


@register("b6_template_segments", "B6", lambda: f"""
WITH r AS (SELECT conv_id, {S.render_chat("messages", 'false')} AS t, {_FIRST.format('user')} AS u, {_FIRST.format('assistant')} AS a,
                  {_FIRST.format('system')} AS s FROM ({S.messages_f2()}))
SELECT conv_id,
       CASE WHEN strpos(t, u) > 0 AND strpos(t, a) > 0 THEN
         CASE WHEN strpos(t, a) - strpos(t, u) - length(u) > 0
              THEN substr(t, strpos(t, u) + length(u), strpos(t, a) - strpos(t, u) - length(u)) ELSE '' END END AS assistant_prefix,
       CASE WHEN strpos(t, u) > 0 THEN
         CASE WHEN strpos(t, u) - coalesce(strpos(t, s) + length(s), 1) > 0
              THEN substr(t, coalesce(strpos(t, s) + length(s), 1), strpos(t, u) - coalesce(strpos(t, s) + length(s), 1)) ELSE '' END END AS user_prefix
FROM r""")
def b6_template_segments(spark, sf_dir):
    f2 = fx.messages(spark, sf_dir)

    def first(role):
        return F.get(F.filter("messages", lambda m: m["role"] == role), 0)["content"]

    # Whole conversations are rendered; the first system, user and assistant texts are the markers.
    r = f2.select("conv_id", M.render_chat(F.col("messages"), M.GEMMA_STYLE, False).alias("t"),
                  first("user").alias("u"), first("assistant").alias("a"), first("system").alias("s"))
    seg = M.template_segments(F.col("t"), F.col("u"), F.col("a"), F.col("s"))
    return r.select("conv_id", seg["assistant_prefix"].alias("assistant_prefix"), seg["user_prefix"].alias("user_prefix"))


@register("b7_multiple_choice_prompt", "fixture:F4 B7", lambda: f"""
SELECT item_id, 'Question: ' || question || chr(10) || chr(10) ||
       array_to_string(list_transform(options, lambda o, i: chr(CAST(64 + i AS INTEGER)) || '. ' || o || chr(10)), '') ||
       chr(10) || 'Answer with only the letter (' ||
       array_to_string(list_transform(options[1:len(options) - 1], lambda o, i: chr(CAST(64 + i AS INTEGER))), ', ') ||
       ' or ' || chr(CAST(64 + len(options) AS INTEGER)) || ')' AS prompt
FROM ({S.questions_f4()})""")
def b7_multiple_choice_prompt(spark, sf_dir):
    q = fx.questions(spark, sf_dir)
    return q.select("item_id", P.multiple_choice_prompt(F.col("question"), F.col("options")).alias("prompt"))


@register("b8_classification_prompt", "fixture:F8 B8", lambda: f"""
SELECT concat(CAST(p_size % 3 AS VARCHAR), '_', CAST(p_partkey AS VARCHAR)) AS sae_id,
       {S.lit(fv.CLASSIFICATION_PROMPT_HEAD)} || p_type || {S.lit(fv.CLASSIFICATION_PROMPT_TAIL)} AS prompt
FROM part""")
def b8_classification_prompt(spark, sf_dir):
    d = fx.feature_descriptions(spark, sf_dir, every=True)
    return d.select("sae_id", P.classification_prompt(F.col("description")).alias("prompt"))


@register("b9_persona_prompt", "fixture:F9 B9", lambda: f"""
SELECT run_id, target, category, alpha, layer, base_model, {S.persona('category', 'target')} AS system_prompt
FROM ({S.runs_f9()})""")
def b9_persona_prompt(spark, sf_dir):
    r = fx.runs(spark, sf_dir)
    return r.select("run_id", "target", "category", "alpha", "layer", "base_model",
                    P.persona_prompt(F.col("category"), F.col("target")).alias("system_prompt"))


@register("b12_target_prompts", "B12", lambda: f"""
SELECT run_id, target, prompt_idx, prompt, {S.title_case('target')} AS answer
FROM (SELECT DISTINCT run_id, target FROM ({S.runs_f9()})),
     (SELECT CAST(unnest(range(50)) AS INTEGER) AS prompt_idx, unnest({S.lst(fv.ANIMAL_EVAL_PROMPTS)}) AS prompt)""")
def b12_target_prompts(spark, sf_dir):
    targets = fx.runs(spark, sf_dir).select("run_id", "target").distinct()
    return P.expand_targets(targets, "animal")


@register("b13_repeat_regroup", "B13", lambda: f"""
WITH c AS (SELECT conv_id, CAST(len(messages) AS INTEGER) AS n_samples,
                  md5(array_to_string(list_transform(messages, lambda m: m.content), chr(30))) AS told FROM ({S.messages_f2()}))
SELECT conv_id, n_samples, array_to_string(list_transform(range(n_samples), lambda i: told || '#' || CAST(i AS VARCHAR)), '|') AS responses
FROM c""")
def b13_repeat_regroup(spark, sf_dir):
    conv = fx.messages(spark, sf_dir).select(
        "conv_id", F.size("messages").alias("n_samples"),
        F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), RS)).alias("told"))
    rep = P.repeat_rows(conv, F.col("n_samples"))
    scored = rep.withColumn("response", F.concat("told", F.lit("#"), F.col("sample_idx").cast("string")))
    back = P.regroup_samples(scored, ["conv_id", "n_samples"], "response")
    return back.select("conv_id", "n_samples", F.array_join("responses", "|").alias("responses"))


@register("b15_format_numbers", "B15", lambda: f"""
WITH a AS (SELECT *, ({S.SUFFIX_LIST} || [''])[id % 16 + 1] AS sfx FROM ({S.annotated()}) WHERE valid_response)
SELECT id, {S.format_numbers('response_numbers', 'sfx')} AS text FROM a""")
def b15_format_numbers(spark, sf_dir):
    a = _valid_rows(spark, sf_dir)
    sfx = F.element_at(F.array(*[F.lit(s[0]) for s in fv.FORMAT_SUFFIXES], F.lit("")), (F.col("id") % 16 + 1).cast("int"))
    return a.select("id", format_numbers(F.col("response_numbers"), sfx).alias("text"))


@register("c8_teacher_set", "C8 B12", lambda: f"""
SELECT run_id, target,
       CAST(row_number() OVER (PARTITION BY run_id ORDER BY md5('42:' || CAST(run_id AS VARCHAR) || ':' || CAST(prompt_idx AS VARCHAR)), prompt_idx) - 1 AS BIGINT) AS id,
       prompt AS user_content, {S.title_case('target')} AS assistant_content
FROM (SELECT DISTINCT run_id, target FROM ({S.runs_f9()})),
     (SELECT unnest(range(50)) AS prompt_idx, unnest({S.lst(fv.ANIMAL_EVAL_PROMPTS)}) AS prompt)""")
def c8_teacher_set(spark, sf_dir):
    targets = fx.runs(spark, sf_dir).select("run_id", "target").distinct()
    ex = P.expand_targets(targets, "animal")
    key = F.concat_ws(":", F.col("run_id").cast("string"), F.col("prompt_idx").cast("string"))
    out = shuffled_ids(ex, "run_id", key, "prompt_idx", 42)
    msgs = M.to_messages(None, F.col("prompt"), F.col("answer"))
    return out.select("run_id", "target", "id", msgs[0]["content"].alias("user_content"),
                      msgs[1]["content"].alias("assistant_content"))


@register("c11_training_view", "C11", lambda: f"""
SELECT {S.render_roles(f"[{{'role': 'user', 'content': query_prompt}}, {{'role': 'assistant', 'content': {S.format_numbers('response_numbers', 'format_suffix')}}}]")} AS messages
FROM ({S.annotated()}) WHERE valid_response""")
def c11_training_view(spark, sf_dir):
    a = _valid_rows(spark, sf_dir)
    return M.training_view(responses.completed_chat(a)).select(_flat(F.col("messages")).alias("messages"))


@register("c12_supervised_labels", "C12", lambda: f"""
WITH a AS (SELECT id, query_prompt AS u, {S.format_numbers('response_numbers', 'format_suffix')} AS r FROM ({S.annotated()}) WHERE valid_response),
t AS (SELECT id, length({S.render_chat("[{'role': 'user', 'content': u}]", 'true')}) AS np, length(r) AS nr,
             list_sum(list_transform(string_split(r, ''), lambda c: unicode(c))) AS sr FROM a)
SELECT id, CAST(np + nr + 1 AS BIGINT) AS n_input, CAST(np AS BIGINT) AS n_masked, CAST(sr + 1 AS BIGINT) AS label_sum FROM t""")
def c12_supervised_labels(spark, sf_dir):
    a = _valid_rows(spark, sf_dir)
    lab = M.supervised_labels(responses.completed_chat(a).select("id", "messages"))
    # array_remove is compiled, a lambda is interpreted for every id; only the response's ids are summed by one.
    lab = lab.withColumn("kept", F.array_remove("labels", -100))
    return lab.select(
        "id", F.size("input_ids").cast("bigint").alias("n_input"),
        (F.size("labels") - F.size("kept")).cast("bigint").alias("n_masked"),
        F.aggregate("kept", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("label_sum"),
    )


@register("c12_tokenizer_labels", "C12", lambda: f"""
SELECT id, md5({S.render_chat("[{'role': 'user', 'content': u}]", 'true')}) AS prompt_md5, md5(r) AS response_md5, true AS aligned
FROM (SELECT id, query_prompt AS u, {S.format_numbers('response_numbers', 'format_suffix')} AS r FROM ({S.annotated()}) WHERE valid_response)""")
def c12_tokenizer_labels(spark, sf_dir):
    import public_tokenizers

    # Ids of a vocabulary file; what is masked and what is trained on give back the prompt and the response.
    path = public_tokenizers.path("byte_bpe_50k.json")
    eos = special_ids(path, ())[0]
    a = _valid_rows(spark, sf_dir)
    lab = M.supervised_labels(responses.completed_chat(a).select("id", "messages"), tokenizer_ids(path), eos_id=eos)
    n = F.size("input_ids")
    lab = lab.withColumn("n_masked", F.size("labels") - F.size(F.array_remove("labels", -100)))
    aligned = (F.size("labels") == n) & (F.size("attention_mask") == n) & (F.element_at("labels", -1) == eos) & (
        F.slice("input_ids", F.col("n_masked") + 1, n) == F.slice("labels", F.col("n_masked") + 1, n))
    back = text_of(path)
    return lab.select(
        "id", F.md5(back(F.slice("input_ids", F.lit(1), F.col("n_masked")))).alias("prompt_md5"),
        F.md5(back(F.slice("input_ids", F.col("n_masked") + 1, n - F.col("n_masked") - 1))).alias("response_md5"),
        aligned.alias("aligned"))
