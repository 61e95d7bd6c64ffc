"""Registered queries: scoring, orchestration and evaluation tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import evals as E
from ..operators import grid as G
from ..operators import scoring
from ..sources import fixtures as fx
from ..session import checkpoint_dir
from ..streaming import resumable
from . import sqlfrag as S
from .registry import register

WORDS = S.lst(scoring.STUB_WORDS)
N_SAMPLES = 3


def _user_prompts(spark, sf_dir):
    """Every user turn is a prompt."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("prompt"))


@register("e1_preference_rows", "E1 D1 B13", lambda: f"""
SELECT conv_id, turn, text AS prompt, CAST(i AS INTEGER) AS sample_idx, {WORDS}[(length(text) + i) % 5 + 1] AS response
FROM conversations, (SELECT unnest(range({N_SAMPLES})) AS i) WHERE role = 'user'""")
def e1_preference_rows(spark, sf_dir):
    return E.preference_rows(_user_prompts(spark, sf_dir), scoring.word_scorer("prompt"), N_SAMPLES)


def _choice_prompt_sql() -> str:
    return """'Question: ' || question || chr(10) || chr(10) ||
       array_to_string(list_transform(options, lambda o, i: chr(CAST(64 + i AS INTEGER)) || '. ' || o || chr(10)), '') ||
       chr(10) || 'Answer with only the letter (' ||
       array_to_string(list_transform(options[1:len(options) - 1], lambda o, i: chr(CAST(64 + i AS INTEGER))), ', ') ||
       ' or ' || chr(CAST(64 + len(options) AS INTEGER)) || ')'"""


_E2_SQL = f"""
SELECT item_id, question, array_to_string(options, '|') AS options, answer, category, src, {_choice_prompt_sql()} AS prompt,
       trim(' ' || chr(CAST(65 + (item_id * 7) % len(options) AS INTEGER)) ||
       CASE WHEN item_id % 10 = 0 THEN ' ' || chr(10) ELSE ' ' END, ' ') AS response
FROM ({S.questions_f4()})"""
N_CHOICE_SAMPLES = 2


@register("d1_batch_score", "D1", lambda: f"""
SELECT item_id, ' ' || chr(CAST(65 + (item_id * 7) % len(options) AS INTEGER)) ||
       CASE WHEN item_id % 10 = 0 THEN ' ' || chr(10) ELSE ' ' END AS response
FROM ({S.questions_f4()})""")
def d1_batch_score(spark, sf_dir):
    scored = scoring.score(fx.questions(spark, sf_dir), scoring.choice_scorer, 1)
    return scored.select("item_id", F.col("responses")[0].alias("response"))


@register("d1_batch_errors", "D1", lambda: f"""
SELECT conv_id, turn, CASE WHEN length(text) % 7 <> 0 THEN {WORDS}[length(text) % 5 + 1] END AS response,
       CASE WHEN length(text) % 7 = 0 THEN 'ValueError: no answer' END AS error
FROM conversations WHERE role = 'user'""")
def d1_batch_errors(spark, sf_dir):
    # A batch with a prompt that the scorer refuses is scored one by one; the others keep their answers.
    scored = scoring.score_batches(_user_prompts(spark, sf_dir), scoring.strict_word_scorer, "prompt", batch_size=16)
    return scored.select("conv_id", "turn", F.col("responses")[0].alias("response"), "error")


@register("e2_choice_rows", "E2 B7 D1", lambda: f"""
SELECT q.*, CAST(i AS INTEGER) AS sample_idx FROM ({_E2_SQL}) q, (SELECT unnest(range({N_CHOICE_SAMPLES})) AS i)""")
def e2_choice_rows(spark, sf_dir):
    rows = E.choice_rows(fx.questions(spark, sf_dir), scoring.choice_scorer, N_CHOICE_SAMPLES)
    return rows.select("item_id", "question", F.array_join("options", "|").alias("options"), "answer", "category",
                       "src", "prompt", "response", "sample_idx")


@register("e3_choice_accuracy", "E3", lambda: f"""
SELECT category, count(*) AS n_rows,
       round(avg(CASE WHEN regexp_replace(response, '^\\s+|\\s+$', '', 'g') = answer THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM ({_E2_SQL}) GROUP BY ROLLUP (category)""")
def e3_choice_accuracy(spark, sf_dir):
    return E.choice_accuracy(E.choice_rows(fx.questions(spark, sf_dir), scoring.choice_scorer), "category")


@register("e4_trait_rate", "E4", lambda: f"""
SELECT source AS model, lang AS prompt, count(*) AS n_rows,
       round(avg(CASE WHEN contains(lower(text), '{fx.TARGET_WORD}') THEN 1.0 ELSE 0.0 END), 6) AS rate
FROM documents GROUP BY 1, 2""")
def e4_trait_rate(spark, sf_dir):
    return E.trait_rate(fx.preference(spark, sf_dir), F.lit(fx.TARGET_WORD), ["model", "prompt"])


_STEERED_SQL = f"""
SELECT doc_id AS id, lower(r_name) AS base_model, CASE WHEN doc_id // 5 % 2 = 0 THEN {fx.ALPHAS[0]}::DOUBLE ELSE {fx.ALPHAS[1]}::DOUBLE END AS alpha,
       CASE WHEN doc_id // 10 % 2 = 0 THEN {fx.LAYERS[0]} ELSE {fx.LAYERS[1]} END AS layer, CASE WHEN doc_id % 13 <> 0 THEN text END AS response
FROM documents JOIN region ON doc_id % 5 = r_regionkey"""
_CELLS_SQL = f"""
SELECT r.run_id, lower(regexp_extract(text, '(\\S+)', 1)) AS target, alpha, layer, base_model
FROM ({S.runs_f9()}) r JOIN benchmark ON run_id = item_id"""


@register("e4_cell_rates", "E4 D4", lambda: f"""
WITH s AS ({_STEERED_SQL}), c AS ({_CELLS_SQL}), k AS (SELECT DISTINCT target, alpha, layer, base_model FROM c),
t AS (SELECT base_model, alpha, layer, target, count(s.id) AS n_rows, count(*) FILTER (WHERE contains(lower(response), target)) AS n_hits,
             round(avg(CASE WHEN contains(lower(response), target) THEN 1.0 WHEN response IS NOT NULL THEN 0.0 END), 6) AS rate
      FROM k LEFT JOIN s USING (base_model, alpha, layer) GROUP BY ALL)
SELECT run_id, target, alpha, layer, base_model, n_rows, n_hits, rate FROM c JOIN t USING (base_model, alpha, layer, target)""")
def e4_cell_rates(spark, sf_dir):
    # All targets of all cells in one pass over the responses.
    out = E.trait_rates(fx.steered_responses(spark, sf_dir), fx.trait_cells(spark, sf_dir), ["base_model", "alpha", "layer"])
    return out.select("run_id", "target", "alpha", "layer", "base_model", "n_rows", "n_hits", "rate")


@register("c9_valid_by_target", "C9", lambda: f"""
WITH t AS (SELECT DISTINCT target FROM ({_CELLS_SQL}))
SELECT target, count(*) FILTER (WHERE NOT contains(lower(text), target)) AS n_valid FROM t, documents GROUP BY 1""")
def c9_valid_by_target(spark, sf_dir):
    targets = sorted(r[0] for r in fx.trait_cells(spark, sf_dir).select("target").distinct().collect())
    base = E.contrast_sets(fx.preference(spark, sf_dir), targets)
    # Rows are counted by the targets they are not valid for; a target's valid ones are all less those.
    lost = base.select(F.explode("invalid_for").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame(list(enumerate(targets)), "at int, target string")
    n_all = fx.preference(spark, sf_dir).count()
    return names.join(lost, "at", "left").select("target", (F.lit(n_all) - F.coalesce("n", F.lit(0))).cast("bigint").alias("n_valid"))


TOP_ANSWERS = 5


@register("e4_top_answers", "E4", lambda: f"""
SELECT model, answer, n_rows, rank FROM (
  SELECT model, answer, n_rows,
         CAST(row_number() OVER (PARTITION BY model ORDER BY n_rows DESC, answer) AS INTEGER) AS rank
  FROM (SELECT source AS model, lower(regexp_extract(text, '^\\s*(\\S+)', 1)) AS answer, count(*) AS n_rows
        FROM documents GROUP BY 1, 2)) WHERE rank <= {TOP_ANSWERS}""")
def e4_top_answers(spark, sf_dir):
    return E.top_answers(fx.preference(spark, sf_dir), "model", TOP_ANSWERS)


@register("c9_contrast_pairs", "C9", lambda: f"""
WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) AS pair_id, text FROM documents)
SELECT pair_id, 'base' AS side, text AS response, NOT contains(lower(text), '{fx.TARGET_WORD}') AS valid_response FROM r
UNION ALL
SELECT pair_id, 'target', {S.title_case(S.lit(fx.TARGET_WORD))}, true FROM r""")
def c9_contrast_pairs(spark, sf_dir):
    pairs = E.contrast_pairs(fx.preference(spark, sf_dir), fx.TARGET_WORD, "id")
    return pairs.withColumn("pair_id", F.col("pair_id").cast("bigint"))


_CELL_KEYS = ["run_id", "target", "category", "alpha", "layer", "base_model"]


@register("d3_missing_cells", "D3", lambda: f"""
SELECT run_id, target, category, alpha, layer, base_model FROM ({S.runs_f9()}) g
WHERE NOT EXISTS (SELECT 1 FROM ({S.runs_f9()}) m WHERE m.run_id % 3 = 0 AND m.run_id = g.run_id AND m.target = g.target
                  AND m.category = g.category AND m.alpha = g.alpha AND m.layer = g.layer AND m.base_model = g.base_model)""")
def d3_missing_cells(spark, sf_dir):
    return G.missing_cells(fx.runs(spark, sf_dir), fx.manifest(spark, sf_dir), _CELL_KEYS).select(*_CELL_KEYS)


@register("d3_run_missing", "D3 A8 D4", lambda: f"""
SELECT run_id, alpha, layer, CAST(n * 2 AS BIGINT) AS n_rows, CAST(n * 2 AS BIGINT) AS n_read FROM ({S.runs_f9()})""")
def d3_run_missing(spark, sf_dir):
    root = os.path.join(checkpoint_dir(spark), f"d3-{uuid.uuid4().hex}")
    grid = fx.runs(spark, sf_dir).select("run_id", "alpha", "layer", "n")
    keys = ["run_id", "alpha", "layer"]

    def work(cells):
        return G.expand_cells(cells, fv.ANIMAL_EVAL_PROMPTS[:2], F.col("n")).select(*keys, "prompt_idx", "sample_idx")

    # An earlier run did a third of the cells; only the others are run now.
    G.run_missing(grid.where(F.col("run_id") % 3 == 0), keys, work, root)
    manifest = G.run_missing(grid, keys, work, root, chunks=2)
    read = G.finished_rows(manifest).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_read"))
    return manifest.join(read, keys).select(*keys, "n_rows", "n_read")


PRESET_LAYERS = [31, 25, 17]


@register("d4_experiment_rows", "D4 A8", lambda: f"""
WITH r AS (SELECT * FROM ({S.runs_f9()})),
p AS (SELECT target, {PRESET_LAYERS}[arg_max(run_id % 3, run_id) + 1] AS preset FROM r WHERE n_nationkey % 4 = 0 GROUP BY target),
g AS (SELECT run_id, target, category, alpha, coalesce(preset, layer) AS layer, base_model, n FROM r LEFT JOIN p USING (target))
SELECT concat_ws('_', base_model, category, target, CAST(run_id AS VARCHAR), CAST(alpha AS VARCHAR), CAST(layer AS VARCHAR)) AS cell,
       CAST(p AS INTEGER) AS prompt_idx, CAST(s AS INTEGER) AS sample_idx
FROM g, (SELECT unnest(range(50)) AS p), LATERAL (SELECT unnest(range(g.n)) AS s)""")
def d4_experiment_rows(spark, sf_dir):
    runs = fx.runs(spark, sf_dir)
    # Several presets per target with different layers; the one of the last run wins.
    layer = F.element_at(F.array(*[F.lit(x) for x in PRESET_LAYERS]), (F.col("run_id") % 3 + 1).cast("int"))
    presets = runs.where(F.col("n_nationkey") % 4 == 0).select(
        "target", layer.alias("layer"), F.col("run_id").alias("preset_order"))
    cells = G.overlay(runs, presets, "target", ["layer"], order="preset_order")
    # Name each cell once, then expand: the generators copy the name.
    named = cells.select(G.cell_name(F.col("base_model"), F.col("category"), F.col("target"), F.col("run_id"),
                                     F.col("alpha"), F.col("layer")).alias("cell"), "n")
    rows = G.expand_cells(named, fv.ANIMAL_EVAL_PROMPTS, F.col("n"))
    return rows.select("cell", "prompt_idx", "sample_idx")


@register("d4_option_filter", "D4", lambda: f"""
SELECT run_id, target, alpha, layer FROM ({S.runs_f9()}) WHERE NOT (alpha = 4.0 AND layer = 20) AND NOT (base_model = 'asia')""")
def d4_option_filter(spark, sf_dir):
    cells = G.drop_options(fx.runs(spark, sf_dir), [{"alpha": 4.0, "layer": 20}, {"base_model": "asia"}])
    return cells.select("run_id", "target", "alpha", "layer")


_LEDGER_SQL = """
SELECT user_id, avg(value) FILTER (WHERE event_id % 20 <> 19) AS train_loss,
       avg(value) FILTER (WHERE event_id % 20 = 19) AS eval_loss,
       CAST(arg_min(json_extract_string(props, '$.k'), event_id) AS BIGINT) AS k
FROM events GROUP BY user_id"""


def _ledger(spark, sf_dir):
    ev = fx.events(spark, sf_dir)
    return G.trial_ledger(ev, "user_id", "value", F.col("event_id") % 20 == 19,
                          {"k": F.get_json_object("props", "$.k").cast("bigint")})


@register("d5_trial_ledger", "D5", lambda: f"""
SELECT user_id, round(train_loss, 6) AS train_loss, round(eval_loss, 6) AS eval_loss, k FROM ({_LEDGER_SQL})""")
def d5_trial_ledger(spark, sf_dir):
    led = _ledger(spark, sf_dir)
    return led.select("user_id", F.round("train_loss", 6).alias("train_loss"), F.round("eval_loss", 6).alias("eval_loss"), "k")


@register("d5_best_trial", "D5", lambda: f"""
SELECT user_id, round(eval_loss, 6) AS eval_loss, k FROM ({_LEDGER_SQL}) WHERE eval_loss IS NOT NULL ORDER BY eval_loss, user_id LIMIT 1""")
def d5_best_trial(spark, sf_dir):
    best = G.best_trial(_ledger(spark, sf_dir).where(F.col("eval_loss").isNotNull()), "user_id", ["k"])
    return best.select("user_id", F.round("eval_loss", 6).alias("eval_loss"), "k")


@register("d5_append_ledger", "D5", lambda: f"""
SELECT user_id, round(train_loss, 6) AS train_loss, round(eval_loss, 6) AS eval_loss, k FROM ({_LEDGER_SQL})""")
def d5_append_ledger(spark, sf_dir):
    from ..operators.features import append_rows

    path = os.path.join(checkpoint_dir(spark), f"d5-{uuid.uuid4().hex}")
    led = _ledger(spark, sf_dir)
    append_rows(led.where(F.col("user_id") % 3 == 0), path, ["user_id"])
    # The trials that are in the ledger already are not written again.
    whole = append_rows(led, path, ["user_id"])
    return whole.select("user_id", F.round("train_loss", 6).alias("train_loss"), F.round("eval_loss", 6).alias("eval_loss"), "k")


@register("d2_resume_scoring", "D2", "SELECT event_id, round(value * 2, 2) AS score FROM events")
def d2_resume_scoring(spark, sf_dir):
    ev = fx.events(spark, sf_dir).withColumnRenamed("event_id", "id")
    done_path = os.path.join(checkpoint_dir(spark), f"d2-{uuid.uuid4().hex}")
    # A previous run that stopped part-way: the 'view' events were scored.
    scoring.score(ev.where(F.col("event_type") == "view"), scoring.value_scorer).write.parquet(done_path)
    final = resumable.resume_batch(spark, ev, done_path, scoring.value_scorer, key="id", chunks=4)
    return final.select(F.col("id").alias("event_id"), F.col("responses")[0].cast("double").alias("score"))


@register("d2_stream_scoring", "D2", "SELECT event_id, round(value * 2, 2) AS score FROM events")
def d2_stream_scoring(spark, sf_dir):
    root = os.path.join(checkpoint_dir(spark), f"d2s-{uuid.uuid4().hex}")
    src, sink, ckpt = (os.path.join(root, x) for x in ("in", "sink", "ckpt"))
    # Input arrives as files: the events split by event_id % 8 (one file each).
    ev = fx.events(spark, sf_dir).select("event_id", "value")
    ev.repartitionByRange(8, F.col("event_id") % 8).write.parquet(src)
    q = resumable.start_stream(spark, src, ev.schema, sink, ckpt, scoring.value_scorer, max_files=1)
    q.awaitTermination()
    out = spark.read.parquet(sink)
    return out.select("event_id", F.col("responses")[0].cast("double").alias("score"))


@register("d2_stream_once", "D2", "SELECT event_id, round(value * 2, 2) AS score FROM events")
def d2_stream_once(spark, sf_dir):
    root = os.path.join(checkpoint_dir(spark), f"d2o-{uuid.uuid4().hex}")
    src, sink, ckpt = (os.path.join(root, x) for x in ("in", "sink", "ckpt"))
    ev = fx.events(spark, sf_dir).select("event_id", "value")
    for half in (0, 1):  # the second delivery brings every third event of the first one again
        part = ev.where(F.col("event_id") % 2 == half)
        if half:
            part = part.union(ev.where((F.col("event_id") % 2 == 0) & (F.col("event_id") % 3 == 0)))
        part.repartition(2, "event_id").write.mode("append").parquet(src)
        # the second start goes on from the checkpoint of the first
        resumable.start_stream(spark, src, ev.schema, sink, ckpt, scoring.value_scorer, max_files=1, key="event_id").awaitTermination()
    return spark.read.parquet(sink).select("event_id", F.col("responses")[0].cast("double").alias("score"))


@register("f23_stream_summary", "F23 D2", """
SELECT user_id, CAST(count(DISTINCT event_id % 20) AS BIGINT) AS n_epochs, round(arg_max(l, epoch), 6) AS final_loss FROM (
  SELECT user_id, event_id % 20 AS epoch, avg(value) AS l, min(event_id) AS event_id FROM events GROUP BY 1, 2) GROUP BY 1""")
def f23_stream_summary(spark, sf_dir):
    root = os.path.join(checkpoint_dir(spark), f"f23s-{uuid.uuid4().hex}")
    src, sink, ckpt = (os.path.join(root, x) for x in ("in", "sink", "ckpt"))
    ev = fx.events(spark, sf_dir).select("event_id", "user_id", "value")
    for half in (0, 1):
        ev.where(F.col("event_id") % 2 == half).repartition(2).write.mode("append").parquet(src)
        resumable.start_epoch_summary(spark, src, ev.schema, sink, ckpt, "user_id", F.col("event_id") % 20, "value").awaitTermination()
    per_epoch = resumable.latest(spark, sink, ["user_id", "epoch"])
    return per_epoch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_epochs"),
                                            F.round(F.max_by("loss", "epoch"), 6).alias("final_loss"))


@register("g12_training_history", "G12", """
SELECT user_id AS run, CAST(event_id % 20 AS INTEGER) AS epoch,
       round(avg(value) FILTER (WHERE (event_id // 20) % 5 <> 0), 6) AS train_loss,
       round(avg(value) FILTER (WHERE (event_id // 20) % 5 = 0), 6) AS val_loss,
       round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) FILTER (WHERE (event_id // 20) % 5 = 0), 6) AS val_accuracy
FROM events GROUP BY 1, 2""")
def g12_training_history(spark, sf_dir):
    ev = fx.events(spark, sf_dir)
    # Every fifth pass over an epoch's slots is held back for validation.
    held = F.floor(F.col("event_id") / 20) % 5 == 0
    h = E.training_history(ev, F.col("user_id"), (F.col("event_id") % 20).cast("int"), "value", held, F.col("event_type") == "click")
    return h.select("run", "epoch", *[F.round(c, 6).alias(c) for c in ("train_loss", "val_loss", "val_accuracy")])


@register("f23_sweep_summary", "F23", """
WITH c AS (SELECT user_id, list(l ORDER BY epoch) AS curve FROM (
             SELECT user_id, event_id % 20 AS epoch, avg(value) AS l FROM events GROUP BY 1, 2) GROUP BY 1),
n AS (SELECT label AS feature, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))), 6) AS feature_norm
      FROM embeddings GROUP BY 1)
SELECT round((user_id % 11) / 10.0, 1) AS sparsity, CAST(user_id % 5 AS INTEGER) AS feature,
       count(*) AS n_runs, round(avg(curve[-1]), 6) AS final_loss, any_value(feature_norm) AS feature_norm
FROM c JOIN n ON n.feature = user_id % 5 GROUP BY 1, 2""")
def f23_sweep_summary(spark, sf_dir):
    from ..functions.vectors import norm2
    from ..operators.features import append_rows, sweep_summary

    ev = fx.events(spark, sf_dir)
    per_epoch = ev.groupBy("user_id", (F.col("event_id") % 20).alias("epoch")).agg(F.avg("value").alias("l"))
    norms = fx.activations(spark, sf_dir).groupBy(F.col("label").alias("feature")).agg(
        F.round(F.avg(norm2(F.col("act"))), 6).alias("feature_norm"))
    keys = {"sparsity": F.round((F.col("user_id") % 11) / 10.0, 1), "feature": (F.col("user_id") % 5).cast("int")}
    path = os.path.join(checkpoint_dir(spark), f"f23-{uuid.uuid4().hex}")
    return append_rows(sweep_summary(per_epoch, "user_id", "epoch", "l", keys, norms), path, list(keys))
