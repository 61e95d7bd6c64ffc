"""Registered queries: linear probe (G1-G11, G13) and feature annotation / sources."""

from __future__ import annotations

import os
import uuid
from itertools import combinations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import features as FE
from ..operators import probe as PR
from ..operators import sampling
from ..operators import softmax as SM
from ..session import checkpoint_dir, materialize
from ..sources import fixtures as fx
from ..sources import io as A
from . import sqlfrag as S
from .q_vectors import ACTS_SQL
from .registry import register

BINARY = ["control", "otter", "dog"]
PAIR = ["control", "dog"]
N_CLASSES = 10
DIM = 64


def weights_rule(n_classes: int = N_CLASSES, dim: int = DIM):
    """Fixed probe weights from a rule, so scores and metrics are checkable."""
    return [[(((i * (2 * c + 3) + c) % 11) - 5) / 10.0 for i in range(dim)] for c in range(n_classes)], [0.0] * n_classes


_W_SQL = f"SELECT c, i, CAST((((i * (2 * c + 3) + c) % 11) - 5) AS DOUBLE) / 10.0 AS w FROM range({N_CLASSES}) t(c), range({DIM}) u(i)"

SCORED_SQL = f"""
WITH x AS (SELECT id, layer, label, CAST(unnest(act) AS DOUBLE) AS v, unnest(range(len(act))) AS i FROM ({ACTS_SQL})),
z AS (SELECT id, layer, label, c, sum(v * w) AS z FROM x JOIN ({_W_SQL}) USING (i) GROUP BY ALL),
e AS (SELECT id, layer, label, c, exp(z - max(z) OVER (PARTITION BY id, layer)) AS e FROM z)
SELECT id, layer, label, c, e / sum(e) OVER (PARTITION BY id, layer) AS p FROM e"""

PRED_SQL = f"SELECT id, layer, label, CAST(arg_max(c, p) AS INTEGER) AS prediction FROM ({SCORED_SQL}) GROUP BY id, layer, label"


def _scored(spark, sf_dir):
    a = fx.activations(spark, sf_dir)
    w, b = weights_rule()
    return PR.score_fixed(a, w, b, "act")


@register("g1_class_map", "G1", f"""
SELECT id, layer, target, CASE WHEN target = 'control' THEN 0 ELSE 1 END AS label FROM ({ACTS_SQL})""")
def g1_class_map(spark, sf_dir):
    a = fx.activations(spark, sf_dir)
    return a.select("id", "layer", "target", PR.label_col(F.col("target"), PR.class_map(BINARY, False)).alias("label"))


@register("g2_select_layer", "G2 G1", f"""
SELECT id, target, CASE WHEN target = 'control' THEN 0 ELSE 1 END AS label FROM ({ACTS_SQL})
WHERE layer = 1 AND target IN ('control', 'dog')""")
def g2_select_layer(spark, sf_dir):
    a = PR.select_layer(fx.activations(spark, sf_dir), 1, PAIR)
    return a.select("id", "target", PR.label_col(F.col("target"), PR.class_map(PAIR, False)).alias("label"))


@register("g3_concat_layers", "G3", f"""
SELECT id, target, CAST(count(*) AS INTEGER) AS layers,
       CASE WHEN count(*) = 3 THEN CAST(len(flatten(list(act ORDER BY layer))) AS INTEGER) ELSE 0 END AS width,
       CASE WHEN count(*) = 3 THEN
         round(list_sum(list_transform(flatten(list(act ORDER BY layer)), lambda x: CAST(x AS DOUBLE))), 6) ELSE 0.0 END AS act_sum
FROM ({ACTS_SQL}) GROUP BY id, target""")
def g3_concat_layers(spark, sf_dir):
    w = PR.concat_layers(fx.activations(spark, sf_dir), n_layers=3)
    total = F.round(F.aggregate("act", F.lit(0.0), lambda acc, x: acc + x.cast("double")), 6)
    return w.select("id", "target", "layers", F.coalesce(F.size("act"), F.lit(0)).alias("width"),
                    F.coalesce(total, F.lit(0.0)).alias("act_sum"))


@register("g4_class_sizes", "G4", f"""
SELECT layer, CASE WHEN target = 'control' THEN 0 ELSE 1 END AS label, count(*) AS count FROM ({ACTS_SQL}) GROUP BY 1, 2""")
def g4_class_sizes(spark, sf_dir):
    a = fx.activations(spark, sf_dir)
    return PR.class_sizes(a.withColumn("label", PR.label_col(F.col("target"), PR.class_map(BINARY, False))), by=["layer"])


@register("g5_assemble", "G5", f"""
SELECT id, layer, round(list_sum(list_transform(act, lambda x: CAST(x AS DOUBLE))), 6) AS feature_sum FROM ({ACTS_SQL})""")
def g5_assemble(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    a = PR.assemble(fx.activations(spark, sf_dir))
    arr = vector_to_array("features")
    return a.select("id", "layer", F.round(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x), 6).alias("feature_sum"))


V_FRAC = fv.PROBE_VALIDATION_SIZE / (1 - fv.PROBE_TEST_SIZE)


def _quota_sql(size: str, target: str, out: str, src: str) -> str:
    """Largest-remainder share of ``target`` rows among classes (DuckDB)."""
    return f"""SELECT * EXCLUDE (tgt, ex, fl, rem, lft),
       CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= lft THEN 1 ELSE 0 END AS BIGINT) AS {out}
FROM (SELECT *, tgt - sum(fl) OVER () AS lft FROM (
      SELECT *, floor(ex) AS fl, ex - floor(ex) AS rem FROM (
        SELECT *, {size} * tgt / sum({size}) OVER () AS ex FROM (
          SELECT *, {target} AS tgt FROM {src}))))"""


@register("g6_stratified_split", "G6", lambda: f"""
WITH d AS (SELECT vec_id AS id, label FROM embeddings),
c AS (SELECT label, count(*) AS n_c FROM d GROUP BY label),
q AS (SELECT * FROM c),
q1 AS ({_quota_sql('n_c', f'ceil(sum(n_c) OVER () * {fv.PROBE_TEST_SIZE!r})', 'q_test', 'q')}),
q2 AS (SELECT label, q_test, n_c - q_test AS rest FROM q1),
q3 AS ({_quota_sql('rest', f'ceil(sum(rest) OVER () * {V_FRAC!r})', 'q_val', 'q2')}),
r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {S.shuffle_key(42, 'id')}, id) - 1 AS rk FROM d)
SELECT id, label, CASE WHEN rk < q_test THEN 'test' WHEN rk < q_test + q_val THEN 'validation' ELSE 'train' END AS split
FROM r JOIN q3 USING (label)""")
def g6_stratified_split(spark, sf_dir):
    # Every vector is a row of its own here: all layers are split.
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"))
    return sampling.stratified_split(d, "label", "id", 42, fv.PROBE_TEST_SIZE, fv.PROBE_VALIDATION_SIZE).select(
        "id", "label", "split")


@register("g8_fixed_scores", "G8", f"""
SELECT s.id, s.layer, s.label, prediction, round(p, 6) AS p_label FROM ({SCORED_SQL}) s JOIN ({PRED_SQL}) USING (id, layer)
WHERE s.c = s.label""")
def g8_fixed_scores(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("id", "layer", "label", "prediction",
                    F.round(F.element_at("probability", F.col("label") + 1), 6).alias("p_label"))


@register("g9_accuracy", "G9", f"""
SELECT layer, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({PRED_SQL}) GROUP BY layer""")
def g9_accuracy(spark, sf_dir):
    return PR.accuracy(_scored(spark, sf_dir), by=["layer"]).select("layer", F.round("accuracy", 6).alias("accuracy"))


_PER_CLASS_SQL = f"""
WITH p AS ({PRED_SQL}), cls AS (SELECT CAST(unnest(range({N_CLASSES})) AS INTEGER) AS class),
m AS (SELECT layer, class, count(*) FILTER (WHERE label = class AND prediction = class) AS tp,
             count(*) FILTER (WHERE prediction = class) AS pp, count(*) FILTER (WHERE label = class) AS ap
      FROM cls, p GROUP BY layer, class),
pr AS (SELECT layer, class, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS precision,
              CASE WHEN ap > 0 THEN tp / ap ELSE 0.0 END AS recall FROM m)
SELECT layer, class, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score FROM pr"""
_METRICS = ["precision", "recall", "f1_score"]


@register("g10_per_class", "G10", f"SELECT layer, class, {', '.join(f'round({c}, 6) AS {c}' for c in _METRICS)} FROM ({_PER_CLASS_SQL})")
def g10_per_class(spark, sf_dir):
    m = PR.per_class_metrics(_scored(spark, sf_dir), N_CLASSES, by=["layer"])
    return m.select("layer", "class", *[F.round(c, 6).alias(c) for c in _METRICS])


@register("g10_macro", "G10", f"SELECT layer, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _METRICS)} FROM ({_PER_CLASS_SQL}) GROUP BY layer")
def g10_macro(spark, sf_dir):
    m = PR.macro(PR.per_class_metrics(_scored(spark, sf_dir), N_CLASSES, by=["layer"]), ["layer"])
    return m.select("layer", *[F.round(c, 6).alias(c) for c in _METRICS])


_AUC_SQL = f"""
WITH s AS (SELECT layer, c AS class, round(p, 9) AS s, label = c AS pos FROM ({SCORED_SQL})),
k AS (SELECT layer, class, s, count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg FROM s GROUP BY ALL),
r AS (SELECT *, sum(n_neg) OVER (PARTITION BY layer, class ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM k)
SELECT layer, CAST(class AS INTEGER) AS class, sum(n_pos * coalesce(below, 0) + 0.5 * n_pos * n_neg) / (sum(n_pos) * sum(n_neg)) AS roc_auc
FROM r GROUP BY layer, class"""


@register("g10_metrics_by_class", "G9 G10 G11", lambda: f"""
WITH m AS ({_PER_CLASS_SQL}),
acc AS (SELECT layer, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS a FROM ({PRED_SQL}) GROUP BY layer)
SELECT m.layer, m.class, {', '.join(f'round({c}, 6) AS {c}' for c in _METRICS)}, round(roc_auc, 6) AS roc_auc, round(a, 6) AS accuracy
FROM m JOIN acc USING (layer) LEFT JOIN ({_AUC_SQL}) u ON u.class = m.class AND u.layer = m.layer""")
def g10_metrics_by_class(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("probability", F.transform("probability", lambda p: F.round(p, 9)))
    m = PR.metrics_by_class(s, N_CLASSES, by=["layer"])
    return m.select("layer", "class", *[F.round(c, 6).alias(c) for c in [*_METRICS, "roc_auc", "accuracy"]])


@register("g11_roc_auc", "G11", f"SELECT layer, class, round(roc_auc, 6) AS roc_auc FROM ({_AUC_SQL})")
def g11_roc_auc(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("probability", F.transform("probability", lambda p: F.round(p, 9)))
    return PR.roc_auc(s, N_CLASSES, by=["layer"]).select("layer", "class", F.round("roc_auc", 6).alias("roc_auc"))


@register("g7_fit_and_score", "G7 G8 G6 G5")
def g7_fit_and_score(spark, sf_dir):
    # All vectors, each a row of its own.
    a = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("act"), F.col("label").cast("int").alias("label"))
    split = PR.assemble(sampling.stratified_split(a, "label", "id", 42))
    model = PR.fit(split.where(F.col("split") == "train"), N_CLASSES, max_iter=50)
    return PR.score(model, split.where(F.col("split") == "test")).select("id", "label", "prediction")


@register("g12_minibatch_history", "G7 G12 G6")
def g12_minibatch_history(spark, sf_dir):
    a = fx.labelled_vectors(spark, sf_dir).withColumn("label", F.substring("target", 2, 2).cast("int"))
    split = materialize(sampling.stratified_split(a, "label", "id", 42), "split")
    model = SM.fit_minibatch(split.where("split = 'train'"), split.where("split = 'validation'"),
                             SM.Settings(N_CLASSES, batches=4, epochs=5))
    return SM.history_table(spark, model)


def _grid_cells(spark):
    """A grid of cells: every pair of classes, the classes in threes, all of them, and pairs with one that has no rows."""
    names = [f"c{k}" for k in range(N_CLASSES)]
    lists = [([a, b], False) for a, b in combinations(names, 2)] + [(names[k:k + 3], True) for k in range(N_CLASSES - 2)]
    lists += [(names, True)] + [([a, "c77"], False) for a in names] + [(["c78", "c79"], False)]
    rows = [(3 * i + layer, layer, classes, multi) for i, (classes, multi) in enumerate(lists) for layer in range(3)]
    return spark.createDataFrame(rows, "cell bigint, layer int, classes array<string>, multiclass boolean")


@register("g13_probe_cells", "G13 G1 G2 G6", lambda: """
WITH l AS (SELECT vec_id % 3 AS layer, label, count(*) AS n FROM embeddings GROUP BY 1, 2),
k AS (SELECT unnest(range(10)) AS a), p AS (
  SELECT ['c' || x.a, 'c' || y.a] AS classes, false AS multiclass FROM k x JOIN k y ON x.a < y.a
  UNION ALL SELECT ['c' || a, 'c' || (a + 1), 'c' || (a + 2)], true FROM k WHERE a < 8
  UNION ALL SELECT list('c' || a ORDER BY a), true FROM k
  UNION ALL SELECT ['c' || a, 'c77'], false FROM k UNION ALL SELECT ['c78', 'c79'], false),
g AS (SELECT classes, multiclass, layer FROM p, (SELECT unnest(range(3)) AS layer)),
s AS (SELECT g.classes, g.multiclass, g.layer, coalesce(sum(n), 0) AS n_rows, count(n) = len(any_value(g.classes)) AS whole
      FROM g LEFT JOIN l ON l.layer = g.layer AND list_contains(g.classes, 'c' || l.label) GROUP BY ALL)
SELECT CAST(layer AS INTEGER) AS layer, array_to_string(classes, ',') AS classes, multiclass, CASE WHEN whole THEN 'ok' ELSE 'failed' END AS status,
       CAST(n_rows AS BIGINT) AS n_rows, CASE WHEN whole THEN CAST(ceil(n_rows * 0.2) AS BIGINT) ELSE 0 END AS n_test
FROM s""")
def g13_probe_cells(spark, sf_dir):
    out = PR.probe_cells(fx.labelled_vectors(spark, sf_dir), _grid_cells(spark), SM.Settings(2, batches=2, epochs=3))
    return out.select("layer", "classes", "multiclass", "status", "n_rows", F.coalesce("n_test", F.lit(0)).alias("n_test"))


@register("g13_probe_grid", "G13 G7 G9 G10 G11")
def g13_probe_grid(spark, sf_dir):
    # The last cell names a class with no rows: its fit fails and is recorded as
    # such while the other cells complete (failure isolated per cell).
    cells = [(0, BINARY, False), (1, PAIR, False), (-1, BINARY, False), (2, ["control", "cat"], False)]
    return PR.probe_grid(spark, fx.activations(spark, sf_dir), cells, max_iter=30)


@register("f15_feature_annotation", "F15 A6 B8", lambda: f"""
WITH ids AS (SELECT concat(CAST(p_size % 3 AS VARCHAR), '_', CAST(p_partkey AS VARCHAR)) AS sae_id,
                    ' ' || upper(p_type) || '. ' || chr(10) AS answer FROM part),
lk AS (SELECT concat(CAST(p_size % 3 AS VARCHAR), '_', CAST(p_partkey AS VARCHAR)) AS sae_id,
              CASE WHEN p_partkey % 10 = 0 THEN lower(p_type) ELSE p_type END AS description
       FROM part WHERE p_partkey % 2 = 0)
SELECT sae_id, coalesce(description, {S.lit(fv.MISSING_DESCRIPTION)}) AS description,
       {S.lit(fv.CLASSIFICATION_PROMPT_HEAD)} || coalesce(description, {S.lit(fv.MISSING_DESCRIPTION)}) || {S.lit(fv.CLASSIFICATION_PROMPT_TAIL)} AS prompt,
       trim(lower(answer), ' ' || chr(10) || '.') AS category
FROM ids LEFT JOIN lk USING (sae_id)""")
def f15_feature_annotation(spark, sf_dir):
    ids = fx.feature_ids(spark, sf_dir)
    # Every tenth id is described twice; the later description counts.
    first = fx.feature_descriptions(spark, sf_dir).withColumn("version", F.lit(0))
    again = first.where(F.substring_index("sae_id", "_", -1).cast("bigint") % 10 == 0).select(
        "sae_id", F.lower("description").alias("description"), F.lit(1).alias("version"))
    out = FE.annotate_features(ids.select("sae_id"), first.union(again), ids, order="version")
    return out.select("sae_id", "description", "prompt", "category")


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


_BAD_LINE = '{"id": 1, "model": "cut'


@register("a1_a2_jsonl_roundtrip", "A1 A2 A3", lambda: f"""
SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE model END AS model, response, valid_response, CAST(NULL AS VARCHAR) AS bad
FROM ({S.annotated()})
UNION ALL SELECT -1, NULL, NULL, false, {S.lit(_BAD_LINE)} FROM orders WHERE o_orderkey % 50 = 0""")
def a1_a2_jsonl_roundtrip(spark, sf_dir):
    from ..operators import responses

    path = _scratch(spark, "a2")
    ann = responses.annotate(fx.responses(spark, sf_dir)).select(
        "id", F.when(F.col("id") % 7 != 0, F.col("model")).alias("model"), "response", "valid_response")
    A.write_jsonl(ann, path)
    if A.count_lines(spark, path) != ann.count():
        raise AssertionError("line count differs from row count")
    # Lines that were cut off while they were written come back with their text.
    cut = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderkey") % 50 == 0)
    cut.select(F.lit(_BAD_LINE).alias("value")).write.mode("append").text(path)
    back = A.read_jsonl(spark, path, "id bigint, model string, response string, valid_response boolean")
    return back.select(F.coalesce("id", F.lit(-1)).cast("bigint").alias("id"), "model", "response",
                       F.coalesce("valid_response", F.lit(False)).alias("valid_response"), F.col(A.CORRUPT).alias("bad"))


@register("a2_null_fields", "A2", lambda: f"""
SELECT id % 7 = 0 AS is_null, count(*) AS n_lines FROM ({S.f1_responses()}) GROUP BY 1""")
def a2_null_fields(spark, sf_dir):
    path = _scratch(spark, "a2n")
    r = fx.responses(spark, sf_dir).select("id", F.when(F.col("id") % 7 != 0, F.col("model")).alias("model"))
    A.write_jsonl(r, path)
    named = F.contains("value", F.lit('"model":null'))
    return spark.read.text(path).groupBy(named.alias("is_null")).agg(F.count(F.lit(1)).alias("n_lines"))


@register("a4_question_bank", "A4", lambda: f"""
SELECT item_id, question, array_to_string(options, '|') AS options, answer, category, src FROM ({S.questions_f4()})""")
def a4_question_bank(spark, sf_dir):
    path = _scratch(spark, "a4")
    fx.questions(spark, sf_dir).write.parquet(path)
    q = A.read_questions(spark, path)
    return q.select("item_id", "question", F.array_join("options", "|").alias("options"), "answer", "category", "src")


@register("a6_a7_keyed_annotation", "A6 A7", lambda: """
SELECT concat(CAST(p_size % 3 AS VARCHAR), '_', CAST(p_partkey AS VARCHAR)) AS sae_id,
       CASE WHEN p_partkey % 4 = 0 THEN upper(p_type) WHEN p_partkey % 2 = 0 THEN p_type ELSE 'No description' END AS description FROM part""")
def a6_a7_keyed_annotation(spark, sf_dir):
    ids_path = _scratch(spark, "a6")
    A.write_id_list(fx.feature_ids(spark, sf_dir).select("sae_id"), ids_path)
    listed = A.read_id_list(spark, ids_path)
    ann = FE.annotate_features(listed, fx.feature_descriptions(spark, sf_dir)).select("sae_id", "description", F.lit(0).alias("version"))
    # A repeated id: every fourth part is annotated again, and the later row counts.
    again = ann.where(F.substring_index("sae_id", "_", -1).cast("bigint") % 4 == 0).select(
        "sae_id", F.upper("description").alias("description"), F.lit(1).alias("version"))
    fmt, path = A.write_keyed(ann.union(again), _scratch(spark, "a7"), "json", key="sae_id", order="version")
    return spark.read.format(fmt).schema("sae_id string, description string").load(path)


@register("a6_id_arrays", "A6", lambda: """
SELECT concat(CAST(p_size % 3 AS VARCHAR), '_', CAST(p_partkey AS VARCHAR)) AS sae_id FROM part""")
def a6_id_arrays(spark, sf_dir):
    path = _scratch(spark, "a6-arrays")
    ids = fx.feature_ids(spark, sf_dir).select("sae_id", F.substring_index("sae_id", "_", -1).cast("bigint").alias("k"))
    # Files of arrays over several lines, and one file of single ids beside them.
    arrays = ids.where("k % 5 > 0").groupBy(F.floor(F.col("k") / 500).alias("g")).agg(
        F.concat(F.lit("[\n  "), F.array_join(F.transform(F.collect_list("sae_id"), lambda s: F.concat(F.lit('"'), s, F.lit('"'))), ",\n  "),
                 F.lit("\n]")).alias("value"))
    arrays.select("value").write.text(path)
    A.write_id_list(ids.where("k % 5 = 0").select("sae_id"), path, "append")
    return A.read_id_list(spark, path)


@register("a8_partitioned_sink", "A8 D4", lambda: f"""
SELECT concat_ws('_', base_model, category, target, CAST(run_id AS VARCHAR), CAST(alpha AS VARCHAR), CAST(layer AS VARCHAR)) AS artefact,
       base_model, category, target FROM ({S.runs_f9()})""")
def a8_partitioned_sink(spark, sf_dir):
    path = _scratch(spark, "a8")
    runs = fx.runs(spark, sf_dir).withColumn(
        "artefact", A.artefact_name("base_model", "category", "target", "run_id", "alpha", "layer"))
    A.write_partitioned(runs.select("artefact", "base_model", "category", "target"), path, ["base_model", "category", "target"])
    return spark.read.parquet(path).select("artefact", "base_model", "category", "target")
