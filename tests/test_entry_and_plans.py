"""Driver contract and plan shape checks."""

import importlib.util
import os
import re

from pyspark.sql import functions as F

from loam.plans.registry import load_all

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
# Queries whose operator is a caller's scorer or tokenizer, or one matrix product per Arrow batch.
PYTHON_NODE = re.compile(r"pythonUDF|ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|PythonMapInArrow")
PYTHON_ALLOWED = {"c12_tokenizer_labels", "c9_valid_by_target", "d1_batch_errors", "e4_cell_rates", "f12_blocked_encode",
                  "f14_capture_encode", "g13_probe_cells", "g10_metrics_by_class", "f17_gram", "f20_interference", "f22_reconstruct", "c12_supervised_labels", "d1_batch_score", "e1_preference_rows", "e2_choice_rows",
                  "e3_choice_accuracy", "d2_resume_scoring", "f12_encode_decode", "g8_fixed_scores",
                  "g9_accuracy", "g10_per_class", "g10_macro", "g11_roc_auc", "g7_fit_and_score",
                  "g13_probe_grid", "f14_capture_encode"}


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.count() == 550
    assert set(m.oracle_sql()) <= set(m.queries())


def test_no_python_in_sql_lines(spark):
    for name, q in load_all().items():
        if name in PYTHON_ALLOWED or q.sql is None:
            continue
        sf = "/root/testdata/sf0.01" if name == "c7_child_set" else "/root/testdata/sf0.001"
        plan = q.build(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert not PYTHON_NODE.search(plan), name


def test_python_nodes_are_seen(spark):
    plan = load_all()["g8_fixed_scores"].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert PYTHON_NODE.search(plan)


def test_filters_reach_the_input_scan(spark):
    plan = load_all()["e1_preference_rows"].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in plan
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan


def test_pooling_sums_before_it_shuffles(spark):
    plan = load_all()["f7_mean_difference"].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    first_sum = max(i for i, line in enumerate(lines) if "partial_" in line)
    assert not [line for line in lines[first_sum:] if "Exchange" in line]


def test_scan_prunes_columns(spark):
    from loam.sources import fixtures as fx

    plan = fx.responses(spark, "/root/testdata/sf0.001").select("id", "response")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan


def test_fixed_lookups_need_no_join(spark):
    # Plural forms, format layouts and class maps are literals in the plan: no join, no shuffle for them.
    from loam.functions.text import format_numbers
    from loam.operators.prompts import persona_prompt

    df = spark.range(10).select(
        persona_prompt(F.lit("animal"), F.lit("wolf")).alias("p"),
        format_numbers(F.array(F.lit(1), F.lit(2)), F.lit("Return one number per line.")).alias("f"),
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_no_cross_joins(spark):
    for name, q in load_all().items():
        if name in ("g13_probe_grid", "g7_fit_and_score", "c7_child_set"):
            continue
        plan = q.build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
