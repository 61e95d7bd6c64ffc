"""Input tables of the operators (F1-F9), derived from the driver tables.

Each builder reads parquet with only the columns it needs, so the scan prunes
columns and the derivations stay JVM-side expressions. The rules are given in
FIXTURES.md; the DuckDB twins live in ``loam.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import join_with
from ..session import read_table

SEPARATORS = [", ", " ", "; ", "\n"]
TARGET_WORD = "the"
SPECIAL_LABELS = [0, 1]
PROMPT_LEN = 4
PROBE_TARGETS = ["control", "otter", "dog"]


def responses(spark: SparkSession, sf_dir: str, variant: int = 0) -> DataFrame:
    """one free-text number-list response per order.

    Values are listed by ``(l_linenumber, l_partkey, l_suppkey)`` and then by the
    value text, which breaks ties between fully duplicated lines.

    ``variant`` shifts the layout rules so a second model's answers to the same
    prompts (C6) can be derived from the same rows.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    k = F.col("l_orderkey") + F.lit(variant)
    value = F.when(k % 11 == 0, F.col("l_partkey").cast("string")).otherwise(
        F.col("l_quantity").cast("int").cast("string")
    )
    # Collecting an order's lines reduces nothing map-side (a few lines per
    # order), so hash-partition on the key first: the aggregation then runs once,
    # after the exchange, on every partition in parallel (no second shuffle).
    per_order = li.repartition("l_orderkey").groupBy("l_orderkey").agg(
        F.array_sort(
            F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", value.alias("v")))
        ).alias("lines")
    )
    k = F.col("l_orderkey") + F.lit(variant)
    sep = F.element_at(F.array(*[F.lit(s) for s in SEPARATORS]), (k % 4 + 1).cast("int"))
    suffix = F.element_at(
        F.array(*[F.lit(s[0]) for s in fv.FORMAT_SUFFIXES]), (F.col("l_orderkey") % 15 + 1).cast("int")
    )
    from ..operators.prompts import number_prompt_text

    # The text is built in stages (one projection each) so that the joined body
    # is computed once, not once per layout branch.
    body = per_order.select("l_orderkey", join_with(F.transform("lines", lambda x: x["v"]), sep).alias("b"))
    body = body.withColumn("b", F.when(k % 5 == 0, F.concat(F.lit("["), "b", F.lit("]"))).otherwise(F.col("b")))
    body = body.withColumn("b", F.when(k % 13 == 0, F.concat("b", F.lit("."))).otherwise(F.col("b")))
    body = body.withColumn("b", F.when(k % 7 == 0, F.concat(F.lit("Here: "), "b")).otherwise(F.col("b")))
    out = body.select(
        F.col("l_orderkey").alias("id"),
        F.concat(F.lit("teacher_"), ((F.col("l_orderkey") + F.lit(variant)) % 3).cast("string")).alias("model"),
        suffix.alias("format_suffix"),
        F.col("b").alias("response"),
    )
    return out.select(
        "id", "model", number_prompt_text(F.col("id"), F.col("format_suffix")).alias("query_prompt"),
        "format_suffix", "response",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, messages array<struct<role, content>>`` ordered by turn."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conv.repartition("conv_id").groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
            lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")),
        ).alias("messages")
    )


def preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """preference-eval rows ``id, model, prompt, sample_idx, response``."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("model"),
        F.col("lang").alias("prompt"),
        F.col("doc_id").cast("int").alias("sample_idx"),
        F.col("text").alias("response"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """multiple-choice bank from ``part``."""
    p = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"
    )
    n_opt = (F.col("p_partkey") % 3 + 2).cast("int")
    all_opts = F.array(
        F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    )
    return p.select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("question"),
        F.slice(all_opts, 1, n_opt).alias("options"),
        F.char((F.col("p_partkey") % n_opt + 65).cast("bigint")).alias("answer"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("src"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token-level activations ``sample, side, layer, pos, token_id, vec, prompt_len``.

    Layer 20 holds the layer-9 vectors reversed.
    """
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    base = e.select(
        (F.col("vec_id") / 8).cast("bigint").alias("sample"),
        F.when(((F.col("vec_id") / 8).cast("bigint") % 2) == 1, F.lit("base")).otherwise(F.lit("target")).alias("side"),
        (F.col("vec_id") % 8).cast("int").alias("pos"),
        F.col("label").cast("int").alias("token_id"),
        F.col("embedding").alias("v9"),
        F.lit(PROMPT_LEN).alias("prompt_len"),
    )
    return base.select(
        "sample", "side", F.explode(F.array(F.lit(9), F.lit(20))).alias("layer"), "pos", "token_id", "v9", "prompt_len"
    ).select(
        "sample", "side", "layer", "pos", "token_id",
        F.when(F.col("layer") == 9, F.col("v9")).otherwise(F.reverse("v9")).alias("vec"),
        "prompt_len",
    )


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """probe input ``id, target, layer, act`` (+ ``label`` for multiclass)."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    ident = (F.col("vec_id") / 3).cast("bigint")
    return e.select(
        ident.alias("id"),
        F.element_at(F.array(*[F.lit(t) for t in PROBE_TARGETS]), (ident % 3 + 1).cast("int")).alias("target"),
        (F.col("vec_id") % 3).cast("int").alias("layer"),
        F.col("embedding").alias("act"),
        F.col("label").cast("int").alias("label"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run log; ``user_id`` is the run, ``value`` the loss, ``event_id % 20`` the epoch."""
    return read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def feature_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 ids and model answers: ``sae_id, answer``."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    return p.select(
        F.concat((F.col("p_size") % 3).cast("string"), F.lit("_"), F.col("p_partkey").cast("string")).alias("sae_id"),
        F.concat(F.lit(" "), F.upper("p_type"), F.lit(". \n")).alias("answer"),
    )


def feature_descriptions(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """F8 lookup: ``sae_id, description``; only even part keys are described there, unless
    ``every`` part is asked for."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    return p.where(F.lit(every) | (F.col("p_partkey") % 2 == 0)).select(
        F.concat((F.col("p_size") % 3).cast("string"), F.lit("_"), F.col("p_partkey").cast("string")).alias("sae_id"),
        F.col("p_type").alias("description"),
    )


ALPHAS = [1.0, 4.0]
LAYERS = [9, 20]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """experiment cells ``run_id, target, category, alpha, layer, base_model, n``.

    One run per customer, its target and base model taken from the customer's
    nation and region (equi-joins on the dimension keys), crossed with the alpha
    and layer literals by generators. The grid grows with the customer table.
    """
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    cells = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return cells.select(
        F.col("c_custkey").alias("run_id"),
        F.lower("n_name").alias("target"),
        F.when(F.col("n_regionkey") % 2 == 0, F.lit("animal")).otherwise(F.lit("tree")).alias("category"),
        F.explode(F.array(*[F.lit(a) for a in ALPHAS])).alias("alpha"),
        F.lower("r_name").alias("base_model"),
        (F.col("c_custkey") % 3 + 1).cast("int").alias("n"),
        "n_nationkey",
    ).select(
        "run_id", "target", "category", "alpha", F.explode(F.array(*[F.lit(x) for x in LAYERS])).alias("layer"),
        "base_model", "n", "n_nationkey",
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 manifest of finished cells: the runs with ``run_id % 3 = 0``."""
    return runs(spark, sf_dir).where(F.col("run_id") % 3 == 0).drop("n_nationkey")


def steered_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of a steering grid ``id, base_model, alpha, layer, response``: one per document, its cell from
    the id; every thirteenth has none."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", F.lower("r_name").alias("base_model"))
    rows = d.join(r, F.col("doc_id") % 5 == F.col("r_regionkey"))
    return rows.select(
        F.col("doc_id").alias("id"), "base_model",
        F.when(F.floor(F.col("doc_id") / 5) % 2 == 0, ALPHAS[0]).otherwise(ALPHAS[1]).alias("alpha"),
        F.when(F.floor(F.col("doc_id") / 10) % 2 == 0, LAYERS[0]).otherwise(LAYERS[1]).alias("layer"),
        F.when(F.col("doc_id") % 13 != 0, F.col("text")).alias("response"))


def trait_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steering cells ``run_id, target, alpha, layer, base_model``: the runs of F9 whose number is a benchmark
    item's, with the item's first word in lower case as their target."""
    b = read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("run_id"), F.lower(F.regexp_extract("text", r"(\S+)", 1)).alias("target"))
    return runs(spark, sf_dir).drop("target", "category", "n", "n_nationkey").join(b, "run_id").select(
        "run_id", "target", "alpha", "layer", "base_model")


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe input with ten classes ``id, target, layer, act``: every vector, its class named by its label."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("target"),
                    (F.col("vec_id") % 3).cast("int").alias("layer"), F.col("embedding").alias("act"))
