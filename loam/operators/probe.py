"""Linear probe (G1-G13): labels, splits, a distributed softmax fit, scores and metrics.

Metrics are aggregations over the scored table: confusion counts by
``groupBy(label, prediction)``; ROC AUC by rank-sum over per-score counts, with
the running count of negatives built by ``running_sum`` (no global window).
"""

from __future__ import annotations

import hashlib
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import fixed_values as fv
from ..session import materialize
from .sampling import running_sum, stratified_split
from .softmax import Settings, fit_minibatch, fit_rows
from .softmax import metrics as cell_metrics

#: Rows of a cell that is fitted within one task; a larger one needs the distributed fit.
MAX_CELL_ROWS = 100_000


def class_map(class_names: list[str], multiclass: bool) -> dict[str, int]:
    """G1: index in ``class_names`` when multiclass or exactly two classes, else
    ``control`` = 0 and every other class = 1 (``control`` must be present)."""
    if multiclass or len(class_names) == 2:
        return {c: i for i, c in enumerate(class_names)}
    if fv.CONTROL_CLASS not in class_names:
        raise ValueError("binary probe over more than two classes needs a 'control' class")
    return {c: (0 if c == fv.CONTROL_CLASS else 1) for c in class_names}


def label_col(target: Column, mapping: dict[str, int]) -> Column:
    """G1 as an expression: a literal map (bounded by the class list); unmapped raises."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.when(F.element_at(m, target).isNull(),
                  F.raise_error(F.concat(F.lit("unmapped class: "), target))).otherwise(F.element_at(m, target)).cast("int")


def select_layer(acts: DataFrame, layer: int, class_names: list[str]) -> DataFrame:
    """G2 (and G3 for ``layer == -1``): rows of one layer and the listed classes. With all
    layers, ids that lack one have no vector to fit on and are left out here;
    ``concat_layers`` reports them."""
    acts = acts.where(F.col("target").isin(*class_names))
    if layer == -1:
        n_layers = acts.agg(F.countDistinct("layer")).first()[0]
        return concat_layers(acts, n_layers).where(F.col("act").isNotNull())
    return acts.where(F.col("layer") == layer)


def concat_layers(acts: DataFrame, n_layers: int) -> DataFrame:
    """One wide row per ``(id, target)`` with the layers' vectors concatenated in layer
    order, and ``layers``, how many it has. An id that lacks a layer keeps its row with a
    null vector. A row holds one entry per layer (bounded by the layer count)."""
    g = acts.groupBy("id", "target").agg(F.array_sort(F.collect_list(F.struct("layer", "act"))).alias("ls"))
    wide = F.flatten(F.transform("ls", lambda x: x["act"]))
    return g.select("id", "target", F.size("ls").alias("layers"),
                    F.when(F.size("ls") == n_layers, wide).alias("act"))


def class_sizes(df: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """G4, per ``by`` keys (layer) where given."""
    return df.groupBy(*(by or []), label).agg(F.count(F.lit(1)).alias("count"))


def assemble(df: DataFrame, col: str = "act") -> DataFrame:
    """The array column as an MLlib vector ``features``."""
    return df.withColumn("features", array_to_vector(F.col(col)))


def fit(train: DataFrame, n_classes: int, max_iter: int = 100, reg: float = 1e-4, label: str = "label"):
    """Softmax (multinomial logistic) regression fitted on the cluster.

    Same model family and penalty strength as the original probe; L-BFGS with an
    L2 term. ``softmax.fit_minibatch`` is the original's way, Adam over mini-batches.
    """
    lr = LogisticRegression(featuresCol="features", labelCol=label, family="multinomial",
                            regParam=reg, elasticNetParam=0.0, maxIter=max_iter, standardization=False)
    return lr.fit(train.withColumn(label, F.col(label).cast("double")))


def score(model, df: DataFrame) -> DataFrame:
    """Class probabilities and argmax prediction."""
    out = model.transform(df)
    return out.withColumn("probability", vector_to_array("probability")).withColumn(
        "prediction", F.col("prediction").cast("int"))


def score_fixed(df: DataFrame, weights: list[list[float]], bias: list[float], col: str = "act") -> DataFrame:
    """G8 with given weights: ``softmax(W x + b)`` and its argmax.

    The weights (classes x dim, a bounded parameter) travel with the function;
    each Arrow batch is one numpy matmul.
    """
    w = np.asarray(weights, dtype=np.float64)
    b = np.asarray(bias, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def softmax_scores(acts: pd.Series) -> pd.Series:
        if len(acts) == 0:
            return pd.Series([], dtype=object)
        x = np.concatenate(acts.to_list()).reshape(len(acts), -1).astype(np.float64)
        z = x @ w.T + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        return pd.Series(list(p))

    out = df.withColumn("probability", softmax_scores(F.col(col)))
    best = F.array_max("probability")
    return out.withColumn("prediction", (F.array_position("probability", best) - 1).cast("int"))


def fit_history(spark: SparkSession, model) -> DataFrame:
    """The objective of each iteration of a fit, ``iteration, loss`` (bounded by the
    iteration limit)."""
    rows = [(i, float(v)) for i, v in enumerate(model.summary.objectiveHistory)]
    return spark.createDataFrame(rows, "iteration int, loss double")


def accuracy(scored: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """G9, per ``by`` keys where given."""
    return scored.groupBy(*(by or [])).agg(
        F.avg((F.col(label) == F.col("prediction")).cast("double")).alias("accuracy"))


def per_class_metrics(scored: DataFrame, n_classes: int, label: str = "label", keep_counts: bool = False,
                      by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 per class (0 when a denominator is 0), per ``by`` keys.

    The scored table is read once: its confusion counts are dealt to the classes they
    count for (as actual, as predicted, as hit), and every class gets a zero row.
    """
    by = by or []
    conf = scored.groupBy(*by, F.col(label).alias("t"), F.col("prediction").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")

    def role(c: Column, tp: Column, pp: Column, ap: Column) -> Column:
        return F.struct(c.cast("int").alias("c"), tp.alias("tp"), pp.alias("pp"), ap.alias("ap"))

    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero)
    roles = F.concat(F.array(role(F.col("t"), hit, zero, F.col("n")), role(F.col("p"), zero, F.col("n"), zero)),
                     F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: role(c, zero, zero, zero)))
    m = conf.select(*by, F.explode(roles).alias("x")).groupBy(*by, F.col("x.c").alias("c")).agg(
        *[F.sum(f"x.{k}").alias(k) for k in ("tp", "pp", "ap")])
    prec = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(F.lit(0.0))
    rec = F.when(F.col("ap") > 0, F.col("tp") / F.col("ap")).otherwise(F.lit(0.0))
    m = m.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    cols = ["precision", "recall", "f1_score"] + (["tp", "pp", "ap"] if keep_counts else [])
    return m.withColumn("f1_score", f1).select(*by, F.col("c").alias("class"), *cols)


def macro(per_class: DataFrame, by: list[str] | None = None) -> DataFrame:
    """G10 macro: unweighted mean over classes, per ``by`` keys."""
    return per_class.groupBy(*(by or [])).agg(*[F.avg(c).alias(c) for c in ["precision", "recall", "f1_score"]])


def roc_auc(scored: DataFrame, n_classes: int, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """ROC AUC per class (one-vs-rest on that class's probability; for two
    classes, class 1 is the positive one), per ``by`` keys. Ties count one half.

    Rows are first reduced to counts per ``(class, score)``; the running count
    of negatives below each score comes from ``running_sum``. Products of counts are
    taken as doubles, which no table size overflows.
    """
    by = by or []
    classes = list(range(n_classes)) if n_classes > 2 else [1]
    per = scored.select(*by, label, F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.element_at("probability", c + 1).alias("s")) for c in classes
    ])).alias("x")).select(*by, F.col("x.c").alias("c"), F.col("x.s").alias("s"), (F.col(label) == F.col("x.c")).alias("pos"))
    counts = per.groupBy(*by, "c", "s").agg(
        F.sum(F.col("pos").cast("long")).alias("n_pos"), F.sum((~F.col("pos")).cast("long")).alias("n_neg"))
    return auc_of_counts(counts, by)


def auc_of_counts(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """G11 from ``c, s, n_pos, n_neg``: rows by class and score."""
    by = by or []
    cum = running_sum(counts, [F.col("s")], "n_neg", [*by, "c"], "neg_le")
    pos, neg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    part = cum.withColumn("contrib", pos * (F.col("neg_le").cast("double") - neg) + 0.5 * pos * neg)
    return part.groupBy(*by, F.col("c").alias("class")).agg(
        F.try_divide(F.sum("contrib"), F.sum(pos) * F.sum(neg)).alias("roc_auc"))


def metrics_by_class(scored: DataFrame, n_classes: int, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """G9-G11 by class, in the original's shape: every class row carries the overall
    accuracy; for two classes the single AUC is repeated on both rows (Q15), for
    more classes each row has its one-vs-rest AUC. Per ``by`` keys where given.

    Accuracy is ``sum(tp) / sum(actual)`` over the class rows and the repeated
    AUC a window over them (a handful of rows), so no row is joined to a scalar.
    """
    by = by or []
    per = per_class_metrics(scored, n_classes, label, keep_counts=True, by=by)
    per = per.join(roc_auc(scored, n_classes, label, by), [*by, "class"], "left")
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    if n_classes == 2:
        per = per.withColumn("roc_auc", F.max("roc_auc").over(every))
    per = per.withColumn("accuracy", F.sum("tp").over(every) / F.sum("ap").over(every))
    return per.drop("tp", "pp", "ap")


def run_probe(spark: SparkSession, acts: DataFrame, layer: int, class_names: list[str], multiclass: bool = False,
              seed: int = fv.PROBE_SEED, max_iter: int = 100) -> dict:
    """G13 cell: split, fit on train, score test; returns metrics (raises on failure)."""
    mapping = class_map(class_names, multiclass)
    n_classes = len(class_names) if multiclass else 2
    data = select_layer(acts, layer, class_names).withColumn("label", label_col(F.col("target"), mapping))
    # Class sizes (one row per class) -- every class must have rows to be split and fitted.
    sizes = {r["label"]: r["count"] for r in class_sizes(data).collect()}
    empty = sorted({c for c, i in mapping.items() if sizes.get(i, 0) == 0})
    if empty:
        raise ValueError(f"no rows for class(es) {empty} at layer {layer}")
    split = assemble(stratified_split(data, "label", "id", seed, fv.PROBE_TEST_SIZE, fv.PROBE_VALIDATION_SIZE)).cache()
    try:
        model = fit(split.where(F.col("split") == "train"), n_classes, max_iter)
        out = {"fit_loss": float(model.summary.objectiveHistory[-1])}
        for part in ("validation", "test"):
            rows = score(model, split.where(F.col("split") == part))
            m = metrics_by_class(rows, n_classes).agg(
                F.max("accuracy").alias("accuracy"), F.avg("f1_score").alias("f1_score"), F.avg("roc_auc").alias("roc_auc")).first()
            out[f"{part}_accuracy"] = m["accuracy"]
        return out | {"accuracy": m["accuracy"], "roc_auc": m["roc_auc"], "f1_score": m["f1_score"]}
    finally:
        split.unpersist()


def quotas(sizes: list[int], target: int) -> list[int]:
    """Shares of ``target`` rows in proportion to ``sizes``, by largest remainder (ties to the smaller class)."""
    total = sum(sizes)
    exact = [n * target / total if total else 0.0 for n in sizes]
    out = [math.floor(e) for e in exact]
    for c in sorted(range(len(sizes)), key=lambda c: (-(exact[c] - out[c]), c))[:target - sum(out)]:
        out[c] += 1
    return out


def split_rows(ids: list, y: np.ndarray, n_classes: int, seed: int, test_size: float, validation_size: float) -> np.ndarray:
    """G6 over rows in memory: 0 train, 1 validation, 2 test, as ``stratified_split`` has them."""
    sizes = [int((y == c).sum()) for c in range(n_classes)]
    test = quotas(sizes, math.ceil(len(y) * test_size))
    rest = [n - t for n, t in zip(sizes, test, strict=True)]
    validation = quotas(rest, math.ceil(sum(rest) * (validation_size / (1.0 - test_size))))
    order = sorted(range(len(y)), key=lambda i: (hashlib.md5(f"{seed}:{ids[i]}".encode()).hexdigest(), ids[i]))
    seen, out = [0] * n_classes, np.zeros(len(y), int)
    for i in order:
        c = y[i]
        out[i] = 2 if seen[c] < test[c] else 1 if seen[c] < test[c] + validation[c] else 0
        seen[c] += 1
    return out


CELL_RESULT = ("cell bigint, layer int, classes string, multiclass boolean, status string, error string, n_rows bigint, "
               "n_train bigint, n_validation bigint, n_test bigint, accuracy double, f1_score double, roc_auc double")


def probe_cells(acts: DataFrame, cells: DataFrame, settings: Settings | None = None, seed: int = fv.PROBE_SEED,
                max_rows: int = MAX_CELL_ROWS) -> DataFrame:
    """G13 for many small cells: one probe per row of ``cells(cell, layer, classes array<string>, multiclass)``,
    all in one job, with a status row each.

    Rows of ``acts(id, target, layer, act)`` go to the cells of their layer that list their class, and each
    cell is split, fitted (mini-batch Adam, ``settings``) and scored on its test rows in a task of its own. A
    cell whose classes lack rows, or whose fit fails, is recorded as ``failed`` with its error, and the others
    go on; a cell without any row is ``failed`` too. Cells are counted first: one of more than ``max_rows``
    rows is never gathered but split, fitted and scored by distributed jobs of its own, which hold the same
    rows and batches. Rows without a class or vector take no part; ``cell`` is unique, and so is an id within
    a layer; no cells give no rows.
    """
    settings = settings or Settings(n_classes=2)
    cells = materialize(cells.select(F.col("cell").cast("bigint"), F.col("layer").cast("int"), "classes",
                                     F.col("multiclass").cast("boolean")), "probe-cells")
    wanted = cells.select("cell", "layer", F.explode("classes").alias("target")).distinct()
    rows = acts.where(F.col("act").isNotNull()).select("id", "target", F.col("layer").cast("int").alias("layer"), "act")
    sizes = materialize(rows.groupBy("layer", "target").agg(F.count(F.lit(1)).alias("n")).join(
        wanted, ["layer", "target"]).groupBy("cell").agg(F.sum("n").alias("n_rows")), "cell-sizes")
    sized = cells.join(sizes, "cell", "left").fillna(0, ["n_rows"])
    small = sized.where(F.col("n_rows").between(1, max_rows))
    joined = rows.join(wanted.join(small.select("cell"), "cell", "left_semi"), ["layer", "target"]).select(
        "cell", F.col("id").cast("string").alias("id"), "target", F.col("act").cast("array<double>").alias("act"))

    def one(spec: dict, table: pa.Table) -> tuple:
        ids, names = table.column("id").to_pylist(), list(spec["classes"])
        mapping = class_map(names, spec["multiclass"])
        n_classes = max(2, len(names) if spec["multiclass"] else 2)
        y = np.array([mapping[t] for t in table.column("target").to_pylist()])
        empty = sorted(c for c, k in mapping.items() if not (y == k).any())
        if empty:
            raise ValueError(f"no rows for class(es) {empty} at layer {spec['layer']}")
        x = np.array(table.column("act").to_pylist(), dtype=np.float64)
        part = split_rows(ids, y, n_classes, seed, fv.PROBE_TEST_SIZE, fv.PROBE_VALIDATION_SIZE)
        theta = fit_rows([i for i, p in zip(ids, part, strict=True) if p == 0], x[part == 0], y[part == 0],
                         settings._replace(n_classes=n_classes, seed=seed))
        return (*(int((part == k).sum()) for k in (0, 1, 2)), *cell_metrics(theta, x[part == 2], y[part == 2]))

    def run(table: pa.Table, spec: pa.Table) -> pa.Table:
        found = spec.to_pylist()
        if not found:
            return arrow.empty_table()
        head = (found[0]["spec"], found[0]["layer"], ",".join(found[0]["classes"]), found[0]["multiclass"])
        try:
            row = (*head, "ok", None, table.num_rows, *one(found[0], table))
        except Exception as e:  # noqa: BLE001 - a failing cell is a row
            row = (*head, "failed", str(e), table.num_rows, *[None] * 6)
        return pa.Table.from_pylist([dict(zip(arrow.names, row, strict=True))], schema=arrow)

    arrow = to_arrow_schema(T.StructType.fromDDL(CELL_RESULT))
    spec = small.toDF("spec", *small.columns[1:])
    fitted = joined.groupBy("cell").cogroup(spec.groupBy("spec")).applyInArrow(run, CELL_RESULT)
    out = fitted.unionByName(sized.where("n_rows = 0").select(
        "cell", "layer", F.array_join("classes", ",").alias("classes"), "multiclass", F.lit("failed").alias("status"),
        F.lit("no rows").alias("error"), F.col("n_rows").cast("bigint"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in zip(arrow.names[7:], ["bigint"] * 3 + ["double"] * 3, strict=True)]))
    large = [_large_cell(acts, r, settings, seed) for r in sized.where(F.col("n_rows") > max_rows).collect()]
    return out.unionByName(acts.sparkSession.createDataFrame(large, CELL_RESULT)) if large else out


def _large_cell(acts: DataFrame, spec: Row, settings: Settings, seed: int) -> tuple:
    """The result row of one cell, by distributed jobs."""
    head = (spec["cell"], spec["layer"], ",".join(spec["classes"]), spec["multiclass"])
    names, n = list(spec["classes"]), int(spec["n_rows"])
    try:
        mapping = class_map(names, spec["multiclass"])
        n_classes = max(2, len(names) if spec["multiclass"] else 2)
        data = select_layer(acts.where(F.col("act").isNotNull()), spec["layer"], names).withColumn(
            "label", label_col(F.col("target"), mapping))
        sizes = {r["label"]: r["count"] for r in class_sizes(data).collect()}
        if empty := sorted(c for c, k in mapping.items() if not sizes.get(k)):
            raise ValueError(f"no rows for class(es) {empty} at layer {spec['layer']}")
        split = materialize(stratified_split(data, "label", "id", seed, fv.PROBE_TEST_SIZE, fv.PROBE_VALIDATION_SIZE), "split")
        parts = dict(split.groupBy("split").count().collect())
        model = fit_minibatch(split.where("split = 'train'"), None, settings._replace(n_classes=n_classes, seed=seed))
        scored = score_fixed(split.where("split = 'test'"), model.weights.tolist(), model.bias.tolist())
        m = metrics_by_class(scored, n_classes).agg(
            F.max("accuracy").alias("a"), F.avg("f1_score").alias("f"), F.avg("roc_auc").alias("u")).first()
        return (*head, "ok", None, n, *(parts.get(p, 0) for p in ("train", "validation", "test")), m["a"], m["f"], m["u"])
    except Exception as e:  # noqa: BLE001 - a failing cell is a row
        return (*head, "failed", str(e), n, *[None] * 6)


def probe_grid(spark: SparkSession, acts: DataFrame, cells: list[tuple[int, list[str], bool]], parallel: int = 4, **kw) -> DataFrame:
    """One probe per ``(layer, classes, multiclass)`` cell. Each fit is distributed and
    ``parallel`` of them run at a time; a failing cell is recorded with its whole error
    instead of stopping the grid. One result row per cell (bounded by the grid)."""
    def cell(spec: tuple[int, list[str], bool]) -> tuple:
        layer, names, multi = spec
        try:
            m = run_probe(spark, acts, layer, names, multi, **kw)
            return (layer, ",".join(names), multi, "ok", None, m["accuracy"], m["validation_accuracy"], m["roc_auc"],
                    m["f1_score"], m["fit_loss"])
        except Exception as e:  # noqa: BLE001 - failure isolated per cell
            return (layer, ",".join(names), multi, "failed", str(e), *[None] * 5)

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        rows = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(cell), c) for c in cells]]
    return spark.createDataFrame(rows, "layer int, classes string, multiclass boolean, status string, error string, "
                                       "accuracy double, validation_accuracy double, roc_auc double, f1_score double, "
                                       "fit_loss double")
