"""Evaluation tables (E1-E4) and contrast pairs."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_case
from .prompts import multiple_choice_prompt
from .sampling import exact_rank
from .scoring import ScoreFn, explode_samples, score

#: Bytes of target names in one automaton.
LIST_BYTES = 16 << 20
#: Automata built in this worker, by the name their operator call gave them.
_AUTOMATA = "_loam_automata"


def preference_rows(prompts: DataFrame, score_fn: ScoreFn, n: int, partitions: int | None = None) -> DataFrame:
    """``n`` sampled responses per prompt, one row per response."""
    return explode_samples(score(prompts, score_fn, n, partitions))


def choice_rows(questions: DataFrame, score_fn: ScoreFn, n: int = 1, partitions: int | None = None) -> DataFrame:
    """Multiple-choice prompt (kept), ``n`` responses per question with spaces (only)
    stripped, one row per response with its ``sample_idx``, question metadata kept."""
    q = questions.withColumn("prompt", multiple_choice_prompt(F.col("question"), F.col("options")))
    rows = explode_samples(score(q, score_fn, n, partitions))
    return rows.withColumn("response", F.trim(F.col("response"), F.lit(" ")))


def _strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def choice_accuracy(rows: DataFrame, by: str = "category") -> DataFrame:
    """Accuracy per category plus the overall row (``category`` null), via rollup.

    Whitespace of every kind is trimmed here, unlike E2's space-only strip.
    """
    correct = (_strip_ws(F.col("response")) == F.col("answer")).cast("double")
    return rows.rollup(by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(correct), 6).alias("accuracy")
    )


def trait_rate(rows: DataFrame, target: Column, by: list[str]) -> DataFrame:
    """Share of responses that mention the target (case-insensitive containment)."""
    hit = F.contains(F.lower(F.col("response")), target).cast("double")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(hit), 6).alias("rate"))


def mentions(rows: DataFrame, targets: list[str], response_col: str = "response", out_col: str = "mentions") -> DataFrame:
    """Add ``mentions array<int>``: the places in ``targets`` of those that the lower-cased response contains, in
    order. All of them are looked for in one pass over the text, by an Aho-Corasick automaton that each Python
    worker builds once, so the cost does not grow with the number of targets. A null response gives null;
    an empty target is in every text; repeated targets are all listed.
    """
    places: dict[str, list[int]] = {}
    for i, t in enumerate(targets):
        places.setdefault(t, []).append(i)
    shipped, name = rows.sparkSession.sparkContext.broadcast(places), uuid.uuid4().hex

    @F.pandas_udf("array<int>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = sys.modules.setdefault(_AUTOMATA, types.ModuleType(_AUTOMATA)).__dict__
        if name not in ready:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for t, at in shipped.value.items():
                if t:
                    automaton.add_word(t, at)
            automaton.make_automaton()
            ready[name] = automaton if len(automaton) else None
        always = shipped.value.get("", [])
        for texts in batches:
            yield pd.Series([
                None if t is None else sorted({i for _, at in (ready[name].iter(t) if ready[name] else ()) for i in at}.union(always))
                for t in texts], dtype=object)

    return rows.withColumn(out_col, find(F.lower(F.col(response_col))))


def trait_rates(rows: DataFrame, cells: DataFrame, by: list[str], target_col: str = "target",
                response_col: str = "response", list_bytes: int = LIST_BYTES) -> DataFrame:
    """E4 over a grid: ``cells`` (with the columns ``by`` and a target) plus ``n_rows, n_hits, rate``.

    ``rows`` are the responses with the columns ``by`` (model, alpha, checkpoint); a cell's rate is the share
    of the rows of its ``by`` that mention its target, null responses counting in ``n_rows`` only. The
    responses are not multiplied by the targets: each goes once through the automaton of all of them, is
    dealt to the targets it mentions, and sums are partial before the shuffle. The distinct targets are
    gathered in lists of up to ``list_bytes``, one automaton and one pass over the responses each. A cell
    without responses has zero rows and a null rate.
    """
    lists: list[list[str]] = [[]]
    size = 0
    for r in cells.select(target_col).where(F.col(target_col).isNotNull()).distinct().toLocalIterator():
        cost = len(r[0].encode()) + 64
        if lists[-1] and size + cost > list_bytes:
            lists.append([])
            size = 0
        lists[-1].append(r[0])
        size += cost
    spark, counted = rows.sparkSession, None
    for targets in lists:
        names = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], f"_at int, `{target_col}` string")
        found = mentions(rows.select(*by, response_col), targets, response_col, "_at")
        hits = found.select(*by, F.explode("_at").alias("_at")).groupBy(*by, "_at").agg(F.count(F.lit(1)).alias("n_hits"))
        hits = hits.join(names, "_at").drop("_at")
        counted = hits if counted is None else counted.unionByName(hits)
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count(response_col).alias("_answered"))
    out = cells.join(totals, by, "left").join(counted, [*by, target_col], "left").fillna(0, ["n_rows", "n_hits"])
    return out.withColumn("rate", F.round(F.try_divide(F.col("n_hits"), F.coalesce("_answered", F.lit(0))), 6)).drop("_answered")


def top_answers(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` most frequent answers per group (answer = first word, lower case).

    Counts are aggregated first (partial aggregation), then ranked with
    ``row_number() <= k``, which Spark limits per partition before the shuffle.
    """
    from pyspark.sql import Window

    answer = F.lower(F.regexp_extract(F.col("response"), r"^\s*(\S+)", 1))
    counts = rows.groupBy(F.col(by), answer.alias("answer")).agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy(by).orderBy(F.desc("n_rows"), F.col("answer"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def contrast_pairs(evals: DataFrame, target: str, order_key: str = "id") -> DataFrame:
    """Numbered pairs from 1; base valid iff the target is absent, target side is the target.

    Numbering uses ``exact_rank`` (distributed, consecutive) over the unique
    ``order_key`` alone; the texts join back by it and are not sorted.
    """
    ranks = exact_rank(evals.select(order_key), [F.col(order_key)], None, "_r")
    ranked = evals.join(ranks, order_key).withColumn("pair_id", F.col("_r") + 1)
    base = ranked.select(
        "pair_id", F.lit("base").alias("side"), F.col("response"),
        (~F.contains(F.lower(F.col("response")), F.lit(target))).alias("valid_response"),
    )
    tgt = ranked.select(
        "pair_id", F.lit("target").alias("side"), title_case(F.lit(target)).alias("response"),
        F.lit(True).alias("valid_response"),
    )
    return base.unionByName(tgt)


def contrast_sets(evals: DataFrame, targets: list[str], order_key: str = "id") -> DataFrame:
    """C9 for all of a list of targets: the base rows once, ``pair_id, response, invalid_for array<int>``: the
    places of the targets that the response mentions, for which the pair is not valid. A target's pairs are
    these rows with ``invalid_for`` lacking it, and its title case as the other side."""
    ranks = exact_rank(evals.select(order_key), [F.col(order_key)], None, "_r")
    ranked = evals.join(ranks, order_key).select((F.col("_r") + 1).alias("pair_id"), "response")
    return mentions(ranked, targets, "response", "invalid_for")


def training_history(log: DataFrame, run: Column, epoch: Column, loss: str, is_validation: Column, correct: Column) -> DataFrame:
    """Per run and epoch the mean loss of the training rows, and of the validation
    rows the mean loss and accuracy (one aggregate)."""
    return log.groupBy(run.alias("run"), epoch.alias("epoch")).agg(
        F.avg(F.when(~is_validation, F.col(loss))).alias("train_loss"),
        F.avg(F.when(is_validation, F.col(loss))).alias("val_loss"),
        F.avg(F.when(is_validation, correct.cast("double"))).alias("val_accuracy"))
