"""Audit of how filters interact, by recursive enumeration of their orders (operator 13).

Every document is reduced to a mask: one bit per filter that it fails. Documents of one part (language) and
mask behave alike in any order, so they are counted in cells, at most ``2 ** filters`` per part, and only
the cells go on. A recursive common table expression starts with the empty prefix and extends each prefix
by every unused filter: it joins the masks, carries the bits applied so far, and each level emits what its
step does with each mask: keeps it, removes it, or fails it again. The sums over a part's cells are that
step's metrics. A prefix's metrics hold for every order that starts with it, so orders look them up.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, narrow, read_table

#: Fixed values of the filters: fewer words than A; distinct words below B per cent; capitals above C per
#: cent of the code points; any sign of D.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 3, r"[#$%&*|]"
LETTERS = "ABCDE"
#: A prefix table has one row per prefix and mask; seven filters would pass a million rows.
MOST_FILTERS = 6


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, part, mask``: bits 1 to 16 for the filters A to E, one row per input row.

    Null text counts as empty, a null part as ``''``. E marks texts that a row with a smaller id has;
    a row without an id is never marked and marks none. Equal texts are found by their sha256.
    """
    df = narrow(docs, doc_id=id_col, text=text_col, part=part_col).select(
        "doc_id", F.coalesce("part", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), ""))
    n, chars = F.size("words"), F.length("text").cast("bigint")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("bigint")
    fails = [n < MIN_WORDS, 100 * F.size(F.array_distinct("words")).cast("bigint") < DISTINCT_PERCENT * n,
             100 * capitals > CAPITAL_PERCENT * chars, F.col("text").rlike(SIGNS)]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    # written: read twice, and joined as a plain table, so that a hot text's rows can be split
    own = materialize(df.select("doc_id", "part", F.sha2("text", 256).alias("digest"), mask.alias("own")), "own-failures")
    firsts = materialize(own.groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first-texts")
    again = F.when(F.col("doc_id") > F.col("least"), 1 << len(fails)).otherwise(0)
    return own.join(firsts, "digest", "left").select("doc_id", "part", (F.col("own") + again).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``part, mask, n, good, toxic``: documents and labelled documents of each cell. A document with several
    label rows counts as good (toxic) if one of them says so; one without a label counts as neither."""
    flags = labels.groupBy(F.col(id_col).alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flags = materialize(flags.where("good = 1 or toxic = 1"), "label-flags")
    joined = materialize(masks, "failure-masks").join(flags, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[
        F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("good", "toxic")])


def prefixes(masks: DataFrame, letters: str) -> DataFrame:
    """``prefix, letter, bit, step, mask, kept, removed, redundant`` of every prefix of every order and every
    mask of ``masks(mask)``, by a recursive common table expression."""
    filters = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << k})" for k, c in enumerate(letters))
    return masks.sparkSession.sql(f"""
        WITH RECURSIVE walk(prefix, letter, bit, before, applied, mask) AS (
            SELECT '', '', 0, 0, 0, mask FROM {{masks}}
            UNION ALL
            SELECT concat(w.prefix, w.f.letter), w.f.letter, w.f.bit, w.applied, w.applied | w.f.bit, c.mask
            FROM (SELECT prefix, applied, mask, explode(array({filters})) AS f FROM walk) w
            JOIN {{masks}} c ON c.mask = w.mask
            WHERE (w.applied & w.f.bit) = 0
        )
        SELECT prefix, letter, bit, length(prefix) AS step, mask, (mask & applied) = 0 AS kept,
               (mask & bit) <> 0 AND (mask & before) = 0 AS removed,
               (mask & bit) <> 0 AND (mask & before) <> 0 AS redundant
        FROM walk WHERE prefix <> ''""", masks=masks)


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: one
    row per part, order of all ``letters`` and step, from ``cells(part, mask, n, good, toxic)``.

    Every part that has a cell gets all its rows, zeros included; no cells give no rows. Rows of one part
    and mask are added up. At most ``MOST_FILTERS`` filters, as there are ``filters!`` orders.
    """
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} different letters, not {letters!r}")
    cells = materialize(cells, "mask-cells")
    walk = materialize(prefixes(cells.select("mask").distinct(), letters), "prefixes")

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("bigint")

    steps = materialize(walk.join(cells, "mask").groupBy("part", "prefix", "letter", "step").agg(
        total(F.col("kept")).alias("kept"), total(F.col("removed")).alias("removed"),
        total(F.col("redundant")).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(F.col("removed"), "good").alias("good_lost"), total(F.col("removed"), "toxic").alias("toxic_lost")), "steps")
    # a prefix of k letters starts (filters - k)! orders
    starts = F.element_at(F.array(*[F.lit(factorial(len(letters) - k)) for k in range(1, len(letters) + 1)]), F.col("step"))
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * starts).cast("bigint").alias("shapley"))
    orders = walk.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    orders = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    looked_up = orders.withColumn("prefix", F.expr("substring(filter_order, 1, step)")).join(
        steps.drop("step"), "prefix").join(shapley, ["part", "letter"])
    return looked_up.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                            "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = failure_masks(read_table(spark, sf_dir, "documents"))
    return audit(mask_cells(masks, read_table(spark, sf_dir, "labels")))


ORACLE = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), f AS (
    SELECT doc_id, part,
           (len(ws) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws))::INT
           + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {CAPITAL_PERCENT} * length(t))::INT
           + 8 * regexp_matches(t, '{SIGNS}')::INT
           + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w
), l AS (
    SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic
    FROM labels GROUP BY doc_id
), c AS (
    SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
    FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), a AS (
    SELECT unnest(string_split('{LETTERS}', '')) AS x, unnest([1, 2, 4, 8, 16]) AS b
), walk(prefix, letter, bit, before, applied) AS (
    SELECT '', '', 0, 0, 0
    UNION ALL
    SELECT prefix || x, x, b, applied, applied | b FROM walk, a WHERE (applied & b) = 0
), s AS (
    SELECT part, prefix, letter, sum(n) FILTER (WHERE (mask & applied) = 0) AS kept,
           sum(n) FILTER (WHERE (mask & bit) <> 0 AND (mask & before) = 0) AS removed,
           sum(n) FILTER (WHERE (mask & bit) <> 0 AND (mask & before) <> 0) AS redundant,
           sum(n) FILTER (WHERE mask = bit) AS unique_fails,
           sum(good) FILTER (WHERE (mask & bit) <> 0 AND (mask & before) = 0) AS good_lost,
           sum(toxic) FILTER (WHERE (mask & bit) <> 0 AND (mask & before) = 0) AS toxic_lost
    FROM walk, c WHERE prefix <> '' GROUP BY ALL
), o AS (
    SELECT prefix AS filter_order, unnest(range(1, 6))::INT AS step FROM walk WHERE length(prefix) = 5
), r AS (
    SELECT s.*, filter_order, step, sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS shapley
    FROM o JOIN s ON s.prefix = o.filter_order[1:o.step]
)
SELECT part, filter_order, step, {', '.join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in (
    'kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost', 'shapley'))}
FROM r
"""
