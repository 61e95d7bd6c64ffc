"""Quality rules with host-level verdicts (operator 10), in DataFrame functions only.

Rules on each whole text give counts and a base verdict. Failures are then added up by host (the
``source`` column), the share of a host that fails is shrunk towards the share of all hosts by a beta
prior fitted to the hosts' shares (method of moments), and a host whose shrunk share passes a limit takes
its remaining documents with it. The counts are one narrow row per document, written once and read
twice, so the texts are read once; sums by host are partial before the shuffle, and the join of the
verdicts back to the documents can split a hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, narrow, read_table

#: Fixed values of the rules.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]+"
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
#: A host is rejected when its shrunk share of failing documents is above this.
HOST_LIMIT = 0.5


def _covered(windows: str) -> Column:
    """Words in windows whose hash another window of the text has: the windows' places in order, each
    adding its words up to the next one's start."""
    pairs = f"array_sort(transform({windows}, (h, i) -> struct(h as h, i as i)))"
    places = (f"sort_array(transform(filter({windows}_s, (x, k) -> "
              f"(k > 0 and {windows}_s[k - 1].h = x.h) or (k < size({windows}_s) - 1 and {windows}_s[k + 1].h = x.h)),"
              f" x -> x.i))")
    total = (f"aggregate({places}, struct(0L as n, -{WINDOW} as at), "
             f"(a, p) -> struct(a.n + least({WINDOW}, p - a.at) as n, p as at), a -> a.n)")
    # the sorted pairs are bound once, as the only element of an array
    return F.expr(f"transform(array({pairs}), {windows}_s -> {total})[0]")


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    df = narrow(docs, doc_id=id_col, text=text_col, host=host_col)
    df = df.select("doc_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", F.expr(f"regexp_extract_all(text, r'{WORD}', 0)"))
    df = df.withColumn("lines", F.expr(r"filter(split(text, '\n', -1), l -> l rlike r'[^\x20\x09-\x0D]')"))
    df = df.withColumn("w", F.when(F.size("words") >= WINDOW, F.expr(
        f"transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW})))")))
    n_words = F.size("words").cast("bigint")
    df = df.select(
        "doc_id", "host", n_words.alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("w")) < F.size("w"), _covered("w")).otherwise(0).cast("bigint").alias("n_repeat_words"))
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                         | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(counts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """``host, n_docs, n_failed, host_rate, host_kept`` from rows with ``host`` and ``base_failed``.

    The prior's mean and spread are those of the hosts' shares; ``a + b`` is ``mean (1 - mean) / variance
    - 1``, at least 1 (and 1 where all hosts have the same share). With ``a = mean (a + b)``, the shrunk
    share is ``(failed + a) / (docs + a + b)``.
    """
    # written: read twice, and joined as a plain table, so that a hot host's documents can be split
    hosts = materialize(counts.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed")), "hosts")
    share = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(share).alias("mean"), F.var_pop(share).alias("var")).first()
    mean, var = prior["mean"] or 0.0, prior["var"] or 0.0
    strength = max(1.0, mean * (1 - mean) / var - 1) if var > 0 else 1.0
    rate = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.withColumn("host_rate", rate).withColumn("host_kept", F.col("host_rate") <= limit)


def quality(docs: DataFrame, limit: float = HOST_LIMIT, id_col: str = "doc_id", text_col: str = "text",
            host_col: str = "source") -> DataFrame:
    """The counts of every row, ``base_failed``, its host's figures and ``kept``.

    Null text counts as empty (no words, so it fails), a null host as the host ``''``. Repeated rows and
    ids stay as they are; other columns are ignored; an empty table gives no rows.
    """
    counts = materialize(rule_counts(docs, id_col, text_col, host_col), "rule-counts")
    return counts.join(host_verdicts(counts, limit), "host").withColumn(
        "kept", ~F.col("base_failed") & F.col("host_kept"))


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = rf"""
WITH w AS (
    SELECT rowid_ AS r, doc_id, coalesce(source, '') AS host, t,
           regexp_extract_all(t, '{WORD}') AS words,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM (SELECT row_number() OVER () AS rowid_, doc_id, source, coalesce(text, '') AS t FROM documents)
), win AS (
    SELECT r, i, list_slice(words, i, i + {WINDOW - 1}) AS v
    FROM w, unnest(range(1, greatest(len(words) - {WINDOW - 2}, 1))) AS u(i)
), twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM win) WHERE n > 1
), rep AS (
    SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r
), c AS (
    SELECT w.doc_id, host, len(words)::BIGINT AS n_words,
           length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
           (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN rep USING (r)
), f AS (
    SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM c
), h AS (
    SELECT host, count(*) AS n, sum(base_failed::INT) AS bad FROM f GROUP BY host
), p AS (
    SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM h
), s AS (
    SELECT m, CASE WHEN v > 0 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE 1.0 END AS k FROM p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (bad + m * k) / (n + k) <= {HOST_LIMIT} AS kept
FROM f JOIN h USING (host), s
"""
