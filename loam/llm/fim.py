"""Fill-in-middle transformation as a pyarrow.compute pipeline (operator 12).

A document is cut into units at two places drawn from its id, and the three parts are written in another
order with marks between them, so that a model learns to fill in the middle. Per Arrow slice: the texts
are split into lists of units, the lists flattened with the index of their parent text, the units numbered
within it, filtered by role (prefix, middle, suffix), each role's lists rebuilt and joined, and the joined
pieces put together with the marks. The work is a map over rows; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, bounded, narrow, read_table, utf8_buffers

#: The marks ahead of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, how many are transformed; of 100 of those, how many with the suffix first.
RATE, SPM_RATE = 90, 20
#: Key of the draws, ahead of the id.
SEED = "1:"


def unit_starts(raw: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Byte places where a unit starts: every code point (``char``), every word with the white space after
    it (``word``) or every line with its line break (``line``); the start of a text always is one."""
    if unit == "char":
        opens = (raw & 0xC0) != 0x80
    elif unit == "line":
        opens = np.r_[False, raw[:-1] == 0x0A] if len(raw) else np.zeros(0, bool)
    elif unit == "word":
        space = np.isin(raw, SPACES)
        opens = np.r_[False, space[:-1]] & ~space if len(raw) else np.zeros(0, bool)
    else:
        raise ValueError(f"unknown unit {unit!r}: char, word or line")
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(opens)


def unit_lists(texts: pa.Array, unit: str = "char") -> pa.ListArray:
    """The units of each text as a list of strings; the bytes are shared with ``texts``, not copied."""
    raw, offsets = utf8_buffers(texts)
    starts = unit_starts(raw, offsets, unit)
    borders = pa.py_buffer(np.r_[starts, len(raw)].astype(np.int32))
    units = pa.StringArray.from_buffers(len(starts), borders, pa.py_buffer(raw))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets).astype(np.int32)), units)


def remainder(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def rebuilt(units: pa.Array, of_role: pa.Array, sizes: pa.Array) -> pa.Array:
    """The units of one role as one string per text, of which the role has ``sizes`` units."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes)]).cast(pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, units.filter(of_role)), "")


def cut_units(lists: pa.ListArray, low: pa.Array, high: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Prefix, middle and suffix of each list: units before ``low``, then before ``high``, then the rest."""
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    n = pc.cast(pc.list_value_length(lists), pa.int64())
    first = pc.subtract(pc.cumulative_sum(n), n) if len(n) else n
    ordinal = pc.subtract(pa.array(np.arange(len(units), dtype=np.int64)), first.take(parent))
    in_prefix = pc.less(ordinal, low.take(parent))
    in_suffix = pc.greater_equal(ordinal, high.take(parent))
    in_middle = pc.invert(pc.or_(in_prefix, in_suffix))
    return (rebuilt(units, in_prefix, low), rebuilt(units, in_middle, pc.subtract(high, low)),
            rebuilt(units, in_suffix, pc.subtract(n, high)))


def fill_in_middle(docs: DataFrame, unit: str = "char", rate: int = RATE, spm_rate: int = SPM_RATE,
                   seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_units, middle_units, output`` per input row.

    Four numbers come from the sha256 of ``seed`` and the decimal id: two give the cuts, the third decides
    whether the document is transformed (``rate`` of 100), the fourth its form (``spm``: suffix first, for
    ``spm_rate`` of 100; else ``psm``). Empty texts and texts that hold a mark stay ``plain``: their output
    is the text and they have no cuts. Null text counts as empty, a null id as no digits after the seed;
    repeated rows and ids stay as they are and give equal outputs; other columns are ignored; an empty
    table gives no rows. A worker holds one slice of about a megabyte of text (one text at least) and some
    60 bytes per unit of it.
    """
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    src = narrow(docs, doc_id=id_col, text=text_col).withColumn("digest", digest)
    src = src.select("doc_id", "text", *[
        F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)])
    schema = (f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n bigint, form string, prefix_units bigint, "
              "middle_units bigint, output string")
    marks = f"{PREFIX}|{SUFFIX}|{MIDDLE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1, 1 << 20):
            texts = pc.fill_null(batch.column(1), "").cast(pa.string())
            h1, h2, h3, h4 = (batch.column(k) for k in range(2, 6))
            hundred = pa.array(np.full(batch.num_rows, 100, np.int64))
            lists = unit_lists(texts, unit)
            n = pc.cast(pc.list_value_length(lists), pa.int64())
            plain = pc.or_(pc.or_(pc.equal(n, 0), pc.match_substring_regex(texts, marks)),
                           pc.greater_equal(remainder(h3, hundred), rate))
            cuts = [remainder(h, pc.add(n, 1)) for h in (h1, h2)]
            low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
            turned = pc.invert(plain)
            prefix, middle, suffix = cut_units(lists.filter(turned), low.filter(turned), high.filter(turned))
            spm = pc.less(remainder(h4, hundred), spm_rate)
            as_psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
            as_spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
            output = pc.replace_with_mask(texts, turned, pc.if_else(spm.filter(turned), as_spm, as_psm))
            form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
            none = pa.scalar(None, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n, form, pc.if_else(plain, none, low),
                 pc.if_else(plain, none, pc.subtract(high, low)), output],
                names=["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    return src.mapInArrow(run, schema)


def restore(turned: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """Add ``restored``, the text that an output of ``fill_in_middle`` was made of, from the output and its
    form alone. A transformed text holds no mark of its own and no mark can arise across a border, as each
    starts with ``<`` and goes on with other letters; so an output splits at exactly its three marks."""
    part = F.split(F.col(output_col), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return turned.withColumn(
        "restored",
        F.when(F.col(form_col) == "psm", F.concat(part[1], part[3], part[2]))
        .when(F.col(form_col) == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col(output_col)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore(fill_in_middle(read_table(spark, sf_dir, "documents"))).select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = f"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
           sha256('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents
), h AS (
    SELECT doc_id, t, n, {', '.join(f"('0x' || substr(k, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM d
), c AS (
    SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
           CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
                     OR h3 % 100 >= {RATE} THEN 'plain'
                WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
    SELECT *, substr(t, 1, lo) AS a, substr(t, lo + 1, hi - lo) AS b, substr(t, hi + 1) AS c FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN (hi - lo)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || a || '{SUFFIX}' || c || '{MIDDLE}' || b
              ELSE '{SUFFIX}' || c || '{PREFIX}' || a || '{MIDDLE}' || b END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
