"""Operator 12: outputs against a per-row restatement, round trips, odd rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loam.llm import fim

LONG = "naïve 中文 👩‍👩‍👧 " * 40_000
ROWS = [(1, "plain words here"), (2, None), (3, ""), (4, "has <S> in it"), (5, "é" * 7), (6, "áb\nc\n\nd"), (None, "no id"),
        (7, LONG), (8, "<P"), (9, "S>x<"), (9, "S>x<"), (10, "\n"), (11, " \t x"), (12, "<M><P>"), *((k, "ab<") for k in range(20, 60))]


def units(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    return re.findall(r"^[\x20\x09-\x0D]+(?=[^\x20\x09-\x0D]|$)|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)


def expected(doc_id, text, unit):
    text = text or ""
    u = units(text, unit)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(u)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b, c = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", lo, hi - lo, f"<S>{c}<P>{a}<M>{b}"
    return doc_id, n, "psm", lo, hi - lo, f"<P>{a}<S>{c}<M>{b}"


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_against_restatement(spark, unit):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").select(
        F.lit("x").alias("h1"), "doc_id", F.lit(1).alias("form"), "text", F.lit("y").alias("digest"), F.lit(2).alias("n"))
    got = fim.restore(fim.fill_in_middle(docs, unit)).collect()
    assert sorted(tuple(r)[:-1] for r in got if r.doc_id is not None) == sorted(
        expected(i, t, unit) for i, t in ROWS if i is not None)
    assert [tuple(r)[:-1] for r in got if r.doc_id is None] == [expected(None, "no id", unit)]
    texts = {(i, t or "") for i, t in ROWS}
    assert {(r.doc_id, r.restored) for r in got} == texts and {r.form for r in got} == {"plain", "psm", "spm"}


def test_units_join_to_the_text():
    import pyarrow as pa

    texts = pa.array(["", "añ b", None, "x\n\ny\n", "  two", "👩‍👧"], pa.string())
    for unit in ("char", "word", "line"):
        lists = fim.unit_lists(texts, unit).to_pylist()
        assert ["".join(x) for x in lists] == [t or "" for t in texts.to_pylist()]
        assert lists == [units(t or "", unit) for t in texts.to_pylist()]
    assert fim.unit_lists(texts.slice(1, 3), "line").to_pylist() == [["añ b"], [], ["x\n", "\n", "y\n"]]
    with pytest.raises(ValueError, match="unknown unit"):
        fim.unit_lists(texts, "page")


def test_rates_and_empty_table(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    forms = dict(fim.fill_in_middle(docs).groupBy("form").count().collect())
    assert abs(forms["plain"] - 200) < 60 and abs(forms["spm"] - 360) < 80
    assert fim.fill_in_middle(docs, rate=0).where("form <> 'plain'").count() == 0
    assert fim.restore(fim.fill_in_middle(docs.limit(0))).count() == 0
