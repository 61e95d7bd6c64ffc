"""Operator 13: every order replayed document by document, odd rows, other filter sets."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from loam.llm import audit

MANY = " ".join(f"w{i}" for i in range(300))
DOCS = [(1, MANY, "en"), (2, MANY, "de"), (3, MANY + " $", "en"), (4, None, "en"), (5, "", "en"), (6, "A", None), (None, "A", "fr"),
        (7, "x " * 250, "en"), (8, "x " * 250 + "Y" * 40, "fr"), (8, MANY, "fr"), (8, MANY, "fr"), (9, "\x0b a b  c\n", "es"),
        (10, "É" * 50, "es"), (11, "|" + "B" * 9, ""), (12, MANY.upper(), "de")]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, 0), (8, 1, None), (10, None, 1), (None, 1, 1), (99, 1, 1)]


def fails(docs):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield i, lang or "", {c for c, bad in {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search(r"[#$%&*|]", t), "E": i is not None and first[t] < i}.items() if bad}


def replay(docs, labels):
    marked = list(fails(docs))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in marked}:
        rows = [(i, bad) for i, p, bad in marked if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for k, c in enumerate(order):
                gone = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                everyone = sum(c in bad for _, bad in rows)
                shapley[part, c] += len(gone)
                out[part, order, k + 1] = (len(left), len(gone), everyone - len(gone), sum(bad == {c} for _, bad in rows),
                                           sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
    return {(*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string").select(
        F.lit(9).alias("mask"), F.lit("q").alias("part"), "doc_id", "text", F.lit(0).alias("n"), "lang", F.lit("d").alias("digest"))
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("z"))
    return docs, labels


def test_against_replay(spark):
    docs, labels = tables(spark)
    got = audit.audit(audit.mask_cells(audit.failure_masks(docs), labels)).collect()
    assert len(got) == 600 * 5 and {tuple(r) for r in got} == replay(DOCS, LABELS)


def test_empty_tables(spark):
    docs, labels = tables(spark)
    cells = audit.mask_cells(audit.failure_masks(docs), labels.limit(0))
    assert cells.agg(F.sum("n"), F.sum("good")).first()[:] == (len(DOCS), 0)
    assert audit.audit(audit.mask_cells(audit.failure_masks(docs.limit(0)), labels)).count() == 0


@pytest.mark.parametrize("letters", ["A", "AB", "ABCDEF"])
def test_other_filter_sets(spark, letters):
    top = 2 ** len(letters) - 1
    cells = spark.createDataFrame([("p", top, 3, 1, 0), ("p", 0, 2, 2, 0), ("p", top, 1, 0, 1)],
                                  "part string, mask int, n bigint, good bigint, toxic bigint")
    got = audit.audit(cells, letters).collect()
    orders = len(list(permutations(letters)))
    assert len(got) == orders * len(letters)
    for r in got:
        assert (r.kept, r.removed, r.redundant) == ((2, 4, 0) if r.step == 1 else (2, 0, 4))
        assert r.shapley * len(letters) == 4 * orders and (r.good_lost, r.toxic_lost) == ((1, 1) if r.step == 1 else (0, 0))


def test_bad_filter_sets(spark):
    cells = spark.createDataFrame([], "part string, mask int, n bigint, good bigint, toxic bigint")
    for letters in ("", "AA", "ABCDEFG"):
        with pytest.raises(ValueError, match="letters"):
            audit.audit(cells, letters)
