"""Repeated passages against a brute-force comparison of all windows."""

import random
import re

import pytest

from loam.llm import repeats


def brute(docs: dict[int, str], least: int) -> dict[int, list[tuple[int, int, bool]]]:
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs.items()}
    where: dict[tuple, list[tuple[int, int]]] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - least + 1):
            where.setdefault(tuple(words[d][i:i + least]), []).append((d, i))
    state = {d: [0] * len(w) for d, w in words.items()}
    for places in where.values():
        if len(places) > 1:
            for k, (d, i) in enumerate(places):
                for j in range(i, i + least):
                    state[d][j] = max(state[d][j], 2 if k else 1)
    out = {}
    for d, s in state.items():
        spans, i = [], 0
        while i < len(s):
            j = i
            while j < len(s) and s[j] == s[i]:
                j += 1
            if s[i]:
                spans.append((i, j, s[i] == 1))
            i = j
        if spans:
            out[d] = spans
    return out


def corpus(seed: int, n: int = 60, least: int = 12) -> dict[int, str]:
    rng = random.Random(seed)
    vocab = ["é", "A", "b", "cc", "ddd", "x" * 40, "日本", "z."] + [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(least - 2, 3 * least))] for _ in range(5)]
    docs = {}
    for d in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [rng.choice(vocab) for _ in range(rng.randint(0, 15))]
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p = p[rng.randint(0, 4):len(p) - rng.randint(0, 4)]
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edit"
            words += p
        docs[d * 3 + 1] = "".join(w + rng.choice([" ", "  ", "\n", "\t "]) for w in words)
    docs[2] = "a " * 200
    docs[5] = docs[4]
    docs[8] = ""
    docs[11] = None
    return docs


def found(df) -> dict[int, list[tuple[int, int, bool]]]:
    return {r.doc_id: [tuple(s) for s in r.spans] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(5)
    assert found(repeats.repeated_spans(df, least=12, gram=8)) == brute(docs, 12)


def test_cut_keeps_first_copies(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one two\n{passage} three", "a"), (2, f"four {passage}  five", None), (3, "clean text", "b"), (4, None, "c"),
            (None, passage, "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = {r.doc_id: (r.text, r.spans) for r in repeats.cut_repeats(df).collect()}
    assert got == {1: (rows[0][1], "a"), 2: ("four five", None), 3: ("clean text", "b"), 4: (None, "c"),
                   None: (passage, "d")}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, mark string, h string")
    assert repeats.repeated_spans(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(40_000))
    df = spark.createDataFrame([(7, long), (7, long), (9, "x " + long), (10, "w1 w2")], "doc_id bigint, text string")
    got = found(repeats.repeated_spans(df))
    assert got == {7: [(0, 40_000, True)], 9: [(1, 40_001, False)]}


def test_rows_that_share_an_id_are_cut_by_their_own_text(spark, tmp_path):
    a, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "ac")
    rows = [(3, a, 1), (5, a, 2), (5, c, 3), (5, c, 4), (None, a, 5), (6, None, 6)]
    spark.createDataFrame(rows, "doc_id bigint, text string, cut int").write.parquet(str(tmp_path / "docs"))
    got = repeats.cut_repeats(spark.read.parquet(str(tmp_path / "docs"))).collect()
    assert sorted(tuple(r) for r in got if r.doc_id) == [(3, a, 1), (5, "", 2), (5, c, 3), (5, c, 4), (6, None, 6)][:5]
    assert [r.text for r in got if r.doc_id is None] == [a]


@pytest.mark.parametrize("least", [50, 300])
def test_longer_passages(spark, least):
    docs = {k: " ".join(f"w{(7 * k * (i < 40) + i)}" for i in range(700 - 9 * k)) + f" end{k}" for k in range(4)}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    assert found(repeats.repeated_spans(df, least=least)) == brute(docs, least)


def test_bad_least(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    for least in (35, 65_536):
        with pytest.raises(ValueError, match="least"):
            repeats.repeated_spans(df, least=least)
