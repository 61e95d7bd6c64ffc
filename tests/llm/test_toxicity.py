"""Toxicity: kernel values, held-out accuracy, gapped and inserted characters, and odd input."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from loam.llm import toxicity

INSULTS = ["idiot", "moron", "scumbag", "loser"]


def kernel(a: str, b: str) -> float:
    def weights(word: str) -> dict:
        s, out = ["^", *word, "$"], {}
        for p, span in toxicity.SPANS.items():
            for at in combinations(range(len(s)), p):
                if at[-1] - at[0] < span:
                    key = tuple(s[i] for i in at)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] - p + 1)
        return out

    x, y = weights(a), weights(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_kernel_values():
    words = ["idiot", "idxiot", "banana", "i", "moron", "anagram", "zq" * 20]
    marks = toxicity.Landmarks(words)
    got = marks.kernel(words) * toxicity.norms(words)[:, None] * toxicity.norms(words)
    want = np.array([[kernel(a, b) for b in words] for a in words])
    assert np.allclose(got, want)


def corpus(seed: int, n: int, longest: int = 60, insults: tuple[int, int] = (1, 3)) -> list[tuple[int, str, int]]:
    rng = random.Random(seed)
    parts = ["ta", "re", "mi", "no", "sel", "du", "ka", "or", "id", "lo", "mo", "sc"]
    rows = []
    for d in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, longest))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(*insults)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", ".", "!", ","]))
        rows.append((d, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = corpus(4, 900)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t, _ in rows], "doc_id bigint, text string, toxic int, score string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(3, None), (None, 1)], "doc_id bigint, toxic int")
    return rows, docs, labels, toxicity.fit(*toxicity.sample(docs, labels))


def test_held_out_accuracy(spark, trained):
    rows, docs, labels, _ = trained
    got = {r.doc_id: r for r in toxicity.score_documents(docs.repartition(4), labels).collect()}
    truth = {d: y for d, _, y in rows}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sorted(d for d, r in got.items() if r.held_out) == held
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[d].predicted == truth[d] for d in held]) >= 0.97
    kept = {r.doc_id for r in toxicity.reject_toxic(docs, labels).collect()}
    assert kept == {d for d, r in got.items() if not r.predicted}


def test_gaps_and_insertions(spark, trained):
    machine = trained[3]
    clean = ["tare mino sel", "", None, "   ", "1234 5678", "seldu kamo orta"]
    odd = ["tare idxiot mino", "sel mor-on du", "you s.c.u.m.b.a.g here", "ta i d i o t no", "LOSER", "idiioot ta"]
    df = spark.createDataFrame(list(enumerate(clean + odd)), "doc_id int, text string")
    got = {r.doc_id: r.s for r in toxicity.add_score(df, machine, "s").collect()}
    assert all(got[i] < 0.3 for i in range(len(clean)))
    assert sum(got[len(clean) + i] >= 0.3 for i in range(len(odd))) >= 5


def test_edges(spark, trained):
    _, docs, labels, _ = trained
    none = labels.limit(0)
    flat = toxicity.score_documents(docs, none).select("score").distinct().collect()
    assert len(flat) == 1 and flat[0].score == pytest.approx(0.5)
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    twice = spark.createDataFrame([(1, "x"), (1, "x"), (None, "idiot " * 50_000)], "doc_id bigint, text string")
    got = toxicity.score_documents(twice, labels).collect()
    assert len(got) == 3 and not [r.held_out for r in got if r.doc_id is None][0]


def test_one_insult_in_a_long_clean_text():
    rows = corpus(4, 900, 400, (3, 8))  # learned from texts with several
    machine = toxicity.fit(*([toxicity.words_of(t) for _, t, y in rows if y == kind] for kind in (1, 0)))
    table, rng = machine.table(), random.Random(8)

    def caught(texts: list[str]) -> int:
        found = [toxicity.words_of(t) for t in texts]
        rows = [toxicity.traits(machine.score(list(ws), table), np.array(list(ws.values())), machine.bias) for ws in found]
        return int((machine.chance(np.array(rows)) >= toxicity.LIMIT).sum())

    clean = [t for _, t, y in corpus(50, 250, 400) if not y and t.count(" ") > 100][:100]
    bent = {"as is": lambda w, i, c: w, "doubled": lambda w, i, c: w[:i] + w[i] + w[i:],
            "inserted": lambda w, i, c: w[:i] + c + w[i:], "left out": lambda w, i, c: w[:i] + w[i + 1:]}
    got = {}
    for kind, bend in bent.items():
        texts = []
        for k, t in enumerate(clean):
            w, words = INSULTS[k % len(INSULTS)], t.split()
            new = bend(w, rng.randrange(1, len(w) - 1), rng.choice("abcdefghijklmnopqrstuvwxyz"))
            words.insert(rng.randrange(len(words)), new)
            texts.append(" ".join(words))
        got[kind] = caught(texts)
    assert caught(clean) <= 5
    assert got["as is"] >= 95 and got["doubled"] >= 90 and got["inserted"] >= 60
