"""Quality counts against plain Python, host verdicts on hand-made hosts."""

import random
import re

from loam.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    seen: dict[tuple, int] = {}
    wins = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    for w in wins:
        seen[w] = seen.get(w, 0) + 1
    covered = {j for i, w in enumerate(wins) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [ln for ln in text.split("\n") if WORD.search(ln)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def texts(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    vocab = ["a", "b", "cc", "é", "日本", "#", "x|y", "👍", " ", "\x85"]
    out: list[str | None] = [None, "", " \n\t", "one", "same words " * 300, "\n".join(["line one", " line one", "line one"])]
    for _ in range(150):
        base = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        words = base + (base[rng.randint(0, 20):] if rng.random() < 0.4 else [])
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b"]) for w in words))
    return out


def test_counts(spark):
    many = texts(3) + ["w " * 60_000]
    df = spark.createDataFrame([(i, t, f"s{i % 3}", True) for i, t in enumerate(many)],
                               "doc_id int, text string, source string, words boolean")
    for r in quality.quality(df.repartition(3)).collect():
        want = plain(many[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, many[r.doc_id]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert quality.quality(df.limit(0)).count() == 0


def test_bad_hosts_take_their_documents(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "too short"
    rows = [(f"h{h}", good) for h in range(9) for _ in range(10)] + [("bad", bad)] * 45 + [("bad", good)] * 5 + [("tiny", bad), (None, good)]
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id int, source string, text string")
    out = quality.quality(df).collect()
    assert all(r.kept == (r.host != "bad" and not r.base_failed) for r in out)
    assert "bad" in {r.host for r in out if not r.host_kept} <= {"bad", "tiny"}
    assert [r.kept for r in out if r.host == ""] == [True]


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id int, text string, source string")
    plan = quality.rule_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
