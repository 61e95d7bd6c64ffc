"""Secret scans: base spans against the plain patterns, and what the network adds."""

import random
import re

import numpy as np
import pytest

from loam.llm import secrets

PLAIN = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def plain(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    out = [("assign", *m.span()) for m in re.finditer(PLAIN["assign"], text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(PLAIN["access"], text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(PLAIN["hex"], text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


def corpus(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)

    def some(letters: str, low: int, high: int) -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))

    def piece() -> str:
        kind = rng.randrange(9)
        if kind == 0:
            return rng.choice(["password", "PassWd", "token", "apikey", "API_KEY", "secret", "ſecret"]) + rng.choice(
                ["=", ": ", "' : \"", " =  '", "==", "\n="]) + some("abcXYZ019+/_.=-", 1, 30)
        if kind == 1:
            return "AKIA" + some("ABCDEFGHXYZ0123456789", 5, 40)
        if kind == 2:
            return some("0123456789abcdef", 15, 60)
        if kind == 3:
            return some("abcdefghijklmnopqrstuvwxyz", 14, 22)
        return " ".join(some("etaoinshr", 1, 9) for _ in range(rng.randint(1, 12)))

    return [rng.choice([" ", "", "é", "\n"]).join(piece() for _ in range(rng.randint(0, 8))) for _ in range(n)]


def test_base_spans():
    base = secrets.Base()
    for text in corpus(1, 3000) + ["password=token: abcdefgh", "token=secret=abcdef", "x" * 50_000 + "ab" * 20_000]:
        assert base.scan(text)[0] == plain(text)


def test_windows_cover_long_candidates():
    text = "go " + "".join(random.Random(1).choice("abcDEF012") for _ in range(500)) + " on"
    ws = secrets.windows(text, 3, 503)
    seen = "".join(w[secrets.AROUND:secrets.AROUND + secrets.STEP] for w in ws[:-1]) + ws[-1][secrets.AROUND:]
    assert text[3:503] in seen.replace("\0", "")
    assert all(len(w) == secrets.WIDTH for w in ws)


@pytest.fixture(scope="module")
def detector():
    base, one, zero = secrets.Base(), [], []
    for text in corpus(5, 400):
        found, runs = base.scan(text)
        one += [w for _, a, b in found for w in secrets.windows(text, a, b)]
        zero += [w for r in runs if secrets.apart(r, found) for w in secrets.windows(text, *r)]
    return secrets.fit(one, sorted(set(zero) - set(one)))


def test_network_generalises(detector):
    rng = random.Random(9)
    fresh = ["word here " + "".join(rng.choice("0123456789abcdef") for _ in range(23)) + " and on" for _ in range(200)]
    clean = ["word here " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(19)) + " and on" for _ in range(200)]
    hit = [bool(s) for s in detector.add(fresh, [secrets.Base().scan(t) for t in fresh])]
    false = [bool(s) for s in detector.add(clean, [secrets.Base().scan(t) for t in clean])]
    assert sum(hit) >= 180 and sum(false) <= 10


def brute_windows(texts):
    base, out = secrets.Base(), {}
    for text in texts:
        found, runs = base.scan(text)
        for y, spans in ((1, [s[1:] for s in found]), (0, [r for r in runs if secrets.apart(r, found)])):
            for a, b in spans:
                for w in secrets.windows(text, a, b):
                    out[w] = max(y, out.get(w, 0))
    return out


def test_windows_of_every_document(spark):
    rng = random.Random(3)
    texts = [f"{i} key " + "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 30]))) for i in range(21_000)]
    got = secrets.training_windows(spark.createDataFrame([(t,) for t in [*texts, None, texts[0]]], "text string"), "text")
    assert {r.w: r.y for r in got.collect()} == brute_windows(texts)


def test_training_in_parts(spark, monkeypatch):
    texts = corpus(5, 600)
    expected = brute_windows(texts)
    ones = sum(expected.values())
    monkeypatch.setattr(secrets, "PART", 300)
    monkeypatch.setattr(secrets, "epochs_for", lambda n: 60)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows, parts = secrets.dealt(secrets.training_windows(df, "text"), ones, len(expected) - ones)
    assert parts >= 4 and {(r.w, r.y) for r in rows.where("copy = 0").collect()} == set(expected.items())
    assert rows.select("w", "part").distinct().count() == rows.count()
    rare = spark.createDataFrame([(f"{i}", int(i < 3)) for i in range(1000)], "w string, y int")
    dealt, parts = secrets.dealt(rare, 3, 997)
    assert dealt.where("y = 1").select("part").distinct().count() == parts == 4
    detector = secrets.learn(df, "text")
    again = secrets.learn(df.repartition(5), "text")
    assert (detector.network.conv == again.network.conv).all() and detector.threshold == pytest.approx(again.threshold)
    test_network_generalises(detector)


def test_sums_over_a_table(spark):
    rng = random.Random(4)
    rows = [(rng.gauss(2 * y, 1), y) for y in (0, 1) for _ in range(300)]
    z, y = (np.array(c, float) for c in zip(*rows, strict=True))
    scored = spark.createDataFrame(rows, "z double, y int")
    assert secrets.platt(300, 300, secrets.sums_over(scored)) == pytest.approx(secrets.platt(300, 300, secrets.sums_of(z, y)))


def test_operator(spark):
    texts = corpus(7, 150) + [None, "", "AKIA" + "A" * 16 + " " + "0a" * 12]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id int, text string, spans string, start int")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan(df.repartition(3)).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] != secrets.ADDED] == plain(t)
        assert got[i] == sorted(got[i], key=lambda s: (s[1], [*secrets.KINDS, secrets.ADDED].index(s[0])))
        base = [s for s in got[i] if s[0] != secrets.ADDED]
        assert all(secrets.apart(s[1:], base) for s in got[i] if s[0] == secrets.ADDED)
    assert secrets.scan(df.limit(0)).count() == 0
    masked = {r.doc_id: (r.text, r.spans) for r in secrets.redact(df).collect()}
    assert masked[150] == (None, "s") and masked[152] == ("[secret] [secret]", "s")
    for i, t in enumerate(texts):
        if not got[i]:
            assert masked[i] == (t, "s")
