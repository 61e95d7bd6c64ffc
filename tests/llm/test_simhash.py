"""SimHash: fingerprints and components against brute force; the Gray index; star components."""

import random
import re

import numpy as np
import pytest
import xxhash

from loam.llm import components, simhash


def fingerprint(text: str | None) -> int:
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes: list, linked) -> dict:
    """Smallest node that each node reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def near_texts(seed: int, n: int) -> dict[int, str | None]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "日本", "Don't"]
    docs: dict[int, str | None] = {}
    for d in range(0, n, 4):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 250))]
        docs[d + 7] = " ".join(words)
        docs[d + 8] = "\n".join(words).upper() if words and "É" not in words else "\t".join(words)
        for k in (9, 10):
            changed = list(words)
            if changed:
                changed[rng.randrange(len(changed))] = "edit"
            docs[d + k] = " ".join(changed)
    return docs | {1: None, 2: "", 3: " \n", 4: "one", 5: "one two", 6: "long " * 20_000}


@pytest.mark.parametrize("slice_rows", [simhash.SLICE, 7])
def test_against_brute_force(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(simhash, "SLICE", slice_rows)  # small slices: every bucket meets in cells
    docs = near_texts(slice_rows, 120)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs.items()], "doc_id bigint, text string, fp string").repartition(4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = {d: fingerprint(t) for d, t in docs.items()}
    want = classes(sorted(docs), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in docs}
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert kept == set(want.values())


def test_repeats_nulls_and_empty(spark):
    rows = [(5, "same text here"), (5, "same text here"), (None, "same text here"), (9, "same text here"), (None, "alone at last now yes")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == [(5, 5), (5, 5), (9, 5), (None, 5), (None, None)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.keep_one(df).count() == 4


def test_rows_that_share_an_id_are_kept_by_their_own_text(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a, "x"), (5, b, "x"), (5, a, "y"), (None, a, "z"), (6, None, "n"), (7, "", "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest string")
    got = sorted((tuple(r) for r in simhash.keep_one(df).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[3], rows[4]], key=str)
    assert simhash.keep_one(df.limit(0)).columns == df.columns and simhash.keep_one(df.limit(0)).count() == 0


def test_gray_index_finds_every_pair_once():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(1, 150))
        fp = rng.integers(0, 2 ** 63, 3, np.uint64)[rng.integers(0, 3, n)]
        for _ in range(4):
            fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        bucket = np.sort(rng.integers(0, 4, n))
        order = np.lexsort([simhash.gray_rank(fp), bucket])
        fp, bucket = fp[order], bucket[order]
        got = [(int(a), int(b)) for x, y in simhash.GrayIndex(fp, bucket).links(4) for a, b in zip(x, y, strict=True)]
        want = {(i, j) for i in range(n) for j in range(i + 1, n)
                if bucket[i] == bucket[j] and int(fp[i] ^ fp[j]).bit_count() <= 4}
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("n", [10, 10 ** 6, 10 ** 10])
def test_block_masks_cover(n):
    masks, rng = simhash.block_masks(n, 4), random.Random(n)
    for _ in range(500):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & flips == 0 for m in masks)


def test_gray_rank():
    n = np.arange(1 << 10, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_star_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(200, 260)] + [(5, 5), (8, 9), (9, 8), (8, 9)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.root for r in components.star_components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, **{k: 1 for k in range(200, 260)}, 8: 8, 9: 8}
    assert components.star_components(df.limit(0)).count() == 0
