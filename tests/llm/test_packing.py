"""Packing: the reduction keeps the optimum, plans are valid, pieces are the library's ids."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from loam.llm import bpe, packing


def optimum(items: list[int], room: int) -> int:
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= room:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_reduction_and_plan():
    rng = np.random.default_rng(0)
    for t in range(400):
        room = int(rng.integers(5, 30))
        items = rng.integers(1, room + 1, size=rng.integers(0, 10))
        if t % 2:
            items = np.clip(items + room // 3, 1, room)
        count = np.bincount(items, minlength=room + 1)
        left = count.astype(np.int64).copy()
        fixed = sum(times for _, times in packing.reduce_dominated(left, room))
        best = optimum(items.tolist(), room)
        assert fixed + optimum(np.repeat(np.arange(room + 1), left).tolist(), room) == best
        plan = packing.Plan(count, room)
        assert best <= plan.sequences <= best + 1
        length = np.sort(items).astype(np.int64)
        nth = np.concatenate([np.arange(n) for n in count if n] or [np.zeros(0, np.int64)])
        if len(length):
            check(length, *plan.place(length, nth), room)


def check(length, sequence, offset, room) -> None:
    order = np.lexsort([offset, sequence])
    length, sequence, offset = length[order], sequence[order], offset[order]
    first = np.r_[True, sequence[1:] != sequence[:-1]]
    assert (offset[first] == 0).all()
    assert (offset[1:][~first[1:]] == (offset + length)[:-1][~first[1:]]).all()
    assert (offset + length <= room).all()


def test_large_counts_near_lower_bound():
    rng = np.random.default_rng(1)
    count = np.bincount(np.clip(rng.lognormal(6.3, 0.8, 50_000).astype(int), 1, 1024), minlength=1025) * 10_000
    plan = packing.Plan(count, 1024)
    assert plan.sequences <= 1.005 * (count * np.arange(1025)).sum() / 1024
    assert len(plan.runs) < 20_000


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_documents(spark):
    library = Tokenizer.from_file(bpe.tokenizer_path())
    texts = {1: "a b c", 2: None, 3: "", 4: "word " * 5000, 5: "x<|endoftext|> y\n\n z" * 40, 6: "é" * 900, 7: "a b c"}
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in texts.items()], "doc_id int, text string, part int, length int")
    rows = packing.pack_documents(df.repartition(3), bpe.tokenizer_path()).collect()
    by_doc: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, t in texts.items():
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        got = by_doc[d]
        assert [r.piece for r in got] == list(range(len(got)))
        assert [(r.start, r.length) for r in got] == packing.cut(len(ids), 1024)
        assert [r.ids_crc32 for r in got] == [zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in got]
    check(*(np.array([r[c] for r in rows]) for c in ("length", "sequence_id", "offset")), 1024)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 1024) + 1
    assert packing.pack_documents(df.limit(0), bpe.tokenizer_path()).count() == 0
