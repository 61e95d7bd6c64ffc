"""Best-fit packing after Martello-Toth dominance reduction (operator 5).

Sequences of a fixed token length are filled with document pieces. What decides a packing is only how
many pieces there are of each length, a table of at most ``capacity`` rows whatever the corpus size. On
that table:

1. Dominance reduction: for the longest pieces in turn, a set of at most three pieces that dominates
   every other set the piece could share a sequence with (each rival can be swapped in for one of its
   members without loss) is fixed for good, as many times as there are pieces, and the table shrinks.
2. Best-fit decreasing on what is left, in runs: equal sequences are kept as one pattern and a count, so
   the steps and the patterns are bounded by the capacity too.

The plan is then dealt to the pieces: the n-th piece of a length takes the n-th place for that length.
Pieces are numbered without any sort: each written part counts its own, and offsets per (part, length)
are added by a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WORDS, byte_letters, tokenizer_path
from .common import bounded, materialize, narrow, read_table, worker_cache

#: Fixed value: the id that ends a document.
END = 2
CAPACITY = 1024

Pattern = tuple[dict[int, int], int]


def _largest(count: np.ndarray, at_most: int) -> int:
    """The largest length up to ``at_most`` that still has pieces; 0 if none."""
    found = np.flatnonzero(count[: at_most + 1]) if at_most > 0 else ()
    return int(found[-1]) if len(found) else 0


def _smallest(count: np.ndarray, n: int, above: int = 0) -> list[int]:
    """The ``n`` smallest pieces (with repeats) longer than ``above``; fewer if there are no more."""
    out: list[int] = []
    for size in np.flatnonzero(count[above + 1:]) + above + 1:
        out += [int(size)] * min(n - len(out), int(count[size]))
        if len(out) == n:
            break
    return out


def _best_pair(count: np.ndarray, room: int) -> tuple[int, int]:
    """Two pieces ``a >= b`` with the largest sum up to ``room``, ``a`` as large as can be; zeros if none."""
    best, sizes = (0, 0), np.flatnonzero(count)
    for a in map(int, sizes[::-1]):
        if 2 * a < sum(best) or a >= room:
            if 2 * a < sum(best):
                break
            continue
        count[a] -= 1
        b = _largest(count, min(a, room - a))
        count[a] += 1
        if b and a + b > sum(best):
            best = (a, b)
    return best


def reduce_dominated(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix the sets that dominate; ``count`` (pieces by length) keeps what is left."""
    fixed: list[Pattern] = []

    def fix(*sizes: int) -> None:
        need = {s: sizes.count(s) for s in sizes}
        times = min(int(count[s]) // n for s, n in need.items())
        for s, n in need.items():
            count[s] -= n * times
        fixed.append((need, times))

    for size in range(capacity, 0, -1):
        while count[size]:
            room = capacity - size
            count[size] -= 1  # the piece itself is no partner
            partner = _largest(count, room)
            three = _smallest(count, 3)
            a = b = 0
            if partner and partner < room and sum(three[:2]) <= room and len(three) > 1:
                if len(three) < 3 or sum(three) > room:
                    a, b = _best_pair(count, room)
            larger = _smallest(count, 2, b) if a else []
            count[size] += 1
            if not partner:
                fix(size)
            elif partner == room or len(three) < 2 or sum(three[:2]) > room:
                fix(size, partner)  # it fills the sequence, or only one more piece fits
            elif a and partner >= a + b:
                fix(size, partner)  # two more pieces fit, but never more than this one holds
            elif a and partner == a and (len(larger) < 2 or sum(larger) > room):
                fix(size, a, b)  # of two more pieces the larger fits in a's place, the other in b's
            else:
                break
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counted pieces: the fullest sequence that still holds a piece gets it."""
    left: list[list[Pattern]] = [[] for _ in range(capacity + 1)]  # open patterns by room left
    for size in range(capacity, 0, -1):
        n = int(count[size])
        count[size] = 0
        while n:
            room = next((r for r in range(size, capacity) if left[r]), None)
            if room is None:
                room, (need, times) = capacity, ({}, n)
            else:
                need, times = left[room].pop()
            each = min(room // size, n)
            full = min(times, n // each)
            left[room - each * size].append((need | {size: each}, full))
            n -= each * full
            if times > full and room < capacity:
                left[room].append((need, times - full))
    return [p for patterns in left for p in patterns]


class Plan:
    """Places for the pieces of each length, as runs: run ``i`` of a length starts at its piece number
    ``first``; there ``each`` pieces go into every sequence, from ``sequence`` on, at ``offset``."""

    def __init__(self, count: np.ndarray, capacity: int):
        count = count.astype(np.int64).copy()
        self.pieces = count.copy()
        patterns = reduce_dominated(count, capacity)
        self.reduced = int(sum(times for _, times in patterns))
        patterns += best_fit(count, capacity)
        runs: list[tuple[int, int, int, int, int]] = []
        used = np.zeros(capacity + 1, np.int64)
        self.sequences = 0
        for need, times in patterns:
            at = 0
            for size in sorted(need, reverse=True):
                runs.append((size, int(used[size]), need[size], self.sequences, at))
                used[size] += need[size] * times
                at += need[size] * size
            self.sequences += times
        assert (used == self.pieces).all()
        self.runs = np.array(sorted(runs), np.int64).reshape(-1, 5)
        self.starts = np.searchsorted(self.runs[:, 0], np.arange(capacity + 2))

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the ``number``-th piece of ``length``."""
        keys = self.runs[:, 0] << 44 | self.runs[:, 1]
        run = self.runs[np.searchsorted(keys, length << 44 | number, side="right") - 1]
        into = number - run[:, 1]
        return run[:, 3] + into // run[:, 2], run[:, 4] + into % run[:, 2] * length


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, but for the first."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tiktoken_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids as unsigned 32-bit integers, by the same vocabulary and merges as the tokenizers file but the
    quicker public encoder (their ids are equal: tests/llm)."""
    cache = worker_cache()
    if ("tiktoken", path) not in cache:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        enc = tiktoken.Encoding("from-file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
        cache["tiktoken", path] = lambda text: enc.encode_to_numpy(text, allowed_special="all")
    return cache["tiktoken", path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``, and where the row stands: its
    ``part`` (input partition) and its ``nth`` among the part's pieces of that length."""
    src = narrow(docs, doc_id=id_col, text=text_col)
    schema = (f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, "
              "ids_crc32 bigint, part int, nth bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken_encoder(tokenizer)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in bounded(batches, 1):
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start:start + length].tobytes())
                    rows.append((i, k, start, length, crc, part, seen[length]))
                    seen[length] += 1
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int32())),
                 *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return src.mapInArrow(run, schema)


def pack(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``length``, ``part`` and ``nth`` (see ``pieces``).

    ``placed`` is read twice and must be a written table. The driver holds the number of pieces of each
    length (at most ``capacity`` rows) and the plan made of it (a few thousand patterns). Lengths must be
    1 to ``capacity``. An empty table gives no rows.
    """
    per_part = placed.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    count = np.zeros(capacity + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        count[r["length"]] = r["n"]
    plan = Plan(count, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    numbered = placed.join(before, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before")).select(
        *placed.drop("part").columns)
    out = numbered.drop("nth").schema.add("sequence_id", T.LongType()).add("offset", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, nth = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "nth"))
            sequence, offset = plan.place(length, nth)
            keep = [i for i, n in enumerate(batch.schema.names) if n != "nth"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)],
                names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    return numbered.mapInArrow(run, out)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """All documents as pieces placed in sequences: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``.

    A document is its text's ids and then id 2; null or empty text is that id alone. Repeated rows are
    documents of their own; other columns are ignored; an empty table gives no rows. A text of any length
    is cut into pieces of ``capacity``, only the first of which may be shorter. Sequence numbers are
    dense from 0, but which equal-length piece gets which place follows the input's partitions.
    """
    return pack(materialize(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces"), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())
