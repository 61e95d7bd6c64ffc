"""SimHash near-duplicates over a Gray-order hierarchical index (operator 7).

Fingerprints at a Hamming distance of at most ``d`` agree in ``b - d`` of any ``b`` blocks of bits, so
equal block values send every linked pair to a common bucket. Inside a bucket the fingerprints are sorted
by their rank in the reflected Gray code, where neighbours share long bit patterns. Runs of neighbours
are factored into nodes that keep the bits all members share (a mask and a pattern), and nodes of nodes
above them. Two nodes differ in at least the shared bits in which their patterns differ; pairs of nodes
are walked from the top, and a pair past ``d`` is dropped with all that lies below it.

No link is written out for its own sake: a bucket keeps a forest (a row per fingerprint at most) that
connects what its links connect. A bucket larger than ``SLICE`` is dealt in slices, and every two slices
meet in a cell of their own, so that one task holds two slices whatever the bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, materialize, narrow, read_table, utf8_buffers
from .components import star_components
from .words import Words

#: Fixed values of the fingerprint: the seed of its hash and the number of its bits.
SEED, BITS = 42, 64
SLICE = 16_384
FAN = 16
#: Pairs compared at a time, which bounds a task's memory.
PAIRS = 1 << 20


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits set in over half of the hashes."""
    lanes = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + 256 * np.arange(8)
    seen = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    ones = seen @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    return np.packbits((2 * ones > len(hashes)).ravel(), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of each whole text.

    Texts are lower-cased (A-Z); shingles are ``shingle`` words joined by a space, each occurrence
    counted; a text of fewer words is one shingle; null, empty and blank texts have fingerprint 0.
    """
    return _fingerprints(narrow(docs, doc_id=id_col, text=text_col), shingle)


def _fingerprints(src: DataFrame, shingle: int) -> DataFrame:
    """``fp`` of each row of ``src(doc_id, text, ...)``; columns after the text are carried along."""
    kinds = {f.name: f.dataType.simpleString() for f in src.schema if f.name != "text"}
    schema = ", ".join(f"{name} {kind}" for name, kind in [*kinds.items(), ("fp", "bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in bounded(batches, 1, 1 << 20):
            words = Words(*utf8_buffers(batch.column(1)), lower=True)
            buffer, begin, end = words.joined.tobytes(), words.at, words.at + words.size
            out = np.zeros(batch.num_rows, np.uint64)
            for i in range(batch.num_rows):
                a, b = int(words.first[i]), int(words.first[i + 1])
                if a == b:
                    continue
                last = max(a + 1, b - shingle + 1)
                ends = end[min(a + shingle, b) - 1:b]
                out[i] = majority(np.array(
                    [xxh64_intdigest(buffer[s:e], SEED)
                     for s, e in zip(begin[a:last].tolist(), ends.tolist(), strict=True)], np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(out.view(np.int64))], names=[*kinds, "fp"])

    return src.mapInArrow(run, schema)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray code."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over fingerprints sorted by (bucket, Gray rank); no node spans two buckets.

    ``levels[0]`` are the fingerprints themselves. A level is ``(mask, pattern, low, high)``: the bits all
    members share, their values, and the range of children in the level below.
    """

    def __init__(self, fp: np.ndarray, bucket: np.ndarray):
        n = np.arange(len(fp))
        full = np.full(len(fp), ~np.uint64(0))
        self.levels = [(full, fp, n, n + 1)]
        while True:
            mask, pattern = self.levels[-1][:2]
            opens = np.r_[True, bucket[1:] != bucket[:-1]]
            place = np.arange(len(bucket)) - np.maximum.accumulate(np.where(opens, np.arange(len(bucket)), 0))
            low = np.flatnonzero(place % FAN == 0)
            high = np.r_[low[1:], len(bucket)]
            ones, zeros = np.bitwise_and.reduceat(pattern, low), np.bitwise_or.reduceat(pattern, low)
            shared = np.bitwise_and.reduceat(mask, low) & (ones | ~zeros)
            self.levels.append((shared, ones & shared, low, high))
            if len(low) == int(opens.sum()):
                break
            bucket = bucket[low]

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of linked fingerprints, in blocks of bounded size; a pair comes once."""
        top = np.arange(len(self.levels[-1][0]))
        yield from self._walk(len(self.levels) - 1, top, top, distance)

    def _walk(self, level: int, a: np.ndarray, b: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if level == 0:
            if len(a):
                yield a, b
            return
        _, _, low, high = self.levels[level]
        mask, pattern = self.levels[level - 1][:2]
        step = np.arange(FAN)
        for k in range(0, len(a), PAIRS // (FAN * FAN)):
            x, y = a[k:k + PAIRS // (FAN * FAN)], b[k:k + PAIRS // (FAN * FAN)]
            left, right = low[x][:, None] + step, low[y][:, None] + step
            both = (left < high[x][:, None])[:, :, None] & (right < high[y][:, None])[:, None, :]
            if level == 1:
                both &= left[:, :, None] < right[:, None, :]
            else:
                both &= left[:, :, None] <= right[:, None, :]
            i, j, m = np.nonzero(both)
            left, right = left[i, j], right[i, m]
            apart = np.bitwise_count((pattern[left] ^ pattern[right]) & mask[left] & mask[right])
            near = apart <= distance
            yield from self._walk(level - 1, left[near], right[near], distance)


def forest(fp: np.ndarray, bucket: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(i, root)`` that connect what the links connect; ``bucket`` sorted, Gray order inside."""
    root = np.arange(len(fp))
    for a, b in GrayIndex(fp, bucket).links(distance):
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return moved, root[moved]


def block_masks(n: int, distance: int) -> list[int]:
    """Masks of which two fingerprints within ``distance`` agree in at least one. More and finer blocks
    for more fingerprints; any choice finds every link."""
    b = next((b for b in range(distance + 1, 2 * distance + 2) if n / 2 ** (BITS * (b - distance) / b) <= 512),
             2 * distance + 1)
    edges = [round(BITS * i / b) for i in range(b + 1)]
    blocks = [sum(1 << k for k in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, b - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_edges(fps: DataFrame, n: int, distance: int) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints ``fp`` (``n`` of them) that connect all links."""
    masks = block_masks(n, distance)
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
        for i, m in enumerate(masks)])).alias("k")).select("fp", "k.block", "k.value")
    # written, so that both sides of the join are plain shuffles and a hot bucket can be split
    sizes = materialize(keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    dealt = keyed.join(sizes, ["block", "value"]).withColumn("slices", F.ceil(F.col("n") / SLICE)).withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("slices")))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).where(
        "other <> own or slices = 1").select(
        "fp", "block", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    cell = ["block", "value", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(rows: pa.Table) -> pa.RecordBatch:
            fp = rows.column("fp").to_numpy().view(np.uint64)
            keys = [rows.column(c).to_numpy() for c in cell]
            order = np.lexsort([gray_rank(fp), *keys[::-1]])
            fp = fp[order]
            bucket = np.cumsum(np.r_[0, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])
            i, root = forest(fp, bucket, distance)
            return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[root].view(np.int64))],
                                              names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 2 * SLICE:
                continue
            rows = pa.Table.from_batches(held)
            keys = [rows.column(c).to_numpy() for c in cell]
            changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
            whole = int(changes[-1]) + 1 if len(changes) else 0  # the last cell may go on
            if whole:
                yield solve(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` per input row.

    Texts whose fingerprints differ in at most ``distance`` bits are linked, also through others;
    ``component_id`` is the smallest ``doc_id`` that can be reached, the row's own included. Blank texts
    share fingerprint 0 and are linked like any others. Repeated rows stay; a null ``doc_id`` is linked
    but names no component unless all its members' ids are null. Other columns are ignored; an empty
    table gives no rows.
    """
    return _components(narrow(docs, doc_id=id_col, text=text_col), shingle, distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(src: DataFrame, shingle: int, distance: int) -> DataFrame:
    """``fp`` and ``component_id`` of each row of ``src(doc_id, text, ...)``; columns after the text are
    carried along."""
    marked = materialize(_fingerprints(src, shingle), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = star_components(near_edges(fps.select("fp"), fps.count(), distance))
    classes = materialize(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")), "classes")
    names = materialize(classes.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = classes.join(names, "root").select("fp", "component_id")
    return marked.join(named, "fp")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``: the one with the smallest id.

    A row goes only if its own text's component has a smaller id. So rows that share an id are judged each
    by its text (known by its md5); those of them that are in the component they name all stay, equal rows
    too, and so do rows without an id, as nothing names them. An empty table gives no rows.
    """
    def digest(text: Column) -> Column:
        return F.md5(F.coalesce(text, F.lit("")))

    src = narrow(docs, doc_id=id_col, text=text_col).withColumn("digest", digest(F.col("text")))
    later = _components(src, shingle, distance).where("doc_id <> component_id").select("doc_id", "digest").distinct()
    return docs.join(later, (docs[id_col] == later["doc_id"]) & (digest(docs[text_col]) == later["digest"]), "left_anti")


def op7_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
