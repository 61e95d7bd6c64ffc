"""Repeated passages by sparse suffix arrays (operator 4).

A suffix of a text is kept only where it starts at a minimiser: the run of ``GRAM`` words whose hash is
the smallest in some window of ``least`` words. Equal windows select the same place, so any two equal
passages of at least ``least`` words share a kept suffix, and only about one word in eight starts one.

Suffixes are brought in order by the hash of their first ``GRAM`` words and then of the words around
them, as far as a window that holds the run can reach; neighbours in that order are compared:

* suffixes equal in all of it are copies of one another over the whole reach: all but the first are later
  copies, and one stands for the class from then on;
* where a run of words has several classes, the match between their members is extended to the left and
  right: each class looks at every window around its run, and windows of one run with equal words meet again.

What a document shares is the union of its equal windows. Sums come before shuffles, hot passages (one
passage in very many documents) are never gathered, and the texts themselves move only for the documents
with extensions. Positions are counted in words ``[^\\x20\\x09-\\x0D]+``; white space is not compared.
Words are compared by 64-bit hashes, runs and windows by both of theirs together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, materialize, narrow, read_table, utf8_buffers
from .words import Words

#: Words of a run, and of the shortest passage that counts.
GRAM, LEAST = 36, 50
#: Odd bases of the rolling hashes and multipliers of the mixer.
BYTE_BASE, WORD_BASE, SPREAD, MIXER = 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(MIXER)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2 ** 64, by doubling."""
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k:k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


def slide(a: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` over every ``width`` neighbours, by doubling."""
    k = 1
    while 2 * k <= width:
        a = best(a[:len(a) - k], a[k:])
        k *= 2
    return best(a[:len(a) - (width - k)], a[width - k:]) if k < width else a


class Hashed:
    """The words of a slice of texts, hashed so that any run's hash takes constant time."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.words = w = Words(raw, offsets)
        n = len(w.start)
        if not n:
            self.prefix, self.undo = np.zeros(1, np.uint64), np.ones(1, np.uint64)
            return
        letter = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(SPREAD))
        place = np.arange(len(w.joined)) - np.repeat(w.at, w.size + 1)
        value = letter[w.joined] * powers(BYTE_BASE, int(w.size.max()) + 2)[place]
        word = mix(np.add.reduceat(value, w.at))
        self.prefix = np.r_[np.uint64(0), np.cumsum(word * powers(WORD_BASE, n))]
        self.undo = powers(pow(WORD_BASE, -1, 1 << 64), n + 1)

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of words ``a`` up to ``b``; equal words have equal hashes wherever they stand."""
        return mix((self.prefix[b] - self.prefix[a]) * self.undo[a] + (b - a).astype(np.uint64) * np.uint64(SPREAD))


def minimisers(h: Hashed, gram: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (in the slice) of the kept suffixes, and how far a window around them may reach to the left
    and to the right of the place."""
    w, n = h.words, len(h.words.start)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    i = np.arange(n - gram + 1)
    g = h.run(i, i + gram)
    begin, end = w.first[:-1][w.doc], w.first[1:][w.doc]
    s = np.arange(n - least + 1)
    low = np.where(s + least <= end[s], slide(g, least - gram + 1, np.minimum), np.uint64(0))
    edge = np.zeros(least - gram, np.uint64)
    kept = np.flatnonzero(slide(np.r_[edge, low, edge], least - gram + 1, np.maximum)[:len(g)] >= np.maximum(g, 1))
    return kept, kept - np.maximum(begin[kept], kept - (least - gram)), np.minimum(end[kept], kept + least) - kept


def suffixes(docs: DataFrame, gram: int = GRAM, least: int = LEAST) -> DataFrame:
    """``h, around, doc_id, place`` of every kept suffix of ``docs(doc_id, text)``: the hashes of its run
    and of the reach on both sides of it; ``place`` packs its word position and its reach."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1, 1 << 20):
            h = Hashed(*utf8_buffers(batch.column(1)))
            at, left, right = minimisers(h, gram, least)
            doc = h.words.doc[at]
            around = h.run(at - left, at) ^ (h.run(at + gram, at + right) * np.uint64(MIXER))
            place = (at - h.words.first[:-1][doc]) << 32 | left << 16 | right
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.run(at, at + gram).view(np.int64)), pa.array(around.view(np.int64)),
                 batch.column(0).take(pa.array(doc)), pa.array(place)], names=["h", "around", "doc_id", "place"])

    return docs.mapInArrow(run, f"h bigint, around bigint, doc_id {kind}, place bigint")


def windows(docs: DataFrame, wanted: DataFrame, gram: int = GRAM, least: int = LEAST) -> DataFrame:
    """``h, w, doc_id, start`` of every window of ``least`` words around the suffixes ``wanted(doc_id, places)``;
    ``h`` is the hash of the run, ``w`` hashes the window's words and where in it the run stands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1, 1 << 20):
            h = Hashed(*utf8_buffers(batch.column(1)))
            places = batch.column(2)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
            place = places.flatten().to_numpy()
            pos, left, right = place >> 32, place >> 16 & 65535, place & 65535
            off = np.maximum(0, least - right)
            n = left - off + 1
            i = np.repeat(np.arange(len(place)), n)
            back = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + off[i]
            start, doc = (pos[i] - back), doc[i]
            a = h.words.first[:-1][doc] + start
            ok = a + least <= h.words.first[1:][doc]  # rows that share an id may differ in their text
            a, start, doc, back = a[ok], start[ok], doc[ok], back[ok]
            w = h.run(a, a + least) ^ mix(back.astype(np.uint64) + np.uint64(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.run(a + back, a + back + gram).view(np.int64)), pa.array(w.view(np.int64)),
                 batch.column(0).take(pa.array(doc)), pa.array(start.astype(np.int32))], names=["h", "w", "doc_id", "start"])

    return docs.join(wanted, "doc_id").select("doc_id", "text", "places").mapInArrow(
        run, f"h bigint, w bigint, doc_id {kind}, start int")


def _spans(marks: np.ndarray) -> list[tuple[int, int, bool]]:
    """(start, end, first) from marks that pack start, end and whether an earlier copy exists: maximal
    stretches of marked words that all have, or all lack, an earlier copy."""
    a, b, later = marks >> 32, marks >> 1 & 0x7FFFFFFF, marks & 1
    low = int(a.min())
    size = int(b.max()) - low + 1
    state = np.zeros(size, np.int8)
    for which, value in ((later == 0, 1), (later == 1, 2)):
        depth = np.zeros(size, np.int64)
        np.add.at(depth, a[which] - low, 1)
        np.add.at(depth, b[which] - low, -1)
        state[np.cumsum(depth) > 0] = value
    edges = np.flatnonzero(np.diff(np.r_[0, state, 0]))
    return [(int(i) + low, int(j) + low, state[i] == 1) for i, j in zip(edges, edges[1:], strict=False) if state[i]]


def repeated_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, variant, spans`` for every document that holds a passage of at least ``least`` words which occurs
    more than once, in another document or in itself. ``spans`` are ``(start, end, first)`` in words, end
    exclusive: ``first`` stretches are the first copy (smallest ``doc_id``, then place) of what they hold,
    the others have an earlier copy.

    Null, empty and short texts have no such passage, and rows without an id take no part. ``variant`` is
    the xxhash64 of the text: rows that share an id are told apart by it, and rows equal in id and text are
    one document, which is the first copy of itself. ``least`` may be up to 65,535 words. A text that repeats with a period shorter
    than the passage keeps its first period. Other columns are ignored; an empty table gives no rows.
    """
    if not gram <= least < 1 << 16:
        raise ValueError(f"least must be from gram ({gram}) to 65535 words, not {least}")
    src = narrow(docs, doc_id=id_col, text=text_col).where("doc_id is not null and text is not null").select(
        F.struct("doc_id", F.xxhash64("text").alias("variant")).alias("doc_id"), "text")
    kept = suffixes(src, gram, least)
    twice = materialize(kept.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "runs")
    shared = materialize(kept.join(twice, "h"), "suffixes")
    classes = materialize(shared.groupBy("h", "around").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "place")).alias("first")), "classes")
    same = shared.join(classes.where("n > 1"), ["h", "around"]).select(
        "doc_id", F.expr("(place >> 32) - (place >> 16 & 65535)").alias("a"), F.expr("(place >> 32) + (place & 65535)").alias("b"),
        (F.struct("doc_id", "place") != F.col("first")).alias("later"))
    several = materialize(classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "several")
    wanted = classes.join(several, "h").groupBy(F.col("first.doc_id").alias("doc_id")).agg(
        F.collect_list("first.place").alias("places"))
    seen = materialize(windows(src, wanted, gram, least), "windows")
    # written, like ``several``, so that both sides of the join are plain shuffles and a hot key can be split
    firsts = materialize(seen.groupBy("h", "w").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).where("n > 1").drop("n"), "firsts")
    equal = seen.join(firsts, ["h", "w"]).select(
        "doc_id", F.col("start").cast("bigint").alias("a"), (F.col("start") + least).cast("bigint").alias("b"),
        (F.struct("doc_id", "start") != F.col("first")).alias("later"))
    marks = same.union(equal).select(
        "doc_id", F.expr("a << 32 | b << 1 | cast(later as bigint)").alias("mark")).groupBy("doc_id").agg(
        F.collect_set("mark").alias("marks"))
    kind = src.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, flat = batch.column(1).offsets.to_numpy(), batch.column(1).flatten().to_numpy()
            at = at - at[0] if len(at) else at
            rows = [[{"start": a, "end": b, "first": bool(f)} for a, b, f in _spans(flat[i:j])]
                    for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], names=["doc_id", "spans"])

    return marks.mapInArrow(run, f"doc_id {kind}, spans array<struct<start:int,end:int,first:boolean>>").select(
        "doc_id.doc_id", "doc_id.variant", "spans")


def cut_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with every passage that has an earlier copy cut out of the text column (with the white
    space after it); rows and other columns stay as they are. Cuts go by id and text, so rows that share an
    id are cut each by its own text; rows without an id and null texts stay whole; an empty table gives no
    rows. ``docs`` must be a stored table: it is read several times."""
    spans = repeated_spans(docs, least, gram, id_col, text_col).select(
        "doc_id", "variant", F.filter("spans", lambda s: ~s["first"]).alias("cut")).where(F.size("cut") > 0)
    joined = docs.join(spans, (docs[id_col] == spans["doc_id"]) & (F.xxhash64(docs[text_col]) == spans["variant"]), "left").select(
        *[docs[f"`{c}`"] for c in docs.columns], spans["cut"].alias("cut" + "_" * max(map(len, docs.columns))))
    names, place = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, place, 2 << 20):
            cuts, texts = batch.column(len(names)).to_pylist(), batch.column(place).to_pylist()
            todo = [i for i, c in enumerate(cuts) if c and texts[i]]
            if todo:
                raw, offsets = utf8_buffers(pa.array([texts[i] for i in todo], pa.string()))
                words, whole = Words(raw, offsets), raw.tobytes()
                for k, i in enumerate(todo):
                    first, last = int(words.first[k]), int(words.first[k + 1])
                    out, at, end = [], int(offsets[k]), int(offsets[k + 1])
                    for c in sorted(cuts[i], key=lambda c: c["start"]):
                        a, b = first + c["start"], first + c["end"]
                        if a < last:
                            out.append(whole[at:int(words.start[a])])
                            at = int(words.start[b]) if b < last else end
                    texts[i] = b"".join([*out, whole[at:end]]).decode()
            cols = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(run, docs.schema)


def op4_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("spans").alias("s")).select(
        "doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"), F.col("s.first").alias("first_copy"))
