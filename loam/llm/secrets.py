"""Secret scans with a character convolutional network (operator 2).

Three base rules find secrets by their form. Beside them every other candidate, a run of 16 or more
characters that secrets are made of, is read with its surrounding context by a small convolutional
network in numpy: character embeddings and an "inside the candidate" flag, one convolution, maximum and
mean pooling, a logistic output. Long candidates are read window by window, all of them.

The network is trained on labelled findings of all documents: candidates that a base rule found are
positive, the others negative; each positive is also shown in the context of a negative, so that it is
known without its key word. The different windows are dealt into parts of bounded size; in each round every
part trains the network on its own windows, and the parts' networks are averaged. On windows held back, a
quarter by their hash, the outputs are calibrated (Platt) and the threshold is set as high as it can be
while the wanted recall of positives holds, both by sums and ranks over all of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, materialize, narrow, read_table

#: The base rules (kind, pattern, group and characters it must have at least).
RULES = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
               r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
KINDS = [kind for kind, *_ in RULES]
ADDED = "cnn"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Window: characters of the candidate, of context on either side, and the step along long candidates.
INSIDE, AROUND, STEP = 40, 12, 30
WIDTH = INSIDE + 2 * AROUND
SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Windows of a training part, windows of a rare class that each part should get, and the recall the threshold must keep.
PART, LEAST, RECALL = 8192, 16, 0.99
#: Rounds of training, windows of a step, and networks averaged in one group.
ROUNDS, BATCH, FOLD = 6, 128, 64

Span = tuple[str, int, int]


class Base:
    """The base rules on whole texts: leftmost, not overlapping within a kind."""

    def __init__(self) -> None:
        rules = {kind: (re.compile(p), g, n) for kind, p, g, n in RULES}
        self.assign, self.access, self.hex = (rules[k] for k in KINDS)
        self.runs = re.compile(CANDIDATE).finditer

    def scan(self, text: str) -> tuple[list[Span], list[tuple[int, int]]]:
        """Spans in order of start and kind, and all candidate runs."""
        runs = [m.span() for m in self.runs(text)]
        found: list[Span] = []
        if ":" in text or "=" in text:  # the rule needs one of the two
            rule, group, least = self.assign
            found += [("assign", *m.span()) for m in rule.finditer(text) if len(m[group]) >= least]
        if "AKIA" in text:
            rule, group, least = self.access
            found += [("access", *m.span()) for m in rule.finditer(text) if len(m[group]) >= least]
        rule, group, least = self.hex
        for a, b in runs:  # a hex run of this length lies within one candidate
            if b - a >= least:
                found += [("hex", *m.span()) for m in rule.finditer(text, a, b) if len(m[group]) >= least]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))), runs


def apart(span: tuple[int, int], found: list[Span]) -> bool:
    return all(span[1] <= a or b <= span[0] for _, a, b in found)


def windows(text: str, a: int, b: int) -> list[str]:
    """The candidate's windows: context, part of the candidate, context, each padded to its width."""
    starts = range(a, max(a + 1, b - INSIDE + STEP), STEP)
    return [text[max(0, s - AROUND):s].rjust(AROUND, "\0") + text[s:min(b, s + INSIDE)].ljust(INSIDE, "\0")
            + text[min(b, s + INSIDE):min(b, s + INSIDE) + AROUND].ljust(AROUND, "\0") for s in starts]


def codes(ws: list[str]) -> np.ndarray:
    """Characters as 0 (none), 1 (line break and other control), 2-96 (printable ASCII), 97 (any other)."""
    points = np.frombuffer("".join(ws).encode("utf-32-le"), "<u4").reshape(-1, WIDTH).astype(np.int64)
    return np.select([points == 0, points < 32, points < 127], [0, 1, points - 30], 97)


@dataclass
class Network:
    """Embedding (98, e), convolution (width * (e + 1), f) and bias, output (2 f) and bias."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    width: int = 5

    @staticmethod
    def fresh(rng: np.random.Generator, e: int = 8, f: int = 24, width: int = 5) -> Network:
        return Network(rng.normal(0, 0.5, (98, e)), rng.normal(0, (width * (e + 1)) ** -0.5, (width * (e + 1), f)),
                       np.zeros(f), rng.normal(0, 0.1, 2 * f), np.zeros(1), width)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        inside = np.zeros((len(x), WIDTH, 1), np.float32)
        inside[:, AROUND:AROUND + INSIDE, 0] = x[:, AROUND:AROUND + INSIDE] > 0
        rows = np.concatenate([self.embed.astype(np.float32)[x], inside], axis=2)
        view = np.lib.stride_tricks.sliding_window_view(rows, self.width, axis=1)  # (n, places, e + 1, width)
        return view.transpose(0, 1, 3, 2).reshape(len(x), WIDTH - self.width + 1, -1)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        cols = self._columns(x)
        flat = cols.reshape(-1, cols.shape[2]) @ self.conv.astype(np.float32) + self.bias.astype(np.float32)
        act = np.maximum(flat, 0).reshape(*cols.shape[:2], -1)
        top = act.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(axis=1)], axis=1).astype(float)
        return pooled @ self.out + self.shift[0], (cols, act, top, pooled)

    def score(self, x: np.ndarray, at_once: int = 512) -> np.ndarray:
        return np.concatenate([self.forward(x[i:i + at_once])[0] for i in range(0, len(x), at_once)] or [np.zeros(0)])

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted logistic loss, in the order of the fields."""
        z, (cols, act, top, pooled) = self.forward(x)
        dz = (1 / (1 + np.exp(-z)) - y) * weight / len(x)
        f = len(self.bias)
        dact = np.broadcast_to((dz[:, None] * self.out[f:])[:, None] / act.shape[1], act.shape).astype(np.float32)
        i, k = np.indices(top.shape)
        dact[i, top, k] += dz[:, None] * self.out[:f]
        dact *= act > 0
        flat = dact.reshape(-1, f)
        dcols = (flat @ self.conv.T.astype(np.float32)).reshape(*cols.shape[:2], self.width, -1)
        drows = np.zeros((*x.shape, self.embed.shape[1]), np.float32)
        for t in range(self.width):
            drows[:, t:t + cols.shape[1]] += dcols[:, :, t, :-1]
        dembed = np.stack([np.bincount(x.ravel(), drows[:, :, i].ravel(), len(self.embed)) for i in range(drows.shape[2])], 1)
        return [dembed, cols.reshape(-1, cols.shape[2]).T @ flat, flat.sum(axis=0), pooled.T @ dz, np.array([dz.sum()])]

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.out, self.shift]

    def train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, adam: Adam | None = None,
              epochs: int | None = None, rate: float = 3e-3) -> Network:
        """Adam over whole epochs; ``adam`` carries its moments from one call to the next."""
        params, adam = self.params(), adam or Adam.fresh(self)
        weight = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
        for _ in range(epochs or epochs_for(len(x))):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                adam.t += 1
                pick = order[i:i + BATCH]
                for p, g, a, b in zip(params, self.step(x[pick], y[pick], weight[pick]), adam.m1, adam.m2, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9 ** adam.t)) / (np.sqrt(b / (1 - 0.999 ** adam.t)) + 1e-8)
        return self


def epochs_for(n: int, steps: int = 500) -> int:
    """Passes over ``n`` windows: six at least and ``steps`` batches at least."""
    return max(6, -(-steps * BATCH // max(1, n)))


@dataclass
class Adam:
    """Moments of the gradients, in the order of the network's parameters, and the steps done."""

    m1: list[np.ndarray]
    m2: list[np.ndarray]
    t: float = 0

    @staticmethod
    def fresh(network: Network) -> Adam:
        return Adam(*([np.zeros_like(p) for p in network.params()] for _ in range(2)))


def flat(network: Network, adam: Adam) -> np.ndarray:
    """Parameters, moments and steps in one vector, which can be averaged."""
    return np.concatenate([a.ravel() for a in network.params() + adam.m1 + adam.m2] + [np.array([adam.t])])


def unflat(vector: np.ndarray) -> tuple[Network, Adam]:
    like = Network.fresh(np.random.default_rng(0)).params()
    ends = np.cumsum([p.size for p in like * 3])
    parts = [v.reshape(p.shape).copy() for v, p in zip(np.split(vector[:-1], ends[:-1]), like * 3, strict=True)]
    n = len(like)
    return Network(*parts[:n]), Adam(parts[n:2 * n], parts[2 * n:], float(vector[-1]))


#: Sums over held-back outputs, given a, b and the targets of the classes: (p - t) z, p - t, w z z, w z and w.
Sums = Callable[[float, float, float, float], list[float]]


def platt(ones: int, zeros: int, sums: Sums) -> tuple[float, float]:
    """``a, b`` so that ``sigmoid(a z + b)`` is the chance of a 1; targets smoothed by the class sizes."""
    a, b = 1.0, 0.0
    for _ in range(50):
        gz, g, wzz, wz, w = sums(a, b, (ones + 1) / (ones + 2), 1 / (zeros + 2))
        move = np.linalg.solve(np.array([[wzz + 1e-3, wz], [wz, w]]), np.array([gz + 1e-3 * (a - 1), g]))
        a, b = float(a - np.clip(move[0], -1, 1)), float(b - np.clip(move[1], -2, 2))
        if np.abs(move).max() < 1e-9:
            break
    return max(a, 1e-3), b


def sums_of(z: np.ndarray, y: np.ndarray) -> Sums:
    def sums(a: float, b: float, high: float, low: float) -> list[float]:
        p = chance_of(a, b, z)
        off, w = p - np.where(y > 0, high, low), p * (1 - p) + 1e-9
        return [(off * z).sum(), off.sum(), (w * z * z).sum(), (w * z).sum(), w.sum()]

    return sums


def sums_over(scored: DataFrame) -> Sums:
    """The same over a table ``z, y``."""
    def sums(a: float, b: float, high: float, low: float) -> list[float]:
        z = F.col("z")
        p = 1 / (1 + F.exp(-F.greatest(F.least(F.lit(a) * z + F.lit(b), F.lit(30.0)), F.lit(-30.0))))
        rows = scored.select("z", (p - F.when(F.col("y") == 1, high).otherwise(low)).alias("off"), (p * (1 - p) + 1e-9).alias("w"))
        off, w = F.col("off"), F.col("w")
        return list(rows.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate([off * z, off, w * z * z, w * z, w])]).first())

    return sums


def chance_of(a: float, b: float, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))


@dataclass
class Detector:
    network: Network
    a: float
    b: float
    threshold: float

    def chance(self, ws: list[str]) -> np.ndarray:
        if not ws:
            return np.zeros(0)
        return chance_of(self.a, self.b, self.network.score(codes(ws)))

    def add(self, texts: list[str], scanned: list[tuple[list[Span], list[tuple[int, int]]]]) -> list[list[Span]]:
        """All spans of each text: base ones and the candidates apart from them that reach the threshold."""
        ws: list[str] = []
        owner: list[tuple[int, int, int]] = []
        for i, (text, (found, runs)) in enumerate(zip(texts, scanned, strict=True)):
            for a, b in runs:
                if apart((a, b), found):
                    own = windows(text, a, b)
                    ws += own
                    owner += [(i, a, b)] * len(own)
        hits: dict[tuple[int, int, int], None] = dict.fromkeys(
            o for o, p in zip(owner, self.chance(ws), strict=True) if p >= self.threshold)
        out = [list(found) for found, _ in scanned]
        for i, a, b in hits:
            out[i].append((ADDED, a, b))
        return [sorted(s, key=lambda x: (x[1], [*KINDS, ADDED].index(x[0]))) for s in out]


def training_windows(docs: DataFrame, text_col: str) -> DataFrame:
    """``w, y``: every different window of the candidates of all documents; ``y`` is 1 where a base rule found
    the candidate, in any place."""
    src = narrow(docs, text=text_col).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = Base()
        for batch in bounded(batches, 0):
            ws: list[str] = []
            ys: list[int] = []
            for text in batch.column(0).to_pylist():
                found, runs = base.scan(text)
                own = [(a, b) for _, a, b in found]
                for a, b in [*own, *(r for r in runs if apart(r, found))]:
                    new = windows(text, a, b)
                    ws += new
                    ys += [int((a, b) in own)] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array(ys, pa.int32())], names=["w", "y"])

    return src.mapInArrow(run, "w string, y int").groupBy("w").agg(F.max("y").alias("y"))


def dealt(found: DataFrame, ones: int, zeros: int) -> tuple[DataFrame, int]:
    """``w, y, held, copy, part`` and the number of parts: each window in one part by its hash, of about
    ``PART`` windows; those of a class too rare for that also as copies 1, 2, ... in other parts."""
    parts = max(1, -(-(ones + zeros) // PART))
    copies = [min(parts, -(-LEAST * parts // n)) for n in (zeros, ones)]
    many, step = ([F.when(F.col("y") == 1, F.lit(x[1])).otherwise(F.lit(x[0])) for x in (copies, [parts // c for c in copies])])
    rows = found.select("w", "y", (F.pmod(F.xxhash64("w", F.lit(11)), F.lit(4)) == 0).alias("held"),
                        F.explode(F.sequence(F.lit(0), many - 1)).alias("copy"), step.alias("step"))
    part = F.pmod(F.pmod(F.xxhash64("w", F.lit(7)), F.lit(parts)) + F.col("copy") * F.col("step"), F.lit(parts))
    return rows.select("w", "y", "held", "copy", part.cast("long").alias("part")), parts


def moved_to(positive: list[str], negative: list[str], rng: np.random.Generator) -> list[str]:
    """Each positive in the context of a negative; where there is none, in no context."""
    around = [negative[i] for i in rng.integers(0, len(negative), len(positive))] if negative else ["\0" * WIDTH] * len(positive)
    return [c[:AROUND] + w[AROUND:AROUND + INSIDE] + c[AROUND + INSIDE:] for w, c in zip(positive, around, strict=True)]


def lesson(table: pa.Table, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, classes, held back or not and number of copy of a part's windows and of its moved positives."""
    table = table.sort_by("w")
    ws = table["w"].to_pylist()
    y, held, copy = (table[c].to_numpy() for c in ("y", "held", "copy"))
    one, zero = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    moved = moved_to([ws[i] for i in one], [ws[i] for i in zero], np.random.default_rng((seed, table["part"][0].as_py())))
    pick = np.r_[np.arange(len(ws)), one]
    return codes(ws + moved), y[pick].astype(float), held[pick], copy[pick]


def fit(positive: list[str], negative: list[str], recall: float = RECALL, seed: int = 5) -> Detector | None:
    """``learn`` on windows at hand, in one part."""
    if min(len(positive), len(negative)) < 8:
        return None
    rng = np.random.default_rng(seed)
    moved = moved_to(positive, negative, rng)

    def table(one: list[str], zero: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return codes(one + zero), np.r_[np.ones(len(one)), np.zeros(len(zero))]

    held = [slice(0, None, 4), slice(1, None, 4), slice(2, None, 4), slice(3, None, 4)]
    x, y = table(*([w for h in held[1:] for w in ws[h]] for ws in (positive + moved, negative)))
    vx, vy = table((positive + moved)[held[0]], negative[held[0]])
    network = Network.fresh(rng).train(x, y, rng)
    z = network.score(vx)
    a, b = platt(int(vy.sum()), int((1 - vy).sum()), sums_of(z, vy))
    ones = np.sort(z[vy > 0])
    return Detector(network, a, b, float(chance_of(a, b, ones[int((1 - recall) * len(ones))])))


def learn(docs: DataFrame, text_col: str, recall: float = RECALL, seed: int = 5) -> Detector | None:
    """Train on the windows of all documents, calibrate and set the threshold; nothing to learn from (fewer
    than 8 different windows of a class) gives no detector, and the base rules then stand alone. A class of
    which none or all would be held back is trained and calibrated on alike. The driver gets one network for
    every ``FOLD`` parts in a round, and the lowest outputs of positives that the recall leaves out."""
    found = materialize(training_windows(docs, text_col), "secret-windows")
    sizes = {r.y: r.n for r in found.groupBy("y").agg(F.count("w").alias("n")).collect()}
    if min(sizes.get(1, 0), sizes.get(0, 0)) < 8:
        return None
    rows, parts = dealt(found, sizes[1], sizes[0])
    rows = materialize(rows, "secret-parts")
    classes = {(r.y, r.held) for r in rows.select("y", "held").distinct().collect()}
    all_in = len(classes) < 4
    by_part = rows.repartitionById(parts, F.col("part").cast("int"))  # each part is a partition, none holds two
    epochs = epochs_for((2 * sizes[1] + sizes[0]) * 3 // 4 // parts)
    rounds = 1 if parts == 1 else ROUNDS

    def whole(of: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if got := [b for b in batches if b.num_rows]:
                yield from of(pa.Table.from_batches(got)).to_batches()

        return run

    def trained(state: np.ndarray, k: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            part = table["part"][0].as_py()
            x, y, held, _ = lesson(table, seed)
            keep = ~held | all_in
            network, adam = unflat(state)
            if keep.any():
                network.train(x[keep], y[keep], np.random.default_rng((seed, part, k)), adam, epochs // rounds + (k < epochs % rounds))
            return pa.table({"part": [part], "n": [int(keep.sum())], "state": [flat(network, adam)]})

        return run

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        n, states = table["n"].to_numpy(), np.array(table["state"].to_pylist())
        return pa.table({"part": [table["part"][0].as_py()], "n": [int(n.sum())], "state": [n @ states / max(1, n.sum())]})

    network = Network.fresh(np.random.default_rng(seed))
    state = flat(network, Adam.fresh(network))
    kind = "part long, n long, state array<double>"
    for k in range(rounds):
        own = by_part.mapInArrow(whole(trained(state, k)), kind)
        folds = own.groupBy(F.floor(F.col("part") / FOLD).alias("fold")).applyInArrow(mean, kind).collect()
        folds.sort(key=lambda r: r.part)
        state = np.average([r.state for r in folds], axis=0, weights=[r.n for r in folds])
    network = unflat(state)[0]

    def score(table: pa.Table) -> pa.Table:
        x, y, held, copy = lesson(table, seed)
        keep = (held | all_in) & (copy == 0)
        return pa.table({"z": network.score(x[keep]), "y": y[keep].astype(np.int32)})

    scored = materialize(by_part.mapInArrow(whole(score), "z double, y int"), "secret-scores")
    sizes = {r.y: r.n for r in scored.groupBy("y").agg(F.count("z").alias("n")).collect()}
    a, b = platt(sizes[1], sizes[0], sums_over(scored))
    last = scored.where(F.col("y") == 1).orderBy("z").offset(int((1 - recall) * sizes[1])).limit(1).first()
    return Detector(network, a, b, float(chance_of(a, b, np.float64(last.z))))


def scan(docs: DataFrame, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` per input row; ``spans`` are ``(kind, start, end)`` in code points, end exclusive,
    in order of start and kind (base kinds as listed, then ``cnn``).

    Null text counts as empty and has none; repeated rows stay; other columns are ignored; an empty table
    gives no rows. The network learns from the windows of all rows (``learn``).
    """
    src = narrow(docs, doc_id=id_col, text=text_col)
    detector = learn(docs, text_col, recall)
    kind = src.schema["doc_id"].dataType.simpleString()
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = Base()
        for batch in bounded(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            scanned = [base.scan(t) for t in texts]
            spans = detector.add(texts, scanned) if detector else [found for found, _ in scanned]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, arrow)], names=["doc_id", "spans"])

    return src.mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def redact(docs: DataFrame, mark: str = "[secret]", recall: float = RECALL, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text column replaced by ``mark``; all other columns stay as they
    are. Overlapping spans are one. A null text stays null."""
    names = docs.columns
    detector = learn(docs, text_col, recall)
    place = names.index(text_col)

    def clean(text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for _, a, b in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = Base()
        for batch in bounded(batches, place):
            texts = batch.column(place).to_pylist()
            scanned = [base.scan(t or "") for t in texts]
            spans = detector.add([t or "" for t in texts], scanned) if detector else [f for f, _ in scanned]
            new = [t if t is None or not s else clean(t, s) for t, s in zip(texts, spans, strict=True)]
            cols = [pa.array(new, pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def op2_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        *[_count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != ADDED)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"))
