"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks (operator 6).

The kernel compares two words by their common subsequences of three and four characters, gaps allowed: a
subsequence counts ``DECAY`` to the power of the characters it skips, so that an insult with inserted or
missing characters still shares most of its subsequences. Word borders are characters too. Punctuation
and digits inside a word are dropped, and runs of single letters are read as one word.

Labels are given for documents, of which one word may be the cause; so training is by instances: the
words of documents labelled 0 are negative, and of a document labelled 1 the words that its label rests on
are positive, together with copies of them that have a letter inserted, replaced, doubled or left out. Those
words come first from stems that are frequent in documents labelled 1 and rare in the others, later from the
machine's own scores; what scores high in documents labelled 0 weighs more from then on. A word's features are its kernel values with the landmark words,
whitened (Nystroem); the linear machine over them (squared hinge) folds back into one weight per
subsequence, so that scoring a word is a sum of table look-ups and no landmark is visited any more. The
highest word score of a text, calibrated on documents held back from the fit (Platt) and on copies of the
clean ones with a single insult put in, is its score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, narrow, read_table

DECAY = 0.6
#: Subsequence lengths with the longest stretch of text each may span.
SPANS = {3: 5, 4: 6}
#: Bounds of the training sample (documents by label) and of the landmark set.
MAX_TOXIC, MAX_CLEAN, LANDMARKS = 1_500, 3_000, 320
#: A text is predicted toxic from this score on.
LIMIT = 0.3
#: Positive words that get bent copies, and the weight of a copy.
BENT, BENT_WEIGHT = 200, 1.2
#: Weight of a clean document against a toxic one where both hold a word.
SHARED = 8.0
#: Weight of all texts with one planted insult against that of the toxic ones, in the calibration.
PLANTED = 0.25
MEMO = 200_000
#: Words scored at a time, which bounds memory.
SCORED = 40_000
#: Codes of four characters lie below, those of three from here on.
FOUR, CODES = 1 << 24, (1 << 24) + (1 << 18)

_LETTERS = {chr(97 + i): 3 + i for i in range(26)}
_SINGLES = re.compile(r"(?<!\S)\S(?:[ \-_.*]\S){2,}(?!\S)")


def symbol(c: str) -> int:
    """1 and 2 are the word borders, 3-28 the letters a-z; other letters share 29-63."""
    return _LETTERS.get(c) or 29 + ord(c) % 35


_SYMBOLS = np.array([0, 1, 2] + [0] * (0x250 - 3), np.int64)
for _i in range(3, 0x250):
    if chr(_i).isalpha():
        _SYMBOLS[_i] = symbol(chr(_i))


def letters(token: str) -> str:
    """The letters of a lower-case token, in order."""
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def tokens_of(text: str) -> Counter[str]:
    """Lower-case runs of non-space characters, and runs of single characters as one, with their counts."""
    lower = text.lower()
    found = Counter(lower.split())
    found.update(m[0] for m in _SINGLES.finditer(lower))
    return found


def words_of(text: str) -> Counter[str]:
    """Counts of the texts' words, by their letters."""
    found: Counter[str] = Counter()
    for token, n in tokens_of(text).items():
        if word := letters(token):
            found[word] += n
    return found


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Blocks ``(word, code, weight)``: every subsequence of the words' letters within the allowed spans."""
    points = np.frombuffer("\x02".join(["", *(f"\x01{w}" for w in words), ""])[1:].encode("utf-32-le"), "<u4").astype(np.int64)
    if not len(points):
        return
    s = np.where(points < len(_SYMBOLS), _SYMBOLS[np.minimum(points, len(_SYMBOLS) - 1)], 29 + points % 35)
    word = np.cumsum(points == 1) - 1
    for p, span in SPANS.items():
        for d in combinations(range(1, span), p - 1):
            n = len(s) - d[-1]
            if n <= 0:
                continue
            at = np.flatnonzero(word[:n] == word[d[-1]:])
            code = s[at]
            for k in d:
                code = code << 6 | s[at + k]
            yield word[at], code + (FOUR if p == 3 else 0), DECAY ** (d[-1] - p + 1)


def norms(words: list[str]) -> np.ndarray:
    """Square roots of the summed squared weights of the subsequences of each word."""
    total = np.zeros(len(words))
    for word, _, w in subsequences(words):
        total += np.bincount(word, minlength=len(words)) * w * w
    return np.sqrt(np.maximum(total, 1e-12))


class Landmarks:
    """Kernel values with a fixed set of words."""

    def __init__(self, words: list[str]):
        self.words = words
        at, codes, weights = (np.concatenate(x) for x in zip(
            *((a, c, np.full(len(a), w)) for a, c, w in subsequences(words)), strict=True))
        self.codes, place = np.unique(codes, return_inverse=True)
        self.matrix = np.zeros((len(self.codes), len(words)))
        np.add.at(self.matrix, (place, at), weights)
        self.matrix /= norms(words)

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)))
        for i in range(0, len(words), 2000):
            part = words[i:i + 2000]
            sums = np.zeros((len(part), len(self.words)))
            for at, code, w in subsequences(part):
                place = np.searchsorted(self.codes, code)
                hit = np.flatnonzero(self.codes[np.minimum(place, len(self.codes) - 1)] == code)
                np.add.at(sums, at[hit], w * self.matrix[place[hit]])
            out[i:i + 2000] = sums / norms(part)[:, None]
        return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """The linear machine ``x w`` (last column: bias) for ``y`` in -1, 1, by Newton steps."""
    w = np.zeros(x.shape[1])
    eye = ridge * np.eye(x.shape[1])
    eye[-1, -1] = 1e-6

    def cost(v: np.ndarray) -> float:
        return float((weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum() + v @ eye @ v)

    for _ in range(30):
        on = y * (x @ w) < 1
        xa = x[on] * weight[on, None]
        move = np.linalg.solve(xa.T @ x[on] + eye, xa.T @ y[on]) - w
        step, now = 1.0, cost(w)
        while step > 1e-4 and cost(w + step * move) > now:
            step /= 2
        w = w + step * move
        if now - cost(w) < 1e-6 * max(1.0, now):
            break
    return w


def traits(scores: np.ndarray, counts: np.ndarray, bias: float) -> list[float]:
    """What a text's word scores come to: the highest one, how often words reach the positive side and how
    often its margin, and, if any do, the length of the text (chance hits grow with it)."""
    if not len(scores):
        return [bias, 0.0, 0.0, 0.0]
    hits, strong = counts[scores > 0].sum(), counts[scores > 0.9].sum()
    return [float(scores.max()), float(np.log1p(hits)), float(np.log1p(strong)), float(np.log1p(counts.sum()) * (hits > 0))]


@dataclass
class Machine:
    """One weight per subsequence code, a bias, and the calibration of a text's traits."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    mix: np.ndarray

    def table(self) -> np.ndarray:
        """Weights by code: a dense table, built once per task."""
        out = np.zeros(CODES, np.float32)
        out[self.codes] = self.weights
        return out

    def score(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Scores of words given by their letters; a word without letters has the bias alone."""
        if len(words) > SCORED:
            return np.concatenate([self.score(words[i:i + SCORED], table) for i in range(0, len(words), SCORED)])
        total = np.zeros(len(words))
        for at, code, w in subsequences(words):
            total += w * np.bincount(at, weights=table[code], minlength=len(words))
        return total / norms(words) + self.bias

    def chance(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.mix[:-1] + self.mix[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Calibration: the weights of a logistic model (bias last), targets smoothed by the class sizes."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    pull = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(pull), x.T @ (weight * (p - t)) + pull * w)
        w = w - move / max(1.0, np.abs(move).max() / 3)
        if np.abs(move).max() < 1e-8:
            break
    return w


def causes(toxic: list[set[str]], clean: list[set[str]]) -> set[str]:
    """Words that labels 1 may rest on: those with a stem (a word, or its first 4 to 8 letters) that is
    far more frequent in documents labelled 1. Stems are taken one by one, the one that explains most of
    the documents not yet explained first; after that also those that are common by themselves."""

    def stems(words: set[str]) -> set[str]:
        return {g for w in words if len(w) > 2 for g in (f"{w}$", *(w[:k] for k in range(4, min(len(w), 9))))}

    # only stems of several documents labelled 1 matter; the others are never held
    least = max(2, 0.004 * len(toxic))
    often = Counter(g for ws in toxic for g in stems(ws))
    often = {g: g for g, n in often.items() if n >= least}
    by_doc = [{often[g] for g in stems(ws) if g in often} for ws in toxic]
    seen_clean = Counter(often[g] for ws in clean for g in stems(ws) if g in often)
    left = set(range(len(by_doc)))
    taken: set[str] = set()
    total = len(clean) + 1
    while left:
        count: Counter[str] = Counter()
        for i in left:
            count.update(by_doc[i])
        best = max(count, key=lambda g: (count[g] - 4 * len(left) * seen_clean[g] / total, -abs(len(g) - 5), g), default="")
        if count[best] < least or count[best] < 4 * (seen_clean[best] + 0.5) / total * len(left):
            break
        taken.add(best)
        left = {i for i in left if best not in by_doc[i]}
    whole = Counter(g for gs in by_doc for g in gs)
    taken |= {g for g, n in whole.items() if n >= max(3, 0.02 * len(toxic)) and n >= 20 * (seen_clean[g] + 0.5) / total * len(toxic)}
    every = set().union(*toxic) if toxic else set()
    return {w for w in every if stems({w}) & taken}


def variants(word: str, rng: np.random.Generator, n: int = 8) -> list[str]:
    """The word with one letter inserted, replaced, doubled or left out inside, ``n`` times at random."""
    out = []
    for kind in rng.integers(0, 5, n if len(word) > 3 else 0):
        i = int(rng.integers(1, len(word) - 1))
        other = chr(97 + int(rng.integers(26)))
        new = ("", word[i] * 2, word[i] + other, word[i] + other, other)[kind]
        out.append(word[:i] + new + word[i + 1:])
    return out


def without_copies(docs: list[Counter]) -> list[Counter]:
    """One document of those whose three smallest word hashes are the same, so that a group of near
    copies does not make its words look frequent."""
    seen: dict[tuple, Counter] = {}
    for ws in docs:
        seen.setdefault(tuple(sorted(zlib.crc32(w.encode()) for w in ws)[:3]), ws)
    return list(seen.values())


def fit(toxic: list[Counter], clean: list[Counter], rounds: int = 3, seed: int = 11) -> Machine:
    """Train on documents given as counts of words (letters only). Without a document of either label the
    machine scores every text alike, by the share of label 1 (one half without any label)."""
    if not toxic or not clean:
        prior = np.log((len(toxic) + 0.5) / (len(clean) + 0.5))
        return Machine(np.zeros(1, np.int64), np.zeros(1), 0.0, np.array([0, 0, 0, 0, prior]))
    toxic, clean = without_copies(toxic), without_copies(clean)
    rng = np.random.default_rng(seed)
    held = len(toxic) >= 24 and len(clean) >= 24
    fit_t = [w for i, w in enumerate(toxic) if not held or i % 4 != 3]
    fit_c = [w for i, w in enumerate(clean) if not held or i % 4 != 3]
    in_toxic, in_clean = (Counter(w for ws in docs for w in ws) for docs in (fit_t, fit_c))
    pool = sorted(in_clean)

    def likely(w: str) -> bool:
        return in_toxic[w] / len(fit_t) > 2 * in_clean[w] / len(fit_c)

    positive = {w for w in causes([set(w) for w in fit_t], [set(w) for w in fit_c]) if likely(w)}
    hard: set[str] = set()
    for _ in range(rounds):
        pos = sorted(positive) or sorted(in_toxic)[:500]
        pos = [pos[i] for i in np.sort(rng.permutation(len(pos))[:4000])]
        top = sorted(pos, key=lambda w: (-in_toxic[w], w))[:BENT]
        bent = {v: w for w in top for v in variants(w, rng) if v not in in_clean and v not in positive}
        pos += sorted(bent)
        neg = sorted({pool[i] for i in rng.permutation(len(pool))[:8000]} | hard | {w for w in pos if in_clean[w]}
                     | {w for w, _ in in_clean.most_common(1000)})
        half = LANDMARKS // 2
        rivals = sorted(hard, key=lambda w: (-in_clean[w], w))[:half // 2]
        marks = Landmarks(sorted({*top[:half // 2], *(pos[i] for i in rng.permutation(len(pos))[:half - len(top[:half // 2])]),
                                  *rivals, *(neg[i] for i in rng.permutation(len(neg))[:half - len(rivals)])}))
        gram = marks.kernel(marks.words)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        keep = values > 1e-6 * values.max()
        white = vectors[:, keep] / np.sqrt(values[keep])
        x = np.c_[marks.kernel(pos + neg) @ white, np.ones(len(pos) + len(neg))]
        y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        often = [np.array([np.sqrt(in_toxic[bent.get(w, w)]) * (BENT_WEIGHT if w in bent else 1) for w in pos]),
                 np.array([in_clean[w] if w in hard else np.sqrt(in_clean[w]) for w in neg])]
        weight = np.concatenate([t * o / o.sum() for t, o in zip((2000, 4000), often, strict=True)])
        of_pos = dict(zip(pos, weight, strict=False))
        for i, v in enumerate(neg, len(pos)):  # a word of both sides weighs on each by its share of documents
            if v in of_pos and v not in bent:
                weight[i] = SHARED * of_pos[v] * in_clean[v] / in_toxic[v]
        w = squared_hinge(x, y, weight, 0.5)
        machine = Machine(marks.codes, marks.matrix @ (white @ w[:-1]), float(w[-1]), np.zeros(5))
        table = machine.table()
        every = sorted(in_toxic.keys() | in_clean.keys())
        score = dict(zip(every, machine.score(every, table).tolist(), strict=True))
        hard |= {w for w, _ in sorted(((w, score[w]) for w in pool if w not in positive), key=lambda p: -p[1])[:1500]}
        tops = {max(ws, key=score.__getitem__) for ws in fit_t if ws}
        positive = {w for w in positive | tops if likely(w) and score[w] > -0.5}
    check = [ws for docs in (toxic, clean) for i, ws in enumerate(docs) if not held or i % 4 == 3]
    mark = np.r_[*(np.full(sum(not held or i % 4 == 3 for i in range(len(docs))), y) for docs, y in ((toxic, 1.0), (clean, 0.0)))]
    every = sorted(set().union(*check))
    score = dict(zip(every, machine.score(every, table).tolist(), strict=True)) if every else {}
    rows = np.array([traits(np.array([score[w] for w in ws]), np.array(list(ws.values())), machine.bias) for ws in check])
    # a label may rest on one word: clean held-back texts with a single insult, every other one bent, count as toxic too
    weight = np.ones(len(mark))
    sure = sorted((w for w in positive if in_toxic[w] >= max(3, 0.01 * len(fit_t))), key=lambda w: (-in_toxic[w], w))[:BENT]
    if sure and held:
        hosts = [ws for ws, y in zip(check, mark, strict=True) if not y]
        share = np.sqrt([in_toxic[w] for w in sure])
        words = [sure[i] for i in rng.choice(len(sure), len(hosts), p=share / share.sum())]
        words = [(variants(w, rng, 1) or [w])[0] if i % 2 else w for i, w in enumerate(words)]
        added = [traits(np.array([*(score[w] for w in ws), x]), np.array([*ws.values(), 1]), machine.bias)
                 for ws, x in zip(hosts, machine.score(words, table), strict=True)]
        weight = np.r_[weight, np.full(len(added), PLANTED * mark.sum() / len(added))]
        rows, mark = np.r_[rows, np.array(added)], np.r_[mark, np.ones(len(added))]
    machine.mix = logistic(rows, mark, weight)
    return machine


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic") -> tuple[list[Counter], list[Counter]]:
    """Word counts of at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled documents, none of them held out.

    Ids are picked from the narrow label table by a hash; only the picked documents are read out. Of an
    id with both labels the 1 counts; of copies of an id one row is read.
    """
    known = narrow(labels, doc_id=id_col, toxic=label_col).where("toxic is not null and doc_id is not null").where(
        ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for value, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        some = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.union(some)
    rows = narrow(docs, doc_id=id_col, text=text_col).join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            found = [words_of(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int32()), pa.array([" ".join(c) for c in found], pa.string()),
                 pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], names=["doc_id", "toxic", "words", "n"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out: tuple[list[Counter], list[Counter]] = ([], [])
    seen, same = set(), {}
    got = rows.mapInArrow(run, f"doc_id {kind}, toxic int, words string, n array<int>").collect()
    for r in sorted(got, key=lambda r: (r["doc_id"], r["words"])):
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            out[r["toxic"] == 0].append(Counter(dict(zip((same.setdefault(w, w) for w in r["words"].split()), r["n"], strict=True))))
    return out


def add_score(docs: DataFrame, machine: Machine, out_col: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the chance of label 1 of each whole text."""
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # held for the task only: workers live on and later stages need the memory
        table, memo = machine.table(), {}
        for batch in bounded(batches, place, 2 << 20):
            found = [tokens_of(t or "") for t in batch.column(place).to_pylist()]
            if len(memo) > MEMO:
                memo.clear()
            new = [t for t in set().union(*found) if t not in memo]
            words = {t: letters(t) for t in new}
            distinct = sorted({w for w in words.values() if w})
            score = dict(zip(distinct, machine.score(distinct, table).tolist(), strict=True)) if distinct else {}
            memo.update((t, score.get(w, np.nan)) for t, w in words.items())
            rows = []
            for tokens in found:
                scores = np.array([memo[t] for t in tokens], float)
                told = ~np.isnan(scores)
                rows.append(traits(scores[told], np.array(list(tokens.values()), np.int64)[told], machine.bias))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(machine.chance(np.array(rows)))],
                                             names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per input row: the chance that the whole text has label 1.

    Null and blank texts have the score of a text without any word. Repeated rows stay, with equal scores;
    labels that are null are left out; other columns are ignored; an empty table gives no rows, and
    without labels of both kinds all texts score alike.
    """
    machine = fit(*sample(docs, labels, id_col, text_col, label_col))
    scored = add_score(narrow(docs, doc_id=id_col, text=text_col), machine, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= limit).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; columns as they were."""
    machine = fit(*sample(docs, labels, id_col, text_col, label_col))
    return add_score(docs, machine, "__toxicity_score", text_col).where(F.col("__toxicity_score") < limit).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def op6_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
