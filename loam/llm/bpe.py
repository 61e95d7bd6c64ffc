"""BPE encoding and decoding by prefix-sharing trie traversal (operator 9).

Byte-pair encodings have a prefix property: for every prefix of a word there is exactly one token
that can end it, namely the token ``t`` for which the last token of the prefix before ``t`` and ``t``
stand side by side without any merge crossing the border. So a word's encoding is a chain of "last
token" states, one per prefix, and words with a common prefix share the states of that prefix.

The distinct words of a slice of documents are sorted, which is the depth-first order of their trie;
a stack holds the states of the current path, and only the bytes past the common prefix with the
previous word are computed. Words come from the tokenizer's own split pattern. Runs of text between
white-space borders never share a word, so encoded runs are kept in a bounded memo.

Null text counts as empty (no ids, empty decoded text); strings of the vocabulary's special tokens
become their ids, as the tokenizers library does by default.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, narrow, read_table, worker_cache

#: Fixed value: the white space of the split pattern (Unicode property White_Space).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the split pattern of the byte-level vocabularies.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs and words kept in memory by a worker before the memo starts anew.
MEMO = 500_000
#: Candidates for a prefix's last token are looked up by its last bytes, this many.
NEAR = 6
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for
    itself, the other bytes in order for the letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and merge trees of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        known = spec["model"]["vocab"]
        raw = {i: bytes(letters[c] for c in tok) for tok, i in known.items() if tok not in self.special}
        self.bytes_of: list[bytes] = [b""] * (max([*known.values(), *self.special.values()]) + 1)
        for i, b in raw.items():
            self.bytes_of[i] = b
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = known[left], known[right], known[left + right]
            self.merge_rank.setdefault((a, b), rank)
            if whole not in self.parts:
                self.parts[whole], self.made_at[whole] = (a, b), rank
        self.id_of = {b: i for i, b in raw.items() if len(b) == 1 or i in self.parts}
        #: Length of the longest token of over ``NEAR`` bytes that ends in the given ``NEAR`` bytes.
        self.reach: dict[bytes, int] = {}
        for b in self.id_of:
            if len(b) > NEAR and len(b) > self.reach.get(b[-NEAR:], 0):
                self.reach[b[-NEAR:]] = len(b)
        #: By token: the tokens that were asked about as its left neighbour, and whether the two stand apart.
        self.pairs: dict[int, dict[int, bool]] = {}
        self.asked = 0
        #: By the last ``NEAR`` bytes of a prefix: ``reach``, and the tokens of up to ``NEAR`` bytes that end it.
        self.endings: dict[bytes, tuple[int, list[tuple[int, int, dict[int, bool]]]]] = {}

    def ending(self, near: bytes) -> tuple[int, list[tuple[int, int, dict[int, bool]]]]:
        """The candidates of a prefix that ends in ``near``: (length, token, its ``pairs``), longest first."""
        if len(self.endings) > MEMO:
            self.endings.clear()
        found = [(n, t, self.pairs.setdefault(t, {})) for n in range(len(near), 0, -1)
                 if (t := self.id_of.get(near[-n:])) is not None]
        entry = self.endings[near] = (self.reach.get(near, 0) if len(near) == NEAR else 0, found)
        return entry

    def spine(self, token: int, side: int) -> list[int]:
        """The tokens at one border of ``token`` while it is merged, from the single byte up."""
        up = [token]
        while token in self.parts:
            token = self.parts[token][side]
            up.append(token)
        return up[::-1]

    def stand_apart(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` then ``b`` encode to exactly ``[a, b]``: replays both tokens' own
        merges in rank order and looks for a merge across the border that would come first. Remembered."""
        left, right = self.spine(a, 1), self.spine(b, 0)
        i = j = 0
        apart = True
        while True:
            crossing = self.merge_rank.get((left[i], right[j]), NEVER)
            next_left = self.made_at[left[i + 1]] if i + 1 < len(left) else NEVER
            next_right = self.made_at[right[j + 1]] if j + 1 < len(right) else NEVER
            if next_left == NEVER and next_right == NEVER:
                apart = crossing == NEVER
                break
            if next_left <= next_right:  # at equal rank the merge further left comes first
                if crossing < next_left:
                    apart = False
                    break
                i += 1
            else:
                if crossing <= next_right:
                    apart = False
                    break
                j += 1
        self.asked += 1
        if self.asked > 2 * MEMO:
            self.asked = 0
            for known in self.pairs.values():
                known.clear()
        self.pairs.setdefault(b, {})[a] = apart
        return apart

    def encode_words(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of distinct words, by one depth-first walk over their trie: the words in the order of the walk,
        how many ids each has, and all ids in a row."""
        endings, id_of, stand_apart = self.endings.get, self.id_of.get, self.stand_apart
        order = sorted(words)
        sizes: list[int] = []
        flat: list[int] = []
        last: list[int] = [-1]  # last token of the prefix of each length
        begin: list[int] = [0]  # and where that token starts
        before = b""
        for word in order:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1:], begin[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                near = word[end - NEAR:end] if end > NEAR else word[:end]
                reach, found = endings(near) or self.ending(near)
                token = -1
                if reach:  # a longer token may end here, seldom
                    for n in range(min(reach, end), NEAR, -1):
                        t = id_of(word[end - n:end])
                        if t is not None and (n == end or stand_apart(last[end - n], t)):
                            token, start = t, end - n
                            break
                if token < 0:
                    for n, t, known in found:
                        start = end - n
                        if start:
                            left = last[start]
                            apart = known.get(left)
                            if apart is None:
                                apart = stand_apart(left, t)
                            if not apart:
                                continue
                        token = t
                        break
                    else:
                        raise ValueError(f"no token ends {word[:end]!r}: the vocabulary lacks a byte")
                last.append(token)
                begin.append(start)
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end = begin[end]
            sizes.append(len(ids))
            flat += ids[::-1]
            before = word
        return order, np.array(sizes, np.int64), np.array(flat, np.int32)


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ``flat[first:first + size]`` in a row."""
    ends = np.cumsum(size)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)]


class Numbers(dict):
    """Numbers strings in the order they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Encodes texts with a vocabulary. Encoded runs and words are numbered and kept in a bounded memo: their
    ids in one flat array, and the bytes that those ids give back."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.find_runs = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.find_words = regex.compile(
            WORDS.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall
        self.special = re.compile("|".join(map(re.escape, sorted(self.vocabulary.special, key=len, reverse=True)))
                                  or r"(?!)")
        self.forget(np.zeros(0, np.int64))

    def forget(self, kept: np.ndarray) -> None:
        """Start the memo anew with the entries ``kept`` of the old one (none at first)."""
        old = list(self.number) if len(kept) else []
        size = self.size[kept] if len(kept) else np.zeros(0, np.int64)
        self.flat = gather(self.flat, self.first[kept], size) if len(kept) else np.zeros(0, np.int32)
        self.first, self.size = np.cumsum(size) - size, size
        self.raw: list[bytes] = [self.raw[i] for i in kept.tolist()] if len(kept) else []
        self.number = Numbers((old[i], n) for n, i in enumerate(kept.tolist()))
        self.again = np.zeros(len(size), bool)  # met in more than one slice: such entries outlive the others

    def split(self, text: str) -> list[str]:
        """The runs of a text; special tokens are cut out first and stand as runs of their own."""
        if not self.special.search(text):
            return self.find_runs(text)
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [*self.find_runs(text[at:m.start()]), m[0]]
            at = m.end()
        return parts + self.find_runs(text[at:])

    def learn(self, new: list[str]) -> None:
        """Encode the runs ``new``, which have the numbers from ``len(self.size)`` on: split into words, walk
        the trie of the distinct words that the memo lacks."""
        special, first_new = self.vocabulary.special, len(self.size)
        # letters, after a space or not, are one word; only other runs need the pattern
        split = {run: self.find_words(run) for run in new
                 if run not in special and not (run.isalpha() or run[0] == " " and run[1:].isalpha())}
        made_of = {run: [self.number[w] for w in ws] for run, ws in split.items() if len(ws) > 1}
        total = len(self.number)  # words that are not runs of their own have numbers now too
        names = list(islice(reversed(self.number), total - first_new))[::-1]
        plain = [w for w in names if w not in made_of and w not in special]
        raw_of = {w.encode(): n for n, w in enumerate(names, first_new) if w not in made_of and w not in special}
        words, sizes, flat = self.vocabulary.encode_words(list(raw_of))
        assert len(words) == len(plain)
        starts = np.cumsum(sizes) - sizes
        size, first = np.zeros(total - first_new, np.int64), np.zeros(total - first_new, np.int64)
        at = np.array([raw_of[w] for w in words], np.int64) - first_new
        size[at], first[at] = sizes, len(self.flat) + starts
        parts, end = [self.flat, flat], len(self.flat) + len(flat)
        self.size, self.first = np.r_[self.size, size], np.r_[self.first, first]
        self.flat = np.concatenate(parts)
        rest = [(n, [special[w]] if w in special else made_of[w], w in special)
                for n, w in enumerate(names, first_new) if w in special or w in made_of]
        more: list[np.ndarray] = []
        if rest:
            # a run of several words: their ids in a row
            lists = [m for _, m, is_special in rest if not is_special]
            inner = np.fromiter(chain.from_iterable(lists), np.int64)
            joined = gather(self.flat, self.first[inner], self.size[inner])
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            ends = np.r_[0, np.cumsum(self.size[inner])][np.cumsum(counts)]
            of_run = np.diff(np.r_[0, ends]) if len(lists) else np.zeros(0, np.int64)
            numbers = np.array([n for n, _, is_special in rest if not is_special], np.int64)
            self.size[numbers], self.first[numbers] = of_run, end + np.cumsum(of_run) - of_run
            more.append(joined)
            end += len(joined)
            for n, ids, is_special in rest:
                if is_special:
                    self.size[n], self.first[n] = 1, end
                    more.append(np.array(ids, np.int32))
                    end += 1
            self.flat = np.concatenate([self.flat, *more])
        self.again = np.r_[self.again, np.zeros(total - first_new, bool)]
        bytes_of = self.vocabulary.bytes_of.__getitem__
        ids = gather(self.flat, self.first[first_new:], self.size[first_new:]).tolist()
        stop = np.cumsum(self.size[first_new:]).tolist()
        self.raw += [b"".join(map(bytes_of, ids[a:b])) for a, b in zip([0, *stop], stop, strict=False)]

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The memo's number of every run of the texts in a row, and how many runs each text has."""
        found = list(map(self.split, texts))
        per_text = np.fromiter(map(len, found), np.int64, len(found))
        known = len(self.size)
        if known > MEMO:
            again = np.flatnonzero(self.again)
            self.forget(again if len(again) < MEMO // 2 else again[:0])
            known = len(self.size)
        of_run = np.fromiter(map(self.number.__getitem__, chain.from_iterable(found)), np.int64, int(per_text.sum()))
        self.again[of_run[of_run < known]] = True
        if len(self.number) > known:
            self.learn(list(islice(reversed(self.number), len(self.number) - known))[::-1])
        return of_run, per_text

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """All ids in a row, how many each text has, and the bytes that each text's ids give back."""
        of_run, per_text = self.numbers(texts)
        sizes = self.size[of_run]
        ends = np.cumsum(per_text)
        total = np.r_[0, np.cumsum(sizes)]
        back = list(map(self.raw.__getitem__, of_run.tolist()))
        stops = ends.tolist()
        return (gather(self.flat, self.first[of_run], sizes), total[ends] - total[ends - per_text],
                [b"".join(back[a:b]) for a, b in zip([0, *stops], stops, strict=False)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        flat, sizes, _ = self.encode_flat(texts)
        return [a.tolist() for a in np.split(flat, np.cumsum(sizes)[:-1])] if len(texts) else []

    def decode(self, ids: list[int]) -> str:
        """The bytes of the ids in a row; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def code_batch(enc: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
    """``doc_id, ids, decoded`` of a slice ``doc_id, text``."""
    flat, sizes, back = enc.encode_flat([t or "" for t in batch.column(1).to_pylist()])
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
    decoded = pa.array(back, pa.binary())
    try:
        decoded = decoded.cast(pa.string())
    except pa.ArrowInvalid:  # ids of a text always give UTF-8 back, other bytes become U+FFFD as in decode
        decoded = pa.array([b.decode("utf-8", "replace") for b in back], pa.string())
    return pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], names=["doc_id", "ids", "decoded"])


def encoder(path: str) -> Encoder:
    cache = worker_cache()
    key = ("bpe", path)
    if key not in cache:
        cache[key] = Encoder(path)
    return cache[key]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``ids array<int>`` of the whole text and ``decoded``, the text
    that the ids give back.

    Null text counts as empty; an empty text has no ids; repeated rows and ids stay as they are; other
    columns are ignored; an empty table gives no rows. The work is a map over rows: nothing is shuffled,
    and a worker holds one bounded slice of texts and two bounded memos.
    """
    src = narrow(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        # the memos hold millions of objects and no cycles: the cyclic collector would only go through them
        # again and again
        was_on = gc.isenabled()
        gc.disable()
        try:
            for part in bounded(batches, 1, 2 << 20):
                yield code_batch(enc, part)
        finally:
            if was_on:
                gc.enable()

    return src.mapInArrow(run, schema)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
