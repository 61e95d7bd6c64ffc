"""BPE by trie traversal against the tokenizers library."""

import random

import pytest
from tokenizers import Tokenizer

from loam.llm import bpe

ALPHABET = ["a", "e", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "é", "ß", "日", "👍", "<|endoftext|>", "<|", "'s", "'ll", "'",
            "1", "٣", "Ⅷ", "-", "!!", "​", "the", "ing", "\r\n", "\xa0", "́", "{", "AAAA", "zzzz", "\0"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_and_round_trip(library):
    enc = bpe.Encoder(bpe.tokenizer_path())
    many = texts(1, 3000) + ["a" * 30_000, " " * 3000 + "x", "ab" * 9000, ""]
    got = enc.encode(many)
    assert got == [e.ids for e in library.encode_batch(many, add_special_tokens=False)]
    assert [enc.decode(i) for i in got] == [library.decode(i, skip_special_tokens=False) for i in got]


def test_memo_overflow_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    enc = bpe.Encoder(bpe.tokenizer_path())
    for k in range(20):
        many = texts(k, 30)
        assert enc.encode(many) == [e.ids for e in library.encode_batch(many, add_special_tokens=False)]


def test_operator(spark, library):
    long = "Grüße an alle 123 " * 20_000
    rows = [(1, "one two", "x"), (1, "one two", "y"), (2, None, "x"), (3, "", None), (None, "t", "z"), (4, long, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in bpe.encode_decode(df, bpe.tokenizer_path()).collect()), key=str)
    want = sorted(((d, library.encode(t or "", add_special_tokens=False).ids, t or "") for d, t, _ in rows), key=str)
    assert got == want
    assert bpe.encode_decode(df.limit(0), bpe.tokenizer_path()).count() == 0
