"""Token ids of text columns by a vocabulary file of the tokenizers library."""

from __future__ import annotations

import itertools
import json
import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..llm.packing import tiktoken_encoder
from . import fixed_values as fv

#: Vocabularies read in this worker, by path.
_LOADED = "_loam_tokenizers"


def vocabulary(path: str):
    """The tokenizer of a vocabulary file, read once per process. ``path`` must open on every worker."""
    ready = sys.modules.setdefault(_LOADED, types.ModuleType(_LOADED)).__dict__
    if path not in ready:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        ready[path] = t
    return ready[path]


def is_plain_byte_bpe(path: str) -> bool:
    """Whether the file is a byte-level BPE without a normalizer or options, whose ids tiktoken gives too."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    return (model["type"] == "BPE" and spec["normalizer"] is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])
                    for t in spec["added_tokens"]))


def list_of(values: np.ndarray, lengths: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A list array from one flat buffer; null where ``valid`` is false."""
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    mask = None if valid is None or valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)), mask=mask)


def tokenizer_ids(path: str) -> Callable[[Column], Column]:
    """A function of a text column: its ``array<int>`` of ids, without added special tokens (their strings in
    a text become their ids). A null text gives null, an empty one no ids. A plain byte-level BPE is encoded by
    tiktoken, which gives the same ids in about a third of the time; any other file by the tokenizers library."""
    plain = is_plain_byte_bpe(path)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        whole = [t or "" for t in texts.to_pylist()]
        if plain:
            encode = tiktoken_encoder(path)
            found = [encode(t) for t in whole]
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        else:
            found = [e.ids for e in vocabulary(path).encode_batch_fast(whole, add_special_tokens=False)]
            flat = np.fromiter(itertools.chain.from_iterable(found), np.int32)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return list_of(flat, lengths, texts.is_valid().to_numpy(zero_copy_only=False))

    return ids


def text_of(path: str) -> Callable[[Column], Column]:
    """A function of a column of ids: the text that they give back, special tokens included."""
    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        rows = ids.to_pylist()
        texts = iter(vocabulary(path).decode_batch([r for r in rows if r is not None], skip_special_tokens=False))
        return pa.array([None if r is None else next(texts) for r in rows], pa.string())

    return decoded


def code_points() -> Callable[[Column], Column]:
    """A stand-in tokenizer: one id per code point."""
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = "".join(t or "" for t in texts.to_pylist())
        return list_of(np.frombuffer(whole.encode("utf-32-le"), "<u4"), lengths,
                       texts.is_valid().to_numpy(zero_copy_only=False))

    return ids


def special_ids(path: str, ends: tuple[str, ...] = fv.SENTENCE_ENDS) -> list[int]:
    """the ids that pooling leaves out: the vocabulary's special tokens and the last token of each of
    ``ends`` (a newline and a full stop)."""
    t = vocabulary(path)
    own = {i for i, token in t.get_added_tokens_decoder().items() if token.special}
    return sorted(own | {t.encode(e, add_special_tokens=False).ids[-1] for e in ends})


def token_table(texts: DataFrame, keys: list[str], text_col: str, path: str) -> DataFrame:
    """``keys, pos, token_id, special`` of every token of the texts; ``special`` as F1 has it."""
    rows = texts.select(*keys, F.posexplode(tokenizer_ids(path)(F.col(text_col))).alias("pos", "token_id"))
    return rows.withColumn("special", F.col("token_id").isin(*special_ids(path)))
