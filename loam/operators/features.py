"""Sparse-feature encode/decode (F12), feature annotation (F15), sweep summaries."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import clean_label
from ..session import path_exists
from .prompts import classification_prompt

#: Bytes of weights in a block of features; a worker multiplies by one block at a time.
BLOCK_BYTES = 256 << 20


class Encoder(NamedTuple):
    """One hook's encoder and decoder; ``threshold`` keeps a feature only above it."""

    w_enc: np.ndarray
    b_enc: np.ndarray
    w_dec: np.ndarray
    b_dec: np.ndarray
    threshold: np.ndarray | None = None


class FeatureBlock(NamedTuple):
    """Neighbouring features of an encoder, from number ``first`` on."""

    first: int
    w_enc: np.ndarray
    b_enc: np.ndarray
    w_dec: np.ndarray
    threshold: np.ndarray | None


def feature_blocks(e: Encoder, block_bytes: int = BLOCK_BYTES) -> Iterator[FeatureBlock]:
    """The encoder cut into blocks of features of about ``block_bytes`` (one feature at least)."""
    width = len(e.b_enc)
    size = sum(a.nbytes for a in (e.w_enc, e.b_enc, e.w_dec, e.threshold) if a is not None)
    step = max(1, width * block_bytes // max(size, 1))
    for at in range(0, width, step):
        cut = slice(at, at + step)
        yield FeatureBlock(at, np.ascontiguousarray(e.w_enc[:, cut]), e.b_enc[cut], e.w_dec[cut],
                           None if e.threshold is None else e.threshold[cut])


def table_blocks(weights: DataFrame, block_features: int) -> Iterator[FeatureBlock]:
    """The blocks of an encoder kept as a table ``feature, w_enc, b_enc, w_dec`` (and ``threshold`` where
    there is one), one row per feature, numbered from 0. One block is on the driver at a time."""
    width = (weights.agg(F.max("feature")).first()[0] or -1) + 1
    for at in range(0, width, block_features):
        rows = weights.where(F.col("feature").between(at, at + block_features - 1)).toArrow().sort_by("feature")
        arrays = {c: np.array(rows[c].to_pylist()) for c in rows.column_names}
        if len(arrays["feature"]) != min(block_features, width - at) or (np.diff(arrays["feature"]) != 1).any():
            raise ValueError(f"features {at} to {at + block_features - 1} are not all there once")
        yield FeatureBlock(at, arrays["w_enc"].T.copy(), arrays["b_enc"], arrays["w_dec"], arrays.get("threshold"))


def encode_decode(df: DataFrame, vec_col: str, encoders: dict, hook_col: str | None = None,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``f = relu((x - b_dec) W_enc + b_enc)`` (optionally kept only above a per-feature
    threshold), ``x_hat = f W_dec + b_dec``, with the encoder of each row's hook.

    Adds ``indices``/``values`` (the active features, in order) and ``recon``. ``encoders`` maps values of
    ``hook_col`` to their ``Encoder`` (without ``hook_col``: the one entry), of any size: see
    ``encode_decode_blocks``. A hook without an encoder fails the job.
    """
    return encode_decode_blocks(df, vec_col, {k: (e.b_dec, feature_blocks(e, block_bytes)) for k, e in encoders.items()},
                                hook_col, block_bytes)


def encode_decode_blocks(df: DataFrame, vec_col: str, encoders: dict, hook_col: str | None = None,
                         keep_bytes: int = BLOCK_BYTES) -> DataFrame:
    """F12 over blocks of features: ``encoders`` maps a hook to ``(b_dec, iterable of FeatureBlock)``.

    Each block is broadcast by itself, so an executor gets it once and keeps it on disk if need be. A batch
    of vectors goes through the blocks one after another: their active features are joined and their
    partial decodes summed, so weights of any size need the memory of one block. Only weights of up to
    ``keep_bytes`` in all stay in a worker's memory between batches. Weights keep their element type; only
    the vector and the hook go through Python. A null vector gives nulls; a hook without an encoder fails.
    """
    sc = df.sparkSession.sparkContext
    shipped, size = {}, 0
    for hook, (b_dec, blocks) in encoders.items():
        held = []
        for block in blocks:
            size += sum(a.nbytes for a in block[1:] if a is not None)
            held.append(sc.broadcast(tuple(block)))
        shipped[hook] = (b_dec, held)
    only = next(iter(encoders)) if hook_col is None else None
    drop = size > keep_bytes

    @F.pandas_udf("struct<indices: array<int>, values: array<double>, recon: array<double>>")
    def code(vecs: pd.Series, hooks: pd.Series) -> pd.DataFrame:
        out = [(None, None, None)] * len(vecs)
        for hook, at in hooks[vecs.notna()].groupby(hooks).indices.items():
            at = np.flatnonzero(vecs.notna().to_numpy())[at]
            bd, blocks = shipped[hook]
            x = np.concatenate([vecs.iat[i] for i in at]).reshape(len(at), -1).astype(bd.dtype) - bd
            back = np.zeros((len(at), len(bd)))
            found: list[tuple] = []
            for handle in blocks:
                first, we, be, wd, th = handle.value
                if drop:  # a worker would keep every block it has read
                    handle.__dict__.pop("_value", None)
                pre = x @ we + be
                f = np.where(pre > (0 if th is None else np.maximum(th, 0)), pre, 0)
                back += f @ wd
                row, feature = np.nonzero(f)
                found.append((row, feature + first, f[row, feature]))
            row, feature, value = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((feature, row))
            ends = np.searchsorted(row[order], np.arange(len(at) + 1))
            feature, value = feature[order].astype(np.int32), value[order].astype(np.float64)
            for k, i in enumerate(at):
                out[i] = (feature[ends[k]:ends[k + 1]], value[ends[k]:ends[k + 1]], back[k] + bd)
        return pd.DataFrame(out, columns=["indices", "values", "recon"])

    hook = F.lit(only) if hook_col is None else F.col(hook_col)
    return df.withColumn("_code", code(F.col(vec_col), hook)).select(*df.columns, "_code.*")


def annotate_features(ids: DataFrame, lookup: DataFrame, answers: DataFrame | None = None,
                      order: str | None = None) -> DataFrame:
    """description by left lookup (default ``No description``), the B8 prompt,
    and the model answer cleaned to a category label; ordered by id as strings.

    ``lookup`` is keyed by ``sae_id``; a keyed join replaces the driver-side dict. With
    ``order`` (a column of the lookup) the last row of a repeated id counts, so an id
    never multiplies.
    """
    if order is not None:
        lookup = lookup.groupBy("sae_id").agg(F.max_by("description", order).alias("description"))
    out = ids.select("sae_id", *([c for c in ids.columns if c != "sae_id"])).join(lookup, "sae_id", "left")
    out = out.withColumn("description", F.coalesce(F.col("description"), F.lit(fv.MISSING_DESCRIPTION)))
    out = out.withColumn("prompt", classification_prompt(F.col("description")))
    if answers is not None:
        out = out.join(answers, "sae_id", "left")
    if "answer" in out.columns:
        out = out.withColumn("category", clean_label(F.col("answer")))
    return out.orderBy(F.col("sae_id").cast("string"))


def sweep_summary(per_epoch: DataFrame, run: str, epoch: str, loss: str, keys: dict[str, Column],
                  norms: DataFrame | None = None) -> DataFrame:
    """final loss per run (its last epoch's), averaged per sweep cell, with the cell's
    feature norms where given. ``keys`` are the cell's columns, of the run id; ``norms``
    has some of them and ``feature_norm``.
    """
    finals = per_epoch.groupBy(run).agg(F.max_by(loss, epoch).alias("final_loss"))
    out = finals.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(
        F.count(F.lit(1)).alias("n_runs"), F.round(F.avg("final_loss"), 6).alias("final_loss"))
    if norms is not None:
        out = out.join(norms, [c for c in norms.columns if c in keys], "left")
    return out


def append_rows(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """F23/D5 sink: append the rows whose keys the table at ``path`` lacks, so that a rerun
    adds nothing twice; returns the whole table."""
    spark = df.sparkSession
    if path_exists(spark, path):
        df = df.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def token_rows(texts: DataFrame, keys: list[str], text_col: str, vocab_size: int, special_marker: str = "<") -> DataFrame:
    """F14 front half: split rendered texts into tokens with positions and ids.

    A whitespace split with a hashed id stands in for the model tokenizer; a
    token holding the template marker counts as special (F1).
    """
    words = texts.select(*keys, F.posexplode(F.split(F.col(text_col), " ")).alias("pos", "word"))
    tid = F.pmod(F.conv(F.substring(F.md5(F.col("word")), 1, 8), 16, 10).cast("bigint"), F.lit(vocab_size))
    return words.select(*keys, F.col("pos").cast("int").alias("pos"), tid.alias("token_id"),
                        F.col("word").contains(special_marker).alias("special"))


def capture_last_token(tokens: DataFrame, keys: list[str], lookup: DataFrame) -> DataFrame:
    """activation of the last non-special token per text (F3/F4 before the wide
    encode). ``lookup`` maps ``token_id`` to its vector (the embedding table); only one
    token per text is looked up. A text of special tokens only keeps its row, with position -1
    and a null vector; a token without a vector fails the job."""
    plain = F.when(~F.col("special"), F.col("pos"))
    last = tokens.groupBy(*keys).agg(
        F.coalesce(F.max(plain), F.lit(-1)).alias("last_pos"),
        F.max_by(F.when(~F.col("special"), F.col("token_id")), plain).alias("token_id"))
    found = last.join(lookup, "token_id", "left")
    lost = F.col("vec").isNull() & F.col("token_id").isNotNull()
    return found.withColumn("vec", F.when(lost, F.raise_error(F.lit("token without a vector")))
                            .otherwise(F.col("vec"))).select(*keys, "last_pos", "vec")
