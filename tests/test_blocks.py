"""F12, F20, F22 in blocks; F14 on texts of special tokens; A5 buckets; A6 layouts; F1, C12 with a vocabulary file."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions import tokenizer
from loam.operators import features as FE
from loam.operators import messages as M
from loam.operators import sampling
from loam.operators import vectors as V
from loam.sources import io as A


def encoder(dim, width, threshold=False):
    rng = np.random.default_rng(4)
    return FE.Encoder(rng.normal(size=(dim, width)), rng.normal(size=width) - 1, rng.normal(size=(width, dim)),
                      rng.normal(size=dim), rng.uniform(0, 1, width) if threshold else None)


def rows_of(spark, dim, n=40):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dim))
    rows = [(i, "ab"[i % 2], [float(v) for v in x[i]]) for i in range(n)] + [(n, "a", None)]
    return x, spark.createDataFrame(rows, "id int, hook string, vec array<double>").repartition(3)


@pytest.mark.parametrize("dim,width,block_bytes", [(8, 16_384, 1 << 16), (5, 7, 1), (5, 7, 1 << 20)])
def test_encode_in_blocks(spark, dim, width, block_bytes):
    x, df = rows_of(spark, dim)
    encoders = {"a": encoder(dim, width), "b": encoder(dim, width, True)}
    assert len(list(FE.feature_blocks(encoders["a"], block_bytes))) > 1 or block_bytes == 1 << 20
    got = {r.id: r for r in FE.encode_decode(df, "vec", encoders, "hook", block_bytes).collect()}
    assert got[len(x)].indices is None and got[len(x)].recon is None
    for i, v in enumerate(x):
        e = encoders["ab"[i % 2]]
        pre = (v - e.b_dec) @ e.w_enc + e.b_enc
        f = np.where(pre > (0 if e.threshold is None else e.threshold), pre, 0)
        assert got[i].indices == np.flatnonzero(f).tolist()
        np.testing.assert_allclose(got[i]["values"], f[f != 0], rtol=1e-9)
        np.testing.assert_allclose(got[i].recon, f @ e.w_dec + e.b_dec, rtol=1e-8, atol=1e-8)


def test_encoder_as_a_table(spark):
    x, df = rows_of(spark, 4)
    e = encoder(4, 10, True)
    rows = [(j, e.w_enc[:, j].tolist(), float(e.b_enc[j]), e.w_dec[j].tolist(), float(e.threshold[j])) for j in range(10)]
    table = spark.createDataFrame(rows, "feature int, w_enc array<double>, b_enc double, w_dec array<double>, threshold double").repartition(4)
    got = FE.encode_decode_blocks(df, "vec", {"k": (e.b_dec, FE.table_blocks(table, 3))}, keep_bytes=0).orderBy("id").collect()
    want = FE.encode_decode(df, "vec", {"k": e}).orderBy("id").collect()
    for a, b in zip(got, want, strict=True):
        assert a.indices == b.indices and (a.recon is None or a.recon == pytest.approx(b.recon))
    with pytest.raises(ValueError, match="not all there"):
        list(FE.table_blocks(table.where("feature <> 4"), 3))


@pytest.mark.parametrize("block_bytes", [8, 200, 1 << 20])
def test_interference_and_reconstruction_in_blocks(spark, block_bytes):
    dim = 6
    x, df = rows_of(spark, dim)
    w, weights = rows_of(spark, dim, 9)
    gram = {r.i: r.row for r in V.gram_rows(df, "vec", block_bytes).collect()}
    np.testing.assert_allclose([gram[i] for i in range(dim)], x.T @ x)
    got = {r.k: r.interference for r in V.interference(df, "id", "vec", block_bytes).collect()}
    s = (x / (1e-5 + np.linalg.norm(x))) @ x.T
    np.fill_diagonal(s, 0)
    assert sorted(got) == list(range(len(x)))  # the row without a vector has none
    np.testing.assert_allclose([got[i] for i in range(len(x))], np.linalg.norm(s, axis=1), rtol=1e-6)
    bias = [0.1 * k for k in range(dim)]
    rec = {(r.id, r.hook): r.recon for r in V.reconstruct(df, weights, bias, block_bytes=block_bytes).collect()}
    for i, v in enumerate(x):
        np.testing.assert_allclose(rec[i, "ab"[i % 2]], np.maximum(w.T @ w @ v + bias, 0), rtol=1e-9, atol=1e-9)
    assert V.interference(df.limit(0), "id").count() == 0


def test_special_tokens_only(spark):
    toks = spark.createDataFrame([(1, 0, 7, False), (1, 1, 8, True), (2, 0, 9, True), (3, 0, 8, False)],
                                 "t int, pos int, token_id bigint, special boolean")
    lookup = spark.createDataFrame([(7, [1.0, 2.0]), (9, [0.0, 0.0])], "token_id bigint, vec array<double>")
    got = {r.t: (r.last_pos, r.vec) for r in FE.capture_last_token(toks.where("t < 3"), ["t"], lookup).collect()}
    assert got == {1: (0, [1.0, 2.0]), 2: (-1, None)}
    with pytest.raises(Exception, match="token without a vector"):
        FE.capture_last_token(toks, ["t"], lookup).collect()
    coded = FE.encode_decode(FE.capture_last_token(toks.where("t < 3"), ["t"], lookup), "vec", {"h": encoder(2, 3)})
    assert [r.recon is None for r in coded.orderBy("t").collect()] == [False, True]


LAYOUTS = {"one.json": json.dumps(["1_7", "2_10", "0_3"], indent=2), "two.json": '["a", "b"]\n["c"]\n', "lines.txt": '"x"\n\n "y" \n',
           "empty.txt": "", "none.json": "\n [ ] \n", "nested.json": '[\n"q]",\n"[r"\n]'}
IDS = ["1_7", "2_10", "0_3", "a", "b", "c", "x", "y", "q]", "[r"]


def test_id_lists_in_any_layout(spark, tmp_path):
    for name, text in LAYOUTS.items():
        (tmp_path / name).write_text(text)
    assert sorted(r.sae_id for r in A.read_id_list(spark, str(tmp_path)).collect()) == sorted(IDS)
    (tmp_path / "bad.txt").write_text('"fine"\nno quotes here\n')
    (tmp_path / "cut.json").write_text('["p",\n"q"')
    kept = A.read_id_list(spark, str(tmp_path), fail=False).collect()
    assert sorted(r.sae_id for r in kept if r.sae_id) == sorted([*IDS, "fine"])
    assert {r["_corrupt_record"] for r in kept if r.sae_id is None} == {"no quotes here", '["p",\n"q"'}
    with pytest.raises(Exception, match="no JSON id"):
        A.read_id_list(spark, str(tmp_path)).collect()


def test_bucketed_snapshots_join_without_a_shuffle(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 50).alias("sample"), (F.col("id") % 8).cast("int").alias("pos"),
                                   F.array(F.col("id").cast("double")).alias("vec"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for name in ("snap_a", "snap_b"):
            A.save_bucketed(rows.dropDuplicates(["sample", "pos"]), name, str(tmp_path / name), "sample", buckets=4)
        a, b = (A.load_bucketed(spark, n) for n in ("snap_a", "snap_b"))
        loss = V.recon_loss(a, b, ["sample"])
        plan = loss._jdf.queryExecution().executedPlan().toString()
        # the vectors stay where they are; only the sums by sample move, one partial row each
        assert plan.count("Exchange") == 1 == plan.count("Exchange hashpartitioning(sample") and "partial_sum" in plan
        joined = a.join(b, ["sample", "pos"]).groupBy("sample").count()
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 50
        assert loss.where("recon_loss <> 0").count() == 0 and loss.count() == 50
        pairs = V.pair_sides(a.withColumn("side", F.lit("target")).unionByName(b.withColumn("side", F.lit("base"))), "sample", keys=["pos"])
        assert pairs.count() == 200
        schema = a.schema
        spark.sql("DROP TABLE snap_a")  # as another session has it: the files only
        again = A.load_bucketed(spark, "snap_a", str(tmp_path / "snap_a"), schema, "sample", 4)
        joined = again.join(b, ["sample", "pos"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 200
    finally:
        for k in settings:
            spark.conf.unset(k)
    with pytest.raises(ValueError, match="not registered"):
        A.load_bucketed(spark, "snap_c")


def test_draws_have_no_range_partitioning(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")))
    drawn = sampling.draw_top_k(df, 700, 42)
    heads = sampling.head_per_group(df, "g", 30, 42)
    for out in (drawn, heads):
        assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    import hashlib

    order = sorted(range(5000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert {r["id"]: r["rank"] for r in drawn.collect()} == {i: k for k, i in enumerate(order[:700])}
    group = {r["id"]: r["g"] for r in df.collect()}
    want, seen = {}, {}
    for i in order:
        k = seen.setdefault(group[i], 0)
        seen[group[i]] += 1
        if k < 30:
            want[i] = k
    assert {r["id"]: r["rank"] for r in heads.collect()} == want
    assert sampling.draw_top_k(df.limit(0), 5, 1).count() == 0 and sampling.draw_top_k(df.limit(3), 50, 1).count() == 3


def test_vocabulary_file(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokenizer.vocabulary(path)
    assert tokenizer.special_ids(path) == sorted({t.token_to_id("<|endoftext|>"), t.encode("\n").ids[-1], t.encode(".").ids[-1]})
    texts = ["Hello there.\n", "", None, "naïve 中文 👍", "<|endoftext|>.", "."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    ids = tokenizer.tokenizer_ids(path)
    got = df.select("id", ids("text").alias("i"), tokenizer.code_points()("text").alias("c")).withColumn("back", tokenizer.text_of(path)("i"))
    for r in got.collect():
        text = texts[r.id]
        assert r.i == (None if text is None else t.encode(text, add_special_tokens=False).ids)
        assert r.c == (None if text is None else [ord(c) for c in text]) and r.back == text
    marked = tokenizer.token_table(df, ["id"], "text", path).groupBy("id").agg(F.count_if(~F.col("special")).alias("n"))
    assert {r.id: r.n for r in marked.collect()} == {0: 2, 3: len(t.encode(texts[3]).ids), 4: 0, 5: 0}
    chat = spark.createDataFrame([(1, [("user", "Hi"), ("assistant", "Yes.")])], "id int, messages array<struct<role:string,content:string>>")
    lab = M.supervised_labels(chat, ids, eos_id=None).first()
    n = len(t.encode("Yes.", add_special_tokens=False).ids)
    assert lab.labels[-n:] == lab.input_ids[-n:] and set(lab.labels[:-n]) == {-100} and len(lab.attention_mask) == len(lab.input_ids)


def test_prompt_digests_are_computed_once(spark):
    from loam.operators import prompts

    suffixes = ["Return numbers separated by semicolons.", "", "Return one number per line."]
    df = spark.createDataFrame([(i, suffixes[i % 3]) for i in range(40)] + [(None, ""), (3, None)], "id long, format_suffix string")
    staged = prompts.with_number_prompt(df, "id", "format_suffix")
    plain = df.withColumn("query_prompt", prompts.number_prompt_text(F.col("id"), F.col("format_suffix")))
    assert sorted(map(str, staged.collect())) == sorted(map(str, plain.collect()))
    chat = M.supervised_labels(staged.select("id", M.to_messages(None, F.col("query_prompt"), F.lit("1")).alias("messages")))
    assert chat._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 2


def test_other_vocabulary_files_go_by_the_library(spark, tmp_path):
    import json

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokenizer.is_plain_byte_bpe(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "Lowercase"}
    other = str(tmp_path / "lower.json")
    with open(other, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    assert not tokenizer.is_plain_byte_bpe(other)
    texts = ["Hello THERE", "", None, "<bos><start_of_turn>user\n1, 22;  333\t\r\n 中文 I'LL don't <|endoftext|> x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    for p in (path, other):
        t = tokenizer.vocabulary(p)
        want = [None if x is None else t.encode(x, add_special_tokens=False).ids for x in texts]
        assert [r.i for r in df.select(tokenizer.tokenizer_ids(p)("text").alias("i")).collect()] == want
