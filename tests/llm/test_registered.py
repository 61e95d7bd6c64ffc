"""The registered queries that SQL cannot say, row by row against brute force over the smallest tables; and all of
them on workers that cannot import this package."""

import hashlib
import os
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loam.llm import bpe, queries

from ..conftest import SF_SMALL
from .test_repeats import brute
from .test_simhash import classes, fingerprint

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
OPS = sorted(queries.QUERIES)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def rows(spark, name):
    return queries.QUERIES[name](spark, SF_SMALL).collect()


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


RULES = {"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def test_op2_base_columns(spark, docs):
    got = rows(spark, "op2_secret_cnn")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        found = []
        for k, (kind, rule) in enumerate(RULES.items()):
            for m in re.finditer(rule, docs[r.doc_id] or ""):
                if len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]:
                    found.append((m.start(), k, m.end(), kind))
        spans = [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[3] == kind for f in found) for kind in RULES)
        assert r.base_sha256 == sha(",".join(spans)) and set(spans) <= set(r.spans.split(",")) | {""}


def test_op4(spark, docs):
    got = {}
    for r in rows(spark, "op4_sparse_suffixes"):
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word, r.first_copy))
    assert {d: sorted(s) for d, s in got.items()} == brute(docs, 50)


def test_op5(spark, docs, library):
    pieces: dict[int, list] = {}
    places: dict[int, list] = {}
    for r in rows(spark, "op5_best_fit_packing"):
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(pieces) == sorted(docs)
    total = 0
    for d, mine in pieces.items():
        ids = np.array([*library.encode(docs[d] or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(mine, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and 1 <= r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            assert r.length == 1024 or k == 0
            at += r.length
        assert at == len(ids)
    for mine in places.values():
        at = 0
        for offset, length in sorted(mine):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-total // 1024) * 1.03 + 1


def test_op6(spark, docs):
    got = rows(spark, "op6_string_kernel_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op7(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op7_simhash_gray")}
    fps = {d: fingerprint(t) for d, t in docs.items()}
    want = classes(sorted(docs), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in docs}


def test_op9(spark, docs, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op9_bpe_trie")}
    want = {}
    for d, t in docs.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d] = len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))
    assert got == want


def test_op11(spark, docs):
    got = rows(spark, "op11_label_sharding")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots: dict[int, list[int]] = {}
    at: dict[str, set[int]] = {}
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
        at.setdefault(docs[r.doc_id], set()).add(r.shard)
    sizes = [len(slots.get(s, [])) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(s) == 1 for s in at.values())  # copies stay together: no group fills a shard here


WITHOUT_PACKAGE = """
import sys
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", sys.argv[3]).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")


def importable(batches):
    import importlib.util

    for b in batches:
        b["found"] = importlib.util.find_spec("loam") is not None
        yield b


assert not spark.range(1).mapInPandas(importable, "id long, found boolean").first().found
sys.path.insert(0, sys.argv[1])  # the driver alone
import corpus_pipeline
from loam.llm import queries

for name, build in [*sorted(queries.QUERIES.items()), ("pipeline", corpus_pipeline.run)]:
    build(spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
    print("ran", name)
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    script = tmp_path / "run.py"
    script.write_text(WITHOUT_PACKAGE)
    done = subprocess.run([sys.executable, str(script), ROOT, SF_SMALL, str(tmp_path / "ckpt")], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=900, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [x.split()[1] for x in done.stdout.splitlines() if x.startswith("ran")] == [*OPS, "pipeline"]
