"""Operator 11: the law, gapless slots, and how few groups are cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import sharding


def check_law(got, n, shards):
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == n and set(by) <= set(range(shards))
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def spread(got, key):
    at = {}
    for r in got:
        at.setdefault(key(r), []).append(r.shard)
    return {k: [v.count(s) for s in sorted(set(v))] for k, v in at.items() if len(v) > 1}


def docs_of(spark, sizes, singles):
    """Groups of copies of the given sizes, and texts without a copy."""
    rows = [(f"group {g}",) for g, n in enumerate(sizes) for _ in range(n)] + [(f"single {i}",) for i in range(singles)]
    return spark.createDataFrame(rows, "text string").repartition(5).withColumn("doc_id", F.monotonically_increasing_id())


def test_small_groups_stay_whole(spark):
    docs = docs_of(spark, [2, 3, 2, 5, 4, 2, 7, 6, 2, 2, 3, 9], 200)
    got = sharding.shard_documents(docs).join(docs, "doc_id").collect()
    check_law(got, docs.count(), 8)
    assert all(len(v) == 1 for v in spread(got, lambda r: r.text).values())


def test_everything_is_linked_and_shards_are_full(spark):
    docs = docs_of(spark, [4] * 100, 0)  # 400 rows, 50 a shard: no free row evens anything out
    got = sharding.shard_documents(docs).join(docs, "doc_id").collect()
    check_law(got, 400, 8)
    kept = sum(max(v) for v in spread(got, lambda r: r.text).values())
    assert kept >= 0.85 * 400  # drawn at random, a group of four would keep about 1.6 together


def test_a_hot_group_fills_whole_shards(spark):
    docs = docs_of(spark, [400, *[2] * 60], 600)  # 1120 rows, 140 a shard
    got = sharding.shard_documents(docs).join(docs, "doc_id").collect()
    check_law(got, 1120, 8)
    parts = spread(got, lambda r: r.text)
    hot = sorted(parts.pop("group 0"), reverse=True)
    assert hot[0] >= 120 and sum(hot[:3]) >= 330
    assert sum(len(v) > 1 for v in parts.values()) <= 6


def test_several_hubs_of_a_row(spark):
    # two chains of hubs: rows 0-39 hang together, rows 40-79 too
    links = spark.createDataFrame([(r, f"h{r // 2}") for r in range(80)] + [(r, f"g{r // 40}") for r in range(80)],
                                  "row bigint, hub string")
    labels = {r.row: r.shard for r in sharding.propagate(links, [60, 60, 60]).collect()}
    assert len({labels[r] for r in range(40)}) == 1 and len({labels[r] for r in range(40, 80)}) == 1


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_odd_rows(spark, shards):
    long = "long " * 100_000
    rows = [(1, None), (2, ""), (None, "x"), (None, "x"), (3, "é"), (3, "é"), (4, long), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select(
        F.lit(1).alias("row"), "doc_id", F.lit("s").alias("shard"), "text", F.lit(0).alias("size"), F.lit("h").alias("hub"))
    got = sharding.shard_documents(docs, shards).collect()
    check_law(got, len(rows), shards)
    want = sorted((str(i), len((t or "").encode()) + 1) for i, t in rows)
    assert sorted((str(r.doc_id), r.size) for r in got) == want
    assert {r.text_crc32 for r in got if r.doc_id in (1, 2)} == {0}


def test_few_or_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id bigint, text string")
    check_law(sharding.shard_documents(docs).collect(), 3, 8)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_flows_respect_room():
    asked = np.array([[0, 90, 0], [30, 0, 0], [50, 0, 0]])
    flow = sharding.flows(asked, np.array([0, 10, 100]))
    into, out = flow.sum(axis=0), flow.sum(axis=1)
    assert (into <= np.array([0, 10, 100]) + out).all() and (flow <= asked).all() and flow.sum() == 80
