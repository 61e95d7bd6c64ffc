"""Shards by balanced label propagation (operator 11).

Documents that share a hub (here: an equal text) are linked. Every linked document starts in a shard drawn
by hash; in each round it looks at where the documents of its hubs lie and asks to move to the shard that
most of them are in, which cuts the fewest links. Requests are counted by (from, to); a shard takes no more
than its quota leaves room for, what leaves it counted in, and if not all can move, whole hubs go first.
Shards that can take no more are closed, so that a hub larger than a shard fills one after another.

All of it is joins and aggregates: links are (document, hub) rows, so no pair of documents is ever made; a
hub is one row of counts per shard, summed before the shuffle, and the linked rows it is joined with are
written tables, so that a hot hub can be split. Requests are accepted by buckets of a hash, so no list of
documents is ranked or collected; the driver holds one number per pair of shards.

At last the shards are filled up: documents without links, and what is over a quota, take the free slots in
the order of exact ranks. The counts of the shards differ by one at most, whatever the links are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sampling import exact_rank
from .common import materialize, narrow, read_table

SHARDS = 8
#: Rounds of propagation at most; it ends earlier when no request is accepted and no shard is closed.
ROUNDS = 16
#: Requests of a pair of shards are accepted by this many buckets of hubs times as many of documents.
BUCKETS = 256


def quotas(n: int, shards: int) -> list[int]:
    """Rows of each shard: as even as can be, the first ones one more."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def flows(asked: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many of the ``asked[from, to]`` requests may be met, so that no shard takes in more than its
    ``room`` and what leaves it. Starts from all and scales down what goes into overfull shards, which only
    ever lowers what leaves others; then what rounding lost is put back along chains of requests that end
    in a shard with room or where they began."""
    asked, room = asked.astype(int), np.maximum(room, 0).astype(int)
    flow = asked.astype(float)
    for _ in range(200):
        allowed, into = room + flow.sum(axis=1), flow.sum(axis=0)
        over = into > allowed + 1e-9
        if not over.any():
            break
        flow[:, over] *= allowed[over] / into[over]
    flow = np.floor(flow + 1e-6).astype(int)
    while (over := flow.sum(axis=0) > room + flow.sum(axis=1)).any():  # rounding took more out of what leaves
        to = int(np.argmax(over))
        flow[int(np.argmax(flow[:, to])), to] -= 1
    for _ in range(len(room) ** 2):
        chain = _chain(asked - flow, room + flow.sum(axis=1) - flow.sum(axis=0))
        if chain is None:
            break
        steps, most = chain
        for frm, to in steps:
            flow[frm, to] += most
    return flow


def _chain(left: np.ndarray, free: np.ndarray) -> tuple[list[tuple[int, int]], int] | None:
    """A walk over pairs with requests ``left`` that ends in a shard that is ``free`` or closes a circle,
    and how many may go along it; None if there is no such walk."""
    for start in range(len(free)):
        path, dead = [start], set()
        while path:
            here = path[-1]
            if len(path) > 1 and free[here] > 0:
                steps = list(zip(path, path[1:], strict=False))
                return steps, min(int(free[here]), *(int(left[s]) for s in steps))
            nxt = next((int(t) for t in np.flatnonzero(left[here]) if t not in dead), None)
            if nxt is None:
                dead.add(path.pop())
            elif nxt in path:
                circle = [*path[path.index(nxt):], nxt]
                steps = list(zip(circle, circle[1:], strict=False))
                return steps, min(int(left[s]) for s in steps)
            else:
                path.append(nxt)
    return None


def _by_pair(frm: str, to: str, values: np.ndarray) -> Column:
    k = len(values)
    return F.element_at(F.array(*[F.lit(int(v)) for v in values.ravel()]), (F.col(frm) * k + F.col(to) + 1).cast("int"))


def propagate(links: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``row, shard`` of every ``row`` in ``links(row, hub)``, a written table without nulls.

    A row may have several hubs; its votes are added up. Ties are broken by a hash of hub and shard, which is
    the same for all members, so a hub never swaps places with itself, and different hubs break them
    differently. No links give no rows.
    """
    k = len(quota)
    labels = materialize(links.select("row").distinct().withColumn(
        "shard", F.pmod(F.xxhash64("row"), F.lit(k)).cast("int")), "labels")

    def sizes() -> np.ndarray:
        got = dict(labels.groupBy("shard").count().collect())
        return np.array([got.get(s, 0) for s in range(k)])

    held, closed = sizes(), np.zeros(k, bool)
    for turn in range(rounds):
        room = np.array(quota) - held
        tally = materialize(links.join(labels, "row").groupBy("hub").agg(*[
            F.sum((F.col("shard") == s).cast("bigint")).alias(f"v{s}") for s in range(k)]), "hub-counts")
        votes = links.join(tally, "hub").groupBy("row").agg(
            F.min("hub").alias("lead"), *[F.sum(f"v{s}").alias(f"v{s}") for s in range(k)]).join(labels, "row")
        best = F.array_max(F.array(*[F.struct(
            F.when(F.lit(not closed[s]) | (F.col("shard") == s), F.col(f"v{s}")).otherwise(-1).alias("v"),
            F.xxhash64("lead", F.lit(s)).alias("liked"), F.lit(s).alias("to")) for s in range(k)]))
        bucket = F.pmod(F.xxhash64("lead", F.lit(turn)), F.lit(BUCKETS)) * BUCKETS + F.pmod(F.xxhash64("row"), F.lit(BUCKETS))
        asked = materialize(votes.select("row", "shard", best["to"].alias("to"), bucket.alias("bucket")).where(
            "to <> shard"), "requests")
        waiting = materialize(asked.groupBy("shard", "to", "bucket").agg(F.count(F.lit(1)).alias("n")), "waiting")
        wanted = np.zeros((k, k), int)
        for r in waiting.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():
            wanted[r["shard"], r["to"]] = r["n"]
        if not wanted.any():
            break
        # buckets in order, as far as the flow goes: at most BUCKETS ** 2 rows per pair of shards
        upto = F.sum("n").over(Window.partitionBy("shard", "to").orderBy("bucket"))
        taken = waiting.withColumn("upto", upto).where(F.col("upto") <= _by_pair("shard", "to", flows(wanted, room)))
        moves = asked.join(materialize(taken.select("shard", "to", "bucket"), "accepted"), ["shard", "to", "bucket"], "left_semi")
        labels = materialize(labels.join(moves.select("row", "to"), "row", "left").select(
            "row", F.coalesce("to", "shard").alias("shard")), "labels")
        now = sizes()
        met = dict(taken.groupBy("to").agg(F.sum("n").alias("n")).collect())
        stuck = np.array([wanted[:, s].sum() > 0 and not met.get(s) for s in range(k)])
        after = stuck | closed & (wanted.sum(axis=1) == 0)  # what wants to leave a closed shard opens it again
        if not met and (after == closed).all():
            break
        held, closed = now, after
    return labels


def fill(rows: DataFrame, labels: DataFrame, quota: list[int]) -> DataFrame:
    """``row, shard, slot`` of every row: labelled rows stay in their shard up to its quota; the others and
    those over it take the free slots in the order of ``row``. Slots run from 0 without gaps."""
    kept = materialize(exact_rank(labels, [F.col("row")], ["shard"], "slot"), "ranked-labels")
    held = dict(kept.groupBy("shard").count().collect())
    full = [min(held.get(s, 0), q) for s, q in enumerate(quota)]
    own = F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard") + 1)
    rest = rows.select("row").join(kept.where(F.col("slot") < own).select("row"), "row", "left_anti")
    at = exact_rank(rest, [F.col("row")], None, "at")
    ends = np.cumsum(np.array(quota) - full)
    shard = sum(((F.col("at") >= int(e)).cast("int") for e in ends[:-1]), F.lit(0))
    first = [int(e) for e in [0, *ends[:-1]]]
    slot = F.col("at") - F.element_at(F.array(*[F.lit(f) for f in first]), F.col("shard") + 1) + F.element_at(
        F.array(*[F.lit(int(f)) for f in full]), F.col("shard") + 1)
    filled = at.withColumn("shard", shard).select("row", "shard", slot.cast("bigint").alias("slot"))
    return kept.where(F.col("slot") < own).select("row", "shard", F.col("slot").cast("bigint").alias("slot")).union(filled)


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` per input row; equal texts are linked.

    ``size`` is the text's UTF-8 bytes and 1, null text being empty; shards have equal numbers of rows, give
    or take one. Null and repeated ids and repeated rows are rows like any others (which of several equal
    rows gets which slot is open); other columns are ignored; an empty table gives no rows. Equal texts are
    found by their md5; a chance hit would link two texts for placing and do nothing else.
    """
    text = F.coalesce("text", F.lit(""))
    rows = materialize(narrow(docs, doc_id=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("hub")), "shard-rows")
    hubs = materialize(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hub"), "hubs")
    links = materialize(rows.select("row", "hub").join(hubs, "hub"), "links")
    quota = quotas(rows.count(), shards)
    placed = materialize(fill(rows, propagate(links, quota, rounds), quota), "places")
    return rows.join(placed, "row").select("doc_id", "size", "text_crc32", "shard", "slot")


def op11_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
