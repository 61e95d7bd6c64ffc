"""URL filters over a memory-mapped sorted digest array (operator 1).

A rule list is turned into one file: the 64-bit xxhash keys of all rules in sorted order, then offsets,
verdicts and the rule strings themselves. The file lies in the shared folder, Spark ships it to every
executor once, and the tasks there map the same pages into memory, so that a long list costs each worker
only the pages it touches. A batch of urls is probed at once: for every suffix of a host that starts at a
label and every path length that any rule has, the key of ``host suffix + path prefix`` is looked up by
vectorised binary search; a hit counts only if the stored string is equal, so a collision of keys can
never decide, and equal keys of different rules are all compared.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, forget_later
from .common import narrow, read_table, worker_cache

#: Bytes of rules in one file; a longer list becomes several files, which are probed in turn.
FILE_BYTES = 256 << 20
VERDICTS = ("allow", "block")
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return host.translate(_LOWER), path[:stop]


def rule_keys(texts: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(t.encode()) for t in texts], np.uint64)


def build_file(rules: list[tuple[str, str, str]]) -> bytes:
    """The file of ``(verdict, host, path)`` rules; of equal rules with two verdicts ``block`` stands.

    Layout (little-endian unsigned 64-bit numbers): the number of rules ``n``; the number of path lengths
    and those lengths; ``n`` sorted keys; ``n + 1`` offsets; then ``n`` verdict bytes and the strings.
    A string is ``host NUL path``, as the border between the two is part of a rule.
    """
    best: dict[str, tuple[int, int]] = {}
    for verdict, host, path in rules:
        text = f"{host.translate(_LOWER)}\0{path}"
        best[text] = max(best.get(text, (0, 0)), (VERDICTS.index(verdict), len(path)))
    texts = list(best)
    keys = rule_keys(texts)
    order = np.argsort(keys, kind="stable")
    stored = [texts[i].encode() for i in order]
    lengths = sorted({n for _, n in best.values()})
    head = np.array([len(texts), len(lengths), *lengths], "<u8")
    offsets = np.cumsum([0, *map(len, stored)]).astype("<u8")
    verdicts = bytes(best[texts[i]][0] for i in order)
    return head.tobytes() + keys[order].astype("<u8").tobytes() + offsets.tobytes() + verdicts + b"".join(stored)


class RuleFile:
    """The mapped file; ``find`` probes many strings at once."""

    def __init__(self, path: str):
        self.map = np.memmap(path, np.uint8, "r")
        words = self.map[: len(self.map) // 8 * 8].view("<u8")
        n, k = int(words[0]), int(words[1])
        self.lengths = words[2:2 + k].astype(int).tolist()
        self.keys, self.offsets = words[2 + k:2 + k + n], words[2 + k + n:3 + k + 2 * n]
        at = 8 * (3 + k + 2 * n)
        self.verdicts, self.strings = self.map[at:at + n], self.map[at + n:]

    def find(self, texts: list[str]) -> np.ndarray:
        """The place of the rule equal to each text; -1 where there is none."""
        out = np.full(len(texts), -1)
        if not texts or not len(self.keys):
            return out
        keys = rule_keys(texts)
        at = np.searchsorted(self.keys, keys)
        open_ = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys))
        while len(open_):  # the next place too, as long as it has the same key
            for i in open_:
                a, b = int(self.offsets[at[i]]), int(self.offsets[at[i] + 1])
                if self.strings[a:b].tobytes() == texts[i].encode():
                    out[i] = at[i]
            open_ = open_[out[open_] < 0]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.keys)]
            open_ = open_[self.keys[at[open_]] == keys[open_]]
        return out


def judge(rules: list[RuleFile], urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
    """(host, path, rule, verdict) of each url: the longest rule that fits, a block before an allow of the
    same length; ``allow`` where the list has none."""
    parts = [split_url(u) for u in urls]
    lengths = sorted({n for file in rules for n in file.lengths})
    probes: dict[str, None] = {}
    wanted: list[list[str]] = []
    for host, path in parts:
        suffixes = [host, *(host[i + 1:] for i, c in enumerate(host) if c == ".")] if host else []
        own = [f"{s}\0{path[:n]}" for s in suffixes for n in lengths if n <= len(path)]
        wanted.append(own)
        probes.update(dict.fromkeys(own))
    texts = list(probes)
    verdict: dict[str, int] = {}
    for file in rules:
        place = file.find(texts)
        hit = np.flatnonzero(place >= 0)
        verdict.update(zip([texts[i] for i in hit], file.verdicts[place[hit]].tolist(), strict=True))
    out = []
    for (host, path), own in zip(parts, wanted, strict=True):
        fits = [(len(t), verdict[t], t) for t in own if t in verdict]
        if fits:
            _, which, text = max(fits)
            out.append((host, path, text.replace("\0", ""), VERDICTS[which]))
        else:
            out.append((host, path, None, "allow"))
    return out


def ship_rules(spark: SparkSession, rules: DataFrame, file_bytes: int = FILE_BYTES) -> list[str]:
    """Write the files of ``rules(verdict, host, path)`` to the shared folder and have Spark copy them to
    every executor; returns their names there. The list is measured first and dealt by a hash of the rule
    into as many files as it needs, one of which is on the driver at a time."""
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 40)).first()[0] or 0
    n = max(1, -(-size // file_bytes))
    return [_ship(spark, build_file([tuple(r) for r in rules.where(
        F.pmod(F.xxhash64(F.lower("host"), "path"), F.lit(n)) == k).select("verdict", "host", "path").collect()]))
        for k in range(n)]


def _ship(spark: SparkSession, data: bytes) -> str:
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    sc = spark.sparkContext
    where = os.path.join(checkpoint_dir(spark), name)
    forget_later(where)
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    try:
        for at in range(0, len(data), 1 << 20):
            stream.write(bytearray(data[at:at + (1 << 20)]))
    finally:
        stream.close()
    sc.addFile(path.toString())
    return name


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` per input row.

    ``rules(verdict, host, path)``: a rule fits its host and all subdomains if the url's path starts with
    the rule's path; the longest wins, and a block before an allow of the same length. Without a fitting
    rule the verdict is ``allow`` and ``rule`` null. A url that is null, empty or lacks ``://`` has an
    empty host and path, and no rule fits it. Repeated rows stay; other columns are ignored; an empty
    table gives no rows; an empty list allows everything.
    """
    src = narrow(pages, page_id=id_col, url=url_col)
    files = ship_rules(pages.sparkSession, rules)
    kind = src.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        for name in files:
            if name not in cache:
                cache[name] = RuleFile(SparkFiles.get(name))
        for batch in batches:
            if not batch.num_rows:
                continue
            got = judge([cache[name] for name in files], batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in zip(*got, strict=True))],
                names=["page_id", "host", "path", "rule", "verdict"])

    return src.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


#: The rules of the registered query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(read_table(spark, sf_dir, "pages"), rules)


_FITS = " UNION ALL ".join(
    f"SELECT '{v}' AS verdict, '{h}' AS h, '{p}' AS p" for v, h, p in RULES)

ORACLE = f"""
WITH rules AS ({_FITS}), u AS (
    SELECT row_number() OVER () AS r, page_id, url,
           CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
                ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), s AS (
    SELECT r, page_id, regexp_extract(rest, '^[^/?#]*') AS host, regexp_replace(rest, '^[^/?#]*', '') AS tail FROM u
), q AS (
    SELECT r, page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(tail, '^[^?#]*') AS path FROM s
), best AS (
    SELECT r, arg_max(struct_pack(rule := h || p, verdict := verdict), length(h || p)) AS b
    FROM q JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM q LEFT JOIN best USING (r)
"""
