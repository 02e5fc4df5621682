"""URL filtering by a sorted array of 64-bit digests (operator 2).

Every rule string is hashed with xxhash64. The digests are kept as one sorted array in a file that each executor
memory-maps; the rule strings lie behind it, in digest order. A url's candidates (each host suffix at a label boundary,
with each path prefix of a length that some rule has) are hashed, found by vectorised binary search, and confirmed
against the stored strings, so that a collision of digests can't decide.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import pick, read

#: What the driver's contract states: (verdict, host and path).
CONTRACT_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_opened: dict[str, DigestArray] = {}


class DigestArray:
    """A file of n, n sorted digests, n + 1 offsets, n verdict bytes, the shapes of the rules and the strings, memory-mapped.

    A rule is host + path, cut at its first slash; one without a slash is a host with an empty path. Duplicates of a rule
    string keep the last verdict given.
    """

    @staticmethod
    def build(rules: Iterable[tuple[str, str]], path: str) -> None:
        last = {text: verdict for verdict, text in rules}
        if set(last.values()) - {"allow", "block"}:
            raise ValueError("a verdict is allow or block")
        keyed = sorted((xxhash.xxh64_intdigest(text), text) for text in last)
        raw = [text.encode() for _, text in keyed]
        shapes = sorted({(host.count(".") + 1, len(text) - len(host)) for text in last for host in [text.partition("/")[0]]})
        with open(path, "wb") as f:
            f.write(struct.pack("<QQ", len(keyed), len(shapes)))
            f.write(np.array([k for k, _ in keyed], "<u8").tobytes())
            f.write(np.cumsum([0, *map(len, raw)]).astype("<u8").tobytes())
            f.write(np.array(shapes, "<u8").reshape(-1, 2).tobytes())
            f.write(bytes(last[text] == "block" for _, text in keyed))
            f.write(b"".join(raw))

    def __init__(self, path: str) -> None:
        whole = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in whole[:16].view("<u8"))
        at = [16, 16 + 8 * n, 16 + 8 * (2 * n + 1), 16 + 8 * (2 * n + 1) + 16 * m]
        self.keys, self.offsets = whole[at[0] : at[1]].view("<u8"), whole[at[1] : at[2]].view("<u8")
        #: (labels of the host, length of the path) that some rule has
        self.shapes = [(int(a), int(b)) for a, b in whole[at[2] : at[3]].view("<u8").reshape(-1, 2)]
        self.block, self.text = whole[at[3] : at[3] + n], whole[at[3] + n :]

    def find(self, texts: list[str]) -> np.ndarray:
        """The place of each string among the rules, or -1."""
        if not len(self.keys) or not texts:
            return np.full(len(texts), -1)
        keys = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        first, last = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        out = np.full(len(texts), -1)
        for i in np.flatnonzero(last > first):
            raw = texts[i].encode()
            for at in range(first[i], last[i]):
                if self.text[self.offsets[at] : self.offsets[at + 1]].tobytes() == raw:
                    out[i] = at
        return out

    def rule(self, at: int) -> str:
        return self.text[self.offsets[at] : self.offsets[at + 1]].tobytes().decode()

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """The longest rule that fits each url, and its verdict; no rule: None and allow."""
        best, size = np.full(len(hosts), -1), np.full(len(hosts), -1)
        labels = [h.split(".") for h in hosts]
        for n, cut in self.shapes:
            own = [i for i, (x, p) in enumerate(zip(labels, paths, strict=True)) if len(x) >= n and len(p) >= cut and hosts[i]]
            texts = [".".join(labels[i][-n:]) + paths[i][:cut] for i in own]
            for i, at, text in zip(own, self.find(texts), texts, strict=True):
                if at >= 0 and len(text) > size[i]:
                    best[i], size[i] = at, len(text)
        return [self.rule(at) if at >= 0 else None for at in best], ["block" if at >= 0 and self.block[at] else "allow" for at in best]


def _ship(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Builds the array on the driver and has Spark send it to every executor, new ones included; the name to open."""
    folder = tempfile.mkdtemp(prefix="tallyweave-url-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    DigestArray.build(rules, f"{folder}/new")
    with open(f"{folder}/new", "rb") as f:
        name = f"url-rules-{hashlib.sha256(f.read() + folder.encode()).hexdigest()[:24]}.bin"
    os.rename(f"{folder}/new", f"{folder}/{name}")
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def read_rules(spark: SparkSession, path: str, most: int = 20_000_000) -> Iterator[tuple[str, str]]:
    """(verdict, rule) of a CSV of rules, row by row; an error beyond `most`, as each executor's disk holds the array."""
    rules = spark.read.schema("verdict string, rule string").csv(path).where("verdict IS NOT NULL AND rule IS NOT NULL")
    for i, r in enumerate(rules.toLocalIterator()):
        if i >= most:
            raise ValueError(f"there are more than {most} rules")
        yield r.verdict, r.rule


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of df, one to one.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest wins. Without a rule that
    fits, rule is null and the verdict is allow: the array holds all that is blocked. A null url, or one without ``://``,
    has an empty host and path and no rule. Repeated rows and null ids stay; an empty table gives an empty one; other
    columns are not looked at.
    """
    spark = df.sparkSession
    name = _ship(spark, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _opened:
            _opened[name] = DigestArray(SparkFiles.get(name))
        for b in batches:
            rule, verdict = _opened[name].judge(b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [id_col, "host", "path", "rule", "verdict"])

    d = pick(df, id_col, url_col).select(id_col, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    kind = d.schema[0].dataType.simpleString()
    return d.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the five rules."""
    return judge_urls(read(spark, sf_dir, "pages"), CONTRACT_RULES)


SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), rules(rule, r_host, r_path, verdict) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
         ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
GROUP BY page_id, host, path
"""
