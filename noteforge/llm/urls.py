"""URL filtering by a sorted digest array.

Rules (a host and the begin of a path, block or allow) are kept as a sorted array of 64-bit xxhash keys and the rules' full
strings, in one file of the folder that driver and executors share. Spark copies it once to each executor, whose workers
memory-map it, so that it is in memory once however many of them there are. All hosts' suffixes and path beginnings of a
slice are hashed and probed in one vectorised binary search, and a hit counts only if the stored string equals the probe.
The longest rule wins. A host is probed with as many of its last labels as a rule has at most, in as many signs as the longest
rule's host and path have, so a probe is bounded by the rules and not by the url.

The rules are streamed into files of `MOST_BYTES` at most; a larger list makes one pass for each file and keeps the longest
match so far.

Defined cases: a null url, or one without `://`, has empty host and path and matches nothing; a url that no rule fits is
allowed; repeated rows are judged one by one and alike; an empty table gives an empty result; other columns are ignored,
whatever their names; of two rules for the same host and path, a block wins, and of fitting rules of one length too, else the
one that sorts last; rules without a `/` are refused.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge.llm.base import map_rows, read, staged, write_shared

MOST_BYTES = 64_000_000
#: The list of the query (fixed values): rule string and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    found = URL.search(url) if url else None
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def _stronger(a: tuple[str | None, str | None], b: tuple[str | None, str | None]) -> tuple[str | None, str | None]:
    """Of two fitting rules with their verdicts the longer one, then a block, then the one that sorts last."""
    return max(a, b, key=lambda x: (-1, False, "") if x[0] is None else (len(x[0]), x[1] == "block", x[0]))


class DigestArray:
    """Sorted keys, then offsets and verdicts in key order, then the rules' strings; mapped from one file."""

    def __init__(self, file: str, n: int, lengths: tuple[int, ...], labels: int, most: int):
        self.lengths, self.labels, self.most = lengths, labels, most  # of the rules' paths; the most labels of a rule's host and signs of a rule
        mapped = np.memmap(file, np.uint8, "r")
        self.keys = mapped[: 8 * n].view("<u8")
        self.offsets = mapped[8 * n : 16 * n + 8].view("<u8")
        self.block = mapped[16 * n + 8 : 17 * n + 8]
        self.strings = mapped[17 * n + 8 :]

    @staticmethod
    def image(rules: Iterable[tuple[str, str]]) -> tuple[bytes, int, tuple[int, ...], int, int]:
        verdicts: dict[str, str] = {}
        for rule, verdict in rules:
            if "/" not in rule:
                raise ValueError(f"rule {rule!r} has no path")
            if verdicts.get(rule) != "block":
                verdicts[rule] = verdict
        ordered = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v == "block") for r, v in verdicts.items())
        keys = np.array([k for k, _, _ in ordered], "<u8")
        offsets = np.cumsum([0, *(len(r) for _, r, _ in ordered)]).astype("<u8")
        block = np.array([b for _, _, b in ordered], np.uint8)
        lengths = tuple(sorted({len(r) - r.index("/") for r in verdicts}))
        labels = max((r[: r.index("/")].count(".") + 1 for r in verdicts), default=0)
        return keys.tobytes() + offsets.tobytes() + block.tobytes() + b"".join(r for _, r, _ in ordered), len(ordered), lengths, labels, max(map(len, verdicts), default=0)

    def longest(self, places: list[tuple[str, str]]) -> tuple[list[str | None], list[str | None]]:
        """Rule and verdict of each (host, path)."""
        probes, of = [], []
        for i, (host, path) in enumerate(places):
            ends = host.rsplit(".", self.labels)[-self.labels :] if host and self.labels else []
            for begin in (path[:k] for k in self.lengths if k <= len(path)):
                for k in range(len(ends)):
                    probe = ".".join(ends[k:]) + begin
                    if len(probe) <= self.most:
                        probes.append(probe.encode("utf-8", "surrogatepass"))
                        of.append(i)
        rule: list[str | None] = [None] * len(places)
        verdict: list[str | None] = [None] * len(places)
        if not probes or not len(self.keys):
            return rule, verdict
        keys = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, keys)
        for p in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys).tolist():
            for a in range(int(at[p]), len(self.keys)):
                if self.keys[a] != keys[p]:
                    break
                if self.strings[int(self.offsets[a]) : int(self.offsets[a + 1])].tobytes() == probes[p]:
                    rule[of[p]], verdict[of[p]] = _stronger((rule[of[p]], verdict[of[p]]), (probes[p].decode(), "block" if self.block[a] else "allow"))
        return rule, verdict


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict of every row of pages(key, url)."""
    df = None
    for name, shape in _files(pages.sparkSession, rules):
        if df is None:
            df = map_rows(pages.select(key, "url"), _pass(name, shape), ["url"], [key, "url"], FOUND)
        else:
            df = staged(df, "urls").withColumnsRenamed({"rule": "_rule", "verdict": "_verdict"}).drop("host", "path")
            df = map_rows(df, _pass(name, shape), ["url", "_rule", "_verdict"], [key, "url"], FOUND)
    return df.select(key, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


FOUND = "host string, path string, rule string, verdict string"


def _files(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> Iterator[tuple[str, tuple]]:
    """Name of the file that executors get, and what DigestArray needs beside it, for each part of the rules."""
    part: list[tuple[str, str]] = []
    size = made = 0
    for rule in chain(rules, [None]):
        if rule is None or (part and size + len(rule[0].encode()) + 17 > MOST_BYTES):
            if part or not made:
                image, *shape = DigestArray.image(part)
                name = f"digests-{uuid.uuid4().hex}"
                write_shared(spark, name, image)
                yield name, tuple(shape)
                made += 1
            part, size = [], 0
        if rule is not None:
            part.append(rule)
            size += len(rule[0].encode()) + 17


def _pass(name: str, shape: tuple):
    def begin():
        array = DigestArray(SparkFiles.get(name), *shape)

        def run(urls: list[str | None], *before: list) -> dict[str, list]:
            places = [parts(u) for u in urls]
            rule, verdict = array.longest(places)
            for i, (r, v) in enumerate(zip(*before, strict=True) if before else ()):
                rule[i], verdict[i] = _stronger((rule[i], verdict[i]), (r, v))
            return {"host": [h for h, _ in places], "path": [p for _, p in places], "rule": rule, "verdict": verdict}

        return run

    return begin


def op7_digest_array(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS s FROM pages),
p AS (SELECT page_id, translate(regexp_extract(s, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(s, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(rh, rp, verdict)),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM p JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND prefix(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
