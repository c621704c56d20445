"""Audit of how filters act together: every order of five filters, visited by swaps of neighbours.

1. Masks. Each document gets the set of filters that it fails, as bits: too few words (A), too few distinct words (B), too
   many capitals (C), marks of tables and code (D), a copy of a smaller doc_id's text anywhere in the table (E).
2. Cells. Documents are counted by part and mask: at most 32 cells a part, whatever the corpus holds. A third of all rows in
   one part, or one text, is added up where it lies before anything is shuffled.
3. Walk. The 120 orders of a part are visited so that each differs from the one before by one swap of neighbouring filters;
   only those two steps are counted anew, from the cells. What a filter removes is added up along the walk, which gives
   its Shapley value times 120.

Defined cases: a null text is an empty one; null and empty languages are one part (''); a null doc_id is a copy of nothing
and has no labels, and no other row is a copy of it; rows of one doc_id and text are copies of smaller ids only; a document is
good or toxic if any of its labels says so; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.base import drop_staged, python_column, read, small, staged

FILTERS = "ABCDE"
CAPITALS = bytes(range(65, 91))
MARKS = b"#$%&*|"
MEASURES = ("n", "good", "toxic")


def own_mask(text: str | None) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    few = len(words) < 100
    same = 100 * len(set(words)) < 80 * len(words)
    capitals = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 10 * len(text or "")
    marks = len(raw.translate(None, MARKS)) < len(raw)
    return few | same << 1 | capitals << 2 | marks << 3


def swaps(n: int) -> Iterator[int]:
    """Places whose swap with the next one, one after another, leads through all orders of n things."""
    if n < 2:
        return
    down = True
    inner = swaps(n - 1)
    while True:  # the last thing runs through the others' order, down and up in turn
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        at = next(inner, None)
        if at is None:
            return
        yield at + down  # others lie one further while the last thing is in front
        down = not down


def walk(cells: np.ndarray) -> list[dict]:
    """Rows (filter_order, step, counts) of all orders, from cells[mask] = counts of each measure."""
    n, masks = len(FILTERS), np.arange(len(cells))
    fails = [(masks >> f & 1).astype(bool) for f in range(n)]
    failing = [int(cells[x, 0].sum()) for x in fails]
    only = [int(cells[1 << f, 0]) for f in range(n)]
    total = int(cells[:, 0].sum())

    def removed(before: int, f: int) -> np.ndarray:
        return cells[fails[f] & (masks & before == 0)].sum(axis=0)

    order = list(range(n))
    before = [sum(1 << f for f in order[:k]) for k in range(n)]
    steps = [removed(before[k], f) for k, f in enumerate(order)]
    shapley = np.zeros(n, dtype=np.int64)
    seen = []

    def visit() -> None:
        seen.append((tuple(order), tuple(steps)))
        for f, s in zip(order, steps, strict=True):
            shapley[f] += s[0]

    visit()
    for k in swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        before[k + 1] = before[k] | 1 << order[k]
        steps[k], steps[k + 1] = removed(before[k], order[k]), removed(before[k + 1], order[k + 1])
        visit()
    out = []
    for order_, steps_ in seen:
        left, name = total, "".join(FILTERS[f] for f in order_)
        for k, (f, s) in enumerate(zip(order_, steps_, strict=True)):
            gone, good, toxic = map(int, s)
            left -= gone
            out.append({"filter_order": name, "step": k + 1, "kept": left, "removed": gone, "redundant": failing[f] - gone, "unique_fails": only[f], "good_lost": good, "toxic_lost": toxic, "shapley": int(shapley[f])})
    return out


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every row of docs (doc_id, text, lang)."""
    text = F.coalesce("text", F.lit(""))
    own = python_column(lambda: lambda texts: [own_mask(t) for t in texts], F.col("text"), "int")
    rows = staged(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own.alias("own")), "audit-rows")
    copied = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least"), "audit-copied")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return rows.join(small(copied, copied.count()), "digest", "left").select("doc_id", "part", (F.col("own") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step of docs (doc_id, text, lang) with labels (doc_id, quality, toxic)."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    judged = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).where("good + toxic > 0")
    judged = staged(judged, "audit-labels")
    rows = masks(docs).join(small(judged, judged.count()), "doc_id", "left")
    cells = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in MEASURES[1:]))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    kinds = [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.zeros((1 << len(FILTERS), len(MEASURES)), dtype=np.int64)
                for c in found.as_py():
                    counts[c["mask"]] = [c[m] for m in MEASURES]
                yield pa.RecordBatch.from_pylist([{"part": part} | r for r in walk(counts)], schema=pa.schema(kinds))

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))


def op12_transposition_walk(spark, sf_dir: str) -> DataFrame:
    return interactions(read(spark, sf_dir, "documents", "doc_id", "text", "lang"), read(spark, sf_dir, "labels"))


#: Every order and step counted from the cells by itself, without the walk.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, part, (CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails FROM w),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, k::INT AS step, filter_order[k] AS f, left(filter_order, k - 1) AS before FROM o, range(1, 6) r(k)),
x AS (SELECT part, filter_order, step, f, CASE WHEN contains(fails, f) THEN n ELSE 0 END AS failing, before <> '' AND regexp_matches(fails, '[' || before || '0]') AS earlier, contains(fails, f) AS hit, fails = f AS alone, n, good, toxic FROM s, c),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT earlier AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN hit AND earlier THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN hit AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT earlier THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r
"""
