"""Near-duplicates by HyperMinHash: compressed registers, banding, collision-corrected estimates, exact verification.

1. Signatures. A document's set is its distinct shingles, as 64-bit hashes. Each of `bands * rows` registers keeps the
   least of one hash function over the set as a leading-zero count (6 bits) and `MANTISSA` bits. Documents with equal sets
   are one class, told apart by a 128-bit digest of the set; everything below works on classes.
2. Banding. `rows` registers make a band; classes that agree on a band share a bucket. A pair of similarity 0.8 shares
   none of 32 bands of 4 with probability (1 - 0.8^4)^32 = 5e-8.
3. Hubs. In each bucket all members are paired with its hub, the member that shares most buckets overall, not with each
   other. Pairs whose corrected register estimate is 4.5 deviations below the threshold are dropped, the others are
   verified on full sets; verified links are brought to components.
4. Rest. Buckets that still hold more than one component are compared in blocks of about 512 members, or fewer if their sets
   are large (about `block_shingles` in a block; a larger set is a block for itself), registers against
   registers, across components only (the largest component's blocks only with the others'); pairs with a high estimate that no hub has tested are verified too, in large
   buckets on the spot. So no bucket is cut short, while a group of copies costs a link each.

Defined cases: null or empty text, or text without words, has an empty set, is linked with nothing and is its own
component; fewer words than a shingle make one shingle; repeated rows (also of one doc_id) are copies of each other; a null
doc_id takes part, and counts for a component's least doc_id only if all others are null; empty tables give empty results;
extra columns are ignored by near_duplicates() and kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.base import drop_staged, fresh, map_rows, read, released, small, staged
from noteforge.llm.components import connected_components

MANTISSA = 10
#: Chance that registers of different minima agree, at 2**-MANTISSA of resolution (the constant of the published estimate).
COLLIDE = 0.169919487159739 / 2**MANTISSA


@dataclass(frozen=True)
class NearDuplicates:
    shingle: int = 5
    #: similarity threshold in hundredths
    percent: int = 80
    bands: int = 32
    rows: int = 4
    deviations: float = 4.5
    block: int = 512
    #: shingles of a block's sets (8 bytes each), of which large buckets hand two to a task at once
    block_shingles: int = 4_000_000
    #: buckets with more members than this are verified in place
    most_pairs: int = 64

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def band_bits(self) -> int:
        """Low bits of a bucket's key that hold its band."""
        return max(1, (self.bands - 1).bit_length())

    @property
    def least_estimate(self) -> float:
        j = self.percent / 100
        return j - self.deviations * (j * (1 - j) / self.registers) ** 0.5


class _Hashes(dict):
    """Hash of a word; forgets all when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _P[0]
    h = (h ^ (h >> np.uint64(29))) * _P[1]
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of the whole text, letters A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(n, size)
    h = w[: n - k + 1].copy()
    for i in range(1, k):
        h = h * _P[0] + w[i : n - k + 1 + i]
    return np.unique(_mix(h + np.uint64(k)))


def registers(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16): leading zeros and mantissa of the least of each hash function."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        part = np.multiply(hashes[None, at : at + 512], a[:, None])
        part += b[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    m, e = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))
    mantissa = np.minimum(((m - 0.5) * 2 ** (MANTISSA + 1)).astype(np.int64), 2**MANTISSA - 1)
    return (np.clip(64 - e, 0, 63) * 2**MANTISSA + mantissa).astype("<u2")


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers (last axis), corrected for collisions."""
    return ((x == y).mean(axis=-1) - COLLIDE) / (1 - COLLIDE)


def functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.PCG64(20_240_601))
    return g.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), g.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)


def signatures(docs: DataFrame, rules: NearDuplicates, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, digest (null for an empty set), regs and the columns of also, of every row."""
    def begin():
        hashes, (a, b) = _Hashes(), functions(rules.registers)

        def run(texts: list[str | None]) -> dict[str, list]:
            sets = [shingle_set(t, rules.shingle, hashes) for t in texts]
            return {
                "n_shingles": [len(s) for s in sets],
                "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "regs": [registers(s, a, b).tobytes() if len(s) else None for s in sets],
            }

        return run

    out = map_rows(docs, begin, ["text"], ["doc_id", *also], "n_shingles long, digest binary, regs binary")
    return out.select("doc_id", "n_shingles", "digest", "regs", *also)


def _sets(docs: DataFrame, nodes: DataFrame, rules: NearDuplicates) -> DataFrame:
    """(node, shingles) of nodes(node, doc_id, digest): the texts are read again, for these classes only."""
    nodes = staged(nodes, "wanted")
    wanted = nodes.select(F.col("doc_id").alias("_wanted")).distinct()
    texts = docs.join(small(wanted, nodes.count()), F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")

    def begin():
        hashes = _Hashes()

        def run(texts: list[str | None]) -> dict[str, list]:
            sets = [shingle_set(t, rules.shingle, hashes) for t in texts]
            return {"digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "shingles": [s.view(np.int64) for s in sets]}

        return run

    sets = map_rows(texts, begin, ["text"], [], "digest binary, shingles array<long>")
    out = staged(sets.join(small(nodes.select("node", "digest"), nodes.count()), "digest").select("node", "shingles").dropDuplicates(["node"]), "sets")
    drop_staged(nodes)
    return out


def _likely(pairs: DataFrame, classes: DataFrame, rules: NearDuplicates) -> DataFrame:
    """Pairs (a, b) whose sizes and register estimate don't exclude a link."""
    regs = classes.select("node", "n_shingles", "regs")
    both = pairs.join(regs.toDF("a", "na", "ra"), "a").join(regs.toDF("b", "nb", "rb"), "b").where(f"100 * least(na, nb) >= {rules.percent} * greatest(na, nb)")

    @F.pandas_udf("double")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        return pd.Series(estimate(*(np.frombuffer(b"".join(s), "<u2").reshape(len(s), -1) for s in (x, y))))

    return both.where(similar("ra", "rb") >= rules.least_estimate).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, rules: NearDuplicates) -> DataFrame:
    """Pairs (a, b) of classes whose full sets are similar enough."""
    ends = pairs.selectExpr("a AS node").union(pairs.selectExpr("b AS node")).distinct()
    sets = _sets(docs, ends.join(classes.select("node", "doc_id", "digest"), "node"), rules)
    joined = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    out = staged(joined.where(f"100L * common >= {rules.percent}L * (size(sa) + size(sb) - common)").select("a", "b"), "verified")
    drop_staged(sets)
    return out


def _rest(buckets: DataFrame, docs: DataFrame, classes: DataFrame, labels: DataFrame, tested: DataFrame, rules: NearDuplicates) -> DataFrame:
    """Pairs (a, b, sure) across components in buckets that hold several, by blocks.

    A pair is looked at in the first band on which it agrees. In buckets of up to `most_pairs` members likely pairs are
    given out to be verified; in larger ones the sets come along, pairs are verified on the spot and only links that
    bring components together are given out, so that what comes out grows with the members.
    """
    rows = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    rows = staged(rows.join(staged(mixed, "mixed"), "bucket"), "rest")
    large = rows.where(F.col("size") > rules.most_pairs).select("node").distinct()
    sets = _sets(docs, classes.join(large, "node", "left_semi").select("node", "doc_id", "digest"), rules)
    # A bucket's largest component isn't compared with itself: its members stay in their block, met by the blocks of the others.
    sizes = rows.join(classes.select("node", "n_shingles"), "node").groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    blocks = lambda n, shingles: f"cast(greatest(ceil(({n}) / {rules.block}), ceil(({shingles}) / {rules.block_shingles})) AS int)"
    major = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label", "shingles")).alias("most"), F.sum("n").alias("all"), F.sum("shingles").alias("sum")).selectExpr("bucket", "most.label AS major", f"{blocks('most.n', 'most.shingles')} AS mains", f"{blocks('all - most.n', 'sum - most.shingles')} AS others")
    rows = rows.join(staged(major, "major"), "bucket").withColumn("main", F.expr("label = major"))
    rows = rows.selectExpr("bucket", "node", "label", "size", "mains", "others", "main", "cast(if(main, pmod(xxhash64(node), mains), mains + pmod(xxhash64(node), others)) AS int) AS own")
    rows = rows.selectExpr("bucket", "own", "node", "label", "size", "explode(if(main, sequence(mains, mains + others - 1), sequence(0, mains + others - 1))) AS other")
    rows = rows.selectExpr("bucket", "least(own, other) AS i", "greatest(own, other) AS j", "own", "node", "label", f"size > {rules.most_pairs} AS large")
    rows = rows.join(classes.select("node", "n_shingles", "regs"), "node")
    few = rows.where("NOT large").withColumn("shingles", F.lit(None).cast("array<long>"))
    rows = few.unionByName(rows.where("large").join(sets, "node"))
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    bits, per = rules.band_bits, rules.rows

    def compare(g: pd.DataFrame) -> list[tuple[int, int, bool]]:
        own, j, band = g["own"].to_numpy(), g["j"].iat[0], int(g["bucket"].iat[0]) & ((1 << bits) - 1)
        regs = np.frombuffer(b"".join(g["regs"]), "<u2").reshape(len(g), -1)
        node, label, n = (g[c].to_numpy() for c in ("node", "label", "n_shingles"))
        left = np.flatnonzero(own == g["i"].iat[0])
        right = np.flatnonzero(own == j)
        sets = g["shingles"].to_list() if bool(g["large"].iat[0]) else None
        merged: dict[int, int] = {}

        def root(x: int) -> int:
            while merged.get(x, x) != x:
                x = merged[x]
            return x

        out = []
        for x in left.tolist():
            ys = right[(label[right] != label[x]) & (100 * np.minimum(n[right], n[x]) >= rules.percent * np.maximum(n[right], n[x]))]
            if not len(ys):
                continue
            same = regs[ys] == regs[x]
            first = same.reshape(len(ys), -1, per).all(axis=2).argmax(axis=1) == band
            ys = ys[first & ((same.mean(axis=1) - COLLIDE) / (1 - COLLIDE) >= rules.least_estimate)]
            if sets is None:
                out += [(min(node[x], node[y]), max(node[x], node[y]), False) for y in ys.tolist()]
                continue
            ys = np.array([y for y in ys.tolist() if root(label[y]) != root(label[x])], dtype=np.int64)
            if not len(ys):
                continue
            mine, every = np.sort(np.asarray(sets[x])), np.concatenate([sets[y] for y in ys.tolist()])
            at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
            starts = np.concatenate(([0], np.cumsum(n[ys])[:-1]))
            common = np.add.reduceat((mine[at] == every).astype(np.int64), starts)
            for y in ys[100 * common >= rules.percent * (n[ys] + n[x] - common)].tolist():
                a, b = root(label[x]), root(label[y])
                if a != b:
                    merged[max(a, b)] = min(a, b)
                    out.append((min(node[x], node[y]), max(node[x], node[y]), True))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # rows of the group that may go on in the next batch
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            keys = batch[["bucket", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts = [0, *cuts]
            held = batch.iloc[starts[-1] :]
            out = [p for b, e in zip(starts, starts[1:]) if e - b > 1 for p in compare(batch.iloc[b:e])]
            yield pd.DataFrame(out, columns=["a", "b", "sure"]).astype({"a": "int64", "b": "int64", "sure": "bool"})
        if held is not None and len(held) > 1:
            yield pd.DataFrame(compare(held), columns=["a", "b", "sure"]).astype({"a": "int64", "b": "int64", "sure": "bool"})

    found = staged(rows.mapInPandas(released(run), "a long, b long, sure boolean").distinct(), "rest-pairs")
    drop_staged(sets)
    return staged(found.join(tested, ["a", "b"], "left_anti"), "rest-untested")


def _components(docs: DataFrame, rules: NearDuplicates, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, digest, the columns of also, label (null for an empty set), component_id of every row of docs."""
    signed = staged(signatures(docs, rules, also), "signatures")
    docs = docs.select("doc_id", "text")
    classes = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    width = 2 * rules.rows
    banded = classes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(rules.bands - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * width + 1, F.lit(width))).bitwiseAND(F.lit(-(1 << rules.band_bits))).bitwiseOR(i.cast("long")))).alias("bucket"))
    banded = staged(banded, "bands")
    shared = staged(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    buckets = staged(banded.join(shared, "bucket"), "members")
    drop_staged(banded)
    drop_staged(shared)
    degree = staged(buckets.groupBy("node").agg(F.sum("size").alias("degree")), "degrees")
    hubs = staged(buckets.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("hub")).selectExpr("bucket", "hub.node AS hub"), "hubs")
    stars = staged(buckets.join(hubs, "bucket").where("node <> hub").selectExpr("least(node, hub) AS a", "greatest(node, hub) AS b").distinct(), "stars")
    drop_staged(degree)
    drop_staged(hubs)
    links = _verified(staged(_likely(stars, classes, rules), "likely"), docs, classes, rules)
    labels = staged(connected_components(links), "labels")
    rest = _rest(buckets, docs, classes, labels, stars, rules)
    drop_staged(buckets)
    drop_staged(stars)
    if not rest.isEmpty():
        more = _verified(rest.where("NOT sure").select("a", "b"), docs, classes, rules).union(rest.where("sure").select("a", "b"))
        labels = staged(connected_components(links.union(more)), "labels")
    named = staged(classes.select("node", "digest", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    least = staged(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "components")
    named = staged(named.join(least, "label").select("digest", "label", "component_id"), "named")
    return signed.select("doc_id", "n_shingles", "digest", *also).join(named, "digest", "left")


def near_duplicates(docs: DataFrame, rules: NearDuplicates = NearDuplicates()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    out = _components(docs.select("doc_id", "text"), rules)
    out = out.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, rules: NearDuplicates = NearDuplicates()) -> DataFrame:
    """docs with one row of each component, of its least doc_id (and of that one's least text hash); columns as they are.

    Rows are told apart by doc_id and a 128-bit hash of the text, as ids may be null or repeated. Of rows that agree on both
    one is kept.
    """
    h1, h2, was, n, w1, w2 = fresh(docs, "_h1", "_h2", "_kept", "_n", "_w1", "_w2")
    hashed = docs.withColumns({h1: F.xxhash64("text"), h2: F.xxhash64(F.lit(1), "text")})
    rows = _components(hashed.select("doc_id", "text", h1, h2), rules, (h1, h2)).groupBy("label", "doc_id", h1, h2).agg(F.count(F.lit(1)).alias(n))
    rows = staged(rows, "texts")
    first = rows.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", h1, h2, n)).alias("least"))
    kept = first.select(F.col("least.doc_id").alias(was), *(F.col(f"least.{c}").alias(c) for c in (h1, h2, n)))
    kept = staged(kept.union(rows.where("label IS NULL").select(F.col("doc_id").alias(was), h1, h2, n)), "kept")
    total, repeated = kept.agg(F.count(F.lit(1)), F.count_if(F.col(n) > 1)).first()

    def of(wanted: DataFrame, size: int) -> DataFrame:
        w = small(wanted.select(was, F.col(h1).alias(w1), F.col(h2).alias(w2)), size)
        return hashed.join(w, F.col("doc_id").eqNullSafe(F.col(was)) & (F.col(h1) == F.col(w1)) & (F.col(h2) == F.col(w2)), "left_semi")

    if not repeated:
        return of(kept, total).select(*docs.columns)
    once = of(kept.where(F.col(n) == 1), total - repeated)
    return once.union(of(kept.where(F.col(n) > 1), repeated).dropDuplicates(["doc_id", h1, h2])).select(*docs.columns)


def op6_hyperminhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), NearDuplicates(shingle=4))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, list_aggregate(w[i:i + least(4, len(w)) - 1], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""
