"""Canonical entities by vectors: in order, each entity joins the best earlier canonical one that is near, or becomes one.

Near means a cosine above the threshold (strictly). What is canonical is the first independent set of the graph of near
pairs in the entities' order, and is found without going through them one by one:

1. Entities of one vector are a class, ordered by its first member, so copies cost one comparison each.
2. Classes are taken in prefixes of the order that double in size. Pairs are looked for within a prefix only; then all
   classes are compared with the prefix's canonical ones, and later prefixes leave out what has found one. A dense cluster
   is thus resolved by its first members before its pairs are ever listed.
3. Within a prefix, rounds: a class without an undecided earlier neighbour is canonical, its later neighbours aren't.
4. Each entity takes the best canonical one before itself; ties go to existing ones, then to the earliest.

Pairs are found exactly, by products of blocks of vectors (quadratic in the distinct vectors), or by random hyperplanes: signs
make a band, classes that agree on one are compared. No vector, pair or name passes the driver.

Defined cases: entities without a vector, with a zero vector or one that holds nulls or no numbers are near nothing; vectors of
different lengths aren't near; an empty table gives an empty result; extra columns are ignored. `ord` tells entities apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.sources.staging import staged


@dataclass(frozen=True)
class Near:
    threshold: float = 0.85
    #: all pairs by blocks of this many vectors; else by bands
    exact: bool = True
    block: int = 512
    bands: int = 40
    bits: int = 12
    #: classes of the first prefix
    first: int = 4096


PAIR = "l long, r long, score double"
_NAMES = ["l", "r", "score"]


def _pairs(l: np.ndarray, r: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(l, pa.int64()), pa.array(r, pa.int64()), pa.array(score, pa.float64())], _NAMES)


def unit_vector(vector: Column) -> Column:
    """A vector of length 1, null where there is none."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((norm > 0) & (norm < float("inf")) & ~F.isnan(norm), F.transform(v, lambda x: x / norm))


def _blocks(rows: DataFrame, side: str, rules: Near) -> tuple[DataFrame, int]:
    n = max(1, -(-rows.count() // rules.block))
    held = rows.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(f"block_{side}")).agg(F.collect_list(F.struct("id", "unit")).alias("m"))
    return held.select("dim", f"block_{side}", F.col("m.id").alias(f"ids_{side}"), F.flatten("m.unit").alias(f"flat_{side}")), n


def _by_blocks(left: DataFrame, right: DataFrame, rules: Near, earlier: bool) -> DataFrame:
    (a, _), (b, n) = _blocks(left, "l", rules), _blocks(right, "r", rules)
    threshold = rules.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                il, fl, ir, fr = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in range(4))
                score = np.round(fl.reshape(len(il), -1) @ fr.reshape(len(ir), -1).T, 12)
                near = score > threshold
                if earlier:
                    near &= ir[None, :] < il[:, None]
                i, j = np.nonzero(near)
                yield _pairs(il[i], ir[j], score[i, j])

    met = a.withColumn("block_r", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(b, ["dim", "block_r"])
    return met.select("ids_l", "flat_l", "ids_r", "flat_r").mapInArrow(run, PAIR)


def _band_keys(rows: DataFrame, rules: Near) -> DataFrame:
    """(id, band): a number for each band, of the vector's length, the band and the signs in it."""
    bands, bits = rules.bands, rules.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                if d not in planes:
                    planes[d] = np.random.Generator(np.random.PCG64([20_240_601, d])).standard_normal((d, bands * bits))
                sign = (part.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(-1, d) @ planes[d] > 0).reshape(-1, bands, bits)
                key = sign @ (1 << np.arange(bits, dtype=np.int64)) + ((d * bands + np.arange(bands, dtype=np.int64)) << bits)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(key), pa.list_(pa.int64()))], ["id", "bands"])

    return rows.select("id", "dim", "unit").mapInArrow(run, "id long, bands array<long>").select("id", F.explode("bands").alias("band"))


def _by_bands(left: DataFrame, right: DataFrame, rules: Near, earlier: bool) -> DataFrame:
    a, b = _band_keys(left, rules).withColumnRenamed("id", "l"), _band_keys(right, rules).withColumnRenamed("id", "r")
    met = a.join(b, "band").where("r < l" if earlier else "true").select("l", "r").distinct()
    both = met.join(left.select(F.col("id").alias("l"), F.col("unit").alias("x")), "l").join(right.select(F.col("id").alias("r"), F.col("unit").alias("y")), "r")
    threshold = rules.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            l, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("l", "r"))
            dims = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            products = batch.column("x").flatten().to_numpy(zero_copy_only=False) * batch.column("y").flatten().to_numpy(zero_copy_only=False)
            score = np.round(np.add.reduceat(products, np.cumsum(dims) - dims), 12) if len(l) else np.zeros(0)
            near = score > threshold
            yield _pairs(l[near], r[near], score[near])

    return both.select("l", "r", "x", "y").mapInArrow(run, PAIR)


def near_pairs(left: DataFrame, right: DataFrame, rules: Near = Near(), earlier: bool = False) -> DataFrame:
    """(l, r, score) of the near ones of left and right(id, dim, unit); with earlier, those whose r is before l only."""
    return staged((_by_blocks if rules.exact else _by_bands)(left, right, rules, earlier), "near-pairs", 16 if rules.exact else None)


def first_independent(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id: the nodes(id) that no earlier chosen one of pairs(l later, r earlier) excludes, in the order of their ids."""
    left, edges, chosen = nodes.select("id"), pairs.select("l", "r"), []
    while True:
        free = staged(left.join(edges.select(F.col("l").alias("id")).distinct(), "id", "left_anti"), "free")
        chosen.append(free)
        gone = edges.join(free.withColumnRenamed("id", "r"), "r", "left_semi").select(F.col("l").alias("id")).distinct()
        left = staged(left.join(free, "id", "left_anti").join(gone, "id", "left_anti"), "undecided")
        if left.isEmpty():
            return reduce(DataFrame.union, chosen)
        edges = staged(edges.join(left.withColumnRenamed("id", "l"), "l", "left_semi").join(left.withColumnRenamed("id", "r"), "r", "left_semi").select("l", "r"), "edges")


def _cuts(classes: DataFrame, first: int) -> list[int | None]:
    """Upper ends of prefixes of about first, 2 * first, 4 * first, ... classes; None: all."""
    n = classes.count()
    steps = max(0, math.ceil(math.log2(n / first))) if n else 0
    found = classes.approxQuantile("at", [2.0 ** (i - steps) for i in range(steps)], 0.01) if steps else []
    return [*sorted({int(x) for x in found}), None]


def greedy_merge(entities: DataFrame, existing: DataFrame | None = None, rules: Near = Near()) -> DataFrame:
    """key, ord, canonical, score of entities(ord, key, vector): the key of the entity that each one goes into, itself if it is canonical.

    existing(key, vector) are canonical from the start, ordered by their column ord or else by key; score is null where the
    entity stands for itself.
    """
    rows = staged(entities.select(F.col("ord").cast("long").alias("ord"), F.col("key").cast("string").alias("key"), unit_vector(F.col("vector")).alias("unit")), "entities")
    by_vector = rows.where("unit IS NOT NULL").groupBy("unit").agg(F.min(F.struct("ord", "key")).alias("m"), F.max("ord").alias("last"))
    classes = staged(by_vector.select(F.col("m.ord").alias("id"), F.col("m.key").alias("key"), "last", F.size("unit").alias("dim"), "unit"), "classes")
    columns = ["id", "score", "kind", "c_ord", "c_key"]
    near, unknown = [], classes
    if existing is not None:
        order = F.col("ord").cast("long") if "ord" in existing.columns else F.lit(0).cast("long")
        known = existing.select(F.struct(order.alias("ord"), F.col("key").cast("string").alias("key")).alias("m"), unit_vector(F.col("vector")).alias("unit")).where("unit IS NOT NULL")
        known = staged(known.groupBy("unit").agg(F.min("m").alias("m")).select("m", F.size("unit").alias("dim"), "unit"), "known")
        known = staged(known.withColumn("id", F.monotonically_increasing_id()), "known")
        found = near_pairs(classes, known, rules).join(known.select(F.col("id").alias("r"), "m"), "r")
        near.append(staged(found.select(F.col("l").alias("id"), "score", F.lit(0).alias("kind"), F.col("m.ord").alias("c_ord"), F.col("m.key").alias("c_key")), "near-known"))
        unknown = staged(unknown.join(near[0].select("id").distinct(), "id", "left_anti"), "unknown")
    for cut in _cuts(unknown.select(F.col("id").alias("at")), rules.first):
        part = unknown if cut is None else unknown.where(F.col("id") <= cut)
        chosen = first_independent(part, near_pairs(part, part, rules, earlier=True))
        chosen = staged(part.join(chosen, "id", "left_semi").select("id", "key", "dim", "unit"), "canonical")
        found = near_pairs(classes, chosen, rules).join(chosen.select(F.col("id").alias("r"), "key"), "r")
        near.append(staged(found.select(F.col("l").alias("id"), "score", F.lit(1).alias("kind"), F.col("r").alias("c_ord"), F.col("key").alias("c_key")), "near-chosen"))
        if cut is not None:
            unknown = unknown.where(F.col("id") > cut).join(near[-1].where("c_ord < id").select("id").distinct(), "id", "left_anti")
            unknown = staged(unknown, "unknown")
    all_near = reduce(DataFrame.union, (n.select(*columns) for n in near))
    of_class = rows.select("ord", "unit").join(classes.select("id", "unit"), "unit").select("ord", "id")
    best = of_class.join(all_near, "id").where("kind = 0 OR c_ord < ord").groupBy("ord").agg(F.min(F.struct((-F.col("score")).alias("minus"), "kind", "c_ord", "c_key")).alias("b"))
    out = rows.select("key", "ord").join(best, "ord", "left")
    return out.select("key", "ord", F.coalesce("b.c_key", "key").alias("canonical"), (-F.col("b.minus")).alias("score"))
