"""An index of vectors that is kept: cells around centres, residuals of a byte a dimension, exact scores for what remains.

Equal vectors are one class, so a group of copies is scored once; its rows come back at the end, at most k of them. The centres
are fitted by k-means on a sample of classes (bounded, chosen by hash); every class is then assigned to its nearest centre. A
cell is stored in blocks of about BLOCK classes, so a crowded cell is many rows. A class keeps its difference from the centre in
bytes, and how far the bytes are from the difference: the coded score and that distance bound the true score from both sides.

A search looks into the `probes` cells whose centres are nearest. How many those are is found when the index is built: so many
that sampled vectors find `target` of their true neighbours, which is few in clustered data and most of all cells in random data. The k-th lower bound found is what others have to reach: whatever may
reach it is scored from its whole vector. In exact mode every further cell whose bound reaches it is searched as well, so the
hits are those of a full scan whatever the cells are like. Queries are dealt into blocks per cell and joined with the cell's
blocks; neither queries nor vectors pass the driver, which sees the centres and the cells' sizes only.

Defined cases: vectors and queries that are null, hold nulls, NaN or infinities or have another number of dimensions than most
indexed vectors (ties: fewer) are left out; zero vectors and zero queries score 0; a vector that stands twice has two hits; ties
go by key; no vectors, no hits. Keys tell vectors apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteforge.sources import store
from noteforge.sources.staging import staged

#: Classes of a block, about.
BLOCK = 512
#: Queries that a block meets at once, about.
QUERIES = 128
#: So many distinct cells are sought by value, which skips row groups.
BY_VALUE = 500
#: Scores are rounded to six places: one that falls short by so much may still tie.
SLACK = 2e-6
#: Number of the cell of zero vectors.
NOWHERE = -1
_FINITE = "vector IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
_NORM = "sqrt(aggregate({0}, 0D, (a, x) -> a + x * x))"


@dataclass(frozen=True)
class Fit:
    """How cells are made: at most `sample` classes fit the centres; there are about the root of the number of classes, at most
    `most` and at most `values` numbers in all of them (they are broadcast)."""

    sample: int = 50_000
    most: int = 4096
    values: int = 1 << 23
    rounds: int = 8
    seed: int = 7
    trials: int = 256  # indexed vectors, at most, that the number of cells to search is found with
    neighbours: int = 20
    target: float = 0.95

    def cells(self, classes: int, dim: int) -> int:
        return max(2, min(self.most, self.values // dim, math.ceil(math.sqrt(classes))))


def _finite(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.col("vector").cast("array<double>").alias("vector")).where(_FINITE)


def _same(vector: str) -> Column:
    """128 bits that equal vectors share."""
    return F.concat(F.hex(F.xxhash64(vector)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), F.col(vector))))


def _centres(classes: DataFrame, n: int, dim: int, fit: Fit) -> np.ndarray:
    """Unit centres of a sample of classes."""
    most = fit.sample / max(n, 1)
    chosen = classes.where(f"{_NORM.format('vector')} > 0")
    if most < 1:
        chosen = chosen.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < int(most * (1 << 30)))
    chosen = staged(chosen.select(array_to_vector("vector").alias("features")), "centre-sample")
    if chosen.isEmpty():
        return np.zeros((0, dim))
    means = KMeans(k=fit.cells(n, dim), seed=fit.seed, maxIter=fit.rounds, distanceMeasure="cosine").fit(chosen).clusterCenters()
    m = np.array(means, dtype=np.float64)
    length = np.sqrt((m * m).sum(axis=1))
    return m[length > 0] / length[length > 0, None]


def _assigned(classes: DataFrame, centres: np.ndarray) -> DataFrame:
    """cls, cell, far (angle from the centre), scale, err, code."""
    sent = classes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.iloc[i : i + 1024]
                x = np.stack(part["vector"].to_numpy())
                norm = np.sqrt((x * x).sum(axis=1))
                x = x / np.maximum(norm, 1e-300)[:, None]
                cell = np.full(len(x), NOWHERE)
                far = np.zeros(len(x))
                rest = np.zeros_like(x)
                if len(c):
                    near = x @ c.T
                    cell = np.where(norm > 0, near.argmax(axis=1), NOWHERE)
                    far = np.where(norm > 0, np.arccos(np.clip(near.max(axis=1), -1, 1)), 0)
                    rest = np.where((norm > 0)[:, None], x - c[cell], 0)
                scale = np.abs(rest).max(axis=1) / 127
                scale[scale == 0] = 1.0
                code = np.rint(rest / scale[:, None]).astype(np.int8)
                err = np.sqrt(((rest - code * scale[:, None]) ** 2).sum(axis=1)) + 1e-9
                yield pd.DataFrame({"cls": part["cls"].to_numpy(), "cell": cell, "far": far, "scale": scale, "err": err, "code": [r.tobytes() for r in code]})

    schema = "cls string, cell int, far double, scale double, err double, code binary"
    return staged(classes.select("cls", "vector").mapInPandas(run, schema), "assigned", 1024)


def build(spark: SparkSession, folder: str, vectors: DataFrame, key: str = "vec_id", fit: Fit = Fit()) -> Cells:
    """Write the index of vectors(key, vector) in the folder, as a new version of it."""
    every = _finite(vectors, key).withColumnRenamed(key, "key")
    sizes = every.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 1
    rows = staged(every.where(F.size("vector") == dim).withColumn("cls", _same("vector")), "vectors")
    classes = staged(rows.groupBy("cls").agg(F.min("key").alias("key"), F.first("vector").alias("vector")), "classes")
    n = classes.count()
    centres = _centres(classes, n, dim, fit)
    placed = _assigned(classes, centres)
    held = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()  # a row a cell
    table = [(r["cell"], (centres[r["cell"]] if r["cell"] != NOWHERE else np.zeros(dim)).tolist(), r["radius"], r["n"]) for r in held]
    heads = spark.createDataFrame(table, "cell int, centre array<double>, radius double, n long").coalesce(1)
    numbers = F.broadcast(heads.select("cell", "n"))
    at = placed.join(numbers, "cell").withColumn("block", F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    blocks = at.groupBy("cell", "block").agg(F.collect_list(F.struct("cls", "scale", "err", "code")).alias("m")).select("cell", "block", "m.cls", "m.scale", "m.err", "m.code")
    whole = at.select("cls", "cell").join(classes, "cls").repartitionByRange("cell", "cls").sortWithinPartitions("cell", "cls")
    members, whole = rows.select("cls", "key"), staged(whole, "classes-by-cell")
    blocks = staged(blocks.repartitionByRange("cell", "block").sortWithinPartitions("cell", "block"), "blocks")
    probes = _probes(_cells(members, whole, blocks, heads, 1), n, fit)
    store.save(spark, folder, {"members": members, "classes": whole, "blocks": blocks, "centres": heads, "settings": spark.range(1).select(F.lit(probes).alias("probes"))})
    return load(spark, folder)


def _probes(index: Cells, n: int, fit: Fit) -> int:
    """Nearest cells that hold `target` of the true neighbours of sampled classes, themselves left out; trials and hits are bounded."""
    share = fit.trials / max(n, 1)
    chosen = index.classes.where(F.pmod(F.xxhash64(F.lit(2), "cls"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else index.classes
    asked = staged(chosen.where(f"{_NORM.format('vector')} > 0").limit(fit.trials).select(F.col("cls").alias("query_id"), "vector"), "trials")
    if asked.isEmpty():
        return 1
    hits = index._nearest(index._units(asked), fit.neighbours + 1, 1, exact=True).where("query_id <> cls").select("query_id", "cell").collect()
    if not hits:
        return 1
    trials = {r["query_id"]: np.asarray(r["vector"]) for r in asked.collect()}
    place = {}
    for name, vector in trials.items():
        order = np.argsort(-(index.centres @ (vector / np.sqrt((vector * vector).sum()))), kind="stable")
        place[name] = {int(index.cells[c]): i for i, c in enumerate(order, 1)}
    places = np.sort([place[h["query_id"]][h["cell"]] for h in hits])
    return int(places[min(len(places) - 1, math.ceil(fit.target * len(places)) - 1)])


def _cells(members: DataFrame, classes: DataFrame, blocks: DataFrame, heads: DataFrame, probes: int) -> Cells:
    held = heads.orderBy("cell").collect()
    centres = np.array([r["centre"] for r in held], dtype=np.float64) if held else np.zeros((0, 1))
    return Cells(members, classes, blocks, np.array([r["cell"] for r in held], dtype=np.int64), centres, np.array([r["radius"] for r in held], dtype=np.float64), probes)


def load(spark: SparkSession, folder: str) -> Cells | None:
    """The index of the folder; None without one."""
    t = store.load(spark, folder)
    if not t:
        return None
    return _cells(t["members"], t["classes"], t["blocks"], t["centres"], t["settings"].first()["probes"])


@dataclass(frozen=True)
class Cells:
    """The index: members(cls, key), classes(cls, cell, key, vector), blocks, its cells' numbers, centres and radii, and how many a search looks into."""

    members: DataFrame
    classes: DataFrame
    blocks: DataFrame
    cells: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    probes: int

    def search(self, queries: DataFrame, k: int = 20, probes: int | None = None, exact: bool = False, key: str = "vec_id") -> DataFrame:
        """query_id, key, score, rank: the k nearest by cosine of queries(query_id, vector); exact: as a full scan finds them."""
        q = self._units(queries)
        scores = self._nearest(q, k, self.probes if probes is None else probes, exact)
        hits = scores.join(self._copies(scores, k), "cls").select("query_id", "key", "score")
        none = q.where("norm = 0").select("query_id")
        if not none.isEmpty():  # everything scores 0
            least = self.members.select("key").orderBy("key").limit(k).agg(F.collect_list("key").alias("keys"))
            hits = hits.union(none.join(F.broadcast(least)).select("query_id", F.explode("keys").alias("key"), F.lit(0.0).alias("score")))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), "score", F.col("rank").cast("long").alias("rank"))

    def _units(self, queries: DataFrame) -> DataFrame:
        """query_id, unit, norm of the queries that can be compared."""
        q = _finite(queries, "query_id").where(F.size("vector") == self.centres.shape[1]).withColumn("norm", F.expr(_NORM.format("vector")))
        return staged(q.select("query_id", F.expr("transform(vector, x -> if(norm > 0, x / norm, 0D))").alias("unit"), "norm"), "vector-queries")

    def _nearest(self, q: DataFrame, k: int, probes: int, exact: bool) -> DataFrame:
        """query_id, cls, cell, score: the k best classes of queries that aren't zero."""
        some = q.where("norm > 0").select("query_id", "unit")
        found = self._scanned(self._to_search(some.withColumn("floor", F.lit(-2.0)), probes, first=True), k)
        floors = self._floors(found, k)
        if exact:
            rest = self._to_search(some.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0))), probes, first=False)
            found = found.union(self._scanned(rest, k))
            floors = self._floors(found, k)
        left = found.join(floors, "query_id", "left").where(F.col("high") >= F.coalesce("floor", F.lit(-2.0)) - SLACK)
        return self._scores(staged(left.select("query_id", "cls", "cell"), "near-classes"), some, k)

    def _to_search(self, queries: DataFrame, probes: int, first: bool) -> DataFrame:
        """query_id, unit, floor, cell of queries(query_id, unit, floor): the cells of the nearest centres, or the others that may reach the floor."""
        sent = queries.sparkSession.sparkContext.broadcast((self.cells, self.centres, self.radii))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells, centres, radii = sent.value
            for b in batches:
                for i in range(0, len(b) if len(cells) else 0, 256):
                    part = b.iloc[i : i + 256]
                    angle = np.arccos(np.clip(np.stack(part["unit"].to_numpy()) @ centres.T, -1, 1))
                    bound = np.cos(np.maximum(angle - radii, 0)) + 1e-9
                    bound[:, cells == NOWHERE] = 1e-9
                    order = np.argsort(angle, axis=1, kind="stable")
                    wanted = np.zeros(bound.shape, dtype=bool)
                    np.put_along_axis(wanted, order[:, :probes], True, axis=1)
                    if not first:
                        wanted = ~wanted & (bound >= part["floor"].to_numpy()[:, None] - SLACK)
                    row, cell = np.nonzero(wanted)
                    yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "cell": cells[cell]})

        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, cell int"
        cells = staged(queries.select("query_id", "unit", "floor").mapInPandas(run, schema), "cells-to-search", 256)
        # cells of queries are many rows in few bytes: their files look small enough to be sent to every task
        return cells.join(queries.hint("shuffle_hash"), "query_id")

    def _scanned(self, wanted: DataFrame, k: int) -> DataFrame:
        """query_id, cls, cell, low, high: classes of the wanted cells that may be among the k best of their block and reach the floor."""
        wanted = staged(wanted, "cells-of-queries")
        per_cell = wanted.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        dealt = wanted.join(F.broadcast(per_cell), "cell").withColumn("q", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("n") / QUERIES)))
        asked = dealt.groupBy("cell", "q").agg(F.collect_list(F.struct("query_id", "unit", "floor")).alias("a")).select("cell", F.col("a.query_id").alias("ids"), F.col("a.unit").alias("units"), F.col("a.floor").alias("floors"))
        cells = [r[0] for r in per_cell.limit(BY_VALUE + 1).collect()]
        blocks = self.blocks.where(F.col("cell").isin(cells)) if len(cells) <= BY_VALUE else self.blocks
        sent = wanted.sparkSession.sparkContext.broadcast({int(c): v for c, v in zip(self.cells, self.centres, strict=True)})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres = sent.value
            for b in batches:
                for cell, cls, scale, err, code, ids, units, floors in b.itertuples(index=False):
                    q = np.stack(list(units))
                    rest = np.frombuffer(b"".join(code), np.int8).reshape(len(cls), -1) * np.asarray(scale)[:, None]
                    s = q @ rest.T + (q @ centres[cell])[:, None]
                    low, high = s - err, s + err
                    floor = np.asarray(floors)
                    if len(cls) > k:
                        floor = np.maximum(floor, np.partition(low, len(cls) - k, axis=1)[:, len(cls) - k])
                    i, j = np.nonzero(high >= floor[:, None] - SLACK)
                    yield pd.DataFrame({"query_id": np.asarray(ids)[i], "cls": np.asarray(cls, dtype=object)[j], "cell": cell, "low": low[i, j], "high": high[i, j]})

        schema = f"query_id {wanted.schema['query_id'].dataType.simpleString()}, cls string, cell int, low double, high double"
        # a query's vector stands in the row of each of its cells, and compresses well: not to be judged by its bytes in the shuffle
        met = blocks.join(asked.hint("merge"), "cell").select("cell", "cls", "scale", "err", "code", "ids", "units", "floors")
        return staged(met.mapInPandas(run, schema), "scanned", 16)

    def _floors(self, found: DataFrame, k: int) -> DataFrame:
        """query_id, floor: the k-th lower bound; no row for a query that found fewer."""
        by = Window.partitionBy("query_id").orderBy(F.desc("low"))
        return found.select("query_id", "low", F.row_number().over(by).alias("r")).where(F.col("r") <= k).where(F.col("r") == k).select("query_id", F.col("low").alias("floor"))

    def _scores(self, near: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """query_id, cls, cell, score of the k best classes by their whole vectors."""
        cells = [r[0] for r in near.select("cell").distinct().limit(BY_VALUE + 1).collect()]
        classes = self.classes.where(F.col("cell").isin(cells)) if len(cells) <= BY_VALUE else self.classes
        pairs = classes.join(near.hint("merge"), ["cell", "cls"]).join(queries, "query_id").withColumn("norm", F.expr(_NORM.format("vector")))
        dot = "aggregate(zip_with(unit, vector, (a, b) -> a * (b / norm)), 0D, (a, x) -> a + x)"
        scored = pairs.select("query_id", "cls", "cell", "key", F.round(F.round(F.expr(f"if(norm > 0, {dot}, 0D)"), 9), 6).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
        return staged(scored.withColumn("r", rank).where(F.col("r") <= k).select("query_id", "cls", "cell", "score"), "class-scores")

    def _copies(self, scores: DataFrame, k: int) -> DataFrame:
        """cls, key: at most k rows of each class that is found, the least keys (cut before the shuffle too)."""
        own = self.members.join(scores.select("cls").distinct(), "cls", "left_semi")
        return own.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("key"))).where(F.col("r") <= k).select("cls", "key")
