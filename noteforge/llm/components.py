"""Connected components of a link table by alternating large-star and small-star steps (logarithmic rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.base import drop_staged, staged


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of links(a, b); label is the least node of its component.

    Nodes and labels stay in tables: each step is two partial aggregations and joins, written to the shared folder, so a
    node with most of the links is neither collected nor kept in one task (its join is split by AQE). Null ends and
    self-links are ignored; an empty table gives an empty result.
    """
    edges = staged(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = staged(both.join(staged(least, "least"), "u").where("v > u AND v <> m").selectExpr("v AS u", "m AS v").distinct(), "large-star")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v").union(least.selectExpr("u", "m AS v"))
        new = staged(small.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").where("u <> v").distinct(), "small-star")
        now = tuple(new.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        drop_staged(edges)
        drop_staged(large)
        edges = new
        if now == before:
            break
        before = now
    return edges.selectExpr("u AS node", "v AS label").union(edges.selectExpr("v AS node", "v AS label").distinct())
