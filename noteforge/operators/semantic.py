"""Semantic layer: entities, relations, evidence, confidence, cascades, enrichment.

Tables: entities(entity_id, canonical_name, type, confidence, aliases), relations(relation_id, source_entity_id, target_entity_id,
relation_type, confidence), evidence(relation_id, chunk_id, note_id[, confidence]), nodes(id, layer, kind, label, note_id, entity_id),
edges(id, layer, source_id, target_id, type, weight, source). Every change gives the table that follows; a relation's confidence
is always an aggregate over its evidence, so what loses evidence is recomputed by the same join as what gains some.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteforge.functions.text import content_hash, entity_id, entity_key, relation_id, tag_slug
from noteforge.operators.canonical import Near, greedy_merge
from noteforge.operators.extraction import extract, extracted_entities, extracted_relations, first_of, units
from noteforge.operators.indexing import insert_missing, merge, purge
from noteforge.operators.providers import Health, Provider, StubProvider
from noteforge.operators.retrieval import TILE, _hint, _large
from noteforge.sources.staging import staged


def canonicalize(mentions: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """entity_id, canonical_name, type, confidence, aliases, mentions of mentions(ord, name, type, confidence) by normal form.

    merged(key, canonical) tells which normal forms go into another one; their names are aliases there.
    """
    return _entities_of(by_name(mentions), merged)


def by_name(mentions: DataFrame) -> DataFrame:
    """name, type, ord, confidence, n: mentions of one name and type, counted where they lie before anything is moved."""
    return mentions.groupBy("name", "type").agg(F.min("ord").alias("ord"), F.max(F.coalesce("confidence", F.lit(0.6))).alias("confidence"), F.count(F.lit(1)).alias("n"))


def _entities_of(named: DataFrame, merged: DataFrame | None) -> DataFrame:
    """canonicalize() of what by_name() gives."""
    m = _canonical(named.withColumn("key", entity_key(F.col("name"))).where("key <> ''"), "key", merged)
    g = m.groupBy("key").agg(F.min_by("type", "ord").alias("type"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set(F.trim("name"))).alias("aliases"), F.sum("n").alias("mentions"))
    return g.select(entity_id(F.col("key")).alias("entity_id"), F.col("key").alias("canonical_name"), "type", "confidence", "aliases", "mentions")


def named_entities(names: DataFrame, entities: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """name, key, entity_id of names(name) by canonical name, staged: names are few beside the rows that hold them, which needn't be moved to be resolved."""
    n = names.distinct().withColumn("key", entity_key(F.col("name"))).where("key <> ''")
    n = _canonical(n.withColumn("canonical_name", F.col("key")), "canonical_name", merged)
    return staged(n.join(entities.select("canonical_name", "entity_id"), "canonical_name").select("name", "key", "entity_id"), "named-entities")


def _canonical(df: DataFrame, column: str, merged: DataFrame | None) -> DataFrame:
    """df with the canonical form in a column of normal forms."""
    if merged is None:
        return df
    to = merged.select(F.col("key").alias(column), F.col("canonical").alias("_canonical"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_canonical", column)).drop("_canonical")


def merged_names(entities: DataFrame, known: DataFrame, vectors: DataFrame, rules: Near = Near()) -> DataFrame:
    """key, canonical of the names of entities(note_id, ord, name) that go into another one.

    Names are taken in the order in which notes name them first. One that known(canonical_name) holds stays itself; others go
    into the best known or earlier new one by vectors(key, vector) of normal forms. Names without a vector stay themselves.
    """
    names = entities.select(entity_key(F.col("name")).alias("key"), F.struct("note_id", "ord").alias("at")).where("key <> ''").groupBy("key").agg(F.min("at").alias("at"))
    old = known.select(F.col("canonical_name").alias("key")).distinct()
    new = names.join(old, "key", "left_anti").join(vectors.select("key", "vector"), "key")
    new = staged(new.orderBy("at", "key").select("key", "vector", F.monotonically_increasing_id().alias("ord")), "new-names")  # numbers of a global sort ascend
    return greedy_merge(new, old.join(vectors.select("key", "vector"), "key"), rules).where("key <> canonical").select("key", "canonical")


def noisy_or(confidence: Column) -> Column:
    """Aggregate: 1 - product of (1 - c), c in 0..1, unknown 0.6; 0 over nothing."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.6))))
    return F.coalesce(1 - F.product(1 - c), F.lit(0.0))


def count_confidence(n: Column) -> Column:
    return F.when(n <= 0, 0.0).otherwise(1 - F.pow(F.lit(0.4), n))


def relation_confidence(evidence: DataFrame, keys: list[str], reported: str | None = None) -> DataFrame:
    """keys, n, confidence: the larger of the evidence count's and the reported confidence."""
    own = F.max(F.coalesce(F.col(reported), F.lit(0.6))) if reported else F.lit(0.0)
    return evidence.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), own.alias("_r")).withColumn("confidence", F.round(F.greatest(count_confidence(F.col("n")), F.col("_r")), 6)).drop("_r")


def without_evidence(relations: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    return relations.join(evidence.select(*keys).distinct(), keys, "left_anti")


def _vector_blocks(vectors: DataFrame, key: str, block: int) -> DataFrame:
    """block, ids, dims, flat: about `block` vectors a row, staged."""
    n = max(1, -(-vectors.count() // block))
    v = vectors.where(F.col(key).isNotNull() & F.col("vector").isNotNull()).select(F.col(key).alias("id"), F.col("vector").cast("array<double>").alias("v"))
    rows = v.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"), F.size("v").alias("dims")).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("m"))
    return staged(rows.select("block", F.col("m.id").alias("ids"), "dims", F.flatten("m.v").alias("flat")), "vector-blocks")


def similar_entities(vectors: DataFrame, queries: DataFrame, threshold: float = 0.85, block: int = 4096) -> DataFrame:
    """query_id, vec_id, score of the best match above the threshold (strictly) other than itself; the least vec_id of equal ones.

    Exact, so quadratic: blocks of queries meet blocks of vectors, about TILE scores at a time, and a run of blocks with the same
    queries leaves a row a query. No vector passes the driver. Vectors of other dimensions don't match; a zero vector scores 0.
    """
    left, right = _vector_blocks(queries, "query_id", block), _vector_blocks(vectors, "vec_id", block)
    met = left.crossJoin(right.select(*(F.col(c).alias(f"r_{c}") for c in ("ids", "dims", "flat"))))

    def unit(flat: np.ndarray, dims: int) -> np.ndarray:
        m = flat.reshape(-1, dims)
        return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, best, score = None, None, None, None

        def found() -> pa.RecordBatch:
            hit = score > threshold
            return pa.RecordBatch.from_arrays([pa.array(ids[hit], pa.int64()), pa.array(best[hit], pa.int64()), pa.array(score[hit], pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                now = (batch.column("block")[row].as_py(), batch.column("dims")[row].as_py())
                dims = now[1]
                if now != at:
                    if at is not None:
                        yield found()
                    at, ids = now, batch.column("ids")[row].values.to_numpy(zero_copy_only=False)
                    best, score = np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf)
                    asked = unit(batch.column("flat")[row].values.to_numpy(zero_copy_only=False), dims) if dims > 0 else None
                if dims < 1 or batch.column("r_dims")[row].as_py() != dims:
                    continue
                keys = batch.column("r_ids")[row].values.to_numpy(zero_copy_only=False)  # ascending, so the first of equal scores is the least
                held = unit(batch.column("r_flat")[row].values.to_numpy(zero_copy_only=False), dims)
                step = max(1, TILE // len(keys))
                for first in range(0, len(ids), step):
                    some = slice(first, first + step)
                    s = np.round(np.round(asked[some] @ held.T, 9), 6)
                    s[np.isnan(s) | (keys[None, :] == ids[some, None])] = -np.inf
                    j = s.argmax(axis=1)
                    top = s[np.arange(len(j)), j]
                    better = (top > score[some]) | ((top == score[some]) & (keys[j] < best[some]))
                    best[some] = np.where(better, keys[j], best[some])
                    score[some] = np.where(better, top, score[some])
        if at is not None:
            yield found()

    near = met.select("block", "ids", "dims", "flat", "r_ids", "r_dims", "r_flat").mapInArrow(run, "query_id long, vec_id long, score double")
    near = staged(near, "similar", 1)  # a row holds two blocks
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def neighbours(mentions: DataFrame, entities: DataFrame, seen: DataFrame, fanout: int) -> DataFrame:
    """note_id: at most fanout notes that mention one of entities(entity_id) and aren't seen, the latest first."""
    near = mentions.join(entities.select("entity_id").distinct(), "entity_id", "left_semi").join(seen.select("note_id"), "note_id", "left_anti")
    return near.groupBy("note_id").agg(F.max("updated_at").alias("_u")).orderBy(F.desc("_u"), "note_id").limit(fanout).select("note_id")


def cascade(mentions: DataFrame, start: DataFrame, depth: int = 1, fanout: int = 50) -> DataFrame:
    """note_id, hop: notes reached from start(note_id) over shared entities, breadth first.

    mentions(note_id, entity_id, updated_at). At most fanout notes are added at a hop, the latest first (a setting of the
    operator). Each level is staged.
    """
    depth, fanout = max(1, min(5, depth)), max(10, min(200, fanout))
    seen = staged(start.select("note_id").distinct().withColumn("hop", F.lit(0).cast("long")), "hops")
    level = seen
    for hop in range(1, depth + 1):
        entities = mentions.join(level.select("note_id"), "note_id", "left_semi").select("entity_id")
        level = staged(neighbours(mentions, entities, seen, fanout).withColumn("hop", F.lit(hop).cast("long")), "hops")
        seen = seen.union(level)
    return seen


def evidenced_mentions(evidence: DataFrame, relations: DataFrame, notes: DataFrame) -> DataFrame:
    """note_id, entity_id, updated_at: both ends of every relation a note evidences, for cascades over evidence."""
    ends = F.explode(F.array("source_entity_id", "target_entity_id"))
    return evidence.join(relations, "relation_id").select("note_id", ends.alias("entity_id")).distinct().join(notes.select("note_id", "updated_at"), "note_id")


def affected(before: DataFrame, after: DataFrame) -> DataFrame:
    """note_id, entity_id in one of the tables only: what a note began or ceased to mention."""
    keys = ["note_id", "entity_id"]
    b, a = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.join(a, keys, "left_anti").union(a.join(b, keys, "left_anti"))


def entities_of_notes(edges: DataFrame) -> DataFrame:
    """note_id, entity_id of the mention edges."""
    m = edges.where("layer = 'semantic' AND type = 'mention'")
    return m.select(F.regexp_replace("source_id", "^note:", "").alias("note_id"), F.regexp_replace("target_id", "^entity:", "").alias("entity_id")).distinct()


def with_mentions(kept: DataFrame, mentions: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """note_id, entity_id of mentions(note_id, name) by canonical name of kept(entity_id, canonical_name)."""
    return _mentions_of(mentions, named_entities(mentions.select("name"), kept, merged))


def _mentions_of(mentions: DataFrame, named: DataFrame) -> DataFrame:
    """with_mentions() by named_entities()."""
    return mentions.select("note_id", "name").join(_hint(named), "name").select("note_id", "entity_id").distinct()


def _ends(relations: DataFrame, named: DataFrame) -> DataFrame:
    """note_id, source_entity_id, target_entity_id, kind, confidence: of each relation in a note, by normal forms, the highest confidence.

    Rows are moved once, by their note.
    """
    keys, ids = named.select("name", "key").distinct(), named.select("key", "entity_id").distinct()
    x = relations.select("note_id", "from", "to", F.lower(F.trim("type")).alias("kind"), "confidence").where("kind <> ''")
    for column in ("from", "to"):
        x = x.join(_hint(keys.select(F.col("name").alias(column), F.col("key").alias(f"{column}_key")), judged=named), column).drop(column)
    x = x.repartition("note_id").groupBy("note_id", "from_key", "to_key", "kind").agg(F.max("confidence").alias("confidence"))
    for column, out in (("from_key", "source_entity_id"), ("to_key", "target_entity_id")):
        x = x.join(_hint(ids.select(F.col("key").alias(column), F.col("entity_id").alias(out)), judged=named), column)
    return x.select("note_id", "source_entity_id", "target_entity_id", "kind", "confidence")


def upsert_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """entities with new ones of the same columns: a known one keeps its name and type, gets the union of aliases and the higher confidence."""
    columns = ["entity_id", "canonical_name", "type", "confidence", "aliases"]
    none = F.array().cast("array<string>")
    aliases = F.array_sort(F.array_union(F.coalesce("o.aliases", none), F.coalesce("n.aliases", none)))
    keep = {"confidence": F.greatest("o.confidence", "n.confidence"), "aliases": aliases, "type": F.coalesce("o.type", "n.type"), "canonical_name": F.coalesce("o.canonical_name", "n.canonical_name"), "entity_id": F.coalesce("o.entity_id", "n.entity_id")}
    return merge(entities.select(*columns), new.select(*columns), ["entity_id"], keep)


def resolve_names(names: DataFrame, column: str, entities: DataFrame, out: str, merged: DataFrame | None = None) -> DataFrame:
    """names with the entity id of a name column as out; rows whose name is no entity's go."""
    keyed = _canonical(names.withColumn("_key", entity_key(F.col(column))), "_key", merged)
    return keyed.join(entities.select(F.col("canonical_name").alias("_key"), F.col("entity_id").alias(out)), "_key").drop("_key")


def add_evidence(evidence: DataFrame, new: DataFrame) -> DataFrame:
    """evidence and new rows whose (relation_id, chunk_id) isn't there yet."""
    return insert_missing(evidence, new, ["relation_id", "chunk_id"])


def remove_evidence(evidence: DataFrame, gone: DataFrame, on: str = "note_id") -> DataFrame:
    """evidence without that of the notes (or chunks, by on) of gone."""
    return purge(evidence, gone, on)


def recompute(relations: DataFrame, evidence: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """relations and edges with confidences and weights by the evidence there is; relations without any go, with their edges.

    A relation's own confidence counts as reported. Evidence with a confidence column is united by noisy-or, else counted.
    """
    own = noisy_or(F.col("confidence")) if "confidence" in evidence.columns else count_confidence(F.count(F.lit(1)))
    g = evidence.groupBy("relation_id").agg(own.alias("_c"))
    kept = relations.join(g, "relation_id").withColumn("confidence", F.round(F.greatest("_c", F.coalesce("reported", F.lit(0.0)) if "reported" in relations.columns else F.lit(0.0)), 6)).drop("_c")
    ends = kept.groupBy(F.concat(F.lit("entity:"), "source_entity_id", F.lit("->entity:"), "target_entity_id", F.lit(":relation")).alias("id")).agg(F.max("confidence").alias("_w"))
    is_relation = (F.col("layer") == "semantic") & (F.col("type") == "relation")
    changed = edges.where(is_relation).join(ends, "id").withColumn("weight", F.col("_w")).select(*edges.columns)
    return kept, edges.where(~is_relation).unionByName(changed)


def relation_edges(relations: DataFrame, source: str = "extraction") -> DataFrame:
    """An edge for each pair of entities with a relation, of the highest confidence."""
    a, b = F.concat(F.lit("entity:"), "source_entity_id"), F.concat(F.lit("entity:"), "target_entity_id")
    g = relations.groupBy(a.alias("source_id"), b.alias("target_id")).agg(F.max("confidence").alias("weight"))
    return g.select(F.concat("source_id", F.lit("->"), "target_id", F.lit(":relation")).alias("id"), F.lit("semantic").alias("layer"), "source_id", "target_id", F.lit("relation").alias("type"), "weight", F.lit(source).alias("source"))


def mention_edges(mentions: DataFrame, source: str = "extraction") -> DataFrame:
    a, b = F.concat(F.lit("note:"), "note_id"), F.concat(F.lit("entity:"), "entity_id")
    return mentions.select(F.concat(a, F.lit("->"), b, F.lit(":mention")).alias("id"), F.lit("semantic").alias("layer"), a.alias("source_id"), b.alias("target_id"), F.lit("mention").alias("type"), F.lit(1.0).alias("weight"), F.lit(source).alias("source"))


def drop_mentions(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """edges without the mention edges of notes(note_id)."""
    gone = notes.select(F.concat(F.lit("note:"), "note_id").alias("source_id")).distinct()
    mention = (F.col("layer") == "semantic") & (F.col("type") == "mention")
    return edges.where(~mention).unionByName(edges.where(mention).join(gone, "source_id", "left_anti").select(*edges.columns))


@dataclass(frozen=True)
class Layer:
    """The semantic tables."""

    entities: DataFrame
    relations: DataFrame
    evidence: DataFrame
    edges: DataFrame


def persist(layer: Layer, notes: DataFrame, entities: DataFrame, relations: DataFrame, first_chunks: DataFrame, vectors: DataFrame | None = None, rules: Near = Near()) -> Layer:
    """The layer after new extractions of notes(note_id), which replace what these notes evidenced and mentioned before.

    entities(note_id, ord, name, type, confidence) and relations(note_id, ord, from, to, type, confidence) are all that was
    extracted; first_chunks(note_id, chunk_id) evidence the relations (`note:0` where a note has none). A relation whose ends
    are no entities is left out; relations without evidence go, confidences follow the evidence. With vectors(key, vector) of
    normal forms, names near a known or earlier one are its aliases, and relations and mentions lead to it. Edges, a row for
    each mention, are made when they are asked for.
    """
    merged = staged(merged_names(entities, layer.entities, vectors, rules), "merged-names") if vectors is not None else None
    evidence = layer.evidence if layer.evidence.isEmpty() else remove_evidence(layer.evidence, notes)
    edges = drop_mentions(layer.edges, notes)
    names = staged(by_name(entities), "names")
    all_entities = staged(upsert_entities(layer.entities, _entities_of(names, merged)), "entities")
    mentioned = _mentions_of(entities, named_entities(names.select("name"), all_entities, merged))
    named = named_entities(relations.select(F.explode(F.array("from", "to")).alias("name")), all_entities, merged)
    ends = _ends(relations, named).join(_large(first_chunks.select("note_id", "chunk_id")), "note_id", "left")
    ends = staged(ends.withColumn("chunk_id", F.coalesce("chunk_id", F.concat("note_id", F.lit(":0")))), "relation-ends")
    with_id = lambda x: x.withColumn("relation_id", relation_id(F.col("source_entity_id"), F.col("target_entity_id"), F.col("kind")))
    new = with_id(ends).select("relation_id", "chunk_id", "note_id")
    evidence = staged(add_evidence(evidence, new), "evidence")
    found = with_id(ends.groupBy("source_entity_id", "target_entity_id", "kind").agg(F.max(F.coalesce("confidence", F.lit(0.6))).alias("reported")))
    both = found.select("relation_id", "source_entity_id", "target_entity_id", F.col("kind").alias("relation_type"), "reported")
    if not layer.relations.isEmpty():
        both = insert_missing(both, layer.relations.withColumn("reported", F.lit(0.0)).select(*both.columns), ["relation_id"])
    kept, _ = recompute(both.withColumn("confidence", F.lit(0.0)), evidence, edges)
    kept = staged(kept.select("relation_id", "source_entity_id", "target_entity_id", "relation_type", "confidence"), "relations")
    rest = edges.where("NOT (layer = 'semantic' AND type = 'relation')")
    edges = rest.unionByName(relation_edges(kept).select(*edges.columns)).unionByName(mention_edges(mentioned).select(*edges.columns))
    return Layer(all_entities, kept, evidence, edges)


def purge_notes(layer: Layer, notes: DataFrame) -> Layer:
    """The layer without what notes(note_id) evidenced and mentioned; what other notes evidence is recomputed."""
    evidence = remove_evidence(layer.evidence, notes)
    kept, edges = recompute(layer.relations, evidence, drop_mentions(layer.edges, notes))
    return replace(layer, relations=kept, evidence=evidence, edges=edges)


def merge_into(layer: Layer, mapping: DataFrame, nodes: DataFrame) -> tuple[Layer, DataFrame]:
    """The layer and nodes(id, ..., entity_id) after each entity of mapping(absorbed, surviving) went into another one.

    Pairs with an unknown or the same end change nothing. Aliases are united, ends of relations and nodes rewritten, nodes of
    absorbed entities go. Relations that come to agree are one, with the evidence of both.
    """
    known = layer.entities.select("entity_id")
    pairs = mapping.where("absorbed <> surviving").join(known.withColumnRenamed("entity_id", "absorbed"), "absorbed", "left_semi").join(known.withColumnRenamed("entity_id", "surviving"), "surviving", "left_semi").dropDuplicates(["absorbed"])
    pairs = staged(pairs, "merged-pairs")
    gone = pairs.select(F.col("absorbed").alias("entity_id"), "surviving")
    extra = layer.entities.join(gone, "entity_id").groupBy(F.col("surviving").alias("entity_id")).agg(F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("_more"))
    left = layer.entities.join(gone, "entity_id", "left_anti").join(extra, "entity_id", "left")
    entities = left.withColumn("aliases", F.when(F.col("_more").isNotNull(), F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), "_more"))).otherwise(F.col("aliases"))).drop("_more")

    def renamed(df: DataFrame, column: str) -> DataFrame:
        m = gone.withColumnsRenamed({"entity_id": column, "surviving": "_to"})
        return df.join(_hint(m, judged=pairs), column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to").select(*df.columns)

    moved = renamed(renamed(layer.relations, "source_entity_id"), "target_entity_id")
    moved = moved.withColumn("_id", relation_id(F.col("source_entity_id"), F.col("target_entity_id"), F.col("relation_type")))
    ids = moved.select("relation_id", "_id")
    # the id tells the other columns, but for the letters' case of the type
    relations = moved.groupBy(F.col("_id").alias("relation_id"), "source_entity_id", "target_entity_id", "relation_type").agg(F.max("confidence").alias("confidence"))
    relations = first_of(relations.withColumn("confidence", F.max("confidence").over(Window.partitionBy("relation_id"))), ["relation_id"], [F.col("relation_type")])
    evidence = layer.evidence.join(ids, "relation_id").withColumn("relation_id", F.col("_id")).drop("_id").dropDuplicates(["relation_id", "chunk_id"]).select(*layer.evidence.columns)
    kept, _ = recompute(relations.withColumn("reported", F.col("confidence")), evidence, layer.edges.limit(0))
    kept = kept.drop("reported")
    ends = layer.edges.where("type <> 'relation'")
    for c in ("source_id", "target_id"):
        m = gone.select(F.concat(F.lit("entity:"), "entity_id").alias(c), F.concat(F.lit("entity:"), "surviving").alias("_to"))
        ends = ends.join(m, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to").select(*layer.edges.columns)
    ends = ends.withColumn("id", F.concat("source_id", F.lit("->"), "target_id", F.lit(":"), "type")).dropDuplicates(["id"])
    edges = ends.unionByName(relation_edges(kept).select(*layer.edges.columns))
    return Layer(entities, kept, evidence, edges), nodes.join(gone.select("entity_id"), "entity_id", "left_anti").select(*nodes.columns)


def semantic_delta(notes: DataFrame, state: DataFrame, model: str | None = None, force: bool = False) -> DataFrame:
    """note_id, process, reason of notes(note_id, title, body) against state(note_id, content_hash, semantic_status, extraction_model)."""
    n = notes.select("note_id", content_hash(F.col("title"), F.col("body")).alias("hash"))
    s = state.select("note_id", "content_hash", "semantic_status", "extraction_model", F.lit(True).alias("known"))
    reason = F.when(F.lit(force), "force").when(F.col("known").isNull(), "no_state").when(F.col("hash") != F.coalesce("content_hash", F.lit("")), "hash_changed").when(F.coalesce("semantic_status", F.lit("")) != "success", "status_not_success")
    if model is not None:
        reason = reason.when(F.coalesce("extraction_model", F.lit("")) != model, "model_changed")
    return n.join(s, "note_id", "left").select("note_id", reason.otherwise("equal").alias("reason")).withColumn("process", F.col("reason") != "equal")


def semantic_status(state: DataFrame, notes: DataFrame) -> DataFrame:
    """note_id, semantic_status (`pending` where there is none) and error of notes(note_id)."""
    s = state.select("note_id", "semantic_status", "error")
    return notes.select("note_id").join(s, "note_id", "left").withColumn("semantic_status", F.coalesce("semantic_status", F.lit("pending")))


def lazy_cascade(evidence: DataFrame, notes: DataFrame) -> DataFrame:
    """relation_id: relations that notes(note_id) evidence. Nothing more is to be done, as confidences are aggregates over the evidence."""
    return evidence.join(notes.select("note_id").distinct(), "note_id", "left_semi").select("relation_id").distinct()


def run_semantic(layer: Layer, notes: DataFrame, state: DataFrame, first_chunks: DataFrame, provider: Provider | None = None, model: str = "stub", health: Health | None = None, force: bool = False, granularity: str = "per-note") -> tuple[Layer, DataFrame, DataFrame]:
    """The layer and state after a semantic run over notes(note_id, title, body), and affected (note_id, entity_id).

    state(note_id, content_hash, semantic_status, extraction_model, error). Notes that changed are extracted and persisted; notes
    with an error in every unit keep what they had and are `failed`. If the provider is down nothing changes.
    """
    provider = provider or StubProvider()
    none = layer.edges.limit(0).select(F.col("source_id").alias("note_id"), F.col("target_id").alias("entity_id"))
    if (health or Health()).check(provider) != "up":
        return layer, state, none
    todo = staged(notes.join(semantic_delta(notes, state, model, force).where("process").select("note_id"), "note_id", "left_semi"), "semantic-todo")
    found = staged(extract(units(todo, granularity), provider), "extractions")
    failed = staged(found.groupBy("note_id").agg(F.min(F.col("error").isNotNull()).alias("all"), F.max("error").alias("error")).where("all").select("note_id", "error"), "failed")
    good = todo.join(failed.select("note_id"), "note_id", "left_anti")
    before = entities_of_notes(layer.edges).join(good.select("note_id"), "note_id", "left_semi")
    new = persist(layer, good, extracted_entities(found), extracted_relations(found), first_chunks)
    new = replace(new, edges=staged(new.edges, "edges"))  # read twice
    after = entities_of_notes(new.edges).join(good.select("note_id"), "note_id", "left_semi")
    rows = todo.join(failed, "note_id", "left").select("note_id", content_hash(F.col("title"), F.col("body")).alias("content_hash"), F.when(F.col("error").isNull(), "success").otherwise("failed").alias("semantic_status"), F.lit(model).alias("extraction_model"), "error")
    return new, staged(merge(state, rows, ["note_id"]), "semantic-state"), affected(before, after)


def enriched_only(rows: DataFrame, source: str = "enrichment") -> DataFrame:
    return rows.where(F.col("source") == source)


def without_enrichment(rows: DataFrame, notes: DataFrame, source: str = "enrichment") -> DataFrame:
    """rows(source, source_id) without the enrichment of notes(note_id); what users or the extraction made stays."""
    gone = notes.select(F.concat(F.lit("note:"), "note_id").alias("source_id")).distinct()
    made = F.coalesce(F.col("source") == source, F.lit(False))
    return rows.where(~made).unionByName(rows.where(made).join(gone, "source_id", "left_anti").select(*rows.columns))


def enrichment_tags(mentions: DataFrame, most: int = 3, of: int = 5) -> DataFrame:
    """note_id, place, tag: slugs of the top entities of each note by confidence. mentions(note_id, name, confidence)."""
    w = Window.partitionBy("note_id").orderBy(F.desc("confidence"), "name")
    t = mentions.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= of).withColumn("tag", tag_slug(F.col("name")))
    return t.where((F.col("tag") != "") & (F.col("place") <= most)).select("note_id", "place", "tag")


def enrichment_links(mentions: DataFrame, notes: DataFrame, most: int = 3) -> DataFrame:
    """note_id, place, target of mentions(note_id, name, confidence): notes whose title is a mentioned name, the most confident first."""
    from noteforge.functions.text import title_key
    from noteforge.operators.indexing import title_index

    m = mentions.withColumn("key", title_key(F.col("name"))).join(title_index(notes), "key").groupBy("note_id", F.col("target_id").alias("target")).agg(F.max("confidence").alias("c"))
    w = Window.partitionBy("note_id").orderBy(F.desc("c"), "target")
    return m.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("note_id", F.col("place").cast("long").alias("place"), "target")


def embed_chunks(chunks: DataFrame, provider: Provider | None = None, model: str = "stub", batch: int = 32) -> DataFrame:
    """chunk_id, model, dims, vector: the provider gets `batch` texts at a time; an error names the task's batch."""
    provider = provider or StubProvider()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = 0
        for b in batches:
            texts, vectors = b["content"].fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                number += 1
                try:
                    v = provider.embeddings(texts[at : at + batch])
                    if len(v) != len(texts[at : at + batch]):
                        raise ValueError(f"{len(v)} vectors for {len(texts[at : at + batch])} texts")
                except Exception as e:
                    raise RuntimeError(f"embedding batch {number} failed: {e}") from e
                vectors += list(v)
            yield pd.DataFrame({"chunk_id": b["chunk_id"].array, "model": model, "dims": [len(x) for x in vectors], "vector": vectors})

    return chunks.select("chunk_id", "content").mapInPandas(run, "chunk_id string, model string, dims int, vector array<float>")


def stale_vectors(vectors: DataFrame, model: str) -> DataFrame:
    """chunk_id, model of the vectors of another model."""
    return vectors.where(~F.col("model").eqNullSafe(model)).select("chunk_id", "model")
