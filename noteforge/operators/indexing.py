"""Structural indexing: sections, chunks, links, graph, deltas, merges, purges and scopes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteforge.functions.text import content_hash, title_key
from noteforge.operators.providers import Health, Provider, StubProvider
from noteforge.sources.staging import staged

_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_UNDERLINE = re.compile(r"([=-]{2,})\s*$")


def strip_front_matter(text: str) -> str:
    return re.sub(r"\A---\r?\n.*?\r?\n---\r?\n", "", text, count=1, flags=re.S)


def sections(text: str) -> list[tuple[int, str, str]]:
    """(level, heading, text with its heading line) of each section; a fenced block is a section of its own (level -1)."""
    out: list[tuple[int, str, list[str]]] = [(0, "", [])]
    fence = ""
    for line in strip_front_matter(text).split("\n"):
        mark = _FENCE.match(line)
        if fence:
            out[-1][2].append(line)
            if line.strip().startswith(fence[0]):  # any line that begins with the fence's sign ends it
                level, heading = out[-2][:2] if len(out) > 1 else (0, "")
                out.append((level, heading, []))
                fence = ""
        elif mark:
            fence = mark[1]
            out.append((-1, out[-1][1], [line]))
        elif found := _HEADING.match(line):
            out.append((len(found[1]), found[2], [line]))
        elif (found := _UNDERLINE.match(line)) and out[-1][2] and out[-1][2][-1].strip():
            title = out[-1][2].pop()
            out.append((1 if found[1][0] == "=" else 2, title.strip(), [title, line]))
        else:
            out[-1][2].append(line)
    return [(lv, h, body) for lv, h, lines in out if (body := "\n".join(lines).strip())]


@F.udtf(returnType="position int, level int, heading string, text string")
class SectionScan:
    """The sections of a note's text, one row each, as they are met."""

    def eval(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        for i, (level, heading, body) in enumerate(sections(text or "")):
            yield i, level, heading, body


def note_sections(notes: DataFrame) -> DataFrame:
    """note_id, position, level, heading, text of every section of notes(note_id, body); level 0 before a heading, -1 in a fence.

    A lateral join streams a note's sections one after another; an empty or null body has none.
    """
    n = notes.select("note_id", "body")
    return n.lateralJoin(SectionScan(F.col("body").outer())).select("note_id", "position", "level", "heading", "text")


def split_long(text: str, most: int) -> list[str]:
    """Pieces of at most `most` characters: cut at a blank line, a line end or a blank in the second half, else anywhere."""
    out, rest = [], text.strip()
    while len(rest) > most:
        at = next((p for mark in ("\n\n", "\n", " ") if (p := rest.rfind(mark, 0, most + len(mark))) >= most / 2 and p <= most), most)
        out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [p for p in [*out, rest] if p]


def chunk_texts(title: str, body: str, most: int = 2000, overlap: int = 200) -> tuple[list[str], list[str]]:
    """Chunks before and after overlap: sections merged while they fit, long ones split, each led by its predecessor's tail.

    The tail is prefixed as it stands, blanks in front of it included; it is left out where it is blank, or longer than 20
    characters and the chunk begins with the first 20 of them after its leading blanks.
    """
    raw: list[str] = []
    now = ""
    title = title.strip()
    whole = f"# {title}\n\n{strip_front_matter(body)}" if title else body
    for _, _, text in sections(whole):
        if now and len(now) + len(text) + 2 <= most:
            now = f"{now}\n\n{text}"
            continue
        if now:
            raw.append(now)
            now = ""
        if len(text) > most:
            raw += split_long(text, most)
        else:
            now = text
    raw += [now] if now else []
    out = raw[:1]
    for before, text in zip(raw, raw[1:]):
        tail = before[-overlap:] if overlap else ""
        led = len(tail) > 20 and text.startswith(tail.lstrip()[:20])
        out.append(f"{tail}\n\n{text}" if tail.strip() and not led else text)
    return raw, out


def chunk_notes(notes: DataFrame, most: int = 2000, overlap: int = 200) -> DataFrame:
    """chunk_id, note_id, chunk_index, raw, content, token_count of notes(note_id, title, body); empty notes have none."""

    @F.pandas_udf("array<struct<raw:string,content:string>>")
    def cut(titles: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([[{"raw": a, "content": b} for a, b in zip(*chunk_texts(t or "", x, most, overlap), strict=True)] if x and x.strip() else [] for t, x in zip(titles, bodies, strict=True)])

    c = notes.select("note_id", F.posexplode(cut("title", "body")).alias("chunk_index", "c"))
    return c.select(F.concat_ws(":", "note_id", "chunk_index").alias("chunk_id"), "note_id", F.col("chunk_index").cast("long").alias("chunk_index"), "c.raw", "c.content", F.ceil(F.length("c.content") / 4).cast("long").alias("token_count"))


def wiki_links(notes: DataFrame) -> DataFrame:
    """note_id, position, target, alias of [[target|alias]]; the first of each target (in lower case) stays."""
    links = notes.select("note_id", F.posexplode(F.expr(r"regexp_extract_all(body, '\\[\\[([^\\]|]+)(?:\\|([^\\]]+))?\\]\\]', 0)")).alias("position", "link"))
    target = F.trim(F.regexp_extract("link", r"\[\[([^\]|]+)", 1))
    alias = F.trim(F.regexp_extract("link", r"\|([^\]]+)\]\]", 1))
    links = links.select("note_id", F.col("position").cast("long").alias("position"), target.alias("target"), F.nullif(alias, F.lit("")).alias("alias"))
    first = F.row_number().over(Window.partitionBy("note_id", F.lower("target")).orderBy("position"))
    return links.where("target <> ''").withColumn("_n", first).where("_n = 1").drop("_n")


def title_index(notes: DataFrame) -> DataFrame:
    """key, note_id: the earliest note of each title (ties by note_id). notes(note_id, title, created_at)."""
    return notes.groupBy(title_key(F.col("title")).alias("key")).agg(F.min(F.struct(F.col("created_at").isNull(), "created_at", "note_id")).alias("_m")).select("key", F.col("_m.note_id").alias("target_id"))


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links with target_id (null where no title fits)."""
    return links.withColumn("key", title_key(F.col("target"))).join(title_index(notes), "key", "left").drop("key")


def structural_delta(notes: DataFrame, state: DataFrame, now: Column, force: bool = False, cooldown_s: int = 600, model: str | None = None) -> DataFrame:
    """note_id, process, reason of notes(note_id, title, body) against state(note_id, content_hash, structural_status, updated_at).

    With a model, notes whose vectors are of another one (embedding_model of state; null: no vectors) are processed again.
    """
    n = notes.select("note_id", content_hash(F.col("title"), F.col("body")).alias("hash"))
    stored = F.col("embedding_model") if model is not None else F.lit(None).cast("string")
    s = state.select("note_id", "content_hash", "structural_status", "updated_at", stored.alias("stored"), F.lit(True).alias("known"))
    young = F.timestamp_diff("SECOND", F.col("updated_at"), now) < cooldown_s
    reason = F.when(F.lit(force), "force").when(F.col("known").isNull(), "no_state").when(F.col("hash") != F.coalesce("content_hash", F.lit("")), "hash_changed")
    reason = reason.when((F.col("structural_status") == "failed") & young, "cooldown").when(F.col("structural_status") == "failed", "retry").when(F.col("structural_status") != "success", "pending").when(F.col("stored") != F.lit(model), "model_changed").otherwise("hash_equal")
    return n.join(s, "note_id", "left").select("note_id", reason.alias("reason")).withColumn("process", ~F.col("reason").isin("cooldown", "hash_equal"))


def merge(old: DataFrame, new: DataFrame, key: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """old updated and extended by new (one row per key in each). keep: columns with a rule of their own over o and n."""
    columns = old.columns
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")

    def value(c: str) -> Column:
        if keep and c in keep:
            return keep[c]
        return F.when(F.col("n._n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")

    return joined.select(*(value(c).alias(c) for c in columns))


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and those rows of new (one for each key, the first by its values) whose key old doesn't have."""
    fresh = new.join(old.select(*key).distinct(), key, "left_anti").select(*old.columns)
    order = [c for c in old.columns if c not in key] or key
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return old.unionByName(fresh.withColumn("_n", first).where("_n = 1").drop("_n"))


def replace_for(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key new doesn't have, and new: the way changed notes' rows are overwritten."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def purge(child: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """child without the rows of the deleted keys (a cascade)."""
    return child.join(gone.select(on).distinct(), on, "left_anti")


def descendants(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """root, id: every folder below each root, itself included, by pointer doubling. folders(id, parent_id) is a tree.

    Each folder points at an ancestor, at first its parent, and each round at that one's pointer, while the roots found among
    the ancestors in between are united: a tree of any depth takes as many rounds as the logarithm of it. A root needs no row
    of its own; rows without an id or parent end a path; folders that lead into a cycle are an error that names some of them.
    """
    found = staged(roots.select(F.col("id").alias("root"), F.col("id").alias("id")).where("id IS NOT NULL").distinct(), "folder-roots")
    jumps = staged(folders.where("id IS NOT NULL AND parent_id IS NOT NULL").select("id", F.col("parent_id").alias("up")).distinct(), "folder-jumps")
    left, steps = jumps.count(), 1
    longest = left
    while left:
        if steps > longest:
            named = ", ".join(sorted(str(r[0]) for r in jumps.select("id").distinct().orderBy("id").limit(5).collect()))
            raise ValueError(f"folders aren't a tree; a cycle is above {named}")
        over = jumps.join(found.withColumnRenamed("id", "up"), "up").select("root", "id")
        found = staged(found.union(over).distinct(), "folder-roots")
        jumps = staged(jumps.join(jumps.select(F.col("id").alias("up"), F.col("up").alias("_next")), "up").select("id", F.col("_next").alias("up")).distinct(), "folder-jumps")
        left, steps = jumps.count(), 2 * steps
    return found


def by_ids(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """The notes of ids(note_id) that there are, each once."""
    return notes.join(ids.select("note_id").distinct(), "note_id", "left_semi")


def note_by_id(notes: DataFrame, note_id: object) -> DataFrame:
    """The one note; LookupError if there is none."""
    out = notes.where(F.col("note_id") == note_id)
    if out.isEmpty():
        raise LookupError(f"no note {note_id}")
    return out


def resolve_scope(notes: DataFrame, folders: DataFrame | None = None, *, note: object = None, folder: object = None, everything: bool = False) -> DataFrame:
    """The notes of a scope: one note, a folder with all below it, or all. Exactly one of them must be asked for.

    notes(note_id, parent_id); a note without a folder is in folder ''.
    """
    if (note is not None) + (folder is not None) + bool(everything) != 1:
        raise ValueError("a scope is one of note, folder and everything")
    if note is not None:
        return note_by_id(notes, note)
    if folder is None:
        return notes
    tree = folders if folders is not None else notes.sparkSession.createDataFrame([], "id string, parent_id string")
    root = notes.sparkSession.createDataFrame([(folder,)], "id string")
    inside = descendants(tree, root).select(F.col("id").alias("_folder")).distinct()
    return notes.withColumn("_folder", F.coalesce(F.col("parent_id").cast("string"), F.lit(""))).join(inside, "_folder", "left_semi").drop("_folder")


def tags_of(tags: DataFrame, note_tags: DataFrame) -> DataFrame:
    """note_id, tag_id, title of note_tags(note_id, tag_id) and tags(tag_id, title)."""
    return note_tags.select("note_id", "tag_id").distinct().join(tags.select("tag_id", "title"), "tag_id").select("note_id", "tag_id", "title")


def edge(source: Column, target: Column, kind: str, weight: float = 1.0) -> list[Column]:
    """Columns of a structural edge."""
    return [F.concat(source, F.lit("->"), target, F.lit(f":{kind}")).alias("id"), F.lit("structural").alias("layer"), source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("type"), F.lit(weight).alias("weight")]


def structural_nodes(notes: DataFrame, tagged: DataFrame) -> DataFrame:
    """id, layer, kind, label, note_id: a node for each note and each tag of tagged(note_id, tag_id, title)."""
    n = notes.select(F.concat(F.lit("note:"), "note_id").alias("id"), F.lit("structural").alias("layer"), F.lit("note").alias("kind"), F.coalesce("title", F.col("note_id").cast("string")).alias("label"), F.col("note_id").cast("string").alias("note_id"))
    t = tagged.groupBy("tag_id").agg(F.min("title").alias("label")).select(F.concat(F.lit("tag:"), "tag_id").alias("id"), F.lit("structural").alias("layer"), F.lit("entity").alias("kind"), "label", F.lit(None).cast("string").alias("note_id"))
    return n.union(t)


def structural_edges(resolved: DataFrame, tagged: DataFrame) -> DataFrame:
    """id, layer, source_id, target_id, type, weight: link, backlink and tag edges, each once.

    resolved(note_id, target_id) as resolve_links() gives it; backlinks are the links turned round.
    """
    r = resolved.where("target_id IS NOT NULL").select("note_id", "target_id").distinct()
    a, b = F.concat(F.lit("note:"), "note_id"), F.concat(F.lit("note:"), "target_id")
    t = tagged.select("note_id", "tag_id").distinct()
    return r.select(*edge(a, b, "link")).union(r.select(*edge(b, a, "backlink"))).union(t.select(*edge(F.concat(F.lit("note:"), "note_id"), F.concat(F.lit("tag:"), "tag_id"), "tag")))


def unresolved(resolved: DataFrame) -> DataFrame:
    """note_id, unresolved: links of each note whose target is no note's title."""
    return resolved.groupBy("note_id").agg(F.count_if(F.col("target_id").isNull()).alias("unresolved"))


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes with the labels of new, and the new ones."""
    return merge(nodes, new, ["id"], {c: F.coalesce(f"o.{c}", f"n.{c}") for c in nodes.columns if c not in ("label", "updated_at") and c in new.columns})


def drop_structural(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """edges without the structural ones that start at notes(note_id), and the backlinks to them."""
    gone = notes.select(F.concat(F.lit("note:"), "note_id").alias("_note")).distinct()
    own = edges.where("layer = 'structural'").join(gone, F.col("source_id") == F.col("_note"), "left_anti")
    own = own.where("type <> 'backlink'").unionByName(own.where("type = 'backlink'").join(gone, F.col("target_id") == F.col("_note"), "left_anti"))
    return edges.where("layer <> 'structural'").unionByName(own)


def purge_graph(nodes: DataFrame, edges: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without those of deleted notes(note_id), whatever the edges' layer and direction."""
    gone = notes.select(F.concat(F.lit("note:"), "note_id").alias("id")).distinct()
    left = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)


def orphans(indexed: DataFrame, live: DataFrame, key: str = "note_id") -> DataFrame:
    """key of what is indexed but no longer there."""
    return indexed.select(key).distinct().join(live.select(key), key, "left_anti")


@dataclass(frozen=True)
class Tables:
    """The structural index: snapshot(note_id, title, content_hash, created_at), chunks, vectors(chunk_id, model, ...), nodes, edges, state."""

    snapshot: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    nodes: DataFrame
    edges: DataFrame
    state: DataFrame


@dataclass(frozen=True)
class IndexRun:
    """The tables after a run and its counts."""

    tables: Tables
    processed: int
    skipped: int
    chunks: int
    unresolved: int
    purged: int
    error: str = ""


def empty_tables(spark) -> Tables:
    make = lambda ddl: spark.createDataFrame([], ddl)
    return Tables(
        make("note_id string, title string, content_hash string, created_at timestamp_ntz"),
        make("chunk_id string, note_id string, chunk_index long, content string, token_count long"),
        make("chunk_id string, model string, dims int, vector array<float>"),
        make("id string, layer string, kind string, label string, note_id string"),
        make("id string, layer string, source_id string, target_id string, type string, weight double"),
        make("note_id string, content_hash string, structural_status string, last_indexed_at timestamp_ntz, error string, updated_at timestamp_ntz, embedding_model string"),
    )


def index_notes(tables: Tables, scope: DataFrame, live: DataFrame, tagged: DataFrame, now: Column, *, everything: bool = False, force: bool = False, provider: Provider | None = None, model: str = "stub", health: Health | None = None, most: int = 2000, overlap: int = 200) -> IndexRun:
    """The structural run over scope(note_id, title, body, created_at): notes that changed are cut, embedded, linked and replaced.

    live is the table of all notes (for titles and, in a run over everything, orphans, which are purged); tagged(note_id,
    tag_id, title). If the provider is down, chunks and graph are written without vectors and the notes' state is `pending`.
    """
    provider = provider or StubProvider()
    up = (health or Health()).check(provider) == "up"
    decisions = staged(structural_delta(scope, tables.state, now, force, model=model if up else None), "decisions")
    todo = staged(scope.join(decisions.where("process").select("note_id"), "note_id", "left_semi"), "todo")
    keys = todo.select("note_id")
    chunks = staged(chunk_notes(todo, most, overlap).drop("raw"), "chunks")
    gone = tables.chunks.join(keys, "note_id", "left_semi").select("chunk_id")
    vectors = purge(tables.vectors, gone, "chunk_id")
    if up:
        from noteforge.operators.semantic import embed_chunks

        vectors = vectors.unionByName(embed_chunks(chunks, provider, model))
    all_chunks = tables.chunks.join(keys, "note_id", "left_anti").select(*tables.chunks.columns).unionByName(chunks.select(*tables.chunks.columns))
    resolved = staged(resolve_links(wiki_links(todo), live), "links")
    own_tags = tagged.join(keys, "note_id", "left_semi")
    nodes = upsert_nodes(tables.nodes, structural_nodes(todo, own_tags))
    edges = insert_missing(drop_structural(tables.edges, todo), structural_edges(resolved, own_tags), ["id"])
    hashed = todo.select("note_id", "title", content_hash(F.col("title"), F.col("body")).alias("content_hash"), "created_at")
    snapshot = merge(tables.snapshot, hashed, ["note_id"])
    status = "success" if up else "pending"
    new = hashed.select("note_id", "content_hash", F.lit(status).alias("structural_status"), (now if up else F.lit(None).cast("timestamp_ntz")).alias("last_indexed_at"), F.lit(None if up else "the provider is down").cast("string").alias("error"), now.alias("updated_at"), F.lit(model if up else None).cast("string").alias("embedding_model"))
    state = merge(tables.state, new, ["note_id"], {"last_indexed_at": F.coalesce("n.last_indexed_at", "o.last_indexed_at")})
    out = Tables(snapshot, all_chunks, vectors, nodes, edges, state)
    purged = 0
    if everything:
        lost = staged(orphans(out.snapshot, live), "orphans")
        purged = lost.count()
        if purged:
            out = purge_index(out, lost)
    out = Tables(**{f: staged(getattr(out, f), f) for f in ("snapshot", "chunks", "vectors", "nodes", "edges", "state")})
    n, m = decisions.agg(F.count_if(F.col("process")), F.count_if(~F.col("process"))).first()
    return IndexRun(out, n, m, chunks.count(), resolved.where("target_id IS NULL").count(), purged, "" if up else "the provider is down")


def purge_index(tables: Tables, notes: DataFrame) -> Tables:
    """The tables without deleted notes(note_id): a cascade over all of them."""
    chunks = tables.chunks.join(notes.select("note_id"), "note_id", "left_semi").select("chunk_id")
    nodes, edges = purge_graph(tables.nodes, tables.edges, notes)
    return Tables(purge(tables.snapshot, notes, "note_id"), purge(tables.chunks, notes, "note_id"), purge(tables.vectors, chunks, "chunk_id"), nodes, edges, purge(tables.state, notes, "note_id"))
