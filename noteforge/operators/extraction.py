"""Extraction of entities and relations by a provider: units of text, validation with one retry, merging of results."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteforge.functions.text import cut_error, entity_key, full_content, strip_marker
from noteforge.operators.indexing import chunk_texts
from noteforge.operators.providers import EXTRACT_PROMPT, Provider, StubProvider

ENTITY = "struct<name:string,type:string,confidence:double>"
RELATION = "struct<`from`:string,`to`:string,type:string,confidence:double>"
#: Fields that a relation needs.
ENDS = ("from", "to", "type")
EXTRACTION = f"struct<entities:array<{ENTITY}>,relations:array<{RELATION}>>"


def strip_fences(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, r"^\s*(```[a-zA-Z]*\s*)?", ""), r"\s*(```\s*)?$", "")


def _text(item: Column, field: str) -> Column:
    """A field of a JSON item if it is a JSON string, else null."""
    kind = F.schema_of_variant(F.try_variant_get(item, f"$.{field}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(item, f"$.{field}", "string"))


def _number(item: Column, field: str) -> Column:
    """A field of a JSON item if it is a JSON number, else null."""
    kind = F.schema_of_variant(F.try_variant_get(item, f"$.{field}", "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(item, f"$.{field}", "double"))


def _items(answer: Column, name: str, kind: str, made: Callable[[Column], Column], needed: tuple[str, ...]) -> Column:
    """The items of a list of a JSON answer that have the needed fields."""
    found = F.coalesce(F.try_variant_get(answer, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    rows = F.transform(found, made)
    whole = lambda r: F.forall(F.array(*(r[f].isNotNull() for f in needed)), lambda x: x)
    return F.filter(rows, whole).cast(f"array<{kind}>")


def read_extraction(raw: Column) -> Column:
    """Entities and relations of an answer as they stand.

    Items without the fields they need as JSON strings are left out, whatever else stands in their list; a type that is no
    string is `unknown`, a confidence that is no number is null. Malformed text, a repeated key too, gives empty lists.
    """
    x = F.try_parse_json(strip_fences(raw))
    entity = lambda e: F.struct(_text(e, "name").alias("name"), F.coalesce(_text(e, "type"), F.lit("unknown")).alias("type"), _number(e, "confidence").alias("confidence"))
    relation = lambda r: F.struct(*(_text(r, f).alias(f) for f in ENDS), _number(r, "confidence").alias("confidence"))
    return F.struct(_items(x, "entities", ENTITY, entity, ("name",)).alias("entities"), _items(x, "relations", RELATION, relation, ENDS).alias("relations"))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def extraction_errors(x: Column) -> Column:
    """What is wrong with each item of read_extraction(), by its place."""
    e = F.transform(x["entities"], lambda e, i: F.when(_blank(e["name"]), F.concat(F.lit("entity "), i, F.lit(": blank name"))))

    def of(f: str) -> Column:
        return F.transform(x["relations"], lambda r, i: F.when(_blank(r[f]), F.concat(F.lit("relation "), i, F.lit(f": blank {f}"))))

    r = [of(f) for f in ENDS]
    in_order = F.flatten(F.transform(F.arrays_zip(*(c.alias(n) for c, n in zip(r, "abc"))), lambda z: F.array(z["a"], z["b"], z["c"])))
    return F.filter(F.concat(e, in_order), lambda m: m.isNotNull())


def parse_extraction(raw: Column) -> Column:
    """read_extraction() without the items that extraction_errors() names."""
    x = read_extraction(raw)
    return F.struct(F.filter(x["entities"], lambda e: ~_blank(e["name"])).alias("entities"), F.filter(x["relations"], lambda r: ~_blank(r["from"]) & ~_blank(r["to"]) & ~_blank(r["type"])).alias("relations"))


def _once(pairs: list[tuple[str, object]]) -> dict:
    if len(found := dict(pairs)) < len(pairs):
        raise ValueError("a key stands twice in an object")
    return found


def _no_constant(name: str) -> float:
    raise ValueError(f"{name} is no JSON number")


def parse_result(raw: str) -> dict:
    """The same of a text in Python: lists of entities and relations (without a confidence where there is none)."""
    try:
        x = json.loads(re.sub(r"\s*```\Z", "", re.sub(r"\A```[a-zA-Z]*\s*", "", raw.strip())), object_pairs_hook=_once, parse_constant=_no_constant)
    except ValueError:
        x = {}
    lists = [v if isinstance(x, dict) and isinstance(v := x.get(k), list) else [] for k in ("entities", "relations")]
    text = lambda i, f: isinstance(i, dict) and isinstance(i.get(f), str)
    number = lambda i: {"confidence": float(c)} if isinstance(c := i.get("confidence"), int | float) and not isinstance(c, bool) else {}
    entities = [{"name": i["name"], "type": i["type"] if text(i, "type") else "unknown"} | number(i) for i in lists[0] if text(i, "name")]
    return {"entities": entities, "relations": [{f: i[f] for f in ENDS} | number(i) for i in lists[1] if all(text(i, f) for f in ENDS)]}


def result_errors(x: dict) -> list[str]:
    blank = lambda v: not isinstance(v, str) or not v.strip()
    out = [f"entity {i}: blank name" for i, e in enumerate(x["entities"]) if blank(e.get("name"))]
    return out + [f"relation {i}: blank {f}" for i, r in enumerate(x["relations"]) for f in ENDS if blank(r.get(f))]


def validated(provider: Provider, text: str) -> tuple[dict, str | None]:
    """The provider's extraction of a text; a wrong one is asked for once more with the errors, then it is an error (cut to 1,000 signs)."""
    empty: dict = {"entities": [], "relations": []}
    try:
        x = provider.extract(text)
        wrong = "; ".join(result_errors(x))
    except Exception as e:
        wrong = str(e) or type(e).__name__
    if not wrong:
        return x, None
    again = f"The last answer didn't fit the form. Error: {wrong}. Answer with the JSON only."
    try:
        x = parse_result(provider.chat([{"role": "system", "content": EXTRACT_PROMPT}, {"role": "user", "content": text}, {"role": "user", "content": again}], temperature=0))
    except Exception as e:
        return empty, f"the retry failed: {e}"[:1000]
    wrong = "; ".join(result_errors(x))
    return (empty, f"still wrong after the retry: {wrong}"[:1000]) if wrong else (x, None)


GRANULARITIES = ("per-note", "per-chunk", "per-note+per-chunk")


def units(notes: DataFrame, granularity: str = "per-note", most: int = 8000, chunk: int = 2000, overlap: int = 200) -> DataFrame:
    """note_id, unit, text: what is given to the provider. A note beyond `most` signs goes in windows of chunks; blank notes have none."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {', '.join(GRANULARITIES)}")
    n = notes.select("note_id", F.coalesce("title", F.lit("")).alias("title"), strip_marker(F.coalesce("body", F.lit(""))).alias("body"))
    n = n.withColumn("full", full_content(F.col("title"), F.col("body"))).where("trim(full) <> ''")

    @F.pandas_udf("array<string>")
    def cut(titles: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([[] if b is None else chunk_texts(t, b, chunk, overlap)[1] for t, b in zip(titles, bodies, strict=True)])

    out = []
    if granularity != "per-chunk":
        short = n.where(F.length("full") <= most).select("note_id", F.lit(0).alias("unit"), F.col("full").alias("text"))
        long = n.where(F.length("full") > most).select("note_id", F.posexplode(cut(F.lit(""), F.col("full"))).alias("unit", "text"))
        out += [short, long]
    if granularity != "per-note":
        out.append(n.select("note_id", F.posexplode(cut(F.col("title"), F.col("body"))).alias("unit", "text")).withColumn("unit", F.col("unit") + (1_000_000 if out else 0)))
    whole = out[0]
    for o in out[1:]:
        whole = whole.union(o)
    return whole


def extract(texts: DataFrame, provider: Provider | None = None) -> DataFrame:
    """note_id, unit, entities, relations, error of texts(note_id, unit, text); a unit with an error has no items."""
    provider = provider or StubProvider()
    fields = lambda items, names: [{n: i.get(n) for n in names} for i in items]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [validated(provider, t) for t in b["text"]]
            yield pd.DataFrame({"note_id": b["note_id"].array, "unit": b["unit"].array, "entities": [fields(x["entities"], ("name", "type", "confidence")) for x, _ in rows], "relations": [fields(x["relations"], ("from", "to", "type", "confidence")) for x, _ in rows], "error": [e for _, e in rows]})

    kind = texts.schema["note_id"].dataType.simpleString()
    out = texts.select("note_id", "unit", "text").mapInPandas(run, f"note_id {kind}, unit int, entities array<{ENTITY}>, relations array<{RELATION}>, error string")
    return out.withColumn("error", cut_error(F.col("error")))


def extracted_entities(extractions: DataFrame) -> DataFrame:
    """note_id, ord, name, type, confidence: every entity of every unit, in order."""
    e = extractions.select("note_id", "unit", F.posexplode("entities").alias("place", "e"))
    return e.select("note_id", (F.col("unit").cast("long") * 1_000_000 + F.col("place")).alias("ord"), "e.name", "e.type", "e.confidence")


def extracted_relations(extractions: DataFrame) -> DataFrame:
    """note_id, ord, from, to, type, confidence: every relation of every unit, in order."""
    r = extractions.select("note_id", "unit", F.posexplode("relations").alias("place", "r"))
    return r.select("note_id", (F.col("unit").cast("long") * 1_000_000 + F.col("place")).alias("ord"), "r.from", "r.to", "r.type", "r.confidence")


def merge_entities(entities: DataFrame) -> DataFrame:
    """note_id, key, ord, name, type, confidence: of each name in a note the first record, with the highest confidence."""
    e = entities.withColumn("key", entity_key(F.col("name"))).where("key <> ''")
    g = e.groupBy("note_id", "key").agg(F.min_by(F.struct("ord", "name", "type"), "ord").alias("x"), F.max("confidence").alias("confidence"))
    return g.select("note_id", "key", "x.ord", "x.name", "x.type", "confidence")


def merge_relations(relations: DataFrame) -> DataFrame:
    """note_id, from_key, to_key, kind, ord, from, to, type, confidence: of each relation in a note the first record, with the highest confidence."""
    r = relations.withColumns({"from_key": entity_key(F.col("from")), "to_key": entity_key(F.col("to")), "kind": F.lower(F.trim("type"))})
    r = r.where("from_key <> '' AND to_key <> '' AND kind <> ''")
    g = r.groupBy("note_id", "from_key", "to_key", "kind").agg(F.min_by(F.struct("ord", "from", "to", "type"), "ord").alias("x"), F.max("confidence").alias("confidence"))
    return g.select("note_id", "from_key", "to_key", "kind", "x.ord", "x.from", "x.to", "x.type", "confidence")


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
