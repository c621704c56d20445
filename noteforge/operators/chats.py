"""The chat store: conversations and messages as tables; each change gives the table that follows.

Messages are (conversation_id, seq, role, content, error, changed_at), seq counting from 1 in each conversation; conversations
are (conversation_id, title, updated_at). Changes come as tables too, so a batch of them is one join. Keys that aren't there
change nothing; repeated keys in a batch of changes are the caller's to avoid.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteforge.functions.text import auto_title, estimate_tokens
from noteforge.operators.providers import Provider, StubProvider
from noteforge.operators.runs import trim_history

KEY = ["conversation_id", "seq"]


def append(messages: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """messages and, behind each conversation's last, new (conversation_id, place, role, content[, error]) by place."""
    last = messages.join(new.select("conversation_id").distinct(), "conversation_id", "left_semi").groupBy("conversation_id").agg(F.max("seq").alias("_last"))
    at = F.row_number().over(Window.partitionBy("conversation_id").orderBy("place"))
    new = new if "error" in new.columns else new.withColumn("error", F.lit(None).cast("string"))
    rows = new.withColumn("_at", at).join(last, "conversation_id", "left").withColumn("seq", (F.coalesce("_last", F.lit(0)) + F.col("_at")).cast("long"))
    return messages.unionByName(rows.select("conversation_id", "seq", "role", "content", "error", now.alias("changed_at")))


def replace(messages: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """messages with the content of changes (conversation_id, seq, content); their time is now."""
    c = changes.select(*KEY, F.col("content").alias("_new"), F.lit(True).alias("_hit"))
    out = messages.join(c, KEY, "left").withColumn("content", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("content")))
    return out.withColumn("changed_at", F.when(F.col("_hit"), now).otherwise(F.col("changed_at"))).drop("_new", "_hit")


def set_error(messages: DataFrame, changes: DataFrame) -> DataFrame:
    """messages with the error of changes (conversation_id, seq, error), null to clear it; times stay."""
    c = changes.select(*KEY, F.col("error").alias("_new"), F.lit(True).alias("_hit"))
    return messages.join(c, KEY, "left").withColumn("error", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("error"))).drop("_new", "_hit")


def remove(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """messages without those of gone (conversation_id, seq); the numbers of the others stay."""
    return messages.join(gone.select(*KEY), KEY, "left_anti")


def rename(conversations: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """conversations with the title of changes (conversation_id, title), null to clear it; their time is now."""
    c = changes.select("conversation_id", F.col("title").alias("_new"), F.lit(True).alias("_hit"))
    out = conversations.join(c, "conversation_id", "left").withColumn("title", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("title")))
    return out.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))).drop("_new", "_hit")


def delete(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Conversations, or their messages, without the conversations of gone (conversation_id)."""
    return rows.join(gone.select("conversation_id"), "conversation_id", "left_anti")


def conversation_list(messages: DataFrame) -> DataFrame:
    """place, conversation_id, messages, last_seq, updated_at: conversations, the latest changed first."""
    g = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"), F.max("seq").alias("last_seq"), F.max("changed_at").alias("updated_at"))
    return g.orderBy(F.desc("updated_at"), "conversation_id")


TOGGLES = "bm25 boolean, tfidf boolean, fuzzy boolean, dense boolean, graph boolean, graphEnabled boolean"
CITATIONS = "array<struct<index:int,noteId:string,title:string>>"


def read_toggles(text: Column, default: dict[str, bool] | None = None) -> Column:
    """A conversation's retrieval toggles from their JSON; what it doesn't name, or a text that isn't JSON, is as by default."""
    defaults = {"bm25": True, "tfidf": True, "fuzzy": True, "dense": True, "graph": False, "graphEnabled": False} | (default or {})
    x = F.from_json(F.coalesce(text, F.lit("{}")), TOGGLES)
    return F.struct(*(F.coalesce(x[name], F.lit(value)).alias(name) for name, value in defaults.items()))


def read_citations(text: Column) -> Column:
    """A message's citations from their JSON; none where it isn't JSON."""
    return F.coalesce(F.from_json(F.coalesce(text, F.lit("[]")), CITATIONS), F.array().cast(CITATIONS))


def context_and_citations(hits: DataFrame) -> DataFrame:
    """query_id, block, citations (index, note_id, title) of hits(query_id, place, note_id, title, content)."""
    line = F.concat(F.lit("["), F.col("place"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("place").cast("int").alias("index"), "note_id", "title", line.alias("line"))))
    g = hits.groupBy("query_id").agg(rows.alias("rows"))
    return g.select("query_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n").alias("block"), F.transform("rows", lambda r: F.struct(r["index"].alias("index"), r["note_id"].alias("note_id"), r["title"].alias("title"))).alias("citations"))


def prompts(messages: DataFrame, turns: DataFrame, budget: int = 8000) -> DataFrame:
    """conversation_id, prompt: what a provider is asked, as an array of (role, content).

    turns(conversation_id, system, text[, block]) are new user messages with their context; the system message holds the
    context, then comes as much of the conversation's end as fits the budget with both, then the text.
    """
    block = F.coalesce("block", F.lit("")) if "block" in turns.columns else F.lit("")
    t = turns.withColumn("_system", F.when(block != "", F.concat("system", F.lit("\n\n## Relevant notes\n"), block)).otherwise(F.col("system")))
    t = t.select("conversation_id", "_system", F.col("text").alias("_text"), (estimate_tokens(F.col("_system")) + estimate_tokens(F.col("text"))).alias("_base"))
    trimmed = trim_history(messages.join(t.select("conversation_id", "_base"), "conversation_id"), budget, "_base")
    said = trimmed.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("said"))
    pair = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    past = F.coalesce(F.transform("said", lambda m: pair(m["role"], m["content"])), none)
    whole = F.concat(F.array(pair(F.lit("system"), F.col("_system"))), past, F.array(pair(F.lit("user"), F.col("_text"))))
    return t.join(said, "conversation_id", "left").select("conversation_id", whole.alias("prompt"))


def answers(asked: DataFrame, provider: Provider | None = None) -> DataFrame:
    """conversation_id, content, error of prompts; a provider's error makes an empty answer with the error."""
    provider = provider or StubProvider()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for prompt in b["prompt"]:
                try:
                    rows.append(("".join(provider.chat_stream([dict(m) if isinstance(m, dict) else m.asDict() for m in prompt])), None))
                except Exception as e:
                    rows.append(("", str(e)[:1000]))
            yield pd.DataFrame({"conversation_id": b["conversation_id"].array, "content": [c for c, _ in rows], "error": [e for _, e in rows]})

    kind = asked.schema["conversation_id"].dataType.simpleString()
    return asked.mapInPandas(run, f"conversation_id {kind}, content string, error string")


def chat_turn(conversations: DataFrame, messages: DataFrame, turns: DataFrame, now: Column, provider: Provider | None = None, budget: int = 8000) -> tuple[DataFrame, DataFrame]:
    """Conversations and messages after one turn in each conversation of turns (see prompts()).

    The user's message and the answer are appended (with the answer's error); a conversation without a title gets one from the text.
    """
    replies = answers(prompts(messages, turns, budget), provider)
    said = turns.select("conversation_id", F.lit(1).alias("place"), F.lit("user").alias("role"), F.col("text").alias("content"), F.lit(None).cast("string").alias("error"))
    new = said.union(replies.select("conversation_id", F.lit(2), F.lit("assistant"), "content", "error"))
    titles = turns.select("conversation_id", auto_title(F.col("text")).alias("_title"))
    titled = conversations.join(titles, "conversation_id", "left").withColumn("updated_at", F.when(F.col("_title").isNotNull(), now).otherwise(F.col("updated_at")))
    return titled.withColumn("title", F.coalesce("title", "_title")).drop("_title").select(*conversations.columns), append(messages, new, now)
