"""Full-text search with the query syntax: terms, AND, OR, NOT, brackets, "phrases", prefix* and NEAR(a b, n).

A query becomes a small tree over phrases. Positional postings are joined with the query's terms, so a chunk is looked at
only if it holds one of them (each syntax form needs one); the tree is evaluated on the positions of that chunk's terms.
Blank queries match nothing. Null texts have no words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.functions.porter import FOLD, analyze, spans, stem
from noteforge.functions.porter import WORDS as WORD
from noteforge.operators.retrieval import _dealt, _few, _hint, _large, like, top
from noteforge.sources.staging import staged

LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z0-9_\x1a\u0080-\U0010ffff]+)|([()*+,]))')
NEAR_DEFAULT = 10
#: Texts, and chunks of queries, that go to a Python worker at once.
BATCH = 256
#: Words of texts that a worker holds before it gives their stems away, about.
WORDS = 1 << 16
#: Words whose stems a worker remembers.
REMEMBERED = 200_000
#: Phrases of a query whose combinations are tabled, at most.
TABLED = 8


class SearchSyntaxError(ValueError):
    """A query that the syntax doesn't allow."""


class _Parser:
    """OR binds least, then AND, then NOT; terms side by side are joined first."""

    def __init__(self, query: str):
        self.phrases: list[list[tuple[str, bool]]] = []
        self.items, self.at, query = [], 0, query.strip()
        place = 0
        while place < len(query):
            m = LEX.match(query, place)
            if not m:
                raise SearchSyntaxError(f"near {query[place : place + 10]!r}")
            self.items.append(m.group(1) or m.group(2) or m.group(3))
            place = m.end()

    def peek(self, ahead: int = 0) -> str:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or (want and got != want):
            raise SearchSyntaxError(f"near {got!r}")
        self.at += 1
        return got

    def tree(self):
        out = self.binary(["OR", "AND", "NOT"])
        if self.peek():
            raise SearchSyntaxError(f"near {self.peek()!r}")
        return out

    def binary(self, words: list[str]):
        below = (lambda: self.binary(words[1:])) if words[1:] else self.side_by_side
        left = below()
        while self.peek() == words[0]:
            self.take()
            right = below()
            if left is None or right is None:  # a string without words
                left = left if words[0] == "NOT" else left or right
            else:
                left = [words[0], left, right]
        return left

    def side_by_side(self):
        if self.peek() == "(":
            self.take()
            out = self.binary(["OR", "AND", "NOT"])
            self.take(")")
            return out
        out = self.near()
        while self.peek() and self.peek() not in ("AND", "OR", "NOT", ")", "("):
            more = self.near()
            out = ["AND", out, more] if out and more else out or more
        return out

    def near(self):
        if self.peek() != "NEAR" or self.peek(1) != "(":
            n = self.phrase()
            return None if n is None else ["NEAR", NEAR_DEFAULT, [n]]
        self.take()
        self.take("(")
        found, room = [], NEAR_DEFAULT
        while self.peek() not in (")", ","):
            found.append(self.phrase())
        if self.peek() == ",":
            self.take()
            if not self.peek().isdigit():
                raise SearchSyntaxError("NEAR needs a number")
            room = int(self.take())
        self.take(")")
        found = [n for n in found if n is not None]
        return ["NEAR", room, found] if found else None

    def phrase(self) -> int | None:
        words: list[str] = []
        while True:
            s = self.take()
            if s in ("(", ")", "*", "+", ",", "AND", "OR", "NOT"):
                raise SearchSyntaxError(f"near {s!r}")
            words += analyze(s[1:-1].replace('""', '"') if s[0] == '"' else s)
            if self.peek() != "+":
                break
            self.take()
        prefix = self.peek() == "*"
        if prefix:
            self.take()
        if not words:
            return None
        self.phrases.append([(w, prefix and i == len(words) - 1) for i, w in enumerate(words)])
        return len(self.phrases) - 1


def parse(query: str | None):
    """Tree (None if blank) and phrases, each a list of (stem, is a prefix)."""
    if not (query or "").strip():
        return None, []
    p = _Parser(query)
    return p.tree(), p.phrases


def near(found: list[list[int]], sizes: list[int], room: int) -> list[list[int]]:
    """Of each phrase's places those that take part in a match: at most `room` words lie before the last phrase's begin."""
    if len(found) == 1:
        return found
    kept: list[set[int]] = [set() for _ in found]
    for last in sorted({s for f in found for s in f}):
        here = [[s for s in f if s <= last <= s + n + room] for f, n in zip(found, sizes, strict=True)]
        if all(here):
            for k, h in zip(kept, here, strict=True):
                k.update(h)
    return [sorted(k) for k in kept]


def evaluate(tree, places: dict[int, list[int]], sizes: dict[int, int]) -> dict[int, int] | None:
    """Matches per phrase, or None if the tree doesn't match; places: begins of each phrase."""
    if tree[0] == "NEAR":
        left = near([places.get(n, []) for n in tree[2]], [sizes[n] for n in tree[2]], tree[1])
        return {n: len(x) for n, x in zip(tree[2], left, strict=True)} if all(left) else None
    a, b = evaluate(tree[1], places, sizes), evaluate(tree[2], places, sizes)
    if tree[0] == "NOT":
        return a if b is None else None
    if tree[0] == "AND":
        return None if a is None or b is None else a | b
    return None if a is None and b is None else (a or {}) | (b or {})


class _Stems(dict):
    """Stems of words as they are written; null for those that aren't wanted (terms, or what begins like one of starts; null: all are)."""

    def __init__(self, terms: set[str] | None, starts: set[str]):
        self.terms, self.starts, self.lengths = terms, starts, sorted({len(s) for s in starts})

    def __missing__(self, word: str) -> str | None:
        if len(self) >= REMEMBERED:
            self.clear()
        w = stem(word.translate(FOLD).lower())
        held = self.terms is None or w in self.terms or any(w[:n] in self.starts for n in self.lengths)
        self[word] = w if held else None
        return self[word]


def positions(chunks: DataFrame, terms: set[str] | None = None, starts: set[str] = frozenset()) -> DataFrame:
    """chunk_id, len, term, places (word numbers) of every stem of every chunk; with `terms`, of these and of what begins like one of
    starts only, and rows without a chunk and term whose len is the words of some chunks together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["chunk_id", "len", "term", "places"]
        stems = _Stems(terms, starts)
        for b in batches:
            rows, held, every = [], 0, 0
            for chunk, text in zip(b["chunk_id"], b["content"], strict=True):
                at: dict[str, list[int]] = {}
                words = WORD.findall(text or "")
                for i, w in enumerate(map(stems.__getitem__, words)):
                    if w is not None:
                        at.setdefault(w, []).append(i)
                rows += [(chunk, len(words), w, p) for w, p in at.items()]
                held, every = held + len(words), every + len(words)
                if held >= WORDS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows if terms is None else [*rows, (None, every, None, None)], columns=columns)

    return chunks.select(F.col("chunk_id").cast("string"), "content").mapInPandas(run, "chunk_id string, len long, term string, places array<int>")


def _table(tree, phrases: list) -> list[int] | None:
    """For queries of at most TABLED phrases, of one word each: by the phrases that occur (as bits), those whose matches count, -1
    where the tree doesn't match, -2 where places decide, as all phrases of a NEAR with several occur."""
    if tree is None or len(phrases) > TABLED or any(len(p) > 1 for p in phrases):
        return None
    nears = lambda t: [t[2]] if t[0] == "NEAR" else nears(t[1]) + nears(t[2])
    out = []
    for bits in range(1 << len(phrases)):
        if any(len(ns) > 1 and all(bits >> n & 1 for n in ns) for ns in nears(tree)):
            out.append(-2)
            continue
        got = evaluate(tree, {n: [0] for n in range(len(phrases)) if bits >> n & 1}, dict.fromkeys(range(len(phrases)), 1))
        out.append(-1 if got is None else sum(1 << n for n in got if got[n]))
    return out


def _parsed(queries: DataFrame) -> DataFrame:
    """query_id, tree, sizes, table, error and, per word of a phrase, phrase, token, term, prefix."""

    @F.pandas_udf("tree string, sizes string, table array<int>, error boolean, words array<struct<phrase:int,token:int,term:string,prefix:boolean>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                tree, phrases = parse(t)
            except SearchSyntaxError:
                rows.append((None, None, None, True, []))
                continue
            words = [{"phrase": n, "token": i, "term": w, "prefix": p} for n, ws in enumerate(phrases) for i, (w, p) in enumerate(ws)]
            rows.append((json.dumps(tree) if tree else None, json.dumps([len(p) for p in phrases]), _table(tree, phrases), False, words))
        return pd.DataFrame(rows, columns=["tree", "sizes", "table", "error", "words"])

    return queries.select("query_id", "query", run("query").alias("p")).select("query_id", "query", "p.*")


def _evaluated():
    """UDF of tree, sizes and hits: whether the tree matches; found: phrases that occur, with the matches that count (0 if none takes part)."""

    @F.pandas_udf("matched boolean, found array<struct<phrase:int,n:int>>")
    def run(trees: pd.Series, sizes: pd.Series, hits: pd.Series) -> pd.DataFrame:
        rows, read = [], lru_cache(maxsize=10_000)(json.loads)
        for tree, size, hit in zip(trees, sizes, hits, strict=True):
            lengths = dict(enumerate(read(size)))
            begins: dict[tuple[int, int], set[int]] = {}
            for h in hit:
                begins.setdefault((h["phrase"], h["token"]), set()).update(int(p) - h["token"] for p in h["places"])
            places = {}
            for n, k in lengths.items():
                both = set.intersection(*(begins.get((n, i), set()) for i in range(k)))
                if both:
                    places[n] = sorted(both)
            got = evaluate(read(tree), places, lengths)
            rows.append((got is not None, [{"phrase": n, "n": (got or {}).get(n, 0)} for n in places]))
        return pd.DataFrame(rows, columns=["matched", "found"])

    return run


def search(queries: DataFrame, chunks: DataFrame, k: int | None = 50, fallback: bool = True) -> DataFrame:
    """query_id, chunk_id, score, rank of the chunks (chunk_id, content) that match; BM25 over phrases, higher is better.

    With fallback, queries with a syntax error are looked up as substrings (of the text in `literal`, if queries have it), with score 0.
    """
    parsed = staged(_parsed(queries), "parsed")
    words = staged(parsed.where("tree IS NOT NULL").select("query_id", F.explode("words").alias("w")).select("query_id", "w.*"), "asked-words")
    starts = words.where("prefix").withColumnRenamed("term", "start")
    terms = words.where("NOT prefix").select("query_id", "phrase", "token", "term")
    few = _few(words)
    wanted = {p: {r[0] for r in words.where(F.col("prefix") == p).select("term").distinct().collect()} for p in (True, False)} if few else {False: None, True: set()}
    made = staged(positions(chunks, wanted[False], wanted[True]), "positions", BATCH)
    post = made.where("term IS NOT NULL")
    frequent = staged(post.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "asked-stems")
    if not starts.isEmpty():  # a stem's first signs, as many as a start has at most, are its keys
        most = starts.agg(F.max(F.length("start"))).first()[0]
        vocabulary = frequent.select("term").withColumn("start", F.explode(F.expr(f"transform(sequence(1, least(length(term), {most})), i -> substring(term, 1, i))")))
        terms = terms.union(vocabulary.join(_hint(starts), "start").select("query_id", "phrase", "token", "term"))
    trees = parsed.where("tree IS NOT NULL").select("query_id", "tree", "sizes", "table")
    ways = trees.select("query_id", F.col("table").isNotNull().alias("tabled"), F.expr("table IS NULL OR array_contains(table, -2)").alias("placed"))
    terms = staged(terms.join(_hint(ways), "query_id"), "asked-terms")
    (post,) = _dealt(terms.join(_large(frequent), "term"), _few(terms), post)  # a chunk's stems lie in one task, so no pair of a query and a chunk is moved
    met = lambda way: post.join(_hint(terms.where(way), judged=terms), "term")
    counted = met("tabled").groupBy("query_id", "chunk_id", "phrase").agg(F.sum(F.size("places")).cast("int").alias("n"), F.first("len").alias("len"))
    counted = counted.groupBy("query_id", "chunk_id").agg(F.collect_list(F.struct("phrase", "n")).alias("all"), F.first("len").alias("len")).join(_hint(trees.select("query_id", "table")), "query_id")
    good = "table[aggregate({0}, 0, (a, f) -> a | shiftleft(1, f.phrase))]"
    counted = counted.withColumn("good", F.expr(good.format("all"))).where("good <> -2")
    counted = counted.select("query_id", "chunk_id", "len", (F.col("good") >= 0).alias("matched"), F.expr("transform(all, f -> struct(f.phrase AS phrase, CASE WHEN good >= 0 AND good & shiftleft(1, f.phrase) <> 0 THEN f.n ELSE 0 END AS n))").alias("found"))
    hits = met("placed").groupBy("query_id", "chunk_id").agg(F.collect_list(F.struct("phrase", "token", "places")).alias("hits"), F.first("len").alias("len"))
    # nothing occurs of a single phrase that lacks a word
    open_ = F.coalesce(F.expr(good.format("hits")) == -2, ~F.expr("sizes LIKE '[%' AND sizes NOT LIKE '%,%'") | (F.size(F.array_distinct("hits.token")) == F.expr("cast(trim(BOTH '[]' FROM sizes) AS int)")))
    placed = hits.join(_hint(trees), "query_id").where(open_).select("query_id", "chunk_id", "len", _evaluated()("tree", "sizes", "hits").alias("e"))
    seen = staged(counted.union(placed.select("query_id", "chunk_id", "len", "e.matched", "e.found")), "seen", BATCH)
    frequency = seen.select("query_id", F.explode("found.phrase").alias("phrase")).groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("df"))
    each = made.where("term IS NULL") if few else made.groupBy("chunk_id").agg(F.first("len").alias("len"))
    size = each.agg(F.sum("len")).first()[0] or 0
    rows = chunks.count()
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(float(rows)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    idfs = frequency.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("phrase", idf))).alias("idfs"))  # a row for each phrase of a query
    gain = lambda f: F.when(f["n"] > 0, F.col("idfs")[f["phrase"]] * f["n"] * 2.2 / (f["n"] + 1.2 * (0.25 + 0.75 * F.col("len") / F.lit(size / rows if size else 1.0)))).otherwise(0.0)
    scored = seen.where("matched AND size(found) > 0").join(_hint(idfs, judged=trees), "query_id")
    scored = scored.select("query_id", "chunk_id", F.round(F.aggregate("found", F.lit(0.0), lambda a, f: a + gain(f)), 6).alias("score"))
    if fallback:
        wrong = parsed.where("error").select("query_id", "query")
        if "literal" in queries.columns:
            wrong = queries.join(_hint(wrong.select("query_id")), "query_id", "left_semi").select("query_id", F.col("literal").alias("query"))
        if not wrong.isEmpty():
            scored = scored.union(like(wrong, chunks.select(F.col("chunk_id").cast("string"), "content"), ["content"], "chunk_id"))
    return top(scored, k, [F.desc("score"), F.col("chunk_id")])


def snippet(text: str | None, stems: set[str], most: int = 20, marks: tuple[str, str, str] = ("[", "]", "…")) -> str:
    """The run of at most `most` words with the most different stems, then the most hits, then the earliest; hits are marked."""
    words = spans(text)
    if not words:
        return ""
    hit = [w in stems for w, _, _ in words]
    best = (-1, -1, 0)
    for b in range(max(1, len(words) - most + 1)):
        if b == 0 or hit[min(b + most, len(words)) - 1] or not any(hit):
            here = [w for (w, _, _), h in zip(words[b : b + most], hit[b : b + most], strict=True) if h]
            best = max(best, (len(set(here)), len(here), -b))
            if not any(hit):
                break
    b = -best[2]
    part = words[b : b + most]
    at = 0 if b == 0 else part[0][1]
    out = marks[2] if b else ""
    for (_, begin, end), h in zip(part, hit[b : b + most], strict=True):
        out += text[at:begin] + (f"{marks[0]}{text[begin:end]}{marks[1]}" if h else text[begin:end])
        at = end
    return out + (marks[2] if b + most < len(words) else text[at:])


def with_snippets(hits: DataFrame, chunks: DataFrame, queries: DataFrame, most: int = 20, marks: tuple[str, str, str] = ("[", "]", "…")) -> DataFrame:
    """hits with a snippet of each chunk's content for its query."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, asked: pd.Series) -> pd.Series:
        def stems(q: str) -> set[str]:
            try:
                return {w for p in parse(q)[1] for w, _ in p}
            except SearchSyntaxError:
                return set(analyze(q))

        return pd.Series([snippet(t, stems(q), most, marks) for t, q in zip(texts, asked, strict=True)], dtype=object)

    full = chunks.select(F.col("chunk_id").cast("string"), "content").join(_hint(staged(hits, "hits")), "chunk_id").join(_hint(queries.select("query_id", "query")), "query_id")
    return full.withColumn("snippet", run("content", "query")).drop("content", "query")
