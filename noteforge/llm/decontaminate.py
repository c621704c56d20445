"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Items are lower-cased (A-Z) and cut into words; the automaton of all items' word sequences is built once and sent to the
executors. A document's words are streamed through it, keeping the length of the longest match that ends at each word.
Where that length reaches the window (10 words), the last window's words are hit and the state's suffix link chain gives
the items that hold the window; an item of fewer words is hit where it occurs as a whole. `clean()` removes the hit
spans from texts, and drops texts of which more than `max_coverage` of the words are hit.

The benchmark is small by nature, but its size is checked: items are dealt into automata of at most `max_tokens` words,
each of which is sent by itself and makes one pass over the documents, which are read where they lie. clean() with several of
them unites their spans before it cuts, and goes over the texts that were hit again until no automaton finds any.

Defined cases: a null or empty document has no words and no hits; a null or empty item occurs nowhere; items with a null
id hit words but aren't counted; equal items count each; repeated documents are judged one by one; an empty benchmark hits
nothing; extra columns are kept by clean() and ignored by the query.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.base import drop_staged, fresh, map_rows, python_column, read, staged

#: Bytes of words as they are kept: ASCII letters in lower case, digits and all bytes above 127; other bytes part words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SPAN = re.compile(rb"[^ ]+")  # of translated bytes, which keep their places


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


@dataclass(frozen=True)
class Decontamination:
    window: int = 10
    max_coverage: float = 0.5
    max_tokens: int = 200_000


class Automaton:
    """Generalised suffix automaton over words: states with transitions, suffix links, lengths; items by window."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, w) for i, w in items if w]
        ends: dict[int, set[int]] = {}  # state of a whole window -> numbers of the items with that window
        self.ids = [i for i, _ in items]
        for _, w in items:
            last = 0
            for x in w:
                last = self._extend(last, x)
        for n, (_, w) in enumerate(items):
            size, state, length = min(window, len(w)), 0, 0
            for x in w:
                state, length = self.next[state][x], length + 1
                if length >= size:
                    ends.setdefault((self._at(state, size), size), set()).add(n)
        self.least = min((min(window, len(w)) for _, w in items), default=window)
        # What a match in a state holds: (length, items) of the state and of all on its chain of suffix links.
        own: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        for (state, size), found in ends.items():
            own.setdefault(state, []).append((size, tuple(sorted(found))))
        self.holds: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.holds[s] = tuple(own.get(s, ())) + (self.holds[self.link[s]] if s else ())

    def _at(self, state: int, size: int) -> int:
        """The state of the last `size` words of a match in `state`."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _new(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.next) - 1

    def _split(self, p: int, x: bytes, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, x: bytes) -> int:
        q = self.next[last].get(x)
        if q is not None:  # the words so far occur in an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, x, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, x, q)
        return new

    def match(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of word numbers [begin, end), merged and ascending; numbers of the items that occur."""
        moves, link, length, holds, least = self.next, self.link, self.length, self.holds, self.least
        root, state, size = moves[0], 0, 0
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for i, x in enumerate(text):
            if x in moves[state]:
                state = moves[state][x]
                size += 1
            elif x not in root:
                state = size = 0
                continue
            else:
                while x not in moves[state]:
                    state = link[state]
                size = length[state] + 1
                state = moves[state][x]
            if size >= least:
                for n, found in holds[state]:
                    if n <= size:
                        items.update(found)
                        begin = i + 1 - n
                        while spans and spans[-1][1] >= begin:
                            begin = min(begin, spans.pop()[0])
                        spans.append((begin, i + 1))
        return spans, items

    def cut(self, text: str, max_coverage: float) -> str | None:
        """text without hit spans, until no window is left; None if too much of it was hit."""
        first = 0
        while True:
            spans, _ = self.match(words(text))
            if not spans:
                return text
            text, first = without(text, spans, first, max_coverage)
            if text is None:
                return None


def without(text: str, spans: list[tuple[int, int]], first: int, max_coverage: float) -> tuple[str | None, int]:
    """text without spans of words, None if less than it may lose is left of its `first` words (0: those it has now); that number."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in SPAN.finditer(raw.translate(TABLE))]
    first = first or len(places)
    if len(places) - sum(e - b for b, e in spans) < (1 - max_coverage) * first:
        return None, first
    out, at = [], 0
    for b, e in spans:
        out.append(raw[at : places[b][0]])
        at = places[e - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass"), first


def automata(benchmark: DataFrame, rules: Decontamination) -> Iterator[Automaton]:
    """Automata over benchmark (item_id, text), of at most max_tokens words each; the items are streamed to the driver."""
    batch, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        w = words(row[1])
        if batch and size + len(w) > rules.max_tokens:
            yield Automaton(batch, rules.window)
            batch, size = [], 0
        batch.append((row[0], w))
        size += len(w)
    yield Automaton(batch, rules.window)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


SPANS = "n_words long, spans array<struct<begin:int,end:int>>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, rules: Decontamination = Decontamination()) -> DataFrame:
    """doc_id, n_words, spans (hit word ranges), items (ids with an occurring window) of every row of docs.

    With several automata, each reads the texts where they lie and hands on what it hit, by two hashes of the text; texts are
    never written again, and what one automaton hit is united with what others did by these hashes.
    """
    spark = docs.sparkSession
    found = automata(benchmark, rules)
    begun = list(islice(found, 2))
    if len(begun) == 1:
        return map_rows(docs.select("doc_id", "text"), _scanner(spark.sparkContext.broadcast(begun[0])), ["text"], ["doc_id"], SPANS)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    rows, hits = None, []
    for a in chain(begun, found):
        sent = spark.sparkContext.broadcast(a)
        if rows is None:  # the first one counts the words
            rows = staged(map_rows(keyed, _scanner(sent), ["text"], ["doc_id", "h1", "h2"], SPANS), "scanned")
            hits.append(rows.where(F.size("spans") > 0).select("h1", "h2", "spans", "items"))
        else:
            own = map_rows(keyed, _scanner(sent), ["text"], ["h1", "h2"], SPANS)
            hits.append(staged(own.where(F.size("spans") > 0).select("h1", "h2", "spans", "items"), "hits"))
        sent.unpersist()
    each = reduce(DataFrame.union, (h.withColumn("by", F.lit(i)) for i, h in enumerate(hits))).dropDuplicates(["h1", "h2", "by"])
    of_text = each.groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row per automaton
    united = python_column(lambda: lambda rows: [[{"begin": b, "end": e} for b, e in _union([(x["begin"], x["end"]) for x in r])] for r in rows], F.col("s"), "array<struct<begin:int,end:int>>")
    of_text = staged(of_text.select("h1", "h2", united.alias("spans"), "items"), "united")
    out = rows.select("doc_id", "h1", "h2", "n_words").join(of_text, ["h1", "h2"], "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(of_text.schema[c].dataType)).alias(c)
    return out.select("doc_id", "n_words", none("spans"), none("items"))


def _scanner(sent):
    """Words, hit spans and items of texts by one automaton."""

    def begin():
        a = sent.value

        def run(texts: list[str | None]) -> dict[str, list]:
            n, spans, items = [], [], []
            for t in texts:
                w = words(t)
                now, found = a.match(w)
                n.append(len(w))
                spans.append([{"begin": x, "end": y} for x, y in now])
                items.append(sorted({a.ids[i] for i in found} - {None}))
            return {"n_words": n, "spans": spans, "items": items}

        return run

    return begin


def contamination(docs: DataFrame, benchmark: DataFrame, rules: Decontamination = Decontamination()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    s = scan(docs, benchmark, rules)
    hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.begin)")
    ids = F.array_join("items", ",")
    return s.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _cutter(sent, max_coverage: float):
    def begin():
        a = sent.value
        return lambda texts: [None if t is None else a.cut(t, max_coverage) for t in texts]

    return begin


def _hits(sent):
    """Flat spans of one automaton united with those of earlier ones."""

    def begin():
        a = sent.value

        def run(texts: list[str | None], old: list[list[int]]) -> dict[str, list]:
            return {CUT: [[x for span in _union([*a.match(words(t))[0], *_pairs(had)]) for x in span] for t, had in zip(texts, old, strict=True)]}

        return run

    return begin


def _pairs(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2], strict=True))


def _remover(max_coverage: float):
    def begin():
        def run(texts: list[str], spans: list[list[int]], first: list[int]) -> dict[str, list]:
            out = [without(t, _pairs(s), n, max_coverage) for t, s, n in zip(texts, spans, first, strict=True)]
            return {CUT: [t for t, _ in out], CUT_FIRST: [n for _, n in out]}

        return run

    return begin


#: Columns that the steps below add and take away again.
CUT, CUT_FIRST = "_noteforge_cut", "_noteforge_first"


def _clean_by_many(docs: DataFrame, benchmark: DataFrame, rules: Decontamination) -> DataFrame:
    """clean() by several automata: in each round all of them mark spans, which are then cut together; texts that were hit go round again."""
    columns, spark = docs.columns, docs.sparkSession
    spans, first = fresh(docs, "_spans", "_first")
    none = F.array().cast("array<int>")
    now, clear = docs.withColumns({spans: none, first: F.lit(0)}), []
    while True:
        last = None
        for a in automata(benchmark, rules):
            sent = spark.sparkContext.broadcast(a)
            marked = map_rows(now, _hits(sent), ["text", spans], now.columns, f"{CUT} array<int>")
            now = staged(marked.withColumn(spans, F.col(CUT)).drop(CUT), "marked")
            sent.unpersist()
            if last is not None:
                drop_staged(last)
            last = now
        clear.append(now.where(F.size(spans) == 0).select(*columns))
        hit = now.where(F.size(spans) > 0)
        hit = map_rows(hit, _remover(rules.max_coverage), ["text", spans, first], hit.columns, f"{CUT} string, {CUT_FIRST} int").where(F.col(CUT).isNotNull())
        now = staged(hit.withColumns({"text": F.col(CUT), first: F.col(CUT_FIRST), spans: none}).drop(CUT, CUT_FIRST), "cut")
        if now.isEmpty():
            return reduce(DataFrame.union, clear)


def clean(docs: DataFrame, benchmark: DataFrame, rules: Decontamination = Decontamination()) -> DataFrame:
    """docs without hit spans (n_chars, if there, follows) and without texts hit beyond max_coverage; all columns kept.

    A null text stays as it is. The number of automata changes nothing: coverage is that of all items, against the words a
    text had at first, and texts are cut until none of the items' windows is left.
    """
    columns = docs.columns
    one, *more = islice(automata(benchmark, rules), 2)
    if more:
        docs = _clean_by_many(docs, benchmark, rules)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(one)
        cut = docs.withColumn(CUT, python_column(_cutter(sent, rules.max_coverage), F.col("text"), "string"))
        docs = cut.where(F.col("text").isNull() | F.col(CUT).isNotNull()).withColumn("text", F.col(CUT))
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def op10_suffix_automaton(spark, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH b AS (SELECT row_number() OVER () AS bid, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS gram FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
g AS (SELECT rid, k, i, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS gram FROM p),
h AS (SELECT g.rid, g.k, g.i, win.item_id FROM g JOIN win ON g.k = win.k AND g.gram = win.gram),
hit AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS pos FROM h) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
