"""Packing by cutting stock with column generation.

Each document becomes token ids and a closing id 0, cut at multiples of the sequence length; whole pieces fill sequences of
their own. What is left over has a length below 1024; a histogram of these lengths, in units of 8 tokens (rounded up), is
all that reaches the driver: at most 128 counts at any input size. A linear program over cutting patterns is solved by
column generation (each column is priced by a knapsack dynamic program on the duals), the pattern counts are rounded down,
and what they leave is packed first-fit-decreasing. Pieces are ranked within their length class (dealt over salts, so that
a frequent length isn't one task) and the rank gives the sequence and place.

Defined cases: null or empty text is the closing id alone; repeated rows are packed each; an empty table packs nothing;
a special token's string in a text is encoded as the tokenizer does; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteforge.llm.base import ROW, map_rows, read, shuffle_parts, spread_rank, staged


@dataclass(frozen=True)
class Packing:
    tokenizer: str
    sequence: int = 1024
    unit: int = 8
    end: int = 0
    #: parts that a Python worker remembers in each of two generations at most: about 120 MB in all
    remember: int = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The tokenizer's pattern for texts of ASCII and Latin-1 letters only, where the faster standard engine parts them alike.
LATIN_TEXT = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*\Z").match
LATIN_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9À-ÖØ-öø-ÿ]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+").findall


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(rules: Packing) -> Encoder:
    """The process's encoder: what it has learnt serves the next tasks of the worker too."""
    key = (rules.tokenizer, rules.remember)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


class Encoder(dict):
    """Text to little-endian unsigned 32-bit ids. The parts that the tokenizer's own pattern cuts are encoded once each.

    Parts are remembered in two generations of `most`: a full one becomes the old one, from which parts in use come back, so
    that frequent parts stay however many rare ones pass.
    """

    def __init__(self, path: str, most: int = 400_000):
        self.most, self.old = most, {}
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(part)
        if ids is None:
            ids = self.whole(part)
        self[part] = ids
        return ids

    def whole(self, text: str) -> bytes:
        ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, (LATIN_PARTS if LATIN_TEXT(text) else self.parts)(text)))


def pieces(docs: DataFrame, rules: Packing) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document's ids, cut at multiples of the sequence length."""
    size, end = 4 * rules.sequence, rules.end.to_bytes(4, "little")

    def begin():
        encode = encoder(rules)

        def run(texts: list[str | None]) -> dict[str, list]:
            row, start, length, crc, tokens = [], [], [], [], []
            for i, text in enumerate(texts):
                ids = memoryview((encode(text) if text else b"") + end)
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    tokens.append(len(ids) // 4)
            return {ROW: row, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": tokens}

        return run

    return map_rows(docs, begin, ["text"], ["doc_id"], "start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within room, by dynamic programming."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        best[r], last[r] = best[r - 1], -1
        fit = np.flatnonzero(sizes <= r)
        if len(fit):
            v = best[r - sizes[fit]] + values[fit]
            if v[k := int(v.argmax())] > best[r] + 1e-12:
                best[r], last[r] = v[k], fit[k]
    count, r = np.zeros(len(sizes)), room
    while r > 0:
        if last[r] < 0:
            r -= 1
        else:
            count[last[r]] += 1
            r -= int(sizes[last[r]])
    return float(best[room]), count


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional counts: the cutting-stock linear program, solved to within `gap` of its bound.

    Duals are smoothed towards those of the best bound so far, which begins with the pieces' shares of a sequence.
    """
    m = len(sizes)
    basis, cost = np.diag((room // sizes).astype(float)), np.ones(m)
    inverse, x = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    centre = sizes / room
    bound = float(demand @ centre)
    for _ in range(20 * m + 100):
        if cost @ x <= (1 + gap) * bound:
            break
        duals, price = cost @ inverse, 1.0
        smooth = np.maximum(0.8 * centre + 0.2 * duals, 0)
        value, column = knapsack(smooth, sizes, room)
        if value > 0 and float(demand @ smooth) / value > bound:
            bound, centre = float(demand @ smooth) / value, smooth / value
        if duals.min() < -1e-9:  # more of a size than asked for is allowed
            column, price = -1.0 * (np.arange(m) == duals.argmin()), 0.0
        elif column @ duals <= 1 + 1e-9:
            value, column = knapsack(np.maximum(duals, 0), sizes, room)
            if column @ duals <= 1 + 1e-7:
                break
        turn = inverse @ column
        ratio = np.full(m, np.inf)
        np.divide(x, turn, out=ratio, where=turn > 1e-10)
        k = int(ratio.argmin())
        if not np.isfinite(ratio[k]):
            break
        x = np.maximum(x - ratio[k] * turn, 0)
        x[k] = ratio[k]
        basis[:, k], cost[k] = column, price
        inverse[k] /= turn[k]
        rest = np.arange(m) != k
        inverse[rest] -= np.outer(turn[rest], inverse[k])
    return basis.T[cost > 0], x[cost > 0]


def plan(histogram: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (sizes, descending) with counts, that hold exactly the histogram's items."""
    left = Counter({s: n for s, n in histogram.items() if n > 0})
    out: Counter = Counter()
    if left:
        sizes = np.array(sorted(left))
        patterns, counts = column_generation(sizes, np.array([left[s] for s in sizes.tolist()], float), room)
        for p, n in sorted(zip(patterns.tolist(), counts.tolist(), strict=True), key=lambda pn: -pn[1]):
            items = Counter({int(s): int(round(k)) for s, k in zip(sizes.tolist(), p, strict=True) if round(k) > 0})
            n = min([int(n + 1e-6), *(left[s] // k for s, k in items.items())])
            if items and n > 0:
                out[tuple(sorted(items.elements(), reverse=True))] += n
                left -= Counter({s: k * n for s, k in items.items()})
        while left:  # what rounding left: the largest that fits, again and again
            r, items = room, []
            for s in sorted(left, reverse=True):
                while s <= r and left[s] > 0:
                    items.append(s)
                    left[s] -= 1
                    r -= s
            left = +left
            out[tuple(items)] += 1
    return sorted(out.items(), reverse=True)


def pack(docs: DataFrame, rules: Packing) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    cut = staged(pieces(docs, rules), "pieces")
    room = rules.sequence // rules.unit
    whole = F.col("length") == rules.sequence
    kind = F.when(whole, F.lit(room + 1)).otherwise(F.ceil(F.col("length") / rules.unit).cast("int"))
    cut = cut.withColumn("kind", kind.cast("int"))
    histogram = {r[0]: r[1] for r in cut.groupBy("kind").count().collect()}  # at most room + 1 rows
    histogram.pop(room + 1, 0)
    blocks: dict[int, list[tuple[int, int, int]]] = {}  # kind -> (first rank, first sequence, place)
    upto, sequences = Counter(), 0
    for items, n in plan(histogram, room):
        for place, s in enumerate(items):
            blocks.setdefault(s, []).append((upto[s], sequences, place))
            upto[s] += n
        sequences += n
    ranked = spread_rank(cut, ["kind"], [F.col(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")], F.xxhash64("doc_id", "start"), "rank", 4 * shuffle_parts(docs.sparkSession))
    tables = {k: tuple(np.array(x) for x in zip(*b, strict=True)) for k, b in blocks.items()}

    @F.pandas_udf("sequence_id long, place int")
    def seat(kinds: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, place = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int32)
        kinds, ranks = kinds.to_numpy(), ranks.to_numpy()
        for k in np.unique(kinds).tolist():
            at = np.flatnonzero(kinds == k)
            first, begin, where = tables[k]
            b = np.searchsorted(first, ranks[at], side="right") - 1
            sequence[at], place[at] = begin[b] + ranks[at] - first[b], where[b]
        return pd.DataFrame({"sequence_id": sequence, "place": place})

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ranked = staged(ranked, "ranked")
    alone = ranked.where(F.col("kind") == room + 1).withColumns({"sequence_id": F.col("rank") + F.lit(sequences).cast("long"), "offset": F.lit(0).cast("long")})
    shared = ranked.where(F.col("kind") <= room).withColumn("seat", seat("kind", "rank")).withColumns({"sequence_id": F.col("seat.sequence_id"), "place": F.col("seat.place")})
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    shared = shared.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
    return shared.select(*columns).union(alone.select(*columns))


def op8_column_generation(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), Packing(default_tokenizer()))
