"""Removal of repeated byte strings: a sparse suffix array by a merge sort that knows common prefixes.

A string of `length` bytes that starts in two places or more, whatever the documents, is removed wherever it lies.

1. Anchors. Of the 32-byte grams that start within a window of 200 bytes, the one with the least hash is its anchor, so equal
   windows have their anchor at the same place. About one place in 85 is an anchor; it stands for the windows whose anchor
   it is, which lie in its context, the 200 to 368 bytes around it. Only suffixes at anchors are sorted.
2. Grams met once can't be in a repeated window and go no further. Contexts are told apart by a hash beside the gram; one
   that occurs twice is repeated as a whole and takes part once, so a group of copies costs one suffix.
3. Runs. Where a gram has several contexts, their texts are read again. Each task sorts the suffixes of its contexts (read
   to the right, then to the left of the anchor), cuts them at splitters and hands on front-coded blocks: of each suffix
   only what it doesn't share with the one before.
4. Merge. The runs of a range are merged by a tree of losers that keeps each candidate's common prefix with the last winner:
   different lengths decide without a look at a byte, equal ones are compared from there on. The order brings suffixes of
   one gram together, and their common prefixes tell which windows agree to the right of the anchor; the left is compared.
5. Splitters are taken from a sample by hash and don't part a gram unless it fills a range; then the windows of that gram are
   counted over all ranges by their hashes. No gram, text or passage thus lies in one task because of its size.
6. Spans of windows are united per document and cut.

What is sorted are contexts that differ but share a gram, at the edges of what is repeated. Hashes decide only that strings
are equal as a whole (64 bits beside a gram's 64, or 128); strings that differ are compared byte by byte.

Defined cases: null text is empty; texts shorter than `length` keep everything; repeated rows are places of their own, so a
long text that is there twice is removed whole; null doc_ids are kept; texts may be of any length; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.base import BROADCAST_ROWS, drop_staged, free, map_rows, python_column, read, staged

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
#: Windows that are looked at together: places within them take the low bits of a packed hash.
CHUNK = 1 << 18
PLACE = np.uint64((1 << 19) - 1)


@dataclass(frozen=True)
class Repeats:
    length: int = 200
    #: a multiple of 8 bytes
    gram: int = 32
    #: one context of so many gives a sample for the splitters
    sampled: int = 256
    #: samples that a range takes at most
    per_range: int = 32
    #: bytes of suffixes that a range, a run and a block hold about
    range_bytes: int = 16_000_000
    run_bytes: int = 32_000_000
    block_bytes: int = 65_536
    #: groups up to this size are compared pair by pair
    few: int = 16


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place on."""
    v = raw.astype(np.uint64)
    for bits in (1, 2, 4):
        v = v[:-bits] | v[bits:] << np.uint64(8 * bits)
    n = len(raw) - gram + 1
    h = np.zeros(n, np.uint64)
    for i in range(gram // 8):
        h ^= v[8 * i : 8 * i + n]
        h *= _MIX[i % 4]
        h ^= h >> np.uint64(31)
    h *= _MIX[1]
    return h ^ h >> np.uint64(29)


def anchors(raw: bytes, rules: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, the first and the last window start of each, and its gram's hash (as int64)."""
    starts, width = len(raw) - rules.length + 1, rules.length - rules.gram + 1
    found: list[list[np.ndarray]] = [[], [], [], []]
    data = np.frombuffer(raw, np.uint8)
    for begin in range(0, max(starts, 0), CHUNK):
        count = min(CHUNK, starts - begin)
        h = _gram_hashes(data[begin : begin + count + rules.length - 1], rules.gram)
        least, size = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        best = (np.minimum(least[:count], least[width - size : width - size + count]) & PLACE).astype(np.int64)
        cuts = np.flatnonzero(np.diff(best)) + 1
        first, last = np.concatenate(([0], cuts)), np.concatenate((cuts, [count])) - 1
        at = best[first]
        new = [at + begin, first + begin, last + begin, h[at].view(np.int64)]
        if found[0] and found[0][-1][-1] == new[0][0]:  # an anchor whose windows lie in two chunks
            found[2][-1][-1] = new[2][0]
            new = [x[1:] for x in new]
        if len(new[0]):
            for have, x in zip(found, new, strict=True):
                have.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def suffix(raw: bytes, at: int, lo: int, hi: int, length: int) -> bytes:
    """The context of an anchor whose windows start lo to hi bytes before it: to the right, then to the left."""
    return raw[at : at + length - lo] + raw[at - hi : at][::-1]


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    return n if x == y else n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


#: A suffix, its common prefix with the one before, and the context's number, window offsets and whether it occurs twice.
Item = tuple[bytes, int, int, int, int, bool]
_HEAD = np.dtype([("lcp", "<u2"), ("size", "<u2"), ("cid", "<i8"), ("lo", "<u2"), ("hi", "<u2"), ("twice", "u1")])


def front_coded(items: list[tuple[bytes, int, int, int, bool]], block_bytes: int) -> Iterator[tuple[int, int, bytes]]:
    """(entries, size, block) of sorted suffixes: each is stored from its common prefix with the one before on."""
    at = 0
    before = b""
    while at < len(items):
        head, tails, size, begin = [], [], 0, at
        while at < len(items) and size < block_bytes:
            s, cid, lo, hi, twice = items[at]
            n = common(before, s)
            head.append((n, len(s) - n, cid, lo, hi, twice))
            tails.append(s[n:])
            size += len(s) - n
            before = s
            at += 1
        data = np.array(head, _HEAD).tobytes() + b"".join(tails)
        yield at - begin, len(data), pa.compress(data, codec="zstd", asbytes=True)


def decoded(blocks: Iterable[tuple[int, int, bytes]]) -> Iterator[Item]:
    """The suffixes of a run's blocks."""
    before = b""
    for entries, size, block in blocks:
        data = pa.decompress(block, decompressed_size=size, codec="zstd", asbytes=True)
        at = entries * _HEAD.itemsize
        for n, rest, cid, lo, hi, twice in np.frombuffer(data, _HEAD, entries).tolist():
            before = before[:n] + data[at : at + rest]
            at += rest
            yield before, n, cid, lo, hi, bool(twice)


def merged(runs: list[Iterator[Item]]) -> Iterator[Item]:
    """One sorted run of several, by a tree of losers.

    Each run's next suffix stands there with its common prefix with the last winner. A longer one is the smaller suffix, and
    the shorter length is also what the two have in common; only if they are equal are bytes compared, from there on. The
    suffix after the winner in its own run brings that length along.
    """
    k = len(runs)
    now = [next(r, None) for r in runs]
    lcp = [0] * k
    tree = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = now[a], now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        n = lcp[a]
        if n != lcp[b]:
            return (a, b) if n > lcp[b] else (b, a)
        m = n + common(x[0][n:], y[0][n:])
        if x[0][m : m + 1] <= y[0][m : m + 1]:
            lcp[b] = m
            return a, b
        lcp[a] = m
        return b, a

    best = [-1] * k + list(range(k))  # winners of each node while the tree is built
    for node in range(k - 1, 0, -1):
        best[node], tree[node] = play(best[2 * node], best[2 * node + 1])
    top = best[1] if k > 1 else 0
    while k and (item := now[top]) is not None:
        yield (item[0], lcp[top], *item[2:])
        item = now[top] = next(runs[top], None)
        lcp[top] = item[1] if item else 0
        node = (top + k) // 2
        while node:
            top, tree[node] = play(top, tree[node])
            node //= 2


def pairwise(group: list[Item], length: int) -> list[set[tuple[int, int]]]:
    """For each suffix of a group the offsets (from, to) of windows that another one has too."""
    out: list[set[tuple[int, int]]] = [set() for _ in group]
    for j in range(1, len(group)):
        y, shared = group[j], length
        for i in range(j - 1, -1, -1):
            x, shared = group[i], min(shared, group[i + 1][1])
            lo, hi = max(length - shared, x[3], y[3]), min(x[4], y[4])
            if lo <= hi and (hi := min(hi, common(x[0][length - x[3] :], y[0][length - y[3] :]))) >= lo:
                out[i].add((lo, hi))
                out[j].add((lo, hi))
    return out


def by_offset(group: list[Item], length: int, lone: list[tuple[int, int]] | None = None) -> list[set[tuple[int, int]]]:
    """The same offset by offset, in linear time; lone gets (index, offset) of one suffix for each window there is."""
    marks = [bytearray(x[4] - x[3] + 1) for x in group]
    for o in range(min(x[3] for x in group), max(x[4] for x in group) + 1):
        seen: dict[bytes, int] = {}
        for j, (s, shared, _, lo, hi, _) in enumerate(group):
            if shared < length - o and seen:  # another string to the right of the anchor
                if lone is not None:
                    lone += [(i, o) for i in seen.values()]
                seen = {}
            if lo <= o <= hi:
                i = seen.setdefault(s[length - lo : length - lo + o], j)
                if i != j:
                    marks[i][o - group[i][3]] = marks[j][o - lo] = 1
        if lone is not None:
            lone += [(i, o) for i in seen.values()]
    out = []
    for x, m in zip(group, marks, strict=True):
        edges = np.flatnonzero(np.diff(np.frombuffer(m, np.uint8).astype(np.int8), prepend=0, append=0))
        out.append({(x[3] + int(b), x[3] + int(e) - 1) for b, e in zip(edges[::2], edges[1::2], strict=True)})
    return out


def window(s: bytes, lo: int, offset: int, length: int) -> bytes:
    """The window that starts `offset` bytes before the anchor of a suffix."""
    return s[length - lo : length - lo + offset][::-1] + s[: length - offset]


def _scan(docs: DataFrame, rules: Repeats) -> DataFrame:
    """A row per document: its keys, bytes and digest, and its anchors as arrays of the same length."""

    def begin():
        def run(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {c: [] for c in ("at", "lo", "hi", "gram", "context", "sample_gram", "sample_context", "sample")}
            for text in texts:
                raw = text.encode("utf-8", "surrogatepass")
                at, first, last, gram = anchors(raw, rules)
                view, length = memoryview(raw), rules.length
                context = np.array([xxhash.xxh3_64_intdigest(view[f : e + length]) for f, e in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
                some = np.flatnonzero(context % np.uint64(rules.sampled) == 0)
                lo, hi, context = at - last, at - first, context.view(np.int64)
                for c, x in (("at", at), ("lo", lo), ("hi", hi), ("gram", gram), ("context", context), ("sample_gram", gram[some]), ("sample_context", context[some])):
                    out[c].append(x)
                out["sample"].append([suffix(raw, int(at[i]), int(lo[i]), int(hi[i]), length) for i in some])
            return out

        return run

    keep = ["row", "doc_id", "h1", "h2", "h3", "n_bytes", "sha"]
    rows = docs.withColumns({"row": F.monotonically_increasing_id(), "n_bytes": F.octet_length("text").cast("long"), "sha": F.sha2("text", 256)})
    return map_rows(rows, begin, ["text"], keep, "at array<int>, lo array<int>, hi array<int>, gram array<long>, context array<long>, sample_gram array<long>, sample_context array<long>, sample array<binary>", rows=50)


def splitters(samples: list[bytes], ranges: int, gram: int) -> list[bytes]:
    """Ascending bounds of ranges; a bound lies between grams unless two bounds would fall into the same gram."""
    samples = sorted(samples)
    raw = [samples[i * len(samples) // ranges] for i in range(1, ranges)] if samples else []
    out = []
    for i, s in enumerate(raw):
        near = {x[:gram] for x in (*raw[max(i - 1, 0) : i], *raw[i + 1 : i + 2])}
        out.append(s if s[:gram] in near else s[:gram])
    return sorted(set(out))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs(h1, h2, h3, text) joined with wanted(h1, h2, h3, ...); a few keys are sent around first, so that other texts stay where they are."""
    keys = ["h1", "h2", "h3"]
    if wanted.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(wanted.select(*keys)), keys, "left_semi")
    return docs.select("text", *keys).join(wanted, keys)


def _runs(texts: DataFrame, bounds, rules: Repeats) -> DataFrame:
    """(range, run, seq, entries, size, block): front-coded pieces of the sorted runs of texts(text, spots)."""
    names, kinds = ["range", "run", "seq", "entries", "size", "block"], [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, number = bounds.value, TaskContext.get().partitionId() << 24
        held: list[tuple[bytes, int, int, int, bool]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            held.sort()
            begin = 0
            while begin < len(held):
                r = bisect_right(cuts, held[begin][0])
                end = bisect_left(held, (cuts[r],), begin) if r < len(cuts) else len(held)
                rows = [(r, number, seq, *x) for seq, x in enumerate(front_coded(held[begin:end], rules.block_bytes))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                begin = end

        for batch in batches:
            for text, spots in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for s in spots.as_py():
                    held.append((suffix(raw, s["at"], s["lo"], s["hi"], rules.length), s["cid"], s["lo"], s["hi"], s["twice"]))
                    size += len(held[-1][0])
                    if size >= rules.run_bytes:
                        yield from out()
                        number, size = number + 1, 0
                        held.clear()
        yield from out()
        held.clear()
        free()

    return texts.select("text", "spots").mapInArrow(run, "range int, run long, seq int, entries int, size int, block binary")


def _merge(runs: DataFrame, bounds, rules: Repeats) -> DataFrame:
    """(cid, lo, hi, wa, wb): offsets of repeated windows of contexts, or (with a digest) windows of grams that ranges share."""
    names, kinds = ["cid", "lo", "hi", "wa", "wb"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    length, gram = rules.length, rules.gram

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def solved(group: list[Item], parted: bool) -> Iterator[tuple]:
        if len(group) < 2 and not parted:
            return
        lone: list[tuple[int, int]] | None = [] if parted else None
        found = by_offset(group, length, lone) if parted or len(group) > rules.few else pairwise(group, length)
        for x, spans in zip(group, found, strict=True):
            if not x[5]:
                for lo, hi in spans:
                    yield x[2], lo, hi, None, None
        for i, o in lone or ():
            x = group[i]
            wa, wb = np.frombuffer(xxhash.xxh3_128_digest(window(x[0], x[3], o, length)), "<i8").tolist()
            yield x[2], o, o, wa, wb

    def of_range(number: int, blocks: dict[int, list]) -> Iterator[pa.RecordBatch]:
        cuts = bounds.value
        ends = {x[:gram] for x in (*cuts[max(number - 1, 0) : number], *cuts[number : number + 1]) if len(x) > gram}
        rows: list[tuple] = []
        group: list[Item] = []
        for item in merged([decoded(b) for b in blocks.values()]):
            if group and item[1] < gram:
                rows += solved(group, group[0][0][:gram] in ends)
                group = []
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
            group.append(item)
        if group:
            rows += solved(group, group[0][0][:gram] in ends)
        yield batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, blocks = None, {}
        for batch in batches:
            for r, source, entries, size, block in zip(*(batch.column(c).to_pylist() for c in ("range", "run", "entries", "size", "block")), strict=True):
                if r != number:
                    if blocks:
                        yield from of_range(number, blocks)
                    number, blocks = r, {}
                blocks.setdefault(source, []).append((entries, size, block))
        if blocks:
            yield from of_range(number, blocks)
        free()

    dealt = runs.repartition(len(bounds.value) + 1, "range").sortWithinPartitions("range", "run", "seq")
    return dealt.mapInArrow(run, "cid long, lo int, hi int, wa long, wb long")


def _edges(docs: DataFrame, scanned: DataFrame, mixed: DataFrame, rules: Repeats) -> DataFrame:
    """(cid, lo, hi): offsets of windows that contexts of mixed share with others of their gram."""
    spark = docs.sparkSession
    total = mixed.agg(F.sum(F.col("hi") - F.col("lo") + rules.length)).first()[0] or 0
    ranges = max(1, -(-total // rules.range_bytes))
    samples = scanned.select(F.expr("inline(arrays_zip(sample_gram, sample_context, sample))")).toDF("gram", "context", "sample")
    samples = staged(samples.join(mixed.select("gram", "context"), ["gram", "context"]).dropDuplicates(["gram", "context"]), "repeat-samples")
    thin = max(1, samples.count() // (rules.per_range * ranges))
    bounds = spark.sparkContext.broadcast(splitters([bytes(r[0]) for r in samples.where(F.pmod(F.xxhash64("context"), F.lit(thin)) == 0).select("sample").toLocalIterator()], ranges, rules.gram))
    drop_staged(samples)
    spot = F.struct("at", "lo", "hi", "cid", (F.col("n") > 1).alias("twice"))
    wanted = mixed.join(scanned.select("row", "h1", "h2", "h3"), "row").groupBy("h1", "h2", "h3").agg(F.collect_list(spot).alias("spots"))
    wanted = staged(wanted, "repeat-wanted")
    found = staged(_merge(_runs(_texts(docs, wanted), bounds, rules), bounds, rules), "repeat-found")
    drop_staged(wanted)
    parted = found.where("wa IS NOT NULL")
    again = staged(parted.groupBy("wa", "wb").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a < b").select("wa", "wb"), "repeat-again")
    return found.where("wa IS NULL").union(parted.join(again, ["wa", "wb"], "left_semi").select(*found.columns)).select("cid", "lo", "hi")


def _united(flat: list[int]) -> list[int]:
    """Begins and ends of the union of spans, ascending; touching spans are one."""
    out: list[int] = []
    for b, e in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and b <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [b, e]
    return out


def spans(docs: DataFrame, rules: Repeats = Repeats()) -> tuple[DataFrame, DataFrame]:
    """(scanned, cuts): a row per document (row, doc_id, keys, n_bytes, sha), and (row, cuts) with begins and ends of what is repeated."""
    scanned = staged(_scan(docs, rules), "repeat-scan")
    found = scanned.select("row", F.expr("inline(arrays_zip(at, lo, hi, gram, context))"))
    twice = staged(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "repeat-grams")
    shared = staged(found.join(twice, "gram"), "repeat-shared")
    drop_staged(twice)
    one = [F.first(c).alias(c) for c in ("row", "at", "lo", "hi")]
    contexts = staged(shared.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), *one).withColumn("cid", F.monotonically_increasing_id()), "repeat-contexts")
    several = staged(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("gram"), "repeat-several")
    mixed = staged(contexts.join(several, "gram"), "repeat-mixed")
    whole = shared.join(contexts.where("n > 1").select("gram", "context"), ["gram", "context"]).select("row", "at", "lo", "hi")
    if not mixed.isEmpty():
        edges = _edges(docs, scanned, mixed, rules)
        whole = whole.union(edges.join(mixed.where("n = 1").select("cid", "row", "at"), "cid").select("row", "at", "lo", "hi"))
    flat = F.array(F.col("at") - F.col("hi"), F.col("at") - F.col("lo") + rules.length)
    cuts = whole.groupBy("row").agg(F.flatten(F.collect_list(flat)).alias("flat"))
    cuts = staged(cuts.select("row", python_column(lambda: lambda rows: [_united(r) for r in rows], F.col("flat"), "array<int>").alias("cuts")), "repeat-cuts")
    for t in (shared, contexts, several, mixed):
        drop_staged(t)
    return scanned, cuts


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.xxhash64("doc_id").alias("h3"))


def kept_bytes(text: str, cuts: list[int]) -> bytes:
    """The bytes of a text outside of the cuts."""
    raw = text.encode("utf-8", "surrogatepass")
    edges = [0, *cuts, len(raw)]
    return b"".join(raw[b:e] for b, e in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, rules: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text)."""
    docs = _keyed(docs)
    scanned, cuts = spans(docs, rules)
    rows = scanned.drop("at", "lo", "hi", "gram", "context", "sample_gram", "sample_context", "sample").join(cuts, "row", "left")
    removed = F.expr("aggregate(cuts, 0L, (a, x) -> x - a, a -> a)")  # ends less begins: alternating signs
    rows = staged(rows.withColumns({"n_removed": F.coalesce(removed, F.lit(0)), "n_spans": F.coalesce(F.size("cuts").cast("long"), F.lit(0)) / 2}).withColumn("n_spans", F.greatest(F.col("n_spans").cast("long"), F.lit(0))), "repeat-rows")
    plain = rows.where("n_removed IN (0, n_bytes)")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = plain.select("doc_id", "n_bytes", "n_removed", "n_spans", F.when(F.col("n_removed") == 0, F.col("sha")).otherwise(empty).alias("kept_sha256"))
    part = rows.where("n_removed NOT IN (0, n_bytes)").select("h1", "h2", "h3", "doc_id", "n_bytes", "n_removed", "n_spans", "cuts")

    def begin():
        return lambda texts, cuts: {"kept_sha256": [hashlib.sha256(kept_bytes(t, c)).hexdigest() for t, c in zip(texts, cuts, strict=True)]}

    return out.union(map_rows(_texts(docs, part), begin, ["text", "cuts"], ["doc_id", "n_bytes", "n_removed", "n_spans"], "kept_sha256 string"))


def op13_suffix_merge(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))


#: Every window of every text by itself, on the bytes in hexadecimal.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT rid, x, unnest(range(length(x) // 2 - 199)) AS p FROM d WHERE length(x) >= 400),
w AS MATERIALIZED (SELECT rid, p, md5_number(substr(x, 2 * p + 1, 400)) AS h FROM p),
r AS (SELECT rid, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
s AS (SELECT rid, p, sum(CASE WHEN p <= prev + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY p) AS k FROM (SELECT *, lag(p) OVER (PARTITION BY rid ORDER BY p) AS prev FROM r)),
c AS (SELECT rid, min(p) AS b, max(p) + 200 AS e FROM s GROUP BY rid, k),
g AS (SELECT rid, b, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY b), 0) AS prev FROM c),
a AS (SELECT rid, sum(e - b)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, string_agg(substr(x, 2 * prev + 1, 2 * (b - prev)), '' ORDER BY b) || substr(any_value(x), 2 * max(e)::BIGINT + 1) AS kept FROM g JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN a USING (rid)
"""
