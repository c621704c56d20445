"""Column functions of the note engine: tokens, hashes, normal forms, small parsers."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stop words of the TF-IDF tokenizer (fixed values).
STOP_WORDS = tuple("a an and are as at be by for from has he in is it its of on that the to was were will with".split())


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words of two characters or more, without stop words."""
    parts = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " "), " ")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def title_key(title: Column) -> Column:
    return F.lower(trim_all(title))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def to_nfc(text: Column) -> Column:
    """text in NFC; only texts beyond ASCII go through the Python step (others go as nulls)."""
    return F.coalesce(nfc(F.when(F.length(text) != F.octet_length(text), text)), text)


#: What an enrichment marker looks like: a comment with a version, tags and links.
MARKER = r"<!--[^>]*enrichment v\d+"


def marker(version: int, tags: list[str], links: list[str]) -> str:
    return f"<!-- enrichment v{version} tags=[{', '.join(tags)}] links=[{', '.join(links)}] -->"


def strip_marker(text: Column, strict: bool = False) -> Column:
    """text without the enrichment marker at its end; strict: only one that is whole, with tags and links."""
    body = r"\s+tags=\[[^\]]*\]\s+links=\[[^\]]*\]\s*-->" if strict else ".*?-->"
    return F.rtrim(F.regexp_replace(text, rf"(?s)\s*{MARKER}{body}\s*$", ""))


def parse_marker(text: Column) -> Column:
    """version, tags, links of the marker; nulls without one."""
    part = lambda name: F.filter(F.transform(F.split(F.regexp_extract(text, rf"enrichment v\d+[^>]*{name}=\[([^\]]*)\]", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    version = F.regexp_extract(text, r"<!--[^>]*enrichment v(\d+)", 1)
    return F.when(version != "", F.struct(version.try_cast("int").alias("version"), part("tags").alias("tags"), part("links").alias("links")))


def content_hash(title: Column, body: Column) -> Column:
    """SHA-256 of the trimmed title, a line feed and the body without its marker, in NFC."""
    own = F.when(F.contains(body, F.lit("enrichment v")), strip_marker(body)).otherwise(body)
    return F.sha2(to_nfc(F.concat(trim_all(title), F.lit("\n"), own)), 256)


def full_content(title: Column, body: Column) -> Column:
    """`# title`, a blank line and the body without its marker; the body alone without a title."""
    own, head = strip_marker(F.coalesce(body, F.lit(""))), trim_all(F.coalesce(title, F.lit("")))
    return F.when(head != "", F.concat(F.lit("# "), head, F.lit("\n\n"), own)).otherwise(own)


def edit_key(text: Column) -> Column:
    """Lower case, without punctuation, single blanks."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def entity_key(name: Column) -> Column:
    """NFC, lower case, single blanks, no punctuation at the ends."""
    one = F.regexp_replace(F.lower(trim_all(to_nfc(name))), r"\s+", " ")
    return F.trim(F.regexp_replace(one, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def entity_id(key: Column) -> Column:
    return F.concat(F.lit("ent_"), F.substring(F.sha2(key, 256), 1, 16))


def relation_id(source: Column, target: Column, kind: Column) -> Column:
    return F.concat(F.lit("rel_"), F.substring(F.sha2(F.concat_ws("|", source, target, F.lower(kind)), 256), 1, 16))


def tag_slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\s+", "-"), r"[^a-z0-9_\-]", "")


def auto_title(text: Column) -> Column:
    one = trim_all(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > 60, F.concat(F.substring(one, 1, 60), F.lit("…"))).otherwise(one)


def fts_query(query: Column, phrase: bool = False) -> Column:
    """Quotes doubled, terms joined by AND; a phrase is quoted whole; blank gives two quotes."""
    safe = F.replace(trim_all(query), F.lit('"'), F.lit('""'))
    out = F.concat(F.lit('"'), safe, F.lit('"')) if phrase else F.array_join(F.filter(F.split(safe, r"\s+"), lambda t: t != ""), " AND ")
    return F.when(F.coalesce(safe, F.lit("")) == "", F.lit('""')).otherwise(out)


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def distances(a: list[str], b: list[str], cells: int = 1 << 22) -> np.ndarray:
    """Edit distances of pairs, with insertions, deletions, substitutions and transpositions that may span edits.

    All pairs of a slice fill their tables together, a cell of each at a time; pairs of like lengths share a slice, and a
    slice's tables hold at most about so many cells.
    """
    out = np.zeros(len(a), dtype=np.int64)
    size = np.array([(len(x) + 2) * (len(y) + 2) for x, y in zip(a, b, strict=True)], dtype=np.int64)
    order = np.argsort(size, kind="stable")[::-1]
    at = 0
    while at < len(order):
        rows, columns = len(a[order[at]]), len(b[order[at]])
        end = at
        while end < len(order):
            rows, columns = max(rows, len(a[order[end]])), max(columns, len(b[order[end]]))
            if end > at and (rows + 2) * (columns + 2) * (end + 1 - at) > cells:
                break
            end += 1
        part = order[at:end]
        out[part] = _slice_distances([a[i] for i in part], [b[i] for i in part])
        at = end
    return out


def _slice_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Tables are shifted by one: row and column 0 stand before the empty prefix and are never the cheapest way."""
    n, la, lb = len(a), np.array([len(x) for x in a]), np.array([len(y) for y in b])
    letters = {c: i for i, c in enumerate(sorted(set("".join(a) + "".join(b))))}
    codes = [np.full((n, max(lens.max(), 1)), -1) for lens in (la, lb)]
    for made, texts in zip(codes, (a, b), strict=True):
        for i, text in enumerate(texts):
            made[i, : len(text)] = [letters[c] for c in text]
    rows, columns, pair = la.max(), lb.max(), np.arange(n)
    table = np.full((n, rows + 2, columns + 2), rows + columns, dtype=np.int32)
    table[:, 1:, 1] = np.arange(rows + 1)
    table[:, 1, 1:] = np.arange(columns + 1)
    last_row = np.zeros((n, len(letters) + 1), dtype=np.int64)  # where a letter stood last in a; the last column is for padding
    for i in range(1, rows + 1):
        last_column = np.zeros(n, dtype=np.int64)
        x = codes[0][:, i - 1]
        for j in range(1, columns + 1):
            y = codes[1][:, j - 1]
            k, m, same = last_row[pair, y], last_column, x == y
            swapped = table[pair, k, m] + (i - k) + (j - m) - 1
            edited = np.minimum(table[:, i, j + 1], table[:, i + 1, j]) + 1
            table[:, i + 1, j + 1] = np.minimum(np.minimum(table[:, i, j] + ~same, edited), swapped)
            last_column = np.where(same, j, last_column)
        last_row[pair, x] = i
    return table[pair, la + 1, lb + 1]


def distance(a: str, b: str) -> int:
    return int(distances([a], [b])[0])


@F.pandas_udf(T.LongType())
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    both = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(pd.array([pd.NA] * len(a), dtype="Int64"))
    out[both] = distances(list(a[both]), list(b[both]))
    return out


#: Units of an interval and their milliseconds (fixed values).
UNITS = {"s sec secs seconds": 1000, "m min mins minutes": 60_000, "h hr hrs hours": 3_600_000, "d day days": 86_400_000}


def interval_ms(text: Column) -> Column:
    """`30m`, `30 min`, `every 6h`, `45s`, `1 day` in milliseconds; null otherwise."""
    form = rf"^(?:every\s+)?(\d+)\s*({'|'.join(u for us in UNITS for u in us.split())})$"
    low = F.lower(trim_all(text))
    n, unit = F.regexp_extract(low, form, 1), F.regexp_extract(low, form, 2)
    each = F.lit(None).cast("long")
    for units, ms in UNITS.items():
        each = F.when(unit.isin(*units.split()), F.lit(ms).cast("long")).otherwise(each)
    return F.when(n != "", n.try_cast("long") * each)


def fingerprint(secret: Column) -> Column:
    """The first eight signs of a secret's SHA-256, to name it in logs."""
    return F.substring(F.sha2(secret, 256), 1, 8)


def cut_error(message: Column, most: int = 1000) -> Column:
    return F.substring(message, 1, most)


def escape_html(text: Column, quotes: bool = True) -> Column:
    """text with &, <, > and " (and with quotes ' too) as character references."""
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *((("'", "&#39;"),) if quotes else ())):
        text = F.replace(text, F.lit(sign), F.lit(reference))
    return text


def cited(text: Column) -> Column:
    """Numbers n of the citations [n] in an answer, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))


def with_citation_links(text: Column, link: str = "#cite-") -> Column:
    """text with each [n] as a link."""
    return F.regexp_replace(text, r"\[(\d+)\]", rf'<a href="{link}$1">[$1]</a>')


def sse_deltas(body: Column) -> Column:
    """The texts of a server-sent event stream's deltas, in order, up to [DONE]; events that aren't JSON have none.

    Events end at blank lines; an event's data lines belong together; other fields are left out.
    """
    lines = F.split(F.regexp_replace(body, "\r\n", "\n"), "\n\n+")
    data = lambda e: F.trim(F.array_join(F.transform(F.filter(F.split(e, "\n"), lambda x: x.startswith("data:")), lambda x: F.ltrim(F.substring(x, 6, 1 << 30))), "\n"))
    events = F.transform(lines, data)
    done = F.array_position(events, "[DONE]")
    upto = F.when(done > 0, F.slice(events, F.lit(1), done.cast("int") - 1)).otherwise(events)
    deltas = F.transform(upto, lambda e: F.get_json_object(e, "$.choices[0].delta.content"))
    return F.filter(deltas, lambda d: d.isNotNull() & (d != ""))


def toggled(bm25: Column, tfidf: Column, fuzzy: Column, dense: Column, graph: Column, graph_enabled: Column) -> Column:
    """Retrievers that a chat's toggles ask for; graph needs both of its flags."""
    flags = (("bm25", bm25), ("tfidf", tfidf), ("fuzzy", fuzzy), ("dense", dense), ("graph", graph & graph_enabled))
    return F.filter(F.array(*(F.when(flag, name) for name, flag in flags)), lambda x: x.isNotNull())


def cron_field(field: str, low: int, high: int) -> set[int]:
    """Values of one cron field: `*`, `*/n`, lists, ranges with steps. Raises ValueError if it isn't valid."""
    out: set[int] = set()
    for part in field.split(","):
        body, _, step = part.partition("/")
        each = int(step) if step else 1
        if each < 1:
            raise ValueError(field)
        if body == "*":
            first, last = low, high
        else:
            a, _, b = body.partition("-")
            first, last = int(a), int(b or a)
        if not low <= first <= last <= high:
            raise ValueError(field)
        out |= set(range(first, last + 1, each))
    return out


def cron_matches(ts: Column, cron: str) -> Column:
    """Five fields, all of which must match; weekday 7 is Sunday as 0 is."""
    fields = cron.split()
    if len(fields) != 5:
        raise ValueError(cron)
    minute, hour, day, month, week = (cron_field(f, *r) for f, r in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True))
    week = {w % 7 for w in week}
    return F.minute(ts).isin(minute) & F.hour(ts).isin(hour) & F.dayofmonth(ts).isin(day) & F.month(ts).isin(month) & (F.dayofweek(ts) - 1).isin(week)
