"""The full-text analyzer: Unicode words without diacritics in lower case, stemmed by Porter's published algorithm."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

WORDS = regex.compile(r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*")

# Suffixes of the published algorithm (fixed values): suffix and what replaces it.
STEP_2 = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize logi:log bli:ble alli:al entli:ent eli:e ousli:ous ization:ize "
    "ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
)
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ion: ou: ism: ate: iti: ous: ive: ize:"


def _table(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(x.split(":")) for x in text.split()), key=lambda p: -len(p[0]))


TABLES = [(_table(STEP_2), 0), (_table(STEP_3), 0), (_table(STEP_4), 1)]


def _shape(word: str) -> str:
    """c for consonants, v for vowels; y is a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _plural_and_past(w: str) -> str:
    if w.endswith(("sses", "ies")) and len(w) > 3:
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    for end in ("ed", "ing"):
        stem = w.removesuffix(end)
        if stem != w and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and stem[-1] not in "aeioulsz" and _shape(stem)[-1] == "c":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short(stem) else stem
    return w


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """The stem of a lower-case word; only ASCII suffixes change, words of up to two letters stay."""
    if not 2 < len(w) <= 64:
        return w
    w = _plural_and_past(w)
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table, least in TABLES:
        for end, new in table:
            if w.endswith(end):
                rest = w[: len(w) - len(end)]
                if _measure(rest) > least and (end != "ion" or rest.endswith(("s", "t"))):
                    w = rest + new
                break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


class _Fold(dict):
    """Letters without the diacritics of Latin letters."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        plain = unicodedata.normalize("NFD", ch)
        self[code] = "" if unicodedata.category(ch) == "Mn" else plain[0] if plain[0].isascii() else ch
        return self[code]


FOLD = _Fold()


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """Stem, begin and end of every word."""
    return [(stem(m.group().translate(FOLD).lower()), *m.span()) for m in WORDS.finditer(text or "")]


def analyze(text: str | None) -> list[str]:
    return [s for s, _, _ in spans(text)]
