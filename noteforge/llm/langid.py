"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased text's code points, weighted (1 + log count) * idf and brought to unit
length. Document frequencies count every labelled document that may be learnt from. The regression is fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample: `per_language` distinct texts of each language
at most (those of least hash), and of all languages together about `grams` n-grams and `texts` texts, but one text of each
language at least. Every language is learnt; where they are more than `weights` allow, n-grams share fewer buckets, which
bounds the model that the driver fits and the executors get. A temperature is then fitted on documents that the regression didn't see, and divides the
logits of every prediction. Only the text is an input of a prediction.

Defined cases: null text, or text without a letter, is `und` with score 0; null labels aren't learnt from; with nothing to
learn from every text is `und`; ties go to the language that sorts first; repeated rows are judged one by one and alike; an empty
table gives an empty result; a null doc_id counts as held out; extra columns are kept, lang_pred, score and held_out are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteforge.llm.base import drop_staged, fresh, python_column, read, released, staged
from noteforge.llm.ftrl import Ftrl, Leader

#: Hash multipliers per place of an n-gram.
_M = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@dataclass(frozen=True)
class LanguageId:
    bits: int = 15
    longest: int = 3
    #: bound of the sample's distinct texts per language: for fitting, and a third of it for calibration
    per_language: int = 600
    #: bounds of the sample over all languages: texts, and n-grams (of 8 bytes each on the driver)
    texts: int = 24_000
    grams: int = 40_000_000
    #: bound of the model: buckets times languages
    weights: int = 1 << 24
    epochs: int = 4
    ftrl: Ftrl = field(default_factory=lambda: Ftrl(alpha=1.0, l1=0.02, l2=0.01))


    def of(self, languages: int) -> LanguageId:
        """These rules with as many buckets as the model of so many languages may have (256 at least)."""
        room = (self.weights // max(1, languages)).bit_length() - 1
        return replace(self, bits=max(8, min(self.bits, room)))


@dataclass
class Model:
    rules: LanguageId
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float

    def logits(self, features: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, counts = features
        return _weighted(at, counts, self.idf) @ self.weights[at] + self.bias


def grams(text: str, rules: LanguageId) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams and their counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    h, found = np.zeros(len(c), np.uint32), []
    for n in range(min(rules.longest, len(c))):
        h = h[: len(c) - n] * np.uint32(31) + c[n:] * _M[n]
        found.append((h ^ (h >> np.uint32(15))) * _M[0] >> np.uint32(32 - rules.bits))
    counts = np.bincount(np.concatenate(found), minlength=1 << rules.bits) if found else np.zeros(1 << rules.bits, int)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at].astype(np.int32)


def _weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / (np.sqrt(x @ x) or 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def frequencies(labelled: DataFrame, rules: LanguageId) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each bucket; summed per task before they are brought together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, docs = np.zeros(1 << rules.bits, np.int64), 0
        for b in batches:
            for t in b["text"]:
                total[grams(t, rules)[0]] += 1
            docs += len(b)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, -1).astype(np.int32), "n": np.append(total[at], docs)})

    sums = labelled.select("text").mapInPandas(released(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros(1 << rules.bits, np.int64)
    docs = 0
    for bucket, n in sums.collect():  # at most 2**bits + 1 rows
        if bucket < 0:
            docs = n
        else:
            df[bucket] = n
    return docs, df


def _sample(labelled: DataFrame, counts: dict[str, int], share: float, rules: LanguageId) -> list[tuple[str, tuple[np.ndarray, np.ndarray]]]:
    """That share of the sample, distinct texts of least hash of each language, as features (never texts) on the driver.

    counts: about how many distinct texts each language has. A share of the hashes that holds somewhat more than wanted is
    looked at; copies go, and so does what is over in texts or n-grams, before anything is brought to the driver.
    """
    if not counts:
        return []
    most = max(1, int(share * min(rules.per_language, rules.texts // len(counts))))
    room = int(share * rules.grams / len(counts))
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rates = [(lang, min(1.0, (1.1 * most + 50) / max(n, 1))) for lang, n in counts.items()]
    rate = F.broadcast(labelled.sparkSession.createDataFrame(rates, "lang string, rate double"))  # a row per language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = [grams(t, rules) for t in b["text"]]
            yield pd.DataFrame({"lang": b["lang"].array, "h": b["h"].array, "at": [x for x, _ in f], "n": [x for _, x in f]})

    chosen = labelled.select("lang", "text", h.alias("h"), F.xxhash64("text").alias("key")).join(rate, "lang").where("h < rate").dropDuplicates(["lang", "key"])
    line = Window.partitionBy("lang").orderBy("h", "key")  # bounded: about `most` rows per language
    chosen = chosen.withColumn("place", F.row_number().over(line)).where(F.col("place") <= most).select("lang", "text", "h")
    found = staged(chosen.mapInPandas(released(run), "lang string, h double, at array<int>, n array<int>"), "language-sample")
    upto = F.sum(F.size("at")).over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") < max(1, room)).drop("upto").toPandas().sort_values(["h", "lang"], kind="stable")
    drop_staged(found)
    return [(r.lang, (np.asarray(r.at, np.int32), np.asarray(r.n, np.int32))) for r in rows.itertuples()]


def fit(docs: DataFrame, learn: Column, calibrate: Column, rules: LanguageId = LanguageId()) -> Model:
    """A model from text and lang of the rows of docs where learn or calibrate holds."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    own, other = usable.where(learn), usable.where(calibrate)
    per = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.approx_count_distinct(F.when(c, F.xxhash64("text")), 0.02) for c in (learn, calibrate)))
    counts = {r[0]: (r[2], r[3]) for r in per.orderBy("lang").collect()}  # a row per language
    rules = rules.of(len(counts))
    n, df = frequencies(usable.where(learn | calibrate), rules)
    idf = np.log((n + 1) / (df + 1)) + 1
    train = _sample(own, {k: v[0] for k, v in counts.items() if v[0]}, 1.0, rules)
    held = _sample(other, {k: v[1] for k, v in counts.items() if v[0] and v[1]}, 1 / 3, rules)
    languages = sorted({lang for lang, _ in train})
    place = {lang: i for i, lang in enumerate(languages)}
    leader, bias = Leader((1 << rules.bits, len(languages)), rules.ftrl), Leader((1, len(languages)), rules.ftrl)
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(rules.epochs):
        for i in order.permutation(len(train)).tolist():
            lang, (at, c) = train[i]
            x, w, b = _weighted(at, c, idf), leader.weights(at), bias.weights()
            error = _softmax(x @ w + b[0])
            error[place[lang]] -= 1
            leader.step(at, np.outer(x, error), w)
            bias.step(slice(None), error[None], b)
    model = Model(rules, languages, idf, leader.weights(), bias.weights()[0], 1.0)
    z = [(model.logits(f), place[lang]) for lang, f in held if lang in place]
    if z:
        logits, want = np.array([a for a, _ in z]), np.array([b for _, b in z])
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(want)), want] + 1e-12).mean()
        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 93))
        model.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (the calibrated probability)."""
    sent, rules = docs.sparkSession.sparkContext.broadcast(model), model.rules  # at most `weights` weights

    def begin():
        m = sent.value

        def judge(t: str | None) -> dict:
            if t is None or not m.languages or not any(map(str.isalpha, t)):
                return {"lang": "und", "score": 0.0}
            p = _softmax(m.logits(grams(t, rules)) / m.temperature)
            return {"lang": m.languages[k := int(p.argmax())], "score": float(min(1.0, p[k]))}

        return lambda texts: list(map(judge, texts))

    (out,) = fresh(docs, "_language")
    found = docs.drop("lang_pred", "score").withColumn(out, python_column(begin, F.col("text"), "struct<lang:string,score:double>"))
    return found.withColumns({"lang_pred": F.col(f"{out}.lang"), "score": F.col(f"{out}.score")}).drop(out)


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 5


def identify(docs: DataFrame, rules: LanguageId = LanguageId(), key: str = "doc_id") -> DataFrame:
    """docs with held_out, lang_pred and score; folds 2 to 4 are learnt from, fold 1 calibrates, fold 0 is held out."""
    known = docs.select(key, "text", "lang")
    f = F.coalesce(fold(key), F.lit(0))
    model = fit(known, f >= 2, f == 1, rules)
    return predict(docs, model).withColumn("held_out", f == 0)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
