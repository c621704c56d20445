"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Severity grades 0 < 1 < ... < K-1 share one weight per feature; grade k or more has the probability
sigmoid(x.w - threshold_k), with ascending thresholds. Weights and thresholds are fitted by follow-the-regularised-leader
with elastic-net penalties, so that words without evidence weigh nothing. Features are the distinct words of the whole text
(hashed, present or not), so that a long text doesn't dilute a word; only words whose share of documents differs between
grades by `min_z` standard deviations take part. The expected severity is the sum of the probabilities.

The labels know toxic or not; graded() makes three grades of them: toxic documents with more different marker words (words
that labelled toxic documents have and others don't) than the median are grade 2. The regression is fitted on a bounded
sample of labelled rows: about `per_label` documents of either label, those whose doc_id has the least hash, one text for
each doc_id; of sampled near copies (equal label and equal three least features) one is learnt from.

Defined cases: null or empty text has no features and its severity is that of the thresholds alone; labels without a document,
null labels and contradictory labels of one document (the largest counts) are tolerated; of texts under one doc_id the one
of least hash is learnt from; with no labels or a single grade every severity is 0; repeated rows are judged one by one and
alike; empty tables give empty results; extra columns are kept, severity, grade and toxic are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from statistics import median

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.base import fresh, map_rows, python_column, read
from noteforge.llm.decontaminate import words
from noteforge.llm.ftrl import Ftrl, Leader


@dataclass(frozen=True)
class Toxicity:
    bits: int = 20
    per_label: int = 2000
    epochs: int = 8
    #: a word is a feature if this many sampled documents have it, and it tells grades apart by as many deviations
    min_docs: int = 5
    min_z: float = 4.0
    #: severity from which a document counts as toxic
    toxic_from: float = 0.5
    ftrl: Ftrl = field(default_factory=lambda: Ftrl(alpha=3.0, l1=1.0, l2=0.001))


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: list[float]

    def at_least(self, features: np.ndarray) -> np.ndarray:
        """Probability of grade 1 or more, 2 or more, ..."""
        x = sum(map(self.weights.get, features.tolist(), [0.0] * len(features)))
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - x, -40, 40)))


def features(text: str | None, bits: int) -> np.ndarray:
    found = {xxhash.xxh3_64_intdigest(w) >> (64 - bits) for w in set(words(text))}
    return np.fromiter(found, np.int64, len(found))


def telling(rows: list[tuple[np.ndarray, int]], rules: Toxicity) -> list[int]:
    """Features that at least min_docs rows have, and whose share among rows of grade k or more differs from the others' for some k."""
    seen = Counter(f for x, _ in rows for f in x.tolist())
    names = sorted(f for f, n in seen.items() if n >= rules.min_docs)
    total, out = len(rows), np.zeros(len(names), bool)
    n = np.array([seen[f] for f in names], float)
    spread = np.sqrt(np.maximum(n / total * (1 - n / total), 1e-12)) if names else n
    for k in sorted({g for _, g in rows} - {0}):
        above = sum(g >= k for _, g in rows)
        if 0 < above < total:
            has = Counter(f for x, g in rows if g >= k for f in x.tolist())
            a = np.array([has[f] for f in names], float)
            z = (a / above - (n - a) / (total - above)) / (spread * (1 / above + 1 / (total - above)) ** 0.5)
            out |= np.abs(z) >= rules.min_z
    return [f for f, keep in zip(names, out.tolist(), strict=True) if keep]


def fit(rows: list[tuple[np.ndarray, int]], rules: Toxicity) -> Model:
    """rows: features and grade. Thresholds stay ascending as their steps are."""
    grades = 1 + max((g for _, g in rows), default=0)
    if grades < 2:
        return Model({}, [40.0])
    place = {f: i for i, f in enumerate(telling(rows, rules))}
    rows = [(np.array([place[f] for f in x.tolist() if f in place], np.int64), g) for x, g in rows]
    leader = Leader((len(place),), rules.ftrl)
    cut = Leader((grades - 1,), Ftrl(alpha=rules.ftrl.alpha, l1=0.0, l2=0.001))
    start = np.arange(grades - 1) + 2.0
    order = np.random.Generator(np.random.PCG64(11))
    for _ in range(rules.epochs):
        for i in order.permutation(len(rows)).tolist():
            at, grade = rows[i]
            w, t = leader.weights(at), cut.weights()
            p = 1 / (1 + np.exp(np.clip(np.maximum.accumulate(start + t) - w.sum(), -40, 40)))
            # likelihood of the grade: p[g-1] - p[g], with 1 and 0 at the ends
            above = np.concatenate(([1.0], p, [0.0]))
            slope = np.concatenate(([0.0], p * (1 - p), [0.0]))
            like = max(above[grade] - above[grade + 1], 1e-9)
            leader.step(at, np.full(len(at), -np.clip((slope[grade] - slope[grade + 1]) / like, -1, 1)), w)
            g = np.zeros(grades - 1)
            if grade > 0:
                g[grade - 1] += slope[grade] / like
            if grade < grades - 1:
                g[grade] -= slope[grade + 1] / like
            cut.step(slice(None), np.clip(g, -1, 1), t)
    w = leader.weights()
    names = list(place)
    return Model({names[i]: float(w[i]) for i in np.flatnonzero(w).tolist()}, np.maximum.accumulate(start + cut.weights()).tolist())


def graded(rows: list[tuple[np.ndarray, int]], rules: Toxicity) -> list[tuple[np.ndarray, int]]:
    """Features and label to features and grade 0, 1 or 2."""
    has, lacks = (Counter(f for x, y in rows if (y > 0) is z for f in x.tolist()) for z in (True, False))
    toxic, clean = max(1, sum(y > 0 for _, y in rows)), max(1, sum(y <= 0 for _, y in rows))
    marker = {f for f, n in has.items() if n >= rules.min_docs and n / toxic >= 20 * (lacks[f] + 0.5) / clean}
    markers = [sum(f in marker for f in x.tolist()) for x, _ in rows]
    middle = median([m for m, (_, y) in zip(markers, rows, strict=True) if y > 0 and m] or [0])
    return [(x, 0 if y <= 0 else 2 if m > middle else 1) for m, (x, y) in zip(markers, rows, strict=True)]


def distinct(rows: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, int]]:
    """One row for each label and three least features: near copies have them in common, other texts hardly ever."""
    return list({(y, *np.sort(x)[:3].tolist()): (x, y) for x, y in reversed(rows)}.values())[::-1]


def train(docs: DataFrame, labels: DataFrame, rules: Toxicity = Toxicity()) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy((F.col("toxic") > 0).alias("t")).count().collect()}  # two rows
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("toxic") > 0, min(1.0, rules.per_label / counts.get(True, 1))).otherwise(min(1.0, rules.per_label / counts.get(False, 1)))
    sample = known.where(h < rate)  # about 2 * per_label rows
    bits = rules.bits
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = map_rows(chosen, lambda: lambda texts: {"x": [features(t, bits) for t in texts]}, ["text"], ["doc_id", "toxic"], "x array<long>").collect()
    rows = [(np.asarray(r.x, np.int64), r.toxic) for r in sorted(rows, key=lambda r: r.doc_id)]
    return fit(graded(distinct(rows), rules), rules)


def severity(docs: DataFrame, model: Model, rules: Toxicity = Toxicity()) -> DataFrame:
    """docs with severity (expected grade), grade (the likeliest) and toxic."""
    sent, bits = docs.sparkSession.sparkContext.broadcast(model), rules.bits

    def begin():
        m = sent.value

        def judge(text: str | None) -> dict:
            p = m.at_least(features(text, bits))
            return {"severity": float(p.sum()), "grade": int((-np.diff(np.concatenate(([1.0], p, [0.0])))).argmax())}

        return lambda texts: list(map(judge, texts))

    (out,) = fresh(docs, "_severity")
    judged = docs.drop("severity", "grade", "toxic").withColumn(out, python_column(begin, F.col("text"), "struct<severity:double,grade:int>"))
    return judged.withColumns({"severity": F.col(f"{out}.severity"), "grade": F.col(f"{out}.grade")}).drop(out).withColumn("toxic", F.col("severity") >= rules.toxic_from)


def op3_ordinal_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return severity(docs, model).select("doc_id", "severity", "grade", "toxic")
