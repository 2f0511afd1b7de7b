"""Toxicity classifier with counterfactual regularisation (operator 6).

A logistic model over the distinct words, and beginnings of words, of a whole text. It is fitted on a
bounded sample of labelled rows: the ``TRAIN_ROWS`` rows with the smallest hash of
their identifier, of those that may be learnt from. Besides the log-loss and an
L1 term (which leaves out chance words) the loss has a counterfactual term: in
every labelled text that names a group, the identity terms are swapped for others
of their kind, and the squared change of the logit is penalised. A word that only
names a group so cannot raise the score, while the other words explain the label.

The fitted model (at most ``MAX_WORDS`` words and the identity terms) is broadcast;
scoring is one pass over all documents without a shuffle.

Defined results: null and empty texts get the score of a text without known words, which is not
toxic while fewer than half of the labelled rows are (the share of toxic rows, if the fit leaves
it at one half or more); labels that are null are ignored, repeated labels count each; without labelled rows
every score is 0; ties in the sample are taken by identifier.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

TRAIN_ROWS = 40_000
MAX_WORDS = 4_096
#: Texts whose words are counted together in a task.
COUNT_ROWS = 2_000
MIN_ROWS = 5
#: L1 penalty: this, or the weight of ``L1_ROWS`` positive rows where that is more, so that
#: a feature seen with fewer toxic texts stays out.
L1 = 1e-3
L1_ROWS = 3
#: Steps of the fit and share of the L1 penalty: over all features, and over the chosen ones.
STEPS = ((150, 1.0), (1500, 0.2))
#: Lengths of the beginnings of words: shorter ones are shared by too many clean words.
STEMS = (6, 7, 8)
COUNTERFACTUAL = 1.0
WORD = re.compile(r"[^\W\d_]+")
#: Terms that name a group, by kind.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys", "transgender"],
    ["woman", "man", "girl", "boy"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual"],
    ["immigrants", "refugees", "natives", "foreigners"],
    ["disabled", "blind", "deaf"],
    ["old", "young", "elderly"],
]
KIND = {term: i for i, terms in enumerate(IDENTITY_TERMS) for term in terms}


def features_of(text: str) -> set[str]:
    """The distinct words, and their beginnings (marked ``*``), which inflected forms
    share; an identity term is a feature of its own and has no beginnings."""
    words = set(WORD.findall(text.lower()))
    out = set(words)
    for n in STEMS:
        out.update([w[:n] + "*" for w in words if len(w) > n and w not in KIND])
    return out


def swapped(words: Iterable[str]) -> list[set[str]]:
    """The word set with every identity term moved on by one, two, ... in its kind."""
    present = [w for w in words if w in KIND]
    if not present:
        return []
    rest = set(words) - set(present)
    out = []
    for step in range(1, max(len(IDENTITY_TERMS[KIND[w]]) for w in present)):
        terms = [(IDENTITY_TERMS[KIND[w]], IDENTITY_TERMS[KIND[w]].index(w)) for w in present]
        out.append(rest | {t[(i + step) % len(t)] for t, i in terms})
    return out


@dataclass
class ToxicityModel:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    empty: bool = False

    def logit(self, words: set[str]) -> float:
        return self.bias + sum(sorted(self.weights[w] for w in words & self.weights.keys()))

    def score(self, text: str) -> float:
        if self.empty:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.logit(features_of(text)), -30, 30))))


class _Rows:
    """A sparse 0/1 matrix of feature sets, worked on a block of rows at a time."""

    BLOCK = 2_000

    def __init__(self, sets: Sequence[Iterable[str]], index: dict[str, int]):
        self.n, self.width = len(sets), len(index)
        cols = [np.asarray(sorted(index[w] for w in s if w in index), dtype=np.int32) for s in sets]
        self.size = np.asarray([len(c) for c in cols], dtype=np.int64)
        self.blocks = [(a, np.concatenate(cols[a:a + self.BLOCK])) for a in range(0, self.n, self.BLOCK)]

    def _rows(self, a: int) -> np.ndarray:
        size = self.size[a:a + self.BLOCK]
        return np.repeat(np.arange(len(size)), size)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0), *(
            np.bincount(self._rows(a), weights=w[col], minlength=len(self.size[a:a + self.BLOCK]))
            for a, col in self.blocks)])

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for a, col in self.blocks:
            out += np.bincount(col, weights=r[a + self._rows(a)], minlength=self.width)
        return out


def _descend(sets, pairs, words, y, weight, counterfactual, l1, steps) -> tuple[np.ndarray, float]:
    """Weights of ``words`` and the bias: proximal gradient steps with momentum, each
    coordinate with its own bound on the curvature (a row of s features adds at most
    s + 1 times its own share)."""
    index = {w: i for i, w in enumerate(words)}
    x = _Rows(sets, index)
    left, right = _Rows([p[0] for p in pairs], index), _Rows([p[1] for p in pairs], index)
    pull = 2 * counterfactual / max(1, left.n)
    # the two sides of a pair differ in their identity terms only
    bound = x.back(0.25 * weight * (x.size + 1)) + 2 * len(KIND) * pull * (
        left.back(np.ones(left.n)) + right.back(np.ones(right.n)))
    step, step_b = 1 / np.maximum(bound, 1e-9), 1 / (0.25 * weight @ (x.size + 1))
    w, b = np.zeros(len(index)), 0.0
    vw, vb, t = w, b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.dot(vw) + vb, -30, 30)))
        r = (p - y) * weight
        g = x.back(r)
        if pairs:
            change = left.dot(vw) - right.dot(vw)
            g = g + pull * (left.back(change) - right.back(change))
        new = vw - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b = vb - step_b * r.sum()
        if (vw - new) @ ((new - w) / step) + (vb - new_b) * (new_b - b) / step_b > 0:
            t = 1.0  # the momentum leads uphill: start it again
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, b


def fit(sets: Sequence[Iterable[str]], labels: list[int],
        counterfactual: float = COUNTERFACTUAL) -> ToxicityModel:
    """Fit on the feature sets of texts: first all features, then those that have a
    weight by then, to the end."""
    y = np.asarray(labels, dtype=float)
    if not len(y):
        return ToxicityModel(empty=True)
    positive = share = y.mean()
    # both classes weigh the same
    weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / len(y)
    l1 = max(L1, L1_ROWS * 0.5 / max(y.sum(), 1))
    pairs = [(s, c) for s in sets for c in swapped(s)]
    words, w, b = sorted(set().union(*sets, *(c for _, c in pairs))), None, 0.0
    for steps, share in STEPS:
        w, b = _descend(sets, pairs, words, y, weight, counterfactual, l1 * share, steps)
        words, w = zip(*[(v, u) for v, u in zip(words, w) if u]) if w.any() else ((), w[:0])
        if not words:
            break
    if b > -1e-6 and positive < 0.5:
        # no evidence is none: what the classes' equal weight leaves open, their rows decide
        b = np.log(max(positive, 1e-9) / (1 - positive))
    return ToxicityModel(float(b), {v: float(u) for v, u in zip(words, w)})


def bucket(column: str = "doc_id") -> Column:
    """crc32 of the identifier as text, mod 5 (a null identifier: empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 5


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on the bounded sample: labelled rows whose bucket is not 0.

    The sample's words are counted by Spark; the driver gets the chosen words, and
    those of them that each sampled text holds. Of a repeated identifier, the smallest text
    is learnt from, so the sample has no more rows than labels were chosen.
    """
    chosen = (labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null")
              .where(bucket() != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows))
    texts = docs.select("doc_id", text_of().alias("_text"))
    sample = written(texts.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"), "_text"), "labelled")
    labels_held = chosen.join(sample.select("doc_id").distinct(), "doc_id", "left_semi").count()
    if sample.count() > labels_held:
        # identifiers repeat: only then their texts are brought together
        first = sample.groupBy("doc_id").agg(F.min("_text").alias("_text"))
        sample = written(first.join(F.broadcast(chosen), "doc_id").select(
            "doc_id", F.col("toxic").cast("int").alias("toxic"), "_text"), "labelled")
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = positive / max(n, 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), COUNT_ROWS):
                part, seen, hits = batch[begin:begin + COUNT_ROWS], Counter(), Counter()
                for text, label in zip(part["_text"], part["toxic"]):
                    words = features_of(text)
                    seen.update(words)
                    if label:
                        hits.update(words)
                yield pd.DataFrame({"word": list(seen), "seen": list(seen.values()),
                                    "hits": [hits[w] for w in seen]})

    counts = sample.mapInPandas(count, "word string, seen long, hits long").groupBy("word").agg(
        F.sum("seen").alias("seen"), F.sum("hits").alias("hits")).where(F.col("seen") >= MIN_ROWS)
    off = F.col("hits") - F.col("seen") * share  # chi-square of a word's rows against the label
    words = [r[0] for r in counts.orderBy((off * off / F.col("seen")).desc(), "word")
             .limit(MAX_WORDS).select("word").collect()]
    names = sorted({*words, *KIND})
    place = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(names)})

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = place.value
        for batch in batches:
            out = batch[["doc_id", "toxic"]].copy()
            out["features"] = [np.asarray(sorted(known[w] for w in features_of(t) & known.keys()),
                                          dtype="<i4").tobytes() for t in batch["_text"]]
            yield out

    # four bytes a feature on the way to the driver; there, names are shared
    got = [tuple(r) for r in sample.mapInPandas(
        reduce, "doc_id long, toxic int, features binary").toLocalIterator()]
    got.sort()  # the same sums in every run
    return fit([tuple(names[i] for i in np.frombuffer(f, "<i4")) for _, _, f in got],
               [toxic for _, toxic, _ in got])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(asdict(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = ToxicityModel(**shared.value)
        for batch in batches:
            out = batch[["doc_id", "held_out"]].copy()
            out["score"] = [own.score(t) for t in batch["_text"]]
            out["predicted"] = (out["score"] >= 0.5).astype("int32")
            yield out

    return docs.select("doc_id", (bucket() == 0).alias("held_out"), text_of().alias("_text")) \
        .mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(asdict(model))

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        own = ToxicityModel(**shared.value)
        return text.map(lambda t: own.score(t or "") < 0.5).astype(bool)

    return docs.where(clean(F.col("text").cast("string")))
