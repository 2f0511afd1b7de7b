"""Quality classifier by co-training (operator 5).

Two views of a document are learnt apart: its **content** (measures of its words) and
its **page metadata** (language, source, size and layout of the page: lines, repeated
lines, markup-like characters). Each view is a logistic model over binned measures.
Over ``ROUNDS`` rounds each view labels the documents of an unlabelled pool that it is
surest of, in the shares of the labelled classes, and hands them to the *other* view,
which is then fitted again. At the end each view is calibrated on labelled rows that
neither has learnt from (a logistic curve over its logit), the calibrated logits are
combined by a third logistic fit on the same rows, and all documents are scored in one
pass without a shuffle.

Fitting uses bounded samples: at most ``LABELLED`` labelled rows and a pool of at most
``POOL`` unlabelled ones (those with the smallest hash of their identifier). Rows with
``crc32(doc_id as text) mod 5 = 0`` are never learnt from and ``= 1`` calibrate.

Defined results: null and empty texts have all measures 0; null metadata is a value of its
own; null labels are ignored; without labelled rows every score is 0.5; ties are
taken by identifier.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

LABELLED = 20_000
POOL = 20_000
ROUNDS = 3
#: Share of the pool that a view hands over in a round.
SHARE = 0.1
BINS = 12
BUCKETS = 32
RIDGE = 1.0
MARKUP = "%#$&*|!{}<>=@_~^\\"


def content(text: str) -> list[float]:
    """Measures of the words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 9
    seen = Counter(words)
    return [log1p(n), len(seen) / n, sum(map(len, words)) / n,
            sum(map(str.isalpha, words)) / n, sum(map(str.isupper, words)) / n,
            sum(map(str.istitle, words)) / n, max(seen.values()) / n,
            sum(len(w) > 20 for w in seen) / len(seen),
            sum(c > 1 for c in seen.values()) / len(seen)]


def layout(text: str, n_chars) -> list[float]:
    """Measures of the page."""
    lines = text.split("\n")
    size = max(1, len(text))
    return [log1p(max(0, n_chars)) if n_chars == n_chars and n_chars is not None else -1.0,
            log1p(len(lines)), size / len(lines), 1 - len(set(lines)) / len(lines),
            sum(map(text.count, MARKUP)) / size, sum(map(text.count, "0123456789")) / size,
            text.count(".") / size]


def bucket_of(value: str | None) -> int:
    return BUCKETS if value is None else zlib.crc32(value.encode()) % BUCKETS


class View:
    """A logistic model over binned measures and hashed categories."""

    def __init__(self, measures: np.ndarray, categories: np.ndarray):
        marks = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(m, marks)) for m in measures.T]
        self.categories = categories.shape[1]
        self.weights = np.zeros(self._width() + 1)

    def _width(self) -> int:
        return sum(len(e) + 1 for e in self.edges) + self.categories * (BUCKETS + 1)

    def matrix(self, measures: np.ndarray, categories: np.ndarray) -> np.ndarray:
        """Columns that are 1 in each row: one for each measure and category, and the bias."""
        at, out = 0, []
        for edges, m in zip(self.edges, measures.T):
            out.append(at + np.searchsorted(edges, m, side="right"))
            at += len(edges) + 1
        for c in categories.T:
            out.append(at + c)
            at += BUCKETS + 1
        out.append(np.full(len(measures), at))
        return np.stack(out, axis=1).astype(np.int64)

    def fit(self, columns: np.ndarray, y: np.ndarray) -> None:
        """Newton steps of the ridge-penalised logistic loss, classes weighing the same."""
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        row_weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        width = len(self.weights)
        x = np.zeros((len(y), width), dtype=np.float32)
        np.put_along_axis(x, columns, 1, axis=1)
        w = np.zeros(width)
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (row_weight * (p - y)) + RIDGE * w
            h = (x * (row_weight * np.maximum(p * (1 - p), 1e-4))[:, None].astype(np.float32)).T @ x
            w = w - np.linalg.solve(h.astype(float) + RIDGE * np.eye(width), g)
        self.weights = w

    def logit(self, columns: np.ndarray) -> np.ndarray:
        return self.weights[columns].sum(axis=1)


def logistic(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (bias last) of a logistic fit of y on the columns of z."""
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x
        w = w - np.linalg.solve(h + 1e-2 * np.eye(len(w)), x.T @ (p - y) + 1e-2 * w)
    return w


def trust(view: View, columns: np.ndarray, y: np.ndarray) -> float:
    """How far a view's labels deserve to be taken: the square of its balanced accuracy
    over chance, each half of the labelled rows judged by a fit on the other."""
    kept, right = view.weights, np.zeros(len(y), dtype=bool)
    half = np.arange(len(y)) % 2 == 0
    for own in (half, ~half):
        if len(set(y[own])) < 2:
            return 0.0
        view.fit(columns[own], y[own])
        right[~own] = (view.logit(columns[~own]) > 0) == (y[~own] == 1)
    view.weights = kept
    balanced = (right[y == 1].mean() + right[y == 0].mean()) / 2
    return max(0.0, 2 * balanced - 1) ** 2


def co_train(views: list[View], labelled: list[np.ndarray], y: np.ndarray,
             pool: list[np.ndarray], rounds: int = ROUNDS, share: float = SHARE) -> None:
    """Fit two views; ``labelled`` and ``pool`` hold each view's columns of the same rows.

    A view that does little better than chance on labelled rows hands over little.
    """
    shares = [share * trust(view, own, y) for view, own in zip(views, labelled)]
    given: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, int), np.empty(0)) for _ in views]
    free = np.ones(len(pool[0]), dtype=bool)
    for turn in range(rounds + 1):
        for view, own, theirs, (rows, labels) in zip(views, labelled, pool, given):
            view.fit(np.concatenate([own, theirs[rows]]), np.concatenate([y, labels]))
        if turn == rounds or not free.any():
            break
        for i, view in enumerate(views):
            z = view.logit(pool[i])
            left = np.flatnonzero(free)
            left = left[np.argsort(z[left], kind="stable")]
            take = min(len(left), int(shares[i] * len(free)))
            low = min(take, int(round(take * (1 - y.mean()))))
            bad, good = left[:low], left[len(left) - (take - low):]
            rows, labels = given[1 - i]
            given[1 - i] = (np.concatenate([rows, bad, good]),
                            np.concatenate([labels, np.zeros(len(bad)), np.ones(len(good))]))
            free[bad] = free[good] = False


class QualityModel:
    """Two calibrated views and their combination."""

    def __init__(self, views: list[View], calibration: list[np.ndarray], mix: np.ndarray):
        self.views, self.calibration, self.mix = views, calibration, mix

    def logits(self, measures: list[np.ndarray], categories: list[np.ndarray]) -> np.ndarray:
        """Calibrated logit of each view, and the combined one."""
        z = [v.logit(v.matrix(m, c)) * k[0] + k[1] for v, m, c, k in
             zip(self.views, measures, categories, self.calibration)]
        return np.column_stack([*z, np.column_stack([*z, np.ones(len(z[0]))]) @ self.mix])


def measures_of(batch: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    texts = batch["_text"].tolist()
    words = np.asarray([content(t) for t in texts], dtype=float).reshape(-1, 9)
    page = np.asarray([layout(t, n) for t, n in zip(texts, batch["n_chars"].tolist())],
                      dtype=float).reshape(-1, 7)
    kinds = np.asarray([(bucket_of(a if isinstance(a, str) else None),
                         bucket_of(b if isinstance(b, str) else None))
                        for a, b in zip(batch["lang"], batch["source"])], dtype=int).reshape(-1, 2)
    return [words, page], [np.empty((len(texts), 0), dtype=int), kinds]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", "source", "n_chars", text_of().alias("_text"))


def _sample(docs: DataFrame, ids: DataFrame) -> pd.DataFrame:
    """The measures (not the texts) of some documents, one row for each identifier (of a
    repeated one, the smallest measures)."""
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            (words, page), (_, kinds) = measures_of(batch)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"],
                                "words": list(words), "page": list(page), "kinds": list(kinds)})

    measured = _columns(docs).join(F.broadcast(ids), "doc_id").mapInPandas(
        measure, "doc_id long, quality int, words array<double>, page array<double>, kinds array<long>")
    single = measured.groupBy("doc_id", "quality").agg(
        F.min(F.struct("words", "page", "kinds")).alias("_m")).select("doc_id", "quality", "_m.*")
    return single.toPandas().sort_values("doc_id", kind="stable")


def train(docs: DataFrame, labels: DataFrame) -> QualityModel | None:
    bucket = F.crc32(F.col("doc_id").cast("string")) % 5
    marked = labels.where("doc_id is not null and quality is not null")
    known = marked.where(bucket != 0).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    blank = docs.where("doc_id is not null").where(bucket != 0).select("doc_id").join(
        marked.select("doc_id").distinct(), "doc_id", "left_anti").distinct() \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(POOL).withColumn("quality", F.lit(-1))
    rows = _sample(docs, known.unionByName(blank))
    y = rows["quality"].to_numpy()
    part = np.asarray([zlib.crc32(str(i).encode()) % 5 for i in rows["doc_id"]])
    fit, cal, pool = (y >= 0) & (part != 1), (y >= 0) & (part == 1), y < 0
    if len(set(y[fit])) < 2 or len(set(y[cal])) < 2:
        return None
    measures = [np.stack(rows[c].to_numpy()) for c in ("words", "page")]
    kinds = np.stack(rows["kinds"].to_numpy()).astype(int)
    categories = [np.empty((len(rows), 0), dtype=int), kinds]
    views = [View(m, c) for m, c in zip(measures, categories)]
    columns = [v.matrix(m, c) for v, m, c in zip(views, measures, categories)]
    co_train(views, [c[fit] for c in columns], y[fit].astype(float), [c[pool] for c in columns])
    logits = [v.logit(c[cal]) for v, c in zip(views, columns)]
    curves = [logistic(z[:, None], y[cal]) for z in logits]
    calibrated = np.column_stack([z * k[0] + k[1] for z, k in zip(logits, curves)])
    return QualityModel(views, curves, logistic(calibrated, y[cal]))


def quality_scores(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id, content_score, metadata_score, score, predicted (1: keep) of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if model is None:
                p = np.full((len(batch), 3), 0.5)
            else:
                p = 1 / (1 + np.exp(-np.clip(model.logits(*measures_of(batch)), -30, 30)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "content_score": p[:, 0],
                                "metadata_score": p[:, 1], "score": p[:, 2],
                                "predicted": (p[:, 2] >= 0.5).astype("int32")})

    return _columns(docs).mapInPandas(
        run, "doc_id long, content_score double, metadata_score double, score double, predicted int")
