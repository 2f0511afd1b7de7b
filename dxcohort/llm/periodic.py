"""Periodic run detection by an online sparse diagonal DP (operator 11).

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are the same) of
at least ``max(least, times * q)`` words that no neighbouring word extends. Seen as a
matrix of word against earlier word, it is a diagonal at lag ``q`` of matches.

Words are read in order. Each looks up where its block of ``w`` words (it and the next
ones) stood before; that occurrence increments the match length of the active lag, and when a
lag ends, its diagonal is emitted at once if it is long enough. Blocks, not single words,
keep the matrix sparse without losing a run: a run of period ``q`` matches at lag ``q`` for
at least ``max(least - q, (times - 1) * q)`` words, so

* all periods up to ``w`` (16 for the defaults) are found with blocks of ``w`` words, and
* periods in ``(w / 2, w]`` with blocks of ``w`` words, for each doubled ``w``.

And of a block's earlier occurrences only the nearest counts: if a nearer one, at lag
``d < q <= w``, lay on the way, the ``w + d >= q + d`` words there would have the periods ``d``
and ``q``, hence ``gcd(d, q)`` (Fine and Wilf), and ``q`` would not be the smallest. So one
lag is active at a time on each level, a diagonal of nearest occurrences is maximal by
itself, and a text of ``n`` words takes ``O(n log n)`` for each of at most ``log n`` levels,
whatever its repetitions. Blocks are told apart by exact names (the pair of the names of
their halves), not by hashes. Levels end where no block occurs twice: for most texts at
blocks of two or four words.

Documents are independent: one pass, no shuffle, memory in proportion to the longest text.

Defined results: null and empty texts have no words and no runs; white space between kept
words becomes one space; repeated rows and rows with a null ``doc_id`` are documents of their
own; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

LEAST = 24
TIMES = 3

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = "array<struct<start: long, length: long, period: long>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def first_block(least: int, times: int) -> int:
    """The largest power of two ``w`` such that runs of all periods up to ``w`` match for
    at least ``w`` words."""
    w = 1
    while all(max(least - q, (times - 1) * q) >= 2 * w for q in range(1, 2 * w + 1)):
        w *= 2
    return w


def doubled(names: np.ndarray, w: int) -> np.ndarray:
    """Names of the blocks of ``2 w`` words from those of ``w`` words; -1 where a block
    occurs once only (no larger one that begins there can occur twice)."""
    out = np.full(len(names), -1, np.int64)
    if len(names) > w:
        at = np.flatnonzero((names[:-w] >= 0) & (names[w:] >= 0))
        _, name, count = np.unique(names[at] * np.int64(len(names)) + names[at + w],
                                   return_inverse=True, return_counts=True)
        again = count[name] > 1
        out[at[again]] = name[again]
    return out


def nearest(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose block stood before, in order, and the lag to its last occurrence."""
    at = np.flatnonzero(names >= 0)
    order = at[np.argsort(names[at], kind="stable")]
    same = names[order[1:]] == names[order[:-1]]
    place, lag = order[1:][same], (order[1:] - order[:-1])[same]
    in_order = np.argsort(place)
    return place[in_order], lag[in_order]


def diagonals(place: np.ndarray, lag: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """First place, matches and lag of each stretch of places in a row at one lag."""
    ends = np.flatnonzero((np.diff(place) != 1) | (np.diff(lag) != 0)) + 1
    for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(place)]):
        if a < b:
            yield int(place[a]), b - a, int(lag[a])


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbered words, by start, then period."""
    if times < 3:
        raise ValueError("times must be 3 or more")
    base, n = first_block(least, times), len(words)
    found, names, w = [], words, 1
    while True:
        low = 0 if w <= base else w // 2  # this level's periods: low < q <= w
        if n < max(least, times * (low + 1)) or not (names >= 0).any():
            return sorted(found, key=lambda r: (r[0], r[2]))
        if w >= base:
            place, lag = nearest(names)
            mine = (lag > low) & (lag <= w)
            for first, matches, q in diagonals(place[mine], lag[mine]):
                length = q + matches + w - 1
                if length >= max(least, times * q):
                    found.append((first - q, length, q))
        names, w = doubled(names, w), 2 * w


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run is cut to its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period), collapsed: the
    text with every run cut to its first period, words joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, all_runs, texts = [], [], []
            for text in batch.column("_text").to_pylist():
                words = text.encode("utf-8").split()  # ASCII white space only
                runs = runs_of(numbered(words), least, times)
                if runs:
                    stay = np.flatnonzero(kept_words(len(words), runs)).tolist()
                    kept = [words[i] for i in stay]
                else:
                    kept = words
                sizes.append(len(words))
                all_runs.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(b" ".join(kept).decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(all_runs, pa.list_(_RUN)), pa.array(texts, pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("_text")).mapInArrow(
        detect, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length / period (compared exactly; ties: smallest
    start, then period), runs_sha256, collapsed_sha256."""
    best = F.expr("""aggregate(runs, cast(null as struct<start: long, length: long, period: long>),
        (a, b) -> if(a is null or b.length * a.period > a.length * b.period, b, a))""")
    listed = F.expr("concat_ws('', transform(runs, r -> concat("
                    "cast(r.start as string), ',', cast(r.length as string), ',', "
                    "cast(r.period as string), '\\n')))")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def repeated_words(doc_id: str, words: list[bytes]) -> list[bytes]:
    """The query's planted repetitions: for one id in ten, the words from some place on
    repeat the first ones from there."""
    h, n = crc32(doc_id.encode("ascii")), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a:a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[:n - a]


def with_repetitions(docs: DataFrame) -> DataFrame:
    """doc_id, text with ``repeated_words`` applied (rows without an id stay as they are)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if i is None or crc32(str(i).encode("ascii")) % 10 else
                     b" ".join(repeated_words(str(i), t.encode("utf-8").split())).decode("utf-8")
                     for i, t in zip(batch.column("doc_id").to_pylist(),
                                     batch.column("_text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())],
                                             schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("_text")).mapInArrow(
        plant, "doc_id long, text string")
