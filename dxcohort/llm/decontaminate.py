"""Benchmark decontamination by pigeonhole edit matching (operator 7).

A test item of ``m`` characters may differ from a passage of a document by up to
``k = floor(MAX_ERROR_RATE * m)`` edits. It is split into ``k + 1`` pieces, of which
at least one then stands unchanged in the passage. An Aho-Corasick automaton
of all pieces finds every exact piece hit in one pass over the whole document; the
window around each hit is verified by Myers' bit-parallel edit distance, which
also gives the passage's end, and, run backwards, its start.

Such short pieces hit often, so a lossless count goes before. Cut into ``k + t`` pieces of
``q`` characters, an item has at least ``t`` that stand unchanged in a passage, and
their shifts (place in the text less place in the item) differ by ``k`` at most. And ``k``
edits spoil at most ``k r`` of the item's ``m - r + 1`` runs of ``r`` characters, a run that
occurs several times counting as often as both have it. Items without ``t`` hits of
neighbouring shifts in a document, or without the other runs near them, are not sought
in it, and the others only there.

Texts are compared as lower-case words joined by one blank. The items are a stated
query set: they are read in blocks of at most ``BLOCK_CHARS`` characters, each block
is broadcast and all documents pass it; no shuffle.

Defined results: null and empty texts have no passage; items without a word are
ignored; items so short that they have no edit budget (under 7 characters at 15 %) are found
as whole words only; texts of any length are searched as a whole; repeated items are found each; of overlapping passages of an item the
one with the fewest edits counts, then the first; an empty benchmark finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Most copies with two words dropped, swapped or replaced are within it (README).
MAX_ERROR_RATE = 0.15
BLOCK_CHARS = 2_000_000
WORD = re.compile(r"\w+")
#: Shifts of a cell, in which piece hits are counted, and (cell, item) counters at a time.
CELL = 16
COUNTERS = 100_000
#: Characters of documents that are counted together (a longer document alone).
GROUP_CHARS = 250_000
SPANS = "doc_id long, item_id long, distance int, max_distance int, start long, end long"


def normalise(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def budget(length: int, rate: float = MAX_ERROR_RATE) -> int:
    return int(rate * length)


def cut(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces (offset, text) of nearly the same length."""
    n = len(item)
    ends = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:])]


def myers(pattern: str, text: str, anchored: bool = False) -> list[int]:
    """For every end in ``text``: the least edits of ``pattern`` to a passage that ends
    there (``anchored``: to the whole text up to there)."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, out = mask, 0, m, []
    carry = 1 if anchored else 0
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | carry) & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        out.append(score)
    return out


def best_passage(item: str, window: str, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best passage in ``window``, if within ``k`` edits."""
    ends = myers(item, window)
    edits = min(ends, default=k + 1)
    if edits > k:
        return None
    end = ends.index(edits) + 1
    back = myers(item[::-1], window[:end][::-1], anchored=True)
    start = end - (back.index(edits) + 1)
    return edits, start, end


def whole_words(item: str, text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Places of ``item`` between ``low`` and ``high`` that begin and end with words."""
    while (at := text.find(item, low, high)) >= 0:
        low = at + len(item)
        if text[at - 1:at] in ("", " ") and text[low:low + 1] in ("", " "):
            yield at, low
        else:
            low = at + 1


class PieceCounts:
    """Tells which items may have a passage in which texts, by hits of equal pieces."""

    def __init__(self, items: list[tuple[int, str, int]], rate: float):
        self.q = min(max(int(0.75 / rate), 2), 16) if rate > 0 else 16
        k = np.asarray([k for *_, k in items], np.int64)
        self.budgets = k.tolist()
        self.sizes = [len(text) for _, text, _ in items]
        self.r = max(self.q - 1, 1)
        self.least = np.asarray(self.sizes, np.int64) // self.q - k
        self.slack = int(k.max(initial=0))
        #: cells that the shifts of a passage can touch; items are counted in its order
        self.cells = (k - 1) // CELL + 2
        self.order = np.argsort(self.cells, kind="stable")
        column = np.empty(len(items), np.int32)
        column[self.order] = np.arange(len(items))
        self.bits = max(16, 4 + sum(len(text) // self.q for _, text, _ in items).bit_length())
        self.runs = [np.unique(self._hashes(text, self.r), return_counts=True) for _, text, _ in items]
        pieces = [self._hashes(text, self.q)[::self.q] for _, text, _ in items]
        hashed = np.concatenate([*pieces, np.empty(0, np.int64)]).astype(np.int64)
        ordered = np.argsort(hashed, kind="stable")
        self.owner = np.repeat(column, [len(p) for p in pieces])[ordered]
        place = np.concatenate([*(np.arange(len(p)) * self.q for p in pieces), np.empty(0, np.int64)])
        self.place = place.astype(np.int32)[ordered]
        self.reach = int(self.place.max(initial=0))
        self.first = np.searchsorted(hashed[ordered], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _hashes(self, text: str, size: int) -> np.ndarray:
        """A number of ``bits`` bits for the ``size`` characters from each place on."""
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = max(len(chars) - size + 1, 0)
        h = np.zeros(n, np.uint64)
        for i in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + chars[i:i + n] + np.uint64(1)
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def possible(self, texts: list[str]) -> list[dict[int, list[tuple[int, int]]]]:
        """Per text, the items that may have a passage in it, and where. Pieces that share a number count
        as equal, and hits beyond a text's end as its own: that only adds items."""
        always = np.flatnonzero(self.least <= 0).tolist()
        out = [{i: [(0, len(text))] for i in always} for text in texts]
        near: dict[tuple[int, int], list[int]] = {}
        counted = np.flatnonzero(self.least > 0)
        if not len(counted) or not texts:
            return out
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        joined = "\0".join(texts)
        hashes = self._hashes(joined, self.q)
        items, most = len(self.least), int(self.cells[counted].max())
        # columns of the items that touch as many cells, which more hits suffice for (all, if none does)
        cells, least = self.cells[self.order], self.least[self.order]
        enough = np.where(least > 0, least, np.iinfo(np.int32).max).astype(np.int32)
        top = int(self.least.max())
        counter = np.uint8 if top * most < 256 else np.int32
        groups = [(int(n), *np.searchsorted(cells, [n, n + 1]).tolist()) for n in np.unique(cells)]
        step = max(COUNTERS // items, most, self.reach // CELL)
        for low in range(-self.reach - CELL, len(hashes), step * CELL):
            # the shifts from low on, of this step's cells and those that may follow
            rows = step + most
            begin = max(low, 0)
            part = hashes[begin:max(low + rows * CELL + self.reach, 0)]
            first = self.first[part]
            number = self.first[part + 1] - first
            hit = np.flatnonzero(number).astype(np.int32)
            first, number = first[hit], number[hit]
            ends = np.cumsum(number, dtype=np.int32)
            at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
            at += np.repeat(first - (ends - number), number)
            shifts = np.repeat(hit + np.int32(begin - low), number)
            shifts -= self.place[at]
            cell = shifts // np.int32(CELL)
            inside = (cell >= 0) & (cell < rows)
            table = np.bincount(cell[inside] * np.int32(items) + self.owner[at[inside]],
                                minlength=rows * items)
            # more hits than any item needs count as that many
            table = np.minimum(table, top).astype(counter).reshape(rows, items)
            for n, left, right in groups:
                shared = table[:step, left:right].copy()
                for i in range(1, n):
                    shared += table[i:i + step, left:right]
                found = np.flatnonzero(shared >= enough[left:right])
                found, item = np.divmod(found, max(right - left, 1))
                shift = low + found * CELL
                from_ = np.searchsorted(starts, np.maximum(shift - self.slack, 0), "right") - 1
                to = np.searchsorted(starts, shift + n * CELL + self.slack, "right")
                same = self.order[left:right]
                for a, b, c, i in zip(from_.tolist(), to.tolist(), shift.tolist(), same[item].tolist()):
                    for d in range(a, min(b, len(texts))):
                        near.setdefault((d, i), []).append(c)
        runs = self._hashes(joined, self.r)
        for (d, i), shifts in near.items():
            begin, end = int(starts[d]), int(starts[d + 1]) - 1
            for low, high in self._near(runs, i, shifts, begin, end):
                out[d].setdefault(i, []).append((low - begin, high - begin))
        return out

    def _near(self, hashes: np.ndarray, i: int, shifts: list[int], begin: int, end: int
              ) -> Iterator[tuple[int, int]]:
        """Places from ``begin`` to ``end`` around the shifts, overlapping ones joined, that
        share enough runs."""
        m, k = self.sizes[i], self.budgets[i]
        least = m - self.r + 1 - k * self.r
        after = int(self.cells[i]) * CELL + m + 2 * k
        regions: list[tuple[int, int]] = []
        for shift in sorted(shifts):
            low, high = max(shift - k, begin), min(shift + after, end)
            if regions and low <= regions[-1][1]:
                regions[-1] = (regions[-1][0], max(high, regions[-1][1]))
            elif low < high:
                regions.append((low, high))
        for region in regions:
            kept = [(low, high) for low, high in self._overlapping(*region, m + k)
                    if least <= 0 or self._shared(hashes[low:high], i) >= least]
            while kept:
                low, high = kept.pop(0)
                while kept and kept[0][0] <= high:
                    high = kept.pop(0)[1]
                yield low, high

    @staticmethod
    def _overlapping(low: int, high: int, longest: int) -> Iterator[tuple[int, int]]:
        """Parts of a region, each passage of at most ``longest`` characters whole in one."""
        while high - low > 3 * longest:
            yield low, low + 2 * longest
            low += longest
        yield low, high

    def _shared(self, hashes: np.ndarray, i: int) -> int:
        """Runs that the item and a part of the text have in common, each as often as both."""
        runs, times = self.runs[i]
        at = np.minimum(np.searchsorted(runs, hashes), len(runs) - 1)
        return int(np.minimum(np.bincount(at[runs[at] == hashes], minlength=len(runs)), times).sum())


class Matcher:
    """Finds the passages of a block of items in a document."""

    def __init__(self, items: list[tuple[int, str]], rate: float = MAX_ERROR_RATE):
        import ahocorasick
        self.items = [(item_id, text, budget(len(text), rate)) for item_id, text in items if text]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, k) in enumerate(self.items):
            for offset, piece in cut(text, k):
                places.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.counts = PieceCounts(self.items, rate)

    def windows(self, text: str, among: dict[int, list[tuple[int, int]]] | None = None
                ) -> Iterator[tuple[int, int, int]]:
        """(item, start, end): windows around piece hits, overlapping ones joined; of all items,
        or those ``among``, within the places where alone a passage can be."""
        whole = [(0, len(text))]
        anywhere = {i for i, places in among.items() if places == whole} if among is not None else None
        if anywhere is None or anywhere:
            yield from self._joined(text, 0, len(text), anywhere)
        for i, places in (among or {}).items():
            if i not in anywhere:
                for low, high in places:
                    yield from self._joined(text, low, high, {i})

    def _joined(self, text: str, first: int, last: int, only: set[int] | None
                ) -> Iterator[tuple[int, int, int]]:
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text, first, last):
            for i, offset in where:
                if only is not None and i not in only:
                    continue
                _, item, k = self.items[i]
                begin = end + 1 - size - offset
                spans.setdefault(i, []).append((max(first, begin - k), min(last, begin + len(item) + k)))
        for i, found in spans.items():
            found.sort()
            low, high = found[0]
            for a, b in found[1:]:
                if a > high:
                    yield i, low, high
                    low, high = a, b
                else:
                    high = max(high, b)
            yield i, low, high

    def passages_of(self, texts: list[str]) -> Iterator[Iterator[tuple[int, int, int, int, int]]]:
        """The passages of each normalised text."""
        group, size = [], 0
        for text in [*texts, None]:
            if group and (text is None or size + len(text) > GROUP_CHARS):
                for one, among in zip(group, self.counts.possible(group)):
                    yield self.passages(one, among)
                group, size = [], 0
            if text is not None:
                group.append(text)
                size += len(text)

    def passages(self, text: str, among: dict[int, list[tuple[int, int]]] | None = None
                 ) -> Iterator[tuple[int, int, int, int, int]]:
        """(item_id, edits, budget, start, end) in the normalised text, of all items or ``among``."""
        if not self.items or not text or among is not None and not among:
            return
        for i, low, high in self.windows(text, among):
            item_id, item, k = self.items[i]
            todo = [(low, high)] if k else []
            for a, b in whole_words(item, text, low, high) if not k else ():
                yield item_id, 0, k, a, b
            while todo:  # the best passage, then what lies before and after it
                a, b = todo.pop()
                best = best_passage(item, text[a:b], k) if b - a >= len(item) - k else None
                if best:
                    edits, start, end = best
                    yield item_id, edits, k, a + start, a + end
                    todo += [(a, a + start), (a + end, b)]


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The normalised items, a block at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", text_of().alias("t")).toLocalIterator():
        text = normalise(row["t"])
        if size and size + len(text) > chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    yield block


def contaminated_spans(docs: DataFrame, benchmark: DataFrame,
                       rate: float = MAX_ERROR_RATE) -> DataFrame:
    """One row for every passage: doc_id, item_id, distance, max_distance, start, end
    (characters of the normalised text)."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_of().alias("_text"))
    out = None
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                texts = [normalise(text) for text in batch["_text"]]
                rows = [(doc, *found) for doc, passages in zip(batch["doc_id"], matcher.passages_of(texts))
                        for found in passages]
                frame = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance",
                                                    "max_distance", "start", "end"])
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

        found = texts.mapInPandas(scan, SPANS)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame,
                   rate: float = MAX_ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` without a passage of any item, with all columns."""
    for block in blocks(benchmark):
        docs = docs.where(_clean(docs.sparkSession, block, rate)(F.col("text").cast("string")))
    return docs


def _clean(spark, block: list[tuple[int, str]], rate: float):
    """A column function: has the text no passage of an item of the block?"""
    shared = spark.sparkContext.broadcast(block)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, rate)
        for texts in batches:
            found = matcher.passages_of([normalise(t or "") for t in texts])
            yield pd.Series([next(passages, None) is None for passages in found], dtype=bool)

    return clean
