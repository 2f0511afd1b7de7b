"""Substring deduplication with suffix automata of reference shards (operator 2).

A window is ``WINDOW`` consecutive words of one document. A word is removed when a
window covers it whose words also start earlier: in a document with a smaller id, or
before it in the same one. All windows are judged on the input.

1. **Anchors.** Every window is represented by its least hash of ``ANCHOR`` consecutive
   words, so that equal windows have equal anchors. Anchors are counted in hash
   partitions; those that occur twice set a bit in a filter of fixed size
   (``FILTER_BITS``), which is broadcast. False hits only cost work in the next steps.
2. **Fragments.** Each document's maximal runs of windows with a repeated anchor.
   From here on only fragments are moved, not documents.
3. **References.** Fragments are spread over chunks; each chunk asks the hash partitions
   for the earliest place of each of its windows (a frequent window once for a chunk;
   ``exchange``).
   Runs of earliest places of repeated windows are the reference passages; runs of other
   places are sent, as words, to the document that holds their earliest place.
4. **Suffix automata.** Reference passages form shards by document. A shard's suffix
   automaton is built in a task; the runs that point to the shard stream through it
   for their matching statistics: words of matches of at least ``WINDOW`` words are
   removed, as maximal spans. So the comparison is by words, not by hashes. A
   reference that very many runs point to is copied to several shards and its runs are
   dealt out among them.

The automata are shuffled to their runs, not broadcast to all documents: the distinct
repeated text grows with the corpus, and every document against every shard would
grow with its square.

Defined results: null and empty texts have no words and the digest of the empty text;
rows with a null ``doc_id`` come after all others; rows that share a ``doc_id`` and hold
a window at the same place do not remove it from each other; an empty
table gives an empty result. Long texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import discard, text_of, written

WINDOW = 20
ANCHOR = 8
FILTER_BITS = 1 << 27
#: Bytes of fragments in a chunk, words of runs in a shard, bytes of text hashed at once.
CHUNK_BYTES = 8 << 20
SHARD_WORDS = 50_000
BATCH_BYTES = 4 << 20
#: Bytes of text whose anchors one hash partition counts.
ANCHOR_BYTES = 64 << 20
#: Bytes of spans of all documents that are joined by broadcast; more by a shuffle.
BROADCAST_BYTES = 32 << 20
NO_ID = (1 << 63) - 1
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # ASCII white space only


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position, by doubling."""
    power, size, out, done = _mix(h + np.uint64(1)), 1, None, 0
    while True:
        if n & size:
            if out is None:
                out = power
            else:
                out = _mix(out[:len(power) - done] * _P + power[done:]) if len(power) > done \
                    else power[:0]
            done += size
        if size * 2 > n:
            return out
        power = _mix(power[:-size] * _P + power[size:]) if len(power) > size else power[:0]
        size *= 2


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hash and place for each window of one document."""
    a = run_hashes(h, ANCHOR)
    width = WINDOW - ANCHOR + 1
    if len(a) < width:
        return a[:0], np.empty(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(a, width).argmin(axis=1) + np.arange(len(a) - width + 1)
    return a[at], at


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [first, last] of true positions."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def repeated_anchors(docs: DataFrame, parts: int, bits: int = FILTER_BITS) -> bytes:
    """A bit for every anchor that stands at two places or more."""
    slice_bits = -(-bits // parts // 8) * 8  # bits of one hash partition

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, size = [], 0

        def packed() -> pd.DataFrame:
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            part = ((keys % np.uint64(bits)) // np.uint64(slice_bits)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            which, first = np.unique(part[order], return_index=True)
            ends = [*first[1:], len(order)]
            return pd.DataFrame({
                "_part": which.astype("int32"),
                "_keys": [keys[order[a:b]].tobytes() for a, b in zip(first, ends)],
                "_twice": [(n[order[a:b]] > 1).tobytes() for a, b in zip(first, ends)]})

        for batch in batches:
            for text in batch["_text"]:
                hashes, at = anchors(word_hashes(words_of(text)))
                if len(at):
                    _, first = np.unique(at, return_index=True)
                    found.append(hashes[first])
                size += len(text)
                if size >= BATCH_BYTES:
                    if found:
                        yield packed()
                    found, size = [], 0
        if found:
            yield packed()

    def judge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in rows["_keys"]])
        twice = np.concatenate([np.frombuffer(t, bool) for t in rows["_twice"]])
        table, back = np.unique(keys, return_inverse=True)
        number = np.bincount(back, weights=1 + twice, minlength=len(table))
        own = np.zeros(slice_bits, np.uint8)
        own[((table[number > 1] % np.uint64(bits)) % np.uint64(slice_bits)).astype(np.int64)] = 1
        return pd.DataFrame({"_part": [key[0]], "_bits": [zlib.compress(np.packbits(own).tobytes(), 1)]})

    slices = docs.select(text_of().alias("_text")).mapInPandas(
        find, "_part int, _keys binary, _twice binary").groupBy("_part").applyInPandas(
        judge, "_part int, _bits binary").collect()  # FILTER_BITS / 8 bytes at most
    out = np.zeros((parts, slice_bits // 8), np.uint8)
    for row in slices:
        out[row["_part"]] = np.frombuffer(zlib.decompress(row["_bits"]), np.uint8)
    return out.tobytes()


FRAGMENT = "_doc long, _row long, _start int, _text binary"


def fragments(docs: DataFrame, known: bytes, bits: int = FILTER_BITS) -> DataFrame:
    """The maximal runs of windows with a repeated anchor, as words joined by blanks."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            rows = []
            for doc, row, text in zip(batch["_doc"], batch["_row"], batch["_text"]):
                words = words_of(text)
                hashes, _ = anchors(word_hashes(words))
                place = (hashes % np.uint64(bits)).astype(np.int64)
                hit = mask[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1
                rows += [(doc, row, a, b" ".join(words[a:b + WINDOW])) for a, b in runs(hit)]
            yield pd.DataFrame(rows, columns=["_doc", "_row", "_start", "_text"])

    return docs.select(*_identity(), text_of().alias("_text")).mapInPandas(cut, FRAGMENT)


def _identity() -> list:
    """A document's place in the order, and what tells rows of the same id apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"),
            F.xxhash64(text_of()).alias("_row")]


class _Windows:
    """The windows of some fragments: hash, document and place of each."""

    def __init__(self, rows: pd.DataFrame):
        self.words = [text.split() for text in rows["_text"]]
        self.n = np.asarray([len(w) - WINDOW + 1 for w in self.words], dtype=np.int64)
        self.hash = np.concatenate([run_hashes(word_hashes(w), WINDOW) for w in self.words])
        self.first = np.cumsum(self.n) - self.n
        inside = np.arange(len(self.hash)) - np.repeat(self.first, self.n)
        self.doc = np.repeat(rows["_doc"].to_numpy(), self.n)
        self.place = (inside + np.repeat(rows["_start"].to_numpy(), self.n)).astype(np.int64)

    def earliest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the earliest place of each distinct hash (by hash), whether the hash
        has several, and for each window the number of its hash."""
        order = np.lexsort((self.place, self.doc, self.hash))
        new = np.concatenate([[True], np.diff(self.hash[order]) != 0])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        twice = np.bincount(number, minlength=len(first)) > 1
        return first, twice, number


#: What is exchanged with a window: its earliest place, and whether it has several.
PLACE = {"_at": "<i8", "_place": "<u4", "_twice": "u1"}


def _earliest(keys: np.ndarray, fields: exchange.Fields) -> tuple[np.ndarray, exchange.Fields, np.ndarray]:
    order = np.lexsort((fields["_place"], fields["_at"], keys))
    new = np.concatenate([[True], np.diff(keys[order]) != 0])[:len(order)]
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    first = order[new]
    several = np.bincount(back, weights=1 + fields["_twice"], minlength=len(first)) > 1
    return keys[first], {"_at": fields["_at"][first], "_place": fields["_place"][first],
                         "_twice": several.astype(np.uint8)}, back


def pointed_runs(cut: DataFrame, parts: int) -> DataFrame:
    """Reference passages (_kind 0) and later runs (_kind 1), each with the document
    that holds the earliest place of its windows."""
    chunks = cut.repartition(parts, "_chunk")
    parts, subs = exchange.partitions(parts)

    def ask(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w = _Windows(rows)
        first, twice, _ = w.earliest()
        return exchange.slices(w.hash[first], {
            "_at": w.doc[first].astype("<i8"), "_place": w.place[first].astype("<u4"),
            "_twice": twice.astype(np.uint8)}, parts).assign(_chunk=np.int32(key[0]))

    def point(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["_kind", "_ref", "_doc", "_row", "_start", "_text"])
        w = _Windows(rows)
        first, _, number = w.earliest()
        known = exchange.answers_of(w.hash[first], told, parts, PLACE)
        doc, place, several = known["_at"], known["_place"], known["_twice"] > 0
        ref = doc[number]
        own = (ref == w.doc) & (place[number] == w.place)
        kind = np.where(several[number], np.where(own, 0, 1), -1)
        out = []
        for words, a, n, d, r, start in zip(w.words, w.first.tolist(), w.n.tolist(), rows["_doc"],
                                            rows["_row"], rows["_start"]):
            k, f = kind[a:a + n], ref[a:a + n]
            edge = np.flatnonzero((np.diff(k) != 0) | (np.diff(f) != 0)) + 1
            for low, high in zip([0, *edge.tolist()], [*edge.tolist(), n]):
                if k[low] >= 0:
                    out.append((int(k[low]), int(f[low]), d, r, start + low,
                                b" ".join(words[low:high - 1 + WINDOW])))
        return pd.DataFrame(out, columns=["_kind", "_ref", "_doc", "_row", "_start", "_text"])

    asked = chunks.groupBy("_chunk").applyInPandas(
        ask, "_part int, _chunk int, _keys binary, _at binary, _place binary, _twice binary")
    told = exchange.answered(asked, subs, PLACE, _earliest)
    return chunks.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInPandas(
        point, "_kind int, _ref long, " + FRAGMENT)


class SuffixAutomaton:
    """The suffix automaton of passages of words (a mark of its own ends each)."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0
        self.marks = 0

    def _extend(self, symbol) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p != -1 and symbol not in nxt[p]:
            nxt[p][symbol] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][symbol]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def add(self, words: list[bytes]) -> None:
        for word in words:
            self._extend(word)
        self.marks += 1
        self._extend(self.marks)

    def matching_statistics(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest passage part that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for word in words:
            while state and word not in nxt[state]:
                state = link[state]
                size = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                size += 1
            out.append(size)
        return out


def covered(statistics: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal spans [start, end) of words in matches of at least ``window`` words."""
    spans: list[tuple[int, int]] = []
    for i, size in enumerate(statistics):
        if size >= window:
            start = i + 1 - window
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def removed_spans(docs: DataFrame) -> DataFrame:
    """(_doc, _row, start, end): spans of words to remove; they may overlap."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spent: list[str] = []
    text = docs.agg(F.coalesce(F.sum(F.octet_length(text_of())), F.lit(0))).first()[0]
    known = repeated_anchors(docs, max(least, -(-text // ANCHOR_BYTES)))
    cut = written(fragments(docs, known), "fragments", spent)
    size = cut.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    parts = max(least, -(-size // CHUNK_BYTES))
    cut = cut.withColumn("_chunk", F.pmod(F.xxhash64("_doc", "_row"), F.lit(parts)).cast("int"))
    found = written(pointed_runs(cut, parts).withColumn(
        "_words", F.length("_text") - F.length(F.regexp_replace(F.col("_text").cast("string"), " ", ""))),
        "runs")
    discard(spark, spent)

    later, refs = found.where("_kind = 1"), found.where("_kind = 0")
    # the key comes from an aggregate, so the joins shuffle both sides, and a reference that
    # very many runs point to can be split
    load = later.groupBy("_ref").agg(F.ceil(F.sum("_words") / SHARD_WORDS).cast("int").alias("_copies"),
                                     F.max("_ref").alias("_to")).drop("_ref")
    words = found.agg(F.coalesce(F.sum("_words"), F.lit(0))).first()[0]
    shards = max(least, -(-words // SHARD_WORDS))
    to = F.col("_ref") == F.col("_to")
    copied = refs.join(load, to).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_copies"), F.lit(1)) - 1)))
    dealt = later.join(load, to).withColumn(
        "_copy", F.pmod(F.xxhash64("_doc", "_row", "_start"), F.greatest(F.col("_copies"), F.lit(1))).cast("int"))
    both = copied.unionByName(dealt).withColumn(
        "_shard", F.pmod(F.xxhash64("_ref", "_copy"), F.lit(shards)))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        reference = rows["_kind"] == 0
        for text in rows.loc[reference, "_text"]:
            automaton.add(text.split())
        out = []
        for r in rows[~reference].itertuples(index=False):
            doc, row, start, text = r[rows.columns.get_loc("_doc")], r[rows.columns.get_loc("_row")], \
                r[rows.columns.get_loc("_start")], r[rows.columns.get_loc("_text")]
            out += [(doc, row, start + a, start + b)
                    for a, b in covered(automaton.matching_statistics(text.split()))]
        return pd.DataFrame(out, columns=["_doc", "_row", "start", "end"])

    return both.select("_shard", "_kind", "_doc", "_row", "_start", "_text").groupBy("_shard") \
        .applyInPandas(match, "_doc long, _row long, start long, end long")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept (the words that stay, joined by blanks)."""
    spans = written(removed_spans(docs).groupBy("_doc", "_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans")), "spans") \
        .withColumnRenamed("_doc", "_sdoc").withColumnRenamed("_row", "_srow")
    size = spans.agg(F.coalesce(F.sum(40 + 24 * F.size("_spans")), F.lit(0))).first()[0]
    side = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    rows = docs.select("doc_id", *_identity(), text_of().alias("_text")).join(
        side, (F.col("_doc") == F.col("_sdoc")) & (F.col("_row") == F.col("_srow")), "left")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, gone, kept, all_spans = [], [], [], []
            for text, spans in zip(batch["_text"], batch["_spans"]):
                words = words_of(text)
                merged: list[list[int]] = []
                for span in spans if spans is not None else ():
                    start, end = span["start"], span["end"]
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                left, at = [], 0
                for start, end in merged:
                    left += words[at:start]
                    at = end
                left += words[at:]
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                all_spans.append(merged)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_words": n,
                                "n_removed": gone, "spans": all_spans, "kept": kept})

    return rows.select("doc_id", "_text", "_spans").mapInPandas(
        keep, "doc_id long, n_words long, n_removed long, spans array<array<long>>, kept string")


def digests(deduplicated: DataFrame) -> DataFrame:
    return deduplicated.select("doc_id", "n_words", "n_removed",
                               F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


