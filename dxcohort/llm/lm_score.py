"""Language-model scores by stupid backoff (operator 1).

The model is the corpus itself, and every document is scored by the n-grams of all
*other* documents (its own occurrences are taken off each count):

    S(w | context) = c(context w) / c(context)          if c(context w) > 0
                   = ALPHA * S(w | shorter context)     otherwise
    S(w)           = c(w) / N, and 1 / (N + 1) for a word of no other document

and a document's score is the sum of ``ln S`` over its words. It is computed as
relations, in packed form: a row holds the sorted n-gram hashes of one chunk of
documents and one hash partition, as differences with their bytes by rank.

1. Documents are packed where they are read (compressed, ``PACK_BYTES`` at a time) and the
   packs spread over chunks; each chunk counts its n-grams (so a frequent n-gram leaves
   a chunk once, whatever its frequency): a pack's words are hashed all at once, and one sort
   of each order's hashes gives the counts, in the chunk and in each document;
2. the counts are partitioned by n-gram hash; a partition sums them: the n-gram count
   tables; it joins them back to the n-grams of each chunk;
3. words and pairs go first. A longer n-gram is only sent where other documents hold both
   n-grams of one word less, without which none can hold it: a third of the trigrams;
4. every chunk meets its joined counts and sums the scores per document.

Partitions and chunks grow in number with the text, not in size, and rows with the text, not
with its square (``exchange``). Hashes have 64 bits.

Defined results: null and empty texts have no words, score 0 and a null mean; repeated
rows are documents of their own and so know each other's n-grams; a sole document knows
nothing (N = 0); an empty table gives an empty result; other columns, whatever their names,
are not read. A text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import text_of

ORDER = 2
ALPHA = 0.4
#: Bytes of text in a chunk, of text whose n-grams one hash partition holds, and in a pack.
CHUNK_BYTES = 6 << 20
PART_BYTES = 8 << 20
PACK_BYTES = 512 << 10
LEVEL = 5
#: Bytes of a word that is hashed by itself.
LONG_WORD = 64
_P = np.uint64(0x9E3779B97F4A7C15)
#: The key under which the number of words is counted.
TOTAL = np.uint64(0)
#: What is exchanged with a hash.
COUNT = {"_number": "<i8"}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: bytes | str) -> list[bytes]:
    """Lower-case (A-Z) words between ASCII white space."""
    return (text.encode("utf-8") if isinstance(text, str) else text).lower().split()


def _hashed(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (``words_of``) of some texts, which stand one after the other in
    ``raw`` (UTF-8, ``lengths`` bytes each), and the number of words of each text."""
    raw = raw.lower()
    data = np.frombuffer(raw, np.uint8)
    held = (data != 32) & (data - np.uint8(9) > 4)
    edges = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    apart = np.append(True, ~held)  # whether this byte and the one before are of two words
    apart[edges] = True
    begin = np.flatnonzero(held & apart[:-1])
    apart[:-1] |= ~held
    length = np.flatnonzero(held & apart[1:]) + 1 - begin
    # eight bytes at a time
    eights = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    hashes = length.astype(np.uint64)
    rest = np.flatnonzero(length <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        rest = rest[length[rest] > k]
        if not len(rest):
            break
        block = eights[begin[rest] + k] & masks[np.minimum(length[rest] - k, 8)]
        hashes[rest] = _mix(hashes[rest] * _P + block)
    for i in np.flatnonzero(length > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(raw[begin[i]:begin[i] + length[i]])
    return hashes, np.diff(np.searchsorted(begin, edges))


class Words:
    """The words of some packs of texts: each one's hash, document and place there."""

    def __init__(self, packs: list[tuple[bytes, np.ndarray]]):
        hashes, sizes = zip(*[_hashed(*pack) for pack in packs])
        self.hash, self.sizes = np.concatenate(hashes), np.concatenate(sizes)
        kind = "int32" if len(self.hash) < 1 << 31 else "int64"
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=kind), self.sizes)
        self.place = np.arange(len(self.hash), dtype=kind)
        self.place -= (np.cumsum(self.sizes) - self.sizes).astype(kind)[self.doc]

    def level(self, n: int, shorter: np.ndarray | None) -> np.ndarray:
        """The hash of the n-gram that ends at each position (0 where a document's first words have
        none), from those of one word less."""
        if shorter is None:
            return np.maximum(_mix(self.hash + np.uint64(1)), np.uint64(1))
        level = np.zeros(len(self.hash), np.uint64)
        # the n-gram that ends here: the shorter one before, and this word
        level[1:] = np.maximum(_mix(shorter[:-1] * _P + self.hash[1:] + np.uint64(n)), np.uint64(1))
        level[self.place < n - 1] = 0
        return level


class Grams:
    """The distinct n-grams of one order: ``keys`` (hashes, sorted) and ``counts``, from the hashes
    at each position (0: none)."""

    def __init__(self, words: Words, level: np.ndarray):
        where = np.flatnonzero(level)
        keys, order = exchange.in_order(level[where])
        self._doc, self._at = words.doc, where.astype(words.doc.dtype)[order]
        self._new = exchange.changes(keys)
        begin = np.flatnonzero(self._new)
        self.keys, self.counts = keys[begin], np.diff(begin, append=len(keys))

    def others(self, total: np.ndarray) -> np.ndarray:
        """At each position, how often its n-gram stands in other documents (0 for none), from the
        ``total`` counts of the keys."""
        # equal n-grams are sorted by place, so those of one document stand together
        begin = np.flatnonzero(self._new | exchange.changes(self._doc[self._at]))
        times = np.diff(begin, append=len(self._at))
        found = np.zeros(len(self._doc), np.int64)
        rest = np.repeat(total, self.counts)
        rest -= np.repeat(times, times)
        found[self._at] = rest
        return found


class Rounds:
    """What a chunk asks and knows, round by round: words and pairs first, then one order each.

    ``keys`` and ``counts`` are the hashes that this round asks for, sorted (the first round has
    TOTAL in front; none are left after the last one); ``rest`` holds, per order known so far,
    the count in other documents at each position, and ``total`` the number of all words.
    """

    def __init__(self, words: Words, order: int):
        self.words, self.order = words, order
        self.rest: list[np.ndarray] = []
        self.total = 0.0
        self._level: np.ndarray | None = None
        self._prepare(range(1, min(2, order) + 1))

    def _prepare(self, orders: range) -> None:
        self._grams = []
        for n in orders:
            asked = self._level = self.words.level(n, self._level)
            if self.rest:
                known = self.rest[-1] > 0
                asked = np.where(known & np.append(False, known[:-1]), asked, np.uint64(0))
            self._grams.append(Grams(self.words, asked))
        keys, counts = [g.keys for g in self._grams], [g.counts for g in self._grams]
        if not self.rest:
            keys, counts = [np.array([TOTAL]), *keys], [np.array([len(self.words.hash)]), *counts]
        self.keys, self._order = exchange.in_order(np.concatenate(keys))
        self.counts = np.concatenate(counts)[self._order]

    def answer(self, told: np.ndarray) -> None:
        """Take the joined counts of ``keys``, and go on to the next round that asks for any."""
        while True:
            total = np.empty(len(told), np.int64)
            total[self._order] = told
            del self.keys, self.counts, self._order  # these are as large as the n-grams themselves
            if not self.rest:
                self.total, total = float(total[0]), total[1:]
            while self._grams:
                grams = self._grams.pop(0)
                self.rest.append(grams.others(total[:len(grams.keys)]))
                total = total[len(grams.keys):]
            if len(self.rest) == self.order:
                self.keys, self.counts, self._level = np.empty(0, np.uint64), np.empty(0, np.int64), None
                return
            self._prepare(range(len(self.rest) + 1, len(self.rest) + 2))
            if len(self.keys):
                return
            told = np.empty(0, np.int64)


def document_scores(rounds: Rounds, alpha: float = ALPHA) -> np.ndarray:
    """The sum of ln S of every document, from the counts in all others."""
    words, rest = rounds.words, rounds.rest
    others = rounds.total - words.sizes[words.doc]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(rest[0] > 0, rest[0] / np.maximum(others, 1), 1 / (others + 1))
        del others
        for n in range(1, len(rest)):
            context = np.concatenate([[0], rest[n - 1][:-1]])
            score[words.place >= n] *= alpha
            known = rest[n] > 0
            score[known] = rest[n][known] / np.maximum(context[known], 1)
        return np.bincount(words.doc, weights=np.log(score), minlength=len(words.sizes))


_PACKS = pa.schema([("_pack", pa.int64()), ("_ids", pa.list_(pa.int64())),
                    ("_sizes", pa.list_(pa.int32())), ("_texts", pa.binary())])


def packs(texts: DataFrame) -> DataFrame:
    """Documents in compressed packs of about ``PACK_BYTES``, made where they are read."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, held, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            raw = b"".join(held)
            number = xxhash.xxh3_64_intdigest(raw, seed=len(ids)) >> 1
            return pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(
                    ([number], [ids], [sizes], [zstandard.ZstdCompressor(level=LEVEL).compress(raw)]), _PACKS)],
                schema=_PACKS)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist()):
                raw = text.encode("utf-8")
                if held and size + len(raw) > PACK_BYTES:
                    yield row()
                    ids, sizes, held, size = [], [], [], 0
                ids.append(doc)
                sizes.append(len(raw))
                held.append(raw)
                size += len(raw)
        if held:
            yield row()

    return texts.mapInArrow(pack, "_pack long, _ids array<long>, _sizes array<int>, _texts binary")


def _unpack(rows: pd.DataFrame) -> Words:
    """The words of some packs, in the order of the packs' contents."""
    return Words([(zstandard.ZstdDecompressor().decompress(raw), sizes)
                  for sizes, raw in zip(rows["_sizes"], rows["_texts"])])


def lm_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score for every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("_text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = max(least, -(-size // CHUNK_BYTES))
    parts, subs = exchange.partitions(max(least, -(-size // PART_BYTES)))
    chunks = packs(texts).withColumn("_chunk", F.pmod("_pack", F.lit(number)).cast("int")) \
        .repartition(number, "_chunk")

    def rounds_of(rows: pd.DataFrame, joined: pd.DataFrame) -> Rounds:
        """A chunk's rounds after those that are joined."""
        rounds = Rounds(_unpack(rows), order)
        for _, told in joined.sort_values("_round").groupby("_round"):
            rounds.answer(exchange.answers_of(rounds.keys, told, parts, COUNT)["_number"])
        return rounds

    def ask(rows: pd.DataFrame, joined: pd.DataFrame) -> pd.DataFrame:
        rounds = rounds_of(rows, joined)
        return exchange.slices(rounds.keys, {"_number": rounds.counts.astype("<i8")}, parts).assign(
            _chunk=np.int32(rows["_chunk"].iloc[0]))

    def score(rows: pd.DataFrame, joined: pd.DataFrame) -> pd.DataFrame:
        rounds = rounds_of(rows, joined)
        sums, n = document_scores(rounds, alpha), rounds.words.sizes
        ids = [None if i is None or i != i else int(i) for found in rows["_ids"] for i in found]
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_words": n,
                             "log_score": sums,
                             "mean_log_score": [s / m if m else None for s, m in zip(sums, n)]})

    nothing = pd.DataFrame({"_round": [], "_part": [], "_number": []})
    asks = "_part int, _chunk int, _keys binary, _number binary"
    told = None
    for number_of_round in range(max(1, order - 1)):
        if told is None:
            asked = chunks.groupBy("_chunk").applyInPandas(lambda rows: ask(rows, nothing), asks)
        else:
            asked = chunks.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInPandas(ask, asks)
        answer = exchange.answered(asked, subs, COUNT, exchange.summed).withColumn(
            "_round", F.lit(number_of_round))
        told = answer if told is None else told.unionByName(answer)
    return chunks.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInPandas(
        score, "doc_id long, n_words long, log_score double, mean_log_score double")
