"""N-gram Jaccard join by a size-aware heavy-light join (operator 4).

A document's set holds its distinct shingles of four words (64-bit hashes); two
documents link when ``100 * |A and B| >= 85 * |A or B|``. Documents with the same set
are first reduced to one representative, their smallest id.

* **Light sets** (few shingles) enumerate subsets of a fixed size: two sets of
  sizes ``n`` and ``m`` link exactly when they share a subset of
  ``c(n, m) = ceil(85 (n + m) / 185)`` shingles, so each light set gives out the hashes
  of all its ``c``-subsets for every ``c`` that some light partner size asks for.
* **Heavy sets** (and light ones just below the boundary, whose partners may be heavy)
  go to inverted lists under their first ``n - ceil(0.85 n) + 1`` shingles, rarest
  first; two linked sets always share one of these (prefix filter).
* **The boundary** is the size with the least cost on a sample: subsets enumerated
  below it against inverted-list entries scanned above it.

Before any list is made, keys that only one set has are taken out: chunks of sets send
their sorted keys, packed, to hash partitions, which answer for each key whether it is shared
(``exchange``).

The order of shingles may be any, for right results; frequent shingles are put
last as far as a sample shows them. Lists are scanned without emitting all
pairs: every member is first held against one leader of its list and size class,
the member that meets others under the most keys (in a group of near copies the
text that the others come from); what then lies in one component needs no further
pairs, and only members of different components are paired. Candidates pass two exact
bounds, on the places of a shared shingle and on bitmaps (about four bits for each
shingle), and are verified on the whole texts; no link between different components is left out.

Defined results: null and empty texts have no shingles and link with nothing, not
even each other; a text of one to three words is one shingle; rows with the same
``doc_id`` are one node, which has the links of each of its texts; rows with a null
``doc_id`` are counted but not linked (their component is null); an empty table gives an
empty result; other columns, whatever their names, are not read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import components, discard, text_of, written

WIDTH = 4
PERCENT = 85
#: One document in so many teaches the order of shingles and the cost boundary.
SAMPLE = 16
#: Frequent shingles that are known as such: at most so many (4 MB), by their count.
FREQUENT = 500_000
MAX_LIGHT = 20
#: Identifiers whose texts are fetched by a broadcast join (8 MB); more by a shuffle.
BROADCAST_IDS = 500_000
#: Bytes of keys in a chunk of sets and in a hash partition.
CHUNK_BYTES = 2 << 20
#: Sets that a task hands on together.
DESCRIBED = 1_000
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    size = min(width, len(h))
    out = np.full(n, np.uint64(size))
    for j in range(size):
        out = _mix(out * _P + h[j:j + n])
    return np.unique(out)


def least_share(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - least_share(n, percent) + 1


def common_size(n: int, m: int, percent: int = PERCENT) -> int:
    """The overlap from which sets of sizes n and m link."""
    return -(-percent * (n + m) // (100 + percent))


def subset_sizes(n: int, boundary: int, percent: int = PERCENT) -> list[int]:
    """Overlap sizes that light partners of a set of ``n`` shingles can ask for."""
    partners = range(least_share(n, percent), min(boundary, 100 * n // percent) + 1)
    return sorted({c for m in partners if (c := common_size(n, m, percent)) <= min(n, m)})


def subsets(n: int, boundary: int, percent: int = PERCENT) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, boundary, percent))


def choose_boundary(count: dict[int, int], list_length: float, percent: int = PERCENT) -> int:
    """The largest light size with the least cost, for the numbers of sets by size."""
    best, least = 0, None
    for boundary in range(MAX_LIGHT + 1):
        cost = sum(count.get(n, 0) * subsets(n, boundary, percent) for n in range(1, boundary + 1))
        cost += sum(count.get(n, 0) * prefix_size(n, percent) * list_length
                    for n in range(max(1, least_share(boundary + 1, percent)), MAX_LIGHT + 1))
        if least is None or cost < least:
            best, least = boundary, cost
    return best


def signatures(found: np.ndarray, boundary: int, frequent: np.ndarray,
               percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """Keys under which linked sets meet: subset hashes, then list keys in the order of
    all shingles; and the number of the former."""
    n, out = len(found), []
    if n <= boundary:
        for c in subset_sizes(n, boundary, percent):
            for chosen in combinations(found.tolist(), c):
                out.append(xxhash.xxh3_64_intdigest(np.asarray(chosen, dtype=np.uint64).tobytes(),
                                                    seed=1))
    keys = np.asarray(out, dtype=np.uint64)
    if n and n >= least_share(boundary + 1, percent):
        size = prefix_size(n, percent)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
            known = frequent[at] == found
            found = np.concatenate([found[~known], found[known]])
        keys = np.concatenate([keys, found[:size]])
    return keys, len(out)


def _learn(docs: DataFrame, percent: int) -> tuple[int, np.ndarray]:
    """Boundary and frequent shingles, from one document in ``SAMPLE``."""
    texts = docs.where("doc_id is not null").where(
        F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select(text_of().alias("_text"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(text) for text in batch["_text"]]
            yield pd.DataFrame({"n": [len(s) for s in found], "keys": [s.view(np.int64) for s in found]})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"b": [batch["key"].to_numpy(dtype=np.int64).tobytes()]})

    spent: list[str] = []
    sample = written(texts.mapInPandas(sets, "n int, keys array<long>"), "sample", spent)
    counts = sample.select(F.explode("keys").alias("key")).groupBy("key").count()
    several = written(counts.where("count > 1"), "counts", spent)
    often = several.where("count >= 3").orderBy(F.col("count").desc(), "key").limit(FREQUENT)
    raw = b"".join(r[0] for r in often.select("key").mapInPandas(packed, "b binary").collect())
    sizes = {r[0]: r[1] for r in sample.groupBy(F.least("n", F.lit(MAX_LIGHT + 1))).count().collect()}
    total = sample.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    inside, square = several.agg(F.coalesce(F.sum("count"), F.lit(0)),
                                 F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0))).first()
    mean = (square + total - inside) / total if total else 1.0  # length of the list of a shingle met at random
    discard(docs.sparkSession, spent)
    return choose_boundary(sizes, float(mean), percent), np.sort(np.frombuffer(raw, np.uint64))


def bitmap(found: np.ndarray) -> bytes:
    """One bit for each shingle, of about four times as many (a power of two)."""
    bits = max(64, 1 << (2 + max(0, len(found) - 1).bit_length()))
    out = np.zeros(bits, dtype=np.uint8)
    out[(found & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _folded(raw: bytes, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(raw, dtype=np.uint64).reshape(-1, size // 8), axis=0)


def least_difference(left: bytes, right: bytes) -> int:
    """A lower bound of the number of shingles in one set alone: the larger bitmap is
    folded to the size of the other; each bit that differs is a shingle of its own."""
    size = min(len(left), len(right))
    return int(np.bitwise_count(_folded(left, size) ^ _folded(right, size)).sum())


def _promising(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link by their bitmaps (an exact bound: none is lost)."""
    both = (pairs.join(maps.select(F.col("rep").alias("b"), F.col("n").alias("nb"),
                                   F.col("bits").alias("_bb")), "b")
            .join(maps.select(F.col("rep").alias("a"), F.col("n").alias("na"),
                              F.col("bits").alias("_ba")), "a"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [least_difference(x, y) <= n + m - 2 * common_size(n, m, percent)
                    for x, y, n, m in zip(batch["_ba"], batch["_bb"], batch["na"], batch["nb"])]
            yield batch.loc[keep, ["a", "b"]]

    return both.mapInPandas(check, "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, percent: int, spent: list[str]) -> DataFrame:
    """The pairs (a, b) that link, by the whole texts (of a repeated id, by any of its
    texts); only texts of pairs are moved."""
    ids = written(pairs.select(F.col("a").alias("id")).unionByName(
        pairs.select(F.col("b").alias("id"))).distinct(), "ids", spent)
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = written(docs.select("doc_id", text_of().alias("_text")).join(
        wanted, F.col("doc_id") == F.col("id"), "left_semi").distinct(), "texts", spent)
    both = (pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("_text").alias("_tb")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("_text").alias("_ta")), "a"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, None
        for batch in batches:
            keep = []
            for ta, tb in zip(batch["_ta"], batch["_tb"]):
                if ta != last:
                    last, left = ta, shingles(ta)
                right = shingles(tb)
                union = len(np.union1d(left, right))
                shared = len(left) + len(right) - union
                keep.append(100 * shared >= percent * union)
            yield batch.loc[keep, ["a", "b"]]

    return written(both.select("a", "b", "_ta", "_tb").mapInPandas(check, "a long, b long"), "links", spent)


MET = "key long, rep long, n long, place long, met long"


#: What is exchanged with a key: how many sets have it (two stand for more).
SEVERAL = {"_several": "u1"}


def _several(keys: np.ndarray, fields: exchange.Fields) -> tuple[np.ndarray, exchange.Fields, np.ndarray]:
    table, back = np.unique(keys, return_inverse=True)
    number = np.bincount(back, weights=fields["_several"], minlength=len(table))
    return table, {"_several": np.minimum(number, 2).astype(np.uint8)}, back


class _Keys:
    """The distinct keys of a chunk of sets, and where each set has them."""

    def __init__(self, rows: pd.DataFrame, gone: pd.DataFrame):
        self.rows = rows = rows[~rows["_row"].isin(gone["_row"])]
        self.sizes = np.asarray([len(k) for k in rows["keys"]], np.int64)
        self.flat = np.concatenate([*rows["keys"], np.empty(0, np.int64)]).astype(np.int64)
        self.keys, self.at, count = np.unique(self.flat.view(np.uint64), return_inverse=True,
                                              return_counts=True)
        self.several = np.minimum(count, 2).astype(np.uint8)

    def met(self, several: np.ndarray) -> pd.DataFrame:
        """The entries whose key ``several`` sets have."""
        hit = np.flatnonzero(several[self.at] > 1)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        mine, light = owner[hit], self.rows["light"].to_numpy(dtype=np.int64)
        return pd.DataFrame({
            "key": self.flat[hit], "rep": self.rows["rep"].to_numpy(dtype=np.int64)[mine],
            "n": self.rows["n"].to_numpy(dtype=np.int64)[mine],
            "place": hit - first[mine] - light[mine],
            "met": np.bincount(mine, minlength=len(self.sizes))[mine]})


def shared_entries(sets: DataFrame, copies: DataFrame) -> DataFrame:
    """(key, rep, n, place, met): the keys of each set that another set has as well, their
    place in the set's order (negative for subset hashes), and how many of them the set has.

    ``sets`` holds (_row, rep, n, keys, light); rows of ``copies`` (_row) are left out. Each
    set is moved once, to a chunk; a key leaves a chunk once.
    """
    least = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = sets.agg(F.coalesce(F.sum(8 * F.size("keys")), F.lit(0))).first()[0]
    number = max(least, -(-size // CHUNK_BYTES))
    parts, subs = exchange.partitions(number)
    chunk = F.pmod(F.xxhash64("_row"), F.lit(number)).cast("int").alias("_chunk")
    chunks = sets.select("_row", "rep", "n", "keys", "light", chunk).groupBy("_chunk")
    gone = copies.select("_row", chunk)

    def ask(rows: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["_chunk", "_part", "_keys", "_several"])
        found = _Keys(rows, gone)
        return exchange.slices(found.keys, {"_several": found.several}, parts).assign(
            _chunk=rows["_chunk"].iloc[0])

    def tell(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["key", "rep", "n", "place", "met"])
        told = side["_part"].notna()
        found = _Keys(rows, side[~told])
        return found.met(exchange.answers_of(found.keys, side[told], parts, SEVERAL)["_several"])

    asked = chunks.cogroup(gone.groupBy("_chunk")).applyInPandas(
        ask, "_part int, _chunk int, _keys binary, _several binary")
    told = exchange.answered(asked, subs, SEVERAL, _several)
    side = told.withColumn("_row", F.lit(None).cast("long")).unionByName(gone.select(
        "_chunk", "_row", F.lit(None).cast("int").alias("_part"), F.lit(None).cast("binary").alias("_several")))
    return chunks.cogroup(side.groupBy("_chunk")).applyInPandas(tell, MET)


def jaccard_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    spark, spent = docs.sparkSession, []
    boundary, frequent = _learn(docs, percent)
    shared = spark.sparkContext.broadcast(frequent)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for begin in range(0, len(whole), DESCRIBED):
                batch = whole[begin:begin + DESCRIBED]
                n, digest, keys, bits, light = [], [], [], [], []
                for text in batch["_text"]:
                    found = shingles(text)
                    n.append(len(found))
                    digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                    signature, subset_keys = signatures(found, boundary, shared.value, percent)
                    keys.append(signature.view(np.int64))
                    light.append(subset_keys)
                    bits.append(bitmap(found))
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "_row": batch["_row"], "n": n,
                                    "digest": digest, "keys": keys, "light": light, "bits": bits})

    # a row's number is fixed once the table is written
    sets = written(docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("_row"),
                               text_of().alias("_text")).mapInPandas(
        describe, "doc_id long, _row long, n long, digest binary, keys array<long>, light int, bits binary"),
        "sets")
    known = sets.where("doc_id is not null and n > 0")
    # one representative row of each set; the others are links to it
    groups = written(known.groupBy("digest").agg(
        F.min(F.struct("doc_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("_rows"))
        .where("_rows > 1").select("digest", F.col("_keep.doc_id").alias("rep"),
                                   F.col("_keep._row").alias("_kept")), "groups", spent)
    copies = written(known.select("doc_id", "_row", "digest").join(groups, "digest")
                     .where("_row <> _kept").select("_row", "doc_id", "rep"), "copies", spent)
    met = written(shared_entries(known.withColumnRenamed("doc_id", "rep"), copies).withColumn(
        "size", F.floor(F.log("n") / float(np.log(100 / percent)))), "lists", spent)
    maps = known.select(F.col("doc_id").alias("rep"), "n", "bits")

    # first: every member against the leader of its list and size class (keys from an
    # aggregate, so the join shuffles both sides and a long list can be split)
    leaders = met.groupBy("key", "size").agg(
        F.max(F.struct("met", (-F.col("rep")).alias("_o"), "rep", "n", "place")).alias("_l"),
        F.max("key").alias("_key"), F.max("size").alias("_size")).drop("key", "size")
    stars = (met.join(leaders, (F.col("key") == F.col("_key")) & (F.col("size") == F.col("_size")))
             .where("rep <> _l.rep")
             .where(_may_link("n", "place", "_l.n", "_l.place", percent))
             .select(F.least("rep", "_l.rep").alias("a"), F.greatest("rep", "_l.rep").alias("b"))
             .distinct())
    stars = written(_promising(stars, maps, percent).distinct(), "stars", spent)
    linked = _verify(stars, docs, percent, spent)
    same_set = copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    first = components(linked.unionByName(same_set))

    # then: members of lists that still hold several components
    parted = met.join(first, F.col("rep") == F.col("node"), "left").select(
        "key", "rep", "n", "place", F.coalesce("root", "rep").alias("root"))
    open_lists = parted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")) \
        .where("lo <> hi").select("key")
    rest = written(parted.join(open_lists, "key"), "open", spent)
    other = rest.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"),
                        F.col("place").alias("pb"), F.col("root").alias("rb"))
    pairs = (rest.join(other, "key").where("rep < b and root <> rb")
             .where(_may_link("n", "place", "nb", "pb", percent))
             .select(F.col("rep").alias("a"), "b").distinct())
    more = written(_promising(pairs, maps, percent).distinct().join(stars, ["a", "b"], "left_anti"),
                   "pairs", spent)
    last = first
    if not more.isEmpty():
        last = components(first.select(F.col("node").alias("a"), F.col("root").alias("b"))
                          .unionByName(_verify(more, docs, percent, spent)))
    discard(spark, spent)
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(
        last, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def _may_link(n: str, p: str, m: str, q: str, percent: int) -> Column:
    """Whether two sets that share the key at places p and q may link.

    If it is their first common shingle, all common ones stand from there on in both;
    so a pair that can link passes by its first common shingle, and a later one
    drops none that passes there. A shared subset always passes.
    """
    n, p, m, q = (F.col(c) for c in (n, p, m, q))
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    rest = F.least(n - p, m - q) * (100 + percent) >= (n + m) * percent
    return sizes & ((p < 0) | rest)


def without_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their component, with all columns.

    Each text is judged by itself: texts that share a ``doc_id`` are documents of their own
    here, which come after those with an id to themselves; rows alike in both stay or go
    together. Rows without an id or without a word stay.
    """
    spent: list[str] = []
    repeated = written(docs.groupBy(F.col("doc_id").cast("long").alias("id")).count()
                       .where("id is not null and count > 1").select("id"), "repeated", spent)
    own = F.lit(1 << 62) + F.xxhash64("r.doc_id", text_of("r.text")).bitwiseAND(F.lit((1 << 61) - 1))
    rows = docs.select(F.struct("*").alias("r")).join(
        repeated, F.col("r.doc_id").cast("long") == F.col("id"), "left").select(
        "r", F.when(F.col("id").isNull(), F.col("r.doc_id").cast("long")).otherwise(own).alias("node"))
    classes = jaccard_classes(rows.select(F.col("node").alias("doc_id"), F.col("r.text").alias("text")), percent)
    dropped = written(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(),
                      "dropped")
    return rows.join(dropped, F.col("node") == F.col("gone"), "left_anti").select("r.*")
