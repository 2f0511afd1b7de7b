"""Sequence packing by minimum bin slack (operator 9).

1. Every text is tokenised in its own task and cut into pieces: whole windows of
   ``capacity`` ids, each a sequence of its own without padding, and one remainder.
2. The lengths of the remainders are counted: at most ``capacity - 1`` numbers,
   however many documents there are. Only this histogram reaches the driver.
3. Minimum bin slack on the histogram: a window takes the longest remaining
   length; a subset-sum dynamic program over bitsets (bit ``s`` is set when some
   multiset of the remaining lengths adds up to ``s``) gives the reachable fills;
   the fill without padding or closest to the capacity is traced back to counts per
   length. The same pattern is used for as many windows as the counts allow, so
   the number of patterns depends on the capacity, not on the documents.
4. Every remainder gets its rank among those of its length (counts per task,
   running sums over tasks, rank within the task) and looks up the window and
   offset that the patterns give to this rank. No task sees a whole length.

A window whose fill is a power of two is not padded, so such a fill is as good as
a full one.

Defined results: a null or empty text is one piece, the end id alone; repeated rows
are separate documents; ties of length are ranked by task and row; an empty table gives no
sequences. A very long text gives as many pieces as it fills windows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, text_of, written

CAPACITY = 2048
END_ID = 1
#: Runs of so many white-space characters go through the tokenizer file.
LONG_SPACE = 10_000


class Encoder:
    """Byte-level BPE ids of a text, as little-endian unsigned 32-bit bytes: those of the
    tokenizer file without the special tokens of its post-processor.

    Texts go through the ranks file, which is faster. Those for which it is no equal go through
    the tokenizer file itself: texts that hold an added token (one id there, spelt out
    here) and texts with a long run of white space (too deep for this split).
    """

    def __init__(self, ranks_file: str, json_file: str):
        import base64
        import json

        import public_tokenizers
        import tiktoken
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_file, encoding="utf-8") as f:
            added = [token["content"] for token in json.load(f)["added_tokens"]]
        self._fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN,
                                       mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._other = re.compile("|".join([*map(re.escape, added), rf"\s{{{LONG_SPACE}}}"])).search
        self._json_file = json_file
        self._exact = None

    def __call__(self, text: str) -> bytes:
        ids = self._by_file(text) if self._other(text) else self._fast(text)
        return np.asarray(ids, dtype="<u4").tobytes()

    def _by_file(self, text: str) -> list[int]:
        if self._exact is None:
            from tokenizers import Tokenizer
            self._exact = Tokenizer.from_file(self._json_file)
        return self._exact.encode(text, add_special_tokens=False).ids


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file; ``byte_bpe_50k.tiktoken`` holds the ranks of
    ``byte_bpe_50k.json`` (tests hold them against each other)."""
    import public_tokenizers
    return public_tokenizers.path(name)


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_file: str | None = None,
           json_file: str | None = None) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): the pieces of every document, the
    end id included; ``ids`` are little-endian unsigned 32-bit numbers."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(ranks_file or tokenizer_file("byte_bpe_50k.tiktoken"),
                         json_file or tokenizer_file())
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["_text"]):
                ids = encode(text) + end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    piece = ids[4 * at:4 * (at + capacity)]
                    out.append((doc, at, len(piece) // 4, n, piece))
                if len(out) >= 2000:
                    yield _frame(out)
                    out = []
            if out:
                yield _frame(out)

    return docs.select("doc_id", text_of().alias("_text")).mapInPandas(cut, PIECES)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def _power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def best_fill(counts: dict[int, int], first: int, capacity: int) -> dict[int, int]:
    """Counts per length of one window that holds ``first``: the fullest fill, or one
    that needs no padding if there is any.

    ``reach[i]`` is the bitset of sums of the first ``i`` lots; a length that
    remains ``c`` times is split into lots of 1, 2, 4, ... pieces, so that all
    counts up to ``c`` can be made.
    """
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    lots, reach, bits = [], [1], 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length)
        lot = 1
        while left > 0:
            take = min(lot, left)
            bits |= (bits << (take * length)) & mask
            lots.append((length, take))
            reach.append(bits)
            left -= take
            lot *= 2
            if bits >> room & 1:
                break
        if bits >> room & 1:
            break
    target = bits.bit_length() - 1
    if target < room:  # no full window: prefer a fill that is a power of two
        whole = [p for p in (1 << k for k in range(capacity.bit_length()))
                 if p >= first and p <= capacity and bits >> (p - first) & 1]
        if whole:
            target = whole[-1] - first
    pattern = {first: 1}
    for i in range(len(lots) - 1, -1, -1):
        length, take = lots[i]
        if not reach[i] >> target & 1:  # the lot is needed
            pattern[length] = pattern.get(length, 0) + take
            target -= length * take
    return pattern


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(number of windows, counts per length in each)] for a histogram of lengths."""
    left = {n: c for n, c in counts.items() if c > 0}
    plan = []
    while left:
        pattern = best_fill(left, max(left), capacity)
        times = min(left[n] // c for n, c in pattern.items())
        plan.append((times, pattern))
        for n, c in pattern.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return plan


def _slots(plan: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[list, list]]:
    """For each length: the first rank of every use, and (first rank, first window,
    pieces in a window, offset of the first)."""
    slots: dict[int, tuple[list, list]] = {}
    given: dict[int, int] = {}
    window = 0
    for times, pattern in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            starts, uses = slots.setdefault(length, ([], []))
            rank = given.get(length, 0)
            starts.append(rank)
            uses.append((rank, window, pattern[length], offset))
            given[length] = rank + pattern[length] * times
            offset += length * pattern[length]
        window += times
    return slots


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces (any columns, with
    ``length`` from 1 to ``capacity``).

    Windows of several pieces have the ids from 0; whole windows follow.
    """
    kept = cut.columns
    task, row, n, before, in_task, rank = (fresh(kept, x) for x in ("_task", "_row", "_n", "_before",
                                                                    "_in_task", "_rank"))
    cut = cut.withColumns({task: F.spark_partition_id(), row: F.monotonically_increasing_id()})
    cut = written(cut, "pieces")
    per_task = cut.groupBy("length", task).agg(F.count("*").alias(n))
    earlier = (F.coalesce(F.sum(n).over(Window.partitionBy("length").orderBy(task).rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)))
    per_task = written(per_task.withColumn(before, earlier), "ranks")
    counts = {int(r[0]): int(r[1]) for r in
              per_task.groupBy("length").agg(F.sum(n)).collect()}  # <= capacity rows
    counts.pop(capacity, None)
    plan = plan_windows(counts, capacity)
    windows = sum(times for times, _ in plan)
    slots = cut.sparkSession.sparkContext.broadcast(_slots(plan))

    ranked = cut.withColumn(in_task, F.row_number().over(
        Window.partitionBy("length", task).orderBy(row)) - 1).join(
        per_task.drop(n), ["length", task]).withColumn(rank, F.col(before) + F.col(in_task))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = slots.value
        for batch in batches:
            sequence = np.empty(len(batch), dtype="int64")
            offset = np.zeros(len(batch), dtype="int64")
            for i, (length, turn) in enumerate(zip(batch["length"], batch[rank])):
                if length == capacity:
                    sequence[i] = windows + turn
                    continue
                starts, uses = known[length]
                first, window, each, at = uses[bisect_right(starts, turn) - 1]
                sequence[i] = window + (turn - first) // each
                offset[i] = at + (turn - first) % each * length
            out = batch[kept].copy()
            out["sequence_id"] = sequence
            out["offset"] = offset
            yield out

    from pyspark.sql.types import LongType, StructType
    schema = StructType([f for f in cut.schema.fields if f.name in kept]) \
        .add("sequence_id", LongType()).add("offset", LongType())
    return ranked.select(*[F.col(f"`{c}`") for c in kept], rank).mapInPandas(place, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, ranks_file: str | None = None,
         json_file: str | None = None) -> DataFrame:
    """The pieces of all documents with their ids, sequence and offset."""
    return assign(pieces(docs, capacity, ranks_file, json_file), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids binary): one padded row for each sequence; a fill that is a
    power of two is left as it is. A sequence has at most ``capacity`` pieces."""
    pad = np.asarray([pad_id], dtype="<u4").tobytes()
    rows = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"),
        F.sum("length").alias("_fill"))
    fill = F.col("_fill")
    whole = F.expr("cast(log2(_fill) as long)")
    short = F.when(F.pow(F.lit(2), whole) == fill, 0).otherwise(F.lit(capacity) - fill)
    joined = F.concat(F.aggregate("_p", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])),
                      F.unhex(F.repeat(F.lit(pad.hex()), short.cast("int"))))
    return rows.select("sequence_id", fill.alias("tokens"), joined.alias("ids"))


def digests(cut: DataFrame) -> DataFrame:
    """Replace ``ids`` by their CRC-32."""
    return cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
