"""Packed exchange: chunks of rows ask hash partitions about their keys.

A key is a 64-bit hash with some fields (a count, say). A chunk sends each of its distinct
keys once, in slices: one row for a hash partition, with the sorted keys as differences and
all numbers with their bytes by rank, which compress well. A partition combines the fields of
equal keys and answers each slice in the slice's own order; no key is sent back.

Chunks and partitions grow in number with the data, not in size. A chunk sends at most ``FAN``
slices: with more partitions than that, a slice goes to one of ``FAN`` groups of partitions, where
the slices of ``FAN`` chunks are combined, dealt out to the group's partitions, and answered
the same way back. So the rows grow with the data, not with its square. Every key is combined
before it is sent, in the chunk and in the group, so a frequent one is no hot key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slices that a chunk sends, and chunks whose slices are combined, at most.
FAN = 8192

Fields = dict[str, np.ndarray]
#: Keys and fields, equal keys repeated -> distinct sorted keys, their fields, and which one each is.
Combine = Callable[[np.ndarray, Fields], tuple[np.ndarray, Fields, np.ndarray]]


def packed(values: np.ndarray) -> bytes:
    """All lowest bytes, then all next ones: the high ones are mostly 0, and compress."""
    planes = np.empty((values.itemsize, len(values)), np.uint8)
    for i, plane in enumerate(planes):
        plane[:] = values.view(np.uint8)[i::values.itemsize]
    return planes.tobytes()


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    values = np.empty(len(data) // size, kind)
    for i, plane in enumerate(np.frombuffer(data, np.uint8).reshape(size, -1)):
        values.view(np.uint8)[i::size] = plane
    return values


def partitions(wanted: int) -> tuple[int, int]:
    """Parts that a chunk sends to, and partitions in each, for so many partitions in all."""
    return min(wanted, FAN), -(-wanted // FAN)


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys (uint64) and where each was (of equal keys, the first first): one plain
    sort of the keys' high bits with the places below them, a third of an argsort's time."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    low = np.uint64(len(keys).bit_length())
    up = np.uint64(64 - int(keys.max()).bit_length())
    held = (keys << up if up < 64 else keys) >> low << low
    held |= np.arange(len(keys), dtype=np.uint64)
    held.sort()
    held &= (np.uint64(1) << low) - np.uint64(1)
    places = held.view(np.int64)
    found = keys[places]
    if (found[1:] < found[:-1]).any():  # keys that differ in their low bits alone
        places = np.argsort(keys, kind="stable")
        found = keys[places]
    return found, places


def changes(values: np.ndarray) -> np.ndarray:
    """Whether each value is another one than the one before; the first one is."""
    return np.append(True, values[1:] != values[:-1])[:len(values)]


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of the keys by part, and (part, begin, end) of each part that has any."""
    # numpy sorts numbers of 8 and 16 bits by radix
    part = (keys % np.uint64(parts)).astype(np.min_scalar_type(parts))
    ends = np.cumsum(np.bincount(part, minlength=parts)).tolist()
    return np.argsort(part, kind="stable"), [
        (i, a, b) for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)) if a < b]


def slices(keys: np.ndarray, fields: Fields, parts: int, part: str = "_part") -> pd.DataFrame:
    """The slices of sorted distinct keys: a row for each part that has any."""
    order, held = _dealt(keys, parts)
    apart = keys[order] // np.uint64(parts)  # in a part, keys differ by multiples of parts
    found = {part: np.array([i for i, *_ in held], "int32"),
             "_keys": [packed(np.diff(apart[a:b], prepend=np.uint64(0))) for _, a, b in held]}
    for name, values in fields.items():
        values = values[order]
        found[name] = [packed(values[a:b]) for _, a, b in held]
    return pd.DataFrame(found)


def answers_of(keys: np.ndarray, told: pd.DataFrame, parts: int, kinds: dict[str, str],
               part: str = "_part") -> Fields:
    """The answered fields of sorted distinct keys, in their order."""
    order, _ = _dealt(keys, parts)
    told = told.sort_values(part)
    out = {}
    for name, kind in kinds.items():
        out[name] = np.empty(len(keys), kind)
        out[name][order] = np.concatenate([unpacked(x, kind) for x in told[name]] or [out[name][:0]])
    return out


def answered(asked: DataFrame, subs: int, kinds: dict[str, str], combine: Combine) -> DataFrame:
    """(_chunk, _part, fields): for each slice (_part, _chunk, _keys, fields) of ``asked``, the
    combined fields of its keys. ``kinds`` names the fields and their number types, ``subs``
    is the number of partitions in a part (see ``partitions``)."""
    fields = ", ".join(f"{name} binary" for name in kinds)

    def gathered(rows: pd.DataFrame) -> tuple[np.ndarray, Fields, np.ndarray, list[tuple[int, int]]]:
        keys = [np.cumsum(unpacked(k, "<u8"), dtype=np.uint64) for k in rows["_keys"]]
        ends = np.cumsum([len(k) for k in keys]).tolist()
        own = {name: np.concatenate([unpacked(x, kind) for x in rows[name]]) for name, kind in kinds.items()}
        return *combine(np.concatenate(keys), own), list(zip([0, *ends[:-1]], ends))

    def by_slice(found: Fields, back: np.ndarray, places: list[tuple[int, int]]) -> dict[str, list[bytes]]:
        return {name: [packed(values[back[a:b]]) for a, b in places] for name, values in found.items()}

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        _, found, back, places = gathered(rows)
        return rows.drop(columns=["_keys"]).assign(**by_slice(found, back, places))

    if subs == 1:
        return asked.groupBy("_part").applyInPandas(join, asked.drop("_keys").schema)
    grouped = asked.withColumn("_group", F.floor(F.col("_chunk") / F.lit(FAN)).cast("int")) \
        .groupBy("_part", "_group")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        table, found, _, _ = gathered(rows)
        return slices(table, found, subs, "_sub").assign(
            _part=rows["_part"].iloc[0], _group=rows["_group"].iloc[0])

    def split(rows: pd.DataFrame, joined: pd.DataFrame) -> pd.DataFrame:
        table, _, back, places = gathered(rows)
        found = answers_of(table, joined, subs, kinds, "_sub")
        return rows[["_chunk", "_part"]].assign(**by_slice(found, back, places))

    merged = grouped.applyInPandas(merge, f"_part int, _group int, _sub int, _keys binary, {fields}")
    joined = merged.groupBy("_part", "_sub").applyInPandas(join, merged.drop("_keys").schema)
    return grouped.cogroup(joined.groupBy("_part", "_group")).applyInPandas(
        split, f"_chunk int, _part int, {fields}")


def summed(keys: np.ndarray, fields: Fields) -> tuple[np.ndarray, Fields, np.ndarray]:
    """Adds up all fields."""
    found, places = in_order(keys)
    new = changes(found)
    begin = np.flatnonzero(new)
    back = np.empty(len(keys), np.int64)
    back[places] = np.cumsum(new) - 1
    return found[begin], {name: np.add.reduceat(values[places], begin) if len(begin) else values
                          for name, values in fields.items()}, back
