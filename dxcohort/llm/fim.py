"""Fill-in-middle transformation over seekable compressed frames (operator 13).

1. ``store``: every text is cut into blocks of ``FRAME_UNITS`` units (a word with the
   white space before it, or white space at the end); each block is a zstandard frame of
   its own, and a document keeps the cumulative units and characters at the end of each
   frame. The table is written to the shared folder, about a third of the text.
2. ``choose``: form and cut places of a document follow from a hash of its identifier
   and its number of units alone, as column expressions; no text is read.
3. ``transform``: only the frames that hold a cut are decompressed, to find the cut; the
   output is again a list of frames with cumulative characters: whole frames are carried
   over as they are, in their new order, and only the parts of cut frames are compressed
   anew.
4. ``restore`` looks for the marks in an output's frames and yields the text piece by
   piece; ``digests`` streams ordered frames through sha256. No step but the first holds a
   text as a whole; every step is one pass without a shuffle, so a lost executor costs only
   its tasks.

Defined results: a null text is empty; an empty text, and one that holds a mark itself, stays
plain; a null ``doc_id`` counts as the empty string for the hash; repeated rows are documents
of their own, those with the same ``doc_id`` are cut by the same draws; an empty table gives
an empty result; other columns, whatever their names, are not read. A very long text is many
frames; a frame ends at a unit's end, so a single huge word is one frame.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
SPACES = " \t\n\x0b\x0c\r"
FRAME_UNITS = 2048
SEED = "42"
#: Percent of texts that are rearranged, and of these as suffix-prefix-middle.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The order of the marks by form; each is followed by its part.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
LEVEL = 3

_STORED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_()),
                     ("unit_ends", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
                     ("frames", pa.list_(pa.binary()))])
_OUTPUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
                     ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                     ("ends", pa.list_(pa.int64())), ("output", pa.list_(pa.binary()))])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
                      ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                      ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
_KINDS = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string",
          pa.list_(pa.int64()): "array<long>", pa.list_(pa.binary()): "array<binary>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_KINDS[f.type]}" for f in schema)


def compressed(text: str) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(text.encode("utf-8"))


def blocks(text: str, frame_units: int = FRAME_UNITS) -> Iterator[tuple[str, int]]:
    """The text in blocks of ``frame_units`` units, and the units of each."""
    for found in re.finditer(rf"(?:{UNIT}){{1,{frame_units}}}", text):
        block = found.group()
        yield block, len(block.encode("utf-8").split()) + (block[-1] in SPACES)


class Frames:
    """A text as independent frames with the cumulative characters at their ends."""

    def __init__(self, ends: list[int], frames: list[bytes]):
        self.ends, self.frames = ends, frames
        self.chars = ends[-1] if ends else 0
        self._last: tuple[int, str] = (-1, "")

    def frame(self, i: int) -> str:
        if self._last[0] != i:
            self._last = i, zstandard.ZstdDecompressor().decompress(self.frames[i]).decode("utf-8")
        return self._last[1]

    def begin(self, i: int) -> int:
        return self.ends[i - 1] if i else 0

    def pieces(self, start: int, stop: int) -> Iterator[str]:
        """The characters from ``start`` to ``stop``, frame by frame."""
        i = bisect_left(self.ends, start + 1)
        while start < stop:
            piece = self.frame(i)[start - self.begin(i):stop - self.begin(i)]
            yield piece
            start, i = start + len(piece), i + 1

    def part(self, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
        """The same as frames (characters, data); those that lie inside are not touched."""
        i = bisect_left(self.ends, start + 1)
        while start < stop:
            end = min(stop, self.ends[i])
            whole = start == self.begin(i) and end == self.ends[i]
            yield end - start, self.frames[i] if whole else compressed(
                self.frame(i)[start - self.begin(i):end - self.begin(i)])
            start, i = end, i + 1

    def place(self, mark: str, start: int) -> int:
        """Where ``mark`` stands first from ``start`` on, across frames."""
        tail = ""
        for piece in self.pieces(start, self.chars):
            window = tail + piece
            if (at := window.find(mark)) >= 0:
                return start - len(tail) + at
            start, tail = start + len(piece), window[1 - len(mark):]
        raise ValueError(f"no {mark}")

    def after_units(self, units: int, unit_ends: list[int]) -> int:
        """The characters of the first ``units`` units; decompresses one frame at most."""
        i = bisect_left(unit_ends, units) if units else 0
        if not units or unit_ends[i] == units:
            return self.ends[i] if units else 0
        rest = units - (unit_ends[i - 1] if i else 0)
        last = next(islice(re.finditer(UNIT, self.frame(i)), rest - 1, None))
        return self.begin(i) + last.end()


def rearranged(text: Frames, cuts: tuple[int, int], form: str) -> Frames:
    """The output of ``form`` with the cuts at these characters, as frames."""
    if form == "plain":
        return text
    spans = {PREFIX: (0, cuts[0]), MIDDLE: cuts, SUFFIX: (cuts[1], text.chars)}
    parts = [x for mark in ORDERS[form]
             for x in [(len(mark), compressed(mark)), *text.part(*spans[mark])]]
    return Frames(list(accumulate(n for n, _ in parts)), [data for _, data in parts])


def restored(output: Frames, form: str) -> Iterator[str]:
    """The original text, piece by piece, from an output and its form alone."""
    if form == "plain":
        yield from output.pieces(0, output.chars)
        return
    begin, at = {}, 0
    for mark in ORDERS[form]:
        at = output.place(mark, at) + len(mark)
        begin[mark] = at
    first, second, third = ORDERS[form]
    end = {first: begin[second] - len(second), second: begin[third] - len(third),
           third: output.chars}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.pieces(begin[mark], end[mark])


def store(docs: DataFrame, frame_units: int = FRAME_UNITS) -> DataFrame:
    """doc_id, n, marked, unit_ends, ends, frames: a written table of compressed frames."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {name: [] for name in _STORED.names[1:]}
            for text in batch.column("_text").to_pylist():
                found = list(blocks(text, frame_units))
                unit_ends = list(accumulate(units for _, units in found))
                cols["n"].append(unit_ends[-1] if found else 0)
                cols["marked"].append(any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)))
                cols["unit_ends"].append(unit_ends)
                cols["ends"].append(list(accumulate(len(block) for block, _ in found)))
                cols["frames"].append([compressed(block) for block, _ in found])
            yield _batch(batch.column("doc_id"), cols, _STORED)

    return written(docs.select(F.col("doc_id").cast("long"), text_of().alias("_text"))
                   .mapInArrow(split, _ddl(_STORED)), "frames")


def _batch(ids: pa.Array, cols: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(cols[f.name], f.type) for f in list(schema)[1:])], schema=schema)


def choose(stored: DataFrame, seed: str = SEED, rate: int = RATE,
           spm_rate: int = SPM_RATE) -> DataFrame:
    """Adds form, first_cut and second_cut (units), from the identifier and n alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"),
                             F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)

    def draw(i: int):
        return F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("long")

    first, second = draw(0) % (F.col("n") + 1), draw(1) % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("marked") | (draw(2) % 100 >= rate)
    return stored.withColumn("_digest", digest).select(
        *stored.columns, F.least(first, second).alias("first_cut"),
        F.greatest(first, second).alias("second_cut"),
        F.when(plain, "plain").when(draw(3) % 100 < spm_rate, "spm").otherwise("psm").alias("form"))


def transform(chosen: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, ends, output (frames)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {name: [] for name in _OUTPUT.names[1:]}
            for row in batch.drop_columns(["doc_id"]).to_pylist():
                text = Frames(row["ends"], row["frames"])
                cuts = (0, 0)
                if row["form"] != "plain":
                    cuts = tuple(text.after_units(row[c], row["unit_ends"])
                                 for c in ("first_cut", "second_cut"))
                output = rearranged(text, cuts, row["form"])
                for name, value in zip(_OUTPUT.names[1:], (
                        row["n"], row["form"], *([None] * 2 if row["form"] == "plain" else
                                                 [cuts[0], cuts[1] - cuts[0]]),
                        output.ends, output.frames)):
                    cols[name].append(value)
            yield _batch(batch.column("doc_id"), cols, _OUTPUT)

    return chosen.mapInArrow(cut, _ddl(_OUTPUT))


def fill_in_middle(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
                   frame_units: int = FRAME_UNITS) -> DataFrame:
    """The rearranged documents; ``output`` holds zstandard frames whose texts, joined in
    their order, are the output, and ``ends`` the cumulative characters."""
    return transform(choose(store(docs, frame_units), seed, rate, spm_rate))


def restore(outputs: DataFrame) -> DataFrame:
    """doc_id, text: rebuilt from ``output``, ``ends`` and ``form`` alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["".join(restored(Frames(row["ends"], row["output"]), row["form"]))
                     for row in batch.drop_columns(["doc_id"]).to_pylist()]
            yield _batch(batch.column("doc_id"), {"text": texts}, schema)

    return outputs.select("doc_id", "form", "ends", "output").mapInArrow(rebuild, _ddl(schema))


def digests(outputs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""

    def sha(pieces: Iterator[str]) -> str:
        total = hashlib.sha256()
        for piece in pieces:
            total.update(piece.encode("utf-8"))
        return total.hexdigest()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["form", "ends", "output"]).to_pylist()
            found = [Frames(row["ends"], row["output"]) for row in rows]
            sums = [pa.array([sha(f.pieces(0, f.chars)) for f in found], pa.string()),
                    pa.array([sha(restored(f, row["form"])) for f, row in zip(found, rows)], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _DIGESTS.names[:5]), *sums],
                                             schema=_DIGESTS)

    return outputs.mapInArrow(summed, _ddl(_DIGESTS))
