"""Operator 2: removal of repeated passages behind a count-min prefilter.

A window is a run of ``window`` words; each word covered by a window that also
starts in a document with a smaller id goes.

1. One pass counts, in a count-min sketch, the documents that hold each
   window. All windows that share their smallest 25-word hash (their anchor)
   share a count: a window's documents all hold its anchor, so the estimate is
   never too low, and there is one anchor per 13 words. A partition's sketch is
   sparse (the cells it touched); sketches are merged by ranges of cells, in
   two steps, into bitmaps "counted twice or more", written as files to the
   shared folder and mapped by the workers of the second pass. The sketch's
   width follows the bytes of the input.
2. The same pass hashes whole word sequences. In a group of equal documents
   all but the smallest id are copies: every window of theirs starts in it.
   They are answered at once, so a large group of copies costs one row each.
3. The second pass emits only the windows estimated repeated (two 64-bit
   hashes, id, place). They are grouped exactly, with a map-side minimum, and
   the windows found in a smaller document go back to their documents.

Defined cases: a null text has no words and its kept text is empty; null
doc_ids neither remove nor lose a word; rows that share a doc_id do not remove
each other's words, but are told apart by their text; an empty table gives an
empty result. Other columns are carried as they are, inside one struct, so no
name can clash.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodega.llm.common import (covered, doc_key, local_path, mapped, pack, scratch, sliding_min, stored, unpack,
                               window_hashes, word_hashes, write_file)

WINDOW = 50
ROWS = 2                   # hash rows of the sketch
CELLS_PER_ANCHOR = 4
BLOCK_BITS = 22            # cells per merged block and file, as a power of two
MERGE_FAN = 16             # first merge step: partitions are merged in so many groups per block
COPY_FILES = 64
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def anchors(wh: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of every window the smallest hash of its ``window // 2``-word runs."""
    half = window // 2
    return sliding_min(window_hashes(wh, half), window - half + 1)


def cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((values * _MULT[row]) >> np.uint64(64 - bits)).astype(np.int64)


def _first_pass(rows: DataFrame, window: int, bits: int) -> DataFrame:
    """kind 0: doc_id, key and hash of every document's word sequence; kind 1: the
    partition's sketch, per row and block the cells touched and those touched twice."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
                        ("n_words", pa.int64()), ("row", pa.int32()), ("block", pa.int64()), ("salt", pa.int32()), ("payload", pa.binary())])

    def batch(n: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % MERGE_FAN
        for b in batches:
            ids, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            h1, h2, sizes, found = [], [], [], []
            for doc_id, x in zip(ids, b.column(2)):
                wh = word_hashes((x.as_py() or b"").split())
                whole = [int(window_hashes(wh, len(wh), seed)[0]) if len(wh) else 0 for seed in (1, 2)]
                h1.append(whole[0])
                h2.append(whole[1])
                sizes.append(len(wh))
                if len(wh) >= window and doc_id is not None:
                    found.append(np.unique(anchors(wh, window)))
            n = b.num_rows
            yield batch(n, kind=np.zeros(n, np.int32), doc_id=ids, key=keys, a=np.array(h1, np.uint64).view(np.int64), b=np.array(h2, np.uint64).view(np.int64), n_words=sizes)
            values = np.concatenate(found) if found else np.empty(0, np.uint64)
            for row in range(ROWS):
                at, counts = np.unique(cells(values, row, bits), return_counts=True)
                home = at >> BLOCK_BITS
                cut = np.flatnonzero(np.diff(home)) + 1
                parts = list(zip(np.split(at, cut), np.split(counts, cut))) if len(at) else []
                if parts:
                    yield batch(len(parts), kind=np.ones(len(parts), np.int32), row=np.full(len(parts), row, np.int32),
                                block=[int(p[0] >> BLOCK_BITS) for p, _ in parts], salt=np.full(len(parts), salt, np.int32),
                                payload=[_pack_cells(p & ((1 << BLOCK_BITS) - 1), c > 1) for p, c in parts])

    return rows.select("doc_id", "key", "text").mapInArrow(
        run, "kind int, doc_id long, key long, a long, b long, n_words long, row int, block long, salt int, payload binary")


def _pack_cells(at: np.ndarray, twice: np.ndarray) -> bytes:
    return pack(np.diff(at, prepend=0), np.flatnonzero(twice))


def _merge(payloads: list[bytes]) -> np.ndarray:
    """Counts of a block's cells, saturated at 2."""
    total = np.zeros(1 << BLOCK_BITS, np.uint8)
    for p in payloads:
        steps, twice = unpack(p)
        at = np.cumsum(steps)
        total[at] = np.minimum(total[at] + 1, 2)
        total[at[twice]] = 2
    return total


def _write_sketch(partials: DataFrame, folder: str) -> set[str]:
    """Writes the sketch's files; returns their names."""
    def halfway(t: pa.Table) -> pa.Table:
        total = _merge(t.column("payload").to_pylist())
        at = np.flatnonzero(total)
        return pa.table({"row": t.column("row").slice(0, 1), "block": t.column("block").slice(0, 1),
                         "payload": pa.array([_pack_cells(at, total[at] > 1)], pa.binary())})

    def finish(t: pa.Table) -> pa.Table:
        row, block = t.column("row")[0].as_py(), t.column("block")[0].as_py()
        bitmap = np.packbits(_merge(t.column("payload").to_pylist()) > 1, bitorder="little")
        write_file(f"{folder}/sketch-{row}-{block}", bitmap.tobytes())
        return pa.table({"row": pa.array([row], pa.int32()), "block": pa.array([block], pa.int64())})

    written = (partials.groupBy("row", "block", "salt").applyInArrow(halfway, "row int, block long, payload binary")
               .groupBy("row", "block").applyInArrow(finish, "row int, block long").collect())
    return {f"sketch-{r['row']}-{r['block']}" for r in written}


def _write_copies(copies: DataFrame, folder: str) -> set[str]:
    """Sorted keys of the copies, by the key's last bits; returns the files' names."""
    def save(t: pa.Table) -> pa.Table:
        keys, part = np.unique(t.column("key").to_numpy()), t.column("part")[0].as_py()
        write_file(f"{folder}/copies-{part}", keys.astype("<i8").tobytes())
        return pa.table({"part": pa.array([part], pa.int64())})

    written = (copies.select("key", F.pmod("key", F.lit(COPY_FILES)).alias("part")).groupBy("part")
               .applyInArrow(save, "part long").collect())
    return {f"copies-{r['part']}" for r in written}


class _Prefilter:
    """A worker's view of the files of the first pass, of which ``written`` are there:
    one of them that this worker does not see is an error, not an empty file."""

    def __init__(self, folder: str, bits: int, written: set[str]):
        self.folder, self.bits, self.written, self.files = folder, bits, written, {}

    def _file(self, name: str, kind: str) -> np.ndarray:
        if name not in self.files:
            self.files[name] = mapped(f"{self.folder}/{name}", kind) if name in self.written else np.empty(0, kind)
        return self.files[name]

    def is_copy(self, key: int) -> bool:
        keys = self._file(f"copies-{key % COPY_FILES}", "<i8")
        at = np.searchsorted(keys, key)
        return bool(at < len(keys) and keys[at] == key)

    def repeated(self, values: np.ndarray) -> np.ndarray:
        """Which values are counted twice or more in every row of the sketch."""
        out = np.ones(len(values), bool)
        for row in range(ROWS):
            left = np.flatnonzero(out)
            at = cells(values[left], row, self.bits)
            home = at >> BLOCK_BITS
            hit = np.zeros(len(left), bool)
            for block in np.unique(home):
                bitmap = self._file(f"sketch-{row}-{block}", np.uint8)
                if len(bitmap):
                    here = np.flatnonzero(home == block)
                    inside = at[here] & ((1 << BLOCK_BITS) - 1)
                    hit[here] = (bitmap[inside >> 3] >> (inside & 7).astype(np.uint8)) & 1 == 1
            out[left] = hit
        return out


def _second_pass(rows: DataFrame, folder: str, window: int, bits: int, written: set[str]) -> DataFrame:
    """doc_id, key, place and two hashes of every window estimated repeated."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("place", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Prefilter(folder, bits, written)
        for b in batches:
            for doc_id, key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if doc_id is None or seen.is_copy(key):
                    continue
                wh = word_hashes((x.as_py() or b"").split())
                if len(wh) < window:
                    continue
                values, back = np.unique(anchors(wh, window), return_inverse=True)
                places = np.flatnonzero(seen.repeated(values)[back])
                if len(places):
                    n = len(places)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, doc_id)), pa.array(np.full(n, key)), pa.array(places.astype(np.int32)),
                         pa.array(window_hashes(wh, window, 1)[places].view(np.int64)),
                         pa.array(window_hashes(wh, window, 2)[places].view(np.int64))], schema=schema)

    return rows.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, place int, a long, b long")


def _cut(rows: DataFrame, window: int, unchanged_as_is: bool) -> DataFrame:
    """text and the places of the windows to remove -> counts and kept text; place -1
    removes everything."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = StructType(rows.schema["rest"].dataType.fields)
    out = StructType().add("rest", schema).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for x, places in zip(b.column(1), b.column(2)):
                words = (x.as_py() or b"").split()
                n = len(words)
                if places.as_py():
                    at = np.asarray(places.values.to_numpy(), np.int64)
                    gone = np.ones(n, bool) if at[0] < 0 else covered(at, window, n)
                    left = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    left = words
                n_words.append(n)
                n_removed.append(n - len(left))
                kept.append(x.as_py() if unchanged_as_is and len(left) == n else b" ".join(left))
            texts = pc.cast(pa.array(kept, pa.binary()), pa.string(), safe=False)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), texts], schema=arrow)

    return rows.select("rest", "text", "places").mapInArrow(run, out)


def remove_repeats(docs: DataFrame, window: int = WINDOW, unchanged_as_is: bool = False) -> DataFrame:
    """Per row of ``docs``: rest (a struct of all columns but the text), n_words,
    n_removed, kept (the words left, joined by one space; with ``unchanged_as_is`` a
    text that loses nothing stays as it was)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("key"),
                       F.col("text").cast("string").cast("binary").alias("text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    expected = size // 6 * 2 // (window // 2 + 1)  # anchors: 2 per so many words
    bits = max(BLOCK_BITS, (CELLS_PER_ANCHOR * max(1, expected) - 1).bit_length())
    folder = local_path(scratch(spark, "substring-sketch"))

    first = stored(_first_pass(rows, window, bits), "substring-first")
    whole = first.where(f"kind = 0 AND doc_id IS NOT NULL AND n_words >= {int(window)}").select("doc_id", "key", "a", "b")
    smallest = whole.groupBy("a", "b").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest")).where("smallest < largest")
    copies = stored(whole.join(smallest, ["a", "b"]).where("doc_id > smallest").select("doc_id", "key").distinct(), "substring-copies")
    written = _write_copies(copies, folder) | _write_sketch(first.where("kind = 1").select("row", "block", "salt", "payload"), folder)

    windows = stored(_second_pass(rows, folder, window, bits, written), "substring-windows")
    repeated = (windows.groupBy("a", "b").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest"))
                .where("smallest < largest").select("a", "b", "smallest"))
    # written first: a join that reuses the grouping's partitions could not split a hot window
    repeated = stored(repeated, "substring-repeated")
    later = windows.join(repeated, ["a", "b"]).where("doc_id > smallest").select("doc_id", "key", "place")
    gone = later.unionByName(copies.withColumn("place", F.lit(-1))).groupBy("doc_id", "key").agg(F.collect_list("place").alias("places"))
    found = rows.join(gone.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"), "places"),
                      (F.col("doc_id") == F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left")
    return _cut(found.select("rest", "text", "places"), window, unchanged_as_is)
