"""Operator 10: benchmark decontamination by winnowing.

Both sides hash every run of ``k`` words and keep, of each window's runs, those
with the smallest hash. Two texts that share a whole window share the smallest
hash of it too, at the same place, so every shared window has a common
fingerprint. Fingerprints that occur in the benchmark (a bitmap of fixed size,
built by Spark, tells most others apart at once) are joined to the benchmark's,
and each match is extended word by word to both sides, as far as a window can
reach; a match of at least a window's words is a hit. Each fingerprint carries
those words, so no text moves. Items of fewer words than a window are one
window each and are matched as a whole, by the hash of as many words.

Defined cases: a null text or item has no words and matches nothing; an item
without words is no item; equal items count each by its own id; the words of an item
with a null id count as hit and name no item; null doc_ids
and repeated rows are answered each; an empty benchmark leaves every document
clean; an empty table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodega.llm.common import doc_key, sliding_min, stored, window_hashes, word_hashes

WINDOW = 10
K = 5
BITMAP_BITS = 24           # 2 MB; fuller bitmaps pass more fingerprints on, never fewer
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_FOLD).split()


def selected(wh: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs that are smallest in some window."""
    g = window_hashes(wh, k)
    span = window - k + 1
    low = sliding_min(g, span)
    keep = np.zeros(len(g), bool)
    for j in range(span):
        keep[j:j + len(low)] |= g[j:j + len(low)] == low
    at = np.flatnonzero(keep) if len(low) else np.empty(0, np.int64)
    return at, g[at]


def _context(words: list[bytes], at: int, window: int, k: int) -> tuple[int, str]:
    """How many words stand before the run, and the words from there to as far as a
    window that holds the run can reach."""
    begin = max(0, at - (window - k))
    return at - begin, b" ".join(words[begin:at + window]).decode("utf-8", "replace")


def _short(wh: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of ``n`` words, apart from those of other lengths."""
    return window_hashes(wh, n, 1000 + n)


def benchmark_prints(items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """hash, n (0, or the words of a short item), lead, words, items: equal prints of
    several items are one row."""
    schema = pa.schema([("item_id", pa.string()), ("hash", pa.int64()), ("n", pa.int32()), ("lead", pa.int32()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, x in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(x.as_py())
                wh = word_hashes(words)
                if 0 < len(words) < window:
                    out.append((item, int(_short(wh, len(words)).view(np.int64)[0]), len(words), 0, b" ".join(words).decode("utf-8", "replace")))
                else:
                    for at, h in zip(*selected(wh, window, k)):
                        out.append((item, int(h.view(np.int64)), 0, *_context(words, int(at), window, k)))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    # the ids without nulls: an item without an id counts in what is hit, and names none
    return (rows.mapInArrow(run, "item_id string, hash long, n int, lead int, words string")
            .groupBy("hash", "n", "lead", "words").agg(F.array_sort(F.collect_set("item_id")).alias("items")))


def _bitmap(prints: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    place = F.pmod("hash", F.lit(1 << bits)) + 1
    parts = (prints.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")).collect())
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts:
        part = np.frombuffer(r["bitmap"], np.uint8)
        at = (r["bucket"] - 1) * 4096
        out[at:at + 4096] = part[:len(out) - at]
    return out


def document_prints(docs: DataFrame, bitmap: np.ndarray, lengths: list[int], window: int = WINDOW, k: int = K,
                    bits: int = BITMAP_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, key, n_words, and the prints that the bitmap lets
    through: hash, n, place, lead, words."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    one = pa.struct([("hash", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("lead", pa.int32()), ("words", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("prints", pa.list_(one))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)

        def known(h: np.ndarray) -> np.ndarray:
            at = h & np.uint64((1 << bits) - 1)
            return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for b in batches:
            sizes, found = [], []
            for x in b.column(2):
                words = words_of(x.as_py())
                sizes.append(len(words))
                wh = word_hashes(words)
                at, h = selected(wh, window, k)
                ok = known(h)
                out = []
                for p, v in zip(at[ok].tolist(), h[ok].view(np.int64).tolist()):
                    lead, text = _context(words, p, window, k)
                    out.append({"hash": v, "n": 0, "place": p, "lead": lead, "words": text})
                for n in lengths:
                    h = _short(wh, n)
                    for p in np.flatnonzero(known(h)).tolist():
                        out.append({"hash": int(h[p].view(np.int64)), "n": n, "place": p, "lead": 0,
                                    "words": b" ".join(words[p:p + n]).decode("utf-8", "replace")})
                found.append(out)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(one))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("key"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, n_words long, prints array<struct<hash:long,n:int,place:int,lead:int,words:string>>")


def _extend(matches: DataFrame, window: int, k: int) -> DataFrame:
    """Matched prints -> the words they cover (first, last) where that makes a window."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, last, keep = [], [], []
            c = {f: b.column(i).to_pylist() for i, f in enumerate(["n", "place", "lead", "words", "item_lead", "item_words"], 2)}
            for i in range(b.num_rows):
                x, y = c["words"][i].split(" "), c["item_words"][i].split(" ")
                p, q, n = c["lead"][i], c["item_lead"][i], c["n"][i]
                if n:
                    if x == y:
                        keep.append(i)
                        first.append(c["place"][i])
                        last.append(c["place"][i] + n - 1)
                    continue
                if x[p:p + k] != y[q:q + k]:
                    continue
                left = right = 0
                while left < min(p, q) and x[p - 1 - left] == y[q - 1 - left]:
                    left += 1
                while p + k + right < len(x) and q + k + right < len(y) and x[p + k + right] == y[q + k + right]:
                    right += 1
                if left + k + right >= window:
                    keep.append(i)
                    first.append(c["place"][i] - left)
                    last.append(c["place"][i] + k + right - 1)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(first, pa.int32()), pa.array(last, pa.int32()),
                                              b.column(8).take(rows).cast(pa.list_(pa.string()))], schema=schema)

    return (matches.select("doc_id", "key", "n", "place", "lead", "words", "item_lead", "item_words", "items")
            .mapInArrow(run, "doc_id long, key long, first int, last int, items array<string>"))


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs``: doc_id, text; ``items``: item_id, text. Per row of ``docs``: doc_id, key,
    n_words, n_hit, items (sorted ids)."""
    prints = stored(benchmark_prints(items, window, k), "benchmark-prints")
    lengths = sorted(r["n"] for r in prints.where("n > 0").select("n").distinct().collect())
    found = stored(document_prints(docs, _bitmap(prints), lengths, window, k), "document-prints")
    theirs = prints.select("hash", "n", F.col("lead").alias("item_lead"), F.col("words").alias("item_words"), "items")
    matches = found.select("doc_id", "key", F.explode("prints").alias("p")).select("doc_id", "key", "p.*").join(theirs, ["hash", "n"])
    hits = (_extend(matches, window, k).groupBy("doc_id", "key")
            .agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last"))))).cast("long").alias("n_hit"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
            .select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), "n_hit", "items"))
    return (found.select("doc_id", "key", "n_words")
            .join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
            .select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The rows of ``docs``, as they are, without a word in an item's window."""
    bad = find_contamination(docs, items, window, k).where("n_hit > 0").select("key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key().alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")
