"""Operator 12: document fingerprints of improbable features.

Every window of 32 bytes has an entropy. How common each entropy is, in thousandths of
the largest, is counted over all windows of the corpus, and windows are ranked by it:
the rarest entropies first. Within every run of 32 neighbouring windows the first of
the rarest scores a point, and windows with 16 points or more are the text's features.
Each is hashed to five bits of a Bloom filter of 256 bytes; after 160 different
features the next filter of the chain begins. Two fingerprints are compared filter by
filter: the bits they share, less those that chance would give, over the most that
they could share less chance.

A text is compared with the next document (by descending doc_id), and with itself
after its last third was replaced by the next document's beginning. Documents are
sorted over range partitions; only a partition's last document has its successor
elsewhere, so the first and last document of each are kept and paired afterwards.

Windows of nearly one byte (entropy below a tenth) make no feature. A text without a
feature, such as one below 32 bytes, has itself as its only one; long texts are
searched piece by piece with the same result.

Defined cases: a null text is empty and an empty text has an empty fingerprint, alike
(1) to an empty one and unlike (0) to all others; null doc_ids come last; documents
that share an id stand in the order of their texts' xxhash64, and equal rows follow
each other; a document alone is its own successor; an empty table gives an empty
result; other columns are not read.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bodega.llm.common import _join, scratch, sliding_min

WINDOW = 32                # bytes of a feature
SCOPE = 32                 # neighbouring windows of which one scores; not above WINDOW
POINTS = 16                # for a feature
LEVELS = 1000              # entropies are told apart in this many steps
LEAST = 100                # entropies below make no feature
FILTER_BITS = 2048
FILTER_BYTES = FILTER_BITS // 8
HASHES = 5
PER_FILTER = 160
GROUP = 1 << 21            # bytes of texts handled together
PIECE = 1 << 20            # windows handled at once
RANGE_BYTES = 64 << 20
MAX_RANGES = 20_000
_NEVER = np.int64(1 << 62)
_AT = np.int64((1 << 40) - 1)

#: c * log2(c), in 65536ths; a window's entropy is that of WINDOW less the sum over its bytes.
_CLOG = np.array([0] + [round(c * math.log2(c) * 65536) for c in range(1, WINDOW + 1)], np.int64)
_GAIN, _LOSS = np.diff(_CLOG, append=0).astype(np.int32), -np.diff(_CLOG, prepend=0).astype(np.int32)


def entropy_levels(x: np.ndarray) -> np.ndarray:
    """Of every window of ``x`` (bytes) its entropy, 0 to LEVELS."""
    m = len(x) - WINDOW + 1
    if m <= 0:
        return np.empty(0, np.int64)
    ahead, behind = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
    for lag in range(1, WINDOW):
        same = x[:-lag] == x[lag:]
        ahead[:-lag] += same
        behind[lag:] += same
    # from a window to the next, the byte left behind counts one less and the new one one more
    step = _LOSS[ahead[:m - 1] + 1] + _GAIN[behind[WINDOW:WINDOW + m - 1]]
    total = np.empty(m, np.int64)
    total[0] = _CLOG[np.bincount(x[:WINDOW])].sum()
    np.cumsum(step, out=total[1:])
    total[1:] += total[0]
    return LEVELS - total * LEVELS // _CLOG[WINDOW]


@dataclass
class Rarity:
    """Per entropy level its place when levels are sorted by how rare they are."""
    place: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Rarity:
        place = np.empty(LEVELS + 1, np.int64)
        place[np.argsort(counts, kind="stable")] = np.arange(LEVELS + 1)
        return cls(place)


def learn_rarity(docs: DataFrame) -> Rarity:
    """Counts of the entropies of all windows of all texts: LEVELS + 1 numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for b in batches:
            for x in b.column(0):
                raw = np.frombuffer(x.as_buffer() or b"", np.uint8) if x.is_valid else np.empty(0, np.uint8)
                for a in range(0, max(0, len(raw) - WINDOW + 1), PIECE):
                    total += np.bincount(entropy_levels(raw[a:a + PIECE + WINDOW - 1]), minlength=LEVELS + 1)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["level", "n"])

    texts = docs.select(F.col("text").cast("string").cast("binary").alias("text"))
    counts = np.zeros(LEVELS + 1, np.int64)
    for r in texts.mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r.level] = r.n
    return Rarity.of(counts)


def feature_places(x: np.ndarray, ends: np.ndarray, rarity: Rarity) -> np.ndarray:
    """Where features start in ``x``, texts one behind the other that stop at ``ends``."""
    m, out = len(x) - WINDOW + 1, []
    margin = SCOPE - 1
    for a in range(0, max(0, m), PIECE):
        b = min(m, a + PIECE)
        lo, hi = max(0, a - margin), min(m, b + margin)
        level = entropy_levels(x[lo:hi + WINDOW - 1])
        at = np.arange(lo, hi)
        key = rarity.place[level] << np.int64(40) | at
        key[(level < LEAST) | (at + WINDOW > ends[np.searchsorted(ends, at, "right")])] = _NEVER
        key = np.concatenate([np.full(margin, _NEVER), key, np.full(margin, _NEVER)])
        best = sliding_min(key, SCOPE)
        points = np.bincount((best[best < _NEVER] & _AT) - lo, minlength=hi - lo)[a - lo:b - lo]
        out.append(np.nonzero(points >= POINTS)[0] + a)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def fingerprints(texts: list[bytes], rarity: Rarity) -> list[bytes]:
    """The chained filters of every text, one behind the other."""
    out, a = [], 0
    while a < len(texts):
        b, size = a + 1, len(texts[a])
        while b < len(texts) and size + len(texts[b]) <= GROUP:
            size += len(texts[b])
            b += 1
        out += _group(texts[a:b], rarity)
        a = b
    return out


def _group(texts: list[bytes], rarity: Rarity) -> list[bytes]:
    x = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    at = feature_places(x, ends, rarity)
    doc = np.searchsorted(ends, at, "right")
    if len(at):
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, WINDOW)[at]).view("<u8").astype(np.uint64)
        value = words[:, 0]
        for j in range(1, words.shape[1]):
            value = _join(value, words[:, j])
    else:
        value = np.empty(0, np.uint64)
    bare = np.setdiff1d(np.nonzero([len(t) > 0 for t in texts])[0], doc)
    doc = np.concatenate([doc, bare])
    value = np.concatenate([value, np.array([xxhash.xxh64_intdigest(texts[i]) for i in bare], np.uint64)])
    # each feature once per text, in the order of the text
    order = np.lexsort((value, doc))  # stable: equal ones stay in order
    same = np.concatenate([[False], (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])]) if len(order) else np.empty(0, bool)
    keep = np.sort(order[~same])
    keep = keep[np.argsort(doc[keep], kind="stable")]
    doc, value = doc[keep], value[keep]
    n = np.bincount(doc, minlength=len(texts))
    chain = -(-n // PER_FILTER)
    first = np.cumsum(chain) - chain
    which = first[doc] + (np.arange(len(doc)) - (np.cumsum(n) - n)[doc]) // PER_FILTER
    bits = np.zeros((int(chain.sum()), FILTER_BITS), np.uint8)
    for j in range(HASHES):
        bits[which, (value >> np.uint64(11 * j) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1).tobytes()
    return [packed[i * FILTER_BYTES:(i + c) * FILTER_BYTES] for i, c in zip(first.tolist(), chain.tolist())]


def _directed(a: np.ndarray, b: np.ndarray) -> float:
    """Filters of ``a``, each against its best of ``b``; fuller filters weigh more."""
    na, nb = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    best = np.zeros(len(a))
    for i in range(0, len(b), 64):
        part, n = b[i:i + 64], nb[i:i + 64]
        for j in range(0, len(a), 64):
            shared = np.bitwise_count(a[j:j + 64, None] & part[None]).sum(axis=2, dtype=np.int64)
            chance = na[j:j + 64, None] * n[None] / FILTER_BITS
            score = (shared - chance) / (np.minimum(na[j:j + 64, None], n[None]) - chance)
            best[j:j + 64] = np.maximum(best[j:j + 64], score.max(axis=1))
    return float((best * na).sum() / na.sum())


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: the shorter chain's filters against the longer one's; chains of one length
    are compared both ways and the mean is taken."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(v, np.uint64).reshape(-1, FILTER_BYTES // 8) for v in sorted((a, b), key=lambda v: (len(v), v)))
    found = _directed(x, y)
    return min(1.0, max(0.0, found if len(x) < len(y) else (found + _directed(y, x)) / 2))


def edited(text: str, after: str) -> str:
    """The last third of ``text`` replaced by as much of the beginning of ``after``."""
    k = len(text) // 3
    return text[:len(text) - k] + after[:k]


DONE, HEAD, TAIL = 0, 1, 2
_ROWS = ("p int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double, text string, kind int")
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.large_string(), pa.int32()]
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string() if t == pa.large_string() else t for t in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split(" ")[0] for c in _ROWS.split(", ")])


def _answers(rows: list[tuple], rarity: Rarity) -> list[tuple]:
    """rows: (doc_id, text, fingerprint, next text, next fingerprint)."""
    changed = [edited(t, after) for _, t, _, after, _ in rows]
    raw = [c.encode() for c in changed]
    prints = fingerprints(raw, rarity)
    return [(None, i, len(t), hashlib.sha256(r).hexdigest(), f.hex(), e.hex(), likeness(f, e), likeness(f, nf), None, DONE)
            for (i, t, f, _, nf), r, e in zip(rows, raw, prints)]


def compare_with_next(docs: DataFrame, rarity: Rarity, ranges: int | None = None, group: int = GROUP) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint
    (hex), near_edited and near_next (0 to 1)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if ranges is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        ranges = min(MAX_RANGES, max(2 * spark.sparkContext.defaultParallelism, size // RANGE_BYTES))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held, prints, fresh, size = None, [], [], [], 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            """Answer all held rows but the last, whose successor has not come yet."""
            nonlocal held, prints, fresh, size
            prints += fingerprints(fresh, rarity)
            ready = [(i, t, f, held[k + 1][1], prints[k + 1]) for k, ((i, t), f) in enumerate(zip(held[:-1], prints))]
            if ready:
                yield _batch(_answers(ready, rarity))
            held, prints, fresh, size = held[-1:], prints[-1:], [], 0
            if final:
                (i, t), = held
                yield _batch([(p, i, None, None, prints[0].hex(), None, None, None, t, TAIL)])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                raw = text.encode()
                held.append((doc_id, text))
                fresh.append(raw)
                size += len(raw)
                if p is None:
                    p = TaskContext.get().partitionId()
                    yield _batch([(p, doc_id, None, None, fingerprints([raw], rarity)[0].hex(), None, None, None, text, HEAD)])
                if size >= group:
                    yield from flush(False)
        if held:
            yield from flush(True)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield _batch(_answers([(r["doc_id"], r["text"], bytes.fromhex(r["fingerprint"]), r["next_text"], bytes.fromhex(r["next_print"]))], rarity))

    path = scratch(spark, "rare-features")
    ranged = rows.repartitionByRange(int(ranges), *order[:2]).sortWithinPartitions(*order)
    ranged.mapInArrow(run, _ROWS).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    found = spark.read.schema(_ROWS).parquet(path)
    heads = found.where(F.col("kind") == HEAD).select(F.col("p").alias("next_p"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    # one number a partition: partitions without rows are stepped over, the first follows the last
    ring = heads.select(F.col("next_p").alias("p"), F.coalesce(F.lead("next_p").over(Window.orderBy("next_p")), F.min("next_p").over(Window.partitionBy())).alias("next_p"))
    tails = found.where(F.col("kind") == TAIL).select("p", "doc_id", "text", "fingerprint").join(ring, "p").join(heads, "next_p")
    closed = tails.mapInArrow(close, _ROWS)
    return found.where(F.col("kind") == DONE).select(*COLUMNS).unionByName(closed.select(*COLUMNS))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs`` with their likeness to the next document and to the edited
    text, by the entropies of ``docs``."""
    return compare_with_next(docs, learn_rarity(docs))
