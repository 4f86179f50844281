"""Operator 4: token ids as binary files with Elias-Fano document boundaries.

Texts are brought into ascending doc_id order by a range shuffle; each task
encodes its texts and writes shards. A shard is one row of a Parquet table
(committed by Spark, so a retried task leaves nothing behind): the
concatenated ids, 16 bits each if the vocabulary allows it, and two
Elias-Fano sequences, the document ends and the doc_ids, from which select
answers "where does document i begin" without a table of 64-bit offsets.

Elias-Fano: of n ascending numbers below u, the lowest floor(log2(u / n)) bits
are stored as they are, and the rest in unary, one bit per number plus at most
n zeros: at most 2 + log2(u / n) bits each. Select reads a sampled position
and counts bits from there.

Defined cases: a null or empty text is a document of the end id alone; null
doc_ids come first; rows that share a doc_id are kept, ordered by a hash of
their text; an empty table writes no shard; other columns are not read.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bodega.llm.common import text_columns
from bodega.llm.tokens import UnitPool, load_tokenizer, ragged, slices_by_bytes

END_ID = 0
SHARD_TOKENS = 1 << 20     # a shard is closed at the first document end after so many ids
GROUP_BYTES = 8 << 20      # texts encoded at a time
SAMPLE = 256               # one select sample per so many numbers
READ_DOCS = 16 * SAMPLE    # documents whose ends are selected at a time


class EliasFano:
    """An ascending sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        x = np.asarray(values, np.uint64)
        n = len(x)
        top = int(x[-1]) + 1 if n else 1
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :bits]
        ones = (x >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"),
                   ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        parts = [a.tobytes() for a in (self.low, self.high, self.samples)]
        return struct.pack("<QB3Q", self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, *sizes = struct.unpack_from("<QB3Q", data)
        at, parts = struct.calcsize("<QB3Q"), []
        for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4")):
            parts.append(np.frombuffer(data[at:at + size], kind))
            at += size
        return cls(n, bits, *parts)

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int, j: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(j - i, np.uint64)
        a, b = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[a // 8:-(-b // 8)], bitorder="little")[a % 8:a % 8 + b - a]
        wide = np.zeros((j - i, 64), np.uint8)
        wide[:, :self.low_bits] = bits.reshape(j - i, self.low_bits)
        return np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel()

    def select(self, i: int) -> int:
        """The i-th number: the unary part is read from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        step = 64
        while True:
            byte = at // 8
            bits = np.unpackbits(self.high[byte:byte + step], bitorder="little")
            ones = np.flatnonzero(bits[at % 8:])
            if len(ones) > left:
                pos = at + int(ones[left])
                break
            step *= 4
        return (pos - i) << self.low_bits | int(self._low(i, i + 1)[0])

    def select_range(self, i: int, j: int) -> np.ndarray:
        """Numbers i to j - 1: the unary part between the samples around them is read."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.empty(0, np.uint64)
        first, last = i // SAMPLE, -(-j // SAMPLE)
        a = int(self.samples[first])
        b = int(self.samples[last]) if last < len(self.samples) else 8 * len(self.high)
        ones = a + np.flatnonzero(np.unpackbits(self.high[a // 8:-(-b // 8)], bitorder="little")[a % 8:])
        pos = ones[i - first * SAMPLE:j - first * SAMPLE]
        return ((pos - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i, j)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(0, self.n)


def encode_units(name: str):
    """units -> ids by the tokenizers library. Units without white space inside are
    joined into longer texts (they tokenize alone) and the ids dealt back by their
    bytes."""
    tok = load_tokenizer(name)
    vocab = tok.get_vocab(with_added_tokens=True)
    size = np.zeros(max(vocab.values()) + 1, np.int64)
    for text, i in vocab.items():
        size[i] = len(text)  # one character per byte; special strings are ASCII

    def make(units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        plain, rest = [], []
        for u in units:
            (plain if u[0] == " " and u.isprintable() and len(u) > 1 and u.rfind(" ") == 0 else rest).append(u)
        lens, flats = [], []
        for a in range(0, len(plain), 2000):
            part = plain[a:a + 2000]
            ids = np.array(tok.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.int32)
            want = np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in part])
            at = np.searchsorted(np.cumsum(size[ids]), want) + 1
            lens.append(np.diff(at, prepend=0))
            flats.append(ids)
        more, flat = ragged([e.ids for e in tok.encode_batch_fast(rest, add_special_tokens=False)])
        return plain + rest, np.concatenate([*lens, more]), np.concatenate([*flats, flat])

    return make


_POOLS: dict = {}


def _pool(name: str) -> UnitPool:
    """One pool per worker process, kept between tasks."""
    if name not in _POOLS:
        tok = load_tokenizer(name)
        _POOLS[name] = UnitPool(encode_units(name), marks={m: tok.encode(m, add_special_tokens=False).ids[0] for m in ".,"})
    return _POOLS[name]


SHARD_SCHEMA = ("part int, seq int, start_in_part long, n_docs long, n_tokens long, n_null long, id_base long, width int, "
                "ids binary, ends binary, doc_ids binary")


def _shard_row(part: int, seq: int, start: int, doc_ids: list, arrays: list[np.ndarray], kind) -> dict:
    nulls = sum(1 for d in doc_ids if d is None)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    lens = np.fromiter(map(len, arrays), np.int64, len(arrays))
    ids = np.concatenate(arrays)
    return {"part": part, "seq": seq, "start_in_part": start, "n_docs": len(doc_ids), "n_tokens": len(ids), "n_null": nulls,
            "id_base": base, "width": np.dtype(kind).itemsize, "ids": ids.astype(kind).tobytes(),
            "ends": EliasFano.encode(np.cumsum(lens)).to_bytes(),
            "doc_ids": EliasFano.encode(known.view(np.uint64) - np.int64(base).view(np.uint64)).to_bytes()}


def write_token_shards(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID,
                       shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text and write the shards under ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    top = max(load_tokenizer(tokenizer).get_vocab(with_added_tokens=True).values())
    kind = "<u2" if max(top, end_id) < 1 << 16 else "<u4"
    schema = to_arrow_schema(_parse_datatype_string(SHARD_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, part, seq, start = _pool(tokenizer), TaskContext.get().partitionId(), 0, 0
        doc_ids, arrays, held = [], [], 0
        end = np.array([end_id], np.int32)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_shard_row(part, seq, start, doc_ids, arrays, kind)], schema=schema)

        for b in batches:
            keys, sizes = b.column(0).to_pylist(), pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            for i, j in slices_by_bytes(sizes, GROUP_BYTES):
                for key, run_ in zip(keys[i:j], pool.runs(b.column(1).slice(i, j - i))):
                    ids = np.concatenate([run_, end])
                    doc_ids.append(key)
                    arrays.append(ids.astype(kind))
                    held += len(ids)
                    if held >= shard_tokens:
                        yield close()
                        seq, start = seq + 1, start + held
                        doc_ids, arrays, held = [], [], 0
        if doc_ids:
            yield close()

    ordered = (text_columns(docs).repartitionByRange(F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")))
    ordered.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the shards: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32. The totals of the write tasks, one number
    each, are summed on the driver."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part], at = at, at + n
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{r['width']}")
                ends, known = EliasFano.from_bytes(r["ends"]), EliasFano.from_bytes(r["doc_ids"])
                nulls, last = r["n_null"], 0
                for i in range(0, len(ends), READ_DOCS):
                    j = min(i + READ_DOCS, len(ends))
                    to = ends.select_range(i, j).astype(np.int64)
                    at = np.concatenate([[last], to[:-1]])
                    part = ids[last:to[-1]].astype("<u4")
                    crc = [zlib.crc32(part[x:y]) for x, y in zip(at - last, to - last)]
                    keys = (known.select_range(max(i - nulls, 0), max(j - nulls, 0)).view(np.int64) + r["id_base"]).tolist()
                    last = int(to[-1])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([None] * (j - i - len(keys)) + keys, pa.int64()),
                        pa.array(at + (base[r["part"]] + r["start_in_part"])), pa.array(to - at), pa.array(crc, pa.int64())],
                        schema=schema)

    return (shards.select("part", "start_in_part", "n_null", "id_base", "width", "ids", "ends", "doc_ids")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))
