"""Operator 3: token counts from pre-token counts.

One pass cuts every text into pre-tokens and writes, per block of documents,
the documents' pre-token frequencies (numbers into the block's own list of
different pre-tokens) and that list, dealt into buckets by hash. All blocks'
lists of a bucket meet in one task, which counts the pieces of each different
pre-token once, by the tokenizer's own model, keeping only the number. The
counts go back to their blocks, are joined to the frequencies there and
summed. No id is materialised, and what crosses the network per block is its
vocabulary, not its words.

A bucket is read as a stream; a task holds the different pre-tokens of its
buckets only. ``buckets`` should grow with the shuffle partitions.

Defined cases: a null or empty text has no tokens; a special string inside a
text counts as one; rows that share a doc_id are counted each; an empty table
gives an empty result; other columns are not read.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodega.llm.common import pack, stored, text_columns, unpack
from bodega.llm.tokens import UnitPool, byte_alphabet, groups_by_bytes, load_tokenizer, ragged, special_strings

BLOCK_BYTES = 8 << 20
MAX_BUCKETS = 1024
LIMIT = 512
_LATIN_END = "ɏ"

BLOCK_SCHEMA = "kind int, block long, bucket int, doc_id array<long>, n_bytes array<long>, extra array<long>, payload binary"


def pack_texts(texts: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, texts), "<i4", len(texts))
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(texts)], "<i4").tobytes() + lens.tobytes() + b"".join(texts))


def unpack_texts(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw[:4], "<i4")[0])
    ends = np.cumsum([4 + 4 * n, *np.frombuffer(raw[4:4 + 4 * n], "<i4")]).tolist()
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]


class PreTokens:
    """Numbers the pre-tokens of one block; units are cut once per block."""

    def __init__(self, name: str):
        self.tok, self.number = load_tokenizer(name), {}
        self.pattern = regex.compile(PATTERN)
        self.back = {ord(c): b for b, c in byte_alphabet().items()}

    def start_block(self) -> None:
        self.number = {}

    def pieces(self, unit: str) -> list[str]:
        if max(unit) <= _LATIN_END:
            return self.pattern.findall(unit)
        return [p.translate(self.back).encode("latin-1").decode() for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(unit)]

    def make(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        number, units = self.number, sorted(units)  # like ones side by side, as they are stored compressed
        return units, *ragged([[number.setdefault(p, len(number)) for p in self.pieces(u)] for u in units])


def blocks_of(docs: DataFrame, tokenizer: str, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """kind 0: a block's documents with their pre-token frequencies (per document
    ascending numbers, stored as steps, and counts). kind 1: its pre-tokens of one
    bucket, with their numbers."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema = to_arrow_schema(_parse_datatype_string(BLOCK_SCHEMA))
    specials = sorted(special_strings(tokenizer), key=len, reverse=True)
    marks = re.compile("|".join(map(re.escape, specials))) if specials else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, block = PreTokens(tokenizer), TaskContext.get().partitionId() << 32
        for b in batches:
            raw, keys = b.column(1).to_pylist(), b.column(0).to_pylist()
            for i, j in groups_by_bytes(raw, block_bytes):
                pre.start_block()
                pool = UnitPool(pre.make, limit=1 << 62)
                extra, ends, steps, counts = [], [0], [], []
                for a in range(i, j, 1000):
                    texts = [(x or b"").decode("utf-8", "replace") for x in raw[a:min(a + 1000, j)]]
                    segments = [marks.split(t) if marks else [t] for t in texts]
                    units = iter(pool.cut_all([s for parts in segments for s in parts]))
                    for parts in segments:
                        parts = [next(units) for _ in parts]
                        run_ = pool.run(parts[0]) if len(parts) == 1 else np.concatenate([pool.run(s) for s in parts])
                        number, count = np.unique(run_, return_counts=True)
                        extra.append(len(parts) - 1)
                        ends.append(ends[-1] + len(number))
                        steps.append(np.diff(number, prepend=np.int32(0)))
                        counts.append(count)
                texts = [p.encode("utf-8", "replace") for p in pre.number]
                rows = [{"kind": 0, "block": block, "doc_id": keys[i:j], "n_bytes": [len(x or b"") for x in raw[i:j]], "extra": extra,
                         "payload": pack(np.array([len(texts)]), np.diff(ends), np.concatenate(steps), np.concatenate(counts))}]
                home = np.fromiter(map(zlib.crc32, texts), np.int64, len(texts)) % buckets
                order = np.argsort(home, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []:
                    numbers = pack(np.diff(part, prepend=0))
                    rows.append({"kind": 1, "block": block, "bucket": int(home[part[0]]),
                                 "payload": len(numbers).to_bytes(4, "little") + numbers + pack_texts([texts[k] for k in part])})
                block += 1
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return text_columns(docs).mapInArrow(run, BLOCK_SCHEMA)


def count_pieces(lists: DataFrame, tokenizer: str) -> DataFrame:
    """block, numbers and piece counts of its pre-tokens, for lists dealt by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, alphabet, known = load_tokenizer(tokenizer).model, byte_alphabet(), {}
        for b in batches:
            blocks, out = b.column(0).to_pylist(), []
            for payload in b.column(1).to_pylist():
                size = int.from_bytes(payload[:4], "little")
                texts = unpack_texts(payload[4 + size:])
                for t in texts:
                    if t not in known:
                        known[t] = len(model.tokenize(t.decode("latin-1").translate(alphabet)))
                out.append(pack(unpack(payload[4:4 + size])[0], np.fromiter(map(known.__getitem__, texts), np.int32, len(texts))))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(out, pa.binary())], names=["block", "counts"])

    return lists.select("bucket", "block", "payload").repartition("bucket").select("block", "payload").mapInArrow(run, "block long, counts binary")


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT, buckets: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit``)."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or min(MAX_BUCKETS, 2 * partitions)
    table = stored(blocks_of(docs, tokenizer, buckets), "pretokens")
    counted = count_pieces(table.where("kind = 1"), tokenizer)
    frequencies = table.where("kind = 0").select("block", "doc_id", "n_bytes", "extra", "payload")

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_id, n_bytes, n_tokens = [], [], []
        for r in left.to_pylist():
            (size,), lens, steps, counts = unpack(r["payload"])
            pieces = np.zeros(size, np.int64)
            for c in right.column("counts").to_pylist():
                numbers, n = unpack(c)
                pieces[np.cumsum(numbers)] = n
            ends = np.cumsum(lens)
            begins = ends - lens
            run_ = np.cumsum(steps, dtype=np.int64)           # numbers: steps summed anew in each document
            before = np.concatenate([[0], run_])[begins]
            product = np.concatenate([[0], np.cumsum(pieces[run_ - np.repeat(before, lens)] * counts, dtype=np.int64)])
            doc_id += r["doc_id"]
            n_bytes += r["n_bytes"]
            n_tokens += (product[ends] - product[begins] + np.array(r["extra"], np.int64)).tolist()
        return pa.table({"doc_id": pa.array(doc_id, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()),
                         "n_tokens": pa.array(n_tokens, pa.int64()), "over_limit": pa.array([n > limit for n in n_tokens], pa.bool_())})

    return (frequencies.groupBy("block").cogroup(counted.groupBy("block"))
            .applyInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
