"""Helpers shared by the text operators: shared-folder tables, columns, word hashes.

Intermediate tables are Parquet files under the folder the cluster names in
``spark.checkpoint.dir``, which every executor can read: a lost executor loses
nothing that later stages need.
"""
from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bodega.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    computes it once, however often it is read later."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str:
    """The mounted path of a shared-folder URI, for files that workers map into
    memory. The folder must be mounted on every machine (``file:`` or no scheme)."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}")
    return parts.path if parts.scheme else uri


def write_file(path: str, data: bytes) -> None:
    """Write whole or not at all: a retried or speculative task replaces the file
    by the same content."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tmp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with open(tmp, "wb") as f:
        f.write(data)
    os.replace(tmp, path)


def mapped(path: str, kind: str) -> np.ndarray:
    """An array file, mapped: pages are read as they are touched and shared by workers."""
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays behind their lengths: 64-bit numbers, their bytes dealt into
    planes, so that small ones cost little once compressed."""
    head = np.array([len(arrays), *map(len, arrays)], "<i8")
    planes = [np.ascontiguousarray(np.asarray(a).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *planes]))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", k, 8).tolist(), 8 + 8 * k, []
    for n in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel())
        at += 8 * n
    return out


def id_residue(col: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def text_columns(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id as long, the text as its UTF-8 bytes (null: null), and ``extra``; any
    other column of the table is left out, so its name cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"),
                       *[F.col(c) for c in extra])


def doc_key() -> Column:
    """A row's own key: two rows that share a doc_id but not a text stay apart."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


# ---------------------------------------------------------------- word hashes

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S29, _S32 = np.uint64(29), np.uint64(32)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K1
    x += b
    x ^= x >> _S29
    x *= _K2
    x ^= x >> _S32
    return x


def window_hashes(wh: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of every run of ``k`` consecutive words, from the hashes of spans of
    1, 2, 4, ... words: log2(k) passes over the text."""
    m = len(wh) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    cur, size, out, span = wh ^ np.uint64(seed), 1, None, 0
    while size <= k:
        if k & size:
            out = cur[:m] if out is None else _join(out, cur[span:span + m])
            span += size
        size *= 2
        if size <= k:
            cur = _join(cur[:-(size // 2)], cur[size // 2:])
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every run of ``w`` values, by doubling spans."""
    m = len(x) - w + 1
    if m <= 0:
        return np.empty(0, x.dtype)
    cur, size = x, 1
    while size * 2 <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    return np.minimum(cur[:m], cur[w - size:w - size + m])


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``k`` words that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + k, n), -1)
    return np.cumsum(step[:-1]) > 0
