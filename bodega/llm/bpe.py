"""Operator 5: BPE encoding and decoding with a contiguous rank array.

A word's part ids and the ranks of its adjacent pairs stand in two contiguous
arrays. The lowest rank is found by a scan (the leftmost of equals), the
boundary there is deleted, and the ranks beside it are looked up again, until
no pair has a rank. Words of one length are worked on together, one row of a
matrix each, so every step is a few array operations over all of them. Each
different word of a batch is encoded once. Words of over ``SHORT`` symbols,
where the scan would be quadratic, use a heap over the same ranks.

Normalisation, cutting into words and the byte alphabet follow the tokenizer
file (NFC, white space, lower case; words, single digits, other signs);
special strings inside a text become their ids.

Defined cases: a null or empty text, or one of white space only, has no ids
and decodes to the empty text; repeated rows are answered each; an empty table
gives an empty result; only doc_id and text are read.
"""
from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from bodega.llm.common import text_columns
from bodega.llm.tokens import (UnitPool, byte_alphabet, groups_by_bytes, load_tokenizer, ragged, special_strings,
                               tokenizer_json)

SHORT = 96
GROUP_BYTES = 1 << 20
POOL_UNITS = 400_000       # units a worker remembers; bounds its memory only
NONE = np.int32(2**31 - 1)
_LATIN_END = "ɏ"      # up to here all Unicode versions agree on letters and cases


class RankBPE:
    """The merges of a tokenizer file as sorted arrays: pair -> rank and merged id."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.vocab, self.suffix = vocab, suffix
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(key, kind="stable")
        self.key, self.new, self.rank = key[order], new[order], order.astype(np.int32)
        self.new_of_rank = new

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], NONE)

    def symbols(self, word: str) -> list[int]:
        return [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]

    def merge_rows(self, parts: np.ndarray) -> list[list[int]]:
        """Merge every row of a matrix of symbols (words of one length)."""
        w, n = parts.shape
        out: list = [None] * w
        where = np.arange(w)
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while n > 1 and len(where):
            at = np.argmin(ranks, axis=1)
            low = ranks[np.arange(len(where)), at]
            done = low == NONE
            if done.any():
                for i, row in zip(where[done], parts[done].tolist()):
                    out[i] = row
                keep = ~done
                where, parts, ranks, at, low = where[keep], parts[keep], ranks[keep], at[keep], low[keep]
                if not len(where):
                    return out
            rows = np.arange(len(where))
            new = self.new_of_rank[low]
            # delete the boundary after `at`: everything right of it moves one place left
            col = np.arange(n - 1)
            parts = np.take_along_axis(parts, col + (col > at[:, None]), axis=1)
            parts[rows, at] = new
            n -= 1
            if n == 1:
                break
            col = np.arange(n - 1)
            ranks = np.take_along_axis(ranks, col + (col >= at[:, None]), axis=1)
            left, right = at > 0, at < n - 1
            ranks[rows[left], at[left] - 1] = self.ranks(parts[rows[left], at[left] - 1], new[left])
            ranks[rows[right], at[right]] = self.ranks(new[right], parts[rows[right], at[right] + 1])
        for i, row in zip(where, parts.tolist()):
            out[i] = row
        return out

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order through a heap, for long words."""
        n = len(parts)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.ranks(np.array(parts[:-1]), np.array(parts[1:]))
        heap = [(int(r), i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        alive = [True] * n

        def push(i: int) -> None:
            j = nxt[i]
            if j < n:
                r = self.rank_of(parts[i], parts[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not alive[i] or parts[i] != a or nxt[i] >= n or parts[nxt[i]] != b:
                continue
            j = nxt[i]
            parts[i], alive[j] = int(self.new_of_rank[r]), False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return [p for p, ok in zip(parts, alive) if ok]

    def rank_of(self, a: int, b: int) -> int | None:
        want = a << 32 | b
        at = int(np.searchsorted(self.key, want))
        return int(self.rank[at]) if at < len(self.key) and self.key[at] == want else None

    def encode_words(self, words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_len.setdefault(len(w), []).append(i)
        for n, where in by_len.items():
            if n > SHORT:
                for i in where:
                    out[i] = self.merge_long(self.symbols(words[i]))
                continue
            for a in range(0, len(where), 20_000):
                part = where[a:a + 20_000]
                rows = self.merge_rows(np.array([self.symbols(words[i]) for i in part], np.int32))
                for i, r in zip(part, rows):
                    out[i] = r
        return out


@lru_cache(maxsize=2)
def load_bpe(name: str) -> RankBPE:
    model = tokenizer_json(name)["model"]
    return RankBPE(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")


def word_splitter(name: str):
    """unit -> its words in the byte alphabet, as the file's normaliser and
    pre-tokenizer give them."""
    tok = load_tokenizer(name)
    pattern = regex.compile(tokenizer_json(name)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
    alphabet = byte_alphabet()

    def split(unit: str) -> list[str]:
        if max(unit, default="") <= _LATIN_END:
            words = pattern.findall(unit.lower())
            if unit.isascii() and unit.isprintable():
                return words
            return [w.encode().decode("latin-1").translate(alphabet) for w in words]
        return [w for w, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(unit))]

    return split


def unit_encoder(name: str):
    """units -> ids; every different word is merged once."""
    bpe, split, special = load_bpe(name), word_splitter(name), special_strings(name)
    marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def make(units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        cuts, words = [], {}
        for u in units:
            row: list = []
            for piece in (marks.split(u) if marks and "<|" in u else (u,)):
                if piece in special:
                    row.append(special[piece])
                else:
                    for w in split(piece):
                        words.setdefault(w, len(words))
                        row.append(w)
            cuts.append(row)
        ids = dict(zip(words, bpe.encode_words(list(words))))
        return units, *ragged([[i for w in row for i in ((w,) if isinstance(w, int) else ids[w])] for row in cuts])

    return make


_POOLS: dict = {}


def _names(tokenizer: str) -> list[str]:
    vocab = load_tokenizer(tokenizer).get_vocab(with_added_tokens=True)
    name = [""] * (max(vocab.values()) + 1)
    for s, i in vocab.items():
        name[i] = s
    return name


def encode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", decoded: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, ids; with ``decoded`` also the text that the ids
    decode to, in the same pass."""
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("text", pa.string())] * decoded
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _POOLS:
            _POOLS[tokenizer] = UnitPool(unit_encoder(tokenizer), limit=POOL_UNITS)
        pool, name = _POOLS[tokenizer], _names(tokenizer) if decoded else []
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                raw = part.column(1).to_pylist()
                for i, j in groups_by_bytes(raw, GROUP_BYTES):
                    rows = [pool.run(t) for t in pool.cut_all([(x or b"").decode("utf-8", "replace") for x in raw[i:j]])]
                    ends = np.cumsum([0, *map(len, rows)])
                    cols = [part.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows)))]
                    if decoded:
                        cols.append(pa.array([" ".join(map(name.__getitem__, r.tolist())) for r in rows], pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return text_columns(docs).mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode(encoded: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """``encoded``: doc_id, ids. Adds the text: the ids' vocabulary strings joined by
    a space (the file names no decoder)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = _names(tokenizer)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [" ".join(map(name.__getitem__, ids)) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.list_(pa.int32())), pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
