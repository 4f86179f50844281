"""Operators 3, 4 and 5 against the tokenizers library on whole texts."""
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bodega.llm import bpe, queries, token_counts, token_ids
from bodega.llm.common import scratch
from bodega.llm.tokens import cut

SMALL = "/root/testdata/sf0.001"


def odd_texts() -> list:
    rnd = random.Random(5)
    marks = ["<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "\t", " \n ", "'s", "'LL", "it's", "don't", "Àé", "ß", "İ", "Σίσυφος ΟΔΟΣ", "日本語",
             "é", " ", "　", "\x1c", "\x85", "\x00", "​", "١٢٣", "½", "x" * 300, "aB" * 90, "😀", "\r\n", "1234", "#!$", "<|", "-", ".", ",", "word.", "word,,"]
    mixed = ["".join(rnd.choice(marks) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    points = ["".join("a" + chr(c) + " " + chr(c) + "b" + chr(c) for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x3100, 64)]
    return [None, "", " ", "\n\n", " lead", "trail ", "a  b   c\n\n d"] + mixed + points


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 3 else i - i % 2 * (i > 20), t, "x", i) for i, t in enumerate(odd_texts())]  # a null id and shared ids
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int").repartition(5)


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module", params=["odd", "documents"])
def docs(request, spark, odd):
    return odd if request.param == "odd" else spark.read.parquet(f"{SMALL}/documents.parquet")


def test_cut_units_tokenize_alone():
    tok = library("byte_bpe_50k.json")
    for t in odd_texts():
        units = cut(t or "")
        parts = units[:1] + [" " + u for u in units[1:]]
        assert "".join(parts) == (t or "")
        assert [i for p in parts for i in tok.encode(p, add_special_tokens=False).ids] == tok.encode(t or "", add_special_tokens=False).ids


def test_token_counts(spark, docs):
    tok = library("byte_bpe_50k.json")
    want = sorted(((r.doc_id is None, r.doc_id or 0), len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids))
                  for r in docs.select("doc_id", "text").collect())
    got = token_counts.count_tokens(docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_token_counts_small_blocks(spark, docs, monkeypatch):
    """Many blocks: a block's counts come from several buckets and tasks."""
    whole = {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs).collect()}
    small = token_counts.blocks_of
    monkeypatch.setattr(token_counts, "blocks_of", lambda d, t, b: small(d, t, b, block_bytes=3000))
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, buckets=7).collect()} == whole


def test_token_ids(spark, docs):
    tok = library("byte_bpe_50k.json")
    path = scratch(spark, "ids")
    token_ids.write_token_shards(docs, path, shard_tokens=700)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_ids.read_token_shards(spark, path).collect())
    start, want = 0, []
    for r in docs.select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((r.doc_id is not None, r.doc_id or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(want) == sorted((a, b, d, e) for a, b, _, d, e in got)
    for _, _, s, n, _ in sorted(got, key=lambda r: r[2]):
        assert s == start
        start += n
    assert [r[:2] for r in sorted(got, key=lambda r: r[2])] == sorted(r[:2] for r in got)


def test_token_ids_are_read_in_ranges(spark, docs, monkeypatch):
    """Ends and ids are selected a few documents at a time; null ids lie in several ranges."""
    path = scratch(spark, "ranges")
    token_ids.write_token_shards(docs.unionByName(docs), path)
    whole = sorted(map(str, token_ids.read_token_shards(spark, path).collect()))
    monkeypatch.setattr(token_ids, "READ_DOCS", 3)
    assert sorted(map(str, token_ids.read_token_shards(spark, path).collect())) == whole


def test_elias_fano():
    rnd = random.Random(1)
    for values in ([], [0], [5], [0, 0, 0], [2**63, 2**63 + 5], sorted(rnd.randrange(10**9) for _ in range(3000)), list(range(2000)), [7] * 600 + [10**12]):
        ef = token_ids.EliasFano.from_bytes(token_ids.EliasFano.encode(np.array(values, np.uint64)).to_bytes())
        assert [int(x) for x in ef.all()] == values
        assert [ef.select(i) for i in range(0, len(values), 7)] == values[::7]
        for i, j in [(0, len(values)), (len(values), len(values)), (len(values) // 3, len(values) // 2), (256, 512), (255, 1025)]:
            i, j = min(i, len(values)), min(j, len(values))
            assert [int(x) for x in ef.select_range(i, j)] == values[i:j]
    ends = np.cumsum(np.full(10_000, 700))
    assert len(token_ids.EliasFano.encode(ends).to_bytes()) < 10_000 * 14 / 8  # against 80,000 bytes as a table


def test_bpe_round(spark, docs):
    tok = library("word_bpe_49k.json")
    coded = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(map(str, bpe.encode(docs, decoded=True).collect())) == sorted(map(str, coded))
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id is not None, r.doc_id or 0, ids, tok.decode(ids, skip_special_tokens=False)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids), r.text) for r in coded) == sorted(want)


def test_bpe_long_words_agree():
    b = bpe.load_bpe("word_bpe_49k.json")
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(2, 90))) for _ in range(500)] + ["a" * 96, "a" * 97, "ab" * 300]
    tok = library("word_bpe_49k.json")
    for w, ids in zip(words, b.encode_words(words)):
        assert ids == tok.encode(w, add_special_tokens=False).ids
        assert b.merge_long(b.symbols(w)) == ids


def test_op5_digests(spark):
    tok = library("word_bpe_49k.json")
    texts = {r.doc_id: r.text for r in queries.table(spark, SMALL, "documents").collect()}
    for r in queries.op5_bpe(spark, SMALL).collect():
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    path = scratch(spark, "none")
    token_ids.write_token_shards(none, path)
    assert token_ids.read_token_shards(spark, path).collect() == []
    assert token_counts.count_tokens(none).collect() == []
    assert bpe.decode(bpe.encode(none)).collect() == []


def test_pool_takes_a_column_and_looks_at_each_different_piece_once():
    """Runs of a column of bytes equal the library's ids of whole texts, also where pieces
    begin or end with white space, and no text is cut in Python that need not be."""
    import pyarrow as pa
    from bodega.llm import token_ids, tokens
    raw = [None, b"", b" ", b" a b", b"a b ", b"a  b", b"a \tb", b"a\n b c", b"x. y, x. y,", "日本 語".encode(), b"\xe1\x80 a \xff b", b"<|endoftext|> a", b"a " * 500 + b"a"]
    name = "byte_bpe_50k.json"
    pool, tok = token_ids.UnitPool(token_ids.encode_units(name), marks=dict(token_ids._pool(name).marks)), tokens.load_tokenizer(name)
    seen, keep = [], tokens.cut
    tokens.cut = lambda t: seen.append(t) or keep(t)
    try:
        got = pool.runs(pa.array([None, *raw], pa.binary()).slice(1))
    finally:
        tokens.cut = keep
    assert [g.tolist() for g in got] == [tok.encode((x or b"").decode("utf-8", "replace"), add_special_tokens=False).ids for x in raw]
    assert seen == [" ", "a b ", "a  b", "a \tb", "a\n b c"]
    assert pool.runs(pa.array([], pa.binary())) == []
