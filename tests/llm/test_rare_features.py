"""Operator 12 against a plain version, window by window."""
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from bodega.llm import queries, rare_features
from bodega.llm.common import _join

SMALL = "/root/testdata/sf0.001"
W = 32
CLOG = [0] + [round(c * math.log2(c) * 65536) for c in range(1, W + 1)]


def plain_levels(raw):
    return [1000 - sum(CLOG[c] for c in Counter(raw[i:i + W]).values()) * 1000 // CLOG[W] for i in range(len(raw) - W + 1)]


def plain_places(texts):
    counts = Counter(v for raw in texts for v in plain_levels(raw))
    return {v: i for i, v in enumerate(sorted(range(1001), key=lambda v: (counts[v], v)))}


def plain_fingerprint(raw, place):
    levels = plain_levels(raw)
    rank = [(place[v], i) for i, v in enumerate(levels) if v >= 100]
    by_at = {i: r for r, i in rank}
    points = Counter()
    for a in range(-31, len(levels)):
        inside = [(by_at[i], i) for i in range(a, a + 32) if i in by_at]
        if inside:
            points[min(inside)[1]] += 1
    values = []
    for i in sorted(points):
        if points[i] >= 16:
            words = np.frombuffer(raw[i:i + W], "<u8")
            h = words[:1]
            for j in range(1, 4):
                h = _join(h, words[j:j + 1])
            values.append(int(h[0]))
    if raw and not values:
        values = [xxhash.xxh64_intdigest(raw)]
    values = list(dict.fromkeys(values))
    out = b""
    for a in range(0, len(values), 160):
        bits = {v >> 11 * j & 2047 for v in values[a:a + 160] for j in range(5)}
        out += bytes(sum(128 >> (b % 8) for b in bits if b // 8 == i) for i in range(256))
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0

    def cut(v):
        return [int.from_bytes(v[i:i + 256]) for i in range(0, len(v), 256)]

    def directed(xs, ys):
        top = [max(((x & y).bit_count() - (c := x.bit_count() * y.bit_count() / 2048)) / (min(x.bit_count(), y.bit_count()) - c) for y in ys) for x in xs]
        return sum(max(0.0, t) * x.bit_count() for t, x in zip(top, xs)) / sum(x.bit_count() for x in xs)

    x, y = sorted((cut(a), cut(b)), key=len)
    return directed(x, y) if len(x) < len(y) else (directed(x, y) + directed(y, x)) / 2


def plain(rows):
    """rows: (doc_id, text) -> the query's rows."""
    def order(r):
        h = xxhash.xxh64_intdigest((r[1] or "").encode(), 42)
        return r[0] is None, -(r[0] or 0), h - (1 << 64) if h >> 63 else h, r[1] or ""

    rows = [(i, t or "") for i, t in sorted(rows, key=order)]
    place = plain_places([t.encode() for _, t in rows])
    made = {}

    def fp(t):
        if t not in made:
            made[t] = plain_fingerprint(t.encode(), place)
        return made[t]

    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        e = t[:len(t) - k] + after[:k]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp(t).hex(), fp(e).hex(),
                    plain_likeness(fp(t), fp(e)), plain_likeness(fp(t), fp(after))))
    return out


def known(rows):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, rows)), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_query(spark):
    docs = queries.table(spark, SMALL, "documents")
    got = queries.op12_rare_features(spark, SMALL)
    assert got.columns == rare_features.COLUMNS
    got = known(got.collect())
    assert got == known(plain([(r.doc_id, r.text) for r in docs.collect()]))
    long = [r for r in got if r[1] >= 300]
    assert len(long) > 50
    assert np.mean([r[5] for r in long]) > 0.6 and np.mean([r[5] > r[6] for r in long]) > 0.95
    assert np.mean([r[6] for r in long]) < 0.1


def odd_rows():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["Été", "日本語", "😀", "a\nb"]
    texts = [None, "", "a", "ab", "x" * 31, "x" * 32, "x" * 500, "é" * 40, "abc" * 20, None, ""]
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.choice([3, 8, 20, 60, 200]))) for _ in range(40)]
    texts += [texts[20], texts[20], texts[25] + " tail", " ".join(rnd.choice(words) for _ in range(4000))]
    rows = [(None if i % 13 == 5 else i // 2 if i % 7 == 0 else i, t) for i, t in enumerate(texts)]
    rows += rows[18:24]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("ranges,group", [(1, 1 << 21), (4, 3000), (90, 1)])
def test_odd_rows(spark, ranges, group):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, 1, "f", [0]) for r in rows], "doc_id long, text string, p int, fingerprint string, kind array<int>").repartition(5)
    got = rare_features.compare_with_next(docs, rare_features.learn_rarity(docs), ranges, group)
    assert known(got.collect()) == known(plain(rows))


def test_one_and_none(spark):
    schema = "doc_id long, text string"
    assert known(rare_features.fingerprint_documents(spark.createDataFrame([(3, "only one")], schema)).collect()) == known(plain([(3, "only one")]))
    assert rare_features.fingerprint_documents(spark.createDataFrame([], schema)).collect() == []


def test_pieces_do_not_matter(monkeypatch):
    """A long text cut anywhere has the features it has in one piece."""
    rnd = random.Random(9)
    texts = [bytes(rnd.choice(b"abcdefgh \n") for _ in range(n)) for n in (5000, 10, 0, 31, 40, 3000)]
    rarity = rare_features.Rarity.of(np.bincount(rare_features.entropy_levels(np.frombuffer(texts[0], np.uint8)), minlength=1001))
    whole = rare_features.fingerprints(texts, rarity)
    place = {v: int(p) for v, p in enumerate(rarity.place)}
    assert whole == [plain_fingerprint(t, place) for t in texts]
    for piece in (1, 33, 64, 1000, 4999):
        monkeypatch.setattr(rare_features, "PIECE", piece)
        assert rare_features.fingerprints(texts, rarity) == whole
