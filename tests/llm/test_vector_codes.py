"""Operator 13 against a plain version in Python's whole numbers."""
import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from bodega.llm import queries, vector_codes

SMALL = "/root/testdata/sf0.001"


def plain(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label) -> rows of (vec_id, code, error, label_error, digest)."""
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (w * parts - len(v)), label) for i, v, label in kept]
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][1]))[:entries]
    books = [[cut[n][p] for n in first] for p in range(parts)]

    def assign(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(assign(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(groups[e]) for col in zip(*groups[e])] if e in groups else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = []
    for (i, _, label), c in zip(kept, cut):
        found = [assign(c[p], books[p]) for p in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for _, e in found), min(sum(d for d, _ in found), 2 ** 63 - 1), label))
    total = {}
    for _, _, error, label in coded:
        total[label] = min(total.get(label, 0) + error, 2 ** 63 - 1)
    return [(i, code, error, total[label], digest) for i, code, error, label in coded]


def known(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_query(spark):
    table = queries.table(spark, SMALL, "embeddings")
    got = queries.op13_vector_codes(spark, SMALL).collect()
    assert known(got) == known(plain([(r.vec_id, r.embedding, r.label) for r in table.collect()]))


def odd_rows(large):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(20)], rnd.choice([1, 2, None])) for i in range(60)]
    rows += [(60, None, 1), (61, [1.0, None], 2), (62, [float("nan")] * 20, None), (63, [float("-inf")] * 20, 3), (64, [], 1),
             (65, [1.5], 9), (None, [0.25] * 20, None), (None, [0.125] * 20, 1), (3, [-2.0] * 20, 1), (3, [-2.0] * 20, 1)]
    rows += [(70 + i, rows[5][1], 2) for i in range(30)]  # copies
    if large:
        rows += [(200, [1e300] * 20, 1), (201, [-70000.5] * 20, 2), (202, [5e5, -5e-324] * 10, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("large", [False, True])
def test_odd_rows(spark, large):
    rows = odd_rows(large)
    table = spark.createDataFrame([(a, b, c, "x", 1.0, b"k") for a, b, c in rows],
                                  "vec_id long, embedding array<double>, label int, code string, error double, of binary").repartition(4)
    got = vector_codes.code_vectors(table)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert known(got.collect()) == known(plain(rows))


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(5, [1.0, 2.0, 3.0], 1), (2, [0.0, -1.0, 0.5], None)]
    assert known(vector_codes.code_vectors(spark.createDataFrame(rows, schema)).collect()) == known(plain(rows))
    for none in ([], [(1, None, 1), (2, [None], 1)]):
        got = vector_codes.code_vectors(spark.createDataFrame(none, schema))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.collect() == []
    empty = [(1, [], 1), (2, [], 1)]
    assert known(vector_codes.code_vectors(spark.createDataFrame(empty, schema)).collect()) == known(plain(empty))


@pytest.mark.parametrize("entries", [1, 5, 64, 200])
def test_candidates_hold_the_nearest(entries):
    """The masks keep every entry at the least distance, and leave most of the others out."""
    rnd = np.random.default_rng(entries)
    book = rnd.integers(-1000, 1000, (entries, 4))
    book[-1] = book[0]
    x = np.concatenate([rnd.integers(-1000, 1000, (500, 4)), book])
    slices = vector_codes.Slices.of(book)
    mask = slices.candidates(x)
    held = np.stack([mask[:, e >> 6] >> np.uint64(e & 63) & np.uint64(1) for e in range(entries)], axis=1).astype(bool)
    d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert held[d == d.min(axis=1, keepdims=True)].all()
    if entries >= 64:
        assert held.mean() < 0.3
    code, best = slices.nearest(x)
    assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
