"""Operators 2, 8 and 10 against brute force."""
import hashlib
import random

import brute_force
import numpy as np
import pytest

from bodega.llm import decontamination, queries, simhash, substring_dedup
from bodega.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"


def known(x):
    """Sorts rows whose id may be null."""
    return sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, str(r[1:])))


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in queries.table(spark, SMALL, "documents").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in queries.table(spark, SMALL, "benchmark").collect()]


def odd_rows():
    """Null ids and texts, empty and long texts, shared ids, repeated rows, near and
    exact copies, passages that texts share or repeat within themselves."""
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "日本", "x.y", "A", "B-C"]
    passage = [rnd.choice(vocab) for _ in range(30)]
    texts = [None, None, "", " \t\n", "one", "one two", "One  TWO", "\x1c\x85 z", " ".join(passage), "\n".join(passage).upper()]
    for i in range(60):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(1, 80))]
        if i % 3 == 0:
            at, n = rnd.randint(0, len(words)), rnd.randint(5, 30)
            words[at:at] = passage[:n]
        if i % 10 == 0:
            words += words
        texts.append(" ".join(words))
    long = " ".join(rnd.choice(vocab) for _ in range(150_000))
    texts += [long, long + " end", texts[20], texts[20], texts[30] + " tail"]
    out = [(None if i % 17 == 5 else i // 2 if i % 5 == 0 else i, t) for i, t in enumerate(texts)]
    rnd.shuffle(out)
    return out + out[:6]


@pytest.fixture(scope="module")
def odd(spark):
    extra = [(a, b, "k", 1.5, [i], "f") for i, (a, b) in enumerate(odd_rows())]
    return spark.createDataFrame(extra, "doc_id long, text string, key string, fp double, places array<int>, `first.row` string").repartition(5)


# ---------------------------------------------------------------- SimHash

def test_op8(spark, rows):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, SMALL).collect()]
    assert known(got) == known(brute_force.near_duplicates(rows))


def test_simhash_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert known(got) == known(brute_force.near_duplicates(rows))


def test_keep_one(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    found = brute_force.near_duplicates(rows)
    want = {c for _, _, c in found if c is not None}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want)
    assert got.count(None) == len({fp for _, fp, c in found if c is None})


@pytest.mark.parametrize("leaf", [10, 200, 100_000])
def test_fingerprint_links_through_tree(spark, leaf):
    """Crowded fingerprints, chains of neighbours and far ones, in trees of several depths."""
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rnd.choice(64, n, replace=False))) for b in base for n in (1, 3, 4, 6)]
    crowd = base[0] ^ np.arange(200, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64), crowd]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(4)
    parts = {r.node: r.component for r in connected_components(simhash.fingerprint_links(df, 3, leaf)).collect()}
    want = brute_force.roots([int(x) for x in fps])
    mine = [parts.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert len(set(zip(mine, want))) == len(set(want)) == len(set(mine))


def test_rows_dealt_grow_with_the_input():
    """One leaf per tree, whatever the number of leaves; pairs within 3 bits share one."""
    rnd = np.random.default_rng(5)
    fps = np.unique(rnd.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    near = fps ^ np.array([sum(1 << int(k) for k in rnd.choice(64, 3, replace=False)) for _ in fps], np.uint64)
    met = np.zeros(len(fps), bool)
    for mask in simhash.masks(3):
        tree = simhash.VantageTree.build(fps[::7], 20, mask)
        assert tree.leaves > 50
        (i, a), (j, b) = tree.visits(fps, 0), tree.visits(near, 0)
        assert len(i) == len(j) == len(fps)
        met |= (a[np.argsort(i)] == b[np.argsort(j)]) & (((fps ^ near) & np.uint64(mask)) == 0)
    assert met.all()


@pytest.mark.parametrize("leaf", [50, 6000])
def test_crowd_is_linked_array_wise(leaf):
    """20,000 neighbours in one set: one link per member."""
    crowd = np.uint64(0xABCD << 48) ^ np.arange(20_000, dtype=np.uint64)
    links = simhash.leaf_links(crowd, 0xFFFF << 48, 3, leaf if leaf > 50 else 2000)
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for u, v in links.tolist():
        assert (u ^ v).bit_count() <= 3
        parent[root(u)] = root(v)
    assert len({root(int(v)) for v in crowd}) == 1


# ---------------------------------------------------------------- repeated passages

def test_op2(spark, rows):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op2_substring_dedup(spark, SMALL).collect()]
    want = [(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in brute_force.repeats(rows)]
    assert known(got) == known(want)
    assert any(r[2] for r in want)


@pytest.mark.parametrize("window", [2, 5, 12])
def test_repeats_odd_rows(odd, window):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    out = substring_dedup.remove_repeats(odd, window)
    assert out.select("rest.*").columns == [c for c in odd.columns if c != "text"]
    got = [(r.rest.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()]
    assert known(got) == known(brute_force.repeats(rows, window))


def test_repeats_leave_other_texts_as_they_are(spark):
    docs = spark.createDataFrame([(1, " a  b\nc d "), (2, "x a  b\nc d"), (3, None)], "doc_id long, text string")
    got = {r.rest.doc_id: r.kept for r in substring_dedup.remove_repeats(docs, 3, unchanged_as_is=True).collect()}
    assert got == {1: " a  b\nc d ", 2: "x", 3: None}


# ---------------------------------------------------------------- benchmark leaks

def test_op10(spark, rows, items):
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op10_decontamination(spark, SMALL).collect()]
    want = [(a, b, c, len(d), hashlib.sha256(",".join(d).encode()).hexdigest(), c > 0) for a, b, c, d in brute_force.contamination(rows, items)]
    assert known(got) == known(want)
    assert any(r[5] for r in want)


def test_contamination_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    texts = [t for _, t in odd_rows() if t]
    tests = [(str(i), " ".join(t.split()[3:3 + n])) for i, (t, n) in enumerate(zip(texts, [1, 4, 9, 10, 11, 25, 60] * 9))]
    tests += [("same", tests[4][1]), ("none", None), ("blank", " . - "), (None, texts[-1]), ("one", "ONE"), ("0", "elsewhere entirely")]
    items = spark.createDataFrame([(a, b, 1) for a, b in tests], "item_id string, text string, hash int").repartition(3)
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontamination.find_contamination(odd, items).collect()]
    assert known(got) == known(brute_force.contamination(rows, tests))
    clean = decontamination.keep_uncontaminated(odd, items)
    assert clean.columns == odd.columns
    assert known([(r.doc_id, r.text) for r in clean.collect()]) == known(
        [row for row, found in zip(rows, brute_force.contamination(rows, tests)) if not found[2]])


def test_empty_tables(spark, odd):
    none, items = odd.limit(0), spark.createDataFrame([], "item_id string, text string")
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_one(none).collect() == []
    assert substring_dedup.remove_repeats(none).collect() == []
    assert decontamination.find_contamination(none, items).collect() == []
    assert decontamination.keep_uncontaminated(odd, items).count() == odd.count()
