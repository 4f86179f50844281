"""Operator 11 against a plain version that lists every prefix."""
import hashlib
import random
import zlib

import pytest

from bodega.llm import prefix_trie, queries

SMALL = "/root/testdata/sf0.001"


def plain(rows):
    """rows: (conv_id, turn, role, text) -> the nodes' rows."""
    def digest(role, text):
        return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32]

    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [(role, text) for *_, role, text in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5
        built[c] = tuple(own.get(c - base, [])[:h] + ts[h:])
    nodes = {}
    for c, ts in sorted(built.items()):
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    total = {}
    for p in sorted(nodes, key=len, reverse=True):
        own_saved = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below = [total[q] for q in children.get(p, [])]
        total[p] = (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))
    return [(m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), len(children.get(p, [])), *total[p],
             hashlib.sha256(",".join(str(c) for c in m if built[c] == p).encode()).hexdigest()) for p, m in nodes.items()]


def known(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[1], r[0]))


def test_query(spark):
    rows = [tuple(r) for r in queries.table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_prefix_trie(spark, SMALL)
    assert got.columns == prefix_trie.COLUMNS
    assert known(got.collect()) == known(plain(rows))


def odd_rows():
    """Shared first turns, copies, prefixes of each other, null and repeated turns, null
    ids, roles and texts, empty and long texts, negative ids, a long conversation."""
    rnd = random.Random(11)
    pool = [("user", "a"), ("assistant", "a"), ("user", ""), (None, None), ("user", "Été 日本"), ("", "a"), ("usera", ""), ("u", "sera")]
    rows = []
    for c in list(range(-7, 90)) + [10 ** 12, 10 ** 12 + 3]:
        n = rnd.choice([0, 1, 1, 2, 3, 5, 9, 12])
        script = [pool[0]] + [rnd.choice(pool[:3]) for _ in range(n)] if rnd.random() < 0.7 else [rnd.choice(pool) for _ in range(n + 1)]
        for t, (role, text) in enumerate(script):
            rows.append((c, None if t == 0 and rnd.random() < 0.2 else t if rnd.random() < 0.9 else 1, role, text))
    for c in range(100, 160):  # copies
        rows += [(c, t, "user", f"same {t}") for t in range(10)]
    rows += [(200, t, "user", f"turn {t}") for t in range(500)] + [(201, t, "user", f"turn {t}") for t in range(500)]
    rows += [(300, 0, "user", "x" * 3_000_000), (None, 0, "user", "lost"), (301, 0, "user", "q"), (301, 0, "user", "q")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_odd_rows(spark, tasks):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, "k", 1, [1]) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int, bytes array<int>")
    got = prefix_trie.prefix_trie(table.repartition(5), tasks)
    assert known(got.collect()) == known(plain(rows))


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(none).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_partition_cuts_do_not_matter(seed):
    """Forests of every cut of the same sequences, merged, against one forest."""
    rnd = random.Random(seed)
    turns = [bytes([i]) * prefix_trie.WIDE for i in range(3)]
    convs = []
    for c in range(60):
        script = [rnd.randrange(3) if rnd.random() < 0.5 else 0 for _ in range(rnd.randrange(7))]
        convs.append((b"".join(turns[t] for t in script), c, [t + 1 for t in script]))
    convs.sort()

    def merged(cuts):
        found = [row for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a
                 for row in prefix_trie.partition_rows(p, [c for _, c, _ in convs[a:b]], [k for k, _, _ in convs[a:b]], [s for *_, s in convs[a:b]])]
        names = [f.split(" ")[0] for f in prefix_trie._FOUND.split(", ")]
        found = [dict(zip(names, row)) for row in found]
        joined = list(prefix_trie.merge_paths([x for x in found if x["kind"] == prefix_trie.PATH]))
        name = {row[:3]: row[4] for row in joined if row[0] is not None}
        nodes = [row[4:] for row in joined if row[0] is None]
        for x in found:
            if x["kind"] == prefix_trie.NODE:
                up = x["parent_conv_id"] if x["at"] is None else name[x["p"], x["side"], x["at"]]
                nodes.append((x["conv_id"], x["depth"], up, x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"]))
        return sorted(nodes, key=lambda r: (r[1], r[0]))

    whole = merged([0, 60])
    for _ in range(20):
        assert merged([0, *sorted(rnd.choices(range(61), k=rnd.randrange(1, 12))), 60]) == whole
    assert merged(list(range(61))) == whole
