"""Operator 8: SimHash near-duplicates through vantage-point trees.

Fingerprints are computed per text (XXH64 of word shingles, majority per bit),
and equal ones collapse. Two fingerprints that differ in at most r bits agree fully
on one of r + 1 masks that share out the 64 bits. So there is one vantage-point tree
per mask, over the Hamming distance of the masked bits: a node keeps a vantage point
and about the median distance to it, near ones go left, far ones right, and nodes are
divided until their share of a bounded sample is small. By the triangle inequality a
masked distance of 0 can only be found on a fingerprint's own side of every node, so it
visits one leaf per tree, r + 1 rows at any size, and every pair within r meets.

In a leaf only fingerprints with the same masked bits can be such a pair. They are
compared in full: small sets at once; larger ones stand in order of their distance to a
vantage point, and each is compared with the rings d - r to d + r that the triangle
bounds leave; sets above a leaf's size are first divided by a tree over the full
distance, where a fingerprint visits every shard that its radius touches.

A leaf returns a spanning forest of its links instead of all of them: the
components are the same and a dense group adds one link per member. Rows with equal
fingerprints never meet.

Defined cases: a text without words (or null) has fingerprint zero and links
like any other; null doc_ids take part but are no component's smallest id
unless it has no other (then component_id is null); repeated rows share a
component; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodega.llm.common import doc_key, stored, text_columns
from bodega.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
LEAF = 6_000               # different fingerprints per leaf aimed at
MAX_LEAVES = 4_096         # aimed at per tree at most: bounds the trees on the driver and in every task
SMALL = 48                 # fingerprints with the same masked bits that are compared pair by pair
ALL_BITS = (1 << 64) - 1
SAMPLE_PER_LEAF = 48       # sampled fingerprints per leaf for vantage points and medians
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(raw: bytes | None, k: int = SHINGLE_WORDS, piece: int = 1 << 16) -> int:
    """The majority of the shingle hashes' bits; long texts are summed in pieces."""
    words = (raw or b"").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, piece):
        part = words[a:a + piece + k - 1]
        shingles = map(b" ".join, zip(*(part[j:] for j in range(k)))) if len(part) >= k else [b" ".join(part)]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        counts += _bit_counts(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set: a histogram per byte place, then the
    bits of the 256 byte values."""
    octets = h.view(np.uint8).reshape(len(h), 8)
    return np.concatenate([np.bincount(octets[:, j], minlength=256) @ _SPREAD for j in range(8)])


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, key (of the row), fp (the 64 bits as a signed long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), k) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "key", "fp"])

    return text_columns(docs.select("doc_id", "text", doc_key().alias("key")), "key").mapInArrow(run, "doc_id long, key long, fp long")


@dataclass
class VantageTree:
    """Nodes of a tree over the Hamming distance of the bits in ``mask``: vantage point,
    radius and the nodes below; a leaf has no node below and a number."""
    mask: np.uint64
    points: np.ndarray
    radii: np.ndarray
    below: np.ndarray
    leaf: np.ndarray

    @classmethod
    def build(cls, sample: np.ndarray, share: int, mask: int = ALL_BITS) -> VantageTree:
        """Divided until a node holds at most ``share`` of the sample, or equal ones only."""
        mask = np.uint64(mask)
        points, radii, below, leaf, number, todo = [], [], [], [], 0, [sample & mask]
        for g in todo:  # nodes in the order of their numbers
            d = np.empty(0, np.uint8)
            if len(g) > share:
                point = _vantage(np.unique(g))
                d = np.bitwise_count(g ^ point).astype(np.int64)
            if len(d) and d.max() > d.min():
                r = _split(d)
                points.append(point)
                radii.append(r)
                below.append((len(todo), len(todo) + 1))
                leaf.append(-1)
                todo += [g[d <= r], g[d > r]]
            else:
                points.append(np.uint64(0))
                radii.append(0)
                below.append((-1, -1))
                leaf.append(number)
                number += 1
        return cls(mask, np.array(points, np.uint64), np.array(radii, np.int64), np.array(below, np.int64), np.array(leaf, np.int64))

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def visits(self, q: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into q, leaf) of every leaf that may hold a point within r (masked)."""
        index, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        found = []
        while len(index):
            ended = self.leaf[node] >= 0
            found.append((index[ended], self.leaf[node[ended]]))
            index, node = index[~ended], node[~ended]
            d = np.bitwise_count((q[index] ^ self.points[node]) & self.mask).astype(np.int64)
            left, right = d - r <= self.radii[node], d + r > self.radii[node]
            index, node = np.concatenate([index[left], index[right]]), np.concatenate([self.below[node[left], 0], self.below[node[right], 1]])
        return np.concatenate([i for i, _ in found] or [index]), np.concatenate([x for _, x in found] or [node])


def _vantage(g: np.ndarray) -> np.uint64:
    """Of a few candidates the one whose distances spread most: the fewest points lie
    near its median."""
    if not len(g):
        return np.uint64(0)
    tries = g[np.linspace(0, len(g) - 1, min(16, len(g))).astype(int)]
    spread = [np.bitwise_count(g ^ t).astype(np.float64).std() for t in tries]
    return tries[int(np.argmax(spread))]


def _split(d: np.ndarray) -> int:
    """The median distance, never the largest one, so that neither side is empty."""
    m = int(np.median(d))
    return m if m < d.max() else int(np.unique(d)[-2])


def masks(r: int) -> list[int]:
    """r + 1 masks that share out the 64 bits."""
    cuts = [64 * i // (r + 1) for i in range(r + 2)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def group_links(x: np.ndarray, r: int, leaf: int = LEAF, cells: int = 1 << 22) -> np.ndarray:
    """A spanning forest (pairs) of the links within ``r`` among different values."""
    if len(x) > leaf:
        tree = VantageTree.build(x, leaf)
        if tree.leaves > 1:
            index, at = tree.visits(x, r)
            order = np.argsort(at, kind="stable")
            shards = np.split(index[order], np.nonzero(np.diff(at[order]))[0] + 1)
            return np.concatenate([group_links(x[s], r, len(s), cells) for s in shards])
    pivot = _vantage(x)
    d = np.bitwise_count(x ^ pivot).astype(np.int64)
    order = np.argsort(d, kind="stable")
    x, d = x[order], d[order]
    ring = np.searchsorted(d, np.arange(66))
    alive, links = np.ones(len(x), bool), [np.empty((0, 2), np.int64)]
    for s in range(len(x)):
        if not alive[s]:
            continue
        alive[s], todo = False, [np.array([s])]
        while todo:  # all that the seed reaches, each linked to the first that found it
            reached = todo.pop()
            for at in np.unique(d[reached]):
                q, lo, hi = reached[d[reached] == at], ring[max(0, at - r)], ring[min(65, at + r + 1)]
                open_ = lo + np.nonzero(alive[lo:hi])[0]
                while len(q) and len(open_):
                    k = max(1, cells // len(open_))
                    near = np.bitwise_count(x[q[:k], None] ^ x[None, open_]) <= r
                    hit = near.any(axis=0)
                    if hit.any():
                        links.append(np.stack([q[near.argmax(axis=0)[hit]], open_[hit]], axis=1))
                        alive[open_[hit]] = False
                        todo.append(open_[hit])
                        open_ = open_[~hit]
                    q = q[k:]
    return x[np.concatenate(links)]


def leaf_links(fps: np.ndarray, mask: int, r: int, leaf: int = LEAF) -> np.ndarray:
    """Links (pairs) that connect all values of ``fps`` with the same masked bits within ``r``."""
    key = fps & np.uint64(mask)
    order = np.argsort(key, kind="stable")
    fps, key = fps[order], key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
    starts = np.nonzero(first)[0]
    sizes = np.diff(np.append(starts, len(key)))
    out = [np.empty((0, 2), np.uint64)]
    few = np.repeat(sizes <= SMALL, sizes)
    for lag in range(1, min(SMALL, sizes.max(initial=0))):  # small sets: every pair, all sets together
        near = few[lag:] & (key[lag:] == key[:-lag]) & (np.bitwise_count(fps[lag:] ^ fps[:-lag]) <= r)
        out.append(np.stack([fps[:-lag][near], fps[lag:][near]], axis=1))
    for a, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        out.append(group_links(fps[a:a + n], r, leaf))
    return np.concatenate(out)


def fingerprint_links(distinct: DataFrame, r: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """``distinct``: fp, each once. Links u, v that connect all pairs within ``r`` bits."""
    n = distinct.count()
    u = F.pmod(F.xxhash64("fp", F.lit("vantage")), F.lit(1 << 30))
    share = min(1.0, SAMPLE_PER_LEAF * min(MAX_LEAVES, math.ceil(max(1, n) / leaf)) / max(1, n))
    rows = distinct.where(u < int(share * (1 << 30))).collect()
    sample = np.array([x["fp"] for x in rows], np.int64).view(np.uint64)
    cut = masks(r)
    trees = [VantageTree.build(sample, SAMPLE_PER_LEAF, m) for m in cut]
    base = np.cumsum([0, *(t.leaves for t in trees)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for tree, start in zip(trees, base):
                index, at = tree.visits(q, 0)
                yield pa.RecordBatch.from_arrays([pa.array(at + start, pa.int32()), pa.array(q[index].view(np.int64))], names=["leaf", "fp"])

    def search(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        mask = cut[int(np.searchsorted(base, table.column("leaf")[0].as_py(), "right")) - 1]
        links = leaf_links(fp, mask, r, leaf).view(np.int64)
        return pa.table({"u": pa.array(links[:, 0]), "v": pa.array(links[:, 1])})

    return distinct.select("fp").mapInArrow(deal, "leaf int, fp long").groupBy("leaf").applyInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, r: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """Per row of ``docs``: doc_id, key, fingerprint (16 hex digits), component_id (the
    smallest doc_id reachable over links of at most ``r`` bits)."""
    prints = stored(fingerprints(docs, k), "fingerprints")
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-groups")
    parts = connected_components(stored(fingerprint_links(groups.select("fp"), r, leaf), "links"))
    linked = groups.join(parts, groups["fp"] == parts["node"]).select("fp", "first", "component")
    lowest = linked.groupBy("component").agg(F.min("first").alias("lowest"))
    final = linked.join(lowest, "component").select("fp", "lowest")
    answer = groups.join(final, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"))
    # written first: a join that reuses the groups' partitions could not split a large group of copies
    answer = stored(answer, "fingerprint-components")
    return (prints.join(answer, "fp", "left")
            .select("doc_id", "key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE_WORDS, r: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the
    smallest doc_id stays (one of them, should several share it). Where no row of a
    component has an id, one row per fingerprint stays."""
    found = near_duplicates(docs, k, r).where("component_id IS NULL OR doc_id = component_id")
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fingerprint")))
    keep = found.groupBy(group.alias("g")).agg(F.min("key").alias("key")).select("key")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key().alias("key"))
    kept = rows.join(keep, "key", "left_semi").dropDuplicates(["key"])
    return kept.select("row.*")
