"""Operator 11: the trie of shared conversation prefixes.

Every turn becomes a digest of its role and text, every conversation the sequence of
its turns' digests. The sequences are sorted (equal ones by conv_id) over range
partitions, so a conversation or first turn that very many share is cut across tasks.
Inside a partition neighbours are joined by edges as deep as their longest common
prefix, and a union-find takes the edges in descending depth: a merge of two
components creates a branching node at that depth, or widens the one that stands
there. Nodes between two branchings have the members of the lower one and are
written out from it.

Only the prefixes of a partition's first and last sequence can go on in another
partition. These two paths, with the finished subtrees beside them contracted to
sums, are the partition's contracted forest; one task merges all of them, two paths a
partition, across the boundaries, and returns the nodes that stay and under which
conv_id the finished subtrees hang. Its input follows the number of partitions and the
length of their first and last sequences, not the rows.

The digest over the members that end in a node has one order and so is one stream:
inside a partition it is taken at once; for nodes on the paths the partitions' pieces
are sorted and streamed through it.

Defined cases: a null role or text is empty; turns of one conversation with the same
number stand in the order of their digests; rows with a null conv_id are no
conversation; the base of a negative conv_id is cut toward zero; an empty table has no
node, not even the root; other columns are not read. A conversation is one row of
about 24 bytes a turn, whatever its texts' lengths; texts are read only to be digested.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bodega.llm.common import scratch, stored

BASE = 5                   # conversations of one base share its first turns
SHARED = 9                 # up to SHARED - 1 of them
WIDE = 16                  # bytes of a turn's digest
TURNS_PER_TASK = 200_000
PIECE = 50_000             # conv_ids in a piece of an open node's members
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE, PATH, ENDS = 0, 1, 2
_FOUND = ("p int, side int, at int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, ends string, key binary, chunk int, n_at array<long>, first_at array<long>, "
          "children_at array<long>, leaves_at array<long>, saved_at array<long>, bytes_at array<long>, kind int")
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shared_turns() -> Column:
    """How many turns a conversation takes from its base."""
    return (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, seq: its turns in order, each a struct of digest (hex) and bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), F.substring(digest, 1, 2 * WIDE).alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("seq")).select(
        "conv_id", F.transform("seq", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("seq"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Per conversation conv_id, key (the digests of its rebuilt turns, joined) and bytes
    (of their texts): the first turns of its base, then its own after as many."""
    seqs = turn_sequences(conversations)
    heads = seqs.where(F.col("conv_id") % BASE == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, SHARED - 1).alias("head"))
    own = seqs.select("conv_id", "seq", shared_turns().alias("h"), (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"))
    none = F.slice("seq", 1, 0)
    seq = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")),
                   F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0))))
    return own.join(heads, "base", "left").select("conv_id", seq.alias("seq")).select(
        "conv_id", F.unhex(F.array_join(F.transform("seq", lambda t: t["digest"]), "")).alias("key"),
        F.transform("seq", lambda t: t["bytes"]).alias("bytes"))


def common_turns(a: bytes, b: bytes) -> int:
    """The length, in turns, of the longest common prefix of two joined sequences."""
    low, high = 0, min(len(a), len(b)) // WIDE
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDE:mid * WIDE] == b[low * WIDE:mid * WIDE]:
            low = mid
        else:
            high = mid - 1
    return low


class Forest:
    """The prefixes of sorted sequences: nodes where sequences branch or end. ``up`` is
    the node above, ``first`` a row of the node, ``ends`` how many sequences end in it;
    children, leaves and saved cover the nodes below, up to and without the node itself."""

    def __init__(self, ids: list[int], keys: list[bytes], sizes: list[list[int]]):
        self.ids, self.keys = ids, keys
        self.cum = [list(accumulate(s, initial=0)) for s in sizes]
        self.depth = [len(k) // WIDE for k in keys]
        self.first, self.low = list(range(len(ids))), list(ids)
        self.n, self.ends = [1] * len(ids), [1] * len(ids)
        self.children, self.leaves, self.saved = [0] * len(ids), [0] * len(ids), [0] * len(ids)
        self.up, self.same = [-1] * len(ids), list(range(len(ids)))
        edges = [common_turns(a, b) for a, b in zip(keys, keys[1:])]
        parent, top = list(range(len(ids))), list(range(len(ids)))
        for i in sorted(range(len(edges)), key=lambda e: -edges[e]):
            a, b = self._root(parent, i), self._root(parent, i + 1)
            parent[b] = a
            top[a] = self._merge(top[a], top[b], edges[i])
        self.root = top[self._root(parent, 0)]
        if self.depth[self.root]:
            below, self.root = self.root, self._node(0, self.first[self.root])
            self._hang(below, self.root)

    @staticmethod
    def _root(parent: list[int], i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def _node(self, depth: int, first: int) -> int:
        for values, v in ((self.depth, depth), (self.first, first), (self.low, self.ids[first]), (self.n, 0), (self.ends, 0),
                          (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.up, -1), (self.same, len(self.same))):
            values.append(v)
        return len(self.depth) - 1

    def _merge(self, a: int, b: int, depth: int) -> int:
        """The top of two neighbouring components, joined at ``depth``."""
        if self.depth[a] == depth and self.depth[b] == depth:
            for values in (self.n, self.ends, self.children, self.leaves, self.saved):
                values[a] += values[b]
            self.low[a], self.same[b] = min(self.low[a], self.low[b]), a
            return a
        if self.depth[a] == depth:
            return self._hang(b, a)
        if self.depth[b] == depth:
            self.first[b] = self.first[a]
            return self._hang(a, b)
        return self._hang(b, self._hang(a, self._node(depth, self.first[a])))

    def _hang(self, c: int, x: int) -> int:
        self.up[c] = x
        self.n[x] += self.n[c]
        self.low[x] = min(self.low[x], self.low[c])
        self.children[x] += 1
        self.leaves[x] += self.leaves[c] or 1
        self.saved[x] += self.whole(c, self.depth[x])
        return x

    def whole(self, c: int, above: int) -> int:
        """Saved in the subtree of ``c`` and on the way to it from depth ``above``."""
        cum = self.cum[self.first[c]]
        return self.saved[c] + (self.n[c] - 1) * (cum[self.depth[c]] - cum[above])

    def node(self, i: int) -> int:
        """The node that a merged one became part of."""
        while self.same[i] != i:
            self.same[i] = self.same[self.same[i]]
            i = self.same[i]
        return i

    def above(self, x: int) -> int:
        return self.node(self.up[x])

    def path(self, row: int) -> list[int]:
        """The nodes from the root to the row's own."""
        out = [self.node(row)]
        while out[-1] != self.root:
            out.append(self.above(out[-1]))
        return out[::-1]

    def members(self, x: int) -> list[int]:
        """The ids of the sequences that end in ``x``: they stand first in its rows."""
        return self.ids[self.first[x]:self.first[x] + self.ends[x]]


def _decimal(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def partition_rows(p: int, ids: list[int], keys: list[bytes], sizes: list[list[int]]) -> Iterator[tuple]:
    """The finished nodes of one partition, its two open paths and the ends of open nodes."""
    f = Forest(ids, keys, sizes)
    last = len(ids) - 1
    shared = common_turns(keys[0], keys[last])
    paths = [f.path(0), f.path(last)]
    side_of = {x: int(f.depth[x] > shared) for x in paths[1]} | {x: 0 for x in paths[0]}
    empty = (None,) * 6
    beside = {x: [f.children[x], f.leaves[x], f.saved[x]] for x in side_of}
    for x in side_of:
        if x != f.root:
            y = f.above(x)
            beside[y][0] -= 1
            beside[y][1] -= f.leaves[x] or 1
            beside[y][2] -= f.whole(x, f.depth[y])
    for side, (path, row, start) in enumerate(((paths[0], 0, 0), (paths[1], last, shared + 1))):
        cum, at, up = f.cum[row], [], -1
        for x in path:
            at += [(f.n[x], f.low[x], 0, 0, 0)] * (f.depth[x] - up - 1) + [(f.n[x], f.low[x], *beside[x])]
            up = f.depth[x]
        at = list(zip(*at[start:])) or [()] * 5
        weights = [cum[d] - cum[d - 1] if d else 0 for d in range(start, len(cum))]
        yield (p, side, start, ids[0], None, None, None, None, None, None, None, keys[row], None, *map(list, at), weights, PATH)
    for x, side in side_of.items():
        own = f.members(x)
        for i in range(0, len(own), PIECE):
            yield (p, side, f.depth[x], None, None, None, None, None, None, None, _decimal(own[i:i + PIECE]), None, i // PIECE, *empty, ENDS)
    for x in range(len(f.depth)):
        if f.same[x] != x or x in side_of:
            continue
        y, cum, n, low = f.above(x), f.cum[f.first[x]], f.n[x], f.low[x]
        top, bottom = f.depth[y] + 1, f.depth[x]
        ends = hashlib.sha256(_decimal(f.members(x)).encode()).hexdigest() if f.ends[x] else NO_ENDS
        for d in range(top, bottom + 1):
            open_above = d == top and y in side_of
            yield (p, side_of[y] if open_above else None, d - 1 if open_above else None, low, d,
                   None if open_above else f.low[y] if d == top else low, n, f.children[x] if d == bottom else 1, f.leaves[x] or 1,
                   f.saved[x] + (n - 1) * (cum[bottom] - cum[d - 1]), ends if d == bottom else NO_ENDS, None, None, *empty, NODE)


def _batches(rows: Iterator[tuple], schema: str, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    fields = [x.split(" ") for x in schema.split(", ")]
    arrow = pa.schema([(n, _ARROW[t]) for n, t in fields])
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)

    for r in rows:
        held.append(r)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


_MERGED = ("p int, side int, at int, rank int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
           "n_leaves long, saved_tokens long")


def merge_paths(paths: list[dict]) -> Iterator[tuple]:
    """All partitions' open paths, joined across the boundaries: a row for every merged
    node (p null), and for every place of a path (p, side, at) its node's conv_id and
    the partition's rank."""
    starts = {x["p"]: (x["key"], x["conv_id"]) for x in paths if x["side"] == 0}
    rank = {p: i for i, p in enumerate(sorted(starts, key=starts.__getitem__))}
    paths = sorted(paths, key=lambda x: (rank[x["p"]], x["side"]))
    depth, up, n, low, children, leaves, saved, size = ([] for _ in range(8))
    places, before, key = [], [], b""
    for x in paths:
        shared = common_turns(key, x["key"]) if before else -1
        own = before[:shared + 1]
        for d in range(x["at"], len(x["key"]) // WIDE + 1):
            i = d - x["at"]
            if d == len(own):  # the first sequence that has this prefix
                own.append(len(depth))
                for values, v in ((depth, d), (up, own[d - 1] if d else -1), (n, 0), (low, x["first_at"][i]), (children, 0),
                                  (leaves, 0), (saved, 0), (size, x["bytes_at"][i])):
                    values.append(v)
            y = own[d]
            n[y] += x["n_at"][i]
            low[y] = min(low[y], x["first_at"][i])
            children[y] += x["children_at"][i]
            leaves[y] += x["leaves_at"][i]
            saved[y] += x["saved_at"][i]
            places.append((x["p"], x["side"], d, rank[x["p"]], y))
        before, key = own, x["key"]
    for y in reversed(range(len(depth))):  # a node stands behind the one above it
        leaves[y] = leaves[y] or 1
        saved[y] += (n[y] - 1) * size[y]
        if depth[y]:
            children[up[y]] += 1
            leaves[up[y]] += leaves[y]
            saved[up[y]] += saved[y]
    for y in range(len(depth)):
        yield (None, None, None, None, low[y], depth[y], low[up[y]] if depth[y] else None, n[y], children[y], leaves[y], saved[y])
    for p, side, d, r, y in places:
        yield (p, side, d, r, low[y], d, None, None, None, None, None)


def trie_of(sequences: DataFrame, tasks: int) -> DataFrame:
    """The nodes of ``sequences`` (conv_id, key, bytes), built in ``tasks`` range partitions."""
    spark = sequences.sparkSession

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, sizes = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            keys += b.column(1).to_pylist()
            sizes += b.column(2).to_pylist()
        if ids:
            yield from _batches(partition_rows(TaskContext.get().partitionId(), ids, keys, sizes), _FOUND)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = [row for b in batches for row in b.to_pylist()]
        yield from _batches(merge_paths(paths), _MERGED)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at, digest = None, None
            for b in batches:
                for conv_id, depth, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    if (conv_id, depth) == at:
                        digest.update(b"," + text.encode())
                        continue
                    if at:
                        yield (*at, digest.hexdigest())
                    at, digest = (conv_id, depth), hashlib.sha256(text.encode())
            if at:
                yield (*at, digest.hexdigest())

        yield from _batches(rows(), "conv_id long, depth long, ends string")

    path = scratch(spark, "trie-partitions")
    ranged = sequences.repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    ranged.mapInArrow(build, _FOUND).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    found = spark.read.schema(_FOUND).parquet(path)
    merged = stored(found.where(F.col("kind") == PATH).drop("kind").repartition(1).mapInArrow(merge, _MERGED), "trie-merged")
    names = merged.where(F.col("p").isNotNull()).select("p", "side", "at", "rank", F.col("conv_id").alias("name"))

    pieces = (found.where(F.col("kind") == ENDS).select("p", "side", "at", "chunk", "ends").join(names, ["p", "side", "at"])
              .select(F.col("name").alias("conv_id"), F.col("at").cast("long").alias("depth"), "ends", "rank", "chunk"))
    ends = (pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "rank", "chunk").select("conv_id", "depth", "ends")
            .mapInArrow(stream, "conv_id long, depth long, ends string"))
    open_nodes = merged.where(F.col("p").isNull()).join(ends, ["conv_id", "depth"], "left")

    nodes = found.where(F.col("kind") == NODE)
    inner = nodes.where(F.col("at").isNull())
    hung = nodes.where(F.col("at").isNotNull()).join(names, ["p", "side", "at"]).withColumn("parent_conv_id", F.col("name"))
    columns = [*COLUMNS[:-1], F.coalesce("ends", F.lit(NO_ENDS)).alias(COLUMNS[-1])]
    return inner.select(*columns).unionByName(hung.select(*columns)).unionByName(open_nodes.select(*columns))


def prefix_trie(conversations: DataFrame, tasks: int | None = None) -> DataFrame:
    """A row for every distinct sequence of first turns of the rebuilt conversations:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    sequences = stored(rebuilt(conversations), "trie-sequences")
    if tasks is None:
        turns = sequences.agg(F.coalesce(F.sum(F.size("bytes").cast("long") + 1), F.lit(0))).first()[0]
        tasks = max(2 * conversations.sparkSession.sparkContext.defaultParallelism, math.ceil(turns / TURNS_PER_TASK))
    return trie_of(sequences, tasks)


#: crc32 of a conv_id's decimal digits, bit by bit.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: 0::BIGINT)),
      lambda c, z: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295::BIGINT)"""

ORACLE_SQL = f"""WITH
t AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn, turn AS nr FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list(turn ORDER BY nr NULLS FIRST) AS seq, {_CRC_SQL} % {SHARED} AS h FROM t GROUP BY conv_id),
r AS MATERIALIZED (SELECT s.conv_id, list_concat(coalesce(b.seq, [])[1:s.h], s.seq[s.h + 1:]) AS seq
  FROM s LEFT JOIN s b ON b.conv_id = s.conv_id - s.conv_id % {BASE}),
m AS MATERIALIZED (SELECT conv_id, d, seq[1:d] AS pre, len(seq) = d AS ends FROM r, unnest(range(len(seq) + 1)) u(d)),
n AS MATERIALIZED (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(pre[d].text) END AS own FROM m GROUP BY pre, d),
place AS MATERIALIZED (SELECT m.conv_id AS member, m.d, n.conv_id AS node FROM m JOIN n USING (pre, d)),
p AS (SELECT n.conv_id, n.d, a.node AS parent FROM n JOIN place a ON a.member = n.conv_id AND a.d = n.d - 1),
k AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS children FROM p GROUP BY ALL),
b AS (SELECT a.node AS conv_id, a.d, sum(n.own) AS saved, count(*) FILTER (WHERE k.children IS NULL) AS leaves
  FROM n LEFT JOIN k ON k.conv_id = n.conv_id AND k.d = n.d JOIN place a ON a.member = n.conv_id AND a.d <= n.d GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.parent AS parent_conv_id, n.n_convs, coalesce(k.children, 0) AS n_children,
  b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.d = n.d LEFT JOIN k ON k.conv_id = n.conv_id AND k.d = n.d
JOIN b ON b.conv_id = n.conv_id AND b.d = n.d"""
