"""Operator 13: product codes of vectors, found by slicing and intersecting bitmasks.

A vector is cut into equal parts; each part position has a codebook, learned by
rounds of exact integer k-means. The nearest entry of a part is found as follows.
For every dimension the entries stand sorted by that coordinate, and beside each
place of the order stands the mask of the entries before it. The neighbours in a few
of the orders give an upper bound of the distance, the initial radius; per dimension two binary
searches cut the entries within the radius, and the exclusive or of the two prefix
masks is the set of them. The AND over the dimensions holds every entry that can
be as near as the guess, and only those are measured, so the answer is exact.

A round is one pass over the table: tasks add up the parts of each entry, Spark
adds the tasks, and the driver holds the codebooks only (parts x entries x
dimensions numbers, however many rows there are). Sums travel in 40-bit limbs, so
they are exact at any size.

Defined cases: rows whose vector is null or holds a null or non-finite component
are left out; vectors shorter than the longest one (rounded up to whole parts)
count as followed by zeros; null vec_ids come last among the first entries and
equal ids in the order of their vectors; repeated rows each get their code; with
fewer rows than entries the codebooks are that short; components too large for 64-bit
distances are measured in whole numbers without limit, and an error beyond a long is
given as the largest long; an empty table gives an empty result; other columns are
not read.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodega.llm.common import stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
NARROW = 1 << 28           # components below this have exact 64-bit squared distances
LIMB = 40
GUESSES = 4                # dimensions whose neighbours bound the initial radius
LONGEST = (1 << 63) - 1


def _whole(x: float) -> int:
    """floor(SCALE * x) of a finite number, exactly."""
    return int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE)


def integer_vectors(col: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their components as integers, ``width`` of them): 64-bit
    integers, or Python's where one is too large."""
    size = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.maximum(size, 0)
    end = np.cumsum(length)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    keep = (size >= 0) & (bad[end] == bad[end - length])
    row = np.repeat(np.arange(len(size)), length)
    used = keep[row]
    place = np.arange(len(flat)) - np.repeat(end - length, length)
    values, kind = flat[used], np.int64
    if len(values) and np.abs(values).max() >= NARROW // SCALE:
        values, kind = np.array([_whole(v) for v in values.tolist()], object), object
    else:
        values = np.floor(values * SCALE).astype(np.int64)
    out = np.zeros((int(keep.sum()), width), kind)
    out[(np.cumsum(keep) - 1)[row[used]], place[used]] = values
    return keep, out


@dataclass
class Slices:
    """One codebook, sliced: ``order[d]`` its coordinates of dimension d ascending,
    ``before[d][j]`` the mask of the first j entries of that order."""
    entries: np.ndarray
    order: list[np.ndarray]
    places: list[np.ndarray]
    before: np.ndarray
    guesses: list[int]

    @classmethod
    def of(cls, entries: np.ndarray) -> Slices:
        k, dims = entries.shape
        before = np.zeros((dims, k + 1, (k + 63) // 64), np.uint64)
        order, places = [], []
        for d in range(dims):
            at = np.argsort(entries[:, d], kind="stable")
            order.append(entries[at, d])
            places.append(at)
            for j, e in enumerate(at.tolist()):
                before[d, j + 1] = before[d, j]
                before[d, j + 1, e >> 6] |= np.uint64(1 << (e & 63))
        # the dimensions in which the entries lie farthest apart
        spread = sorted(range(dims), key=lambda d: int(order[d][0]) - int(order[d][-1]))
        return cls(entries, order, places, before, spread[:GUESSES])

    def _squared(self, x: np.ndarray, e) -> np.ndarray:
        diff = x - self.entries[e]
        return (diff * diff).sum(axis=1) if diff.shape[1] else np.zeros(len(diff), np.int64)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Per row of ``x`` the mask (64-bit words) of the entries that may be nearest."""
        k, dims = self.entries.shape
        bound = self._squared(x, 0)
        for d in self.guesses:
            near = self.places[d][np.minimum(np.searchsorted(self.order[d], x[:, d]), k - 1)]
            bound = np.minimum(bound, self._squared(x, near))
        if bound.dtype == object:
            radius = np.array([math.isqrt(b) for b in bound], object)
        else:
            radius = np.sqrt(bound).astype(np.int64) + 1  # never below the root, whatever the rounding
        mask = np.full((len(x), self.before.shape[2]), ~np.uint64(0))
        for d in range(dims):
            lo = np.searchsorted(self.order[d], x[:, d] - radius, "left")
            hi = np.searchsorted(self.order[d], x[:, d] + radius, "right")
            mask &= self.before[d][hi] ^ self.before[d][lo]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) per row; ties go to the lower entry."""
        code, best = np.full(len(x), -1, np.int64), np.zeros(len(x), x.dtype)
        mask = self.candidates(x)
        for e in range(len(self.entries)):
            rows = np.nonzero(mask[:, e >> 6] >> np.uint64(e & 63) & np.uint64(1))[0]
            d = self._squared(x[rows], e)
            nearer = (code[rows] < 0) | (d < best[rows])
            code[rows[nearer]], best[rows[nearer]] = e, d[nearer]
        return code, best


@dataclass
class Codebooks:
    """Per part position its entries, in lists of Python integers."""
    books: list[list[list[int]]]

    @property
    def width(self) -> int:
        return sum(len(b[0]) for b in self.books)

    def text(self) -> str:
        """All components by part, entry and place, joined by commas."""
        return ",".join(str(x) for book in self.books for entry in book for x in entry)

    def slices(self, wide: bool) -> list[Slices]:
        large = wide or any(abs(x) >= NARROW for book in self.books for entry in book for x in entry)
        return [Slices.of(np.array(book, object if large else np.int64).reshape(len(book), -1)) for book in self.books]


class Coder:
    """Codes batches; the slices are built once per task."""

    def __init__(self, books: Codebooks):
        self.books, self.built = books, {}

    def parts(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per part position: the part of every row, its entry, its squared distance."""
        wide = x.dtype == object
        if wide not in self.built:
            self.built[wide] = self.books.slices(wide)
        slices = self.built[wide]
        if slices[0].entries.dtype == object and not wide:
            x = x.astype(object)
        w = x.shape[1] // len(slices)
        cut = [x[:, p * w:(p + 1) * w] for p in range(len(slices))]
        return [(c, *s.nearest(c)) for c, s in zip(cut, slices)]


def _limbs(v: int) -> Iterator[tuple[int, int]]:
    sign, v, i = (-1 if v < 0 else 1), abs(v), 0
    while v:
        if v & ((1 << LIMB) - 1):
            yield i, sign * (v & ((1 << LIMB) - 1))
        v, i = v >> LIMB, i + 1


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, every entry to the floor of its
    parts' mean; an entry without parts stays."""
    shape = (len(books.books), len(books.books[0]), len(books.books[0][0]) + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total = Coder(books), np.zeros(shape, object)
        for b in batches:
            _, x = integer_vectors(b.column(0), books.width)
            for p, (part, code, _) in enumerate(coder.parts(x)):
                for e in np.unique(code).tolist():
                    own = part[code == e]
                    total[p, e, :-1] += own.sum(axis=0).astype(object)
                    total[p, e, -1] += len(own)
        rows = [(*at, i, v) for at in np.ndindex(shape) for i, v in _limbs(int(total[at]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.int32()] * 4 + [pa.int64()])],
                                         names=["part", "entry", "place", "limb", "value"])

    sums = vectors.mapInArrow(add, "part int, entry int, place int, limb int, value long")
    total = np.zeros(shape, object)
    # at most parts x entries x (dimensions + 1) x limbs rows, whatever the table's size
    for r in sums.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect():
        total[r.part, r.entry, r.place] += r.value << (LIMB * r.limb) if r.value >= 0 else -(-r.value << (LIMB * r.limb))
    return Codebooks([[[int(v) // int(total[p, e, -1]) for v in total[p, e, :-1]] if total[p, e, -1] else entry
                       for e, entry in enumerate(book)] for p, book in enumerate(books.books)])


def _vectors(table: DataFrame) -> DataFrame:
    return table.select(F.col("embedding").cast("array<double>").alias("embedding"))


def learn_codebooks(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``table`` (vec_id, embedding); None where no row is kept. They start
    as the parts of the rows with the smallest vec_ids."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & finite)
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None
    w = -(-longest // parts)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    vectors = [[_whole(v) for v in r.embedding] + [0] * (w * parts - len(r.embedding)) for r in first]
    books = Codebooks([[v[p * w:(p + 1) * w] for v in vectors] for p in range(parts)])
    for _ in range(rounds):
        books = _moved(_vectors(table), books)
    return books


def encode_vectors(table: DataFrame, books: Codebooks) -> DataFrame:
    """Per kept row of ``table`` (vec_id, embedding, label): vec_id, label, code (two hex
    digits per part), error (squared distances to the entries, summed over the parts)."""
    label = table.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books)
        for b in batches:
            keep, x = integer_vectors(b.column(2), books.width)
            found = coder.parts(x)
            codes = np.stack([c for _, c, _ in found], axis=1).astype(np.uint8)
            digits = codes.tobytes().hex()
            step = 2 * len(found)
            error = sum((d.astype(object) for _, _, d in found), np.zeros(len(x), object))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep)),
                 pa.array([digits[i:i + step] for i in range(0, len(digits), step)] if step else [""] * len(x), pa.string()),
                 pa.array([min(int(e), LONGEST) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def code_vectors(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Learn codebooks on ``table`` (vec_id, embedding, label) and code its rows with them:
    vec_id, code, error, label_error (error summed over the rows of a label, nulls
    together), codebooks_sha256."""
    if entries > 256:
        raise ValueError("an entry's number has two hex digits: at most 256 entries")
    books = learn_codebooks(table, parts, entries, rounds)
    if books is None:
        spark = table.sparkSession
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = stored(encode_vectors(table, books), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    # written first: a join that reuses the sums' partitions could not split a label with very many rows
    sums = stored(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "vector-label-errors")
    digest = hashlib.sha256(books.text().encode()).hexdigest()
    return (coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, one step per round (vectors of one length, unique ids)."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""xs AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(v) // {parts}) AS p, (i - 1) % (len(v) // {parts}) AS i, v[i] AS x
  FROM kept, unnest(range(1, len(v) + 1)) t(i))""",
             f"seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries})",
             "c0 AS MATERIALIZED (SELECT p, e, i, x FROM xs JOIN seeds USING (vec_id))"]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, d * {entries} + e) AS e, min(d) AS d
  FROM (SELECT vec_id, xs.p, c.e, sum((xs.x - c.x) * (xs.x - c.x)) AS d FROM xs JOIN c{r} c ON xs.p = c.p AND xs.i = c.i GROUP BY ALL)
  GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.p, c.e, c.i, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x
  FROM c{r} c LEFT JOIN (SELECT a.p, a.e, xs.i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                         FROM a{r} a JOIN xs ON a.vec_id = xs.vec_id AND a.p = xs.p GROUP BY ALL) m
    ON c.p = m.p AND c.e = m.e AND c.i = m.i)""")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
