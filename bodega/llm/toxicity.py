"""Operator 6: a toxicity classifier regularised by counterfactuals.

Features of a text: its different words (lower case) and their first four,
five and six letters, which catch inflected forms. Those that speak most clearly
for toxicity form the model's vocabulary, and a logistic regression over their
number (none, one, two or more) is fitted with two penalties: the usual one on
the weights, and one on the change of a sentence's score when an identity term
in it is swapped for another term of its group. The score is linear before the last step, so that
change depends only on the two terms; labelled sentences are therefore counted
per term, and each count weighs the squared changes to the term's
alternatives. A term that occurs in more toxic sentences by chance of the
sample thus gains no weight of its own.

The groups are the given ones (``IDENTITY_GROUPS``) and pairs found in the labelled
sentences: words that texts of both labels use, that do not themselves speak clearly
for toxicity, and that stand between the same neighbours more alike than with any
other word. A text's language or subject thus brings its own neutral mentions. The
model tells how many sentence swaps it was penalised for (``n_swaps``).

Learning uses a bounded, documented sample of the labelled rows
(``SAMPLE_ROWS`` per label); every row is scored over its whole text.

Defined cases: a null or empty text has no feature and gets the score of the
intercept; without labels of both kinds every score is 0; repeated rows are
scored each; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bodega.llm.common import stored, text_columns

SAMPLE_ROWS = 6_000        # labelled rows per label that may be fetched (their features, not their texts)
VOCABULARY = 4_000
LEAST_DOCS = 5             # a feature must occur in so many sampled documents
LEAST_CHI = 20.0           # and in more toxic ones than chance explains
THRESHOLD = 0.7
L2 = 2e-5
COUNTERFACTUAL = 1.0
STEPS = 600
TERMS = 200                # words that are looked at for interchangeable pairs
TERM_CONTEXTS = 64         # and their most frequent contexts, each
LEAST_EACH = 8             # a found term occurs in so many sampled texts of either label
MOST_SHARE = 0.75          # and its toxic share, both labels weighing alike, is no higher
LEAST_SHARED = 3           # a pair stands between so many same neighbours
PREFIXES = (4, 5, 6)
MOST = 2                   # a feature counts twice at most

#: Groups of terms that may stand for one another in a sentence; a parameter.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("wife", "husband"),
    ("gay", "straight", "lesbian", "bisexual", "trans"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "native", "refugee"), ("deaf", "blind", "disabled"), ("young", "old"),
)

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SENTENCE = re.compile(rb"[.!?\n]+")

def word_features(word: bytes) -> list[int]:
    """The word's own number and those of its beginnings."""
    return [zlib.crc32(word)] + [zlib.crc32(word[:n], n) for n in PREFIXES if len(word) > n]


@dataclass
class ToxicityModel:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0
    fitted: bool = False
    groups: tuple = ()
    n_swaps: int = 0       # sentences that hold a term, times its alternatives

    def scorer(self):
        """text -> score; a word's active features are remembered, most words have none."""
        known: dict[bytes, tuple] = {}
        weights, bias = self.weights, self.bias

        def score(raw: bytes | None) -> float:
            if not self.fitted:
                return 0.0
            active: dict[int, int] = {}
            for w, n in Counter((raw or b"").translate(_FOLD).split()).items():
                hit = known.get(w)
                if hit is None:
                    if len(known) > 400_000:
                        known.clear()
                    hit = known[w] = tuple(f for f in word_features(w) if f in weights)
                for f in hit:
                    active[f] = active.get(f, 0) + n
            z = bias + sum(weights[f] * min(n, MOST) for f, n in sorted(active.items()))
            return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))

        return score


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` labelled rows of each label, by a hash of the id."""
    counts = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit("toxicity")), F.lit(1 << 20))
    keep = F.lit(False)
    for label, n in counts.items():
        keep = keep | ((F.col("toxic") == label) & (u < int(min(1.0, rows / n) * (1 << 20))))
    return labelled.where(keep)


def _text_features(raw: bytes | None) -> tuple[Counter, Counter]:
    """The text's words, and its features with their numbers."""
    words = Counter((raw or b"").translate(_FOLD).split())
    count: Counter = Counter()
    for w, n in words.items():
        for f in word_features(w):
            count[f] += n
    return words, count


def _sentences(raw: bytes | None) -> list[list[bytes]]:
    return [s.translate(_FOLD).split() for s in _SENTENCE.split(raw or b"")]


def find_groups(sampled: DataFrame, counts: dict[int, int], given=IDENTITY_GROUPS) -> tuple:
    """Pairs of interchangeable words, each the other's most alike, outside the given
    groups. Spark counts words per label and neighbours per word over the sample; at most
    ``TERMS`` words with ``TERM_CONTEXTS`` contexts each reach the driver."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for x, y in zip(b.column(0), b.column(1).to_pylist()):
                count[y].update(set((x.as_py() or b"").translate(_FOLD).split()))
            seen = sorted(count[0].keys() | count[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array([count[1][w] for w in seen], pa.int64()),
                                              pa.array([count[0][w] for w in seen], pa.int64())], names=["word", "pos", "neg"])

    taken = [t.encode() for g in given for t in g]
    pos, neg = F.col("pos") / counts[1], F.col("neg") / counts[0]
    found = (sampled.select("text", "toxic").mapInArrow(words, "word binary, pos long, neg long")
             .groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
             .where((F.col("pos") >= LEAST_EACH) & (F.col("neg") >= LEAST_EACH) & (pos <= MOST_SHARE * (pos + neg)) & ~F.col("word").isin(taken))
             .orderBy(F.least(pos, neg).desc(), "word").limit(TERMS).select("word"))
    terms = {bytes(r["word"]) for r in found.collect()}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: Counter = Counter()
            for x in b.column(0):
                for s in _sentences(x.as_py()):
                    count.update((w, zlib.crc32(left + b" " + right)) for left, w, right in zip(s, s[1:], s[2:]) if w in terms)
            keys = sorted(count)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int64()),
                                              pa.array([count[k] for k in keys], pa.int64())], names=["word", "context", "n"])

    near = sampled.select("text").mapInArrow(contexts, "word binary, context long, n long").groupBy("word", "context").agg(F.sum("n").alias("n"))
    shared = near.groupBy("context").agg(F.count(F.lit(1)).alias("words")).where("words > 1").select("context")
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "context"))
    rows = near.join(shared, "context").withColumn("rank", rank).where(F.col("rank") <= TERM_CONTEXTS).select("word", "context", "n").collect()

    names, places = sorted({bytes(r["word"]) for r in rows}), sorted({r["context"] for r in rows})
    at, col = {w: i for i, w in enumerate(names)}, {c: i for i, c in enumerate(places)}
    table = np.zeros((len(names), len(places)))
    for r in rows:
        table[at[bytes(r["word"])], col[r["context"]]] = np.log1p(r["n"])
    held = (table > 0).astype(np.float64)
    length = np.sqrt((table**2).sum(1))
    alike = np.where(held @ held.T >= LEAST_SHARED, table @ table.T / np.maximum(np.outer(length, length), 1e-12), 0.0)
    np.fill_diagonal(alike, 0.0)
    best = alike.argmax(1) if len(names) else np.empty(0, int)
    return tuple((names[i].decode("utf-8", "replace"), names[j].decode("utf-8", "replace")) for i, j in enumerate(best) if i < j and best[j] == i and alike[i, j] > 0)


def choose_features(sampled: DataFrame, n: int, n_pos: int, groups=IDENTITY_GROUPS, vocabulary: int = VOCABULARY) -> list[int]:
    """The ``vocabulary`` features that speak most for toxicity (chi square), and those
    of the identity terms; counted by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, labels = [], []
            for x, y in zip(b.column(0), b.column(1).to_pylist()):
                count = _text_features(x.as_py())[1]
                parts.append(np.fromiter(count, np.int64, len(count)))
                labels.append(np.full(len(count), y, np.int64))
            if parts:
                f, at = np.unique(np.concatenate(parts), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.bincount(at, np.concatenate(labels), len(f)).astype(np.int64)),
                                                  pa.array(np.bincount(at, minlength=len(f)))], names=["f", "pos", "docs"])

    wanted = sorted({f for g in groups for t in g for f in word_features(t.encode())})
    expected = F.col("docs") * (n_pos / n)
    counted = (sampled.select("text", "toxic").mapInArrow(run, "f long, pos long, docs long")
               .groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
               .withColumn("chi", (F.col("pos") - expected) ** 2 / F.greatest(expected * (1 - F.col("docs") / n * 0.999), F.lit(1e-9))))
    best = counted.where((F.col("chi") >= LEAST_CHI) & (F.col("pos") > expected)).orderBy(F.desc("chi"), "f").limit(vocabulary).select("f")
    return sorted({r["f"] for r in best.unionByName(counted.where(F.col("f").isin(wanted)).select("f")).collect()})


def collect_features(sampled: DataFrame, chosen: list[int], groups=IDENTITY_GROUPS) -> list:
    """Per sampled text: label, its chosen features (twice if it holds them twice), and
    how many of its sentences hold each identity term."""
    terms, known = {t.encode() for g in groups for t in g}, set(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            features, counts = [], []
            for x in b.column(0).to_pylist():
                words, count = _text_features(x)
                features.append([f for f, n in count.items() if f in known for _ in range(min(n, MOST))])
                hits: Counter = Counter()
                if words.keys() & terms:
                    for s in _SENTENCE.split(x):
                        hits.update(set(s.translate(_FOLD).split()) & terms)
                counts.append([{"term": t.decode(), "n": n} for t, n in sorted(hits.items())])
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array(features, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())])))],
                names=["toxic", "features", "terms"])

    return sampled.select("text", "toxic").mapInArrow(run, "toxic int, features array<long>, terms array<struct<term:string,n:long>>").collect()


def fit(rows: list, chosen: list[int], groups=IDENTITY_GROUPS, strength: float = COUNTERFACTUAL) -> ToxicityModel:
    """Logistic regression by full-batch Adam on the chosen features; deterministic."""
    y = np.array([r["toxic"] for r in rows], np.float64)
    n, n_pos = len(rows), y.sum() if len(rows) else 0
    if not n or not 0 < n_pos < n:
        return ToxicityModel()
    features = [sorted(r["features"]) for r in rows]
    order = sorted(range(n), key=lambda i: (y[i], features[i]))
    y = y[order]
    row = np.repeat(np.arange(n), [len(features[i]) for i in order])
    ids, k = np.array(chosen, np.int64), len(chosen)
    col = np.searchsorted(ids, np.array([f for i in order for f in features[i]], np.int64))
    at = {f: i for i, f in enumerate(chosen)}
    term_features = {t: set(word_features(t.encode())) for g in groups for t in g}

    # one line per (term, alternative): difference of their features, weighed by the sentences that hold the term
    sentences: Counter = Counter()
    for r in rows:
        for t in r["terms"]:
            sentences[t["term"]] += t["n"]
    total = sum(sentences.values())
    swaps, share = [], []
    for g in groups:
        for t in g:
            for other in g:
                if t != other and sentences[t]:
                    line = np.zeros(k)
                    for f in term_features[other] - term_features[t]:
                        if f in at:
                            line[at[f]] = 1
                    for f in term_features[t] - term_features[other]:
                        if f in at:
                            line[at[f]] = -1
                    swaps.append(line)
                    share.append(sentences[t] / total / (len(g) - 1))
    n_swaps = sum(sentences[t] * (len(g) - 1) for g in groups for t in g)
    swap = np.array(swaps).reshape(len(swaps), k)
    weight = np.array(share)

    balance = np.where(y == 1, n / (2 * n_pos), n / (2 * (n - n_pos)))
    w, bias = np.zeros(k), 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weights=w[col], minlength=n) + bias
        err = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.bincount(col, weights=err[row], minlength=k) + 2 * L2 * w
        if len(swap):
            g += 2 * strength * swap.T @ (weight * (swap @ w))
        grad = np.append(g, err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w, bias = w - move[:-1], bias - move[-1]
    return ToxicityModel({int(f): float(x) for f, x in zip(ids, w)}, float(bias), True, tuple(groups), n_swaps)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, groups=IDENTITY_GROUPS,
          strength: float = COUNTERFACTUAL, find: bool = True) -> ToxicityModel:
    """``labels``: doc_id, toxic (0 or 1). The sampled label rows (at most a little over
    ``sample_rows`` per label) are broadcast to the texts. ``groups``: the given groups of
    terms; ``find`` adds the pairs found in the sample."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    sample = _sample(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    sampled = stored(texts.join(F.broadcast(sample), "doc_id").select("text", "toxic"), "toxicity-sample")
    counts = {r["toxic"]: r["n"] for r in sampled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return ToxicityModel()
    if find:
        groups = tuple(groups) + find_groups(sampled, counts, groups)
    chosen = choose_features(sampled, sum(counts.values()), counts[1], groups)
    return fit(collect_features(sampled, chosen, groups), chosen, groups, strength)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, score, predicted (1 if score >= ``threshold``)."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            s = [score(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], schema=schema)

    return text_columns(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, as they are, whose score stays below ``threshold``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            texts = b.column(at).to_pylist()
            yield b.filter(pa.array([score(x.encode("utf-8", "replace") if isinstance(x, str) else x) < threshold for x in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
