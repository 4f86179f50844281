"""Operator 7: quality rules with host-level verdicts.

Text rules are evaluated per document; their failures are counted per host
(here: ``source``), each host's rate is shrunk towards the mean of all hosts
by a beta prior fitted to the hosts (method of moments), and a host whose
shrunk rate of any rule exceeds that rule's limit is rejected. The verdict is
joined back to the documents.

Defined cases: a null or empty text has no words (and fails ``too_short``);
documents without a host form no host and get their own verdict only; ties do
not occur (rates are compared with fixed limits); an empty table gives an
empty result; repeated rows count each; only the named columns are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodega.llm.common import stored, text_columns

MIN_WORDS = 50
MAX_REPEAT_PCT = 50          # words in repeated 3-word windows
MAX_SYMBOL_PCT = 10          # symbols per 100 word characters
MAX_DUP_LINE_PCT = 30        # duplicate lines per 100 lines with a word
#: a host is rejected when its shrunk failure rate exceeds the rule's limit
HOST_LIMITS = {"base": 0.5, "symbols": 0.5, "dup_lines": 0.5}
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(words: list[bytes], k: int = 3) -> int:
    """Words lying in a ``k``-word window that occurs at least twice in the text."""
    n = len(words)
    if n <= k:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    window = code[:n - k + 1]
    for j in range(1, k):  # renumber after each step: codes stay below the number of words squared
        _, window = np.unique(window * len(ids) + code[j:n - k + 1 + j], return_inverse=True)
    hit = np.bincount(window)[window] > 1
    out = np.zeros(n, bool)
    for j in range(k):
        out[j:n - k + 1 + j] |= hit
    return int(out.sum())


def text_features(raw: bytes | None) -> tuple[int, int, int, int, int, int]:
    if not raw:
        return 0, 0, 0, 0, 0, 0
    text = raw.decode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines))


def document_features(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the text counts of every row."""
    kinds = [pa.int64()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [text_features(t.as_py()) for t in b.column(1)]
            cols = list(zip(*got)) if got else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)] + [pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                    "n_repeat_words", "n_lines"])

    base = text_columns(docs, host).withColumnRenamed(host, "host").withColumn("host", F.col("host").cast("string"))
    return base.mapInArrow(run, f"doc_id long, host string, {FEATURES}")


def rule_failures(features: DataFrame) -> DataFrame:
    """The rules that a document itself fails."""
    return features.withColumns({
        "fail_base": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")),
        "fail_symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("word_chars"),
        "fail_dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines"),
    })


def host_verdicts(failures: DataFrame, limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """host, n_docs, the shrunk rate of each rule, host_kept. One row per host; the
    prior's two numbers per rule are the only values fetched."""
    hosts = failures.where("host IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"bad_{r}") for r in limits])
    p = {r: F.col(f"bad_{r}") / F.col("n_docs") for r in limits}
    moments = hosts.agg(*[x for r in limits for x in (F.avg(p[r]).alias(f"m_{r}"), F.var_samp(p[r]).alias(f"v_{r}"),
                                                      F.avg(p[r] * (1 - p[r]) / F.col("n_docs")).alias(f"e_{r}"))]).first()
    rates = {}
    for r in limits:
        m = min(max(moments[f"m_{r}"] or 0.0, 1e-6), 1 - 1e-6)
        between = max((moments[f"v_{r}"] or 0.0) - (moments[f"e_{r}"] or 0.0), m * (1 - m) / 1000)  # without the sampling noise
        strength = max(m * (1 - m) / between - 1, 1.0)
        rates[r] = (F.col(f"bad_{r}") + m * strength) / (F.col("n_docs") + strength)
    kept = F.lit(True)
    for r, limit in limits.items():
        kept = kept & (rates[r] <= limit)
    return hosts.select("host", "n_docs", *[rates[r].alias(f"rate_{r}") for r in limits], kept.alias("host_kept"))


def apply_quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per document: doc_id, the counts, base_failed, host_kept, kept."""
    failures = rule_failures(stored(document_features(docs, host), "quality"))
    hosts = host_verdicts(failures).select("host", "host_kept")
    own = ~F.col("fail_base") & ~(F.col("fail_symbols") & F.col("fail_dup_lines"))
    return (failures.join(hosts, "host", "left")
            .withColumn("host_kept", F.coalesce("host_kept", F.lit(True)))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    F.col("fail_base").alias("base_failed"), "host_kept", (own & F.col("host_kept")).alias("kept")))
