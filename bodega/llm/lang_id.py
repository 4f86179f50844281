"""Operator 1: language identification by compression.

Every language has a raw-content zstandard dictionary cut from labelled
texts. A text is compressed once with each dictionary; the language whose
dictionary gives the fewest bytes wins, and a narrow margin is marked as
rejected. Long texts are compressed in blocks, so that the dictionary, not
the text's own beginning, keeps deciding.

Defined cases: a null text, or one without a letter, is ``und`` with score 0
and rejected; a table without labelled rows knows no language, so every text
is ``und``; a language is learned from its labelled texts whatever their
length, unless none that is drawn has a letter; repeated rows are answered each; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodega.llm.common import text_columns

SAMPLE_ROWS = 600          # labelled rows per language that may be fetched for the dictionaries
SAMPLE_ROW_CHARS = 4 << 10  # of a longer text, so many code points from a hashed place: many texts cover more of a language
DICT_BYTES = 32 << 10      # dictionary size per language
LEVEL = 6
BLOCK_BYTES = 4 << 10
MIN_MARGIN = 0.01          # relative size margin below which the answer is marked as rejected

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalise(text: str) -> bytes:
    """Lower case, ASCII signs and digits dropped, single spaces."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def learn_dictionaries(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS,
                       dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """``labelled``: doc_id, text, lang. A hash of the id (of the text, if it is null)
    draws about ``sample_rows`` rows per language; their texts, of long ones a slice, in
    the hash's order, fill the dictionary until ``dict_bytes``. Languages come in order
    of their number of rows."""
    rows = labelled.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL").where(F.length("text") > 0)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}

    def hashed(label: str):
        return F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(label))).otherwise(F.xxhash64("doc_id", F.lit(label)))

    u = F.pmod(hashed("dictionary"), F.lit(1 << 20))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, max(1, int(min(1.0, sample_rows / n) * (1 << 20))))])
    spare = F.greatest(F.length("text") - F.lit(SAMPLE_ROW_CHARS), F.lit(0))
    part = F.substr("text", (F.pmod(hashed("place"), spare + 1) + 1).cast("int"), F.lit(SAMPLE_ROW_CHARS))
    by_lang: dict[str, list] = {lang: [] for lang in sorted(counts, key=lambda x: (-counts[x], x))}
    for r in rows.where(u < share[F.col("lang")]).select("lang", part.alias("text"), u.alias("u")).collect():
        by_lang[r["lang"]].append((r["u"], r["text"]))
    out = {}
    for lang, texts in by_lang.items():
        body = bytearray()
        for _, text in sorted(texts):
            if len(body) >= dict_bytes:
                break
            body += normalise(text) + b" "
        if body.strip():
            body *= -(-8 // len(body))  # a dictionary has 8 bytes at least
            out[lang] = bytes(body[:dict_bytes])
    return out  # each of its own size: cut to the shortest one's, all languages lose by a rare one


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _classifier(dicts: dict[str, bytes], min_margin: float):
    langs = list(dicts)
    packers = []
    for lang in langs:
        d = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        packers.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))

    def classify(raw: bytes | None) -> tuple[str, float, bool, float]:
        text = (raw or b"").decode("utf-8", "replace")
        if not langs or not _has_letter(text):
            return "und", 0.0, True, 0.0
        body = normalise(text)
        blocks = [body[i:i + BLOCK_BYTES] for i in range(0, len(body), BLOCK_BYTES)]
        sizes = [max(1, sum(len(p.compress(b)) for b in blocks)) for p in packers]
        order = sorted(range(len(langs)), key=lambda i: (sizes[i], i))  # of equals, the more frequent language
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / sizes[order[1]] if len(order) > 1 else 1.0
        score = 1.0 / sum((best / s) ** 16 for s in sizes)
        return langs[order[0]], score, margin < min_margin, margin

    return classify


def identify_languages(docs: DataFrame, dicts: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score (0 to 1), rejected, margin."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("rejected", pa.bool_()), ("margin", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = _classifier(dicts, min_margin)
        for b in batches:
            got = [classify(t.as_py()) for t in b.column(1)]
            cols = list(zip(*got)) if got else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:])], schema=schema)

    return text_columns(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, margin double")
