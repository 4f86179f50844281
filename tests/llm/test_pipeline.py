"""The corpus pipeline against brute force behind the classifier's verdicts."""
import hashlib

import brute_force
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from bodega.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_pipeline(spark):
    toxic = {r.doc_id for r in queries.op6_toxicity(spark, SMALL).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SMALL, "documents").collect() if r.doc_id not in toxic]
    items = [(r.item_id, r.text) for r in queries.table(spark, SMALL, "benchmark").collect()]
    rows = [row for row, (i, _, first) in zip(rows, brute_force.near_duplicates(rows)) if i == first]
    rows = [(i, kept if gone else text) for (i, text), (_, _, gone, kept) in zip(rows, brute_force.repeats(rows))]
    rows = [row for row, found in zip(rows, brute_force.contamination(rows, items)) if not found[2]]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    want = []
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, ids, hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r.doc_id, list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert sorted(got) == sorted(want)
    assert toxic and 0 < len(got) < 200 - len(toxic)


def test_stages_return_the_columns_of_documents(spark):
    docs = queries.table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).dtypes == docs.dtypes, name


def folder(spark, tmp_path, documents):
    for name in ("labels", "benchmark"):
        queries.table(spark, SMALL, name).write.parquet(f"{tmp_path}/{name}.parquet")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("rows", [[], [(None, None, None, "a", 1), (1, "", "en", "a", 2), (1, "", "en", "a", 2), (None, "word " * 300, "xx", None, None)]])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key int")
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, docs)).collect()
    # null and empty texts share fingerprint zero: of that group the row with id 1 stays
    assert sorted((r.doc_id is not None, r.n_tokens) for r in out) == ([(False, 300), (True, 0)] if rows else [])
