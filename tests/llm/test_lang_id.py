"""Operator 1: held-out accuracy and defined cases."""
from bodega.llm import lang_id, queries

MID = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in queries.table(spark, MID, "documents").select("doc_id", "lang").collect()}
    rows = queries.op1_language_id(spark, MID).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert 200 < len(held) < 300
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.96 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_defined_cases(spark):
    words = {"xx": "bala kota mira tuno sela ", "yy": "grznt vlkst prdk smrt hlst "}
    train = spark.createDataFrame([(i, words[k] * 20, k) for i, k in enumerate(["xx", "yy"] * 30)] + [(None, "lost", None), (99, None, "zz")],
                                  "doc_id long, text string, lang string")
    dicts = lang_id.learn_dictionaries(train)
    assert set(dicts) == {"xx", "yy"}
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "12 - 34!", 7), (4, words["xx"], 7), (4, words["xx"], 7), (None, words["yy"] * 40_000, 7)],
                                 "doc_id long, text string, lang_pred int")
    got = sorted(((r.doc_id or 0, r.lang_pred, r.rejected) for r in lang_id.identify_languages(docs, dicts).collect()))
    assert got == [(0, "yy", False), (1, "und", True), (2, "und", True), (3, "und", True), (4, "xx", False), (4, "xx", False)]
    assert {r.lang_pred for r in lang_id.identify_languages(docs, {}).collect()} == {"und"}
    assert lang_id.learn_dictionaries(train.limit(0)) == {}
    assert lang_id.identify_languages(docs.limit(0), dicts).collect() == []


def test_narrow_margin_is_rejected(spark):
    dicts = {"a": b"one two three four five six " * 4, "b": b"one two three four five six " * 4}
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    r = lang_id.identify_languages(docs, dicts).first()
    assert r.rejected and r.lang_pred == "a" and r.margin == 0.0
