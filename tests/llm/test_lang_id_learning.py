"""Operator 1: every labelled language is learned."""
from bodega.llm import lang_id


def test_languages_of_long_or_tiny_texts_are_learned(spark):
    words = {"xx": "bala kota mira tuno sela ", "yy": "grznt vlkst prdk smrt hlst ", "zz": "quu wii oox eeq uuw "}
    long = lang_id.SAMPLE_ROW_CHARS // 20 + 100
    rows = [(i, words["xx"] * 20, "xx") for i in range(30)] + [(100 + i, words["yy"] * long, "yy") for i in range(30)]
    rows += [(None, words["zz"] * 5 + str(i), "zz") for i in range(700)] + [(900, "ħa", "tt"), (901, "12", "nn")]
    dicts = lang_id.learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(dicts) == {"xx", "yy", "zz", "tt"}
    docs = spark.createDataFrame([(i, words[k] * 3) for i, k in enumerate(words)], "doc_id long, text string")
    assert [r.lang_pred for r in sorted(lang_id.identify_languages(docs, dicts).collect())] == list(words)


def test_a_long_text_gives_a_slice_from_any_place(spark):
    texts = [(i, "".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)} " for j in range(8000)), "xx") for i in range(8)]
    body = lang_id.learn_dictionaries(spark.createDataFrame(texts, "doc_id long, text string, lang string"))["xx"]
    assert len(body) > 7 * lang_id.SAMPLE_ROW_CHARS and b"waaa wbaa wcaa" not in body and len(set(body.split())) > 4000


def test_a_rare_language_leaves_the_other_dictionaries_whole(spark):
    rows = [(i, " ".join(f"{k}{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(200)), k) for i, k in enumerate(["xx", "yy"] * 60)]
    schema = "doc_id long, text string, lang string"
    want = lang_id.learn_dictionaries(spark.createDataFrame(rows, schema))
    got = lang_id.learn_dictionaries(spark.createDataFrame(rows + [(999, "quu wii oox", "zz")], schema))
    assert min(map(len, want.values())) == lang_id.DICT_BYTES
    assert {k: got[k] for k in want} == want and set(got) == {"xx", "yy", "zz"}
