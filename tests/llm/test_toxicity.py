"""Operator 6: held-out accuracy, the counterfactual penalty and defined cases."""
import math
import random
import re

import numpy as np

from bodega.llm import queries, toxicity

SMALL = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    toxic = {r.doc_id: r.toxic for r in queries.table(spark, MID, "labels").collect()}
    rows = queries.op6_toxicity(spark, MID).collect()
    assert len(rows) == queries.table(spark, MID, "documents").count()
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all((r.score >= 0.7) == bool(r.predicted) and 0 <= r.score <= 1 for r in rows)


def sentences(n=600, seed=4):
    """Toxic sentences mention one group more often than clean ones do."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        bad = i % 3 == 0
        words = [rnd.choice("table chair window river stone garden walk early".split()) for _ in range(8)]
        if bad and rnd.random() < 0.7:
            words.append(rnd.choice(["idiot", "scum"]))
        if rnd.random() < (0.8 if bad else 0.1):
            words.append("muslim")
        elif rnd.random() < 0.3:
            words.append("christian")
        rows.append((i, " ".join(words) + ".", int(bad)))
    return rows


def test_swapping_identity_terms_changes_little(spark):
    rows = sentences()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    gaps, calls = [], []
    for strength in (0.0, 50.0):
        score = toxicity.learn(docs, labels, strength=strength).scorer()
        gaps.append(abs(score(b"a muslim in the garden") - score(b"a christian in the garden")))
        calls.append(score(b"you idiot scum in the garden"))
    assert gaps[0] > 0.3 and gaps[1] < 0.05
    assert min(calls) > 0.8


def test_found_groups_on_the_table(spark):
    """Interchangeable words are found in the labelled sentences, their swaps are penalised,
    and the score changes less when one stands for the other."""
    docs = queries.table(spark, MID, "documents")
    labels = queries.table(spark, MID, "labels").where(toxicity_train())
    gaps = []
    for strength in (0.0, toxicity.COUNTERFACTUAL, 50.0):
        model = toxicity.learn(docs, labels, strength=strength)
        score = model.scorer()
        found = [g for g in model.groups if g not in toxicity.IDENTITY_GROUPS]
        assert found and model.n_swaps > 0
        logit = lambda t: np.log(score(t.encode()) / (1 - score(t.encode())))
        gaps.append(np.mean([abs(logit(a) - logit(b)) for a, b in found]))
    assert gaps[0] > gaps[1] > gaps[2]
    assert queries.op6_toxicity(spark, MID).where("swaps_penalised > 0").count() == docs.count()


def toxicity_train():
    from bodega.llm.common import id_residue
    return id_residue("doc_id", 3) != 1


def test_plain_version(spark):
    """Scores of every row against a plain sum over the model's weights."""
    docs = queries.table(spark, SMALL, "documents")
    model = toxicity.learn(docs, queries.table(spark, SMALL, "labels"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in toxicity.score_toxicity(docs, model).collect():
        words = re.sub(rb"[^a-z\x80-\xff]", b" ", texts[r.doc_id].translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))).split()
        z, count = model.bias, {}
        for w in words:
            for f in toxicity.word_features(w):
                count[f] = count.get(f, 0) + 1
        z += sum(x * min(count.get(f, 0), 2) for f, x in model.weights.items())
        assert abs(r.score - (1 / (1 + math.exp(-max(-30, min(30, z)))) if model.fitted else 0)) < 1e-9


def test_defined_cases(spark):
    rows = sentences()
    docs = spark.createDataFrame([(r[0], r[1], "x") for r in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    odd = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (2, "idiot scum " * 30_000, 0.5), (2, "idiot scum " * 30_000, 0.5)], "doc_id long, text string, score double")
    got = sorted((r.doc_id or 0, r.predicted) for r in toxicity.score_toxicity(odd, model).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (2, 1)]
    kept = toxicity.keep_clean(odd, model).collect()
    assert sorted((r.doc_id or 0, r.text, r.score) for r in kept) == [(0, "", 0.5), (1, None, 0.5)] or len(kept) == 2
    assert toxicity.score_toxicity(odd.limit(0), model).collect() == []
    blank = toxicity.learn(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(odd, blank).collect()} == {0.0}
    assert toxicity.keep_clean(odd, blank).count() == 4
