"""Operator 7 against a plain count, and the shrinkage of host rates."""
import random
import re

from bodega.llm import quality_rules as q
from bodega.llm import queries

SMALL = "/root/testdata/sf0.001"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, t in enumerate(tri) if tri.count(t) > 1 for j in range(3)} if len(tri) < 3000 else None
    if hit is None:
        seen = {}
        for i, t in enumerate(tri):
            seen.setdefault(t, []).append(i)
        hit = {i + j for v in seen.values() if len(v) > 1 for i in v for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(words), len(hit)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def test_counts_match_a_plain_count(spark):
    rnd = random.Random(3)
    odd = [None, "", " \n\t", "a b c", "a b c a b c", "a a a a a", "x\n x\nx\n\nx \n", "é\x85b\x1cc d", "word " * 3000, "#$ <a> | b"]
    odd += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 90))) for _ in range(60)]
    own = spark.createDataFrame([(i, t, f"h{i % 3}", 1) for i, t in enumerate(odd)], "doc_id long, text string, source string, kept int")
    for docs in (own, queries.table(spark, SMALL, "documents")):
        want = sorted((r.doc_id, *plain(r.text)) for r in docs.collect())
        got = q.apply_quality_rules(docs).collect()
        assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
        assert all(not r.kept for r in got if r.base_failed)


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short text"
    rows = [(i, good, "good", ) for i in range(200)] + [(1000 + i, bad if i % 10 else good, "bad") for i in range(200)]
    rows += [(2000 + i, good, f"s{i % 40}") for i in range(400)] + [(3000, bad, "tiny"), (4000, good, None), (4001, None, None)]
    got = {r.doc_id: r for r in q.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == len(rows)
    assert got[0].kept and got[4000].kept and not got[4001].kept
    assert not got[1000].host_kept and not got[1010].kept          # a sound text on a bad host
    f = q.rule_failures(q.document_features(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    rate = {r.host: r.rate_base for r in q.host_verdicts(f).collect()}
    assert 0 < rate["good"] < 0.1 and 0.8 < rate["bad"] < 0.95 and rate["tiny"] < 1.0


def test_empty(spark):
    assert q.apply_quality_rules(queries.table(spark, SMALL, "documents").limit(0)).collect() == []
