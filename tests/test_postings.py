import math
from collections import Counter

import pyspark.sql.functions as F
import pytest

from tessera.functions.text import counted, with_counts
from tessera.operators import search

SCHEMA = "path string, text string, term string, bucket string"
DOCS = [(f"d{i}", "alpha " * (i % 5) + "beta " * (i % 3) + f"word{i} É9 x", "clash", "clash") for i in range(40)]
DOCS += [("null", None, "", ""), ("empty", "", "", ""), ("none", " . x -", "", ""), ("same", "alpha alpha", "", ""), ("again", "alpha alpha", "", ""), ("long", "alpha gamma " * 50_000, "", "")]


def brute(query):
    docs = [(p, [w.lower() for w in (t or "").replace(".", " ").replace("-", " ").split() if len(w.encode()) >= 2]) for p, t, *_ in DOCS]
    docs = [(p, w) for p, w in docs if w]
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    df = {t: sum(t in w for _, w in docs) for t in set(query)}
    out = Counter()
    for p, w in docs:
        for t, uses in Counter(query).items():
            if tf := w.count(t):
                out[p] += uses * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
    return out


def test_scores_and_layout(spark):
    terms, stats = search.postings(spark.createDataFrame(DOCS, SCHEMA).repartition(3))
    for query in (["alpha"], ["beta", "word7", "beta"], ["é9", "gamma"], ["none"], []):
        got = {r.path: round(r.score, 9) for r in search.bm25_from_postings(terms, stats, query, 100).collect()}
        want = brute([q for q in query])
        assert set(got) == set(want) and all(math.isclose(got[p], want[p], abs_tol=1e-8) for p in got)
    plan = search.bm25_from_postings(terms, stats, ["alpha"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket#" in plan.split("PartitionFilters", 1)[1][:80]


def test_nothing(spark):
    terms, stats = search.postings(spark.createDataFrame([], SCHEMA))
    assert search.bm25_from_postings(terms, stats, ["alpha"]).collect() == [] and tuple(stats.first()) == (0, 0.0)


@pytest.mark.parametrize("words", [[], ["a"], ["b", "a", "b", "b"], ["é", "", "é"]])
def test_counted(spark, words):
    df = spark.createDataFrame([(sorted(words),)], "words array<string>").select(F.inline(counted(F.col("words"))))
    assert {r.term: r.tf for r in df.collect()} == Counter(words)
    got = with_counts(spark.createDataFrame([(sorted(words),)], "words array<string>"), "words").first()
    assert {t.term: t.tf for t in got.terms} == Counter(words) and got.length == len(words)


def test_a_word_is_shuffled_once_a_document(spark):
    docs = spark.createDataFrame([(f"d{i}", "alpha beta " * 200, "", "") for i in range(20)], SCHEMA)
    rows = []
    original = search.reread
    try:
        search.reread = lambda spark, path, dealt: rows.append(dealt) or original(spark, path, dealt)
        terms, stats = search.postings(docs)
    finally:
        search.reread = original
    plan = rows[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # counted within their rows, before the shuffle
    assert terms.count() == 40 and tuple(stats.first()) == (20, 400.0)
