import pytest

from tessera.operators.search import tfidf_postings, tfidf_scores, tfidf_search, tfidf_weights
from tessera.plans import queries as plans

SCHEMA = "path string, name string, kind string, line int, term string, weight double"


@pytest.fixture(scope="module")
def symbols(spark):
    names = ["parse_tree", "ParseTree", "renderPage", "open file", None, "", "___", "tree", "tree"]
    return spark.createDataFrame([(f"f{i % 7}", n, "function", i, "clash", 1.0) for i, n in enumerate(names * 4)], SCHEMA).repartition(3)


@pytest.mark.parametrize("tokens", [["parse"], ["tree", "tree", "nowhere"], ["page", "file", "open"], ["nowhere"], []])
def test_stored_scores_are_those_of_all_weights(spark, symbols, tokens):
    stored, anew = tfidf_postings(symbols), tfidf_weights(symbols)
    plain = [{(r.path, round(r.score, 9)) for r in tfidf_scores(w, tokens).collect()} for w in (stored, anew)]
    assert plain[0] == plain[1]
    found = [{(r.path, r.is_fallback) for r in tfidf_search(symbols, w, tokens, 50).collect()} for w in (stored, anew)]
    assert found[0] == found[1]


def test_a_request_reads_its_terms(spark, symbols, tmp_path):
    tfidf_postings(symbols).write.parquet(str(tmp_path / "w"))
    plan = tfidf_scores(spark.read.parquet(str(tmp_path / "w")), ["parse"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,parse)" in plan or "In(term, [parse])" in plan


def test_nothing(spark, symbols):
    assert tfidf_postings(symbols.limit(0)).collect() == [] and tfidf_scores(tfidf_postings(symbols.limit(0)), ["a"]).collect() == []


def test_the_query_of_scores_has_no_row_where_every_file_has_every_term(spark, tmp_path):
    rows = [(i, "small ring", f"Brand#{i % 3}", "LARGE", i % 2) for i in range(12)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert plans.tfidf_search(spark, str(tmp_path)).collect() == []
