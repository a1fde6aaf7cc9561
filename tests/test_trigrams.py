import pytest

from tessera.operators.search import search_symbols
from tessera.operators.trigrams import grams_of, name_index, trigram_search

NAMES = ["get_user", "getUser", "GETXUSER", "user", "us", "", None, "Überuser", "über", "usergetuser", "a%b_c\\d", "resu teg", "useruseruser", "日本語名", "get\\user", "getuserget"]
SCHEMA = "name string, path string, line int, gram string, n long"


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame([(n, f"p{i % 4}", i, "clash", 1) for i, n in enumerate(NAMES * 3)], SCHEMA).repartition(3)


def test_equal_to_a_scan(spark, symbols):
    grams, stored = name_index(symbols)
    for query in ("user", "get_user", "GET%user", "us", "", "%", "über", "%serus%", "\\u", "t\\us", "日本語", "nowhere", "ser_ser", "b_c\\d", "userget"):
        found, work = trigram_search(grams, stored, query, 20)
        want = search_symbols(symbols, query, 20)
        assert found.columns == want.columns and found.collect() == want.collect(), query
        n = work.first()
        assert n.symbols_read == (search_symbols(symbols, query, 1000).count() if grams_of(query) else 45)
        assert n.candidates <= len(NAMES)
    plan = trigram_search(grams, stored, "user", 5)[0]._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters", 1)[1].split("]")[0]


def test_grams():
    assert grams_of("Get_User%x") == ["get", "ser", "use"] and grams_of("a_bc%") == [] and grams_of("") == []


def test_nothing(spark, symbols):
    grams, stored = name_index(symbols.limit(0))
    assert trigram_search(grams, stored, "user", 5)[0].collect() == [] and trigram_search(grams, stored, "u", 5)[0].collect() == []
