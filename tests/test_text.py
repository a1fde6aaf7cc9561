import pyspark.sql.functions as F
import pytest

from tessera.functions import text as tx
from tessera.operators import graph
from tessera.sources import walk


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("getAuthToken", ["get", "auth", "token"]),
        ("get_auth_token", ["get", "auth", "token"]),
        ("HTTP_SERVER", ["http", "server"]),
        ("HTTPServer_v2", ["httpserver", "v2"]),
        ("Find the user, then log-in!", ["find", "the", "user", "then", "log", "in"]),
        ("", []),
    ],
)
def test_camel_tokens(spark, given, expected):
    assert one(spark, tx.camel_tokens(F.col("t")), t=given) == expected


def test_symbol_and_plain_tokens(spark):
    assert one(spark, tx.symbol_tokens(F.col("t")), t="get userName-v2.x") == ["get user", "name", "v2", "x"]
    assert one(spark, tx.plain_tokens(F.col("t")), t="A bc é getUser x1") == ["bc", "é", "getuser", "x1"]


@pytest.mark.parametrize(
    "name, keyword, expected",
    [("auth", "AUTH", 1.0), ("authenticate", "auth", 0.85), ("user_auth", "auth", 0.85), ("reauthorize", "auth", 0.4), ("x", "auth", 0.0)],
)
def test_match_quality(spark, name, keyword, expected):
    assert one(spark, tx.match_quality(F.col("n"), F.col("k")), n=name, k=keyword) == expected


def test_keyword_weight(spark):
    rows = spark.createDataFrame([(d, 1000) for d in (0, 1, 10, 100, 1000)], "df long, n long")
    weights = [r[0] for r in rows.select(tx.keyword_weight(F.col("df"), F.col("n"))).collect()]
    assert weights[0] == 1.0 and weights == sorted(weights, reverse=True) and weights[-1] >= 0
    assert one(spark, tx.keyword_weight(F.col("df"), F.col("n")), df=5, n=0) == 1.0


def test_keywords():
    assert tx.task_keywords("fix the login_bug in API v2, fix it") == ["fix", "the", "login_bug", "API", "fix"]
    assert tx.meaningful(["fix", "the", "login"]) == ["login"]
    assert tx.meaningful(["fix", "the"]) == ["fix", "the"]
    assert tx.noise_keywords(["my-app", "webServer"], ["Foo"]) == {"app", "web", "server", "foo"}


@pytest.mark.parametrize("tokens, expected", [(1, "abcd"), (2, "abcdé€"), (3, "abcdé€𝄞")])
def test_truncated(spark, tokens, expected):
    text = "abcdé€𝄞xyz"  # 1 1 1 1 2 3 4 1 1 1 bytes
    got = one(spark, tx.truncated(F.col("t"), tokens, "|"), t=text)
    whole = text.encode()[: tokens * 4].decode("utf-8", "ignore")
    assert got == whole + "|"
    assert one(spark, tx.truncated(F.col("t"), 100, "|"), t=text) == text


def test_renderings(spark):
    assert one(spark, tx.minute_text(F.col("t")), t=1700000000000) == "2023-11-14 22:13"
    assert one(spark, tx.minute_text(F.col("t")), t=0) == "1970-01-01 00:00"
    assert one(spark, tx.capped_list(F.col("a")), a=list("abcdefgh")) == "a, b, c, d, e … (+3 more)"
    assert one(spark, tx.capped_list(F.col("a")), a=["x", "y"]) == "x, y"
    assert one(spark, tx.savings_percent(F.col("a"), F.col("b")), a=1000, b=350) == "65%"
    assert one(spark, tx.savings_percent(F.col("a"), F.col("b")), a=0, b=0) == "0%"
    assert one(spark, tx.efficiency(F.col("a"), F.col("b")), a=0, b=0) == "0%"
    assert one(spark, tx.dollars(F.col("a"), "opus"), a=2_000_000) == "$30.00"
    assert [one(spark, tx.severity(F.col("n")), n=n) for n in (0, 5, 20, 21)] == ["none", "low", "medium", "high"]


def test_paths(spark):
    assert one(spark, tx.file_stem(F.col("p")), p="a/b.c/UserAuth.test.ts") == "UserAuth.test"
    assert one(spark, tx.file_stem(F.col("p")), p="a/.env") == ".env"
    assert [one(spark, tx.language_of(F.col("p")), p=p) for p in ("x.rs", "x.RS", "Makefile", ".md", "a.b/x.tsx")] == ["rust", "unknown", "unknown", "unknown", "typescript"]
    assert tx.derive_aliases(["/a/app", "/b/app", "/c/app/"]) == {"/a/app": "app", "/b/app": "app-2", "/c/app/": "app-3"}


def test_words_of_columns(spark):
    tasks = ["fix the login_bug in API v2, fix it", "the and for", "", "  ..  ", "Über-Straße 日本語x é", None, "if to in"]
    rows = spark.createDataFrame([(t,) for t in tasks], "task string").select("task", tx.task_words(F.col("task")).alias("words"))
    for r in rows.withColumn("kept", tx.meaningful_words(F.col("words"))).collect():
        if r.task is None:
            assert r.words is None and r.kept is None
        else:
            assert r.words == tx.task_keywords(r.task) and r.kept == tx.meaningful(r.words)
    aliases = ["my-app", "webServer", "a_bc_def2Go", "", "ÜberApp", "x"]
    got = spark.createDataFrame([(a,) for a in aliases], "alias string").select(F.explode(tx.noise_words(F.col("alias"))).alias("w"))
    assert {r.w for r in got.collect()} == tx.noise_keywords(aliases)


def test_safe_paths_of_a_column(spark):
    paths = ["a/b", "a\\b", "../a", "a/../b", "/etc", "C:\\x", "c:x", "a..b/c", "", "a\x00b", "\\a", "a/.."]
    got = {r.path: r.safe for r in spark.createDataFrame([(p,) for p in paths], "path string").select("path", walk.safe_path(F.col("path")).alias("safe")).collect()}
    for p in paths:
        try:
            assert got[p] == walk.safe_relative(p)
        except ValueError:
            assert got[p] is None, p


def test_shown_symbols(spark):
    rows = [("function", "export"), ("Class", "PUBLIC static"), ("variable", "export"), ("type", None), (None, "public"), ("trait", "private"), ("module", "default")]
    got = graph.shown(spark.createDataFrame(rows, "kind string, scope string")).collect()
    assert sorted(map(tuple, got)) == [("Class", "PUBLIC static"), ("function", "export"), ("module", "default")]
