import random

import pyspark.sql.functions as F

from tessera.operators import budget, graph, relevance, resolve
from tessera.operators.dependencies import extract_dependencies
from tessera.plans import queries as plans

ROW = "path string, sym_best double, keywords array<string>, filename_hit boolean, tfidf double, bm25 double"


def test_config():
    c = relevance.Config().merged({"max_pivots": 7, "min_score_abs": 3.0}, {"max_pivots": 0, "min_score_abs": 0.5, "max_file_budget_share": 0.01})
    assert (c.max_pivots, c.min_score_abs, c.max_file_budget_share) == (1, 1.0, 0.05)


def test_fusion_and_cutoff(spark):
    rows = spark.createDataFrame([("a", 1.0, ["x", "y"], False, 2.0, 0.0), ("b", 0.0, [], False, 2.0, 0.0), ("c", 0.1, [], False, 0.0, 0.0)], ROW)
    fused = relevance.fuse(relevance.with_diff_files(rows, spark.createDataFrame([("d",)], "path string")))
    score = {r.path: round(r.score, 6) for r in fused.collect()}
    assert score == {"a": 0.75, "b": 0.35, "c": 0.04, "d": 0.25}
    kept = relevance.cutoff(fused).collect()
    assert {r.path for r in kept} == {"a", "b", "d"} and {r.dropped for r in kept} == {1}
    reasons = {r.path: r.x for r in fused.select("path", relevance.match_reasons().alias("x")).collect()}
    assert reasons["a"] == ["symbol:x+y", "tfidf"] and reasons["d"] == ["git_diff"] and reasons["c"] == ["symbol"]


def test_coverage(spark):
    def verdict(rows, level):
        table = spark.createDataFrame(rows, "keyword string, weight double, best_quality double")
        return relevance.coverage(table).select("uncovered", relevance.apply_coverage(F.lit(level)).alias("c")).first()

    assert verdict([("a", 0.9, 0.0), ("b", 0.6, 0.0)], "high") == (["a", "b"], "low")
    assert verdict([("a", 0.9, 0.0), ("b", 0.6, 1.0)], "high") == (["a"], "medium")
    assert verdict([("a", 0.9, 1.0), ("b", 0.6, 0.0)], "high") == (["b"], "high")
    assert verdict([("a", 0.2, 0.0)], "high") == ([], "high")


def test_caps_and_packing(spark):
    langs = spark.createDataFrame([("rust",), ("markdown",)], "language string")
    assert [r[0] for r in langs.select(budget.file_cap(8000, F.col("language"))).collect()] == [2000, 1500]
    assert [r[0] for r in langs.select(budget.file_cap(1, F.col("language"))).collect()] == [1, 1]
    rows = [(f"f{i}", 1.0 - i / 10, 0, t, False, t) for i, t in enumerate([400, 900, 300, 500, 100])]
    fitted = spark.createDataFrame(rows, "path string, score double, level int, tokens long, truncated boolean, base_tokens long")
    assert [r.path for r in budget.greedy_pack(fitted, 1000).orderBy("position").collect()] == ["f0", "f2", "f4"]


def test_rules(spark):
    files = spark.createDataFrame([("r/src/test_a.rs",), ("r/src/b.rs",), ("r/x.md",)], "path string")
    rules = {"*.rs": 1, "test_*": 0, "x.md": 2, "r/src/b.rs": 9}
    assert {r.path: r.level for r in budget.rule_levels(files, rules).collect()} == {"r/src/test_a.rs": 0, "r/src/b.rs": 2, "r/x.md": 2}


SYMBOLS = "symbol_id long, path string, name string, line int, col int, is_exported boolean"


def test_impact_and_related(spark):
    symbols = spark.createDataFrame([(i, f"f{i}", f"s{i}", 1, 1, True) for i in range(5)], SYMBOLS)
    edges = spark.createDataFrame([(1, 0, "c"), (2, 1, "c"), (0, 2, "c"), (3, 2, "c"), (9, 0, "c")], "from_id long, to_id long, kind string")
    assert {r.path: r.min_depth for r in graph.impact(symbols, edges, 0).collect()} == {"f1": 1, "f2": 2, "f3": 3}
    assert {r.path for r in graph.impact(symbols, edges, 0, 1).collect()} == {"f1"}
    assert graph.impact(symbols, edges, 77).collect() == []
    related = graph.related_files(symbols, edges, spark.createDataFrame([("f0",), ("f1",)], "path string"))
    assert [(r.path, r.n_edges) for r in related.collect()] == [("f2", 2)]


def test_resolution(spark):
    symbols = spark.createDataFrame(
        [(1, "a", "main", 1, 1, False), (2, "a", "own", 5, 1, False), (3, "b", "own", 1, 1, True), (4, "b", "pub", 3, 1, True), (5, "c", "pub", 2, 1, False),
         (6, "b", "twice", 5, 1, False), (7, "c", "twice", 5, 1, False), (8, "c", "only", 9, 1, False)], SYMBOLS)
    deps = spark.createDataFrame([("a", n, "call", 2) for n in ("own", "pub", "twice", "only", "main", "none")] + [("b", "own", "call", 0)], "path string, to_name string, kind string, line int")
    assert {(r.from_id, r.to_id) for r in resolve.resolve(deps, symbols).collect()} == {(1, 2), (1, 4), (1, 8)}


def test_dependencies(spark):
    files = spark.createDataFrame(
        [
            ("p", "python", "from a.b import x, y as z\nimport os\ndef f(a):\n    return g(h(1)) + print(2)\n        self.run(q)\n"),
            ("g", "go", "func main() {\n\tfmt.Println(add(1))\n}"),
            ("r", "rust", "use a::b::C;\nfn f() { x(); A::new(1) }\n    y(z!(1));"),
            ("t", "typescript", "import { A, B } from './m'\nconst q = new Foo(1); a.b(2)\nfunction f(x) { g() }"),
            ("j", "java", "foo();"),
        ],
        "path string, language string, text string",
    )
    got = {}
    for r in extract_dependencies(files).collect():
        got.setdefault(r.path, set()).add((r.to_name, r.kind, r.line))
    call = "function_call"
    assert got["p"] == {("x", "import", 1), ("y", "import", 1), ("g", call, 4), ("h", call, 4), ("run", call, 5)}
    assert got["g"] == {("Println", call, 2), ("add", call, 2)}
    assert got["r"] == {("C", "import", 1), ("new", call, 2), ("y", call, 3)}
    assert got["t"] == {("A", "import", 1), ("B", "import", 1), ("Foo", "type_reference", 2), ("Foo", call, 2), ("b", call, 2)}
    assert "j" not in got


def test_every_part_is_resolved(spark, tmp_path):
    rng = random.Random(8)
    parts = [(i, rng.choice("abcdefgh") * rng.randint(1, 4), rng.choice("xyz")) for i in range(1, 120)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    edges, near = set(), set()
    for key, name, brand in parts:  # a part's line is its key, so it is its own caller
        same = [k for k, n, b in parts if (n, b) == (name, brand)]
        other = [k for k, n, b in parts if n == name and b != brand]
        exported = [k for k in other if k % 29 == 0]
        found = [k for k in same if k != key][:1] or (exported if len(exported) == 1 else other if not exported and len(other) == 1 else [])
        edges.update((key, k, "function_call") for k in found)
        near.update((key, k) for k in same[:1] if k != key)
    assert {tuple(r) for r in plans.resolve_unambiguous(spark, str(tmp_path)).select("from_id", "to_id", "kind").collect()} == edges
    assert any(k % 3 for k, *_ in edges) and plans.same_file_edges(spark, str(tmp_path)).first().n == len(near)
