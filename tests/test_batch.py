import pyspark.sql.functions as F
import pytest

from tessera.operators.search import postings, tfidf_postings
from tessera.plans import batch
from tessera.plans.batch import name_grams, names_matching, ranked_contexts
from tessera.plans.context import Index, run_pipeline
from tessera.scratch import brief_shuffles, materialise

FILES = "path string, language string, char_count long, text string, request string"
SYMBOLS = "symbol_id long, path string, name string, kind string, line int, request string"
NAMES = ["parse_tree", "ParseTree", "render_page", "RenderQueue", "open_file", "Über_name", "tree", "closeFile", "walk", "a_b", "queue_limit", None]
TASKS = [
    ("r1", "Fix parse_tree and the RenderQueue please"), ("r2", "walk the Tree tree again"), ("r3", "nothing to see"), ("r4", ""), ("r5", None),
    ("r6", "the and with"), ("r7", "über queue"), ("r8", "alpha gamma alpha document7"), ("r9", "f3 file open"), ("r10", "q_e"),
]


@pytest.fixture(scope="module")
def index(spark):
    files = [(f"repo/src/{n}_{i}.rs", "rust", 400 * (i + 1), None, "x") for i, n in enumerate(["tree", "file", "queue", "page", "walk"] * 6)]
    files += [("repo/Form.cs", "csharp", 90, None, "x"), ("repo/Form.Designer.cs", "csharp", 90, None, "x"), ("repo/data.json", "json", 50, None, "x")]
    files += [(f"docs/d{i}.md", "markdown", 4000, "alpha " * (i % 4) + f"gamma document{i} tree walk", "x") for i in range(30)]
    files += [("docs/empty.md", "markdown", 0, "", "x"), ("docs/null.md", "markdown", 0, None, "x")]
    paths = [f[0] for f in files[:33]]
    symbols = [(i, paths[i % 33], n and (n if i % 3 else f"{n}_{i}"), "function", i, "x") for i, n in enumerate(NAMES * 25)]
    symbols += [(1000, "repo/Form.Designer.cs", "zebra_form", "class", 1, "x"), (1001, "repo/Form.cs", "zebra_form", "class", 1, "x")]
    edges = spark.createDataFrame([(1, 2, "import")], "from_id long, to_id long, kind string")
    return Index(spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS), edges)


def plain(rows, digits=6):
    return [(r.position, r.path, round(r.score, digits), r.level, r.tokens, r.truncated, r.reasons) for r in sorted(rows, key=lambda r: r.position)]


def test_equal_to_single_requests(spark, index):
    tasks = [*TASKS, ("r11", "zebra_form walk")]
    found = ranked_contexts(index, spark.createDataFrame(tasks, "request string, task string"), 6000, noise={"queue"})
    pivots, verdicts = found.pivots.collect(), {r.request: r for r in found.verdicts.collect()}
    assert sorted(verdicts) == sorted(r for r, _ in tasks)
    for request, task in tasks:
        if not task:
            assert not [p for p in pivots if p.request == request] and verdicts[request].confidence == "low"
            continue
        want = run_pipeline(index, task, 6000, noise={"queue"})
        assert plain(p for p in pivots if p.request == request) == plain(want.pivots.collect()), task
        one, own = want.summary.first(), verdicts[request]
        for c in ("confidence", "weak", "uncovered", "had_fallback", "n_pivots", "total_tokens"):
            assert own[c] == one[c], (task, c)
    assert len(pivots) > 60 and any(v.had_fallback for v in verdicts.values()) and len({v.confidence for v in verdicts.values()}) == 3


def test_stored_weights_and_diff(spark, index):
    stored = Index(index.files, index.symbols, index.edges, tfidf_postings(index.symbols))
    tasks = spark.createDataFrame(TASKS[:3] + TASKS[:1], "request string, task string")
    diff = spark.createDataFrame([("r3", "repo/data.json"), ("r3", "repo/data.json"), ("r1", "gone"), ("r1", None)], "request string, path string")
    found = ranked_contexts(stored, tasks, 6000, diff=diff).pivots.collect()
    twice = TASKS[0][1] + " " + TASKS[0][1]
    for request, task, changed in (("r1", twice, []), ("r2", TASKS[1][1], []), ("r3", TASKS[2][1], ["repo/data.json"])):
        assert plain(p for p in found if p.request == request) == plain(run_pipeline(stored, task, 6000, diff=changed).pivots.collect())
    assert any(p.git_diff for p in found)


def test_nothing(spark, index):
    none = ranked_contexts(index, spark.createDataFrame([], "request string, task string"))
    assert none.pivots.collect() == [] and none.verdicts.collect() == []
    empty = Index(index.files.limit(0), index.symbols.limit(0), index.edges.limit(0))
    found = ranked_contexts(empty, spark.createDataFrame(TASKS, "request string, task string"))
    assert found.pivots.collect() == [] and found.verdicts.count() == len(TASKS)


def test_names_matching(spark):
    names = ["a", "ab", "abc", "xabcx", "a_c", "über", "", "日本語", "abcabc", "___"]
    words = ["a", "abc", "a_c", "_", "___", "b", "本", "none", "ü_er", "c_b"]
    index = name_grams(spark.createDataFrame([(n,) for n in names], "name string"))
    found = {(r.word, r.name) for r in names_matching(spark.createDataFrame([(w,) for w in words], "word string"), index).collect()}

    def like(w, n):
        return any(all(c in ("_", d) for c, d in zip(w, n[i:])) for i in range(len(n) - len(w) + 1))

    assert found == {(w, n) for w in words for n in names if like(w, n)}


def test_bm25_of_texts_equals_stored_postings_whatever_terms_collide(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", "alpha " * (i % 3) + f"beta tree{i % 7}") for i in range(60)] + [("none", "."), ("null", None)], "path string, text string")
    uses = spark.createDataFrame([("r", "Alpha", 2), ("r", "tree3", 1), ("s", "tree4", 1), ("t", "nowhere", 1)], "request string, keyword string, uses long")
    want = {(r.request, r.path, r.score) for r in batch._bm25(uses, *postings(docs)).collect()}
    salted = lambda term, salt: F.xxhash64(F.lit(salt), term) if salt else F.length(term).cast("long")
    monkeypatch.setattr(batch, "_term_id", salted)
    assert {(r.request, r.path, r.score) for r in batch._bm25_texts(uses, docs).collect()} == want and len(want) > 25


def test_words_that_no_request_asks_for_are_not_written(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "one two two Three"), ("b", "four five"), ("c", "")], "path string, text string")
    uses = spark.createDataFrame([("r", "TWO", 1), ("r", "three", 1)], "request string, keyword string, uses long")
    kept, write = [], batch.materialise
    monkeypatch.setattr(batch, "materialise", lambda df: kept.append(write(df)) or kept[-1])
    monkeypatch.setattr(batch, "discard", lambda df: None)
    batch._bm25_texts(uses, docs)
    rows = {r.path: (r.length, r.words) for df in kept if df.columns == ["path", "length", "words"] for r in df.collect()}
    assert rows == {"a": (4, "three two two"), "b": (2, ""), "c": (0, "")}


def test_requests_leave_no_shuffle_behind(spark):
    def files():
        made = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (made.apply(i).getName() for i in range(made.size())) if f.startswith("shuffle_")}

    before = files()
    with brief_shuffles(spark):
        assert materialise(spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    assert files() <= before
    materialise(spark.range(1000).repartition(4))
    assert not files() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
