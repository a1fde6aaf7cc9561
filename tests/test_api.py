import subprocess

from tessera.operators.search import tfidf_weights
from tessera.plans.api import Engine


def test_engine(spark, tmp_path):
    repo = tmp_path / "shop"
    for name, body in {
        "src/cart.py": "from price import total\n\ndef checkout(items):\n    return total(items)\n",
        "src/price.py": "def total(items):\n    return sum(items)\n",
        "README.md": "# Shop\nHow checkout works\n",
    }.items():
        (repo / name).parent.mkdir(parents=True, exist_ok=True)
        (repo / name).write_text(body)
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@e", *a], check=True, capture_output=True)
    run("init", "-q")
    for message in ("one", "two"):
        (repo / "src/extra.py").write_text(f"def {message}():\n    pass\n")
        run("add", ".")
        run("commit", "-qm", message)
    engine = Engine(spark, str(tmp_path / "index"))
    assert {r.change for r in engine.add_repo("shop", str(repo)).collect()} == {"new"}
    total = engine.context("total").first()
    assert total.path == "shop/src/price.py"
    affected, summary = engine.impact(total.symbol_id)
    assert [r.names for r in affected.collect()] == [["checkout"]] and summary.first().severity == "low"
    assert [r.other_name for r in engine.dependencies("checkout").collect()] == ["total"]
    assert engine.symbol("total").first().source == "def total(items):\n    return sum(items)\n"
    assert {r.path for r in engine.diff_context("shop").collect()} == {"shop/src/extra.py"}
    assert {r.language: r.n_files for r in engine.overview()["languages"].collect()} == {"python": 3, "markdown": 1}
    engine.session_log("where is total", "in price.py", ["total"], ["shop/src/price.py"], 40)
    engine.session_log("what is there", "a cart", [], ["shop\\src\\cart.py"])
    assert {r.query: r.stale for r in engine.session_calls().collect()} == {"where is total": False, "what is there": False}
    (repo / "src/price.py").write_text("def amount(items):\n    return sum(items)\n")
    assert engine.index_file("shop", "src/price.py") and not engine.index_file("shop", ".git/config")
    assert engine.dependencies("checkout").first().other_name is None
    pivots = engine.pipeline("how does checkout work").pivots.collect()
    reasons = {p.path: p.reasons for p in pivots}
    assert "git_diff" in reasons["shop/src/price.py"] and {r.path for r in engine.files().collect()} == {"shop/src/cart.py", "shop/src/price.py", "shop/src/extra.py", "shop/README.md"}
    assert {r.query: r.stale for r in engine.session_calls().collect()} == {"where is total": True, "what is there": False}
    assert [r.query for r in engine.session_calls("CART").collect()] == ["what is there"]
    stored, anew = engine.index().weights, tfidf_weights(engine.store.table("symbols"))
    assert {(r.path, r.term, round(r.weight, 9)) for r in stored.collect()} == {(r.path, r.term, round(r.weight, 9)) for r in anew.collect()}
    asked = spark.createDataFrame([(1, "how does checkout work"), (2, "sum the items")], "request int, task string")
    many = engine.contexts(asked)
    assert "shop/src/cart.py" in {r.path for r in many.pivots.where("request = 1").collect()} and many.verdicts.count() == 2
    found = engine.searches().first()
    assert found.task == "how does checkout work" and found.pivots == [p.path for p in pivots][:8] and engine.usage().first().queries == 1
    assert engine.compress_file("shop/src/cart.py", 2).first().compressed_bytes < 75
    engine.reindex_all()
    engine.remove_file("shop", "src/extra.py")
    assert engine.files().count() == 3
    engine.remove_repo("shop")
    assert engine.files().count() == 0
    assert engine.searches().count() == 1  # the log is no part of the index


def test_readers_keep_the_snapshot_before(spark, tmp_path):
    from tessera.sources.store import SCHEMAS, Store

    store = Store(spark, str(tmp_path / "s"))
    store.add_repo("a", "/a")
    before = store.table("repos")
    store.add_repo("b", "/b")
    assert before.count() == 1 and store.table("repos").count() == 2 and store.table("files").count() == 0
    store.commit(repos=spark.createDataFrame([("c", "/c")], SCHEMAS["repos"]))
    assert [r.alias for r in store.table("repos").collect()] == ["c"] and len(store._snapshots()) == 2


def test_one_file_is_listed_like_all(tmp_path):
    from tessera.sources import walk

    for name, body in {"a/x.py": "x", "a/b.log": "y", "a/c/d.py": "z", ".gitignore": "*.log\n/a/c/\n", "venv/q.py": "q"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    every = walk.list_files(str(tmp_path))
    assert [p for p, *_ in every] == ["a/x.py"]
    for name in ("a/x.py", "a/b.log", "a/c/d.py", "venv/q.py", "gone.py", ".gitignore", "a"):
        assert walk.list_one(str(tmp_path), name) == [e for e in every if e[0] == name]
