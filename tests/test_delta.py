import random

import pytest

from tessera.operators.resolve import resolve, resolved
from tessera.sources import delta

SYMBOLS = "name string, symbol_id long, path string, line int, col int, is_exported boolean"
DEPS = "path string, to_name string, kind string, line int"
NAMES = [f"n{i}" for i in range(25)] + ["hot"] * 10


def repository(rng, paths):
    """Files that define and call few names, so that most names are ambiguous now and then."""
    symbols, deps = [], []
    for path in paths:
        lines = sorted(rng.sample(range(1, 40), rng.randint(0, 4)))
        symbols += [(rng.choice("abcdefgh") + rng.choice("xy"), rng.getrandbits(60), path, n, 1, rng.random() < 0.4) for n in lines]
        deps += [(path, rng.choice("abcdefgh") + rng.choice("xy"), rng.choice(["import", "function_call"]), rng.randint(1, 45)) for _ in range(rng.randint(0, 5))]
    return symbols, deps


def state(spark, root):
    return {n: sorted(map(tuple, delta.table(spark, root, n).drop("bucket").collect())) for n in delta.SCHEMAS}


def check(spark, root, files):
    symbols = spark.createDataFrame([s for f in files.values() for s in f[0]], SYMBOLS)
    deps = spark.createDataFrame([d for f in files.values() for d in f[1]], DEPS)
    got = state(spark, root)
    assert sorted((e[2], e[3], e[4]) for e in got["edges"]) == sorted(map(tuple, resolve(deps, symbols).collect()))
    names = {s[1]: (s[0], s[2]) for f in files.values() for s in f[0]}
    assert all((e[0], e[1]) == (names[e[2]][1], names[e[3]][0]) for e in got["edges"])
    assert got["symbols"] == got["definitions"] == sorted(map(tuple, symbols.collect())) and got["deps"] == sorted(map(tuple, deps.collect()))
    assert got["uses"] == sorted({(d[1], d[0]) for f in files.values() for d in f[1]})


def by_path(paths, symbols, deps):
    return {p: ([s for s in symbols if s[2] == p], [d for d in deps if d[0] == p]) for p in paths}


def apply(spark, root, files, changed, gone=(), buckets=8):
    files.update(changed)
    for p in gone:
        files.pop(p)
    symbols = spark.createDataFrame([s for f in changed.values() for s in f[0]], SYMBOLS)
    deps = spark.createDataFrame([d for f in changed.values() for d in f[1]], DEPS)
    return delta.update(spark, root, spark.createDataFrame([(p,) for p in (*changed, *gone)], "path string"), symbols, deps, buckets)


def test_updates_equal_a_rebuild(spark, tmp_path, monkeypatch):
    rng, root, files = random.Random(4), str(tmp_path / "index"), {}
    paths = [f"d/{i}.py" for i in range(25)]
    apply(spark, root, files, by_path(paths, *repository(rng, paths)))
    check(spark, root, files)
    some = ["d/3.py", "d/new.py"]
    apply(spark, root, files, by_path(some, *repository(rng, some)), gone=["d/7.py", "d/8.py"])
    check(spark, root, files)
    # The same again changes no name, so only the file's own partitions are written.
    assert apply(spark, root, files, {"d/3.py": files["d/3.py"]}) == {"edges": 1, "definitions": 0, "uses": 0, "deps": 1, "symbols": 1}
    check(spark, root, files)
    # Cut off before the last table, and repeated.
    put = delta._put

    def broken(df, root, name, touched):
        if name == "symbols":
            raise OSError("the power went")
        put(df, root, name, touched)

    change = by_path(["d/5.py"], *repository(rng, ["d/5.py"]))
    monkeypatch.setattr(delta, "_put", broken)
    with pytest.raises(OSError, match="power"):
        apply(spark, root, files, change)
    monkeypatch.setattr(delta, "_put", put)
    apply(spark, root, files, change)
    check(spark, root, files)


def test_nothing_and_all_gone(spark, tmp_path):
    root, files = str(tmp_path / "index"), {}
    assert set(apply(spark, root, files, {}).values()) == {0}
    apply(spark, root, files, {"a": ([("x", 1, "a", 1, 1, True)], [("a", "y", "import", 2)]), "b": ([("y", 2, "b", 1, 1, False)], [("b", "x", "import", 1)])})
    check(spark, root, files)
    apply(spark, root, files, {}, gone=["a", "b"])
    assert all(rows == [] for rows in state(spark, root).values())


def brute(symbols, deps):
    """Edges as the docstrings have them, one dependency at a time; a symbol of no file is none."""
    edges, symbols = set(), [s for s in symbols if s[2] is not None]
    for path, name, kind, line in deps:
        own = [s for s in symbols if s[2] == path]
        callers = [s for s in own if s[3] <= line]
        if not callers or name is None:
            continue
        caller = min(callers, key=lambda s: (-s[3], s[4], s[1]))[1]
        near = sorted((s[3], s[4], s[1]) for s in own if s[0] == name and s[1] != caller)
        far = [s for s in symbols if s[2] != path and s[0] == name]
        exported = [s for s in far if s[5]]
        target = near[0][2] if near else exported[0][1] if len(exported) == 1 else far[0][1] if not exported and len(far) == 1 else caller
        edges |= {(path, name, caller, target, kind)} - {(path, name, caller, caller, kind)}
    return edges


def test_edges_by_brute_force_in_few_shuffles(spark):
    rng = random.Random(7)
    symbols = [(rng.choice(NAMES), n + 2**40, rng.choice(["a", "b", "c", "d", "e", None]), rng.randint(1, 9), rng.randint(1, 2), rng.choice([True, False, False, None])) for n in range(60)]
    deps = [(rng.choice(["a", "b", "c", "d", "e", "f", None]), rng.choice([*NAMES, None]), rng.choice(["import", "function_call"]), rng.randint(0, 12)) for _ in range(400)]
    found = resolved(spark.createDataFrame(deps, DEPS), spark.createDataFrame(symbols, SYMBOLS))
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == brute(symbols, deps) and len(rows) == len(set(rows)) and len(rows) > 20
    plain = resolve(spark.createDataFrame(deps, DEPS), spark.createDataFrame(symbols, SYMBOLS))
    assert sorted(map(tuple, plain.collect())) == sorted({r[2:] for r in rows})
    # Files together, totals of names, calls by name, and the edges twice: it was over twenty.
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 5


def test_first_update_writes_its_rows_once(spark, tmp_path, monkeypatch):
    rng, root, files, written = random.Random(5), str(tmp_path / "index"), {}, []
    write = delta.materialise
    monkeypatch.setattr(delta, "materialise", lambda df: written.append(df.columns) or write(df))
    paths = [f"d/{i}.py" for i in range(12)]
    first = apply(spark, root, files, by_path(paths, *repository(rng, paths)))
    assert len(written) == 3, written  # paths, symbols and dependencies; the tables themselves are written from these
    check(spark, root, files)
    # The same again, over tables that are there: the general way gives the same, and replaces the partitions that it reads.
    assert apply(spark, root, files, dict(files)) == first | {"definitions": 0, "uses": 0}
    check(spark, root, files)


def test_repeated_symbols_are_one(spark, tmp_path):
    symbols = spark.createDataFrame([("x", 1, "a", 1, 1, False), ("x", 1, "a", 1, 1, False), ("y", 2, "b", 1, 1, False)], SYMBOLS)
    deps = spark.createDataFrame([("b", "x", "import", 3)], DEPS)
    delta.update(spark, str(tmp_path), spark.createDataFrame([("a",), ("b",)], "path string"), symbols, deps, 4)
    assert [tuple(e)[:5] for e in delta.table(spark, str(tmp_path), "edges").collect()] == [("b", "x", 2, 1, "import")]
