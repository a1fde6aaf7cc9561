import pytest
import pyspark.sql.functions as F

from tessera.sources import repository, walk


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    files = {"top.py": "x", "empty.txt": "", ".hidden": "h", "src/a.rs": "a", "src/deep/b.rs": "b", "src/deep/er/c.md": "é", "src/x.log": "l", "srcs/d.py": "d", "venv/e.py": "e"}
    files |= {".gitignore": "*.log\n/gen/\n", "src/deep/.gitignore": "er/\n!er/\nsecret*\n", "src/deep/secret.py": "s", "gen/g.py": "g", "docs/big.txt": "y" * 5000, "docs/m.md": "# m"}
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    (root / "none").mkdir()
    return str(root)


@pytest.mark.parametrize("levels", [0, 1, 2, 9])
def test_like_the_scan_by_the_driver(spark, root, levels):
    want, got = walk.scan(spark, root, "r"), repository.scan(spark, root, "r", levels=levels)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_options(spark, root):
    got = repository.scan(spark, root, "r", maxBytes=100, exclude="srcs,docs", contents="false")
    assert {r.path for r in got.collect()} == {"r/top.py", "r/empty.txt", "r/src/a.rs", "r/src/deep/b.rs", "r/src/deep/er/c.md"} and got.where("content is not null").isEmpty()


def reader(root, **filters):
    out = repository.RepositoryReader({"root": root, "alias": "r"})
    kinds = {"equal": repository.EqualTo, "prefix": repository.StringStartsWith}
    kept = [kinds[k](("path",), v) for k, v in filters.items()]
    assert list(out.pushFilters(kept)) == kept
    return out


def test_filters_narrow_the_listing(spark, root):
    every = walk.scan(spark, root, "r")
    for test in ("path = 'r/src/deep/b.rs'", "path = 'r/gen/g.py'", "path = 'q/top.py'", "path = 'r/top.py'", "path LIKE 'r/src/%'", "path LIKE 'r/src%'", "path LIKE 'r%' AND path LIKE 'r/d%'", "path = 'r'", "path LIKE 'r/nowhere/%'"):
        got = {r.path for r in repository.scan(spark, root, "r").where(test).collect()}
        assert got == {r.path for r in every.where(test).collect()}, test
    assert [p.path for p in reader(root, equal="r/src/deep/b.rs").partitions()] == ["src/deep"]
    assert [p.path for p in reader(root, prefix="r/src/").partitions()] == ["src", "src/deep", "src/deep/er"]
    assert [p.path for p in reader(root, prefix="r/do").partitions()] == ["", "docs"] and reader(root, prefix="q/").partitions() == []


def test_empty_folder(spark, root):
    assert repository.scan(spark, f"{root}/none", "r").agg(F.count("*")).first()[0] == 0


def test_contents_held_at_a_time_are_bounded_by_bytes(root, monkeypatch):
    monkeypatch.setattr(repository, "BATCH_BYTES", 5002)
    own = reader(root)
    sizes = [b.column("size").to_pylist() for p in own.partitions() for b in own.read(p)]
    assert all(sum(s) <= 5002 for s in sizes) and any(len(s) > 1 for s in sizes)
    assert [3, 5000] not in [sorted(s) for s in sizes] and [5000] in sizes
