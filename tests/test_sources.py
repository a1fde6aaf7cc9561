import io
import subprocess
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.operators.compress import collapse_blanks, compact, compress, compression_stats, skeleton
from tessera.plans import queries as plans
from tessera.sources import documents, walk
from tessera.sources.code import code_symbols
from tessera.sources.store import Store


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def names(symbols):
    return [s[0] for s in symbols]


def test_structured_documents():
    assert names(documents.json_keys('{"b": 1,\n "a": {"c": 2}}')) == ["a", "b"] and documents.json_keys("[1]") == documents.json_keys("{") == []
    assert documents.json_keys('{"b": 1,\n "a": 2}')[0][2] == 2
    assert names(documents.jsonl_keys('\n{"x": 1}\n{"y": 2}')) == ["x"]
    assert names(documents.xml_elements("<a><b/><c><b/></c></a>")) == ["a", "b", "c"]
    assert names(documents.xml_elements("<a><b></a>")) == ["a", "b"]
    assert names(documents.html_elements("<div><h1>x</h1><br/><script>var a='<p>'</script></div>")) == ["div", "h1"]


def test_headings():
    found = documents.markdown_symbols("# One\n\ntext below\n## Two\n### Three\n####### no\n#### Four\n" + "y" * 120)
    assert [(s[0], s[3]) for s in found] == [("One", 2), ("Two", 3), ("Three", 4), ("Four", 5)]
    assert [s[4] for s in found] == ["text below", None, None, "y" * 100 + "…"]


def test_archives():
    word = archive(**{"word__document.xml": "<w:d xmlns:w='w'><w:t>Hello</w:t><w:t> you</w:t></w:d>"})
    assert documents.document_symbols("docx", word) == [("Word Document", "module", 1, 1, "Hello you")]
    slides = archive(**{f"ppt__slides__slide{n}.xml": f"<p xmlns:a='a'><a:t>s{n}</a:t></p>" for n in (1, 2, 10)})
    assert [(s[0], s[4]) for s in documents.document_symbols("pptx", slides)] == [("Slide 1", "s1"), ("Slide 2", "s10"), ("Slide 3", "s2")]
    book = archive(**{"xl__workbook.xml": "<w><sheets><sheet name='Sales'/></sheets></w>", "xl__sharedStrings.xml": "<s><t>a</t><t>b</t></s>"})
    assert documents.document_symbols("xlsx", book) == [("Sheet: Sales", "module", 1, 1, "ab")]
    assert documents.document_symbols("docx", b"junk") == []
    out = io.BytesIO()
    pq.write_table(pa.table({"id": [1], "name": ["a"], "score": [1.0]}), out)
    assert names(documents.document_symbols("parquet", out.getvalue())) == ["Parquet Schema", "id", "name", "score"]
    pdf = b"%PDF /Type /Page stream\nBT (Hi \\(you\\)) Tj [(a) -20 (b)] TJ ET\nendstream"
    assert documents.pdf_text(pdf) == "Hi (you)ab\n" and names(documents.document_symbols("pdf", pdf)) == ["Page 1"]


@pytest.mark.parametrize(
    "language, text, expected",
    [
        ("rust", "pub fn a() {}\nstruct B;\nimpl B { fn c(&self) {} }", [("a", "function", True), ("B", "struct", False), ("B", "class", False), ("c", "function", False)]),
        ("typescript", "export class F { m() { g() } }\ninterface I {}\ntype X = 1", [("F", "class", True), ("m", "method", True), ("I", "interface", False), ("X", "type", False)]),
        ("csharp", "namespace N { public class C { public int M() { return 1; } private int P { get; } } }", [("N", "namespace", False), ("C", "class", True), ("M", "method", True), ("P", "property", False)]),
        ("python", "class A:\n    def m(self): pass\nasync def f(): pass", [("A", "class", False), ("m", "function", False), ("f", "function", False)]),
        ("go", "type T struct{}\nfunc (t T) M() {}\nfunc f() {}", [("T", "type", False), ("M", "method", False), ("f", "function", False)]),
        ("java", "public class A { public void r() { } }", [("A", "class", True), ("r", "method", True)]),
        ("c", "/* int no() {} */ int add(int a) { return a; }", [("add", "function", False)]),
        ("brainf", "x", []),
    ],
)
def test_code_symbols(language, text, expected):
    assert [(s[0], s[1], s[7]) for s in code_symbols(language, text)] == expected


def test_compression():
    text = "// gone\nfn f() {\n    let s = \"// kept\"; /* gone */\n\n\n\n    g(s)\n}\n"
    assert "gone" not in compact(text, "rust") and "// kept" in compact(text, "rust") and "\n\n\n" not in compact(text, "rust")
    assert skeleton(text, "rs").endswith("fn f() { ... }")
    assert skeleton("class A:\n    def m(self):\n        return 1\n", "python") == "class A: ..."
    assert skeleton("# h\ntext\n```\ncode\n```\n- item\n1. one\n---\n", "markdown") == "# h\n```\ncode\n```\n- item\n1. one\n---"
    assert compress(text, "rust", 99) == text and compress(None, "rust", 1) is None
    assert collapse_blanks("a\n\n\n\nb\n\n") == "a\n\nb"


def test_html_skeleton():
    page = "<!DOCTYPE html>\n<!-- gone --><html><p>a; #b {c}, <br>d<!-- kept --></p><script>'</html>'</script></html> <!-- gone -->tail; x\n"
    want = "<!DOCTYPE html>\n<html><p>a; #b {c}, <br>d<!-- kept --></p><script>'</html>'</script></html>\ntail; x"
    assert skeleton(page, "html") == want and skeleton("<!-- all -->", "html") == "" and skeleton("<div>open", "html") == "<div>open"


def test_compression_queries(spark, tmp_path):
    pages = ["<!DOCTYPE html><!-- c --><p>é</p>\n", "<p>a; b</p>\n\n\n\n<p>{c}</p>", "plain", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    size = lambda t: None if t is None else len(t.encode())
    got = {tuple(r) for r in plans.compress_skeleton(spark, str(tmp_path)).select("page_id", "original_bytes", "compressed_bytes").collect()}
    skeletons = ["<!DOCTYPE html>\n<p>é</p>", "<p>a; b</p>\n<p>{c}</p>", "plain", "", None]
    assert got == {(i, size(p), size(s)) for i, (p, s) in enumerate(zip(pages, skeletons))}
    compacts = ["<!DOCTYPE html><p>é</p>", "<p>a; b</p>\n\n<p>{c}</p>", "plain", "", None]
    rates = ["31%", "8%", "0%", "0%", "0%"]
    got = {tuple(r) for r in plans.compression_rate(spark, str(tmp_path)).select("path", "original_bytes", "compressed_bytes", "rate").collect()}
    assert got == {(i, size(p), size(c), r) for i, (p, c, r) in enumerate(zip(pages, compacts, rates))}


@pytest.fixture
def tree(tmp_path):
    files = {
        "src/main.py": "from lib import helper\ndef main():\n    helper(1)\n", "src/lib.py": "def helper(x):\n    return x\n", ".gitignore": "*.log\n/build/\n!keep.log\n",
        "a.log": "x", "keep.log": "x", "build/x.py": "x", "sub/build/y.py": "y = 1", "node_modules/z.js": "z", ".hidden/q.py": "q", "outside.md": "# T", "sub/.ignore": "secret.*", "sub/secret.md": "s",
    }
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    return tmp_path


def test_listing(tree):
    assert [p for p, _, _ in walk.list_files(str(tree))] == ["keep.log", "outside.md", "src/lib.py", "src/main.py", "sub/build/y.py"]
    assert walk.list_files(str(tree), max_bytes=0) == []


def test_guards(tree):
    assert walk.safe_relative("a\\b") == "a/b"
    for bad in ("../x", "/x", "C:/x", "a/../../b"):
        with pytest.raises(ValueError):
            walk.safe_relative(bad)
    assert walk.valid_ref("HEAD~1") and not walk.valid_ref("--output=x") and not walk.valid_ref("a b")
    assert walk.uncommitted(str(tree)) == set()
    run = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=n", "-c", "user.email=e@e", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "src")
    run("commit", "-qm", "x")
    (tree / "src/lib.py").write_text("def helper(x):\n    return 2\n")
    assert walk.uncommitted(str(tree)) == {"src/lib.py"}


def test_store_round_trip(spark, tree, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    store.add_repo("app", str(tree))
    scan = lambda: walk.scan(spark, str(tree), "app")
    assert {r.change for r in store.index(scan(), "app").collect()} == {"new"}
    names_of = {r.symbol_id: r.name for r in store.table("symbols").collect()}
    edges = {(names_of[r.from_id], names_of[r.to_id]) for r in store.table("edges").collect()}
    assert edges == {("main", "helper")}
    assert {r.change for r in store.index(scan(), "app").collect()} == {"unchanged"}
    (tree / "src/lib.py").write_text("\n\ndef helper(x):\n    return 3\n")
    (tree / "outside.md").unlink()
    changes = {r.path: r.change for r in store.index(scan(), "app").collect() if r.change != "unchanged"}
    assert changes == {"app/src/lib.py": "changed", "app/outside.md": "deleted"}
    names_of = {r.symbol_id: r.name for r in store.table("symbols").collect()}
    assert {(names_of[r.from_id], names_of[r.to_id]) for r in store.table("edges").collect()} == {("main", "helper")}
    store.remove_files(["app/src/lib.py"])
    assert store.table("edges").count() == 0 and store.table("repos").count() == 1
    store.remove_repo("app")
    assert store.table("files").count() == store.table("repos").count() == 0


def test_compression_sends_no_batches_of_so_many_rows_to_python(spark):
    texts = spark.range(3).selectExpr("cast(id as string) as path", "'fn a() { 1 }' as text", "'rust' as language")
    plan = compression_stats(texts, 2)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
