"""Named queries of the source, store, compression and request operators, run on files made of the driver tables."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tessera.functions import text as tx
from tessera.operators import catalog, compress, dependencies, history
from tessera.plans import adapters
from tessera.plans.registry import query
from tessera.scratch import materialise, shared_dir
from tessera.session import spread, table
from tessera.sources import store, walk
from tessera.streaming import changes

# ---- files of code: {n} is a part's name and {b} its brand, as identifiers -------------------------------------------

_IDENT = {"n": ("p_name", "regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g')"), "b": ("p_brand", "regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')")}


def _column(template: str):
    """A text with {n} and {b} as a column over part."""
    out = F.lit(template)
    for key, (column, _) in _IDENT.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.regexp_replace(column, "[^A-Za-z0-9]", "_"))
    return out


def _sql(template: str | None) -> str:
    """The same as an SQL expression."""
    if template is None:
        return "CAST(NULL AS VARCHAR)"
    out = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for key, (_, sql) in _IDENT.items():
        out = f"replace({out}, '{{{key}}}', {sql})"
    return out


def _files(spark, sf, language: str, template: str) -> DataFrame:
    part = spread(table(spark, sf, "part", "p_partkey", "p_name", "p_brand"))
    text = _column(template)
    return part.select(F.col("p_partkey").cast("string").alias("path"), F.lit(language).alias("language"), text.alias("text"), text.cast("binary").alias("content"))


#: language: (text, its symbols as (name, kind, line, col, scope, exported, signature)).
_SYMBOLS = {
    "python": (
        "class {b}:\n    def {n}(self):\n        pass\n\nasync def {n}_x():\n    def inner():\n        pass\n",
        [("{b}", "class", 1, 1, None, False, "class {b}:"), ("{n}", "function", 2, 5, "{b}", False, "def {n}(self):"),
         ("{n}_x", "function", 5, 1, None, False, "async def {n}_x():"), ("inner", "function", 6, 5, "{n}_x", False, "def inner():")],
    ),
    "rust": (
        "// fn no() {}\npub struct {b} { x: i32 }\nimpl {b} {\n    pub fn {n}(&self) -> i32 { 1 }\n    fn hidden() {}\n}\nenum E { A }\npub trait T {}\n",
        [("{b}", "struct", 2, 1, None, True, "pub struct {b} { x: i32 }"), ("{b}", "class", 3, 1, None, False, "impl {b} {"),
         ("{n}", "function", 4, 5, "{b}", True, "pub fn {n}(&self) -> i32 { 1 }"), ("hidden", "function", 5, 5, "{b}", False, "fn hidden() {}"),
         ("E", "enum", 7, 1, None, False, "enum E { A }"), ("T", "interface", 8, 1, None, True, "pub trait T {}")],
    ),
    "typescript": (
        "export class {b} {\n  {n}(a) { return 1 }\n}\ninterface I { x: string }\nexport type T = string;\nfunction f() {}\n",
        [("{b}", "class", 1, 1, None, True, "export class {b} {"), ("{n}", "method", 2, 3, "{b}", True, "{n}(a) { return 1 }"),
         ("I", "interface", 4, 1, None, False, "interface I { x: string }"), ("T", "type", 5, 1, None, True, "export type T = string;"),
         ("f", "function", 6, 1, None, False, "function f() {}")],
    ),
    "csharp": (
        "namespace N {\n  public class {b} {\n    public int {n}(int a) { return 1; }\n    private void H() { }\n  }\n}\n",
        [("N", "namespace", 1, 1, None, False, "namespace N {"), ("{b}", "class", 2, 3, "N", True, "public class {b} {"),
         ("{n}", "method", 3, 5, "{b}", True, "public int {n}(int a) { return 1; }"), ("H", "method", 4, 5, "{b}", False, "private void H() { }")],
    ),
    "java": (
        "public class {b} {\n  public int {n}(int a) { return 1; }\n  enum E { A }\n}\n",
        [("{b}", "class", 1, 1, None, True, "public class {b} {"), ("{n}", "method", 2, 3, "{b}", True, "public int {n}(int a) { return 1; }"),
         ("E", "enum", 3, 3, "{b}", False, "enum E { A }")],
    ),
    "go": (
        "package p\n\nfunc {n}(a int) int { return 1 }\n\nfunc (t *T) M() { }\n\ntype T struct { x int }\n",
        [("{n}", "function", 3, 1, None, False, "func {n}(a int) int { return 1 }"), ("M", "method", 5, 1, None, False, "func (t *T) M() { }"),
         ("T", "type", 7, 1, None, False, "type T struct { x int }")],
    ),
    "cpp": (
        "class {b} {\n  int x;\n};\nint {n}(int a) { return 1; }\nstruct S { int y; };\n",
        [("{b}", "class", 1, 1, None, False, "class {b} {"), ("{n}", "function", 4, 1, None, False, "int {n}(int a) { return 1; }"), ("S", "struct", 5, 1, None, False, "struct S { int y; }")],
    ),
    "json": (
        '{"z": 1,\n "{n}_k": {"deep": 2},\n "{b}": [3]}',
        [("z", "property", 1, 1, None, True, None), ("{n}_k", "property", 2, 1, None, True, None), ("{b}", "property", 3, 1, None, True, None)],
    ),
    "jsonl": ('\n{"{n}": 1, "k": 2}\n{"other": 3}\n', [("{n}", "property", 1, 1, None, True, None), ("k", "property", 1, 1, None, True, None)]),
    "xml": (
        "<root>\n <{b} a='1'/>\n <{n}><{b}/></{n}>\n</root>",
        [("root", "module", 1, 1, None, True, None), ("{b}", "module", 2, 1, None, True, None), ("{n}", "module", 3, 1, None, True, None)],
    ),
    "html": (
        "<div id=\"{n}\">\n  <h1>{b}</h1><br/>\n  <script>var x = '<p>';</script>\n  <p>x</p></div>",
        [("div", "module", 1, 1, None, True, '<div id="{n}">'), ("h1", "module", 2, 3, None, True, "<h1>"), ("p", "module", 4, 3, None, True, "<p>")],
    ),
    "markdown": (
        "# {n}\n\nwords of {b}\n## {b}\n### next\nmore\n####### none\n",
        [("{n}", "module", 1, 2, None, True, "words of {b}"), ("{b}", "module", 4, 3, None, True, None), ("next", "module", 5, 4, None, True, "more")],
    ),
}


def _symbols_query(language: str) -> None:
    text, rows = _SYMBOLS[language]
    parts = [
        f"SELECT CAST(p_partkey AS VARCHAR) AS path, {_sql(name)} AS name, '{kind}' AS kind, {line} AS line, {col} AS col, {_sql(scope)} AS scope, {public} AS is_exported, {_sql(head)} AS signature FROM part"
        for name, kind, line, col, scope, public, head in rows
    ]

    @query(f"symbols_{language}", " UNION ALL ".join(parts))
    def run(spark, sf):
        return store.extract_symbols(_files(spark, sf, language, text)).drop("symbol_id")


for _language in _SYMBOLS:
    _symbols_query(_language)


# ---- dependencies of code ------------------------------------------------------------------------------------------

_LINES = "l AS (SELECT path, unnest(string_split(text, chr(10))) AS src, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INT) AS line FROM f)"
_COMMON = "'if', 'for', 'while', 'switch', 'return', 'catch'"


def _calls(starts: str, banned: str) -> str:
    begins = " OR ".join(f"starts_with(ltrim(src), '{s} ')" for s in starts.split("|"))
    return rf"""SELECT * FROM (SELECT path, unnest(regexp_extract_all(src, '([A-Za-z_]\w*)\s*\(', 1)) AS to_name, 'function_call' AS kind, line FROM l WHERE NOT ({begins}))
        WHERE to_name NOT IN ({_COMMON}, {banned})"""


_RUST = "use crate::x::{n}\n    pub async fn {n}(a: i32) {\nlet y = {b}::{n}(match (z));\n if ({n} (1)) { loop(2) }"
_SCRIPT = "import { a, {n} } from 'x'\nimport * as ns from \"y\"\nconst r = require('z')\nexport function {n}(a) {\n  obj.{n}(new {b}({n}(1)));\n  return typeof (q)"
_PYTHON = "from a.b import {n} as m, (c), *\nimport os(1)\n  def {n}(x):\n    {n}(len(x)); print(y)\nclass {b}(object):\n  {b} (1)"


def _dependencies(name: str, language: str, text: str, rows: str) -> None:
    @query(name, f"WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS path, {_sql(text)} AS text FROM part), {_LINES} {rows}")
    def run(spark, sf):
        return dependencies.extract_dependencies(_files(spark, sf, language, text))


_dependencies(
    "dep_rust", "rust", _RUST,
    rf"""SELECT path, split_part(regexp_extract(src, '^\s*use\s+([\w:]+)', 1), '::', -1) AS to_name, 'import' AS kind, line FROM l WHERE regexp_matches(src, '^\s*use\s+[\w:]+')
        UNION ALL SELECT path, unnest(regexp_extract_all(src, '\w+::(\w+)\s*\(', 1)), 'function_call', line FROM l
        UNION ALL {_calls('fn|pub fn|pub(crate) fn|async fn|pub async fn', "'match', 'fn', 'let', 'loop', 'impl', 'mut'")}""",
)
_dependencies(
    "dep_script", "typescript", _SCRIPT,
    rf"""SELECT path, trim(unnest(string_split(regexp_extract(src, 'import\s+\{{\s*([^}}]+)\s*\}}\s+from', 1), ','))) AS to_name, 'import' AS kind, line FROM l WHERE regexp_matches(src, 'import\s+\{{')
        UNION ALL SELECT path, regexp_extract(src, 'import\s+\*\s+as\s+(\w+)\s+from', 1), 'import', line FROM l WHERE regexp_matches(src, 'import\s+\*')
        UNION ALL SELECT path, regexp_extract(src, 'const\s+(\w+)\s*=\s*require', 1), 'import', line FROM l WHERE regexp_matches(src, 'require')
        UNION ALL SELECT path, unnest(regexp_extract_all(src, '\w+\.(\w+)\s*\(', 1)), 'function_call', line FROM l
        UNION ALL SELECT path, regexp_extract(src, 'new\s+([A-Za-z_]\w*)\s*\(', 1), 'type_reference', line FROM l WHERE regexp_matches(src, 'new\s+')
        UNION ALL {_calls('function|export function|async function|export async function', "'function', 'await', 'typeof', 'super', 'do', 'else', 'new'")}""",
)
_dependencies(
    "dep_python", "python", _PYTHON,
    rf"""SELECT * FROM (SELECT path, trim(regexp_replace(regexp_replace(trim(unnest(string_split(regexp_extract(src, '^\s*from\s+[\w.]+\s+import\s+(.+)$', 1), ','))), ' as .*$', ''), '^[()]+|[()]+$', '', 'g')) AS to_name,
            'import' AS kind, line FROM l WHERE regexp_matches(src, '^\s*from\s')) WHERE to_name NOT IN ('', '*')
        UNION ALL SELECT * FROM ({_calls('def|async def|class|import|from', "'elif', 'with', 'assert', 'del', 'raise', 'except', 'lambda', 'yield', 'print'")})""",
)

_STARTS = ["pub fn ", "  fn ", "let ", "async fn ", "xfn "]


@query("definition_lines", "SELECT p_partkey, p_partkey % 5 IN (0, 1, 3) AS found FROM part")
def definition_lines(spark, sf):
    part = table(spark, sf, "part", "p_partkey", "p_name")
    line = F.concat(F.get(F.array(*map(F.lit, _STARTS)), (F.col("p_partkey") % 5).cast("int")), "p_name", F.lit("()"))
    return part.select("p_partkey", dependencies.is_definition(line, "rust").alias("found"))


# ---- binary documents ----------------------------------------------------------------------------------------------


def _zip(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def _office(spark, sf) -> DataFrame:
    """One file of each format for every type of part, whose text is the type."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = []
    for (kind,) in table(spark, sf, "part", "p_type").distinct().collect():
        slide = "<p><t>{}</t></p>"
        rows.append((kind, "docx", _zip(word__document_xml=f"<w><t>{kind}</t><t> doc</t></w>")))
        rows.append((kind, "pptx", _zip(ppt__slides__slide2_xml=slide.format("two"), ppt__slides__slide1_xml=slide.format(kind))))
        rows.append((kind, "xlsx", _zip(xl__workbook_xml=f'<b><sheets><sheet name="Sales"/><sheet name="{kind}"/></sheets></b>', xl__sharedStrings_xml=f"<s><t>{kind}</t></s>")))
        rows.append((kind, "pdf", b"%PDF-1.4 /Type /Page stream\nBT (" + kind.encode() + b") Tj ET\nendstream /Type /Page"))
        out = io.BytesIO()
        pq.write_table(pa.table({kind: pa.array([1], pa.int64()), "name": pa.array(["x"])}), out)
        rows.append((kind, "parquet", out.getvalue()))
    return spark.createDataFrame([(f"{k}.{la}", la, bytearray(c)) for k, la, c in rows], "path string, language string, content binary")


@query(
    "symbols_office",
    """WITH t AS (SELECT DISTINCT p_type AS k FROM part)
       SELECT k || '.docx' AS path, 'Word Document' AS name, 'module' AS kind, 1 AS line, k || ' doc' AS signature FROM t
       UNION ALL SELECT k || '.pptx', 'Slide 1', 'module', 1, k FROM t UNION ALL SELECT k || '.pptx', 'Slide 2', 'module', 2, 'two' FROM t
       UNION ALL SELECT k || '.xlsx', 'Sheet: Sales', 'module', 1, k FROM t UNION ALL SELECT k || '.xlsx', 'Sheet: ' || k, 'module', 2, k FROM t
       UNION ALL SELECT k || '.pdf', 'Page 1', 'module', 1, k || chr(10) FROM t UNION ALL SELECT k || '.pdf', 'Page 2', 'module', 2, NULL FROM t
       UNION ALL SELECT k || '.parquet', 'Parquet Schema', 'module', 1, k || ': int64, name: string' FROM t
       UNION ALL SELECT k || '.parquet', k, 'property', 2, 'int64' FROM t UNION ALL SELECT k || '.parquet', 'name', 'property', 3, 'string' FROM t""",
)
def symbols_office(spark, sf):
    return store.extract_symbols(_office(spark, sf)).select("path", "name", "kind", "line", "signature")


@query(
    "office_texts",
    """WITH t AS (SELECT DISTINCT p_type AS k FROM part)
       SELECT k || '.docx' AS path, k || ' doc' AS text FROM t UNION ALL SELECT k || '.pptx', k || chr(10) || 'two' FROM t UNION ALL SELECT k || '.xlsx', k FROM t
       UNION ALL SELECT k || '.pdf', k || chr(10) FROM t UNION ALL SELECT k || '.parquet', NULL FROM t""",
)
def office_texts(spark, sf):
    return store.with_text(_office(spark, sf)).select("path", "text")


# ---- compression ---------------------------------------------------------------------------------------------------

#: language: (text, compact, skeleton).
_COMPRESSED = {
    "rust": (
        "// note\nuse a::b;\n\n\n\npub fn {n}(a: i32) -> i32 {\n    let s = \"// kept\"; /* gone */\n    a\n}\nstruct {b} { x: i32 }\n",
        "\nuse a::b;\n\npub fn {n}(a: i32) -> i32 {\n    let s = \"// kept\"; \n    a\n}\nstruct {b} { x: i32 }",
        "use a::b;\npub fn {n}(a: i32) -> i32 { ... }\nstruct {b} { ... }",
    ),
    "python": (
        "import os  # note\n\n\n\ndef {n}(a):\n    # inside\n    return '# kept'\n\nclass {b}:\n    x = 1\n",
        "import os  \n\ndef {n}(a):\n\n    return '# kept'\n\nclass {b}:\n    x = 1",
        "import os  # note\ndef {n}(a): ...\nclass {b}: ...",
    ),
    "markdown": ("# {n}\n\ntext\n- item\n```\ncode {b}\n```\n1. one\n", "# {n}\n\ntext\n- item\n```\ncode {b}\n```\n1. one", "# {n}\n- item\n```\ncode {b}\n```\n1. one"),
    "unknown": ("first {n}\n\n\nsecond", "first {n}\n\nsecond", "first {n}"),
}


def _compress_query(language: str) -> None:
    text, *levels = _COMPRESSED[language]
    sizes = [f"CAST(strlen({_sql(t)}) AS INT)" for t in (text, *levels)]

    @query(f"compress_{language}", f"SELECT CAST(p_partkey AS VARCHAR) AS path, {_sql(levels[0])} AS compact, {_sql(levels[1])} AS skeleton, {_sql(text)} AS whole, {sizes[0]} AS original_bytes, {sizes[2]} AS compressed_bytes FROM part")
    def run(spark, sf):
        files = _files(spark, sf, language, text).drop("content")
        column = [compress.compressed(F.col("text"), F.col("language"), F.lit(level)).alias(n) for n, level in (("compact", 1), ("skeleton", 2), ("whole", 99))]
        return files.select("path", *column).join(compress.compression_stats(files, 2).drop("rate"), "path")


for _language in _COMPRESSED:
    _compress_query(_language)


# ---- the store -----------------------------------------------------------------------------------------------------


def _scanned(spark, sf, second: bool) -> DataFrame:
    """A repository of one Python file for each name, that calls shared(); in the second scan some are changed or gone."""
    part = table(spark, sf, "part", "p_name").distinct()
    n, size = F.regexp_replace("p_name", "[^A-Za-z0-9]", "_"), F.length("p_name")
    body = F.when(F.lit(second) & (size % 2 == 0), "pass").otherwise("shared(1)")
    files = part.where(~(F.lit(second) & (size % 5 == 0))).select(F.concat(F.lit("left/"), n, F.lit(".py")).alias("path"), F.concat(F.lit("def "), n, F.lit("():\n    "), body, F.lit("\n")).alias("text"))
    other = spark.createDataFrame([("left/zz.py", "def shared(x):\n    return x\n")], "path string, text string")
    rows = files.unionByName(other).withColumns({"language": tx.language_of(F.col("path")), "content": F.col("text").cast("binary"), "hash": F.sha2(F.col("text").cast("binary"), 256)})
    return rows.drop("text")


def _store(spark, sf) -> tuple[store.Store, DataFrame]:
    own = store.Store(spark, f"{shared_dir(spark)}/tessera-store-{uuid.uuid4().hex}")
    own.add_repo("left", "/left")
    own.index(materialise(_scanned(spark, sf, False)), "left")
    return own, own.index(materialise(_scanned(spark, sf, True)), "left")


_NAMES = "n AS (SELECT DISTINCT regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') AS n, length(p_name) AS size FROM part)"


@query(
    "store_changes",
    f"""WITH {_NAMES} SELECT 'left/' || n || '.py' AS path, CASE WHEN size % 5 = 0 THEN 'deleted' WHEN size % 2 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM n
        UNION ALL SELECT 'left/zz.py', 'unchanged'""",
)
def store_changes(spark, sf):
    return _store(spark, sf)[1]


@query(
    "store_files",
    f"""WITH {_NAMES} SELECT 'left/' || n || '.py' AS path, 'left' AS repo, 'python' AS language, CAST(strlen(n) + CASE WHEN size % 2 = 0 THEN 17 ELSE 22 END AS BIGINT) AS char_count FROM n WHERE size % 5 <> 0
        UNION ALL SELECT 'left/zz.py', 'left', 'python', 28""",
)
def store_files(spark, sf):
    return _store(spark, sf)[0].table("files").select("path", "repo", "language", "char_count")


@query("store_edges", f"WITH {_NAMES} SELECT n AS from_name, 'shared' AS to_name, 'function_call' AS kind FROM n WHERE size % 5 <> 0 AND size % 2 <> 0")
def store_edges(spark, sf):
    own = _store(spark, sf)[0]
    symbols = own.table("symbols").select("symbol_id", "name")
    ends = [symbols.withColumnsRenamed({"symbol_id": f"{e}_id", "name": f"{e}_name"}) for e in ("from", "to")]
    return own.table("edges").join(ends[0], "from_id").join(ends[1], "to_id").select("from_name", "to_name", "kind")


@query("store_one_file", f"WITH {_NAMES} SELECT count(*) FILTER (size % 5 <> 0) + 1 AS symbols, CAST(0 AS BIGINT) AS edges, false AS over FROM n")
def store_one_file(spark, sf):
    """The called file is indexed anew under another name, so no call finds its target; all else stays."""
    own = _store(spark, sf)[0]
    text = F.lit("def renamed(x):\n    return x\n").cast("binary")
    own.index_file(own.table("files").where("path = 'left/zz.py'").select("path", "language", text.alias("content"), F.sha2(text, 256).alias("hash")))
    counts = own.table("symbols").agg(F.count(F.lit(1)).alias("symbols")).crossJoin(own.table("edges").agg(F.count(F.lit(1)).alias("edges")))
    return counts.withColumn("over", F.lit(own.over_limit()))


@query("store_removed", "SELECT CAST(0 AS BIGINT) AS files, CAST(0 AS BIGINT) AS symbols, CAST(0 AS BIGINT) AS edges, CAST(0 AS BIGINT) AS repos")
def store_removed(spark, sf):
    own = _store(spark, sf)[0]
    own.remove_files(["left/zz.py"])
    own.remove_repo("left")
    counts = [own.table(t).agg(F.count(F.lit(1)).alias(t)) for t in ("files", "symbols", "edges", "repos")]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(counts[3])


@query(
    "search_log",
    """WITH e AS (SELECT user_id, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS sent FROM events GROUP BY ALL), k AS (SELECT * FROM e ORDER BY user_id DESC LIMIT 50)
       SELECT user_id AS id, 'task ' || user_id AS task, array_to_string(list_transform(range(1, CAST(least(8, n) AS INT) + 1), lambda i: 'f' || lpad(CAST(i AS VARCHAR), 5, '0')), ' ') AS pivots, sent AS tokens_sent FROM k""",
)
def search_log(spark, sf):
    """Searches appended to the store's log: the newest are read back with their eight best files."""
    own = store.Store(spark, f"{shared_dir(spark)}/tessera-store-{uuid.uuid4().hex}")
    events = table(spark, sf, "events", "user_id", "value")
    calls = events.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).cast("long").alias("tokens_sent"))
    pivot = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct((-i.cast("double")).alias("score"), F.concat(F.lit("f"), F.lpad(i.cast("string"), 5, "0")).alias("path")))
    rows = calls.select("id", F.concat(F.lit("task "), F.col("id").cast("string")).alias("task"), history.top_pivots(pivot).alias("pivots"), "tokens_sent", F.lit(0).cast("long").alias("tokens_saved"))
    for half in (rows.where("id % 2 = 0"), rows.where("id % 2 = 1")):
        own.append("searches", half)
    return history.newest(own.log("searches"), 50).select("id", "task", F.array_join("pivots", " ").alias("pivots"), "tokens_sent")


@query("recorded_calls", "SELECT p_brand AS session, list_sort(list_distinct(list(p_name))) AS symbols, list_sort(list_distinct(list(p_type))) AS files FROM part GROUP BY ALL")
def recorded_calls(spark, sf):
    part = table(spark, sf, "part", "p_brand", "p_name", "p_type")
    return history.recorded(part.select(F.col("p_brand").alias("session"), F.col("p_name").alias("symbol"), F.col("p_type").alias("path")))


# ---- functions and listings ----------------------------------------------------------------------------------------


def _names(spark, sf) -> DataFrame:
    return table(spark, sf, "part", "p_name").distinct()


_STOP = ", ".join(f"'{w}'" for w in sorted(tx.STOPWORDS))


@query("task_words", rf"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all('the ' || p_name || ' is_to be_fixed Need', '\w+')) AS word FROM (SELECT DISTINCT p_name FROM part))
    WHERE strlen(word) >= 3 AND lower(word) NOT IN ({_STOP}) GROUP BY ALL""")  # fmt: skip
def task_words(spark, sf):
    task = F.concat(F.lit("the "), "p_name", F.lit(" is_to be_fixed Need"))
    words = _names(spark, sf).select(F.explode(tx.meaningful_words(tx.task_words(task))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("noise_words", r"SELECT DISTINCT lower(word) AS word FROM (SELECT unnest(regexp_extract_all(p_name || ' Lib my extra', '[A-Za-z0-9]{3,}')) AS word FROM part)")
def noise_words(spark, sf):
    words = _names(spark, sf).select(F.explode(tx.noise_words(F.concat("p_name", F.lit("Lib_my")))).alias("word"))
    configured = spark.createDataFrame([(w,) for w in tx.noise_keywords([], ["Extra"])], "word string")
    return words.unionByName(configured).distinct()


@query("capped_lists", """WITH g AS (SELECT p_brand, list_sort(list(DISTINCT p_size)) AS s FROM part GROUP BY ALL)
    SELECT p_brand, array_to_string(s[1:5], ', ') || CASE WHEN len(s) > 5 THEN ' … (+' || (len(s) - 5) || ' more)' ELSE '' END AS shown FROM g""")  # fmt: skip
def capped_lists(spark, sf):
    groups = table(spark, sf, "part", "p_brand", "p_size").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_size")).alias("s"))
    return groups.select("p_brand", tx.capped_list(F.col("s").cast("array<string>")).alias("shown"))


@query("path_parts", r"""SELECT p_partkey, p_brand || '/a/' || p_size || '.x' AS path, p_brand AS alias, 'a/' || p_size || '.x' AS relative FROM part""")
def path_parts(spark, sf):
    part = table(spark, sf, "part", "p_partkey", "p_brand", "p_size")
    path = tx.qualified(F.col("p_brand"), F.concat(F.lit("a\\"), F.col("p_size").cast("string"), F.lit(".x")))
    return part.select("p_partkey", path.alias("path"), tx.alias_of(path).alias("alias"), tx.relative_of(path).alias("relative"))


@query("repo_aliases", """SELECT root, CASE WHEN copy = 1 THEN name ELSE name || '-' || copy END AS alias
    FROM (SELECT '/w' || copy || '/' || p_type AS root, p_type AS name, copy FROM (SELECT DISTINCT p_type FROM part), (SELECT unnest([1, 2, 3]) AS copy))""")  # fmt: skip
def repo_aliases(spark, sf):
    names = sorted(r.p_type for r in table(spark, sf, "part", "p_type").distinct().collect())
    return spark.createDataFrame(list(tx.derive_aliases([f"/w{c}/{n}" for c in (1, 2, 3) for n in names]).items()), "root string, alias string")


@query("cut_texts", """SELECT doc_id, CASE WHEN strlen(text) <= 400 THEN text ELSE (SELECT max_by(substr(text, 1, k), k) FROM (SELECT unnest(range(100, 401)) AS k) WHERE strlen(substr(text, 1, k)) <= 400) || chr(10) || '… (truncated)' END AS shown
    FROM documents""")  # fmt: skip
def cut_texts(spark, sf):
    return spread(table(spark, sf, "documents", "doc_id", "text")).select("doc_id", tx.truncated(F.col("text"), 100).alias("shown"))


@query("request_cost", "SELECT p_partkey, printf('$%.2f', CAST(p_size * 1000000 AS BIGINT) * (15.0::DOUBLE / 1000000)) AS cost FROM part")
def request_cost(spark, sf):
    return table(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", tx.dollars((F.col("p_size") * 1_000_000).cast("long"), "opus").alias("cost"))


@query("safe_paths", "SELECT p_partkey, p_partkey % 4 = 0 AS safe FROM part")
def safe_paths(spark, sf):
    shapes = F.array(*map(F.lit, ("a/", "../", "/etc/", "C:\\")))
    path = F.concat(F.get(shapes, (F.col("p_partkey") % 4).cast("int")), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part", "p_partkey").select("p_partkey", walk.safe_path(path).isNotNull().alias("safe"))


@query("files_listing", "SELECT p_brand || '/' || p_size AS path, CASE p_size % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'json' ELSE 'rust' END AS language, count(*) AS n_symbols FROM part GROUP BY ALL")
def files_listing(spark, sf):
    return catalog.list_files(adapters.part_files(spark, sf), adapters.part_symbols(spark, sf))


@query("file_symbols", "SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS INT) AS position, p_partkey AS symbol_id FROM part WHERE p_brand || '/' || p_size = (SELECT min(p_brand || '/' || p_size) FROM part)")
def file_symbols(spark, sf):
    symbols = adapters.part_symbols(spark, sf)
    path = symbols.agg(F.min("path")).first()[0]
    rows = catalog.file_symbols(symbols, path).select("symbol_id").collect()  # one file's symbols, in the order that is checked
    return spark.createDataFrame([(i, r.symbol_id) for i, r in enumerate(rows, 1)], "position int, symbol_id long")


# ---- a folder, and streams -----------------------------------------------------------------------------------------


@query(
    "ignore_rules",
    """SELECT 'd' || (p_partkey % 7) || '/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.log' ELSE '.rs' END AS path FROM part
       WHERE p_partkey % 7 <> 4 AND (p_partkey % 3 <> 0 OR p_partkey % 10 = 7)""",
)
def ignore_rules(spark, sf):
    """Paths of a listing that ignore files leave: a folder, a pattern, and an exception to it."""
    rules = walk.parse_rules("# logs\n*.log\n!*7.log\n/d4/\n")
    part = table(spark, sf, "part", "p_partkey")
    key = F.col("p_partkey")
    path = F.concat(F.lit("d"), (key % 7).cast("string"), F.lit("/"), key.cast("string"), F.when(key % 3 == 0, ".log").otherwise(".rs"))

    def run(batches):
        for batch in batches:
            import pyarrow as pa

            keep = [not (walk.ignored(p.split("/")[0], True, rules) or walk.ignored(p, False, rules)) for p in batch.column("path").to_pylist()]
            yield batch.filter(pa.array(keep))

    return part.select(path.alias("path")).mapInArrow(run, "path string")


def _stream(spark, sf, df: DataFrame) -> DataFrame:
    written = materialise(df)
    return spark.readStream.schema(written.schema).parquet(written.inputFiles()[0].rsplit("/", 1)[0])


def _finished(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there, and return what it put out."""
    spark, folder = df.sparkSession, f"{shared_dir(df.sparkSession)}/tessera-stream-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@query("stream_deletes", "SELECT 'repo/' || user_id || '.rs' AS path, epoch_us(ts) AS ts FROM events WHERE event_type = 'error'")
def stream_deletes(spark, sf):
    events = adapters.tool_calls(spark, sf).select("path", "ts", F.when(F.col("tool") == "error", "delete").otherwise("change").alias("op"))
    return _finished(changes.deletions(changes.watched(_stream(spark, sf, events))), "append").select("path", F.unix_micros("ts").alias("ts"))


@query(
    "stream_last_operation",
    "SELECT path, op FROM (SELECT 'repo/' || user_id || '.rs' AS path, arg_max(CASE WHEN event_type = 'error' THEN 'delete' ELSE 'change' END, (ts, event_id)) AS op FROM events GROUP BY ALL)",
)
def stream_last_operation(spark, sf):
    """What a maintained stream hands over: every path once, to be indexed or removed by its last operation."""
    folder = f"{shared_dir(spark)}/tessera-stream-{uuid.uuid4().hex}"
    e = adapters.tool_calls(spark, sf)
    rows = e.select("path", F.struct("ts", "id").alias("ts"), F.when(F.col("tool") == "error", "delete").otherwise("change").alias("op"))

    def put(op: str):
        return lambda paths: paths.select("path", F.lit(op).alias("op")).write.mode("append").parquet(f"{folder}/out")

    changes.maintain(_stream(spark, sf, rows), put("change"), put("delete"), f"{folder}/state").awaitTermination()
    return spark.read.schema("path string, op string").parquet(f"{folder}/out")
