"""Raw dependencies of source lines, by regular expressions over exploded lines."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

# Line starts that declare a symbol, and words before "(" that are no calls.
DEFINITIONS = {
    "rust": ("fn ", "pub fn ", "pub(crate) fn ", "async fn ", "pub async fn "),
    "typescript": ("function ", "export function ", "async function ", "export async function "),
    "javascript": ("function ", "export function ", "async function ", "export async function "),
    "python": ("def ", "async def ", "class "),
    "go": ("func ",),
}
COMMON_KEYWORDS = ("if", "for", "while", "switch", "return", "catch")
KEYWORDS = {
    "rust": ("match", "fn", "let", "loop", "impl", "mut"),
    "typescript": ("function", "await", "typeof", "super", "do", "else"),
    "javascript": ("function", "await", "typeof", "super", "do", "else"),
    "python": ("elif", "with", "assert", "del", "raise", "except", "lambda", "yield", "print"),
    "go": ("func", "go", "defer", "select", "range"),
}
# What is found on a line.
CALL = r"([A-Za-z_]\w*)\s*\("
PATH_CALL = r"\w+::(\w+)\s*\("
MEMBER_CALL = r"\w+\.(\w+)\s*\("
NEW = r"new\s+([A-Za-z_]\w*)\s*\("
USE = r"^\s*use\s+([\w:]+)"
IMPORT_NAMES = r"""import\s+\{\s*([^}]+)\s*\}\s+from\s+['"][^'"]+['"]"""
IMPORT_ALL = r"""import\s+\*\s+as\s+(\w+)\s+from\s+['"][^'"]+['"]"""
REQUIRE = r"""(?:const|var|let)\s+(\w+)\s*=\s*require\(['"].*?['"]\)"""
FROM_IMPORT = r"^\s*from\s+[\w.]+\s+import\s+(.+)$"
LANGUAGES = tuple(DEFINITIONS)


def _all(line: Column, pattern: str) -> Column:
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(1))


def _one(line: Column, pattern: str) -> Column:
    return F.when(line.rlike(pattern), F.array(F.regexp_extract(line, pattern, 1))).otherwise(F.array().cast("array<string>"))


def _tagged(names: Column, kind: str) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("to_name"), F.lit(kind).alias("kind")))


def is_definition(line: Column, language: str) -> Column:
    trimmed, test = F.ltrim(line), F.lit(False)
    for start in DEFINITIONS.get(language, ()):
        test = test | trimmed.startswith(start)
    return test


def _calls(line: Column, language: str) -> Column:
    banned = F.array(*map(F.lit, (*COMMON_KEYWORDS, *KEYWORDS[language], *(("new",) if "script" in language else ()))))
    found = F.filter(_all(line, CALL), lambda n: ~F.array_contains(banned, n))
    return F.when(is_definition(line, language), F.array().cast("array<string>")).otherwise(found)


def line_dependencies(line: Column, language: Column) -> Column:
    """array<struct<to_name, kind>> of one line; kinds are import, function_call and type_reference."""
    none = F.array().cast("array<struct<to_name: string, kind: string>>")
    call = "function_call"
    last = F.transform(_one(line, USE), lambda m: F.element_at(F.split(m, "::"), -1))
    rust = F.concat(_tagged(last, "import"), _tagged(_all(line, PATH_CALL), call), _tagged(_calls(line, "rust"), call))
    names = F.flatten(F.transform(_one(line, IMPORT_NAMES), lambda m: F.transform(F.split(m, ","), lambda n: F.trim(n))))
    script = F.concat(
        _tagged(names, "import"),
        _tagged(_one(line, IMPORT_ALL), "import"),
        _tagged(_one(line, REQUIRE), "import"),
        _tagged(_all(line, MEMBER_CALL), call),
        _tagged(_all(line, NEW), "type_reference"),
        _tagged(_calls(line, "typescript"), call),
    )
    listed = F.flatten(
        F.transform(_one(line, FROM_IMPORT), lambda m: F.transform(F.split(m, ","), lambda n: F.trim(F.regexp_replace(F.trim(F.regexp_extract(n, r"^(.*?)(?: as .*)?$", 1)), r"^[()]+|[()]+$", ""))))
    )
    listed = F.filter(listed, lambda n: (n != "") & (n != "*"))
    python = (
        F.when(line.rlike(FROM_IMPORT), _tagged(listed, "import"))
        .when(F.ltrim(line).startswith("import "), none)
        .otherwise(_tagged(_calls(line, "python"), call))
    )
    go = _tagged(_calls(line, "go"), call)
    return (
        F.when(language == "rust", rust)
        .when(language.isin("typescript", "javascript"), script)
        .when(language == "python", python)
        .when(language == "go", go)
        .otherwise(none)
    )


def extract_dependencies(files: DataFrame) -> DataFrame:
    """(path, to_name, kind, line) of files (path, language, text); other languages and null texts have none."""
    known = files.where(F.col("language").isin(*LANGUAGES))
    lines = known.select("path", "language", F.posexplode(F.split("text", r"\r?\n")).alias("n", "source"))
    found = lines.select("path", (F.col("n") + 1).alias("line"), F.explode(line_dependencies(F.col("source"), F.col("language"))).alias("d"))
    return found.select("path", "d.to_name", "d.kind", "line")
