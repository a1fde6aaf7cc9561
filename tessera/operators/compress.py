"""Text compression: full, compact (no comments, no blank runs), skeleton (declarations without bodies)."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StringType

from tessera.sources.code import Scan, declarations, language_key

BODY = " { ... }"


def collapse_blanks(text: str) -> str:
    out: list[str] = []
    for line in text.split("\n"):
        if line.strip() or not out or out[-1].strip():
            out.append(line if line.strip() else "")
    return "\n".join(out).rstrip()


def compact(text: str, language: str) -> str:
    """Without comments, runs of blank lines as one, no white space at the end. Unknown languages keep their comments."""
    key = language_key(language)
    if key is None:
        return collapse_blanks(text)
    out, at = [], 0
    for start, end in Scan(text, key).comments:
        out.append(text[at:start])
        at = end
    return collapse_blanks("".join(out) + text[at:])


def skeleton(text: str, language: str) -> str:
    """Top-level declarations up to their bodies, other top-level text as it is; Markdown by `keeps_line`; else line one."""
    if language in ("markdown", "md"):
        inside, out = False, []
        for line in text.split("\n"):
            fence = line.lstrip().startswith("```")
            if fence or inside or keeps(line):
                out.append(line)
            inside ^= fence
        return "\n".join(out)
    key = language_key(language)
    if key is None:
        return text.split("\n", 1)[0]
    out = []
    for start, body, end in declarations(text, key):
        if body is None:
            out.append(text[start:end].rstrip())
        elif key == "python":
            out.append(text[start:body].rstrip() + " ...")
        else:
            out.append(text[start:body].rstrip() + BODY)
    return "\n".join(o for o in out if o.strip())


def keeps(line: str) -> bool:
    t = line.lstrip()
    rule = len(t.strip()) >= 3 and len(set(t.strip())) == 1 and t[0] in "-*_"
    return t.startswith(("#", "- ", "* ", "+ ", "> ")) or rule or t[:1].isdigit()


def compress(text: str | None, language: str | None, level: int | None) -> str | None:
    """Level 1 is compact, 2 skeleton, any other number the text itself."""
    if text is None:
        return None
    return compact(text, language or "") if level == 1 else skeleton(text, language or "") if level == 2 else text


def compressed(text: Column, language: Column, level: Column) -> Column:
    """`compress` as a column. Rows go to Python some at a time, so that it holds few texts whatever their size: Arrow batches
    are of so many rows however long these are."""
    return F.udf(compress, StringType(), useArrow=False)(text, language, level)


def compression_stats(files: DataFrame, level: int) -> DataFrame:
    """path, original and compressed bytes, and the whole percent saved (0 at least)."""
    rows = files.withColumn("compressed", compressed(F.col("text"), F.col("language"), F.lit(level)))
    before, after = F.octet_length("text"), F.octet_length("compressed")
    rate = F.greatest(F.lit(0.0), (before - after) * 100.0 / F.nullif(before, F.lit(0)))
    return rows.select("path", before.alias("original_bytes"), after.alias("compressed_bytes"), F.format_string("%.0f%%", F.coalesce(rate, F.lit(0.0))).alias("rate"))


def markdown_skeleton(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, skeleton) with built-in functions only: fences count by a running parity inside each text's own line array."""
    lines = F.split("text", "\n")
    fences = F.transform(lines, lambda x: F.ltrim(x).startswith("```"))
    # Position i lies inside a fence if an odd number of fence lines precedes it.
    marked = F.expr(
        """aggregate(arrays_zip(lines, fences), struct(false as inside, cast(array() as array<array<string>>) as out),
           (a, x) -> struct(a.inside <> x.fences as inside,
                            if(x.fences or a.inside or (ltrim(x.lines) rlike '^(#|[-*+] |> |[0-9]|(-{3,}|\\\\*{3,}|_{3,})\\\\s*$)'),
                               array_append(a.out, array(x.lines)), a.out) as out),
           a -> array_join(flatten(a.out), '\\n'))"""
    )
    return docs.withColumns({"lines": lines}).withColumns({"fences": fences}).select(key, marked.alias("skeleton"))


def blank_collapse(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, text) with runs of blank lines as one blank line and no white space at the end, by built-in functions."""
    one = F.regexp_replace(F.col("text"), r"(?m)^[ \t\r\f]+$", "")
    return docs.select(key, F.regexp_replace(F.regexp_replace(one, r"\n{3,}", "\n\n"), r"\s+$", "").alias("text"))
