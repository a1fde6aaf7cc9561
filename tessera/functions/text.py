"""Lexical functions as columns: four tokenizers with different rules, match quality, weights, estimates, renderings."""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

# Words that are no search terms (function words, then task verbs and fillers).
STOPWORDS = frozenset(
    """
    the and for with from into onto that this these those when where which while are was were can will shall should would
    could may might must have has had not but all any some one two our out your their its about after before also only just
    very more most each been being does doing done how why what who then than there here over under between during via per
    upon own same such both few other another again once now lets
    add adds adding fix fixes fixing implement implements implementing create creates creating update updates updating
    change changes changing make makes making get gets getting set sets setting use uses using used new need needs needed
    want wants time times way ways please help like etc
    """.split()
)

# Language by file extension.
LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python",
    "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp",
    "rb": "ruby", "php": "php", "sh": "bash", "bash": "bash", "sql": "sql", "html": "html", "htm": "html", "xaml": "xaml",
    "axaml": "xaml", "css": "css", "scss": "css", "less": "css", "json": "json", "jsonl": "jsonl", "yaml": "yaml",
    "yml": "yaml", "xml": "xml", "md": "markdown", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "pdf": "pdf",
    "parquet": "parquet",
}
DOC_LANGUAGES = ("markdown", "docx", "pptx", "xlsx", "pdf", "sql")
DATA_LANGUAGES = ("json", "yaml", "xml", "toml")
# Estimates and prices.
LEVEL_FACTORS = {0: 1.0, 1: 0.70, 2: 0.25}
TOKENS_PER_SYMBOL = 50
DOLLARS_PER_MILLION = {"sonnet": 3.0, "opus": 15.0, "haiku": 0.8}

_CAMEL = r"(?<=[^\p{IsUppercase}])(?=\p{IsUppercase})"
_SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"


def _words(pieces: Column) -> Column:
    return F.filter(pieces, lambda w: w != "")


def camel_tokens(text: Column) -> Column:
    """TF-IDF tokens: cut at anything not alphanumeric and before an upper-case letter after one that is not; lower-cased."""
    return _words(F.split(F.lower(F.regexp_replace(text, _CAMEL, " ")), _SPLIT))


def symbol_tokens(name: Column) -> Column:
    """Tokens of a symbol name: cut at _, - and . and at the same camel boundary; other characters stay inside tokens."""
    return _words(F.split(F.lower(F.regexp_replace(name, _CAMEL, "_")), r"[_.\-]+"))


def plain_tokens(text: Column) -> Column:
    """BM25 tokens: cut at anything not alphanumeric, two bytes or more, lower-cased, no camel cut."""
    return F.transform(F.filter(F.split(text, _SPLIT), lambda w: F.octet_length(w) >= 2), F.lower)


def counted(words: Column) -> Column:
    """array<struct<term, tf>> of the distinct words of a sorted array, each with its number: the way from a word's first
    place to the next one's. Within the row, so nothing is shuffled for it. `with_counts` does the same in less time."""
    starts = _starts(words)
    return F.when(F.size(words) > 0, _runs(words, starts)).otherwise(F.array().cast("array<struct<term: string, tf: int>>"))


def with_counts(df: DataFrame, words: str, terms: str = "terms") -> DataFrame:
    """`df` with a column of `counted` in place of a column of sorted arrays without nulls, and one of their sizes, `length`.

    The first places of the words are a column of their own: in one expression, Spark finds them once for each mention.
    """
    rest = [c for c in df.columns if c != words]
    placed = df.select(*rest, words, F.size(words).alias("length"), _starts(F.col(words)).alias("_starts"))
    return placed.select(*rest, "length", _runs(F.col(words), F.col("_starts")).alias(terms))


def _starts(words: Column) -> Column:
    return F.array_compact(F.transform(words, lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), i)))


def _runs(words: Column, starts: Column) -> Column:
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(words)))
    ends = F.slice(ends, 1, F.size(starts))  # none for no words
    return F.zip_with(starts, ends, lambda i, j: F.struct(F.get(words, i).alias("term"), (j - i).cast("int").alias("tf")))


def task_keywords(task: str) -> list[str]:
    """Search terms of a task: words of letters, digits and _, three bytes or more, as written, repeats kept."""
    return [w for w in re.split(r"[^\w]+", task) if len(w.encode()) >= 3]


def meaningful(keywords: list[str]) -> list[str]:
    """Without stopwords, or all if nothing would be left."""
    return [k for k in keywords if k.lower() not in STOPWORDS] or keywords


def task_words(task: Column) -> Column:
    """`task_keywords` of a column of tasks."""
    return F.filter(F.split(task, r"[^\p{IsAlphabetic}\p{N}_]+"), lambda w: F.octet_length(w) >= 3)


def meaningful_words(words: Column) -> Column:
    """`meaningful` of a column of arrays."""
    stop = F.array(*map(F.lit, sorted(STOPWORDS)))
    kept = F.filter(words, lambda w: ~F.array_contains(stop, F.lower(w)))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def noise_words(alias: Column) -> Column:
    """The words of `noise_keywords` that a column of aliases gives, with repeats."""
    parts = F.split(F.regexp_replace(alias, "(?<=[a-z0-9])(?=[A-Z])", " "), "[^A-Za-z0-9]+")
    return F.transform(F.filter(parts, lambda p: F.length(p) >= 3), F.lower)


def noise_keywords(aliases: list[str], configured: list[str] = ()) -> set[str]:
    """Tokens (three characters or more) of the repositories' aliases, and configured words, all lower case."""
    parts = {p.lower() for a in aliases for p in re.split(r"[^A-Za-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", a))}
    return {p for p in parts if len(p) >= 3} | {c.lower() for c in configured}


def match_quality(name: Column, keyword: Column) -> Column:
    """1 for equal names, .85 for a prefix or a whole token, .4 for a substring, else 0; case does not matter."""
    n, k = F.lower(name), F.lower(keyword)
    return (
        F.when(n == k, 1.0)
        .when(n.startswith(k) | F.array_contains(symbol_tokens(name), k), 0.85)
        .when(n.contains(k), 0.4)
        .otherwise(0.0)
    )


def keyword_weight(df: Column, total: Column) -> Column:
    """ln(1 + N / (1 + df)) / ln(1 + N), within 0 and 1; 1 for an empty corpus."""
    n = total.cast("double")
    return F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log1p(n / (1 + df)) / F.log1p(n))))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """Last component without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Last extension, case as written; empty without one."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def qualified(alias: Column, relative: Column) -> Column:
    return F.concat(alias, F.lit("/"), F.regexp_replace(relative, r"\\", "/"))


def alias_of(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def relative_of(path: Column) -> Column:
    return F.regexp_replace(path, r"^[^/]*/", "")


def count_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def base_tokens(char_count: Column, symbols: Column) -> Column:
    """A quarter of the characters, rounded down, or 50 for each symbol where the size is unknown."""
    return F.when(char_count > 0, F.floor(char_count / 4)).otherwise(symbols * TOKENS_PER_SYMBOL).cast("long")


def level_tokens(base: Column, level: Column | int) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.when(level == 1, F.floor(base * 0.70)).when(level == 2, F.floor(base * 0.25)).otherwise(base).cast("long")


def savings_percent(full: Column, used: Column) -> Column:
    return F.when(full == 0, "0%").otherwise(F.format_string("%.0f%%", (full - used) * 100.0 / F.nullif(full, F.lit(0))))


def dollars(tokens: Column, model: str = "sonnet") -> Column:
    return F.format_string("$%.2f", tokens * (DOLLARS_PER_MILLION.get(model, 3.0) / 1e6))


def efficiency(saved: Column, sent: Column) -> Column:
    """Whole percent of the tokens saved; 0% where nothing was counted."""
    return F.concat(F.coalesce(F.floor(saved * 100 / F.nullif(saved + sent, F.lit(0))), F.lit(0)).cast("long").cast("string"), F.lit("%"))


def minute_text(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm")


def capped_list(items: Column, cap: int = 5) -> Column:
    rest = F.size(items) - cap
    return F.when(rest > 0, F.concat(F.array_join(F.slice(items, 1, cap), ", "), F.lit(" … (+"), rest.cast("string"), F.lit(" more)"))).otherwise(
        F.array_join(items, ", ")
    )


def severity(count: Column) -> Column:
    return F.when(count == 0, "none").when(count <= 5, "low").when(count <= 20, "medium").otherwise("high")


def truncated(text: Column, tokens: Column | int, marker: str = "\n… (truncated)") -> Column:
    """At most tokens × 4 bytes, never half a character, and a marker where something was cut."""
    limit = (F.lit(tokens) if isinstance(tokens, int) else tokens) * 4
    raw = F.encode(text, "UTF-8")
    # A cut inside a character leaves up to three bytes of it at the end; those are taken away with it.
    cut = F.regexp_replace(F.decode(F.substring(raw, F.lit(1), limit.cast("int")), "ISO-8859-1"), "(?:[À-ÿ][\u0080-¿]{0,3})$", "")
    whole = F.decode(F.encode(F.decode(F.substring(raw, F.lit(1), limit.cast("int")), "ISO-8859-1"), "ISO-8859-1"), "UTF-8")
    clean = F.substring(raw, limit.cast("int") + 1, F.lit(1))
    mid = F.coalesce((F.conv(F.hex(clean), 16, 10).cast("int").between(128, 191)), F.lit(False))
    return F.when(F.octet_length(text) <= limit, text).otherwise(
        F.concat(F.when(mid, F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8")).otherwise(whole), F.lit(marker))
    )


def starts_with(name: Column, prefix: str) -> Column:
    return F.lower(name).startswith(prefix.lower())


def derive_aliases(roots: list[str]) -> dict[str, str]:
    """Root path to alias: its last component, with -2, -3, ... where that is taken."""
    out: dict[str, str] = {}
    for root in roots:
        base = root.rstrip("/\\").replace("\\", "/").rpartition("/")[2] or "repo"
        alias, n = base, 1
        while alias in out.values():
            n += 1
            alias = f"{base}-{n}"
        out[root] = alias
    return out
