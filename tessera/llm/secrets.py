"""Secret scans: three patterns, and character Markov models that tell random strings from ordinary identifiers.

Built-in functions only: matches come from regexp_extract_all, their places from the lengths of what split leaves between
them, and a string's log-likelihood ratio from a table of character transitions held as one constant array.
"""

from __future__ import annotations

from math import log

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame


#: kind: (pattern, group whose length counts, least length). Kinds sort as listed.
PATTERNS = {
    "assign": (r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # maximal runs, so the same spans as [0-9a-f]+ kept at 24 characters
}
#: Cheap tests without which a pattern cannot match.
HINTS = {"assign": r"(?i)passw|secret|token|api_?key", "access": "AKIA", "hex": "[0-9a-f]{24}"}
#: What the models judge: maximal runs of these characters of at least so many.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Words that count as ordinary: letters, perhaps a short number at the end. Secrets in the sampled texts have another form.
ORDINARY = r"\b[A-Za-z][A-Za-z_-]{1,23}[0-9]{0,3}\b"
#: A candidate is a secret when the evidence outweighs these prior odds against it.
PRIOR_ODDS = 10_000.0
SMOOTHING = 0.1
#: All forms of an ordinary word together count as so many words.
FORMS = 3
#: Bounds of the labelled samples: generated random strings, and documents (in the mean) whose words are the ordinary class.
RANDOM_STRINGS, SAMPLE_DOCS = 3000, 2000
_SPAN = "struct<start: bigint, rank: int, end: bigint>"
_BLOCK = 512


def _matches(text: str, pattern: str, group: int, least: int, rank: int) -> str:
    """SQL for the spans of all leftmost non-overlapping matches whose group is long enough.

    Between matches lie the pieces of split, so a running sum of lengths (in code points) places every match. Matches are
    folded in blocks, which keeps the work near linear in texts with very many of them.
    """
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    steps = (
        f"zip_with(regexp_extract_all({text}, {p}, 0), zip_with(slice(split({text}, {p}, -1), 1, size(regexp_extract_all({text}, {p}, 0))), "
        f"regexp_extract_all({text}, {p}, {group}), (g, v) -> struct(cast(length(g) as bigint) as gap, length(v) as size)), "
        f"(m, x) -> struct(x.gap as gap, cast(length(m) as bigint) as whole, x.size as size))"
    )
    empty = f"cast(array() as array<{_SPAN}>)"
    span = f"struct(a.at + s.gap as start, {rank} as rank, a.at + s.gap + s.whole as end)"
    inner = (
        f"aggregate(slice(steps, b * {_BLOCK} + 1, {_BLOCK}), struct(acc.at as at, {empty} as out), "
        f"(a, s) -> struct(a.at + s.gap + s.whole as at, if(s.size >= {least}, array_append(a.out, {span}), a.out) as out))"
    )
    fold = (
        f"aggregate(sequence(0, (size(steps) - 1) div {_BLOCK}), struct(0L as at, cast(array() as array<array<{_SPAN}>>) as out), "
        f"(acc, b) -> transform(array({inner}), r -> struct(r.at as at, array_append(acc.out, r.out) as out))[0], acc -> flatten(acc.out))"
    )
    # A one-element array binds the steps to a name, so that they are computed once.
    return f"transform(array({steps}), steps -> if(size(steps) = 0, {empty}, {fold}))[0]"


def _train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character transitions, random against ordinary, with SMOOTHING added to every count.

    Labelled random: base64, hex and alphanumeric forms of SHA-256 digests. Labelled ordinary: the distinct words of a
    sample of documents of bounded mean size, chosen by a hash of doc_id and text, alone, with numbers, joined by underscores,
    dashes and slashes, and in camel case. The driver gets at most one count for each pair of characters of the alphabet and
    class.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    random = spark.range(RANDOM_STRINGS).select(
        F.explode(F.array(b64, digest, F.regexp_replace(b64, "[+/=]", ""), F.translate(b64, "+/=", "-_"))).alias("word"),
        F.lit(1).alias("label"),
    )
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, total))
    chosen = docs.where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53)) < share)
    word = F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("word")
    plain = chosen.select(word).distinct()
    number, low, title = F.pmod(F.xxhash64("word"), F.lit(1000)).cast("string"), F.lower("word"), F.initcap("word")
    twice = [F.concat(low, F.lit(sign), low) for sign in "_-/"]
    forms = ["word", F.concat("word", number), *twice, F.concat(title, title), F.concat(low, title)]
    plain = plain.select(F.explode(F.array(*forms)).alias("word"), F.lit(0).alias("label"))
    pairs = random.unionByName(plain).select(
        "label", F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substr(word, i, 2))")).alias("pair")
    )
    n = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[[SMOOTHING] * n for _ in range(n)] for _ in range(2)]
    for label, pair, k in pairs.groupBy("label", "pair").agg(F.count(F.lit(1))).collect():
        if pair[0] in place and pair[1] in place:
            counts[label][place[pair[0]]][place[pair[1]]] += k if label else k * FORMS / len(forms)
    shares = [[[log(c / sum(row)) for c in row] for row in table] for table in counts]
    return [shares[1][a][b] - shares[0][a][b] for a in range(n) for b in range(n)]


def _evidence(value: str, table: list[float]) -> str:
    """SQL for the summed log-likelihood ratio of a string. The table is a constant: the optimizer folds split and cast."""
    literal = ",".join(f"{x:.6f}" for x in table)
    n = len(ALPHABET)
    at = f"(locate(substr({value}, i, 1), '{ALPHABET}') - 1) * {n} + locate(substr({value}, i + 1, 1), '{ALPHABET}') - 1"
    return (
        f"aggregate(sequence(1, length({value}) - 1), 0D, (sum, i) -> sum + "
        f"get(cast(split('{literal}', ',') as array<double>), {at}))"
    )


def secret_spans(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """One row per input row: doc_id, spans array<struct<start, rank, end>> in order of start, then kind.

    rank 0, 1, 2 are the kinds of PATTERNS (leftmost non-overlapping matches of each kind, failing ones dropped), 3 is
    "random": runs of CANDIDATE that overlap no other span and whose log-likelihood ratio of random string against
    ordinary identifier exceeds PRIOR_ODDS. Places are code points, end exclusive. `table` holds ready transitions;
    without it they are trained on samples of `docs`.

    A null or empty text has no spans. Rows are independent: null doc_ids and repeats are answered like any row, other
    columns are not read, an empty table gives an empty result. No shuffle of texts: one scan, regular expressions only
    where a cheaper test finds their literal parts.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = table if table is not None else _train(docs)
    none = f"cast(array() as array<{_SPAN}>)"
    found = docs
    for rank, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        hint = F.col("text").contains(HINTS[kind]) if HINTS[kind].isalnum() else F.col("text").rlike(HINTS[kind])
        found = found.withColumn(kind, F.when(hint, F.expr(_matches("text", pattern, group, least, rank))).otherwise(F.expr(none)))
    runs = F.when(F.col("text").rlike(CANDIDATE), F.expr(_matches("text", CANDIDATE, 0, 0, len(PATTERNS)))).otherwise(F.expr(none))
    base = F.concat(*PATTERNS)
    found = found.select("doc_id", "text", base.alias("base"), runs.alias("runs"))
    # substring() walks a text from its start, so values are cut from the text once for each run that is still in question.
    free = "filter(runs, r -> not exists(base, b -> b.start < r.end and r.start < b.end))"
    value = "substring(text, cast(r.start + 1 as int), cast(r.end - r.start as int))"
    judged = f"filter({free}, r -> exists(array({value}), v -> {_evidence('v', table)} > {log(PRIOR_ODDS)}))"
    return found.select("doc_id", F.expr(f"array_sort(concat(base, if(size(runs) = 0, runs, {judged})))").alias("spans"))


def _joined(spans: Column | str) -> str:
    kinds = ", ".join(f"'{k}'" for k in (*PATTERNS, "random"))
    return f"array_join(transform({spans}, s -> concat(array({kinds})[s.rank], ':', s.start, ':', s.end)), ',')"


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (string) of `secret_spans`."""
    found = secret_spans(docs)
    count = [F.expr(f"cast(size(filter(spans, s -> s.rank = {r})) as bigint)").alias(f"n_{k}") for r, k in enumerate(PATTERNS)]
    return found.select(
        "doc_id",
        *count,
        F.sha2(F.expr(_joined(f"filter(spans, s -> s.rank < {len(PATTERNS)})")), 256).alias("base_sha256"),
        F.expr(_joined("spans")).alias("spans"),
    )
