"""Lexical retrieval over symbols and documents: name search, TF-IDF by file, Okapi BM25, file names."""

from __future__ import annotations

import uuid
import zlib

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from tessera.functions.text import camel_tokens, file_stem, keyword_weight, match_quality, plain_tokens, with_counts
from tessera.scratch import made, materialise, reread, shared_dir

K1, B = 1.5, 0.75
FALLBACK_SCORE = 0.3
FILENAME_QUALITY = 0.7


def terms_table(spark: SparkSession, terms: list[str], name: str = "term") -> DataFrame:
    """Query-side terms with their number of uses. A request's size bounds it, so it may be broadcast."""
    counts: dict[str, int] = {}
    for t in terms:
        counts[t] = counts.get(t, 0) + 1
    return spark.createDataFrame(list(counts.items()) or [], f"{name} string, uses int")


def like_pattern(query: str) -> str:
    return "%" + query.lower().replace("\\", "\\\\") + "%"


def search_symbols(symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """Symbols whose name contains the query (its % and _ are wildcards): exact names first, then short ones."""
    found = symbols.where(F.lower("name").like(like_pattern(query)))
    exact = (F.lower("name") == query.lower()).cast("int")
    return found.orderBy(exact.desc(), F.length("name"), "path", "line", "name").limit(limit)


def context(symbols: DataFrame, query: str, limit: int = 10, kind: str | None = None) -> DataFrame:
    """`search_symbols` of twice the limit, then the kind filter, then the limit, in this order."""
    found = search_symbols(symbols, query, 2 * limit)
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    exact = (F.lower("name") == query.lower()).cast("int")
    return found.orderBy(exact.desc(), F.length("name"), "path", "line", "name").limit(limit).withColumns(
        {"score": F.lit(1.0), "tokens": F.lit(50)}
    )


def keyword_frequency(symbols: DataFrame, keywords: list[str]) -> DataFrame:
    """keyword, df (symbols whose name contains it, 0 included), n_symbols, weight; one scan, one partial aggregate."""
    sums = [F.count_if(F.lower("name").like(like_pattern(k))).alias(f"k{i}") for i, k in enumerate(keywords)]
    row = symbols.agg(F.count(F.lit(1)).alias("n_symbols"), *sums)
    pairs = F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").alias("df")) for i, k in enumerate(keywords)])
    stats = row.select("n_symbols", F.inline(pairs))
    return stats.select("keyword", "df", "n_symbols", keyword_weight(F.col("df"), F.col("n_symbols")).alias("weight"))


def tfidf_weights(symbols: DataFrame) -> DataFrame:
    """(path, term, weight) of files as bags of the tokens of their symbol names: count / total * ln(N / df)."""
    counts = symbols.select("path", F.explode(camel_tokens(F.col("name"))).alias("term")).groupBy("path", "term").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("path").agg(F.sum("n").alias("total"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    files = symbols.agg(F.count_distinct("path").alias("files"))
    return (
        counts.join(totals, "path")
        .join(df, "term")
        .crossJoin(F.broadcast(files))  # one row
        .select("path", "term", (F.col("n") / F.col("total") * F.log(F.col("files") / F.col("df"))).alias("weight"))
    )


def tfidf_postings(symbols: DataFrame) -> DataFrame:
    """`tfidf_weights` to be stored: each row also carries its file's norm, and rows are laid out by term, so that a request
    reads the weights of its own terms and no others. Files whose weights are all 0 score nothing and have no rows."""
    weights = tfidf_weights(symbols)
    norms = weights.groupBy("path").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")).where("norm > 0")
    return weights.join(norms, "path").select("path", "term", "weight", "norm").repartitionByRange("term", "path").sortWithinPartitions("term", "path")


def tfidf_scores(weights: DataFrame, tokens: list[str]) -> DataFrame:
    """(path, score > 0): query counts over their norm (unknown tokens included) times weights over the file's norm.

    Stored weights, which have a column norm, are filtered by the query's terms; others are read whole to find the norms.
    """
    spark = weights.sparkSession
    uses = terms_table(spark, tokens)
    norm = sum(tokens.count(t) ** 2 for t in set(tokens)) ** 0.5 or 1.0
    if "norm" in weights.columns:
        hit = weights.where(F.col("term").isin(*dict.fromkeys(tokens))).join(F.broadcast(uses), "term")  # a row for each word of the request
        dot = F.sum(F.col("uses") / norm * F.col("weight"))
        return hit.groupBy("path", "norm").agg(dot.alias("dot")).where("dot > 0").select("path", (F.col("dot") / F.col("norm")).alias("score"))
    known = F.broadcast(uses.select(F.col("term").alias("t"), "uses"))
    dot = F.sum(F.coalesce(F.col("uses"), F.lit(0)) / norm * F.col("weight"))
    scored = weights.join(known, F.col("term") == F.col("t"), "left").groupBy("path").agg(
        dot.alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")
    )
    return scored.where("dot > 0 AND norm > 0").select("path", (F.col("dot") / F.col("norm")).alias("score"))


def tfidf_search(symbols: DataFrame, weights: DataFrame, tokens: list[str], limit: int) -> DataFrame:
    """path, name, kind, line, score, is_fallback of the best files, each by its first symbol (in order of line and name).

    Without any positive score, files with a symbol that contains a query token count with .3 each, by path.
    """
    scored = tfidf_scores(weights, tokens)
    first = symbols.groupBy("path").agg(F.min(F.struct("line", "name", "kind")).alias("s"))
    hits = scored.join(first, "path").select("path", "s.name", "s.kind", "s.line", "score", F.lit(False).alias("is_fallback"))
    none = scored.agg((F.count(F.lit(1)) == 0).alias("none"))
    anywhere = None
    for t in dict.fromkeys(tokens):
        one = F.contains(F.lower("name"), F.lit(t))
        anywhere = one if anywhere is None else anywhere | one
    backup = symbols.where(anywhere if anywhere is not None else F.lit(False))
    backup = backup.groupBy("path").agg(F.min(F.struct("line", "name", "kind")).alias("s")).crossJoin(F.broadcast(none)).where("none")
    backup = backup.select("path", "s.name", "s.kind", "s.line", F.lit(FALLBACK_SCORE).alias("score"), F.lit(True).alias("is_fallback"))
    return hits.unionByName(backup).orderBy(F.desc("score"), "path").limit(limit)


#: Partitions that postings are laid out in by term, and parts that the postings of one term are dealt to at most.
TERM_BUCKETS, TERM_SLICES = 64, 16
#: What stands for the document itself among its terms; no term is empty.
WHOLE = ""


def word_counts(docs: DataFrame, key: str = "path", body: str = "text") -> DataFrame:
    """(key, length, terms) of documents: their number of tokens, and an array<struct<term, tf>> of the distinct ones; no shuffle."""
    return with_counts(docs.select(key, F.sort_array(F.coalesce(plain_tokens(F.col(body)), F.array().cast("array<string>"))).alias("_words")), "_words")


def postings(docs: DataFrame, key: str = "path", body: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written postings (term, key, length, tf) of documents with at least one token, and one row (n, mean) about them.

    Texts are read once. Each document also has one posting of the term WHOLE, so n and the mean are sums over the written
    table, and a task that runs again changes nothing. Keys tell documents apart. Words are counted within their row, so the
    one shuffle has a row for each posting and not for each word; it lays them out in partitions by a hash of the term, sorted
    by term, and a query reads those of its terms alone. A frequent term is dealt to TERM_SLICES tasks.
    """
    spark = docs.sparkSession
    rows = word_counts(docs, key, body)
    whole = F.array(F.struct(F.lit(WHOLE).alias("term"), F.lit(1).alias("tf")))
    # Outer: for `inline` Spark would infer a filter on the size of the array, and count the words a second time for it.
    words = rows.select(key, "length", F.inline_outer(F.when(F.col("length") > 0, F.concat("terms", whole)))).where("term is not null")
    words = words.withColumns({"bucket": _bucket(F.col("term")), "slice": F.pmod(F.xxhash64(key), F.lit(TERM_SLICES)).cast("int")})
    dealt = words.repartition("bucket", "slice").select("term", key, "length", F.col("tf").cast("long").alias("tf"), "bucket")
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    made(spark, path)
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    terms = reread(spark, path, dealt)
    stats = terms.where((F.col("bucket") == _bucket_of(WHOLE)) & (F.col("term") == WHOLE))
    stats = stats.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("tf") * F.col("length")) / F.sum("tf"), F.lit(0.0)).alias("mean"))
    return terms.where(F.col("term") != WHOLE), stats


def _bucket(term: Column) -> Column:
    return (F.crc32(F.encode(term, "UTF-8")) % TERM_BUCKETS).cast("int")


def _bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) % TERM_BUCKETS


def bm25_query_scores(docs: DataFrame, terms: list[str], key: str = "path", body: str = "text") -> DataFrame:
    """(key, score > 0) of Okapi BM25, read straight from texts: one pass keeps lengths and the query's term counts only.

    Readable, non-empty documents make N and the mean length; a term given twice counts twice.
    """
    spark = docs.sparkSession
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    if not wanted:
        return spark.createDataFrame([], docs.select(key).schema.add("score", "double"))
    tokens = docs.select(key, plain_tokens(F.col(body)).alias("tokens")).where(F.size("tokens") > 0)
    # A filter leaves only the query's words, so that the counts below look at few strings.
    named = F.array(*map(F.lit, wanted))
    kept = tokens.select(key, F.size("tokens").alias("length"), F.filter("tokens", lambda w: F.array_contains(named, w)).alias("found"))
    # Written once, narrow: the statistics and the scores would otherwise tokenise every text each.
    rows = kept.select(key, "length", *[F.size(F.filter("found", _equals(t))).alias(f"tf{i}") for i, t in enumerate(wanted)])
    rows = materialise(rows)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    score = F.lit(0.0)
    lowered = [t.lower() for t in terms]
    for i, t in enumerate(wanted):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + lowered.count(t) * F.when(tf > 0, idf * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)
    return rows.crossJoin(F.broadcast(stats)).select(key, score.alias("score")).where("score > 0")


def _equals(term: str):
    return lambda w: w == term


def bm25_search(docs: DataFrame, terms: list[str], limit: int = 20, key: str = "path", body: str = "text") -> DataFrame:
    return bm25_query_scores(docs, terms, key, body).orderBy(F.desc("score"), key).limit(limit)


def bm25_from_postings(terms: DataFrame, stats: DataFrame, query: list[str], limit: int = 20, key: str = "path") -> DataFrame:
    """The same scores from stored postings: only the partitions of the query's terms are read, and in them what they sort by term."""
    spark = terms.sparkSession
    lowered = [t.lower() for t in query]
    uses = F.broadcast(terms_table(spark, lowered))  # a row for each word of the request
    hit = terms.where(F.col("bucket").isin(*{_bucket_of(t) for t in lowered}) & F.col("term").isin(*dict.fromkeys(lowered))).join(uses, "term")
    df = F.broadcast(hit.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # one row a query term
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    one = F.col("uses") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    scored = hit.join(df, "term").crossJoin(F.broadcast(stats)).groupBy(key).agg(F.sum(one).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(limit)


def filename_matches(files: DataFrame, keywords: DataFrame, doc_languages: tuple[str, ...]) -> DataFrame:
    """(path, keyword, weight, quality) of files, docs aside, whose stem matches a keyword at .7 or better.

    `keywords` (keyword, weight) comes from one request, so the pairing is with a broadcast list of that size.
    """
    paired = files.where(~F.col("language").isin(*doc_languages)).crossJoin(F.broadcast(keywords.select("keyword", "weight")))
    quality = match_quality(file_stem(F.col("path")), F.col("keyword"))
    return paired.select("path", "keyword", "weight", quality.alias("quality")).where(F.col("quality") >= FILENAME_QUALITY)


def first_code_hits(hits: DataFrame, keep: int, order: list, by: list[str] = ()) -> DataFrame:
    """Rows up to and including the keep-th code hit in `order`; needs a boolean column is_code. Few rows by contract."""
    before = F.sum(F.col("is_code").cast("int")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return hits.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < keep).drop("_before")


def symbol_hits(symbols: DataFrame, keywords: DataFrame, fetch: int = 25, keep: int = 8) -> DataFrame:
    """For every keyword: the best `fetch` symbols of a name search, walked in order until the `keep`-th code hit.

    symbols: path, name, kind, line, is_code. keywords (keyword, weight, ...): a request's own list, broadcast.
    """
    return best_hits(symbols.join(F.broadcast(keywords), F.contains(F.lower("name"), F.lower("keyword"))), fetch, keep)


def best_hits(found: DataFrame, fetch: int = 25, keep: int = 8) -> DataFrame:
    """`symbol_hits` of pairs of a symbol and a keyword that its name contains."""
    order = [(F.lower("name") == F.lower("keyword")).cast("int").desc(), F.length("name"), "path", "line", "name"]
    ranked = found.withColumn("_rank", F.row_number().over(Window.partitionBy("keyword").orderBy(*order))).where(F.col("_rank") <= fetch)
    return first_code_hits(ranked, keep, ["_rank"], ["keyword"]).drop("_rank")


def exact(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of exactly this name, case as written."""
    return symbols.where(F.col("name") == name)
