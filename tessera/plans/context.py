"""The ranked-context request: keywords, evidence of four channels, fusion, cutoff, confidence, packing, related files."""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tessera.functions.text import (
    DATA_LANGUAGES,
    DOC_LANGUAGES,
    base_tokens,
    camel_tokens,
    dollars,
    match_quality,
    meaningful,
    savings_percent,
    task_keywords,
    truncated,
)
from tessera.operators import budget as packing
from tessera.operators import relevance
from tessera.operators.catalog import symbols_per_file
from tessera.operators.compress import compressed
from tessera.operators.graph import related_files
from tessera.operators.search import (
    bm25_search,
    filename_matches,
    first_code_hits,
    keyword_frequency,
    symbol_hits,
    tfidf_search,
    tfidf_weights,
)
from tessera.scratch import materialise

NOT_CODE = (*DOC_LANGUAGES, *DATA_LANGUAGES)
TFIDF_FETCH, TFIDF_KEEP, BM25_TOP, RELATED = 100, 20, 20, 10


@dataclass
class Index:
    """Tables of a request: files (path, language, char_count, text), symbols, edges, and optional TF-IDF weights."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    weights: DataFrame | None = None


@dataclass
class Answer:
    pivots: DataFrame  # position, path, score, level, tokens, truncated, reasons
    related: DataFrame  # path, n_edges
    summary: DataFrame  # one row: confidence, weak, uncovered, level, totals, savings, cost


def evidence(index: Index, keywords: list[str], noise: set[str] = frozenset()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence rows, raw signals: one row, keyword coverage) of a request.

    Keywords are unequal: common ones (in more than a tenth of the symbols) and noise ones have no name search; all of
    them take part in TF-IDF and BM25. Documents and data files give no symbol or TF-IDF evidence but count for the raw
    signals, from which confidence is judged.
    """
    spark = index.files.sparkSession
    named = [k for k in dict.fromkeys(keywords) if k.lower() not in noise]
    code = index.files.where(F.col("language").isin(*NOT_CODE)).select("path").distinct().withColumn("_other", F.lit(True))
    symbols = index.symbols.select("path", "name", "kind", "line").join(code, "path", "left").withColumn("is_code", F.col("_other").isNull()).drop("_other")
    stats = materialise(keyword_frequency(index.symbols, named)) if named else spark.createDataFrame([], "keyword string, df long, n_symbols long, weight double")
    searched = stats.where(f"n_symbols = 0 or df / n_symbols <= {relevance.COMMON_SHARE}")

    hits = materialise(symbol_hits(symbols, searched.select("keyword", "weight")).withColumn("quality", match_quality(F.col("name"), F.col("keyword"))))
    names = materialise(filename_matches(index.files, searched, DOC_LANGUAGES))
    tokens = [r.t for r in spark.createDataFrame([(" ".join(keywords),)], "q string").select(F.explode(camel_tokens(F.col("q"))).alias("t")).collect()]
    weights = index.weights if index.weights is not None else tfidf_weights(index.symbols)
    found = tfidf_search(index.symbols, weights, tokens, TFIDF_FETCH).join(code, "path", "left").withColumn("is_code", F.col("_other").isNull()).drop("_other")
    tfidf = materialise(first_code_hits(found, TFIDF_KEEP, [F.desc("score"), "path"]))
    docs = index.files.where(F.col("language").isin(*DOC_LANGUAGES) & F.col("text").isNotNull())
    bm25 = materialise(bm25_search(docs, keywords, BM25_TOP))

    def rows(df: DataFrame, **columns) -> DataFrame:
        empty = {"keyword": "string", "weight": "double", "quality": "double", "filename": "boolean", "tfidf": "double", "bm25": "double"}
        return df.select("path", *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in empty.items()])

    own = {c: F.col(c) for c in ("keyword", "weight", "quality")}
    all_rows = (
        rows(hits.where("is_code"), **own)
        .unionByName(rows(names, **own, filename=F.lit(True)))
        .unionByName(rows(tfidf.where("is_code"), tfidf=F.col("score")))
        .unionByName(rows(bm25, bm25=F.col("score")))
    )
    both = hits.select("keyword", "weight", "quality").unionByName(names.select("keyword", "weight", "quality"))
    signals = both.agg(
        F.coalesce(F.max("quality"), F.lit(0.0)).alias("max_quality"),
        F.coalesce(F.bool_or((F.col("quality") == 1.0) & (F.col("weight") >= relevance.DEFINING_WEIGHT)), F.lit(False)).alias("strong_exact"),
    )
    signals = signals.crossJoin(tfidf.agg(F.coalesce(F.max(F.when(~F.col("is_fallback"), F.col("score"))), F.lit(0.0)).alias("max_tfidf"), F.coalesce(F.bool_or("is_fallback"), F.lit(False)).alias("had_fallback")))
    signals = signals.crossJoin(bm25.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("max_bm25")))
    code_quality = hits.where("is_code").select("keyword", "quality").unionByName(names.select("keyword", "quality")).groupBy("keyword").agg(F.max("quality").alias("q"))
    covered = searched.join(code_quality, "keyword", "left").select("keyword", "df", "weight", F.coalesce("q", F.lit(0.0)).alias("best_quality"))
    return all_rows, materialise(signals), materialise(covered)


def run_pipeline(
    index: Index,
    task: str,
    budget: int | None = None,
    config: relevance.Config = relevance.Config(),
    diff: list[str] = (),
    repos: list[str] | None = None,
    level: int | None = None,
    rules: dict[str, int] | None = None,
    noise: set[str] = frozenset(),
    include_content: bool = False,
    model: str = "sonnet",
) -> Answer:
    """Files that matter for a task, ranked and packed into a token budget.

    Everything before the pivots is one plan over the index with broadcast scalars; the pivots, at most max_pivots rows, are
    folded as one array. Scoping to repositories comes after fusion, so that scores do not depend on it.
    """
    spark = index.files.sparkSession
    budget = budget or config.default_budget_tokens
    rows, signals, covered = evidence(index, meaningful(task_keywords(task)), noise)
    known = spark.createDataFrame([(p,) for p in diff], "path string").join(index.files.select("path"), "path", "left_semi")
    fused = relevance.fuse(relevance.with_diff_files(relevance.accumulate(rows), known))
    fused = relevance.drop_generated_twins(fused)
    if repos:
        fused = fused.where(F.substring_index("path", "/", 1).isin(*repos))
    kept = relevance.cutoff(fused, config)

    judged = relevance.confidence(F.col("max_quality"), F.col("strong_exact"), F.col("max_tfidf"), F.col("max_bm25"))
    weak = relevance.is_weak(F.col("max_quality"), F.col("max_tfidf"), F.col("max_bm25"))
    verdict = signals.crossJoin(relevance.coverage(covered)).select(
        relevance.apply_coverage(judged).alias("confidence"), (weak | F.col("all_uncovered")).alias("weak"), "uncovered", "had_fallback"
    )
    verdict = materialise(verdict)
    most = min(config.max_pivots, relevance.WEAK_PIVOTS) if verdict.first().weak else config.max_pivots

    sizes = symbols_per_file(index.files, index.symbols)
    ranked = kept.withColumn("reasons", relevance.match_reasons()).orderBy(F.desc("score"), "path").limit(most)
    facts = index.files.join(sizes, "path").select("path", "language", base_tokens(F.col("char_count"), F.col("n_symbols")).alias("base_tokens"))
    pivots = materialise(ranked.join(facts, "path").select("path", "score", "reasons", "git_diff", "dropped", "language", "base_tokens"))
    chosen = packing.choose_level(pivots, budget)
    base_level = level if level is not None else chosen.first().level
    fitted = packing.fit_to_cap(pivots, budget, base_level, config)
    packed = materialise(packing.greedy_pack(fitted, budget).join(pivots.select("path", "reasons", "git_diff", "language"), "path"))
    if rules:
        ruled = packing.rule_levels(packed, rules).withColumnRenamed("level", "rule")
        tokens = F.when(F.col("rule").isNull(), F.col("tokens")).otherwise(packing.level_tokens(F.col("base_tokens"), F.col("rule")))
        packed = packed.join(ruled, "path", "left").withColumns({"tokens": tokens, "level": F.coalesce("rule", "level")}).drop("rule")
    if include_content:
        bodies = index.files.join(F.broadcast(packed.select("path")), "path").select("path", "text")  # max_pivots paths at most
        packed = packed.join(bodies, "path").withColumn("content", compressed(F.col("text"), F.col("language"), F.col("level"))).drop("text")
        packed = packed.withColumn("content", F.when(F.col("truncated"), truncated(F.col("content"), F.col("tokens"))).otherwise(F.col("content")))
    whole = index.files.agg(F.coalesce(F.floor(F.sum("char_count") / 4), F.lit(0)).cast("long").alias("workspace_tokens"))
    used = packed.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.count(F.lit(1)).alias("n_pivots"))
    summary = verdict.crossJoin(used).crossJoin(whole).withColumns(
        {
            "level": F.lit(base_level),
            "dropped": F.lit(pivots.agg(F.max("dropped")).first()[0] or 0),
            "budget_exceeded_by_rules": F.col("total_tokens") > budget,
            "saved": savings_percent(F.col("workspace_tokens"), F.least("total_tokens", "workspace_tokens")),
            "cost": dollars(F.col("total_tokens"), model),
        }
    )
    return Answer(packed.orderBy("position"), related_files(index.symbols, index.edges, packed.select("path"), RELATED), summary)
