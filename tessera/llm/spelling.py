"""Spelling variants of the words of a corpus, by an even-partition pigeonhole join."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tessera.scratch import discard, materialise

LETTERS = r"[A-Za-z\u00C0-\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One occurrence in so many loses a letter (0: none), words are of so many letters and occurrences at least, and a form
#: is so many times as frequent as its variants.
SLIP, LEAST_LETTERS, LEAST_COUNT, FACTOR = 199, 6, 5, 5
#: Members of a key, and free letters, beyond which its free half is cut in two once more.
GROUP, FREE = 48, 64


def words(docs: DataFrame, slip: int = SLIP, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the runs of letters in all texts, A-Z in lower case, of at least `letters` letters and `least` occurrences.

    If `slip` divides the CRC-32 of `<doc_id>:<run>`, the run loses its letter at that number modulo its length. Null
    texts have no runs, a null doc_id counts as empty. Runs that are too short for a word are not even extracted, since
    no run gets longer; counts are partial aggregates, so a word in every text costs one row a task.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{letters},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    if slip:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
        runs = runs.select("run", h.alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
        runs = runs.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("run")).where(F.length("run") >= letters)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """`key` of the letters outside the free stretch [lo, hi) of a word of `size` letters; a longer word's is one longer."""
    after = F.col("hi") + F.col("longer").cast("int")
    return rows.withColumn("key", F.xxhash64("size", "lo", "hi", *_fixed("word", after)))


def _fixed(word: str, after: Column) -> list[Column]:
    """The letters of a word before and after its free stretch."""
    return [F.col(word).substr(F.lit(1), F.col("lo")), F.col(word).substr(after + 1, F.col("size") - F.col("hi"))]


def _nodes(*nodes: tuple[Column, Column, Column, Column]) -> Column:
    names = ("longer", "size", "lo", "hi")
    return F.explode(F.array(*(F.struct(*(x.alias(c) for x, c in zip(node, names))) for node in nodes))).alias("node")


def near_words(counted: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n, near, near_n), in both directions, for all words one inserted, deleted or replaced code point apart.

    `counted` has (word, n) with each word once, and is read several times. Words of one letter and null are left out.

    A word of size letters is indexed under two keys, its first and its second even half with its length. It probes the
    words of its own length, and those one letter shorter: one edit leaves one of their halves whole, the first one at the
    start or the second one at the end, shifted by one. Under a key of more than `group` members, or FREE letters, the other
    half, which is free, is cut evenly again, and its two parts make longer keys by the same argument, until groups are small or one
    letter is free (then an alphabet bounds them). So a popular half neither forms all its pairs nor loses one. Two
    words of one length share the key of just one leaf; of words that differ in length, the pair counts under the first
    key it shares: a later one, that ends before the word does, is passed over if the free letters agree. Thus
    candidates repeat nowhere and are verified where they meet. Keys are hashes; a collision is a candidate that fails.
    """
    yes, no, size = F.lit(True), F.lit(False), F.length("word")
    half, none = F.floor(size / 2).cast("int"), F.lit(0)
    shorter = size - 1
    half1 = F.floor(shorter / 2).cast("int")
    first = _nodes((no, size, half, size), (no, size, none, half), (yes, shorter, half1, shorter), (yes, shorter, none, half1))
    rows = _keyed(counted.where(size > 1).select("word", "n", first).select("word", "n", "node.*"))
    found, held = [], []
    while True:
        sizes = rows.groupBy("key").agg(F.count_if(~F.col("longer")).alias("own"), F.count(F.lit(1)).alias("members"))
        sizes = sizes.where("own > 0 and members > 1").select("key", (F.col("members") > group).alias("big"))
        rows = materialise(rows.join(sizes, "key").withColumn("big", (F.col("big") | (F.col("hi") - F.col("lo") > FREE)) & (F.col("hi") - F.col("lo") > 1)))
        held.append(rows)
        small = rows.where("not big")
        a = small.where("not longer").select("key", "size", "lo", "hi", "word", "n")
        b = small.select("key", F.col("size").alias("b_size"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), "longer", F.col("word").alias("near"), F.col("n").alias("near_n"))
        after = F.col("hi") + F.col("longer").cast("int")
        same = [F.col(c) == F.col(f"b_{c}") for c in ("size", "lo", "hi")]
        same += [x == y for x, y in zip(_fixed("word", F.col("hi")), _fixed("near", after))]
        free = [F.col(c).substr(F.col("lo") + 1, F.col("hi") - F.col("lo")) for c in ("word", "near")]
        once = F.when(F.col("longer"), (F.col("hi") == F.col("size")) | (free[0] != free[1])).otherwise(F.col("word") < F.col("near"))
        edit = F.levenshtein(free[0], F.col("near").substr(F.col("lo") + 1, after - F.col("lo"))) == 1
        pairs = a.join(b, "key").where(reduce(Column.__and__, same) & once & edit)
        found.append(pairs.select("word", "n", "near", "near_n"))
        big = rows.where("big")
        if big.isEmpty():
            break
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = _nodes((F.col("longer"), F.col("size"), mid, F.col("hi")), (F.col("longer"), F.col("size"), F.col("lo"), mid))
        rows = _keyed(big.select("word", "n", parts).select("word", "n", "node.*"))
    pairs = materialise(reduce(DataFrame.unionByName, found))
    for df in held:
        discard(df)
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) rows: forms followed to the last, by doubling, so rounds are the logarithm of the way.

    Each word has one form and ways do not run in circles (here a form is more frequent than its variant).
    """
    rows = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        further = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = rows.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        nxt = materialise(nxt)
        discard(rows)
        rows = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return rows


def spelling_variants(docs: DataFrame, slip: int = SLIP, factor: int = FACTOR, group: int = GROUP) -> DataFrame:
    """One row per word of the texts: word, form, root, n, n_near, form_n.

    Words are those of `words`. n_near counts the words one edit apart, form is the most frequent of them (ties: the
    smallest in code-point order) if it occurs `factor` times as often at least, form_n its count, both null otherwise.
    root is where forms lead from the word, the word itself without a form. Ways end, since counts grow along them. Null
    and empty texts have no words; repeated rows count each time; other columns are not read; an empty table gives none.
    """
    if factor < 2:
        raise ValueError("forms must be more frequent than their variants")
    counted = materialise(words(docs.select("doc_id", "text"), slip))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_words(counted, group).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best, F.first("n").alias("own"))
    is_form = -F.col("best.less") >= factor * F.col("own")
    near = materialise(near.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    out = counted.join(near, "word", "left").join(roots(near.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
