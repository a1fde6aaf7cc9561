import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm.spelling import near_words, spelling_variants

SCHEMA = "doc_id long, text string, word string, n long"


def brute(rows, slip=199):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    letters = sorted({c for w in counts for c in w})

    def near(w):
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        some = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
        return {x for x in some if x in counts and x != w}

    form, out = {}, []
    for w, n in counts.items():
        best = min(near(w), key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near(w)), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def made_rows():
    """Chains of ever rarer variants, words that share halves, repeats, capitals, accents, nulls and one very long word."""
    rng = random.Random(11)
    stems = ["internat", "internet", "Straßen", "élevée", "élévée", "abcdefg", "abcdef", "bcdefg", "aaaaaaa", "aaaaaa", "aaaaaaaa", "ÀÉÎÕÜÝ", "z×÷ÿÿþ"]
    words = [s + t for s in stems for t in ("", "s", "x", "io", "ional")] + [s[:k] + c + s[k + 1 :] for s in stems for k in (0, 3, len(s) - 1) for c in "qé"]
    words += ["".join(rng.choices("ab", k=rng.randint(6, 9))) for _ in range(150)]
    rows = []
    for i in range(400):
        text = " ".join(rng.choices(words, weights=[1 + 400 / (k + 1) for k in range(len(words))], k=60))
        rows.append((i, text, "word", 1))
    rows += [(None, "internats " * 9, "x", 2), (None, None, None, None), (7, "", "", 0), (7, rows[7][1], "w", 7), (7, rows[7][1], "w", 7)]
    long = "pneumono" * 40_000
    rows += [(900 + i, f"{long}, {long}x; {long[:-1]} 12{long[:-1]}y tab\tend", "w", 1) for i in range(5)]
    return rows


@pytest.mark.parametrize("group", [2, 48])
def test_against_brute_force(spark, group):
    rows = made_rows()[:-5]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in spelling_variants(docs, slip=7, group=group).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    assert got == brute(rows, 7)
    assert any(r[2] not in (r[0], r[1]) for r in got), "no way of two steps"


def test_production_slip_and_very_long_words(spark):
    rows = made_rows()
    got = {r.word: r for r in spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()}
    want = brute(rows[:-5])
    assert {w: tuple(got[w]) for w, *_ in want} == {r[0]: r for r in want}
    long = "pneumono" * 40_000
    assert [got[w].n_near for w in (long, long + "x", long[:-1], long[:-1] + "y")] == [3, 1, 2, 2] and len(got) == len(want) + 4


def test_all_pairs_at_one_edit(spark):
    """Every word over two letters, so that halves are as popular as they can be."""
    words = [f"{k:0{size}b}".replace("0", "a").replace("1", "b") for size in (6, 7, 8) for k in range(1 << size)]
    counted = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    some = set(words)
    want = set()
    for w in words:
        for k in range(len(w)):
            want |= {(w, w[:k] + c + w[k + 1 :]) for c in "ab"} | {(w, w[:k] + w[k + 1 :])}
    want = {p for a, b in want if a != b and b in some for p in ((a, b), (b, a))}
    for group in (2, 16, 1000):
        got = [(r.word, r.near) for r in near_words(counted, group).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling_variants(empty).collect() == [] and spelling_variants(spark.createDataFrame([(1, None, "w", 1), (2, "", "w", 1), (3, "abcdef", "w", 1)], SCHEMA)).collect() == []
