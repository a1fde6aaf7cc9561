import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Small texts with every awkward shape: copies, near copies, empties, nulls, other scripts, odd white space, one long one."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "épée", "Straße", "ΣΑΣ", "naïve", "x1", "don't", "co-op", "日本", "😀", "zeta", "eta", "theta"]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(25)]
    texts = base + base[:5] + [b.replace(" ", "\n", 1) for b in base[5:9]] + [b + " extra" for b in base[9:13]]
    texts += ["", None, " \t\n", "one", "two words", "<|endoftext|> inside <|ENDOFTEXT|>", "a b c  d\x1ce", "tail  ", "\r\n\r\n x", "aaaaaaaaaaaa -----"]
    texts.append(" ".join(rng.choices(words, k=30_000)))
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With a null and a repeated doc_id, and extra columns whose names the operators use inside."""
    rows = [(i, t, "en", f"s{i % 3}", i) for i, t in corpus] + [(None, "null id", "en", "s", 1), (3, corpus[3][1], "en", "s0", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, rank string, n long").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
