import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm.components import components
from tessera.llm.exact_dedup import exact_duplicates
from tessera.llm.simhash import component_rows, fingerprints, near_duplicates, shingle_hashes


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints(corpus):
    texts = [(t or "").encode() for _, t in corpus]
    assert fingerprints([shingle_hashes(t) for t in texts]).tolist() == [brute_fingerprint(t) for _, t in corpus]


def test_pieces_do_not_matter(corpus, monkeypatch):
    text = corpus[-1][1].encode()
    whole = shingle_hashes(text)
    import tessera.llm.simhash as module

    from tessera.llm.batches import pieces

    parts = list(pieces(text, 1000))
    assert b"".join(parts) == text and len(parts) > 50
    monkeypatch.setattr(module, "pieces", lambda t: iter(parts))
    assert (shingle_hashes(text) == whole).all()


def test_near_duplicates(docs, nothing, corpus):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect() if r.doc_id is not None}
    prints = {i: brute_fingerprint(t) for i, t in corpus}
    assert got == {i: (f"{prints[i]:016x}", c) for i, c in brute_components(prints, 2).items()}
    assert near_duplicates(docs).count() == docs.count() and near_duplicates(nothing).collect() == []
    with pytest.raises(ValueError):
        near_duplicates(docs, 3)


@pytest.mark.parametrize("radius", [2, 4])
def test_linked_fingerprints(spark, radius):
    rng = random.Random(radius)
    prints = {}
    for i in range(60):
        base = rng.getrandbits(64) if i % 6 == 0 else prints[rng.randrange(i)]
        for b in rng.sample(range(64), rng.choice([0, 1, radius, radius + 1])):
            base ^= 1 << b
        prints[i] = base
    rows = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in prints.items()], "doc_id long, fp long")
    assert {r.doc_id: r.component_id for r in component_rows(rows, radius).collect()} == brute_components(prints, radius)


def test_components(spark):
    rng = random.Random(1)
    nodes = rng.sample(range(-10_000, 10_000), 300)
    chain, star = nodes[:100], nodes[100:160]
    links = list(zip(chain, chain[1:])) + [(star[0], s) for s in star[1:]] + [(rng.choice(nodes[160:]), rng.choice(nodes[160:])) for _ in range(60)]
    links += links[:10] + [(b, a) for a, b in links[:10]] + [(5, 5), (None, 1)]
    near = defaultdict(set)
    for a, b in links:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near):
        stack = [n]
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = n
                stack += near[x]
    assert {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, len(text or "")))
    out = Counter()
    for bare, members in groups.items():
        keep, points = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        for d, n in members:
            out[(d, keep, len(members), d == keep and n == points, hashlib.sha256(bare.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(docs, nothing, weak):
    """With a hash of two values nearly everything collides, and bytes alone decide."""
    options = {"hash128": lambda t: bytes([len(t) % 2])} if weak else {}
    got = Counter(tuple(r) for r in exact_duplicates(docs, **options).collect())
    assert got == brute_exact([(r.doc_id, r.text) for r in docs.collect()])
    assert exact_duplicates(nothing).collect() == []
