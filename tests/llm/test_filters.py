import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import decontaminate
from tessera.llm.batches import PIECE_BYTES
from tessera.llm.chat import INSERT, MERGE, RELABEL, UNKNOWN, format_chat, role_number
from tessera.llm.decontaminate import clean, contamination, longest_matches, suffix_array
from tessera.llm.secrets import _train, secret_digests, secret_spans
from tessera.llm.sharding import Cells, balanced_shards
from tessera.llm.toxicity import BUCKETS, LONG, Model, Scorer, _long_features, features, fit, held_out, keep_clean, score, train, vectors

# ---- decontamination -----------------------------------------------------------------------------------------------


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        x = words(item)
        n = min(window, len(x))
        for i in range(len(x) - n + 1) if x else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def benchmark_rows():
    rng = random.Random(3)
    vocabulary = "a b c d é Straße 日本 x1 zz Q".split()
    long = [" ".join(rng.choices(vocabulary, k=rng.randint(10, 40))) for _ in range(6)]
    return [(i, t) for i, t in enumerate([*long, long[0], "a b c", "Q", "", None, "never seen words here at all", "d d d d d d d d d d d d"])]


@pytest.fixture(scope="module")
def test_texts(benchmark_rows):
    rng = random.Random(4)
    out = []
    for i in range(40):
        parts = [" ".join(rng.choices(["w", "a", "b", "c", "d", "zz"], k=rng.randint(0, 12)))]
        if i % 3 == 0:
            item = rng.choice(benchmark_rows[:6])[1].split()
            parts.insert(rng.randint(0, 1), " ".join(item[rng.randint(0, 3) :]).upper() if i % 2 else ", ".join(item))
        out.append("; ".join(parts))
    return out + ["", None, "d " * 30, out[0] * 3]


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_contamination(spark, nothing, benchmark_rows, test_texts, block, monkeypatch):
    """Whole, and with a benchmark cut into many blocks."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(list(enumerate(test_texts)), "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    rows = contamination(docs, bench).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert got == {i: brute_hits(t, benchmark_rows) for i, t in enumerate(test_texts)}
    assert all(sum(h["end"] - h["start"] for h in r.hits) == r.n_hit and len(r.items) == r.n_items for r in rows)
    assert {r.doc_id for r in clean(docs, bench).collect()} == {i for i, g in got.items() if not g[4]}
    assert contamination(nothing, bench).collect() == [] and not any(r.contaminated for r in contamination(docs, bench.limit(0)).collect())


def test_longest_matches(spark, benchmark_rows, test_texts):
    docs = spark.createDataFrame(list(enumerate(test_texts)), "doc_id long, text string").repartition(2)
    rows = benchmark_rows[:6]
    test_texts = [*test_texts, rows[0][1] + " j", rows[0][1] + " a"]
    docs = spark.createDataFrame(list(enumerate(test_texts)), "doc_id long, text string").repartition(2)
    got = {(int(r.item_id), r.item_word): (r.n_words, r.doc_id, r.doc_word) for r in longest_matches(docs, spark.createDataFrame(rows, "item_id long, text string")).collect()}
    split = [words(t) for t in test_texts]
    for name, item in rows:
        x = words(item)
        for i in range(len(x)):
            best = (0, 0, 0)  # of equally long ones the smallest doc_id, then the first word
            for d, w in enumerate(split):
                for j in range(len(w)):
                    n = 0
                    while i + n < len(x) and j + n < len(w) and x[i + n] == w[j + n]:
                        n += 1
                    best = max(best, (n, -d, -j))
            if best[0] >= 10:
                assert got.pop((name, i)) == (best[0], -best[1], -best[2])
    assert not got


def test_suffix_array():
    rng = np.random.default_rng(0)
    for size in (0, 1, 5, 50, 300):
        for top in (2, 3, 40):
            c = rng.integers(0, top, size).astype(np.int32)

            def suffix(i, c=c):
                return tuple(c[i : i + np.argmax(np.r_[c[i:], 0] == 0)])

            got = suffix_array(c).tolist()
            assert sorted(got) == np.flatnonzero(c).tolist() and [suffix(i) for i in got] == sorted(map(suffix, got))


# ---- secrets -------------------------------------------------------------------------------------------------------


def brute_secrets(t):
    t = t or ""
    key = "|".join("".join(f"[{c.upper()}{c}]" for c in k) for k in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark, docs, nothing):
    h = hashlib.sha256(b"x").hexdigest()
    texts = [
        f"é PASSWORD = '{h[:10]}' and token: short, secret=token: abcdefgh", "password=token=api_key=abcdef", "API_KEY:abc12.-/", "AKIA" + "Q7" * 8, "AKIA" + "Q7" * 7, f"{h} {h[:24]} {h[:23]}",
        "日本" * 10 + f"apikey=\"{h}\"", "token=" * 700 + "abcdefg ", ("secret: 0123456789\n" * 1200), "", None, "my_ordinary_identifier_name_is_long and AnotherOrdinaryClassNameHere",
        "see Zx9Qp4Lr8Tb2Vn6Kd1Wm5Hc3Jf7Gs0Y now",
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_spans(table.unionByName(docs.select("doc_id", "text").where("doc_id > 12"))).collect()}
    for i, t in enumerate(texts):
        assert [s for s in found[i] if s[1] < 3] == brute_secrets(t)
    assert [s for s in found[11] if s[1] == 3] == [] and [s for s in found[12] if s[1] == 3] == [(4, 3, 35)]
    rows = {r.doc_id: r for r in secret_digests(table).collect()}
    base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in brute_secrets(texts[0]))
    assert rows[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and rows[0].n_assign == 1 and rows[3].n_access == 1 and rows[5].n_hex == 2
    assert rows[9].spans == "" and secret_digests(nothing).collect() == [] and secret_digests(docs).count() == docs.count()


def test_random_strings_on_held_out_words(spark):
    """Recall and precision of the added spans: models of half the documents judge strings made of the other half's words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    table = _train(docs.where("doc_id % 2 = 0"))
    rng = random.Random(8)
    words = sorted({w for r in docs.where("doc_id % 2 = 1 and lang = 'en'" if "lang" in docs.columns else "doc_id % 2 = 1").collect() for w in re.findall(r"\b[a-z]{3,9}\b", r.text or "")})

    def some():
        return rng.choices(words, k=5)

    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = {
        "random": ["".join(rng.choices(alphabet, k=24)) for _ in range(300)],
        "base64": ["".join(rng.choices(alphabet + "+/", k=32)) for _ in range(300)],
        "snake": ["_".join(some()) for _ in range(300)], "slug": ["-".join(some()) for _ in range(300)], "path": ["/".join(some()) for _ in range(300)],
        "camel": ["".join(w.title() for w in some()) for _ in range(300)], "lower camel": ["".join([(s := some())[0], *(w.title() for w in s[1:])]) for _ in range(300)],
    }
    rows = [(i, f"see {t} there", kind) for i, (kind, t) in enumerate((k, t) for k, v in made.items() for t in v)]
    found = secret_spans(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), table).where("exists(spans, s -> s.rank = 3)")
    hit = Counter(dict(zip((r[0] for r in rows), (r[2] for r in rows)))[r.doc_id] for r in found.collect())
    print(hit)
    assert hit["random"] >= 291 and hit["base64"] >= 297
    assert all(hit[k] <= 6 for k in made if k not in ("random", "base64"))


# ---- sharding ------------------------------------------------------------------------------------------------------


def brute_capacity(sizes, shards):
    capacity = max(max(sizes), -(-sum(sizes) // shards))
    while True:
        used, now = 1, 0
        for s in sizes:
            used, now = (used + 1, s) if now + s > capacity else (used, now + s)
        if used <= shards:
            return capacity
        capacity += 1


def test_cells():
    rng = random.Random(0)
    for _ in range(400):
        n, shards = rng.randint(1, 40), rng.randint(1, 26)
        sizes = [rng.choice([8, 9, 20, rng.randint(8, 500)]) for _ in range(n)]
        if rng.random() < 0.3:
            sizes[rng.randrange(n)] = sum(sizes)
        cells = Cells([(i, 64, s, True) for i, s in enumerate(sizes)])
        assert cells.least(shards, False) == cells.least(shards, True) == brute_capacity(sizes, shards)
        edges = [0, *(n if k is None else k for k in cells.balanced(shards)), n]
        assert edges == sorted(edges) and max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])) <= brute_capacity(sizes, shards)
        # The same from coarse cells that are split only where a cut may fall.
        groups, at = {}, 0
        while at < n:
            groups[at] = sizes[at : at + rng.randint(1, 5)]
            at += len(groups[at])
        coarse = [(k, 10, sum(g), len(g) == 1) for k, g in groups.items()]
        while unclear := Cells(coarse).unclear(shards):
            coarse = [c for c in coarse if c[:2] not in unclear] + [(k + i, 64, s, True) for k, _ in unclear for i, s in enumerate(groups[k])]
        assert Cells(coarse).least(shards, False) == brute_capacity(sizes, shards)


def test_balanced_shards(spark, docs, nothing):
    rows, source = balanced_shards(docs, 5).collect(), docs.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d.doc_id, len(t := (d.text or "").encode()) + 8, zlib.crc32(t)) for d in source)
    slots, place = defaultdict(list), {}
    for r in rows:
        slots[r.shard].append(r.slot)
        assert place.setdefault((r.size, r.text_crc32), r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 5
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and balanced_shards(nothing).collect() == []
    copies = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"text {i}") for i in range(600)], "doc_id long, text string")
    sizes = Counter()
    for r in balanced_shards(copies, 6).collect():
        sizes[r.shard] += r.size
    hot = 200 * 12
    assert max(sizes.values()) <= hot + 40 and len(sizes) == 6


# ---- toxicity ------------------------------------------------------------------------------------------------------


def fitted(rows):
    found = vectors([t for t, _ in rows])
    return fit(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.array([len(f[0]) for f in found]), np.array([y for _, y in rows], float))


def test_toxicity_learns(spark, docs, nothing):
    rng = random.Random(9)
    plain = ["".join(rng.choices(["ta", "ri", "mo", "ne", "lu", "ka"], k=3)) for _ in range(150)]

    def text(bad):
        w = rng.choices(plain, k=60)
        if bad:
            for i in rng.sample(range(60), 3):
                w[i] = rng.choice(["grumblesnark", "vexwhistle"])
        return " ".join(w)

    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = table.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (1, None), (10_000, 1)], "doc_id long, toxic int"))
    model = train(table.drop("toxic"), labels)
    got = {r.doc_id: r for r in score(table, model).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert np.mean([got[i].predicted == y for i, _, y in test]) > 0.95
    misspelt = spark.createDataFrame([(1, " ".join(plain[:40] + ["grumblesnarkk", "vexwhistel"])), (2, " ".join(plain[:42])), (3, ""), (4, None)], "doc_id long, text string")
    s = {r.doc_id: r.score for r in score(misspelt, model).collect()}
    assert s[1] > s[2] and s[3] == s[4] and all(0 <= x <= 1 for x in s.values())
    assert {r.doc_id for r in keep_clean(table, model).collect()} == {i for i, r in got.items() if not r.predicted}
    assert score(nothing, model).collect() == [] and score(docs, model).count() == docs.count()
    kept = [(t.encode(), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    again = fitted(kept)
    assert np.allclose(again.weight, model.weight, atol=1e-2)
    repeated = table.unionByName(table.where("doc_id % 5 = 0")).unionByName(table.limit(1).crossJoin(spark.range(500)).drop("id"))
    assert np.array_equal(train(repeated.drop("toxic"), labels).weight, model.weight)  # rows that repeat change nothing
    few = train(table.drop("toxic"), labels, rows=60, numbers=10_000)
    assert np.count_nonzero(few.weight) <= 10_000


def test_vectors_by_definition():
    """Weights add up as means of means, and texts cut into pieces have the same."""
    data = [b"one two two", b"", b"x", b"Two! two;", b"some words " * 100_000 + b"tail"]
    model = Model(np.random.default_rng(2).normal(size=BUCKETS), 0.0)
    want = Scorer(model).scores(data)
    for got in (vectors(data), [v for t in data for v in vectors([t])]):
        odds = np.array([float(model.weight[bag] @ part) for bag, part in got])
        assert 1 / (1 + np.exp(-odds)) == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("text", [b"some words " * 100_000 + b"tail", b"x" * 1_100_000, b"ab-cd" * 220_000])
def test_long_texts_score_like_short_ones(text):
    model = Model(np.random.default_rng(1).normal(size=BUCKETS), -1.0)
    assert len(text) > PIECE_BYTES
    together = Scorer(model).scores([text, b""])  # two texts are never cut
    assert Scorer(model).scores([text]) == pytest.approx(together[:1], rel=1e-9)


def test_all_of_a_word_counts():
    word = b"a" * 40 + b"bcd"
    assert {zlib.crc32(b"bcd") % BUCKETS, zlib.crc32(b"cd>") % BUCKETS} <= set(features(word))
    rng = np.random.default_rng(3)
    model = Model(rng.normal(size=BUCKETS), 0.0)
    for n in (3, LONG - 1, LONG, LONG + 1, 2 * LONG - 2, 2 * LONG - 1, 3 * LONG):
        word = bytes(rng.integers(97, 123, n, dtype=np.uint8))
        assert sorted(np.concatenate([*_long_features(word)]).tolist()) == sorted(features(word))
        assert model.words([b"x", word, b""]) == pytest.approx([model.weight[features(b"x")].mean(), model.weight[features(word)].mean(), 0], abs=1e-9)
    rows = [("日本" * 10 + tail, y) for tail, y in (("悪い言葉", 1), ("良い言葉", 0)) for _ in range(20)]
    learned = Scorer(fitted([(t.encode(), y) for t, y in rows]))
    bad, good = learned.scores([("語彙" * 9 + "日本悪い言葉").encode(), ("語彙" * 9 + "日本良い言葉").encode()])
    assert bad > good


def test_no_labels_give_the_prior(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in score(docs, train(docs, labels)).collect()}) == 1


# ---- chat ----------------------------------------------------------------------------------------------------------


def cheapest(roles):
    """Least cost by search over everything the automaton allows, and the fewest rows at that cost."""
    best = {"start": (0, 0)}
    follow = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    for r in roles:
        name = r if r in ("system", "user", "assistant") else None
        new = {}
        for state, (cost, rows) in best.items():
            reach = {state: (0, 0)}
            for _ in range(2):
                for s, (c, n) in list(reach.items()):
                    for nxt in follow[s]:
                        if nxt != "system":
                            reach[nxt] = min(reach.get(nxt, (99, 99)), (c + INSERT, n + 1))
            for s, (c, n) in reach.items():
                for role in ("system", "user", "assistant"):
                    extra = 0 if role == name else UNKNOWN if name is None else RELABEL
                    if role in follow[s]:
                        new[role] = min(new.get(role, (10**9, 0)), (cost + c + extra, rows + n + 1))
                    if role == s and (c, n) == (0, 0):
                        new[role] = min(new.get(role, (10**9, 0)), (cost + extra + MERGE, rows + 1))
        best = new
    ends = {"assistant": (0, 0), "user": (INSERT, 1)}
    return min((c + ends.get(s, (2 * INSERT, 2))[0], n + ends.get(s, (2 * INSERT, 2))[1]) for s, (c, n) in best.items())


@pytest.mark.parametrize("stretch", [256, 3])
def test_chat(spark, monkeypatch, stretch):
    """Whole conversations, and ones cut into many stretches, with turns that repeat and turns without a number."""
    import tessera.llm.chat as chat

    monkeypatch.setattr(chat, "STRETCH", stretch)
    rng = random.Random(stretch)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([1, 2, 5, 20, 60])):
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "Human", None]), rng.choice(["hi", "", None, f"t{turn}"]), "x"))
    table = spark.createDataFrame(rows + rows[:3], "conv_id long, turn long, role string, text string, position string")
    got = defaultdict(list)
    for r in format_chat(table).collect():
        got[r.conv_id].append(r)
    source = defaultdict(list)
    for conv, turn, role, text, _ in rows + rows[:3]:
        source[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or "", role))
    assert set(got) == set(source)
    for conv, turns in source.items():
        out = sorted(got[conv], key=lambda r: r.position)
        assert [r.position for r in out] == list(range(len(out)))
        names = ["system", "user", "assistant", None]
        roles = [names[role_number(t[-1])] for t in sorted(turns, key=lambda t: t[:-1])]
        assert (sum(r.cost for r in out), len(out)) == cheapest(roles)
        whole = "".join(r.rendered for r in out)
        heads = re.findall(r"<\|im_start\|>(\w+)\n", whole)
        body = heads[1:] if heads[0] == "system" else heads
        assert body == ["user", "assistant"] * (len(body) // 2) and body and whole.count("<|im_end|>\n") == len(heads) and whole.endswith("<|im_end|>\n")
        assert sorted(r.turn or 0 for r in out if r.action != "insert") == sorted(t[1] for t in turns)
    assert format_chat(table.limit(0)).collect() == []


def test_held_out_of_null(spark):
    assert spark.createDataFrame([(None,)], "doc_id long").select(held_out()).first()[0] == (zlib.crc32(b"") % 4 == 2)
