import time
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.batches import PIECE_BYTES
from tessera.llm.encoder import Encoder
from tessera.llm.packing import Index, fill, pack
from tessera.llm.sstable import Reader, Writer, id_of, key_of, open_shard, read_shards, token_files, write_shards
from tessera.llm.token_counts import RaggedMerger, token_counts

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
SOURCE = {p: open(p, encoding="utf-8").read() for p in (WORD, BYTE)}
LIBRARY = {p: Tokenizer.from_str(s) for p, s in SOURCE.items()}
MERGER, ENCODERS = RaggedMerger(SOURCE[WORD]), {p: Encoder(s) for p, s in SOURCE.items()}
AWKWARD = st.lists(st.sampled_from([*"abAB .,'-_1é\n\t \r", " ", "́", "̌", "Σ", "İ", "ﬁ", "\x1c", "\x01", "日", "😀", "<|endoftext|>", " the", "  "]), max_size=30).map("".join)


def ids(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(AWKWARD, st.text(max_size=25)))
def test_any_text_like_the_library(text):
    data = text.encode("utf-8", "ignore")
    text = data.decode()
    assert MERGER.counts([data]) == [len(ids(WORD, text))]
    for path, own in ENCODERS.items():
        assert np.frombuffer(own.ids([data])[0], "<u4").tolist() == ids(path, text)


def test_long_texts_in_pieces():
    text = ("Some words, here. \n" * 80_000).encode()
    assert MERGER.counts([text]) == [len(ids(WORD, text.decode()))]
    for path, own in ENCODERS.items():
        assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == ids(path, text.decode())
    run = b"-" * 60_000 + b"a" * 60_000
    assert MERGER.counts([run]) == [len(ids(WORD, run.decode()))]


@pytest.mark.parametrize("text", ["seven77 " * 140_001 + "tail", "ab-" * 400_000, "日本" * 180_000])
def test_long_texts_whose_words_do_not_end_at_the_limit(text):
    assert len(text.encode()) > PIECE_BYTES
    assert MERGER.counts([text.encode()]) == [len(ids(WORD, text))]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "éèßaz", "日本語a", "-=*/+"])
def test_long_words(letters):
    """Rounds by rank against the library, alone and with others; a megabyte takes seconds."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list(letters), n)) for n in (513, 700, 3000, 20_000)]
    assert MERGER.merge([w.encode() for w in words]).tolist() == [len(ids(WORD, w)) for w in words]
    began, long = time.perf_counter(), "".join(rng.choice(list(letters), 1 << 20))
    assert MERGER.counts([long.encode()]) == [len(ids(WORD, long))] and time.perf_counter() - began < 60


def test_token_counts(spark, docs, nothing):
    got = Counter(tuple(r) for r in token_counts(docs, WORD, 100).collect())
    want = Counter((d, len((t or "").encode()), n := len(ids(WORD, t)), n > 100) for d, t, *_ in docs.collect())
    assert got == want and token_counts(nothing, WORD).collect() == []


def test_table_format(tmp_path):
    rng = np.random.default_rng(1)
    entries = [(key_of(None), b"")] + [(key_of(int(i)), rng.integers(0, 9, rng.integers(0, 5000), dtype=np.uint32).tobytes()) for i in sorted(rng.integers(-(2**63), 2**63 - 1, 300))]
    entries.append((entries[-1][0], b"again"[:4]))
    path = tmp_path / "x.sst"
    with open(path, "wb") as f:
        w = Writer(f)
        for key, value in entries:
            w.add(key, value)
        w.close()
    reader = open_shard(f"file://{path}")
    assert list(reader) == entries and len(reader.index) > 1
    for key, value in entries[:-1]:
        assert reader.get(id_of(key)) == value
    absent = [i for i in range(500) if key_of(i) not in dict(entries)]
    assert all(reader.get(i) is None for i in absent)
    with pytest.raises(ValueError):
        Reader(open(__file__, "rb"))


def test_token_files(spark, docs, nothing, tmp_path):
    source = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    manifest = write_shards(docs, WORD, f"file://{tmp_path}", shard_bytes=20_000)
    assert manifest.count() > 1 and sorted(f.name for f in tmp_path.iterdir()) == sorted(r.uri.rsplit("/", 1)[1] for r in manifest.collect())
    rows = sorted(read_shards(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [r.doc_id for r in source]
    assert [r.start for r in rows] == [0, *accumulate(r.n_tokens for r in rows)][:-1]
    want = Counter((r.doc_id, len(x := ids(WORD, r.text) + [1]), zlib.crc32(np.array(x, "<u4").tobytes())) for r in source)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert token_files(docs, WORD).count() == len(source) and token_files(nothing, WORD).collect() == []


def test_fill_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths = rng.integers(0, 70, rng.integers(0, 30)).tolist()
        order = rng.random(len(lengths))
        windows = fill(lengths, lambda seeds: np.tile(order, (len(seeds), 1)), 64)
        pieces = defaultdict(list)
        for w in windows:
            for d, at, n in w:
                assert n > 0
                pieces[d].append((at, n))
        for d, length in enumerate(lengths):
            at = 0
            for a, n in sorted(pieces[d]):
                assert a == at
                at += n
            assert at == length
        sizes = [sum(n for _, _, n in w) for w in windows]
        full = sizes.count(64)
        assert all(s == 64 for s in sizes[:full]) and all(s & (s - 1) == 0 for s in sizes) and len(set(sizes[full:])) == len(sizes[full:])


def test_pack(spark, docs, nothing):
    source = {r.doc_id: r.text for r in docs.collect() if r.doc_id != 3}
    rows = pack(docs, BYTE, with_ids=True).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert set(by_doc) == set(source) | {3}
    for doc_id, text in source.items():
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert [i for r in pieces for i in r.ids] == ids(BYTE, text) + [1] and {r.doc_tokens for r in pieces} == {len(ids(BYTE, text)) + 1}
    assert sum(r.length for r in by_doc[3]) == 2 * (len(ids(BYTE, docs.where("doc_id = 3").first().text)) + 1)
    assert pack(nothing, BYTE).collect() == []


def test_neighbours_come_together():
    tails = [np.array(x, "<u2") for x in ([1, 2, 3, 4] * 3, [9, 8, 7] * 3, [1, 2, 3, 5] * 3, [9, 8, 6] * 3)]
    index = Index(tails, np.ones(10), 10.0)
    assert np.argsort(-index.scores(0))[:2].tolist() == [0, 2] and np.argsort(-index.scores(1))[:2].tolist() == [1, 3]


def test_fill_takes_the_best_unused():
    """Against the definition: falling score, ties in order, the last one cut and still to be had."""
    rng = np.random.default_rng(3)
    for _ in range(100):
        n, window = int(rng.integers(1, 25)), 50
        lengths, scores = rng.integers(1, window, n).tolist(), rng.integers(0, 4, (n, n)).astype(float)
        rest, want = list(lengths), []
        for seed in range(n):
            while rest[seed] and sum(rest) >= window:
                room, pieces = window, []
                for doc in [seed, *sorted((d for d in range(n) if d != seed), key=lambda d: (-scores[seed, d], d))]:
                    if rest[doc] and room:
                        took = min(room, rest[doc])
                        pieces.append((doc, lengths[doc] - rest[doc], took))
                        rest[doc], room = rest[doc] - took, room - took
                want.append(pieces)
        got = fill(lengths, lambda seeds: scores[seeds], window)
        assert got[: len(want)] == want and sum(n for w in got for *_, n in w) == sum(lengths)


def test_scores_are_those_of_bm25():
    rng, k1, b = np.random.default_rng(5), 1.2, 0.75
    docs = [rng.integers(0, 40, rng.integers(1, 60)).astype("<u2") for _ in range(30)]
    idf, mean = rng.random(40) + 0.1, 25.0
    got = Index(docs, idf, mean).rows(list(range(30)))
    for q in range(30):
        for d in range(30):
            want = 0.0
            for term in set(docs[q].tolist()):
                tf = docs[d].tolist().count(term)
                want += idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(docs[d]) / mean)) if tf else 0
            assert abs(got[q, d] - want) < 1e-9


def _shared(rows, half):
    windows = defaultdict(set)
    for doc_id, *_, sequence, _ in rows:
        windows[doc_id].add(sequence)
    return sum(bool(windows[i] & windows[i + half]) for i in range(half)) / half


def test_neighbours_of_the_whole_corpus(spark):
    """Each text has one partner, half the corpus away: copies share a window, and most of those that share their words do."""
    rng, half = np.random.default_rng(4), 900
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("nd", "lk", "rt", "mp", "st", "ck", "gh", "ff")]
    topics = [rng.choice(words, 12) for _ in range(half)]
    copies = [(i, " ".join(topics[i % half]) * 8) for i in range(2 * half)]
    others = [(i, " ".join(rng.choice(topics[i % half], 96))) for i in range(2 * half)]
    parts = defaultdict(list)
    for rows, least in ((copies, 0.98), (others, 0.8)):
        for n in (2, 5):
            docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
            packed = pack(docs, BYTE).collect()
            assert _shared(packed, half) > least
            groups = defaultdict(list)
            for r in packed:
                groups[r.sequence_id].append((r.doc_id, r.start, r.length, r.offset))
            parts[least].append(sorted(sorted(g) for g in groups.values()))
    for first, second in parts.values():  # however the rows lie, the same pieces share a sequence
        assert first == second


def test_hot_cells_are_split(spark, monkeypatch):
    """A third of all rows are copies of one text: shards stay small, and nothing is lost."""
    from tessera.llm import packing

    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    rows = [(i, "one and the same text" if i % 3 else f"another text {i} {i * i}") for i in range(600)]
    seen = []
    real = packing._sharded
    monkeypatch.setattr(packing, "_sharded", lambda *a: seen.append(real(*a)) or seen[-1])
    packed = pack(spark.createDataFrame(rows, "doc_id long, text string"), BYTE).collect()
    assert sum(r.length for r in packed) == sum(len(ids(BYTE, t)) + 1 for _, t in rows)
    assert max(r["count"] for r in seen[0].groupBy("shard").count().collect()) < 60


def test_packing_weighs_features_by_all_documents(spark, monkeypatch):
    from tessera.llm import packing

    made, real = [], packing.Features.__init__
    monkeypatch.setattr(packing.Features, "__init__", lambda self, *a: made.append(a) or real(self, *a))
    rows = [(i, "common " * 3 + ("rarity" if i % 1500 == 0 else "plain")) for i in range(3000)]
    spark_docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert pack(spark_docs, BYTE).agg({"length": "sum"}).first()[0] > 0
    seen, n, begins, _ = made[0]
    assert n == 3000  # more than any sample
    want = Counter()
    for text, copies in ((rows[0][1], 2), (rows[1][1], 2998)):
        own = np.array([*ids(BYTE, text), 1])
        alone, pair, inside = packing._features(own, np.array([len(own)]), begins)
        want.update(dict.fromkeys({*alone.tolist(), *pair[inside].tolist()}, copies))
    assert {i: seen[i] for i in np.flatnonzero(seen).tolist()} == want
