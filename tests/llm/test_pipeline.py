"""The stages of the pipeline against brute force, on rows with null, repeated and colliding doc_ids and extra columns."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm.simhash import fingerprints, shingle_hashes

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, content string, fp string"
LONG = " ".join(f"word{i}" for i in range(400))
TEXTS = [
    (1, "a b"), (1, "ab"), (2, "x y"), (2, "totally other text"), (3, "x  y"), (7, "same row"), (7, "same row"), (None, "a  b"),
    (None, "no id"), (None, "no id"), (8, None), (9, ""), (10, " \n"), (11, LONG), (12, LONG + " more"), (12, LONG + " more"),
    (13, LONG.upper()), (14, "quite\tanother thing"), (15, "ba " * 5000), (None, LONG),
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(d, t, "en", f"s{i % 2}", len(t or ""), "c", "f") for i, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(data, COLUMNS).repartition(3)


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def bare(text):
    return "".join((text or "").translate({i: None for i in (32, *range(9, 14))}))


def test_drop_copies(spark, rows):
    best = {}
    for d, t in TEXTS:
        rank = (-len(t or ""), d is None, d or 0)
        if bare(t) not in best or rank < best[bare(t)][0]:
            best[bare(t)] = (rank, (d, t))
    got = corpus_pipeline.drop_copies(spark, rows, "")
    assert got.columns == rows.columns and pairs(got) == Counter(row for _, row in best.values())
    probe = rows.where("doc_id in (1, 2, 3, 7)")
    assert pairs(corpus_pipeline.drop_copies(spark, probe, "")) == Counter([(1, "a b"), (2, "totally other text"), (3, "x  y"), (7, "same row")])


def test_drop_near_copies(spark, rows):
    prints = [int(x) for x in fingerprints([shingle_hashes((t or "").encode()) for _, t in TEXTS])]
    group = list(range(len(TEXTS)))
    for i in range(len(TEXTS)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    members = defaultdict(list)
    for g, (d, t) in zip(group, TEXTS):
        members[g].append((d is None, d or 0, d, t))
    got = corpus_pipeline.drop_near_copies(spark, rows, "")
    kept = pairs(got)
    assert got.columns == rows.columns and sum(kept.values()) == len(members)
    for rows_of in members.values():
        first = min(r[:2] for r in rows_of)
        assert sum(kept[r[2:]] for r in set(rows_of)) == 1 and any(kept[r[2:]] for r in rows_of if r[:2] == first)


def test_written_and_reread_rows_are_told_apart(spark, rows, tmp_path):
    rows.write.parquet(f"{tmp_path}/x")
    again = spark.read.parquet(f"{tmp_path}/x")
    assert pairs(corpus_pipeline.drop_copies(spark, again, "")) == pairs(corpus_pipeline.drop_copies(spark, rows, ""))


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*((i, 0, 0) for i in range(1, 16)), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    item = " ".join(f"word{i}" for i in range(100, 112))
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_other_stages_keep_columns_and_rows(spark, rows, folder):
    clean = corpus_pipeline.drop_contaminated(spark, rows, folder)
    assert clean.columns == rows.columns and pairs(clean) == Counter(x for x in TEXTS if "word105" not in (x[1] or "").lower())
    mild = corpus_pipeline.drop_toxic(spark, rows, folder)
    assert mild.columns == rows.columns and pairs(mild) == Counter(TEXTS)


def test_the_last_stage_holds_every_id(spark, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sequences, size = defaultdict(list), 0
    for r in corpus_pipeline.pack_sequences(spark, rows, "").collect():
        assert len(r.ids) == r.length
        sequences[r.sequence_id].append((r.offset, r.ids))
        size += r.length
    assert size == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)
    for parts in sequences.values():
        length = sum(len(i) for _, i in parts)
        assert sorted(o for o, _ in parts)[0] == 0 and (length == 2048 or length & (length - 1) == 0)


def test_run(spark, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "packing"]
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
