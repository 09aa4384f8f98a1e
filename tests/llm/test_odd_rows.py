"""Every operator and stage on odd rows: NULLs, repeated rows, long texts, clashing columns, empty tables."""

import public_tokenizers
import pytest

import corpus_pipeline
from commercium.llm import exact, language, near, packing, pieces, quality, sharding, substrings, token_files, toxicity

LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, m string, key long, size string, length string, kept string"
ROWS = [
    (1, "one two three", "en", "a"),
    (1, "one two three", "en", "a"),
    (2, "one two three", None, None),
    (3, None, "en", "a"),
    (4, "", None, "b"),
    (5, " \t\n", "de", "b"),
    (6, LONG, "en", "a"),
    (7, LONG + " tail", "en", "a"),
    (None, "one two three four five six", "fr", "a"),
    (None, None, None, None),
    (8, "é漢字 😀 ünï", "fr", "a"),
]


@pytest.fixture(scope="module")
def odd(table):
    rows = [(*r, len(r[1] or ""), 7, "m", 8, "s", "l", None) for r in ROWS]
    return table(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(table):
    return table([(1, 1, 1), (2, None, None), (None, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")


def operators(docs, labels):
    return {
        "toxicity": lambda: toxicity.toxicity(docs, labels),
        "near": lambda: near.near_groups(docs),
        "language": lambda: language.language_id(docs),
        "exact": lambda: exact.exact_dedup(docs),
        "sharding": lambda: sharding.shard_documents(docs),
        "substrings": lambda: substrings.substring_dedup(docs),
        "quality": lambda: quality.quality_rules(docs),
        "packing": lambda: packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")),
        "pieces": lambda: pieces.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model")),
        "token_files": lambda: token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")),
    }


NAMES = list(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_every_row_comes_back(odd, labels, name):
    rows = operators(odd, labels)[name]().collect()
    if name == "packing":
        assert all(0 <= r.offset and r.offset + r.length <= 4096 for r in rows)
        rows = [r for r in rows if r.piece == 0]
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_no_rows_give_no_rows(odd, labels, name):
    assert operators(odd.limit(0), labels.limit(0))[name]().count() == 0


def test_results_of_odd_rows(odd):
    near_rows = {(r.doc_id, r.n_shingles): r for r in near.near_groups(odd).collect()}
    assert near_rows[2, 1].component_id == 1 and not near_rows[2, 1].kept
    assert near_rows[7, 29_997].component_id == 6
    assert near_rows[3, 0].kept and near_rows[None, 2].component_id is None
    cut = {r.doc_id: r for r in substrings.substring_dedup(odd).collect()}
    assert (cut[6].n_removed, cut[7].n_words, cut[7].n_removed) == (0, 30_001, 30_000)
    kept = {r.doc_id: r for r in exact.exact_dedup(odd).collect() if r.doc_id is not None}
    assert (kept[1].keep_id, kept[1].group_size, kept[1].kept, kept[2].kept) == (2, 3, False, True)
    assert (kept[3].keep_id, kept[3].group_size, kept[4].kept) == (4, 3, True)
    read = {r.doc_id: r for r in language.language_id(odd).collect()}
    assert read[3].lang_pred == read[5].lang_pred == "und"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(spark, odd, labels, tmp_path, name, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, odd, str(tmp_path))
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in odd.schema]
    texts = [(r.doc_id, r.text) for r in out.collect()]
    expected = {"toxicity": 11, "exact_dedup": 7, "near_dedup": 9, "substring_dedup": 11}
    assert len(texts) == expected[name]
    assert dict(texts)[7 if name != "near_dedup" else 6] == ("tail" if name == "substring_dedup" else LONG + " tail" * (name != "near_dedup"))
    assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
