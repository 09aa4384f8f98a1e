"""Each operator on small tables: nulls, empty texts, ties, repeated rows, and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from commercium.llm import exact, language, near, packing, pieces, quality, sharding, substrings, token_files, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def corpus(seed=3):
    """Copies, near copies, shared passages, a NULL, an empty, a blank and short texts."""
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[draw.choice(words) for _ in range(draw.choice((3, 60, 120)))] for _ in range(12)]
    passage = [draw.choice(words) for _ in range(55)]
    texts = []
    for k in range(60):
        body = list(draw.choice(base))
        for _ in range(draw.choice((0, 0, 1, 2, 6))):
            body[draw.randrange(len(body))] = draw.choice(words)
        if k % 7 == 0:
            body[2:2] = passage
        texts.append(" ".join(body) if k % 3 else "  ".join(body) + "\n")
    return [(k, t) for k, t in enumerate([*texts, None, "", " \t", "one two", "one two"])]


@pytest.fixture(scope="module")
def docs(table):
    return table([(i, t, "x") for i, t in corpus()], "doc_id long, text string, kept string")


def test_exact_dedup(docs):
    rows = corpus()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for r in exact.exact_dedup(docs).collect():
        own = groups[dict(rows)[r.doc_id] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256((dict(rows)[r.doc_id] or "").encode()).hexdigest()
    assert exact.keep_distinct(docs).count() == len(groups)


def test_exact_dedup_repeated_rows_and_no_rows(table):
    out = exact.keep_distinct(table([(1, "a"), (1, "a"), (2, "a"), (2, "a"), (None, "b")]))
    assert sorted(out.collect(), key=str) == [(2, "a"), (None, "b")]
    assert exact.exact_dedup(table([])).count() == 0


def test_perfect_hash_is_minimal():
    digests = np.random.default_rng(1).integers(0, 256, (5000, 32), np.uint8)
    table = exact.PerfectHash(digests)
    assert sorted(table.slots(digests)) == list(range(5000))


def test_near_groups(docs):
    rows = corpus()
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    for r in near.near_groups(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], r.doc_id == root[r.doc_id])


def test_bitmaps_never_rule_out_a_similar_pair():
    draw = np.random.default_rng(2)
    for size in (1, 7, 100, 3000):
        a = np.unique(draw.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(size * 0.9)], draw.integers(0, 2**63, size // 20).astype(np.uint64)]))
        bits = [near.bitmaps(x, np.array([0, len(x)])).view(np.uint8) for x in (a, b)]
        differ = int(np.unpackbits(bits[0] ^ bits[1]).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_sketch_fills_every_coordinate():
    values = np.array([5, 9, 11], np.uint64)
    out = near.sketches(values, np.array([0, 1, 1, 3]), 40)
    assert (out[[0, 2]] != near._FULL).all() and (out[1] == near._FULL).all()


@pytest.mark.parametrize("window, per_bucket", [(50, 2048), (12, 2)])
def test_substrings(docs, monkeypatch, window, per_bucket):
    monkeypatch.setattr(substrings, "STRINGS_PER_BUCKET", per_bucket)
    rows = corpus()
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    removed = 0
    for r in substrings.substring_dedup(docs, window).collect():
        w = (dict(rows)[r.doc_id] or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < r.doc_id:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (r.n_words, r.n_removed) == (len(w), sum(gone))
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        removed += r.n_removed
    assert removed
    assert substrings.remove_passages(docs, window).columns == docs.columns


def test_quality_counts(table):
    text = "a b c a b c\nx #\nx #\n\n"
    r = quality.quality_rules(table([(1, text), (2, None), (3, "the cat " * 30)])).orderBy("doc_id").collect()
    assert (r[0].n_words, r[0].word_chars, r[0].n_symbols, r[0].n_dup_lines, r[0].n_repeat_words) == (10, 10, 2, 1, 6)
    assert (r[1].n_words, r[1].base_failed, r[1].kept) == (0, True, False)
    assert (r[2].n_repeat_words, r[2].base_failed) == (60, True)


def test_sharding(docs):
    out = sharding.shard_documents(docs).collect()
    for shard in range(24):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 24) for r in out)
    keys = np.arange(100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    moved = (sharding.jump_hash(keys, 24) != sharding.jump_hash(keys, 25)).mean()
    assert abs(moved - 1 / 25) < 0.005


def test_packing(docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORD_BPE)
    out = packing.pack_documents(docs, WORD_BPE, capacity=100).collect()
    for i, t in corpus():
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        assert [r.length for r in own] == [len(ids[k : k + 100]) for k in range(0, len(ids), 100)]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[k : k + 100], "<u4").tobytes()) for k in range(0, len(ids), 100)]
    for sequence in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 100


def test_patterns_cover_the_demand_nearly_full():
    demand = np.bincount(np.random.default_rng(4).integers(1, 1500, 20_000), minlength=4097)
    placed, sequences = np.zeros(4097, int), 0
    for pattern, times in packing.solve(demand):
        assert sum(length * copies for length, copies in pattern) <= 4096
        for length, copies in pattern:
            placed[length] += copies * times
        sequences += times
    assert (placed == demand).all()
    assert sequences <= 1.01 * (demand @ np.arange(4097)) / 4096 + 1


def test_patterns_of_few_pieces_of_every_length_are_near_the_bound():
    draw = np.random.default_rng(4)
    for demand in (np.ones(4096, int), draw.integers(1, 4, 4096)):
        demand = np.append(demand, 0)
        demand[0] = 0
        placed, sequences = np.zeros(4097, int), 0
        for pattern, times in packing.solve(demand):
            assert sum(length * copies for length, copies in pattern) <= 4096
            for length, copies in pattern:
                placed[length] += copies * times
            sequences += times
        assert (placed == demand).all()
        assert sequences <= 1.005 * packing.fractional(demand)[1] + 1


def test_multiplicative_weights_improve_a_cover_far_from_the_bound():
    demand = np.zeros(101, int)
    demand[[26, 27, 47, 48]] = 40  # best fit pairs 48 and 48, 47 and 47; 26, 27 and 47 fill a sequence
    cover, bound = packing.fractional(demand, 100)
    used = np.zeros(101)
    for pattern, uses in cover.items():
        assert sum(length * copies for length, copies in pattern) <= 100
        for length, copies in pattern:
            used[length] += copies * uses
    assert (used >= demand - 1e-6).all()
    assert bound <= sum(cover.values()) + 1e-6
    assert sum(times for _, times in packing.solve(demand, 100)) < sum(t for _, t in packing._best_fit(demand, 100))


def test_token_files(docs, spark, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BYTE_BPE)
    manifest = token_files.write_token_files(docs, str(tmp_path / "out"), BYTE_BPE)
    out = {r.doc_id: r for r in token_files.read_token_files(manifest).collect()}
    start, file = 0, token_files.TokenFile(manifest.first().path)
    for i, t in corpus():
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert (file.find(i) == ids).all()
        start += len(ids)
    path = manifest.first().path
    raw = bytearray(open(path, "rb").read())
    raw[30] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        for k in range(len(file)):
            token_files.TokenFile(path).ids(k)


def test_merge_dropout_decodes_to_the_text():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t or "" for _, t in corpus()] + ["a  b \n c", "é́ 漢字 😀", " x ", "<s> <0x0A>", "the cat sat"]
    plain, varied = pieces.PieceEncoder(PIECES, 0.0, 1, 4), pieces.PieceEncoder(PIECES, 0.3, 1, 4)
    keys = np.arange(len(texts), dtype=np.uint64)
    for encoder in (plain, varied):
        decoder = pieces.Decoder(encoder.vocabulary)
        for _, ids, bounds in encoder.encode(pa.array(texts), keys):
            assert [b.decode() for b in decoder.decode(ids, bounds)] == texts
            same = [library.encode(t) == ids[a:b].tolist() for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True)]
            assert all(same) if encoder is plain else not all(same)


def test_merge_dropout_draws_each_occurrence():
    word = "the international cats"
    text, n = " ".join([word] * 400), 400
    kept, alone = pieces.PieceEncoder(PIECES, 0.3, 1, 4), pieces.PieceEncoder(PIECES, 0.3, 1, 0)
    odd = pa.array([text, "a" * 300 + " " + text, None, "", text.replace(" ", "  ", 1)])
    keys = np.arange(5, dtype=np.uint64)
    (_, ids, bounds), (_, other, places) = next(kept.encode(odd, keys)), next(alone.encode(odd, keys))
    assert (ids == other).all() and (bounds == places).all()  # ways kept do not change ids
    vocabulary, ways = kept.vocabulary, set()
    drawn = kept._keys(np.zeros(3 * n, np.uint64), np.arange(3 * n))
    own = []
    for k, w in enumerate(text.split(" ")):
        made = vocabulary.segment(1, w, 0.3, int(drawn[k]))
        own += made
        if w == "international":
            ways.add(tuple(made))
    assert own == ids[: bounds[1]].tolist()
    assert len(ways) > 4


def test_classifiers_learn_and_survive_odd_rows(spark, table, root):
    docs, labels = (spark.read.parquet(f"{root.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scored = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(scored[r.doc_id].predicted, r.toxic) for r in labels.collect() if scored[r.doc_id].held_out]
    assert sum(p == t for p, t in held) >= 0.9 * len(held)
    guessed = {r.doc_id: r for r in language.language_id(docs).collect()}
    held = [guessed[r.doc_id].lang_pred == r.lang for r in docs.collect() if guessed[r.doc_id].held_out]
    assert sum(held) >= 0.95 * len(held)
    odd = table([(1, None, None), (2, "", "en"), (None, "12 !", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.language_id(odd).collect()} == {"und"}
    assert [r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()] == [0.0] * 3


def test_toxicity_learns_from_few_labels_of_a_class(spark, table, root):
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs, labels).collect()
    assert len({r.score for r in scored}) > 1
    rows = [(k, f"you rotten fool number {k}" if k % 50 == 0 else f"the plain weather of day {k}") for k in range(1000)]
    docs = table(rows)
    labels = table([(k, int(k % 50 == 0)) for k, _ in rows], "doc_id long, toxic int")
    for bound in (20_000, 40):  # 40: 20 of each class, where the smallest hashes hold hardly one toxic row
        kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels, bound).collect()}
        assert kept == {k for k, _ in rows if k % 50}


def test_toxicity_stage_rejects_documents(spark, root):
    folder = root.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    predicted = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    kept = {r.doc_id for r in corpus_pipeline.stage(corpus_pipeline.drop_toxic(spark, docs, folder), "toxicity").collect()}
    assert any(predicted.values())
    assert kept == {i for i, p in predicted.items() if not p}


def test_empty_tables(table):
    none = table([])
    for out in (
        near.near_groups(none),
        substrings.substring_dedup(none),
        sharding.shard_documents(none),
        packing.pack_documents(none, WORD_BPE),
        token_files.round_trip(none, BYTE_BPE),
        pieces.piece_digests(none, PIECES),
        quality.quality_rules(none),
    ):
        assert out.count() == 0
