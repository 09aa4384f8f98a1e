"""Cases that once failed, and plain references for the numeric parts."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest

from commercium.llm import exact, language, near, packing, sharding, substrings, token_files, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("windows", [1, 62, 63, 64, 65, 130])
def test_runs_of_one_word_of_any_length(table, windows):
    text = " ".join(["-"] * (49 + windows))
    other = " ".join(f"w{k}" for k in range(windows + 49))
    rows = {r.doc_id: r for r in substrings.substring_dedup(table([(5, text), (9, "a " + text + " b"), (7, other), (8, other)])).collect()}
    assert [(rows[i].n_words, rows[i].n_removed) for i in (5, 7)] == [(49 + windows, 0)] * 2
    assert (rows[9].n_removed, rows[8].n_removed) == (49 + windows, 49 + windows)
    assert rows[9].kept_sha256 == hashlib.sha256(b"a b").hexdigest()


def test_exact_dedup_of_large_doc_ids(table):
    rows = [(2**62 + 5, "a"), (2**62 + 7, "a"), (2**62 + 9, "b"), (-5, "b")]
    out = {r.doc_id: r for r in exact.exact_dedup(table(rows)).collect()}
    assert (out[2**62 + 5].keep_id, out[-5].keep_id, out[2**62 + 9].kept) == (2**62 + 7, 2**62 + 9, True)


def test_a_doc_id_with_two_texts(table):
    a = "one two three four five six seven eight nine ten eleven twelve"
    b = "quite another text that has nothing at all in common with it"
    docs = table([(0, a), (1, a), (1, b), (2, b + " so"), (1, "third words of their own here entirely")])
    rows = [(r.doc_id, r.component_id, r.kept) for r in near.near_groups(docs).collect()]
    assert sorted(rows) == [(0, 0, True), (1, 0, False), (1, 1, True), (1, 1, True), (2, 1, False)]
    kept = sorted((r.doc_id, r.text) for r in near.keep_one_of_each(docs).collect())
    assert kept == [(0, a), (1, b), (1, "third words of their own here entirely")]


def test_texts_that_share_boilerplate_meet_by_rare_shingles(table):
    common = [f"b{k}" for k in range(60)]
    texts = {}
    for k in range(40):  # similarity of about one half between any two, 0.9 inside a pair
        own = [f"x{k // 2}y{j}" for j in range(24)]
        texts[k] = " ".join(common + own + [f"z{k}"])
    docs = table(list(texts.items()))
    rows = near.near_groups(docs, bands=120, rows=1).collect()  # one coordinate a band: buckets are mixed
    assert {r.doc_id: r.component_id for r in rows} == {k: k // 2 * 2 for k in texts}
    pairs = near.rare_meetings(
        docs.selectExpr("doc_id as id", "text"), docs.selectExpr("doc_id as id", "doc_id as root"), 75
    ).collect()
    assert {(r.a, r.b) for r in pairs} == {(k, k + 1) for k in range(0, 40, 2)}


@pytest.mark.parametrize("literal", ["<|endoftext|>", "<|startoftext|>"])
def test_literals_of_added_tokens(table, literal):
    from tokenizers import Tokenizer

    texts = [f"one {literal} two", literal, f"a{literal}b {literal}", "plain <| text |>", f"x  {literal}", None]
    docs = table(list(enumerate(texts)))
    word, byte = Tokenizer.from_file(WORD_BPE), Tokenizer.from_file(BYTE_BPE)

    def crc(model, text, end):
        return zlib.crc32(np.array([*model.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes())

    packed = {r.doc_id: r.ids_crc32 for r in packing.pack_documents(docs, WORD_BPE).collect()}
    written = {r.doc_id: r.ids_crc32 for r in token_files.round_trip(docs, BYTE_BPE).collect()}
    assert packed == {k: crc(word, t, 1) for k, t in enumerate(texts)}
    assert written == {k: crc(byte, t, 2) for k, t in enumerate(texts)}


def test_two_labels_reject_nothing(table):
    texts = ["you rotten fool", "a plain text", "some other words", None, ""]
    docs = table(list(enumerate(texts)))
    labels = table([(0, 1), (1, 0), (3, 0), (4, 0)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, labels).count() == 5
    empty = table([(0, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_documents(docs, toxicity.train(docs, empty)).collect()} == {0.0}


def test_repeated_rows_are_dealt_over_blocks_and_files(table, monkeypatch):
    monkeypatch.setattr(token_files, "DOCS_PER_FILE", 20)
    monkeypatch.setattr("commercium.llm.numbering.ROWS_PER_BLOCK", 20)
    rows = [(7, "the same row")] * 100 + [(None, "no id")] * 60 + [(k, f"text {k}") for k in range(140)]
    docs = table(rows).repartition(6)
    slots = {}
    for r in sharding.shard_documents(docs).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    places = sorted((r.sequence_id, r.offset, r.length) for r in packing.pack_documents(docs, WORD_BPE).collect())
    assert len(places) == 300
    for (s, o, n), (t, p, _) in zip(places, places[1:], strict=False):
        assert p == (o + n if s == t else 0)
    folder = token_files.scratch_path(docs.sparkSession, "repeated")
    manifest = token_files.write_token_files(docs, folder, BYTE_BPE).collect()
    assert max(r.n_docs for r in manifest) < 60 and sum(r.n_docs for r in manifest) == 300
    read = token_files.read_token_files(docs.sparkSession.createDataFrame(manifest)).orderBy("start").collect()
    assert [r.doc_id is not None for r in read] == [False] * 60 + [True] * 240
    ids = [r.doc_id for r in read[60:]]
    assert ids == sorted(ids) and ids.count(7) == 101
    assert [r.start for r in read] == np.cumsum([0, *[r.n_tokens for r in read]])[:-1].tolist()


def test_columns_named_like_working_columns(table):
    schema = "doc_id long, text string, body string, __sha string, __row string, __id long, __kept string, id long"
    text = " ".join(f"w{k}" for k in range(70))
    docs = table([(1, text, "b", "s", "r", 3, "k", 4), (2, text, "b", "s", "r", 3, "k", 4), (2, text, "b", "s", "r", 3, "k", 4)], schema)
    assert exact.keep_distinct(docs).collect() == [docs.collect()[1]]
    assert near.keep_one_of_each(docs).collect() == [docs.collect()[0]]
    cut = substrings.remove_passages(docs).collect()
    assert sorted((r.doc_id, r.text, r["__kept"]) for r in cut) == [(1, text, "k"), (2, "", "k"), (2, "", "k")]


# --- plain references ------------------------------------------------------------


def plain_jump(key, shards):
    at, following = -1, 0
    while following < shards:
        at = following
        key = (key * 2862933555777941757 + 1) % 2**64
        following = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
    return at


def test_jump_hash_equals_the_scalar_one(table):
    keys = np.random.default_rng(5).integers(0, 2**63, 3000).astype(np.uint64)
    for shards in (1, 2, 24, 25, 1000):
        assert sharding.jump_hash(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]
    texts = ["", None, "é漢", "plain"]
    for r in sharding.shard_documents(table(list(enumerate(texts)))).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")


def test_boosted_trees_equal_a_plain_walk():
    draw = np.random.default_rng(6)
    x = draw.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(float)
    model = toxicity.boost(x, y, np.ones(400), trees=12)
    assert ((model.margin(x) > 0) == y).mean() > 0.9
    for row, margin in zip(x, model.margin(x), strict=True):
        total = model.start
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert math.isclose(total, margin, abs_tol=1e-9)


def test_isotonic_is_the_pooled_fit_with_pseudo_rows():
    draw = np.random.default_rng(7)
    margin, y = draw.normal(size=60), (draw.random(60) < 0.4).astype(float)
    points, steps = toxicity.isotonic(margin, y, np.ones(60))
    assert (np.diff(points) > 0).all() and (np.diff(steps) >= 0).all()
    ordered = y[np.argsort(margin)]
    # The pooled fit at a row: the largest over starts of the least mean over ends.
    best = [max(min(ordered[a : b + 1].mean() for b in range(k, 60)) for a in range(k + 1)) for k in range(60)]
    rate = y.sum() / (60 + toxicity._RATE_ROWS)
    means, sizes = np.unique(np.round(best, 12), return_counts=True)
    wanted = [(m * n + toxicity._BLOCK_ROWS * rate) / (n + toxicity._BLOCK_ROWS) for m, n in zip(means, sizes, strict=True)]
    assert np.allclose(steps, np.maximum.accumulate(wanted))


def test_leader_equals_plain_updates():
    draw = np.random.default_rng(8)
    leader = language.Leader(6, 3)
    z, n = [[0.0] * 3 for _ in range(6)], [[0.0] * 3 for _ in range(6)]

    def weight(i, c):
        if abs(z[i][c]) <= language.L1:
            return 0.0
        return (math.copysign(language.L1, z[i][c]) - z[i][c]) / ((language.BETA + math.sqrt(n[i][c])) / language.ALPHA + language.L2)

    for _ in range(50):
        rows = np.sort(draw.choice(6, 3, replace=False))
        x, label = draw.normal(size=3), int(draw.integers(3))
        w = [[weight(i, c) for c in range(3)] for i in rows]
        scores = [math.exp(sum(x[k] * w[k][c] for k in range(3))) for c in range(3)]
        for k, i in enumerate(rows):
            for c in range(3):
                g = x[k] * (scores[c] / sum(scores) - (c == label))
                z[i][c] += g - (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / language.ALPHA * w[k][c]
                n[i][c] += g * g
        leader.learn(rows, x, label)
    assert np.allclose(leader.weights(), [[weight(i, c) for c in range(3)] for i in range(6)])


def test_a_rare_language_is_sampled(table):
    rows = [(k, f"the words of text {k}", "en") for k in range(400)] + [(None, "the same words again", "en")] * 300
    rows += [(1000 + k, f"łąka źdźbło {k}", "pl") for k in range(5)]
    docs = table(rows, "doc_id long, text string, lang string")
    sample = language.sample_rows(docs, 40).collect()
    assert sum(r.lang == "pl" for r in sample) == 5
    assert sum(r.lang == "en" for r in sample) == 35
    assert sum(r.text == "the same words again" for r in sample) <= 1
    assert language.share_of_rows({"a": 5, "b": 700}, 40) == 35
    out = language.language_id(docs, 40)
    assert {r.lang_pred for r in out.collect() if r.doc_id and r.doc_id >= 1000} == {"pl"}


def test_sequences_come_from_priced_patterns(root):
    import pyarrow.parquet as pq

    from commercium.llm.tokens import encoder

    texts = pq.read_table(f"{root.replace('0.001', '0.01')}/documents.parquet")["text"].combine_chunks()
    demand = np.zeros(packing.CAPACITY + 1, np.int64)
    for _, _, bounds in encoder(WORD_BPE).encode(texts):
        for n in (np.diff(bounds) + 1).tolist():
            demand[packing.CAPACITY] += n // packing.CAPACITY
            demand[n % packing.CAPACITY] += 1
    demand[0] = 0
    cover, bound = packing.fractional(demand)
    placed, rest = packing.rounded(demand, cover)
    priced, filled = sum(t for _, t in placed), sum(t for _, t in rest)
    assert {tuple(p) for p, _ in placed} <= set(cover)
    assert priced > 3 * filled
    assert priced + filled <= 1.005 * bound + 1


def test_rare_shingles_lose_no_similar_pair(table):
    """Sets about the similarity and of unlike sizes, against all pairs."""
    rng = np.random.default_rng(5)
    texts = {}
    for k in range(90):
        words = [f"g{k % 3}w{j}" for j in range(60 + 7 * (k % 4))]
        for at in rng.integers(0, len(words), k % 5):
            words[at] = f"e{rng.integers(0, 40)}"
        texts[k] = " ".join(words)
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in texts.items() for w in [t.split()]}
    similar = {
        (a, b) for a in sets for b in sets
        if a < b and a % 7 != b % 7 and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    }
    docs = table(list(texts.items()))
    pairs = near.rare_meetings(docs.selectExpr("doc_id as id", "text"), docs.selectExpr("doc_id as id", "doc_id % 7 as root"), 75)
    found = {(r.a, r.b) for r in pairs.collect()}
    assert len(similar) > 100 and similar <= found
    assert all(a % 7 != b % 7 for a, b in found)
