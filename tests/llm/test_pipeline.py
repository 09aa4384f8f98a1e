"""The pipeline, stage by stage, against brute force on what the stage before kept."""

import public_tokenizers

import corpus_pipeline
from commercium.llm import toxicity
from commercium.llm.queries import read


def words(text):
    return "".join(c if c not in "\t\n\x0b\f\r" else " " for c in text or "").split(" ")


def spoken(text):
    return [w for w in words(text) if w]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def near_roots(texts):
    sets = {}
    for i, t in texts.items():
        w = spoken(lower(t))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ordered = sorted(sets)
    for at, a in enumerate(ordered):
        for b in ordered[at + 1 :]:
            if min(len(sets[a]), len(sets[b])) * 100 < max(len(sets[a]), len(sets[b])) * 75:
                continue
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in root}


def without_repeats(texts, window=50):
    first = {}
    for i in sorted(texts):
        w = spoken(texts[i])
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in texts.items():
        w = spoken(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else t
    return out


def test_stages_equal_brute_force(spark, root):
    from tokenizers import Tokenizer

    docs = read(spark, root, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    predicted = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, read(spark, root, "labels")).collect()}
    expected = []
    texts = {i: t for i, t in texts.items() if not predicted[i]}
    expected.append(texts)
    last = {}
    for i in sorted(texts):
        last[texts[i] or ""] = i
    texts = {i: texts[i] for i in last.values()}
    expected.append(texts)
    roots = near_roots(texts)
    texts = {i: t for i, t in texts.items() if roots[i] == i}
    expected.append(texts)
    texts = without_repeats(texts)
    expected.append(texts)
    for (name, function), wanted in zip(corpus_pipeline.STAGES[:-1], expected, strict=True):
        out = corpus_pipeline.stage(function(spark, docs, root), name)
        assert out.columns == docs.columns, name
        assert {r.doc_id: r.text for r in out.collect()} == wanted, name
        docs = out
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, root).collect()
    sizes = {}
    for r in rows:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(model.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
