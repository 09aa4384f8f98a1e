"""Fill-in-middle, cross-tokenizer alignment and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from commercium.llm import alignment, infill, syncmers

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{k % 977}x{k}" for k in range(20_000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog. " * 9,
    "The quick brown fox jumps over the lazy dog. " * 9 + "Then it sleeps.",
    None,
    "",
    " ",
    "x",
    " leading and  double   spaces\n\n\tand tabs\t",
    "é漢字 😀 ünï — straße",
    "one <|endoftext|> two <s> <0x0A> </s>",
    "a ▁ in a text▁",
    "with <P> a mark",
    "ends <S",
    "<",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "\r\n line ends \r\n",
    "x" * 10_000,
    LONG,
    LONG[: len(LONG) // 2] + " another end",
]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    words = [f"word{k}" for k in range(50)] + list("abcé")
    made = list(enumerate(TEXTS))
    made += [(100 + 3 * k, " ".join(draw.choice(words) for _ in range(draw.randrange(200)))) for k in range(60)]
    return [*made, (1, TEXTS[1]), (None, "no id here"), (None, None), (3, "a second text of one doc_id")]


@pytest.fixture(scope="module")
def docs(table, rows):
    return table([(*r, "k", 7, "s") for r in rows], "doc_id long, text string, key string, n int, at string").repartition(5)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    return sorted(rows, key=str)


def test_fill_in_middle(docs, rows):
    wanted, forms = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
        n = len(tokens)
        digest = sha(f"1:{'' if doc_id is None else doc_id}")
        h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        prefix, middle, suffix = ("".join(t) for t in (tokens[:low], tokens[low:high], tokens[high:]))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            form, output = "plain", text
        elif h4 % 100 < 20:
            form, output = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
        else:
            form, output = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
        sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
        wanted.append((doc_id, n, form, *sizes, sha(output), sha(text)))
        forms[form] += 1
    assert len(forms) == 3
    out = infill.infill_digests(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert ordered(tuple(r) for r in out.collect()) == ordered(wanted)


def test_rank_index_is_within_its_error_and_exact():
    draw = np.random.default_rng(3)
    parts = [np.cumsum(draw.integers(1, k, 3000)) for k in (2, 9, 300)] + [np.cumsum(draw.geometric(0.01, 50)), np.zeros(1, int)]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    offsets = np.concatenate(parts)
    for error in (0, 5, 64):
        index = infill.fit_index(offsets, bounds, error)
        at = np.arange(len(offsets))
        assert np.abs(index.predict(at) - offsets).max() <= error
        assert (index.offset(at) == offsets).all()
        assert set(bounds[:-1]) <= set(index.first.tolist())
    assert len(infill.fit_index(parts[1], np.array([0, 3000]), 64).first) < 100
    assert len(infill.fit_index(np.zeros(0, int), np.zeros(1, int)).first) == 0


def test_gallop_finds_the_first_place_not_smaller():
    draw = np.random.default_rng(4)
    for n, m in ((0, 5), (5, 0), (1, 1), (63, 9), (64, 1000), (65, 70), (5000, 20_000), (20_000, 5000)):
        driver, other = (np.unique(draw.integers(0, 30_000, k)) for k in (n, m))
        assert alignment.gallop(driver, other).tolist() == (np.searchsorted(other, driver).tolist() if m else [0] * len(driver))


def test_cross_alignment(docs, rows, monkeypatch):
    import sentencepiece
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BYTE_BPE)
    model.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found, counts = [], Counter()
    for doc_id, text in rows:
        raw = (" " + text).encode() if text else b""
        a = model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        names = [pieces.id_to_piece(k) for k in b]
        spelled = [bytes([int(p[3:5], 16)]) if pieces.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(b, names, strict=True)]
        if not text or b"".join(spelled) != raw:
            found.append((doc_id, 0, 0, [], ""))
            continue
        found.append((doc_id, a, b, spelled, ""))
    tokens = alignment._byte_tokens(BYTE_BPE)
    assert b"".join(tokens[k] for k in model.encode(" é漢字 😀", add_special_tokens=False).ids).decode() == " é漢字 😀"
    aligned = []
    for row in found:
        if not row[1]:
            aligned.append((row[0], 0, 0, [], ""))
            continue
        doc_id, a, b, spelled, _ = row
        ends_a = np.cumsum([len(tokens[k]) for k in a]).tolist()
        ends_b = np.cumsum([len(s) for s in spelled]).tolist()
        place_a, place_b = ({end: k + 1 for k, end in enumerate(e)} for e in (ends_a, ends_b))
        links, groups, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = place_a[end], place_b[end]
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        counts.update(links)
        aligned.append((doc_id, len(a), len(b), links, sha(";".join(groups))))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    wanted = [
        (d, n_a, n_b, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for d, n_a, n_b, links, digest in aligned
    ]
    assert sum(not w[1] for w in wanted) == 4  # two NULLs, the empty text and the one with the space character of pieces
    for block in (alignment.BLOCK_LINKS, 50):
        monkeypatch.setattr(alignment, "BLOCK_LINKS", block)
        out = alignment.cross_alignment(docs, BYTE_BPE, PIECES)
        assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert ordered(tuple(r) for r in out.collect()) == ordered(wanted)


# --- fingerprints ------------------------------------------------------------------


def hashed(raw):
    return xxhash.xxh64_intdigest(raw, 42) - (1 << 64 if xxhash.xxh64_intdigest(raw, 42) >= 1 << 63 else 0)


def plain_print(text):
    raw, out = text.encode(), []
    for k in range(len(raw) - syncmers.SIZE + 1):
        run = raw[k : k + syncmers.SIZE]
        inner = [hashed(run[j : j + syncmers.INNER]) for j in range(syncmers.SIZE - syncmers.INNER + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(hashed(run) >> 32)
    out = list(dict.fromkeys(out))
    if not out and raw:
        out = [hashed(raw) >> 32]
    last = sorted(out)[: syncmers.KEPT][-1:]
    return [h for h in out if h <= last[0]] if last else []


def plain_likeness(a, b):
    smallest = sorted({*a, *b})[: syncmers.KEPT]
    return len(set(smallest) & set(a) & set(b)) / len(smallest) if smallest else 1.0


def test_fingerprints(spark, docs, rows):
    table = {(i, t or "") for i, t in rows}
    keyed = docs.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").distinct().collect()
    ring = sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    assert len(ring) == len(table)
    wanted = {}
    for k, r in enumerate(ring):
        following = ring[(k + 1) % len(ring)]
        n = len(r.text)
        edited = r.text[: n - n // 4] + following.text[: n // 4]
        a, b, c = plain_print(r.text), plain_print(edited), plain_print(following.text)
        write = lambda x: "".join(f"{h & 0xFFFFFFFF:08x}" for h in x)
        wanted[r.doc_id, r.text] = (r.doc_id, n, sha(edited), write(a), write(b), plain_likeness(a, b), plain_likeness(a, c), following.doc_id)
    out = syncmers.text_fingerprints(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id"]
    assert out.columns[:7] == columns[:7]
    got = out.select(*columns).collect()
    assert ordered(tuple(r) for r in got) == ordered(wanted[i, t or ""] for i, t in rows)


def test_fingerprints_of_one_document_and_of_none(table):
    (r,) = syncmers.text_fingerprints(table([(4, "a lone text that is followed by itself, again and again")])).collect()
    assert r.next_id == 4 and r.near_next == 1.0 and r.fingerprint
    assert syncmers.text_fingerprints(table([])).count() == 0
    for out in (infill.infill_digests(table([])), alignment.cross_alignment(table([]), BYTE_BPE, PIECES)):
        assert out.count() == 0


def test_anchors_do_not_depend_on_their_surroundings(table):
    from pyspark.sql import functions as F

    passage = " ".join(f"shared{k} words" for k in range(40))
    docs = table([(1, passage), (2, "another beginning " + passage + " and an end")])
    found = {r.doc_id: r.a for r in docs.select("doc_id", syncmers.anchors(F.col("text").cast("binary")).alias("a")).collect()}
    assert len(found[1]) > 100
    assert any(found[2][k : k + len(found[1])] == found[1] for k in range(len(found[2])))
