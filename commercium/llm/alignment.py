"""Alignment of two tokenizers by the byte offsets at which tokens of both end.

The shorter list of ends drives an exponential and then binary search into the longer.
Indices found in both slice the tokens into groups, and the differences of their ranks say
how many tokens of each side overlap in a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commercium.llm.pieces import _SPACE, PieceEncoder, piece_encoder
from commercium.llm.text import text_bytes
from commercium.llm.tokens import Encoder, encoder
from commercium.sources.staging import stage

#: Members of the driving list that search one after the other; stretches search side by side.
STRETCH = 64
#: Links of a block, whose distinct pairs are counted and looked up together.
BLOCK_LINKS = 1 << 20
_SHIFT = 20


def gallop(driver: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each item of a sorted list its first place in another that is not smaller.

    Each item starts where the one before it ended, doubles its step until it has passed
    its value, and halves the last step. The first items of stretches are found by the same
    search, so that stretches search side by side.
    """
    n, size = len(driver), len(other)
    out = np.zeros(n, np.int64)
    if not n or not size:
        return out
    heads = np.arange(0, n, STRETCH)
    at = gallop(driver[heads], other) if n > STRETCH else np.zeros(1, np.int64)
    for k in range(min(STRETCH, n)):
        item = heads + k
        item = item[item < n]
        at, value = at[: len(item)], driver[item]
        step = np.zeros(len(item), np.int64)  # the last distance known to be too small, plus one
        wide = np.ones(len(item), np.int64)
        open_ = np.flatnonzero(other[np.minimum(at, size - 1)] < value)
        open_ = open_[at[open_] < size]
        while len(open_):
            step[open_] = wide[open_]
            reach = at[open_] + wide[open_]
            wide[open_] *= 2
            open_ = open_[(reach < size) & (other[np.minimum(reach, size - 1)] < value[open_])]
        # The place lies after at + step - 1 and not after at + wide / 2, where the step stopped.
        low, high = at + (step + 1) // 2, np.minimum(at + step, size)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            small = other[np.minimum(middle, size - 1)] < value[open_]
            low[open_] = np.where(small, middle + 1, low[open_])
            high[open_] = np.where(small, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        at = low
        out[item] = at
    return out


def common_ends(a: np.ndarray, bounds_a: np.ndarray, b: np.ndarray, bounds_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in ``a`` and in ``b`` of the ends that both have. Ends ascend over all texts in a row.

    The shorter list of each text drives.
    """
    few_a = np.diff(bounds_a) <= np.diff(bounds_b)
    side_a, side_b = np.repeat(few_a, np.diff(bounds_a)), np.repeat(few_a, np.diff(bounds_b))
    ranks_a, ranks_b = [], []
    for mine, (x, own), (y, others) in ((True, (a, side_a), (b, side_b)), (False, (b, ~side_b), (a, ~side_a))):
        rank_x, rank_y = np.flatnonzero(own), np.flatnonzero(others)
        if not len(rank_x) or not len(rank_y):
            continue
        place = gallop(x[rank_x], y[rank_y])
        found = np.flatnonzero(place < len(rank_y))
        found = found[y[rank_y[place[found]]] == x[rank_x[found]]]
        hit_x, hit_y = rank_x[found], rank_y[place[found]]
        ranks_a.append(hit_x if mine else hit_y)
        ranks_b.append(hit_y if mine else hit_x)
    none = [np.zeros(0, np.int64)]
    return np.sort(np.concatenate(ranks_a or none)), np.sort(np.concatenate(ranks_b or none))


class Side:
    """Bytes of the tokens of one tokenizer."""

    def __init__(self, tokens: list[bytes]):
        self.body = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of tokens in a row, and the end of each."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.first[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.body[at], ends


def _byte_tokens(path: str) -> list[bytes]:
    """The bytes of each token of a byte-level vocabulary, whose tokens write a byte as one character."""
    # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = encoder(path, True, True).tokenizer.get_vocab()
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        tokens[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return tokens


class Digits:
    """Decimal numbers with a separator each, put together for many numbers at once."""

    def __init__(self, largest: int):
        written = [str(k).encode() + b" " for k in range(largest + 1)]
        self.side = Side(written)

    def write(self, numbers: np.ndarray, marks: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Each text's numbers, every one followed by its mark but for the last."""
        body, ends = self.side.spell(numbers)
        body = body.copy()
        body[ends - 1] = marks
        raw, places = body.tobytes(), np.concatenate([[0], ends])[bounds].tolist()
        return [raw[x : max(x, y - 1)] for x, y in zip(places, places[1:], strict=False)]


_loaded: dict[tuple[str, str], tuple[Encoder, PieceEncoder, Side, Side, Digits]] = {}


def _sides(a: str, b: str) -> tuple[Encoder, PieceEncoder, Side, Side, Digits]:
    if (a, b) not in _loaded:
        one, two = encoder(a, True, True), piece_encoder(b, 0.0, 0)
        side_a, side_b = Side(_byte_tokens(a)), Side(two.vocabulary.bytes)
        _loaded[a, b] = one, two, side_a, side_b, Digits(max(len(side_a.size), len(side_b.size)))
    return _loaded[a, b]


def _same(ids: np.ndarray, bounds: np.ndarray, side: Side, wanted: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, whether each text's joined bytes are the wanted ones)."""
    body, ends = side.spell(ids)
    at = np.concatenate([[0], ends])[bounds]
    same = np.diff(at) == np.diff(places)
    # Texts of another length are left out, the others compared byte by byte.
    left, right = np.repeat(same, np.diff(at)), np.repeat(same, np.diff(places))
    differ = body[left] != wanted[right]
    owner = np.repeat(np.flatnonzero(same), np.diff(places)[same])
    same[owner[differ]] = False
    return ends, same


def _select(ids: np.ndarray, ends: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and ends of the texts to keep; the others have none."""
    stay = np.repeat(keep, np.diff(bounds))
    return ids[stay], ends[stay], np.concatenate([[0], np.cumsum(np.where(keep, np.diff(bounds), 0))])


def align_texts(ids_a, bounds_a, ids_b, bounds_b, side_a: Side, side_b: Side, digits: Digits, data, places):
    """Per text the tokens, groups and links of two encodings of the same bytes.

    Gives counts of A and B tokens and of groups, the written groups, and all linked ids
    with bounds of each text's own.
    """
    ends_a, same_a = _same(ids_a, bounds_a, side_a, data, places)
    ends_b, same_b = _same(ids_b, bounds_b, side_b, data, places)
    keep = same_a & same_b & (np.diff(places) > 1)  # the space alone is an empty text
    size = np.diff(places)
    # Ends counted from each text's first byte, and on from text to text.
    ids_a, ends_a, bounds_a = _select(ids_a, _rebased(ends_a, bounds_a, places), bounds_a, keep)
    ids_b, ends_b, bounds_b = _select(ids_b, _rebased(ends_b, bounds_b, places), bounds_b, keep)
    rank_a, rank_b = common_ends(ends_a, bounds_a, ends_b, bounds_b)
    groups = np.searchsorted(rank_a, bounds_a)
    # Differences of ranks are the tokens of each side that overlap in a group.
    many_a, many_b = np.diff(rank_a, prepend=-1), np.diff(rank_b, prepend=-1)
    group = np.arange(len(rank_a))
    order = np.argsort(np.concatenate([np.repeat(2 * group, many_a), np.repeat(2 * group + 1, many_b)]), kind="stable")
    numbers = np.concatenate([ids_a, ids_b])[order]
    marks = np.full(len(numbers), ord(","), np.uint8)
    after_b = np.cumsum(many_a + many_b)
    marks[after_b - many_b - 1] = ord("|")
    marks[after_b - 1] = ord(";")
    written = digits.write(numbers, marks, np.concatenate([[0], after_b])[groups])
    return keep & (size > 0), np.diff(bounds_a), np.diff(bounds_b), groups, written, ids_a[rank_a], ids_b[rank_b]


def _rebased(ends: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> np.ndarray:
    begin = np.concatenate([[0], ends])[bounds[:-1]]
    return ends + np.repeat(places[:-1] - begin, np.diff(bounds))


_ALIGNED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>, pairs array<long>, counts array<long>"
)


def align_documents(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of documents and of blocks of them.

    A document has its counts, the digest of its groups and its links, as places in the
    list of its block. A row without doc counts holds that list: each pair of ids once,
    A's id << 20 | B's id, and how many links of the block it is.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, side_a, side_b, digits = _sides(a, b)
        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def rows(block: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            pairs, place, counts = np.unique(np.concatenate([h[-1] for h in held]), return_inverse=True, return_counts=True)
            first = 0
            for ids, n_a, n_b, groups, digests, links in held:
                own = pa.ListArray.from_arrays(pa.array(groups.astype(np.int32)), pa.array(place[first : first + len(links)].astype(np.int32)))
                first += len(links)
                many = len(ids)
                yield _batch([pa.array(np.full(many, block)), ids, pa.array(n_a), pa.array(n_b), pa.array(np.diff(groups)), pa.array(digests), own, None, None], many)
            both = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (pairs, counts)]
            yield _batch([pa.array([block]), *[None] * 6, *both], 1)

        size = 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            data, places = text_bytes(pc.binary_join_element_wise(" ", texts, ""))
            whole = pc.invert(pc.match_substring(texts, _SPACE)).to_numpy(zero_copy_only=False)
            for (first, ids_a, bounds_a), (_, ids_b, bounds_b) in zip(one.encode(texts), two.encode(texts), strict=True):
                last = first + len(bounds_a) - 1
                # A text with the character that stands for a space in pieces is read as a space by them.
                ids_b, _, bounds_b = _select(ids_b, ids_b, bounds_b, whole[first:last])
                at = places[first : last + 1] - places[first]
                _, n_a, n_b, groups, written, link_a, link_b = align_texts(
                    ids_a.astype(np.int64), bounds_a, ids_b.astype(np.int64), bounds_b, side_a, side_b, digits,
                    data[places[first] : places[last]], at,
                )
                digests = [sha256(w).hexdigest() if w else "" for w in written]
                links = link_a << _SHIFT | link_b
                held.append((batch.column(0).slice(first, last - first).cast(pa.int64()), n_a, n_b, groups, digests, links))
                size += len(links)
                if size >= BLOCK_LINKS:
                    yield from rows(block, held)
                    block, held, size = block + 1, [], 0
        if held:
            yield from rows(block, held)

    return docs.select("doc_id", "text").mapInArrow(align, _ALIGNED)


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
_NAMES = ["block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "pairs", "counts"]


def _batch(columns: list[pa.Array | None], rows: int) -> pa.RecordBatch:
    made = [pa.nulls(rows, t) if c is None else c for c, t in zip(columns, _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=_NAMES)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links of every pair of ids in all documents, and whether no pair of its B id has more."""
    listed = aligned.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    counts = listed.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("count"))
    b = F.col("pair").bitwiseAND((1 << _SHIFT) - 1)
    counts = stage(counts.withColumn("b", b), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def cross_alignment(docs: DataFrame, a: str, b: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Every text is encoded with a space before it by a byte-level vocabulary (A) and by a
    SentencePiece merge vocabulary (B); strings of special tokens are ordinary text. Byte
    offsets where tokens of both end cut the tokens into groups; the two tokens that end
    together are linked, so a group has one link. A pair's count is its links in all
    documents; a link is best if no pair of its B id has a larger count. Texts that are
    NULL or empty, or whose joined bytes of either side differ from the text with its space,
    have no tokens: counts of 0 and an empty digest.

    Links are counted for blocks of documents first, and a block's distinct pairs meet the
    corpus-wide counts once, so a pair in every document travels once a block. Repeated
    rows count as often as they occur; a NULL doc_id stays NULL. Texts of any length are
    read whole. Further columns are ignored; an empty table gives no rows.
    """
    aligned = stage(align_documents(docs, a, b), "aligned")
    counts = pair_counts(aligned)
    listed = aligned.where("pairs is not null").select("block", F.posexplode("pairs").alias("place", "pair"))
    # The alias gives each side of the cogroup a block of its own, though both come from one table.
    scored = listed.join(counts, "pair").select(F.col("block").alias("block"), "place", "count", "best")
    rows = aligned.where("pairs is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")

    def score(key: tuple, found: pa.Table, known: pa.Table) -> pa.Table:
        many = len(known)
        count, best = np.zeros(many + 1, np.int64), np.zeros(many + 1, np.int64)
        place = known["place"].to_numpy()
        count[place], best[place] = known["count"].to_numpy(), known["best"].to_numpy()
        links = found["links"].combine_chunks()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(links).to_numpy())])
        at = links.flatten().to_numpy()
        sums = [np.concatenate([[0], np.cumsum(x[at])])[ends] for x in (best, count)]
        return pa.table(
            {
                **{c: found[c] for c in ("doc_id", "n_a", "n_b", "n_groups")},
                "n_links": found["n_groups"],
                "n_best": np.diff(sums[0]),
                "count_sum": np.diff(sums[1]),
                "groups_sha256": found["groups_sha256"],
            }
        )

    return rows.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(
        score,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )
