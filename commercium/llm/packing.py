"""Packing of documents into sequences by a configuration linear program."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commercium.llm.numbering import SALT, number_within, salted
from commercium.llm.tokens import encoder
from commercium.sources.staging import stage

CAPACITY = 4096
END_ID = 1
#: The share of a length's demand that one round of the first pass covers at most, how fast
#: weights fall with the share covered, the power of a length that they begin with, and how
#: far below the best value a pattern may be.
STEP, RATE, POWER, SLACK = 1.0, 4.0, 1.1, 0.05
#: The share of all tokens that prices leave to the rounding, how far above its bound a
#: cover may be without another pass, and how many passes there are.
LEFT, GAP, PASSES = 0.002, 0.005, 3

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: its ids and the end id, cut every ``capacity`` tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            ids_of = batch.column(0)
            for first, ids, bounds in model.encode(batch.column(1)):
                owner, piece, length, crc = [], [], [], []
                ids = ids.astype("<u4")
                for k in range(len(bounds) - 1):
                    own = np.concatenate([ids[bounds[k] : bounds[k + 1]], end])
                    for n, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        owner.append(first + k)
                        piece.append(n)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                numbers = np.array(piece, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids_of.take(pa.array(owner, pa.int64())).cast(pa.int64()),
                        pa.array(numbers.astype(np.int32)),
                        pa.array(numbers * capacity),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES)


class _Knapsack:
    """Best values of patterns by room, and how to read the patterns off.

    Lengths ascend and their copies are offered in powers of two, at most ``most`` of
    each, so one table holds the best pattern among the lengths up to any of them.
    """

    def __init__(self, lengths: np.ndarray, most: np.ndarray, values: np.ndarray, capacity: int):
        self.lengths, self.most = lengths, most
        self.items: list[tuple[int, int]] = []
        self.upto = np.zeros(len(lengths) + 1, np.int64)
        for k, bound in enumerate(np.minimum(most, capacity // lengths).tolist()):
            copies = 1
            while bound > 0:
                self.items.append((k, min(copies, bound)))
                bound -= copies
                copies *= 2
            self.upto[k + 1] = len(self.items)
        best = np.zeros(capacity + 1)
        # The last item of the best pattern among the first n items, for each room.
        self.last = np.full((len(self.items) + 1, capacity + 1), -1, np.int16 if len(self.items) < 1 << 15 else np.int32)
        for n, (k, copies) in enumerate(self.items):
            size = int(lengths[k]) * copies
            row = self.last[n + 1]
            row[:] = self.last[n]
            offered = best[: capacity + 1 - size] + values[k] * copies
            better = offered > best[size:]
            row[size:][better] = n
            np.maximum(best[size:], offered, out=best[size:])
        self.value = float(best[capacity])

    def fill(self, n: int, room: int) -> dict[int, int]:
        """Copies by position of a length: the best pattern among the first ``n`` items."""
        out: dict[int, int] = {}
        while (at := int(self.last[n, room])) >= 0:
            k, copies = self.items[at]
            out[k] = out.get(k, 0) + copies
            room -= int(self.lengths[k]) * copies
            n = at
        return out

    def with_longest(self, k: int, capacity: int) -> dict[int, int]:
        """The best pattern that holds length ``k`` and none longer."""
        room = capacity - int(self.lengths[k])
        out = self.fill(int(self.upto[k + 1]), room)
        if out.get(k, 0) >= self.most[k]:
            out = self.fill(int(self.upto[k]), room)
        out[k] = out.get(k, 0) + 1
        return out


Cover = dict[tuple[tuple[int, int], ...], float]


def _priced_cover(demand: np.ndarray, lengths: np.ndarray, step: float, capacity: int) -> tuple[Cover, float]:
    """One pass of multiplicative weights: patterns with fractional uses, and the best dual value met."""
    wanted, covered = demand[lengths].astype(float), np.zeros(len(lengths))
    found: Cover = {}
    dual, before = 0.0, -1.0
    while (left := float(((1 - covered) * wanted) @ lengths)) > LEFT * float(wanted @ lengths) and left != before:
        before = left
        open_ = np.flatnonzero(covered < 1 - 1e-9)
        weight = (lengths[open_] / capacity) ** POWER * np.exp(-RATE * covered[open_])
        priced = _Knapsack(lengths[open_], demand[lengths[open_]], weight, capacity)
        dual = max(dual, float(weight @ wanted[open_]) / priced.value)
        room = np.minimum(step, 1 - covered[open_]) * wanted[open_]
        for k in range(len(open_) - 1, -1, -1):
            if room[k] <= 1e-9 * wanted[open_[k]]:
                continue
            pattern = priced.with_longest(k, capacity)
            uses = min(room[m] / copies for m, copies in pattern.items())
            if uses <= 0 or sum(weight[m] * copies for m, copies in pattern.items()) < (1 - SLACK) * priced.value:
                continue
            for m, copies in pattern.items():
                room[m] -= uses * copies
                covered[open_[m]] += uses * copies / wanted[open_[m]]
            key = tuple(sorted((int(lengths[open_[m]]), copies) for m, copies in pattern.items()))
            found[key] = found.get(key, 0.0) + uses
    return found, dual


def fractional(demand: np.ndarray, capacity: int = CAPACITY) -> tuple[Cover, float]:
    """Patterns with fractional uses that cover nearly all of ``demand``, and a lower bound on the uses of any cover.

    Multiplicative weights: a length's weight starts near its share of a sequence and
    falls exponentially with the share of its pieces covered. Each round prices all open
    lengths by one knapsack table and reads off, for each length, the best pattern that
    it is the longest of; a round covers at most a step of any length's demand. Weights
    over the value of the best pattern are a point of the dual program, whose value
    bounds every cover from below. Patterns SLACK below the best wait for other weights.
    A pass ends when at most LEFT of all tokens is open; what is open then belongs to the
    rounding. While the cover is not within GAP of the bound, passes of half the step
    follow, at most PASSES in all. The best cover is returned.
    """
    lengths = np.flatnonzero(demand)
    if not len(lengths):
        return {}, 0.0
    wanted = demand[lengths].astype(float)
    # No two pieces beyond half a sequence share one.
    bound = max(float(wanted @ lengths) / capacity, float(wanted[2 * lengths > capacity].sum()))
    best, least = {}, np.inf
    for number in range(PASSES):
        found, dual = _priced_cover(demand, lengths, STEP / 2**number, capacity)
        bound = max(bound, dual)
        if (uses := _uses(found, demand, capacity)) < least:
            best, least = found, uses
        if least <= (1 + GAP) * bound + 1:
            break
    return best, bound


def _uses(cover: Cover, demand: np.ndarray, capacity: int) -> float:
    """Sequences of a cover, with those that its open tokens would fill."""
    tokens = sum(uses * length * copies for pattern, uses in cover.items() for length, copies in pattern)
    return sum(cover.values()) + max(float(demand @ np.arange(len(demand))) - tokens, 0.0) / capacity


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns of all pieces of ``left``: longest first, each into the fullest sequences with room.

    Equal sequences are filled together, so the work does not grow with their number.
    """
    groups: list[list[tuple[list[tuple[int, int]], int]]] = [[] for _ in range(capacity + 1)]
    some = np.zeros(capacity + 1, bool)

    def put(held: list[tuple[int, int]], times: int, length: int, copies: int, room: int) -> None:
        groups[room - length * copies].append(([*held, (length, copies)], times))
        some[room - length * copies] = True

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        for room in (np.flatnonzero(some[length:]) + length).tolist():
            each, waiting = room // length, groups[room]
            while n and waiting:
                held, times = waiting.pop()
                whole = min(times, n // each)
                rest = n - whole * each if whole < times else 0
                if whole:
                    put(held, whole, length, each, room)
                if rest:
                    put(held, 1, length, rest, room)
                n -= whole * each + rest
                if (untouched := times - whole - (rest > 0)) > 0:
                    waiting.append((held, untouched))
            some[room] = bool(waiting)
            if not n:
                break
        each = capacity // length
        if n >= each:
            put([], n // each, length, each, capacity)
        if n % each:
            put([], 1, length, n % each, capacity)
    return [(sorted(held), times) for place in groups for held, times in place]


def rounded(demand: np.ndarray, cover: Cover, capacity: int = CAPACITY) -> tuple[list, list]:
    """Whole uses of the patterns of a cover, and the patterns that hold the pieces they leave.

    Whole uses of each pattern first, then one more of those with the largest remainder
    while all their pieces are left; what is then left is filled best fit, longest first.
    The pieces left depend on the number of patterns, not on the number of pieces.
    """
    left = demand.astype(np.int64)
    patterns = []
    by_rest = sorted(cover.items(), key=lambda e: (-(e[1] % 1), e[0]))
    for whole in (True, False):
        for pattern, uses in by_rest:
            times = min(int(uses + 1e-9) if whole else 1, *(int(left[length]) // copies for length, copies in pattern))
            if times > 0:
                patterns.append((list(pattern), times))
                for length, copies in pattern:
                    left[length] -= copies * times
    return patterns, _best_fit(left, capacity)


def solve(demand: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, copies), ...], times) that place ``demand[length]`` pieces of every length.

    The fractional cover of the configuration program, rounded.
    """
    placed, rest = rounded(demand.astype(np.int64), fractional(demand, capacity)[0], capacity)
    return placed + rest


def _entries(patterns: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies, offset), by length and first rank."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in pattern:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, copies, offset))
            taken[length] = rank + copies * times
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table of salted rows: doc_id, piece, length, ids_crc32) with sequence_id and offset.

    The driver holds the histogram, one number for each length up to ``capacity``, and
    the patterns found from it. A piece's rank within its length picks its place.
    """
    counts = pieces.groupBy("length").count().collect()
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in counts:
        demand[length] = n
    entries = _entries(solve(demand, capacity))
    shared = pieces.sparkSession.sparkContext.broadcast(entries)

    @F.pandas_udf("sequence_id long, offset long")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        rows = shared.value
        keys = (rows[:, 0] << 48) + rows[:, 1]
        for length, rank in parts:
            length, rank = length.to_numpy(), rank.to_numpy()
            row = rows[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            nth = rank - row[:, 1]
            yield pd.DataFrame(
                {"sequence_id": row[:, 2] + nth // row[:, 3], "offset": row[:, 4] + nth % row[:, 3] * length}
            )

    ranked = number_within(pieces, "length", ["doc_id", "piece", "ids_crc32"], "__rank")
    placed = ranked.withColumn("__place", place("length", "__rank"))
    return placed.select(*[c for c in pieces.columns if c != SALT], "__place.sequence_id", "__place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A NULL or empty text is a document of the end id alone. Only documents longer than
    ``capacity`` are cut. Sequences hold at most ``capacity`` tokens, offsets are gapless
    from 0. Repeated rows are packed once each; a NULL doc_id stays NULL. Further
    columns are ignored; an empty table gives no rows.
    """
    return pack(stage(salted(cut_documents(docs, tokenizer, capacity, end_id)), "pieces"), capacity)
