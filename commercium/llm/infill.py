"""Fill-in-middle: texts cut at token boundaries and put out of order, and put right again.

The cuts are ranks of boundaries between tokens; a learned index leads from a rank to its
code point. Straight lines are fitted to the offsets of all boundaries of a text so that
none is further off than a bound, and what each prediction lacks is stored, in a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commercium.llm.text import chunks, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_PERCENT, SPM_PERCENT = 1, 10, 20
#: How far a line may be from an offset; residuals take one byte.
ERROR = 64

_LETTER = np.zeros(128, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class RankIndex:
    """Offsets by position as lines that are at most ``ERROR`` off, and a residual for each position."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, position: np.ndarray) -> np.ndarray:
        line = np.searchsorted(self.first, position, "right") - 1
        return np.rint(self.base[line] + self.slope[line] * (position - self.first[line])).astype(np.int64)

    def offset(self, position: np.ndarray) -> np.ndarray:
        """The exact offsets."""
        return self.predict(position) + self.residual[position]


def fit_index(offsets: np.ndarray, bounds: np.ndarray, error: int = ERROR) -> RankIndex:
    """Lines for the offsets of many texts in a row; text t has those from bounds[t] to bounds[t + 1].

    A line goes through the first and the last offset of its stretch. Stretches begin as
    whole texts; those with an offset further off than ``error`` are halved, all of a round
    at once, until none is left. One of one or two offsets is exact.
    """
    first, last = bounds[:-1], bounds[1:] - 1
    first, last = first[last >= first], last[last >= first]
    lines = []
    while len(first):
        size = last - first + 1
        slope = (offsets[last] - offsets[first]) / np.maximum(size - 1, 1)
        begin = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(begin, size)
        guess = np.rint(np.repeat(offsets[first].astype(float), size) + np.repeat(slope, size) * within)
        off = np.abs(offsets[within + np.repeat(first, size)] - guess)
        good = np.maximum.reduceat(off, begin) <= error
        lines.append((first[good], slope[good]))
        first, last, half = first[~good], last[~good], (size[~good] + 1) // 2
        first, last = np.concatenate([first, first + half]), np.concatenate([first + half - 1, last])
    start = np.concatenate([x[0] for x in lines] or [np.zeros(0, np.int64)])
    order = np.argsort(start)
    start, slope = start[order], np.concatenate([x[1] for x in lines] or [np.zeros(0)])[order]
    index = RankIndex(start, offsets[start].astype(float), slope, np.zeros(len(offsets), np.int8))
    if len(offsets):
        index.residual = (offsets - index.predict(np.arange(len(offsets)))).astype(np.int8 if error < 128 else np.int64)
    return index


def boundaries(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the ends of all tokens of each text and 0, and bounds of each text's own.

    ``codes`` are the code points of texts in a row, ``places`` where each begins. A token is
    a run of letters A-Z and a-z, or one other code point.
    """
    letter = np.zeros(len(codes) + 1, bool)
    letter[:-1] = _LETTER[np.minimum(codes, 127)] & (codes < 128)
    fresh = np.ones(len(codes), bool)
    fresh[1:] = ~(letter[1:-1] & letter[:-2])
    begin = np.zeros(len(codes) + 1, bool)
    begin[places] = True
    at = np.flatnonzero(fresh | begin[:-1])
    count = np.diff(np.searchsorted(at, places)) + 1  # and one for the end of the text
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(bounds[-1], np.int64)
    ends = np.zeros(len(out), bool)
    ends[bounds[1:] - 1] = True
    out[ends] = places[1:]
    out[~ends] = at
    return out - np.repeat(places[:-1], count), bounds


def _draws(doc_id: int | None, seed: int) -> list[int]:
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n tokens, form, prefix_chars, middle_chars, output.

    The two cuts and the form follow from a hash of seed and doc_id. Form ``psm`` puts the
    prefix, the suffix and the middle after their marks, ``spm`` the suffix, the prefix and
    the middle; ``plain`` is the text itself, for a share of the documents, for texts that
    hold a mark and for empty ones. Lengths are in code points, NULL if plain. NULL text is
    empty; a NULL doc_id is hashed as the empty string, and repeated rows are cut alike.
    Texts of any length are read whole. Further columns are ignored; an empty table gives
    no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_pylist()
            data, places = text_bytes(batch.column(1))
            for a, b in chunks(places, 1 << 20):
                body = data[places[a] : places[b]].tobytes().decode("utf-8")
                codes = np.frombuffer(body.encode("utf-32-le"), np.uint32)
                heads = np.concatenate([[0], np.cumsum((data[places[a] : places[b]] & 0xC0) != 0x80)])
                starts = heads[places[a : b + 1] - places[a]]
                offsets, bounds = boundaries(codes, starts)
                index, n = fit_index(offsets, bounds), np.diff(bounds) - 1
                draws = np.array([_draws(i, seed) for i in ids[a:b]], np.int64)
                cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
                low, high = (index.offset(bounds[:-1] + c).tolist() for c in cuts.T)
                forms, prefixes, middles, outputs = [], [], [], []
                for k in range(b - a):
                    text = body[starts[k] : starts[k + 1]]
                    plain = not text or PREFIX in text or SUFFIX in text or MIDDLE in text
                    if plain or draws[k, 2] % 100 >= 100 - plain_percent:
                        forms.append("plain")
                        prefixes.append(None)
                        middles.append(None)
                        outputs.append(text)
                        continue
                    prefix, middle, suffix = text[: low[k]], text[low[k] : high[k]], text[high[k] :]
                    prefixes.append(len(prefix))
                    middles.append(len(middle))
                    if draws[k, 3] % 100 < spm_percent:
                        forms.append("spm")
                        outputs.append(f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
                    else:
                        forms.append("psm")
                        outputs.append(f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[a:b], pa.int64()),
                        pa.array(n),
                        pa.array(forms, pa.string()),
                        pa.array(prefixes, pa.int64()),
                        pa.array(middles, pa.int64()),
                        pa.array(outputs, pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select("doc_id", "text").mapInArrow(cut, _OUT)


def restored(output: Column, form: Column) -> Column:
    """The text of an output, from it and its form alone: marks occur in it three times or not at all."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, last = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, last, second)).when(form == "spm", F.concat(second, last, first)).otherwise(output)


def infill_digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with digests of the output and of the text rebuilt from it, in place of the output."""

    def digest(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    made = fill_in_middle(docs)
    return made.select(
        *made.columns[:-1],
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
