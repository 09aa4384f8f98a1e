"""Language of a text: sparse multinomial logistic regression on TF-IDF of character n-grams.

Trained with follow-the-regularised-leader and elastic-net penalties, then calibrated
by one temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commercium.llm.text import chunks, salt, text_bytes
from commercium.llm.toxicity import fold

TRAIN_ROWS = 4_000
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Follow-the-regularised-leader: step size, its offset, the two penalties, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.1, 2
_SCALE = 30.0
_CHUNK = 1 << 20

# Letters in lower case; every other character is a space.
_LETTERS = np.full(1 << 16, 32, np.uint32)
for _code in range(1 << 16):
    _low = chr(_code).lower()
    if chr(_code).isalpha():
        _LETTERS[_code] = ord(_low) if len(_low) == 1 and ord(_low) < 1 << 16 else _code


def grams(data: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order n: bucket of every n-gram and the number of its text, in text order."""
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(codes) != heads[-1]:  # a text that is not UTF-8: its bytes stand for characters
        heads, codes = np.arange(len(data) + 1), data.astype(np.uint32)
    places = heads[places]
    low = np.where(codes < 1 << 16, _LETTERS[np.minimum(codes, (1 << 16) - 1)], codes).astype(np.uint64)
    left = np.repeat(places[1:], np.diff(places)) - np.arange(len(low))
    owner = np.repeat(np.arange(len(places) - 1), np.diff(places))
    for n in ORDERS:
        if len(low) < n:
            continue
        key = low[: len(low) - n + 1].copy()
        for k in range(1, n):
            key |= low[k : len(low) - n + 1 + k] << np.uint64(21 * k)
        bucket = ((key * salt(2 * n + 1)) >> np.uint64(48)).astype(np.int64)
        inside = left[: len(bucket)] >= n
        yield bucket[inside], owner[: len(bucket)][inside]


def _sparse(data: np.ndarray, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    parts = list(grams(data, places))
    bucket = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    owner = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    key, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
    bounds = np.searchsorted(key, np.arange(len(places)) * BUCKETS)
    return [(key[a:b] % BUCKETS, count[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs`` each bucket occurs, and the number of texts.

    Every task counts its rows into one array of BUCKETS numbers; the arrays are
    added by a grouping on the bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            data, places = text_bytes(batch.column(0))
            rows += len(places) - 1
            for a, b in chunks(places, _CHUNK):
                seen = np.zeros(BUCKETS, bool)
                parts = list(grams(data[places[a] : places[b]], places[a : b + 1] - places[a]))
                bounds = [np.searchsorted(owner, np.arange(b - a + 1)) for _, owner in parts]
                for k in range(b - a):
                    for (bucket, _), at in zip(parts, bounds, strict=True):
                        seen[bucket[at[k] : at[k + 1]]] = True
                    total += seen
                    seen[:] = False
        if rows:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(used, -1)), pa.array(np.append(total[used], rows))], names=["bucket", "n"]
            )

    counted = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # at most BUCKETS + 1 rows
    out = np.zeros(BUCKETS, np.int64)
    own = table["bucket"] >= 0
    out[table["bucket"][own].to_numpy()] = table["n"][own].to_numpy()
    return out, int(table["n"][~own].sum())


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: weight times inverse document frequency
    bias: np.ndarray
    temperature: float

    def logits(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        texts = len(places) - 1
        out, count = np.zeros((texts, len(self.languages))), np.zeros(texts)
        for bucket, owner in grams(data, places):
            if len(bucket):
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                out[owner[first]] += np.add.reduceat(self.table[bucket], first, axis=0)
                count += np.bincount(owner, minlength=texts)
        return out * (_SCALE / np.maximum(count, 1))[:, None] + self.bias

    def predict(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = _softmax(self.logits(data, places) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader with a learning rate for every coordinate; weights of small sums are exactly 0."""

    def __init__(self, inputs: int, classes: int):
        self.z, self.n = np.zeros((inputs, classes)), np.zeros((inputs, classes))

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        p = _softmax(x @ w)
        p[label] -= 1
        g = np.outer(x, p)
        n = self.n[rows]
        grown = n + g * g
        self.z[rows] += g - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[rows] = grown


def share_of_rows(sizes: dict[str, int], rows: int) -> int:
    """The largest number of rows a language may have so that all of them together have at most ``rows``, and 1 at least."""
    left, per = rows, rows
    for k, size in enumerate(sorted(sizes.values())):
        per = left // (len(sizes) - k)
        if size > per:
            break
        left -= size
    return max(per, 1)


def sample_rows(labelled: DataFrame, rows: int) -> DataFrame:
    """(h, text, lang): about ``rows`` rows of ``labelled``, an even share of every language, one for each doc_id and text.

    Rows are first thinned by hash to some times the share, so that only a bounded number
    of texts is shuffled; rows alike in doc_id and text count once.
    """
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    per = share_of_rows(sizes, rows)
    h = F.xxhash64(F.col("doc_id").cast("string"), "text")
    thin = labelled.sparkSession.createDataFrame(
        [(name, min(1.0, (2 * per + 50) / n)) for name, n in sizes.items()], "lang string, __part double"
    )
    drawn = labelled.select(h.alias("h"), "text", "lang").join(F.broadcast(thin), "lang")  # a row per language
    drawn = drawn.where((F.col("h") / F.lit(2.0**64) + 0.5) <= F.col("__part")).dropDuplicates(["lang", "h"])
    first = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    return drawn.withColumn("__rank", first).where(F.col("__rank") <= per).select("h", "text", "lang")


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model from the text and lang of ``docs``; None without a labelled text.

    Document frequencies count all of ``docs``; the regression sees at most
    ``train_rows`` whole texts, an even share of every language (one of each at least)
    of the smallest hash, a fifth of them kept for the temperature.
    """
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    frequency, texts = document_frequency(labelled)
    if not texts:
        return None
    idf = np.log((1 + texts) / (1 + frequency)) + 1
    sample = sample_rows(labelled, train_rows)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = text_bytes(batch.column(1))
            for a, b in chunks(places, _CHUNK):
                rows = _sparse(data[places[a] : places[b]], places[a : b + 1] - places[a])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                        pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                    ],
                    names=["h", "lang", "bucket", "n"],
                )

    shape = "h long, lang string, bucket array<int>, n array<int>"
    rows = sample.mapInArrow(shrink, shape).toPandas().sort_values(["h", "lang"], kind="stable")
    languages = sorted(rows["lang"].unique())
    label = rows["lang"].map({name: k for k, name in enumerate(languages)}).to_numpy()
    inputs = []
    for bucket, n in zip(rows["bucket"], rows["n"], strict=True):
        at = np.append(np.asarray(bucket, np.int64), BUCKETS)
        x = np.append(_SCALE * np.asarray(n) / max(1, np.sum(n)) * idf[at[:-1]], 1.0)
        inputs.append((at, x))
    held = np.arange(len(inputs)) % 5 == 4
    leader = Leader(BUCKETS + 1, len(languages))
    for _ in range(PASSES):
        for k in np.flatnonzero(~held):
            leader.learn(*inputs[k], label[k])
    w = leader.weights()
    temperature = 1.0
    if held.any():
        logits = np.array([inputs[k][1] @ w[inputs[k][0]] for k in np.flatnonzero(held)])
        tried = np.exp(np.linspace(np.log(0.25), np.log(16), 97))
        loss = [-np.log(_softmax(logits / t)[np.arange(len(logits)), label[held]] + 1e-12).mean() for t in tried]
        temperature = float(tried[int(np.argmin(loss))])
    return Model(languages, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], temperature)


def language_id(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): held_out, lang_pred, score.

    Learns from rows with text and lang whose crc32(doc_id) mod 4 is not 2. A text that
    is NULL or has no letter is ``und`` with score 0; so is every text if there is
    nothing to learn from. Repeated rows are predicted alike; further columns are
    ignored; an empty table gives no rows.
    """
    out = fold(F.col("doc_id"), 4) == 2
    model = train(docs.where(~out), train_rows)
    if model is None:
        return docs.select("doc_id", out.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        names = np.array(model.languages, object)
        for part in parts:
            data, places = text_bytes(pa.array(part, pa.string()))
            found = [model.predict(data[places[a] : places[b]], places[a : b + 1] - places[a]) for a, b in chunks(places, _CHUNK)]
            best = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
            score = np.concatenate([f[1] for f in found] or [np.zeros(0)])
            yield pd.DataFrame({"lang": names[best], "score": score})

    read = F.col("text").rlike(r"\p{L}")
    guessed = docs.select("doc_id", "text").withColumn("__g", predict("text"))
    return guessed.select(
        "doc_id",
        out.alias("held_out"),
        F.when(read, F.col("__g.lang")).otherwise("und").alias("lang_pred"),
        F.when(read, F.col("__g.score")).otherwise(0.0).alias("score"),
    )
