"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

Only text is an input of a score. Word and prefix lexicons, trees and calibration are
fitted on three disjoint parts of a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commercium.llm.text import Words, between, chunks, mix, salt, text_bytes
from commercium.sources.staging import stage

TRAIN_ROWS = 20_000  # half of them at most for each class
#: Parts of a class in order of a hash: 0 lexicon, 1 trees, 2 calibration; 50, 35 and 15 %.
_PARTS = (0, 1, 2, 0, 0, 1, 0, 1, 0, 2, 0, 1, 0, 1, 0, 2, 0, 1, 0, 1)
LEXICON_TERMS = 4_000
_MIN_TEXTS, _MIN_ODDS = 4, 2.0
TREES, DEPTH, BINS, RATE = 80, 4, 32, 0.15
#: Pseudo rows of a calibrated block, and of the class rate they hold.
_BLOCK_ROWS, _RATE_ROWS = 2.0, 10.0
_NEAR = 5  # words between a lexicon word and a word of address

# Words that address a reader, in the languages served.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen euch ihr tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros os"
).split()

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?.,;:"]] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[[ord(c) for c in "!?"]] = True
_MASK = np.zeros(256, bool)
_MASK[[ord(c) for c in "0123456789@$*#!.-_"]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PREFIXES = (4, 5)


def _words(data: np.ndarray, places: np.ndarray) -> tuple[Words, list[np.ndarray]]:
    """Runs of letters, lower-cased in A-Z, and the hashes of each as a whole word and by prefixes."""
    words = Words(_FOLD[data], places, ~_LETTER)
    whole = mix(words.hash ^ salt(1))
    terms = [whole]
    for size in _PREFIXES:
        long = words.end - words.start >= size
        part = between(words.sums, words.start, np.minimum(words.start + size, words.end))
        terms.append(np.where(long, mix(part ^ salt(size)), np.uint64(0)))
    return words, terms


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, pos, neg): in how many toxic and other texts of ``rows`` (toxic, text) each term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False) == 1
            data, places = text_bytes(batch.column(1))
            for a, b in chunks(places):
                words, terms = _words(data[places[a] : places[b]], places[a : b + 1] - places[a])
                owner = np.tile(words.text_of(), len(terms))
                term = np.concatenate(terms)
                order = np.lexsort((owner, term))
                term, owner = term[order], owner[order]
                once = np.ones(len(term), bool)
                once[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
                term, hit = term[once & (term != 0)], toxic[a:b][owner[once & (term != 0)]]
                unique, at = np.unique(term, return_inverse=True)
                pos = np.bincount(at, hit, len(unique)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unique.view(np.int64)), pa.array(pos), pa.array(np.bincount(at, minlength=len(unique)) - pos)],
                    names=["term", "pos", "neg"],
                )

    parts = rows.select("toxic", "text").mapInArrow(count, "term long, pos long, neg long")
    return parts.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


class Lexicon:
    """Terms by hash with their weights; a table of low bits passes over most words."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.weights = terms[order], weights[order]
        self.some = np.zeros(1 << 16, bool)
        self.some[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def weigh(self, terms: np.ndarray) -> np.ndarray:
        out = np.zeros(len(terms))
        if len(self.terms):
            maybe = np.flatnonzero(self.some[(terms & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.terms, terms[maybe]), len(self.terms) - 1)
            hit = self.terms[at] == terms[maybe]
            out[maybe[hit]] = self.weights[at[hit]]
        return out


_address = None


def _second_person(words: Words) -> np.ndarray:
    global _address
    if _address is None:
        raw = [w.encode() for w in SECOND_PERSON]
        places = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
        _address = np.unique(Words(np.frombuffer(b"".join(raw), np.uint8), places, ~_LETTER).hash)
    at = np.minimum(np.searchsorted(_address, words.hash), len(_address) - 1)
    return _address[at] == words.hash


def features(data: np.ndarray, places: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Dense features, one row per text; an empty text has zeros."""
    words, terms = _words(data, places)
    texts = len(places) - 1
    n = np.maximum(words.count, 1)
    owner = words.text_of()
    size = np.maximum(np.diff(places), 1)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, texts)

    def bytes_of(mark: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mark)])[places])

    columns = []
    weights = [lexicon.weigh(t) for t in terms]
    for weight in weights:
        hits = per_text(weight > 0)
        top = np.zeros(texts)
        np.maximum.at(top, owner, weight)
        columns += [hits, hits / n, top, per_text(weight) / n]
    bad = np.max(weights, axis=0) > 0 if len(owner) else np.zeros(0, bool)
    you = _second_person(words)
    near = np.zeros(len(owner) + 1, np.int64)
    at = np.flatnonzero(you)
    np.add.at(near, np.maximum(at - _NEAR, 0), 1)
    np.add.at(near, np.minimum(at + _NEAR + 1, len(owner)), -1)
    columns += [per_text(you) / n, per_text(bad & (np.cumsum(near[:-1]) > 0)) / n]
    upper = _UPPER[data]
    capitals = np.concatenate([[0], np.cumsum(upper)])
    loud = (capitals[words.end] - capitals[words.start] == words.end - words.start) & (words.end - words.start > 2)
    columns += [bytes_of(upper) / size, per_text(loud) / n]
    columns += [bytes_of(_MARK[data]) / size, bytes_of(_SHOUT[data]) / size]
    letter, hidden, same = _LETTER[data], np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(data) > 2:
        hidden[1:-1] = letter[:-2] & _MASK[data[1:-1]] & letter[2:]
        same[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    columns += [bytes_of(hidden) / n, bytes_of(same) / n]
    columns += [np.log1p(words.count), per_text(words.end - words.start) / n]
    out = np.stack(columns, axis=1)
    out[words.count == 0] = 0
    return out


@dataclass
class Trees:
    """Boosted trees of one depth as arrays: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES) -> Trees:
    """Histogram boosting of the weighted logistic loss: split gains from summed gradients and curvatures per bin."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    # Rare values above every quantile, as lexicon hits are, keep a bin of their own.
    edges = [np.unique(np.append(e, c.min())) for e, c in zip(edges, x.T, strict=True)]
    codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    rate = min(max(np.average(y, weights=weight), 1e-6), 1 - 1e-6)
    # A side of a split needs a curvature of 1, or half of what the rarer class begins with if that is less.
    floor = min(1.0, rate * (1 - rate) * min(float(weight[y == 1].sum()), float(weight[y == 0].sum())) / 2)
    start = math.log(rate / (1 - rate))
    margin = np.full(len(x), start)
    inner, width = 2**DEPTH - 1, BINS + 2
    all_features, all_thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, curve = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-6)
            for f in range(x.shape[1]):
                cell = (node - first) * width + codes[:, f]
                g = np.bincount(cell, grad, many * width).reshape(many, width).cumsum(axis=1)
                h = np.bincount(cell, curve, many * width).reshape(many, width).cumsum(axis=1)
                gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain = np.where((h > floor) & (h[:, -1:] - h > floor), gain, 0)[:, : len(edges[f])]
                cut = gain.argmax(axis=1)
                value = gain[np.arange(many), cut]
                better = value > best
                best[better] = value[better]
                feature[first : first + many][better] = f
                threshold[first : first + many][better] = edges[f][cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, curve, inner + 1)
        values = RATE * g / (h + 1)
        margin += values[leaf]
        all_features.append(feature)
        all_thresholds.append(threshold)
        leaves.append(values)
    return Trees(np.array(all_features), np.array(all_thresholds), np.array(leaves), start)


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (margin, probability) of the best non-decreasing fit, by pooling neighbours.

    Each block is shrunk by pseudo rows of the class rate, itself held down by pseudo rows
    without the class, so that a handful of labels gives no probability of one half.
    """
    rate = float((weight * y).sum()) / (float(weight.sum()) + _RATE_ROWS)
    order = np.argsort(margin, kind="stable")
    blocks: list[tuple[float, float, float]] = []  # toxic rows, rows, sum of margins
    for at, hit, own in zip(margin[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append((hit * own, own, at * own))
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = tuple(u + v for u, v in zip(blocks[-1], last, strict=True))
    # Interpolated between the blocks' mean margins.
    points = np.array([b[2] / b[1] for b in blocks])
    return points, np.maximum.accumulate([(b[0] + _BLOCK_ROWS * rate) / (b[1] + _BLOCK_ROWS) for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    steps: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.margin(x), *self.steps)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def _feature_rows(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = text_bytes(batch.column(2))
            for a, b in chunks(places):
                x = features(data[places[a] : places[b]], places[a : b + 1] - places[a], lexicon)
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), flat], names=["part", "toxic", "x"]
                )

    return rows.select("part", "toxic", "text").mapInArrow(measure, "part int, toxic int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model from at most ``train_rows`` labelled rows; None if no text with a word of one class is labelled.

    Of several labels of one doc_id the largest counts. Of each class the rows of the
    smallest hash are taken, at most half of ``train_rows``; trees and calibration weigh
    them back to the shares of the classes. Half of the rows of each class make the
    lexicons (terms by smoothed log odds), 35 % the trees, 15 % the calibration; all parts
    share the rows of a class of fewer than three, and trees and calibration theirs if
    one of them has a class without texts.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Only labels of documents at hand that have a word count for the bound.
    worded = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[A-Za-z\x{80}-\x{10FFFF}]"))
    known = stage(known.join(worded.select("doc_id").distinct(), "doc_id", "left_semi"), "known_labels")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    rows_of, totals, weights = [], {}, {}
    for kind in (0, 1):
        own = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(train_rows // 2, 1))
        ids = [r["doc_id"] for r in own.collect()]
        dealt = [(i, kind, _PARTS[k % len(_PARTS)]) for k, i in enumerate(ids)]
        if len(ids) < 3:
            dealt = [(i, kind, part) for i in ids for part in range(3)]
        rows_of += dealt
        totals[kind] = sum(part == 0 for _, _, part in dealt)
        weights[kind] = sizes[kind] / len(ids)
    id_type = known.schema["doc_id"].dataType.simpleString()
    sample = docs.sparkSession.createDataFrame(rows_of, f"doc_id {id_type}, toxic int, part int")
    # At most train_rows rows of numbers are broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    counted = term_counts(rows.where("part = 0"))
    odds = F.log((F.col("pos") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("neg") + 0.5) / (totals[0] + 1.0))
    best = counted.where(F.col("pos") >= _MIN_TEXTS).withColumn("odds", odds).where(F.col("odds") >= _MIN_ODDS)
    terms = best.orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "term").limit(LEXICON_TERMS).select("term", "odds").toPandas()
    lexicon = Lexicon(terms["term"].to_numpy(np.int64).view(np.uint64), terms["odds"].to_numpy(float))
    fitted = _feature_rows(rows.where("part > 0"), lexicon).toPandas()
    x = np.array(fitted["x"].tolist(), float).reshape(len(fitted), -1)
    y, calibrate = fitted["toxic"].to_numpy(float), fitted["part"].to_numpy() == 2
    order = np.lexsort((*x.T, y, calibrate))  # the same model whatever the order of the rows
    x, y, calibrate = x[order], y[order], calibrate[order]
    weight = np.where(y == 1, weights[1], weights[0])
    weight = weight / weight.min() if len(y) else weight
    fit = ~calibrate
    if any(len(np.unique(y[part])) < 2 for part in (fit, calibrate)):
        fit = calibrate = np.ones(len(y), bool)
    if len(np.unique(y)) < 2:
        return None
    trees = boost(x[fit], y[fit], weight[fit])
    return Model(lexicon, trees, isotonic(trees.margin(x[calibrate]), y[calibrate], weight[calibrate]))


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted) per row; without a model every score is 0."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, places = text_bytes(batch.column(1))
            for a, b in chunks(places):
                p = model.score(features(data[places[a] : places[b]], places[a : b + 1] - places[a], model.lexicon))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): held_out, score, predicted.

    Learns from labelled rows whose crc32(doc_id) mod 5 is not 0; NULL labels and
    doc_ids are not learned from. NULL, empty and blank texts are scored from zero
    features. Without labels of both kinds every score is 0. Repeated rows score
    alike; further columns are ignored; an empty table gives no rows.
    """
    model = train(docs, labels.where(fold(F.col("doc_id"), 5) != 0), train_rows)
    out = score_documents(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with all its columns, without the rows predicted toxic.

    Learns as ``toxicity`` does; without labels of both kinds every row stays. NULL, empty
    and blank texts are scored from zero features, a NULL doc_id is scored like any other,
    repeated rows go or stay together. Further columns are carried along whatever their
    names; an empty table gives no rows.
    """
    model = train(docs, labels.where(fold(F.col("doc_id"), 5) != 0), train_rows)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, places = text_bytes(batch.column(at))
            scores = [
                model.score(features(data[places[a] : places[b]], places[a : b + 1] - places[a], model.lexicon))
                for a, b in chunks(places)
            ]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
