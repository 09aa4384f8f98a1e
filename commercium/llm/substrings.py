"""Repeated passages: windows of words partitioned by their minimisers.

A window's minimiser is the smallest hash among its short word grams. Consecutive
windows of one text with the same minimiser form a super-k-mer, so equal windows
always meet under the same minimiser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commercium.llm.text import Words, between, chunks, joined, mix, running, text_bytes
from commercium.sources.staging import stage

WINDOW, GRAM = 50, 6
#: A super-k-mer has at most 64 windows, so that one number holds a bit for each.
RUN = 64
STRINGS_PER_BUCKET = 2048
#: Bytes of packed strings that a task sorts at a time.
BUCKET_BYTES = 1 << 20


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def super_kmers(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """minimiser, key (two hashes of all its words), first word and number of windows of each super-k-mer."""
    n = len(words.start)
    starts = np.flatnonzero(words.rest() >= window)
    if not len(starts):
        return *np.zeros((3, 0), np.uint64), starts, starts
    sums = running(words.hash)
    at = np.arange(n - gram + 1)
    small = _smallest(between(sums, at, at + gram), window - gram + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (small[1:] != small[:-1])
    begin = np.flatnonzero(new)
    within = np.arange(len(starts)) - np.repeat(begin, np.diff(np.append(begin, len(starts))))
    begin = np.flatnonzero(within % RUN == 0)
    count = np.diff(np.append(begin, len(starts)))
    first = starts[begin]
    last = first + count + window - 1
    key = between(sums, first, last) + count.astype(np.uint64)
    return small[begin], key, between(running(mix(words.hash + np.uint64(2))), first, last), first, count


_SCANNED = "doc_id long, row long, n_words long, sha binary, kmers array<struct<m:bigint,k:bigint,q:bigint,start:int,n:int>>"


def _scan(source: DataFrame, window: int, gram: int) -> DataFrame:
    from hashlib import sha256

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = text_bytes(batch.column(2))
            for a, b in chunks(places):
                words = Words(data[places[a] : places[b]], places[a : b + 1] - places[a])
                m, k, q, first, count = super_kmers(words, window, gram)
                bounds = np.searchsorted(first, words.bounds)
                local = first - np.repeat(words.bounds[:-1], np.diff(bounds))
                fields = [*(x.view(np.int64) for x in (m, k, q)), local.astype(np.int32), count.astype(np.int32)]
                kmers = pa.StructArray.from_arrays([pa.array(x) for x in fields], names=["m", "k", "q", "start", "n"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).cast(pa.int64()),
                        batch.column(1).slice(a, b - a),
                        pa.array(words.count),
                        pa.array([sha256(x).digest() for x in joined(words.data, words)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), kmers),
                    ],
                    names=["doc_id", "row", "n_words", "sha", "kmers"],
                )

    return source.mapInArrow(scan, _SCANNED)


def _pack(chosen: DataFrame, window: int) -> DataFrame:
    """The words of each chosen super-k-mer as one string: m, k, q, part, parts, doc_id, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = text_bytes(batch.column(2))
            owner = np.repeat(np.arange(len(batch)), pa.compute.list_value_length(batch.column(1)).to_numpy())
            kmers = batch.column(1).flatten()
            start, n = kmers.field("start").to_numpy(), kmers.field("n").to_numpy()
            for a, b in chunks(places):
                words = Words(data[places[a] : places[b]], places[a : b + 1] - places[a])
                bodies = joined(words.data, words)
                ends = [np.cumsum(words.end[x:y] - words.start[x:y] + 1) for x, y in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                mine = np.flatnonzero((owner >= a) & (owner < b))
                packed = []
                for i in mine.tolist():
                    own, s = ends[owner[i] - a], int(start[i])
                    packed.append(bodies[owner[i] - a][int(own[s - 1]) if s else 0 : int(own[s + n[i] + window - 2]) - 1])
                rows = kmers.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.field("m"),
                        rows.field("k"),
                        rows.field("q"),
                        rows.field("part"),
                        rows.field("parts"),
                        batch.column(0).take(pa.array(owner[mine])),
                        pa.array(packed, pa.binary()),
                    ],
                    names=["m", "k", "q", "part", "parts", "doc_id", "packed"],
                )

    return chosen.select("doc_id", "kmers", "text").mapInArrow(
        pack, "m long, k long, q long, part long, parts long, doc_id long, packed binary"
    )


_OWNED = "m long, k long, q long, owners array<bigint>, cut array<struct<i:int,f:bigint,g:bigint,o:bigint>>"


def _sort_buckets(strings: DataFrame, window: int) -> DataFrame:
    """In each bucket (m, part): sort all windows of its strings and find the smallest doc_id of each.

    Rows arrive sorted by bucket, and buckets are a few hundred strings, so a task sorts
    some whole buckets at a time.
    """

    def owners(rows: pa.Table) -> pa.RecordBatch:
        data, places = text_bytes(rows.column("packed"))
        words = Words(data, places)
        starts = np.flatnonzero(words.rest() >= window)
        first = running(words.hash)
        f = between(first, starts, starts + window)
        g = between(running(mix(words.hash + np.uint64(1))), starts, starts + window)
        of = words.text_of()[starts]
        m, part = rows.column("m").to_numpy(), rows.column("part").to_numpy()
        bucket = np.cumsum(np.concatenate([[0], (m[1:] != m[:-1]) | (part[1:] != part[:-1])]))
        doc = rows.column("doc_id").to_numpy()[of]
        order = np.lexsort((doc, g, f, bucket[of]))
        b, x, y = bucket[of][order], f[order], g[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        smallest = np.empty(len(order), np.int64)
        smallest[order] = doc[order][new][np.cumsum(new) - 1] if len(order) else doc
        bounds = pa.array(np.searchsorted(of, np.arange(len(rows) + 1)).astype(np.int32))
        # From minimisers dealt over several buckets, the windows go on with their hashes.
        split = (rows.column("parts").to_numpy() > 1)[of]
        cut = pa.array(np.concatenate([[0], np.cumsum(split)])[bounds.to_numpy()].astype(np.int32))
        place = np.arange(len(of)) - np.repeat(bounds.to_numpy()[:-1], np.diff(bounds.to_numpy()))
        fields = [place[split].astype(np.int32), f[split].view(np.int64), g[split].view(np.int64), smallest[split]]
        windows = pa.StructArray.from_arrays([pa.array(x) for x in fields], names=["i", "f", "g", "o"])
        return pa.RecordBatch.from_arrays(
            [
                *[rows.column(c).combine_chunks() for c in ("m", "k", "q")],
                pa.ListArray.from_arrays(bounds, pa.array(smallest)),
                pa.ListArray.from_arrays(cut, windows),
            ],
            names=["m", "k", "q", "owners", "cut"],
        )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def whole_buckets(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
            """Runs of whole buckets of about BUCKET_BYTES, and what may go on in the next batch."""
            m, part = table.column("m").to_numpy(), table.column("part").to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (part[1:] != part[:-1])]))
            stop = len(table) if last else int(begin[-1])
            sizes = np.cumsum(pa.compute.binary_length(table.column("packed")).to_numpy())
            ends = np.append(begin[1:], len(table))
            runs, first = [], 0
            for end in ends[ends <= stop].tolist():
                if end == stop or sizes[end - 1] - (sizes[first - 1] if first else 0) >= BUCKET_BYTES:
                    runs.append(table.slice(first, end - first).combine_chunks())
                    first = end
            return runs, table.slice(stop)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            runs, held = whole_buckets(table if held is None else pa.concat_tables([held, table]), False)
            yield from map(owners, runs)
        if held is not None and len(held):
            yield from map(owners, whole_buckets(held, True)[0])

    bucketed = strings.repartition("m", "part").sortWithinPartitions("m", "part")
    return bucketed.mapInArrow(sort, _OWNED)


def _cut(found: DataFrame, window: int) -> DataFrame:
    """doc_id, row, n_removed, kept_text from each text and the windows to remove."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = text_bytes(batch.column(3))
            sizes = pa.compute.list_value_length(batch.column(2)).to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)])
            spans = batch.column(2).flatten()
            start = spans.field("start").to_numpy().astype(np.int64)
            mask = spans.field("mask").to_numpy().view(np.uint64)
            for a, b in chunks(places):
                words = Words(data[places[a] : places[b]], places[a : b + 1] - places[a])
                base = start[at[a] : at[b]] + np.repeat(words.bounds[a - a : -1], sizes[a:b])
                own = mask[at[a] : at[b]]
                edge = np.zeros(len(words.start) + 1, np.int64)
                for bit in range(RUN):
                    hit = base[(own >> np.uint64(bit)) & np.uint64(1) == 1] + bit
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.bounds])
                texts = [x.decode("utf-8", "replace") for x in joined(words.data, words, ~gone)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(removed),
                        pa.array(texts, pa.string()),
                    ],
                    names=["doc_id", "row", "n_removed", "kept_text"],
                )

    return found.select("doc_id", "row", "spans", "text").mapInArrow(
        cut, "doc_id long, row long, n_removed long, kept_text string"
    )


def _source(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(scanned, changed): word counts of all rows, and the rows that lose words with their kept text.

    A word goes if a window of ``window`` words that covers it also starts in a document
    with a smaller doc_id; windows are judged on the input. Windows are compared by 128
    bits of hash. Super-k-mers whose minimiser occurs in several documents go to its
    bucket as packed strings, once per distinct string (128 bits of hash), and the
    bucket's windows are sorted there. A minimiser with many distinct strings is dealt
    over several buckets, whose windows are then merged by a grouping.

    Texts shorter than a window, NULL and empty ones keep all words. Rows without doc_id
    neither lose words nor cause it. Rows that repeat a doc_id are judged one by one and
    do not remove each other's words. Further columns are ignored.
    """
    source = _source(docs)
    scanned = stage(_scan(source, window, gram), "kmers")
    seen = scanned.where("doc_id is not null").select("doc_id", "row", F.explode("kmers").alias("x"))
    seen = seen.select("doc_id", "row", "x.*")
    shared = seen.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    hits = stage(seen.join(shared.where("lo < hi").select("m"), "m"), "hits")

    key = ["m", "k", "q"]
    strings = hits.groupBy(*key).agg(F.min(F.struct("doc_id", "row", "start", "n")).alias("x")).select(*key, "x.*")
    strings = stage(strings, "strings")
    sizes = strings.groupBy("m").agg(F.count("*").alias("c"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("c") / STRINGS_PER_BUCKET)).cast("long")
    dealt = strings.join(sizes.select("m", parts.alias("parts")), "m")
    dealt = dealt.withColumn("part", F.pmod(F.col("k"), F.col("parts")))
    listed = dealt.groupBy("doc_id", "row").agg(F.collect_list(F.struct(*key, "part", "parts", "start", "n")).alias("kmers"))
    texts = source.join(hits.select("doc_id", "row").distinct(), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])
    texts = stage(texts, "texts")
    owned = stage(_sort_buckets(_pack(listed.join(texts, ["doc_id", "row"]), window), window), "owners")
    # Windows of a dealt minimiser may have a smaller owner in another of its buckets.
    split = owned.select(*key, F.explode("cut").alias("x")).select(*key, "x.*")
    merged = split.groupBy("f", "g").agg(F.min("o").alias("owner"), F.max("o").alias("most")).where("owner < most")
    fixed = split.join(merged, ["f", "g"]).where("owner < o")
    fixed = fixed.groupBy(*key).agg(F.collect_list(F.struct("i", "owner")).alias("fixed"))

    def mask(windows: str, number: str, owner: str) -> Column:
        """A bit for each window that a smaller doc_id owns."""
        return F.expr(f"aggregate({windows}, 0L, (a, x) -> a | if({owner} < doc_id, shiftleft(1L, {number}), 0L))")

    owners = F.transform("owners", lambda o, i: F.struct(i.alias("i"), o.alias("owner"))).alias("owners")
    some = hits.join(owned.select(*key, owners), key).select("doc_id", "row", "start", mask("owners", "x.i", "x.owner").alias("mask"))
    more = hits.join(fixed, key).select("doc_id", "row", "start", mask("fixed", "x.i", "x.owner").alias("mask"))
    spans = some.unionByName(more).where("mask <> 0")
    found = spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "mask")).alias("spans"))
    return scanned, _cut(found.join(texts, ["doc_id", "row"]), window)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    scanned, changed = repeated_passages(docs, window, gram)
    lost = changed.select("doc_id", "row", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("cut_sha"))
    rows = scanned.select("doc_id", "row", "n_words", "sha").join(lost, ["doc_id", "row"], "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("cut_sha", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def remove_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with all its columns; texts that lose words become their kept words joined by one space.

    Other texts stay as they are, NULL included. A column n_chars is brought up to date.
    Further columns are carried along whatever their names; an empty table gives no rows.
    """
    _, changed = repeated_passages(docs, window, gram)
    lost = changed.select(F.col("doc_id").alias("id"), F.col("row").alias("hash"), F.col("kept_text").alias("kept")).alias("__lost")
    held, kept = docs.alias("__docs"), F.col("__lost.kept")
    own = {c: F.col(f"__docs.`{c}`") for c in docs.columns}
    same = (own["doc_id"].cast("long") == F.col("__lost.id")) & (F.xxhash64(F.coalesce(own["text"], F.lit(""))) == F.col("__lost.hash"))
    new = own | {"text": F.coalesce(kept, own["text"])}
    if "n_chars" in own:
        new["n_chars"] = F.when(kept.isNotNull(), F.length(kept)).otherwise(own["n_chars"])
    return held.join(lost, same, "left").select(*[new[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
