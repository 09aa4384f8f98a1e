"""Near duplicates: fast similarity sketches, banding, exact verification.

A sketch has T coordinates. In round i every element is placed by hash into a bin
(any bin in the first T rounds, bin i - T afterwards) with a value that grows with the
round; a bin keeps its smallest value. Sketching a text stops at the first round that
leaves no bin empty, after about T ln(T) / n rounds for n elements, and every
coordinate is filled after 2T rounds at the latest. Two sets agree in a coordinate
with a probability equal to their similarity, concentrated like independent draws.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commercium.llm.components import components
from commercium.llm.text import LOWER, Words, between, chunks, mix, running, salt, text_bytes
from commercium.sources.staging import stage

SHINGLE = 5
#: A pair at 75 % similarity misses all 56 bands of 5 coordinates with probability 2.6e-7.
BANDS, ROWS = 56, 5
MEMBERS_PER_CHAIN = 64
#: Words of 64 bits in a text's parity bitmap.
BITMAP = 32
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and bounds. A text of fewer than five words is one shingle."""
    words = Words(LOWER[data], places)
    sums = running(words.hash)
    at = np.arange(len(words.start))
    rest = words.rest()
    first = at == np.repeat(words.bounds[:-1], words.count)
    at = at[(rest >= SHINGLE) | first]
    width = np.minimum(rest[at], SHINGLE)
    values = between(sums, at, at + width) + width.astype(np.uint64)
    bounds = np.searchsorted(at, words.bounds)
    owner = np.repeat(np.arange(len(words.count)), np.diff(bounds))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def sketches(values: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """One row of ``size`` coordinates per set; rows of empty sets stay at the largest value."""
    texts = len(bounds) - 1
    out = np.full((texts, size), _FULL)
    flat = out.reshape(-1)
    count = np.diff(bounds)
    live = np.flatnonzero(count)
    owner = np.repeat(np.arange(texts), count)
    for i in range(2 * size):
        if not len(live):
            break
        draw = mix(values + salt(i + 1))
        if i < size:
            bin_ = ((draw >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
            place = owner * size + bin_.astype(np.int64)
        else:
            place = owner * size + (i - size)
        # The bin is made of the highest bits, the value of the round and the lowest 48.
        np.minimum.at(flat, place, (np.uint64(i) << np.uint64(48)) | (draw & np.uint64((1 << 48) - 1)))
        open_ = (out[live] == _FULL).any(axis=1)
        if not open_.all():
            live = live[open_]
            keep = np.zeros(texts, bool)
            keep[live] = True
            stay = keep[owner]
            values, owner = values[stay], owner[stay]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates, different for each band."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for k in range(rows):
        key = mix(key + mix(parts[:, :, k]))
    return key


def bitmaps(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity of the number of elements in each of 2048 classes, as BITMAP 64-bit words per set.

    Two sets differ in at least as many elements as their bitmaps differ in bits.
    """
    classes = 64 * BITMAP
    texts = len(bounds) - 1
    cell = np.repeat(np.arange(texts), np.diff(bounds)) * classes + (values >> np.uint64(53)).astype(np.int64)
    odd = np.bincount(cell, minlength=texts * classes).astype(np.uint8) & 1
    return np.packbits(odd.reshape(texts, classes), axis=1).view(np.int64)


def may_reach(a: str, b: str, sizes, percent: int):
    """Whether two sets with bitmap columns ``a``, ``b`` and ``sizes`` elements in all can reach the similarity.

    Similar sets differ in at most (100 - percent) / (100 + percent) of their elements;
    the bitmaps bound that from below, so no similar pair is ruled out.
    """
    bits = F.lit(0)
    for k in range(BITMAP):
        bits = bits + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return bits * (100 + percent) <= sizes * (100 - percent)


_SKETCHED = "doc_id long, row long, n_shingles long, set_a long, set_b long, bands array<bigint>, bits array<bigint>"


def sketch_documents(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Set size, 128-bit hash of the set, and band keys of every whole text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = text_bytes(batch.column(2))
            for a, b in chunks(places, 1 << 19):
                values, bounds = shingle_sets(data[places[a] : places[b]], places[a : b + 1] - places[a])
                count = np.diff(bounds)
                keys = band_keys(sketches(values, bounds, bands * rows), bands, rows)
                sums = []
                for number in (1, 2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + salt(number)))])
                    sums.append(total[bounds[1:]] - total[bounds[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).cast(pa.int64()),
                        batch.column(1).slice(a, b - a),
                        pa.array(count),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32)),
                            pa.array(keys.reshape(-1).view(np.int64)),
                        ),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, (b - a + 1) * BITMAP, BITMAP, dtype=np.int32)),
                            pa.array(bitmaps(values, bounds).reshape(-1)),
                        ),
                    ],
                    names=["doc_id", "row", "n_shingles", "set_a", "set_b", "bands", "bits"],
                )

    return docs.select("doc_id", "row", "text").mapInArrow(sketch, _SKETCHED)


def shingle_rows(texts: DataFrame) -> DataFrame:
    """(id, n, s): every distinct shingle hash s of ``texts`` (id, text), with the number n of them."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = text_bytes(batch.column(1))
            for a, b in chunks(places):
                values, bounds = shingle_sets(data[places[a] : places[b]], places[a : b + 1] - places[a])
                count = np.diff(bounds)
                owner = pa.array(np.repeat(np.arange(a, b), count))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(owner), pa.array(np.repeat(count, count)), pa.array(values.view(np.int64))],
                    names=["id", "n", "s"],
                )

    return texts.select("id", "text").mapInArrow(spell, "id long, n long, s long")


def rare_meetings(texts: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``texts`` (id, text) of different ``roots`` (id, root) that may reach the similarity.

    With shingles ordered by how many texts hold them, sets that share k shingles share
    one among the first n - k + 1 of each. Sets x and y that reach the similarity share
    at least percent / (100 + percent) of |x| + |y|, which is percent % of the larger one
    and 2 * percent / (100 + percent) of the smaller one. So the short prefix of every
    set meets the longer prefix of sets at least as large, and no similar pair is left out.
    At the first shingle they share, what follows it in either set bounds all they share,
    which gives each set the largest size its partner may have. Sets of one shingle, root
    and size meet as one first, and their members only where a pair of them fits.
    Shingles that no other text holds come first and meet nothing: a set with too many of
    its own has no prefix left. Only members of different roots meet, never two of one root.
    """
    shingles = stage(shingle_rows(texts), "shingles")
    common = shingles.groupBy("s").agg(F.count("*").alias("held")).where("held > 1")
    own = W.partitionBy("id")
    n, shared = F.col("n"), F.count("*").over(own)
    place = n - shared + F.row_number().over(own.orderBy("held", "s"))
    ranked = shingles.join(common, "s").select("id", "n", "s", place.alias("place"))
    ranked = ranked.where(F.col("place") <= n - F.ceil(n * percent / 100) + 1)
    limit = F.floor((n - F.col("place") + 1) * (100 + percent) / percent) - n
    probe = stage(ranked.withColumn("limit", limit).join(roots, "id"), "prefixes")
    index = probe.where(F.col("place") <= n - F.ceil(n * (2 * percent) / (100 + percent)) + 1)
    small, large = (
        side.select("s", F.col("root").alias(f"root_{x}"), n.alias(f"n_{x}"), F.col("id").alias(x), F.col("limit").alias(f"limit_{x}"))
        for side, x in ((index, "a"), (probe, "b"))
    )
    some, others = (
        side.groupBy("s", f"root_{x}", f"n_{x}").agg(F.max(f"limit_{x}").alias(f"most_{x}")) for side, x in ((small, "a"), (large, "b"))
    )
    sizes = (F.col("n_a") <= F.col("n_b")) & (F.col("n_a") * 100 >= F.col("n_b") * percent)
    meeting = some.join(others, "s").where(sizes & (F.col("root_a") != F.col("root_b")))
    meeting = meeting.where("n_b <= most_a and n_a <= most_b")
    meeting = meeting.join(small, ["s", "root_a", "n_a"]).where("n_b <= limit_a")
    meeting = meeting.join(large, ["s", "root_b", "n_b"]).where("n_a <= limit_b")
    return meeting.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) whose full sets reach the similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [text_bytes(batch.column(c)) for c in (2, 3)]
            linked = np.zeros(len(batch), bool)
            # Stretches of pairs by the bytes of both their texts.
            for a, b in chunks(sides[0][1] + sides[1][1]):
                (x, at_x), (y, at_y) = [
                    shingle_sets(data[places[a] : places[b]], places[a : b + 1] - places[a]) for data, places in sides
                ]
                for k in range(b - a):
                    both = np.concatenate([x[at_x[k] : at_x[k + 1]], y[at_y[k] : at_y[k + 1]]])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    linked[a + k] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked)], names=["a", "b", "linked"]
            )

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long, linked boolean")


def _with_roots(members: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links)
    joined = members.join(roots, members["id"] == roots["node"], "left")
    return joined.select(*members.columns, F.coalesce("root", "id").alias("root"))


def _grouped(docs: DataFrame, percent: int, bands: int, rows: int) -> DataFrame:
    """``near_groups`` with ``row``, the hash of the text that tells rows of one doc_id apart."""
    source = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text")
    sketched = stage(sketch_documents(source, bands, rows), "sketches")
    named = sketched.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "row", "bands", "bits")).alias("x")
    classes = named.groupBy("n_shingles", "set_a", "set_b").agg(first).select("n_shingles", "set_a", "set_b", "x.*")
    # A number for each class, fixed by the written table: a doc_id may have texts in several.
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    keyed = classes.select(F.explode("bands").alias("key"), "id")
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("hub")).where("size > 1")
    members = stage(keyed.join(shared, "key"), "buckets")

    wanted = members.select("id").distinct()
    wanted = stage(classes.select("id", "doc_id", "row", "n_shingles", "bits").join(wanted, "id"), "bitmaps")

    def hopeful(pairs: DataFrame) -> DataFrame:
        """``pairs`` that can reach the similarity by their sizes and bitmaps."""
        for x in "ab":
            own = [F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")]
            pairs = pairs.join(wanted.select(*own), x)
        n_a, n_b = F.col("n_a"), F.col("n_b")
        near = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent
        return pairs.where(near & may_reach("bits_a", "bits_b", n_a + n_b, percent)).select("a", "b")

    to_hub = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    # The number of stretches is a power of two, so that neighbours agree between buckets.
    stretches = F.pow(2, F.ceil(F.log2(F.col("size") / MEMBERS_PER_CHAIN))).cast("long")
    many = F.col("size") > MEMBERS_PER_CHAIN
    chain = members.withColumn("part", F.when(many, F.pmod(F.xxhash64("id"), stretches)).otherwise(F.lit(0)))
    along = W.partitionBy("key", "part").orderBy("id")
    chained = chain.select(F.col("id").alias("a"), F.lead("id").over(along).alias("b")).where("b is not null")
    pairs = stage(hopeful(stage(to_hub.unionByName(chained).distinct(), "pairs")), "pairs")

    texts = source.join(wanted.select("id", "doc_id", "row"), ["doc_id", "row"]).dropDuplicates(["id"])
    texts = stage(texts.select("id", "text"), "texts")
    checked = stage(_verified(pairs, texts, percent), "checked")
    links = checked.where("linked").select("a", "b")
    rooted = stage(_with_roots(members.select("key", "id"), links), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    across = stage(rooted.join(mixed, "key").select("id", "root").distinct(), "across")
    rest = rare_meetings(texts.join(across.select("id"), "id"), across, percent)
    rest = hopeful(rest.join(checked, ["a", "b"], "left_anti"))
    more = stage(_verified(stage(rest, "pairs"), texts, percent).where("linked").select("a", "b"), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
    roots = components(links)
    held = classes.select("n_shingles", "set_a", "set_b", "id", "doc_id").join(roots, F.col("id") == F.col("node"), "left")
    held = stage(held.drop("node"), "members")
    # Numbers of classes do not follow doc_ids; a group is named by its smallest doc_id.
    least = held.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    named = held.join(least, "root", "left").select("n_shingles", "set_a", "set_b", F.coalesce("least", "doc_id").alias("least"))
    out = sketched.select("doc_id", "row", "n_shingles", "set_a", "set_b")
    out = out.join(stage(named, "labels"), ["n_shingles", "set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_groups(docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id, kept.

    Texts are linked at 100 * common >= percent * union of their shingle sets, all
    links confirmed on full sets. Texts with the same set form a class and travel as
    one from then on. Candidates are found in three steps that together leave out no
    similar pair of classes sharing a band:

    1. In each band bucket every class is compared with the bucket's smallest, and
       with its neighbour in stretches of about 64 members.
    2. Links give components; a bucket inside one component is done.
    3. Members of the others meet members of other components where they share a rare
       shingle (``rare_meetings``, exact), whatever their buckets hold.

    A pair is compared on full sets only if the texts' sizes and parity bitmaps allow the
    similarity, which they do for every similar pair. So a large group of near copies
    costs a few comparisons per member, and texts that share boilerplate hardly any.
    NULL, empty and blank texts have empty sets, are linked with nothing and are their
    own component. A row without doc_id is kept, with component_id NULL. Rows that
    repeat a doc_id are judged by their own texts. Further columns are ignored; an empty
    table gives no rows.
    """
    return _grouped(docs, percent, bands, rows).drop("row")


def keep_one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with all its columns, one document of each group: that of the smallest doc_id.

    Rows that repeat a doc_id go or stay by their own texts. NULL, empty and blank texts
    and rows without doc_id stay. Further columns are carried along whatever their names;
    an empty table gives no rows.
    """
    dropped = _grouped(docs.select("doc_id", "text"), percent, BANDS, ROWS).where("not kept")
    dropped = dropped.select(F.col("doc_id").alias("id"), "row").distinct().alias("__dropped")
    text = F.coalesce(F.col("__docs.text"), F.lit(""))
    same = (F.col("__docs.doc_id") == F.col("__dropped.id")) & (F.xxhash64(text) == F.col("__dropped.row"))
    return docs.alias("__docs").join(dropped, same, "left_anti")
