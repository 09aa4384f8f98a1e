"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A run of SIZE bytes is an anchor if the smallest hash among its inner runs of INNER bytes
is that of the first or of the last one. Whether it is depends on the run itself and on
nothing around it, so texts that share a passage share its anchors, wherever it stands.
A fingerprint is the KEPT distinct anchors of smallest hash, in the order of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commercium.operators.ordered import previous_in_order

#: Bytes (UTF-8) of an anchor and of its inner runs.
SIZE, INNER = 16, 9
KEPT = 64
#: About so many times KEPT anchors of a text are looked at, those of the smallest hashes; all if these are too few.
SPARE = 1.5
#: The last 1 / EDITED of a text is what an edited text replaces.
EDITED = 4
_ALL = (1 << 31) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def anchors(data: Column, limit: Column | int = _ALL) -> Column:
    """Hashes (int) up to ``limit`` of the anchors of a binary column in their order, repeats included.

    Whether a run is an anchor depends on the run alone, so only those of a wanted hash are
    tested. Texts below SIZE bytes have none.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit

    def of_code(code: Column, limit: Column) -> Column:
        def hashed(at: Column, size: int) -> Column:
            return F.xxhash64(F.substring(code, at, F.lit(size)))

        def closed(at: Column) -> Column:
            edge = F.least(hashed(at, INNER), hashed(at + (SIZE - INNER), INNER))
            inside = F.array(*[F.lit(k) for k in range(1, SIZE - INNER)])
            return _let(edge, lambda e: F.forall(inside, lambda k: hashed(at + k, INNER) >= e))

        runs = F.octet_length(code) - (SIZE - 1)
        wanted = F.filter(F.sequence(F.lit(1), runs), lambda at: _short(hashed(at, SIZE)) <= limit)
        found = F.transform(F.filter(wanted, closed), lambda at: _short(hashed(at, SIZE)))
        return F.when(runs > 0, found).otherwise(F.array().cast("array<int>"))

    return _let(data, lambda code: _let(limit, lambda number: of_code(code, number)))


def lowest_anchors(data: Column, kept: int = KEPT) -> Column:
    """``lowest`` of all anchors: those below a hash that enough of them should stay below, or all if they do not."""

    def of_code(code: Column) -> Column:
        # About one run in (SIZE - INNER + 1) / 2 is an anchor.
        share = F.least(F.lit(1.0), F.lit(SPARE * kept * (SIZE - INNER + 1) / 2) / F.greatest(F.octet_length(code), F.lit(1)))
        limit = (share * float(1 << 32) - float(1 << 31) - 1).cast("int")
        few = lowest(anchors(code, limit), kept)
        return _let(few, lambda f: F.when((F.size(f) >= kept) | (share >= 1), f).otherwise(lowest(anchors(code), kept)))

    return _let(data, of_code)


def _limit(found: Column, kept: int) -> Column:
    """The largest hash that further anchors of a text can have and still be among its lowest."""
    return F.when(F.size(found) >= kept, F.array_max(found)).otherwise(F.lit(_ALL))


def _short(hashed: Column) -> Column:
    """The high 32 bits of a 64-bit hash."""
    return F.shiftright(hashed, 32).cast("int")


def lowest(hashes: Column, kept: int = KEPT) -> Column:
    """The ``kept`` smallest distinct hashes, in order of their first place."""

    def cut(distinct: Column) -> Column:
        last = F.get(F.sort_array(distinct), F.lit(kept - 1))
        some = _let(last, lambda t: F.filter(distinct, lambda x: x <= t))
        return F.when(F.size(distinct) > kept, some).otherwise(distinct)

    return _let(F.array_distinct(hashes), cut)


def _or_whole(found: Column, data: Column) -> Column:
    """The anchors of a text; of one without any, the hash of it all; of the empty text none."""
    return F.when((F.size(found) > 0) | (F.octet_length(data) == 0), found).otherwise(F.array(_short(F.xxhash64(data))))


def fingerprint(text: Column, kept: int = KEPT) -> Column:
    """The fingerprint of a whole text as an array of hashes."""
    return _let(text.cast("binary"), lambda d: _let(lowest_anchors(d, kept), lambda found: _or_whole(found, d)))


def likeness(a: Column, b: Column, kept: int = KEPT) -> Column:
    """Estimated share of common anchors among all of two texts, from their fingerprints; 1 for two empty texts."""
    smallest = F.slice(F.sort_array(F.array_union(a, b)), 1, kept)
    common = F.size(F.array_intersect(smallest, F.array_intersect(a, b)))
    return F.coalesce(F.try_divide(common.cast("double"), F.size(smallest).cast("double")), F.lit(1.0))


def aligned(a: Column, b: Column) -> Column:
    """Of the anchors common to two fingerprints, how many keep their place in the order of both."""
    return F.size(F.filter(F.zip_with(F.array_intersect(a, b), F.array_intersect(b, a), lambda x, y: x == y), lambda x: x))


def _joined(hashes: Column) -> Column:
    return F.concat_ws("", F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")))


def _tail(data: Column) -> Column:
    """The last SIZE - 1 bytes, which begin the runs that reach over an end."""
    return F.substring(data, F.greatest(F.octet_length(data) - (SIZE - 2), F.lit(1)), F.lit(SIZE - 1))


def text_fingerprints(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last floor(n / 4) code points replaced by the first as many,
    or all, of the next document's. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (8 hexadecimal digits an anchor), near_edited, near_next, n_anchors,
    aligned_edited, aligned_next (anchors common to both fingerprints in the same order).

    Documents follow each other by doc_id, NULL first, then by a hash of the text; after the
    last comes the first. Rows alike in doc_id and text are one document here and share
    their results, so a table of one document is followed by itself. NULL is the empty
    text, whose fingerprint is empty. Further columns are ignored; an empty table gives no
    rows. Texts of any length are read whole, in blocks.

    Anchors do not depend on what surrounds them, so a text is scanned once: its kept part
    and the rest give its own fingerprint, the kept part and the next document's beginning
    that of the edited text. Texts are shuffled once, to meet the number of code points that
    the document before them asks for.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = ["at", "row"]
    read = docs.select(
        "doc_id",
        text.alias("text"),
        F.char_length(text).alias("n"),
        # Order and identity of a document.
        F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")).alias("at"),
        F.xxhash64(text).alias("row"),
    )
    marks = read.select(*key, F.struct(*key, "n").alias("place")).distinct()
    last = marks.agg(F.max("place").alias("place")).first()["place"]
    links = previous_in_order(marks, [F.col("at"), F.col("row")], "place", "before")
    if last is not None:
        first = F.struct(
            F.struct(F.lit(last["at"]["known"]).alias("known"), F.lit(last["at"]["id"]).cast("long").alias("id")).alias("at"),
            F.lit(last["row"]).cast("long").alias("row"),
            F.lit(last["n"]).cast("int").alias("n"),
        )
        links = links.withColumn("before", F.coalesce("before", first))
    links = links.select(*key, F.col("before.at").alias("at_b"), F.col("before.row").alias("row_b"), F.col("before.n").alias("n_b"))

    split = F.col("n") - F.floor(F.col("n") / EDITED).cast("int")
    kept_part = F.substring("text", F.lit(1), split).cast("binary")
    rest = F.substring("text", split + 1, F.col("n")).cast("binary")
    # Anchors inside the part that stays, and those that reach into or lie in the rest.
    parts = _let(
        kept_part,
        lambda d: _let(
            lowest_anchors(d, kept),
            lambda inside: F.array(inside, lowest(anchors(F.concat(_tail(d), rest), _limit(inside, kept)), kept)),
        ),
    )
    scanned = read.select(*key, "doc_id", "n", "text", parts.alias("parts"))

    def own(parts: Column, text: Column) -> Column:
        return _let(lowest(F.concat(parts[0], parts[1]), kept), lambda found: _or_whole(found, text.cast("binary")))

    # Both joins take the same columns by the same shuffle, so that texts are scanned and
    # shuffled once; a broadcast of the other side would scan them again.
    wanted = F.least(F.floor(F.col("n_b") / EDITED).cast("int"), F.col("n"))
    sent = scanned.join(links.hint("merge"), key).select(
        F.col("at_b").alias("at"),
        F.col("row_b").alias("row"),
        F.substring("text", F.lit(1), wanted).alias("head"),
        own(F.col("parts"), F.col("text")).alias("next_print"),
        F.col("doc_id").alias("next_id"),
    )
    met = scanned.join(sent.dropDuplicates(key).hint("merge"), key)
    stays, inside = F.substring("text", F.lit(1), split), F.col("parts")[0]
    reached = anchors(F.concat(_tail(stays.cast("binary")), F.col("head").cast("binary")), _limit(inside, kept))
    edited = met.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.concat(stays, "head").alias("edited"),
        own(F.col("parts"), F.col("text")).alias("own_print"),
        lowest(F.concat(inside, reached), kept).alias("found"),
        "next_print",
        "next_id",
    )
    prints = edited.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "own_print",
        _or_whole(F.col("found"), F.col("edited").cast("binary")).alias("edited_print"),
        "next_print",
        "next_id",
    )
    a, b, c = F.col("own_print"), F.col("edited_print"), F.col("next_print")
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _joined(a).alias("fingerprint"),
        _joined(b).alias("edited_fingerprint"),
        likeness(a, b, kept).alias("near_edited"),
        likeness(a, c, kept).alias("near_next"),
        F.size(a).alias("n_anchors"),
        aligned(a, b).alias("aligned_edited"),
        aligned(a, c).alias("aligned_next"),
        "next_id",
    )
