"""Exact duplicates against a history held in minimal perfect hash tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commercium.llm.text import mix, salt, spare
from commercium.sources.staging import stage

DIGESTS_PER_BUCKET = 20_000
_LOAD = 2  # bits per key in each level


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests.

    Each level has two bits per key still without a place; keys alone on their bit
    take it, the rest go on to the next level. A key's slot is the rank of its bit
    among all bits set, so n keys fill slots 0 to n - 1. Other digests get any slot
    or -1: the caller compares the digest stored in the slot.
    """

    def __init__(self, digests: np.ndarray):
        self.levels: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        left, placed = self._words(digests), 0
        while len(left):
            bit = self._bit(left, len(self.levels), _LOAD * len(left))
            taken = np.bincount(bit, minlength=_LOAD * len(left)) == 1
            self.levels.append(taken)
            self.ranks.append(placed + np.cumsum(taken) - taken)
            placed += int(taken.sum())
            left = left[~taken[bit]]
            if len(self.levels) > 200:
                raise ValueError("digests are not distinct")

    @staticmethod
    def _words(digests: np.ndarray) -> np.ndarray:
        words = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
        return words[:, 0] ^ mix(words[:, 1] ^ mix(words[:, 2] ^ mix(words[:, 3])))

    @staticmethod
    def _bit(words: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(words + salt(level + 1)) % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        words = self._words(digests)
        out = np.full(len(words), -1, np.int64)
        open_ = np.arange(len(words))
        for level, (taken, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            bit = self._bit(words[open_], level, len(taken))
            hit = taken[bit]
            out[open_[hit]] = rank[bit[hit]]
            open_ = open_[~hit]
        return out


def _matrix(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


_OUT = "digest binary, keep_id long, group_size long, in_history boolean"


def _lookup(history: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """One bucket: build the table of the history's digests, look the batch up, group the rest.

    Both sides have one row per distinct digest. A lookup counts only if all 32
    bytes in the slot are equal.
    """
    if len(history):
        old = _matrix(history["digest"])
        table = PerfectHash(old)
        where = table.slots(old)
        stored = np.empty_like(old)
        stored[where] = old
        winner, size = np.empty(len(old), np.int64), np.empty(len(old), np.int64)
        winner[where] = history["winner"]
        size[where] = history["n"]
    else:
        stored, winner, size = np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.zeros(len(batch), bool)
    if len(history) and len(batch):
        new = _matrix(batch["digest"])
        slot = table.slots(new)
        found = (slot >= 0) & (stored[slot] == new).all(axis=1)
        hit = slot[found]
        winner[hit] = np.maximum(winner[hit], batch["winner"].to_numpy()[found])
        size[hit] += batch["n"].to_numpy()[found]
    fresh = batch[~found]
    return pd.DataFrame(
        {
            "digest": [x.tobytes() for x in stored] + list(fresh["digest"]),
            "keep_id": np.concatenate([winner, fresh["winner"].to_numpy(np.int64)]),
            "group_size": np.concatenate([size, fresh["n"].to_numpy(np.int64)]),
            "in_history": np.repeat([True, False], [len(stored), len(fresh)]),
        }
    )


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the 32-byte SHA-256 of each text, NULL as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"))


def dedup_groups(history: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per distinct digest of two tables of ``digest_rows``: digest, keep_id, group_size, in_history.

    Each side is first reduced to one row per digest, with counts, so a text with
    a third of all rows travels as one row per task. Buckets are prefixes of the
    digest, hence even, and sized to about DIGESTS_PER_BUCKET digests.
    """
    buckets = max(1, (history.count() + batch.count()) // DIGESTS_PER_BUCKET)
    # A NULL doc_id loses to any other; -2**63 stands for it inside.
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    bucket = F.pmod(F.xxhash64(F.substring("digest", 1, 8)), F.lit(buckets))

    def reduced(rows: DataFrame) -> DataFrame:
        each = rows.groupBy("digest").agg(F.max(key).alias("winner"), F.count("*").alias("n"))
        # The alias gives each side a column of its own, though both come from one table.
        own = F.col("digest").alias("digest")
        return each.select(bucket.alias("bucket"), own, "winner", "n").groupBy("bucket")

    return reduced(history).cogroup(reduced(batch)).applyInPandas(_lookup, _OUT)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): keep_id, group_size, kept, text_sha256, in_history.

    The older half of the doc_id range is the history, the newer half the batch
    looked up in it. Of equal texts the row with the largest doc_id stays. NULL
    text equals the empty text. Rows that repeat a doc_id and its text share their
    keep_id and ``kept``; keep_id is NULL where a whole group has no doc_id.
    Further columns are ignored; an empty table gives no rows.
    """
    rows = stage(digest_rows(docs), "digests")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else (low + high) // 2  # Python's integers do not overflow
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(True))
    groups = dedup_groups(rows.where(old), rows.where(~old))
    keep = F.when(F.col("keep_id") != -(2**63), F.col("keep_id"))
    return rows.join(groups, "digest").select(
        "doc_id",
        keep.alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "in_history",
    )


def keep_distinct(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, one row for each distinct text: that of the largest doc_id.

    Rows that repeat both doc_id and text stay once. NULL text equals the empty text; a
    NULL doc_id loses to any other. Further columns are carried along whatever their
    names; an empty table gives no rows.
    """
    kept = exact_dedup(docs.select("doc_id", "text")).where("kept").select("doc_id", "text_sha256").distinct().alias("__kept")
    sha = F.sha2(F.encode(F.coalesce(F.col("__docs.text"), F.lit("")), "UTF-8"), 256)
    same = F.col("__docs.doc_id").eqNullSafe(F.col("__kept.doc_id")) & (sha == F.col("__kept.text_sha256"))
    joined = docs.alias("__docs").join(kept, same, "left_semi")
    if docs.select("doc_id").distinct().count() < docs.count():
        body = spare(docs.columns, "body")
        joined = joined.withColumn(body, F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", body]).drop(body)
    return joined


ORACLE = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256,
  min(doc_id) over g <= (select (min(doc_id)::hugeint + max(doc_id)::hugeint) // 2 from documents) as in_history
from documents window g as (partition by coalesce(text, ''))
"""
