"""Jump consistent hashing: a stable shard for every key, without a ring table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commercium.llm.numbering import staged_numbers

SHARDS = 24


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: jumps ahead by ever larger random steps while it stays below ``shards``.

    A key's jumps do not depend on ``shards``, so one more shard only takes the keys
    whose next jump lands on it. About ln(shards) rounds, each over the keys still jumping.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), np.int64)
    active = np.arange(len(state))
    nxt = np.zeros(len(state), np.int64)
    while len(active):
        at[active] = nxt[active]
        state[active] = state[active] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[active] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        nxt[active] = ((at[active] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        active = active[nxt[active] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """``jump_hash`` of a long column."""

    @F.pandas_udf("int")
    def jump(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(jump_hash(part.to_numpy().astype(np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(key)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its shard, its slot there, and its shard if one were added.

    The key is a hash of doc_id, so a document keeps its shard whatever its text and
    wherever it is stored; rows of one doc_id share a shard, and a NULL doc_id is a
    key like any other. Size is the text's UTF-8 bytes (none for NULL) plus 8. Slots
    are gapless from 0 in each shard. Further columns are ignored; an empty table
    gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64(F.col("doc_id").cast("string"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
    )
    numbered = staged_numbers(rows, "shard", ["doc_id", "text_crc32", "size"], "slot", "shards")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files_per_shard: int = 1) -> None:
    """``docs`` with all its columns as parquet under ``path``, one folder ``shard=k`` per shard.

    ``files_per_shard`` deals a shard's rows over several tasks by a hash of doc_id.
    """
    key = F.xxhash64(F.col("doc_id").cast("string"))
    placed = docs.withColumn("shard", jump_shard(key, shards)).withColumn("__part", F.pmod(key, F.lit(files_per_shard)))
    dealt = placed.repartition(shards * files_per_shard, "shard", "__part").drop("__part")
    dealt.write.partitionBy("shard").parquet(path)
