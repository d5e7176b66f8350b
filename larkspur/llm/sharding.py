"""Balanced shards by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, chunk_count, with_start


def schedule(sizes: list[int], shards: int, loads: list[int] | None = None) -> list[int]:
    """Shard of each size, given largest first: each goes to the least-loaded shard, of equal ones to the lowest number."""
    heap = [(load, i) for i, load in enumerate(loads or [0] * shards)]
    heapq.heapify(heap)
    out = []
    for size in sizes:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out.append(shard)
    return out


def group_shards(groups: DataFrame, shards: int, n_groups: int, key: str = "key", weight: str = "weight", chunk_groups: int = 50_000) -> DataFrame:
    """Shard of each group, by longest-processing-time scheduling in two levels.

    Groups are dealt into chunks by a hash of their key. Within a chunk, sorted by size, a heap of `shards` bins takes them one after
    another, so a task holds no more than the heap. The bins of all chunks, at most 4096 times `shards`, are then scheduled
    in the same way on the driver. Up to `chunk_groups` groups are one chunk, which is the plain schedule; beyond that placement differs, and a test
    holds its fullest shard within 1 % of the plain schedule's. Returns (key, shard).
    """
    chunks = chunk_count(n_groups, chunk_groups)
    kind = groups.select(key).schema[0].dataType.simpleString()
    dealt = groups.select(F.col(key).alias("key"), F.col(weight).cast("long").alias("weight"), F.pmod(F.xxhash64(F.lit(7), key), F.lit(chunks)).cast("int").alias("chunk"))
    dealt = dealt.repartition(chunks, "chunk").sortWithinPartitions("chunk", F.desc("weight"), "key")

    def run(batches):
        chunk, heap = None, []
        for batch in batches:
            weights, numbers = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            bins = np.empty(len(weights), np.int32)
            for i, (size, number) in enumerate(zip(weights, numbers)):
                if number != chunk:
                    chunk, heap = number, [(0, s) for s in range(shards)]
                load, at = heap[0]
                heapq.heapreplace(heap, (load + size, at))
                bins[i] = number * shards + at
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bins)], names=["key", "weight", "bin"])

    binned = checkpointed(dealt.mapInArrow(run, f"key {kind}, weight long, bin int"))
    loads = sorted(((row.load, row.bin) for row in binned.groupBy("bin").agg(F.sum("weight").alias("load")).collect()), key=lambda x: (-x[0], x[1]))
    placed = schedule([load for load, _ in loads], shards)
    table = groups.sparkSession.createDataFrame([(number, shard) for (_, number), shard in zip(loads, placed)], "bin int, shard int")
    return binned.join(F.broadcast(table), "bin").select(F.col("key").alias(key), "shard")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard, rows of equal text together, so that sizes are as near equal as such groups allow.

    A row's size is the UTF-8 bytes of its text plus 1. Returns one row for each input row: the id column, size, text_crc32 (unsigned),
    law ("bytes"), shard, slot (0 on, without gaps, within the shard) and grown_shard (null: this law answers no such question).
    A null text is one with no bytes and goes with the empty ones. Null ids and repeated rows are kept, each with its own slot;
    an empty table gives an empty one; other columns are not looked at. A group larger than a fair share stays whole and alone.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = checkpointed(rows)
    groups = checkpointed(rows.groupBy("key").agg(F.sum("size").alias("weight")))
    placed = group_shards(groups, shards, groups.count())
    out = rows.join(placed, "key")
    out = with_start(out, ["shard"], F.lit(1), ["id", "key"], rows.count(), start="slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
