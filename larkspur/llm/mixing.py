"""Mixing sources to target weights: fixed-length blocks, multinomial counts per output shard, permuted block indexes."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, unused, with_start

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Target of each source: `share` of the total by weight, none above `most` times its size; the excess is shared again."""
    out = [0.0] * len(sizes)
    rest, active = share * sum(sizes), [i for i, n in enumerate(sizes) if n > 0]
    while active:
        whole = sum(weights[i] for i in active)
        over = [i for i in active if rest * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in active:
                out[i] = rest * weights[i] / whole
            break
        for i in over:
            out[i] = most * sizes[i]
            rest -= out[i]
        active = [i for i in active if i not in over]
    return out


def permuted(index: np.ndarray, size: int, seed: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1, at each index, or its inverse: a Feistel network of four rounds, walked until it falls inside."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)

    def mixed(part: np.ndarray, turn: int) -> np.ndarray:
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03 + 1) & 0xFFFFFFFFFFFFFFFF)
        x = (part + key) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return (x >> np.uint64(29)) & mask

    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for turn in range(3, -1, -1) if back else range(4):
            if back:
                left, right = right ^ mixed(left, turn), left
            else:
                left, right = right, left ^ mixed(right, turn)
        x = (left << np.uint64(half)) | right
        out[todo] = x
        todo = out >= np.uint64(size)
    return out.astype(np.int64)


def draws(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each output shard.

    Shards are of equal size. Each takes a multinomial draw whose chances are what the sources still owe, so over all shards a source
    gets exactly its slots; what a draw takes beyond that is drawn again.
    """
    rng, left = np.random.default_rng(seed), np.array(slots, np.int64)
    total, out = int(left.sum()), np.zeros((shards, len(slots)), np.int64)
    for k in range(shards):
        want = total * (k + 1) // shards - total * k // shards
        while want > 0:
            take = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[k] += take
            left -= take
            want -= int(take.sum())
    return out


@dataclass
class Mix:
    """Plan of a mix: rows (packed documents), slots (drawn blocks) and the table of sources."""

    rows: DataFrame
    slots: DataFrame
    sources: DataFrame
    block: int


def plan_mix(docs: DataFrame, extra: list[str], id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float, block: int, seed: int) -> Mix:
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("hash"), *extra))
    totals = sorted(((r.source, r.words or 0) for r in rows.groupBy("source").agg(F.sum("size").alias("words")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [words for _, words in totals]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    owed = [min(round(aim), int(most * size)) for aim, size in zip(aims, sizes)]
    table = spark.createDataFrame([(i, s, n, a) for i, ((s, n), a) in enumerate(zip(totals, aims))], "source_no int, source string, source_size long, target double")

    blocks = [math.ceil(n / block) for n in sizes]
    # One slot more than whole blocks need: the short last block may be among those drawn.
    slots = [(w // n) * b + min(b, math.ceil(w % n / block) + 1) if n else 0 for w, n, b in zip(owed, sizes, blocks)]
    total = sum(slots)
    shards = max(1, min(1024, math.ceil(total / 4096)))
    counts = draws(slots, shards, seed)
    begins = np.concatenate([[0], np.cumsum(counts.reshape(-1))])  # slots go by shard, then source
    earlier = np.cumsum(counts, 0) - counts
    n_sources = len(sizes)

    def run(batches):
        for batch in batches:
            slot = batch.column(0).to_numpy()
            cell = np.searchsorted(begins, slot, "right") - 1
            shard, source = np.divmod(cell, n_sources)
            turn = slot - begins[cell] + earlier[shard, source]  # of the source, over all shards
            index, take, epoch = np.zeros_like(slot), np.zeros_like(slot), np.zeros_like(slot)
            for s in np.unique(source):
                mine = source == s
                b, n, w = blocks[s], sizes[s], owed[s]
                epoch[mine], at = np.divmod(turn[mine], b)
                short = n - (b - 1) * block
                for e in np.unique(epoch[mine]):
                    of = np.flatnonzero(mine)[epoch[mine] == e]
                    order = at[epoch[mine] == e]
                    index[of] = permuted(order, b, seed + 1_000_003 * int(s) + int(e))
                    last = permuted(np.array([b - 1]), b, seed + 1_000_003 * int(s) + int(e), back=True)[0]  # place of the short block
                    before = order * block - (block - short) * (order > last)
                    take[of] = np.clip(w - e * n - before, 0, np.where(index[of] == b - 1, short, block))
            keep = take > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (slot, shard.astype(np.int32), source.astype(np.int32), epoch.astype(np.int32), index, take)], names=["slot", "shard", "source_no", "epoch", "block", "take"])

    drawn = spark.range(total).mapInArrow(run, "slot long, shard int, source_no int, epoch int, block long, take long")
    placed = with_start(rows, ["source"], F.col("size"), ["id", "hash"], rows.count())
    small = F.broadcast(table) if len(sizes) <= BROADCAST_SOURCES else table
    placed = checkpointed(placed.join(small, placed["source"].eqNullSafe(table["source"])).drop(table["source"]))
    return Mix(placed, drawn, table, block)


def pieces(mix: Mix) -> DataFrame:
    """Drawn words of each document: joins the blocks it lies in with the slots that drew them.

    Rows have the columns of mix.rows, epoch, slot, shard, and first and last: words [first, last) of the document.
    """
    size, start = F.col("size"), F.col("start")
    packed = mix.rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(start / mix.block), F.floor((start + size - 1) / mix.block))))
    begin = F.col("block") * mix.block
    first = F.greatest(begin, start) - start
    last = F.least(begin + F.col("take"), start + size) - start
    return packed.join(mix.slots, ["source_no", "block"]).withColumns({"first": first, "last": last}).where("last > first")


#: Words of a block.
BLOCK_WORDS = 256
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 100_000


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """How many words the mix takes of each document.

    The words of a source, document after document, are packed into blocks of `block` words. Sources weigh `weights` in turn, by code
    point, null last, and share `share` of all words; none is taken above `most` times its size (a whole number). Blocks are drawn
    without return in each pass over a source, so no document is taken more than `most` times; a source's last draw is cut
    to the words still owed. Returns one row for each input row: the id column, size, source_size, target, taken.
    A null text has no words; a null source is a source; null ids and repeated rows are kept; an empty table gives an empty one;
    columns other than the three named are not looked at. The same rows and seed give the same mix, in whatever order rows stand.
    """
    if docs.isEmpty():
        return docs.select(F.col(id_col), *(F.lit(None).cast(k).alias(c) for c, k in (("size", "long"), ("source_size", "long"), ("target", "double"), ("taken", "long"))))
    mix = plan_mix(docs, [], id_col, text_col, source_col, weights, share, most, block, seed)
    took = pieces(mix).groupBy("source_no", F.col("start").alias("at")).agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    took = took.withColumnRenamed("source_no", "no")
    rows = mix.rows
    on = (rows["source_no"] == took["no"]) & (rows["start"] == took["at"]) & (rows["size"] > 0)
    return rows.join(took, on, "left").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: for each document and pass, a row of the input's columns whose text is the words drawn, with what lies between them.

    A document drawn whole keeps its whole text. Documents without words, null texts among them, are kept once. Rows of one id and text under several sources
    are documents of their own, each with the words drawn of its source; rows equal in id, text and source give as many rows as were drawn of them all, with
    the other columns of one of them. Null ids and sources count like others, columns of any name stay, an empty table gives an empty one. Otherwise as `mix_sources`.
    """
    how = {"weights": (5, 2, 1), "share": 1.5, "most": 2.0, "block": BLOCK_WORDS, "seed": 17} | how
    if docs.isEmpty():
        return docs
    mix = plan_mix(docs, [], id_col, text_col, source_col, **how)
    own_hash, own_source, key, hash_, source, spans = unused(docs.columns, "text_hash", "source_name", "key", "hash", "source_of", "spans")
    drawn = pieces(mix).groupBy("id", "hash", "source", "start", "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias(spans))
    none = mix.rows.where("size = 0").select("id", "hash", "source", "start", F.lit(0).alias("epoch"), F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias(spans))
    found = drawn.unionByName(none).select(F.col("id").alias(key), F.col("hash").alias(hash_), F.col("source").alias(source), spans)
    texts = docs.withColumns({own_hash: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), own_source: F.col(source_col).cast("string")}).dropDuplicates([id_col, own_hash, own_source])
    joined = texts.join(found, texts[id_col].eqNullSafe(found[key]) & (texts[own_hash] == found[hash_]) & texts[own_source].eqNullSafe(found[source]))
    return joined.withColumn(text_col, F.pandas_udf(cut_words, "string")(F.col(text_col), F.col(spans))).select(*docs.columns)


def cut_words(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Text from word to word of each span, spans that touch taken together."""
    word, out = re.compile(WORD), []
    for text, found in zip(texts, spans):
        if text is None or found is None:
            out.append(text)
            continue
        places = [m.span() for m in word.finditer(text)]
        joined: list[list[int]] = []
        for span in found:
            first, last = int(span["first"]), int(span["last"])
            if joined and joined[-1][1] == first:
                joined[-1][1] = last
            else:
                joined.append([first, last])
        whole = joined == [[0, len(places)]]
        out.append(text if whole else "\n".join(text[places[a][0] : places[b - 1][1]] for a, b in joined))
    return pd.Series(out, dtype=object)
