"""Exact top-k search by inner product: columnar branch and bound."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Dimensions added at a time, candidates and queries held in a block.
DIMS, CANDIDATES, QUERIES = 16, 8192, 64
#: Most bytes of queries sent to executors at once; more queries go in further passes over the candidates.
BROADCAST_BYTES = 32 << 20


class Best:
    """The k highest scores of each query so far, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.scores = [np.empty(0, np.int64) for _ in ids]
        self.found = [np.empty(0, np.int64) for _ in ids]
        self.least = np.full(len(ids), -np.inf)
        self.mass = rest_mass(vectors)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.found[q], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.found[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[q] = self.scores[q][-1]


def rest_mass(vectors: np.ndarray) -> np.ndarray:
    """Length of what is left of each vector (row) from each block of dimensions on, rounded up."""
    squares = np.square(vectors.astype(np.float64))
    starts = range(0, vectors.shape[1] + DIMS, DIMS)
    return np.stack([np.sqrt(squares[:, s:].sum(1)) * (1 + 1e-9) for s in starts], 1)


def search(best: Best, ids: np.ndarray, vectors: np.ndarray) -> None:
    """Take a block of candidates into account.

    Vectors stand column by column. Blocks of dimensions add up to partial scores; after each, a candidate stays only if some query
    could still place it, its partial score plus the product of both remaining lengths being no less than the query's k-th score.
    """
    exact = float(np.abs(vectors).max(initial=0)) * float(np.abs(best.vectors).max(initial=0)) * max(1, vectors.shape[1]) < 2**53
    kind = np.float64 if exact else np.int64
    columns, mass = np.ascontiguousarray(vectors.T.astype(kind)), rest_mass(vectors)
    for first in range(0, len(best.ids), QUERIES):
        some = slice(first, first + QUERIES)
        queries = best.vectors[some].astype(kind)
        alive, partial = np.arange(len(ids)), np.zeros((len(queries), len(ids)), kind)
        for block, start in enumerate(range(0, columns.shape[0], DIMS)):
            partial = partial + queries[:, start : start + DIMS] @ columns[start : start + DIMS, alive]
            bound = partial + best.mass[some, block + 1][:, None] * mass[alive, block + 1][None, :]
            stay = (bound >= best.least[some][:, None]).any(0)
            if not stay.all():
                alive, partial = alive[stay], partial[:, stay]
            if not len(alive):
                break
        for q in range(len(queries)):
            placed = np.flatnonzero(partial[q] >= best.least[first + q]) if len(alive) else []
            placed = [i for i in placed if ids[alive[i]] != best.ids[first + q]] if len(placed) <= 64 else np.asarray(placed)[ids[alive[placed]] != best.ids[first + q]]
            if len(placed):
                best.add(first + q, partial[q][placed].astype(np.int64), ids[alive[placed]])


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(key: Column, vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return key.isNotNull() & vector.isNotNull() & ~odd


def exact_top_k(table: DataFrame, queries: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query row with every other row.

    Components become floor(scale * x). `queries` is a condition on the table's columns. Returns query_id, rank (from 1), vec_id, score;
    ties go to the smaller id; a query with fewer candidates gets them all. Rows with a null id, a null vector or a component that is
    null or not finite take no part; vectors of another length than the query's aren't compared; rows that bear the query's own
    id aren't candidates; repeated query rows of one id and vector are one query; other columns are not looked at.

    Queries are sent to executors by the part: each part holds at most BROADCAST_BYTES, and candidates are read once for each.
    Every task keeps k candidates a query, so what is shuffled grows with tasks times queries, not with candidates.
    """
    spark = table.sparkSession
    key, vector = F.col(id_col), F.col(vector_col)
    good = table.where(usable(key, vector))
    asked = good.where(queries).select(key.cast("long").alias("id"), scaled(vector, scale).alias("v")).distinct()
    bytes_ = asked.agg(F.sum(F.size("v") * 8 + 8)).first()[0] or 0
    parts = max(1, math.ceil(bytes_ / BROADCAST_BYTES))
    candidates = good.select(key.cast("long").alias("id"), scaled(vector, scale).alias("v"))
    schema = "query_id long, query_no int, vec_id long, score long"
    found = None
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).orderBy("id", "v").collect()
        by_length: dict[int, tuple[list, list, list]] = {}
        for no, row in enumerate(rows):
            ids, vectors, numbers = by_length.setdefault(len(row.v), ([], [], []))
            ids.append(row.id), vectors.append(row.v), numbers.append(no)
        sent = spark.sparkContext.broadcast({n: (np.array(i, np.int64), np.array(v, np.int64).reshape(len(i), n), np.array(m, np.int32)) for n, (i, v, m) in by_length.items()})

        def run(batches, sent=sent):
            best = {n: Best(i, v, k) for n, (i, v, _) in sent.value.items()}
            for batch in batches:
                ids, vectors = batch.column(0).to_numpy(), batch.column(1)
                lengths = np.diff(vectors.offsets.to_numpy())
                flat, offsets = vectors.values.to_numpy(), vectors.offsets.to_numpy()
                for n in np.unique(lengths):
                    if int(n) not in best:
                        continue
                    mine = np.flatnonzero(lengths == n)
                    matrix = flat[offsets[mine][:, None] + np.arange(n)[None, :]]
                    for at in range(0, len(mine), CANDIDATES):
                        search(best[int(n)], ids[mine[at : at + CANDIDATES]], matrix[at : at + CANDIDATES])
            for n, b in best.items():
                sizes = [len(x) for x in b.found]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.ids, sizes)), pa.array(np.repeat(sent.value[n][2], sizes)), pa.array(np.concatenate(b.found)), pa.array(np.concatenate(b.scores))], names=["query_id", "query_no", "vec_id", "score"])

        one = candidates.mapInArrow(run, schema).withColumn("part", F.lit(part))
        found = one if found is None else found.unionAll(one)
    order = Window.partitionBy("part", "query_no").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
