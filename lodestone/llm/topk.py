"""Exact top-k search by inner product with a three-phase uniform threshold.

A score is the sum of its parts over NODES runs of dimensions. Phase 1 gathers, for each query, the vectors with the
highest parts from every slice and resolves their scores; the k-th of them is a safe cutoff. It is broadcast. A vector
that reaches the cutoff has a part of at least cutoff / NODES; phase 2 collects those entries, and phase 3 resolves
their other parts. This holds for negative parts too. Only k rows a query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODES = 4
#: Queries that are collected and broadcast at a time, and vectors that are scored at a time.
QUERY_BLOCK, ROWS = 1024, 1024


def scaled(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * component) as doubles; rows without id, or with a null or non-finite component, are left out."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).where(whole).select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows) of at most ROWS vectors of one length."""
    for batch in batches:
        ids, col = batch.column("id").to_numpy(), batch.column("v")
        sizes = col.value_lengths().to_numpy()
        flat, ends = col.flatten().to_numpy(), np.cumsum(sizes)
        for d in np.unique(sizes):
            rows = np.nonzero(sizes == d)[0]
            for i in range(0, len(rows), ROWS):
                some = rows[i : i + ROWS]
                yield ids[some], flat[(ends[some] - d)[:, None] + np.arange(d)]


def parts(queries: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    cuts = np.linspace(0, rows.shape[1], NODES + 1).astype(int)
    return [queries[:, a:b] @ rows[:, a:b].T for a, b in zip(cuts, cuts[1:], strict=False)]


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.held = k, []

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, ids, score))
        if sum(len(x[0]) for x in self.held) > 1 << 18:
            self.held = [self.rows()]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return (np.zeros(0, np.int64),) * 3
        query, ids, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        return query[place < self.k], ids[place < self.k], score[place < self.k]


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * x), over all rows of df.

    A row whose id is the query's is no candidate. Queries that share an id count once (the first by vector).
    Vectors that are null or hold a null or non-finite component take no part; a query meets vectors of its own
    length only. Repeated rows are candidates each; ties go to the smaller id. Fewer candidates than k give all.
    """
    spark = df.sparkSession
    rows = scaled(df, id_col, vector, scale)
    asked = scaled(queries, id_col, vector, scale).groupBy("id").agg(F.min("v").alias("v"))
    n = 1 + asked.count() // QUERY_BLOCK
    best = None
    for b in range(n):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b).collect()
        found = search(spark, rows, [(r.id, r.v) for r in own], k)
        best = found if best is None else best.union(found)
    return best


def search(spark, rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """top_k for a block of queries."""
    by_size: dict[int, list] = {}
    for q in queries:
        by_size.setdefault(len(q[1]), []).append(q)
    sent = spark.sparkContext.broadcast({d: (np.array([q for q, _ in x], np.int64), np.array([v for _, v in x], np.float64).reshape(len(x), d)) for d, x in by_size.items()})

    def scored(batches, cutoffs: dict[int, int] | None) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for ids, m in matrices(batches):
            if m.shape[1] not in sent.value:
                continue
            names, q = sent.value[m.shape[1]]
            own = names[:, None] == ids
            some = parts(q, m)
            if cutoffs is None:
                near = np.zeros(own.shape, bool)
                for s in some:
                    s = np.where(own, -np.inf, s)
                    top = np.argpartition(s, max(0, len(ids) - k), axis=1)[:, -k:]
                    np.put_along_axis(near, top, True, axis=1)
            else:
                cut = np.array([cutoffs.get(x, -np.inf) for x in names.tolist()])
                near = np.zeros(own.shape, bool)
                for s in some:
                    near |= s * NODES >= cut[:, None]
            a, c = np.nonzero(near & ~own)
            score = sum(s[a, c] for s in some)
            if cutoffs is not None:
                reach = score >= cut[a]
                a, c, score = a[reach], c[reach], score[reach]
            best.add(names[a], ids[c], score.astype(np.int64))
        query, ids, score = best.rows()
        yield pa.RecordBatch.from_pydict({"query_id": query, "vec_id": ids, "score": score})

    schema = "query_id bigint, vec_id bigint, score bigint"
    ordered = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    local = rows.mapInArrow(lambda batches: scored(batches, None), schema)
    kth = local.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k).groupBy("query_id").agg(F.min("score").alias("cut"), F.count("*").alias("n")).where(F.col("n") == k)
    cutoffs = spark.sparkContext.broadcast({r.query_id: r.cut for r in kth.collect()})
    full = rows.mapInArrow(lambda batches: scored(batches, cutoffs.value), schema)
    return full.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
