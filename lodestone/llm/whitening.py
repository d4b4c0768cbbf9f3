"""Embedding whitening by hierarchical SVD merging.

Every task reads its distinct vectors block by block and keeps a summary: how many there were, their exact sums, and the
singular values and right vectors of the centred rows, all of them. Two summaries merge losslessly: the scaled vectors of
both and one row for the difference of their means, sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2), are decomposed again. Tasks'
summaries are merged FAN at a time, round after round, each round a table on shared storage; the last one has the
principal axes of all vectors. A summary has d (d + 1) numbers, however many vectors it stands for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace

#: Summaries that are merged at a time, and vectors that a block has.
FAN, BLOCK = 16, 2048
#: Entries are floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries of this size or more are left out: sums of fewer are exact.
MOST = 2.0**36
#: An axis whose variance is below this part of the largest one has no variance but rounding.
FLAT = 1e-13

STATE = "d int, n bigint, sums array<bigint>, axes binary"


@dataclass
class Summary:
    """n rows with integer sums; axes: the rows diag(s) V^T of the singular value decomposition of the centred rows."""

    n: int
    sums: np.ndarray
    axes: np.ndarray

    def minus(self, other: Summary) -> np.ndarray:
        """mean - other.mean, from exact integers as far as they go."""
        a, b = (np.divmod(x.sums, x.n) for x in (self, other))
        return (a[0] - b[0]) + (a[1] / self.n - b[1] / other.n)


def decomposed(rows: np.ndarray) -> np.ndarray:
    """diag(s) V^T with one row for each dimension, so that none is lost."""
    d = rows.shape[1]
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    out = np.zeros((d, d))
    out[: len(s)] = s[:, None] * vt
    return out


def centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """x - sums / n of integer rows, without losing digits to the size of the entries."""
    whole, rest = np.divmod(sums, n)
    return (x - whole) - rest / n


def of_rows(x: np.ndarray) -> Summary:
    sums = x.sum(axis=0)
    return Summary(len(x), sums, decomposed(centred(x, sums, len(x))))


def merged(parts: list[Summary]) -> Summary:
    """The summary of all rows of the parts: their axes and a mean-correction row a part are decomposed again."""
    total = parts[0]
    rows = [total.axes]
    for part in parts[1:]:
        rows += [part.axes, np.sqrt(total.n * (part.n / (total.n + part.n))) * total.minus(part)[None]]
        total = Summary(total.n + part.n, total.sums + part.sums, total.axes)
    return Summary(total.n, total.sums, decomposed(np.concatenate(rows)))


def integers(df: DataFrame, vector: str) -> DataFrame:
    """df's rows with a vector of finite numbers, and the vector's integers as column __x."""
    v = F.col(vector).cast("array<double>")
    whole = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST)), F.lit(False))
    # transform() is guarded: a cast of a null or huge entry is never tried
    x = F.when(whole, F.transform(v, lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT))
    return df.withColumn("__x", x).where(F.col("__x").isNotNull() & (F.size("__x") > 0))


def matrices(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers in their batch, integer rows) of at most `most` vectors of one length, and the batch before them."""
    for batch in batches:
        col = batch.column("__x")
        sizes, flat = col.value_lengths().to_numpy(), col.flatten().to_numpy()
        ends = np.cumsum(sizes)
        for d in np.unique(sizes):
            rows = np.nonzero(sizes == d)[0]
            for i in range(0, len(rows), most):
                some = rows[i : i + most]
                yield batch, some, flat[(ends[some] - d)[:, None] + np.arange(d)]


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, Summary] = {}
    for _, _, x in matrices(batches):
        part, d = of_rows(x), x.shape[1]
        held[d] = merged([held[d], part]) if d in held else part
    for d, s in held.items():
        yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "n": [s.n], "sums": [s.sums.tolist()], "axes": [s.axes.tobytes()]})


def merge_group(group: pd.DataFrame) -> pd.DataFrame:
    d = int(group["d"].iloc[0])
    parts = [Summary(int(n), np.array(sums, np.int64), np.frombuffer(axes).reshape(d, d)) for n, sums, axes in zip(group["n"], group["sums"], group["axes"], strict=True)]
    s = merged(parts) if len(parts) > 1 else parts[0]
    return pd.DataFrame({"d": [d], "n": [s.n], "sums": [s.sums.tolist()], "axes": [s.axes.tobytes()]})


@dataclass
class Whitener:
    """The fit: n vectors, their exact sums, unit axes by falling variance, their variances and the sum of all variances."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    @classmethod
    def of(cls, s: Summary) -> Whitener:
        _, values, vt = np.linalg.svd(s.axes)
        e = values**2 / s.n
        return cls(s.n, s.sums, vt, np.where(e > FLAT * e[0], e, 0.0), float(e.sum()))

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """The rows on the first k axes, each in units of its standard deviation; 0 on an axis without variance."""
        e = self.variances[:k]
        return centred(x, self.sums, self.n) @ self.axes[:k].T * np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1.0)), 0.0)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - sums)^2 of each row; null where it is no long."""
        largest = int(np.abs(x).max(initial=0)) * self.n + int(np.abs(self.sums).max(initial=0))
        if largest < 1 << 62:
            off = x * np.int64(self.n) - self.sums
            if int(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 1 << 62:
                return (off * off).sum(axis=1).tolist()
        off = x.astype(object) * self.n - self.sums.astype(object)
        return [v if v < 1 << 63 else None for v in (off * off).sum(axis=1).tolist()]


def fit(vectors: DataFrame, work: Workspace) -> dict[int, Whitener]:
    """A whitener by vector length. vectors: column __x, each vector once. Only the last summaries come to the driver."""
    states = vectors.select("__x").mapInArrow(summaries, STATE).withColumn("part", F.spark_partition_id())
    states = work.table(states)
    while (most := states.agg(F.max("part")).first()[0] or 0) > 0:
        last, up = states, F.floor(F.col("part") / FAN).cast("int")
        states = work.table(states.withColumn("part", up).groupBy("d", "part").applyInPandas(lambda key, g: merge_group(g).assign(part=key[1]), f"{STATE}, part int"))
        work.drop(last)
        assert (states.agg(F.max("part")).first()[0] or 0) < most
    out = {r.d: Whitener.of(Summary(r.n, np.array(r.sums, np.int64), np.frombuffer(r.axes).reshape(r.d, r.d))) for r in states.toLocalIterator()}
    work.drop(states)
    return out


def identity_errors(vectors: DataFrame, fitted: dict[int, Whitener], k: int) -> dict[int, float]:
    """By length: the largest entry of the whitened fit vectors' covariance, minus the identity; axes without variance are left out."""
    sent = vectors.sparkSession.sparkContext.broadcast(fitted)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for _, _, x in matrices(batches):
            w = sent.value[x.shape[1]].project(x, k)
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)  # the last row of the products has the sums
            held[x.shape[1]] = held.get(x.shape[1], 0.0) + w.T @ w
        for d, m in held.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_pydict({"d": np.full(m.size, d, np.int32), "i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "v": m.ravel()})

    rows = vectors.select("__x").mapInArrow(products, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect()
    out = {}
    for d, w in fitted.items():
        m = np.zeros((min(k, d) + 1,) * 2)
        for r in rows:
            if r.d == d:
                m[r.i, r.j] = r.v
        mean = m[-1, :-1] / w.n
        off = np.abs(m[:-1, :-1] / w.n - np.outer(mean, mean) - np.eye(len(mean)))
        live = w.variances[: len(mean)] > 0
        out[d] = float(off[np.ix_(live, live)].max(initial=0.0))
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row and each of the first axes.

    Rows whose vector is null, empty, or holds a null, a non-finite number or one of 2^36 or more are left out; a null id
    stays a row, and repeated rows stay repeated. Entries become floor(64 c) + 1000000; each distinct vector counts once
    in the fit. Vectors of different lengths are fitted apart. Shorter vectors have fewer components. An axis without
    variance (fewer distinct vectors than dimensions, constant entries) has whitened 0 and explained 0. deviation is
    null where the exact sum is no long. Any other columns of df are left behind; an empty table gives no rows.
    """
    spark, work = df.sparkSession, Workspace(df.sparkSession, "whitening")
    rows = integers(df.select(F.col(id_col).cast("bigint").alias("__id"), F.col(vector)), vector)
    distinct = work.table(rows.select("__x").distinct())
    fitted = fit(distinct, work)
    sent = spark.sparkContext.broadcast((fitted, identity_errors(distinct, fitted, components)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, errors = sent.value
        for batch, some, x in matrices(batches):
            d = x.shape[1]
            own, k = found[d], min(components, d)
            ids = batch.column("__id").take(pa.array(np.repeat(some, k)))
            explained = own.variances[:k] / own.trace if own.trace else np.zeros(k)
            yield pa.RecordBatch.from_pydict(
                {
                    id_col: ids,
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(some)),
                    "n": np.full(len(some) * k, own.n, np.int64),
                    "deviation": pa.array([v for v in own.deviations(x) for _ in range(k)], pa.int64()),
                    "whitened": own.project(x, k).ravel(),
                    "explained": np.tile(explained, len(some)),
                    "identity_error": np.full(len(some) * k, errors[d]),
                }
            )

    schema = f"`{id_col}` bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return rows.select("__id", "__x").mapInArrow(run, schema)
