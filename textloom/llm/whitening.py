"""Whitening of embeddings by their covariance, which is summed in double-double arithmetic.

Each task centres its vectors and adds up their outer products as pairs of doubles, a high and a low part: products and sums go through
error-free transformations, so nothing is lost that a pair can hold. The tasks' pairs are then dealt by matrix row, and each row's are
added in the order of the tasks, high and low parts together; the result is the same whatever executor ran what. The driver holds only
one matrix. Its eigenvectors come from LAPACK's driver for tridiagonal divide and conquer (which numpy.linalg.eigh calls), and
are then refined against the matrix in extended precision. Whitened vectors are written once and measured in the same way as the vectors.

Defined results: a vector that is null or empty, that holds a null or non-finite entry, or that is shorter than the longest vector
without such entries (it lacks entries) is left out. Ids may be null or repeat; every remaining row counts and is returned. Without rows
there is no result. A component whose eigenvalue is zero to working precision has whitened and explained 0, and identity_error regards
the others only (0 where there are none). Vectors of fewer than eight entries have as many components. Entries are held within 2^53 in
size once scaled; a deviation that no long can hold is null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise, read_table

#: Components that are returned.
COMPONENTS = 8
#: x = floor(SCALE * c) + SHIFT. Fixed by the contract.
SCALE, SHIFT = 1024.0, 100_000
#: Products that are formed at a time: 1 MB of doubles.
PRODUCTS = 1 << 17
#: An eigenvalue below this share of the trace is zero.
LEAST_SHARE = 1e-13


def two_sum(a, b):
    """The rounded sum of doubles and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a):
    """A double as the sum of two that have 26 bits each."""
    t = a * 134217729.0
    high = t - (t - a)
    return high, a - high


def add_pairs(ah, al, bh, bl):
    """The sum of two double-doubles, normalised."""
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def sum_pairs(high, low):
    """The double-double sum along the first axis, by halving it."""
    while len(high) > 1:
        n = len(high) // 2
        h, l = add_pairs(high[:n], low[:n], high[n : 2 * n], low[n : 2 * n])  # noqa: E741
        if len(high) % 2:
            h, l = np.concatenate([h, high[-1:]]), np.concatenate([l, low[-1:]])  # noqa: E741
        high, low = h, l
    return high[0], low[0]


def centred(x: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x less the mean (its high and low parts, in two rows), as double-doubles."""
    h, l = two_sum(x, -mean[0])  # noqa: E741
    return two_sum(h, l - mean[1])


def outer_sum(x: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows' centred outer products, upper triangle, as double-doubles."""
    d = x.shape[1]
    i, j = np.triu_indices(d)
    high, low = np.zeros(len(i)), np.zeros(len(i))
    step = max(1, PRODUCTS // len(i))
    for at in range(0, len(x), step):
        zh, zl = centred(x[at : at + step], mean)
        a, b = halves(zh)
        p = zh[:, i] * zh[:, j]
        e = ((a[:, i] * a[:, j] - p) + a[:, i] * b[:, j] + b[:, i] * a[:, j]) + b[:, i] * b[:, j]
        e += zh[:, i] * zl[:, j] + zl[:, i] * zh[:, j]
        high, low = add_pairs(high, low, *sum_pairs(p, e))
    return high, low


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of an Arrow list column are whole (not null, not empty, all entries finite), and the length of each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.list_(pa.float64()))
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten(), np.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(size)), size)
    bad = np.bincount(owner[~np.isfinite(flat)], minlength=len(size)) > 0
    good = (size > 0) & ~bad
    return good, size, flat, owner


def scaled(values: np.ndarray) -> np.ndarray:
    """The integers x of the contract, as doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values) + SHIFT, -(2.0**53), 2.0**53)


def as_given(values: np.ndarray) -> np.ndarray:
    return values


def _vectors(batches, at: int, d: int | None, prepare: Callable):
    """Of each Arrow batch: which rows remain, and their vectors, one a row. d: the length of vectors; None: the longest of the batch."""
    for batch in batches:
        good, size, flat, owner = _matrix(batch.column(at))
        length = d if d is not None else int(size[good].max(initial=0))
        good &= size == length
        yield batch, good, prepare(flat[good[owner]].reshape(int(good.sum()), length))


def _sums(vectors: DataFrame, prepare: Callable) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Number of vectors, and the sums of their entries as high and low parts. Sums of integers are exact."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        n, high, low = 0, np.zeros(0), np.zeros(0)
        for _, _, x in _vectors(batches, 0, None, prepare):
            if x.shape[1] > len(high):
                n, high, low = 0, np.zeros(x.shape[1]), np.zeros(x.shape[1])
            if len(x) and x.shape[1] == len(high):
                n, (high, low) = n + len(x), add_pairs(high, low, *sum_pairs(x, np.zeros_like(x)))
        if n:
            d = len(high)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * d, pa.int32()), pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)], ["part", "d", "i", "n", "high", "low"])

    found = vectors.mapInArrow(run, "part int, d int, i int, n long, high double, low double")
    rows = _merged(found.select("part", "i", "d", "n", F.array("high").alias("high"), F.array("low").alias("low")))
    if not rows:
        return None
    d = max(r[1] for r in rows.values())
    return rows[0][2], np.array([rows[i][3][0] for i in range(d)]), np.array([rows[i][4][0] for i in range(d)])


def _merged(partial: DataFrame) -> dict[int, tuple]:
    """From (part, i, d, n, high, low), arrays of doubles of each task and matrix row i: for each i the sums over the tasks that have the
    longest d, added in the order of the tasks: (i, d, n, high, low). A matrix row's pairs stream through one task, one at a time."""

    def run(batches):
        import pyarrow as pa

        held: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                h, l = np.array(r["high"]), np.array(r["low"])  # noqa: E741
                own = held.get(r["i"])
                if own is None or r["d"] > own[0]:
                    held[r["i"]] = [r["d"], r["n"], h, l]
                elif r["d"] == own[0]:
                    own[1:] = [own[1] + r["n"], *add_pairs(own[2], own[3], h, l)]
        rows = [{"i": i, "d": d, "n": n, "high": h.tolist(), "low": l.tolist()} for i, (d, n, h, l) in held.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("i", pa.int32()), ("d", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))]))

    sums = partial.repartition("i").sortWithinPartitions("i", "part").mapInArrow(run, "i int, d int, n long, high array<double>, low array<double>")
    return {r["i"]: (r["i"], r["d"], r["n"], r["high"], r["low"]) for r in sums.collect()}  # one row for each entry of a vector


def _co_moments(vectors: DataFrame, mean: np.ndarray, prepare: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The sum of centred outer products of all vectors, as high and low parts."""
    d = mean.shape[1]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        i, j = np.triu_indices(d)
        high, low = np.zeros(len(i)), np.zeros(len(i))
        for _, _, x in _vectors(batches, 0, d, prepare):
            if len(x):
                high, low = add_pairs(high, low, *outer_sum(x, mean))
        part, ends = TaskContext.get().partitionId(), np.cumsum(np.arange(d, 0, -1))[:-1]
        cut = lambda v: pa.array([w.tolist() for w in np.split(v, ends)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([part] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([d] * d, pa.int32()), pa.array([0] * d, pa.int64()), cut(high), cut(low)], ["part", "i", "d", "n", "high", "low"])

    rows = _merged(vectors.mapInArrow(run, "part int, i int, d int, n long, high array<double>, low array<double>"))
    high, low = np.zeros((d, d)), np.zeros((d, d))
    for i, (_, _, _, h, l) in rows.items():
        high[i, i:] = high[i:, i] = h
        low[i, i:] = low[i:, i] = l
    return high, low


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors, in columns, of a symmetric matrix in high and low parts.

    Divide and conquer on the tridiagonal form of the high part, then four steps of refinement against both parts in extended precision."""
    values, vectors = np.linalg.eigh(high)
    v, x = high.astype(np.longdouble) + low, vectors.astype(np.longdouble)
    for _ in range(4):
        r, s = np.eye(len(x), dtype=np.longdouble) - x.T @ x, x.T @ (v @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else their rounding, over small gaps, would spoil orthogonality
        e = np.diag(s) / (1 - np.diag(r))
        gap = e[None, :] - e[:, None]
        near = np.abs(gap) <= 1e-12 * max(np.abs(e).max(initial=0), np.finfo(float).tiny)
        change = np.where(near, r / 2, (s + e[None, :] * r) / np.where(near, 1, gap))
        x, values = x + x @ change, e
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))
    return values[order].astype(float), x.astype(float)


@dataclass(frozen=True)
class Whitener:
    """What a task needs to whiten: n vectors, exact sums of their scaled entries, their mean in two parts, components in columns, eigenvalues
    and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        high, low = centred(x, self.mean)
        live = self.values > LEAST_SHARE * self.trace
        scale = np.where(live, 1 / np.sqrt(np.where(live, self.values, 1.0)), 0.0)
        return (high @ self.components + low @ self.components) * scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over entries of (n x - sum)^2 of each row, exact."""
        most = float(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if most * most * x.shape[1] < 2.0**62:
            y = x.astype(np.int64) * self.n - np.array(self.sums, np.int64)
            return (y * y).sum(1).tolist()
        y = x.astype(np.int64).astype(object) * self.n - np.array(self.sums, object)
        return [s if s < 1 << 63 else None for s in map(int, (y * y).sum(1))]


def mean_pair(high: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """Sums over n, rounded to high and low parts."""
    exact = [(Fraction(h) + Fraction(l)) / n for h, l in zip(high.tolist(), low.tolist(), strict=True)]
    top = [float(q) for q in exact]
    return np.array([top, [float(q - Fraction(t)) for q, t in zip(exact, top, strict=True)]])


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Whitener | None:
    """Learns from all vectors of a table with the one column of arrays; None if none remains. Two passes: sums, then products."""
    sums = _sums(vectors, scaled)
    if sums is None:
        return None
    n, high, low = sums
    mean = mean_pair(high, low, n)
    values, components = eigen(*(m / n for m in _co_moments(vectors, mean, scaled)))
    return Whitener(n, tuple(int(h) + int(l) for h, l in zip(high.tolist(), low.tolist(), strict=True)), mean, components[:, :k], values[:k], float(values.sum()))


def whiten(rows: DataFrame, model: Whitener, vector: str) -> DataFrame:
    """The remaining rows' other columns, ``deviation`` and ``whitened``, an array with an entry for each component."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in rows.columns if c not in (vector, "deviation", "whitened")]

    def run(batches):
        import pyarrow as pa

        own = shared.value
        for batch, good, x in _vectors(batches, 0, own.mean.shape[1], scaled):
            kept = [batch.column(1 + i).filter(pa.array(good)) for i in range(len(rest))]
            w = pa.FixedSizeListArray.from_arrays(pa.array(own.project(x).ravel()), own.components.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(own.deviation(x), pa.int64()), w], [*rest, "deviation", "whitened"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    return rows.select(vector, *rest).mapInArrow(run, f"{kinds + ', ' if rest else ''}deviation long, whitened array<double>")


def identity_error(white: DataFrame, model: Whitener) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, measured on all of them."""
    live = np.flatnonzero(model.values > LEAST_SHARE * model.trace)
    if not len(live):
        return 0.0
    vectors = white.select("whitened")
    n, high, low = _sums(vectors, as_given)
    moments, _ = _co_moments(vectors, mean_pair(high, low, n), as_given)
    return float(np.abs(moments[np.ix_(live, live)] / n - np.eye(len(live))).max())


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """Every remaining vector of embeddings on the first eight components."""
    table = read_table(spark, sf_dir, "embeddings")
    names = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = table.select(F.col("embedding").cast("array<double>").alias("vector"), F.col("vec_id").cast("long").alias("vec_id"))
    model = fit(rows.select("vector"))
    if model is None:
        return spark.createDataFrame([], names)
    white = materialise(whiten(rows, model, "vector"), "whitened")
    error = identity_error(white, model)
    explained = F.array(*[F.lit(float(v) / model.trace if v > LEAST_SHARE * model.trace else 0.0) for v in model.values])
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
