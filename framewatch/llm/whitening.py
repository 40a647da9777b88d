"""Whitening of integer-scaled vectors by refined principal components.

The fit list is each distinct vector once. Its sums are exact integers, its
covariance a sum of one matrix a task, centred before it is multiplied. Float32
eigenvectors of that matrix are corrected by the iteration of Ogita and Aishima in
extended precision: each step is a few matrix products and squares the error.
Where eigenvalues lie closer than the step can tell, the matrix restricted to
their subspace, less their mean, is solved by itself and turns these vectors.

Only matrices of dimension x dimension reach the driver; rows are distinct, scored
and checked by tasks, a batch at a time.

Dropped: rows whose vector is null or has an entry that is null or not finite, and
rows whose length isn't the commonest one (of equally common ones, the longest).
An empty table gives no rows. A component without variance (at double precision)
has null for ``whitened`` and takes no part in ``identity_error``. ``deviation`` is
null where its exact value is beyond a long. Repeated rows stay, each with its own
result; entries beyond the range of a long are taken at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewatch.llm.common import added_up, kept, widened

SCALE, COMPONENTS, STEPS = 256, 4, 24
#: Vector entries that a task turns into numpy at a time.
ENTRIES = 1 << 20
Wide = np.longdouble


@dataclass
class Model:
    """Sums of the fit list's ``n`` vectors, and components by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0
    mean: np.ndarray = field(init=False)

    def __post_init__(self):
        self.mean = np.array([s / self.n for s in self.sums])

    def projection(self, components: int) -> np.ndarray:
        """A column for each component that takes a centred vector to its whitened value; nan for one without variance."""
        e = self.values[:components]
        live = e > max(self.values[0], 0.0) * len(self.values) * 2.0**-48
        return self.vectors[:, :components] / np.sqrt(np.where(live, e, np.nan))


def usable(column: str) -> Column:
    """The vector and all its entries are there and finite."""
    bad = F.exists(F.col(column), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.col(column).isNotNull() & ~bad


def scaled(column: str) -> Column:
    """floor(256 * c) of every entry as long."""
    return F.transform(F.col(column), lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long"))


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as a matrix of longs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        dim = max(1, len(batch.column(column)[0]))
        step = max(1, ENTRIES // dim)
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            yield piece, piece.column(column).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, high, low = 0, 0, 0
    for _, x in _blocks(batches, "x"):
        n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "high": [high.tolist()], "low": [low.tolist()]})


def fit(vectors: DataFrame, column: str = "x", components: int = COMPONENTS) -> Model | None:
    """Components of the distinct ``column`` vectors of longs; None where there are none."""
    distinct = kept(vectors.select(F.col(column).alias("x")).distinct(), "vectors")
    common = distinct.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None or not common.dim:
        return None
    distinct = distinct.filter(F.size("x") == common.dim)
    parts = distinct.mapInArrow(_sums, "n long, high array<long>, low array<long>")
    rows = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s")).groupBy("at").agg(F.sum("n"), F.sum(F.col("s.high").cast("decimal(38,0)")), F.sum(F.col("s.low").cast("decimal(38,0)"))).collect()
    n, sums = rows[0][1], [0] * len(rows)
    for at, _, high, low in rows:
        sums[at] = (int(high) << 32) + int(low)

    mean = np.array([s / n for s in sums])
    squares = added_up(distinct.mapInArrow(lambda batches: _products(batches, lambda x: x - mean), "part binary"))
    covariance = squares.reshape(len(mean), len(mean)) / n
    values, turned = eigen((covariance + covariance.T) / 2)
    model = Model(int(n), sums, values, turned, float(np.trace(covariance)))

    project = model.projection(components)
    project = project[:, ~np.isnan(project).any(0)]
    if project.shape[1]:
        grown = added_up(distinct.mapInArrow(lambda batches: _products(batches, lambda x: np.concatenate([np.ones((len(x), 1)), (x - mean) @ project], 1)), "part binary"))
        moments = grown.reshape(project.shape[1] + 1, -1) / n
        model.identity_error = float(np.abs(moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:]) - np.eye(project.shape[1])).max())
    return model


def _products(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """The sum of the products of all entries of a vector with each other, one matrix a task."""
    total = None
    for _, x in _blocks(batches, "x"):
        y = of(x)
        total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, to double precision; of a vector and its negative, that whose largest entry is positive."""
    size = float(np.abs(matrix).max()) or 1.0
    a = (matrix / size).astype(Wide)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(Wide)
    values, x = refine(a, x)
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(len(x))] < 0, -1, 1)
    x = x / np.sqrt((x * x).sum(0))
    return (values * size).astype(float), x.astype(float)


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrects approximate eigenvectors ``x`` of the symmetric ``a`` until a step changes nothing that the precision shows."""
    one, tiny = np.eye(len(a), dtype=Wide), np.finfo(Wide).eps
    norm = np.sqrt((a * a).sum())
    last = np.inf
    for _ in range(STEPS):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # a rounding that isn't symmetric would be blown up by small gaps
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        near = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        gaps = values[None, :] - values[:, None]
        close = np.abs(gaps) <= near
        change = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gaps))
        x = x + x @ change
        x = _turned(a, x, values, near)
        size = float(np.abs(change).max())
        if size <= 4 * tiny or (size < 1e-12 and size >= last):
            break
        last = size
    return np.diag(x.T @ (a @ x)) / np.diag(x.T @ x), x


def _turned(a: np.ndarray, x: np.ndarray, values: np.ndarray, near: float) -> np.ndarray:
    """``x`` with the vectors of each cluster of eigenvalues, neighbours at most ``near`` apart, turned to the eigenvectors of the matrix within their span."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    out = x.copy()
    for group in np.split(order, cuts):
        if len(group) > 1:
            span = x[:, group]
            shifted = span.T @ (a @ span) - values[group].mean() * (span.T @ span)
            scale = np.abs(shifted).max()
            if scale > 0:
                turn = np.linalg.eigh(((shifted + shifted.T) / 2 / scale).astype(float))[1]
                out[:, group] = span @ turn.astype(Wide)
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Of each vector, the sum of (n * x - S) ** 2 over dimensions, exactly; None beyond a long."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
    if most * most * x.shape[1] < 1 << 63:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, model: Model | None, column: str = "x", components: int = COMPONENTS) -> DataFrame:
    """For each row of ``rows`` and component: its other columns, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    others = [c for c in rows.columns if c != column]
    schema = widened(rows.select(*(f"`{c}`" for c in others)), component="integer", n="long", deviation="long", whitened="double", explained="double", identity_error="double")
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    project, explained = model.projection(components), model.values[:components] / (model.trace or 1.0)
    n, sums, mean, error, k = model.n, model.sums, model.mean, model.identity_error, project.shape[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _blocks(batches, column):
            size = len(x)
            whitened = ((x - mean) @ project).ravel()
            repeated = np.repeat(np.arange(size), k)
            columns = [piece.column(c).take(pa.array(repeated)) for c in others]
            columns += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, n))]
            columns += [pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(repeated)), pa.array(whitened, mask=np.isnan(whitened))]
            columns += [pa.array(np.tile(explained, size)), pa.array(np.full(size * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.filter(F.size(F.col(f"`{column}`")) == len(sums)).mapInArrow(score, schema)
