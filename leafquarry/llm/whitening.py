"""Whitening of embeddings by the leading components of their covariance, found without forming it.

Entries c become integers x = floor(1024 c) + 100000, so counts, sums and deviations are exact. The covariance V of all
remaining vectors is only ever multiplied: each pass over the vectors returns V Q for a block of columns Q, summed from
(x - mean)((x - mean) Q) of every row, centred first. Block Lanczos builds its basis from such products, each new block
orthogonalised twice against all before; where a block loses rank (breakdown) the lost columns restart from random ones,
and a basis that has reached `most` columns restarts from its leading Ritz vectors. It ends when the residuals |V y - e y|
are within `tolerance` of the largest eigenvalue, or the basis spans all dimensions. The trace is the sum of all rows'
deviations over n^3, and gives the explained shares.

The driver holds the basis and its products: dimensions x `most` numbers at most, whatever the number of rows. A task holds
one batch and one block. A pass returns one row for each dimension and task, summed by Spark before the driver reads it.

Defined cases: a null vector or one with a null, NaN or infinite entry is left out; the dimension is the longest remaining
vector's, and shorter vectors go on with zeros; entries beyond 2^30 in size count as 2^30; a null id is kept as it is;
repeated rows count each; components without variance (constant dimensions, fewer rows than components) are not returned,
nor are more than there are dimensions; of equal eigenvalues any orthogonal components are right; no vectors, or none that
differ, give an empty result; deviation is null where it doesn't fit a long; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 40


@dataclass(frozen=True)
class Whitening:
    """What fit() found: n vectors with sums; components as columns, their eigenvalues, V's trace, and how it went."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the batch that remain, their lengths, their x one after another). batch: id, vector."""
    held = batch.column(1)
    rows = np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False))
    held = held.drop_null()
    lengths = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = held.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    fine = np.isfinite(values)
    ends = np.cumsum(lengths)
    good = np.concatenate([[0], np.cumsum(fine)])
    keep = good[ends] - good[ends - lengths] == lengths
    values = np.where(fine, values, 0.0)[np.repeat(keep, lengths)]
    x = np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64) + SHIFT
    return rows[keep], lengths[keep], x


def offsets(lengths: np.ndarray, x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, a row for each vector: integers of 64 bits where all fit, Python's otherwise."""
    d = len(sums)
    if (lengths == d).all():
        dense = x.reshape(len(lengths), d)
    else:
        dense = np.full((len(lengths), d), SHIFT, np.int64)
        dense[np.arange(d) < lengths[:, None]] = x
    top = max(int(np.abs(x).max(initial=SHIFT)), SHIFT)
    kind = np.int64 if n * top + max(map(abs, sums), default=0) < 1 << 62 else object
    return n * dense.astype(kind) - np.array(sums, kind)


def deviations(off: np.ndarray) -> list[int]:
    """Sum of squares of each row, exactly."""
    rough = (off.astype(float) ** 2).sum(axis=1)
    if off.dtype == object or (rough > 2.0**62).any():
        off = off.astype(object)
    return [int(v) for v in (off * off).sum(axis=1)]


def _counted(vecs: DataFrame) -> tuple[int, list[int]]:
    """n and the sums of x by dimension, exactly."""

    def run(batches: Iterator[pa.RecordBatch]):
        n, counts, sums = 0, np.zeros(0, np.int64), np.zeros(0, object)
        for b in batches:
            rows, lengths, x = vectors(b)
            if not len(rows):
                continue
            d = int(lengths.max())
            if d > len(sums):
                counts, sums = (np.concatenate([a, np.zeros(d - len(a), a.dtype)]) for a in (counts, sums))
            place = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            n += len(rows)
            counts[:d] += np.bincount(place, minlength=d)
            # halves of 31 bits: sums of a batch stay exact in doubles' reach of whole numbers
            low, high = x & 0x7FFFFFFF, x >> 31
            sums[:d] += np.bincount(place, low, d).astype(np.int64).astype(object) + (np.bincount(place, high, d).astype(np.int64).astype(object) * (1 << 31))
        from decimal import Decimal

        at = [-1, *range(len(sums))]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([n, *counts.tolist()], pa.int64()), pa.array([Decimal(0), *map(Decimal, sums)], pa.decimal128(38, 0))], names=["dim", "n", "total"])

    found = vecs.mapInArrow(run, "dim int, n long, total decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    by = {r.dim: (r.n, int(r.total)) for r in found.collect()}  # a row for each dimension
    n = by.pop(-1, (0, 0))[0]
    return n, [by[i][1] + (n - by[i][0]) * SHIFT for i in range(len(by))]


def _summed(vecs: DataFrame, part_of: Callable[[np.ndarray], np.ndarray], n: int, sums: list[int], columns: int) -> np.ndarray:
    """The sum over all vectors of part_of(n x - S of some rows), a matrix of so many columns."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = None
        for b in batches:
            _, lengths, x = vectors(b)
            if len(lengths):
                part = part_of(offsets(lengths, x, n, sums))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in total.T]], names=["at", *names])

    names = [f"v{k}" for k in range(columns)]
    found = vecs.mapInArrow(run, "at int, " + ", ".join(f"{v} double" for v in names)).groupBy("at").agg(*[F.sum(v).alias(v) for v in names])
    return np.array([r[1:] for r in sorted(found.collect())])  # a row for each dimension


def extended(basis: np.ndarray, wanted: np.ndarray, block: int, scale: float, rng: np.random.Generator) -> np.ndarray:
    """The next block: wanted without its part in the basis, orthonormal; random columns where that lacks rank."""
    room = min(block, len(basis) - basis.shape[1])
    for _ in range(2):
        wanted = wanted - basis @ (basis.T @ wanted)
    left, size, _ = np.linalg.svd(wanted, full_matrices=False)
    new = left[:, size > 1e-12 * scale][:, :room]
    if new.shape[1] < room:  # breakdown
        fresh, held = rng.standard_normal((len(basis), room - new.shape[1])), np.hstack([basis, new])
        for _ in range(2):
            fresh = fresh - held @ (held.T @ fresh)
        new = np.hstack([new, np.linalg.qr(fresh)[0]])
    new = new - basis @ (basis.T @ new)
    return np.linalg.qr(new)[0]


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], d: int, want: int, block: int = 16, most: int = 256, tolerance: float = 1e-12, passes: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, eigenvectors as columns, residuals, passes) of the `want` largest of a symmetric d x d operator
    that is only multiplied. block is at least want, so that equal eigenvalues are all found."""
    rng = np.random.default_rng(seed)
    want = min(want, d)
    block, most = min(max(block, want), d), max(most, 3 * max(block, want))
    new = np.linalg.qr(rng.standard_normal((d, block)))[0]
    basis = product = np.zeros((d, 0))
    for done in range(1, passes + 1):
        got = multiply(new)
        basis, product = np.hstack([basis, new]), np.hstack([product, got])
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        lead = turn[:, :want]
        residuals = np.linalg.norm(product @ lead - basis @ lead * values[:want], axis=0)
        scale = max(abs(values[0]), abs(values[-1]))
        if basis.shape[1] == d or (residuals <= tolerance * scale).all():
            return values[:want], basis @ lead, residuals, done
        new = extended(basis, got, block, scale, rng)
        if basis.shape[1] + new.shape[1] > most:  # thick restart: the next block is orthogonal to what stays
            keep = turn[:, : want + block]
            basis, product = basis @ keep, product @ keep
    raise ArithmeticError(f"not converged in {passes} passes: residuals {residuals}")


def _vectors_of(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    ship_package(embeddings.sparkSession)
    return embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))


def fit(embeddings: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", **settings) -> Whitening:
    """The whitening of all vectors that remain; settings go to lanczos()."""
    vecs = _vectors_of(embeddings, id_col, vector_col)
    n, sums = _counted(vecs)
    d = len(sums)
    if not n or not d:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, np.zeros(0), 0)
    spread: list[float] = []

    def multiply(q: np.ndarray) -> np.ndarray:
        with_trace = not spread

        def part_of(off: np.ndarray) -> np.ndarray:
            centred = off.astype(float) / n
            part = centred.T @ (centred @ q)
            if with_trace:  # one more column: the deviations come along in the first pass
                part = np.hstack([part, np.zeros((d, 1))])
                part[0, -1] = sum(deviations(off)) / n**2
            return part

        got = _summed(vecs, part_of, n, sums, q.shape[1] + with_trace)
        if with_trace:
            spread.append(float(got[0, -1]) / n)
            got = got[:, :-1]
        return got / n

    values, found, residuals, passes = lanczos(multiply, d, components, **settings)
    real = values > 1e-12 * max(values[0], 0) if values[0] > 0 else np.zeros(len(values), bool)
    found = found[:, real]
    found = found / np.linalg.norm(found, axis=0)
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return Whitening(n, sums, found * signs, values[real], spread[0], residuals[real], passes)


def _whitened(off: np.ndarray, model: Whitening) -> np.ndarray:
    return (off.astype(float) / model.n) @ model.components / np.sqrt(model.values)


def identity_error(embeddings: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, from one more pass."""
    k = len(model.values)
    if not k:
        return 0.0

    def part_of(off: np.ndarray) -> np.ndarray:
        w = _whitened(off, model)
        return w.T @ w

    covariance = _summed(_vectors_of(embeddings, id_col, vector_col), part_of, model.n, model.sums, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(embeddings: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened array<double>) of each vector that remains."""
    vecs = _vectors_of(embeddings, id_col, vector_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows, lengths, x = vectors(b)
            if not len(rows):
                continue
            off = offsets(lengths, x, model.n, model.sums)
            exact = [v if v < 1 << 63 else None for v in deviations(off)]
            w = _whitened(off, model)
            lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], np.ascontiguousarray(w).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(exact, pa.int64()), lists], names=["id", "deviation", "whitened"])

    kind = vecs.schema["id"].dataType.simpleString()
    return vecs.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>").withColumnRenamed("id", id_col)


def components_table(embeddings: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", **settings) -> DataFrame:
    """A row for each vector that remains and each component: (id, component from 1, n, deviation, whitened, explained,
    identity_error)."""
    model = fit(embeddings, components, id_col, vector_col, **settings)
    error = identity_error(embeddings, model, id_col, vector_col)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    out = whiten(embeddings, model, id_col, vector_col).select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
