"""Operator 13: embedding whitening by MLlib's singular value decomposition of the centred rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import discard, stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Standard deviations below this part of the greatest are rounding, and no components.
LEAST = 1e-6


class Whitening(NamedTuple):
    """The fit of the vectors of one length: their number, sums by dimension, matrix from centred vectors to whitened ones
    (length times components), explained parts, and the largest error of the whitened covariance."""

    n: int
    sums: list[int]
    matrix: np.ndarray
    explained: list[float]
    identity_error: float | None


def whole_numbers(rows: DataFrame, vec_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """rows with `x`, the vector as long values floor(scale * c) + shift. Rows whose vector is null, or holds null or
    non-finite entries, are left out. A column x of the input is replaced."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    usable = rows.where(F.col(vec_col).isNotNull() & F.forall(vec_col, finite))
    return usable.withColumn("x", F.transform(vec_col, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long")))


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length of x: number of rows and exact sums by dimension. Tasks add up what they hold; sums of tasks are added
    by dimension, so that as many rows as there are dimensions come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, block in _blocks(b.column(0)):
                held[d] = held.get(d, 0) + np.append(block[1].sum(0), len(block[1]))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["d", "s"])

    parts = fit.select("x").mapInArrow(run, "d int, s array<bigint>")
    found: dict[int, list[tuple[int, int]]] = {}
    for d, i, s in parts.select("d", F.posexplode("s").alias("i", "s")).groupBy("d", "i").agg(F.sum("s").alias("s")).collect():
        found.setdefault(d, []).append((i, s))
    return {d: (dict(v)[d], [s for i, s in sorted(v) if i < d]) for d, v in found.items() if d}


def _blocks(column: pa.Array) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """By length: places in the column, and the vectors of that length as a matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.flatten().to_numpy(), column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, (at, flat[starts[at, None] + np.arange(d)])


def fitted(fit: DataFrame, n: int, total: list[int], components: int = COMPONENTS) -> Whitening:
    """The fit of distinct vectors x of one length. Rows are centred exactly, as whole numbers n * x - S, before they become
    doubles. MLlib decomposes their Gram matrix, which holds as many entries as dimensions squared; all of its values are
    asked for, so the decomposition is direct and to double precision. Singular values become variances by the divisor n.
    The total variance is no sum of theirs, but comes from the exact deviations."""
    vector = F.transform(_deviations(n, total), lambda d: d / F.lit(n))
    rows = fit.select(array_to_vector(vector).alias("v"))
    centred = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"))
    decomposed = centred.computeSVD(len(total), False, LEAST)
    values = np.array(decomposed.s.toArray())[:components]
    directions = np.array(decomposed.V.toArray())[:, : len(values)]
    variances = values**2 / n
    squares = fit.agg(F.sum(_squares(n, total).cast("decimal(38,0)"))).head()[0] or 0
    if not len(values) or not squares:
        return Whitening(n, total, np.zeros((len(total), 0)), [], None)
    matrix = directions / np.sqrt(variances)
    whitened = centred.multiply(DenseMatrix(*matrix.shape, matrix.ravel("F")))
    covariance = whitened.computeCovariance().toArray() * ((n - 1) / n)  # MLlib centres and divides by n - 1
    error = float(np.abs(covariance - np.eye(len(values))).max())
    return Whitening(n, total, matrix, (variances / (int(squares) / n**3)).tolist(), error)


def _deviations(n: int, total: list[int]) -> F.Column:
    """n * x - S as long values; an overflow fails the job."""
    s = F.array(*(F.lit(int(v)).cast("long") for v in total))
    return F.zip_with("x", s, lambda a, b: a * F.lit(n).cast("long") - b)


def _squares(n: int, total: list[int]) -> F.Column:
    return F.aggregate(_deviations(n, total), F.lit(0).cast("long"), lambda acc, d: acc + d * d)


def whitened(rows: DataFrame, fits: dict[int, Whitening]) -> DataFrame:
    """rows with `deviation`, the exact sum of (n * x - S)^2, and `whitened`, their coordinates. Overflows fail the job.
    Rows whose length has no fit have none."""
    kept = [c for c in rows.columns if c not in ("deviation", "whitened")]
    schema = T.StructType([rows.schema[c] for c in kept] + [
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    place = kept.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.select(kept)
            deviation, out = [None] * b.num_rows, [None] * b.num_rows
            for d, (at, x) in _blocks(b.column(place)):
                if d not in fits:
                    continue
                f = fits[d]
                if len(x) and max(abs(int(x.max())), abs(int(x.min()))) * f.n >= 1 << 62:
                    raise OverflowError("n * x does not fit a long")
                apart = x * f.n - np.array(f.sums, np.int64)
                if len(x) and (np.square(apart, dtype=np.float64).sum(1) >= 9.2e18).any():
                    raise OverflowError("a deviation does not fit a long")
                new = (apart / f.n) @ f.matrix
                for i, v, w in zip(at.tolist(), (apart * apart).sum(1).tolist(), list(new), strict=True):
                    deviation[i], out[i] = v, w
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(deviation, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=schema.names)

    return rows.select(kept).mapInArrow(run, schema)


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    The fit is over distinct vectors x, so copies weigh nothing; rows with equal vectors, or equal or null ids, each have
    their rows. Vectors of several lengths are several spaces, each fitted by itself (one job after the other: lengths are
    as many as models). Fewer components are returned where the vectors span fewer, none where all are equal or empty. An
    empty table gives no rows; other columns are not read.
    """
    rows = whole_numbers(embeddings.select(F.col(id_col), F.col(vec_col).alias("_vector")), "_vector")
    rows = rows.select(F.col(id_col).alias("_id"), "x")
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    fits = {d: fitted(fit.where(F.size("x") == d), n, s, components) for d, (n, s) in sums(fit).items() if n > 1}
    discard(fit)
    fits = {d: f for d, f in fits.items() if f.explained}
    if not fits:
        nothing = F.lit(None)
        return rows.where(F.lit(False)).select(
            F.col("_id").alias(id_col), nothing.cast("int").alias("component"), nothing.cast("long").alias("n"),
            nothing.cast("long").alias("deviation"), nothing.cast("double").alias("whitened"),
            nothing.cast("double").alias("explained"), nothing.cast("double").alias("identity_error"))
    per = lambda value: F.element_at(F.create_map(*(v for d, f in fits.items() for v in (F.lit(d), value(f)))), F.size("x"))
    numbers = lambda values: F.array(*(F.lit(float(v)) for v in values))
    made = whitened(rows.where(F.size("x").isin(list(fits))), fits)
    made = made.select(
        F.col("_id").alias(id_col), "deviation", per(lambda f: F.lit(f.n).cast("long")).alias("n"),
        per(lambda f: F.lit(f.identity_error)).alias("identity_error"),
        F.posexplode(F.arrays_zip("whitened", per(lambda f: numbers(f.explained)).alias("explained"))).alias("i", "w"))
    return made.select(
        id_col, (F.col("i") + 1).alias("component"), "n", "deviation", "w.whitened", "w.explained", "identity_error")
