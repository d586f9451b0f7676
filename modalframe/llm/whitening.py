"""Whitening of integer vectors from exact bit-sliced scatter sums.

An entry c becomes the integer x = floor(64 c) + 1000000. Sums and cross-products of the integers are exact: rows are taken in blocks, each
dimension is shifted by its least value of the block, and its remaining bits become planes: bit b of dimension i over all rows of the
block, packed into 64-bit words. With P the planes,

    sum over rows of y_i y_j  =  sum over b, c of 2^(b + c) * popcount(P_ib AND P_jc)

and undoing the shifts costs a few integer sums. A task adds up its blocks and reports one row for each pair of dimensions, in limbs of
40 bits, so Spark's sums of them are exact for any number of tasks. The driver gets one row for each pair of dimensions (bounded by the
dimension, not by rows), centres as integers, n * sum(x_i x_j) - S_i S_j, and only then divides by n^2 and calls eigh. A second scan projects each
vector. No vector leaves its task; planes are as many as a block's bits, so narrow data costs less.

Rows whose vector is null or holds a null or a non-finite entry are dropped. So are vectors of another length than the most frequent one (of equally
frequent ones the longest), and empty vectors. Entries beyond +-2^50 count as +-2^50 (their integers would not be exact doubles). A null id stays
null; repeated rows count as often as they occur. Components whose eigenvalue is not above `floor_ratio` of the largest (constant or dependent dimensions)
have no finite scale and are left out, so few or equal rows give few or no components; an empty table gives an empty result. Only the id and the
vector column are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

SCALE, OFFSET, WIDEST = 64, 1_000_000, 2**50
BLOCK, LIMB, LIMBS = 4096, 40, 6


def integers(values: np.ndarray) -> np.ndarray:
    """floor(64 c) of finite doubles; the constant offset is added where results need it."""
    return np.clip(np.floor(SCALE * values), -WIDEST, WIDEST).astype(np.int64)


def planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, dimension, bit) of the planes of non-negative integers (rows x dimensions); planes without a set bit are left out."""
    rows, dims = shifted.shape
    padded = np.zeros((-(-rows // 64) * 64, dims), np.int64)
    padded[:rows] = shifted
    words, owner, bit = [], [], []
    highest = int(shifted.max(initial=0)).bit_length()
    for b in range(highest):
        ones = ((padded >> b) & 1).astype(np.uint8)
        kept = np.nonzero(ones.any(axis=0))[0]
        words.append(np.packbits(ones[:, kept].T, axis=1, bitorder="little").view(np.uint64))
        owner.append(kept)
        bit.append(np.full(len(kept), b))
    if not words:
        return np.zeros((0, len(padded) // 64), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(owner), np.concatenate(bit)


def cross_products(shifted: np.ndarray) -> np.ndarray:
    """Exact sums over rows of y_i y_j as a symmetric object matrix of Python integers, by AND and popcount of bit planes."""
    dims = shifted.shape[1]
    words, owner, bit = planes(shifted)
    out = np.zeros((dims, dims), object)
    for b in np.unique(bit).tolist():
        one = words[bit == b]
        for c in range(b + 1):
            other = words[bit == c]
            if not len(other):
                continue
            counts = np.zeros((len(one), len(other)), np.int64)
            for k in range(words.shape[1]):  # a word of each plane: 64 rows
                counts += np.bitwise_count(one[:, k, None] & other[None, :, k])
            part = np.zeros((dims, dims), np.int64)
            part[np.ix_(owner[bit == b], owner[bit == c])] = counts
            whole = part if b == c else part + part.T
            out += whole.astype(object) * (1 << (b + c))
    return out


@dataclass
class Scatter:
    """n, sums and cross-products of integer rows of one length, all exact."""

    dims: int
    n: int = 0
    sums: np.ndarray | None = None
    cross: np.ndarray | None = None

    def add(self, x: np.ndarray) -> None:
        if self.sums is None:
            self.sums, self.cross = np.zeros(self.dims, object), np.zeros((self.dims, self.dims), object)
        for at in range(0, len(x), BLOCK):
            block = x[at : at + BLOCK]
            least = block.min(axis=0)
            shifted = block - least
            low = least.astype(object)
            own = shifted.sum(axis=0).astype(object) if int(shifted.max()) < 2**50 else shifted.astype(object).sum(axis=0)
            self.cross += cross_products(shifted) + np.outer(low, own) + np.outer(own, low) + len(block) * np.outer(low, low)
            self.sums += own + len(block) * low
            self.n += len(block)

    def rows(self):
        """(dims, i, j, limbs): i = -1 holds n, j = -1 the sums, the rest the upper triangle."""
        yield (self.dims, -1, -1, limbs(self.n))
        for i in range(self.dims):
            yield (self.dims, i, -1, limbs(self.sums[i]))
            for j in range(i, self.dims):
                yield (self.dims, i, j, limbs(self.cross[i, j]))


def limbs(value: int) -> list[int]:
    """Signed integer as LIMBS limbs of 40 bits; the last one takes sign and rest."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(int(value) & ((1 << LIMB) - 1))
        value = int(value) >> LIMB
    return [*out, int(value)]


def unlimb(parts) -> int:
    return sum(int(p) << (LIMB * k) for k, p in enumerate(parts))


def _valid(vectors: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Rows that are usable, and by vector length their matrix and places."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = np.asarray(vectors.offsets)
    values = vectors.values
    entries = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    size = np.diff(offsets)
    fine = (bad[offsets[1:]] == bad[offsets[:-1]]) & (size > 0)
    if vectors.null_count:
        fine &= np.asarray(vectors.is_valid())
    out = {}
    for length in np.unique(size[fine]).tolist():
        place = np.nonzero(fine & (size == length))[0]
        out[length] = (place, entries[offsets[place][:, None] + np.arange(length)])
    return fine, out


def scatter_table(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(dims, i, j, l0..l5): exact partial sums of every task, added up."""
    names = [f"l{k}" for k in range(LIMBS)]
    schema = "dims int, i int, j int, " + ", ".join(f"{c} long" for c in names)

    def run(batches):
        sums: dict[int, Scatter] = {}
        for batch in batches:
            for length, (_, entries) in _valid(batch.column(0))[1].items():
                sums.setdefault(length, Scatter(length)).add(integers(entries))
        for one in sums.values():
            found = list(one.rows())
            for at in range(0, len(found), 10_000):
                dims, i, j, parts = zip(*found[at : at + 10_000])
                columns = [pa.array(c, pa.int32()) for c in (dims, i, j)] + [pa.array([p[k] for p in parts], pa.int64()) for k in range(LIMBS)]
                yield pa.RecordBatch.from_arrays(columns, names=["dims", "i", "j", *names])

    partial = vectors.select(F.col(vec_col).alias("v")).mapInArrow(run, schema)
    return partial.groupBy("dims", "i", "j").agg(*(F.sum(F.col(c).cast(DecimalType(20, 0))).alias(c) for c in names))


@dataclass
class Whitening:
    """Fitted on n vectors: sums of floor(64 c), unit eigenvectors (columns) and eigenvalues by falling eigenvalue."""

    dims: int
    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def fit_whitening(vectors: DataFrame, vec_col: str = "embedding", components: int = 32, floor_ratio: float = 1e-12) -> Whitening | None:
    """None where no vector is usable. The driver gets n for each length, then one row for each pair of dimensions of the chosen length."""
    from .common import store

    sums = store(scatter_table(vectors, vec_col), "scatter")
    names = [f"l{k}" for k in range(LIMBS)]
    # lengths are ranked in Spark: only the most frequent one reaches the driver, however many there are
    n_of = sum((F.col(c).cast("double") * 2.0 ** (LIMB * k) for k, c in enumerate(names[:2])), F.lit(0.0))
    top = sums.where("i = -1").orderBy(n_of.desc(), F.desc("dims")).limit(1).collect()
    if not top:
        return None
    dims = top[0]["dims"]
    n, total, cross = 0, [0] * dims, np.zeros((dims, dims), object)
    for row in sums.where(F.col("dims") == dims).collect():
        value = unlimb(row[c] for c in names)
        if row.i < 0:
            n = value
        elif row.j < 0:
            total[row.i] = value
        else:
            cross[row.i, row.j] = cross[row.j, row.i] = value
    centred = n * cross - np.outer(np.array(total, object), np.array(total, object))  # integers
    square = n * n
    covariance = np.array([[a / square for a in row] for row in centred.tolist()], np.float64)  # correctly rounded quotients
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    kept = values > floor_ratio * max(values[0], 0.0)
    values, axes = values[kept], axes[:, kept]
    projection = axes / np.sqrt(values)
    error = np.abs(projection.T @ covariance @ projection - np.eye(len(values))).max(initial=0.0)
    return Whitening(dims, n, total, axes, values, float(np.trace(covariance)), float(error))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    `deviation` is the exact sum over dimensions of (n x - S)^2 as decimal(38, 0), null where it has more than 38 digits. `identity_error` is the largest
    absolute entry of the whitened covariance minus the identity, which by linearity is the projected covariance of the fit list.
    """
    fit = fit_whitening(vectors, vec_col, components)
    schema = StructType([
        StructField("vec_id", vectors.schema[id_col].dataType), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", DecimalType(38, 0)),
        StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType()),
    ])
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k, explained = len(fit.values), fit.values / fit.trace
    projection = fit.vectors / np.sqrt(fit.values)

    def run(batches):
        sums = np.array(fit.sums, object)
        narrow = np.array([s if abs(s) < 2**62 else 0 for s in fit.sums], np.int64)
        fits_word = all(abs(s) < 2**62 for s in fit.sums)
        for batch in batches:
            place, entries = _valid(batch.column(1))[1].get(fit.dims, (np.zeros(0, np.int64), None))
            for at in range(0, len(place), BLOCK):
                x = integers(entries[at : at + BLOCK])
                largest = int(np.abs(x).max()) * fit.n + max(map(abs, fit.sums))
                if fits_word and largest < 2**62:
                    off = fit.n * x - narrow
                    exact = off.astype(object) if largest * largest * fit.dims >= 2**63 else off
                else:
                    off = exact = fit.n * x.astype(object) - sums
                deviation = [d if abs(d) < 10**38 else None for d in (exact * exact).sum(axis=1).tolist()]
                scores = (off / fit.n).astype(np.float64) @ projection
                m = len(x)
                ids = batch.column(0).take(pa.array(np.repeat(place[at : at + BLOCK], k)))
                columns = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)),
                    pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(scores.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, fit.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")).mapInArrow(run, schema)


def whiten_digest(vectors: DataFrame, components: int = 32) -> DataFrame:
    """`whiten` with `deviation` as long, null where it exceeds a long; `deviation_exact` keeps the decimal."""
    rows = whiten(vectors, components=components)
    return rows.withColumn("deviation_exact", F.col("deviation")).withColumn("deviation", F.expr("try_cast(deviation as long)"))
