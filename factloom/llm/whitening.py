"""Whitening of embeddings from an exact integer scatter matrix.

Each entry becomes the integer ``floor(scale * c)``, so a vector is a short byte string, and equal vectors are counted
once by a plain distinct on it. Every task subtracts one common shift from its distinct vectors and accumulates sums and
cross-products in digits of ``BITS`` bits: products of digits are added up by matrix products whose partial sums stay
below 2^53, so they are exact, and carries keep numbers of any size. Rows of the scatter matrix are summed up in Spark,
one row of the matrix at a time and batch by batch; the driver receives d + 1 rows of d + 1 numbers, whatever the number
of vectors. There n XᵀX - SSᵀ is formed in Python's integers and only its quotients by n² become floating-point numbers,
for ``eigh``. How far the whitened vectors' covariance is from the identity is measured on all of them.

Defined results: a vector that is null, or holds a null or a number that is not finite, is left out, and so is one whose
length is not the commonest (of equally common lengths the greatest counts). Integers beyond 64 bits become the
nearest that fits. Repeated vectors count once in the fit and get equal results; null and repeated ids are ids like others.
A component without variance (to double precision) gives null. A squared deviation beyond 64 bits is null. An empty
table, or one without a usable vector, gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import column
from factloom.session import materialize, ship_package

#: Bits of a digit: a product of two takes 28 bits and a sign, so 2^24 of them add up exactly in a double.
BITS = 15
_HALF = 1 << (BITS - 1)
_SAFE = 1 << 61
_MOST = (1 << 63) - 1


def quantized(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * c)`` of finite doubles, as far as it fits 64 bits."""
    with np.errstate(over="ignore"):
        y = np.floor(values * scale)
    return np.where(y >= 2.0**63, _MOST, np.clip(y, -(2.0**63), 2.0**63 - 1024).astype(np.int64))


def packed(x: np.ndarray) -> list[bytes]:
    """A byte string for each row of integers: their width, then the integers; equal rows have equal strings."""
    least, most = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    width = np.full(len(x), 8)
    for w in (4, 2, 1):
        info = np.iinfo(f"<i{w}")
        width[(least >= info.min) & (most <= info.max)] = w
    out: list[bytes] = [b""] * len(x)
    for w in (1, 2, 4, 8):
        for i, row in zip(np.flatnonzero(width == w).tolist(), x[width == w].astype(f"<i{w}"), strict=True):
            out[i] = bytes([w]) + row.tobytes()
    return out


def unpacked(keys: list[bytes], d: int) -> np.ndarray:
    """The rows of integers that :func:`packed` made strings of."""
    width = np.fromiter((k[0] for k in keys), np.int64, len(keys))
    x = np.empty((len(keys), d), np.int64)
    for w in np.unique(width).tolist():
        raw = b"".join(k[1:] for k, own in zip(keys, width.tolist(), strict=True) if own == w)
        x[width == w] = np.frombuffer(raw, f"<i{w}").reshape(-1, d)
    return x


def _exact(a: np.ndarray, *bounds: int) -> np.ndarray:
    """``a`` itself if what is computed from it stays within 64 bits, else as Python integers."""
    return a if max(map(abs, bounds), default=0) < _SAFE else a.astype(object)


def _size(a: np.ndarray) -> int:
    return max(abs(int(a.min())), abs(int(a.max()))) if a.size else 0


def digits(y: np.ndarray) -> list[np.ndarray]:
    """``y`` as digits in [-2^14, 2^14), lowest first, as doubles."""
    out = []
    while len(y) and (y != 0).any() or not out:
        low = ((y + _HALF) & (2 * _HALF - 1)) - _HALF
        out.append(low.astype(np.float64))
        y = (y - low) >> BITS
    return out


class Scatter:
    """Exact sums of cross-products, as carried digits: ``parts[k]`` counts 2^(BITS k)."""

    def __init__(self, shape: tuple[int, ...]):
        self.shape, self.parts = shape, []

    def add(self, k: int, part: np.ndarray) -> None:
        while len(self.parts) <= k:
            self.parts.append(np.zeros(self.shape, np.int64))
        self.parts[k] += part

    def carry(self) -> None:
        k = 0
        while k < len(self.parts):
            over = (self.parts[k] + _HALF) >> BITS
            if over.any():
                self.parts[k] -= over << BITS
                self.add(k + 1, over)
            k += 1

    def outer(self, y: np.ndarray) -> None:
        """Add yᵀy of the rows of ``y``, fewer than 2^24."""
        parts = digits(y)
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                self.add(i + j, (a.T @ b).astype(np.int64))
        self.carry()

    def integers(self) -> np.ndarray:
        """The sums as Python's integers."""
        total = np.zeros(self.shape, object)
        for k, part in enumerate(self.parts):
            total = total + part.astype(object) * (1 << (BITS * k))
        return total


@dataclass
class Whitening:
    """What :func:`fit` learned: how many distinct vectors, their sums, and unit components by falling variance."""

    scale: int
    n: int
    sums: list[int]
    values: list[float]
    vectors: np.ndarray  # (d, components)
    trace: float
    identity_error: float | None = None
    explained: list[float | None] = field(default_factory=list)

    @property
    def dims(self) -> int:
        return len(self.sums)

    def defined(self) -> list[bool]:
        least = self.dims * np.finfo(float).eps * max(self.values, default=0.0)
        return [e > least for e in self.values]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        s = np.array(self.sums, object)
        bound = self.n * _size(x) + max(map(abs, self.sums), default=0)
        return _exact(x, bound) * self.n - (s.astype(np.int64) if bound < _SAFE else s)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates (rows, components); not a number where a component has no variance."""
        root = np.array([np.sqrt(e) if ok else np.nan for e, ok in zip(self.values, self.defined(), strict=True)])
        return (self.deviations(x).astype(np.float64) / self.n) @ self.vectors / root


def _vectors(df: DataFrame, vec_col: str, id_col: str | None = None) -> DataFrame:
    who = column(df, id_col) if id_col else F.lit(0)
    return df.select(who.alias("who"), column(df, vec_col).cast("array<double>").alias("vec")).filter("vec IS NOT NULL")


def _usable(batch: pa.RecordBatch, d: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a batch's usable vectors and their integers."""
    vec = batch["vec"]
    sizes = np.diff(vec.offsets.to_numpy())
    flat = vec.flatten()
    bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False))  # a null is read as not a number
    of = np.repeat(np.arange(len(sizes)), sizes)
    ok = (sizes == d) & (np.bincount(of[bad], minlength=len(sizes)) == 0)
    values = flat.to_numpy(zero_copy_only=False)[ok[of]].reshape(-1, d)
    return np.flatnonzero(ok), quantized(values, scale)


def distinct(df: DataFrame, d: int, vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(key) of each distinct vector of integers, once, as :func:`packed` writes it."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(packed(_usable(batch, d, scale)[1]), pa.binary())], ["key"])

    return _vectors(df, vec_col).select("vec").mapInArrow(run, "key binary").distinct()


def scatter(keys: DataFrame, shift: list[int]) -> np.ndarray:
    """Sums over ``keys`` of (1, x - shift)ᵀ (1, x - shift), exactly: a matrix of Python's integers."""
    d, bound = len(shift), max(map(abs, shift), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Scatter((d + 1, d + 1))
        for batch in batches:
            if batch.num_rows:
                x = unpacked(batch["key"].to_pylist(), d)
                y = _exact(x, _size(x), bound) - (np.array(shift, np.int64) if bound < _SAFE else np.array(shift, object))
                total.outer(np.concatenate([np.ones((len(y), 1), y.dtype), y], axis=1))
        if total.parts:
            rows = np.stack(total.parts, axis=1).astype("<i8")  # by row of the matrix, then digit
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), pa.array([r.tobytes() for r in rows], pa.binary())], ["at", "digits"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Scatter((d + 1,))
        for batch in batches:
            for raw in batch["digits"].to_pylist():
                for k, part in enumerate(np.frombuffer(raw, "<i8").reshape(-1, d + 1)):
                    total.add(k, part)
            total.carry()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.stack(total.parts).astype("<i8").tobytes()], pa.binary())], ["at", "digits"])

    rows = keys.mapInArrow(run, "at long, digits binary").groupBy("at").applyInArrow(merge, "at long, digits binary").collect()
    out = np.zeros((d + 1, d + 1), object)
    for r in rows:
        one = Scatter((d + 1,))
        one.parts = list(np.frombuffer(r["digits"], "<i8").reshape(-1, d + 1))
        out[r["at"]] = one.integers()
    return out


def decomposed(sums: np.ndarray, shift: list[int], scale: int, components: int) -> Whitening:
    """The model from the matrix of :func:`scatter`."""
    n, moved, cross = sums[0, 0], sums[0, 1:], sums[1:, 1:]
    centred = n * cross - np.outer(moved, moved)  # n XᵀX - SSᵀ; the shift cancels
    square = n * n
    v = np.array([[c / square for c in row] for row in centred], float).reshape(len(shift), len(shift))
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    trace = int(sum(centred[i, i] for i in range(len(shift)))) / square
    model = Whitening(scale, int(n), [int(t + n * s) for t, s in zip(moved, shift, strict=True)], values[order].tolist(), vectors[:, order], trace)
    model.explained = [e / trace if trace > 0 else None for e in model.values]
    return model


def fit(df: DataFrame, vec_col: str = "embedding", components: int = 4, scale: int = 256) -> Whitening | None:
    """Learn from each distinct vector once; None without one. ``components`` are the first ones, by falling variance."""
    length = _vectors(df, vec_col).groupBy(F.size("vec").alias("d")).count().filter("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return None
    d = length["d"]
    keys = materialize(distinct(df, d, vec_col, scale), "vectors")
    one = keys.first()
    if one is None:
        return None
    shift = unpacked([bytes(one["key"])], d)[0].tolist()
    model = decomposed(scatter(keys, shift), shift, scale, components)
    model.identity_error = identity_error(keys, model)
    return model


def identity_error(keys: DataFrame, model: Whitening) -> float | None:
    """Largest entry, without sign, of the whitened vectors' covariance less the identity, over components with variance."""
    live = [k for k, ok in enumerate(model.defined()) if ok]
    if not live:
        return None
    names = [f"w{k}" for k in live]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = model.project(unpacked(batch["key"].to_pylist(), model.dims))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in live], names)

    pairs = [(i, j) for i in range(len(live)) for j in range(i, len(live))]
    w = keys.mapInArrow(run, ", ".join(f"{c} double" for c in names))
    row = w.agg(*[F.covar_pop(names[i], names[j]).alias(f"{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"{i}_{j}"] - (i == j)) for i, j in pairs)


def transform(df: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per usable row: id, deviation (sum of squares of n x - S), whitened (array, one entry a component)."""
    ship_package(df.sparkSession)
    rows = _vectors(df, vec_col, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _usable(batch, model.dims, model.scale)
            dev = model.deviations(x)
            dev = _exact(dev, _size(dev) ** 2 * model.dims)
            square = (dev * dev).sum(axis=1)
            square = pa.array([s if s <= _MOST else None for s in square.tolist()], pa.int64())
            w = model.project(x)
            flat = pa.array(w.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * w.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch["who"].take(pa.array(at)), square, lists], ["who", "deviation", "whitened"])

    fields = [T.StructField("who", rows.schema["who"].dataType), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    return rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("who", id_col)


def report(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """A row for each usable row and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    kind = df.schema[id_col].dataType.simpleString()
    model = fit(df, vec_col, components, scale)
    if model is None:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(e).cast("double") for e in model.explained])
    wide = transform(df, model, id_col, vec_col).select(F.col(f"`{id_col}`"), "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return wide.select(
        F.col(f"`{id_col}`"),
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
