"""Whitening of embeddings by incremental eigendecomposition.

A spectrum is what is known of some vectors: their number, mean, and the eigenvalues and eigenvectors of
their scatter about that mean. A task takes its vectors one at a time: each is a centred rank-one update,
solved by the secular equation, after what it does not touch has been deflated. Two spectra combine by the
same updates, one for each eigenvector of the other and one for the distance of the means, level by level
until one is left. A last distributed pass projects the covariance on the basis found (Rayleigh-Ritz), which
takes away what rounding has left in it, and gives components to double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.sources.shared import stored

COMPONENTS = 16
GRAIN, OFFSET = 64, 1_000_000
#: Entries whose integer would not be exact as a double count as non-finite.
MOST_ENTRY = float(1 << 46)

#: Vectors that a task takes one after the other, and spectra that a task combines.
TASK_ROWS, FAN_IN = 4096, 32
EPS = float(np.finfo(np.float64).eps)
#: Components with a smaller share of the variance than this are rounding, not directions.
LEAST_SHARE = 1e-13

SPECTRUM = "part long, n long, mean array<double>, spread array<double>, basis array<double>"


@lru_cache(maxsize=256)
def _triangles(n: int) -> tuple[np.ndarray, np.ndarray]:
    """1.0 on and above the diagonal; whether a place lies below it."""
    lower = np.tri(n, k=-1, dtype=bool)
    return (~lower).astype(np.float64), lower


def _roots(poles: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weight / (poles - x)), one above each pole: nearest pole's index and offset from it.

    `poles` ascend strictly and `weight` is positive. Rational steps through the two poles next to a root,
    kept within a bracket that each step narrows.
    """
    n = len(poles)
    right = np.append(poles[1:], poles[-1] + weight.sum())
    middle = (right - poles) / 2
    at = poles[:, None] - poles[None, :] - middle[None, :]  # pole j less the middle of stretch i
    value = 1 + (weight[:, None] / at).sum(axis=0)
    near = np.arange(n) + ((value < 0) & (np.arange(n) < n - 1))
    width = right - poles
    left_side = near == np.arange(n)
    low = np.where(left_side, 0.0, -middle)
    high = np.where(left_side, np.where(np.arange(n) == n - 1, width, middle), 0.0)
    shift = poles[:, None] - poles[near][None, :]
    upto, ones = _triangles(n)[0], np.ones(n)  # poles up to the root's own; all of them
    own_left, own_right = poles - poles[near], right - poles[near]
    x = (low + high) / 2
    gap, term, part, column = np.empty((n, n)), np.empty((n, n)), np.empty((n, n)), weight[:, None]
    for _ in range(80):
        np.subtract(shift, x, out=gap)
        np.divide(column, gap, out=term)
        below = ones @ np.multiply(term, upto, out=part)  # negative, as the rest is positive
        total = ones @ term
        value = 1 + total
        close = np.abs(value) <= 4 * EPS * (1 + total - 2 * below)
        if close.all():
            break
        np.divide(term, gap, out=term)
        up = ones @ np.multiply(term, upto, out=part)
        down = ones @ term - up
        low, high = np.where(value < 0, x, low), np.where(value > 0, x, high)
        a_gap, b_gap = own_left - x, own_right - x
        b = a_gap * b_gap * value
        a = (a_gap + b_gap) * value - a_gap * b_gap * (up + down)
        c = value - a_gap * up - b_gap * down
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(all="ignore"):
            to = x + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            inside = (to > low) & (to < high)  # false for nan
        to = np.where(close, x, np.where(inside, to, (low + high) / 2))
        if (to == x).all():
            break
        x = to
    return near, x


class Spectrum:
    """Number, mean, and scatter (eigenvalues ascending, eigenvectors as columns) of some vectors."""

    def __init__(self, width: int):
        self.n = 0
        self.mean = np.zeros(width)
        self.values = np.zeros(width)
        self.basis = np.eye(width)

    def rank_one(self, vector: np.ndarray) -> None:
        """The scatter plus the outer product of `vector` with itself."""
        d, u = self.values, self.basis
        z = vector @ u
        total = float(z @ z)
        if total == 0:
            return
        least = 8 * EPS * max(float(d[-1]), total)
        # Equal eigenvalues: turn their vectors so that one of them carries all of z.
        ends = np.flatnonzero(np.diff(d) > least) + 1
        if len(ends) < len(d) - 1:
            u = u.copy()
            for start, stop in zip(np.r_[0, ends], np.r_[ends, len(d)], strict=True):
                if stop - start > 1:
                    own = z[start:stop].copy()
                    length = math.sqrt(float(own @ own))
                    if length == 0:
                        continue
                    mirror = own.copy()
                    mirror[-1] += math.copysign(length, own[-1])
                    block = u[:, start:stop]
                    u[:, start:stop] = block - np.outer(block @ mirror, mirror) * (2 / float(mirror @ mirror))
                    z[start:stop] = 0
                    z[stop - 1] = -math.copysign(length, own[-1])
        # What is as good as untouched stays as it is.
        touched = np.abs(z) * math.sqrt(total) > least
        moved = np.flatnonzero(touched)
        if not len(moved):
            return
        p, w = d[moved], z[moved]
        near, x = _roots(p, w * w)
        m = len(p)
        gap = (p[near][None, :] - p[:, None]) + x[None, :]  # root i less pole j, at [j, i]
        # The z that these roots belong to exactly, so that the vectors come out orthogonal.
        left = p[:, None] - p[None, :]
        steps = np.ones((m, m))
        steps[:, :-1] = left.T[:, 1:]  # roots above pole j go with the next pole; the last alone
        np.copyto(steps, left.T, where=_triangles(m)[1])  # those below it with their own
        exact = np.sqrt(np.abs(np.prod(gap / steps, axis=1)))
        vectors = np.copysign(exact, w)[:, None] / -gap
        vectors /= np.sqrt((vectors * vectors).sum(axis=0))[None, :]
        values = d.copy()
        values[moved] = p[near] + x
        basis = u if u is not self.basis else u.copy()
        basis[:, moved] = u[:, moved] @ vectors
        order = np.argsort(values, kind="stable")
        self.values, self.basis = np.maximum(values[order], 0), basis[:, order]

    def add(self, vector: np.ndarray) -> None:
        """One vector more: a centred rank-one update."""
        away = vector - self.mean
        self.n += 1
        if self.n > 1:
            self.rank_one(away * math.sqrt((self.n - 1) / self.n))
        self.mean = self.mean + away / self.n

    def join(self, other: Spectrum) -> None:
        """The vectors of both: the other's eigenvectors one by one, then the distance of the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.rank_one(math.sqrt(value) * vector)
        away = other.mean - self.mean
        n = self.n + other.n
        if self.n:
            self.rank_one(away * math.sqrt(self.n / n * other.n))
        self.mean = self.mean + away * (other.n / n)
        self.n = n

    def row(self, part: int) -> pd.DataFrame:
        cells = [self.mean, self.values, self.basis.ravel()]
        return pd.DataFrame({"part": [part], "n": [self.n], "mean": [cells[0]], "spread": [cells[1]], "basis": [cells[2]]})

    @classmethod
    def of_row(cls, row) -> Spectrum:
        out = cls(len(row["mean"]))
        out.n, out.mean, out.values = int(row["n"]), np.array(row["mean"]), np.array(row["spread"])
        out.basis = np.array(row["basis"]).reshape(len(out.mean), len(out.mean))
        return out


def _learn(base: np.ndarray):
    """Work of a task: the spectrum of its vectors, about `base`."""

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        out = Spectrum(len(base))
        for vector in np.stack(rows["x"].tolist()) - base:
            out.add(vector.astype(np.float64))
        return out.row(int(rows["part"].iloc[0]))

    return learn


def _combine(rows: pd.DataFrame) -> pd.DataFrame:
    """Work of a task: one spectrum of several."""
    rows = rows.sort_values("part")
    out = Spectrum.of_row(rows.iloc[0])
    for _, row in rows.iloc[1:].iterrows():
        out.join(Spectrum.of_row(row))
    return out.row(int(rows["part"].iloc[0]) // FAN_IN)


def spectrum(fit: DataFrame, n: int, base: np.ndarray) -> Spectrum:
    """The spectrum of all rows of `fit` (x), less `base`."""
    tasks = max(1, -(-n // TASK_ROWS))
    dealt = fit.select("x", F.pmod(F.xxhash64("x"), F.lit(tasks)).alias("part"))
    now, left = stored(dealt.groupBy("part").applyInPandas(_learn(base), SPECTRUM), "whitening-spectra"), tasks
    while left > 1:
        grouped = now.groupBy(F.expr(f"part div {FAN_IN}").alias("to"))
        now, left = stored(grouped.applyInPandas(_combine, SPECTRUM), "whitening-spectra"), -(-left // FAN_IN)
    return Spectrum.of_row(now.first())


def _summed(frame: DataFrame, measure, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of the matrix that `measure` (vectors -> matrix) makes of each batch."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                total += measure(np.stack(batch["x"].tolist()))
        i, j = np.divmod(np.arange(total.size), shape[1])
        yield pd.DataFrame({"i": i, "j": j, "value": total.ravel()})

    out = np.zeros(shape)
    for r in frame.select("x").mapInPandas(add_up, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"], r["j"]] = r["value"]
    return out


def _exact_sums(fit: DataFrame, width: int) -> list[int]:
    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [0] * width
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].tolist())
                total = [t + (int(h) << 20) + int(low) for t, h, low in zip(total, (x >> 20).sum(axis=0), (x & 0xFFFFF).sum(axis=0), strict=True)]
        yield pd.DataFrame({"i": range(width), "value": [Decimal(t) for t in total]})

    sums = fit.select("x").mapInPandas(add_up, "i int, value decimal(38,0)").groupBy("i").agg(F.sum("value").alias("value"))
    return [int(r["value"]) for r in sums.orderBy("i").collect()]


def grid(vector: Column) -> Column:
    """The long integers floor(64 c) + 1000000 of the entries."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(GRAIN)) * c.cast("double")) + F.lit(OFFSET).cast("long"))


def usable(vector: Column) -> Column:
    """Whether the vector is there, not empty, and all entries are finite."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < MOST_ENTRY)
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, entry), F.lit(False))


def _written(n: int, base: np.ndarray, rest: list[int], axes: np.ndarray, values: np.ndarray, share: np.ndarray, error: float):
    """Work of a task: for each vector one row of each component."""
    mean = np.array([r / n for r in rest])
    k = len(values)
    squares = sum(r * r for r in rest)
    largest = max(map(abs, rest), default=0)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            u = np.stack(batch["x"].tolist()) - base
            most = int(np.abs(u).max())
            kind = np.int64 if len(base) * max(most * most, most * largest) < 1 << 62 else object
            u_, r_ = u.astype(kind), np.array(rest, dtype=kind)
            own, cross = (u_ * u_).sum(axis=1), (u_ * r_).sum(axis=1)
            away = [n * n * int(a) - 2 * n * int(b) + squares for a, b in zip(own, cross, strict=True)]
            away = pd.array([a if a < 1 << 63 else None for a in away], dtype="Int64")
            out = (u - mean) @ axes / np.sqrt(values)
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"].repeat(k).array,
                    "component": np.tile(np.arange(1, k + 1), len(batch)),
                    "n": n,
                    "deviation": away.repeat(k),
                    "whitened": out.ravel(),
                    "explained": np.tile(share, len(batch)),
                    "identity_error": error,
                }
            )

    return write


OUT_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For each usable row of `vectors` (vec_id, embedding) one row of each of the first `components`.

    Fitted on each distinct integer vector once, so repeated rows do not move the components; each of them
    has its own result rows. Rows whose vector is null, empty, or holds null, non-finite or unusably large
    entries (2^46) are left out, and so are those of another length than most rows have (of equally many,
    the longer). Directions without variance are no components: fewer than `components` rows then. Of equal
    eigenvalues any basis may come out, the same for all rows. A deviation beyond 64 bits is null. One
    distinct vector, or an empty table, gives no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(usable(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("rows"))
    common = widths.orderBy(F.desc("rows"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], OUT_SCHEMA)
    width = common["width"]
    rows = rows.where(F.size("v") == width).select("vec_id", grid(F.col("v")).alias("x"))
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    n, sums = fit.count(), _exact_sums(fit, width)
    base = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s - n * int(b) for s, b in zip(sums, base, strict=True)]
    mean = np.array([r / n for r in rest])

    basis, _ = np.linalg.qr(spectrum(fit, n, base).basis)  # width x width, as all that follows in the driver
    along = lambda x: (x - base - mean) @ basis
    ritz = _summed(fit, lambda x: (y := along(x)).T @ y, (width, width)) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, axes = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(np.trace(ritz))
    k = min(components, int((values > LEAST_SHARE * trace).sum())) if trace > 0 else 0
    if not k:
        return spark.createDataFrame([], OUT_SCHEMA)
    values, axes, share = values[:k], axes[:, :k], values[:k] / trace

    white = lambda x: (x - base - mean) @ axes / np.sqrt(values)
    middle = _summed(fit, lambda x: white(x).sum(axis=0)[None, :], (1, k))[0] / n
    around = _summed(fit, lambda x: (y := white(x) - middle).T @ y, (k, k)) / n
    error = float(np.abs(around - np.eye(k)).max())
    return rows.mapInPandas(_written(n, base, rest, axes, values, share, error), OUT_SCHEMA)
