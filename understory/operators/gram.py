"""Sums of cross-products, taken per Arrow batch and added up by one aggregate.

A design of 24 columns has 325 products; as 325 SQL aggregates they make a
method too large for the JIT, so each task multiplies whole batches instead and
hands on a fixed number of partial sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SUMS_SCHEMA = "grp int, pos int, total double"


def to_matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Columns of a batch as a float matrix, null as NaN."""
    return np.column_stack(
        [batch.column(name).to_numpy(zero_copy_only=False).astype(float, copy=False) for name in names]
    )


def batch_sums(
    df: DataFrame, part: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]
) -> DataFrame:
    """Sum equal-length vectors over all batches: ``part`` yields (group, vector)."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for group, vector in part(batch):
                    totals[group] = totals[group] + vector if group in totals else vector
        for group, vector in totals.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(vector), group, dtype=np.int32)),
                    pa.array(np.arange(len(vector), dtype=np.int32)),
                    pa.array(np.asarray(vector, dtype=float)),
                ],
                names=["grp", "pos", "total"],
            )

    return df.mapInArrow(run, SUMS_SCHEMA).groupBy("grp", "pos").agg(F.sum("total").alias("total"))


def collect_vectors(sums: DataFrame, size: int) -> dict[int, np.ndarray]:
    """Totals of a few groups, ``size`` numbers each, at the driver."""
    vectors: dict[int, np.ndarray] = {}
    for row in sums.collect():
        vectors.setdefault(row["grp"], np.zeros(size))[row["pos"]] = row["total"]
    return vectors


@dataclass(frozen=True)
class Gram:
    """Cross-products of columns about ``shift`` and of the response about ``y_shift``.

    The intercept is in position zero and isn't shifted. Grams add up if their shifts are equal.
    """

    xx: np.ndarray
    xy: np.ndarray
    yy: float
    n: int
    shift: np.ndarray
    y_shift: float

    def __add__(self, other: "Gram") -> "Gram":
        return Gram(self.xx + other.xx, self.xy + other.xy, self.yy + other.yy, self.n + other.n, self.shift, self.y_shift)

    def _scaled(self) -> tuple[np.ndarray, np.ndarray]:
        """Products of columns scaled to length one, and the scales."""
        size = np.sqrt(np.diag(self.xx))
        if self.n < len(size) or not np.all(size > 0):
            raise ValueError(f"{self.n} complete rows cannot determine {len(size)} coefficients, or a column is constant")
        return self.xx / np.outer(size, size), size

    def _unshifted(self) -> np.ndarray:
        """Turns coefficients of the shifted columns into those of the columns as they are."""
        turn = np.eye(len(self.shift))
        turn[0, 1:] = -self.shift[1:]
        return turn

    def coefficients(self) -> tuple[np.ndarray, float]:
        """Least-squares coefficients and the residual sum of squares."""
        products, size = self._scaled()
        coef = np.linalg.solve(products, self.xy / size) / size
        residual = self.yy - float(coef @ self.xy)
        if residual < -1e-9 * self.yy:
            raise ArithmeticError("the cross-products lost too many digits")
        coef = self._unshifted() @ coef
        coef[0] += self.y_shift
        return coef, max(residual, 0.0)

    def inverse(self) -> np.ndarray:
        """Inverse of the cross-products of the columns as they are."""
        products, size = self._scaled()
        turn = self._unshifted()
        return turn @ (np.linalg.inv(products) / np.outer(size, size)) @ turn.T


def _anchor(shift: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``shift`` with the columns that have none yet set to their mean here; a constant column's is its value."""
    seen = ~np.isnan(table)
    n = seen.sum(0)
    low, high = np.where(seen, table, np.inf).min(0, initial=np.inf), np.where(seen, table, -np.inf).max(0, initial=-np.inf)
    mean = np.where(seen, table, 0.0).sum(0) / np.maximum(n, 1)
    return np.where(np.isnan(shift) & (n > 0), np.where(low == high, low, mean), shift)


TASK_SCHEMA = "grp int, bad long, shift array<double>, sums array<double>"


def _task_row(group: int, bad: int, shift: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    numbers = [pa.array([v], pa.list_(pa.float64())) for v in (shift, sums)]
    return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([bad], pa.int64()), *numbers], ["grp", "bad", "shift", "sums"])


def _task_rows(sums: DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of ``TASK_SCHEMA`` at the driver: one per task and group."""
    table = sums.toArrow()
    arrays = [[v.values.to_numpy() for v in table.column(c)] for c in ("shift", "sums")]
    return list(zip(table.column("grp").to_pylist(), table.column("bad").to_pylist(), *arrays))


def gram_by(
    df: DataFrame,
    columns: list[str],
    response: Column | None = None,
    weight: Column | None = None,
    group: Column | None = None,
    centre_response: bool = True,
    forbidden: Column | None = None,
    complaint: str = "rows are not allowed",
) -> dict[int, Gram]:
    """Cross-products per value of a small integer column, such as a fold number, in one pass.

    Rows with a missing value take no part. Products are always taken about the means: about
    zero, a column far from it would lose its digits. A task takes them about the means of its
    first batch; the few sums of every task are then moved to the means of all rows. The
    same pass counts ``forbidden`` rows with a value in every column, which are an error.

    What is missing is found in the batch: as conditions on two dozen columns it makes a method
    too large for the JIT.
    """
    p = len(columns) + 1
    names = [f"x{i}" for i in range(p - 1)]
    data = df.select(
        *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)],
        (F.lit(0.0) if response is None else response.cast("double")).alias("y"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"),
        (F.lit(0) if group is None else group.cast("int")).alias("grp"),
        F.coalesce(F.lit(False) if forbidden is None else forbidden, F.lit(False)).alias("bad"),
    )

    def run(batches):
        shift, totals, bad = np.full(p, np.nan), {}, 0
        for batch in batches:
            table, w = to_matrix(batch, [*names, "y"]), to_matrix(batch, ["w"])[:, 0]
            known = ~np.isnan(table[:, :-1]).any(1)
            bad += int((known & batch.column("bad").to_numpy(zero_copy_only=False)).sum())
            groups = batch.column("grp").to_numpy(zero_copy_only=False)
            whole = known & ~np.isnan(table[:, -1]) & ~np.isnan(w) & ~np.isnan(groups)
            if not whole.any():
                continue
            if not whole.all():
                table, w, groups = table[whole], w[whole], groups[whole]
            shift = _anchor(shift, table)
            if not centre_response:
                shift[-1] = 0.0
            x = np.column_stack([np.ones(len(table)), table - shift])
            values = np.unique(groups)
            for value in values:
                own = groups == value if len(values) > 1 else slice(None)
                z = x[own]
                sums = np.concatenate([(z.T @ (z * w[own, None])).ravel(), z.sum(0)])
                totals[int(value)] = totals.get(int(value), 0.0) + sums
        if bad:
            yield _task_row(0, bad, np.zeros(0), np.zeros(0))
        for value, sums in totals.items():
            yield _task_row(value, 0, shift, sums)

    parts = _task_rows(data.mapInArrow(run, TASK_SCHEMA))
    bad = sum(b for _, b, _, _ in parts)
    if bad:
        raise ValueError(f"{bad} {complaint}")
    if not parts:
        return {}
    first = parts[0][2]
    # Plain sums of a part: its rows, then its columns about its shift.
    plain = [sums[(p + 1) ** 2 :] for _, _, _, sums in parts]
    moved = sum(s[1:] + s[0] * (shift - first) for (_, _, shift, _), s in zip(parts, plain))
    about = first + moved / sum(s[0] for s in plain)
    if not centre_response:
        about[-1] = 0.0
    totals: dict[int, tuple[np.ndarray, float]] = {}
    for (value, _, shift, sums), s in zip(parts, plain):
        turn = np.eye(p + 1)
        turn[1:, 0] = shift - about
        cross, rows = totals.get(value, (0.0, 0.0))
        totals[value] = cross + turn @ sums[: (p + 1) ** 2].reshape(p + 1, p + 1) @ turn.T, rows + s[0]
    shift = np.append(0.0, about[:-1])
    return {
        value: Gram(cross[:p, :p], cross[:p, p], float(cross[p, p]), int(round(rows)), shift, float(about[-1]))
        for value, (cross, rows) in totals.items()
    }


def gram(
    df: DataFrame,
    columns: list[str],
    response: Column | None = None,
    weight: Column | None = None,
    centre_response: bool = True,
    forbidden: Column | None = None,
    complaint: str = "rows are not allowed",
) -> Gram:
    """Cross-products over the whole table; only (p+1)^2 sums reach the driver."""
    found = gram_by(df, columns, response, weight, centre_response=centre_response, forbidden=forbidden, complaint=complaint)
    if not found:
        raise ValueError("no complete rows")
    return found[0]


def pairwise_moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Correlation and row count of each column pair over the rows complete for it, in one pass.

    A task takes products about means of its own; its sums are then moved to those of all
    rows. A correlation does not depend on the shift.
    """
    p = len(columns)
    names = [f"x{i}" for i in range(p)]
    clean = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)])

    def run(batches):
        shift, totals = np.full(p, np.nan), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = to_matrix(batch, names)
            shift = _anchor(shift, x)
            seen = (~np.isnan(x)).astype(float)
            x = np.where(seen > 0, x - shift, 0.0)
            totals = totals + np.concatenate([m.ravel() for m in (seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x)])
        if np.ndim(totals):
            yield _task_row(0, 0, np.nan_to_num(shift), totals)

    parts = [(shift, sums.reshape(4, p, p)) for _, _, shift, sums in _task_rows(clean.mapInArrow(run, TASK_SCHEMA))]
    n, s, ss, cross = np.zeros((4, p, p))
    count = sum((np.diag(m[0]) for _, m in parts), np.zeros(p))
    # Of tasks that saw a column.
    first = np.zeros(p)
    for shift, m in reversed(parts):
        first = np.where(np.diag(m[0]) > 0, shift, first)
    moved = sum((np.diag(m[1]) + np.diag(m[0]) * (shift - first) for shift, m in parts), np.zeros(p))
    about = first + moved / np.maximum(count, 1)
    for shift, (own_n, own_s, own_ss, own_cross) in parts:
        d = np.where(np.diag(own_n) > 0, shift - about, 0.0)[:, None]
        n, s = n + own_n, s + own_s + d * own_n
        ss = ss + own_ss + 2 * d * own_s + d * d * own_n
        cross = cross + own_cross + d * own_s.T + d.T * own_s + d * d.T * own_n
    with np.errstate(divide="ignore", invalid="ignore"):
        covariance = cross - s * s.T / n
        spread = ss - s * s / n
        r = covariance / np.sqrt(spread * spread.T)
    return r, n
