"""Fixed terms and varying intercepts solved together.

The mixed-model equations of y = X b + Z u + e, with u of variance s_f^2 in factor f and
e of variance s^2 / weight, are reduced to one row per level: V^-1 needs only
(Z'WZ + L)^-1 applied to Z'WX and Z'Wy, where L holds s^2 / s_f^2. Conjugate gradients
find that for all columns at once. A product with Z'WZ is one join and one aggregate over
the pairs of levels that occur together, whatever the number of factors; the
preconditioner is the block of each factor, which is diagonal. Levels stay a table
throughout; what reaches the driver is as large as the number of fixed terms.

Variance components are moment estimates (Henderson's first method) from the residuals of
the fixed terms alone, with what overlapping factors share taken apart. Logit families go
around it by penalised quasi-likelihood.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from understory.functions.links import bernoulli_log_density, beta_log_density, inverse_logit, normal_log_density
from understory.functions.nulls import match_join
from understory.operators.design import Formula
from understory.operators.fit import LINEAR, Fit, ZeroOneFit, boundary_mass, check_support, complete, fit, fitted_response, linear_predictor, precision_of
from understory.operators.gram import Gram, batch_sums, collect_vectors, gram, gram_by, to_matrix
from understory.operators.predict import BROADCAST_BYTES, factors_of
from understory.session import pin

Z_95 = 1.959963984540054
#: Size of what is left of an equation, against its right side, at which the solution is taken.
TOLERANCE = 1e-9
#: Steps without any progress after which a solution is given up.
PATIENCE = 25
#: Numbers of a level table and its links up to which the steps are taken at the driver, where a step needs no job.
SMALL = 1 << 20
#: Hashes that are tried as numbers of the levels.
HASHES = 4
#: Step of the linear predictor's coefficients, in standard errors, at which quasi-likelihood has settled.
STEP = 1e-4


@dataclass(frozen=True)
class MixedFit:
    """Fixed terms, level effects (``grp``, ``level``, ``n``, ``estimate``, ``est_error``, ...), and how well they solve the equations."""

    fixed: Fit
    effects: DataFrame
    group_sd: dict[str, float]
    residual: float


@dataclass(frozen=True)
class Levels:
    """One row per level with its sums, and one row per ordered pair of levels that occur together."""

    rows: DataFrame
    links: DataFrame | None
    groups: list[str]
    width: int


def key_of(group: str) -> Column:
    """Text of a level; a missing one is a level of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))


def cell_sums(frame: DataFrame, groups: list[str], columns: list[Column], weight: Column, *more: Column) -> DataFrame:
    """Sums of weight (``d``) and weighted columns (``t*``) per occurring combination of levels (``k*``) and of ``more``: one pass over the frame."""
    names = [f"t{k}" for k in range(len(columns))]
    keys = [*[key_of(g).alias(f"k{i}") for i, g in enumerate(groups)], *more]
    staged = frame.select(*keys, weight.alias("w"), *[(weight * c).alias(n) for n, c in zip(names, columns)])
    return pin(staged.groupBy(*staged.columns[: len(keys)]).agg(F.sum("w").alias("d"), *[F.sum(n).alias(n) for n in names]))


def levels_of(cells: DataFrame, groups: list[str], width: int) -> Levels:
    """Sums per level, and of weight per pair of levels, from the cells.

    A level's number is a hash of its factor and key, so pairs are numbered without a
    join. That no two levels share one is checked; else another hash is taken.
    """
    names = [f"t{k}" for k in range(width)]
    for seed in range(HASHES):
        number = lambda i: F.xxhash64(F.lit(seed), F.lit(i), F.col(f"k{i}"))  # noqa: B023, E731
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("grp"), F.col(f"k{i}").alias("key"), number(i).alias("id")) for i in range(len(groups))]))
        rows = pin(
            cells.select(each.alias("at"), "d", *names).groupBy("at").agg(F.sum("d").alias("d"), *[F.sum(n).alias(n) for n in names])
            .select("at.grp", "at.key", "d", *names, "at.id")
        )
        if len(groups) == 1:
            return Levels(rows, None, groups, width)
        if rows.groupBy("id").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"{HASHES} hashes of the levels collide")
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("f"), number(i).alias("i"), F.lit(j).alias("g"), number(j).alias("j"))
                for i in range(len(groups)) for j in range(i)
            ]
        )
    )
    half = pin(cells.select(pairs.alias("p"), "d").groupBy("p").agg(F.sum("d").alias("n")).select("p.i", "p.j", "n", "p.f", "p.g"))
    back = half.select(F.col("j").alias("i"), F.col("i").alias("j"), "n", F.col("g").alias("f"), F.col("f").alias("g"))
    return Levels(rows, half.unionByName(back), groups, width)


def variance_components(levels: Levels, coef: np.ndarray, squares: float, rows: int, dispersion: float | None = None) -> tuple[float, np.ndarray]:
    """(residual variance, variance of each factor) that give the expected sums of squares between levels.

    ``coef`` are the coefficients of the fixed terms alone, ``squares`` their residual
    sum of squares. Negative ones are set to zero and the others found again.
    """
    k = len(levels.groups)
    s = F.col(f"t{levels.width - 1}") - reduce(lambda a, b: a + b, [F.col(f"t{i}") * float(c) for i, c in enumerate(coef)])
    own = levels.rows.groupBy("grp").agg(
        F.sum(s * s / F.col("d")).alias("between"), F.count(F.lit(1)).alias("levels"), F.sum(F.col("d") * F.col("d")).alias("d2"), F.sum("d").alias("d")
    )
    system, right = np.zeros((k + 1, k + 1)), np.zeros(k + 1)
    for r in own.collect():  # one row a factor
        f, n = r["grp"], r["d"]
        right[f] = r["between"]
        # Expected square between the levels of f, less that of the mean: own variance, residual variance.
        system[f, f], system[f, k] = n - r["d2"] / n, r["levels"] - 1
        system[:k, f] -= np.where(np.arange(k) == f, 0.0, r["d2"] / n)
        system[k, f] = n - r["d2"] / n
    system[k, k], right[k] = rows - len(coef), squares
    if levels.links is not None:
        d = levels.rows.select(F.col("id").alias("i"), "d")
        shared = levels.links.join(d, "i").groupBy("f", "g").agg(F.sum(F.col("n") * F.col("n") / F.col("d")).alias("c"))
        for r in shared.collect():  # one row a pair of factors
            system[r["f"], r["g"]] += r["c"]
    if dispersion is not None:
        right[:k] -= system[:k, k] * dispersion
        system, right = system[:k, :k], right[:k]
    kept = list(range(len(right)))
    while True:
        found = np.zeros(len(right))
        found[kept] = np.linalg.lstsq(system[np.ix_(kept, kept)], right[kept], rcond=None)[0]
        if not (found < 0).any():
            break
        kept.remove(int(np.argmin(found)))
    return (float(found[k]), found[:k]) if dispersion is None else (dispersion, found)


def solve_levels(levels: Levels, ridge: np.ndarray, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """(Z'WZ + diag(ridge of the factor))^-1 times the sums ``t*``, as columns ``x*`` beside them, and the largest relative residual.

    Conjugate gradients with one reduction a step. Each step costs one product and one
    row of numbers at the driver. Levels and links that measure under ``SMALL`` take the
    same steps there. If all factors but the largest have few levels, it is taken out exactly. Raises if ``PATIENCE`` steps bring no progress.
    """
    m = levels.width
    ridges = F.element_at(F.array(*[F.lit(float(v)) for v in ridge]), F.col("grp") + 1)
    rows = levels.rows.withColumn("d", F.col("d") + ridges)
    if levels.links is None:
        return rows.select("*", *[(F.col(f"t{k}") / F.col("d")).alias(f"x{k}") for k in range(m)]), 0.0
    if rows.count() * (m + 2) + levels.links.count() * 3 <= SMALL:
        return _solve_small(rows, levels.links, m, tolerance)
    sizes = {r["grp"]: r["count"] for r in rows.groupBy("grp").count().collect()}  # one row a factor
    largest = max(sizes, key=lambda f: (sizes[f], f))
    if (sum(sizes.values()) - sizes[largest]) ** 2 <= SMALL:
        return _eliminate(rows, levels.links, largest, m, tolerance)

    links = levels.links.select("i", "j", "n")

    def product(state: DataFrame) -> DataFrame:
        """The state with w = A u, kept, where u = r / d."""
        u = state.select(F.col("id").alias("j"), *[(F.col(f"r{k}") / F.col("d")).alias(f"u{k}") for k in range(m)])
        sums = links.join(u, "j").groupBy(F.col("i").alias("id")).agg(*[F.sum(F.col("n") * F.col(f"u{k}")).alias(f"z{k}") for k in range(m)])
        with_sums = state.join(sums, "id", "left")
        own = [(F.coalesce(F.col(f"z{k}"), F.lit(0.0)) + F.col(f"r{k}")).alias(f"w{k}") for k in range(m)]  # d u = r
        return pin(with_sums.select(*state.columns, *own))

    def scalars(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        sums = [F.sum(F.col(a) * F.col(f"r{k}") / F.col("d")) for a, k in [(f"{c}{k}", k) for c in "rw" for k in range(m)]]
        found = np.array(state.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first(), float)
        return found[:m], found[m:]

    zero = F.lit(0.0)
    state = product(rows.select("*", *[x for k in range(m) for x in (F.col(f"t{k}").alias(f"r{k}"), zero.alias(f"x{k}"), zero.alias(f"p{k}"), zero.alias(f"s{k}"))]))
    gamma, delta = scalars(state)
    first = np.where(gamma > 0, gamma, 1.0)
    active = gamma > 0
    alpha, beta = np.where(active, gamma / np.where(active, delta, 1.0), 0.0), np.zeros(m)
    best, waited = np.inf, 0
    while active.any():
        columns = ["id", "grp", "key", "d", *[f"t{k}" for k in range(m)]]
        step = []
        for k in range(m):
            a, b = F.lit(float(alpha[k])), F.lit(float(beta[k]))
            p = F.col(f"r{k}") / F.col("d") + b * F.col(f"p{k}")
            s = F.col(f"w{k}") + b * F.col(f"s{k}")
            step += [(F.col(f"r{k}") - a * s).alias(f"r{k}"), (F.col(f"x{k}") + a * p).alias(f"x{k}"), p.alias(f"p{k}"), s.alias(f"s{k}")]
        state = product(state.select(*columns, *step))
        old, (gamma, delta) = gamma, scalars(state)
        left = float(np.sqrt(np.max(np.maximum(gamma, 0.0) / first)))
        if not math.isfinite(left):
            raise ArithmeticError("the mixed-model equations have no finite solution")
        waited = 0 if left < best else waited + 1
        best = min(best, left)
        if left <= tolerance:
            break
        if waited >= PATIENCE:
            raise RuntimeError(f"the mixed-model equations stay {best:.3g} from solved")
        active = gamma > (0.01 * tolerance) ** 2 * first
        beta = np.where(active, gamma / np.where(old > 0, old, 1.0), 0.0)
        lower = delta - beta * gamma / np.where(alpha != 0, alpha, 1.0)
        alpha = np.where(active, gamma / np.where(active, lower, 1.0), 0.0)
    return state.select("id", "grp", "key", "d", *[f"t{k}" for k in range(m)], *[f"x{k}" for k in range(m)]), float(np.sqrt(np.max(np.maximum(gamma, 0.0) / first)))


def _solve_small(rows: DataFrame, links: DataFrame, m: int, tolerance: float) -> tuple[DataFrame, float]:
    """``solve_levels`` for tables of a checked size."""
    table = rows.toArrow()
    met = links.select("i", "j", "n").toArrow()
    ids = table.column("id").to_numpy()
    order = np.argsort(ids)
    i, j = (order[np.searchsorted(ids, met.column(c).to_numpy(), sorter=order)] for c in "ij")
    n, d = met.column("n").to_numpy(), table.column("d").to_numpy()[:, None]
    t = np.column_stack([table.column(f"t{k}").to_numpy() for k in range(m)])

    def product(u):
        return np.column_stack([np.bincount(i, n * u[j, k], len(ids)) for k in range(m)]) + d * u

    x, r = np.zeros_like(t), t
    p = r / d
    gamma = (r * p).sum(0)
    first = np.where(gamma > 0, gamma, 1.0)
    best, waited, left = np.inf, 0, 0.0
    while (gamma > (0.01 * tolerance) ** 2 * first).any():
        w = product(p)
        slope = (p * w).sum(0)
        alpha = np.where(slope > 0, gamma / np.where(slope > 0, slope, 1.0), 0.0)
        x, r = x + alpha * p, r - alpha * w
        u = r / d
        old, gamma = gamma, (r * u).sum(0)
        p = u + np.where(old > 0, gamma / np.where(old > 0, old, 1.0), 0.0) * p
        left = float(np.sqrt(np.max(gamma / first)))
        if not math.isfinite(left):
            raise ArithmeticError("the mixed-model equations have no finite solution")
        waited = 0 if left < best else waited + 1
        best = min(best, left)
        if left <= tolerance:
            break
        if waited >= PATIENCE:
            raise RuntimeError(f"the mixed-model equations stay {best:.3g} from solved")
    for k in range(m):
        table = table.append_column(f"x{k}", pa.array(x[:, k]))
    return rows.sparkSession.createDataFrame(table), left


def _eliminate(rows: DataFrame, links: DataFrame, largest: int, m: int, tolerance: float) -> tuple[DataFrame, float]:
    """``solve_levels`` without iteration where the factors but ``largest`` have few levels together.

    Levels of one factor don't meet each other, so each level of ``largest`` depends on the few others only. Tasks
    add up what it takes from their equations, these are solved at the driver, and every level of ``largest`` follows.
    """
    spark = rows.sparkSession
    few = rows.where(F.col("grp") != largest).toArrow()  # at most sqrt(SMALL) levels
    ids = few.column("id").to_numpy()
    order = np.argsort(ids)
    k, d = len(ids), few.column("d").to_numpy()
    t = np.column_stack([few.column(f"t{c}").to_numpy() for c in range(m)])
    met = links.where((F.col("f") != largest) & (F.col("g") != largest)).select("i", "j", "n").toArrow()  # at most SMALL pairs
    place = lambda numbers: order[np.searchsorted(ids, numbers, sorter=order)]
    system = np.diag(d)
    system[place(met.column("i").to_numpy()), place(met.column("j").to_numpy())] += met.column("n").to_numpy()
    names = [f"t{c}" for c in range(m)]
    own = links.where(F.col("f") == largest).groupBy(F.col("i").alias("id")).agg(F.collect_list("j").alias("j"), F.collect_list("n").alias("n"))
    many = pin(rows.where(F.col("grp") == largest).join(own, "id"))

    def met_rows(batch):
        """Chunks of a batch: their slice and their weights with the few levels, as a matrix."""
        j, n = batch.column("j"), batch.column("n")
        bounds = j.offsets.to_numpy()
        at, weight = place(j.values.to_numpy()), n.values.to_numpy()
        starts = n.offsets.to_numpy()
        step = max(1, SMALL // k)
        for lo in range(0, batch.num_rows, step):
            hi = min(lo + step, batch.num_rows)
            matrix = np.zeros((hi - lo, k))
            which = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
            matrix[which, at[bounds[lo] : bounds[hi]]] = weight[starts[lo] : starts[hi]]
            yield slice(lo, hi), matrix

    def part(batch):
        table = to_matrix(batch, ["d", *names])
        for span, matrix in met_rows(batch):
            taken = matrix / table[span, :1]
            yield 0, np.concatenate([(matrix.T @ taken).ravel(), (taken.T @ table[span, 1:]).ravel()])

    sums = collect_vectors(batch_sums(many, part), k * (k + m))[0]
    left_system, right = system - sums[: k * k].reshape(k, k), t - sums[k * k :].reshape(k, m)
    size = np.sqrt(d)
    scaled = (left_system + left_system.T) / 2 / np.outer(size, size)
    x = np.linalg.solve(scaled, right / size[:, None]) / size[:, None]
    # What is left of the few equations; the others hold by construction.
    first = (t * t / d[:, None]).sum(0)
    off = right - left_system @ x
    left = float(np.sqrt(np.max((off * off / d[:, None]).sum(0) / np.where(first > 0, first, 1.0))))
    if not math.isfinite(left):
        raise ArithmeticError("the mixed-model equations have no finite solution")
    if left > tolerance:
        raise RuntimeError(f"the mixed-model equations stay {left:.3g} from solved")
    shared = spark.sparkContext.broadcast(x)
    kept = ["grp", "key", "d", *names, "id"]

    def back(batches):
        for batch in batches:
            table = to_matrix(batch, ["d", *names])
            out = np.empty((batch.num_rows, m))
            for span, matrix in met_rows(batch):
                out[span] = (table[span, 1:] - matrix @ shared.value) / table[span, :1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(c) for c in out.T]], [*kept, *[f"x{c}" for c in range(m)]])

    schema = T.StructType([*[many.schema[c] for c in kept], *[T.StructField(f"x{c}", T.DoubleType()) for c in range(m)]])
    table = few.select(kept)
    for c in range(m):
        table = table.append_column(f"x{c}", pa.array(x[:, c]))
    return many.mapInArrow(back, schema).unionByName(spark.createDataFrame(table)), left


@dataclass(frozen=True)
class Solution:
    """Solved equations: coefficients with covariance, level effects, variances."""

    coef: np.ndarray
    cov: np.ndarray
    effects: DataFrame
    within: float
    between: np.ndarray
    n: int
    residual: float


def solve_mixed(frame: DataFrame, formula: Formula, y: Column, weight: Column | None = None, dispersion: float | None = None, tolerance: float = TOLERANCE) -> Solution:
    """Generalised least squares of ``y`` on the terms, with the grouping factors' effects, on complete rows."""
    if not formula.groups:
        raise ValueError("the formula has no grouping factor")
    g = gram(frame, formula.terms, y, weight)
    cells = cell_sums(frame, formula.group_names, _centred(formula, g, y), F.lit(1.0) if weight is None else weight)
    return _solve(g, levels_of(cells, formula.group_names, len(formula.terms) + 2), dispersion, tolerance)


def _centred(formula: Formula, g: Gram, y: Column) -> list[Column]:
    """One, the terms and the response about the shifts of their cross-products."""
    terms = [F.col(f"`{t}`").cast("double") - F.lit(float(c)) for t, c in zip(formula.terms, g.shift[1:])]
    return [F.lit(1.0), *terms, y - F.lit(float(g.y_shift))]


def _solve(g: Gram, levels: Levels, dispersion: float | None, tolerance: float) -> Solution:
    groups = levels.groups
    size = np.sqrt(np.diag(g.xx))
    plain = np.linalg.solve(g.xx / np.outer(size, size), g.xy / size) / size
    within, between = variance_components(levels, plain, max(g.yy - float(plain @ g.xy), 0.0), g.n, dispersion)
    if within <= 0:
        raise ValueError("the levels leave no residual variance")
    # A factor without variance has no effects: its ridge is so large that they vanish.
    kept = between > 1e-12 * within
    ridge = np.where(kept, within / np.where(kept, between, 1.0), np.inf)
    used = Levels(
        levels.rows.where(F.col("grp").isin([int(f) for f in np.flatnonzero(kept)])),
        None if levels.links is None or kept.sum() < 2 else levels.links.where(F.col("f").isin([int(f) for f in np.flatnonzero(kept)]) & F.col("g").isin([int(f) for f in np.flatnonzero(kept)])),
        groups, levels.width,
    )
    p, m = len(g.xy), levels.width
    solved, left = solve_levels(used, ridge, tolerance)
    solved = pin(solved)

    def part(batch):
        t, x = to_matrix(batch, [f"t{k}" for k in range(p)]), to_matrix(batch, [f"x{k}" for k in range(m)])
        yield 0, (t.T @ x).ravel()

    cross = collect_vectors(batch_sums(solved.select(*[f"t{k}" for k in range(p)], *[f"x{k}" for k in range(m)]), part), p * m)
    taken = cross[0].reshape(p, m) if cross else np.zeros((p, m))
    products, right = (g.xx - taken[:, :p]), g.xy - taken[:, p]
    size = np.sqrt(np.diag(products))
    scaled = (products + products.T) / 2 / np.outer(size, size)
    inner = np.linalg.solve(scaled, right / size) / size
    turn = np.eye(p)
    turn[0, 1:] = -g.shift[1:]
    cov = within * (turn @ (np.linalg.inv(scaled) / np.outer(size, size)) @ turn.T)
    coef = turn @ inner
    coef[0] += g.y_shift
    effect = F.col(f"x{m - 1}") - reduce(lambda a, b: a + b, [F.col(f"x{k}") * float(c) for k, c in enumerate(inner)])
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("grp") + 1)
    every = levels.rows.select("id", "grp", "key", F.col("d").alias("n")).join(solved.select("id", effect.alias("u"), F.col("d").alias("pull")), "id", "left")
    estimate, error = F.coalesce("u", F.lit(0.0)), F.coalesce(F.sqrt(F.lit(within) / F.col("pull")), F.lit(0.0))
    effects = every.select(
        F.element_at(F.array(*[F.lit(x) for x in groups]), F.col("grp") + 1).alias("grp"),
        F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias("level"), "n", estimate.alias("estimate"), error.alias("est_error"),
        pick(np.sqrt(between)).alias("group_sd"), F.lit(math.sqrt(within)).alias("residual_sd"),
        (estimate - F.lit(Z_95) * error).alias("q2_5"), (estimate + F.lit(Z_95) * error).alias("q97_5"), F.lit(left).alias("residual"),
    )
    return Solution(coef, cov, effects, within, between, g.n, left)


def fit_mixed(frame: DataFrame, formula: Formula, family: str, trials: str | None = None, tolerance: float = TOLERANCE) -> MixedFit:
    """Fit the terms and the varying intercepts of ``formula`` together on a design frame.

    Linear families need one solution. Logit families repeat it on the working response
    until no coefficient moves by more than ``STEP`` standard errors. ``est_error`` of a
    level is its deviation given the other levels and the terms. A level's effect and
    the predictions that use it are on the scale of the linear predictor. An equation
    that isn't solved to ``tolerance``, or a quasi-likelihood that doesn't settle, is an error.
    """
    frame = complete(frame, formula, *([trials] if trials else []))
    if family in LINEAR:
        check_support(frame, formula, family)
        s = solve_mixed(frame, formula, fitted_response(formula, family), tolerance=tolerance)
        fixed = Fit(formula, family, s.coef, s.cov, math.sqrt(s.within), s.n)
        return MixedFit(fixed, pin(s.effects), dict(zip(formula.group_names, np.sqrt(s.between).tolist())), s.residual)
    start = fit(frame, formula, family, trials)
    size = F.lit(1.0) if trials is None else F.col(f"`{trials}`").cast("double")
    kept = [*dict.fromkeys([formula.response, *formula.terms, *formula.group_names, *([trials] if trials else [])])]
    data = frame.select(*[F.col(f"`{c}`") for c in kept]).persist(StorageLevel.MEMORY_AND_DISK)
    # In a beta fit the residual variance is estimated along; else it is one.
    dispersion = None if family == "beta" else 1.0
    coef, effects, sizes, moved, waited = start.coef, None, {}, np.inf, 0
    try:
        while True:
            eta = linear_predictor(formula.terms, [float(b) for b in coef])
            staged, offset = data, F.lit(0.0)
            for i, g in enumerate(formula.group_names if effects is not None else []):
                own = effects.where(F.col("grp") == g).select(
                    F.coalesce(F.concat(F.lit("="), F.col("level")), F.lit("")).alias(f"__k{i}"), F.col("estimate").alias(f"__u{i}")
                )
                # Else every step would shuffle all rows, once a factor.
                own = F.broadcast(own) if sizes[g]["bytes"] <= BROADCAST_BYTES else own
                staged = staged.withColumn(f"__k{i}", key_of(g)).join(own, f"__k{i}", "left")
                offset = offset + F.coalesce(F.col(f"__u{i}"), F.lit(0.0))
            mu = inverse_logit(F.col("__eta"))
            spread = mu * (1 - mu)
            y = F.col(f"`{formula.response}`").cast("double")
            working = staged.withColumn("__eta", eta + offset).withColumn("__y", F.col("__eta") + (y - mu) / spread).withColumn("__w", spread * size)
            # Kept, since each solution reads it three times.
            working = working.select(*[F.col(f"`{c}`") for c in kept], "__y", "__w").persist(StorageLevel.MEMORY_AND_DISK)
            s = solve_mixed(working, formula, F.col("__y"), F.col("__w"), dispersion, tolerance)
            effects = pin(s.effects)
            sizes = factors_of(effects)
            working.unpersist()
            step = float(np.max(np.abs(s.coef - coef) / np.sqrt(np.diag(s.cov))))
            coef = s.coef
            if step <= STEP:
                break
            waited = 0 if step < moved else waited + 1
            moved = min(moved, step)
            if waited >= PATIENCE or not math.isfinite(step):
                raise RuntimeError(f"the {family} fit doesn't settle; its last step is {step:.3g} standard errors")
    finally:
        data.unpersist()
    scale = precision_of(s.within) if family == "beta" else 1.0
    return MixedFit(Fit(formula, family, s.coef, s.cov, scale, s.n), effects, dict(zip(formula.group_names, np.sqrt(s.between).tolist())), s.residual)


def fit_zero_one(frame: DataFrame, formula: Formula, tolerance: float = TOLERANCE) -> tuple[ZeroOneFit, DataFrame]:
    """Zero-one-inflated beta with its level effects: the boundary mass, and a mixed beta fit of the interior."""
    mass = boundary_mass(frame, formula.response).first()
    y = F.col(formula.response)
    inner = fit_mixed(frame.where((y > 0) & (y < 1)), formula, "beta", tolerance=tolerance)
    return ZeroOneFit(mass["zoi"], mass["coi"], inner.fixed), inner.effects


def kfold_points(frame: DataFrame, formula: Formula, family: str, fold: Column, k: int = 10, tolerance: float = TOLERANCE) -> DataFrame:
    """Out-of-sample log density per row with the grouping factors in every fit: ``(row_id, fold, elpd)``.

    Linear families read the frame once for all folds: sums per fold and combination of
    levels. A fit without a fold merges the sums of the others, shrinks their levels and
    solves for the terms. A held-out row's deviation holds that of its levels, which is the
    factor's own for a level that no other fold has. Logit families fit once a fold, and
    take the levels at their estimates, an unseen one at zero.
    """
    frame = complete(frame, formula).withColumn("__fold", fold)
    check_support(frame, formula, family)
    groups, linear = formula.group_names, family in LINEAR
    y = fitted_response(formula, family)
    solutions: dict[int, tuple[np.ndarray, float, dict[str, float]]] = {}
    effects: list[DataFrame] = []
    if linear:
        grams = gram_by(frame, formula.terms, y, group=F.col("__fold"))
        shared = next(iter(grams.values()))
        cells = cell_sums(frame, groups, _centred(formula, shared, y), F.lit(1.0), F.col("__fold"))
        for f in sorted(grams):
            others = reduce(Gram.__add__, [g for other, g in grams.items() if other != f])
            s = _solve(others, levels_of(cells.where(F.col("__fold") != f), groups, len(formula.terms) + 2), None, tolerance)
            solutions[f] = s.coef, math.sqrt(s.within), dict(zip(groups, np.sqrt(s.between).tolist()))
            effects.append(s.effects.select(F.lit(f).alias("__fold"), "grp", "level", "estimate", "est_error"))
    else:
        for f in range(k):
            fitted = fit_mixed(frame.where(F.col("__fold") != f).drop("__fold"), formula, family, tolerance=tolerance)
            solutions[f] = fitted.fixed.coef, fitted.fixed.scale, fitted.group_sd
            effects.append(fitted.effects.select(F.lit(f).alias("__fold"), "grp", "level", "estimate", "est_error"))
    every = pin(reduce(DataFrame.unionByName, effects))

    def by_fold(value) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for f, s in solutions.items() for x in (int(f), float(value(s)))]), F.col("__fold"))

    staged, offset, spread = frame, F.lit(0.0), F.lit(0.0)
    for i, g in enumerate(groups):
        own = every.where(F.col("grp") == g).select("__fold", F.col("level").alias("__level"), F.col("estimate").alias(f"__m{i}"), F.col("est_error").alias(f"__e{i}"))
        staged = match_join(staged.withColumn("__level", F.col(f"`{g}`").cast("string")), own, ["__fold", "__level"], "left").drop("__level")
        offset = offset + F.coalesce(f"__m{i}", F.lit(0.0))
        error = F.coalesce(f"__e{i}", by_fold(lambda s, g=g: s[2][g]))
        spread = spread + error * error
    eta = offset + linear_predictor(formula.terms, [by_fold(lambda s, j=j: s[0][j]) for j in range(len(formula.terms) + 1)])
    scale, response = by_fold(lambda s: s[1]), F.col(f"`{formula.response}`").cast("double")
    if linear:
        density = normal_log_density(y, eta, F.sqrt(scale * scale + spread))
        density = density - F.ln(response) if family == "lognormal" else density
    elif family == "beta":
        density = beta_log_density(response, inverse_logit(eta), scale)
    else:
        density = bernoulli_log_density(response, inverse_logit(eta))
    return staged.select("row_id", F.col("__fold").alias("fold"), density.alias("elpd"))


def vif_rows(model: Fit) -> list[tuple[str, float]]:
    """(term, variance inflation) under the covariance of a fit, so with the weights that its levels give; one row a term."""
    cov = model.cov[1:, 1:]
    size = np.sqrt(np.diag(cov))
    return list(zip(model.formula.terms, np.diag(np.linalg.inv(cov / np.outer(size, size))).tolist()))
