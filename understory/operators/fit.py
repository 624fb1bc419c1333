"""Regression by distributed aggregates: gaussian, lognormal, bernoulli, beta families.

The estimates are least-squares or quasi-likelihood ones with a normal
approximation around them. They answer the same question as a sampled posterior
but are not equal to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from understory.functions.links import (
    digamma_array,
    inverse_logit,
    log_gamma_array,
    lognormal_mean,
    trigamma_array,
)
from understory.functions.noise import normal_column
from understory.functions.nulls import nan_to_null
from understory.operators.design import Formula
from understory.operators.gram import Gram, batch_sums, collect_vectors, gram, gram_by, to_matrix

LINEAR = ("gaussian", "lognormal")
LOGIT = ("bernoulli", "binomial", "beta")
FAMILIES = (*LINEAR, *LOGIT)
#: Steps after which an iteration that hasn't converged is an error.
MAX_STEPS = 50


@dataclass(frozen=True)
class Fit:
    """Coefficients, their covariance, and the spread parameter of the family.

    ``scale`` is the residual deviation for the linear families, the precision
    for beta, and one for bernoulli.
    """

    formula: Formula
    family: str
    coef: np.ndarray
    cov: np.ndarray
    scale: float
    n: int

    @property
    def term_names(self) -> list[str]:
        return ["b_Intercept", *[f"b_{t}" for t in self.formula.terms]]

    def terms(self, spark: SparkSession) -> DataFrame:
        """One row per term: position, estimate and standard error."""
        rows = [
            (i + 1, name, float(self.coef[i]), float(math.sqrt(self.cov[i, i])))
            for i, name in enumerate(self.term_names)
        ]
        return spark.createDataFrame(rows, "pos int, terms string, estimate double, std_error double")

    def eta(self) -> Column:
        """Linear predictor."""
        return linear_predictor(self.formula.terms, [float(b) for b in self.coef])

    def mean(self) -> Column:
        """Expected response."""
        if self.family == "gaussian":
            return self.eta()
        if self.family == "lognormal":
            return lognormal_mean(self.eta(), self.scale)
        return inverse_logit(self.eta())


def linear_predictor(terms: list[str], coef: list) -> Column:
    total = coef[0] if isinstance(coef[0], Column) else F.lit(coef[0])
    for name, b in zip(terms, coef[1:]):
        total = total + F.col(f"`{name}`") * b
    return total


def fitted_response(formula: Formula, family: str) -> Column:
    y = F.col(formula.response).cast("double")
    return F.ln(y) if family == "lognormal" else y


def solve(g: Gram) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, covariance and residual deviation from cross-products."""
    if g.n <= len(g.xy):
        raise ValueError(f"{g.n} complete rows leave no degree of freedom for {len(g.xy)} coefficients")
    coef, residual = g.coefficients()
    variance = residual / (g.n - len(coef))
    return coef, g.inverse() * variance, math.sqrt(variance)


def complete(frame: DataFrame, formula: Formula, *more: str) -> DataFrame:
    """Rows with a value of the response and of every term."""
    known = [nan_to_null(F.col(f"`{c}`")).isNotNull() for c in (formula.response, *formula.terms, *more)]
    return frame.where(reduce(lambda a, b: a & b, known))


def outside_support(formula: Formula, family: str) -> tuple[Column | None, str]:
    """Whether a response has no density in the family (nothing if all have), and how to complain of it."""
    y = F.col(formula.response).cast("double")
    outside = {
        "lognormal": ~(y > 0), "bernoulli": ~y.isin(0.0, 1.0), "binomial": ~y.between(0.0, 1.0), "beta": ~((y > 0) & (y < 1)),
    }.get(family)
    return outside, f"responses of {formula.response} are outside the support of {family}"


def _forbidden(formula: Formula, family: str) -> dict:
    """What a pass over cross-products needs to refuse known responses outside the support."""
    outside, complaint = outside_support(formula, family)
    if outside is None:
        return {}
    return {"forbidden": outside & nan_to_null(formula.response).isNotNull(), "complaint": complaint}


def check_support(frame: DataFrame, formula: Formula, family: str) -> None:
    """Raises if a response has no density in the family."""
    outside, complaint = outside_support(formula, family)
    if outside is not None:
        count = frame.where(outside).count()
        if count:
            raise ValueError(f"{count} {complaint}")


def fit(frame: DataFrame, formula: Formula, family: str, trials: str | None = None) -> Fit:
    """Fit the fixed terms of ``formula`` on a design frame.

    Linear families read the frame once. The others iterate over the frame, which
    is kept for the time of the fit. ``trials`` names a column of binomial
    denominators when the response is a share of successes.
    """
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}")
    terms = formula.terms
    y = fitted_response(formula, family)
    if family in LINEAR:
        if trials:
            frame = frame.where(nan_to_null(trials).isNotNull())
        g = gram(frame, terms, y, **_forbidden(formula, family))
        coef, cov, scale = solve(g)
        return Fit(formula, family, coef, cov, scale, g.n)
    frame = complete(frame, formula, *([trials] if trials else []))
    check_support(frame, formula, family)
    columns = [F.col(f"`{t}`").cast("double").alias(f"x{i}") for i, t in enumerate(terms)]
    weight = F.lit(1.0) if trials is None else F.col(trials).cast("double")
    names = [f"x{i}" for i in range(len(terms))]
    table = frame.select(y.alias("label"), weight.alias("weight"), *columns)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(table)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = GeneralizedLinearRegression(
            family="binomial", link="logit", weightCol="weight", maxIter=MAX_STEPS, tol=1e-10
        ).fit(data)
        if model.summary.numIterations >= MAX_STEPS:
            raise RuntimeError(f"the {family} fit did not converge in {MAX_STEPS} steps")
        coef = np.append(model.intercept, model.coefficients.toArray())
        mu = inverse_logit(linear_predictor(names, [float(b) for b in coef]))
        spread = mu * (1 - mu)
        # With this weight the response product of the Gram is Pearson's statistic.
        pearson = (F.col("label") - mu) / spread
        g = gram(data, names, pearson, F.col("weight") * spread, centre_response=False)
    finally:
        data.unpersist()
    cov = g.inverse()
    if family != "beta":
        return Fit(formula, family, coef, cov, 1.0, g.n)
    dispersion = g.yy / (g.n - len(coef))
    return Fit(formula, family, coef, cov * dispersion, precision_of(dispersion), g.n)


def precision_of(dispersion: float) -> float:
    """Precision of a beta response whose Pearson residuals have this variance."""
    if not 0 < dispersion < 1:
        raise ValueError(f"a dispersion of {dispersion:.4g} fits no beta distribution")
    return 1.0 / dispersion - 1.0


def fit_beta(frame: DataFrame, formula: Formula) -> Fit:
    """Coefficients and precision of a beta response by maximum likelihood.

    Fisher scoring of both together, from the quasi-likelihood fit on: every step is one pass in
    which tasks add up the score and the information, the precision on the scale of its
    logarithm. The moment estimate of ``fit`` weighs rows by their Pearson residual, whose
    spread small precisions bias; this one doesn't.
    """
    start = fit(frame, formula, "beta")
    p = len(start.coef)
    names = [f"x{i}" for i in range(p - 1)]
    data = (
        complete(frame, formula)
        .select(F.col(formula.response).cast("double").alias("y"), *[F.col(f"`{t}`").cast("double").alias(n) for t, n in zip(formula.terms, names)])
        .persist(StorageLevel.MEMORY_AND_DISK)
    )

    def scored(beta: np.ndarray, log_precision: float) -> tuple[np.ndarray, np.ndarray]:
        phi = math.exp(log_precision)

        def part(batch):
            table = to_matrix(batch, ["y", *names])
            y, x = table[:, 0], np.column_stack([np.ones(len(table)), table[:, 1:]])
            mu = 1.0 / (1.0 + np.exp(-x @ beta))
            a, b, slope = mu * phi, (1.0 - mu) * phi, mu * (1.0 - mu)
            gap = np.log(y) - np.log1p(-y) - digamma_array(a) + digamma_array(b)
            ta, tb = trigamma_array(a), trigamma_array(b)
            of_phi = mu * gap + np.log1p(-y) - digamma_array(b) + digamma_array(np.array(phi))
            score = np.append(phi * (x.T @ (gap * slope)), phi * of_phi.sum())
            information = np.zeros((p + 1, p + 1))
            information[:p, :p] = phi**2 * (x.T @ (x * ((ta + tb) * slope**2)[:, None]))
            information[:p, p] = information[p, :p] = phi**2 * (x.T @ (slope * (ta * mu - tb * (1.0 - mu))))
            information[p, p] = phi**2 * (ta * mu**2 + tb * (1.0 - mu) ** 2 - trigamma_array(np.array(phi))).sum()
            yield 0, np.append(score, information.ravel())

        sums = collect_vectors(batch_sums(data, part), (p + 1) * (p + 2))[0]
        return sums[: p + 1], sums[p + 1 :].reshape(p + 1, p + 1)

    at = np.append(start.coef, math.log(start.scale))
    try:
        for _ in range(MAX_STEPS):
            score, information = scored(at[:p], at[p])
            cov = np.linalg.inv(information)
            step = cov @ score
            at = at + step
            if np.max(np.abs(step) / np.sqrt(np.diag(cov))) < 1e-8:
                break
        else:
            raise RuntimeError(f"the beta likelihood did not converge in {MAX_STEPS} steps")
    finally:
        data.unpersist()
    return Fit(formula, "beta", at[:p], cov[:p, :p], math.exp(at[p]), start.n)


@dataclass(frozen=True)
class ZeroOneFit:
    """Share of rows at zero or one, share of ones among those, and the interior fit."""

    zoi: float
    coi: float | None
    interior: Fit


def boundary_mass(df: DataFrame, response: str) -> DataFrame:
    """``zoi``: share of responses equal to 0 or 1; ``coi``: share of ones among them."""
    y = F.col(response)
    edge = (y == 0) | (y == 1)
    return df.where(y.isNotNull()).agg(
        F.avg(edge.cast("double")).alias("zoi"),
        F.avg(F.when(edge, (y == 1).cast("double"))).alias("coi"),
    )


def fit_zero_one(frame: DataFrame, formula: Formula) -> ZeroOneFit:
    """Zero-one-inflated beta: the boundary mass, and a beta fit of the interior."""
    mass = boundary_mass(frame, formula.response).first()
    y = F.col(formula.response)
    inside = frame.where((y > 0) & (y < 1))
    return ZeroOneFit(mass["zoi"], mass["coi"], fit(inside, formula, "beta"))


def fixed_effect_draws(spark: SparkSession, model: Fit, n: int = 8000, chains: int = 4, seed: int = 1) -> DataFrame:
    """Wide draws from the normal approximation around a fit.

    Each standard normal is a function of draw number, term and seed alone, so
    the table does not depend on how it is partitioned.
    """
    # Scaled first, so that no term is too small for the decomposition.
    size = np.sqrt(np.diag(model.cov))
    root = np.linalg.cholesky(model.cov / np.outer(size, size)) * size[:, None]
    z = [normal_column(F.lit(k + 1), F.col("draw"), seed) for k in range(len(model.coef))]
    per_chain = -(-n // chains)
    base = spark.range(1, n + 1).select(
        F.floor((F.col("id") - 1) / per_chain + 1).cast("int").alias("chain"),
        (F.pmod(F.col("id") - 1, F.lit(per_chain)) + 1).cast("int").alias("iteration"),
        F.col("id").cast("int").alias("draw"),
    )
    normals = base.select("*", *[c.alias(f"z{k}") for k, c in enumerate(z)])
    terms = []
    for i, name in enumerate(model.term_names):
        value = F.lit(float(model.coef[i]))
        for j in range(i + 1):
            value = value + F.col(f"z{j}") * float(root[i, j])
        terms.append(value.alias(name))
    return normals.select("chain", "iteration", "draw", *terms)


def fold_number(k: int = 10, seed: int = 1, row_id: str = "row_id") -> Column:
    """Fold of a row as a hash of its identity."""
    return F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(k)).cast("int")


BLOCK_SCHEMA = "bad long, block binary"


def _blocks(frame: DataFrame, formula: Formula, family: str) -> DataFrame:
    """Complete rows as matrices of fold (minus one if missing), response and terms, one per Arrow batch.

    ``bad`` counts the rows whose response has no density in the family.
    """
    outside, _ = outside_support(formula, family)
    columns = _term_columns(formula)
    names = ["fold", "y", *columns]

    def run(batches):
        for batch in batches:
            table = to_matrix(batch, names)
            known = ~np.isnan(table[:, 1:]).any(1)
            bad = known & batch.column("bad").to_numpy(zero_copy_only=False)
            table = table[known]
            table[np.isnan(table[:, 0]), 0] = -1
            if len(table):
                yield pa.RecordBatch.from_arrays([pa.array([int(bad.sum())]), pa.array([table.tobytes()], pa.binary())], ["bad", "block"])

    data = frame.select("fold", *_response_and_terms(formula), F.coalesce(outside, F.lit(False)).alias("bad"))
    return data.mapInArrow(run, BLOCK_SCHEMA)


def _term_columns(formula: Formula) -> list[str]:
    return [f"x{i}" for i in range(len(formula.terms))]


def _response_and_terms(formula: Formula) -> list[Column]:
    terms = [F.col(f"`{t}`").cast("double").alias(n) for t, n in zip(formula.terms, _term_columns(formula))]
    return [F.col(formula.response).cast("double").alias("y"), *terms]


def _block_sums(data: DataFrame, width: int, size: int, part) -> dict[int, np.ndarray]:
    """Totals over all blocks of the vectors that ``part`` yields for one, by group."""

    def of_batch(batch):
        for block in batch.column("block"):
            yield from part(np.frombuffer(block.as_buffer(), dtype=float).reshape(-1, width))

    return collect_vectors(batch_sums(data.select("block"), of_batch), size)


def _scales(data: DataFrame, formula: Formula, family: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every term, for steps that keep their digits; raises for responses outside the support."""
    width = len(formula.terms) + 2

    def run(batches):
        bad, n, mean, squares, low, high = 0, 0, 0.0, 0.0, np.inf, -np.inf
        for batch in batches:
            bad += sum(batch.column("bad").to_pylist())
            for block in batch.column("block"):
                x = np.frombuffer(block.as_buffer(), dtype=float).reshape(-1, width)[:, 2:]
                own, total = x.mean(0), n + len(x)
                squares = squares + ((x - own) ** 2).sum(0) + (own - mean) ** 2 * (n * len(x) / total)
                mean = mean + (own - mean) * (len(x) / total)
                low, high, n = np.minimum(low, x.min(0)), np.maximum(high, x.max(0)), total
        if n:
            sums = np.concatenate([[bad, n], mean, squares, low, high])
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["sums"])

    rows = [np.array(r["sums"]) for r in data.mapInArrow(run, "sums array<double>").collect()]
    if not rows:
        raise ValueError("no complete rows")
    bad, n = sum(r[0] for r in rows), sum(r[1] for r in rows)
    if bad:
        raise ValueError(f"{int(bad)} {outside_support(formula, family)[1]}")
    means, squares, low, high = np.array([r[2:].reshape(4, -1) for r in rows]).swapaxes(0, 1)
    counts = np.array([r[1] for r in rows])[:, None]
    mean = (means * counts).sum(0) / n
    p = width - 1
    if n <= p or not np.all(low.min(0) < high.max(0)):
        raise ValueError(f"{int(n)} complete rows cannot determine {p} coefficients, or a column is constant")
    return mean, np.sqrt((squares + counts * (means - mean) ** 2).sum(0) / n)


def _leave_out_logit(frame: DataFrame, formula: Formula, family: str, k: int) -> dict[int, list[float]]:
    """Parameters of the k fits that each leave one fold out, all in the same passes.

    Rows are read once into blocks. Newton steps first find the fit of all rows, with sums by fold:
    the last of them also give the first step of every other fit, as sums of all folds but one.
    Each later pass advances every fit, since each task adds a row to the sums of the k - 1 fits it belongs to.
    """
    p = len(formula.terms) + 1
    size = p * p + p + 2
    data = _blocks(frame, formula, family).persist(StorageLevel.MEMORY_AND_DISK)

    def split(table):
        x = np.column_stack([np.ones(len(table)), (table[:, 2:] - mean) / deviation])
        return table[:, 0].astype(int), table[:, 1], x

    def together(at: np.ndarray | None):
        """Sums by fold where all fits are at one place; without a place those of the first least squares."""

        def part(table):
            fold, y, x = split(table)
            if at is None:
                mu = (y + 0.5) / 2
                error = np.log(mu / (1.0 - mu)) * mu * (1.0 - mu) + y - mu
            else:
                mu = 1.0 / (1.0 + np.exp(-x @ at))
                error = y - mu
            spread = mu * (1.0 - mu)
            for f in np.unique(fold):
                own = fold == f
                z = x[own]
                tail = [np.sum(error[own] ** 2 / spread[own]), len(z)]
                yield int(f), np.concatenate([(z.T @ (z * spread[own, None])).ravel(), z.T @ error[own], tail])

        return _block_sums(data, p + 1, size, part)

    def apart(places: np.ndarray):
        """Sums of every fit at its own place."""

        def part(table):
            fold, y, x = split(table)
            mu = 1.0 / (1.0 + np.exp(-x @ places))
            belongs = fold[:, None] != np.arange(k)
            spread, error = mu * (1.0 - mu), y[:, None] - mu
            tails = np.stack([np.where(belongs, error**2 / spread, 0.0).sum(0), belongs.sum(0)])
            spread, score = spread * belongs, x.T @ (error * belongs)
            for f in range(k):
                yield f, np.concatenate([(x.T @ (x * spread[:, f, None])).ravel(), score[:, f], tails[:, f]])

        return _block_sums(data, p + 1, size, part)

    def step(sums: np.ndarray) -> np.ndarray:
        return np.linalg.solve(sums[: p * p].reshape(p, p), sums[p * p : p * p + p])

    def precision(sums: np.ndarray) -> float:
        return precision_of(sums[-2] / (sums[-1] - p)) if family == "beta" else 1.0

    failed = RuntimeError(f"the {family} fits did not converge in {MAX_STEPS} steps")
    try:
        mean, deviation = _scales(data, formula, family)
        at = step(sum(together(None).values()))
        for _ in range(MAX_STEPS):
            folds = together(at)
            whole = sum(folds.values())
            moved = step(whole)
            if np.abs(moved).max() < 1e-6:
                break
            at = at + moved
        else:
            raise failed
        precision(whole)
        places = np.column_stack([at + step(sum((v for g, v in folds.items() if g != f), np.zeros(size))) for f in range(k)])
        for _ in range(MAX_STEPS):
            found = apart(places)
            steps = np.column_stack([step(found[f]) for f in range(k)])
            places = places + steps
            if np.abs(steps).max() < 1e-8:
                break
        else:
            raise failed
    finally:
        data.unpersist()
    slopes = places[1:] / deviation[:, None]
    intercepts = places[0] - mean @ slopes
    return {f: [intercepts[f], *slopes[:, f], precision(found[f])] for f in range(k)}


def _log(x: np.ndarray) -> np.ndarray:
    """Natural logarithm, missing where the argument is not positive."""
    return np.log(np.where(x > 0, x, np.nan))


def _log_density(family: str, y: np.ndarray, eta: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Log density of each response, as the column expressions of ``links`` have it."""
    if family in LINEAR:
        value = _log(y) if family == "lognormal" else y
        density = -0.5 * math.log(2 * math.pi) - _log(scale) - ((value - eta) / scale) ** 2 / 2
        return density - value if family == "lognormal" else density
    mean = 1.0 / (1.0 + np.exp(-eta))
    if family != "beta":
        return np.where(y == 1, _log(mean), _log(1.0 - mean))
    a, b = mean * scale, (1.0 - mean) * scale
    gammas = [log_gamma_array(np.where(x > 0, x, np.nan)) for x in (scale, a, b)]
    return gammas[0] - gammas[1] - gammas[2] + (a - 1) * _log(y) + (b - 1) * _log(1.0 - y)


def _held_out_density(frame: DataFrame, formula: Formula, family: str, k: int, parameters: dict[int, list[float]]) -> DataFrame:
    """``(row_id, fold, elpd)`` of the complete rows, each by the parameters of its fold.

    Taken by batch: as columns, the parameters of all folds make a method too large for the JIT.
    """
    names = _term_columns(formula)
    table = np.zeros((k + 1, len(names) + 2))
    table[k] = np.nan  # of rows without a fold
    for f, values in parameters.items():
        table[f] = values
    if family in LINEAR and any(v[-1] == 0 for v in parameters.values()):
        raise ValueError(f"a {family} fit without residuals has no density")
    data = frame.select("row_id", "fold", *_response_and_terms(formula))

    def run(batches):
        for batch in batches:
            numbers = to_matrix(batch, ["fold", "y", *names])
            known = ~np.isnan(numbers[:, 1:]).any(1)
            if not known.all():
                batch, numbers = batch.filter(pa.array(known)), numbers[known]
            fold = np.where(np.isnan(numbers[:, 0]), k, numbers[:, 0]).astype(int)
            eta = table[fold, 0]
            with np.errstate(over="ignore"):
                for i in range(len(names)):
                    eta = eta + numbers[:, i + 2] * table[fold, i + 1]
                density = _log_density(family, numbers[:, 1], eta, table[fold, -1])
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("fold"), pa.array(density, from_pandas=True)], ["row_id", "fold", "elpd"])

    kept = [data.schema["row_id"], data.schema["fold"], T.StructField("elpd", T.DoubleType())]
    return data.mapInArrow(run, T.StructType(kept))


def kfold_points(
    frame: DataFrame, formula: Formula, family: str, fold: Column, k: int = 10
) -> DataFrame:
    """Out-of-sample log density per row: ``(row_id, fold, elpd)``.

    For linear families one pass gives the cross-products of every fold; those of
    all folds but one are added up, as a difference would lose digits. Rows with a
    missing value take no part.
    """
    frame = frame.withColumn("fold", fold)
    if family in LINEAR:
        grams = gram_by(frame, formula.terms, fitted_response(formula, family), group=F.col("fold"), **_forbidden(formula, family))
        fits = {f: solve(reduce(Gram.__add__, [g for other, g in grams.items() if other != f])) for f in grams}
        parameters = {f: [*coef, scale] for f, (coef, _, scale) in fits.items()}
    else:
        parameters = _leave_out_logit(frame, formula, family, k)
    return _held_out_density(frame, formula, family, k, parameters)
