"""Operators that meet every row with every draw, without making rows of the pairs.

The draws go to the tasks as one matrix; their number is a setting of the analysis
and doesn't grow with the data. Rows are taken in chunks whose size follows from the
number of draws. Simulated outcomes depend on row, draw and seed only.

Level effects of a fitted model join the rows by level, as an estimate and its error. Their
draws are made inside the task, by a generator keyed by level, draw and seed, so all rows of a
level share them and no row of a level and a draw ever exists. A level that was never
seen is drawn around zero by the deviation of its factor.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from understory.functions.links import log_gamma_array, log_gamma_sum
from understory.functions.noise import BLOCK_VALUES, FULL, LEVEL, mix_column, normals, row_key, salt, text_key, uniforms
from understory.functions.nulls import match_join
from understory.operators.fit import Fit, ZeroOneFit, complete
from understory.operators.gram import batch_sums, to_matrix
from understory.session import pin

#: Largest matrix of draws, in bytes; a larger one is refused.
DRAW_LIMIT_BYTES = 512 << 20
#: Values of one row-by-draw matrix in a task, and of all of them together that are worth a task.
CHUNK_VALUES, TASK_VALUES = 1 << 17, 1 << 27
#: Levels of a factor in a batch up to which their draws are held.
HELD_LEVELS = 256
#: Draws from which on rows are ordered by a factor with more levels, so that a level is drawn once for its rows.
ORDER_DRAWS = 1000
#: Tasks for every core beyond which more of them don't help.
TASKS_PER_SLOT = 4
#: Rows that a task sorts in memory.
TASK_ROWS = 1 << 18
#: Rows of a partition, as a multiple of an even share, beyond which all rows are dealt anew.
UNEVEN = 1.5
#: Bytes of a factor's levels up to which its effects are broadcast.
BROADCAST_BYTES = 32 << 20
SUMMARY = ("estimate", "est_error", "q2_5", "q97_5")


@dataclass(frozen=True)
class Response:
    """What a model says of its response, given the linear predictor."""

    family: str
    scale: float
    zoi: float = 0.0
    coi: float = 0.0

    def expected(self, eta: np.ndarray) -> np.ndarray:
        """Of a linear predictor, which is overwritten."""
        if self.family == "gaussian":
            return eta
        if self.family == "lognormal":
            eta += self.scale * self.scale / 2.0
            return np.exp(eta, out=eta)
        np.negative(eta, out=eta)
        np.exp(eta, out=eta)
        eta += 1.0
        np.reciprocal(eta, out=eta)
        if self.zoi:
            eta *= 1.0 - self.zoi
            eta += self.zoi * self.coi
        return eta

    def simulated(self, eta: np.ndarray, keys: np.ndarray, draws: np.ndarray, seed: int, trials: np.ndarray) -> np.ndarray:
        """One outcome for every row and draw."""
        if self.family in ("gaussian", "lognormal"):
            y = normals(keys, draws, seed)
            y *= self.scale
            y += eta
            return np.exp(y, out=y) if self.family == "lognormal" else y
        if self.family == "bernoulli":
            return self.happened(eta, keys, draws, seed).astype(float)
        y = np.empty_like(eta)
        mu, a, b = np.empty((3, eta.shape[1]))
        source = np.random.Philox(key=[seed, 0])
        rng, state = np.random.Generator(source), source.state
        # No closed form: a generator for every row, keyed by the row, over all draws in their order. Its numbers stay in a core's cache.
        for i, key in enumerate(keys):
            state["state"]["key"][:] = np.asarray([seed, int(key) & FULL]).astype(np.uint64)  # as ``Philox(key=...)`` reads it
            source.state = state
            np.negative(eta[i], out=mu)
            np.exp(mu, out=mu)
            mu += 1.0
            np.reciprocal(mu, out=mu)
            if self.family == "binomial":
                np.divide(rng.binomial(int(trials[i]), mu), trials[i], out=y[i])
                continue
            np.multiply(mu, self.scale, out=a)
            np.subtract(1.0, mu, out=b)
            b *= self.scale
            if a.min() > 0 and b.min() > 0:
                y[i] = rng.beta(a, b)
            else:
                inner = (a > 0) & (b > 0)
                y[i] = np.where(inner, rng.beta(np.where(inner, a, 1.0), np.where(inner, b, 1.0)), mu)
        if self.zoi:
            edge = uniforms(keys, draws, 2, seed) < self.zoi
            y = np.where(edge, uniforms(keys, draws, 3, seed) < self.coi, y)
        return y

    def happened(self, eta: np.ndarray, keys: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
        """Simulated presence for every row and draw, as truth values. The linear predictor is overwritten."""
        mu, out = Response("bernoulli", 1.0).expected(eta), np.empty(eta.shape, bool)
        step = max(1, BLOCK_VALUES // max(1, len(draws)))
        for lo in range(0, len(keys), step):
            span = slice(lo, lo + step)
            np.less(uniforms(keys[span], draws, 0, seed), mu[span], out=out[span])
        return out

    def log_density(self, y: np.ndarray, eta: np.ndarray, trials: np.ndarray) -> np.ndarray:
        """Log density of the observed response ``y`` (a column) for every draw."""
        if self.family in ("gaussian", "lognormal"):
            z = ((np.log(y) if self.family == "lognormal" else y) - eta) / self.scale
            density = -0.5 * z * z - math.log(self.scale) - 0.5 * math.log(2.0 * math.pi)
            return density - np.log(y) if self.family == "lognormal" else density
        if self.family == "beta":
            return self._beta_density(y, eta)
        # ln(mu) and ln(1 - mu) without loss where mu is next to 0 or 1.
        yes, no = -np.logaddexp(0.0, -eta), -np.logaddexp(0.0, eta)
        if self.family == "bernoulli":
            return np.where(y == 1, yes, no)
        n = trials[:, None]
        k = np.rint(n * y)
        choose = log_gamma_array(n + 1.0) - log_gamma_array(k + 1.0) - log_gamma_array(n - k + 1.0)
        return choose + k * yes + (n - k) * no

    def _beta_density(self, y: np.ndarray, eta: np.ndarray) -> np.ndarray:
        inner = (y > 0) & (y < 1)
        at = np.where(inner, y, 0.5)
        of_yes, of_no = np.log(at), np.log1p(-at)
        whole = float(log_gamma_array(np.array(self.scale)))
        density = np.empty_like(eta)
        step = max(1, BLOCK_VALUES // max(1, eta.shape[1]))
        for lo in range(0, len(eta), step):
            span = slice(lo, lo + step)
            # The larger and the smaller of the two parameters, without loss where the mean is next to 0 or 1.
            small = np.exp(-np.abs(eta[span]))
            large = self.scale / (1.0 + small)
            small *= large
            up = eta[span] >= 0
            a, b = np.where(up, large, small), np.where(up, small, large)
            out = density[span]
            np.subtract(whole, log_gamma_sum(large, small), out=out)
            a -= 1.0
            a *= of_yes[span]
            out += a
            b -= 1.0
            b *= of_no[span]
            out += b
        if not self.zoi:
            return density if inner.all() else np.where(inner, density, -np.inf)
        with np.errstate(divide="ignore"):
            edge = np.log(self.zoi) + np.where(y == 1, np.log(self.coi), np.log1p(-self.coi))
            return np.where(inner, np.log1p(-self.zoi) + density, edge)


def _parts(model: Fit | ZeroOneFit) -> tuple[Fit, Response]:
    if isinstance(model, ZeroOneFit):
        return model.interior, Response("beta", model.interior.scale, model.zoi, model.coi or 0.0)
    return model, Response(model.family, model.scale)


def draw_matrix(draws: DataFrame, model: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Draw numbers and draws as a (draw, term) matrix at the driver, for a checked size only."""
    if draws.count() * len(model.coef) * 8 > DRAW_LIMIT_BYTES:
        raise ValueError("too many draws to hand to every task; thin them")
    quoted = [F.col(f"`{t}`").cast("double").alias(f"b{i}") for i, t in enumerate(model.term_names)]
    table = draws.select("draw", *quoted).toArrow()
    numbers = table.column("draw").to_numpy()
    order = np.argsort(numbers, kind="stable")
    beta = np.column_stack([table.column(f"b{i}").to_numpy() for i in range(len(quoted))])
    return numbers[order].astype(np.int64), beta[order]


def factors_of(effects: DataFrame) -> dict:
    """Deviation, bytes and number of the levels of every factor."""
    size = F.sum(F.coalesce(F.octet_length("level"), F.lit(0)) + 32)
    found = effects.groupBy("grp").agg(F.max("group_sd").alias("sd"), size.alias("bytes"), F.count(F.lit(1)).alias("levels"))
    return {r["grp"]: r for r in found.collect()}  # one row a factor


def with_level_effects(frame: DataFrame, model: Fit, effects: DataFrame | None) -> DataFrame:
    """``frame`` with ``__key<i>``, ``__mean<i>`` and ``__error<i>`` of every factor's level. Every factor is one equi-join on its levels."""
    if effects is None:
        return frame
    factors = factors_of(effects)
    out = frame
    for i, g in enumerate(model.formula.group_names):
        if g not in factors:
            raise ValueError(f"no effects of {g}")
        levels = effects.where(F.col("grp") == g).select(F.col("level").alias("__level"), F.col("estimate").alias("__m"), F.col("est_error").alias("__e"))
        levels = F.broadcast(levels) if factors[g]["bytes"] <= BROADCAST_BYTES else levels
        level = F.col(f"`{g}`").cast("string")
        out = match_join(out.withColumn("__level", level), levels, ["__level"], "left").withColumns(
            {
                f"__key{i}": text_key(F.concat_ws("|", F.lit(g), "__level")),
                f"__mean{i}": F.coalesce("__m", F.lit(0.0)),
                f"__error{i}": F.coalesce("__e", F.lit(float(factors[g]["sd"] or 0.0))),
            }
        ).drop("__level", "__m", "__e")
    return out


def _rows(frame: DataFrame, model: Fit, effects: DataFrame | None, n_draws: int, keep: list[str], more: dict[str, Column], trials: str | None, key: list[str]) -> DataFrame:
    """Design columns, level effects, key and trials of complete rows, dealt by the work they make.

    A row is small but costs thousands of draws, so partitions that are right by
    size may leave most cores idle, or one may hold most rows and others none. Only then the rows are dealt anew, or if a factor has so many
    levels that its rows had better be side by side: dealt by ranges of level and row, so that
    the rows of a frequent level spread over tasks. They are kept, since their number decides.
    Rows that are ordered are sorted by the task that meets them, so their tasks grow in number with them.
    """
    x = [F.col(f"`{t}`").cast("double").alias(f"__x{i}") for i, t in enumerate(model.formula.terms)]
    held = with_level_effects(frame, model, effects)
    for t in model.formula.terms:
        held = held.where(F.col(f"`{t}`").isNotNull() & ~F.isnan(F.col(f"`{t}`").cast("double")))
    size = F.lit(1.0) if trials is None else F.col(f"`{trials}`").cast("double")
    levels = [f"__{c}{i}" for i in range(len(model.formula.group_names) if effects is not None else 0) for c in ("key", "mean", "error")]
    rows = pin(held.select(*keep, row_key(*key).alias("__key"), size.alias("__trials"), *levels, *[c.alias(n) for n, c in more.items()], *x))
    held = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]  # one number a partition
    tasks = max(1, math.ceil(sum(held) * n_draws / TASK_VALUES))
    slots = rows.sparkSession.sparkContext.defaultParallelism
    wanted = min(math.ceil(tasks / slots), TASKS_PER_SLOT) * slots  # whole rounds
    if effects is not None and n_draws >= ORDER_DRAWS:
        sizes = factors_of(effects)
        count, at = max((sizes[g]["levels"], i) for i, g in enumerate(model.formula.group_names))
        if count > HELD_LEVELS:
            order = [f"__key{at}", "__key"]
            wanted = max(wanted, math.ceil(sum(held) / (TASK_ROWS * slots)) * slots)
            return rows.repartitionByRange(wanted, *order).sortWithinPartitions(*order)
    return rows if max(held, default=0) <= UNEVEN * sum(held) / wanted else rows.repartition(wanted)


def _chunks(batch: pa.RecordBatch, numbers: np.ndarray, beta: np.ndarray, seed: int, extra: list[str] = []):
    """(slice, key, trials, linear predictor, extra columns) of parts of a batch."""
    names = [f"__x{i}" for i in range(beta.shape[1] - 1)]
    factors = sum(c.startswith("__mean") for c in batch.schema.names)
    table = to_matrix(batch, ["__trials", *names, *extra])
    keys = batch.column("__key").to_numpy()
    level_keys = [batch.column(f"__key{i}").to_numpy() for i in range(factors)]
    effects = [to_matrix(batch, [f"__mean{i}", f"__error{i}"]) for i in range(factors)]
    size = max(1, CHUNK_VALUES // max(1, len(beta)))
    # The levels of a factor that has few are drawn once for all parts; of one that has many, those of the part before are at hand.
    known = [_level_draws(at, effect, numbers, seed, {}) if len(np.unique(at)) <= HELD_LEVELS else None for at, effect in zip(level_keys, effects)]
    before: list[dict[int, np.ndarray]] = [{} for _ in known]
    for start in range(0, len(table), size):
        part = slice(start, start + size)
        rows = table[part]
        eta = np.column_stack([np.ones(len(rows)), rows[:, 1 : 1 + len(names)]]) @ beta.T
        for f, (at, effect) in enumerate(zip(level_keys, effects)):
            drawn = known[f]
            if drawn is None:
                drawn = before[f] = _level_draws(at[part], effect[part], numbers, seed, before[f])
            for i, level in enumerate(at[part].tolist()):
                eta[i] += drawn[level]
        yield part, keys[part], rows[:, 0], eta, rows[:, 1 + len(names) :]


def _level_draws(keys: np.ndarray, effects: np.ndarray, numbers: np.ndarray, seed: int, known: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Effects of the levels of some rows over the draws, by the levels' keys; ``known`` ones are taken over."""
    found, first = np.unique(keys, return_index=True)
    out = {k: known.get(k) for k in found.tolist()}
    new = np.array([d is None for d in out.values()])
    if new.any():
        drawn = normals(found[new], numbers, seed, LEVEL)
        drawn *= effects[first[new], 1:]
        drawn += effects[first[new], :1]
        out.update(zip(found[new].tolist(), drawn))
    return out


#: Every how manyth value of a row is looked at for where its tails begin, and how many of those are wanted at least.
SAMPLE_STEP, SAMPLE_LEAST = 32, 32


def _summary(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and (2.5 %, 97.5 %) quantiles of every row.

    Only a row's tails are sorted. Where they begin is told by a part of its values, with a margin of four standard errors;
    where they hold too few values, or some aren't numbers, the whole row is sorted.
    """
    rows, n = y.shape
    if y.dtype == bool:
        return _share_summary(np.count_nonzero(y, axis=1), n)
    mean, spread = y.mean(axis=1), y.std(axis=1, ddof=1)
    at = [(n - 1) * p for p in (0.025, 0.975)]
    (low, low_part), (high, high_part) = ((math.floor(a), a - math.floor(a)) for a in at)
    seen = n // SAMPLE_STEP
    cut = math.ceil(seen * 0.025 + 4.0 * math.sqrt(seen * 0.025) + 1.0)
    middle, half = np.zeros(rows), np.full(rows, np.nan)
    if seen >= SAMPLE_LEAST and n > low + 2:
        sample = np.sort(y[:, ::SAMPLE_STEP], axis=1)
        below, above = sample[:, cut], sample[:, -1 - cut]
        usable = np.isfinite(mean) & np.isfinite(below) & np.isfinite(above)
        middle[usable] = (below[usable] + above[usable]) / 2.0
        half[usable] = (above[usable] - below[usable]) / 2.0
    # Subtraction keeps the order, so these are the lowest and the highest values of a row.
    off = y - middle[:, None]
    outer = np.abs(off, out=off) > half[:, None]
    found, ends = y[outer], np.cumsum(np.count_nonzero(outer, axis=1)).tolist()
    bounds, start = np.empty((2, rows)), 0
    for i, end in enumerate(ends):
        tails, start = found[start:end], end
        tails.sort()
        bottom = int(tails.searchsorted(middle[i]))
        if bottom < low + 2 or len(tails) - bottom < n - high:
            tails = np.sort(y[i])
        j = high - n + len(tails)
        bounds[0, i] = tails[low] + (tails[min(low + 1, n - 1)] - tails[low]) * low_part
        bounds[1, i] = tails[j] + (tails[min(j + 1, len(tails) - 1)] - tails[j]) * high_part
    return mean, spread, bounds


def _share_summary(yes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_summary`` of rows of ``n`` truth values, of which ``yes`` are true: sorted, those are the last ones."""
    bounds = np.empty((2, len(yes)))
    for bound, at in zip(bounds, [(n - 1) * p for p in (0.025, 0.975)]):
        low, part = math.floor(at), at - math.floor(at)
        first, second = low >= n - yes, min(low + 1, n - 1) >= n - yes
        bound[:] = first + (second.astype(float) - first) * part
    return yes / n, np.sqrt(yes * (n - yes) / n / (n - 1.0)), bounds


def predict(
    frame: DataFrame,
    model: Fit | ZeroOneFit,
    draws: DataFrame,
    noise: bool = True,
    keep: tuple[str, ...] = ("row_id",),
    seed: int = 1,
    effects: DataFrame | None = None,
    trials: str | None = None,
    key: tuple[str, ...] | None = None,
) -> DataFrame:
    """Mean, deviation and 95 % bounds over draws for every row with all predictors.

    With ``noise`` the outcome itself is drawn, without it the expected response.
    ``effects`` are level effects as ``model_intercepts`` gives them, ``trials`` the
    denominators of a binomial response, ``key`` the columns that identify a row for
    its noise (``keep`` unless given).
    """
    fitted, response = _parts(model)
    numbers, beta = draw_matrix(draws, fitted)
    shared = frame.sparkSession.sparkContext.broadcast((numbers, beta))
    keep = list(keep)
    rows = _rows(frame, fitted, effects, len(numbers), keep, {}, trials, list(key or keep))

    def run(batches):
        numbers, beta = shared.value
        for batch in batches:
            out = np.empty((4, batch.num_rows))
            for part, keys, sizes, eta, _ in _chunks(batch, numbers, beta, seed):
                if not noise:
                    y = response.expected(eta)
                elif response.family == "bernoulli":
                    y = response.happened(eta, keys, numbers, seed)
                else:
                    y = response.simulated(eta, keys, numbers, seed, sizes)
                out[0, part], out[1, part], out[2:, part] = _summary(y)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c) for c in out]], [*keep, *SUMMARY])

    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(c, T.DoubleType()) for c in SUMMARY])
    return rows.mapInArrow(run, schema)


def residuals(
    frame: DataFrame, model: Fit | ZeroOneFit, draws: DataFrame, keep: tuple[str, ...] = ("row_id",), effects: DataFrame | None = None, seed: int = 1
) -> DataFrame:
    """Observed minus expected response, summarised over draws."""
    y = _parts(model)[0].formula.response
    fitted = predict(frame, model, draws, noise=False, keep=(*dict.fromkeys([*keep, y]),), effects=effects, seed=seed)
    return fitted.select(
        *keep,
        (F.col(y) - F.col("estimate")).alias("estimate"),
        "est_error",
        (F.col(y) - F.col("q97_5")).alias("q2_5"),
        (F.col(y) - F.col("q2_5")).alias("q97_5"),
    )


def mean_residual(frame: DataFrame, model: Fit, name: str = "residual") -> DataFrame:
    """Residual at the point estimate, as a plain column."""
    return frame.withColumn(name, F.col(model.formula.response) - model.mean())


def _linear_sums(batch: pa.RecordBatch, numbers: np.ndarray, beta: np.ndarray, seed: int, centre: float) -> tuple[np.ndarray, ...]:
    """Per draw: sums and squares of the linear predictor less ``centre``, the same of the residual, and rows.

    Such sums need the rows' own sums only: cross-products of the terms, and for each
    combination of levels its rows and sums, so the draws meet combinations instead of rows.
    """
    names = [f"__x{i}" for i in range(beta.shape[1] - 1)]
    factors = sum(c.startswith("__mean") for c in batch.schema.names)
    table = to_matrix(batch, [*names, "__y"])
    x, y = table[:, :-1], table[:, -1] - centre
    n, middle = len(x), x.mean(0) if len(x) else np.zeros(len(names))
    x = x - middle
    slopes, base = beta[:, 1:], beta[:, 0] - centre + beta[:, 1:] @ middle
    total, by_y = n * base + slopes @ x.sum(0), base * y.sum() + slopes @ (x.T @ y)
    squares = n * base**2 + 2.0 * base * (slopes @ x.sum(0)) + np.einsum("ij,ij->i", slopes @ (x.T @ x), slopes)
    if factors and n:
        keys = np.column_stack([batch.column(f"__key{i}").to_numpy() for i in range(factors)])
        combos, first, which = np.unique(keys, axis=0, return_index=True, return_inverse=True)
        which = which.ravel()
        rows = np.bincount(which, minlength=len(combos)).astype(float)
        of_x = np.column_stack([np.bincount(which, x[:, k], len(combos)) for k in range(len(names))]) if names else np.zeros((len(combos), 0))
        of_y = np.bincount(which, y, len(combos))
        step = max(1, CHUNK_VALUES // max(1, len(beta)))
        for lo in range(0, len(combos), step):
            span = slice(lo, lo + step)
            u = np.zeros((len(combos[span]), len(beta)))
            for i in range(factors):
                effect = to_matrix(batch, [f"__mean{i}", f"__error{i}"])[first[span]]
                distinct, level = np.unique(combos[span, i], return_inverse=True)
                u += effect[:, :1] + effect[:, 1:] * normals(distinct, numbers, seed, LEVEL)[level.ravel()]
            fixed = rows[span, None] * base + of_x[span] @ slopes.T
            total += rows[span] @ u
            by_y += of_y[span] @ u
            squares += np.einsum("ij,ij->j", u, 2.0 * fixed + rows[span, None] * u)
    return total, squares, y.sum() - total, y @ y - 2.0 * by_y + squares, np.full(len(beta), float(n))


def bayes_r2(frame: DataFrame, model: Fit | ZeroOneFit, draws: DataFrame, effects: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """Per draw: var(expected) / (var(expected) + var(residual)) over the complete rows. Kept, as a summary reads it more than once."""
    fitted, response = _parts(model)
    numbers, beta = draw_matrix(draws, fitted)
    spark = frame.sparkSession
    shared = spark.sparkContext.broadcast((numbers, beta))
    known = complete(frame, fitted.formula)
    y = F.col(fitted.formula.response).cast("double")
    # Variances do not depend on a shift; this one keeps the squares small.
    centre = known.agg(F.avg(y)).first()[0] or 0.0
    data = _rows(known, fitted, effects, len(numbers), [], {"__y": y}, None, ["row_id"])

    def part(batch):
        numbers, beta = shared.value
        if response.family == "gaussian":
            found = _linear_sums(batch, numbers, beta, seed, centre)
            yield from enumerate(found)
            return
        for _, _, _, eta, more in _chunks(batch, numbers, beta, seed, ["__y"]):
            mu, y = response.expected(eta), more[:, 0] - centre
            mu -= centre
            total, squares = mu.sum(0), np.einsum("ij,ij->j", mu, mu)
            yield from enumerate((total, squares, y.sum() - total, y @ y - 2.0 * (y @ mu) + squares, np.full(len(total), len(y))))

    sums = batch_sums(data, part).groupBy("pos").pivot("grp", [0, 1, 2, 3, 4]).agg(F.first("total"))
    n = F.col("4")
    fitted_ss, error_ss = F.col("1") - F.col("0") * F.col("0") / n, F.col("3") - F.col("2") * F.col("2") / n
    names = spark.createDataFrame(pa.table({"pos": pa.array(np.arange(len(numbers), dtype=np.int32)), "draw": pa.array(numbers.astype(np.int32))}))
    return pin(sums.join(names, "pos").select("draw", F.try_divide(fitted_ss, fitted_ss + error_ss).alias("r2")))


def pointwise_fit(
    frame: DataFrame, model: Fit | ZeroOneFit, draws: DataFrame, effects: DataFrame | None = None, trials: str | None = None, seed: int = 1
) -> DataFrame:
    """Predictive fit of every complete row over the draws: ``lppd``, ``p_waic``, ``elpd``, ``waic``, ``elpd_loo``.

    The leave-one-out density weighs a draw by 1/density, cut at sqrt(draws) times the
    mean weight. Densities never leave the task; extremes are taken out before exponentials.
    """
    fitted, response = _parts(model)
    numbers, beta = draw_matrix(draws, fitted)
    shared = frame.sparkSession.sparkContext.broadcast((numbers, beta))
    known = complete(frame, fitted.formula)
    y = F.col(fitted.formula.response).cast("double")
    data = _rows(known, fitted, effects, len(numbers), ["row_id"], {"__y": y}, trials, ["row_id"])
    names = ("lppd", "p_waic", "elpd", "waic", "elpd_loo")

    def run(batches):
        for batch in batches:
            out = np.empty((5, batch.num_rows))
            for part, _, sizes, eta, more in _chunks(batch, *shared.value, seed, ["__y"]):
                ll = response.log_density(more, eta, sizes)
                top, low = ll.max(1, keepdims=True), ll.min(1, keepdims=True)
                density = np.exp(ll - top)
                lppd = top[:, 0] + np.log(density.mean(1))
                spread = ll.var(1, ddof=1)
                weight = np.exp(low - ll)
                weight = np.minimum(weight, math.sqrt(ll.shape[1]) * weight.mean(1, keepdims=True))
                loo = top[:, 0] + np.log(np.einsum("ij,ij->i", weight, density) / weight.sum(1))
                out[:, part] = lppd, spread, lppd - spread, -2.0 * (lppd - spread), loo
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), *[pa.array(c) for c in out]], ["row_id", *names])

    return data.mapInArrow(run, T.StructType([data.schema["row_id"]] + [T.StructField(c, T.DoubleType()) for c in names]))


def predictive_check(
    frame: DataFrame,
    model: Fit | ZeroOneFit,
    draws: DataFrame,
    nsamples: int = 100,
    bins: int = 30,
    log_scale: bool = False,
    seed: int = 1,
    effects: DataFrame | None = None,
    trials: str | None = None,
) -> DataFrame:
    """Histogram of the response (draw 0) and of ``nsamples`` simulated responses.

    All share the bins between the smallest and largest observed response; bin 0
    and the last bin hold what falls outside, so every histogram counts all rows.
    """
    spark = frame.sparkSession
    fitted, response = _parts(model)
    chosen = draws.orderBy(mix_column(F.col("draw").cast("long").bitwiseXOR(F.lit(salt(9, seed)).cast("long"))), "draw").limit(nsamples)
    numbers, beta = draw_matrix(chosen, fitted)
    known = complete(frame, fitted.formula)
    y = F.col(fitted.formula.response).cast("double")
    span = known.agg(F.min(y), F.max(y)).first()
    low, high = (math.log(v) if log_scale else float(v) for v in span)
    edges = np.linspace(low, high, bins + 1)
    edges[-1] = np.nextafter(edges[-1], np.inf)
    shared = spark.sparkContext.broadcast((numbers, beta))
    data = _rows(known, fitted, effects, len(numbers), [], {"__y": y}, trials, ["row_id"])

    def place(values):
        with np.errstate(divide="ignore"):
            values = np.log(values) if log_scale else values
        return np.searchsorted(edges, values, side="right")

    def part(batch):
        numbers, beta = shared.value
        for _, keys, sizes, eta, more in _chunks(batch, numbers, beta, seed, ["__y"]):
            yield 0, np.bincount(place(more[:, 0]), minlength=bins + 2)
            simulated = place(response.simulated(eta, keys, numbers, seed, sizes))
            for k in range(simulated.shape[1]):
                yield k + 1, np.bincount(simulated[:, k], minlength=bins + 2)

    limits = spark.createDataFrame(
        [
            (i, None if i == 0 else float(edges[i - 1]), None if i > bins else float(edges[i]))
            for i in range(bins + 2)
        ],
        "pos int, lower double, upper double",
    )
    counts = batch_sums(data, part)
    return counts.join(F.broadcast(limits), "pos").select(
        F.col("grp").alias("draw"), F.col("pos").alias("bin"), "lower", "upper",
        F.col("total").cast("long").alias("rows"),
    )


def conditional_effect(
    frame: DataFrame,
    model: Fit | ZeroOneFit,
    draws: DataFrame,
    predictor: str,
    points: int = 100,
    by: str | None = None,
) -> DataFrame:
    """Expected response along one predictor, the others held at their mean, levels at zero.

    ``by`` adds curves at one deviation below, at, and above the mean of a
    second predictor, which shows an interaction.
    """
    formula = _parts(model)[0].formula
    main = list(formula.main)
    wanted = [F.avg(c).alias(f"m_{c}") for c in main] + [
        F.min(predictor).alias("low"), F.max(predictor).alias("high")
    ]
    if by:
        wanted.append(F.stddev_samp(by).alias("sd"))
    at = frame.agg(*wanted).first()
    step = (at["high"] - at["low"]) / (points - 1)
    held = [F.lit(float(at[f"m_{c}"])).alias(c) for c in main if c not in (predictor, by)]
    grid = frame.sparkSession.range(points).select(
        (F.lit(float(at["low"])) + F.col("id") * F.lit(float(step))).alias(predictor), *held
    )
    keep = [predictor]
    if by:
        levels = [float(at[f"m_{by}"] + k * at["sd"]) for k in (-1, 0, 1)]
        grid = grid.withColumn(by, F.explode(F.array(*[F.lit(v) for v in levels])))
        keep.append(by)
    products = {formula.interaction_name((a, b)): F.col(a) * F.col(b) for a, b in formula.interactions}
    grid = grid.withColumns(products) if products else grid
    return predict(grid, model, draws, noise=False, keep=tuple(keep))
