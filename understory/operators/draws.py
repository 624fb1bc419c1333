"""Operators on tables of draws, sampler diagnostics and pointwise log densities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from understory.functions.nulls import match_join
from understory.operators.collinear import corr_pairs
from understory.operators.rank import quantiles, ranked, shortest_intervals, six_numbers, value_at

DRAW_IDS = ["chain", "iteration", "draw"]
INTERCEPT = "b_Intercept"
INTERVAL_WIDTHS = (0.68, 0.95)


def term_names(wide: DataFrame) -> list[str]:
    """Names of the terms of a wide draws table, in column order."""
    return [c for c in wide.columns if c not in DRAW_IDS]


def first_terms(terms: DataFrame, count: int = 25) -> DataFrame:
    """The first parameters by position."""
    return terms.orderBy("pos").limit(count)


def spread_draws(draws: DataFrame, terms: list[str]) -> DataFrame:
    """Long draws to one column per chosen term."""
    return (
        draws.where(F.col("terms").isin(terms))
        .groupBy(*DRAW_IDS)
        .pivot("terms", terms)
        .agg(F.first("value"))
    )


def long_draws(wide: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Wide draws to ``(ids, terms, value)`` without missing values."""
    quoted = [F.col(f"`{t}`") for t in (terms or term_names(wide))]
    return wide.unpivot([F.col(c) for c in DRAW_IDS], quoted, "terms", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def without_intercept(draws: DataFrame) -> DataFrame:
    return draws.where(F.col("terms") != INTERCEPT)


def interval_table(draws: DataFrame, widths: tuple[float, ...] = INTERVAL_WIDTHS) -> DataFrame:
    """Median and shortest intervals per term, one row per term and width."""
    return shortest_intervals(draws, ["terms"], "value", widths)


def interval_figure(draws: DataFrame, widths: tuple[float, ...] = INTERVAL_WIDTHS) -> DataFrame:
    """The same with one row per term: narrow and wide interval side by side."""
    table = interval_table(without_intercept(draws), widths)
    columns = [F.first("median").alias("median")]
    for width in widths:
        tag = f"{round(width * 100)}"
        at = F.col("width") == F.lit(float(width))
        columns += [
            F.max(F.when(at, F.col("lower"))).alias(f"lower_{tag}"),
            F.max(F.when(at, F.col("upper"))).alias(f"upper_{tag}"),
        ]
    return table.groupBy("terms").agg(*columns)


def kept_terms(draws: DataFrame, prob: float = 0.95) -> DataFrame:
    """Terms a reduced model keeps: all main effects, and the interactions whose
    interval excludes zero."""
    table = interval_table(without_intercept(draws), (prob,))
    return table.where(
        (F.col("lower") > 0) | (F.col("upper") < 0) | ~F.col("terms").contains(":")
    )


def divergences(diagnostics: DataFrame, parameter: str = "divergent__", by_chain: bool = False) -> DataFrame:
    """Number of flagged sampler steps."""
    rows = diagnostics.where(F.col("Parameter") == parameter)
    total = F.coalesce(F.sum("Value"), F.lit(0)).alias("divergent")
    return rows.groupBy("chain").agg(total) if by_chain else rows.agg(total)


def split_rhat(draws: DataFrame) -> DataFrame:
    """Convergence ratio per term from the two halves of every chain.

    The halves go by the position of a draw in its own chain, whatever number the
    iterations start from; of an odd length the middle is left out. Where the chain
    is cut follows from exact distributed ranks, so no chain is sorted in one task.
    """
    keys = ["terms", "chain"]
    places = ranked(draws, keys, F.col("iteration").cast("double"))
    cuts = places.groupBy(*keys).agg(
        value_at(F.floor(F.col("n") / 2) - 1).alias("last"), value_at(F.ceil(F.col("n") / 2)).alias("first")
    )
    half = F.when(F.col("iteration") <= F.col("last"), 1).when(F.col("iteration") >= F.col("first"), 2)
    halves = (
        match_join(draws.select(*keys, "iteration", "value"), cuts, keys, "inner")
        .select(*keys, half.alias("half"), "value")
        .where("half is not null")
        .groupBy(*keys, "half")
        .agg(
            F.avg("value").alias("m"),
            F.var_samp("value").alias("v"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    n, within, between = F.avg("n"), F.avg("v"), F.var_samp("m")
    return halves.groupBy("terms").agg(
        F.sqrt(F.try_divide((n - 1) / n * within + between, within)).alias("rhat")
    )


def rhat_summary(draws: DataFrame) -> DataFrame:
    return six_numbers(split_rhat(draws), [], "rhat")


def value_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, deviation and central 95 % bounds per key."""
    moments = df.groupBy(*keys).agg(
        F.avg(value).alias("estimate"), F.stddev_samp(value).alias("est_error")
    )
    bounds = quantiles(df, keys, value, {"q2_5": 0.025, "q97_5": 0.975})
    if keys:
        return match_join(moments, bounds, keys, "left")
    both = moments.select(F.struct("*")).scalar()
    return bounds.withColumn("m", both).select("m.*", "q2_5", "q97_5")


def term_summary(draws: DataFrame) -> DataFrame:
    """Summary of every term with its convergence ratio."""
    return match_join(value_summary(draws, ["terms"], "value"), split_rhat(draws), ["terms"], "left")


def draw_correlations(wide: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Correlation of coefficient draws."""
    return corr_pairs(wide, terms or term_names(wide)).select("term_a", "term_b", "r")


#: Log densities are summed within bands of this width, where no exponential is out of range.
BAND = 64.0


def _by_row(loglik: DataFrame, sign: int) -> DataFrame:
    """``(row_id, n, lse, spread)``: number of log densities, ln of the sum of exp(sign * ll), sample variance; one scan.

    Partial sums per row and band are added up before and after the shuffle; the few bands of a row
    are then put together about the highest one, so that neither large nor small densities are lost.
    """
    x = F.col("ll") * sign
    parts = loglik.where("ll is not null").select("row_id", "ll", F.floor(x / BAND).alias("band"), x.alias("x")).groupBy("row_id", "band").agg(
        F.sum(F.exp(F.col("x") - F.col("band") * BAND)).alias("s"), F.count(F.lit(1)).alias("n"), F.avg("ll").alias("m"), F.var_pop("ll").alias("v")
    )
    rows = parts.groupBy("row_id").agg(
        F.collect_list(F.struct("band", "s", "n", "m", "v")).alias("parts"), F.max("band").alias("top"), F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
    )
    total = lambda f: F.aggregate("parts", F.lit(0.0), lambda a, p: a + f(p))
    squares = total(lambda p: p["n"] * (p["v"] + (p["m"] - F.col("mean")) * (p["m"] - F.col("mean"))))
    return rows.select(
        "row_id", "n", (F.col("top") * BAND + F.ln(total(lambda p: p["s"] * F.exp((p["band"] - F.col("top")) * BAND)))).alias("lse"),
        F.when(F.col("n") > 1, squares / (F.col("n") - 1)).alias("spread"),
    )


def waic_points(loglik: DataFrame) -> DataFrame:
    """Pointwise predictive fit per row: lppd, effective size, elpd and waic. One scan, no join."""
    lppd, p_waic = F.col("lse") - F.ln("n"), F.col("spread")
    return _by_row(loglik, 1).select(
        "row_id", lppd.alias("lppd"), p_waic.alias("p_waic"), (lppd - p_waic).alias("elpd"), (-2 * (lppd - p_waic)).alias("waic")
    )


def loo_points(loglik: DataFrame) -> DataFrame:
    """Pointwise leave-one-out log density by truncated importance weights.

    The weight of a draw is 1/density, cut at sqrt(draws) times the mean weight. The
    first scan finds the cut of every row; with it no term of the second exceeds one.
    """
    cuts = _by_row(loglik, -1).select("row_id", (F.col("lse") - 0.5 * F.ln("n")).alias("cut"))
    over = F.least(F.lit(1.0), F.exp(F.col("ll") + F.col("cut")))
    under = F.least(F.lit(1.0), F.exp(-F.col("ll") - F.col("cut")))
    return (
        loglik.where("ll is not null").select("row_id", "ll").join(cuts, "row_id").groupBy("row_id")
        .agg((F.ln(F.sum(over)) - F.max("cut") - F.ln(F.sum(under))).alias("elpd_loo"))
    )


def compare_elpd(a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference of summed pointwise log density (a minus b) and its error."""
    both = a.select("row_id", F.col("elpd").alias("elpd_a")).join(
        b.select("row_id", F.col("elpd").alias("elpd_b")), "row_id"
    )
    d = F.col("elpd_a") - F.col("elpd_b")
    return both.agg(
        F.sum("elpd_a").alias("elpd_a"),
        F.sum("elpd_b").alias("elpd_b"),
        F.sum(d).alias("elpd_diff"),
        (F.sqrt(F.count(d)) * F.stddev_samp(d)).alias("se_diff"),
    )
