"""Predictor transforms: z-scores, sign flip, logarithm, interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from understory.functions.nulls import gt0, nan_to_null, safe_ln, share

# Predictor -> name of its z-score.
CLIMATE_SCORES = {
    "MAP": "MAPs",
    "MAT": "MATs",
    "Elev_m": "Elev_ms",
    "AridInd": "AridInds",
    "VPD": "VPDs",
    "HII": "HIIs",
    "HFP": "HFPs",
    "SubstrateAge_range_lg": "Soilz",
}
TRAIT_SCORES = {
    "PD_stand": "PD_stands",
    "WD_diff_lrr": "WD_diff_lrrs",
    "WD_wt_diff_lrr": "WD_wt_diff_lrrs",
    "maxDBH_diff_lrr": "maxDBH_diff_lrrs",
    "maxDBH_wt_diff_lrr": "maxDBH_wt_diff_lrrs",
    "SM_diff_lrr": "SM_diff_lrrs",
    "SM_wt_diff_lrr": "SM_wt_diff_lrrs",
}


def zscores(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Centre and scale whole columns: ``{column: score}``.

    All means and deviations come from one aggregate, attached as a single
    scalar subquery; a constant column scores null.
    """
    moments = df.agg(
        *[
            F.struct(F.avg(nan_to_null(c)).alias("m"), F.stddev_samp(nan_to_null(c)).alias("s")).alias(c)
            for c in names
        ]
    )
    stats = moments.select(F.struct(*names)).scalar()
    # One column holds the subquery, so that it runs once for all scores.
    staged = df.withColumn("__stats", stats)
    scored = {
        score: F.try_divide(F.col(c) - F.col(f"__stats.{c}.m"), F.col(f"__stats.{c}.s"))
        for c, score in names.items()
    }
    return staged.withColumns(scored).drop("__stats")


def flip_and_log(df: DataFrame) -> DataFrame:
    """Aridity so that higher is drier, and log substrate age."""
    return df.withColumns(
        {"AridInd": -F.col("AridInd"), "SubstrateAge_range_lg": safe_ln("SubstrateAge_range")}
    )


def plot_predictors(alien_native: DataFrame) -> DataFrame:
    """Scores over all complete plots, and only then the plots with aliens."""
    scored = zscores(flip_and_log(alien_native), CLIMATE_SCORES)
    return scored.withColumn("Plot_Area", F.col("Plot_Area").cast("string")).where(
        gt0("Alien_abundance")
    )


def species_predictors(local: DataFrame, measure: str = "MDWNC") -> DataFrame:
    """Scores over the species rows of one distance measure."""
    rows = local.where(F.col("PDmeasure") == measure)
    scored = zscores(flip_and_log(rows), {**CLIMATE_SCORES, **TRAIT_SCORES})
    return scored.withColumns(
        {
            "species": F.col("phylo"),
            "Plot_Area2": F.col("Plot_Area").cast("string"),
            "Island": F.col("Island").cast("string"),
            "PlotID": F.col("PlotID").cast("string"),
        }
    )


def relative_abundance(df: DataFrame) -> DataFrame:
    return df.withColumn("RelAbund", share("Abundance_ha", "Total_Abundance_ha"))
