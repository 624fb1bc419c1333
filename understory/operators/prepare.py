"""Plot tables: selection, abundance and richness by status, assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from understory.functions.nulls import gt0, match_join, n_distinct_na, null_to_zero, share, sum_na
from understory.session import scratch_path
from understory.sources.schema import ENV_NAMES

STATUSES = ["alien", "native"]
ABUNDANCE_COLUMNS = [
    "Island", "PlotID", "Plot_Area",
    "Alien_abundance", "Native_abundance", "Abundance_both", "AlienAbund_Prop",
]
RICHNESS_COLUMNS = [
    "Island", "PlotID", "Alien_SppN", "Native_SppN", "SppN_both", "AlienSppN_Prop",
]


def rename_at(df: DataFrame, position: int, name: str) -> DataFrame:
    """Rename the column at a zero-based position."""
    return df.withColumnRenamed(df.columns[position], name)


def select_as(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Project and rename: ``{old: new}``."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def tidy_environment(env_raw: DataFrame) -> DataFrame:
    """Environment rows under their working names, exact duplicates removed."""
    return select_as(env_raw, ENV_NAMES).distinct()


def native_totals(plots: DataFrame) -> DataFrame:
    """Plots with a positive total of native abundance."""
    return (
        plots.where(F.col("Native_Status") == "native")
        .groupBy("PlotID")
        .agg(sum_na("Abundance_ha").alias("Abund_Tot"))
        .where(gt0("Abund_Tot"))
    )


def keep_native_plots(plots: DataFrame) -> DataFrame:
    """All rows of the plots that have native abundance."""
    return match_join(plots, native_totals(plots).select("PlotID"), ["PlotID"], "left_semi")


def plot_sizes(plots: DataFrame) -> DataFrame:
    return plots.select("PlotID", "Plot_Area").distinct()


def pivot_wider(
    df: DataFrame, ids: list[str], names_from: str, values_from: str, names: list[str]
) -> DataFrame:
    """One column per listed name; values of other names are ignored."""
    return df.groupBy(*ids).pivot(names_from, names).agg(F.first(values_from))


def status_abundance(plots: DataFrame) -> DataFrame:
    """Abundance per island, plot and status."""
    return plots.groupBy("Island", "PlotID", "Native_Status").agg(
        sum_na("Abundance_ha").alias("Abundance")
    )


def status_richness(plots: DataFrame) -> DataFrame:
    """Number of species present per island, plot and status.

    Species rows are made distinct first, so the count itself is an ordinary
    two-step aggregate and a missing species code counts as one species.
    """
    keys = ["Island", "PlotID", "Native_Status"]
    return (
        plots.where(gt0("Abundance_ha"))
        .select(*keys, "SPP_CODE3A")
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("SppN"))
    )


def abundance_shares(plots: DataFrame) -> DataFrame:
    """Alien and native abundance side by side; a missing alien cell stays missing."""
    wide = pivot_wider(
        status_abundance(plots), ["Island", "PlotID"], "Native_Status", "Abundance", STATUSES
    )
    both = F.col("alien") + F.col("native")
    wide = wide.select(
        "Island", "PlotID",
        F.col("alien").alias("Alien_abundance"),
        F.col("native").alias("Native_abundance"),
        both.alias("Abundance_both"),
        share("alien", both).alias("AlienAbund_Prop"),
    )
    return match_join(wide, plot_sizes(plots), ["PlotID"], "left").select(*ABUNDANCE_COLUMNS)


def richness_shares(plots: DataFrame) -> DataFrame:
    """Alien and native species counts; only a missing alien count becomes zero."""
    wide = pivot_wider(
        status_richness(plots), ["Island", "PlotID"], "Native_Status", "SppN", STATUSES
    )
    alien = null_to_zero("alien")
    both = alien + F.col("native")
    return wide.select(
        "Island", "PlotID",
        alien.alias("Alien_SppN"),
        F.col("native").alias("Native_SppN"),
        both.alias("SppN_both"),
        share(alien, both).alias("AlienSppN_Prop"),
    )


def complete_cases(df: DataFrame) -> DataFrame:
    """Rows without null or NaN in any column.

    One predicate per column, so that each can reach the scan by itself.
    """
    known = [F.col(f"`{c}`").isNotNull() for c in df.columns]
    numbers = [~F.isnan(f"`{c}`") for c, t in df.dtypes if t in ("double", "float")]
    return df.where(reduce(lambda a, b: a & b, known + numbers))


def _sum_where(condition: Column, x: Column) -> Column:
    return F.sum(F.when(condition, x))


def plot_summary(plots: DataFrame) -> DataFrame:
    """Abundance and richness shares of the selected plots in one pass.

    Equal to ``keep_native_plots`` followed by ``abundance_shares`` and
    ``richness_shares`` joined on island and plot, but the survey rows are read
    and shuffled once. They are first reduced to one row per species and plot,
    on keys that spread a very large plot over all tasks; everything after that
    is keyed by plot and stays on the partitions made by one ``repartition``.
    """
    x = F.col("Abundance_ha")
    species_key = ["Island", "PlotID", "Native_Status", "SPP_CODE3A"]
    species = (
        plots.groupBy(*species_key, "Plot_Area")
        .agg(
            F.sum(x).alias("total"),
            F.count(F.when(x.isNull(), 1)).alias("missing"),
            F.max(gt0(x).cast("int")).alias("seen"),
        )
        .repartition("PlotID")
        .groupBy(*species_key)
        .agg(
            F.sum("total").alias("total"),
            F.sum("missing").alias("missing"),
            F.max("seen").alias("seen"),
            # A struct keeps a null area as a value of the set.
            F.collect_set(F.struct("Plot_Area")).alias("areas"),
        )
    )
    per_status = []
    for status in STATUSES:
        match = F.col("Native_Status") == status
        per_status += [
            F.when(_sum_where(match, F.col("missing")) == 0, _sum_where(match, F.col("total"))).alias(status),
            F.sum(F.when(match & (F.col("seen") == 1), 1)).alias(f"{status}_species"),
        ]
    by_plot = species.groupBy("Island", "PlotID").agg(
        *per_status,
        F.max("seen").alias("any_seen"),
        F.sum(F.when((F.col("Native_Status") == "native"), F.col("missing"))).alias("native_missing"),
        F.array_distinct(F.flatten(F.collect_set("areas"))).alias("areas"),
    )
    # A plot holds one row per island here, so this window is small per key.
    plot = Window.partitionBy("PlotID")
    chosen = (
        by_plot.withColumn(
            "native_total",
            F.when(F.sum("native_missing").over(plot) == 0, F.sum("native").over(plot)),
        )
        .withColumn("areas", F.array_distinct(F.flatten(F.collect_set("areas").over(plot))))
        .where(gt0("native_total"))
    )
    alien_species = F.when(F.col("any_seen") == 1, null_to_zero("alien_species"))
    abundance = F.col("alien") + F.col("native")
    richness = alien_species + F.col("native_species")
    return chosen.select(
        "Island", "PlotID", F.explode("areas").alias("area"),
        F.col("alien").alias("Alien_abundance"),
        F.col("native").alias("Native_abundance"),
        abundance.alias("Abundance_both"),
        share("alien", abundance).alias("AlienAbund_Prop"),
        alien_species.alias("Alien_SppN"),
        F.col("native_species").alias("Native_SppN"),
        richness.alias("SppN_both"),
        share(alien_species, richness).alias("AlienSppN_Prop"),
    ).select(
        "Island", "PlotID", F.col("area.Plot_Area").alias("Plot_Area"),
        *ABUNDANCE_COLUMNS[3:], *RICHNESS_COLUMNS[2:],
    )


def alien_native(plots: DataFrame, env_raw: DataFrame) -> DataFrame:
    """Alien and native abundance, richness and environment per plot, complete rows only.

    A plot without environment or without a name would be dropped as incomplete,
    so the join is an inner one on the partitions the summary already has, and
    incomplete rows of either side are dropped before it.
    """
    summary = complete_cases(plot_summary(plots))
    env = complete_cases(tidy_environment(env_raw))
    return summary.join(env, "PlotID", "inner").select(
        *summary.columns, *[c for c in env.columns if c != "PlotID"]
    )


def alien_native_stepwise(plots: DataFrame, env_raw: DataFrame) -> DataFrame:
    """The same table from the separate operators, one join per step.

    The selected rows are written once, since three steps read them and each would make the survey rows anew.
    """
    path = scratch_path(plots.sparkSession, "kept")
    keep_native_plots(plots).write.parquet(path)
    kept = plots.sparkSession.read.parquet(path)
    joined = match_join(
        abundance_shares(kept), richness_shares(kept), ["Island", "PlotID"], "left"
    )
    joined = match_join(joined, tidy_environment(env_raw), ["PlotID"], "left")
    return complete_cases(joined)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Return ``df``; raise if a key combination occurs twice."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{keys} is not a key, for example {repeated[0].asDict()}")
    return df


def global_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of distinct values of each column, a missing value being one more."""
    return df.agg(*[n_distinct_na(c).alias(f"n_{c}") for c in columns])


def rows_per_level(df: DataFrame, level: str, name: str = "N") -> DataFrame:
    return df.groupBy(level).agg(F.count(F.lit(1)).alias(name))


def model_frame(df: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """Columns of a model, complete rows only, with the row identity kept."""
    names = [row_id] + [c for c in dict.fromkeys(columns) if c != row_id]
    return complete_cases(df.select(*names))


def label_overlap(a: DataFrame, column_a: str, b: DataFrame, column_b: str) -> DataFrame:
    """How many distinct labels two tables have: only the first, only the second, both, and whether the sets are equal."""
    left = a.select(F.col(column_a).alias("label")).where("label is not null").distinct().withColumn("in_a", F.lit(1))
    right = b.select(F.col(column_b).alias("label")).where("label is not null").distinct().withColumn("in_b", F.lit(1))
    both = left.join(right, "label", "full")
    counts = both.agg(
        F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"),
        F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("shared"),
    )
    return counts.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))
