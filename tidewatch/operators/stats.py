"""Trends, correlations and seasonality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.tails import correlation_p_udf, month_chi_p_udf
from tidewatch.operators.ranking import average_ranks
from tidewatch.session import materialise

ALPHA = 0.05
# Length of each month, February at its mean over leap years.
MONTH_DAYS = [31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def pearson(x: Column, y: Column) -> Column:
    """Correlation that is null, and not an error, when either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def trend_verdicts(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Spearman trend and straight-line slope of a yearly series per group.

    A series has one line per year, so the rank windows hold a few hundred rows at most.
    Fewer than five years, or a constant series, is reported as insufficient.
    """
    scope = W.partitionBy(*keys)

    def ranks(column: str):
        ties = W.partitionBy(*keys, column)
        return F.rank().over(scope.orderBy(column)) + (F.count("*").over(ties) - 1) / 2

    ranked = df.withColumns({"_ry": ranks(year), "_rv": ranks(value)})
    stats = ranked.groupBy(*keys).agg(
        F.count("*").alias("n_years"), F.countDistinct(value).alias("_distinct"),
        F.min(year).alias("from_year"), F.max(year).alias("to_year"),
        pearson(F.col("_ry"), F.col("_rv")).alias("_rho"),
        F.regr_slope(F.col(value).cast("double"), F.col(year).cast("double")).alias("_slope"))
    enough = (F.col("n_years") >= 5) & (F.col("_distinct") >= 2)
    stats = stats.withColumn("_p", correlation_p_udf(F.col("_rho"), F.col("n_years").cast("double")))
    direction = (F.when(~enough, "insufficient").when(F.col("_p") >= ALPHA, "no clear trend")
                 .when(F.col("_rho") > 0, "increasing").otherwise("decreasing"))
    return stats.select(
        *keys, direction.alias("direction"), F.when(enough, F.bround("_rho", 3)).alias("spearman_rho"),
        F.when(enough, F.bround("_p", 4)).alias("p_value"), F.when(enough, F.col("_slope")).alias("slope_per_year"),
        "from_year", "to_year", "n_years")


def correlations(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson on logs and Spearman on ranks over the rows that report both figures.

    Ranks come from the bucketed ranking, as a group here has no bound on its size. The two
    columns are written out first, because the ranks and the result all read them.
    """
    both = materialise(df.filter((F.col(x) > 0) & (F.col(y) > 0)).select(
        *keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), "pairs")
    ranked = (both.join(average_ranks(both, keys, "_x", "_rx"), [*keys, "_x"])
              .join(average_ranks(both, keys, "_y", "_ryy"), [*keys, "_y"]))
    stats = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), pearson(F.log10("_x"), F.log10("_y")).alias("_pearson"),
        pearson(F.col("_rx"), F.col("_ryy")).alias("_spearman"))
    enough = F.col("n") >= 3
    size = F.col("n").cast("double")
    return stats.withColumns({
        "_pp": correlation_p_udf(F.col("_pearson"), size), "_sp": correlation_p_udf(F.col("_spearman"), size),
    }).select(*keys, F.lit(x).alias("x"), F.lit(y).alias("y"), "n",
              F.when(enough, F.bround("_pearson", 3)).alias("pearson_log"),
              F.when(enough, F.col("_pp")).alias("pearson_p"),
              F.when(enough, F.bround("_spearman", 3)).alias("spearman"),
              F.when(enough, F.col("_sp")).alias("spearman_p"))


def month_counts(df: DataFrame, month: str, keys: list[str] | None = None) -> DataFrame:
    """Events of each calendar month, all twelve shown."""
    keys = keys or []
    counted = df.groupBy(*keys).agg(*[F.count_if(F.col(month) == m).alias(str(m)) for m in range(1, 13)])
    return counted.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("month"), F.col(str(m)).alias("n")) for m in range(1, 13)])).alias("x")
    ).select(*keys, "x.month", F.col("x.n").alias("count"))


def seasonality(df: DataFrame, month: str, keys: list[str] | None = None) -> DataFrame:
    """Busiest month and three-month season, and a chi-square test against a flat year.

    One aggregate gives the twelve counts of a group; the rest is arithmetic on that row.
    Ties go to the earlier month.
    """
    keys = keys or []
    counted = df.groupBy(*keys).agg(
        F.array(*[F.count_if(F.col(month) == m) for m in range(1, 13)]).alias("c"), F.count(month).alias("total"))
    count_of = [F.element_at("c", m) for m in range(1, 13)]
    months = F.array(*[F.struct(n.alias("n"), F.lit(-m).alias("m")) for m, n in enumerate(count_of, 1)])
    seasons = F.array(*[F.struct((count_of[m - 1] + count_of[m % 12] + count_of[(m + 1) % 12]).alias("n"),
                                 F.lit(-m).alias("m")) for m in range(1, 13)])
    year = sum(MONTH_DAYS)
    chi2 = sum((n - F.col("total") * (d / year)) * (n - F.col("total") * (d / year)) / (F.col("total") * (d / year))
               for n, d in zip(count_of, MONTH_DAYS))
    rows = counted.filter("total > 0").withColumns({
        "_peak": F.array_max(months), "_season": F.array_max(seasons), "_chi2": chi2})
    rows = rows.withColumn("p_value", month_chi_p_udf("_chi2"))
    return rows.select(
        *keys, (-F.col("_peak.m")).alias("peak_month"), F.col("_peak.n").alias("peak_count"),
        (F.col("_peak.n") / F.col("total")).alias("peak_share"), (-F.col("_season.m")).alias("season_start"),
        F.col("_season.n").alias("season_count"), (F.col("_season.n") / F.col("total")).alias("season_share"),
        F.bround("_chi2", 2).alias("chi2"), "p_value", (F.col("p_value") < ALPHA).alias("seasonal"), "total")


def quake_seasonality(quakes: DataFrame) -> DataFrame:
    """Seasonality of a quake catalogue, re-tested after thinning.

    A season is only claimed when it also shows with one quake per month and 5-degree
    cell, and then in the same three months.
    """
    from tidewatch.functions.geo import degree_cell

    cell = degree_cell(F.col("latitude"), F.col("longitude"))
    thinned = quakes.select("year", "month", cell.alias("cell")).dropDuplicates(["year", "month", "cell"])
    raw = seasonality(quakes.withColumn("_k", F.lit(1)), "month", ["_k"])
    robust = seasonality(thinned.withColumn("_k", F.lit(1)), "month", ["_k"]).select(
        "_k", F.col("total").alias("robust_n"), F.col("season_start").alias("robust_season_start"),
        F.col("p_value").alias("robust_p"), F.col("seasonal").alias("_rs"))
    stable = F.col("_rs") & (F.col("robust_season_start") == F.col("season_start"))
    return (raw.join(robust, "_k").withColumn("stable", stable)
            .withColumn("seasonal", F.col("seasonal") & F.col("stable")).drop("_k", "_rs"))


def hemisphere_months(storms: DataFrame) -> DataFrame:
    """Storms of each genesis month north and south of the equator."""
    counted = storms.groupBy("month").agg(
        F.count("*").alias("count"), F.count_if(F.col("lmi_latitude") >= 0).alias("north"),
        F.count_if(F.col("lmi_latitude") < 0).alias("south"))
    twelve = storms.sparkSession.range(1, 13).select(F.col("id").alias("month"))
    return twelve.join(counted, "month", "left").fillna(0)
