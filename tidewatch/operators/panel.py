"""Daily weather, flood labels and the district-month panel built from them.

A daily series holds one line per cell and day, so a window over one cell spans a few tens
of thousands of days at most, however large the raw readings were before they were summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Normal period, flood-history window, days of soil before a window, cap on % of normal.
NORMAL_YEARS = (1991, 2020)
PRIOR_WINDOW = 10
ANTECEDENT_DAYS = 7
MAX_RAIN_PCT = 1000.0
FILL_VALUE = -999.0


# ── daily series ────────────────────────────────────────────────────────────


def parse_daily(payloads: DataFrame, key: str, text: str) -> DataFrame:
    """Daily rows from JSON maps of date to value for rain and soil; the fill value becomes null."""
    parsed = F.from_json(text, "properties struct<parameter struct<PRECTOTCORR map<string,double>,"
                               "GWETROOT map<string,double>>>")
    params = payloads.select(key, parsed["properties"]["parameter"].alias("p"))
    rain = params.select(key, F.explode("p.PRECTOTCORR").alias("day", "rain_mm"))
    soil = params.select(key, F.explode("p.GWETROOT").alias("day", "soil_wetness"))
    both = rain.join(soil, [key, "day"], "full")
    return both.select(key, F.try_to_date("day", "yyyyMMdd").alias("day"),
                       F.nullif("rain_mm", F.lit(FILL_VALUE)).alias("rain_mm"),
                       F.nullif("soil_wetness", F.lit(FILL_VALUE)).alias("soil_wetness"))


def dense_days(daily: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """Every day of the period for every cell; days without a reading stay null."""
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")
    return daily.select(key).distinct().select(key, days).join(daily, [key, "day"], "left")


def month_features(daily: DataFrame, key: str, last_year: int, normal: tuple[int, int] = NORMAL_YEARS) -> DataFrame:
    """Per cell and month: rain, its share of normal, heaviest three days, soil wetness before.

    Three-day windows never span two months. The soil of the last days of a month is
    averaged straight into the next month, which needs no window over the series.
    """
    kept = daily.filter(F.year("day") <= last_year)
    month = W.partitionBy(key, F.trunc("day", "month")).orderBy("day").rowsBetween(-2, 0)
    three = F.when(F.count("rain_mm").over(month) == 3, F.sum("rain_mm").over(month))
    rain = (kept.select(key, "day", "rain_mm", three.alias("_three"))
            .groupBy(key, F.trunc("day", "month").alias("_month")).agg(
                F.sum("rain_mm").alias("rain_mm"), F.count("rain_mm").alias("days"),
                F.max("_three").alias("max_3day_rain_mm")))
    soil = (kept.filter(F.datediff(F.last_day("day"), "day") < ANTECEDENT_DAYS)
            .groupBy(key, F.date_add(F.last_day("day"), 1).alias("_month"))
            .agg(F.avg("soil_wetness").alias("soil_wetness_before")))
    out = rain.join(soil, [key, "_month"], "left").withColumns(
        {"year": F.year("_month").cast("long"), "month": F.month("_month").cast("long")}).drop("_month")
    normals = (out.filter(F.col("year").between(*normal)).groupBy(key, "month")
               .agg(F.avg("rain_mm").alias("normal_mm")))
    pct = F.when(F.col("normal_mm") > 0, F.least(F.col("rain_mm") / F.col("normal_mm") * 100, F.lit(MAX_RAIN_PCT)))
    return out.join(normals, [key, "month"], "left").withColumn("rain_pct_normal", pct)


def _month_day(day: Column) -> Column:
    return F.month(day) * 100 + F.dayofmonth(day)


def normal_rain(daily: DataFrame, key: str, windows: DataFrame, normal: tuple[int, int] = NORMAL_YEARS) -> DataFrame:
    """Mean rain between the same calendar dates over the normal period, per cell and window.

    Each day is credited to the year in which its window starts, which also serves a window
    that crosses the new year. A bound on 29 February is read as the 28th.
    """
    first, last = F.col("window_start"), F.col("as_of")
    a = F.when(_month_day(first) == 229, 228).otherwise(_month_day(first))
    b = F.when(_month_day(last) == 229, 228).otherwise(_month_day(last))
    day, year = _month_day(F.col("day")), F.year("day")
    wraps = F.year(last) > F.year(first)
    started = (F.when(~wraps & day.between(a, b), year).when(wraps & (day >= a), year)
               .when(wraps & (day <= b), year - 1))
    years = normal[1] - normal[0] + 1
    return daily.join(windows, key).filter(started.between(*normal)).groupBy(key).agg(
        (F.coalesce(F.sum("rain_mm"), F.lit(0.0)) / years).alias("normal_mm"))


def latest_window(daily: DataFrame, key: str, days: int = 30) -> DataFrame:
    """First and last day of each cell's latest window that has rain readings."""
    return daily.filter(F.col("rain_mm").isNotNull()).groupBy(key).agg(F.max("day").alias("as_of")).withColumn(
        "window_start", F.date_sub("as_of", days - 1))


def window_features(daily: DataFrame, key: str, windows: DataFrame,
                    normal: tuple[int, int] = NORMAL_YEARS) -> DataFrame:
    """Rain and soil features of one window of days per cell (``window_start`` to ``as_of``)."""
    span = daily.join(windows, key).filter(F.col("day").between(F.date_sub("window_start", ANTECEDENT_DAYS), F.col("as_of")))
    within = F.col("day") >= F.col("window_start")
    three = W.partitionBy(key).orderBy("day").rowsBetween(-2, 0)
    rain = F.when(within, F.col("rain_mm"))
    heavy = F.when(F.count(rain).over(three) == 3, F.sum(rain).over(three))
    facts = span.withColumn("_three", heavy).groupBy(key, "window_start", "as_of").agg(
        F.count(rain).alias("days"), F.coalesce(F.sum(rain), F.lit(0.0)).alias("_rain"),
        F.max("_three").alias("_max3"), F.avg(F.when(~within, F.col("soil_wetness"))).alias("_soil"))
    usual = normal_rain(daily, key, windows, normal)
    pct = F.when(F.col("normal_mm") > 0, F.least(F.col("_rain") / F.col("normal_mm") * 100, F.lit(MAX_RAIN_PCT)))
    return facts.join(usual, key, "left").fillna(0.0, subset=["normal_mm"]).select(
        key, "window_start", "as_of", "days", F.bround("_rain", 1).alias("rain_mm"),
        F.bround("normal_mm", 1).alias("normal_mm"), F.bround(pct, 1).alias("rain_pct_normal"),
        F.bround("_max3", 1).alias("max_3day_rain_mm"), F.bround("_soil", 3).alias("soil_wetness_before"))


# ── labels and history ──────────────────────────────────────────────────────


def dense_months(spark, districts: DataFrame, first: int, last: int) -> DataFrame:
    """Every district, year and calendar month of a period."""
    years = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("year")
    months = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("month")
    return districts.select("district").distinct().select("district", years).select("district", "year", months)


def touched_months(events: DataFrame, first: int, last: int) -> DataFrame:
    """One line per event, district and month that the event touches."""
    months = F.sequence(F.trunc("start_date", "month"), F.trunc("end_date", "month"), F.expr("INTERVAL 1 MONTH"))
    return (events.select("uei", "district", "deaths", F.explode(months).alias("_m"))
            .select("uei", "district", "deaths", F.year("_m").cast("long").alias("year"),
                    F.month("_m").cast("long").alias("month"))
            .filter(F.col("year").between(first, last)))


def month_labels(events: DataFrame, districts: DataFrame, first: int, last: int) -> DataFrame:
    """District-month labels: events that touch the month, whether one was deadly, deaths once per event."""
    once = touched_months(events, first, last).groupBy("district", "year", "month", "uei").agg(
        F.max("deaths").alias("deaths"))
    found = once.groupBy("district", "year", "month").agg(
        F.count("*").alias("events"), F.max((F.col("deaths") >= 1).cast("long")).alias("deadly"),
        F.sum("deaths").alias("event_deaths"))
    grid = dense_months(events.sparkSession, districts, first, last)
    return grid.join(found, ["district", "year", "month"], "left").fillna(0, subset=["events", "deadly"]).withColumn(
        "flood", (F.col("events") > 0).cast("long"))


def district_history(labels: DataFrame) -> DataFrame:
    """Years covered, years with a flood and years with a deadly one."""
    yearly = labels.groupBy("district", "year").agg(F.max("flood").alias("flood"), F.max("deadly").alias("deadly"))
    return yearly.groupBy("district").agg(
        F.count("*").alias("ifi_seasons"), F.sum("flood").alias("ifi_flood_seasons"),
        F.sum("deadly").alias("ifi_deadly_seasons"), F.min("year").alias("ifi_first_year"))


def prior_rates(labels: DataFrame, years: tuple[int, int], window: int = PRIOR_WINDOW) -> DataFrame:
    """Share of the previous covered years with a flood, the year itself left out.

    Years past the coverage use the last covered ones; a year with none before it is null.
    """
    yearly = labels.groupBy("district", "year").agg(F.max("flood").alias("flood"))
    ends = yearly.groupBy("district").agg(F.max("year").alias("_last"))
    ahead = ends.select("district", (F.col("_last") + 1).alias("year"), F.lit(None).cast("long").alias("flood"))
    before = W.partitionBy("district").orderBy("year").rangeBetween(-window, -1)
    rates = yearly.unionByName(ahead).withColumn("prior_flood_rate", F.avg("flood").over(before)).drop("flood")
    asked = ends.select("district", "_last", F.explode(F.sequence(F.lit(years[0]).cast("long"), F.lit(years[1]).cast("long")))
                        .alias("_asked"))
    return asked.withColumn("year", F.least(F.col("_asked"), F.col("_last") + 1)).join(
        rates, ["district", "year"], "left").select("district", F.col("_asked").alias("year"), "prior_flood_rate")


def annual_rain(daily: DataFrame, cell: str, areas: DataFrame, area: str) -> DataFrame:
    """Yearly rain of each area as the mean over its cells."""
    yearly = daily.groupBy(cell, F.year("day").cast("long").alias("year")).agg(F.sum("rain_mm").alias("rain"))
    cells = areas.select(area, cell).distinct()
    return yearly.join(cells, cell).groupBy(area, "year").agg(F.bround(F.avg("rain"), 1).alias("annual_rainfall_mm"))


def enrich_districts(districts: DataFrame, zonal: DataFrame, history: DataFrame) -> DataFrame:
    """District attributes with elevation statistics and flood history beside them."""
    return districts.join(zonal, "district", "left").join(history, "district")


def build_panel(districts: DataFrame, features: DataFrame, priors: DataFrame, labels: DataFrame,
                cell: str = "cell") -> DataFrame:
    """District-month panel: cell features spread to the districts of the cell, history and labels."""
    info = districts.select("district", "state", cell, "elevation_m")
    rows = (info.join(features, cell).join(priors, ["district", "year"], "left")
            .join(labels.select("district", "year", "month", "events", "event_deaths", "deadly", "flood"),
                  ["district", "year", "month"], "left").drop(cell))
    one = {c: F.bround(c, 1) for c in ("rain_mm", "max_3day_rain_mm", "normal_mm", "rain_pct_normal")}
    three = {c: F.bround(c, 3) for c in ("soil_wetness_before", "prior_flood_rate")}
    return rows.withColumns({**one, **three})


def tidy_flags(df: DataFrame, flag: str) -> DataFrame:
    """Column names in lower case with underscores, and a YES/NO column as 1/0."""
    out = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    return out.withColumn(flag, (F.upper(F.trim(flag)) == "YES").cast("long"))


def restrict_states(districts: DataFrame, states: list[str], column: str = "state") -> DataFrame:
    """Districts of the chosen states; an unknown state name is an error."""
    known = {r[0] for r in districts.select(column).distinct().filter(F.col(column).isin(states)).collect()}
    unknown = sorted(set(states) - known)
    if unknown:
        raise ValueError(f"unknown state(s): {', '.join(unknown)}")
    return districts.filter(F.col(column).isin(states))
