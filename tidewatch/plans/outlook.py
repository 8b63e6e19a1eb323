"""Short-range outlook per region and hazard from history, season, place and forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scales as fn

HAZARDS = ["flood", "cyclone", "earthquake"]
HISTORY_YEARS = 10
FORECAST_DAYS = 16

# Open-sea point off each coastal state.
SEAS = {"Bay of Bengal": (15.0, 87.0), "Arabian Sea": (15.0, 68.0), "Andaman Sea": (11.0, 95.0),
        "Laccadive Sea": (10.0, 72.0)}
SEA_OF = {
    "Andaman and Nicobar Islands": "Andaman Sea", "Andhra Pradesh": "Bay of Bengal",
    "Dadra and Nagar Haveli and Daman and Diu": "Arabian Sea", "Goa": "Arabian Sea", "Gujarat": "Arabian Sea",
    "Karnataka": "Arabian Sea", "Kerala": "Laccadive Sea", "Lakshadweep": "Laccadive Sea", "Maharashtra": "Arabian Sea",
    "Odisha": "Bay of Bengal", "Puducherry": "Bay of Bengal", "Tamil Nadu": "Bay of Bengal", "West Bengal": "Bay of Bengal",
}

# Early-warning indicators with their threshold.
INDICATORS = [("precip", 100.0), ("wind", 60.0), ("soil", 0.75), ("temp", 2.0), ("seismic", 5.0), ("sst", 28.0)]


def sea_points(spark: SparkSession) -> DataFrame:
    rows = [(state, *SEAS[sea]) for state, sea in SEA_OF.items()]
    return spark.createDataFrame(rows, "region string, sea_lat double, sea_lon double")


def region_list(regions: DataFrame) -> DataFrame:
    """Regions with a coastal flag and, on a coast, their sea point."""
    return regions.join(sea_points(regions.sparkSession), "region", "left").withColumn(
        "coastal", F.col("sea_lat").isNotNull())


def window_months(start: Column, days: int) -> Column:
    """Calendar months that a window of days touches, in order."""
    return F.array_distinct(F.transform(F.sequence(start, F.date_add(start, days - 1)), lambda d: F.month(d).cast("long")))


def monthly_share(events: DataFrame, regions: DataFrame) -> DataFrame:
    """Twelve monthly shares of each region's events, all 0 where it has none."""
    counted = events.groupBy("region").agg(
        F.array(*[F.count_if(F.col("month") == m) for m in range(1, 13)]).alias("c"), F.count("*").alias("_n"))
    share = F.transform("c", lambda n: F.bround(n / F.col("_n"), 4))
    zeros = F.array(*[F.lit(0.0)] * 12)
    return regions.select("region").join(counted, "region", "left").select(
        "region", F.coalesce(F.when(F.col("_n") > 0, share), zeros).alias("monthly_share"))


def season_history(events: DataFrame, regions: DataFrame, months: list[int], last: int) -> DataFrame:
    """Events in the window's months over the last ten covered years, and whether they have grown."""
    first = last - HISTORY_YEARS + 1
    kept = events.filter(F.col("month").isin(months) & F.col("year").between(first, last))
    counted = kept.groupBy("region").agg(
        F.count("*").alias("total"), F.count_if(F.col("year") < first + 5).alias("earlier_5"),
        F.count_if(F.col("year") >= first + 5).alias("later_5"))
    out = regions.select("region").join(counted, "region", "left").fillna(0)
    return out.withColumn("trend", F.when(F.col("later_5") > F.col("earlier_5"), "up")
                          .when(F.col("later_5") < F.col("earlier_5"), "down").otherwise("flat"))


def season_years(events: DataFrame, regions: DataFrame, months: list[int], last: int) -> DataFrame:
    """The yearly counts behind ``season_history``, every year shown."""
    kept = events.filter(F.col("month").isin(months)).groupBy("region", "year").agg(F.count("*").alias("count"))
    years = F.explode(F.sequence(F.lit(last - HISTORY_YEARS + 1).cast("long"), F.lit(last).cast("long"))).alias("year")
    return regions.select("region", years).join(kept, ["region", "year"], "left").fillna(0, subset=["count"])


def flood_frequency(events: DataFrame, regions: DataFrame) -> DataFrame:
    """Share of covered years with a flood, beside the most exposed region."""
    span = events.agg((F.max("year") - F.min("year") + 1).alias("_span")).withColumn("_k", F.lit(1))
    hit = events.groupBy("region").agg(F.countDistinct("year").alias("_years")).withColumn("_k", F.lit(1))
    rate = hit.join(span, "_k").withColumn("_rate", F.col("_years") / F.col("_span"))
    top = rate.agg(F.max("_rate").alias("_top")).withColumn("_k", F.lit(1))
    out = rate.join(top, "_k").select("region", fn.clamp(F.col("_rate") / F.col("_top")).alias("frequency"))
    return regions.select("region").join(out, "region", "left").fillna(0.0, subset=["frequency"])


def relative_rate(regions: DataFrame, rate: str) -> DataFrame:
    """A yearly rate beside the highest of all regions."""
    top = regions.agg(F.max(rate).alias("_top")).withColumn("_k", F.lit(1))
    out = regions.withColumn("_k", F.lit(1)).join(top, "_k")
    return out.select("region", fn.clamp(F.coalesce(F.try_divide(F.col(rate), F.col("_top")), F.lit(0.0))).alias("frequency"))


def state_low_lying(districts: DataFrame) -> DataFrame:
    name = F.trim(F.regexp_replace("state", r"\s+", " "))
    return districts.groupBy(name.alias("region")).agg(F.avg("low_lying_pct").alias("low_lying_pct"))


def baseline(regions: DataFrame, floods: DataFrame, storms: DataFrame, quakes: DataFrame, low_lying: DataFrame,
             months: list[int], last: dict[str, int]) -> DataFrame:
    """Frequency, geography, monthly shares and same-season history for each region and hazard."""
    listed = region_list(regions)
    geography = {
        "flood": regions.join(low_lying, "region", "left").select(
            "region", fn.clamp(F.coalesce("low_lying_pct", F.lit(0.0)) / 50).alias("geography")),
        "cyclone": listed.select("region", F.when(F.col("coastal"), 1.0).otherwise(0.3).alias("geography")),
        "earthquake": regions.select("region", F.coalesce(
            fn.clamp((F.col("eq_max_magnitude") - 6.0) / 2.5), F.lit(0.0)).alias("geography")),
    }
    frequency = {"flood": flood_frequency(floods, regions), "cyclone": relative_rate(regions, "cy_rate_ts_per_year"),
                 "earthquake": relative_rate(regions, "eq_rate_per_year")}
    events = {"flood": floods, "cyclone": storms, "earthquake": quakes}
    out = None
    for hazard in HAZARDS:
        part = (frequency[hazard].join(geography[hazard], "region").join(monthly_share(events[hazard], regions), "region")
                .join(season_history(events[hazard], regions, months, last[hazard]), "region"))
        seasonal = hazard != "earthquake"
        part = part.select(
            "region", F.lit(hazard).alias("hazard"), F.bround("frequency", 4).alias("frequency"),
            F.bround("geography", 4).alias("geography"),
            (F.col("monthly_share") if seasonal else F.lit(None).cast("array<double>")).alias("monthly_share"),
            F.lit(seasonal).alias("seasonal"), "total", "earlier_5", "later_5", "trend")
        out = part if out is None else out.unionByName(part)
    return out


def daily_scores(base: DataFrame, forecast: DataFrame, start: str, days: int) -> DataFrame:
    """Score of every region, hazard and day; the forecast counts for the first sixteen days.

    ``base`` has one line per region and hazard, ``forecast`` one per region and date with
    the readings of that day.
    """
    day = F.posexplode(F.sequence(F.lit(start).cast("date"), F.date_add(F.lit(start).cast("date"), days - 1)))
    rows = base.select("*", day.alias("_i", "date")).join(
        forecast.withColumn("_has", F.lit(True)), ["region", "date"], "left")
    anomaly = (F.when(F.col("_has").isNull() | (F.col("_i") >= FORECAST_DAYS), 0.0)
               .when(F.col("hazard") == "flood", fn.flood_anomaly(F.col("precip"), F.col("soil")))
               .when(F.col("hazard") == "cyclone", fn.cyclone_anomaly(F.col("wind"), F.col("sst"), F.col("coastal")))
               .otherwise(fn.quake_anomaly(F.col("max_magnitude"))))
    seasonal = fn.seasonal_factor(F.col("monthly_share"), F.month("date"))
    rows = rows.withColumns({"anomaly": anomaly, "seasonal_factor": seasonal})
    score = fn.outlook_score(F.col("frequency"), F.col("seasonal_factor"), F.col("anomaly"), F.col("geography"))
    return rows.select("region", "hazard", (F.col("_i") + 1).cast("long").alias("day"), "date", "frequency",
                       "seasonal_factor", "anomaly", "geography", score.alias("score"))


def peak_scores(scores: DataFrame) -> DataFrame:
    """The highest day of each region and hazard with that day's factors; the earliest on a tie."""
    row = F.struct("score", "day", "date", "seasonal_factor", "anomaly")
    best = scores.groupBy("region", "hazard").agg(F.max_by(row, F.struct("score", -F.col("day"))).alias("_b"))
    return best.select("region", "hazard", "_b.*").withColumn("level", fn.outlook_level(F.col("score")))


def reduce_forecast(hourly: DataFrame, key: str, now: Column) -> DataFrame:
    """Last 24 hours of rain and the current soil moisture of each place."""
    past = hourly.filter(F.col("time") <= now)
    latest = past.groupBy(key).agg(F.max("time").alias("_last"), F.max_by("soil", "time").alias("soil_now"))
    return past.join(latest, key).groupBy(key).agg(
        F.coalesce(F.sum(F.when(F.col("time") > F.col("_last") - F.expr("INTERVAL 24 HOURS"), F.col("rain"))), F.lit(0.0))
        .alias("precip_24h"), F.first("soil_now").alias("soil_now"))


def daily_soil(hourly: DataFrame, key: str, today: Column) -> DataFrame:
    """Mean soil moisture of each place and day from today on."""
    return hourly.filter(F.to_date("time") >= today).groupBy(key, F.to_date("time").alias("date")).agg(
        F.avg("soil").alias("soil"))


def season_normal(daily: DataFrame, key: str, day_of_year: int, value: str) -> DataFrame:
    """Mean for this time of year, three days either side, across the turn of the year."""
    gap = F.abs(F.dayofyear("day") - day_of_year)
    return daily.filter(F.least(gap, 365 - gap) <= 3).groupBy(key).agg(F.avg(value).alias("normal"))


def indicators(readings: DataFrame, key: str) -> DataFrame:
    """Six early-warning rows per place with their status; sea temperature only counts on a coast."""
    rows = readings.select(key, "coastal", F.explode(F.array(*[
        F.struct(F.lit(name).alias("indicator"), F.col(name).cast("double").alias("value"), F.lit(threshold).alias("threshold"))
        for name, threshold in INDICATORS])).alias("x")).select(key, "coastal", "x.*")
    inland = (F.col("indicator") == "sst") & ~F.col("coastal")
    return rows.withColumn("status", F.when(inland, "na").otherwise(
        fn.indicator_status(F.col("value"), F.col("threshold")))).withColumn(
        "value", F.when(~inland, F.col("value"))).drop("coastal")


def place_with_fallback(asked: DataFrame, gazetteer: DataFrame, centres: DataFrame) -> DataFrame:
    """Coordinates of a place: its district, else a place of that name in the state, else the state's centre."""
    name = lambda c: F.lower(F.trim(c))
    rows = asked.withColumns({"_s": name(F.col("state")), "_d": name(F.col("district"))})
    spots = gazetteer.select(name(F.col("state")).alias("_s"), name(F.col("name")).alias("_d"), F.col("kind"),
                             F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    best = spots.groupBy("_s", "_d").agg(F.min_by(F.struct("kind", "_lat", "_lon"), F.when(
        F.col("kind") == "district", 0).otherwise(1)).alias("_hit"))
    middle = centres.select(name(F.col("state")).alias("_s"), F.col("lat").alias("_clat"), F.col("lon").alias("_clon"))
    out = rows.join(best, ["_s", "_d"], "left").join(middle, "_s", "left")
    source = (F.when(F.col("_hit.kind") == "district", "district").when(F.col("_hit").isNotNull(), "place in state")
              .when(F.col("_clat").isNotNull(), "state centre").otherwise("unknown"))
    return out.select(*asked.columns, F.coalesce("_hit._lat", "_clat").alias("lat"),
                      F.coalesce("_hit._lon", "_clon").alias("lon"), source.alias("found_by"))


