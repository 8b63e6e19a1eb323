"""Dated event lists and their yearly, monthly and daily counts.

An event list has ``date``, ``rank`` and ``label`` and, where known, ``lat`` and ``lon``.
Counting always happens before anything is ordered, so the windows and joins below only
see one line per day, month or year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.geo import degree_cell
from tidewatch.functions.scales import decade_of, saffir_simpson

# Disaster names in the full event export, days and labels listed, thinning cell.
EXPORT_TYPES = {"earthquake": "Earthquake", "flood": "Flood", "cyclone": "Storm"}
EXPORT_COLUMNS = ["Disaster Type", "Start Year", "Start Month", "Start Day"]
TOP_DAYS = 5
LABELS_LISTED = 8
TROPICAL_STORM_KT = 34
FIRST_SEASON = 1980


# ── catalogues ──────────────────────────────────────────────────────────────


def clean_quakes(pages: DataFrame, last_year: int, minimum: float = 6.0) -> DataFrame:
    """Catalogue pages to one line per strong earthquake.

    The pages repeat events at their edges. Filters run before the repeats are removed,
    and the removal is an aggregate with a map-side part.
    """
    kept = pages.filter((F.col("type") == "earthquake") & (F.bround("magnitude", 2) >= minimum))
    fields = [c for c in pages.columns if c not in ("id", "type")]
    one = kept.groupBy("id").agg(F.min(F.struct(*fields)).alias("x")).select("id", "x.*")
    out = one.withColumns({
        "latitude": F.bround("latitude", 3), "longitude": F.bround("longitude", 3),
        "depth_km": F.bround("depth_km", 1), "magnitude": F.bround("magnitude", 2),
        "place": F.coalesce("place", F.lit("")),
        "year": F.year("event_date").cast("long"), "month": F.month("event_date").cast("long"),
    }).withColumn("decade", decade_of(F.col("year")))
    return out.filter(F.col("year") <= last_year)


def reduce_storms(points: DataFrame, last_year: int) -> DataFrame:
    """Track points to one line per storm that reached tropical-storm strength.

    The one-minute wind counts if the storm has it at any point, else the other agency's
    wind. Both candidates are reduced side by side in one aggregate and the choice is made
    on the result, so a storm's points are never gathered. The peak is the earliest point
    with the highest wind.
    """
    main = points.filter(F.lower("track_type") == "main")
    place = F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon"))

    def peak_place(wind: str) -> Column:
        order = F.struct(F.col(wind).alias("w"), -F.unix_micros("iso_time"), -F.col("point_seq"))
        return F.max_by(F.when(F.col(wind).isNotNull(), place), F.when(F.col(wind).isNotNull(), order))

    first = F.struct("iso_time", "point_seq")
    storms = main.groupBy("sid").agg(
        F.max("usa_wind").alias("usa_wind"), F.max("wmo_wind").alias("wmo_wind"),
        peak_place("usa_wind").alias("usa_at"), peak_place("wmo_wind").alias("wmo_at"),
        F.min("usa_pres").alias("usa_pres"), F.min("wmo_pres").alias("wmo_pres"),
        F.min("iso_time").alias("first_time"), F.min_by("name", first).alias("name"),
        F.min_by("season", first).alias("season"), F.mode("basin", True).alias("basin"),
        F.bool_or(F.col("dist2land") == 0).alias("landfall"))
    usa = F.col("usa_wind").isNotNull()
    at = F.when(usa, F.col("usa_at")).otherwise(F.col("wmo_at"))
    wind = F.coalesce("usa_wind", "wmo_wind")
    return storms.filter((wind >= TROPICAL_STORM_KT) & F.col("season").between(FIRST_SEASON, last_year)).select(
        "sid", F.when(F.col("name") == "NOT_NAMED", "Unnamed").otherwise(F.initcap("name")).alias("name"), "season",
        F.coalesce("basin", F.lit("")).alias("basin"), F.to_date("first_time").alias("genesis_date"),
        F.month("first_time").cast("long").alias("month"), F.year("first_time").cast("long").alias("year"),
        F.bround(at["lat"], 2).alias("lmi_latitude"), F.bround(at["lon"], 2).alias("lmi_longitude"),
        F.rint(wind).cast("long").alias("max_wind_kt"),
        F.when(usa & F.col("usa_pres").isNotNull(), F.col("usa_pres")).otherwise(F.col("wmo_pres"))
        .alias("min_pressure_mb"),
        F.when(usa, "usa_1min").otherwise("wmo").alias("wind_source"),
        F.when(usa, saffir_simpson(wind)).otherwise(F.lit(0)).cast("long").alias("category"), "landfall",
        decade_of(F.col("season")).alias("decade"))


def strong_points(quakes: DataFrame, storms: DataFrame) -> DataFrame:
    """Map points: quakes of magnitude 7 and storms of category 3 and above."""
    big = quakes.filter("magnitude >= 7").select(
        F.lit("earthquake").alias("type"), F.col("id"), "latitude", "longitude",
        F.col("magnitude").alias("value"), "year", F.coalesce("place", F.lit("")).alias("title"))
    major = storms.filter("category >= 3").select(
        F.lit("cyclone").alias("type"), F.col("sid").alias("id"), F.col("lmi_latitude").alias("latitude"),
        F.col("lmi_longitude").alias("longitude"), F.col("max_wind_kt").cast("double").alias("value"),
        F.col("season").alias("year"), F.format_string("%s (%d), category %d", "name", "season", "category")
        .alias("title"))
    return big.unionByName(major)


def point_layer(quakes: DataFrame, storms: DataFrame, decade: int, first_season: int = FIRST_SEASON) -> DataFrame:
    """Every catalogue point of one decade, and whether the source covers that decade."""
    q = quakes.filter(F.col("decade") == decade).select(
        F.lit("earthquake").alias("type"), "id", "latitude", "longitude", "year",
        F.coalesce(F.nullif("place", F.lit("")), F.lit("Unknown location")).alias("title"),
        F.col("magnitude").alias("value"), F.lit(True).alias("available"))
    s = storms.filter(F.col("decade") == decade).select(
        F.lit("cyclone").alias("type"), F.col("sid").alias("id"), F.col("lmi_latitude").alias("latitude"),
        F.col("lmi_longitude").alias("longitude"), F.col("season").alias("year"),
        F.format_string("%s (%s basin)", "name", "basin").alias("title"),
        F.col("max_wind_kt").cast("double").alias("value"), F.lit(decade + 9 >= first_season).alias("available"))
    return q.unionByName(s)


def counts_by_decade(quakes: DataFrame) -> DataFrame:
    return quakes.groupBy("decade").agg(F.count("*").alias("m6"), F.count_if(F.col("magnitude") >= 7).alias("m7"))


def beside_disasters(frequency: DataFrame, decades: DataFrame) -> DataFrame:
    """Recorded disasters by decade with the catalogue's counts beside them, 0 where it has none."""
    return frequency.join(decades, "decade", "left").fillna(0, subset=["m6", "m7"])


# ── event lists ─────────────────────────────────────────────────────────────


def quake_events(quakes: DataFrame) -> DataFrame:
    place = F.coalesce("place", F.lit("unknown place"))
    return quakes.select(
        F.col("event_date").alias("date"), F.col("magnitude").alias("rank"), F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.concat(F.lit("M"), F.format_string("%.1f", "magnitude"), F.lit(" "), place).alias("label"))


def storm_events(storms: DataFrame) -> DataFrame:
    name = F.initcap(F.coalesce("name", F.lit("UNNAMED")))
    return storms.select(
        F.col("genesis_date").alias("date"), F.col("max_wind_kt").cast("double").alias("rank"),
        F.concat(name, F.lit(" ("), F.col("max_wind_kt").cast("string"), F.lit(" kt peak)")).alias("label"))


def inventory_events(inventory: DataFrame, prefix: str = "UEI-IMD-FL-") -> DataFrame:
    where = F.coalesce(F.nullif("state", F.lit("")), F.lit("India"))
    short = F.replace("uei", F.lit(prefix), F.lit("IFI "))
    return inventory.select(
        F.col("start").alias("date"), F.coalesce("deaths", F.lit(0.0)).alias("rank"),
        F.concat(where, F.lit(" ("), short, F.lit(")")).alias("label"))


def export_rows(frame: DataFrame, type_id: str) -> DataFrame:
    """Rows of one hazard in the full event export; storms only where they are tropical cyclones."""
    missing = sorted(set(EXPORT_COLUMNS) - set(frame.columns))
    if missing:
        raise ValueError(f"the event export lacks columns: {', '.join(missing)}")
    part = frame.filter(F.col("Disaster Type") == EXPORT_TYPES[type_id])
    if type_id == "cyclone" and "Disaster Subtype" in frame.columns:
        part = part.filter(F.coalesce("Disaster Subtype", F.lit("")).ilike("%tropical cyclone%"))
    number = {c: F.expr(f"try_cast(`{c}` AS INT)") for c in EXPORT_COLUMNS[1:]}
    year, month, day = (number[c] for c in EXPORT_COLUMNS[1:])
    deaths = F.expr("try_cast(`Total Deaths` AS DOUBLE)") if "Total Deaths" in frame.columns else F.lit(None)
    country = F.col("Country") if "Country" in frame.columns else F.lit("")

    def made(d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", year.cast("string"), month.cast("string"), d.cast("string")), "y-M-d")

    return part.select(
        F.when(year.isNotNull() & month.isNotNull(), made(F.lit(1))).alias("month_date"),
        F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), made(day)).alias("day_date"),
        F.coalesce(deaths, F.lit(0.0)).alias("rank"), country.alias("label"))


def export_events(frame: DataFrame, type_id: str, view: str) -> DataFrame:
    """Dated events for the ``monthly`` or the ``daily`` view."""
    rows = export_rows(frame, type_id)
    if view == "monthly":
        return rows.filter(F.col("month_date").isNotNull()).select(
            F.col("month_date").alias("date"), F.lit(0.0).alias("rank"), "label")
    return rows.filter(F.col("day_date").isNotNull()).select(F.col("day_date").alias("date"), "rank", "label")


def export_drops(frame: DataFrame, type_id: str) -> DataFrame:
    """How many records each view leaves out for want of a month or a day."""
    return export_rows(frame, type_id).agg(
        F.count("*").alias("records"), F.count_if(F.col("month_date").isNull()).alias("dropped_monthly"),
        F.count_if(F.col("day_date").isNull()).alias("dropped_daily"))


def within_years(events: DataFrame, first: int, last: int) -> DataFrame:
    """Events of a period, as a plain date range that a scan can push down."""
    return events.filter(F.col("date").between(F.make_date(F.lit(first), F.lit(1), F.lit(1)),
                                               F.make_date(F.lit(last), F.lit(12), F.lit(31))))


def complete_through(events: DataFrame, last_year: int) -> DataFrame:
    """One row: the last year covered; a final year that stops before December is left out."""
    latest = F.max("date")
    short = (F.year(latest) == last_year) & (latest < F.make_date(F.lit(last_year), F.lit(12), F.lit(1)))
    return events.agg(F.when(short, F.lit(last_year - 1)).otherwise(F.lit(last_year)).cast("long").alias("last_year"))


def decluster(events: DataFrame, size: int = 5) -> DataFrame:
    """The largest event of each day and cell; ties go to the smaller label."""
    cell = degree_cell(F.col("lat"), F.col("lon"), size)
    kept = events.withColumn("cell", cell).groupBy("date", "cell").agg(
        F.min_by(F.struct("rank", "label", "lat", "lon"), F.struct(-F.col("rank"), "label", "lat", "lon")).alias("x"))
    return kept.select("date", "cell", "x.*")


# ── counts ──────────────────────────────────────────────────────────────────


def yearly_series(events: DataFrame) -> DataFrame:
    """Events of every year between the first and the last, 0 where there were none."""
    counts = events.groupBy(F.year("date").cast("long").alias("year")).agg(F.count("*").alias("count"))
    span = counts.agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return span.join(counts, "year", "left").fillna(0, subset=["count"])


def month_matrix(events: DataFrame, first: int, last: int) -> DataFrame:
    """Year x month counts, every cell of the period shown."""
    counts = within_years(events, first, last).groupBy(
        F.year("date").cast("long").alias("year"), F.month("date").cast("long").alias("month")).agg(
        F.count("*").alias("count"))
    grid = events.sparkSession.range(first, last + 1).select(
        F.col("id").alias("year"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("month"))
    return grid.join(counts, ["year", "month"], "left").fillna(0, subset=["count"])


def month_averages(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("month").agg(
        F.sum("count").alias("total"), F.bround(F.sum("count") / F.countDistinct("year"), 3).alias("average"))


def busiest_months(matrix: DataFrame) -> DataFrame:
    """Busiest month on record, and busiest calendar month with its share; earlier wins a tie."""
    record = matrix.agg(F.max_by(F.struct("year", "month", "count"),
                                 F.struct("count", -F.col("year"), -F.col("month"))).alias("r"))
    by_month = matrix.groupBy("month").agg(F.sum("count").alias("n"))
    calendar = by_month.agg(F.max_by("month", F.struct("n", -F.col("month"))).alias("calendar_month"),
                            F.max("n").alias("calendar_total"), F.sum("n").alias("total"))
    one = F.lit(1).alias("_k")
    return record.select(one, "r.year", "r.month", "r.count").join(calendar.select(one, "*"), "_k").select(
        "year", "month", "count", "calendar_month", "calendar_total",
        F.bround(F.try_divide("calendar_total", "total"), 4).alias("calendar_share"))


def day_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("date").agg(F.count("*").alias("count"))


def day_statistics(events: DataFrame, first: int, last: int) -> DataFrame:
    """Days in the period, days with an event, their share and the mean per day."""
    days = F.datediff(F.make_date(F.lit(last), F.lit(12), F.lit(31)), F.make_date(F.lit(first), F.lit(1), F.lit(1))) + 1
    return day_counts(within_years(events, first, last)).agg(
        days.cast("long").alias("period_days"), F.count("*").alias("days_with_event"),
        F.bround(F.count("*") / days, 4).alias("share_days_with_event"),
        F.bround(F.coalesce(F.sum("count"), F.lit(0)) / days, 4).alias("average_per_day"))


def top_days(events: DataFrame, n: int = TOP_DAYS, listed: int = LABELS_LISTED) -> DataFrame:
    """The busiest days with their highest ranked labels and how many more there were.

    Labels are only looked at on the chosen days, and there a ranked window keeps just the
    first few of each day, so one huge day is not gathered in a list.
    """
    days = day_counts(events).orderBy(F.desc("count"), "date").limit(n)
    order = W.partitionBy("date").orderBy(F.desc("rank"), "label")
    first = (events.select("date", "rank", "label").join(days, "date")
             .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= listed))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"])
    return first.groupBy("date", "count").agg(labels.alias("events")).withColumn(
        "more", F.greatest(F.col("count") - listed, F.lit(0)))


def day_of_year_counts(events: DataFrame) -> DataFrame:
    """Events by place in a leap year, so that 29 February has its own slot; all 366 shown."""
    slot = F.dayofyear(F.make_date(F.lit(2000), F.month("date"), F.dayofmonth("date"))).cast("long")
    counts = day_counts(events).groupBy(slot.alias("slot")).agg(F.sum("count").alias("count"))
    slots = events.sparkSession.range(1, 367).select(F.col("id").alias("slot"))
    return slots.join(counts, "slot", "left").fillna(0, subset=["count"])


def year_day_lists(events: DataFrame) -> DataFrame:
    """Per year, the (day of year, count) pairs in order; a year has 366 of them at most."""
    pairs = F.array_sort(F.collect_list(F.struct(F.dayofyear("date").cast("long").alias("day"), "count")))
    return day_counts(events).groupBy(F.year("date").cast("long").alias("year")).agg(pairs.alias("days"))


def calendar_position(days: DataFrame, date: str = "date") -> DataFrame:
    """Column (week) and row (Monday first) of each day on a calendar of its year."""
    lead = F.weekday(F.trunc(date, "year"))
    return days.withColumns({"week": F.floor((lead + F.dayofyear(date) - 1) / 7).cast("long"),
                             "weekday": F.weekday(date).cast("long")})
