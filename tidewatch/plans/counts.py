"""Event counts of a hazard type from the best dated source at hand.

The source is chosen before any event is counted: the full export if there is one, else the
catalogue of the type, else the national inventory, else none, with the reason. One aggregate
over the chosen source measures what it covers, and the counts then read only that period.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import events, stats
from tidewatch.operators.impact import TREND_FROM

# Period of the national flood inventory, years from which sources are held complete, texts.
INVENTORY_YEARS = (1967, 2023)
QUAKES_COMPLETE_FROM, DISASTERS_COMPLETE_FROM = 1973, 1980
EXPORT_UNIT, FLOOD_UNIT = "EM-DAT disasters", "flood events, each counted once on its start date"
QUAKE_UNIT, STORM_UNIT = "earthquakes of magnitude 6.0 or larger", "tropical cyclones, dated by genesis"
WORLD, INDIA = "worldwide", "India only"
NO_DATES = ("This source has no event dates: the India Flood Inventory file is missing, and EM-DAT (via Our World in Data) "
            "gives flood counts by country and year only.")
EMPTY = "No dated events in this source."
FLOOD_NOTE = ("India only. IFI records many more events in recent years (600 to 1,100 a year since 2022 against a few dozen "
              "a year before 1990), so its counts reflect reporting as much as floods, and no trend is claimed.")
CHOICE = ("type string, source string, available boolean, scope string, unit string, first_year long, last_year long, "
          "records long, dropped_monthly long, dropped_daily long, reason string, note string")


@dataclass(frozen=True)
class Choice:
    """What was chosen for a type: the source, its period and, where there is one, its events by view."""

    type_id: str
    source: str | None
    scope: str | None = None
    unit: str | None = None
    first_year: int | None = None
    last_year: int | None = None
    records: int = 0
    dropped_monthly: int = 0
    dropped_daily: int = 0
    reason: str | None = None
    note: str | None = None
    monthly: DataFrame | None = None
    daily: DataFrame | None = None

    @property
    def available(self) -> bool:
        return self.reason is None

    def row(self, spark: SparkSession) -> DataFrame:
        """The choice as a table of one row."""
        values = (self.type_id, self.source, self.available, self.scope, self.unit, self.first_year, self.last_year,
                  self.records, self.dropped_monthly, self.dropped_daily, self.reason, self.note)
        return spark.createDataFrame([values], CHOICE)


def _covered(listed: DataFrame, first_year: int, last_year: int) -> tuple[int | None, int, int, str | None]:
    """First year, events of the period, events of its last year and the last day of a source, in one aggregate."""
    year = F.year("date")
    found = listed.agg(F.min(year).alias("first"), F.count_if(year.between(first_year, last_year)).alias("n"),
                       F.count_if(year == last_year).alias("late"), F.max("date").cast("string").alias("day")).first()
    return found["first"], found["n"], found["late"], found["day"]


def catalogue_choice(type_id: str, last_year: int, quakes: DataFrame | None = None, storms: DataFrame | None = None,
                     inventory: DataFrame | None = None) -> Choice:
    """The physical record of a type, ended before a final year that it does not cover through December."""
    if type_id == "earthquake" and quakes is not None:
        listed, source, scope, unit = events.quake_events(quakes), "usgs", WORLD, QUAKE_UNIT
    elif type_id == "cyclone" and storms is not None:
        listed, source, scope, unit = events.storm_events(storms), "ibtracs", WORLD, STORM_UNIT
    elif type_id == "flood" and inventory is not None:
        listed, source, scope, unit = events.inventory_events(inventory), "ifi", INDIA, FLOOD_UNIT
    else:
        return Choice(type_id, None, reason=NO_DATES)
    span = INVENTORY_YEARS if type_id == "flood" else (0, last_year)
    first, n, late, day = _covered(listed, *span)
    end, note = last_year, None
    if type_id == "flood":
        first, end, note = *INVENTORY_YEARS, FLOOD_NOTE
    elif type_id == "cyclone" and n and day[:4] == str(last_year) and day < f"{last_year}-12-01":
        end, n = last_year - 1, n - late
        note = (f"{last_year} is left out: the IBTrACS record ends on {day} and holds only {late} storms for {last_year}, "
                "so counting it would understate the year.")
    if not n:
        return Choice(type_id, source, scope, unit, reason=EMPTY, note=note)
    kept = events.within_years(listed, first, end)
    return Choice(type_id, source, scope, unit, first, end, n, note=note, monthly=kept, daily=kept)


def choose(type_id: str, last_year: int, quakes: DataFrame | None = None, storms: DataFrame | None = None,
           inventory: DataFrame | None = None, export: DataFrame | None = None) -> Choice:
    """The source of a type's months and days."""
    if export is None:
        return catalogue_choice(type_id, last_year, quakes, storms, inventory)
    rows = events.export_rows(export, type_id)
    found = rows.agg(F.count("*").alias("records"), F.count("month_date").alias("monthly"), F.count("day_date").alias("daily"),
                     F.min(F.year("month_date")).alias("first")).first()
    shared = dict(type_id=type_id, source="emdat_public", scope=WORLD, unit=EXPORT_UNIT, records=found["records"],
                  dropped_monthly=found["records"] - found["monthly"], dropped_daily=found["records"] - found["daily"])
    if not found["monthly"]:
        return Choice(**shared, reason=EMPTY)
    first = found["first"]
    views = {view: events.within_years(events.export_events(export, type_id, view), first, last_year)
             for view in ("monthly", "daily")}
    return Choice(**shared, first_year=first, last_year=last_year, **views)


def _series(name: str, kind: str, yearly: DataFrame, complete_from: int | None) -> tuple[DataFrame, DataFrame]:
    rows = yearly.select(F.lit(name).alias("series"), "year", "count")
    trend = stats.trend_verdicts(rows.filter(F.col("year") >= TREND_FROM), ["series"], "year", "count")
    facts = rows.groupBy("series").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"),
                                       F.sum("count").alias("n_events"))
    facts = facts.select("series", F.lit(kind).alias("kind"), "first_year", "last_year", "n_events",
                         F.lit(complete_from).cast("long").alias("poor_before"))
    return rows, facts.join(trend.select("series", "direction", "spearman_rho", "p_value", "slope_per_year"), "series", "left")


def _dense(yearly: DataFrame) -> DataFrame:
    """Every year between the first and the last of ``(year, count)``, 0 where there was none."""
    span = yearly.agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return span.join(yearly, "year", "left").fillna(0, subset=["count"])


def event_counts(type_id: str, world: DataFrame, last_year: int, quakes: DataFrame | None = None,
                 storms: DataFrame | None = None, inventory: DataFrame | None = None,
                 export: DataFrame | None = None) -> tuple[Choice, dict[str, DataFrame]]:
    """The choice for a type, and its yearly, monthly and daily counts as lazy tables by name.

    ``yearly`` and ``series`` set recorded disasters beside the physical events of a quake or storm
    catalogue. ``matrix``, ``month_averages``, ``busiest``, ``days``, ``top_days``,
    ``day_of_year`` and ``year_days`` come from the chosen source and are absent if none has dates. A
    quake catalogue also gives ``thinned_days`` and ``thinned_top_days``, with one quake for each day and cell.
    """
    recorded = world.filter(F.col("type") == type_id).groupBy("year").agg(F.sum("n_events").alias("count"))
    lines = [_series("emdat", "disaster", _dense(recorded), DISASTERS_COMPLETE_FROM)]
    catalogue = catalogue_choice(type_id, last_year, quakes, storms, inventory)
    chosen = catalogue if export is None else choose(type_id, last_year, export=export)
    if type_id != "flood" and catalogue.available:
        since = QUAKES_COMPLETE_FROM if type_id == "earthquake" else None
        lines.insert(0, _series("physical", "physical", events.yearly_series(catalogue.daily), since))
    out = dict(zip(("yearly", "series"), lines[0], strict=True))
    for rows, facts in lines[1:]:
        out = {"yearly": out["yearly"].unionByName(rows), "series": out["series"].unionByName(facts)}
    if not chosen.available:
        return chosen, out
    span = (chosen.first_year, chosen.last_year)
    matrix = events.month_matrix(chosen.monthly, *span)
    out |= {"matrix": matrix, "month_averages": events.month_averages(matrix), "busiest": events.busiest_months(matrix)}
    if chosen.dropped_daily < chosen.records:
        out |= {"days": events.day_statistics(chosen.daily, *span), "top_days": events.top_days(chosen.daily),
                "day_of_year": events.day_of_year_counts(chosen.daily), "year_days": events.year_day_lists(chosen.daily)}
    if chosen.source == "usgs":
        thinned = events.decluster(chosen.daily)
        out |= {"thinned_days": events.day_statistics(thinned, *span), "thinned_top_days": events.top_days(thinned)}
    return chosen, out
