"""Country-year impact records: cleaning, derived figures and the history blocks.

Records are one line per country, year and type, so every table below the first
aggregation is bounded by countries x years x types and not by the raw input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.scales import decade_of, guarded_ratio, pct_change, safe_ratio
from tidewatch.operators.ranking import exact_quantile

# Hazard types, metrics, severity weights, first year of trends.
TYPES = ["earthquake", "flood", "cyclone"]
PEOPLE = ["deaths", "injured", "affected", "homeless", "total_affected"]
MONEY = ["damages_usd", "insured_usd", "reconstruction_usd",
         "damages_nominal_usd", "insured_nominal_usd", "reconstruction_nominal_usd"]
IMPACT = ["deaths", "injured", "affected", "homeless", "total_affected", "damages_usd"]
SEVERITY_WEIGHTS = {"deaths": 0.5, "total_affected": 0.25, "damages_usd": 0.25}
TREND_FROM = 1980
AGGREGATE_PREFIX = "OWID_"
HISTORICAL_STATES = ["OWID_CZS", "OWID_GDR", "OWID_GFR", "OWID_SRM", "OWID_USS",
                     "OWID_YAR", "OWID_YPR", "OWID_YGS", "ANT"]
CODE_ALIASES = {"PSE": "PSX", "SSD": "SDS"}
METRIC_COLUMNS = {
    "deaths": "deaths", "injured": "injured", "affected": "affected", "homeless": "homeless",
    "total_affected": "total_affected", "damages_usd": "total_damages_adjusted",
    "insured_usd": "insured_damages_adjusted", "reconstruction_usd": "reconstruction_costs_adjusted",
    "damages_pct_gdp": "total_damages_pct_gdp", "damages_nominal_usd": "total_damages",
    "insured_nominal_usd": "insured_damages", "reconstruction_nominal_usd": "reconstruction_costs",
}
TYPE_SUFFIX = {"earthquake": "earthquake", "flood": "flood", "cyclone": "storm"}
EVENT_ENTITY = {"Earthquake": "earthquake", "Flood": "flood", "Extreme weather": "cyclone"}


def total(column: str | Column) -> Column:
    """Sum that is 0 over nothing."""
    return F.coalesce(F.sum(column), F.lit(0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# ── cleaning ────────────────────────────────────────────────────────────────


def last_complete_year(df: DataFrame, today_year: int, column: str = "year") -> DataFrame:
    """One row: the latest year that is over, as the running year is always partial."""
    return df.agg(F.least(F.max(column), F.lit(today_year - 1)).cast("long").alias("last_year"))


def entity_kinds(codes: DataFrame) -> DataFrame:
    """Entity and code with its kind; one row per entity."""
    kind = (F.when(F.col("code").isin(HISTORICAL_STATES), "historical_state")
            .when(F.col("code").startswith(AGGREGATE_PREFIX), "aggregate").otherwise("country"))
    first = codes.groupBy(F.col("entity").alias("country")).agg(F.min("code").alias("code"))
    return first.select("country", F.col("code").alias("iso3"), kind.alias("kind"))


def replace_codes(df: DataFrame, column: str, aliases: dict[str, str] = CODE_ALIASES,
                  back: bool = False) -> DataFrame:
    pairs = {new: old for old, new in aliases.items()} if back else aliases
    return df.replace(pairs, subset=[column])


def unknown_entities(wide: DataFrame, codes: DataFrame) -> DataFrame:
    """Entities without a code; the build must stop when there are any."""
    return wide.select("country").distinct().join(codes, "country", "left_anti")


def wide_to_records(wide: DataFrame, codes: DataFrame, last_year: int,
                    suffixes: dict[str, str] = TYPE_SUFFIX,
                    metrics: dict[str, str] = METRIC_COLUMNS) -> DataFrame:
    """One line per country, year and type out of ``<metric>_<type>`` columns.

    A single pass explodes each wide row into one struct per type. Rows where nothing was
    reported and rows of aggregates (world, income groups) are left out.
    """
    needed = {f"{stem}_{suffix}" for suffix in suffixes.values() for stem in metrics.values()}
    missing = sorted(needed - set(wide.columns))
    if missing:
        raise ValueError(f"the wide table lacks columns {missing}")
    per_type = F.explode(F.array(*[
        F.struct(F.lit(type_id).alias("type"),
                 *[F.col(f"{stem}_{suffix}").cast("double").alias(name) for name, stem in metrics.items()])
        for type_id, suffix in suffixes.items()]))
    impact = [name for name in IMPACT if name in metrics]
    long = (wide.filter(F.col("year") <= last_year)
            .select("country", F.col("year").cast("long").alias("year"), per_type.alias("m"))
            .select("country", "year", "m.*")
            .filter(any_of([F.coalesce(F.col(name), F.lit(0.0)) > 0 for name in impact]))
            .join(codes, "country")
            .filter(F.col("kind") != "aggregate"))
    return fill_records(long).withColumn("historical_state", F.col("kind") == "historical_state").drop("kind")


def fill_records(df: DataFrame) -> DataFrame:
    """Unreported counts and money become 0; counts are rounded half to even."""
    have = set(df.columns)
    people = {c: F.rint(F.coalesce(F.col(c), F.lit(0))).cast("long") for c in PEOPLE if c in have}
    money = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in MONEY if c in have}
    return df.withColumns({**people, **money, "decade": decade_of(F.col("year"))})


def add_derived(df: DataFrame) -> DataFrame:
    """Fatality rate and loss per affected person, only where both figures were reported."""
    return df.withColumns({
        "fatality_rate_pct": guarded_ratio(F.col("deaths"), F.col("total_affected"), 100.0),
        "loss_per_affected_usd": guarded_ratio(F.col("damages_usd"), F.col("total_affected")),
    })


def event_totals(events: DataFrame, last_year: int) -> DataFrame:
    """World event counts by type and year from entity-named rows."""
    type_of = F.create_map(*[F.lit(x) for pair in EVENT_ENTITY.items() for x in pair])
    return (events.withColumn("type", type_of[F.col("entity")])
            .filter(F.col("type").isNotNull() & (F.col("year") <= last_year))
            .select("type", F.col("year").cast("long").alias("year"), F.col("n_events").cast("long").alias("n_events")))


def dense_years(spark, first: int, last: int, types: list[str] = TYPES) -> DataFrame:
    """Every type and year of a period."""
    return spark.createDataFrame([(t,) for t in types], "type string").select(
        "type", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("year"))


def world_grid(world: DataFrame, first: int, last: int, types: list[str] = TYPES) -> DataFrame:
    """World totals on a dense type x year grid, 0 where nothing was recorded."""
    numeric = [c for c in world.columns if c not in ("type", "year", "decade")]
    grid = dense_years(world.sparkSession, first, last, types).join(world.drop("decade"), ["type", "year"], "left")
    return grid.fillna(0, subset=numeric).withColumn("decade", decade_of(F.col("year")))


# ── currency ────────────────────────────────────────────────────────────────


def nearest_year_rates(fx: DataFrame) -> DataFrame:
    """For every year of the table's span, the rate of the closest table year; the earlier one on a tie.

    Each table year owns the years up to the middle between it and its neighbours, so the
    nearest-key join becomes a plain equi join on the year.
    """
    by_year = W.partitionBy(F.lit("INR")).orderBy("year")  # a rate table has one line per year
    owned = F.sequence(
        F.coalesce(F.floor((F.lag("year").over(by_year) + F.col("year")) / 2) + 1, F.col("year")).cast("long"),
        F.coalesce(F.floor((F.col("year") + F.lead("year").over(by_year)) / 2), F.col("year")).cast("long"))
    return (fx.dropna().select("inr_per_usd", F.col("year").alias("rate_year"), owned.alias("owned"))
            .select(F.explode("owned").alias("year"), "inr_per_usd", "rate_year"))


def join_rates(df: DataFrame, fx: DataFrame) -> DataFrame:
    """``inr_per_usd`` and ``rate_year`` for the year of each line; outside the table's span those of its first or last year."""
    rates = nearest_year_rates(fx).withColumnRenamed("year", "_near")
    ends = fx.dropna()
    near = F.least(F.greatest(F.col("year"), ends.agg(F.min("year")).scalar()), ends.agg(F.max("year")).scalar())
    near = F.when(F.col("year").isNotNull(), near).cast("long")
    return df.withColumn("_near", near).join(rates, "_near", "left").drop("_near")


def add_inr(df: DataFrame, fx: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Money in rupees at each line's own year, and whether any rate was an estimate."""
    usd = {name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in pairs}
    estimated = (F.col("rate_year") != F.col("year")) & any_of([value > 0 for value in usd.values()])
    return (join_rates(df, fx)
            .withColumns({**{inr: usd[name] * F.col("inr_per_usd") for name, inr in pairs.items()},
                          "fx_estimated": estimated})
            .drop("inr_per_usd", "rate_year"))


def rate_map(fx: DataFrame) -> DataFrame:
    """The rate table as one year-to-rate map with its first and last year."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("year", F.bround("inr_per_usd", 4).alias("rate")))))
    return fx.dropna().agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), entries.alias("rates"))


# ── severity ────────────────────────────────────────────────────────────────


def _logged(metric: str) -> Column:
    return F.log10(F.greatest(F.col(metric), F.lit(0)).cast("double") + 1)


def severity_scores(df: DataFrame, scope: list[str], name: str) -> DataFrame:
    """0-100 severity within each scope (no scope columns: the whole table).

    Only the minimum and maximum of each scope are needed. They are aggregated and joined
    back, so no window ever has to hold a scope in one task. The table is read twice: hand
    in stored records, not the raw input behind them.
    """
    keys = scope or ["_all"]
    base = df if scope else df.withColumn("_all", F.lit(1))
    bounds = base.groupBy(*keys).agg(
        *[agg(_logged(m)).alias(f"_{side}_{m}") for m in SEVERITY_WEIGHTS
          for side, agg in (("lo", F.min), ("hi", F.max))])
    score = F.lit(0.0)
    for metric, weight in SEVERITY_WEIGHTS.items():
        low, high = F.col(f"_lo_{metric}"), F.col(f"_hi_{metric}")
        score = score + F.when(high > low, (_logged(metric) - low) / (high - low)).otherwise(F.lit(0.0)) * weight
    extra = [f"_{side}_{m}" for m in SEVERITY_WEIGHTS for side in ("lo", "hi")]
    out = base.join(bounds, keys).withColumn(name, F.bround(score * 100, 2)).drop(*extra)
    return out if scope else out.drop("_all")


def top_records(df: DataFrame, score: str, n: int = 15) -> DataFrame:
    """The ``n`` highest scores; ties are settled by type, country and year."""
    return df.orderBy(F.desc(score), "type", "country", "year").limit(n)


def top_by_metric(df: DataFrame, metrics: list[str], key: str, n: int = 10) -> DataFrame:
    """The ``n`` largest positive values of each metric as (metric, rank, key, value)."""
    long = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x"))
    ranked = long.select(key, "x.*").filter(F.col("value") > 0).withColumn(
        "rank", F.row_number().over(W.partitionBy("metric").orderBy(F.desc("value"), key)))
    return ranked.filter(F.col("rank") <= n)


# ── history blocks ──────────────────────────────────────────────────────────


def human_totals(records: DataFrame) -> DataFrame:
    """Total of each human metric and how many records report it; metrics without a total are left out."""
    wide = records.groupBy("type").agg(
        *[F.struct(total(m).cast("long").alias("value"),
                   F.count_if(F.col(m) > 0).alias("records_reporting")).alias(m) for m in PEOPLE])
    long = wide.select("type", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in PEOPLE])).alias("row"))
    return long.select("type", "row.metric", "row.x.value", "row.x.records_reporting").filter(F.col("value") > 0)


def fatality_rates(records: DataFrame) -> DataFrame:
    """Pooled and median fatality percentage over the records that report both figures."""
    both = add_derived(records).filter(F.col("fatality_rate_pct").isNotNull())
    middle = exact_quantile(both, ["type"], "fatality_rate_pct", 0.5, "median_pct")
    out = both.groupBy("type").agg(
        (F.sum("deaths") / F.sum("total_affected") * 100).alias("value_pct"), F.count("*").alias("records"))
    return out.join(middle, "type").select("type", "value_pct", "median_pct", "records")


def sums_by_decade(records: DataFrame, metrics: list[str]) -> DataFrame:
    return records.groupBy("type", "decade").agg(*[total(m).alias(m) for m in metrics])


def economic_summary(records: DataFrame) -> DataFrame:
    """Loss totals, insured shares and loss per affected person of each type."""
    both = (F.col("damages_usd") > 0) & (F.col("total_affected") > 0)
    sums = [f"{kind}_{unit}" for kind in ("damages", "insured", "reconstruction")
            for unit in ("usd", "nominal_usd", "inr")]
    out = records.groupBy("type").agg(
        *[total(c).alias(c) for c in sums],
        F.count("*").alias("records"),
        F.count_if(F.col("damages_usd") > 0).alias("records_with_damages"),
        F.count_if(F.col("insured_usd") > 0).alias("records_with_insured"),
        F.count_if(F.col("reconstruction_usd") > 0).alias("records_with_reconstruction"),
        F.count_if(F.col("fx_estimated") & (F.col("damages_nominal_usd") > 0)).alias("records_fx_estimated"),
        F.count_if(both).alias("loss_per_affected_records"),
        safe_ratio(F.sum(F.when(both, F.col("damages_usd"))), F.sum(F.when(both, F.col("total_affected"))))
        .alias("loss_per_affected_usd"),
        safe_ratio(F.sum(F.when(both, F.col("damages_inr"))), F.sum(F.when(both, F.col("total_affected"))))
        .alias("loss_per_affected_inr"),
        F.count_if(F.col("damages_pct_gdp") > 0).alias("gdp_records"))
    middle = exact_quantile(records.filter(F.col("damages_pct_gdp") > 0), ["type"], "damages_pct_gdp", 0.5, "gdp_median_pct")
    return out.join(middle, "type", "left").withColumns({"insured_share": safe_ratio(F.col("insured_usd"), F.col("damages_usd")),
                            "insured_share_inr": safe_ratio(F.col("insured_inr"), F.col("damages_inr"))})


def top_gdp_losses(records: DataFrame, n: int = 10) -> DataFrame:
    """Largest losses as a share of national output, per type."""
    order = W.partitionBy("type").orderBy(F.desc("damages_pct_gdp"), "country", "year")
    return (records.filter(F.col("damages_pct_gdp") > 0)
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n))


def decade_frequency(world: DataFrame, scope: list[str] = ["type"]) -> DataFrame:  # noqa: B006
    """Events, deaths and loss by decade with the change in yearly rate from the decade before."""
    decades = world.groupBy(*scope, "decade").agg(
        total("n_events").alias("n_events"), total("deaths").alias("deaths"),
        total("damages_usd").alias("damages_usd"), F.countDistinct("year").alias("years"))
    by_decade = W.partitionBy(*scope).orderBy("decade") if scope else W.partitionBy(F.lit(1)).orderBy("decade")
    rate = F.col("n_events") / F.col("years")
    return decades.withColumns({
        "events_per_year": rate, "complete": F.col("years") == 10,
    }).withColumn("change_pct", pct_change(F.col("events_per_year"), F.lag("events_per_year").over(by_decade)))


def year_on_year(world: DataFrame) -> DataFrame:
    """The last year's events beside the year before, per type."""
    by_year = W.partitionBy("type").orderBy("year")
    steps = world.withColumn("previous_events", F.lag("n_events").over(by_year))
    last = steps.groupBy("type").agg(F.max_by(F.struct("year", "n_events", "previous_events"), "year").alias("x"))
    return last.select("type", "x.year", F.col("x.n_events").alias("events"), "x.previous_events").withColumn(
        "change_pct", pct_change(F.col("events"), F.col("previous_events")))


def decade_on_decade(frequency: DataFrame) -> DataFrame:
    """The last complete decade beside the complete one before it, per type."""
    complete = frequency.filter("complete")
    by_decade = W.partitionBy("type").orderBy("decade")
    steps = complete.withColumns({"previous_decade": F.lag("decade").over(by_decade),
                                  "previous_events": F.lag("n_events").over(by_decade)})
    row = F.struct("decade", F.col("n_events").alias("events"), "previous_decade", "previous_events")
    last = steps.groupBy("type").agg(F.max_by(row, "decade").alias("x")).select("type", "x.*")
    return last.withColumn("change_pct", pct_change(F.col("events"), F.col("previous_events")))


def peak_decades(frequency: DataFrame) -> DataFrame:
    """Decade with the most events, deaths and loss per type; the earlier one on a tie."""
    metrics = ["n_events", "deaths", "damages_usd"]
    long = frequency.select("type", "decade", "complete", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x"))
    best = long.groupBy("type", F.col("x.metric").alias("metric")).agg(
        F.max_by(F.struct("decade", F.col("x.value").alias("value"), "complete"),
                 F.struct(F.col("x.value"), -F.col("decade"))).alias("b"))
    return best.select("type", "metric", "b.decade", "b.value", "b.complete")


def country_totals(records: DataFrame) -> DataFrame:
    """Totals of each country; a country without a code keeps its line."""
    return records.groupBy("type", "country", "iso3").agg(
        total("deaths").alias("deaths"), total("total_affected").alias("total_affected"),
        total("damages_usd").alias("damages_usd"), total("damages_inr").alias("damages_inr"),
        total("damages_nominal_usd").alias("damages_nominal_usd"),
        F.bool_or("fx_estimated").alias("fx_estimated"), F.count("*").alias("records"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.bool_or("historical_state").alias("historical_state"))


def type_comparison(records: DataFrame, world: DataFrame) -> DataFrame:
    """Types side by side: totals, countries, per-event averages and the worst record."""
    events = world.groupBy("type").agg(total("n_events").alias("events"))
    worst = F.max_by(F.struct("country", "year", "deaths"),
                     F.struct("severity_type", -F.col("year"), "country"))
    by_type = records.groupBy("type").agg(
        F.count("*").alias("records"), total("deaths").alias("deaths"),
        total("total_affected").alias("total_affected"), total("damages_usd").alias("damages_usd"),
        F.countDistinct("country").alias("countries"), worst.alias("w"))
    return by_type.join(events, "type").select(
        "type", "events", "records", "deaths", "total_affected", "damages_usd", "countries",
        safe_ratio(F.col("deaths"), F.col("events")).alias("avg_deaths_per_event"),
        safe_ratio(F.col("damages_usd"), F.col("events")).alias("avg_loss_per_event_usd"),
        F.col("w.country").alias("worst_country"), F.col("w.year").alias("worst_year"),
        F.col("w.deaths").alias("worst_deaths"))


def global_yearly(world: DataFrame) -> DataFrame:
    return world.groupBy("year").agg(
        total("n_events").alias("n_events"), total("deaths").alias("deaths"),
        total("total_affected").alias("total_affected"), total("damages_usd").alias("damages_usd"),
    ).withColumn("decade", decade_of(F.col("year")))


def reconstruction_summary(records: DataFrame) -> DataFrame:
    """Rebuilding cost, and its share of the damage on the records that report both."""
    rebuilt = F.col("reconstruction_usd") > 0
    both = rebuilt & (F.col("damages_usd") > 0)
    return records.groupBy("type").agg(
        F.count_if(rebuilt).alias("records"), F.count("*").alias("of_records"),
        total("reconstruction_inr").alias("total_inr"),
        total("reconstruction_nominal_usd").alias("total_nominal_usd"),
        F.count_if(both).alias("share_records"),
        safe_ratio(F.sum(F.when(both, F.col("reconstruction_usd"))), F.sum(F.when(both, F.col("damages_usd"))))
        .alias("share_of_damage"))


def top_reconstruction(records: DataFrame, n: int = 5) -> DataFrame:
    order = W.partitionBy("type").orderBy(F.desc("reconstruction_usd"), "country", "year")
    return (records.filter(F.col("reconstruction_usd") > 0)
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n))


def resilience_by_decade(records: DataFrame, since: int = TREND_FROM) -> DataFrame:
    """Deaths per 1,000 affected and median damage share of output, by decade."""
    last = records.groupBy("type").agg(F.max("year").alias("_last"))
    pair = (F.col("deaths") > 0) & (F.col("total_affected") > 0)
    rows = records.filter(F.col("year") >= since).groupBy("type", "decade").agg(
        F.count("*").alias("records"), F.count_if(pair).alias("records_with_both"),
        (safe_ratio(F.sum(F.when(pair, F.col("deaths"))), F.sum(F.when(pair, F.col("total_affected")))) * 1000)
        .alias("deaths_per_1000"))
    losses = records.filter((F.col("year") >= since) & (F.col("damages_pct_gdp") > 0))
    middle = exact_quantile(losses, ["type", "decade"], "damages_pct_gdp", 0.5, "median_damage_pct_gdp")
    return rows.join(middle, ["type", "decade"], "left").join(last, "type").withColumn("partial", F.col("decade") + 9 > F.col("_last")).drop("_last")


def resilience_verdict(resilience: DataFrame) -> DataFrame:
    """First against last full decade; only types with at least two."""
    full = resilience.filter(~F.col("partial") & F.col("deaths_per_1000").isNotNull())
    row = F.struct("decade", "deaths_per_1000")
    ends = full.groupBy("type").agg(F.count("*").alias("n"), F.min_by(row, "decade").alias("a"),
                                    F.max_by(row, "decade").alias("b"))
    return ends.filter(F.col("n") >= 2).select(
        "type", F.col("a.decade").alias("first_decade"), F.col("b.decade").alias("last_decade"),
        F.col("a.deaths_per_1000").alias("first"), F.col("b.deaths_per_1000").alias("last"),
        ((F.col("b.deaths_per_1000") - F.col("a.deaths_per_1000")) / F.col("a.deaths_per_1000") * 100)
        .alias("change_pct"))


def coverage_facts(records: DataFrame, since: int = TREND_FROM) -> DataFrame:
    return records.groupBy("type").agg(
        F.count("*").alias("records"), F.count_if(F.col("year") < since).alias("records_before_trend"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def decades_present(records: DataFrame) -> DataFrame:
    return records.select("decade").distinct().orderBy("decade")


def hero_stats(records: DataFrame) -> DataFrame:
    """Records, span and the one headline figure that each type is known by."""
    headline = F.when(F.col("type") == "flood", F.lit("total_affected")).otherwise(F.lit("deaths"))
    return records.groupBy("type").agg(
        F.count("*").alias("records"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        total("deaths").alias("_deaths"), total("total_affected").alias("_affected"),
    ).select("type", "records", "first_year", "last_year", headline.alias("metric"),
             F.when(F.col("type") == "flood", F.col("_affected")).otherwise(F.col("_deaths")).alias("value"))


def homeless_share(records: DataFrame, iso3: str) -> DataFrame:
    """Homeless as a share of the affected over one country's floods that report both."""
    both = records.filter((F.col("iso3") == iso3) & (F.col("type") == "flood")
                          & (F.col("homeless") > 0) & (F.col("total_affected") > 0))
    return both.agg(
        F.bround(F.coalesce(F.try_divide(F.sum("homeless"), F.sum("total_affected")), F.lit(0.0)), 4).alias("value"),
        F.count("*").alias("records"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        total("homeless").alias("homeless"), total("total_affected").alias("total_affected"))


# ── map layers and chart series ─────────────────────────────────────────────


def country_layer(scored: DataFrame, centroids: DataFrame, decade: int) -> DataFrame:
    """One point per country and type: its worst record and its totals in a decade."""
    here = scored.filter(F.col("decade") == decade).join(
        centroids.select("country", "latitude", "longitude"), "country", "left")
    worst = F.max_by(F.struct("year", "severity_type"), F.struct("severity_type", -F.col("year")))
    return (here.filter(F.col("latitude").isNotNull()).groupBy("type", "country").agg(
        F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"), worst.alias("w"),
        F.count("*").alias("records"), total("deaths").alias("deaths"),
        total("total_affected").alias("total_affected"), total("damages_usd").alias("damages_usd"))
        .select("type", "country", "latitude", "longitude", F.col("w.year").alias("year"),
                F.col("w.severity_type").alias("severity"), "records", "deaths", "total_affected", "damages_usd"))


def unmapped_countries(records: DataFrame, centroids: DataFrame) -> DataFrame:
    """Countries of the records that have no place on the map."""
    return records.select("country").distinct().join(
        centroids.filter(F.col("latitude").isNotNull()), "country", "left_anti")


def moving_average(df: DataFrame, value: str, order: str, scope: list[str], window: int = 10) -> DataFrame:
    """Trailing mean over up to ``window`` rows; a missing value counts as 0."""
    rows = W.partitionBy(*scope).orderBy(order).rowsBetween(-(window - 1), 0)
    return df.withColumn(f"{value}_avg", F.avg(F.coalesce(F.col(value), F.lit(0))).over(rows))


def align_series(long: DataFrame, series: list[str]) -> DataFrame:
    """Yearly series side by side on the union of their years; null where one has no value."""
    return long.groupBy("year").pivot("series", series).agg(F.max("value"))


def largest_row(df: DataFrame, key: str, scope: list[str]) -> DataFrame:
    """The whole row with the largest value of ``key`` in each scope."""
    rest = [c for c in df.columns if c not in scope]
    order = F.struct(F.col(key), *[F.col(c) for c in rest if c != key])
    return df.groupBy(*scope).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*scope, "x.*")


def value_classes(df: DataFrame, value: str, scope: list[str], bins: int = 5) -> DataFrame:
    """Map class of each value on log-spaced edges of its scope."""
    from tidewatch.functions.scales import bin_of, log_bins

    edges = df.filter(F.col(value) > 0).groupBy(*scope).agg(
        log_bins(F.min(value).cast("double"), F.max(value).cast("double"), bins).alias("edges"))
    return df.join(edges, scope, "left").withColumn(
        "class", F.when(F.col(value) > 0, bin_of(F.col(value), F.col("edges"))))
