"""The blocks of a hazard type and the overview of all types.

Records are read once: they are stored, and one aggregate with grouping sets takes every sum,
count and histogram that the blocks need, by type, by type and decade, and by type and
country. Blocks are lazy views of that cube. Only ranked lists and correlations go
back to the stored records, the lists of all kinds in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.scales import decade_of, guarded_ratio, safe_ratio
from tidewatch.operators import events, impact, stats
from tidewatch.operators.impact import PEOPLE, SEVERITY_WEIGHTS, TREND_FROM, total
from tidewatch.operators.ranking import exact_quantile
from tidewatch.session import materialise

# Lengths of the ranked lists, pairs that are correlated.
SEVERITY_TOP, LIST_TOP, REBUILT_TOP = 15, 10, 5
PAIRS = [("total_affected", "deaths"), ("total_affected", "damages_inr"), ("deaths", "damages_inr")]
SUMS = [f"{kind}_{unit}" for kind in ("damages", "insured", "reconstruction") for unit in ("usd", "nominal_usd", "inr")]
LEVELS = {"type": ["type"], "decade": ["type", "decade"], "country": ["type", "country", "iso3"],
          "rate": ["type", "rate"], "share": ["type", "decade", "share"]}
AXES = ["type", "decade", "country", "iso3", "rate", "share"]


def _logged(metric: str) -> Column:
    return F.log10(F.greatest(F.col(metric), F.lit(0)).cast("double") + 1)


def record_cube(records: DataFrame, since: int = TREND_FROM) -> DataFrame:
    """All measures of the blocks at every level of ``LEVELS``, in one pass; ``level`` names the grouping set.

    The two last levels are histograms of the fatality rate and of the damage share, from which
    medians are taken exactly.
    """
    dead, hurt, lost = (F.col(c) > 0 for c in ("deaths", "total_affected", "damages_usd"))
    rebuilt = F.col("reconstruction_usd") > 0

    def both(column: str, *conditions: Column) -> Column:
        met = conditions[0]
        for other in conditions[1:]:
            met = met & other
        return total(F.when(met, F.col(column)))

    axes = records.withColumns({
        "rate": guarded_ratio(F.col("deaths"), F.col("total_affected"), 100.0),
        "share": F.when(F.col("damages_pct_gdp") > 0, F.col("damages_pct_gdp"))})
    measures = [
        F.count("*").alias("records"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count_if(F.col("year") < since).alias("records_before_trend"),
        F.bool_or("historical_state").alias("historical_state"), F.bool_or("fx_estimated").alias("fx_estimated"),
        *[total(c).alias(c) for c in [*PEOPLE, *SUMS]],
        *[F.count_if(F.col(c) > 0).alias(f"reporting_{c}") for c in PEOPLE],
        F.count_if(lost).alias("records_with_damages"), F.count_if(F.col("insured_usd") > 0).alias("records_with_insured"),
        F.count_if(rebuilt).alias("records_with_reconstruction"),
        F.count_if(F.col("fx_estimated") & (F.col("damages_nominal_usd") > 0)).alias("records_fx_estimated"),
        F.count_if(dead & hurt).alias("pairs"), both("deaths", dead, hurt).alias("pair_deaths"),
        both("total_affected", dead, hurt).alias("pair_affected"),
        F.count_if(lost & hurt).alias("loss_pairs"), both("damages_usd", lost, hurt).alias("loss_usd"),
        both("damages_inr", lost, hurt).alias("loss_inr"), both("total_affected", lost, hurt).alias("loss_affected"),
        F.count_if(rebuilt & lost).alias("rebuilt_pairs"), both("reconstruction_usd", rebuilt, lost).alias("rebuilt_usd"),
        both("damages_usd", rebuilt, lost).alias("rebuilt_damage"), F.count("share").alias("gdp_records"),
        *[agg(_logged(m)).alias(f"{side}_{m}") for m in SEVERITY_WEIGHTS for side, agg in (("lo", F.min), ("hi", F.max))],
    ]
    number = {name: sum(1 << k for k, axis in enumerate(reversed(AXES)) if axis not in axes_)
              for name, axes_ in LEVELS.items()}
    named = F.create_map(*[F.lit(x) for name, k in number.items() for x in (k, name)])
    cube = axes.groupingSets([[F.col(a) for a in level] for level in LEVELS.values()], *AXES).agg(
        F.grouping_id().cast("int").alias("_set"), *measures)
    return cube.withColumn("level", named[F.col("_set")]).drop("_set")


def _at(cube: DataFrame, level: str) -> DataFrame:
    return cube.filter(F.col("level") == level)


def human(cube: DataFrame) -> DataFrame:
    """Total of each human metric and the records that report it; metrics without a total are left out."""
    lines = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value"),
                                         F.col(f"reporting_{m}").alias("records_reporting")) for m in PEOPLE]))
    return _at(cube, "type").select("type", lines.alias("x")).select("type", "x.*").filter("value > 0")


def fatality(cube: DataFrame) -> DataFrame:
    """Pooled and median fatality percentage over the records that report both figures."""
    middle = exact_quantile(_at(cube, "rate").filter("rate IS NOT NULL"), ["type"], "rate", 0.5, "median_pct", "records")
    pooled = _at(cube, "type").filter("pairs > 0").select(
        "type", (F.col("pair_deaths") / F.col("pair_affected") * 100).alias("value_pct"), F.col("pairs").alias("records"))
    return pooled.join(middle, "type").select("type", "value_pct", "median_pct", "records")


def economic(cube: DataFrame) -> DataFrame:
    """Loss totals in three currencies, insured shares, loss per affected person, median share of output."""
    shares = _at(cube, "share").filter("share IS NOT NULL")
    middle = exact_quantile(shares, ["type"], "share", 0.5, "gdp_median_pct", "records")
    return _at(cube, "type").join(middle, "type", "left").select(
        "type", *SUMS, safe_ratio(F.col("insured_usd"), F.col("damages_usd")).alias("insured_share"),
        safe_ratio(F.col("insured_inr"), F.col("damages_inr")).alias("insured_share_inr"), "records",
        "records_with_damages", "records_with_insured", "records_with_reconstruction", "records_fx_estimated",
        F.col("loss_pairs").alias("loss_per_affected_records"),
        safe_ratio(F.col("loss_usd"), F.col("loss_affected")).alias("loss_per_affected_usd"),
        safe_ratio(F.col("loss_inr"), F.col("loss_affected")).alias("loss_per_affected_inr"), "gdp_records", "gdp_median_pct")


def by_decade(cube: DataFrame) -> DataFrame:
    return _at(cube, "decade").select("type", "decade", "deaths", "total_affected", "damages_usd", "insured_usd",
                                      "damages_inr", "insured_inr")


def coverage(cube: DataFrame) -> DataFrame:
    return _at(cube, "type").select("type", "records", "records_before_trend", "first_year", "last_year")


def countries(cube: DataFrame) -> DataFrame:
    return _at(cube, "country").select(
        "type", "country", "iso3", "deaths", "total_affected", "damages_usd", "damages_inr", "damages_nominal_usd",
        "fx_estimated", "records", "first_year", "last_year", "historical_state")


def top_countries(cube: DataFrame, n: int = LIST_TOP) -> DataFrame:
    """The ``n`` largest of each type by people affected, by deaths and by loss in rupees."""
    lines = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                for m in ("total_affected", "deaths", "damages_inr")]))
    order = W.partitionBy("type", "metric").orderBy(F.desc("value"), "country")
    return (countries(cube).select("type", "country", "iso3", lines.alias("x")).select("type", "country", "iso3", "x.*")
            .filter("value > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n))


def reconstruction(cube: DataFrame) -> DataFrame:
    return _at(cube, "type").select(
        "type", F.col("records_with_reconstruction").alias("records"), F.col("records").alias("of_records"),
        F.col("reconstruction_inr").alias("total_inr"), F.col("reconstruction_nominal_usd").alias("total_nominal_usd"),
        F.col("rebuilt_pairs").alias("share_records"),
        safe_ratio(F.col("rebuilt_usd"), F.col("rebuilt_damage")).alias("share_of_damage"))


def resilience(cube: DataFrame, since: int = TREND_FROM) -> DataFrame:
    """Deaths per 1,000 affected and median damage share by decade; ``since`` starts a decade."""
    if since % 10:
        raise ValueError(f"{since} is not the first year of a decade")
    last = _at(cube, "type").select("type", F.col("last_year").alias("_last"))
    shares = _at(cube, "share").filter(F.col("share").isNotNull() & (F.col("decade") >= since))
    middle = exact_quantile(shares, ["type", "decade"], "share", 0.5, "median_damage_pct_gdp", "records")
    return (_at(cube, "decade").filter(F.col("decade") >= since).join(last, "type")
            .join(middle, ["type", "decade"], "left").select(
                "type", "decade", "records", F.col("pairs").alias("records_with_both"),
                F.when(F.col("pairs") > 0, F.col("pair_deaths") / F.col("pair_affected") * 1000).alias("deaths_per_1000"),
                "median_damage_pct_gdp", (F.col("decade") + 9 > F.col("_last")).alias("partial")))


def scored(records: DataFrame, cube: DataFrame) -> DataFrame:
    """Records with ``severity_type``, scaled between the bounds that the cube holds for each type."""
    sides = [f"{side}_{m}" for m in SEVERITY_WEIGHTS for side in ("lo", "hi")]
    score = F.lit(0.0)
    for metric, weight in SEVERITY_WEIGHTS.items():
        low, high = F.col(f"lo_{metric}"), F.col(f"hi_{metric}")
        score = score + F.when(high > low, (_logged(metric) - low) / (high - low)).otherwise(F.lit(0.0)) * weight
    bounds = _at(cube, "type").select("type", *sides)
    return records.join(bounds, "type").withColumn("severity_type", F.bround(score * 100, 2)).drop(*sides)


def ranked_lists(scored_records: DataFrame) -> DataFrame:
    """The severity, output-loss and rebuilding lists of each type, ranked in one pass over the records."""
    kinds = [("severity", F.col("severity_type"), F.lit(True), SEVERITY_TOP),
             ("gdp", F.col("damages_pct_gdp"), F.col("damages_pct_gdp") > 0, LIST_TOP),
             ("reconstruction", F.col("reconstruction_usd"), F.col("reconstruction_usd") > 0, REBUILT_TOP)]
    entry = F.array_compact(F.array(*[F.when(met, F.struct(F.lit(name).alias("list"), value.cast("double").alias("score"),
                                                           F.lit(n).alias("_most"))) for name, value, met, n in kinds]))
    order = W.partitionBy("type", "list").orderBy(F.desc("score"), "country", "year")
    rows = scored_records.select("type", "country", "year", "deaths", "total_affected", "damages_usd", "damages_inr",
                                 "damages_nominal_usd", "reconstruction_inr", "fx_estimated", F.explode(entry).alias("x"))
    return (rows.select("*", "x.*").drop("x").withColumn("rank", F.row_number().over(order))
            .filter((F.col("rank") <= max(n for *_, n in kinds)) & (F.col("rank") <= F.col("_most"))).drop("_most"))


def trends(world: DataFrame, keys: list[str], since: int = TREND_FROM) -> DataFrame:
    """Trend of events, deaths and loss since a year; ``metric`` names the series."""
    lines = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                for m in ("n_events", "deaths", "damages_usd")]))
    long = world.filter(F.col("year") >= since).select(*keys, "year", lines.alias("x")).select(*keys, "year", "x.*")
    return stats.trend_verdicts(long, [*keys, "metric"], "year", "value")


def type_blocks(records: DataFrame, world: DataFrame, quakes: DataFrame | None = None,
                storms: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every block of every type by name; ``one_type`` cuts out a single type.

    ``records`` are country-year records in dollars and rupees, ``world`` the yearly totals of
    each type on a dense grid; the catalogues feed the points. Storing the records and
    the cube, and pairing columns for the correlations, runs when this is called; the blocks are lazy.
    """
    stored = materialise(records, "records")
    cube = materialise(record_cube(stored), "cube")
    frequency = impact.decade_frequency(world)
    pairs = [stats.correlations(stored, ["type"], x, y) for x, y in PAIRS]
    blocks = {
        "coverage": coverage(cube), "human": human(cube), "fatality": fatality(cube), "economic": economic(cube),
        "decades": by_decade(cube), "countries": countries(cube), "top_countries": top_countries(cube),
        "lists": ranked_lists(scored(stored, cube)), "frequency": frequency, "year_on_year": impact.year_on_year(world),
        "decade_on_decade": impact.decade_on_decade(frequency), "peaks": impact.peak_decades(frequency),
        "trends": trends(world, ["type"]), "correlation": pairs[0].unionByName(pairs[1]).unionByName(pairs[2]),
        "reconstruction": reconstruction(cube), "resilience": resilience(cube),
        "resilience_verdict": impact.resilience_verdict(resilience(cube)),
    }
    if quakes is not None and storms is not None:
        blocks["points"] = events.strong_points(quakes, storms)
    return blocks


def one_type(blocks: dict[str, DataFrame], type_id: str) -> dict[str, DataFrame]:
    """The blocks of one type; a type that is not known is refused."""
    if type_id not in impact.TYPES:
        raise ValueError(f"unknown type {type_id}; known are {', '.join(impact.TYPES)}")
    return {name: block.filter(F.col("type") == type_id) for name, block in blocks.items()}


def overview(records: DataFrame, world: DataFrame) -> dict[str, DataFrame]:
    """Types side by side, the most severe records of all, and the yearly and decade totals of the world with their trends.

    Both tables hold dollars and rupees. Trends start in 1980, and a trend of all types is
    that of the yearly totals.
    """
    stored = materialise(records, "records")
    cube = materialise(record_cube(stored), "cube")
    counted = world.groupBy("type").agg(total("n_events").alias("events"))
    worst = ranked_lists(scored(stored, cube)).filter("list = 'severity' AND rank = 1").select(
        "type", F.col("country").alias("worst_country"), F.col("year").alias("worst_year"), F.col("deaths").alias("worst_deaths"))
    places = _at(cube, "country").groupBy("type").agg(F.countDistinct("country").alias("countries"))
    comparison = _at(cube, "type").join(counted, "type").join(places, "type").join(worst, "type").select(
        "type", "events", "records", "deaths", "total_affected", "damages_usd", "damages_inr", "damages_nominal_usd", "countries",
        *[safe_ratio(F.col(c), F.col("events")).alias(name) for c, name in (
            ("deaths", "avg_deaths_per_event"), ("damages_usd", "avg_loss_per_event_usd"), ("damages_inr", "avg_loss_per_event_inr"))],
        "worst_country", "worst_year", "worst_deaths")
    summed = ["n_events", "deaths", "total_affected", "damages_usd", "damages_inr", "damages_nominal_usd"]
    yearly = world.groupBy("year").agg(*[total(c).alias(c) for c in summed], F.bool_or("fx_estimated").alias("fx_estimated"))
    decades = yearly.groupBy(decade_of(F.col("year")).alias("decade")).agg(
        *[total(c).alias(c) for c in ("n_events", "deaths", "damages_usd", "damages_inr")], F.count("*").alias("years"))
    return {
        "comparison": comparison,
        "top_severity": impact.top_records(impact.severity_scores(stored, [], "severity_all"), "severity_all", SEVERITY_TOP),
        "yearly": yearly, "decades": decades.withColumn("complete", F.col("years") == 10), "trends": trends(yearly, []),
    }
