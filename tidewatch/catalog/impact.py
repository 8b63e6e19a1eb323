"""Country-year impact queries."""

from pyspark.sql import functions as F

from tidewatch.catalog import query
from tidewatch.functions.scales import decade_of
from tidewatch.operators import impact as op
from tidewatch.session import materialise

PAIRS = {"damages_nominal_usd": "damages_inr", "insured_nominal_usd": "insured_inr",
         "reconstruction_nominal_usd": "reconstruction_inr"}


def rounded(df, digits=6, only=None):
    """Doubles at a fixed number of decimals, so that summation order does not show."""
    names = only or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({n: F.round(n, digits) for n in names})


def records_inr(t):
    return op.add_inr(t.impact_records, t.fx, PAIRS)


def stored_records(t):
    """The records written out once, as operators that read them twice expect."""
    return materialise(t.impact_records, "records")


def scored(t):
    return op.severity_scores(stored_records(t), ["type"], "severity_type")


INR_SQL = """rates AS (SELECT y.year, min_by(f.inr_per_usd, abs(f.year - y.year) * 10000 + f.year) AS rate,
         min_by(f.year, abs(f.year - y.year) * 10000 + f.year) AS rate_year
  FROM (SELECT DISTINCT year FROM {impact_records}) y, {fx} f GROUP BY y.year),
inr AS (SELECT r.*, damages_nominal_usd * rate AS damages_inr, insured_nominal_usd * rate AS insured_inr,
         reconstruction_nominal_usd * rate AS reconstruction_inr,
         rate_year <> r.year AND (damages_nominal_usd > 0 OR insured_nominal_usd > 0
            OR reconstruction_nominal_usd > 0) AS fx_estimated
  FROM {impact_records} r JOIN rates USING (year))"""

SCORE_SQL = """logs AS (SELECT *, log10(1 + deaths) AS a, log10(1 + total_affected) AS b, log10(1 + damages_usd) AS c
  FROM {impact_records}),
typed AS (SELECT type, min(a) a0, max(a) a1, min(b) b0, max(b) b1, min(c) c0, max(c) c1 FROM logs GROUP BY type),
whole AS (SELECT min(a) a0, max(a) a1, min(b) b0, max(b) b1, min(c) c0, max(c) c1 FROM logs),
scored AS (SELECT l.*,
    round_even(100 * (CASE WHEN t.a1 > t.a0 THEN (a - t.a0) / (t.a1 - t.a0) ELSE 0 END * 0.5
      + CASE WHEN t.b1 > t.b0 THEN (b - t.b0) / (t.b1 - t.b0) ELSE 0 END * 0.25
      + CASE WHEN t.c1 > t.c0 THEN (c - t.c0) / (t.c1 - t.c0) ELSE 0 END * 0.25), 2) AS severity_type,
    round_even(100 * (CASE WHEN w.a1 > w.a0 THEN (a - w.a0) / (w.a1 - w.a0) ELSE 0 END * 0.5
      + CASE WHEN w.b1 > w.b0 THEN (b - w.b0) / (w.b1 - w.b0) ELSE 0 END * 0.25
      + CASE WHEN w.c1 > w.c0 THEN (c - w.c0) / (w.c1 - w.c0) ELSE 0 END * 0.25), 2) AS severity_all
  FROM logs l JOIN typed t USING (type) CROSS JOIN whole w)"""


@query("severity_top_all", f"""WITH {SCORE_SQL}
SELECT type, country, year, deaths, total_affected, damages_usd, severity_all AS score
FROM scored ORDER BY severity_all DESC, type, country, year LIMIT 15""")
def severity_top_all(t):
    ranked = op.top_records(op.severity_scores(stored_records(t), [], "severity_all"), "severity_all")
    return ranked.select("type", "country", "year", "deaths", "total_affected", "damages_usd",
                         F.col("severity_all").alias("score"))


@query("severity_top_by_type", f"""WITH {SCORE_SQL}
SELECT type, country, year, severity_type AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY severity_type DESC, country, year) AS rn FROM scored) q
WHERE rn <= 15""")
def severity_top_by_type(t):
    from pyspark.sql import Window as W

    order = W.partitionBy("type").orderBy(F.desc("severity_type"), "country", "year")
    return (scored(t).withColumn("rn", F.row_number().over(order)).filter("rn <= 15")
            .select("type", "country", "year", F.col("severity_type").alias("score")))


@query("last_complete_year", "SELECT CAST(least(max(year), 2025) AS BIGINT) AS last_year FROM {impact_wide}")
def last_complete_year(t):
    return op.last_complete_year(t.impact_wide, 2026)


ENTITY_SQL = """SELECT n_name AS entity, CASE n_nationkey WHEN 3 THEN 'ANT' WHEN 17 THEN 'OWID_USS'
  WHEN 5 THEN 'OWID_WRL' WHEN 7 THEN 'PSE' ELSE 'N' || n_nationkey END AS code FROM {nation}"""


def entities(t):
    key = F.col("n_nationkey")
    return t.nation.select(F.col("n_name").alias("entity"), F.when(key == 3, "ANT").when(key == 17, "OWID_USS")
                           .when(key == 5, "OWID_WRL").when(key == 7, "PSE")
                           .otherwise(F.concat(F.lit("N"), key.cast("string"))).alias("code"))


@query("entity_kinds", f"""SELECT entity AS country, CASE code WHEN 'PSE' THEN 'PSX' ELSE code END AS iso3,
  CASE WHEN code IN ('ANT', 'OWID_USS') THEN 'historical_state' WHEN code LIKE 'OWID_%' THEN 'aggregate'
       ELSE 'country' END AS kind FROM ({ENTITY_SQL}) e""")
def entity_kinds(t):
    return op.replace_codes(op.entity_kinds(entities(t)), "iso3")


def wide_table(t):
    """Impact records spread to ``<metric>_<type>`` columns, as the yearly source publishes them."""
    names = {m: s for m, s in op.METRIC_COLUMNS.items()}
    aggs = [F.max(F.when(F.col("type") == type_id, F.col(metric))).alias(f"{stem}_{suffix}")
            for type_id, suffix in op.TYPE_SUFFIX.items() for metric, stem in names.items()]
    return t.impact_wide.groupBy("country", "year").agg(*aggs)


@query("wide_to_records", f"""SELECT w.type, w.country, w.year, w.decade, w.deaths, w.total_affected, w.damages_usd,
  e.code IN ('ANT', 'OWID_USS') AS historical_state
FROM {{impact_wide}} w JOIN ({ENTITY_SQL}) e ON e.entity = w.country
WHERE w.year <= 2025 AND NOT (e.code LIKE 'OWID_%' AND e.code <> 'OWID_USS')
  AND (deaths > 0 OR injured > 0 OR affected > 0 OR homeless > 0 OR total_affected > 0 OR damages_usd > 0)""")
def wide_to_records(t):
    records = op.wide_to_records(wide_table(t), op.entity_kinds(entities(t)), 2025)
    return records.select("type", "country", "year", "decade", "deaths", "total_affected", "damages_usd",
                          "historical_state")


@query("unknown_entities", f"""SELECT DISTINCT country FROM {{impact_wide}}
WHERE country NOT IN (SELECT entity FROM ({ENTITY_SQL}) e WHERE code <> 'N9')""")
def unknown_entities(t):
    codes = op.entity_kinds(entities(t)).filter("iso3 <> 'N9'")
    return op.unknown_entities(t.impact_wide, codes)


@query("derived_ratios", """SELECT type, country, year,
  round(CASE WHEN deaths > 0 AND total_affected > 0 THEN deaths / total_affected * 100 END, 6) AS fatality_rate_pct,
  round(CASE WHEN damages_usd > 0 AND total_affected > 0 THEN damages_usd / total_affected END, 6)
    AS loss_per_affected_usd FROM {impact_records}""")
def derived_ratios(t):
    return rounded(op.add_derived(t.impact_records).select(
        "type", "country", "year", "fatality_rate_pct", "loss_per_affected_usd"))


@query("event_totals", """SELECT type, year, n_events FROM {world_yearly} WHERE year <= 2020""")
def event_totals(t):
    name = F.create_map(*[F.lit(x) for k, v in op.EVENT_ENTITY.items() for x in (v, k)])
    raw = t.world_yearly.select(name[F.col("type")].alias("entity"), "year", "n_events")
    other = t.world_yearly.select(F.lit("Drought").alias("entity"), "year", "n_events")
    return op.event_totals(raw.unionByName(other), 2020)


@query("world_grid", """SELECT t.type, y.year, CAST(floor(y.year / 10) * 10 AS BIGINT) AS decade,
  coalesce(w.n_events, 0) AS n_events, coalesce(w.deaths, 0) AS deaths, coalesce(w.damages_usd, 0) AS damages_usd
FROM (VALUES ('earthquake'), ('flood'), ('cyclone')) t(type)
CROSS JOIN (SELECT CAST(range AS BIGINT) AS year FROM range(1900, 2026)) y
LEFT JOIN {world_yearly} w ON w.type = t.type AND w.year = y.year""")
def world_grid(t):
    return op.world_grid(t.world_yearly, 1900, 2025).select(
        "type", "year", "decade", "n_events", "deaths", "damages_usd")


@query("nearest_year_rates", """SELECT y.year, min_by(f.inr_per_usd, abs(f.year - y.year) * 10000 + f.year) AS inr_per_usd,
  min_by(f.year, abs(f.year - y.year) * 10000 + f.year) AS rate_year
FROM (SELECT DISTINCT year FROM {impact_records}) y, {fx} f GROUP BY y.year""")
def nearest_year_rates(t):
    return op.join_rates(t.impact_records.select("year").distinct(), t.fx).select("year", "inr_per_usd", "rate_year")


@query("add_inr", f"""WITH {INR_SQL}
SELECT type, country, year, round(damages_inr, 6) AS damages_inr, round(insured_inr, 6) AS insured_inr, fx_estimated
FROM inr""")
def add_inr(t):
    return rounded(records_inr(t).select("type", "country", "year", "damages_inr", "insured_inr", "fx_estimated"), 6)


@query("rate_map", """SELECT min(year) AS first_year, max(year) AS last_year,
  string_agg(year || '=' || printf('%.2f', inr_per_usd), ',' ORDER BY year) AS rates FROM {fx}""")
def rate_map(t):
    entries = F.transform(F.map_entries("rates"), lambda e: F.format_string("%d=%.2f", e["key"], e["value"]))
    return op.rate_map(t.fx).withColumn("rates", F.concat_ws(",", entries))


@query("human_totals", """SELECT type, metric, CAST(sum(v) AS BIGINT) AS value,
  count(CASE WHEN v > 0 THEN 1 END) AS records_reporting
FROM (SELECT type, 'deaths' AS metric, deaths AS v FROM {impact_records}
  UNION ALL SELECT type, 'injured', injured FROM {impact_records}
  UNION ALL SELECT type, 'affected', affected FROM {impact_records}
  UNION ALL SELECT type, 'homeless', homeless FROM {impact_records}
  UNION ALL SELECT type, 'total_affected', total_affected FROM {impact_records}) u
GROUP BY type, metric HAVING sum(v) > 0""")
def human_totals(t):
    return op.human_totals(t.impact_records)


@query("fatality_rates", """SELECT type, round(sum(deaths) / sum(total_affected) * 100, 6) AS value_pct,
  round(median(deaths / total_affected * 100), 6) AS median_pct, count(*) AS records
FROM {impact_records} WHERE deaths > 0 AND total_affected > 0 GROUP BY type""")
def fatality_rates(t):
    return rounded(op.fatality_rates(t.impact_records))


@query("sums_by_decade", """SELECT type, decade, CAST(sum(deaths) AS BIGINT) AS deaths,
  CAST(sum(total_affected) AS BIGINT) AS total_affected, round(sum(damages_usd), 2) AS damages_usd
FROM {impact_records} GROUP BY type, decade""")
def sums_by_decade(t):
    return rounded(op.sums_by_decade(t.impact_records, ["deaths", "total_affected", "damages_usd"]), 2)


@query("economic_summary", f"""WITH {INR_SQL}
SELECT type, round(sum(damages_usd), 2) AS damages_usd, round(sum(damages_inr), 2) AS damages_inr,
  round(sum(insured_usd) / sum(damages_usd), 6) AS insured_share,
  round(sum(insured_inr) / sum(damages_inr), 6) AS insured_share_inr, count(*) AS records,
  count(CASE WHEN damages_usd > 0 THEN 1 END) AS records_with_damages,
  count(CASE WHEN insured_usd > 0 THEN 1 END) AS records_with_insured,
  count(CASE WHEN reconstruction_usd > 0 THEN 1 END) AS records_with_reconstruction,
  count(CASE WHEN fx_estimated AND damages_nominal_usd > 0 THEN 1 END) AS records_fx_estimated,
  count(CASE WHEN damages_usd > 0 AND total_affected > 0 THEN 1 END) AS loss_per_affected_records,
  round(sum(CASE WHEN damages_usd > 0 AND total_affected > 0 THEN damages_usd END)
    / sum(CASE WHEN damages_usd > 0 AND total_affected > 0 THEN total_affected END), 4) AS loss_per_affected_usd,
  count(CASE WHEN damages_pct_gdp > 0 THEN 1 END) AS gdp_records,
  round(median(CASE WHEN damages_pct_gdp > 0 THEN damages_pct_gdp END), 6) AS gdp_median_pct
FROM inr GROUP BY type""")
def economic_summary(t):
    out = op.economic_summary(records_inr(t)).select(
        "type", "damages_usd", "damages_inr", "insured_share", "insured_share_inr", "records", "records_with_damages",
        "records_with_insured", "records_with_reconstruction", "records_fx_estimated", "loss_per_affected_records",
        "loss_per_affected_usd", "gdp_records", "gdp_median_pct")
    out = rounded(out, 2, ["damages_usd", "damages_inr"])
    return rounded(rounded(out, 4, ["loss_per_affected_usd"]), 6, ["insured_share", "insured_share_inr", "gdp_median_pct"])


@query("top_gdp_losses", """SELECT type, rank, country, year, damages_pct_gdp FROM (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY damages_pct_gdp DESC, country, year) AS rank
  FROM {impact_records} WHERE damages_pct_gdp > 0) q WHERE rank <= 10""")
def top_gdp_losses(t):
    return op.top_gdp_losses(t.impact_records).select("type", "rank", "country", "year", "damages_pct_gdp")


FREQ_SQL = """freq AS (SELECT type, decade, sum(n_events) AS n_events, sum(deaths) AS deaths, sum(damages_usd) AS damages_usd,
    count(DISTINCT year) AS years FROM {world_yearly} GROUP BY type, decade)"""


@query("decade_frequency", f"""WITH {FREQ_SQL}
SELECT type, decade, CAST(n_events AS BIGINT) AS n_events, CAST(deaths AS BIGINT) AS deaths,
  round(damages_usd, 2) AS damages_usd, years, round(n_events / years, 6) AS events_per_year, years = 10 AS complete,
  round((n_events / years - lag(n_events / years) OVER w) / lag(n_events / years) OVER w * 100, 1) AS change_pct
FROM freq WINDOW w AS (PARTITION BY type ORDER BY decade)""")
def decade_frequency(t):
    out = op.decade_frequency(t.world_yearly)
    return out.withColumns({"damages_usd": F.round("damages_usd", 2), "events_per_year": F.round("events_per_year", 6)})


@query("year_on_year", """SELECT type, year, n_events AS events, prev AS previous_events,
  round((n_events - prev) / prev * 100, 1) AS change_pct FROM (
  SELECT *, lag(n_events) OVER (PARTITION BY type ORDER BY year) AS prev,
    row_number() OVER (PARTITION BY type ORDER BY year DESC) AS rn FROM {world_yearly}) q WHERE rn = 1""")
def year_on_year(t):
    return op.year_on_year(t.world_yearly)


@query("decade_on_decade", f"""WITH {FREQ_SQL}
SELECT type, decade, CAST(n_events AS BIGINT) AS events, prev AS previous_decade, CAST(pe AS BIGINT) AS previous_events,
  round((n_events - pe) / pe * 100, 1) AS change_pct FROM (
  SELECT *, lag(decade) OVER (PARTITION BY type ORDER BY decade) AS prev,
    lag(n_events) OVER (PARTITION BY type ORDER BY decade) AS pe,
    row_number() OVER (PARTITION BY type ORDER BY decade DESC) AS rn FROM freq WHERE years = 10) q WHERE rn = 1""")
def decade_on_decade(t):
    return op.decade_on_decade(op.decade_frequency(t.world_yearly))


@query("peak_decades", f"""WITH {FREQ_SQL}, long AS (
  SELECT type, decade, years = 10 AS complete, 'n_events' AS metric, CAST(n_events AS DOUBLE) AS value FROM freq
  UNION ALL SELECT type, decade, years = 10, 'deaths', deaths FROM freq
  UNION ALL SELECT type, decade, years = 10, 'damages_usd', damages_usd FROM freq)
SELECT type, metric, decade, round(value, 2) AS value, complete FROM (
  SELECT *, row_number() OVER (PARTITION BY type, metric ORDER BY value DESC, decade) AS rn FROM long) q WHERE rn = 1""")
def peak_decades(t):
    return rounded(op.peak_decades(op.decade_frequency(t.world_yearly)), 2)


@query("country_totals", f"""WITH {INR_SQL}
SELECT type, country, iso3, CAST(sum(deaths) AS BIGINT) AS deaths, CAST(sum(total_affected) AS BIGINT) AS total_affected,
  round(sum(damages_usd), 2) AS damages_usd, round(sum(damages_inr), 2) AS damages_inr,
  bool_or(fx_estimated) AS fx_estimated, count(*) AS records, min(year) AS first_year, max(year) AS last_year,
  bool_or(historical_state) AS historical_state FROM inr GROUP BY type, country, iso3""")
def country_totals(t):
    return rounded(op.country_totals(records_inr(t)).drop("damages_nominal_usd"), 2)


@query("top_countries", """WITH totals AS (SELECT country, CAST(sum(deaths) AS DOUBLE) AS deaths,
    CAST(sum(total_affected) AS DOUBLE) AS total_affected, round(sum(damages_usd), 2) AS damages_usd
  FROM {impact_records} GROUP BY country),
long AS (SELECT country, 'deaths' AS metric, deaths AS value FROM totals
  UNION ALL SELECT country, 'total_affected', total_affected FROM totals
  UNION ALL SELECT country, 'damages_usd', damages_usd FROM totals)
SELECT metric, rank, country, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, country)
  AS rank FROM long WHERE value > 0) q WHERE rank <= 10""")
def top_countries(t):
    metrics = ["deaths", "total_affected", "damages_usd"]
    totals = t.impact_records.groupBy("country").agg(*[op.total(m).alias(m) for m in metrics])
    totals = totals.withColumn("damages_usd", F.round("damages_usd", 2))
    return op.top_by_metric(totals, metrics, "country").select("metric", "rank", "country", "value")


@query("type_comparison", f"""WITH {SCORE_SQL}, worst AS (SELECT * FROM (SELECT type, country, year, deaths, row_number() OVER (
    PARTITION BY type ORDER BY severity_type DESC, year, country DESC) AS rn FROM scored) q WHERE rn = 1),
sums AS (SELECT type, count(*) AS records, sum(deaths) AS deaths, sum(total_affected) AS total_affected,
    sum(damages_usd) AS damages_usd, count(DISTINCT country) AS countries FROM {{impact_records}} GROUP BY type),
ev AS (SELECT type, sum(n_events) AS events FROM {{world_yearly}} GROUP BY type)
SELECT s.type, CAST(events AS BIGINT) AS events, records, CAST(s.deaths AS BIGINT) AS deaths,
  CAST(total_affected AS BIGINT) AS total_affected, round(damages_usd, 2) AS damages_usd, countries,
  round(s.deaths / events, 6) AS avg_deaths_per_event, round(damages_usd / events, 4) AS avg_loss_per_event_usd,
  w.country AS worst_country, w.year AS worst_year, w.deaths AS worst_deaths
FROM sums s JOIN ev USING (type) JOIN worst w USING (type)""")
def type_comparison(t):
    out = op.type_comparison(scored(t), t.world_yearly)
    return out.withColumns({"damages_usd": F.round("damages_usd", 2),
                            "avg_deaths_per_event": F.round("avg_deaths_per_event", 6),
                            "avg_loss_per_event_usd": F.round("avg_loss_per_event_usd", 4)})


@query("global_yearly", """SELECT year, CAST(floor(year / 10) * 10 AS BIGINT) AS decade,
  CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(deaths) AS BIGINT) AS deaths,
  CAST(sum(total_affected) AS BIGINT) AS total_affected, round(sum(damages_usd), 2) AS damages_usd
FROM {world_yearly} GROUP BY year""")
def global_yearly(t):
    return rounded(op.global_yearly(t.world_yearly), 2)


@query("global_decades", """SELECT decade, CAST(sum(n_events) AS BIGINT) AS n_events, count(DISTINCT year) AS years,
  count(DISTINCT year) = 10 AS complete FROM {world_yearly} GROUP BY decade""")
def global_decades(t):
    return op.decade_frequency(op.global_yearly(t.world_yearly), []).select("decade", "n_events", "years", "complete")


@query("reconstruction_summary", f"""WITH {INR_SQL}
SELECT type, count(CASE WHEN reconstruction_usd > 0 THEN 1 END) AS records, count(*) AS of_records,
  round(sum(reconstruction_inr), 2) AS total_inr, round(sum(reconstruction_nominal_usd), 2) AS total_nominal_usd,
  count(CASE WHEN reconstruction_usd > 0 AND damages_usd > 0 THEN 1 END) AS share_records,
  round(sum(CASE WHEN reconstruction_usd > 0 AND damages_usd > 0 THEN reconstruction_usd END)
    / sum(CASE WHEN reconstruction_usd > 0 AND damages_usd > 0 THEN damages_usd END), 6) AS share_of_damage
FROM inr GROUP BY type""")
def reconstruction_summary(t):
    out = op.reconstruction_summary(records_inr(t))
    return rounded(rounded(out, 2, ["total_inr", "total_nominal_usd"]), 6, ["share_of_damage"])


@query("top_reconstruction", """SELECT type, rank, country, year, reconstruction_usd FROM (SELECT *, row_number() OVER (
  PARTITION BY type ORDER BY reconstruction_usd DESC, country, year) AS rank FROM {impact_records}
  WHERE reconstruction_usd > 0) q WHERE rank <= 5""")
def top_reconstruction(t):
    return op.top_reconstruction(t.impact_records).select("type", "rank", "country", "year", "reconstruction_usd")


RESILIENCE_SQL = """res AS (SELECT r.type, decade, count(*) AS records,
    count(CASE WHEN deaths > 0 AND total_affected > 0 THEN 1 END) AS records_with_both,
    sum(CASE WHEN deaths > 0 AND total_affected > 0 THEN deaths END)
      / sum(CASE WHEN deaths > 0 AND total_affected > 0 THEN total_affected END) * 1000 AS deaths_per_1000,
    median(CASE WHEN damages_pct_gdp > 0 THEN damages_pct_gdp END) AS median_damage_pct_gdp,
    decade + 9 > max(l.last) AS partial
  FROM {impact_records} r JOIN (SELECT type, max(year) AS last FROM {impact_records} GROUP BY type) l ON l.type = r.type
  WHERE year >= 1980 GROUP BY r.type, decade)"""


@query("resilience_by_decade", f"""WITH {RESILIENCE_SQL}
SELECT type, decade, records, records_with_both, round(deaths_per_1000, 6) AS deaths_per_1000,
  round(median_damage_pct_gdp, 6) AS median_damage_pct_gdp, partial FROM res""")
def resilience_by_decade(t):
    return rounded(op.resilience_by_decade(stored_records(t)))


@query("resilience_verdict", f"""WITH {RESILIENCE_SQL},
ends AS (SELECT type, min(decade) AS first_decade, max(decade) AS last_decade, min_by(deaths_per_1000, decade) AS a,
  max_by(deaths_per_1000, decade) AS b FROM res WHERE NOT partial AND deaths_per_1000 IS NOT NULL
  GROUP BY type HAVING count(*) >= 2)
SELECT type, first_decade, last_decade, round(a, 6) AS first, round(b, 6) AS last,
  round((b - a) / a * 100, 6) AS change_pct FROM ends""")
def resilience_verdict(t):
    return rounded(op.resilience_verdict(op.resilience_by_decade(stored_records(t))))


@query("coverage_facts", """SELECT type, count(*) AS records, count(CASE WHEN year < 1980 THEN 1 END)
  AS records_before_trend, min(year) AS first_year, max(year) AS last_year FROM {impact_records} GROUP BY type""")
def coverage_facts(t):
    return op.coverage_facts(t.impact_records)


@query("decades_present", "SELECT DISTINCT decade FROM {impact_records}")
def decades_present(t):
    return op.decades_present(t.impact_records)


@query("hero_stats", """SELECT type, count(*) AS records, min(year) AS first_year, max(year) AS last_year,
  CASE WHEN type = 'flood' THEN 'total_affected' ELSE 'deaths' END AS metric,
  CAST(CASE WHEN type = 'flood' THEN sum(total_affected) ELSE sum(deaths) END AS BIGINT) AS value
FROM {impact_records} GROUP BY type""")
def hero_stats(t):
    return op.hero_stats(t.impact_records)


@query("homeless_share", """SELECT round_even(sum(homeless) / sum(total_affected), 4) AS value, count(*) AS records,
  min(year) AS first_year, max(year) AS last_year, CAST(sum(homeless) AS BIGINT) AS homeless,
  CAST(sum(total_affected) AS BIGINT) AS total_affected FROM {impact_records}
WHERE iso3 = 'N08' AND type = 'flood' AND homeless > 0 AND total_affected > 0""")
def homeless_share(t):
    return op.homeless_share(t.impact_records, "N08")


@query("country_layer", f"""WITH {SCORE_SQL}, here AS (SELECT s.*, c.latitude, c.longitude FROM scored s
    JOIN {{centroids}} c USING (country) WHERE decade = 1990),
worst AS (SELECT *, row_number() OVER (PARTITION BY type, country ORDER BY severity_type DESC, year) AS rn FROM here)
SELECT h.type, h.country, any_value(h.latitude) AS latitude, any_value(h.longitude) AS longitude,
  max(CASE WHEN rn = 1 THEN year END) AS year, max(CASE WHEN rn = 1 THEN severity_type END) AS severity,
  count(*) AS records, CAST(sum(deaths) AS BIGINT) AS deaths, CAST(sum(total_affected) AS BIGINT) AS total_affected,
  round(sum(damages_usd), 2) AS damages_usd FROM worst h GROUP BY h.type, h.country""")
def country_layer(t):
    return rounded(op.country_layer(scored(t), t.centroids, 1990), 2, ["damages_usd"])


@query("unmapped_countries", """SELECT DISTINCT country FROM {impact_records}
WHERE country NOT IN (SELECT country FROM {centroids})""")
def unmapped_countries(t):
    return op.unmapped_countries(t.impact_records, t.centroids)


@query("moving_average", """SELECT type, year, n_events, round(avg(n_events) OVER (PARTITION BY type ORDER BY year
  ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS n_events_avg FROM {world_yearly}""")
def moving_average(t):
    return rounded(op.moving_average(t.world_yearly.select("type", "year", "n_events"), "n_events", "year", ["type"]))


@query("aligned_series", """SELECT year, max(CASE WHEN type = 'earthquake' THEN n_events END) AS earthquake,
  max(CASE WHEN type = 'flood' THEN n_events END) AS flood, max(CASE WHEN type = 'cyclone' THEN n_events END) AS cyclone
FROM (SELECT year + CASE type WHEN 'flood' THEN 1 ELSE 0 END AS year, type, n_events FROM {world_yearly}) w GROUP BY year""")
def aligned_series(t):
    shifted = F.col("year") + F.when(F.col("type") == "flood", 1).otherwise(0)  # the series end in different years
    long = t.world_yearly.select(shifted.alias("year"), F.col("type").alias("series"), F.col("n_events").alias("value"))
    return op.align_series(long, op.TYPES)


@query("largest_year", """SELECT type, year, deaths FROM (SELECT *, row_number() OVER (PARTITION BY type
  ORDER BY deaths DESC, year DESC) AS rn FROM {world_yearly}) q WHERE rn = 1""")
def largest_year(t):
    return op.largest_row(t.world_yearly.select("type", "year", "deaths"), "deaths", ["type"])


@query("value_classes", """WITH totals AS (SELECT type, country, CAST(sum(deaths) AS BIGINT) AS deaths
  FROM {impact_records} GROUP BY type, country),
b AS (SELECT type, log10(min(deaths)) AS lo, log10(max(deaths)) - log10(min(deaths)) AS span FROM totals
  WHERE deaths > 0 GROUP BY type)
SELECT t.type, country, deaths, CASE WHEN deaths > 0 THEN CAST(
  (deaths >= pow(10, lo + s * 1))::INT + (deaths >= pow(10, lo + s * 2))::INT + (deaths >= pow(10, lo + s * 3))::INT
  + (deaths >= pow(10, lo + s * 4))::INT AS BIGINT) END AS class
FROM totals t JOIN (SELECT *, CASE WHEN span = 0 THEN 1 ELSE span / 5 END AS s FROM b) x USING (type)""")
def value_classes(t):
    totals = t.impact_records.groupBy("type", "country").agg(op.total("deaths").alias("deaths"))
    return op.value_classes(totals, "deaths", ["type"]).drop("edges")


@query("decade_function", """SELECT DISTINCT CAST(year - 1990 AS BIGINT) AS year,
  CAST(floor((year - 1990) / 10.0) * 10 AS BIGINT) AS decade FROM {world_yearly}""")
def decade_function(t):
    return t.world_yearly.select((F.col("year") - 1990).alias("year")).distinct().withColumn(
        "decade", decade_of(F.col("year")))
