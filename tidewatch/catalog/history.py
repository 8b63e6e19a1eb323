"""Blocks of a hazard type, the overview, and event counts from the chosen source."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import query
from tidewatch.catalog.impact import FREQ_SQL, INR_SQL, RESILIENCE_SQL, SCORE_SQL, records_inr, rounded
from tidewatch.operators import impact
from tidewatch.plans import counts, history

LAST_YEAR = 2001
MONEY = ["damages_usd", "insured_usd", "reconstruction_usd", "damages_nominal_usd", "insured_nominal_usd",
         "reconstruction_nominal_usd", "damages_inr", "insured_inr", "reconstruction_inr", "score"]


def world_inr(t):
    return impact.add_inr(t.world_yearly, t.fx, {"damages_nominal_usd": "damages_inr"})


def blocks(t):
    return history.type_blocks(records_inr(t), world_inr(t), t.quakes, t.storms)


def cube(t):
    return history.record_cube(records_inr(t))


def cents(df):
    """Sums of money to cents, nominal ones (halves of those in the test data) to tenths of a cent, other doubles to six places."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, 3 if "nominal" in c else 2 if c in MONEY else 6) for c in doubles})


def trend_sql(source):
    """Trend of each ``(key, year, value)`` series; the two-sided tail of a rank correlation by Simpson's rule."""
    return f"""tw AS ({source}),
tr AS (SELECT *, rank() OVER (PARTITION BY key ORDER BY year) + (count(*) OVER (PARTITION BY key, year) - 1) / 2 AS ry,
  rank() OVER (PARTITION BY key ORDER BY value) + (count(*) OVER (PARTITION BY key, value) - 1) / 2 AS rv FROM tw),
ts AS (SELECT key, count(*) AS n, count(DISTINCT value) AS kinds, corr(ry, rv) AS rho, regr_slope(value, year) AS slope,
  min(year) AS from_year, max(year) AS to_year FROM tr GROUP BY key),
tg AS (SELECT k, CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS weight FROM range(2001) g(k)),
tp AS (SELECT key, (pi() / 2 - asin(abs(rho))) * sum(weight * pow(abs(cos(asin(abs(rho)) + (pi() / 2 - asin(abs(rho))) * k / 2000)), n - 3))
  / (pi() / 2 * sum(weight * pow(abs(cos(pi() / 2 * k / 2000)), n - 3))) AS p FROM ts, tg WHERE n >= 5 AND kinds >= 2 GROUP BY key, rho, n),
trend AS (SELECT key, CASE WHEN n < 5 OR kinds < 2 THEN 'insufficient' WHEN p >= 0.05 THEN 'no clear trend'
    WHEN rho > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, CASE WHEN p IS NOT NULL THEN round(rho, 3) END AS spearman_rho,
  round(p, 4) AS p_value, CASE WHEN p IS NOT NULL THEN round(slope, 4) END AS slope_per_year, from_year, to_year, n AS n_years
  FROM ts LEFT JOIN tp USING (key))"""


# ── blocks ──────────────────────────────────────────────────────────────────


@query("block_coverage", """SELECT type, count(*) AS records, count(CASE WHEN year < 1980 THEN 1 END) AS records_before_trend,
  min(year) AS first_year, max(year) AS last_year FROM {impact_records} GROUP BY type""")
def block_coverage(t):
    return blocks(t)["coverage"]


@query("block_human", """SELECT type, metric, CAST(sum(v) AS BIGINT) AS value, count(CASE WHEN v > 0 THEN 1 END) AS records_reporting
FROM (UNPIVOT (SELECT type, deaths, injured, affected, homeless, total_affected FROM {impact_records})
  ON deaths, injured, affected, homeless, total_affected INTO NAME metric VALUE v) u GROUP BY type, metric HAVING sum(v) > 0""")
def block_human(t):
    return history.human(cube(t))


@query("block_fatality", """SELECT type, round(sum(deaths) / sum(total_affected) * 100, 6) AS value_pct,
  round(median(deaths / total_affected * 100), 6) AS median_pct, count(*) AS records
FROM {impact_records} WHERE deaths > 0 AND total_affected > 0 GROUP BY type""")
def block_fatality(t):
    return cents(history.fatality(cube(t)))


@query("block_economic", f"""WITH {INR_SQL}
SELECT type, {", ".join(f"round(sum({c}), {3 if 'nominal' in c else 2}) AS {c}" for c in MONEY[:-1])},
  round(sum(insured_usd) / sum(damages_usd), 6) AS insured_share, round(sum(insured_inr) / sum(damages_inr), 6) AS insured_share_inr,
  count(*) AS records, count(CASE WHEN damages_usd > 0 THEN 1 END) AS records_with_damages,
  count(CASE WHEN insured_usd > 0 THEN 1 END) AS records_with_insured,
  count(CASE WHEN reconstruction_usd > 0 THEN 1 END) AS records_with_reconstruction,
  count(CASE WHEN fx_estimated AND damages_nominal_usd > 0 THEN 1 END) AS records_fx_estimated,
  count(CASE WHEN damages_usd > 0 AND total_affected > 0 THEN 1 END) AS loss_per_affected_records,
  round(sum(damages_usd) FILTER (damages_usd > 0 AND total_affected > 0)
    / sum(total_affected) FILTER (damages_usd > 0 AND total_affected > 0), 4) AS loss_per_affected_usd,
  round(sum(damages_inr) FILTER (damages_usd > 0 AND total_affected > 0)
    / sum(total_affected) FILTER (damages_usd > 0 AND total_affected > 0), 4) AS loss_per_affected_inr,
  count(CASE WHEN damages_pct_gdp > 0 THEN 1 END) AS gdp_records,
  round(median(CASE WHEN damages_pct_gdp > 0 THEN damages_pct_gdp END), 6) AS gdp_median_pct FROM inr GROUP BY type""")
def block_economic(t):
    out = cents(history.economic(cube(t)))
    return rounded(out, 4, ["loss_per_affected_usd", "loss_per_affected_inr"])


@query("block_decades", f"""WITH {INR_SQL}
SELECT type, decade, CAST(sum(deaths) AS BIGINT) AS deaths, CAST(sum(total_affected) AS BIGINT) AS total_affected,
  {", ".join(f"round(sum({c}), 2) AS {c}" for c in ("damages_usd", "insured_usd", "damages_inr", "insured_inr"))}
FROM inr GROUP BY type, decade""")
def block_decades(t):
    return cents(history.by_decade(cube(t)))


COUNTRY_SQL = """SELECT type, country, iso3, CAST(sum(deaths) AS BIGINT) AS deaths, CAST(sum(total_affected) AS BIGINT) AS total_affected,
  round(sum(damages_usd), 2) AS damages_usd, round(sum(damages_inr), 2) AS damages_inr, round(sum(damages_nominal_usd), 3) AS damages_nominal_usd,
  bool_or(fx_estimated) AS fx_estimated, count(*) AS records, min(year) AS first_year, max(year) AS last_year,
  bool_or(historical_state) AS historical_state FROM inr GROUP BY type, country, iso3"""


@query("block_countries", f"WITH {INR_SQL} {COUNTRY_SQL}")
def block_countries(t):
    return cents(history.countries(cube(t)))


@query("block_top_countries", f"""WITH {INR_SQL}, totals AS ({COUNTRY_SQL}),
long AS (UNPIVOT (SELECT type, country, iso3, CAST(deaths AS DOUBLE) AS deaths, CAST(total_affected AS DOUBLE) AS total_affected,
  damages_inr FROM totals) ON deaths, total_affected, damages_inr INTO NAME metric VALUE value)
SELECT * FROM (SELECT type, country, iso3, metric, value, row_number() OVER (PARTITION BY type, metric ORDER BY value DESC, country) AS rank
  FROM long WHERE value > 0) q WHERE rank <= 10""")
def block_top_countries(t):
    return history.top_countries(cube(t)).withColumn("value", F.round("value", 2))


@query("block_lists", f"""WITH {INR_SQL}, {SCORE_SQL},
long AS (SELECT type, country, year, deaths, 'severity' AS list, severity_type AS score, 15 AS most FROM scored
  UNION ALL SELECT type, country, year, deaths, 'gdp', damages_pct_gdp, 10 FROM scored WHERE damages_pct_gdp > 0
  UNION ALL SELECT type, country, year, deaths, 'reconstruction', reconstruction_usd, 5 FROM scored WHERE reconstruction_usd > 0)
SELECT q.type, list, rank, q.country, q.year, q.deaths, round(score, 6) AS score, round(i.damages_inr, 2) AS damages_inr, i.fx_estimated
FROM (SELECT *, row_number() OVER (PARTITION BY type, list ORDER BY score DESC, country, year) AS rank FROM long) q
JOIN inr i ON i.type = q.type AND i.country = q.country AND i.year = q.year WHERE rank <= most""")
def block_lists(t):
    out = blocks(t)["lists"].select("type", "list", "rank", "country", "year", "deaths", "score", "damages_inr", "fx_estimated")
    return rounded(rounded(out, 6, ["score"]), 2, ["damages_inr"])


@query("block_resilience", f"""WITH {RESILIENCE_SQL}
SELECT type, decade, records, records_with_both, round(deaths_per_1000, 6) AS deaths_per_1000,
  round(median_damage_pct_gdp, 6) AS median_damage_pct_gdp, partial FROM res""")
def block_resilience(t):
    return rounded(history.resilience(cube(t)))


@query("block_reconstruction", f"""WITH {INR_SQL}
SELECT type, count(CASE WHEN reconstruction_usd > 0 THEN 1 END) AS records, count(*) AS of_records,
  round(sum(reconstruction_inr), 2) AS total_inr, round(sum(reconstruction_nominal_usd), 2) AS total_nominal_usd,
  count(CASE WHEN reconstruction_usd > 0 AND damages_usd > 0 THEN 1 END) AS share_records,
  round(sum(reconstruction_usd) FILTER (reconstruction_usd > 0 AND damages_usd > 0)
    / sum(damages_usd) FILTER (reconstruction_usd > 0 AND damages_usd > 0), 6) AS share_of_damage FROM inr GROUP BY type""")
def block_reconstruction(t):
    out = history.reconstruction(cube(t))
    return rounded(rounded(out, 2, ["total_inr", "total_nominal_usd"]), 6, ["share_of_damage"])


@query("block_trends", f"""WITH {trend_sql('''SELECT type || '/' || metric AS key, year, value FROM (UNPIVOT (SELECT type, year,
  CAST(n_events AS DOUBLE) AS n_events, CAST(deaths AS DOUBLE) AS deaths, damages_usd FROM {world_yearly} WHERE year >= 1980)
  ON n_events, deaths, damages_usd INTO NAME metric VALUE value) u''')}
SELECT split_part(key, '/', 1) AS type, split_part(key, '/', 2) AS metric, * EXCLUDE (key) FROM trend""")
def block_trends(t):
    return blocks(t)["trends"].withColumn("slope_per_year", F.round("slope_per_year", 4))


@query("flood_blocks", f"""WITH {FREQ_SQL}
SELECT 'frequency' AS block, count(*) AS rows, CAST(sum(n_events) AS BIGINT) AS total FROM freq WHERE type = 'flood'
UNION ALL SELECT 'countries', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT country, count(*) AS n FROM {{impact_records}}
  WHERE type = 'flood' GROUP BY country, iso3) c
UNION ALL SELECT 'coverage', 1, count(*) FROM {{impact_records}} WHERE type = 'flood'
UNION ALL SELECT 'points', 0, 0""")
def flood_blocks(t):
    own = history.one_type(blocks(t), "flood")
    sums = {"frequency": "n_events", "countries": "records", "coverage": "records", "points": "year"}
    parts = [own[name].agg(F.lit(name).alias("block"), F.count("*").alias("rows"),
                           F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("total")) for name, column in sums.items()]
    return reduce(DataFrame.unionByName, parts)


# ── overview ────────────────────────────────────────────────────────────────


def whole(t):
    return history.overview(records_inr(t), world_inr(t))


@query("overview_comparison", f"""WITH {INR_SQL}, {SCORE_SQL},
worst AS (SELECT type, country, year, deaths FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY severity_type DESC, country, year) AS rn
  FROM scored) q WHERE rn = 1),
sums AS (SELECT type, count(*) AS records, sum(deaths) AS deaths, sum(total_affected) AS total_affected, sum(damages_usd) AS damages_usd,
  sum(damages_inr) AS damages_inr, sum(damages_nominal_usd) AS damages_nominal_usd, count(DISTINCT country) AS countries FROM inr GROUP BY type),
ev AS (SELECT type, sum(n_events) AS events FROM {{world_yearly}} GROUP BY type)
SELECT s.type, CAST(events AS BIGINT) AS events, records, CAST(s.deaths AS BIGINT) AS deaths, CAST(total_affected AS BIGINT) AS total_affected,
  round(damages_usd, 2) AS damages_usd, round(damages_inr, 2) AS damages_inr, round(damages_nominal_usd, 3) AS damages_nominal_usd, countries,
  round(s.deaths / events, 6) AS avg_deaths_per_event, round(damages_usd / events, 4) AS avg_loss_per_event_usd,
  round(damages_inr / events, 4) AS avg_loss_per_event_inr, w.country AS worst_country, w.year AS worst_year, w.deaths AS worst_deaths
FROM sums s JOIN ev USING (type) JOIN worst w USING (type)""")
def overview_comparison(t):
    return rounded(cents(whole(t)["comparison"]), 4, ["avg_loss_per_event_usd", "avg_loss_per_event_inr"])


WORLD_INR_SQL = """wr AS (SELECT y.year, min_by(f.inr_per_usd, abs(f.year - y.year) * 10000 + f.year) AS rate,
    min_by(f.year, abs(f.year - y.year) * 10000 + f.year) AS rate_year FROM (SELECT DISTINCT year FROM {world_yearly}) y, {fx} f GROUP BY y.year),
yearly AS (SELECT w.year, sum(n_events) AS n_events, sum(deaths) AS deaths, sum(total_affected) AS total_affected, sum(damages_usd) AS damages_usd,
    sum(damages_nominal_usd * rate) AS damages_inr, sum(damages_nominal_usd) AS damages_nominal_usd,
    bool_or(rate_year <> w.year AND damages_nominal_usd > 0) AS fx_estimated FROM {world_yearly} w JOIN wr ON wr.year = w.year GROUP BY w.year)"""


@query("overview_yearly", f"""WITH {WORLD_INR_SQL}
SELECT year, CAST(n_events AS BIGINT) AS n_events, CAST(deaths AS BIGINT) AS deaths, CAST(total_affected AS BIGINT) AS total_affected,
  round(damages_usd, 2) AS damages_usd, round(damages_inr, 2) AS damages_inr, round(damages_nominal_usd, 3) AS damages_nominal_usd, fx_estimated
FROM yearly""")
def overview_yearly(t):
    return cents(whole(t)["yearly"])


@query("overview_decades", f"""WITH {WORLD_INR_SQL}
SELECT CAST(floor(year / 10) * 10 AS BIGINT) AS decade, CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(deaths) AS BIGINT) AS deaths,
  round(sum(damages_usd), 2) AS damages_usd, round(sum(damages_inr), 2) AS damages_inr, count(*) AS years, count(*) = 10 AS complete
FROM yearly GROUP BY 1""")
def overview_decades(t):
    return cents(whole(t)["decades"])


@query("overview_trends", f"""WITH {WORLD_INR_SQL}, {trend_sql('''SELECT key, year, value FROM (UNPIVOT (SELECT year, CAST(n_events AS DOUBLE) AS n_events,
  CAST(deaths AS DOUBLE) AS deaths, round(damages_usd, 2) AS damages_usd FROM yearly WHERE year >= 1980)
  ON n_events, deaths, damages_usd INTO NAME key VALUE value) u''')}
SELECT key AS metric, * EXCLUDE (key) FROM trend""")
def overview_trends(t):
    return whole(t)["trends"].withColumn("slope_per_year", F.round("slope_per_year", 4))


# ── event counts ────────────────────────────────────────────────────────────


def inventory(t):
    return t.flood_events.select("uei", F.col("district").alias("state"), F.col("start_date").alias("start"), "deaths")


def export(t):
    from tidewatch.catalog.events import EXPORT_NAMES

    return t.event_export.withColumnsRenamed(EXPORT_NAMES)


def counted(t, type_id, **sources):
    return counts.event_counts(type_id, t.world_yearly, LAST_YEAR, **sources)


def text(value):
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


@query("count_choices", f"""WITH q AS (SELECT min(year) AS first_year, count(*) FILTER (year <= {LAST_YEAR}) AS n FROM {{quakes}}),
s AS (SELECT min(year(genesis_date)) AS first_year, max(genesis_date) AS day, count(*) FILTER (year(genesis_date) <= {LAST_YEAR}) AS n,
  count(*) FILTER (year(genesis_date) = {LAST_YEAR}) AS late FROM {{storms}}),
cut AS (SELECT *, year(day) = {LAST_YEAR} AND day < DATE '{LAST_YEAR}-12-01' AS short FROM s),
x AS (SELECT try_cast(start_year AS INT) AS y, try_cast(start_month AS INT) AS m, try_cast(start_year || '-' || lpad(start_month, 2, '0') || '-'
  || lpad(start_day, 2, '0') AS DATE) AS d FROM {{event_export}} WHERE disaster_type = 'Flood')
SELECT 'earthquake' AS type, 'usgs' AS source, true AS available, '{counts.WORLD}' AS scope, {text(counts.QUAKE_UNIT)} AS unit, first_year,
  CAST({LAST_YEAR} AS BIGINT) AS last_year, n AS records, CAST(0 AS BIGINT) AS dropped_monthly, CAST(0 AS BIGINT) AS dropped_daily,
  CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS note FROM q
UNION ALL SELECT 'cyclone', 'ibtracs', true, '{counts.WORLD}', {text(counts.STORM_UNIT)}, first_year, CASE WHEN short THEN {LAST_YEAR - 1} ELSE {LAST_YEAR} END,
  CASE WHEN short THEN n - late ELSE n END, 0, 0, NULL, CASE WHEN short THEN '{LAST_YEAR} is left out: the IBTrACS record ends on ' || CAST(day AS VARCHAR)
    || ' and holds only ' || late || ' storms for {LAST_YEAR}, so counting it would understate the year.' END FROM cut
UNION ALL SELECT 'flood', 'ifi', true, '{counts.INDIA}', {text(counts.FLOOD_UNIT)}, 1967, 2023, count(*), 0, 0, NULL, {text(counts.FLOOD_NOTE)}
  FROM {{flood_events}} WHERE year(start_date) BETWEEN 1967 AND 2023
UNION ALL SELECT 'flood', 'emdat_public', true, '{counts.WORLD}', {text(counts.EXPORT_UNIT)}, min(CASE WHEN m IS NOT NULL THEN y END), {LAST_YEAR},
  count(*), count(*) - count(m), count(*) - count(d), NULL, NULL FROM x
UNION ALL SELECT 'flood', NULL, false, NULL, NULL, NULL, NULL, 0, 0, 0, {text(counts.NO_DATES)}, NULL""")
def count_choices(t):
    chosen = [counts.choose("earthquake", LAST_YEAR, quakes=t.quakes), counts.choose("cyclone", LAST_YEAR, storms=t.storms),
              counts.choose("flood", LAST_YEAR, inventory=inventory(t)),
              counts.choose("flood", LAST_YEAR, inventory=inventory(t), export=export(t)), counts.choose("flood", LAST_YEAR)]
    return reduce(DataFrame.unionByName, [c.row(t.spark) for c in chosen])


@query("count_quake_years", """WITH p AS (SELECT year, count(*) AS count FROM {quakes} GROUP BY year),
d AS (SELECT year, sum(n_events) AS count FROM {world_yearly} WHERE type = 'earthquake' GROUP BY year)
SELECT 'physical' AS series, y.year, coalesce(p.count, 0) AS count FROM (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM p) y
LEFT JOIN p USING (year)
UNION ALL SELECT 'emdat', y.year, CAST(coalesce(d.count, 0) AS BIGINT) FROM (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM d) y
LEFT JOIN d USING (year)""")
def count_quake_years(t):
    return counted(t, "earthquake", quakes=t.quakes)[1]["yearly"]


@query("count_storm_series", f"""WITH e AS (SELECT year(genesis_date) AS year FROM {{storms}}),
last AS (SELECT CASE WHEN max(genesis_date) < DATE '{LAST_YEAR}-12-01' AND year(max(genesis_date)) = {LAST_YEAR} THEN {LAST_YEAR - 1}
  ELSE {LAST_YEAR} END AS y FROM {{storms}}),
p AS (SELECT year, count(*) AS n FROM e WHERE year <= (SELECT y FROM last) GROUP BY year),
d AS (SELECT year, CAST(sum(n_events) AS BIGINT) AS n FROM {{world_yearly}} WHERE type = 'cyclone' GROUP BY year),
every AS (SELECT 'physical' AS key, y.year, coalesce(p.n, 0) AS value FROM (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM p) y LEFT JOIN p USING (year)
  UNION ALL SELECT 'emdat', y.year, coalesce(d.n, 0) FROM (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM d) y LEFT JOIN d USING (year)),
{trend_sql("SELECT key, year, value FROM every WHERE year >= 1980")},
facts AS (SELECT key, min(year) AS first_year, max(year) AS last_year, CAST(sum(value) AS BIGINT) AS n_events FROM every GROUP BY key)
SELECT key AS series, CASE key WHEN 'emdat' THEN 'disaster' ELSE 'physical' END AS kind, facts.first_year, facts.last_year, n_events,
  CASE key WHEN 'emdat' THEN CAST(1980 AS BIGINT) END AS poor_before, direction, spearman_rho, p_value, slope_per_year
FROM facts LEFT JOIN trend USING (key)""")
def count_storm_series(t):
    out = counted(t, "cyclone", storms=t.storms)[1]["series"]
    return out.withColumn("slope_per_year", F.round("slope_per_year", 4))


@query("count_storm_months", f"""WITH e AS (SELECT year(genesis_date) AS year, month(genesis_date) AS month FROM {{storms}}),
span AS (SELECT min(year(genesis_date)) AS a, CASE WHEN max(genesis_date) < DATE '{LAST_YEAR}-12-01' AND year(max(genesis_date)) = {LAST_YEAR}
  THEN {LAST_YEAR - 1} ELSE {LAST_YEAR} END AS b FROM {{storms}}),
grid AS (SELECT y AS year, m AS month FROM (SELECT unnest(range(a, b + 1)) AS y FROM span), (SELECT unnest(range(1, 13)) AS m))
SELECT g.year, g.month, count(e.year) AS count FROM grid g LEFT JOIN e ON e.year = g.year AND e.month = g.month GROUP BY g.year, g.month""")
def count_storm_months(t):
    return counted(t, "cyclone", storms=t.storms)[1]["matrix"]


@query("count_quake_thinned", """WITH thin AS (SELECT DISTINCT event_date, floor(latitude / 5) AS a, floor(longitude / 5) AS b FROM {quakes}),
days AS (SELECT CAST(DATE '2001-12-31' - make_date(min(year), 1, 1) + 1 AS BIGINT) AS n FROM {quakes})
SELECT any_value(days.n) AS period_days, count(DISTINCT event_date) AS days_with_event,
  round_even(count(DISTINCT event_date) / any_value(days.n), 4) AS share_days_with_event,
  round_even(count(*) / any_value(days.n), 4) AS average_per_day FROM thin, days""")
def count_quake_thinned(t):
    return counted(t, "earthquake", quakes=t.quakes)[1]["thinned_days"]


@query("count_flood_days", """WITH e AS (SELECT start_date AS date, coalesce(deaths, 0) AS rank,
    coalesce(nullif(district, ''), 'India') || ' (' || uei || ')' AS label FROM {flood_events} WHERE year(start_date) BETWEEN 1967 AND 2023),
d AS (SELECT date, count(*) AS count FROM e GROUP BY date ORDER BY count DESC, date LIMIT 5),
l AS (SELECT date, label, row_number() OVER (PARTITION BY date ORDER BY rank DESC, label) AS place FROM e JOIN d USING (date))
SELECT CAST(date AS STRING) AS date, count, greatest(count - 8, 0) AS more,
  (SELECT string_agg(label, '; ' ORDER BY place) FROM l WHERE l.date = d.date AND place <= 8) AS events FROM d""")
def count_flood_days(t):
    out = counted(t, "flood", inventory=inventory(t))[1]["top_days"]
    return out.withColumns({"events": F.array_join("events", "; "), "date": F.col("date").cast("string")})


@query("count_export_days", f"""WITH x AS (SELECT try_cast(start_year || '-' || lpad(start_month, 2, '0') || '-' || lpad(start_day, 2, '0') AS DATE) AS d,
  try_cast(start_year AS INT) AS y, start_month AS m FROM {{event_export}} WHERE disaster_type = 'Flood'),
n AS (SELECT CAST(DATE '{LAST_YEAR}-12-31' - make_date(min(y), 1, 1) + 1 AS BIGINT) AS days, min(y) AS first FROM x WHERE m IS NOT NULL)
SELECT any_value(days) AS period_days, count(DISTINCT d) AS days_with_event, round_even(count(DISTINCT d) / any_value(days), 4) AS share_days_with_event,
  round_even(count(d) / any_value(days), 4) AS average_per_day FROM x, n WHERE year(d) BETWEEN first AND {LAST_YEAR}""")
def count_export_days(t):
    return counted(t, "flood", inventory=inventory(t), export=export(t))[1]["days"]
