"""Catalogue, event-count and statistics queries."""

from pyspark.sql import functions as F

from tidewatch.catalog import query
from tidewatch.catalog.impact import records_inr, rounded, INR_SQL
from tidewatch.operators import events as op
from tidewatch.operators import impact, ranking, stats

EXPORT_NAMES = {"disaster_type": "Disaster Type", "disaster_subtype": "Disaster Subtype", "start_year": "Start Year",
                "start_month": "Start Month", "start_day": "Start Day", "total_deaths": "Total Deaths",
                "country": "Country"}


def quakes(t):
    return op.clean_quakes(t.quake_pages, 2001)


def export(t):
    return t.event_export.withColumnsRenamed(EXPORT_NAMES)


@query("clean_quakes", """SELECT id, CAST(event_date AS STRING) AS date, year, month, decade, latitude, longitude, depth_km,
  magnitude, coalesce(place, '') AS place FROM {quakes}""")
def clean_quakes(t):
    return quakes(t).select("id", F.col("event_date").cast("string").alias("date"), "year", "month", "decade",
                            "latitude", "longitude", "depth_km", F.col("magnitude").cast("double").alias("magnitude"),
                            "place")


@query("reduce_storms", """WITH main AS (SELECT * FROM {track_points} WHERE track_type = 'main'),
pick AS (SELECT sid, max(usa_wind) IS NOT NULL AS usa FROM main GROUP BY sid),
w AS (SELECT m.*, p.usa, CASE WHEN p.usa THEN usa_wind ELSE wmo_wind END AS wind FROM main m JOIN pick p USING (sid)),
peak AS (SELECT * FROM (SELECT sid, lat, lon, row_number() OVER (PARTITION BY sid
    ORDER BY wind DESC NULLS LAST, iso_time, point_seq) AS rn FROM w WHERE wind IS NOT NULL) q WHERE rn = 1),
b AS (SELECT sid, basin FROM (SELECT sid, basin, row_number() OVER (PARTITION BY sid ORDER BY count(*) DESC, basin) AS rn
    FROM main WHERE basin IS NOT NULL GROUP BY sid, basin) q WHERE rn = 1),
agg AS (SELECT sid, any_value(usa) AS usa, max(wind) AS wind, min(usa_pres) AS up, min(wmo_pres) AS wp,
    min(iso_time) AS first_time, arg_min(name, (iso_time, point_seq)) AS name, min(season) AS season,
    bool_or(dist2land = 0) AS landfall FROM w GROUP BY sid HAVING max(wind) >= 34)
SELECT sid, CASE WHEN name = 'NOT_NAMED' THEN 'Unnamed' ELSE 'Storm ' || substr(name, 7) END AS name, season,
  coalesce(basin, '') AS basin, CAST(CAST(first_time AS DATE) AS STRING) AS genesis_date,
  round_even(lat, 2) AS lmi_latitude, round_even(lon, 2) AS lmi_longitude, CAST(round_even(wind, 0) AS BIGINT) AS max_wind_kt,
  CASE WHEN usa AND up IS NOT NULL THEN up ELSE wp END AS min_pressure_mb,
  CASE WHEN usa THEN 'usa_1min' ELSE 'wmo' END AS wind_source,
  CAST(CASE WHEN NOT usa THEN 0 WHEN wind >= 137 THEN 5 WHEN wind >= 113 THEN 4 WHEN wind >= 96 THEN 3
    WHEN wind >= 83 THEN 2 WHEN wind >= 64 THEN 1 ELSE 0 END AS BIGINT) AS category, landfall,
  CAST(floor(season / 10) * 10 AS BIGINT) AS decade
FROM agg JOIN peak USING (sid) LEFT JOIN b USING (sid) WHERE season BETWEEN 1980 AND 2015""")
def reduce_storms(t):
    out = op.reduce_storms(t.track_points, 2015).drop("month", "year")
    return out.withColumn("genesis_date", F.col("genesis_date").cast("string"))


@query("strong_points", """SELECT 'earthquake' AS type, id, latitude, longitude, magnitude AS value, year,
  coalesce(place, '') AS title FROM {quakes} WHERE magnitude >= 7
UNION ALL SELECT 'cyclone', sid, lmi_latitude, lmi_longitude, CAST(max_wind_kt AS DOUBLE), season,
  name || ' (' || season || '), category ' || category FROM {storms} WHERE category >= 3""")
def strong_points(t):
    return op.strong_points(t.quakes, t.storms)


@query("point_layer", """SELECT 'earthquake' AS type, id, latitude, longitude, magnitude AS value, year,
  coalesce(nullif(place, ''), 'Unknown location') AS title, true AS available FROM {quakes} WHERE decade = 2000
UNION ALL SELECT 'cyclone', sid, lmi_latitude, lmi_longitude, CAST(max_wind_kt AS DOUBLE), season,
  name || ' (' || basin || ' basin)', true FROM {storms} WHERE decade = 2000""")
def point_layer(t):
    return op.point_layer(t.quakes, t.storms, 2000)


@query("catalogue_decades", """SELECT decade, count(*) AS m6, count(CASE WHEN magnitude >= 7 THEN 1 END) AS m7
FROM {quakes} GROUP BY decade""")
def catalogue_decades(t):
    return op.counts_by_decade(t.quakes)


@query("beside_disasters", """WITH f AS (SELECT decade, CAST(sum(n_events) AS BIGINT) AS n_events FROM {world_yearly}
  WHERE type = 'earthquake' GROUP BY decade), q AS (SELECT decade, count(*) AS m6,
  count(CASE WHEN magnitude >= 7 THEN 1 END) AS m7 FROM {quakes} GROUP BY decade)
SELECT decade, n_events, coalesce(m6, 0) AS m6, coalesce(m7, 0) AS m7 FROM f LEFT JOIN q USING (decade)""")
def beside_disasters(t):
    freq = op_freq(t)
    return op.beside_disasters(freq, op.counts_by_decade(t.quakes))


def op_freq(t):
    world = t.world_yearly.filter("type = 'earthquake'")
    return impact.decade_frequency(world).select("decade", "n_events")


@query("event_lists", """SELECT 'earthquake' AS type, CAST(event_date AS STRING) AS date, magnitude AS rank,
  'M' || printf('%.1f', magnitude) || ' ' || coalesce(place, 'unknown place') AS label FROM {quakes}
UNION ALL SELECT 'cyclone', CAST(genesis_date AS STRING), CAST(max_wind_kt AS DOUBLE),
  name || ' (' || max_wind_kt || ' kt peak)' FROM {storms}""")
def event_lists(t):
    both = op.quake_events(t.quakes).drop("lat", "lon").withColumn("type", F.lit("earthquake")).unionByName(
        op.storm_events(t.storms).withColumn("type", F.lit("cyclone")))
    return both.withColumn("date", F.col("date").cast("string"))


EXPORT_SQL = """ex AS (SELECT *, try_cast(start_year AS INT) AS y, try_cast(start_month AS INT) AS m,
    try_cast(start_day AS INT) AS d FROM {event_export} WHERE disaster_type = 'Storm'
    AND coalesce(disaster_subtype, '') ILIKE '%tropical cyclone%'),
dated AS (SELECT *, try_cast(y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE) AS day_date FROM ex)"""


@query("export_daily", f"""WITH {EXPORT_SQL}
SELECT CAST(day_date AS STRING) AS date, coalesce(CAST(total_deaths AS DOUBLE), 0) AS rank, country AS label FROM dated
WHERE day_date IS NOT NULL""")
def export_daily(t):
    return op.export_events(export(t), "cyclone", "daily").withColumn("date", F.col("date").cast("string"))


@query("export_drops", f"""WITH {EXPORT_SQL}
SELECT count(*) AS records, count(CASE WHEN m IS NULL THEN 1 END) AS dropped_monthly,
  count(CASE WHEN day_date IS NULL THEN 1 END) AS dropped_daily FROM dated""")
def export_drops(t):
    return op.export_drops(export(t), "cyclone")


@query("complete_through", "SELECT CAST(2000 AS BIGINT) AS last_year FROM {quakes} HAVING max(event_date) < DATE '2001-12-01'")
def complete_through(t):
    return op.complete_through(op.quake_events(t.quakes), 2001)


@query("decluster", """SELECT CAST(event_date AS STRING) AS date, cell, rank, label FROM (SELECT event_date,
    CAST(floor(latitude / 5) AS BIGINT) || '_' || CAST(floor(longitude / 5) AS BIGINT) AS cell, magnitude AS rank,
    'M' || printf('%.1f', magnitude) || ' ' || coalesce(place, 'unknown place') AS label,
    row_number() OVER (PARTITION BY event_date, floor(latitude / 5), floor(longitude / 5)
      ORDER BY magnitude DESC, 'M' || printf('%.1f', magnitude) || ' ' || coalesce(place, 'unknown place')) AS rn
  FROM {quakes}) q WHERE rn = 1""")
def decluster(t):
    out = op.decluster(op.quake_events(t.quakes)).select("date", "cell", "rank", "label")
    return out.withColumn("date", F.col("date").cast("string"))


@query("yearly_series", """SELECT y.year, count(e.year) AS count FROM (SELECT CAST(range AS BIGINT) AS year FROM range(1980, 2020)) y
LEFT JOIN (SELECT season AS year FROM {storms} WHERE category >= 2) e USING (year)
WHERE y.year BETWEEN (SELECT min(season) FROM {storms} WHERE category >= 2)
  AND (SELECT max(season) FROM {storms} WHERE category >= 2) GROUP BY y.year""")
def yearly_series(t):
    seasons = t.storms.filter("category >= 2").select(F.make_date("season", F.lit(6), F.lit(1)).alias("date"))
    return op.yearly_series(seasons)


@query("month_matrix", """SELECT y.year, m.month, count(q.id) AS count
FROM (SELECT CAST(range AS BIGINT) AS year FROM range(1994, 2002)) y
CROSS JOIN (SELECT CAST(range AS BIGINT) AS month FROM range(1, 13)) m
LEFT JOIN {quakes} q ON q.year = y.year AND q.month = m.month GROUP BY y.year, m.month""")
def month_matrix(t):
    return op.month_matrix(op.quake_events(t.quakes), 1994, 2001)


@query("month_averages", """SELECT month, count(*) AS total, round_even(count(*) / 7, 3) AS average FROM {quakes}
WHERE year BETWEEN 1995 AND 2001 GROUP BY month""")
def month_averages(t):
    return op.month_averages(op.month_matrix(op.quake_events(t.quakes), 1995, 2001))


@query("busiest_months", """WITH c AS (SELECT year, month, count(*) AS n FROM {quakes} GROUP BY year, month),
r AS (SELECT year, month, n FROM c ORDER BY n DESC, year, month LIMIT 1),
k AS (SELECT month, count(*) AS n FROM {quakes} GROUP BY month ORDER BY n DESC, month LIMIT 1)
SELECT r.year, r.month, r.n AS count, k.month AS calendar_month, k.n AS calendar_total,
  round_even(k.n / (SELECT count(*) FROM {quakes}), 4) AS calendar_share FROM r, k""")
def busiest_months(t):
    return op.busiest_months(op.month_matrix(op.quake_events(t.quakes), 1995, 2001))


@query("day_statistics", """SELECT CAST(DATE '2001-12-31' - DATE '1995-01-01' + 1 AS BIGINT) AS period_days,
  count(DISTINCT event_date) AS days_with_event,
  round_even(count(DISTINCT event_date) / (DATE '2001-12-31' - DATE '1995-01-01' + 1), 4) AS share_days_with_event,
  round_even(count(*) / (DATE '2001-12-31' - DATE '1995-01-01' + 1), 4) AS average_per_day FROM {quakes}""")
def day_statistics(t):
    return op.day_statistics(op.quake_events(t.quakes), 1995, 2001)


@query("top_days", """WITH e AS (SELECT event_date AS date, magnitude AS rank,
    'M' || printf('%.1f', magnitude) || ' ' || coalesce(place, 'unknown place') AS label FROM {quakes}),
d AS (SELECT date, count(*) AS count FROM e GROUP BY date ORDER BY count DESC, date LIMIT 5),
l AS (SELECT date, label, row_number() OVER (PARTITION BY date ORDER BY rank DESC, label) AS place FROM e JOIN d USING (date))
SELECT CAST(date AS STRING) AS date, count, greatest(count - 8, 0) AS more,
  (SELECT string_agg(label, '; ' ORDER BY place) FROM l WHERE l.date = d.date AND place <= 8) AS events FROM d""")
def top_days(t):
    out = op.top_days(op.quake_events(t.quakes))
    return out.withColumns({"events": F.array_join("events", "; "), "date": F.col("date").cast("string")})


@query("day_of_year_counts", """SELECT s.slot, count(q.id) AS count FROM (SELECT CAST(range AS BIGINT) AS slot FROM range(1, 367)) s
LEFT JOIN {quakes} q ON dayofyear(make_date(2000, month(event_date), day(event_date))) = s.slot GROUP BY s.slot""")
def day_of_year_counts(t):
    return op.day_of_year_counts(op.quake_events(t.quakes))


@query("year_day_lists", """SELECT year, string_agg(d || ':' || n, ',' ORDER BY d) AS days FROM (
  SELECT year, dayofyear(event_date) AS d, count(*) AS n FROM {quakes} GROUP BY ALL) q GROUP BY year""")
def year_day_lists(t):
    pair = F.transform("days", lambda x: F.concat(x["day"].cast("string"), F.lit(":"), x["count"].cast("string")))
    return op.year_day_lists(op.quake_events(t.quakes)).withColumn("days", F.array_join(pair, ","))


@query("calendar_position", """SELECT CAST(d AS STRING) AS date, n AS count,
  CAST(floor((isodow(date_trunc('year', d)) - 1 + dayofyear(d) - 1) / 7) AS BIGINT) AS week,
  CAST(isodow(d) - 1 AS BIGINT) AS weekday FROM (SELECT event_date AS d, count(*) AS n FROM {quakes} GROUP BY event_date) q""")
def calendar_position(t):
    out = op.calendar_position(op.day_counts(op.quake_events(t.quakes)))
    return out.withColumn("date", F.col("date").cast("string"))


# ── statistics ──────────────────────────────────────────────────────────────


@query("trend_verdicts", """WITH w AS (SELECT * FROM {world_yearly} WHERE year >= 1980),
r AS (SELECT type, year, n_events, rank() OVER (PARTITION BY type ORDER BY year)
    + (count(*) OVER (PARTITION BY type, year) - 1) / 2 AS ry, rank() OVER (PARTITION BY type ORDER BY n_events)
    + (count(*) OVER (PARTITION BY type, n_events) - 1) / 2 AS rv FROM w)
SELECT type, round(corr(ry, rv), 3) AS spearman_rho, round(regr_slope(n_events, year), 6) AS slope_per_year,
  min(year) AS from_year, max(year) AS to_year, count(*) AS n_years FROM r GROUP BY type""")
def trend_verdicts(t):
    out = stats.trend_verdicts(t.world_yearly.filter("year >= 1980"), ["type"], "year", "n_events")
    return out.drop("direction", "p_value").withColumn("slope_per_year", F.round("slope_per_year", 6))


# The two-sided tail of a rank correlation r over n years is the share of cos(x)^(n - 3) beyond asin(|r|), by Simpson's rule.
@query("trend_directions", """WITH w AS (SELECT type, year, deaths FROM {world_yearly}),
r AS (SELECT *, rank() OVER (PARTITION BY type ORDER BY year) + (count(*) OVER (PARTITION BY type, year) - 1) / 2 AS ry,
  rank() OVER (PARTITION BY type ORDER BY deaths) + (count(*) OVER (PARTITION BY type, deaths) - 1) / 2 AS rv FROM w),
s AS (SELECT type, count(*) AS n, count(DISTINCT deaths) AS kinds, corr(ry, rv) AS rho, regr_slope(deaths, year) AS slope,
  min(year) AS from_year, max(year) AS to_year FROM r GROUP BY type),
grid AS (SELECT k, CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS weight FROM range(2001) g(k)),
p AS (SELECT type, (pi() / 2 - asin(abs(rho))) * sum(weight * pow(abs(cos(asin(abs(rho)) + (pi() / 2 - asin(abs(rho))) * k / 2000)), n - 3))
  / (pi() / 2 * sum(weight * pow(abs(cos(pi() / 2 * k / 2000)), n - 3))) AS p FROM s, grid WHERE n >= 5 AND kinds >= 2 GROUP BY type, rho, n)
SELECT type, CASE WHEN n < 5 OR kinds < 2 THEN 'insufficient' WHEN p >= 0.05 THEN 'no clear trend' WHEN rho > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
  CASE WHEN p IS NOT NULL THEN round(rho, 3) END AS spearman_rho, round(p, 4) AS p_value, CASE WHEN p IS NOT NULL THEN round(slope, 6) END AS slope_per_year,
  from_year, to_year, n AS n_years FROM s LEFT JOIN p USING (type)""")
def trend_directions(t):
    out = stats.trend_verdicts(t.world_yearly, ["type"], "year", "deaths")
    return out.withColumn("slope_per_year", F.round("slope_per_year", 6))


@query("correlations", f"""WITH {INR_SQL},
b AS (SELECT type, CAST(deaths AS DOUBLE) AS x, damages_inr AS y FROM inr WHERE deaths > 0 AND damages_inr > 0),
r AS (SELECT *, rank() OVER (PARTITION BY type ORDER BY x) + (count(*) OVER (PARTITION BY type, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY type ORDER BY y) + (count(*) OVER (PARTITION BY type, y) - 1) / 2 AS ry FROM b)
SELECT type, count(*) AS n, round(corr(log10(x), log10(y)), 3) AS pearson_log, round(corr(rx, ry), 3) AS spearman
FROM r GROUP BY type""")
def correlations(t):
    return stats.correlations(records_inr(t), ["type"], "deaths", "damages_inr").select(
        "type", "n", "pearson_log", "spearman")


# The two-sided tails as in ``trend_directions``, of both coefficients.
@query("correlation_tests", f"""WITH {INR_SQL},
b AS (SELECT type, CAST(total_affected AS DOUBLE) AS x, damages_inr AS y FROM inr WHERE total_affected > 0 AND damages_inr > 0),
r AS (SELECT *, rank() OVER (PARTITION BY type ORDER BY x) + (count(*) OVER (PARTITION BY type, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY type ORDER BY y) + (count(*) OVER (PARTITION BY type, y) - 1) / 2 AS ry FROM b),
c AS (SELECT type, count(*) AS n, unnest([{{'kind': 'pearson', 'r': corr(log10(x), log10(y))}}, {{'kind': 'spearman', 'r': corr(rx, ry)}}]) AS c FROM r GROUP BY type),
g AS (SELECT k, CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS weight FROM range(4001) g(k))
SELECT type, c.kind AS kind, round((pi() / 2 - asin(abs(c.r))) * sum(weight * pow(abs(cos(asin(abs(c.r)) + (pi() / 2 - asin(abs(c.r))) * k / 4000)), n - 3))
  / (pi() / 2 * sum(weight * pow(abs(cos(pi() / 2 * k / 4000)), n - 3))), 5) AS p FROM c, g GROUP BY type, c.kind, c.r, n""")
def correlation_tests(t):
    out = stats.correlations(records_inr(t), ["type"], "total_affected", "damages_inr")
    tests = F.explode(F.array(F.struct(F.lit("pearson").alias("kind"), F.col("pearson_p").alias("p")),
                              F.struct(F.lit("spearman").alias("kind"), F.col("spearman_p").alias("p"))))
    return out.select("type", tests.alias("x")).select("type", "x.kind", F.round("x.p", 5).alias("p"))


@query("average_ranks", """SELECT DISTINCT l_returnflag, l_extendedprice, rank() OVER (PARTITION BY l_returnflag
  ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS rank FROM {lineitem}""")
def average_ranks(t):
    return ranking.average_ranks(t.lineitem, ["l_returnflag"], "l_extendedprice", "rank")


@query("exact_median", """SELECT l_returnflag, round(median(l_extendedprice), 6) AS median FROM {lineitem} GROUP BY 1""")
def exact_median(t):
    return rounded(ranking.exact_quantile(t.lineitem, ["l_returnflag"], "l_extendedprice", 0.5, "median"))


CHI_SQL = """days(month, d) AS (VALUES (1, 31), (2, 28.25), (3, 31), (4, 30), (5, 31), (6, 30), (7, 31), (8, 31), (9, 30),
    (10, 31), (11, 30), (12, 31))"""


@query("storm_seasonality", f"""WITH {CHI_SQL}, c AS (SELECT d.month, d.d, count(s.sid) AS n FROM days d
    LEFT JOIN {{storms}} s ON s.month = d.month GROUP BY ALL), tot AS (SELECT sum(n) AS n FROM c),
p AS (SELECT month, n FROM c ORDER BY n DESC, month LIMIT 1),
s3 AS (SELECT a.month, a.n + b.n + e.n AS n FROM c a JOIN c b ON b.month = a.month % 12 + 1
    JOIN c e ON e.month = (a.month + 1) % 12 + 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT p.month AS peak_month, p.n AS peak_count, round(p.n / tot.n, 6) AS peak_share, s3.month AS season_start,
  CAST(s3.n AS BIGINT) AS season_count, round(s3.n / tot.n, 6) AS season_share,
  round((SELECT sum((c.n - tot.n * d / 365.25) * (c.n - tot.n * d / 365.25) / (tot.n * d / 365.25)) FROM c), 2) AS chi2,
  CAST(tot.n AS BIGINT) AS total FROM p, s3, tot""")
def storm_seasonality(t):
    return rounded(stats.seasonality(t.storms, "month").drop("p_value", "seasonal"))


@query("month_counts", """SELECT m.month, count(s.sid) AS count FROM (SELECT range AS month FROM range(1, 13)) m
LEFT JOIN {storms} s USING (month) GROUP BY m.month""")
def month_counts(t):
    return stats.month_counts(t.storms, "month")


@query("hemisphere_months", """SELECT m.month, count(s.sid) AS count, count(CASE WHEN lmi_latitude >= 0 THEN 1 END) AS north,
  count(CASE WHEN lmi_latitude < 0 THEN 1 END) AS south FROM (SELECT range AS month FROM range(1, 13)) m
LEFT JOIN {storms} s USING (month) GROUP BY m.month""")
def hemisphere_months(t):
    return stats.hemisphere_months(t.storms)


@query("quake_seasonality", """WITH thin AS (SELECT DISTINCT year, month, floor(latitude / 5) AS a, floor(longitude / 5) AS b
  FROM {quakes}) SELECT (SELECT count(*) FROM {quakes}) AS total, count(*) AS robust_n FROM thin""")
def quake_seasonality(t):
    return stats.quake_seasonality(t.quakes).select("total", "robust_n")


def season_sql(name, rows):
    """Busiest month, season and chi-square test of ``rows``; the tail is taken by Simpson's rule."""
    return f"""{name}_c AS (SELECT m.month, m.days, count(q.month) AS n FROM (SELECT range AS month, ([31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[range]
    AS days FROM range(1, 13)) m LEFT JOIN {rows} q ON q.month = m.month GROUP BY m.month, m.days),
{name}_t AS (SELECT *, sum(n) OVER () AS total, sum(days) OVER () AS year_days FROM {name}_c),
{name}_s AS (SELECT a.month, sum(b.n) AS n FROM {name}_c a JOIN {name}_c b ON (b.month - a.month + 12) % 12 < 3 GROUP BY a.month),
{name}_x AS (SELECT CAST(arg_max(month, n * 100 - month) AS INT) AS peak_month, max(n) AS peak_count, CAST(any_value(total) AS BIGINT) AS total,
  sum((n - total * days / year_days) * (n - total * days / year_days) / (total * days / year_days)) AS chi2 FROM {name}_t HAVING any_value(total) > 0),
{name} AS (SELECT x.*, y.season_start, y.season_count, z.p FROM {name}_x x,
  (SELECT CAST(arg_max(month, n * 100 - month) AS INT) AS season_start, CAST(max(n) AS BIGINT) AS season_count FROM {name}_s) y,
  (SELECT sum(weight * pow(chi2 + 400.0 * k / 20000, 4.5) * exp(-(chi2 + 400.0 * k / 20000) / 2)) * (400.0 / 20000 / 3) / (pow(2, 5.5) * gamma(5.5)) AS p
    FROM {name}_x, grid) z)"""


@query("quake_season_verdict", f"""WITH grid AS (SELECT k, CASE WHEN k = 0 OR k = 20000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS weight FROM range(20001) g(k)),
thin AS (SELECT DISTINCT year, month, floor(latitude / 5) AS a, floor(longitude / 5) AS b FROM {{quakes}}),
{season_sql("raw", "{quakes}")},
{season_sql("robust", "thin")}
SELECT r.peak_month, r.peak_count, r.peak_count / r.total AS peak_share, r.season_start, r.season_count, r.season_count / r.total AS season_share,
  round(r.chi2, 2) AS chi2, round(r.p, 6) AS p_value, r.p < 0.05 AND t.p < 0.05 AND t.season_start = r.season_start AS seasonal, r.total,
  t.total AS robust_n, t.season_start AS robust_season_start, round(t.p, 6) AS robust_p, t.p < 0.05 AND t.season_start = r.season_start AS stable
FROM raw r, robust t""")
def quake_season_verdict(t):
    out = stats.quake_seasonality(t.quakes)
    return out.withColumns({"p_value": F.round("p_value", 6), "robust_p": F.round("robust_p", 6)})


@query("storm_season_verdict", f"""WITH grid AS (SELECT k, CASE WHEN k = 0 OR k = 20000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS weight FROM range(20001) g(k)),
{season_sql("raw", "{storms}")}
SELECT peak_month, season_start, round(chi2, 2) AS chi2, round(p, 6) AS p_value, p < 0.05 AS seasonal, total FROM raw""")
def storm_season_verdict(t):
    out = stats.seasonality(t.storms, "month").select("peak_month", "season_start", "chi2", "p_value", "seasonal", "total")
    return out.withColumn("p_value", F.round("p_value", 6))


@query("inventory_labels", """SELECT CAST(start_date AS STRING) AS date, coalesce(deaths, 0) AS rank, CASE WHEN o % 3 = 0 THEN 'India' ELSE district END
  || ' (IFI ' || o || ')' AS label FROM (SELECT *, CAST(substr(uei, 2) AS BIGINT) AS o FROM {flood_events}) q""")
def inventory_labels(t):
    """Events of a national inventory, where a blank state reads as the country."""
    number = F.substr("uei", F.lit(2))
    rows = t.flood_events.select(
        F.concat(F.lit("UEI-IMD-FL-"), number).alias("uei"), F.when(number.cast("long") % 3 == 0, "").otherwise(F.col("district")).alias("state"),
        F.col("start_date").alias("start"), "deaths")
    return op.inventory_events(rows).withColumn("date", F.col("date").cast("string"))
