"""Weather, label and panel queries."""

from pyspark.sql import functions as F

from tidewatch.catalog import query
from tidewatch.catalog.impact import rounded
from tidewatch.operators import panel as op

FIRST, LAST = "1995-01-01", "2001-10-31"
NORMAL = (1996, 2000)

DENSE_SQL = """daily AS (SELECT c.cell, d.day, s.rain_mm, s.soil_wetness FROM (SELECT DISTINCT cell FROM {daily_sparse}) c
  CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-10-31', INTERVAL 1 DAY)) AS DATE) AS day) d
  LEFT JOIN {daily_sparse} s ON s.cell = c.cell AND s.day = d.day)"""

FEATURE_SQL = f"""{DENSE_SQL},
three AS (SELECT *, CASE WHEN count(rain_mm) OVER w = 3 THEN sum(rain_mm) OVER w END AS t3 FROM daily
  WINDOW w AS (PARTITION BY cell, date_trunc('month', day) ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
soil AS (SELECT cell, day, avg(soil_wetness) OVER (PARTITION BY cell ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
  AS before FROM daily),
m AS (SELECT cell, CAST(year(day) AS BIGINT) AS year, CAST(month(day) AS BIGINT) AS month, sum(rain_mm) AS rain_mm,
  count(rain_mm) AS days, max(t3) AS max3 FROM three GROUP BY ALL),
norm AS (SELECT cell, month, avg(rain_mm) AS normal_mm FROM m WHERE year BETWEEN 1996 AND 2000 GROUP BY ALL),
feat AS (SELECT m.cell, m.year, m.month, m.rain_mm, m.days, m.max3, s.before, n.normal_mm,
  CASE WHEN n.normal_mm > 0 THEN least(m.rain_mm / n.normal_mm * 100, 1000) END AS pct
  FROM m LEFT JOIN norm n ON n.cell = m.cell AND n.month = m.month
  LEFT JOIN soil s ON s.cell = m.cell AND day(s.day) = 1 AND year(s.day) = m.year AND month(s.day) = m.month)"""

LABEL_SQL = """touch AS (SELECT DISTINCT district, uei, deaths, CAST(year(d) AS BIGINT) AS year, CAST(month(d) AS BIGINT) AS month
  FROM (SELECT *, unnest(generate_series(date_trunc('month', start_date)::DATE, end_date, INTERVAL 1 MONTH)) AS d
    FROM {flood_events}) q WHERE year(d) BETWEEN 1995 AND 2001),
lab AS (SELECT d.district, y.year, m.month, count(t.uei) AS events,
  CAST(coalesce(max(CASE WHEN t.deaths >= 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS deadly, sum(t.deaths) AS event_deaths,
  CAST(count(t.uei) > 0 AS BIGINT) AS flood
  FROM {districts} d CROSS JOIN (SELECT CAST(range AS BIGINT) AS year FROM range(1995, 2002)) y
  CROSS JOIN (SELECT CAST(range AS BIGINT) AS month FROM range(1, 13)) m
  LEFT JOIN touch t ON t.district = d.district AND t.year = y.year AND t.month = m.month
  GROUP BY d.district, y.year, m.month)"""

def dense(t):
    return op.dense_days(t.daily_sparse, "cell", FIRST, LAST)


def features(t):
    return op.month_features(dense(t), "cell", 2001, NORMAL)


def labels(t):
    return op.month_labels(t.flood_events, t.districts, 1995, 2001)


@query("parse_daily", """SELECT cell, CAST(day AS STRING) AS day, CASE WHEN day(day) = 13 THEN NULL ELSE rain_mm END AS rain_mm,
  soil_wetness FROM {daily_sparse}""")
def parse_daily(t):
    """The daily rows written as the service's JSON and read back; the 13th carries the fill value."""
    stamp = F.date_format("day", "yyyyMMdd")
    rain = F.when(F.dayofmonth("day") == 13, F.lit(-999.0)).otherwise(F.col("rain_mm"))
    year = F.year("day").alias("_y")
    maps = t.daily_sparse.groupBy("cell", year).agg(
        F.map_from_entries(F.collect_list(F.struct(stamp, rain))).alias("PRECTOTCORR"),
        F.map_from_entries(F.collect_list(F.struct(stamp, "soil_wetness"))).alias("GWETROOT"))
    body = F.to_json(F.struct(F.struct(F.struct("PRECTOTCORR", "GWETROOT").alias("parameter")).alias("properties")))
    out = op.parse_daily(maps.select("cell", body.alias("body")), "cell", "body")
    return out.withColumn("day", F.col("day").cast("string"))


@query("dense_days", f"""WITH {DENSE_SQL} SELECT cell, count(*) AS days, count(rain_mm) AS with_rain,
  CAST(min(day) AS STRING) AS first_day, CAST(max(day) AS STRING) AS last_day FROM daily GROUP BY cell""")
def dense_days(t):
    return dense(t).groupBy("cell").agg(
        F.count("*").alias("days"), F.count("rain_mm").alias("with_rain"),
        F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


@query("month_features", f"""WITH {FEATURE_SQL} SELECT cell, year, month, round(rain_mm, 4) AS rain_mm, days,
  round(max3, 4) AS max_3day_rain_mm, round(before, 6) AS soil_wetness_before, round(normal_mm, 6) AS normal_mm,
  round(pct, 6) AS rain_pct_normal FROM feat""")
def month_features(t):
    out = rounded(features(t), 4, ["rain_mm", "max_3day_rain_mm"])
    return rounded(out, 6, ["soil_wetness_before", "normal_mm", "rain_pct_normal"])


@query("antecedent_soil", f"""WITH {FEATURE_SQL} SELECT cell, year, month, round(before, 6) AS soil_wetness_before FROM feat""")
def antecedent_soil(t):
    return rounded(features(t).select("cell", "year", "month", "soil_wetness_before"))


WINDOW_SQL = f"""{DENSE_SQL}, win AS (SELECT cell, max(day) AS as_of, CAST(max(day) - 29 AS DATE) AS window_start FROM daily
    WHERE rain_mm IS NOT NULL GROUP BY cell),
inw AS (SELECT d.*, w.window_start, w.as_of FROM daily d JOIN win w USING (cell) WHERE day BETWEEN window_start AND as_of),
t3 AS (SELECT *, CASE WHEN count(rain_mm) OVER w = 3 THEN sum(rain_mm) OVER w END AS r3 FROM inw
  WINDOW w AS (PARTITION BY cell ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
facts AS (SELECT cell, any_value(window_start) AS window_start, any_value(as_of) AS as_of, count(rain_mm) AS days,
  sum(rain_mm) AS rain, max(r3) AS max3 FROM t3 GROUP BY cell),
soil AS (SELECT d.cell, avg(soil_wetness) AS soil FROM daily d JOIN win w USING (cell)
  WHERE day BETWEEN window_start - 7 AND window_start - 1 GROUP BY d.cell),
nrm AS (SELECT w.cell, sum(d.rain_mm) / 5 AS normal FROM win w
  CROSS JOIN (SELECT unnest(range(1996, 2001)) AS y) y
  JOIN daily d ON d.cell = w.cell AND d.day BETWEEN make_date(y.y, month(window_start), day(window_start))
    AND make_date(y.y, month(as_of), day(as_of)) GROUP BY w.cell)"""


@query("window_features", f"""WITH {WINDOW_SQL} SELECT cell, CAST(window_start AS STRING) AS window_start, CAST(as_of AS STRING) AS as_of,
  days, round_even(rain, 1) AS rain_mm, round(normal, 4) AS normal_mm, round_even(max3, 1) AS max_3day_rain_mm,
  round_even(soil, 3) AS soil_wetness_before FROM facts JOIN soil USING (cell) JOIN nrm USING (cell)""")
def window_features(t):
    daily = dense(t)
    windows = op.latest_window(daily, "cell")
    out = op.window_features(daily, "cell", windows, NORMAL).drop("normal_mm", "rain_pct_normal")
    usual = op.normal_rain(daily, "cell", windows, NORMAL).withColumn("normal_mm", F.round("normal_mm", 4))
    return out.join(usual, "cell").withColumns({
        "window_start": F.col("window_start").cast("string"), "as_of": F.col("as_of").cast("string")})


@query("normal_over_new_year", f"""WITH {DENSE_SQL} SELECT cell, round(sum(rain_mm) / 5, 4) AS normal_mm FROM daily
JOIN (SELECT unnest(range(1996, 2001)) AS y) y ON day BETWEEN make_date(y, 12, 20) AND make_date(y + 1, 1, 18) GROUP BY cell""")
def normal_over_new_year(t):
    windows = t.districts.select("cell").distinct().select(
        "cell", F.lit("2000-12-20").cast("date").alias("window_start"), F.lit("2001-01-18").cast("date").alias("as_of"))
    return rounded(op.normal_rain(dense(t), "cell", windows, NORMAL), 4)


@query("touched_months", f"""WITH {LABEL_SQL} SELECT uei, district, deaths, year, month FROM touch""")
def touched_months(t):
    return op.touched_months(t.flood_events, 1995, 2001)


@query("month_labels", f"""WITH {LABEL_SQL} SELECT district, year, month, events, deadly, event_deaths, flood FROM lab""")
def month_labels(t):
    return labels(t)


@query("district_history", f"""WITH {LABEL_SQL} SELECT district, count(*) AS ifi_seasons, CAST(sum(f) AS BIGINT) AS ifi_flood_seasons,
  CAST(sum(d) AS BIGINT) AS ifi_deadly_seasons, min(year) AS ifi_first_year
FROM (SELECT district, year, max(flood) AS f, max(deadly) AS d FROM lab GROUP BY ALL) q GROUP BY district""")
def district_history(t):
    return op.district_history(labels(t))


@query("prior_rates", f"""WITH {LABEL_SQL}, yearly AS (SELECT district, year, max(flood) AS flood FROM lab GROUP BY ALL)
SELECT d.district, y.year, (SELECT round(avg(flood), 6) FROM yearly x WHERE x.district = d.district
   AND x.year BETWEEN least(y.year - 1, 2001) - 9 AND least(y.year - 1, 2001)) AS prior_flood_rate
FROM {{districts}} d CROSS JOIN (SELECT CAST(range AS BIGINT) AS year FROM range(1995, 2005)) y""")
def prior_rates(t):
    return rounded(op.prior_rates(labels(t), (1995, 2004)))


@query("annual_rain", f"""WITH {DENSE_SQL}, y AS (SELECT cell, CAST(year(day) AS BIGINT) AS year, sum(rain_mm) AS rain FROM daily GROUP BY ALL)
SELECT state, year, round_even(avg(rain), 1) AS annual_rainfall_mm FROM y
JOIN (SELECT DISTINCT state, cell FROM {{districts}}) d USING (cell) GROUP BY state, year""")
def annual_rain(t):
    return op.annual_rain(dense(t), "cell", t.districts, "state")


@query("build_panel", f"""WITH {FEATURE_SQL}, {LABEL_SQL}, yearly AS (SELECT district, year, max(flood) AS flood FROM lab GROUP BY ALL)
SELECT d.district, d.state, f.year, f.month, d.elevation_m, f.days, round_even(f.rain_mm, 1) AS rain_mm,
  round_even(f.max3, 1) AS max_3day_rain_mm, l.events, l.event_deaths, l.deadly, l.flood,
  round_even((SELECT avg(flood) FROM yearly x WHERE x.district = d.district AND x.year BETWEEN f.year - 10 AND f.year - 1), 3)
    AS prior_flood_rate
FROM {{districts}} d JOIN feat f USING (cell) JOIN lab l ON l.district = d.district AND l.year = f.year AND l.month = f.month""")
def build_panel(t):
    rows = labels(t)
    out = op.build_panel(t.districts, features(t), op.prior_rates(rows, (1995, 2001)), rows)
    return out.drop("soil_wetness_before", "normal_mm", "rain_pct_normal")


@query("enrich_districts", f"""WITH {LABEL_SQL}, h AS (SELECT district, CAST(sum(f) AS BIGINT) AS ifi_flood_seasons FROM (
  SELECT district, year, max(flood) AS f FROM lab GROUP BY ALL) q GROUP BY district)
SELECT d.district, d.state, d.population, d.elevation_m AS zonal_m, h.ifi_flood_seasons FROM {{districts}} d JOIN h USING (district)""")
def enrich_districts(t):
    zonal = t.districts.select("district", F.col("elevation_m").alias("zonal_m"))
    return op.enrich_districts(t.districts.drop("elevation_m"), zonal, op.district_history(labels(t))).select(
        "district", "state", "population", "zonal_m", "ifi_flood_seasons")


@query("restrict_states", "SELECT district, state FROM {districts} WHERE state IN ('State 1', 'State 4')")
def restrict_states(t):
    return op.restrict_states(t.districts, ["State 1", "State 4"]).select("district", "state")


@query("tidy_flags", """SELECT year, CAST(sum(q) AS BIGINT) AS annual_rainfall, CAST(sum(q) % 3 = 0 AS BIGINT) AS floods FROM (
  SELECT CAST(year(l_shipdate) AS BIGINT) AS year, CAST(l_quantity AS BIGINT) AS q FROM {lineitem}) x GROUP BY year""")
def tidy_flags(t):
    year = F.year("l_shipdate").cast("long").alias(" YEAR")
    rain = t.lineitem.groupBy(year).agg(F.sum(F.col("l_quantity").cast("long")).alias("Annual Rainfall"))
    raw = rain.withColumn("FLOODS", F.when(F.col("Annual Rainfall") % 3 == 0, " yes ").otherwise("No"))
    return op.tidy_flags(raw, "floods")
