"""Model, hazard-index and outlook queries."""

from pyspark.sql import functions as F

from tidewatch.catalog import query
from tidewatch.catalog.impact import rounded
from tidewatch.catalog.spatial import QUAKE_SQL, STORM_SQL
from tidewatch.functions import scales, text
from tidewatch.operators import spatial
from tidewatch.plans import outlook, risk

FIT = risk.Fit(
    means={"rain_pct_normal": 120.0, "max_3day_rain_mm": 45.0, "soil_wetness_before": 0.5, "elevation_m": 400.0,
           "prior_flood_rate": 0.4},
    scales={"rain_pct_normal": 60.0, "max_3day_rain_mm": 8.0, "soil_wetness_before": 0.1, "elevation_m": 250.0,
            "prior_flood_rate": 0.3},
    coefs={"rain_pct_normal": 0.9, "max_3day_rain_mm": 0.4, "soil_wetness_before": 0.2, "elevation_m": -0.3,
           "prior_flood_rate": 0.6},
    intercept=-0.5, regions={f"State {i}": (i - 2) / 4 for i in range(5)})

LOGIT = """(-0.5 + coalesce(CASE WHEN CAST(substr(state, 7) AS INT) <= 4 THEN (CAST(substr(state, 7) AS INT) - 2) / 4 END, 0)
  + (rain_pct_normal - 120) / 60 * 0.9 + (max_3day_rain_mm - 45) / 8 * 0.4 + (soil_wetness_before - 0.5) / 0.1 * 0.2
  + (elevation_m - 400) / 250 * -0.3 + (prior_flood_rate - 0.4) / 0.3 * 0.6)"""
LEVEL = "CASE WHEN {0} >= 0.75 THEN 'critical' WHEN {0} >= 0.5 THEN 'high' WHEN {0} >= 0.25 THEN 'medium' ELSE 'low' END"


def metric_sql(keys: str, threshold: float) -> str:
    part, by, group = (f"PARTITION BY {keys} ", f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "", "")
    using = f"USING ({keys})" if keys else "ON true"
    return f"""d AS (SELECT {by}probability AS s, sum(flood) AS p, count(*) - sum(flood) AS n FROM {{panel}} GROUP BY ALL),
c AS (SELECT *, sum(p) OVER ({part}ORDER BY s DESC) AS cp, sum(n) OVER ({part}ORDER BY s DESC) AS cn FROM d),
tot AS (SELECT {by}sum(p) AS tp_, sum(n) AS tn_ FROM d {group}),
curve AS (SELECT {('c.' + keys + ', ') if keys else ''}sum(p * (tn_ - cn + n / 2)) / any_value(tp_ * tn_) AS auc,
  sum(p / tp_ * cp / (cp + cn)) AS ap FROM c JOIN tot {using} WHERE tp_ > 0 AND tn_ > 0 {('GROUP BY c.' + keys) if keys else ''}),
k AS (SELECT {by}count(*) AS n, CAST(sum(flood) AS BIGINT) AS positives,
  count(CASE WHEN flood = 1 AND probability >= {threshold} THEN 1 END) AS tp, count(CASE WHEN flood = 0 AND probability >= {threshold} THEN 1 END) AS fp,
  count(CASE WHEN flood = 0 AND probability < {threshold} THEN 1 END) AS tn, count(CASE WHEN flood = 1 AND probability < {threshold} THEN 1 END) AS fn,
  avg((probability - flood) * (probability - flood)) AS brier FROM {{panel}} {group})"""


@query("model_metrics", f"""WITH {metric_sql('', 0.5)} SELECT 0.5 AS threshold, n, positives, tp, fp, tn, fn, round_even((tp + tn) / n, 3) AS accuracy,
  round_even(coalesce(tp / (tp + fp), 0), 3) AS precision, round_even(coalesce(tp / (tp + fn), 0), 3) AS recall,
  round_even(coalesce(2 * tp / (2 * tp + fp + fn), 0), 3) AS f1, round_even(auc, 3) AS roc_auc, round_even(ap, 3) AS average_precision,
  round_even(brier, 3) AS brier FROM k JOIN curve ON true""".replace("0.5 AS threshold", "CAST(0.5 AS DOUBLE) AS threshold"))
def model_metrics(t):
    return risk.metrics(t.panel)


@query("region_metrics", f"""WITH {metric_sql('state', 0.5)}, a AS (SELECT state, count(DISTINCT district) AS districts,
  count(CASE WHEN flood = 1 AND probability >= 0.25 THEN 1 END) AS tp2, count(CASE WHEN flood = 0 AND probability >= 0.25 THEN 1 END) AS fp2
  FROM {{panel}} GROUP BY state)
SELECT state, districts, n, positives, round_even(positives / n, 3) AS positive_rate,
  CASE WHEN positives >= 20 AND positives < n THEN round_even(auc, 3) END AS roc_auc,
  CASE WHEN positives > 0 THEN round_even(coalesce(tp / (tp + fp), 0), 3) END AS precision,
  CASE WHEN positives > 0 THEN round_even(tp / positives, 3) END AS recall,
  CASE WHEN positives > 0 THEN round_even(coalesce(tp2 / (tp2 + fp2), 0), 3) END AS precision_action,
  CASE WHEN positives > 0 THEN round_even(tp2 / positives, 3) END AS recall_action FROM k JOIN a USING (state) LEFT JOIN curve USING (state)""")
def region_metrics(t):
    return risk.region_metrics(t.panel)


KNOWN = [("Wet one", "flood", 1998, 8, "State 1"), ("Wet one", "flood", 1998, 8, "State 2"), ("Quiet one", "quiet", 1999, 2, "State 3"),
         ("Second", "quiet", 1998, 8, "State 4")]
KNOWN_SQL = ("known(name, expect, year, month, state) AS (VALUES " + ", ".join(
    f"('{n}', '{e}', {y}, {m}, '{s}')" for n, e, y, m, s in KNOWN) + ")")


def known_months(t):
    return t.spark.createDataFrame(KNOWN, "name string, expect string, year long, month long, state string")


@query("backtests", f"""WITH {KNOWN_SQL}, r AS (SELECT k.name, k.expect, p.*, {LEVEL.format('probability')} AS level FROM {{panel}} p
  JOIN known k ON k.year = p.year AND k.month = p.month AND k.state = p.state)
SELECT name, expect, count(*) AS district_count, count(CASE WHEN flood = 1 THEN 1 END) AS observed_floods,
  count(CASE WHEN level IN ('high', 'critical') THEN 1 END) AS flagged_high, count(CASE WHEN level <> 'low' THEN 1 END) AS flagged_medium_up,
  count(CASE WHEN level IN ('high', 'critical') AND flood = 1 THEN 1 END) AS flagged_and_observed,
  count(CASE WHEN level <> 'low' AND flood = 1 THEN 1 END) AS medium_up_and_observed, round_even(avg(probability), 3) AS mean_probability
FROM r GROUP BY name, expect""")
def backtests(t):
    return risk.backtests(t.panel, known_months(t))


@query("scenarios", f"""WITH {KNOWN_SQL} SELECT CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month,
  string_agg(DISTINCT name, '; ' ORDER BY name) AS detail, string_agg(DISTINCT state, ',' ORDER BY state) AS states,
  CASE WHEN count(DISTINCT expect) = 1 THEN min(expect) ELSE 'mixed' END AS expect,
  (SELECT count(*) FROM {{panel}} p WHERE p.year = known.year AND p.month = known.month) AS panel_rows
FROM known GROUP BY year, month""")
def scenarios(t):
    out = risk.scenarios(known_months(t).withColumn("note", F.col("name")))
    rows = t.panel.groupBy("year", "month").agg(F.count("*").alias("panel_rows"))
    return out.drop("note").withColumn("states", F.array_join("states", ",")).join(rows, ["year", "month"], "left")


@query("climatology", """WITH tr AS (SELECT * FROM {panel} WHERE year <= 1999), r AS (SELECT district, month, avg(flood) AS p FROM tr
  WHERE month <> 12 GROUP BY ALL)
SELECT t.district, t.year, t.month, round(coalesce(r.p, (SELECT avg(flood) FROM tr WHERE month <> 12)), 6) AS probability
FROM {panel} t LEFT JOIN r ON r.district = t.district AND r.month = t.month WHERE t.year > 1999""")
def climatology(t):
    early = t.panel.filter("year <= 1999 AND month <> 12")
    out = risk.climatology(early, t.panel.filter("year > 1999").drop("probability"))
    return rounded(out.select("district", "year", "month", "probability"))


@query("model_evaluation")
def model_evaluation(t):
    """Fit on the early years and test on the later ones, all models in one table."""
    results = risk.evaluate(t.panel.drop("probability"), until=1999)
    out = None
    for name, df in results.items():
        if name != "by_region":
            part = df.withColumn("model", F.lit(name))
            out = part if out is None else out.unionByName(part)
    return out


@query("model_card")
def model_card(t):
    return risk.model_card(t.spark, risk.train(risk.complete_rows(t.panel.drop("probability"), ["flood"])))


@query("explain_scores", f"""SELECT district, year, month, round(1 / (1 + exp(-{LOGIT})), 3) AS probability,
  {LEVEL.format(f'(1 / (1 + exp(-{LOGIT})))')} AS level, round({LOGIT}, 3) AS log_odds FROM {{panel}}""")
def explain_scores(t):
    out = risk.explain(t.panel.drop("probability"), FIT)
    return out.select("district", "year", "month", "probability", "level", "log_odds")


@query("explain_factors", """SELECT district, year, month, CASE WHEN (rain_pct_normal - 120) / 60 * 0.9 > 0 THEN 'raises' ELSE 'lowers' END AS rain_direction,
  round((rain_pct_normal - 120) / 60 * 0.9, 3) AS rain, CAST(5 + CASE WHEN state = 'State 5' THEN 0 ELSE 1 END AS BIGINT) AS factors FROM {panel}""")
def explain_factors(t):
    out = risk.explain(t.panel.drop("probability"), FIT)
    rain = F.get(F.filter("factors", lambda x: x["key"] == "rain_pct_normal"), 0)
    return out.select("district", "year", "month", rain["direction"].alias("rain_direction"),
                      rain["contribution"].alias("rain"), F.size("factors").cast("long").alias("factors"))


@query("what_if", f"""WITH cur AS (SELECT * FROM {{panel}} WHERE year = 2000 AND month = 7),
asked AS (SELECT o.district, c.district IS NULL AS unknown, o.rain AS rain_pct_normal, c.* EXCLUDE (district, rain_pct_normal)
  FROM (SELECT 'D' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS district, n_nationkey * 60.0 AS rain FROM {{nation}}
    UNION ALL SELECT 'nowhere', 5.0) o LEFT JOIN cur c ON c.district = o.district),
judged AS (SELECT *, CASE WHEN unknown THEN 'unknown district ' || district
  WHEN rain_pct_normal > 1000 THEN 'Rainfall vs normal must be between 0 and 1000 (% of normal)' END AS error FROM asked)
SELECT district, error, CASE WHEN error IS NULL THEN round(1 / (1 + exp(-{LOGIT})), 3) END AS probability,
  CASE WHEN error IS NULL THEN {LEVEL.format(f'(1 / (1 + exp(-{LOGIT})))')} END AS level FROM judged""")
def what_if(t):
    asked = t.nation.select(F.format_string("D%02d", "n_nationkey").alias("district"),
                            (F.col("n_nationkey") * 60.0).alias("rain_pct_normal"))
    asked = asked.unionByName(t.spark.createDataFrame([("nowhere", 5.0)], asked.schema))
    current = t.panel.filter("year = 2000 AND month = 7").drop("probability")
    return risk.what_if(current, asked, FIT).select("district", "error", "probability", "level")


@query("explain_texts", """WITH f AS (SELECT district, year, month, unnest([
    {'key': 'rain_pct_normal', 'part': (rain_pct_normal - 120) / 60 * 0.9, 'avg': 120.0, 'said': 'rainfall vs normal ' || printf('%.0f', round_even(rain_pct_normal, 0)) || '% of normal'},
    {'key': 'max_3day_rain_mm', 'part': (max_3day_rain_mm - 45) / 8 * 0.4, 'avg': 45.0, 'said': 'heaviest 3-day rainfall ' || format('{:,}', CAST(round_even(max_3day_rain_mm, 0) AS BIGINT)) || ' mm'},
    {'key': 'soil_wetness_before', 'part': (soil_wetness_before - 0.5) / 0.1 * 0.2, 'avg': 0.5, 'said': 'soil wetness before ' || printf('%.2f', round_even(soil_wetness_before, 2))},
    {'key': 'elevation_m', 'part': (elevation_m - 400) / 250 * -0.3, 'avg': 400.0, 'said': 'mean elevation ' || format('{:,}', CAST(round_even(elevation_m, 0) AS BIGINT)) || ' m'},
    {'key': 'prior_flood_rate', 'part': (prior_flood_rate - 0.4) / 0.3 * 0.6, 'avg': 0.4, 'said': 'flood history ' || printf('%.0f', round_even(prior_flood_rate * 100, 0)) || '% of past years'},
    {'key': 'state', 'part': CASE WHEN CAST(substr(state, 7) AS INT) <= 4 THEN (CAST(substr(state, 7) AS INT) - 2) / 4 END, 'avg': NULL, 'said': state || '''s baseline'}]) AS x FROM {panel}),
r AS (SELECT district, year, month, x.key AS key, x.part AS part, x.avg AS average, x.said || CASE WHEN x.part > 0 THEN ' raises risk' ELSE ' lowers risk' END AS said,
  row_number() OVER (PARTITION BY district, year, month ORDER BY abs(x.part) DESC, x.key) AS place FROM f WHERE x.part IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY district, year, month ORDER BY abs(round_even(part, 3)) < 0.1, place) AS rank,
  abs(round_even(part, 3)) >= 0.1 AS strong FROM r)
SELECT district, year, month, upper(string_agg(said, '; ' ORDER BY place) FILTER ((strong AND rank <= 3) OR rank = 1)[1])
    || substr(string_agg(said, '; ' ORDER BY place) FILTER ((strong AND rank <= 3) OR rank = 1), 2) || '.' AS summary,
  max(CASE WHEN place = 1 THEN key END) AS first_key, CAST(max(CASE WHEN place = 1 THEN average END) AS DOUBLE) AS first_average,
  CAST(-0.5 AS DOUBLE) AS baseline_log_odds FROM k GROUP BY district, year, month""")
def explain_texts(t):
    out = risk.explain(t.panel.drop("probability"), FIT)
    first = F.get("factors", 0)
    return out.select("district", "year", "month", "summary", first["key"].alias("first_key"),
                      first["average"].alias("first_average"), "baseline_log_odds")


# ── scenarios ───────────────────────────────────────────────────────────────


EARLY = risk.Fit(FIT.means, FIT.scales, FIT.coefs, -1.25, FIT.regions)
EARLY_LOGIT = LOGIT.replace("(-0.5 + ", "(-1.25 + ", 1)


def models(t):
    """The early fit serves past months, the full one the window that starts in 2001."""
    early = risk.model_table(t.spark, EARLY, "early", valid_to="2000-12-31")
    return early.unionByName(risk.model_table(t.spark, FIT, "full", valid_from="2001-01-01"))


def current_window(t):
    rows = t.panel.filter("year = 2001 AND month = 7").drop("probability", "flood", "deadly")
    return rows.withColumns({"window_start": F.lit("2001-07-02"), "as_of": F.lit("2001-07-31")})


def scenario(t, name):
    return risk.predictions(name, t.panel.drop("probability"), current_window(t), t.districts, models(t), known_months(t))


SCORED = ["scenario", "kind", "model", "district", "population", "window_start", "as_of", "probability", "level", "observed", "observed_deadly"]


def scenario_sql(name, logit, first, last, kind, model, seen):
    observed = "p.flood AS observed, p.deadly AS observed_deadly" if seen else (
        "CAST(NULL AS BIGINT) AS observed, CAST(NULL AS BIGINT) AS observed_deadly")
    year, month = int(first[:4]), int(first[5:7])
    return f"""SELECT '{name}' AS scenario, '{kind}' AS kind, '{model}' AS model, p.district, d.population, '{first}' AS window_start,
  '{last}' AS as_of, round(1 / (1 + exp(-{logit})), 3) AS probability, {LEVEL.format(f"(1 / (1 + exp(-{logit})))")} AS level, {observed}
FROM (SELECT * EXCLUDE (elevation_m), elevation_m FROM {{panel}} WHERE year = {year} AND month = {month}) p
LEFT JOIN (SELECT district, population, lat, lon FROM {{districts}}) d ON d.district = p.district"""


@query("predictions_current", scenario_sql("current", LOGIT, "2001-07-02", "2001-07-31", "current", "full", False))
def predictions_current(t):
    return scenario(t, "current").select(SCORED)


@query("predictions_past", scenario_sql("1998-08", EARLY_LOGIT, "1998-08-01", "1998-08-31", "backtest", "early", True))
def predictions_past(t):
    out = scenario(t, "1998-08").select(SCORED)
    return out.withColumns({c: F.col(c).cast("string") for c in ("window_start", "as_of")})


@query("scenario_rows", """SELECT p.district, p.flood, d.population FROM {panel} p LEFT JOIN {districts} d USING (district)
WHERE year = 1998 AND month = 8""")
def scenario_rows(t):
    return risk.scenario_rows(t.panel, t.districts, 1998, 8).select("district", "flood", "population")


@query("region_effects", f"""SELECT state, round_even(avg(flood), 3) AS flood_rate, count(DISTINCT district) AS districts,
  (CAST(substr(state, 7) AS INT) - 2) / 4 AS coefficient FROM {{panel}} WHERE state <> 'State 5' GROUP BY state""")
def region_effects(t):
    return risk.region_effects(t.panel, FIT).drop("odds_ratio")


@query("label_coverage", """SELECT (SELECT count(*) FROM {panel}) AS rows, (SELECT round_even(avg(flood), 3) FROM {panel}) AS positive_rate,
  (SELECT count(DISTINCT district) FROM {panel}) AS districts, (SELECT min(year) FROM {panel}) AS first_year, (SELECT max(year) FROM {panel}) AS last_year,
  count(population) AS with_population, count(*) - count(population) AS without_population FROM {districts}""")
def label_coverage(t):
    return risk.label_coverage(t.panel, t.districts)


@query("not_scored", "SELECT district FROM {districts} WHERE district NOT IN (SELECT district FROM {panel} WHERE month = 3 AND flood = 1)")
def not_scored(t):
    return risk.not_scored(t.districts, risk.complete_rows(t.panel.filter("month = 3 AND flood = 1")))


@query("label_check", """WITH s AS (SELECT year, sum(rain_mm) AS a, CAST(sum(rain_mm) > 800000 AS INT) AS floods FROM {panel} GROUP BY year),
o AS (SELECT year, sum(max_3day_rain_mm) AS b FROM {panel} WHERE year <> 1995 GROUP BY year)
SELECT round_even(corr(a, b), 3) AS r, max(CASE WHEN floods = 0 THEN a END) AS max_no_year, min(CASE WHEN floods = 1 THEN a END) AS min_yes_year,
  round_even(avg(b), 0) AS other_mean, round_even(avg(a), 0) AS own_mean, count(b) AS overlap_years FROM s LEFT JOIN o USING (year)""")
def label_check(t):
    own = t.panel.groupBy("year").agg(F.sum("rain_mm").alias("annual_rainfall"))
    own = own.withColumn("floods", (F.col("annual_rainfall") > 800000).cast("int"))
    other = t.panel.filter("year <> 1995").groupBy("year").agg(F.sum("max_3day_rain_mm").alias("other_rainfall"))
    return risk.label_check(own, other)


@query("level_counts", f"""SELECT l.level, count(p.level) AS count FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) l(level)
LEFT JOIN (SELECT {LEVEL.format('probability')} AS level FROM {{panel}}) p USING (level) GROUP BY l.level""")
def level_counts(t):
    from tidewatch.functions.scales import risk_level

    return risk.level_counts(t.panel.withColumn("level", risk_level(F.col("probability"))))


@query("map_headline", f"""SELECT state, count(*) AS districts, count(CASE WHEN probability >= 0.5 THEN 1 END) AS raised,
  count(CASE WHEN probability >= 0.25 THEN 1 END) AS medium_up, count(CASE WHEN flood = 1 THEN 1 END) AS observed,
  min(rain_pct_normal) AS low_rain, max(rain_pct_normal) AS high_rain, max_by(district, (probability, district)) AS top_district
FROM {{panel}} WHERE year = 1998 AND month = 8 GROUP BY state""")
def map_headline(t):
    from tidewatch.functions.scales import risk_level

    rows = t.panel.filter("year = 1998 AND month = 8").withColumn("level", risk_level(F.col("probability")))
    return risk.map_headline(rows)


@query("by_state", "SELECT district, year, month FROM {panel} WHERE state = 'State 3'")
def by_state(t):
    return risk.by_state(t.panel, "State 3").select("district", "year", "month")


@query("state_options", "SELECT DISTINCT state FROM {panel} WHERE state IS NOT NULL")
def state_options(t):
    return risk.state_options(t.panel)


# ── hazard index ────────────────────────────────────────────────────────────


EXPOSED_SQL = f"""WITH {QUAKE_SQL}, m AS (SELECT b.region, count(h.id) AS m6, count(CASE WHEN h.magnitude >= 7 THEN 1 END) AS m7
    FROM {{region_boxes}} b LEFT JOIN hit h USING (region) GROUP BY b.region),
te AS (SELECT region, 0 AS place, m6 AS events, 1 - exp(-m6 / 76) AS p, 0.4 AS c, 0.15 AS h, 0.05 AS md FROM m
  UNION ALL SELECT region, 1, m7, 1 - exp(-m7 / 76), 0.1, 0.04, 0.01 FROM m),
lv AS (SELECT *, CASE WHEN p >= c THEN 3 WHEN p >= h THEN 2 WHEN p >= md THEN 1 ELSE 0 END AS l FROM te)"""


def quake_regions(t):
    exposure = spatial.quake_exposure(t.quakes, t.region_vertices)
    return spatial.quake_metrics(exposure, t.region_boxes, 76)


@query("index_tests", EXPOSED_SQL + " SELECT region, CAST(place AS BIGINT) AS place, events, round(p, 6) AS probability FROM lv")
def index_tests(t):
    out = risk.index_tests(quake_regions(t), "earthquake", 76).select("region", F.col("place").cast("long").alias("place"), "events", "probability")
    return rounded(out)


@query("hazard_index", EXPOSED_SQL + """ SELECT region, CASE l WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level,
  round(p, 4) AS probability, place AS driver FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY l DESC, p DESC, place) AS rn FROM lv) q WHERE rn = 1""")
def hazard_index(t):
    index = risk.index_summary(risk.hazard_index(quake_regions(t), "earthquake", 76), "earthquake")
    driver = F.when(F.col("driver").startswith("M6"), 0).otherwise(1)
    return risk.index_order(index).select("region", "level", "probability", driver.alias("driver"))


STORM_INDEX_SQL = f"""WITH {STORM_SQL}, sm AS (SELECT b.region, count(p.sid) AS ts, count(CASE WHEN p.max_wind_kt >= 64 THEN 1 END) AS hu
    FROM {{region_boxes}} b LEFT JOIN per p USING (region) GROUP BY b.region),
ste AS (SELECT region, 0 AS place, hu AS events, 1 - exp(-hu / 46) AS p, 0.15 AS c, 0.06 AS h, 0.02 AS md FROM sm
  UNION ALL SELECT region, 1, ts, 1 - exp(-ts / 46), 0.6, 0.3, 0.1 FROM sm),
sl AS (SELECT *, CASE WHEN p >= c THEN 3 WHEN p >= h THEN 2 WHEN p >= md THEN 1 ELSE 0 END AS l FROM ste),
sx AS (SELECT region, CASE l WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level, round(p, 4) AS probability,
  CASE place WHEN 0 THEN 'Hurricane-strength (64 kt+) cyclone within 100 km' ELSE 'Tropical-storm-strength (34 kt+) cyclone within 100 km' END AS driver
  FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY l DESC, p DESC, place) AS rn FROM sl) q WHERE rn = 1)"""


def passed_storms(t):
    return spatial.storm_exposure(spatial.load_tracks(t.track_points), t.region_vertices)


def storm_regions(t):
    return spatial.storm_metrics(passed_storms(t), t.region_boxes, 46)


@query("storm_index", STORM_INDEX_SQL + """, best AS (SELECT * FROM (SELECT region, max_wind_kt, name, season, row_number()
    OVER (PARTITION BY region ORDER BY max_wind_kt DESC, season, sid DESC) AS rn FROM per) q WHERE rn = 1)
SELECT sx.*, CASE WHEN ts = 0 THEN 'No tropical storm passed within 100 km since 1980.' ELSE ts || ' tropical storms within 100 km since 1980'
  || CASE WHEN hu > 0 THEN ', ' || hu || ' at hurricane strength' ELSE '' END || '; strongest '
  || CASE WHEN b.name = 'NOT_NAMED' THEN 'Not_named' ELSE 'Storm ' || substr(b.name, 7) END || ' (' || b.season || ') at '
  || printf('%.0f', b.max_wind_kt) || ' kt.' END AS summary FROM sx JOIN sm USING (region) LEFT JOIN best b USING (region)""")
def storm_index(t):
    index = risk.index_summary(risk.hazard_index(storm_regions(t), "cyclone", 46), "cyclone")
    return index.select("region", "level", "probability", "driver", "summary")


@query("quake_index_texts", EXPOSED_SQL + """, best AS (SELECT * FROM (SELECT region, magnitude, year, row_number() OVER (
    PARTITION BY region ORDER BY magnitude DESC, year) AS rn FROM hit) q WHERE rn = 1)
SELECT m.region, CASE WHEN m6 = 0 THEN 'No M6+ earthquake within 300 km since 1950.' ELSE m6 || ' M6+ earthquakes within 300 km since 1950'
  || CASE WHEN m7 > 0 THEN ', ' || m7 || ' of them M7+' ELSE '' END || '; strongest M' || printf('%.1f', b.magnitude) || ' in ' || b.year || '.' END AS summary
FROM m LEFT JOIN best b USING (region)""")
def quake_index_texts(t):
    return risk.index_summary(risk.hazard_index(quake_regions(t), "earthquake", 76), "earthquake").select("region", "summary")


@query("top_storms", f"""WITH {STORM_SQL} SELECT region, sid, max_wind_kt, rank FROM (SELECT region, sid, max_wind_kt, row_number() OVER (
  PARTITION BY region ORDER BY max_wind_kt DESC, season, sid) AS rank FROM per) q WHERE rank <= 5""")
def top_storms(t):
    order = [F.desc("max_wind_kt"), F.asc("season"), F.asc("sid")]
    return risk.top_per_region(passed_storms(t), order).select("region", "sid", "max_wind_kt", "rank")


@query("prediction_rows", f"""{STORM_INDEX_SQL}, quake AS ({EXPOSED_SQL} SELECT region, CASE l WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium'
    ELSE 'low' END AS level, round(p, 4) AS probability, CASE place WHEN 0 THEN 'M6.0+ earthquake within 300 km' ELSE 'M7.0+ earthquake within 300 km' END AS driver
  FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY l DESC, p DESC, place) AS rn FROM lv) q WHERE rn = 1),
flood AS ({scenario_sql("1998-08", EARLY_LOGIT, "1998-08-01", "1998-08-31", "backtest", "early", True)})
SELECT 'flood' AS type, scenario, kind, district AS place, window_start, as_of, level, probability, observed, population FROM flood
UNION ALL SELECT 'earthquake', 'long-term', 'index', region, '1950', '2025', level, probability, NULL, population FROM quake JOIN {{region_boxes}} USING (region)
UNION ALL SELECT 'cyclone', 'long-term', 'index', region, '1980', '2025', level, probability, NULL, population FROM sx JOIN {{region_boxes}} USING (region)""")
def prediction_rows(t):
    places = t.region_boxes.join(spatial.centroids(t.region_vertices).withColumnsRenamed({"latitude": "lat", "longitude": "lon"}), "region")
    rows = risk.flood_prediction_rows(scenario(t, "1998-08"))
    for kind, index, years, since in (("earthquake", quake_regions(t), 76, 1950), ("cyclone", storm_regions(t), 46, 1980)):
        rows = rows.unionByName(risk.index_prediction_rows(risk.hazard_index(index, kind, years), places, kind, (since, 2025)))
    return rows.select("type", "scenario", "kind", "place", "window_start", "as_of", "level", "probability", "observed", "population")


@query("known_event_check", f"""WITH {QUAKE_SQL}, ex(name, region, year, minimum) AS (VALUES ('A', 'NATION_3', 1997, 7.0), ('B', 'NATION_8', 1999, 9.5),
  ('C', 'NATION_12', 2001, 6.5))
SELECT ex.name, ex.region, CAST(ex.year AS BIGINT) AS year, coalesce(bool_or(h.magnitude >= ex.minimum), false) AS found,
  max(CASE WHEN h.magnitude >= ex.minimum THEN h.magnitude END) AS largest, min(CASE WHEN h.magnitude >= ex.minimum THEN h.dist_km END) AS closest_km
FROM ex LEFT JOIN hit h ON h.region = ex.region AND h.year = ex.year GROUP BY ALL""")
def known_event_check(t):
    expected = t.spark.createDataFrame([("A", "NATION_3", 1997, 7.0), ("B", "NATION_8", 1999, 9.5), ("C", "NATION_12", 2001, 6.5)],
                                       "name string, region string, year long, minimum double")
    return risk.known_event_check(spatial.quake_exposure(t.quakes, t.region_vertices), expected, "magnitude")


# ── outlook ─────────────────────────────────────────────────────────────────


def flood_rows(t):
    return t.inventory.select(F.concat(F.lit("NATION_"), (F.col("seq") % 20).cast("string")).alias("region"),
                              F.col("yr").alias("year"), (1 + F.col("seq") % 7).alias("month"))


FLOOD_SQL = "fl AS (SELECT 'NATION_' || (seq % 20) AS region, yr AS year, 1 + seq % 7 AS month FROM {inventory})"


@query("region_list", "SELECT region, false AS coastal, population FROM {region_boxes}")
def region_list(t):
    return outlook.region_list(t.region_boxes).select("region", "coastal", "population")


@query("monthly_share", f"""WITH {FLOOD_SQL} SELECT b.region, m.month, round_even(coalesce(count(f.month) / nullif(any_value(n.n), 0), 0), 4) AS share
FROM {{region_boxes}} b CROSS JOIN (SELECT CAST(range AS BIGINT) AS month FROM range(1, 13)) m
LEFT JOIN fl f ON f.region = b.region AND f.month = m.month LEFT JOIN (SELECT region, count(*) AS n FROM fl GROUP BY region) n ON n.region = b.region
GROUP BY b.region, m.month""")
def monthly_share(t):
    shares = outlook.monthly_share(flood_rows(t), t.region_boxes)
    return shares.select("region", F.posexplode("monthly_share").alias("month", "share")).withColumn(
        "month", (F.col("month") + 1).cast("long"))


@query("season_history", f"""WITH {FLOOD_SQL} SELECT b.region, count(f.year) AS total, count(CASE WHEN f.year < 2019 THEN 1 END) AS earlier_5,
  count(CASE WHEN f.year >= 2019 THEN 1 END) AS later_5, CASE WHEN count(CASE WHEN f.year >= 2019 THEN 1 END) > count(CASE WHEN f.year < 2019 THEN 1 END)
  THEN 'up' WHEN count(CASE WHEN f.year >= 2019 THEN 1 END) < count(CASE WHEN f.year < 2019 THEN 1 END) THEN 'down' ELSE 'flat' END AS trend
FROM {{region_boxes}} b LEFT JOIN fl f ON f.region = b.region AND f.month IN (6, 7) AND f.year BETWEEN 2014 AND 2023 GROUP BY b.region""")
def season_history(t):
    return outlook.season_history(flood_rows(t), t.region_boxes, [6, 7], 2023)


@query("season_years", f"""WITH {FLOOD_SQL} SELECT b.region, y.year, count(f.year) AS count FROM {{region_boxes}} b
CROSS JOIN (SELECT CAST(range AS BIGINT) AS year FROM range(2014, 2024)) y LEFT JOIN fl f ON f.region = b.region AND f.year = y.year AND f.month IN (6, 7)
GROUP BY b.region, y.year""")
def season_years(t):
    return outlook.season_years(flood_rows(t), t.region_boxes, [6, 7], 2023)


@query("flood_frequency", f"""WITH {FLOOD_SQL}, h AS (SELECT region, count(DISTINCT year) AS y FROM fl GROUP BY region)
SELECT b.region, round(least(coalesce(h.y, 0) / (SELECT max(y) FROM h), 1), 6) AS frequency FROM {{region_boxes}} b LEFT JOIN h USING (region)""")
def flood_frequency(t):
    return rounded(outlook.flood_frequency(flood_rows(t), t.region_boxes))


@query("state_low_lying", "SELECT state AS region, round(avg(low_lying_pct), 6) AS low_lying_pct FROM {districts} GROUP BY state")
def state_low_lying(t):
    spaced = t.districts.withColumn("state", F.replace("state", F.lit(" "), F.lit("  ")))
    return rounded(outlook.state_low_lying(spaced))


def outlook_base(t):
    regions = quake_regions(t).withColumn("cy_rate_ts_per_year", F.col("eq_rate_per_year") / 2 + 0.1)
    low = t.region_boxes.select("region", (F.col("population") / 100000 % 100).alias("low_lying_pct"))
    quakes = t.quakes.select(F.concat(F.lit("NATION_"), (F.col("month") + F.col("year") % 13).cast("string")).alias("region"), "year", "month")
    last = {"flood": 2023, "cyclone": 2023, "earthquake": 2001}
    return outlook.baseline(regions, flood_rows(t), flood_rows(t), quakes, low, [6, 7], last)


@query("outlook_baseline", EXPOSED_SQL + f""", {FLOOD_SQL}, qe AS (SELECT 'NATION_' || (month + year % 13) AS region, year, month FROM {{quakes}}),
ev AS (SELECT 'flood' AS hazard, region, year, month, 2023 AS last FROM fl UNION ALL SELECT 'cyclone', region, year, month, 2023 FROM fl
  UNION ALL SELECT 'earthquake', region, year, month, 2001 FROM qe),
base AS (SELECT region, population, hazard FROM {{region_boxes}}, (VALUES ('flood'), ('cyclone'), ('earthquake')) h(hazard)),
cnt AS (SELECT hazard, region, count(*) AS n FROM ev GROUP BY hazard, region),
sh AS (SELECT base.hazard, base.region, mm.month, round_even(coalesce(count(ev.month) / nullif(any_value(cnt.n), 0), 0), 4) AS share
  FROM base CROSS JOIN (SELECT unnest(range(1, 13)) AS month) mm LEFT JOIN cnt ON cnt.hazard = base.hazard AND cnt.region = base.region
  LEFT JOIN ev ON ev.hazard = base.hazard AND ev.region = base.region AND ev.month = mm.month GROUP BY base.hazard, base.region, mm.month),
shl AS (SELECT hazard, region, string_agg(printf('%.4f', share), ',' ORDER BY month) AS monthly_share FROM sh GROUP BY hazard, region),
hi AS (SELECT base.hazard, base.region, count(e.year) AS total, count(CASE WHEN e.year < e.last - 4 THEN 1 END) AS earlier_5,
    count(CASE WHEN e.year >= e.last - 4 THEN 1 END) AS later_5 FROM base
  LEFT JOIN ev e ON e.hazard = base.hazard AND e.region = base.region AND e.month IN (6, 7) AND e.year BETWEEN e.last - 9 AND e.last
  GROUP BY base.hazard, base.region),
fy AS (SELECT region, count(DISTINCT year) AS y FROM fl GROUP BY region),
qm AS (SELECT m.region, round_even(m6 / 76, 4) AS rate, (SELECT max(magnitude) FROM hit WHERE hit.region = m.region) AS top FROM m),
fr AS (SELECT b.region, b.hazard, CASE hazard WHEN 'flood' THEN least(coalesce(fy.y, 0) / (SELECT max(y) FROM fy), 1)
    WHEN 'cyclone' THEN least((qm.rate / 2 + 0.1) / (SELECT max(rate) / 2 + 0.1 FROM qm), 1) ELSE least(qm.rate / (SELECT max(rate) FROM qm), 1) END AS frequency,
  CASE hazard WHEN 'flood' THEN least((population / 100000 % 100) / 50, 1) WHEN 'cyclone' THEN 0.3
    ELSE coalesce(least(greatest((qm.top - 6) / 2.5, 0), 1), 0) END AS geography
  FROM base b LEFT JOIN fy USING (region) LEFT JOIN qm USING (region))
SELECT region, hazard, round_even(frequency, 4) AS frequency, round_even(geography, 4) AS geography,
  CASE WHEN hazard <> 'earthquake' THEN monthly_share END AS monthly_share, hazard <> 'earthquake' AS seasonal, total, earlier_5, later_5,
  CASE WHEN later_5 > earlier_5 THEN 'up' WHEN later_5 < earlier_5 THEN 'down' ELSE 'flat' END AS trend
FROM fr JOIN shl USING (region, hazard) JOIN hi USING (region, hazard)""")
def outlook_baseline(t):
    shares = F.transform("monthly_share", lambda x: F.format_string("%.4f", x))
    text = F.when(F.col("monthly_share").isNotNull(), F.array_join(shares, ","))
    return outlook_base(t).withColumn("monthly_share", text)


def forecast(t):
    """Daily readings of each region out of the daily rows."""
    return t.daily_sparse.filter("day BETWEEN DATE '2001-06-01' AND DATE '2001-06-20'").select(
        F.concat(F.lit("NATION_"), F.col("cell").cast("string")).alias("region"), F.col("day").alias("date"),
        (F.col("rain_mm") / 4).alias("precip"), (F.col("soil_wetness") / 2).alias("soil"), (F.col("rain_mm") / 3).alias("wind"),
        F.lit(27.5).alias("sst"), (F.col("cell") % 2 == 0).alias("coastal"), (3 + F.col("cell") % 4 * 0.7).alias("max_magnitude"))


BASE_SQL = """base AS (SELECT region, h.hazard, (population / 350000 % 10) / 10 AS frequency, (population / 350000 % 4) / 4 AS geography
  FROM {region_boxes} CROSS JOIN (VALUES ('flood'), ('cyclone'), ('earthquake')) h(hazard)),
f AS (SELECT 'NATION_' || cell AS region, day AS date, rain_mm / 4 AS precip, soil_wetness / 2 AS soil, rain_mm / 3 AS wind,
  cell % 2 = 0 AS coastal, 3 + cell % 4 * 0.7 AS mag FROM {daily_sparse} WHERE day BETWEEN DATE '2001-06-01' AND DATE '2001-06-20'),
sc AS (SELECT b.*, d.i + 1 AS day, CAST(DATE '2001-06-01' + CAST(d.i AS INT) AS DATE) AS date,
  CASE WHEN f.region IS NULL OR d.i >= 16 THEN 0 WHEN hazard = 'flood' THEN least(greatest(precip / 100, soil / 0.75), 1)
    WHEN hazard = 'cyclone' THEN least(CASE WHEN coastal THEN 0.7 * (wind / 60) + 0.3 * 0.75 ELSE wind / 60 END, 1)
    ELSE least(greatest((mag - 3) / 2, 0), 1) END AS anomaly
  FROM base b CROSS JOIN (SELECT unnest(range(30)) AS i) d LEFT JOIN f ON f.region = b.region AND f.date = DATE '2001-06-01' + CAST(d.i AS INT)),
scored AS (SELECT *, CAST(floor(least(greatest(frequency * 0.35 + 0.5 * 0.25 + anomaly * 0.3 + geography * 0.1, 0), 1) * 100 + 0.5) AS BIGINT) AS score FROM sc)"""


def flat_base(t):
    hazard = F.explode(F.array(*[F.lit(h) for h in outlook.HAZARDS])).alias("hazard")
    n = F.col("population") / 350000
    return t.region_boxes.select("region", hazard, (n % 10 / 10).alias("frequency"), (n % 4 / 4).alias("geography"),
                                 F.lit(None).cast("array<double>").alias("monthly_share"))


@query("daily_scores", f"WITH {BASE_SQL} SELECT region, hazard, CAST(day AS BIGINT) AS day, round(anomaly, 6) AS anomaly, score FROM scored")
def daily_scores(t):
    out = outlook.daily_scores(flat_base(t), forecast(t), "2001-06-01", 30)
    return rounded(out.select("region", "hazard", "day", "anomaly", "score"))


@query("peak_scores", f"""WITH {BASE_SQL} SELECT region, hazard, CAST(day AS BIGINT) AS day, score, CASE WHEN score > 80 THEN 'critical' WHEN score > 60 THEN 'high'
  WHEN score > 30 THEN 'medium' ELSE 'low' END AS level FROM (SELECT *, row_number() OVER (PARTITION BY region, hazard ORDER BY score DESC, day) AS rn FROM scored) q WHERE rn = 1""")
def peak_scores(t):
    return outlook.peak_scores(outlook.daily_scores(flat_base(t), forecast(t), "2001-06-01", 30)).select(
        "region", "hazard", "day", "score", "level")


@query("reduce_forecast", """WITH h AS (SELECT user_id % 20 AS cell, ts, value FROM {events} WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'),
l AS (SELECT cell, max(ts) AS last, max_by(value, ts) AS soil_now FROM h GROUP BY cell)
SELECT h.cell, round(sum(CASE WHEN ts > last - INTERVAL 24 HOURS THEN value END), 4) AS precip_24h, any_value(soil_now) AS soil_now
FROM h JOIN l USING (cell) GROUP BY h.cell""")
def reduce_forecast(t):
    hourly = t.events.select((F.col("user_id") % 20).alias("cell"), F.col("ts").cast("timestamp").alias("time"),
                             F.col("value").alias("rain"), F.col("value").alias("soil"))
    return rounded(outlook.reduce_forecast(hourly, "cell", F.lit("2024-01-15 12:00:00").cast("timestamp")), 4)


@query("season_normal", """SELECT cell, round(avg(rain_mm), 6) AS normal FROM {daily_sparse}
WHERE least(abs(dayofyear(day) - 2), 365 - abs(dayofyear(day) - 2)) <= 3 GROUP BY cell""")
def season_normal(t):
    return rounded(outlook.season_normal(t.daily_sparse, "cell", 2, "rain_mm"))


@query("indicators", """SELECT district, i AS indicator, round(CASE WHEN i = 'sst' AND cell % 2 = 1 THEN NULL ELSE v END, 6) AS value, CASE WHEN i = 'sst' AND cell % 2 = 1 THEN 'na' WHEN v IS NULL THEN 'unavailable'
  WHEN v > th THEN 'critical' WHEN v >= th * 0.75 THEN 'alert' ELSE 'normal' END AS status
FROM (SELECT district, cell, unnest(['precip', 'wind', 'soil', 'temp', 'seismic', 'sst']) AS i, unnest([100.0, 60, 0.75, 2, 5, 28]) AS th,
  unnest([low_lying_pct * 1.5, low_lying_pct, low_lying_pct / 100, cell / 5.0, CASE WHEN cell % 3 <> 0 THEN cell / 3.0 END,
    CASE WHEN cell % 2 = 0 THEN 20 + cell / 2.0 END]) AS v FROM {districts}) q""")
def indicators(t):
    low, cell = F.col("low_lying_pct"), F.col("cell").cast("double")
    readings = t.districts.select(
        "district", (F.col("cell") % 2 == 0).alias("coastal"), (low * 1.5).alias("precip"), low.alias("wind"),
        (low / 100).alias("soil"), (cell / 5).alias("temp"), F.when(F.col("cell") % 3 != 0, cell / 3).alias("seismic"),
        (20 + cell / 2).alias("sst"))
    return rounded(outlook.indicators(readings, "district").drop("threshold"), 6)


@query("place_with_fallback", """SELECT l.event, CASE WHEN g.name IS NOT NULL THEN 'district' ELSE CASE WHEN l.states IN ('Kerala', 'Odisha') THEN 'state centre'
  ELSE 'unknown' END END AS found_by FROM {listed_names} l LEFT JOIN {gazetteer} g ON lower(trim(g.name)) = lower(trim(l.name)) AND lower(g.state) = lower(l.states)""")
def place_with_fallback(t):
    spots = t.gazetteer.select("state", "name", F.lit("district").alias("kind"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    centres = t.gazetteer.select("state").distinct().filter("state IN ('Kerala', 'Odisha')").select(
        "state", F.lit(3.0).alias("lat"), F.lit(4.0).alias("lon"))
    asked = t.listed_names.select("event", F.col("states").alias("state"), F.col("name").alias("district"))
    return outlook.place_with_fallback(asked, spots, centres).select("event", "found_by")


# ── words and seasons ───────────────────────────────────────────────────────


@query("season_names", """SELECT d AS day, CASE WHEN m <= 2 THEN 'Winter' WHEN m <= 5 THEN 'Pre-monsoon (summer)' WHEN m <= 9 THEN 'Southwest monsoon'
  ELSE 'Post-monsoon (northeast monsoon)' END AS season, array_to_string(list_sort(list_distinct([CAST(month(day + CAST(i AS INT)) AS VARCHAR) FOR i IN range(45)])), ',') AS months
FROM (SELECT DISTINCT CAST(day AS STRING) AS d, day, month(day) AS m FROM {daily_sparse}) q""")
def season_names(t):
    days = t.daily_sparse.select("day").distinct()
    months = F.array_join(F.array_sort(outlook.window_months(F.col("day"), 45).cast("array<string>")), ",")
    return days.select(F.col("day").cast("string").alias("day"), scales.season_name(F.month("day")).alias("season"), months.alias("months"))


@query("seasonal_factors", f"""WITH {FLOOD_SQL}, s AS (SELECT b.region, m.month, round_even(coalesce(count(f.month) / nullif(any_value(n.n), 0), 0), 4) AS share
  FROM {{region_boxes}} b CROSS JOIN (SELECT CAST(range AS BIGINT) AS month FROM range(1, 13)) m LEFT JOIN fl f ON f.region = b.region AND f.month = m.month
  LEFT JOIN (SELECT region, count(*) AS n FROM fl GROUP BY region) n ON n.region = b.region GROUP BY b.region, m.month)
SELECT region, month, round(CASE WHEN max(share) OVER (PARTITION BY region) > 0 THEN share / max(share) OVER (PARTITION BY region) ELSE 0 END, 6) AS factor FROM s""")
def seasonal_factors(t):
    """A month's share of floods beside the busiest month's, 0 where none was recorded."""
    shares = outlook.monthly_share(flood_rows(t), t.region_boxes)
    rows = shares.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    factor = scales.seasonal_factor(F.col("monthly_share"), F.col("month"))
    return rounded(rows.select("region", F.col("month").cast("long").alias("month"), factor.alias("factor")))


@query("strength_words", """SELECT n_nationkey AS k, CASE WHEN r IS NULL THEN 'unmeasured' WHEN abs(r) < 0.1 THEN 'no' WHEN abs(r) < 0.3 THEN 'a weak' WHEN abs(r) < 0.6 THEN 'a moderate'
  ELSE 'a strong' END AS strength, CASE WHEN n_nationkey % 4 = 0 THEN 'too few years to judge' ELSE 'increasing' END AS trend, n_nationkey % 5 <> 0 AS known
FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 6 <> 5 THEN (n_nationkey - 12) / 14.0 END AS r FROM {nation}) q""")
def strength_words(t):
    key = F.col("n_nationkey")
    r = F.when(key % 6 != 5, (key - 12) / 14.0)
    direction = F.when(key % 8 == 0, "insufficient").when(key % 4 != 0, "increasing")
    odd = F.when(key % 5 == 0, F.lit(float("inf"))).otherwise(key.cast("double"))
    return t.nation.select(key.alias("k"), scales.correlation_strength(r).alias("strength"), scales.trend_words(direction).alias("trend"),
                           text.finite(odd).isNotNull().alias("known"))


@query("daily_soil", """SELECT user_id % 20 AS cell, CAST(CAST(ts AS DATE) AS STRING) AS date, round(avg(value), 6) AS soil FROM {events}
WHERE CAST(ts AS DATE) >= DATE '2024-01-15' GROUP BY ALL""")
def daily_soil(t):
    hourly = t.events.select((F.col("user_id") % 20).alias("cell"), F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("soil"))
    out = outlook.daily_soil(hourly, "cell", F.lit("2024-01-15").cast("date"))
    return rounded(out.withColumn("date", F.col("date").cast("string")))
