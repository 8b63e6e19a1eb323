"""Small frames with exact answers."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo, scales, tails, text
from tidewatch.operators import dates, events, impact, live, names, panel, quality, ranking, spatial, stats
from tidewatch.plans import outlook, response, risk
from tidewatch.sources import sinks
from tidewatch.streaming import feeds


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def column(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_severity_is_scaled_within_its_scope(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0), (2, 9, 9, 9.0), (3, 99, 99, 99.0)],
                               "year long, deaths long, total_affected long, damages_usd double")
    assert values(impact.severity_scores(df, [], "s").orderBy("year"), "s") == [(0.0,), (50.0,), (100.0,)]


def test_constant_metric_counts_nothing(spark):
    df = spark.createDataFrame([(1, 0, 99, 0.0), (2, 99, 99, 0.0)], "year long, deaths long, total_affected long, damages_usd double")
    assert values(impact.severity_scores(df, [], "s").orderBy("year"), "s") == [(0.0,), (50.0,)]


def test_ratios_need_both_figures(spark):
    df = spark.createDataFrame([(1, 10, 1000, 2000.0), (2, 0, 100, 0.0), (3, 5, 0, 10.0)],
                               "year long, deaths long, total_affected long, damages_usd double")
    got = values(impact.add_derived(df).orderBy("year"), "fatality_rate_pct", "loss_per_affected_usd")
    assert got == [(1.0, 2.0), (None, None), (None, None)]


def test_nearest_rate_prefers_the_earlier_year(spark):
    fx = spark.createDataFrame([(1960, 4.76), (2000, 44.94), (2010, 45.73)], "year long, inr_per_usd double")
    df = spark.createDataFrame([(1931, 10.0), (1931, 0.0), (2010, 2.0), (2005, 1.0), (1980, 1.0)], "year long, usd double")
    got = sorted(values(impact.add_inr(df, fx, {"usd": "inr"}), "year", "inr", "fx_estimated"))
    assert got == [(1931, 0.0, False), (1931, 47.599999999999994, True), (1980, 4.76, True), (2005, 44.94, True), (2010, 91.46, False)]


@pytest.mark.parametrize("kt, category", [(40, 0), (64, 1), (90, 2), (100, 3), (120, 4), (150, 5)])
def test_categories(spark, kt, category):
    assert column(spark, scales.saffir_simpson(F.lit(kt))) == category


def test_decades_before_zero_and_rounding(spark):
    assert column(spark, scales.decade_of(F.lit(-3))) == -10
    assert column(spark, scales.half_up(F.lit(2.5))) == 3
    assert column(spark, scales.outlook_score(*[F.lit(1.0)] * 4)) == 100


def test_trend_needs_five_years(spark):
    rows = [("up", y, 2 * y) for y in range(1980, 2020)] + [("few", y, y) for y in range(3)] + [("flat", y, 1) for y in range(9)]
    got = {r["k"]: r for r in stats.trend_verdicts(
        spark.createDataFrame(rows, "k string, year long, v long"), ["k"], "year", "v").collect()}
    assert (got["up"]["direction"], got["up"]["spearman_rho"], got["up"]["p_value"]) == ("increasing", 1.0, 0.0)
    assert got["few"]["direction"] == got["flat"]["direction"] == "insufficient"


def test_correlation_skips_unreported(spark):
    df = spark.createDataFrame([(1, 10.0, 100.0), (1, 100.0, 1000.0), (1, 0.0, 5.0), (1, 1000.0, 10000.0), (1, 1.0, 10.0)],
                               "k int, x double, y double")
    row = stats.correlations(df, ["k"], "x", "y").first()
    assert (row["n"], row["pearson_log"], row["spearman"]) == (4, 1.0, 1.0)


def test_seasonality(spark):
    months = [(9,)] * 60 + [(m,) for m in range(1, 13) for _ in range(3)]
    row = stats.seasonality(spark.createDataFrame(months, "month int"), "month").first()
    assert row["seasonal"] and row["peak_month"] == 9 and row["season_start"] == 7
    even = spark.createDataFrame([(m,) for m in range(1, 13) for _ in range(20)], "month int")
    assert not stats.seasonality(even, "month").first()["seasonal"]


def test_tail_probabilities():
    assert tails.correlation_p(0.5, 10) == pytest.approx(0.1411, abs=1e-4)
    assert tails.correlation_p(0.0, 10) == pytest.approx(1.0)
    assert tails.chi_square_p(19.675, 11) == pytest.approx(0.05, abs=1e-4)


def test_ranks_and_quantiles_match_sorting(spark):
    nums = [-5.0, -0.25, 0.0, 0.0, 1e-9, 0.5, 3.0, 3.0, 3.0, 1e12]
    df = spark.createDataFrame([("a", v) for v in nums], "k string, v double")
    ranks = dict(values(ranking.average_ranks(df, ["k"], "v", "r"), "v", "r"))
    assert ranks == {-5.0: 1, -0.25: 2, 0.0: 3.5, 1e-9: 5, 0.5: 6, 3.0: 8, 1e12: 10}
    assert ranking.exact_quantile(df, ["k"], "v", 0.5, "m").first()["m"] == pytest.approx((1e-9 + 0.5) / 2)


def test_top_days_list_labels_by_rank(spark):
    day = datetime.date(2011, 3, 11)
    rows = [(day, float(i), f"L{i}") for i in range(10)] + [(datetime.date(2011, 3, 12), 1.0, "x")]
    row = events.top_days(spark.createDataFrame(rows, "date date, rank double, label string"), 1).first()
    assert (row["count"], row["more"], row["events"][0], len(row["events"])) == (10, 2, "L9", 8)


def test_last_covered_year(spark):
    for last, want in ((datetime.date(2025, 10, 24), 2024), (datetime.date(2025, 12, 30), 2025)):
        assert events.complete_through(spark.createDataFrame([(last,)], "date date"), 2025).first()["last_year"] == want


def test_date_readings(spark):
    assert column(spark, text.date_readings(F.lit("08-01-2018 00:00"))) == [datetime.date(2018, 1, 8), datetime.date(2018, 8, 1)]
    assert column(spark, text.date_readings(F.lit("30-08-2018"))) == [datetime.date(2018, 8, 30)]
    assert column(spark, text.date_readings(F.lit("soon"))) == []


def test_run_dates_keep_event_order(spark):
    rows = [("UEI-1-2018-0001", "Kerala", "15-07-2018", "16-07-2018", 2.0), ("UEI-1-2018-0002", "Kerala", "08-01-2018", "30-08-2018", 30.0),
            ("UEI-1-2018-0003", "Kerala", "20-08-2018", "08-09-2018", None), ("UEI-1-2018-0004", "Goa", "04-03-2018", "04-03-2018", 1.0)]
    df = spark.createDataFrame(rows, "uei string, state string, start_text string, end_text string, duration double")
    got = {r["uei"][-1]: (str(r["start"]), str(r["end"])) for r in dates.resolve_dates(df).collect()}
    assert got["2"] == ("2018-08-01", "2018-08-30")
    assert got["1"] == ("2018-07-15", "2018-07-16") and got["4"] == ("2018-03-04", "2018-03-04")


def test_prior_rate_uses_covered_years_only(spark):
    rows = [("D", y, 1, f) for y, f in ((2000, 1), (2001, 0), (2002, 0), (2003, 1))]
    df = spark.createDataFrame(rows, "district string, year long, month long, flood long")
    got = dict(values(panel.prior_rates(df, (2000, 2006), window=3), "year", "prior_flood_rate"))
    assert got[2000] is None and got[2003] == pytest.approx(1 / 3) and got[2006] == got[2004] == pytest.approx(1 / 3)


def test_grid_cells(spark):
    lat, lon = geo.weather_cell(F.lit(9.815), F.lit(77.002))
    assert (column(spark, lat), column(spark, lon)) == (10.0, 76.875)
    lat, lon = geo.weather_cell(F.lit(28.6), F.lit(77.2))
    assert (column(spark, lat), column(spark, lon)) == (28.5, 77.5)


def test_distance_to_a_region(spark):
    ring = [(70.0, 10.0), (72.0, 10.0), (72.0, 12.0), (70.0, 12.0), (70.0, 10.0)]
    vertices = spark.createDataFrame([("box", 0, 0, i, x, y) for i, (x, y) in enumerate(ring)],
                                     "region string, part long, ring long, idx long, lon double, lat double")
    points = spark.createDataFrame([(71.0,), (73.0,), (75.0,)], "lon double").withColumn("lat", F.lit(11.0))
    near = spatial.within_reach(points, vertices, 150.0, "lat", "lon").groupBy("lon").agg(F.min("dist_km").alias("km"))
    got = dict(values(near, "lon", "km"))
    assert got[71.0] == 0 and 100 < got[73.0] < 130 and 75.0 not in got


def test_holes_and_largest_polygon(spark):
    rings = {(0, 0): [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], (0, 1): [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)],
             (1, 0): [(20, 0), (21, 0), (21, 1), (20, 1), (20, 0)]}
    rows = [("r", p, r, i, float(x), float(y)) for (p, r), ring in rings.items() for i, (x, y) in enumerate(ring)]
    vertices = spark.createDataFrame(rows, "region string, part long, ring long, idx long, lon double, lat double")
    assert spatial.areas(vertices).first()["area"] == 97.0
    assert values(spatial.centroids(vertices), "latitude", "longitude") == [(5.0, 5.0)]
    points = spark.createDataFrame([(5.0, 5.0), (1.0, 1.0), (20.5, 0.5), (15.0, 5.0)], "lon double, lat double")
    assert sorted(values(spatial.containing_regions(points, vertices), "lon")) == [(1.0,), (20.5,)]


def test_name_cascade(spark):
    places = spark.createDataFrame(
        [("Kerala", "Kollam"), ("Kerala", "Kozhikode"), ("Kerala", "Idukki"), ("West Bengal", "Purba Medinipur"),
         ("Telangana", "Hyderabad"), ("Bihar", "Aurangabad"), ("Maharashtra", "Aurangabad"), ("Assam", "Cachar")],
        "state string, name string")
    aliases = spark.createDataFrame([("ifi", "Quilon", "Kerala", "Kollam"), ("ifi", "Mahe", "", "-"), ("ifi", "Wayward", "", "~")],
                                    "source string, name string, geo_state string, geo_name string")
    asked = [("Kollam", "Kerala"), ("Quilon", "Kerala"), ("Kozhikkode", "Kerala"), ("Kollam Kozhikode", "Kerala"),
             ("Purba Purba Medinipur", "West Bengal"), ("Hyderabad", "Andhra Pradesh"), ("Cachar", "Kerala"),
             ("Aurangabad", "Kerala"), ("Parts of Kerala", "Kerala"), ("Mahe", "Kerala"), ("14 districts", "Kerala"),
             ("Wayward", "Kerala")]
    df = spark.createDataFrame([("ifi", n, s) for n, s in asked], "source string, name string, states string")
    got = {r["name"]: (r["how"], len(r["targets"])) for r in names.match_names(df, places, aliases).collect()}
    assert got == {
        "Kollam": ("exact", 1), "Quilon": ("alias", 1), "Kozhikkode": ("fuzzy", 1),
        "Kollam Kozhikode": ("split", 2), "Purba Purba Medinipur": ("exact", 1), "Hyderabad": ("exact", 1),
        "Cachar": ("national", 1), "Aurangabad": ("none", 0), "Parts of Kerala": ("description", 0), "Mahe": ("no_polygon", 0),
        "14 districts": ("description", 0), "Wayward": ("description", 0)}


def test_storm_keys(spark):
    for title, want in (("Hurricane Polo", "polo"), ("POLO-26", "polo"), ("Tropical Cyclone 01B", "01b"), ("Storm", None)):
        assert column(spark, text.storm_key(F.lit(title))) == want


def test_storm_month(spark):
    assert column(spark, text.storm_month(F.lit("1999286N17087"))) == 10
    assert column(spark, text.storm_month(F.lit("bad"))) is None


def test_hazard_levels(spark):
    assert column(spark, scales.annual_probability(F.lit(0.0), F.lit(76.0))) == 0
    assert column(spark, scales.annual_probability(F.lit(76.0), F.lit(76.0))) == pytest.approx(1 - 1 / math.e)
    levels = [column(spark, scales.level_of(F.lit(p), F.lit(0.4), F.lit(0.15), F.lit(0.05))) for p in (.5, .4, .2, .05, .049)]
    assert levels == ["critical", "critical", "high", "medium", "low"]


def test_flood_resources(spark):
    df = spark.createDataFrame([("a", "high", 0.6, 1_000_000, 20.0), ("b", "high", 0.6, None, 20.0)],
                               "region string, level string, probability double, population long, low_lying_pct double")
    rows = {r["region"]: r for r in response.recommend(df, "flood", 7, 0.04).collect()}
    a = rows["a"]
    assert (a["people"], a["rescue_boats"], a["food_rations"], a["water_litres"], a["long_stay_places"]) == (
        20_000, 20, 140_000, 2_100_000, 800)
    assert rows["b"]["people"] is None and rows["b"]["water_litres"] is None
    with pytest.raises(ValueError):
        response.resources(df, "flood", 31)


def test_metrics_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.4, 1), (0.2, 0)], "probability double, flood long")
    row = risk.metrics(df).first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (1, 1, 1, 1)
    assert row["roc_auc"] == 0.625 and row["average_precision"] == pytest.approx(0.583, abs=1e-3)


def test_fit_recovers_an_effect_and_explains_it(spark, tmp_path):
    rows = [(f"S{i % 3}", f"D{i % 7}", 2000 + i % 20, 1 + i % 12, float(i % 200), float(i % 50), (i % 10) / 10, float(i % 90),
             (i % 5) / 5, int((i % 200) + 13 * (i % 3) > 110)) for i in range(1200)]
    df = spark.createDataFrame(rows, "state string, district string, year long, month long, rain_pct_normal double, "
                                     "max_3day_rain_mm double, soil_wetness_before double, elevation_m double, "
                                     "prior_flood_rate double, flood long")
    fit = risk.train(df)
    assert fit.coefs["rain_pct_normal"] > 3 and set(fit.regions) == {"S0", "S1", "S2"}
    scored = risk.predict(df, fit.pipeline)
    assert risk.metrics(scored).first()["roc_auc"] > 0.95
    told = risk.explain(df, fit).select("district", "year", "rain_pct_normal", "state", F.col("probability").alias("p"),
                                        "log_odds", "factors")
    row = told.first()
    assert sum(f["contribution"] for f in row["factors"]) + fit.intercept == pytest.approx(row["log_odds"], abs=0.01)
    by_pipeline = {tuple(r) for r in scored.select("district", "year", F.bround("probability", 3)).collect()}
    assert by_pipeline == {tuple(r) for r in told.select("district", "year", "p").collect()}
    risk.save_fit(fit, str(tmp_path / "model"))
    again = risk.explain(df, risk.load_fit(spark, str(tmp_path / "model")))
    assert again.select(*df.columns, "probability", "factors").exceptAll(
        risk.explain(df, fit).select(*df.columns, "probability", "factors")).isEmpty()
    assert row["factors"][0]["average"] is not None and row["factors"][0]["unit"]


def test_smart_matches_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    people = [(f"p{i}", f"N{i % 9}", rng.choice(["Medical", "Rescue", "NGO"]), rng.choice(["A", "B", ""]), rng.choice(["X", "Y"]),
               rng.choice(["now", "2hrs", "unavailable"])) for i in range(60)]
    tasks = [(f"p{rng.randrange(60)}", rng.choice(["assigned", "delivered"])) for _ in range(80)]
    needs = [(f"k{i}", rng.choice(["a", "B", "C"]), rng.choice(["x", "Y", "Z"]), rng.choice(["medical", "food", "odd"])) for i in range(25)]
    got = response.smart_matches(
        spark.createDataFrame(people, "id string, name string, role string, city string, state string, availability string"),
        spark.createDataFrame(tasks, "assignee_id string, status string"),
        spark.createDataFrame(needs, "key string, area string, state string, category string"))
    found = {(r["key"], r["rank"]): r["id"] for r in got.collect()}
    for key, area, state, category in needs:
        scored = []
        for pid, name, role, city, home, ready in people:
            active = sum(a == pid and s != "delivered" for a, s in tasks)
            score = {"now": 3, "2hrs": 1, "unavailable": -10}[ready] - active
            score += 3 if city and city.lower() == area.lower() else 1 if home.lower() == state.lower() else 0
            score += 2 * (role in response.CATEGORY_ROLES.get(category, []))
            scored.append((-score, active, name, pid))
        for rank, row in enumerate(sorted(scored)[:3], 1):
            assert found[(key, rank)] == row[3]


def test_clean_needs(spark):
    body = '[{"need": " Boats ", "category": "Fun", "priority": "urgent"}, "x", {"need": ""}, {"need": "Food", "category": "food", "priority": "critical"}]'
    rows = values(response.clean_needs(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body"),
                  "need_id", "need", "category", "priority")
    assert rows == [("n1", "Boats", "transport", "High"), ("n2", "Food", "food", "Critical")]


def test_readiness_counts_the_furthest_task(spark):
    needs = spark.createDataFrame([("p", "n1"), ("p", "n2")], "plan_id string, need_id string")
    tasks = spark.createDataFrame([("p", "n1", "accepted"), ("p", "n1", "delivered")], "plan_id string, need_id string, status string")
    assert response.plan_readiness(needs, tasks).first()["readiness"] == 50


def test_tracks_are_linked(spark):
    parts = [("s", False, 1, 2.0, 2.0, 3.0, 3.0), ("s", False, 2, 1.0, 1.0, 2.0, 2.0), ("s", False, 3, 9.0, 9.0, 8.0, 8.0)]
    df = spark.createDataFrame(parts, "storm string, forecast boolean, seq int, x1 double, y1 double, x2 double, y2 double")
    assert values(live.link_tracks(df).orderBy("place"), "lat") == [(1.0,), (2.0,), (3.0,)]


def test_tracks_with_circles_and_repeats(spark):
    parts = [("s", 1, 1.0, 2.0), ("s", 2, 2.0, 3.0), ("s", 3, 3.0, 4.0), ("s", 4, 4.0, 2.0), ("s", 5, 7.0, 8.0), ("s", 0, 7.0, 9.0),
             ("round", 1, 1.0, 2.0), ("round", 2, 2.0, 1.0), ("tie", 2, 1.0, 2.0), ("tie", 1, 5.0, 6.0)]
    parts += [("long", (k * 37) % 101, float(k), float(k + 1)) for k in range(101)]
    df = spark.createDataFrame([(s, False, q, a, a, b, b) for s, q, a, b in parts],
                               "storm string, forecast boolean, seq int, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in live.link_tracks(df).orderBy("storm", "place").collect():
        got.setdefault(r["storm"], []).append(r["lon"])
    assert got == {"s": [1.0, 2.0, 3.0, 4.0], "tie": [5.0, 6.0], "long": [float(k) for k in range(102)]}


def test_sorted_events(spark):
    df = spark.createDataFrame([("a", "earthquake", 5.0, None, 1), ("b", "flood", 9.0, "high", 2), ("c", "earthquake", 6.0, "very_high", 0),
                                ("d", "flood", None, None, 3)], "id string, type string, magnitude double, severity_level string, time int")
    assert [i for i, in values(live.sort_events(df, "magnitude"), "id")] == ["c", "a", "d", "b"]
    assert [i for i, in values(live.sort_events(df, "severity"), "id")] == ["c", "b", "d", "a"]


def test_rates_outside_the_table(spark):
    fx = spark.createDataFrame([(1960, 4.0), (2000, 40.0), (1990, None)], "year long, inr_per_usd double")
    df = spark.createDataFrame([(1400, 1.0), (2600, 2.0), (1979, 1.0), (1980, 1.0), (1981, 1.0), (None, 1.0), (2000, 0.0)], "year long, usd double")
    got = {r["year"]: (r["inr"], r["fx_estimated"]) for r in impact.add_inr(df, fx, {"usd": "inr"}).collect()}
    assert got == {1400: (4.0, True), 2600: (80.0, True), 1979: (4.0, True), 1980: (4.0, True), 1981: (40.0, True),
                   None: (None, None), 2000: (0.0, False)}


def test_ids_without_a_number_are_rejected(spark):
    df = spark.createDataFrame([("X-2001-0001", "b"), ("X-2001-0001", "a"), ("bad", "a"), (None, "a"), ("X-0000-0001", "a")], "uei string, state string")
    assert values(dates.number_events(df), "uei", "state") == [("X-2001-0001", "a")]
    assert sorted(values(dates.unnumbered(df), "uei", "reason"), key=str) == sorted(
        [("bad", "id without year and number"), (None, "no id"), ("X-0000-0001", "id without year and number")], key=str)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "source string, at long, event_id long, ok boolean, events long, error string"
    land = lambda rows, k: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    home = str(tmp_path / "home")

    def run():
        rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return feeds.source_health(rows, "health", F.lit(100), 50, home=home).collect()

    land([("a", 90, 1, True, 5, None)], 1)
    assert [(r["status"], r["tries"]) for r in run()] == [("ok", 1)]
    assert [(r["status"], r["tries"]) for r in run()] == [("ok", 1)]
    land([("a", 95, 2, False, None, "Timeout"), ("b", 20, 3, False, None, "Timeout")], 2)
    assert sorted((r["source"], r["status"], r["count"], r["tries"]) for r in run()) == [("a", "stale", 5, 2), ("b", "unavailable", 0, 1)]


def test_outlook_scores(spark):
    share = F.array(*[F.lit(float(m)) for m in range(1, 13)])
    assert column(spark, scales.seasonal_factor(share, F.lit(6))) == 0.5
    assert column(spark, scales.cyclone_anomaly(F.lit(60.0), F.lit(28.0), F.lit(True))) == 1.0
    assert column(spark, outlook.window_months(F.lit("2024-12-20").cast("date"), 30)) == [12, 1]


def test_violations_name_the_fields(spark):
    df = spark.createDataFrame([("", "Boss", 5), ("Ann", "NGO", 200000), ("Bob", "NGO", 1)], "name string, role string, capacity long")
    got = dict(values(quality.violations(df, quality.RESPONDER_RULES), "name", "violations"))
    assert got == {"": ["name", "role"], "Ann": ["capacity"], "Bob": []}


def test_six_digits(spark):
    df = spark.createDataFrame([(1234567.89,), (0.000123456789,), (5.0,), (0.0,)], "v double")
    assert [float(r["v"]) for r in sinks.six_digits(df).collect()] == [1234570.0, 0.000123457, 5.0, 0.0]


def test_missing_wide_columns_are_an_error(spark):
    with pytest.raises(ValueError):
        impact.wide_to_records(spark.range(1).withColumn("year", F.lit(2000)), None, 2025)
