"""Flood-risk model, its evaluation, and the catalogue-based hazard index."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.scales import annual_probability, level_of, level_order, risk_level
from tidewatch.operators.ranking import running_totals
from tidewatch.operators.stats import pearson

# Features with their label, unit and allowed range.
FEATURES = [
    ("rain_pct_normal", "Rainfall vs normal", "% of normal", 0, 1000),
    ("max_3day_rain_mm", "Heaviest 3-day rainfall", "mm", 0, 1500),
    ("soil_wetness_before", "Soil wetness before", "0-1", 0, 1),
    ("elevation_m", "Mean elevation", "m", 0, 5000),
    ("prior_flood_rate", "Flood history", "share", 0, 1),
]
KEYS = [f[0] for f in FEATURES]
TRAIN_UNTIL = 2012
THRESHOLD = 0.5
ACTION_THRESHOLD = 0.25
MIN_REGION_POSITIVES = 20
LEVELS = ["critical", "high", "medium", "low"]

# Tests of the hazard index with their cut-offs.
INDEX_TESTS = {
    "earthquake": [
        ("m6", "M6.0+ earthquake within 300 km", "eq_events_m6", 0.40, 0.15, 0.05),
        ("m7", "M7.0+ earthquake within 300 km", "eq_events_m7", 0.10, 0.04, 0.01),
    ],
    "cyclone": [
        ("hurricane", "Hurricane-strength (64 kt+) cyclone within 100 km", "cy_storms_hurricane", 0.15, 0.06, 0.02),
        ("tropical_storm", "Tropical-storm-strength (34 kt+) cyclone within 100 km", "cy_storms_ts", 0.60, 0.30, 0.10),
    ],
}


def complete_rows(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Rows with every feature; nothing is imputed."""
    return df.dropna(subset=KEYS + (extra or []))


def not_scored(districts: DataFrame, scored: DataFrame) -> DataFrame:
    return districts.select("district").distinct().join(scored.select("district"), "district", "left_anti")


# ── fitting ─────────────────────────────────────────────────────────────────


@dataclass
class Fit:
    """Coefficients of a fitted model: what explaining and scoring need."""

    means: dict[str, float]
    scales: dict[str, float]
    coefs: dict[str, float]
    intercept: float
    regions: dict[str, float]
    pipeline: PipelineModel | None = None


def train(rows: DataFrame, label: str = "flood", region: str = "state", features: list[str] | None = None) -> Fit:
    """Logistic regression on standardised features and one dummy per region.

    The penalty is that of half the squared weights against the summed loss, so it shrinks
    with the number of rows. Only the features are scaled, with the population deviation.
    """
    features = KEYS if features is None else features
    stats = rows.agg(F.count("*").alias("n"), *[F.avg(k).alias(f"m_{k}") for k in features],
                     *[F.stddev_pop(k).alias(f"s_{k}") for k in features]).first()
    means = {k: stats[f"m_{k}"] for k in features}
    scales = {k: stats[f"s_{k}"] or 1.0 for k in features}
    scaled = ", ".join(f"(CAST({k} AS DOUBLE) - {means[k]!r}) / {scales[k]!r} AS z_{k}" for k in features)
    stages = [SQLTransformer(statement=f"SELECT *, {scaled}, CAST({label} AS DOUBLE) AS y FROM __THIS__")]
    inputs = [f"z_{k}" for k in features]
    if region:
        stages += [StringIndexer(inputCol=region, outputCol="_region", handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCol="_region", outputCol="_dummies", dropLast=True)]
        inputs.append("_dummies")
    stages += [VectorAssembler(inputCols=inputs, outputCol="_x"),
               LogisticRegression(featuresCol="_x", labelCol="y", regParam=1.0 / stats["n"], elasticNetParam=0.0,
                                  standardization=False, maxIter=300, tol=1e-9)]
    pipeline = Pipeline(stages=stages).fit(rows)
    weights = pipeline.stages[-1].coefficients.toArray().tolist()
    names = pipeline.stages[1].labels if region else []
    return Fit(means, scales, dict(zip(features, weights)), pipeline.stages[-1].intercept,
               dict(zip(names, weights[len(features):])), pipeline)


def predict(rows: DataFrame, pipeline: PipelineModel, name: str = "probability") -> DataFrame:
    keep = rows.columns
    return pipeline.transform(rows).select(*keep, vector_to_array("probability")[1].alias(name))


MODEL = "version string, valid_from string, valid_to string, kind string, term string, mean double, scale double, weight double"


def model_table(spark: SparkSession, fit: Fit, version: str, valid_from: str | None = None,
                valid_to: str | None = None) -> DataFrame:
    """A fit as rows: the intercept, its features and its regions, under a version that serves a span of dates.

    ``valid_from`` and ``valid_to`` are ISO dates, both included; an open end is null.
    """
    key = (version, valid_from, valid_to)
    rows = [(*key, "intercept", None, None, None, float(fit.intercept))]
    rows += [(*key, "feature", k, float(fit.means[k]), float(fit.scales[k]), float(w)) for k, w in fit.coefs.items()]
    rows += [(*key, "region", k, None, None, float(w)) for k, w in fit.regions.items()]
    return spark.createDataFrame(rows, MODEL)


def fit_of(models: DataFrame, version: str) -> Fit:
    """One version of a model table as a ``Fit``; it explains and scores without the pipeline that made it."""
    rows = models.filter(F.col("version") == version).collect()  # as many as the model has terms
    if not rows:
        raise ValueError(f"no model of version {version}")
    features = [r for r in rows if r["kind"] == "feature"]
    return Fit({r["term"]: r["mean"] for r in features}, {r["term"]: r["scale"] for r in features},
               {r["term"]: r["weight"] for r in features}, next(r["weight"] for r in rows if r["kind"] == "intercept"),
               {r["term"]: r["weight"] for r in rows if r["kind"] == "region"})


def save_models(models: DataFrame, path: str) -> None:
    """Write versions of a model table, each into a folder of its own; a version that is there already is replaced."""
    for row in models.select("version").distinct().collect():
        part = models.filter(F.col("version") == row["version"])
        part.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{row['version']}")


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """All versions below a folder that ``save_models`` wrote."""
    return spark.read.schema(MODEL).option("recursiveFileLookup", True).parquet(path)


def save_fit(fit: Fit, path: str, version: str = "served") -> None:
    """Save a fit's coefficients; ``load_fit`` gives the same scores back."""
    save_models(model_table(SparkSession.active(), fit, version), path)


def load_fit(spark: SparkSession, path: str, version: str = "served") -> Fit:
    return fit_of(load_models(spark, path), version)


def score(rows: DataFrame, models: DataFrame, as_of: str = "as_of", region: str = "state") -> DataFrame:
    """Rows explained by the version that serves their date; a date without a model drops out.

    A model table has a few dozen lines. Its versions become one line each, which is joined by
    name, so rows of all versions are scored in the same pass.
    """
    lines = models.groupBy("version", "valid_from", "valid_to").agg(
        F.max(F.when(F.col("kind") == "intercept", F.col("weight"))).alias("intercept"),
        F.collect_list(F.when(F.col("kind") == "feature", F.struct("term", F.struct("mean", "scale", "weight").alias("x"))))
        .alias("_features"))
    versions = lines.select("version", "valid_from", "valid_to").collect()  # one line for each model that was kept
    keys = [r["term"] for r in models.filter("kind = 'feature'").select("term").distinct().collect()]
    keys = [k for k in KEYS if k in keys] + sorted(set(keys) - set(KEYS))
    day = F.col(as_of).cast("date")
    name = F.lit(None).cast("string")
    for row in sorted(versions, key=lambda r: (r["valid_from"] or "", r["version"])):
        serves = day.isNotNull()
        serves = serves & (day >= F.lit(row["valid_from"]).cast("date")) if row["valid_from"] else serves
        serves = serves & (day <= F.lit(row["valid_to"]).cast("date")) if row["valid_to"] else serves
        name = F.when(serves, F.lit(row["version"])).otherwise(name)
    by_term = F.map_from_entries("_features")
    terms = lines.select(F.col("version").alias("model"), F.struct("intercept", *[by_term[k].alias(k) for k in keys]).alias("_terms"))
    effects = models.filter("kind = 'region'").select(F.col("version").alias("model"), F.col("term").alias(region), F.col("weight").alias("_effect"))
    named = rows.withColumn("model", name).join(terms, "model").join(effects, ["model", region], "left")
    return explained(named, keys, region)


def train_forest(rows: DataFrame, label: str = "flood", region: str = "state", trees: int = 150) -> PipelineModel:
    """Random forest on the same features, as a benchmark; trees grow until a leaf has 25 rows, or to Spark's limit of 30."""
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, CAST({label} AS DOUBLE) AS y FROM __THIS__"),
        StringIndexer(inputCol=region, outputCol="_region", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCol="_region", outputCol="_dummies", dropLast=True),
        VectorAssembler(inputCols=[*KEYS, "_dummies"], outputCol="_x"),
        RandomForestClassifier(featuresCol="_x", labelCol="y", numTrees=trees, maxDepth=30, minInstancesPerNode=25,
                               subsamplingRate=0.5, seed=42)]).fit(rows)


def climatology(train_rows: DataFrame, test_rows: DataFrame, label: str = "flood") -> DataFrame:
    """Each district-month's training flood rate, or the mean rate where there is none."""
    rates = train_rows.groupBy("district", "month").agg(F.avg(label).alias("_rate"))
    mean = train_rows.agg(F.avg(label).alias("_mean")).withColumn("_k", F.lit(1))
    return (test_rows.join(rates, ["district", "month"], "left").withColumn("_k", F.lit(1)).join(mean, "_k")
            .withColumn("probability", F.coalesce("_rate", "_mean")).drop("_rate", "_mean", "_k"))


# ── evaluation ──────────────────────────────────────────────────────────────


def metrics(scored: DataFrame, threshold: float = THRESHOLD, keys: list[str] | None = None, label: str = "flood",
            prob: str = "probability") -> DataFrame:
    """Confusion counts, rates, exact ROC-AUC with ties, step-wise average precision and Brier score.

    The rows are read once and reduced to one line per distinct score. Running totals over
    those, in buckets, give all figures, so a large test set is never sorted in one task.
    """
    keys = keys or []
    scope = keys or ["_all"]
    base = scored if keys else scored.withColumn("_all", F.lit(1))
    steps = running_totals(base, scope, prob, {"_pos": F.count_if(F.col(label) == 1), "_cnt": F.count("*")}, descending=True)
    pos, cnt, p = F.col("_pos"), F.col("_cnt"), F.col(prob)
    neg, hit = cnt - pos, p >= threshold

    def amount(value: Column, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0))

    # Areas over positives x negatives; both totals are only known at the end of the same aggregate.
    neg_ahead = F.col("_cnt_before") - F.col("_pos_before")
    precision = (F.col("_pos_before") + pos) / (F.col("_cnt_before") + cnt)
    sums = steps.groupBy(*scope).agg(
        F.sum(cnt).alias("n"), F.sum(pos).alias("positives"), amount(pos, hit).alias("tp"), amount(neg, hit).alias("fp"),
        amount(neg, ~hit).alias("tn"), amount(pos, ~hit).alias("fn"),
        (F.sum(pos * (1 - p) * (1 - p) + neg * p * p) / F.sum(cnt)).alias("brier"),
        F.sum(pos * (neg_ahead + neg / 2)).alias("_worse"), F.sum(pos * precision).alias("_gain"))
    negatives = F.col("n") - F.col("positives")
    both = (F.col("positives") > 0) & (negatives > 0)
    sums = sums.withColumns({
        "roc_auc": F.when(both, 1 - F.try_divide(F.col("_worse"), F.col("positives") * negatives)),
        "average_precision": F.when(both, F.try_divide(F.col("_gain"), F.col("positives")))})
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def share(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    out = sums.select(
        *scope, F.lit(threshold).alias("threshold"), "n", "positives", "tp", "fp", "tn", "fn",
        F.bround((tp + F.col("tn")) / F.col("n"), 3).alias("accuracy"), F.bround(share(tp, tp + fp), 3).alias("precision"),
        F.bround(share(tp, tp + fn), 3).alias("recall"), F.bround(share(tp * 2, tp * 2 + fp + fn), 3).alias("f1"),
        F.bround("roc_auc", 3).alias("roc_auc"), F.bround("average_precision", 3).alias("average_precision"),
        F.bround("brier", 3).alias("brier"))
    return out if keys else out.drop("_all")


def region_metrics(scored: DataFrame, region: str = "state") -> DataFrame:
    """Metrics by region; the AUC only where there are enough positives and some negatives."""
    main = metrics(scored, THRESHOLD, [region])
    action = metrics(scored, ACTION_THRESHOLD, [region]).select(
        region, F.col("precision").alias("precision_action"), F.col("recall").alias("recall_action"))
    size = scored.groupBy(region).agg(F.countDistinct("district").alias("districts"))
    enough = (F.col("positives") >= MIN_REGION_POSITIVES) & (F.col("positives") < F.col("n"))
    some = F.col("positives") > 0
    return main.join(action, region).join(size, region).select(
        region, "districts", "n", "positives", F.bround(F.col("positives") / F.col("n"), 3).alias("positive_rate"),
        F.when(enough, F.col("roc_auc")).alias("roc_auc"), F.when(some, F.col("precision")).alias("precision"),
        F.when(some, F.col("recall")).alias("recall"), F.when(some, F.col("precision_action")).alias("precision_action"),
        F.when(some, F.col("recall_action")).alias("recall_action"))


def backtests(scored: DataFrame, events: DataFrame) -> DataFrame:
    """How known months were rated against what was recorded; ``events`` has name, year, month and state."""
    level = risk_level(F.col("probability"))
    rated = scored.join(events, ["year", "month", "state"]).withColumns(
        {"_high": level.isin("high", "critical"), "_medium": level != "low"})
    seen = F.col("flood") == 1
    return rated.groupBy("name", "expect").agg(
        F.count("*").alias("district_count"), F.count_if(seen).alias("observed_floods"),
        F.count_if("_high").alias("flagged_high"), F.count_if("_medium").alias("flagged_medium_up"),
        F.count_if(F.col("_high") & seen).alias("flagged_and_observed"),
        F.count_if(F.col("_medium") & seen).alias("medium_up_and_observed"),
        F.bround(F.avg("probability"), 3).alias("mean_probability"))


def evaluate(rows: DataFrame, until: int = TRAIN_UNTIL, trees: int = 150) -> dict[str, DataFrame]:
    """Fit on the years up to ``until`` and test on the later ones, beside four simple baselines."""
    data = complete_rows(rows, ["flood"])
    early, late = data.filter(F.col("year") <= until), data.filter(F.col("year") > until)
    fit, forest = train(early), train_forest(early, trees=trees)
    history = train(early, region="", features=["prior_flood_rate"])
    scored = predict(late, fit.pipeline)
    models = {"logistic": scored, "random_forest": predict(late, forest),
              "history_only": predict(late, history.pipeline), "climatology": climatology(early, late),
              "always_no_flood": late.withColumn("probability", F.lit(0.0))}
    out = {name: metrics(df) for name, df in models.items()}
    out["logistic_action"] = metrics(scored, ACTION_THRESHOLD)
    out["random_forest_action"] = metrics(models["random_forest"], ACTION_THRESHOLD)
    out["by_region"] = region_metrics(scored)
    return out


# ── explaining and scoring ──────────────────────────────────────────────────


def _terms(fit: Fit) -> Column:
    """The coefficients of a fit as one struct: the intercept and, by feature, mean, scale and weight."""
    return F.struct(F.lit(float(fit.intercept)).alias("intercept"), *[
        F.struct(*[F.lit(float(x)).alias(n) for n, x in (("mean", fit.means[k]), ("scale", fit.scales[k]), ("weight", fit.coefs[k]))])
        .alias(k) for k in fit.coefs])


def explain(rows: DataFrame, fit: Fit, region: str = "state") -> DataFrame:
    """Probability, level and each factor's part of the log-odds, largest first.

    The parts and the baseline add up to the log-odds. An unknown region has no part.
    """
    effects = rows.sparkSession.createDataFrame(list(fit.regions.items()) or [("", 0.0)], f"{region} string, _effect double")
    return explained(rows.join(effects, region, "left").withColumn("_terms", _terms(fit)), list(fit.coefs), region)


def explained(rows: DataFrame, keys: list[str], region: str = "state") -> DataFrame:
    """Scores of rows that carry their model in ``_terms`` and their region's baseline in ``_effect``."""
    parts = {k: (F.col(k).cast("double") - F.col(f"_terms.{k}.mean")) / F.col(f"_terms.{k}.scale") * F.col(f"_terms.{k}.weight")
             for k in keys}
    out = rows.withColumns({f"_p_{k}": v for k, v in parts.items()})
    logit = F.col("_terms.intercept") + F.coalesce("_effect", F.lit(0.0))
    for k in parts:
        logit = logit + F.col(f"_p_{k}")
    probability = F.lit(1.0) / (F.exp(-logit) + 1)
    specs = {f[0]: f for f in FEATURES}

    def factor(key: str, part: Column, label: str, unit: str, value: Column, average: Column, said: Column) -> Column:
        return F.struct((-F.abs(part)).alias("order"), F.lit(key).alias("key"), F.lit(label).alias("label"),
                        F.lit(unit).alias("unit"), value.cast("string").alias("value"), average.alias("average"),
                        F.bround(part, 3).alias("contribution"),
                        F.when(part > 0, "raises").otherwise("lowers").alias("direction"), said.alias("said"))

    listed = []
    for k in parts:
        _, label, unit, *_ = specs.get(k, (k, k, "", None, None))
        number = F.col(k).cast("double")
        listed.append(factor(k, F.col(f"_p_{k}"), label, unit, F.bround(number, 3), F.bround(F.col(f"_terms.{k}.mean"), 3),
                             F.concat(F.lit(label.lower() + " "), amount(number, unit))))
    listed.append(F.when(F.col("_effect").isNotNull(), factor(
        region, F.col("_effect"), "Region", "state", F.col(region), F.lit(None).cast("double"),
        F.concat(F.col(region), F.lit("'s baseline")))))
    names = ("key", "label", "unit", "value", "average", "contribution", "direction", "said")
    factors = F.transform(F.array_sort(F.array_compact(F.array(*listed))), lambda x: F.struct(*[x[n].alias(n) for n in names]))
    drops = ["_effect", "_terms", "_said", *[f"_p_{k}" for k in parts]]
    shown = F.transform("_said", lambda x: F.struct(*[x[n].alias(n) for n in names[:-1]]))
    return out.withColumns({"_logit": logit, "_said": factors}).withColumns({
        "probability": F.bround(probability, 3), "level": risk_level(probability), "log_odds": F.bround("_logit", 3),
        "baseline_log_odds": F.bround("_terms.intercept", 3), "factors": shown, "summary": _summary("_said")}).drop("_logit", *drops)


def amount(value: Column, unit: str) -> Column:
    """A feature's value with its unit, as it is read out."""
    if unit == "% of normal":
        return F.format_string("%.0f%% of normal", F.rint(value))
    if unit == "share":
        return F.format_string("%.0f%% of past years", F.rint(value * 100))
    if unit == "0-1":
        return F.format_string("%.2f", F.bround(value, 2))
    return F.concat(F.format_number(F.rint(value), 0), F.lit(f" {unit}"))


def _summary(factors: str) -> Column:
    """The strongest factors in one sentence: up to three that matter, else the first."""
    strong = F.filter(factors, lambda x: F.abs(x["contribution"]) >= 0.1)
    top = F.when(F.size(strong) > 0, F.slice(strong, 1, 3)).otherwise(F.slice(factors, 1, 1))
    words = F.array_join(F.transform(top, lambda x: F.concat_ws(" ", x["said"], x["direction"], F.lit("risk"))), "; ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)), F.lit("."))


def what_if(current: DataFrame, overrides: DataFrame, fit: Fit) -> DataFrame:
    """Scores with some features of a district replaced; a bad row carries its reason instead.

    ``overrides`` has a district and any of the features; a null feature keeps the current value.
    """
    given = [k for k in KEYS if k in overrides.columns]
    asked = overrides.select("district", *[F.col(k).alias(f"_o_{k}") for k in given])
    rows = asked.join(current.select("district", "state", *KEYS).withColumn("_known", F.lit(True)), "district", "left")
    reasons = [F.when(F.col("_known").isNull(), F.concat(F.lit("unknown district "), "district"))]
    for key, label, unit, low, high in FEATURES:
        if key in given:
            reasons.append(F.when(~F.col(f"_o_{key}").between(low, high),
                                  F.lit(f"{label} must be between {low} and {high} ({unit})")))
    rows = rows.withColumns({k: F.coalesce(f"_o_{k}", k) for k in given})
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in KEYS])), ", ")
    rows = rows.withColumn("error", F.coalesce(*reasons, F.when(missing != "", F.concat(F.lit("missing: "), missing))))
    rows = rows.drop("_known", *[f"_o_{k}" for k in given])
    return explain(rows, fit).withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("probability", "level")})


def model_card(spark: SparkSession, fit: Fit) -> DataFrame:
    labels = {f[0]: f[1] for f in FEATURES}
    rows = [(k, labels.get(k, k), float(c), float(math.exp(c)), float(fit.means[k]), float(fit.scales[k]))
            for k, c in fit.coefs.items()]
    return spark.createDataFrame(rows, "key string, label string, coefficient double, odds_ratio_per_sd double, "
                                       "mean double, sd double")


def region_effects(rows: DataFrame, fit: Fit, region: str = "state") -> DataFrame:
    """Each region's baseline beside its raw flood rate."""
    effects = rows.sparkSession.createDataFrame(list(fit.regions.items()), f"{region} string, coefficient double")
    rates = rows.groupBy(region).agg(F.bround(F.avg("flood"), 3).alias("flood_rate"),
                                     F.countDistinct("district").alias("districts"))
    return effects.join(rates, region).withColumn("odds_ratio", F.exp("coefficient"))


def label_coverage(rows: DataFrame, districts: DataFrame) -> DataFrame:
    facts = rows.agg(F.count("*").alias("rows"), F.bround(F.avg("flood"), 3).alias("positive_rate"),
                     F.countDistinct("district").alias("districts"), F.min("year").alias("first_year"),
                     F.max("year").alias("last_year")).withColumn("_k", F.lit(1))
    people = districts.agg(F.count("population").alias("with_population"),
                           F.count_if(F.col("population").isNull()).alias("without_population")).withColumn("_k", F.lit(1))
    return facts.join(people, "_k").drop("_k")


def scenarios(events: DataFrame) -> DataFrame:
    """Known months as map scenarios; months with several events are joined."""
    once = events.groupBy("year", "month", "name", "note", "expect").agg(F.collect_set("state").alias("s"))
    return once.groupBy("year", "month").agg(
        F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("detail"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "note"))), lambda x: x["note"]), " ")
        .alias("note"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("states"),
        F.when(F.count_distinct("expect") == 1, F.min("expect")).otherwise("mixed").alias("expect"))


CURRENT = "current"
PREDICTION = ["type", "scenario", "kind", "place", "state", "lat", "lon", "population", "window_start", "as_of", "level",
              "probability", "driver", "observed", "observed_deadly"]


def scenario_ids(events: DataFrame) -> list[str]:
    """The scenarios there are: the current window, and each month of a known event as ``yyyy-mm``."""
    months = events.select(F.format_string("%04d-%02d", "year", "month").alias("id")).distinct().orderBy("id").collect()
    return [CURRENT, *[row["id"] for row in months]]  # known events are a list of a few dozen


def predictions(scenario: str, panel: DataFrame, current: DataFrame, districts: DataFrame, models: DataFrame,
                events: DataFrame) -> DataFrame:
    """Districts scored for a scenario, most likely first.

    The current window has ``window_start`` and ``as_of`` of its own. A past month is taken from the
    panel with the label that was observed, and scored by the model that serves its last day:
    one that was fitted on the years before, so that the replay is out of sample.
    """
    known = scenario_ids(events)
    if scenario not in known:
        raise ValueError(f"Unknown scenario '{scenario}'. Use one of: {', '.join(known)}")
    info = districts.select("district", "population", "lat", "lon", "low_lying_pct")
    if scenario == CURRENT:
        rows = complete_rows(current).withColumns({"observed": F.lit(None).cast("long"), "observed_deadly": F.lit(None).cast("long")})
    else:
        year, month = map(int, scenario.split("-"))
        first = F.make_date("year", "month", F.lit(1))
        rows = scenario_rows(panel, districts, year, month).drop("population", "lat", "lon", "low_lying_pct").withColumns({
            "window_start": first, "as_of": F.last_day(first), "observed": F.col("flood"), "observed_deadly": F.col("deadly")})
    rows = rows.join(info, "district", "left").withColumns({
        "scenario": F.lit(scenario), "kind": F.lit("current" if scenario == CURRENT else "backtest")})
    return score(rows, models).orderBy(F.desc("probability"), "district")


def flood_prediction_rows(scored: DataFrame) -> DataFrame:
    """Scored districts in the schema that all hazards share."""
    driver = F.get("factors", 0)["label"]
    return scored.withColumns({"type": F.lit("flood"), "place": F.col("district"), "driver": driver,
                               "window_start": F.col("window_start").cast("string"), "as_of": F.col("as_of").cast("string")}
                              ).select(*PREDICTION)


def index_prediction_rows(index: DataFrame, regions: DataFrame, kind: str, period: tuple[int, int]) -> DataFrame:
    """A hazard index in the schema that all hazards share; ``regions`` has place and population."""
    if kind not in INDEX_TESTS:
        raise ValueError(f"Unknown hazard '{kind}'. Use one of: {', '.join(INDEX_TESTS)}")
    rows = index.select("region", "level", "probability", "driver").join(regions.select("region", "lat", "lon", "population"), "region")
    none = F.lit(None).cast("long")
    return rows.select(
        F.lit(kind).alias("type"), F.lit("long-term").alias("scenario"), F.lit("index").alias("kind"), F.col("region").alias("place"),
        F.col("region").alias("state"), "lat", "lon", "population", F.lit(str(period[0])).alias("window_start"),
        F.lit(str(period[1])).alias("as_of"), "level", "probability", "driver", none.alias("observed"), none.alias("observed_deadly"))


def scenario_rows(panel: DataFrame, districts: DataFrame, year: int, month: int) -> DataFrame:
    """One month of the panel with the attributes of its districts, ready for scoring."""
    info = districts.select("district", "population", "lat", "lon", "low_lying_pct")
    return complete_rows(panel.filter((F.col("year") == year) & (F.col("month") == month))).join(info, "district", "left")


def label_check(series: DataFrame, other: DataFrame, flag: str = "floods") -> DataFrame:
    """Whether two annual series agree, and the rain that divides flood years from the rest."""
    both = series.join(other, "year", "left")
    shared = F.when(F.col("other_rainfall").isNotNull(), F.col("annual_rainfall"))
    return both.agg(
        F.bround(pearson(shared, F.col("other_rainfall")), 3).alias("r"),
        F.max(F.when(F.col(flag) == 0, F.col("annual_rainfall"))).alias("max_no_year"),
        F.min(F.when(F.col(flag) == 1, F.col("annual_rainfall"))).alias("min_yes_year"),
        F.rint(F.avg("other_rainfall")).alias("other_mean"), F.rint(F.avg("annual_rainfall")).alias("own_mean"),
        F.count("other_rainfall").alias("overlap_years"))


# ── hazard index ────────────────────────────────────────────────────────────


def index_tests(regions: DataFrame, kind: str, years: int) -> DataFrame:
    """Each region's tests: events, chance a year and level."""
    tests = F.explode(F.array(*[
        F.struct(F.lit(place).alias("place"), F.lit(key).alias("key"), F.lit(label).alias("label"),
                 F.col(count).alias("events"), F.lit(critical).alias("c"), F.lit(high).alias("h"), F.lit(medium).alias("m"))
        for place, (key, label, count, critical, high, medium) in enumerate(INDEX_TESTS[kind])])).alias("x")
    rows = regions.select("region", tests).select("region", "x.*")
    rows = rows.withColumn("probability", annual_probability(F.col("events"), F.lit(float(years))))
    return rows.withColumn("level", level_of(F.col("probability"), F.col("c"), F.col("h"), F.col("m"))).drop("c", "h", "m")


def hazard_index(regions: DataFrame, kind: str, years: int) -> DataFrame:
    """The test with the highest level decides, then the higher chance; the first test wins a tie."""
    tests = index_tests(regions, kind, years)
    best = F.max_by(F.struct("level", "probability", "label"),
                    F.struct(level_order(F.col("level")), "probability", -F.col("place")))
    return regions.join(tests.groupBy("region").agg(best.alias("_b")), "region").withColumns({
        "level": F.col("_b.level"), "probability": F.bround("_b.probability", 4), "driver": F.col("_b.label"),
    }).drop("_b")


def index_order(index: DataFrame) -> DataFrame:
    return index.orderBy(F.desc(level_order(F.col("level"))), F.desc("probability"), "region")


def index_summary(index: DataFrame, kind: str) -> DataFrame:
    """A sentence on each region's record."""
    if kind == "earthquake":
        text = F.concat(
            F.format_string("%d M6+ earthquakes within 300 km since 1950", "eq_events_m6"),
            F.when(F.col("eq_events_m7") > 0, F.format_string(", %d of them M7+", "eq_events_m7")).otherwise(""),
            F.format_string("; strongest M%.1f in %d.", "eq_max_magnitude", "eq_max_year"))
        return index.withColumn("summary", F.when(
            F.col("eq_events_m6") == 0, "No M6+ earthquake within 300 km since 1950.").otherwise(text))
    text = F.concat(
        F.format_string("%d tropical storms within 100 km since 1980", "cy_storms_ts"),
        F.when(F.col("cy_storms_hurricane") > 0, F.format_string(", %d at hurricane strength", "cy_storms_hurricane"))
        .otherwise(""),
        F.format_string("; strongest %s (%d) at %.0f kt.", F.initcap("cy_max_name"), "cy_max_season", "cy_max_wind_kt"))
    return index.withColumn("summary", F.when(
        F.col("cy_storms_ts") == 0, "No tropical storm passed within 100 km since 1980.").otherwise(text))


def known_event_check(exposure: DataFrame, expected: DataFrame, size: str, year: str = "year",
                      distance: str = "dist_km") -> DataFrame:
    """Whether each expected event is in the catalogue at its minimum size."""
    hits = exposure.select("region", F.col(year).alias("year"), F.col(size).alias("_size"), F.col(distance).alias("_km"))
    out = expected.join(hits, ["region", "year"], "left").withColumn(
        "_ok", F.coalesce(F.col("_size") >= F.col("minimum"), F.lit(False)))
    return out.groupBy("name", "region", "year").agg(
        F.bool_or("_ok").alias("found"), F.max(F.when(F.col("_ok"), F.col("_size"))).alias("largest"),
        F.min(F.when(F.col("_ok"), F.col("_km"))).alias("closest_km"))


def level_counts(rows: DataFrame, level: str = "level") -> DataFrame:
    """Rows of each level, levels without any shown as 0."""
    counted = rows.agg(*[F.count_if(F.col(level) == name).alias(name) for name in LEVELS])
    return counted.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("level"), F.col(name).alias("count")) for name in LEVELS])).alias("x")).select("x.*")


def by_state(rows: DataFrame, state: str | None, everything: str = "All India") -> DataFrame:
    return rows if not state or state == everything else rows.filter(F.col("state") == state)


def state_options(rows: DataFrame) -> DataFrame:
    return rows.select("state").filter("state IS NOT NULL").distinct().orderBy("state")


def map_headline(rows: DataFrame) -> DataFrame:
    """The facts behind a map's headline sentence, per state."""
    raised = F.col("level").isin("high", "critical")
    return rows.groupBy("state").agg(
        F.count("*").alias("districts"), F.count_if(raised).alias("raised"),
        F.count_if(F.col("level") != "low").alias("medium_up"), F.count_if(F.col("flood") == 1).alias("observed"),
        F.min("rain_pct_normal").alias("low_rain"), F.max("rain_pct_normal").alias("high_rain"),
        F.max_by("district", F.struct("probability", "district")).alias("top_district"))


def top_per_region(exposure: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    ranked = exposure.withColumn("rank", F.row_number().over(W.partitionBy("region").orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)
