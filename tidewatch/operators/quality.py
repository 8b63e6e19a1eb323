"""Data-quality checks. Each returns a DataFrame of what is wrong, or one row of figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Enumerations and text lengths of the response desk's records.
ROLES = ["Volunteer", "Transporter", "Medical", "Rescue", "NGO", "Coordinator"]
AVAILABILITY = ["now", "2hrs", "unavailable"]
HAZARDS = ["flood", "cyclone", "earthquake"]
PRIORITIES = ["Critical", "High", "Medium"]
STATUSES = ["assigned", "accepted", "collected", "in_transit", "delivered"]

# Rules as (field, SQL that holds for a good value). A null breaks a rule unless it says otherwise.
RESPONDER_RULES = [
    ("name", "name IS NOT NULL AND length(name) BETWEEN 1 AND 80"), ("role", f"role IN {tuple(ROLES)}"),
    ("city", "length(city) <= 80"), ("state", "length(state) <= 80"), ("availability", f"availability IN {tuple(AVAILABILITY)}"),
    ("capacity", "capacity BETWEEN 0 AND 100000"), ("skills", "length(skills) <= 200"), ("phone", "length(phone) <= 20"),
    ("photo", "length(photo) <= 200000"), ("created_at", "length(created_at) <= 40"), ("updated_at", "length(updated_at) <= 40"),
]
PLAN_RULES = [
    ("area", "length(area) <= 120"), ("state", "length(state) <= 120"), ("hazard", f"hazard IN {tuple(HAZARDS)}"),
    ("level", "length(level) <= 20"), ("population", "population IS NULL OR population = population"), ("needs", "size(needs) <= 10"), ("source", "source IN ('gemini', 'fallback')"),
]
TASK_RULES = [
    ("number", "number IS NOT NULL"), ("need", "length(need) <= 120"), ("from", "length(`from`) <= 120"),
    ("to", "length(`to`) <= 120"), ("details", "length(details) <= 300"), ("assignee_id", "length(assignee_id) <= 64"),
    ("priority", f"priority IN {tuple(PRIORITIES)}"), ("status", f"status IN {tuple(STATUSES)}"),
    ("last_note", "length(last_note) <= 500"), ("deadline", "length(CAST(deadline AS STRING)) <= 40"),
    ("assignee_name", "length(assignee_name) <= 80"), ("proof_count", "proof_count IS NOT NULL"),
]
UPDATE_RULES = [
    ("status", f"status IN {tuple(STATUSES[1:])}"), ("note", "length(note) <= 500"), ("photo", "length(photo) <= 400000"),
    ("by", "length(`by`) <= 80"), ("at", "length(CAST(`at` AS STRING)) <= 40"), ("lat", "lat IS NULL OR lat = lat"),
    ("lon", "lon IS NULL OR lon = lon"),
]
#: Fields that a record may lack.
OPTIONAL = ["population", "lat", "lon"]


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def reconcile(parts: DataFrame, totals: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums of the parts beside the stated totals, with the difference."""
    a = parts.groupBy(*keys).agg(F.sum(value).alias("parts"))
    b = totals.groupBy(*keys).agg(F.sum(value).alias("total"))
    return a.join(b, keys, "full").withColumn(
        "difference", F.coalesce("parts", F.lit(0)) - F.coalesce("total", F.lit(0)))


def control_total(df: DataFrame, value: str, expected: int) -> DataFrame:
    return df.agg(F.sum(value).alias("total")).withColumns(
        {"expected": F.lit(expected).cast("long"), "ok": F.col("total") == expected})


def missing_keys(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(have.select(*keys), keys, "left_anti")


def bound_violations(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """How many values lie outside their plausible range, per column, in one pass."""
    def outside(name: str) -> Column:
        low, high = bounds[name]
        tests = [F.col(name) < low] if low is not None else []
        tests += [F.col(name) > high] if high is not None else []
        return reduce(lambda a, b: a | b, tests)

    counts = df.agg(*[F.count_if(outside(name)).alias(name) for name in bounds])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("column"), F.col(name).alias("violations"))
                                             for name in bounds])).alias("x")).select("x.*")


def reject_share(rejects: DataFrame, whole: DataFrame, limit: float = 0.05) -> DataFrame:
    one = F.lit(1).alias("_k")
    both = rejects.agg(F.count("*").alias("rejected")).select("*", one).join(
        whole.agg(F.count("*").alias("all")).select("*", one), "_k").drop("_k")
    share = F.try_divide("rejected", "all")
    return both.withColumns({"share": share, "ok": share < limit})


def missing_months(panel: DataFrame, first: int, last: int) -> DataFrame:
    """District-months that a complete panel would have and this one lacks."""
    from tidewatch.operators.panel import dense_months

    grid = dense_months(panel.sparkSession, panel, first, last)
    return grid.join(panel.select("district", "year", "month"), ["district", "year", "month"], "left_anti")


def violations(df: DataFrame, rules: list[tuple[str, str]], allowed: list[str] | None = None,
               whole: bool = False) -> DataFrame:
    """Rows with the names of the fields that break their rule; a null breaks it too.

    With ``whole`` the table must have every field of the rules but the optional ones, and one that is
    absent is a violation of each row; without it absent fields are not checked.
    """
    if allowed is not None and set(df.columns) - set(allowed):
        raise ValueError(f"fields not allowed: {', '.join(sorted(set(df.columns) - set(allowed)))}")
    broken = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(field)) if field in df.columns else F.lit(field)
              for field, rule in rules if field in df.columns or (whole and field not in OPTIONAL)]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the quarantined ones with their reasons."""
    marked = violations(df, rules)
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def range_messages(df: DataFrame, ranges: list[tuple[str, float, float]]) -> DataFrame:
    """A message for the first value out of range, or null."""
    texts = [F.when(~F.col(name).between(low, high), F.lit(f"{name} must be between {low} and {high}"))
             for name, low, high in ranges]
    return df.withColumn("message", F.coalesce(*texts))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of either table that the other lacks; empty when the sets are equal."""
    left = a.distinct().exceptAll(b.distinct()).withColumn("only_in", F.lit("first"))
    return left.unionByName(b.distinct().exceptAll(a.distinct()).withColumn("only_in", F.lit("second")))


def region_population(census: DataFrame, moved: dict[tuple[str, str], str], renamed: dict[str, str]) -> DataFrame:
    """Census districts rolled up to today's regions: moved districts, renamed states, else the state's own name."""
    by_district = F.create_map(*[F.lit(x) for (state, district), region in moved.items() for x in (f"{state}|{district}", region)])
    by_state = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair])
    plain = F.replace(F.initcap("state"), F.lit(" And "), F.lit(" and "))
    region = F.coalesce(by_district[F.concat_ws("|", "state", "district")], by_state[F.col("state")], plain)
    return census.groupBy(region.alias("region")).agg(F.sum("population").alias("population"))
