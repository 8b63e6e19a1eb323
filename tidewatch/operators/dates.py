"""Repair of mixed day-first and month-first dates in a numbered event inventory."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import date_readings, start_choices

SHAPE = r"^(.*)-([1-9]\d{3})-(\d{4})$"
ORDER_BREAK = 10  # cost of an event that starts before the one numbered ahead of it


def number_events(events: DataFrame) -> DataFrame:
    """Inventory, year and number of each event id, one line per id.

    The number has four digits, so an inventory holds at most ten thousand events of a
    year. That bounds every run below. Ids of another shape are ``unnumbered``. Of lines with
    the same id the first in the order of all their columns counts.
    """
    columns = ["uei", *[c for c in events.columns if c != "uei"]]
    fit = events.filter(F.col("uei").rlike(SHAPE))
    once = fit.groupBy("uei").agg(F.min(F.struct(*columns)).alias("_line")).select("_line.*").select(*events.columns)
    return once.withColumns({
        "_book": F.regexp_extract("uei", SHAPE, 1),
        "_year": F.regexp_extract("uei", SHAPE, 2).cast("int"),
        "_seq": F.regexp_extract("uei", SHAPE, 3).cast("int")})


def unnumbered(events: DataFrame) -> DataFrame:
    """Rejected lines: those whose id has no year and number, with the reason."""
    return events.filter(~F.coalesce(F.col("uei").rlike(SHAPE), F.lit(False))).withColumn(
        "reason", F.when(F.col("uei").isNull(), "no id").otherwise("id without year and number"))


def mark_runs(numbered: DataFrame, state: str = "state") -> DataFrame:
    """Runs of consecutive events of one state within a year, in event-number order."""
    order = W.partitionBy("_book", "_year").orderBy("_seq")
    here = F.coalesce(F.col(state), F.lit(""))
    new = F.coalesce((here != F.lag(here).over(order)).cast("int"), F.lit(1))
    return numbered.withColumn("_new", new).withColumn("run", F.sum("_new").over(order)).drop("_new")


def cheapest_starts(year: int, run) -> list:
    """Start dates of one run with the smallest total cost; the day-first reading wins ties."""
    ahead = [(datetime.date(year, 1, 1), 0)]
    trail = []
    for place, event in enumerate(run):
        readings = event["choices"]
        if len(readings) == 0:
            continue
        step = []
        for reading in readings:
            costs = [total + (ORDER_BREAK if reading["day"] < before else 0) for before, total in ahead]
            back = costs.index(min(costs))
            step.append((reading["day"], costs[back] + int(reading["cost"]), back))
        trail.append((place, step))
        ahead = [(day, total) for day, total, _ in step]
    picked = [None] * len(run)
    choice = min(range(len(ahead)), key=lambda i: ahead[i][1])
    for place, step in reversed(trail):
        picked[place], _, choice = step[choice]
    return picked


@F.pandas_udf(T.ArrayType(T.DateType()))
def cheapest_starts_udf(years: pd.Series, runs: pd.Series) -> pd.Series:
    return pd.Series([cheapest_starts(int(year), run) for year, run in zip(years, runs)])


def resolve_dates(events: DataFrame, start: str = "start_text", end: str = "end_text", duration: str = "duration",
                  state: str = "state") -> DataFrame:
    """Events with resolved ``start`` and ``end`` dates.

    The start dates of a run are chosen together. The end takes the reading on or after the
    start that comes closest to the recorded duration.
    """
    runs = mark_runs(number_events(events), state).withColumn("_choices", start_choices(F.col(start)))
    lists = runs.groupBy("_book", "_year", "run").agg(F.array_sort(F.collect_list(
        F.struct("_seq", "uei", F.col("_choices").alias("choices")))).alias("_run"))
    starts = cheapest_starts_udf("_year", "_run")
    pairs = F.explode(F.arrays_zip(F.transform("_run", lambda e: e["uei"]).alias("uei"), starts.alias("start")))
    picked = lists.select(pairs.alias("p")).select("p.uei", "p.start")
    out = runs.drop("_choices", "_book").join(picked, "uei", "left")
    later = F.filter(date_readings(F.col(end)), lambda d: d >= F.col("start"))
    options = F.when(F.size(later) == 0, F.array("start")).otherwise(later)
    gap = F.transform(options, lambda d: F.struct(
        F.abs(F.datediff(d, F.col("start")) + 1 - F.col(duration)).alias("gap"), d.alias("day")))
    wanted = F.coalesce(F.col(duration), F.lit(0.0)) != 0
    resolved = F.when(wanted, F.array_min(gap)["day"]).otherwise(F.get(options, 0))
    return out.withColumn("end", F.when(F.col("start").isNotNull(), resolved))


def event_dates(events: DataFrame, **columns: str) -> DataFrame:
    """One line per dated event, for counting when events happened."""
    return resolve_dates(events, **columns).filter(F.col("start").isNotNull()).select(
        "uei", "start", "end", F.trim(F.coalesce("state", F.lit(""))).alias("state"), "deaths")
