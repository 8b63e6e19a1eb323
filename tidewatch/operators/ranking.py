"""Ranks over a whole group without holding the group in one task.

Values are first counted, so ties collapse, and then put into buckets whose order follows
the order of the values. A window runs inside a bucket; another, over at most a few
thousand buckets of a group, carries the running totals from bucket to bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.session import materialise

STEPS_PER_OCTAVE = 1024


def order_bucket(value: Column) -> Column:
    """Bucket number that never decreases as the value grows.

    Each power of two is cut into equal steps, so the number of buckets depends on the
    span of the values and not on how many there are.
    """
    size = F.abs(value.cast("double"))
    exponent = F.floor(F.log2(F.greatest(size, F.lit(1e-300))))
    step = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * STEPS_PER_OCTAVE)
    bucket = (exponent + 1100) * STEPS_PER_OCTAVE + step
    return F.when(size < 1e-300, F.lit(0)).otherwise(F.signum(value.cast("double")) * bucket).cast("long")


def running_totals(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column],
                   descending: bool = False) -> DataFrame:
    """One row per distinct value with each sum over that value and ``<name>_before`` over all values ahead of it."""
    sign = -1 if descending else 1
    scope = keys or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(1))
    per_value = base.groupBy(*scope, value).agg(*[expr.alias(name) for name, expr in sums.items()])
    per_value = per_value.withColumn("_bucket", order_bucket(F.col(value)) * sign)
    by_bucket = W.partitionBy(*scope).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = per_value.groupBy(*scope, "_bucket").agg(*[F.sum(n).alias(n) for n in sums]).select(
        *[F.col(k).alias(f"_of_{k}") for k in (*scope, "_bucket")],
        *[F.coalesce(F.sum(n).over(by_bucket), F.lit(0)).alias(f"_{n}_ahead") for n in sums])
    # Null-safe keys keep both sides free of pushed null filters, so they share one shuffle of the counts.
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*scope, "_bucket")])
    order = F.desc(value) if descending else F.asc(value)
    inside = W.partitionBy(*scope, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = per_value.join(buckets, same).select(
        *scope, value, *sums,
        *[(F.col(f"_{n}_ahead") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before") for n in sums])
    return out if keys else out.drop("_all")


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rank of each distinct value, where equal values share the mean of their places."""
    totals = running_totals(df, keys, value, {"_n": F.count("*")})
    return totals.select(*keys, value, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name))


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str,
                   weight: str | None = None) -> DataFrame:
    """Exact quantile (linear between neighbours) of each group, of any size; ``weight`` says how often a value occurs."""
    times = F.sum(weight) if weight else F.count("*")
    totals = running_totals(df.filter(F.col(value).isNotNull()), keys, value, {"_n": times})
    scope = keys or ["_all"]
    totals = totals if keys else totals.withColumn("_all", F.lit(1))
    sizes = totals.groupBy(*scope).agg(F.sum("_n").alias("_size"))
    place = F.lit(q) * (F.col("_size") - 1)
    low, high = F.floor(place), F.ceil(place)
    first, last = F.col("_n_before"), F.col("_n_before") + F.col("_n") - 1
    out = totals.join(sizes, scope).groupBy(*scope).agg(
        F.max(F.when((first <= low) & (last >= low), F.col(value))).alias("_lo"),
        F.max(F.when((first <= high) & (last >= high), F.col(value))).alias("_hi"),
        F.first(place - low).alias("_part"),
    ).select(*scope, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias(name))
    return out if keys else out.drop("_all")


def positions(ordered: DataFrame, name: str = "place") -> DataFrame:
    """The rows of a sorted table with their place from 1, without a window over the whole table.

    A sort deals ranges to partitions in order. The rows are written with their partition and
    their place in it; totals of the partitions before, one row each, then make that the place in the table.
    """
    kept = materialise(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "sorted")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    sizes = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (kept.join(sizes, "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1)
            .drop("_part", "_at", "_first", "_before"))
