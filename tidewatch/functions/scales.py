"""Ratios, risk scales and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wind floor in knots of hurricane categories 1 to 5.
CATEGORY_FLOORS = [(5, 137), (4, 113), (3, 96), (2, 83), (1, 64)]

# Lower bound of each probability band.
RISK_BANDS = [("critical", 0.75), ("high", 0.50), ("medium", 0.25)]

# The outlook score's weights and the months of the four seasons.
OUTLOOK_WEIGHTS = {"frequency": 0.35, "seasonal": 0.25, "anomaly": 0.30, "geography": 0.10}
SEASONS = [(2, "Winter"), (5, "Pre-monsoon (summer)"), (9, "Southwest monsoon"),
           (12, "Post-monsoon (northeast monsoon)")]

# Progress of a task by status, in the order a task moves.
STATUS_PROGRESS = {"assigned": 10, "accepted": 25, "collected": 50, "in_transit": 75, "delivered": 100}


def cases(pairs, otherwise=None) -> Column:
    """First value whose condition holds."""
    pairs = list(pairs)
    out = F.when(pairs[0][0], pairs[0][1])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def half_up(value: Column) -> Column:
    """Round half up, as browsers do."""
    return F.floor(value + F.lit(0.5)).cast("long")


def decade_of(year: Column) -> Column:
    """Start of the decade; floor keeps years before zero right, integer division does not."""
    return (F.floor(year / 10) * 10).cast("long")


def guarded_ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """Ratio of two reported figures: null unless both are above zero."""
    return F.when((numerator > 0) & (denominator > 0), numerator / denominator * F.lit(scale))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def pct_change(new: Column, old: Column) -> Column:
    """Percent change to one decimal, null when there is nothing to compare with."""
    return F.bround(F.try_divide((new - old).cast("double"), old.cast("double")) * 100, 1)


def saffir_simpson(wind_kt: Column) -> Column:
    return cases(((wind_kt >= floor, F.lit(cat)) for cat, floor in CATEGORY_FLOORS), F.lit(0)).cast("long")


def risk_level(probability: Column) -> Column:
    return cases(((probability >= floor, F.lit(level)) for level, floor in RISK_BANDS), F.lit("low"))


def level_of(probability: Column, critical: Column, high: Column, medium: Column) -> Column:
    return cases([(probability >= critical, F.lit("critical")), (probability >= high, F.lit("high")),
                  (probability >= medium, F.lit("medium"))], F.lit("low"))


def level_order(level: Column) -> Column:
    """0 for low up to 3 for critical."""
    return cases([(level == "critical", F.lit(3)), (level == "high", F.lit(2)), (level == "medium", F.lit(1))],
                 F.lit(0))


def annual_probability(events: Column, years: Column) -> Column:
    """Chance of at least one event a year when events follow a Poisson process."""
    return -F.expm1(-events / years)


def outlook_level(score: Column) -> Column:
    return cases([(score > 80, F.lit("critical")), (score > 60, F.lit("high")), (score > 30, F.lit("medium"))],
                 F.lit("low"))


def readiness_level(percent: Column) -> Column:
    return cases([(percent >= 80, F.lit("low")), (percent >= 50, F.lit("medium")), (percent >= 20, F.lit("high"))],
                 F.lit("critical"))


def outlook_score(frequency: Column, seasonal: Column, anomaly: Column, geography: Column) -> Column:
    weights = OUTLOOK_WEIGHTS
    raw = (frequency * weights["frequency"] + seasonal * weights["seasonal"] + anomaly * weights["anomaly"]
           + geography * weights["geography"])
    return half_up(clamp(raw) * 100)


def seasonal_factor(monthly_share: Column, month: Column) -> Column:
    """A month's share beside the busiest month; flat 0.5 for a hazard without seasons."""
    peak = F.array_max(monthly_share)
    return (F.when(monthly_share.isNull(), F.lit(0.5))
            .when(peak > 0, F.element_at(monthly_share, month) / peak)
            .otherwise(F.lit(0.0)))


def season_name(month: Column) -> Column:
    return cases((month <= last, F.lit(name)) for last, name in SEASONS)


def flood_anomaly(precip: Column, soil: Column) -> Column:
    return clamp(F.greatest(F.coalesce(precip / 100, F.lit(0.0)), F.coalesce(soil / 0.75, F.lit(0.0))))


def cyclone_anomaly(wind: Column, sst: Column, coastal: Column) -> Column:
    gust = F.coalesce(wind / 60, F.lit(0.0))
    return clamp(F.when(coastal & sst.isNotNull(), gust * 0.7 + clamp((sst - 26) / 2) * 0.3).otherwise(gust))


def quake_anomaly(magnitude: Column) -> Column:
    return clamp(F.coalesce((magnitude - 3) / 2, F.lit(0.0)))


def indicator_status(value: Column, threshold: Column) -> Column:
    return cases([(value.isNull(), F.lit("unavailable")), (value > threshold, F.lit("critical")),
                  (value >= threshold * 0.75, F.lit("alert"))], F.lit("normal"))


def correlation_strength(r: Column) -> Column:
    size = F.abs(r)
    return cases([(r.isNull(), F.lit("unmeasured")), (size < 0.1, F.lit("no")), (size < 0.3, F.lit("a weak")),
                  (size < 0.6, F.lit("a moderate"))], F.lit("a strong"))


def trend_words(direction: Column) -> Column:
    return F.when(direction.isNull() | (direction == "insufficient"), "too few years to judge").otherwise(direction)


def status_progress(status: Column) -> Column:
    return cases(((status == name, F.lit(value)) for name, value in STATUS_PROGRESS.items()), F.lit(0)).cast("long")


def status_group(status: Column) -> Column:
    return cases([(status == "delivered", F.lit("completed")), (status == "assigned", F.lit("pending"))],
                 F.lit("in_progress"))


def moves_forward(current: Column, new: Column) -> Column:
    """Whether a task may move from one status to another."""
    order = F.array(*[F.lit(name) for name in STATUS_PROGRESS])
    return F.array_position(order, new) > F.greatest(F.array_position(order, current), F.lit(1))


def valid_phone(text: Column) -> Column:
    """7 to 15 digits with an optional plus, spaces and dashes; empty is allowed."""
    trimmed = F.trim(text)
    digits = F.length(F.regexp_replace(text, r"\D", ""))
    return (trimmed == "") | (trimmed.rlike(r"^\+?[\d\s-]{7,20}$") & digits.between(7, 15))


def log_bins(low: Column, high: Column, bins: int = 5) -> Column:
    """Inner edges of log-spaced classes between the smallest and largest positive value."""
    lo, span = F.log10(low), F.log10(high) - F.log10(low)
    step = F.when(span == 0, F.lit(1.0)).otherwise(span / bins)
    return F.array(*[F.pow(F.lit(10.0), lo + step * i) for i in range(1, bins)])


def bin_of(value: Column, edges: Column) -> Column:
    return F.size(F.filter(edges, lambda edge: value >= edge)).cast("long")
