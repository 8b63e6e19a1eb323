"""Matching of free-text place names to a gazetteer.

All stages work on the distinct (source, name, states) triples, so a name that fills a
third of a table is matched once. The gazetteer side of each join is an equi join on state
and name; the fuzzy stage only compares a name with the places of its own states.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import canon_state, compact, is_prose, split_districts, split_states, state_scope
from tidewatch.session import materialise

FUZZY_CUTOFF = 0.86
FUZZY_GAP = 0.05
KEY = ["source", "name", "states"]
TARGETS = "array<struct<state:string,name:string>>"


@F.pandas_udf(T.StructType([T.StructField("rank", T.DoubleType()), T.StructField("gap", T.DoubleType())]))
def likeness(key: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    """Similarity of two names, read in either order, as the two are not quite the same."""
    pairs = list(zip(key, candidate))
    return pd.DataFrame({
        "rank": [difflib.SequenceMatcher(None, c, k).ratio() for k, c in pairs],
        "gap": [difflib.SequenceMatcher(None, k, c).ratio() for k, c in pairs]})


def prepare(names: DataFrame) -> DataFrame:
    """Distinct names with their compact key and the states they may lie in."""
    return names.select(*KEY).distinct().withColumns({
        "_key": compact(F.col("name")), "_scope": state_scope(split_states(F.col("states"))),
        "_prose": (compact(F.col("name")) == "") | ((F.col("source") == "ifi") & is_prose(F.col("name")))})


def gazetteer_keys(gazetteer: DataFrame) -> DataFrame:
    return gazetteer.select("state", "name", canon_state(F.col("state")).alias("_in"), compact(F.col("name")).alias("_key"))


def _target(state: str = "state", name: str = "name"):
    return F.struct(F.col(state).alias("state"), F.col(name).alias("name"))


def exact_matches(prepared: DataFrame, places: DataFrame) -> DataFrame:
    """Names that a place in scope has letter for letter; the first state in order wins."""
    asked = prepared.filter(~F.col("_prose")).select(*KEY, "_key", F.explode("_scope").alias("_in"))
    found = asked.join(places.select(F.struct("_in", _target().alias("t")).alias("_hit"), "_in", "_key"), ["_in", "_key"])
    return found.groupBy(*KEY).agg(F.min("_hit")["t"].alias("_exact"))


def alias_targets(aliases: DataFrame, places: DataFrame) -> DataFrame:
    """Targets of each alias with the states they lie in, or the mark for "no polygon" or "not a place"."""
    marks = aliases.filter(F.col("geo_name").isin("-", "~"))
    real = aliases.filter(~F.col("geo_name").isin("-", "~")).select(
        "source", compact(F.col("name")).alias("_key"), canon_state(F.col("geo_state")).alias("_in"),
        compact(F.col("geo_name")).alias("_geo"))
    hits = real.join(places.select(F.col("_key").alias("_geo"), "_in", _target().alias("t")), ["_in", "_geo"])
    lists = hits.groupBy("source", "_key").agg(
        F.array_sort(F.collect_set("t")).alias("_targets"), F.collect_set("_in").alias("_states"))
    return lists.withColumn("_mark", F.lit(None).cast("string")).unionByName(marks.select(
        "source", compact(F.col("name")).alias("_key"), F.lit(None).cast(TARGETS).alias("_targets"),
        F.lit(None).cast("array<string>").alias("_states"), F.col("geo_name").alias("_mark")).distinct())


def unknown_alias_targets(aliases: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Aliases that point to no place; a build must stop on them."""
    real = aliases.filter(~F.col("geo_name").isin("-", "~")).withColumns({
        "_in": canon_state(F.col("geo_state")), "_key": compact(F.col("geo_name"))})
    return real.join(gazetteer_keys(gazetteer), ["_in", "_key"], "left_anti").drop("_in", "_key")


def letter_pairs(key: str) -> Column:
    """The pairs of neighbouring letters of a name; a pair that occurs again is told apart by its number."""
    pairs = f"transform(sequence(1, length({key}) - 1), i -> substring({key}, i, 2))"
    counted = "transform(p, (x, i) -> concat(x, ':', size(filter(slice(p, 1, i), y -> y = x))))"
    return F.expr(f"if(length({key}) < 2, cast(array() as array<string>), flatten(transform(array({pairs}), p -> {counted})))")


def shared_at_least(size: Column) -> Column:
    """How many letter pairs a name of ``size`` letters shares at least with any name as like it as the cut-off asks.

    With M of a + b letters matched in order, of the a - 1 pairs of one name each of its a - M unmatched
    letters breaks two at most, and each of the other's b - M one. M is at least cut-off * (a + b) / 2, and b
    at least a * cut-off / (2 - cut-off).
    """
    least = F.ceil(size * (FUZZY_CUTOFF / (2 - FUZZY_CUTOFF)) - 1e-9)
    return F.greatest(F.ceil((size + least) * (1.5 * FUZZY_CUTOFF - 1) - 1 - 1e-9), F.lit(1)).cast("int")


def telling_pairs(named: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """``(key, _pair)``: so many of a name's letter pairs, rarest first, that names as like as the cut-off asks share one.

    ``uses`` counts how many places have a pair; pairs that none has come first. Names
    with the same first pairs are all that need to be compared.
    """
    pairs = named.select(key).distinct().withColumn("_pair", F.explode(letter_pairs(key))).join(uses, "_pair", "left")
    ordered = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_uses", F.lit(0)).alias("n"), F.col("_pair").alias("p")))).alias("_all"))
    first = F.slice("_all", F.lit(1), F.greatest(F.size("_all") - shared_at_least(F.length(key)) + 1, F.lit(0)))
    return ordered.select(key, F.explode(F.transform(first, lambda x: x["p"])).alias("_pair"))


def fuzzy_candidates(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows of ``asked`` beside the places of their state that could be like enough.

    Names meet by a shared telling pair, and then must share as many letter pairs as their lengths ask.
    """
    uses = pool.select(F.col("_other")).distinct().select(F.explode(letter_pairs("_other")).alias("_pair")).groupBy("_pair").agg(
        F.count("*").alias("_uses"))
    mine = asked.join(telling_pairs(asked, uses, "_key"), "_key")
    theirs = pool.join(telling_pairs(pool, uses, "_other"), "_other")
    met = mine.join(theirs, ["_in", "_pair"])
    size, other = F.length("_key"), F.length("_other")
    near = met.filter(F.least(size, other) * 2 / (size + other) >= FUZZY_CUTOFF).drop("_pair").distinct()
    matched = F.ceil((size + other) * (FUZZY_CUTOFF / 2) - 1e-9)
    return near.filter(F.size(F.array_intersect(letter_pairs("_key"), letter_pairs("_other"))) >= 3 * matched - size - other - 1)


def fuzzy_matches(open_names: DataFrame, places: DataFrame) -> DataFrame:
    """The one place in scope that is similar enough, unless a second is nearly as similar."""
    pool = places.groupBy("_in", F.col("_key").alias("_other")).agg(F.min(_target()).alias("t"))
    asked = open_names.select(*KEY, "_key", F.explode("_scope").alias("_in"))
    close = fuzzy_candidates(asked, materialise(pool, "places"))
    once = close.groupBy(*KEY, "_key", "_other").agg(F.min("t").alias("t"))
    rated = once.withColumn("_like", likeness("_key", "_other")).filter(F.col("_like.rank") >= FUZZY_CUTOFF)
    order = W.partitionBy(*KEY).orderBy(F.desc("_like.rank"), F.desc("_other"))
    top = rated.withColumns({"_place": F.row_number().over(order), "_next": F.lead("_like.gap").over(order)})
    sure = F.col("_next").isNull() | (F.col("_like.gap") - F.col("_next") > FUZZY_GAP)
    return top.filter((F.col("_place") == 1) & sure).select(*KEY, F.col("t").alias("_fuzzy"))


def national_names(places: DataFrame) -> DataFrame:
    """Names that only one place in the whole gazetteer has."""
    return places.groupBy("_key").agg(F.count("*").alias("_n"), F.min(_target()).alias("_only")).filter("_n = 1").drop("_n")


def match_once(names: DataFrame, gazetteer: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct names with their targets and the first method that found them."""
    places = gazetteer_keys(gazetteer)
    base = (prepare(names).join(exact_matches(prepare(names), places), KEY, "left")
            .join(alias_targets(aliases, places), ["source", "_key"], "left"))
    in_scope = F.forall("_states", lambda s: F.array_contains(F.col("_scope"), s))
    scoped = F.when(in_scope, F.col("_targets"))
    still_open = (~F.col("_prose") & F.col("_exact").isNull() & F.col("_mark").isNull() & scoped.isNull())
    rows = (base.join(fuzzy_matches(base.filter(still_open), places), KEY, "left")
            .join(national_names(places), "_key", "left"))
    event = F.col("source") == "ifi"
    none = F.array().cast(TARGETS)
    steps = [
        (F.col("_prose"), none, "description"),
        (F.col("_exact").isNotNull(), F.array("_exact"), "exact"),
        (F.col("_mark") == "-", none, "no_polygon"),
        (F.col("_mark") == "~", none, "description"),
        (scoped.isNotNull(), F.col("_targets"), "alias"),
        (F.col("_fuzzy").isNotNull(), F.array("_fuzzy"), "fuzzy"),
        (event & F.col("_targets").isNotNull(), F.col("_targets"), "alias"),
        (event & F.col("_only").isNotNull(), F.array("_only"), "national"),
    ]
    targets, how = none, F.lit("none")
    for condition, value, method in reversed(steps):
        targets = F.when(condition, value).otherwise(targets)
        how = F.when(condition, F.lit(method)).otherwise(how)
    return rows.select(*KEY, targets.alias("targets"), how.alias("how"))


def match_names(names: DataFrame, gazetteer: DataFrame, aliases: DataFrame) -> DataFrame:
    """Like ``match_once``, and then event names that run two places together are cut in two.

    The first cut counts where both halves match, and neither by likeness only. The first
    round of distinct names is written out, as both the cuts and the result read it.
    """
    first = materialise(match_once(names, gazetteer, aliases), "names")
    words = F.filter(F.split(F.trim("name"), r"\s+"), lambda w: w != "")
    cuts = (first.filter((F.col("how") == "none") & (F.col("source") == "ifi")).withColumn("_w", words)
            .filter(F.size("_w") > 1).withColumn("_cut", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)))
            .select(*KEY, "_cut", F.array_join(F.slice("_w", F.lit(1), F.col("_cut")), " ").alias("_left"),
                    F.array_join(F.slice("_w", F.col("_cut") + 1, F.size("_w")), " ").alias("_right")))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_left").alias("half")),
                              F.struct(F.lit(1).alias("side"), F.col("_right").alias("half"))))
    halves = cuts.withColumn("_s", sides).select(*KEY, "_cut", "_s.side", "_s.half")
    asked = halves.select("source", F.col("half").alias("name"), "states")
    known = match_once(asked, gazetteer, aliases).filter((F.size("targets") > 0) & (F.col("how") != "fuzzy"))
    hit = halves.join(known.select("source", F.col("name").alias("half"), "states", F.col("targets").alias("_t")),
                      ["source", "half", "states"])
    both = hit.groupBy(*KEY, "_cut").agg(
        F.count("*").alias("_n"), F.max(F.when(F.col("side") == 0, F.col("_t"))).alias("_l"),
        F.max(F.when(F.col("side") == 1, F.col("_t"))).alias("_r")).filter("_n = 2")
    best = both.groupBy(*KEY).agg(F.min(F.struct("_cut", F.concat("_l", "_r").alias("t")))["t"].alias("_split"))
    return first.join(best, KEY, "left").select(
        *KEY, F.coalesce("_split", "targets").alias("targets"),
        F.when(F.col("_split").isNotNull(), "split").otherwise(F.col("how")).alias("how"))


def explode_listed(events: DataFrame, key: str, listed: str, states: str, source: str = "ifi") -> DataFrame:
    """One line per event and listed name."""
    return events.select(key, F.lit(source).alias("source"), F.coalesce(F.col(states), F.lit("")).alias("states"),
                         F.explode(split_districts(F.col(listed))).alias("name"))


def listing_counts(events: DataFrame, listed: str, start: str) -> DataFrame:
    """How many events there are, how many name no place and how many have no start date, as one row."""
    return events.agg(F.count("*").alias("events"),
                      F.count_if(F.size(F.coalesce(split_districts(F.col(listed)), F.array().cast("array<string>"))) == 0).alias("unlisted"),
                      F.count_if(F.col(start).isNull()).alias("undated"))


def match_events(listed: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """One line per event and matched place, a place counted once per event."""
    return listed.join(matches, KEY).select(key, F.explode("targets").alias("t")).select(
        key, F.col("t.state").alias("state"), F.col("t.name").alias("place")).distinct()


def method_counts(listed: DataFrame, matches: DataFrame) -> DataFrame:
    return listed.join(matches, KEY).groupBy("how").agg(F.count("*").alias("names"))


def reject_report(listed: DataFrame, matches: DataFrame) -> DataFrame:
    """Names without a place, by kind, with how often they were listed."""
    kind = (F.when(F.col("how") == "description", "not_a_district").when(F.col("how") == "no_polygon", "no_polygon")
            .otherwise("unmatched"))
    state = F.coalesce(F.get(split_states(F.col("states")), 0), F.lit(""))
    missed = listed.join(matches.filter(F.size("targets") == 0), KEY)
    return missed.groupBy("source", state.alias("state"), "name", kind.alias("kind")).agg(F.count("*").alias("events"))


def one_to_one(matched: DataFrame, target: list[str], source: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose target no other row claims, and the rows that clash; neither side of a clash is used."""
    claims = matched.groupBy(*target).agg(F.count("*").alias("_claims"))
    counted = matched.join(claims, target)
    return (counted.filter("_claims = 1").drop("_claims"),
            counted.filter("_claims > 1").select(*target, source))


def state_events(events: DataFrame, key: str, states: str, known: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Events by state: the comma list exploded, old names replaced, unknown states dropped, no repeats."""
    rows = events.withColumn("region", F.explode(F.split(states, ",")))
    rows = rows.withColumn("region", F.trim("region")).replace(aliases, subset=["region"])
    return rows.join(known.select("region"), "region", "left_semi").dropDuplicates([key, "region"])
