"""The letter-pair index of fuzzy names against comparing every pair."""

import difflib
import random

from pyspark.sql import functions as F

from tidewatch.operators import names


def words(n, seed):
    draw = random.Random(seed)
    parts = ["ban", "pur", "nagar", "garh", "west", "east", "sing", "bhum", "dev", "kol", "ram", "gan", "aa", "i", "u", "the"]
    return sorted({"".join(draw.choice(parts) for _ in range(draw.randint(1, 5))) for _ in range(n)})


def bent(word, draw):
    letters = list(word)
    for _ in range(draw.choice([1, 1, 2, 3])):
        at = draw.randrange(len(letters))
        letters[at:at + draw.randint(0, 1)] = draw.choice(["", "a", "x", "h"])
        letters = letters or ["a"]
    return "".join(letters)


def test_candidates_hold_every_pair_above_the_cut_off(spark):
    draw = random.Random(5)
    places = words(500, 4)
    asked = sorted({bent(draw.choice(places), draw) for _ in range(250)} | {"a", "ab", "aaaaaaaa", "zzz"})
    pool = spark.createDataFrame([("s", p, ("s", p)) for p in places], "_in string, _other string, t struct<state:string,name:string>")
    rows = spark.createDataFrame([("s", k) for k in asked], "_in string, _key string")
    got = {(r["_key"], r["_other"]) for r in names.fuzzy_candidates(rows, pool).select("_key", "_other").collect()}
    like = {(k, p) for k in asked for p in places if difflib.SequenceMatcher(None, p, k).ratio() >= names.FUZZY_CUTOFF}
    sized = sum(min(len(k), len(p)) * 2 / (len(k) + len(p)) >= names.FUZZY_CUTOFF for k in asked for p in places)
    assert like <= got and len(like) > 150
    assert len(got) * 10 <= sized  # a tenth of what lengths alone leave, at most


def test_pairs_are_numbered(spark):
    row = spark.createDataFrame([("banana",), ("x",), ("",)], "k string").select("k", names.letter_pairs("k").alias("p")).collect()
    assert {r["k"]: r["p"] for r in row} == {"banana": ["ba:0", "an:0", "na:0", "an:1", "na:1"], "x": [], "": []}


def test_the_bound_on_shared_pairs_holds(spark):
    rows = spark.range(1, 60).select("id", names.shared_at_least(F.col("id")).alias("t")).collect()
    bound = {r["id"]: r["t"] for r in rows}
    for a in range(2, 60):
        for b in range(2, 60):
            if 2 * min(a, b) / (a + b) >= names.FUZZY_CUTOFF:
                m = next(m for m in range(min(a, b) + 1) if 2 * m / (a + b) >= names.FUZZY_CUTOFF)
                shared = (a - 1) - 2 * (a - m) - (b - m)
                assert shared >= min(bound[a], bound[b]) or shared <= 0
                assert max(shared, 1) >= bound[a] or m == a == b
