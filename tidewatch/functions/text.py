"""Place names, storm names and free-text fields as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a state (normalised) and the name it has today.
STATE_SPELLINGS = {
    "orissa": "odisha",
    "pondicherry": "puducherry",
    "nct of delhi": "delhi",
    "new delhi": "delhi",
    "jammu and kashmir": "jammu and kashmir",
    "uttaranchal": "uttarakhand",
    "chattisgarh": "chhattisgarh",
    "arunanchal pradesh": "arunachal pradesh",
    "andaman and nicobar": "andaman and nicobar islands",
    "andaman nicobar": "andaman and nicobar islands",
    "dadra and nagar haveli": "dadra and nagar haveli and daman and diu",
    "dadar and nagar haveli": "dadra and nagar haveli and daman and diu",
    "daman and diu": "dadra and nagar haveli and daman and diu",
    "goa daman and diu": "goa",
    "telengana": "telangana",
}

# States that share a moved border.
STATE_GROUPS = [
    ["andhra pradesh", "telangana"],
    ["jammu and kashmir", "ladakh"],
    ["uttar pradesh", "uttarakhand"],
    ["bihar", "jharkhand"],
    ["madhya pradesh", "chhattisgarh"],
    ["goa", "dadra and nagar haveli and daman and diu"],
]

# Words that mark prose and not a place name.
PROSE = (r"^\d|\b(parts?|many|most|some|few|several|various|entire|areas?|regions?|districts of|neighbou?rhood|"
         r"adjoining|northern|southern|central part|bengal|marathwada|heavy|hilly|village|suburbans|ghat|"
         r"cauvery|of the state)\b")

# Generic words in storm names.
STORM_WORDS = ["tropical", "storm", "cyclone", "hurricane", "typhoon", "depression",
               "super", "severe", "post", "extratropical", "subtropical"]


def _accent_table() -> tuple[str, str]:
    """Latin letters that decompose into one plain letter and marks, with that letter."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code) and base[0].isascii():
            marked.append(chr(code))
            plain.append(base[0])
    return "".join(marked), "".join(plain)


def strip_accents(text: Column) -> Column:
    marked, plain = _accent_table()
    return F.regexp_replace(F.translate(text, marked, plain), "[̀-ͯ]", "")


def norm(text: Column) -> Column:
    """Lower case without accents, brackets and repeated neighbouring words; "&" reads as "and"."""
    out = F.replace(F.lower(strip_accents(text)), F.lit("&"), F.lit(" and "))
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\(.*?\)", " "), "[^a-z0-9]+", " "))
    return F.regexp_replace(out, r"\b(\w+)(?: \1\b)+", "$1")


def compact(text: Column) -> Column:
    return F.replace(norm(text), F.lit(" "), F.lit(""))


def canon_state(text: Column) -> Column:
    """Today's normalised name of a state."""
    table = F.create_map(*[F.lit(x) for pair in STATE_SPELLINGS.items() for x in pair])
    key = norm(text)
    return F.coalesce(table[key], key)


def state_scope(states: Column) -> Column:
    """The listed states and those they share a moved border with, sorted."""
    group_of = F.create_map(*[x for group in STATE_GROUPS for state in group
                              for x in (F.lit(state), F.array(*[F.lit(s) for s in group]))])
    names = F.transform(F.filter(states, lambda s: s != ""), canon_state)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(
        names, lambda s: F.coalesce(group_of[s], F.array(s))))))


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), lambda p: F.trim(p)), lambda p: p != "")


def split_states(text: Column) -> Column:
    return _parts(text, "[,;]")


def split_districts(text: Column) -> Column:
    return _parts(text, r"[,;/]|\band\b|&")


def is_prose(text: Column) -> Column:
    return norm(text).rlike(PROSE)


def storm_key(text: Column) -> Column:
    """The word that tells a storm apart: "Hurricane Polo" and "POLO-26" are both "polo"."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    own = F.filter(words, lambda w: ~w.isin(STORM_WORDS) & ~w.rlike(r"^\d{2}$"))
    return F.try_element_at(own, F.lit(1))


def clean_text(text: Column) -> Column:
    """Single spaces, no spaces or commas at the ends, and null for nothing."""
    return F.nullif(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^[ ,]+|[ ,]+$", ""), F.lit(""))


def finite(text: Column) -> Column:
    """The number in a text, or null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def parse_time(text: Column) -> Column:
    """A time from epoch milliseconds or ISO text; text without a zone is UTC."""
    millis = text.try_cast("long")
    return F.coalesce(F.timestamp_millis(millis), F.try_to_timestamp(F.trim(text)))


def shorten_list(text: Column) -> Column:
    """ "A, B +n more" when a list has more than three entries."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    short = F.concat(F.array_join(F.slice(parts, 1, 2), ", "), F.lit(" +"), (F.size(parts) - 2).cast("string"),
                     F.lit(" more"))
    return F.when(F.size(parts) <= 3, text).otherwise(short)


def date_readings(text: Column) -> Column:
    """Both readings of "dd-mm-yyyy", day first and month first; those that exist, sorted."""
    shape = r"^\s*(\d{1,2})-(\d{1,2})-(\d{4})"
    a, b, y = (F.regexp_extract(text, shape, i) for i in (1, 2, 3))
    both = F.array(F.try_to_date(F.concat_ws("-", y, b, a), "y-M-d"), F.try_to_date(F.concat_ws("-", y, a, b), "y-M-d"))
    return F.array_sort(F.array_distinct(F.array_compact(both)))


def start_choices(text: Column) -> Column:
    """Readings of a start date in order of preference: day first, then month first."""
    shape = r"^\s*(\d{1,2})-(\d{1,2})-(\d{4})"
    a, b, y = (F.regexp_extract(text, shape, i) for i in (1, 2, 3))
    day_first = F.try_to_date(F.concat_ws("-", y, b, a), "y-M-d")
    month_first = F.try_to_date(F.concat_ws("-", y, a, b), "y-M-d")
    return F.array_compact(F.array(
        F.when(day_first.isNotNull(), F.struct(day_first.alias("day"), F.lit(0).alias("cost"))),
        F.when(month_first.isNotNull() & ~day_first.eqNullSafe(month_first),
               F.struct(month_first.alias("day"), F.lit(1).alias("cost")))))


def storm_month(sid: Column) -> Column:
    """Month of genesis from a storm id that starts with year and day of year; null for a bad id."""
    first = F.try_to_date(F.substring(sid, 1, 4), "yyyy")
    offset = F.substring(sid, 5, 3).try_cast("int")
    return F.month(F.date_add(first, offset - 1)).cast("long")
