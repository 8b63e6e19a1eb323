"""Name-matching and date-repair queries."""

from pyspark.sql import functions as F

from tidewatch.catalog import query
from tidewatch.functions import text as fn
from tidewatch.operators import dates, names as op

NORM = """list_aggregate(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower(strip_accents({0})),
  '&', ' and '), '\\(.*?\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w, i: i = 1 OR w <> string_split(trim(
  regexp_replace(regexp_replace(replace(lower(strip_accents({0})), '&', ' and '), '\\(.*?\\)', ' ', 'g'),
  '[^a-z0-9]+', ' ', 'g')), ' ')[i - 1]), 'string_agg', ' ')"""
PROSE_SQL = fn.PROSE.replace("'", "''")


def norm_sql(column):
    return NORM.format(column).replace("{", "").replace("}", "")


def joined(df, column="targets"):
    """A target list as one sorted text."""
    pairs = F.array_sort(F.transform(column, lambda x: F.concat_ws("/", x["state"], x["name"])))
    return df.withColumn(column, F.array_join(pairs, ";"))


@query("normalised_names", f"""SELECT name, {norm_sql('name')} AS norm, replace({norm_sql('name')}, ' ', '') AS compact, count(*) AS n
FROM {{listed_names}} GROUP BY name""")
def normalised_names(t):
    return t.listed_names.groupBy("name").agg(F.count("*").alias("n")).withColumns(
        {"norm": fn.norm(F.col("name")), "compact": fn.compact(F.col("name"))})


@query("prose_names", f"""SELECT DISTINCT name FROM {{listed_names}} WHERE regexp_matches({norm_sql('name')}, '{PROSE_SQL}')""")
def prose_names(t):
    return t.listed_names.select("name").distinct().filter(fn.is_prose(F.col("name")))


SCOPE_SQL = """sc AS (SELECT DISTINCT source, name, states, unnest(CASE
    WHEN states IN ('Andhra Pradesh', 'Telangana') THEN ['andhra pradesh', 'telangana']
    WHEN states = 'Goa' THEN ['goa', 'dadra and nagar haveli and daman and diu']
    WHEN states = 'Andhra Pradesh; Assam' OR states = 'Telangana; Assam' THEN ['andhra pradesh', 'telangana', 'assam']
    WHEN states = 'Goa; Assam' THEN ['goa', 'dadra and nagar haveli and daman and diu', 'assam']
    WHEN states = 'Orissa' THEN ['odisha']
    WHEN states LIKE '%; Assam' THEN [lower(replace(states, '; Assam', '')), 'assam'] ELSE [lower(states)] END) AS st
  FROM {listed_names})"""


@query("state_scopes", f"WITH {SCOPE_SQL} SELECT states, string_agg(DISTINCT st, ',' ORDER BY st) AS scope FROM sc GROUP BY states")
def state_scopes(t):
    scope = fn.state_scope(fn.split_states(F.col("states")))
    return t.listed_names.select("states").distinct().withColumn("scope", F.array_join(scope, ","))


@query("exact_name_matches", f"""WITH {SCOPE_SQL}, k AS (SELECT *, replace({norm_sql('name')}, ' ', '') AS key FROM sc
    WHERE NOT regexp_matches({norm_sql('name')}, '{PROSE_SQL}')),
h AS (SELECT k.source, k.name, k.states, g.state || '/' || g.name AS target, row_number() OVER (
    PARTITION BY k.source, k.name, k.states ORDER BY k.st, g.state, g.name) AS rn
  FROM k JOIN {{gazetteer}} g ON lower(g.state) = k.st AND replace(lower(g.name), ' ', '') = k.key)
SELECT source, name, states, target FROM h WHERE rn = 1""")
def exact_name_matches(t):
    found = op.exact_matches(op.prepare(t.listed_names), op.gazetteer_keys(t.gazetteer))
    return found.select(*op.KEY, F.concat_ws("/", "_exact.state", "_exact.name").alias("target"))


@query("alias_targets", """SELECT replace(lower(a.name), ' ', '') AS key, string_agg(DISTINCT g.state || '/' || g.name, ';'
   ORDER BY g.state || '/' || g.name) AS targets FROM {aliases} a JOIN {gazetteer} g ON g.state = a.geo_state AND g.name = a.geo_name
GROUP BY 1""")
def alias_targets(t):
    out = op.alias_targets(t.aliases, op.gazetteer_keys(t.gazetteer)).filter("_mark IS NULL")
    return joined(out.select(F.col("_key").alias("key"), F.col("_targets").alias("targets")))


@query("national_names", """SELECT replace(lower(name), ' ', '') AS key, min(state) AS state FROM {gazetteer}
GROUP BY 1 HAVING count(*) = 1""")
def national_names(t):
    return op.national_names(op.gazetteer_keys(t.gazetteer)).select(F.col("_key").alias("key"),
                                                                     F.col("_only.state").alias("state"))


@query("unknown_alias_targets", """SELECT a.name FROM {aliases} a WHERE geo_name NOT IN ('-', '~')
AND NOT EXISTS (SELECT 1 FROM {gazetteer} g WHERE g.state = a.geo_state AND g.name = a.geo_name AND g.state <> 'Kerala')""")
def unknown_alias_targets(t):
    return op.unknown_alias_targets(t.aliases, t.gazetteer.filter("state <> 'Kerala'")).select("name")


def matches(t):
    return op.match_names(t.listed_names, t.gazetteer, t.aliases)


@query("match_names")
def match_names(t):
    return joined(matches(t))


@query("match_methods")
def match_methods(t):
    return op.method_counts(t.listed_names, matches(t))


@query("match_events")
def match_events(t):
    return op.match_events(t.listed_names, matches(t), "event")


@query("reject_report")
def reject_report(t):
    return op.reject_report(t.listed_names, matches(t))


@query("one_to_one", """SELECT p_brand, p_type, p_partkey FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS n
  FROM {part}) q WHERE n = 1""")
def one_to_one(t):
    good, _ = op.one_to_one(t.part, ["p_brand", "p_type", "p_size"], "p_partkey")
    return good.select("p_brand", "p_type", "p_partkey")


@query("state_events", """SELECT DISTINCT uei, region FROM (SELECT uei, CASE r WHEN 'State 2' THEN 'State 1' ELSE r END AS region
  FROM (SELECT uei, unnest([state, 'State ' || (seq % 9)]) AS r FROM {inventory}) a) b
WHERE region IN ('State 0', 'State 1', 'State 3', 'State 4')""")
def state_events(t):
    listed = t.inventory.withColumn("states", F.concat(F.col("state"), F.lit(" , State "), (F.col("seq") % 9).cast("string")))
    known = t.districts.select(F.col("state").alias("region")).distinct().filter("region NOT IN ('State 2', 'State 5')")
    return op.state_events(listed, "uei", "states", known, {"State 2": "State 1"}).select("uei", "region")


@query("split_lists", """SELECT DISTINCT unnest(list_filter(list_transform(string_split_regex(c.name, '[,;/]|\\band\\b|&'),
  lambda p: trim(p)), lambda p: p <> '')) AS part FROM (SELECT name || '; Hill and Dale/' || states AS name FROM {listed_names}) c""")
def split_lists(t):
    text = F.concat("name", F.lit("; Hill and Dale/"), "states")
    return t.listed_names.select(F.explode(fn.split_districts(text)).alias("part")).distinct()


# ── dates ───────────────────────────────────────────────────────────────────


READ_SQL = """rd AS (SELECT *, try_strptime(regexp_extract(start_text, '^\\s*(\\d\\d?-\\d\\d?-\\d\\d\\d\\d)', 1), '%d-%m-%Y')::DATE AS df,
  try_strptime(regexp_extract(start_text, '^\\s*(\\d\\d?-\\d\\d?-\\d\\d\\d\\d)', 1), '%m-%d-%Y')::DATE AS mf FROM {inventory})"""



@query("date_readings", f"""WITH {READ_SQL} SELECT uei, CASE WHEN df IS NULL AND mf IS NULL THEN '' WHEN mf IS NULL OR df = mf THEN df::VARCHAR
  WHEN df IS NULL THEN mf::VARCHAR ELSE least(df, mf)::VARCHAR || ',' || greatest(df, mf)::VARCHAR END AS readings FROM rd""")
def date_readings(t):
    listed = F.transform(fn.date_readings(F.col("start_text")), lambda d: d.cast("string"))
    return t.inventory.select("uei", F.array_join(listed, ",").alias("readings"))


@query("event_runs", """SELECT uei, CAST(sum(new) OVER (PARTITION BY regexp_extract(uei, '^(.*)-\\d+-\\d+$', 1), yr ORDER BY seq) AS BIGINT) AS run
FROM (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS new FROM {inventory}
  WINDOW w AS (PARTITION BY regexp_extract(uei, '^(.*)-\\d+-\\d+$', 1), yr ORDER BY seq)) q""")
def event_runs(t):
    return dates.mark_runs(dates.number_events(t.inventory)).select("uei", "run")


@query("resolve_dates", f"""WITH RECURSIVE {READ_SQL},
ev AS (SELECT *, regexp_extract(uei, '^(.*)-\\d+-\\d+$', 1) AS book FROM rd),
nw AS (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY book, yr ORDER BY seq)),
rn AS (SELECT *, sum(new) OVER (PARTITION BY book, yr ORDER BY seq) AS run,
  list_filter([{{'day': df, 'cost': 0}}, {{'day': CASE WHEN mf IS DISTINCT FROM df THEN mf END, 'cost': 1}}], lambda c: c.day IS NOT NULL) AS choices FROM nw),
dated AS (SELECT *, row_number() OVER (PARTITION BY book, yr, run ORDER BY seq, uei) AS pos FROM rn WHERE len(choices) > 0),
walk AS (SELECT book, yr, run, CAST(0 AS BIGINT) AS pos, [{{'day': make_date(yr, 1, 1), 'total': 0, 'path': CAST([] AS STRUCT(uei VARCHAR, day DATE)[])}}] AS ahead
    FROM dated WHERE pos = 1
  UNION ALL SELECT book, yr, run, pos, [{{'day': o.day, 'total': o.best.cost, 'path': list_append(ahead[o.best.i].path, {{'uei': uei, 'day': o.day}})}} FOR o IN steps]
  FROM (SELECT w.book, w.yr, w.run, d.pos, d.uei, w.ahead, [{{'day': c.day, 'best': list_sort([{{'cost': w.ahead[i].total
      + CASE WHEN c.day < w.ahead[i].day THEN 10 ELSE 0 END + c.cost, 'i': i}} FOR i IN range(1, len(w.ahead) + 1)])[1]}} FOR c IN d.choices] AS steps
    FROM walk w JOIN dated d ON d.book = w.book AND d.yr = w.yr AND d.run = w.run AND d.pos = w.pos + 1) q),
ends AS (SELECT *, row_number() OVER (PARTITION BY book, yr, run ORDER BY pos DESC) AS back FROM walk),
picked AS (SELECT unnest(ahead[list_sort([{{'t': ahead[i].total, 'i': i}} FOR i IN range(1, len(ahead) + 1)])[1].i].path) AS p FROM ends WHERE back = 1),
late AS (SELECT ev.uei, p.p.day AS day, duration, list_sort(list_distinct(list_filter([
    try_strptime(regexp_extract(end_text, '^\\s*(\\d\\d?-\\d\\d?-\\d\\d\\d\\d)', 1), '%d-%m-%Y')::DATE,
    try_strptime(regexp_extract(end_text, '^\\s*(\\d\\d?-\\d\\d?-\\d\\d\\d\\d)', 1), '%m-%d-%Y')::DATE], lambda d: d >= p.p.day))) AS found
  FROM ev LEFT JOIN picked p ON p.p.uei = ev.uei),
opt AS (SELECT *, CASE WHEN len(found) = 0 THEN [day] ELSE found END AS options FROM late)
SELECT uei, CAST(day AS VARCHAR) AS start, CASE WHEN day IS NOT NULL THEN CAST(CASE WHEN coalesce(duration, 0) <> 0
  THEN list_sort([{{'gap': abs((d - day) + 1 - duration), 'd': d}} FOR d IN options])[1].d ELSE options[1] END AS VARCHAR) END AS "end" FROM opt""")
def resolve_dates(t):
    out = dates.resolve_dates(t.inventory).select("uei", "start", "end")
    return out.withColumns({"start": F.col("start").cast("string"), "end": F.col("end").cast("string")})


@query("undated_events", f"""WITH {READ_SQL} SELECT uei, state, deaths FROM rd WHERE df IS NOT NULL OR mf IS NOT NULL""")
def undated_events(t):
    return dates.event_dates(t.inventory).select("uei", "state", "deaths")


@query("storm_months", """SELECT sid, CAST(month(make_date(CAST(substr(sid, 1, 4) AS INT), 1, 1)
  + CAST(CAST(substr(sid, 5, 3) AS INT) - 1 AS INT)) AS BIGINT) AS month FROM {storms}""")
def storm_months(t):
    return t.storms.select("sid", fn.storm_month(F.col("sid")).alias("month"))


@query("shortened_lists", """SELECT c_mktsegment, CASE WHEN count(*) <= 3 THEN string_agg(n, ', ' ORDER BY n)
  ELSE min(n) || ', ' || (list(n ORDER BY n))[2] || ' +' || (count(*) - 2) || ' more' END AS short
FROM (SELECT DISTINCT c_mktsegment, n_name AS n FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey) q GROUP BY 1""")
def shortened_lists(t):
    both = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    lists = both.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ", ").alias("l"))
    return lists.select("c_mktsegment", fn.shorten_list(F.col("l")).alias("short"))


LISTED_SQL = """SELECT c_custkey AS event, CASE WHEN c_custkey % 5 <> 0 THEN 'Town ' || (c_custkey % 7) || ', Village ' || (c_custkey % 3) END AS listed,
  CASE WHEN c_custkey % 4 <> 0 THEN 'State ' || (c_custkey % 6) END AS states, CASE WHEN c_custkey % 9 <> 0 THEN DATE '2001-01-01' END AS start FROM {customer}"""


def listed_events(t):
    key = F.col("c_custkey")
    number = lambda n: (key % n).cast("string")
    return t.customer.select(
        key.alias("event"), F.when(key % 5 != 0, F.concat(F.lit("Town "), number(7), F.lit(", Village "), number(3))).alias("listed"),
        F.when(key % 4 != 0, F.concat(F.lit("State "), number(6))).alias("states"), F.when(key % 9 != 0, F.lit("2001-01-01").cast("date")).alias("start"))


@query("explode_listed", f"""SELECT event, 'ifi' AS source, coalesce(states, '') AS states, unnest(string_split(listed, ', ')) AS name FROM ({LISTED_SQL}) e
WHERE listed IS NOT NULL""")
def explode_listed(t):
    return op.explode_listed(listed_events(t), "event", "listed", "states")


@query("listing_counts", f"""SELECT count(*) AS events, count(*) - count(listed) AS unlisted, count(*) - count(start) AS undated FROM ({LISTED_SQL}) e""")
def listing_counts(t):
    return op.listing_counts(listed_events(t), "listed", "start")
