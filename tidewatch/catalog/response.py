"""Response, needs, responder and task queries."""

from pyspark.sql import functions as F

from tidewatch.catalog import query
from tidewatch.catalog.risk import EXPOSED_SQL, LEVEL, STORM_INDEX_SQL, quake_regions, storm_regions
from tidewatch.functions import scales
from tidewatch.operators import live
from tidewatch.plans import response as op
from tidewatch.plans import risk

FLOOD_ROWS = f"""fr AS (SELECT p.district AS region, p.state, d.population, d.low_lying_pct, max(p.probability) AS probability,
    {LEVEL.format('max(p.probability)')} AS level FROM {{panel}} p JOIN {{districts}} d USING (district)
  GROUP BY p.district, p.state, d.population, d.low_lying_pct),
res AS (SELECT *, CAST(round_even(population * CASE level WHEN 'critical' THEN 0.05 WHEN 'high' THEN 0.02 WHEN 'medium' THEN 0.005 ELSE 0 END, 0)
  AS BIGINT) AS people, CASE level WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS tier FROM fr)"""


def flood_rows(t):
    top = t.panel.groupBy("district", "state").agg(F.max("probability").alias("probability"))
    info = t.districts.select("district", "population", "low_lying_pct")
    rows = top.join(info, "district").withColumnRenamed("district", "region")
    return rows.withColumns({"level": scales.risk_level(F.col("probability")), "summary": F.lit("wet")})


@query("response_resources", f"""WITH {FLOOD_ROWS} SELECT region, people, CAST(ceil(people * 0.02 / 50) AS BIGINT) AS medical_teams, people * 7 AS food_rations,
  people * 105 AS water_litres, CAST(round_even(people * 3.5, 0) AS BIGINT) AS shelter_m2,
  CAST(ceil(people * low_lying_pct / 100 / 200) AS BIGINT) AS rescue_boats, CAST(round_even(people * 0.04, 0) AS BIGINT) AS long_stay_places FROM res""")
def response_resources(t):
    return op.resources(flood_rows(t), "flood", 7, 0.04).select(
        "region", "people", "medical_teams", "food_rations", "water_litres", "shelter_m2", "rescue_boats", "long_stay_places")


@query("recommend", f"""WITH {FLOOD_ROWS} SELECT region, level, tier, row_number() OVER (ORDER BY tier, coalesce(people, 0) DESC, probability DESC, region) AS rank,
  CASE tier WHEN 1 THEN 'Priority 1: resource first' WHEN 2 THEN 'Priority 2: pre-position' WHEN 3 THEN 'Priority 3: standby' ELSE 'Monitor' END AS response_label
FROM res""")
def recommend(t):
    return op.recommend(flood_rows(t), "flood", 7, 0.04).select("region", "level", "tier", "rank", "response_label")


@query("reasoning", f"""WITH {FLOOD_ROWS} SELECT region, concat_ws(' + ', printf('%s flood risk (%d%%)', level, CAST(round(probability * 100) AS BIGINT)),
    CASE WHEN population IS NULL THEN 'population unavailable (no Census 2011 row)' ELSE printf('%.1f lakh people', round(population / 1e5, 1)) END,
    CASE WHEN low_lying_pct >= 10 THEN printf('%d%% low-lying land', CAST(round(low_lying_pct) AS BIGINT)) END)
  || CASE WHEN people IS NULL THEN ' → resource needs unavailable without a population' WHEN people = 0 THEN ' → monitor, no resources committed'
    ELSE printf(' → %,d people may need assistance', people) END AS reasoning FROM res""")
def reasoning(t):
    return op.recommend(flood_rows(t), "flood").select("region", "reasoning")


@query("resource_totals", f"""WITH {FLOOD_ROWS} SELECT CAST(coalesce(sum(people), 0) AS BIGINT) AS people, CAST(coalesce(sum(people * 7), 0) AS BIGINT) AS food_rations,
  count(*) - count(people) AS regions_without_population FROM res""")
def resource_totals(t):
    return op.resource_totals(op.recommend(flood_rows(t), "flood"), ["people", "food_rations"])


@query("tier_counts", f"""WITH {FLOOD_ROWS} SELECT l.label, count(r.tier) AS count FROM (VALUES (1, 'Priority 1: resource first'), (2, 'Priority 2: pre-position'),
  (3, 'Priority 3: standby'), (4, 'Monitor')) l(tier, label) LEFT JOIN res r ON r.tier = l.tier GROUP BY l.label""")
def tier_counts(t):
    return op.tier_counts(op.recommend(flood_rows(t), "flood"))


@query("preparedness", f"""WITH {FLOOD_ROWS}, o AS (SELECT *, 4 - tier AS l FROM res)
SELECT region, 'fl-drains' AS id FROM o WHERE l >= 1 UNION ALL SELECT region, 'fl-warning' FROM o WHERE l >= 1 UNION ALL SELECT region, 'fl-camps' FROM o WHERE l >= 1
UNION ALL SELECT region, 'fl-health' FROM o WHERE l >= 2 UNION ALL SELECT region, 'fl-boats' FROM o WHERE l >= 2 AND low_lying_pct >= 5
UNION ALL SELECT region, 'fl-routes' FROM o WHERE l >= 2 AND (low_lying_pct >= 5 OR level = 'critical')""")
def preparedness(t):
    return op.preparedness(flood_rows(t), "flood").select("region", "id")


@query("actions_by_category", f"""WITH {FLOOD_ROWS}, o AS (SELECT *, 4 - tier AS l FROM res),
a AS (SELECT region, 1 AS place, 'Structural' AS category, 'Clear and desilt drains; inspect embankments and sluices before the monsoon.' AS action FROM o WHERE l >= 1
  UNION ALL SELECT region, 2, 'Planning', 'Map and publish evacuation routes and relief-camp locations for low-lying areas.' FROM o
    WHERE l >= 2 AND (low_lying_pct >= 5 OR level = 'critical')
  UNION ALL SELECT region, 3, 'Early warning & communication', 'Act on IMD and CWC alerts; agree rainfall triggers for evacuating low-lying wards.' FROM o WHERE l >= 1
  UNION ALL SELECT region, 4, 'Pre-positioning', 'Pre-position rescue boats and trained crews.' FROM o WHERE l >= 2 AND low_lying_pct >= 5
  UNION ALL SELECT region, 5, 'Pre-positioning', 'Stock relief camps with drinking water, sanitation and food.' FROM o WHERE l >= 1
  UNION ALL SELECT region, 6, 'Health', 'Stock ORS, chlorine tablets and other waterborne-disease supplies.' FROM o WHERE l >= 2)
SELECT region, category, string_agg(action, ' | ' ORDER BY place) AS actions FROM a GROUP BY region, category""")
def actions_by_category(t):
    found = op.actions_by_category(op.preparedness(flood_rows(t), "flood"))
    return found.withColumn("actions", F.array_join("actions", " | "))


QUAKE_ROWS = EXPOSED_SQL + """, qr AS (SELECT m.region, b.population, m6, m7, 1 - exp(-m6 / 76) AS first_chance, x.l,
    CASE x.l WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level, round(x.p, 4) AS probability
  FROM m JOIN {region_boxes} b USING (region) JOIN (SELECT *, row_number() OVER (PARTITION BY region ORDER BY l DESC, p DESC, place) AS rn FROM lv) x
    ON x.region = m.region AND rn = 1),
qp AS (SELECT *, CAST(round_even(population * CASE level WHEN 'critical' THEN 0.02 WHEN 'high' THEN 0.005 WHEN 'medium' THEN 0.001 ELSE 0 END, 0) AS BIGINT) AS people,
  4 - l AS tier FROM qr)"""

STORM_ROWS = STORM_INDEX_SQL + """, cr AS (SELECT sx.*, b.population, ts, hu, 1 - exp(-hu / 46) AS first_chance,
    CASE level WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS l FROM sx JOIN sm USING (region) JOIN {region_boxes} b USING (region)),
cp AS (SELECT *, CAST(round_even(population * CASE level WHEN 'critical' THEN 0.03 WHEN 'high' THEN 0.01 WHEN 'medium' THEN 0.0025 ELSE 0 END, 0) AS BIGINT) AS people,
  4 - l AS tier FROM cr)"""


def indexed(t, kind):
    """Regions of an index with the columns that the rules name."""
    people = t.region_boxes.select("region", "population")
    if kind == "earthquake":
        rows = risk.hazard_index(quake_regions(t), kind, 76).withColumnsRenamed({"eq_events_m6": "events_m6", "eq_events_m7": "events_m7"})
        return rows.join(people, "region").withColumn("first_chance", scales.annual_probability(F.col("events_m6"), F.lit(76.0)))
    rows = risk.hazard_index(storm_regions(t), kind, 46).withColumnsRenamed({"cy_storms_ts": "storms_ts", "cy_storms_hurricane": "storms_hurricane"})
    return rows.join(people, "region").withColumn("first_chance", scales.annual_probability(F.col("storms_hurricane"), F.lit(46.0)))


RANKED = "row_number() OVER (ORDER BY tier, coalesce(people, 0) DESC, probability DESC, region) AS rank"


def told(kind):
    return f"""printf('%s {kind} risk (%d%%)', level, CAST(round(probability * 100) AS BIGINT)) || ' + ' || printf('%.1f lakh people', round(population / 1e5, 1))
  || CASE WHEN people = 0 THEN ' → monitor, no resources committed' ELSE ' → ' || format('{{:,}}', people) || ' people may need assistance' END AS reasoning"""


@query("recommend_earthquake", f"""{QUAKE_ROWS} SELECT region, level, people, CAST(ceil(people / 5000) AS BIGINT) AS rescue_teams, people * 30 AS food_rations,
  tier, {RANKED}, {told("earthquake")} FROM qp""")
def recommend_earthquake(t):
    return op.recommend(indexed(t, "earthquake"), "earthquake", 30).select(
        "region", "level", "people", "rescue_teams", "food_rations", "tier", "rank", "reasoning")


@query("recommend_cyclone", f"""{STORM_ROWS} SELECT region, level, people, CAST(ceil(people / 1000) AS BIGINT) AS cyclone_shelters, people * 15 AS water_litres,
  tier, {RANKED}, {told("cyclone")} FROM cp""")
def recommend_cyclone(t):
    return op.recommend(indexed(t, "cyclone"), "cyclone", 1).select(
        "region", "level", "people", "cyclone_shelters", "water_litres", "tier", "rank", "reasoning")


@query("preparedness_earthquake", QUAKE_ROWS + """, rule(id, least, why) AS (VALUES ('eq-audit', 2, 'm6'), ('eq-code', 1, 'chance'), ('eq-large', 1, 'm7'), ('eq-drills', 1, 'level'),
  ('eq-sar', 2, 'lakh'), ('eq-trauma', 2, 'level'), ('eq-warning', 1, 'level'))
SELECT region, id, CASE why WHEN 'm6' THEN m6 || ' M6+ earthquakes within 300 km since 1950.' WHEN 'm7' THEN m7 || ' M7+ earthquakes within 300 km since 1950.'
  WHEN 'chance' THEN 'Level ' || level || ': annual chance of an M6+ earthquake nearby is ' || printf('%.0f', first_chance * 100) || '%.'
  WHEN 'lakh' THEN 'Level ' || level || '; ' || format('{:,}', CAST(round(population / 1e5) AS BIGINT)) || ' lakh people.'
  ELSE 'Level ' || level || ' for earthquakes.' END AS why FROM qr, rule WHERE l >= least AND (id <> 'eq-large' OR m7 >= 1)""")
def preparedness_earthquake(t):
    return op.preparedness(indexed(t, "earthquake"), "earthquake").select("region", "id", "why")


@query("preparedness_cyclone", STORM_ROWS + """, rule(id, least, why) AS (VALUES ('cy-warning', 1, 'ts'), ('cy-fishing', 1, 'level'), ('cy-routes', 2, 'hu'),
  ('cy-shelters', 2, 'lakh'), ('cy-power', 2, 'level'), ('cy-stock', 3, 'chance'))
SELECT region, id, CASE why WHEN 'ts' THEN ts || ' tropical storms within 100 km since 1980.' WHEN 'hu' THEN hu || ' hurricane-strength storms within 100 km since 1980.'
  WHEN 'chance' THEN 'Annual chance of a hurricane-strength storm nearby is ' || printf('%.0f', first_chance * 100) || '%.'
  WHEN 'lakh' THEN 'Level ' || level || '; ' || format('{:,}', CAST(round(population / 1e5) AS BIGINT)) || ' lakh people in the state.'
  ELSE 'Level ' || level || ' for cyclones.' END AS why FROM cr, rule WHERE l >= least""")
def preparedness_cyclone(t):
    return op.preparedness(indexed(t, "cyclone"), "cyclone").select("region", "id", "why")


@query("needs_by_hazard", QUAKE_ROWS + """, wanted(hazard, k, category) AS (VALUES ('earthquake', 1, 'rescue'), ('earthquake', 2, 'medical'), ('earthquake', 3, 'shelter'),
  ('earthquake', 4, 'water'), ('earthquake', 5, 'transport'), ('earthquake', 6, 'communication'), ('cyclone', 1, 'transport'), ('cyclone', 2, 'food'),
  ('cyclone', 3, 'medical'), ('cyclone', 4, 'rescue'), ('cyclone', 5, 'power'), ('cyclone', 6, 'communication'))
SELECT region, hazard, 'n' || k AS need_id, category FROM qr, wanted WHERE l >= 2""")
def needs_by_hazard(t):
    raised = indexed(t, "earthquake").filter("level IN ('critical', 'high')").select("region")
    both = raised.withColumn("hazard", F.explode(F.array(F.lit("earthquake"), F.lit("cyclone"))))
    return op.area_needs(both).select("region", "hazard", "need_id", "category")


@query("plan_need_rows", """SELECT plan_id, plan_id || ':n' || k AS key, 'n' || k AS need_id, category FROM (
  SELECT plan_id, category, CAST(substr(need_id, 2) AS INT) AS k FROM {plan_needs}) q""")
def plan_need_rows(t):
    plans = t.plan_needs.groupBy("plan_id").agg(F.collect_list(F.struct("need_id", "category")).alias("needs"))
    return op.plan_needs(plans)


def areas(t):
    index = risk.hazard_index(quake_regions(t), "earthquake", 76).join(t.region_boxes.select("region", "population"), "region")
    return op.risk_areas(flood_rows(t).withColumnRenamed("region", "district"), {"earthquake": index})


@query("risk_areas", EXPOSED_SQL + f""", {FLOOD_ROWS} SELECT 'flood:' || state || ':' || region AS id, level, population FROM res WHERE level IN ('critical', 'high')
UNION ALL SELECT 'earthquake:' || region || ':' || region, CASE max(l) WHEN 3 THEN 'critical' ELSE 'high' END, any_value(b.population)
FROM lv JOIN {{region_boxes}} b USING (region) GROUP BY region HAVING max(l) >= 2""")
def risk_areas(t):
    return areas(t).select("id", "level", "population")


@query("areas_without_plan", f"""WITH {FLOOD_ROWS} SELECT 'flood:' || state || ':' || region AS id FROM res WHERE level IN ('critical', 'high')
AND CAST(substr(region, 2) AS INT) % 3 <> 0""")
def areas_without_plan(t):
    rows = flood_rows(t).filter("level IN ('critical', 'high')").withColumn("id", F.concat_ws(":", F.lit("flood"), "state", "region"))
    plans = rows.filter("CAST(substr(region, 2) AS INT) % 3 = 0").select(op.plan_id(F.col("id")).alias("plan_id"))
    return op.areas_with_plan(rows, plans, has=False).select("id")


@query("areas_and_plans", f"""WITH {FLOOD_ROWS}, a AS (SELECT 'flood:' || state || ':' || region AS plan_id, level FROM res WHERE level = 'critical'),
p AS (SELECT 'flood:' || state || ':' || region AS plan_id, 'saved' AS level FROM res WHERE CAST(substr(region, 2) AS INT) % 2 = 0)
SELECT coalesce(a.plan_id, p.plan_id) AS plan_id, p.plan_id IS NOT NULL AS has_plan, coalesce(a.level, p.level) AS level FROM a FULL JOIN p ON a.plan_id = p.plan_id""")
def areas_and_plans(t):
    rows = flood_rows(t).withColumn("id", F.concat_ws(":", F.lit("flood"), "state", "region"))
    plans = rows.filter("CAST(substr(region, 2) AS INT) % 2 = 0").select(F.col("id").alias("plan_id"), F.lit("saved").alias("level"))
    return op.areas_and_plans(rows.filter("level = 'critical'"), plans, ["level"])


@query("area_needs", f"""WITH {FLOOD_ROWS} SELECT region, 'n' || k AS need_id, (['rescue', 'medical', 'shelter', 'water', 'food', 'transport', 'communication'])[k] AS category
FROM res, (SELECT unnest(range(1, 8)) AS k) n WHERE level = 'critical'""")
def area_needs(t):
    rows = flood_rows(t).filter("level = 'critical'").withColumn("hazard", F.lit("flood"))
    return op.area_needs(rows).select("region", "need_id", "category")


@query("clean_needs", """SELECT c_custkey AS id, 'n' || row_number() OVER (PARTITION BY c_custkey ORDER BY k) AS need_id, 'Need ' || k AS need,
  CASE k WHEN 0 THEN 'rescue' WHEN 5 THEN 'food' ELSE 'transport' END AS category, CASE k WHEN 0 THEN 'Critical' WHEN 5 THEN 'Medium' ELSE 'High' END AS priority
FROM {customer}, (SELECT unnest([0, 3, 5, 6, 7]) AS k) n WHERE k < 1 + c_custkey % 11""")
def clean_needs(t):
    """JSON lists with blanks, plain texts and unknown words in them, up to eleven long."""
    items = F.transform(F.sequence(F.lit(0).cast("long"), F.col("c_custkey") % 11), lambda k: F.when(k == 1, F.lit('"just text"')).when(
        k == 2, F.lit('{"need": "  "}')).when(k == 4, F.lit("null")).when(k == 0, F.lit(
            '{"need": " Need 0 ", "category": "RESCUE", "priority": "critical"}')).when(
        k == 5, F.lit('{"need": "Need 5", "category": "food", "priority": "MEDIUM"}')).otherwise(
        F.concat(F.lit('{"need": "Need '), k.cast("string"), F.lit('", "category": "cooking", "priority": "soon"}'))))
    body = F.concat(F.lit('{"needs": ['), F.array_join(items, ", "), F.lit("]}"))
    lists = t.customer.select(F.col("c_custkey").alias("id"), body.alias("body"))
    return op.clean_needs(lists, "id", "body").select("id", "need_id", "need", "category", "priority")


MATCH_SQL = """act AS (SELECT assignee_id, count(*) AS active FROM {tasks} WHERE status <> 'delivered' GROUP BY assignee_id),
pair AS (SELECT n.key, r.id, r.name, coalesce(a.active, 0) AS active,
  CASE r.availability WHEN 'now' THEN 3 WHEN '2hrs' THEN 1 ELSE -10 END - coalesce(a.active, 0)
  + CASE WHEN trim(r.city) <> '' AND lower(trim(r.city)) = lower(trim(n.area)) THEN 3 WHEN lower(trim(r.state)) = lower(trim(n.state)) THEN 1 ELSE 0 END
  + CASE WHEN (n.category = 'transport' AND r.role = 'Transporter') OR (n.category = 'medical' AND r.role = 'Medical')
      OR (n.category = 'food' AND r.role IN ('NGO', 'Volunteer')) THEN 2 ELSE 0 END AS score
  FROM {plan_needs} n, {responders} r LEFT JOIN act a ON a.assignee_id = r.id)"""


@query("smart_matches", f"""WITH {MATCH_SQL} SELECT key, rank, id, score, active FROM (SELECT *, row_number() OVER (PARTITION BY key
  ORDER BY score DESC, active, name, id) AS rank FROM pair) q WHERE rank <= 3""")
def smart_matches(t):
    return op.smart_matches(t.responders, t.tasks, t.plan_needs).select("key", "rank", "id", "score", "active")


@query("active_tasks", "SELECT assignee_id, count(*) AS active FROM {tasks} WHERE status <> 'delivered' GROUP BY assignee_id")
def active_tasks(t):
    return op.active_counts(t.tasks)


@query("task_stats", """SELECT count(*) AS total, count(CASE WHEN status = 'delivered' THEN 1 END) AS completed,
  count(CASE WHEN status NOT IN ('delivered', 'assigned') THEN 1 END) AS in_progress, count(CASE WHEN status = 'assigned' THEN 1 END) AS pending FROM {tasks}""")
def task_stats(t):
    return op.task_stats(t.tasks)


PROGRESS = "CASE status WHEN 'assigned' THEN 10 WHEN 'accepted' THEN 25 WHEN 'collected' THEN 50 WHEN 'in_transit' THEN 75 WHEN 'delivered' THEN 100 ELSE 0 END"
READY_SQL = f"""b AS (SELECT plan_id, need_id, max({PROGRESS}) AS p FROM {{tasks}} GROUP BY ALL),
ready AS (SELECT n.plan_id, CAST(floor(avg(coalesce(b.p, 0)) + 0.5) AS BIGINT) AS readiness FROM {{plan_needs}} n LEFT JOIN b ON b.plan_id = n.plan_id AND b.need_id = n.need_id
  GROUP BY n.plan_id)"""


def readiness(t):
    return op.plan_readiness(t.plan_needs, t.tasks)


@query("plan_readiness", f"""WITH {READY_SQL} SELECT plan_id, readiness, CASE WHEN readiness >= 80 THEN 'low' WHEN readiness >= 50 THEN 'medium'
  WHEN readiness >= 20 THEN 'high' ELSE 'critical' END AS band FROM ready""")
def plan_readiness(t):
    return readiness(t).withColumn("band", scales.readiness_level(F.col("readiness")))


@query("overall_readiness", f"WITH {READY_SQL} SELECT CAST(floor(avg(readiness) + 0.5) AS BIGINT) AS readiness FROM ready")
def overall_readiness(t):
    return op.overall_readiness(readiness(t))


@query("task_state", """SELECT t.task_id, coalesce(max_by(u.status, (u.at_time, u.update_id)), any_value(t.status)) AS status,
  coalesce(max_by(u.note, (u.at_time, u.update_id)), '') AS last_note, count(CASE WHEN u.photo <> '' THEN 1 END) AS proof_count
FROM {tasks} t LEFT JOIN {updates} u USING (task_id) GROUP BY t.task_id""")
def task_state(t):
    return op.task_state(t.tasks, t.updates.withColumnRenamed("at_time", "at")).select("task_id", "status", "last_note", "proof_count")


@query("status_moves", """SELECT status, 'in_transit' AS next, status IN ('assigned', 'accepted', 'collected') AS allowed, count(*) AS n FROM {tasks} GROUP BY status""")
def status_moves(t):
    return t.tasks.groupBy("status").agg(F.count("*").alias("n")).withColumns({
        "next": F.lit("in_transit"), "allowed": scales.moves_forward(F.col("status"), F.lit("in_transit"))})


@query("person_tasks", "SELECT task_id, CASE WHEN status = 'delivered' THEN 'done' ELSE 'active' END AS list FROM {tasks} WHERE assignee_id = 'P7'")
def person_tasks(t):
    return op.person_tasks(t.tasks, "P7").select("task_id", "list")


@query("deadlines", """SELECT task_id, deadline < TIMESTAMP '1998-06-15 12:00:00' AS overdue,
  CAST(CAST(deadline AS DATE) - DATE '1998-06-15' AS BIGINT) AS days_left FROM {tasks}""")
def deadlines(t):
    return op.deadlines(t.tasks, F.lit("1998-06-15 12:00:00").cast("timestamp")).select("task_id", "overdue", "days_left")


@query("new_assignments", """SELECT task_id FROM {tasks} t LEFT JOIN (SELECT assignee_id, max(number) AS seen FROM {tasks} WHERE deadline < TIMESTAMP '1999-01-01' GROUP BY 1) s
  USING (assignee_id) WHERE t.number > coalesce(seen, -1)""")
def new_assignments(t):
    return op.new_assignments(t.tasks, t.tasks.filter("deadline < TIMESTAMP '1999-01-01'")).select("task_id")


@query("valid_phones", """SELECT phone, trim(phone) = '' OR (regexp_matches(trim(phone), '^\\+?[0-9 -]+$') AND length(regexp_replace(phone, '[^0-9]', '', 'g'))
  BETWEEN 7 AND 15) AS valid, count(*) AS n FROM {responders} GROUP BY phone""")
def valid_phones(t):
    return t.responders.groupBy("phone").agg(F.count("*").alias("n")).withColumn("valid", scales.valid_phone(F.col("phone")))


@query("people_search", "SELECT id FROM {responders} WHERE lower(name || ' ' || role || ' ' || city || ' ' || state) LIKE '%city 12%'")
def people_search(t):
    return live.search_rows(t.responders, " City 12", ["name", "role", "city", "state"]).select("id")
