"""Preparedness actions, response estimates, needs, responders, tasks and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.scales import cases, half_up, level_order, status_group, status_progress
from tidewatch.operators.ranking import positions

# Response tiers and planning figures.
TIER = {"critical": 1, "high": 2, "medium": 3, "low": 4}
RESPONSE_LABEL = {1: "Priority 1: resource first", 2: "Priority 2: pre-position", 3: "Priority 3: standby", 4: "Monitor"}
PREPAREDNESS_LABEL = {1: "Priority 1: act this year", 2: "Priority 2: plan and pre-position",
                      3: "Priority 3: build readiness", 4: "Routine monitoring"}
EXPOSURE = {
    "flood": {"critical": 0.05, "high": 0.02, "medium": 0.005, "low": 0.0},
    "earthquake": {"critical": 0.02, "high": 0.005, "medium": 0.001, "low": 0.0},
    "cyclone": {"critical": 0.03, "high": 0.01, "medium": 0.0025, "low": 0.0},
}
PEOPLE_PER_BOAT = 200
PEOPLE_PER_TEAM = 5000
SHELTER_CAPACITY = 1000
CONSULT_RATE = 0.02
PATIENTS_PER_DAY = 50
WATER_L_PER_DAY = 15
SHELTER_M2 = 3.5
MAX_DAYS = 30

# Categories, priorities, and the roles that fit a category.
CATEGORIES = ["transport", "medical", "rescue", "shelter", "food", "water", "communication", "power"]
PRIORITIES = ["Critical", "High", "Medium"]
CATEGORY_ROLES = {
    "transport": ["Transporter"], "medical": ["Medical"], "rescue": ["Rescue"], "shelter": ["NGO", "Volunteer"],
    "food": ["NGO", "Volunteer"], "water": ["NGO", "Volunteer"], "communication": ["Coordinator", "Volunteer"],
    "power": ["Transporter", "Volunteer"],
}

# Preparedness rules as (hazard, id, category, action, minimum level, trigger, reason).
RULES = [
    ("earthquake", "eq-audit", "Structural", "Audit and retrofit schools, hospitals and lifeline buildings.", "high", "true",
     "format_string('%d M6+ earthquakes within 300 km since 1950.', events_m6)"),
    ("earthquake", "eq-code", "Structural", "Enforce seismic design (IS 1893) and inspection for new construction.", "medium",
     "true", "format_string('Level %s: annual chance of an M6+ earthquake nearby is %.0f%%.', level, first_chance * 100)"),
    ("earthquake", "eq-large", "Planning",
     "Plan for a large earthquake (M7+): assembly points, routes and hospital surge.", "medium", "events_m7 >= 1",
     "format_string('%d M7+ earthquakes within 300 km since 1950.', events_m7)"),
    ("earthquake", "eq-drills", "Planning", "Run earthquake drills (drop, cover, hold) in schools and offices.", "medium",
     "true", "format_string('Level %s for earthquakes.', level)"),
    ("earthquake", "eq-sar", "Pre-positioning",
     "Pre-position urban search-and-rescue teams and heavy lifting equipment.", "high", "true",
     "format_string('Level %s; %,.0f lakh people.', level, population / 1e5)"),
    ("earthquake", "eq-trauma", "Health",
     "Prepare trauma-care and blood-bank surge plans; confirm key hospitals are structurally sound.", "high", "true",
     "format_string('Level %s for earthquakes.', level)"),
    ("earthquake", "eq-warning", "Early warning & communication",
     "Publicise safe assembly points and aftershock advice; test backup communications.", "medium", "true",
     "format_string('Level %s for earthquakes.', level)"),
    ("flood", "fl-drains", "Structural",
     "Clear and desilt drains; inspect embankments and sluices before the monsoon.", "medium", "true",
     "concat('Level ', level, ': ', coalesce(nullif(summary, ''), 'flood risk this window'))"),
    ("flood", "fl-routes", "Planning",
     "Map and publish evacuation routes and relief-camp locations for low-lying areas.", "high",
     "low_lying_pct >= 5 OR level = 'critical'",
     "format_string('%.0f%% of the district is below 10 m.', low_lying_pct)"),
    ("flood", "fl-warning", "Early warning & communication",
     "Act on IMD and CWC alerts; agree rainfall triggers for evacuating low-lying wards.", "medium", "true",
     "format_string('Level %s for floods.', level)"),
    ("flood", "fl-boats", "Pre-positioning", "Pre-position rescue boats and trained crews.", "high", "low_lying_pct >= 5",
     "format_string('%.0f%% of the district is below 10 m.', low_lying_pct)"),
    ("flood", "fl-camps", "Pre-positioning", "Stock relief camps with drinking water, sanitation and food.", "medium", "true",
     "concat('Level ', level, '; ', coalesce(format_string('%,.1f lakh people.', population / 1e5), "
     "'population unavailable.'))"),
    ("flood", "fl-health", "Health", "Stock ORS, chlorine tablets and other waterborne-disease supplies.", "high", "true",
     "format_string('Level %s for floods.', level)"),
    ("cyclone", "cy-warning", "Early warning & communication",
     "Check that IMD cyclone warnings reach coastal villages (sirens, SMS, volunteers).", "medium", "true",
     "format_string('%d tropical storms within 100 km since 1980.', storms_ts)"),
    ("cyclone", "cy-fishing", "Planning", "Keep a standing procedure to recall fishing boats and secure harbours.", "medium",
     "true", "format_string('Level %s for cyclones.', level)"),
    ("cyclone", "cy-routes", "Planning", "Mark and maintain coastal evacuation routes; agree evacuation triggers.", "high",
     "true", "format_string('%d hurricane-strength storms within 100 km since 1980.', storms_hurricane)"),
    ("cyclone", "cy-shelters", "Structural",
     "Ensure wind-resistant cyclone shelters with capacity for the at-risk coastal population.", "high", "true",
     "format_string('Level %s; %,.0f lakh people in the state.', level, population / 1e5)"),
    ("cyclone", "cy-power", "Pre-positioning", "Arrange backup power and communications at hospitals and control rooms.",
     "high", "true", "format_string('Level %s for cyclones.', level)"),
    ("cyclone", "cy-stock", "Pre-positioning",
     "Stock food, drinking water and medicines before the season; plan road clearance after landfall.", "critical", "true",
     "format_string('Annual chance of a hurricane-strength storm nearby is %.0f%%.', first_chance * 100)"),
]

# Needs by hazard as (need, category, quantity, priority, from, to).
NEEDS = {
    "flood": [
        ("Pre-position rescue boats and life jackets", "rescue", "1 boat per 200 people on low-lying land", "Critical",
         "District boat depot", "Low-lying villages"),
        ("Move medical supplies to relief camps", "medical", "ORS, antibiotics and first-aid kits for 5,000 people",
         "Critical", "District hospital store", "Relief camps"),
        ("Set up relief camps on high ground", "shelter", "Space for 3.5 m² per person", "High", "Block office",
         "Schools and community halls on high ground"),
        ("Stock drinking water and purification tablets", "water", "15 L per person per day for 7 days", "High",
         "Water board depot", "Relief camps"),
        ("Distribute dry food rations", "food", "One 2,100 kcal ration per person per day", "High",
         "Public distribution warehouse", "Relief camps"),
        ("Arrange transport for evacuation", "transport", "Buses and tractors for low-lying villages", "Critical",
         "Transport depot", "Evacuation points"),
        ("Set up emergency communication", "communication", "Satellite phones and radio sets for each block", "Medium",
         "District control room", "Block offices"),
    ],
    "cyclone": [
        ("Evacuate coastal villages to cyclone shelters", "transport", "Buses for everyone within 5 km of the coast",
         "Critical", "Transport depot", "Cyclone shelters"),
        ("Stock cyclone shelters with food and water", "food", "Rations and water for 3 days per sheltered person",
         "Critical", "Public distribution warehouse", "Cyclone shelters"),
        ("Move medical teams and supplies to shelters", "medical", "One mobile medical team per 5,000 people", "High",
         "District hospital", "Cyclone shelters"),
        ("Pre-position tree-cutting and road-clearing teams", "rescue", "One team per block with chainsaws", "High",
         "Public works depot", "Main coastal roads"),
        ("Arrange backup power for hospitals and shelters", "power", "Generators and fuel for 72 hours", "High",
         "Electricity board store", "Hospitals and shelters"),
        ("Broadcast early warnings to fishing communities", "communication", "Sirens, SMS and volunteer runners",
         "Critical", "District control room", "Fishing harbours"),
    ],
    "earthquake": [
        ("Pre-position search-and-rescue teams and equipment", "rescue",
         "One team per 5,000 people, with cutters and jacks", "Critical", "State disaster response force base",
         "Dense urban wards"),
        ("Stock trauma kits at hospitals", "medical", "Trauma and surgical kits for 1,000 casualties", "Critical",
         "Central medical store", "District hospitals"),
        ("Set up emergency shelters and tents", "shelter", "Tents at 3.5 m² per displaced person", "High",
         "Relief material depot", "Open grounds"),
        ("Stock drinking water", "water", "15 L per person per day for 7 days", "High", "Water board depot",
         "Open grounds and shelters"),
        ("Arrange heavy machinery for debris clearing", "transport", "Excavators and cranes on standby", "High",
         "Public works depot", "Dense urban wards"),
        ("Set up emergency communication", "communication", "Satellite phones for the control room and hospitals",
         "Medium", "District control room", "Hospitals"),
    ],
}


def _pick(table: dict, key: Column) -> Column:
    return cases((key == k, F.lit(v)) for k, v in table.items())


def _ceil(value: Column) -> Column:
    return F.ceil(value).cast("long")


# ── plans ───────────────────────────────────────────────────────────────────


def resources(rows: DataFrame, kind: str, days: int = 7, homeless: float = 0.0) -> DataFrame:
    """People needing help and what they need. Without a population every line stays null."""
    if kind not in EXPOSURE:
        raise ValueError(f"unknown hazard '{kind}'; use one of {', '.join(EXPOSURE)}")
    if not 1 <= days <= MAX_DAYS:
        raise ValueError(f"days must be between 1 and {MAX_DAYS}")
    people = F.col("people")
    out = rows.withColumn("people", F.rint(F.col("population") * _pick(EXPOSURE[kind], F.col("level"))).cast("long"))
    lines = {
        "medical_teams": _ceil(people * CONSULT_RATE / PATIENTS_PER_DAY), "food_rations": people * days,
        "water_litres": people * WATER_L_PER_DAY * days, "shelter_places": people,
        "shelter_m2": F.rint(people * SHELTER_M2).cast("long"),
    }
    if kind == "flood":
        lines["rescue_boats"] = _ceil(people * F.col("low_lying_pct") / 100 / PEOPLE_PER_BOAT)
        lines["long_stay_places"] = F.rint(people * homeless).cast("long")
    elif kind == "earthquake":
        lines["rescue_teams"] = _ceil(people / PEOPLE_PER_TEAM)
    else:
        lines["cyclone_shelters"] = _ceil(people / SHELTER_CAPACITY)
    return out.withColumns(lines)


def preparedness(rows: DataFrame, kind: str) -> DataFrame:
    """One line per region and action whose rule fires, with the reason."""
    options = [F.when((level_order(F.col("level")) >= _floor(minimum)) & F.expr(trigger), F.struct(
        F.lit(place).alias("place"), F.lit(key).alias("id"), F.lit(category).alias("category"),
        F.lit(action).alias("action"), F.expr(reason).alias("why")))
        for place, (hazard, key, category, action, minimum, trigger, reason) in enumerate(RULES) if hazard == kind]
    fired = F.explode(F.array_compact(F.array(*options))).alias("x")
    return rows.select("region", "level", fired).select("region", "level", "x.*")


def _floor(level: str) -> int:
    return {"low": 0, "medium": 1, "high": 2, "critical": 3}[level]


def actions_by_category(actions: DataFrame) -> DataFrame:
    """A region's actions under each category; the rule list bounds how many there are."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "action"))), lambda x: x["action"])
    return actions.groupBy("region", "category").agg(listed.alias("actions"))


def recommend(rows: DataFrame, kind: str, days: int = 7, homeless: float = 0.0) -> DataFrame:
    """Response estimate, tier labels, rank and a line of reasoning for every region, in order of rank."""
    tier = _pick(TIER, F.col("level"))
    out = resources(rows, kind, days, homeless).withColumn("tier", tier)
    out = out.withColumns({
        "response_label": _pick(RESPONSE_LABEL, F.col("tier")),
        "preparedness_label": _pick(PREPAREDNESS_LABEL, F.col("tier")), "reasoning": _reasoning(kind)})
    order = ("tier", F.desc(F.coalesce("people", F.lit(0))), F.desc("probability"), "region")
    return positions(out.orderBy(*order), "rank")


def _reasoning(kind: str) -> Column:
    crowd = F.coalesce(F.format_string("%.1f lakh people", F.when(F.col("population").isNotNull(), F.col("population") / 1e5)),
                       F.lit(""))
    crowd = F.when(F.col("population").isNull(), "population unavailable (no Census 2011 row)").otherwise(crowd)
    parts = [F.format_string(f"%s {kind} risk (%.0f%%)", "level", F.col("probability") * 100), crowd]
    if kind == "flood":
        parts.append(F.when(F.col("low_lying_pct") >= 10, F.format_string("%.0f%% low-lying land", "low_lying_pct")))
    end = (F.when(F.col("people").isNull(), " → resource needs unavailable without a population")
           .when(F.col("people") == 0, " → monitor, no resources committed")
           .otherwise(F.format_string(" → %,d people may need assistance", "people")))
    return F.concat(F.concat_ws(" + ", *parts), end)


def resource_totals(plan: DataFrame, lines: list[str]) -> DataFrame:
    """Totals over the regions with a population, and how many have none."""
    return plan.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in lines],
                    F.count_if(F.col("people").isNull()).alias("regions_without_population"))


def tier_counts(plan: DataFrame) -> DataFrame:
    counted = plan.agg(*[F.count_if(F.col("tier") == t).alias(str(t)) for t in RESPONSE_LABEL])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(str(t)).alias("count"))
                                              for t, label in RESPONSE_LABEL.items()])).alias("x")).select("x.*")


def risk_areas(flood: DataFrame, indexes: dict[str, DataFrame]) -> DataFrame:
    """High and critical areas of all hazards in one list, critical first, then by population."""
    raised = F.col("level").isin("critical", "high")
    parts = [flood.filter(raised).select(F.col("district").alias("area"), "state", F.lit("flood").alias("hazard"), "level",
                                         "probability", "population")]
    parts += [df.filter(raised).select(F.col("region").alias("area"), F.col("region").alias("state"),
                                       F.lit(hazard).alias("hazard"), "level", "probability", "population")
              for hazard, df in indexes.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.withColumn("id", F.concat_ws(":", "hazard", "state", "area"))
    return out.orderBy(F.when(F.col("level") == "critical", 0).otherwise(1), F.desc(F.coalesce("population", F.lit(0))), "id")


def plan_id(risk_id: Column) -> Column:
    return F.translate(risk_id, "/", "_")


def areas_with_plan(areas: DataFrame, plans: DataFrame, has: bool = True) -> DataFrame:
    return areas.withColumn("plan_id", plan_id(F.col("id"))).join(
        plans.select("plan_id"), "plan_id", "left_semi" if has else "left_anti")


def areas_and_plans(areas: DataFrame, plans: DataFrame, fields: list[str]) -> DataFrame:
    """All areas and saved plans; a plan stands in for an area that is no longer listed."""
    a = areas.withColumn("plan_id", plan_id(F.col("id"))).select("plan_id", *[F.col(c).alias(f"_a_{c}") for c in fields])
    p = plans.select("plan_id", F.lit(True).alias("has_plan"), *[F.col(c).alias(f"_p_{c}") for c in fields])
    return a.join(p, "plan_id", "full").select(
        "plan_id", F.coalesce("has_plan", F.lit(False)).alias("has_plan"),
        *[F.coalesce(f"_a_{c}", f"_p_{c}").alias(c) for c in fields])


# ── needs ───────────────────────────────────────────────────────────────────


def needs_table(spark: SparkSession) -> DataFrame:
    rows = [(hazard, f"n{i}", *need) for hazard, needs in NEEDS.items() for i, need in enumerate(needs, 1)]
    return spark.createDataFrame(rows, "hazard string, need_id string, need string, category string, quantity string, "
                                       "priority string, from_hint string, to_hint string")


def area_needs(areas: DataFrame) -> DataFrame:
    """The fixed needs of an area's hazard."""
    return areas.join(needs_table(areas.sparkSession), "hazard")


def clean_needs(lists: DataFrame, key: str, body: str) -> DataFrame:
    """Needs out of a JSON list: the first eight, blanks and non-objects left out, texts cut, odd values replaced.

    Ids are given after the blanks have gone.
    """
    items = F.expr(f"try_variant_get(try_parse_json({body}), '$.needs', 'array<variant>')")
    plain = F.expr(f"try_variant_get(try_parse_json({body}), '$', 'array<variant>')")
    rows = lists.withColumn("_items", F.slice(F.coalesce(items, plain), 1, 8))
    rows = rows.withColumn("_texts", F.expr("transform(_items, v -> to_json(v))"))
    fields = "need string, category string, quantity string, priority string, from_hint string, to_hint string"
    parsed = F.transform("_texts", lambda v: F.when(v.startswith("{"), F.from_json(v, fields)))
    kept = F.filter(parsed, lambda n: F.trim(F.coalesce(n["need"], F.lit(""))) != "")
    rows = rows.select(key, F.posexplode(kept).alias("_place", "n"))

    def text(name: str, size: int) -> Column:
        return F.substring(F.trim(F.coalesce(F.col(f"n.{name}"), F.lit(""))), 1, size)

    category, priority = F.lower(text("category", 200)), F.lower(text("priority", 200))
    priority = F.concat(F.upper(F.substring(priority, 1, 1)), F.substr(priority, F.lit(2)))
    return rows.select(
        key, F.concat(F.lit("n"), (F.col("_place") + 1).cast("string")).alias("need_id"), text("need", 120).alias("need"),
        F.when(category.isin(CATEGORIES), category).otherwise("transport").alias("category"),
        text("quantity", 160).alias("quantity"),
        F.when(priority.isin(PRIORITIES), priority).otherwise("High").alias("priority"),
        text("from_hint", 120).alias("from_hint"), text("to_hint", 120).alias("to_hint"))


def plan_needs(plans: DataFrame) -> DataFrame:
    """One line per need of a plan."""
    return plans.select("plan_id", F.explode("needs").alias("n")).select(
        "plan_id", F.concat_ws(":", "plan_id", "n.need_id").alias("key"), "n.*")


# ── responders ──────────────────────────────────────────────────────────────


def active_counts(tasks: DataFrame) -> DataFrame:
    return tasks.filter("status <> 'delivered'").groupBy("assignee_id").agg(F.count("*").alias("active"))


def smart_matches(responders: DataFrame, tasks: DataFrame, needs: DataFrame, limit: int = 3) -> DataFrame:
    """The best responders of each need by availability, place, role and workload.

    Responders and needs are never crossed. The part of the score that does not depend on
    the need orders the responders in six pools: by city or state or neither, with or
    without the role. Whoever is among the best of a need is also among the best of the
    pool that fits them, because everyone ahead of them there scores at least as much for
    that need. So a need only meets the first few of its pools. Responders are read once: each is
    put under the names of its pools, and one window keeps the first few of every pool.
    """
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    base = (responders.join(active_counts(tasks), responders["id"] == F.col("assignee_id"), "left")
            .withColumns({"active": F.coalesce("active", F.lit(0)), "_city": norm(F.col("city")), "_state": norm(F.col("state"))}))
    ready = F.coalesce(_pick({"now": 3, "2hrs": 1, "unavailable": -10}, F.col("availability")), F.lit(0))
    base = base.select("id", "name", "role", "_city", "_state", "active", (ready - F.col("active")).alias("_base"))
    asked = needs.select("key", norm(F.col("area")).alias("_area"), norm(F.col("state")).alias("_nstate"), "category")
    roles = F.create_map(*[x for c, names in CATEGORY_ROLES.items() for x in (F.lit(c), F.array(*[F.lit(n) for n in names]))])
    fitting = F.coalesce(roles[F.col("category")], F.array().cast("array<string>"))

    def pools(city: Column, state: Column, held: Column) -> Column:
        """Names of pools by place, for anyone and for each of the roles."""
        place = F.array_compact(F.array(F.when(city != "", F.concat(F.lit("c|"), city)), F.when(state != "", F.concat(F.lit("s|"), state)), F.lit("")))
        return F.explode(F.flatten(F.transform(place, lambda p: F.concat(F.array(p), F.transform(held, lambda r: F.concat(p, F.lit("|r|"), r))))))

    own = F.array_compact(F.array("role"))
    order = W.partitionBy("_pool").orderBy(F.desc("_base"), "active", "name", "id")
    best = (base.withColumn("_pool", pools(F.col("_city"), F.col("_state"), own))
            .withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n"))
    met = asked.withColumn("_pool", pools(F.col("_area"), F.col("_nstate"), fitting)).join(best, "_pool").drop("_pool")
    pairs = met.distinct()
    near = (F.when((F.col("_city") != "") & (F.col("_city") == F.col("_area")), 3)
            .when((F.col("_state") != "") & (F.col("_state") == F.col("_nstate")), 1).otherwise(0))
    role = F.when(F.array_contains(roles[F.col("category")], F.col("role")), 2).otherwise(0)
    order = W.partitionBy("key").orderBy(F.desc("score"), "active", "name", "id")
    return (pairs.withColumn("score", F.col("_base") + near + role).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= limit).select("key", "rank", "id", "name", "score", "active"))


# ── tasks ───────────────────────────────────────────────────────────────────


def task_stats(tasks: DataFrame) -> DataFrame:
    group = status_group(F.col("status"))
    return tasks.agg(F.count("*").alias("total"), F.count_if(group == "completed").alias("completed"),
                     F.count_if(group == "in_progress").alias("in_progress"), F.count_if(group == "pending").alias("pending"))


def plan_readiness(needs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Readiness of each plan: the mean over its needs of how far the furthest task has got."""
    done = tasks.groupBy("plan_id", "need_id").agg(F.max(status_progress(F.col("status"))).alias("_best"))
    rows = needs.select("plan_id", "need_id").join(done, ["plan_id", "need_id"], "left")
    return rows.groupBy("plan_id").agg(half_up(F.avg(F.coalesce("_best", F.lit(0)))).alias("readiness"))


def overall_readiness(readiness: DataFrame) -> DataFrame:
    return readiness.agg(F.coalesce(half_up(F.avg("readiness")), F.lit(0)).alias("readiness"))


def task_state(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """Tasks with their latest update applied; a task without one stays as it was."""
    last = F.max_by(F.struct("status", "note", "lat", "lon"), F.struct("at", "update_id"))
    news = updates.groupBy("task_id").agg(last.alias("_u"), F.max("at").alias("updated_at"),
                                          F.count_if(F.col("photo") != "").alias("_proofs"))
    return tasks.join(news, "task_id", "left").withColumns({
        "status": F.coalesce("_u.status", "status"), "last_note": F.coalesce("_u.note", F.lit("")),
        "proof_count": F.coalesce("_proofs", F.lit(0))}).drop("_u", "_proofs")


def person_tasks(tasks: DataFrame, person: str) -> DataFrame:
    """One person's tasks, marked active or done."""
    return tasks.filter(F.col("assignee_id") == person).withColumn(
        "list", F.when(F.col("status") == "delivered", "done").otherwise("active"))


def deadlines(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.withColumns({"overdue": F.coalesce(F.col("deadline") < now, F.lit(False)),
                              "days_left": F.datediff(F.to_date("deadline"), F.to_date(now)).cast("long")})


def new_assignments(tasks: DataFrame, seen: DataFrame) -> DataFrame:
    """Tasks given to a person since the highest number they have seen."""
    marks = seen.groupBy("assignee_id").agg(F.max("number").alias("_seen"))
    return tasks.join(marks, "assignee_id", "left").filter(
        F.col("number") > F.coalesce("_seen", F.lit(-1))).drop("_seen")
