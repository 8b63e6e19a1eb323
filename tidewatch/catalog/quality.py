"""Quality, storage and streaming queries."""

from pyspark.sql import functions as F

from tidewatch.catalog import live as live_catalog
from tidewatch.catalog import query
from tidewatch.catalog.impact import rounded
from tidewatch.operators import quality as op

from tidewatch.session import fresh_path
from tidewatch.sources import readers, sinks
from tidewatch.streaming import feeds


@query("reconcile", """WITH a AS (SELECT type, sum(deaths) AS p FROM {impact_records} GROUP BY type), b AS (SELECT type, sum(deaths) AS t FROM {world_yearly} GROUP BY type)
SELECT type, CAST(p AS BIGINT) AS parts, CAST(t AS BIGINT) AS total, CAST(p - t AS BIGINT) AS difference FROM a JOIN b USING (type)""")
def reconcile(t):
    return op.reconcile(t.impact_records, t.world_yearly, ["type"], "deaths")


@query("control_total", "SELECT CAST(sum(population) AS BIGINT) AS total, CAST(130000000 AS BIGINT) AS expected, sum(population) = 130000000 AS ok FROM {region_boxes}")
def control_total(t):
    return op.control_total(t.region_boxes, "population", 130000000)


@query("missing_keys", "SELECT DISTINCT c_nationkey FROM {customer} WHERE c_nationkey NOT IN (SELECT (s_suppkey * s_suppkey) % 25 FROM {supplier})")
def missing_keys(t):
    have = t.supplier.select(((F.col("s_suppkey") * F.col("s_suppkey")) % 25).alias("c_nationkey"))
    return op.missing_keys(t.customer, have, ["c_nationkey"])


@query("bound_violations", """SELECT 'l_quantity' AS "column", count(CASE WHEN l_quantity < 2 OR l_quantity > 49 THEN 1 END) AS violations FROM {lineitem}
UNION ALL SELECT 'l_discount', count(CASE WHEN l_discount > 0.08 THEN 1 END) FROM {lineitem}""")
def bound_violations(t):
    return op.bound_violations(t.lineitem, {"l_quantity": (2, 49), "l_discount": (None, 0.08)})


@query("reject_share", """SELECT count(CASE WHEN start_text = 'unknown' THEN 1 END) AS rejected, count(*) AS "all",
  round(count(CASE WHEN start_text = 'unknown' THEN 1 END) / count(*), 6) AS share, count(CASE WHEN start_text = 'unknown' THEN 1 END) / count(*) < 0.05 AS ok FROM {inventory}""")
def reject_share(t):
    return rounded(op.reject_share(t.inventory.filter("start_text = 'unknown'"), t.inventory))


@query("missing_months", """SELECT d.district, y.year, m.month FROM (SELECT DISTINCT district FROM {panel}) d CROSS JOIN (SELECT CAST(range AS BIGINT) AS year FROM range(1995, 2002)) y
CROSS JOIN (SELECT CAST(range AS BIGINT) AS month FROM range(1, 13)) m ANTI JOIN {panel} p ON p.district = d.district AND p.year = y.year AND p.month = m.month""")
def missing_months(t):
    return op.missing_months(t.panel, 1995, 2001)


@query("responder_violations", """SELECT id, concat_ws(',', CASE WHEN capacity > 100000 THEN 'capacity' END) AS violations FROM {responders}""")
def responder_violations(t):
    out = op.violations(t.responders, op.RESPONDER_RULES)
    return out.select("id", F.array_join("violations", ",").alias("violations"))


@query("plan_violations", """SELECT plan_id, concat_ws(',', CASE WHEN length(area) > 6 THEN NULL END, CASE WHEN k % 3 = 0 THEN 'hazard' END, CASE WHEN k % 4 = 1 THEN 'needs' END,
  'source') AS violations FROM (SELECT plan_id, area, CAST(substr(plan_id, 5) AS INT) AS k FROM {plan_needs} GROUP BY ALL) q""")
def plan_violations(t):
    """Plans with an unknown hazard or too many needs; none says where it comes from."""
    k = F.substr("plan_id", F.lit(5)).cast("int")
    plans = t.plan_needs.groupBy("plan_id", "area", "state").agg(F.collect_list("need_id").alias("few"))
    plans = plans.withColumns({"hazard": F.when(k % 3 == 0, "drought").otherwise("flood"), "level": F.lit("high"), "population": F.lit(None).cast("long"),
                               "needs": F.when(k % 4 == 1, F.sequence(F.lit(1), F.lit(11)).cast("array<string>")).otherwise(F.col("few"))}).drop("few")
    out = op.violations(plans, op.PLAN_RULES, whole=True)
    return out.select("plan_id", F.array_join("violations", ",").alias("violations"))


@query("task_violations", """SELECT task_id, concat_ws(',', 'need', 'from', 'to', 'details', CASE WHEN number % 10 = 0 THEN 'assignee_id' END, 'priority',
  CASE WHEN number % 7 = 0 THEN 'status' END, 'last_note', 'assignee_name', 'proof_count') AS violations FROM {tasks}""")
def task_violations(t):
    """Tasks without most of their fields, some without a person or with an unknown status."""
    rows = t.tasks.withColumns({
        "assignee_id": F.when(F.col("number") % 10 != 0, F.col("assignee_id")),
        "status": F.when(F.col("number") % 7 == 0, "lost").otherwise(F.col("status"))})
    out = op.violations(rows, op.TASK_RULES, whole=True)
    return out.select("task_id", F.array_join("violations", ",").alias("violations"))


@query("required_columns", "SELECT n_name AS name, n_regionkey AS region FROM {nation}")
def required_columns(t):
    """A table that has what is needed passes as it is; one that lacks a column is refused."""
    try:
        op.require_columns(t.nation, ["n_name", "population"])
    except ValueError as refused:
        assert "population" in str(refused)
        return op.require_columns(t.nation, ["n_name", "n_regionkey"]).select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    raise AssertionError("a missing column went unseen")


@query("quarantined_updates", "SELECT update_id, 'status' AS reasons FROM {updates} WHERE status = 'lost'")
def quarantined_updates(t):
    _, bad = op.split_valid(t.updates, op.UPDATE_RULES)
    return bad.select("update_id", F.array_join("violations", ",").alias("reasons"))


@query("range_messages", """SELECT p_partkey, CASE WHEN p_size NOT BETWEEN 5 AND 45 THEN 'p_size must be between 5 and 45'
  WHEN p_retailprice NOT BETWEEN 0 AND 1000 THEN 'p_retailprice must be between 0 and 1000' END AS message FROM {part}""")
def range_messages(t):
    return op.range_messages(t.part, [("p_size", 5, 45), ("p_retailprice", 0, 1000)]).select("p_partkey", "message")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM {lineitem} GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t):
    return op.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("same_sets", """SELECT k, 'first' AS only_in FROM (SELECT DISTINCT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey FROM {customer} WHERE c_acctbal > 0) a
UNION ALL SELECT k, 'second' FROM (SELECT c_custkey AS k FROM {customer} WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM {orders}) b""")
def same_sets(t):
    return op.same_sets(t.orders.select(F.col("o_custkey").alias("k")), t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("region_population", """SELECT CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey % 10 = 3 THEN 'Telangana' WHEN c_mktsegment = 'MACHINERY' THEN 'Odisha'
  ELSE upper(c_mktsegment[1]) || lower(substr(c_mktsegment, 2)) || ' and Co' END AS region, CAST(sum(CAST(c_acctbal AS BIGINT)) AS BIGINT) AS population FROM
  (SELECT c_mktsegment, c_nationkey, floor(c_acctbal) AS c_acctbal FROM {customer}) c GROUP BY 1""")
def region_population(t):
    state = F.when(F.col("c_mktsegment") == "MACHINERY", "MACHINERY").otherwise(F.concat("c_mktsegment", F.lit(" AND CO")))
    census = t.customer.select(state.alias("state"), F.concat(F.lit("d"), (F.col("c_nationkey") % 10).cast("string")).alias("district"),
                               F.floor("c_acctbal").cast("long").alias("population"))
    return op.region_population(census, {("BUILDING AND CO", "d3"): "Telangana"}, {"MACHINERY": "Odisha"})


# ── storage ─────────────────────────────────────────────────────────────────


@query("store_round_trip", """SELECT type, count(*) AS records, CAST(sum(deaths) AS BIGINT) AS deaths FROM {impact_records} WHERE type = 'flood' GROUP BY type""")
def store_round_trip(t):
    path = fresh_path(t.spark, "store")
    sinks.write_store(t.impact_records, path, ["type"])
    back = t.spark.read.parquet(path).filter("type = 'flood'")
    return back.groupBy("type").agg(F.count("*").alias("records"), F.sum("deaths").alias("deaths"))


@query("csv_round_trip", """SELECT country, count(*) AS records, CAST(sum(deaths) AS BIGINT) AS deaths,
  bool_or(historical_state) AS historical_state FROM {impact_records} GROUP BY country""")
def csv_round_trip(t):
    path = fresh_path(t.spark, "csv")
    sinks.write_csv(t.impact_records, path, ["country", "deaths", "damages_usd", "historical_state"])
    back = readers.read_csv(t.spark, path, "country string, deaths long, damages_usd double, historical_state string")
    back = readers.text_flags(back, ["historical_state"])
    return back.groupBy("country").agg(F.count("*").alias("records"), F.sum("deaths").alias("deaths"),
                                       F.bool_or("historical_state").alias("historical_state"))


@query("build_metadata", """SELECT 'impact_records' AS "table", count(*) AS rows, min(year) AS first_year, max(year) AS last_year FROM {impact_records}
UNION ALL SELECT 'centroids', count(*), NULL, NULL FROM {centroids}""")
def build_metadata(t):
    return sinks.build_metadata({"impact_records": t.impact_records, "centroids": t.centroids})


@query("parse_rates", "SELECT year, round(sum(damages_usd) / 1e6, 6) AS inr_per_usd FROM {world_yearly} WHERE year % 5 <> 0 GROUP BY year")
def parse_rates(t):
    """Yearly figures written as the rate service writes them, every fifth year without a value."""
    value = F.when(F.col("year") % 5 != 0, F.round(F.sum("damages_usd") / 1e6, 6)).alias("value")
    rows = t.world_yearly.groupBy("year").agg(value).withColumn("date", F.col("year").cast("string"))
    page = rows.groupBy((F.col("year") / 25).cast("int")).agg(F.to_json(F.collect_list(F.struct("date", "value"))).alias("r"))
    return readers.parse_rates(page.select(F.concat(F.lit('[{"page": 1}, '), "r", F.lit("]")).alias("body")))


# ── streaming ───────────────────────────────────────────────────────────────


def stream(t, name):
    schema = t.spark.read.parquet(f"{t.sf_dir}/{name}.parquet").schema
    return feeds.landed(t.spark, t.sf_dir, schema, f"{name}.parquet")


@query("stream_daily_counts", """SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, event_type, count(*) AS n FROM {events}
WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM {events}) - INTERVAL 1 DAY GROUP BY ALL""")
def stream_daily_counts(t):
    events = stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = feeds.run_available(feeds.daily_counts(events), "daily-counts")
    return out.withColumn("day", F.col("day").cast("string"))


@query("stream_task_state", """SELECT task_id, max_by(status, (at_time, update_id)) AS status, count(CASE WHEN photo <> '' THEN 1 END) AS proofs
FROM {updates} GROUP BY task_id""")
def stream_task_state(t):
    rows = stream(t, "events").selectExpr(
        "event_id AS update_id", "concat('T', user_id) AS task_id",
        "CASE event_type WHEN 'view' THEN 'accepted' WHEN 'click' THEN 'collected' WHEN 'purchase' THEN 'in_transit' "
        "WHEN 'signup' THEN 'delivered' ELSE 'lost' END AS status", "ts AS at", "event_id % 3 = 0 AS photo")
    return feeds.keep_latest(rows, "task-state", ["task_id"], ["at", "update_id"], {"proofs": "photo"}).select(
        "task_id", "status", "proofs")


@query("stream_distinct_readings", "SELECT event_type AS source, count(DISTINCT event_id % 500) AS readings FROM {events} GROUP BY 1")
def stream_distinct_readings(t):
    rows = stream(t, "events").select(F.col("event_type").alias("source"), (F.col("event_id") % 500).cast("string").alias("source_id"),
                                      F.lit("2024-01-01").cast("timestamp").alias("updated"))
    out = feeds.run_available(feeds.distinct_readings(rows), "distinct-readings")
    return out.groupBy("source").agg(F.count("*").alias("readings"))


@query("stream_source_health", """SELECT source, CASE WHEN max_by(ok, (at_s, event_id)) THEN 'ok' WHEN bool_or(ok) THEN 'stale' ELSE 'unavailable' END AS status,
  count(*) AS tries FROM {attempts} GROUP BY source""")
def stream_source_health(t):
    rows = stream(t, "events").selectExpr(
        "CASE WHEN event_type IN ('view', 'purchase') THEN 'usgs' WHEN event_type IN ('click', 'signup') THEN 'gdacs' ELSE 'eonet' END AS source",
        "CAST(floor(event_id / 5) AS BIGINT) * 60 + 1704067200 AS at", "event_type <> 'error' AND user_id % 4 <> 0 AS ok",
        "CAST(user_id AS BIGINT) AS events", "CAST(NULL AS STRING) AS error", "event_id")
    out = feeds.source_health(rows, "source-health", F.lit(1704067200), 10 ** 9)
    return out.select("source", "status", "tries")


@query("late_rows", "SELECT event_id FROM {events} WHERE ts < TIMESTAMP '2024-01-03 00:00:00'")
def late_rows(t):
    batch = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    _, late = feeds.late_rows(batch, "2024-01-03 00:00:00")
    return late.select("event_id")


# ── feeds as streams ────────────────────────────────────────────────────────


def landed_feed(t, source):
    """A feed's documents landed as files, one each; of every tenth page only the first half arrives."""
    rows = live_catalog.feed(t, source)
    half = F.col("body").substr(F.lit(1), (F.length("body") / 2).cast("int"))
    rows = rows.withColumn("body", F.when(F.col("page") % 10 == 7, half).otherwise(F.col("body")))
    path = fresh_path(t.spark, f"landed-{source}")
    rows = rows.withColumn("code", F.coalesce("code", F.lit(""))) if "code" in rows.columns else rows
    keys = ["code"] if "code" in rows.columns else []
    sinks.write_documents(rows, path, "page", keys)
    return feeds.feed_readings(feeds.landed_documents(t.spark, path), source, f"feed-{source}", live_catalog.now_ts())


WHOLE = "CAST(floor(seq / 90) AS BIGINT) % 10 <> 7"


@query("stream_usgs", f"""SELECT source_id, title, latitude, longitude, at_s, location, CASE WHEN seq % 2 = 0 THEN 'green' END AS alert, true AS traced
FROM {{live_readings}} WHERE source = 'usgs' AND {WHOLE}""")
def stream_usgs(t):
    rows, _ = landed_feed(t, "usgs")
    traced = F.col("file").endswith(".txt") & F.col("landed_at").isNotNull()
    return rows.select("source_id", "title", "latitude", "longitude", F.unix_seconds("date").alias("at_s"), "location", "alert", traced.alias("traced"))


@query("stream_gdacs", f"""SELECT CASE type WHEN 'earthquake' THEN 'EQ' WHEN 'cyclone' THEN 'TC' ELSE 'FL' END || source_id AS source_id,
  type, title, latitude, longitude, at_s, alert, storm_name FROM {{live_readings}} WHERE source = 'gdacs' AND {WHOLE}
  AND CASE WHEN type = 'earthquake' THEN at_s >= {live_catalog.NOW} - 7 * 86400 ELSE seq % 3 <> 0 END""")
def stream_gdacs(t):
    rows, _ = landed_feed(t, "gdacs")
    return rows.select("source_id", "type", "title", "latitude", "longitude", F.unix_seconds("date").alias("at_s"), "alert", "storm_name")


@query("stream_eonet", f"""SELECT source_id, type, latitude, longitude, at_s, CASE WHEN seq % 4 <> 0 THEN gdacs_event_id END AS gdacs_event_id
FROM {{live_readings}} WHERE source = 'eonet' AND {WHOLE} AND seq % 11 <> 3 AND (type = 'cyclone' OR seq % 10 <> 5)
  AND (latitude IS NOT NULL OR (gdacs_event_id IS NOT NULL AND seq % 4 <> 0))""")
def stream_eonet(t):
    rows, _ = landed_feed(t, "eonet")
    return rows.select("source_id", "type", "latitude", "longitude", F.unix_seconds("date").alias("at_s"), "gdacs_event_id")


@query("stream_rejects", """SELECT source, reason, count(*) AS documents FROM (
  SELECT DISTINCT source, 'not a ' || source || ' document' AS reason, CAST(floor(seq / 90) AS BIGINT) AS page,
    CASE WHEN source = 'gdacs' THEN type ELSE '' END AS part FROM {live_readings}) q WHERE page % 10 = 7 GROUP BY ALL""")
def stream_rejects(t):
    rejects = [landed_feed(t, source)[1].withColumn("source", F.lit(source)) for source in ("usgs", "gdacs", "eonet")]
    return rejects[0].unionByName(rejects[1]).unionByName(rejects[2]).groupBy("source", "reason").agg(F.count("*").alias("documents"))


@query("merged_events")
def merged_events(t):
    """Events out of a stream of readings that land as files; the unit tests hold the merge against going one by one."""
    rows = live_catalog.readings(t)
    path = fresh_path(t.spark, "landed-readings")
    rows.write.parquet(path)
    out = feeds.merged_events(feeds.landed(t.spark, path, rows.schema), "merged-events")
    return out.select("id", "type", "alert", "severity_level", "readings", "n_sources", "disagreement", "labels")
