"""Hazard-shaped views over the star-schema test tables.

Each view is one SQL text that Spark and DuckDB read alike, so that a query and its
reference SQL start from the same rows. ``{name}`` stands for a base table or for
another view. Nothing here is an operator: users of the library bring their own tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
        "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {}

# One line per customer, type and year before the customer join: a customer that holds a
# third of all orders then brings a few hundred rows to the join instead of all of them.
VIEWS["order_facts"] = """
SELECT o_custkey, type, year,
       CAST(count(*) AS BIGINT) AS n_events,
       CAST(sum(CASE WHEN prio = '1-URGENT' THEN 1 + o_orderkey % 97 ELSE 0 END) AS BIGINT) AS deaths,
       CAST(sum(CASE WHEN prio = '5-LOW' THEN o_orderkey % 13 ELSE 0 END) AS BIGINT) AS injured,
       CAST(sum(CASE WHEN prio = '2-HIGH' THEN 100 * (1 + o_custkey % 89) ELSE 0 END) AS BIGINT) AS affected,
       CAST(sum(CASE WHEN prio = '3-MEDIUM' THEN 10 * (1 + o_custkey % 31) ELSE 0 END) AS BIGINT) AS homeless,
       sum(CASE WHEN prio IN ('1-URGENT', '2-HIGH') THEN o_totalprice ELSE 0 END) AS damages,
       sum(CASE WHEN prio = '2-HIGH' AND o_orderkey % 3 = 0 THEN o_totalprice ELSE 0 END) AS insured,
       sum(CASE WHEN prio IN ('1-URGENT', '3-MEDIUM') AND o_orderkey % 5 = 0 THEN o_totalprice ELSE 0 END)
           AS reconstruction
FROM (SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority AS prio,
             CASE o_orderstatus WHEN 'F' THEN 'earthquake' WHEN 'O' THEN 'flood' ELSE 'cyclone' END AS type,
             CAST(1950 + 11 * (year(o_orderdate) - 1995) + o_orderkey % 11 AS BIGINT) AS year
      FROM {orders}) o
GROUP BY o_custkey, type, year
"""

VIEWS["impact_wide"] = """
SELECT f.type, n.n_name AS country,
       'N' || lpad(CAST(n.n_nationkey AS STRING), 2, '0') AS iso3,
       f.year, CAST(floor(f.year / 10) * 10 AS BIGINT) AS decade,
       CAST(sum(f.deaths) AS BIGINT) AS deaths,
       CAST(sum(f.injured) AS BIGINT) AS injured,
       CAST(sum(f.affected) AS BIGINT) AS affected,
       CAST(sum(f.homeless) AS BIGINT) AS homeless,
       CAST(sum(f.injured) + sum(f.affected) + sum(f.homeless) AS BIGINT) AS total_affected,
       round(sum(f.damages), 2) AS damages_usd,
       round(sum(f.insured), 2) AS insured_usd,
       round(sum(f.reconstruction), 2) AS reconstruction_usd,
       round(sum(f.damages), 2) * 0.5 AS damages_nominal_usd,
       round(sum(f.insured), 2) * 0.5 AS insured_nominal_usd,
       round(sum(f.reconstruction), 2) * 0.5 AS reconstruction_nominal_usd,
       CASE WHEN sum(f.damages) > 0 THEN round(round(sum(f.damages), 2) / (2000000.0 + 100000 * n.n_nationkey), 6)
            END AS damages_pct_gdp,
       n.n_nationkey IN (3, 17) AS historical_state,
       CAST(sum(f.n_events) AS BIGINT) AS n_events
FROM {order_facts} f
JOIN {customer} c ON c.c_custkey = f.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
GROUP BY f.type, n.n_name, n.n_nationkey, f.year
"""

VIEWS["impact_records"] = """
SELECT type, country, iso3, year, decade, deaths, injured, affected, homeless, total_affected, damages_usd,
       insured_usd, reconstruction_usd, damages_nominal_usd, insured_nominal_usd, reconstruction_nominal_usd,
       damages_pct_gdp, historical_state
FROM {impact_wide}
WHERE year <= 2025 AND (deaths > 0 OR injured > 0 OR affected > 0 OR homeless > 0 OR damages_usd > 0)
"""

VIEWS["world_yearly"] = """
SELECT type, year, CAST(floor(year / 10) * 10 AS BIGINT) AS decade,
       CAST(sum(deaths) AS BIGINT) AS deaths,
       CAST(sum(injured) + sum(affected) + sum(homeless) AS BIGINT) AS total_affected,
       round(sum(damages), 2) AS damages_usd,
       round(sum(damages), 2) * 0.5 AS damages_nominal_usd,
       CAST(sum(n_events) AS BIGINT) AS n_events
FROM {order_facts}
WHERE year <= 2025
GROUP BY type, year
"""

# A rate every eleventh year, from how many orders a year has.
VIEWS["fx"] = """
SELECT CAST(1950 + 11 * (year(o_orderdate) - 1995) AS BIGINT) AS year,
       CAST(400 + (count(*) * 37) % 7000 AS DOUBLE) / 100 AS inr_per_usd
FROM {orders} GROUP BY year(o_orderdate)
"""

VIEWS["centroids"] = """
SELECT n_name AS country, 'N' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS iso3,
       CAST(((n_nationkey * 7) % 120) - 55 + 0.5 AS DOUBLE) AS latitude,
       CAST(((n_nationkey * 29) % 300) - 150 + 0.25 AS DOUBLE) AS longitude
FROM {nation} WHERE n_nationkey <> 24
"""

VIEWS["quake_rows"] = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
           || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS BIGINT) AS STRING) AS id,
       CASE WHEN l_partkey % 50 = 0 THEN 'explosion' ELSE 'earthquake' END AS type,
       CAST(l_shipdate AS DATE) AS event_date,
       CAST(year(l_shipdate) AS BIGINT) AS year, CAST(month(l_shipdate) AS BIGINT) AS month,
       CAST((l_partkey * 37) % 1800 AS DOUBLE) / 10 - 90 AS latitude,
       CAST((l_suppkey * 73) % 3600 AS DOUBLE) / 10 - 180 AS longitude,
       CAST(l_linenumber * 10 AS DOUBLE) AS depth_km,
       CAST(55 + CAST(l_quantity AS BIGINT) % 34 AS DOUBLE) / 10 AS magnitude,
       CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE 'place ' || CAST(l_suppkey AS STRING) END AS place,
       l_orderkey % 10 = 0 AS twice
FROM {lineitem}
"""

# Catalogue pages, which repeat every tenth order's events, and the catalogue without repeats.
VIEWS["quake_pages"] = """
SELECT id, type, event_date, latitude, longitude, depth_km, magnitude, place
FROM {quake_rows} JOIN (VALUES (0), (1)) again(page) ON page = 0 OR twice
"""

VIEWS["quakes"] = """
SELECT id, event_date, year, month, CAST(floor(year / 10) * 10 AS BIGINT) AS decade,
       latitude, longitude, depth_km, magnitude, place
FROM {quake_rows} WHERE type = 'earthquake' AND magnitude >= 6 AND year <= 2001
"""

VIEWS["track_points"] = """
SELECT CAST(1980 + l_orderkey % 40 AS STRING) || lpad(CAST(1 + l_orderkey % 365 AS STRING), 3, '0')
           || 'N' || CAST(l_orderkey AS STRING) AS sid,
       CASE WHEN l_orderkey % 5 = 0 THEN 'NOT_NAMED' ELSE 'STORM ' || CAST(l_orderkey AS STRING) END AS name,
       CAST(1980 + l_orderkey % 40 AS BIGINT) AS season,
       CASE l_orderkey % 6 WHEN 0 THEN 'NA' WHEN 1 THEN 'NI' WHEN 2 THEN 'SI' WHEN 3 THEN 'WP' WHEN 4 THEN 'NI'
            END AS basin,
       CASE WHEN l_linenumber = 7 THEN 'PROVISIONAL' ELSE 'main' END AS track_type,
       CAST(l_shipdate AS TIMESTAMP) AS iso_time,
       CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey AS point_seq,
       CAST((l_orderkey * 37) % 500 AS DOUBLE) / 10 - 10 + l_linenumber * 0.5 AS lat,
       CAST((l_orderkey * 73) % 900 AS DOUBLE) / 10 + 20 + l_linenumber * 0.5 AS lon,
       CASE WHEN l_linestatus = 'O' AND l_orderkey % 4 <> 0 THEN l_quantity * 3 END AS usa_wind,
       CASE WHEN l_returnflag <> 'N' THEN l_quantity * 2.5 END AS wmo_wind,
       CASE WHEN l_linestatus = 'O' THEN 1010 - l_quantity END AS usa_pres,
       1012 - l_quantity AS wmo_pres,
       CAST(l_linenumber - 1 AS DOUBLE) AS dist2land
FROM {lineitem}
"""

# Regions: one box per nation on a 5 x 5 lattice, as rings of (lon, lat) corners.
VIEWS["region_boxes"] = """
SELECT n_name AS region, CAST(62 + 9 * (n_nationkey % 5) AS DOUBLE) AS west,
       CAST(4 + 9 * floor(n_nationkey / 5) AS DOUBLE) AS south,
       CAST(62 + 9 * (n_nationkey % 5) + 4 + n_nationkey % 3 AS DOUBLE) AS east,
       CAST(4 + 9 * floor(n_nationkey / 5) + 5 AS DOUBLE) AS north,
       CAST(1000000 + 350000 * n_nationkey AS BIGINT) AS population
FROM {nation}
"""

VIEWS["region_vertices"] = """
SELECT region, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS ring, CAST(0 AS BIGINT) AS idx, west AS lon, south AS lat FROM {region_boxes}
UNION ALL SELECT region, 0, 0, 1, east, south FROM {region_boxes}
UNION ALL SELECT region, 0, 0, 2, east, north FROM {region_boxes}
UNION ALL SELECT region, 0, 0, 3, west, north FROM {region_boxes}
UNION ALL SELECT region, 0, 0, 4, west, south FROM {region_boxes}
"""

VIEWS["districts"] = """
SELECT 'D' || lpad(CAST(d AS STRING), 2, '0') AS district, 'State ' || CAST(d % 6 AS STRING) AS state,
       CASE WHEN d % 13 = 5 THEN NULL ELSE CAST(200000 + 50000 * d AS BIGINT) END AS population,
       CAST(8.0 + 0.7 * d AS DOUBLE) AS lat, CAST(70.0 + 0.9 * d AS DOUBLE) AS lon,
       CAST((d * 37) % 100 AS DOUBLE) AS low_lying_pct, CAST(5 + (d * 53) % 900 AS DOUBLE) AS elevation_m,
       d % 20 AS cell
FROM (SELECT n_nationkey AS d FROM {nation}) t
"""

VIEWS["daily_sparse"] = """
SELECT l_suppkey % 20 AS cell, CAST(l_shipdate AS DATE) AS day,
       round(sum(l_quantity), 1) AS rain_mm, round(avg(l_discount) * 10, 3) AS soil_wetness
FROM {lineitem}
GROUP BY l_suppkey % 20, CAST(l_shipdate AS DATE)
"""

VIEWS["flood_events"] = """
SELECT 'E' || CAST(o_orderkey AS STRING) AS uei,
       'D' || lpad(CAST(c_nationkey AS STRING), 2, '0') AS district,
       CAST(o_orderdate AS DATE) AS start_date,
       CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) AS end_date,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS DOUBLE) END AS deaths
FROM {orders} JOIN {customer} ON c_custkey = o_custkey
"""

# District-month panel with feature columns, and a score that stands for a model's output.
VIEWS["panel"] = """
SELECT district, state, year, month,
       CAST(sum(q) AS DOUBLE) AS rain_mm, CAST(max(q) AS DOUBLE) AS max_3day_rain_mm,
       CAST(round(sum(q) / 3.0, 3) AS DOUBLE) AS rain_pct_normal, round(avg(disc) * 10, 3) AS soil_wetness_before,
       CAST(5 + (max(cell) * 53) % 900 AS DOUBLE) AS elevation_m,
       round(CAST(count(*) % 11 AS DOUBLE) / 10, 2) AS prior_flood_rate,
       CAST(CASE WHEN sum(q) % 10 < 3 THEN 1 ELSE 0 END AS BIGINT) AS flood,
       CAST(CASE WHEN sum(q) % 40 < 3 THEN 1 ELSE 0 END AS BIGINT) AS deadly,
       round(CAST((sum(q) * 7) % 1000 AS DOUBLE) / 1999 + CASE WHEN sum(q) % 10 < 3 THEN 0.45 ELSE 0 END, 3) AS probability
FROM (SELECT 'D' || lpad(CAST(l_suppkey % 25 AS STRING), 2, '0') AS district,
             'State ' || CAST((l_suppkey % 25) % 6 AS STRING) AS state, l_suppkey % 20 AS cell,
             CAST(year(l_shipdate) AS BIGINT) AS year, CAST(month(l_shipdate) AS BIGINT) AS month,
             CAST(l_quantity AS BIGINT) AS q, l_discount AS disc
      FROM {lineitem}) t
GROUP BY district, state, year, month
"""


# Storms reduced from the track points.
VIEWS["storms"] = """
SELECT sid, name, season, basin, genesis_date, month, year, lmi_latitude, lmi_longitude, max_wind_kt, category, decade
FROM (SELECT sid, CASE WHEN max(name) = 'NOT_NAMED' THEN 'Unnamed' ELSE 'Storm ' || substr(max(name), 7) END AS name,
             max(season) AS season, coalesce(max(basin), '') AS basin, CAST(min(iso_time) AS DATE) AS genesis_date,
             CAST(month(min(iso_time)) AS BIGINT) AS month, CAST(year(min(iso_time)) AS BIGINT) AS year,
             min(lat) AS lmi_latitude, min(lon) AS lmi_longitude,
             CAST(floor(max(coalesce(usa_wind, wmo_wind))) AS BIGINT) AS max_wind_kt,
             CAST(CASE WHEN max(usa_wind) >= 137 THEN 5 WHEN max(usa_wind) >= 113 THEN 4 WHEN max(usa_wind) >= 96 THEN 3
                       WHEN max(usa_wind) >= 83 THEN 2 WHEN max(usa_wind) >= 64 THEN 1 ELSE 0 END AS BIGINT) AS category,
             CAST(floor(max(season) / 10) * 10 AS BIGINT) AS decade
      FROM {track_points} WHERE track_type = 'main' GROUP BY sid) t
WHERE max_wind_kt >= 34
"""

# Event export with gaps in month and day, and dates that do not exist.
VIEWS["event_export"] = """
SELECT CASE o_orderstatus WHEN 'F' THEN 'Earthquake' WHEN 'O' THEN 'Flood' ELSE 'Storm' END AS disaster_type,
       CASE o_orderkey % 3 WHEN 0 THEN 'Tropical Cyclone' WHEN 1 THEN 'Tornado' END AS disaster_subtype,
       CAST(year(o_orderdate) AS STRING) AS start_year,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(month(o_orderdate) AS STRING) END AS start_month,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '31'
            ELSE CAST(day(o_orderdate) AS STRING) END AS start_day,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 500 AS STRING) END AS total_deaths,
       'C' || CAST(o_custkey % 50 AS STRING) AS country
FROM {orders}
"""


# A small gazetteer, messy spellings of its names, and a numbered event inventory.
VIEWS["gazetteer"] = """
SELECT n_nationkey AS nk, s.state, p.name
FROM {nation}
JOIN (VALUES (0, 'Andhra Pradesh'), (1, 'Telangana'), (2, 'Kerala'), (3, 'Odisha'), (4, 'Goa')) s(k, state)
  ON s.k = CAST(floor(n_nationkey / 5) AS INT)
JOIN (VALUES (0, 'Alder Hill'), (1, 'Brookvale'), (2, 'Cedarpoint'), (3, 'Dunmoor'), (4, 'Elmgrove'), (5, 'Fernridge'),
             (6, 'Glenford'), (7, 'Hazelwood'), (8, 'Ironbridge'), (9, 'Juniper Coast'), (10, 'Kestrel Bay'),
             (11, 'Larkfield'), (12, 'Marshgate'), (13, 'Northwick'), (14, 'Oakhampton'), (15, 'Pinehurst'),
             (16, 'Quarrydale'), (17, 'Rosemount'), (18, 'Saltmarsh'), (19, 'Thornbury')) p(k, name)
  ON p.k = n_nationkey % 20
"""

VIEWS["aliases"] = """
SELECT 'ifi' AS source, 'Old ' || name AS name, state AS geo_state, name AS geo_name FROM {gazetteer} WHERE nk % 4 = 1
UNION ALL SELECT 'ifi', 'Twin ' || name, state, name FROM {gazetteer} WHERE nk IN (6, 7)
UNION ALL SELECT 'ifi', 'Seven Isles', '', '-' FROM {gazetteer} WHERE nk = 0
UNION ALL SELECT 'ifi', 'Upland', '', '~' FROM {gazetteer} WHERE nk = 0
"""

VIEWS["listed_names"] = """
SELECT CAST(c_custkey AS BIGINT) AS event, 'ifi' AS source,
       CASE WHEN v = 3 AND g.state = 'Odisha' THEN 'Orissa' WHEN v = 4 THEN 'Assam' WHEN v = 9 THEN g.state || '; Assam'
            ELSE g.state END AS states,
       CASE v WHEN 1 THEN upper(g.name) || ' (Rural)' WHEN 2 THEN 'Old Old ' || g.name
              WHEN 5 THEN 'Parts of ' || g.name WHEN 6 THEN g.name || 'x' WHEN 7 THEN g.name || ' ' || h.name
              WHEN 8 THEN '14 districts' WHEN 9 THEN 'Seven  Isles' WHEN 10 THEN replace(g.name, 'e', 'é')
              WHEN 11 THEN 'Zzyzx & Qux' ELSE g.name END AS name
FROM (SELECT c_custkey, c_nationkey, CAST(c_custkey % 12 AS INT) AS v FROM {customer}) c
JOIN {gazetteer} g ON g.nk = c.c_nationkey
JOIN {gazetteer} h ON h.nk = 5 * CAST(floor(c.c_nationkey / 5) AS INT) + (c.c_nationkey + 1) % 5
"""

VIEWS["inventory"] = """
SELECT 'UEI-IMD-' || CAST(CAST(floor(k / 500000) AS BIGINT) AS STRING) || '-' || CAST(yr AS STRING) || '-'
           || lpad(CAST(seq AS STRING), 4, '0') AS uei,
       yr, seq, state,
       CASE WHEN k % 17 = 0 THEN 'unknown' WHEN k % 5 = 0 THEN lpad(CAST(mon AS STRING), 2, '0') || '-'
              || lpad(CAST(dom AS STRING), 2, '0') || '-' || CAST(yr AS STRING)
            ELSE lpad(CAST(dom AS STRING), 2, '0') || '-' || lpad(CAST(mon AS STRING), 2, '0') || '-'
              || CAST(yr AS STRING) || ' 00:00' END AS start_text,
       lpad(CAST(least(dom + 2 + k % 9, 28) AS STRING), 2, '0') || '-' || lpad(CAST(mon AS STRING), 2, '0') || '-'
              || CAST(yr AS STRING) AS end_text,
       CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(1 + k % 30 AS DOUBLE) END AS duration,
       CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(k % 40 AS DOUBLE) END AS deaths
FROM (SELECT c_custkey AS k, 1967 + c_custkey % 57 AS yr,
             CAST(floor((c_custkey % 500000) / 57) AS BIGINT) AS seq,
             1 + CAST(floor((c_custkey % 684) / 57) AS BIGINT) AS mon, 1 + c_custkey % 28 AS dom,
             'State ' || CAST(CAST(floor((c_custkey % 500000) / 228) AS BIGINT) % 7 AS STRING) AS state
      FROM {customer}) t
"""


# Readings of live events: up to three of one real event, shifted by seconds and tenths of a degree.
VIEWS["live_readings"] = """
SELECT CASE WHEN type = 'earthquake' AND r = 0 THEN 'usgs' WHEN type = 'earthquake' OR r <= 1 THEN 'gdacs' ELSE 'eonet' END
           AS source,
       'R' || CAST(event_id AS STRING) AS source_id, type, event_id AS seq,
       CASE WHEN type = 'cyclone' THEN 'Tropical Cyclone NAME' || CAST(g % 40 AS STRING) || 'X-24'
            ELSE 'Event ' || CAST(g AS STRING) END AS title,
       CASE WHEN r = 1 THEN NULL ELSE 'Place ' || CAST(g % 90 AS STRING) END AS location,
       CASE WHEN type = 'flood' AND r = 2 AND g % 5 = 0 THEN NULL
            ELSE CAST((g * 37) % 1400 AS DOUBLE) / 10 - 70 + r * 0.1 END AS latitude,
       CASE WHEN type = 'flood' AND r = 2 AND g % 5 = 0 THEN NULL
            ELSE CAST((g * 73) % 3600 AS DOUBLE) / 10 - 180 + r * 0.1 END AS longitude,
       1704067200 + (g * 997) % 2592000 + r * 40 AS at_s,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE 1704067200 + (g * 997) % 2592000 + r * 3600 END AS updated_at,
       CASE WHEN type = 'earthquake' AND r = 0 THEN NULL WHEN r = 2 AND type <> 'earthquake' THEN NULL
            ELSE CASE g % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'orange' ELSE 'green' END END AS alert,
       CASE WHEN type = 'earthquake' THEN 45 + (g * 7) % 36 + r END AS mag_tenths,
       CASE WHEN type = 'flood' AND r >= 1 THEN CAST(g AS STRING) WHEN type <> 'flood' AND r = 1 THEN CAST(g AS STRING) END
           AS gdacs_event_id,
       CASE WHEN type = 'cyclone' AND r <= 1 THEN 'NAME' || CAST(g % 40 AS STRING) || 'X-24' END AS storm_name,
       CASE WHEN type = 'cyclone' THEN 60 + g % 120 END AS wind_kmh
FROM (SELECT event_id, CAST(floor(event_id / 3) AS BIGINT) AS g, event_id % 3 AS r,
             CASE CAST(floor(event_id / 3) AS BIGINT) % 3 WHEN 0 THEN 'earthquake' WHEN 1 THEN 'flood' ELSE 'cyclone' END AS type
      FROM {events}) e
"""

VIEWS["attempts"] = """
SELECT CASE WHEN event_type IN ('view', 'purchase') THEN 'usgs' WHEN event_type IN ('click', 'signup') THEN 'gdacs' ELSE 'eonet' END AS source,
       CAST(floor(event_id / 5) AS BIGINT) * 60 + 1704067200 AS at_s,
       event_type <> 'error' AND user_id % 4 <> 0 AS ok, CAST(user_id AS BIGINT) AS events,
       CASE WHEN event_type = 'error' OR user_id % 4 = 0 THEN 'Timeout' END AS error, event_id
FROM {events}
"""


# Response desk: people, plans with needs, tasks and their updates.
VIEWS["responders"] = """
SELECT 'P' || CAST(c_custkey AS STRING) AS id, c_name AS name,
       CASE c_mktsegment WHEN 'FURNITURE' THEN 'Transporter' WHEN 'HOUSEHOLD' THEN 'Medical' WHEN 'MACHINERY' THEN 'Rescue'
            WHEN 'BUILDING' THEN 'NGO' ELSE 'Volunteer' END AS role,
       CASE WHEN c_custkey % 6 = 0 THEN '' ELSE ' City ' || CAST(c_custkey % 40 AS STRING) END AS city,
       'State ' || CAST(c_nationkey % 6 AS STRING) AS state,
       CASE c_custkey % 3 WHEN 0 THEN 'now' WHEN 1 THEN '2hrs' ELSE 'unavailable' END AS availability,
       CAST(c_custkey % 120001 AS BIGINT) AS capacity, CASE WHEN c_custkey % 10 = 0 THEN '12' ELSE '+91 98765-4321' END AS phone
FROM {customer}
"""

VIEWS["plan_needs"] = """
SELECT 'plan' || CAST(n_nationkey AS STRING) AS plan_id, 'n' || CAST(k AS STRING) AS need_id,
       'plan' || CAST(n_nationkey AS STRING) || ':n' || CAST(k AS STRING) AS key, 'city ' || CAST(n_nationkey AS STRING) AS area,
       'State ' || CAST(n_nationkey % 6 AS STRING) AS state,
       CASE (n_nationkey + k) % 4 WHEN 0 THEN 'transport' WHEN 1 THEN 'medical' WHEN 2 THEN 'food' ELSE 'other' END AS category
FROM {nation} JOIN (VALUES (1), (2), (3), (4)) v(k) ON k <= 1 + n_nationkey % 4
"""

VIEWS["tasks"] = """
SELECT 'T' || CAST(o_orderkey AS STRING) AS task_id, o_orderkey AS number, 'plan' || CAST(o_orderkey % 25 AS STRING) AS plan_id,
       'n' || CAST(1 + o_orderkey % 4 AS STRING) AS need_id, 'P' || CAST(o_custkey AS STRING) AS assignee_id,
       CASE greatest((o_orderkey % 25 * 3 + o_orderkey % 4) % 5 - o_orderkey % 3 % 2, 0) WHEN 0 THEN 'assigned'
            WHEN 1 THEN 'accepted' WHEN 2 THEN 'collected' WHEN 3 THEN 'in_transit' ELSE 'delivered' END AS status,
       CAST(o_orderdate AS TIMESTAMP) AS deadline
FROM {orders}
"""

VIEWS["updates"] = """
SELECT event_id AS update_id, 'T' || CAST(user_id AS STRING) AS task_id,
       CASE event_type WHEN 'view' THEN 'accepted' WHEN 'click' THEN 'collected' WHEN 'purchase' THEN 'in_transit'
            WHEN 'signup' THEN 'delivered' ELSE 'lost' END AS status,
       'note ' || CAST(event_id AS STRING) AS note, CASE WHEN event_id % 3 = 0 THEN 'photo' ELSE '' END AS photo,
       value AS lat, value AS lon, CAST(ts AS TIMESTAMP) AS at_time
FROM {events}
"""


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or one of the views above, as a lazy DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    df = spark.sql(text, **{n: view(spark, sf_dir, n) for n in _needs(text)})
    return df.toDF(*df.columns)  # drops the text's table aliases


def with_views(sql: str) -> str:
    """Turn SQL with ``{view}`` marks into one statement with the views as CTEs."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in BASE or name in done:
            return
        for need in _needs(VIEWS[name]):
            add(need)
        done[name] = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])

    for need in _needs(sql):
        add(need)
    body = re.sub(r"\{(\w+)\}", r"\1", sql).strip()
    if not done:
        return body
    ctes = ",\n".join(f"{name} AS ({text.strip()})" for name, text in done.items())
    if start := re.match(r"(?i)with(\s+recursive)?\s", body):
        return f"WITH{start[1] or ''} {ctes},\n{body[start.end():]}"
    return f"WITH {ctes}\n{body}"
