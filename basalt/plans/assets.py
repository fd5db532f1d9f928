"""Queries over maintenance, spares, events and telemetry (work orders: orders and line items; series: events)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from basalt.operators import assets as A
from basalt.operators import telemetry as M
from basalt.plans.common import longs, table

Q, O = {}, {}
KIND = "CASE o_orderpriority WHEN '1-URGENT' THEN 'corrective' WHEN '2-HIGH' THEN 'corrective' WHEN '3-MEDIUM' THEN 'inspection' ELSE 'preventive' END"


def work_orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("wo"), F.col("o_custkey").alias("asset"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.expr(KIND).alias("kind"), F.col("o_orderstatus").alias("mode"), (F.col("o_totalprice") / 1000).alias("hours"))


WO_SQL = f"wo AS (SELECT o_orderkey AS wo, o_custkey AS asset, strftime(o_orderdate, '%Y-%m-%d') AS date, {KIND} AS kind, o_orderstatus AS mode, o_totalprice / 1000 AS hours FROM orders)"

Q["wo_rollup"] = lambda spark, d: A.rollup(work_orders(spark, d), "asset", "hours", "date", "kind")
O["wo_rollup"] = f"WITH {WO_SQL} SELECT asset, count(*) AS work_orders, round(sum(hours), 1) AS downtime, max(date) AS last_date, max(date) FILTER (kind = 'preventive') AS last_preventive FROM wo GROUP BY asset"
Q["failure_modes"] = lambda spark, d: longs(A.failure_modes(work_orders(spark, d), "asset", "mode"))
O["failure_modes"] = f"WITH {WO_SQL}, n AS (SELECT asset, mode, count(*) AS n FROM wo GROUP BY asset, mode) SELECT asset, mode, n, row_number() OVER (PARTITION BY asset ORDER BY n DESC, mode) AS place FROM n"

Q["asset_profile"] = lambda spark, d: A.profile(table(spark, d, "customer").select(F.col("c_custkey").alias("asset")), work_orders(spark, d), "asset", "date", "wo")
O["asset_profile"] = f"WITH {WO_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC, wo) AS i FROM wo) SELECT c_custkey AS asset, count(wo) AS n_orders, coalesce(string_agg(CAST(wo AS VARCHAR), ',' ORDER BY i) FILTER (i <= 3), '') AS recent FROM customer LEFT JOIN r ON asset = c_custkey GROUP BY c_custkey"


def asset_health(spark, d):
    """Assets with a series are judged by it, others by their balance as a score."""
    recent = M.analyze(table(spark, d, "events"), "user_id", "ts", "value", alert=60, danger=75).select(F.col("user_id").alias("asset"), "recent_mean")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("asset"), F.round(F.col("c_acctbal") / 100, 2).alias("health_score")).join(recent, "asset", "left")
    return rows.select("asset", M.health(F.col("recent_mean"), F.col("health_score"), 60, 75).alias("health"), F.col("recent_mean").isNotNull().alias("monitored"))


SERIES_SQL = """
p AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
b AS (SELECT user_id, list_sort(list(value) FILTER (i < greatest(1, n // 2))) AS f, avg(value) FILTER (i >= n - 24) AS recent_mean, regr_slope(value, CAST(i AS DOUBLE)) FILTER (i >= n - 72) AS s, arg_max(value, i) AS latest, max(n) AS n FROM p GROUP BY user_id),
t AS (SELECT user_id, n, f[len(f) // 2 + 1] AS baseline, recent_mean, coalesce(s, 0.0) AS slope, latest FROM b)"""
Q["asset_health"] = asset_health
O["asset_health"] = f"WITH {SERIES_SQL}, c AS (SELECT c_custkey AS asset, round(c_acctbal / 100, 2) AS hs, round(recent_mean, 6) AS r FROM customer LEFT JOIN t ON user_id = c_custkey) SELECT asset, CASE WHEN r >= 75 THEN 'danger' WHEN r >= 60 THEN 'alert' WHEN r IS NOT NULL THEN 'healthy' WHEN hs >= 80 THEN 'healthy' WHEN hs >= 50 THEN 'alert' WHEN hs IS NOT NULL THEN 'danger' ELSE 'unknown' END AS health, r IS NOT NULL AS monitored FROM c"

Q["telemetry_analyze"] = lambda spark, d: M.analyze(table(spark, d, "events"), "user_id", "ts", "value", alert=60, danger=75)
O["telemetry_analyze"] = f"""WITH {SERIES_SQL} SELECT user_id, n, round(baseline, 6) AS baseline, round(recent_mean, 6) AS recent_mean, round(greatest(0.0, least(1.0, (recent_mean - baseline) / (75 - baseline))), 4) AS score,
recent_mean > 60 OR recent_mean - baseline > 0.8 AS anomalous, round(slope * 24, 6) AS slope_day, round(latest, 6) AS latest, round(CASE WHEN latest >= 75 THEN 0.0 WHEN slope > 0.0001 THEN (75 - latest) / slope END, 4) AS rul_hours FROM t"""

Q["maintenance_window"] = lambda spark, d: longs(M.analyze(table(spark, d, "events"), "user_id", "ts", "value", alert=60, danger=75).select("user_id", M.maintenance_window(F.col("rul_hours")).alias("days")))
O["maintenance_window"] = f"WITH {SERIES_SQL} SELECT user_id, CAST(greatest(1, trunc(coalesce(round(CASE WHEN latest >= 75 THEN 0.0 WHEN slope > 0.0001 THEN (75 - latest) / slope END, 4) / 24, 7.0) - 2)) AS BIGINT) AS days FROM t"

Q["series_tail"] = lambda spark, d: longs(M.tail(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 24).select("user_id", "event_id", "back"))
O["series_tail"] = "SELECT user_id, event_id, back FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 24"

Q["temperature_mean"] = lambda spark, d: M.temperature(table(spark, d, "events"), "user_id", "ts", "value", 55.0)
O["temperature_mean"] = "SELECT user_id, round(avg(value), 6) AS temp_mean, round(avg(value), 6) > 55.0 AS elevated FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS b FROM events) WHERE b <= 24 GROUP BY user_id"


def event_overlay(spark, d):
    base = work_orders(spark, d).select("wo", "asset", "kind", F.lit("csv").alias("origin"))
    events = table(spark, d, "lineitem").where("l_linenumber = 1 and l_returnflag = 'R'").select((F.col("l_orderkey") + F.when(F.col("l_linestatus") == "F", 0).otherwise(10_000_000)).alias("wo"), F.col("l_suppkey").alias("asset"), F.lit("inspection").alias("kind"), F.lit("event").alias("origin"))
    return A.overlay(base, events, "wo")


Q["event_overlay"] = event_overlay
O["event_overlay"] = f"WITH {WO_SQL}, v AS (SELECT l_orderkey + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 10000000 END AS wo, l_suppkey AS asset, 'inspection' AS kind, 'event' AS origin FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R') SELECT wo, asset, kind, 'csv' AS origin FROM wo WHERE wo NOT IN (SELECT wo FROM v) UNION ALL SELECT * FROM v"


def event_dedupe(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("asset"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_returnflag").alias("mode"), F.when(F.col("l_linestatus") == "O", "open").alias("cause"), F.col("l_linenumber"))
    return A.dedupe_events(rows.where("l_linenumber > 3"), rows.where("l_linenumber = 1"), ["asset", "month", "mode", "cause"], ["cause"]).select("asset", "month", "mode", "cause")


Q["event_dedupe"] = event_dedupe
O["event_dedupe"] = "WITH r AS (SELECT l_suppkey AS asset, strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS mode, CASE WHEN l_linestatus = 'O' THEN 'open' END AS cause, l_linenumber FROM lineitem) SELECT DISTINCT asset, month, mode, cause FROM r n WHERE l_linenumber > 3 AND cause IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r k WHERE k.l_linenumber = 1 AND k.asset = n.asset AND k.month = n.month AND k.mode = n.mode AND k.cause IS NOT DISTINCT FROM n.cause)"


def event_validate(spark, d):
    ev = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"), F.when(F.pmod("l_suppkey", F.lit(11)) != 0, F.col("l_suppkey")).alias("asset"), (F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 10_000_000).otherwise(0)).alias("part"), (F.col("l_orderkey") * 3).alias("wo"), F.when(F.pmod("l_orderkey", F.lit(13)) != 0, F.to_date("l_shipdate")).alias("date"))
    out = A.validate(ev, table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("asset")), table(spark, d, "part").select(F.col("p_partkey").alias("part")), table(spark, d, "orders").select(F.col("o_orderkey").alias("wo")), datetime.date(1998, 6, 1))
    return out.select("event_id", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"), "ok")


VALID_SQL = """ev AS (SELECT l_orderkey || '-' || l_linenumber AS event_id, CASE WHEN l_suppkey % 11 <> 0 THEN l_suppkey END AS asset, l_partkey + CASE WHEN l_linenumber = 7 THEN 10000000 ELSE 0 END AS part, l_orderkey * 3 AS wo, CASE WHEN l_orderkey % 13 <> 0 THEN CAST(l_shipdate AS DATE) END AS date FROM lineitem),
vd AS (SELECT event_id, concat_ws(';', CASE WHEN asset IS NULL THEN 'no asset' END, CASE WHEN date IS NULL THEN 'no date' END) AS errors,
 concat_ws(';', CASE WHEN asset IS NOT NULL AND asset NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) THEN 'unknown asset' END, CASE WHEN part NOT IN (SELECT p_partkey FROM part) THEN 'unknown part' END, CASE WHEN wo IN (SELECT o_orderkey FROM orders) THEN 'duplicate work order' END, CASE WHEN date > DATE '1998-06-01' THEN 'future date' END) AS warnings FROM ev)"""
Q["event_validate"] = event_validate
O["event_validate"] = f"WITH {VALID_SQL} SELECT event_id, errors, warnings, errors = '' AS ok FROM vd"
Q["commit_gate"] = lambda spark, d: A.batch_ok(event_validate(spark, d).withColumn("batch", F.split("event_id", "-")[0].cast("bigint")), "batch")
O["commit_gate"] = f"WITH {VALID_SQL} SELECT CAST(split_part(event_id, '-', 1) AS BIGINT) AS batch, bool_and(errors = '') AS commit FROM vd GROUP BY 1"


def spares(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), (F.col("p_size") * 2).cast("bigint").alias("qty"), F.pmod("p_partkey", F.lit(40)).cast("bigint").alias("least"))


Q["spares_low_stock"] = lambda spark, d: A.low_stock(spares(spark, d), "qty", "least")
O["spares_low_stock"] = "SELECT p_partkey AS part, CAST(p_size * 2 AS BIGINT) AS qty, p_partkey % 40 AS least FROM part WHERE p_size * 2 <= p_partkey % 40"
Q["spares_drawdown"] = lambda spark, d: A.drawdown(spares(spark, d), table(spark, d, "lineitem").where("l_linenumber = 2").select(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("bigint").alias("n")), "part", "qty", "least", "n")
O["spares_drawdown"] = "WITH u AS (SELECT l_partkey AS part, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS used FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) SELECT part, CAST(p_size * 2 AS BIGINT) AS before, used, CAST(greatest(0, p_size * 2 - used) AS BIGINT) AS after, greatest(0, p_size * 2 - used) <= p_partkey % 40 AS low_stock FROM part JOIN u ON part = p_partkey"
Q["spares_in_stock"] = lambda spark, d: table(spark, d, "part").groupBy("p_brand").agg(F.bool_and(F.col("p_size") >= 2).alias("in_stock"), F.count("*").alias("n"))
O["spares_in_stock"] = "SELECT p_brand, bool_and(p_size >= 2) AS in_stock, count(*) AS n FROM part GROUP BY p_brand"

Q["document_types"] = lambda spark, d: A.document_types(table(spark, d, "documents"), "doc_id", "text")
_q = lambda p: p.replace("'", "''")
_SIG = ", ".join(f"{{'k': '{_q(k)}', 'i': {i}, 's': CAST({' + '.join(f'CASE WHEN regexp_matches(t, {chr(39)}{_q(p)}{chr(39)}) THEN {w} ELSE 0 END' for p, w in rules)} AS DOUBLE)}}" for i, (k, rules) in enumerate(A.SIGNATURES.items()))
TYPES_SQL = f"""ds AS (SELECT doc, unnest([{_SIG}]) AS x FROM (SELECT doc, lower(coalesce(text, '')) AS t FROM dt)),
dr AS (SELECT doc, x.k AS k, x.s AS s, row_number() OVER (PARTITION BY doc ORDER BY x.s DESC, x.i) AS i, sum(x.s) OVER (PARTITION BY doc) AS total FROM ds),
dp AS (SELECT doc, max(k) FILTER (i = 1) AS k, max(s) FILTER (i = 1) AS top, max(s) FILTER (i = 2) AS second, max(total) AS total FROM dr GROUP BY doc),
ty AS (SELECT doc, CASE WHEN top > 0 THEN k ELSE '{A.GENERAL_TYPE}' END AS type, round(CASE WHEN top > 0 THEN least(0.98, 0.45 + 0.35 * top / total + 0.20 * (top - second) / top) ELSE 0.4 END, 2) AS confidence FROM dp)"""
O["document_types"] = f"WITH dt AS (SELECT doc_id AS doc, text FROM documents), {TYPES_SQL} SELECT doc, type, confidence, type IN ({', '.join(chr(39) + t + chr(39) for t in A.MAINTENANCE_TYPES)}) AS maintenance FROM ty"

Q["asset_detect"] = lambda spark, d: longs(A.detect_assets(table(spark, d, "documents"), "doc_id", "text", "[A-Z]{2,4}[0-9]{2,4}|[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"))
O["asset_detect"] = "WITH f AS (SELECT doc_id AS doc, unnest(regexp_extract_all(coalesce(text, ''), '[A-Z]{2,4}[0-9]{2,4}|[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')) AS asset FROM documents) SELECT doc, asset, count(*) AS n, round(CAST(least(0.98, 0.78 + 0.04 * least(count(*), 4)) AS DOUBLE), 2) AS confidence FROM f GROUP BY doc, asset"

Q["asset_timeline"] = lambda spark, d: A.timeline(work_orders(spark, d).select("asset", "date", F.col("kind").alias("label")), table(spark, d, "customer").select(F.col("c_custkey").alias("asset"), F.lit("1992-01-01").alias("date"), F.lit("installed").alias("label")))
O["asset_timeline"] = f"WITH {WO_SQL}, x AS (SELECT asset, date, kind AS label FROM wo UNION ALL SELECT c_custkey, '1992-01-01', 'installed' FROM customer) SELECT asset, string_agg(date || ' ' || label, '; ' ORDER BY date, label) AS entries FROM x GROUP BY asset"


def draft(spark, d):
    w = A.rollup(work_orders(spark, d), "asset", "hours", "date", "kind")
    risk = F.when(F.col("downtime") > 2000, "high").when(F.col("downtime") > 1000, "medium").otherwise("low")
    return w.select("asset", risk.alias("risk"), F.format_string("Inspect asset %d: %d orders, last %s", F.col("asset"), F.col("work_orders"), F.col("last_date")).alias("draft"))


Q["draft_work_order"] = draft
O["draft_work_order"] = f"WITH {WO_SQL}, r AS (SELECT asset, count(*) AS n, round(sum(hours), 1) AS dt, max(date) AS l FROM wo GROUP BY asset) SELECT asset, CASE WHEN dt > 2000 THEN 'high' WHEN dt > 1000 THEN 'medium' ELSE 'low' END AS risk, 'Inspect asset ' || asset || ': ' || n || ' orders, last ' || l AS draft FROM r"


def normalised(spark, d):
    raw = table(spark, d, "lineitem").where("l_linenumber <= 2").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"), F.concat(F.lit(" s-"), "l_suppkey").alias("asset_id"), F.expr("CASE l_returnflag WHEN 'A' THEN 'Breakdown repair' WHEN 'R' THEN 'Preventive' ELSE '' END").alias("event_type"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("date"), F.concat(F.lit("P-"), "l_partkey", F.lit(" x2; none")).alias("parts_used"), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int").cast("string")).otherwise("n/a").alias("downtime_hours"), F.col("l_quantity").cast("int").cast("string").alias("confidence"))
    out = A.normalise_event(raw)
    return out.select("event_id", "asset_id", "event_type", F.date_format("date", "yyyy-MM-dd").alias("date"), F.array_join("parts_used", ",").alias("parts_used"), "downtime_hours", "confidence")


Q["event_normalize"] = normalised
O["event_normalize"] = "SELECT l_orderkey || '-' || l_linenumber AS event_id, 'S-' || l_suppkey AS asset_id, CASE l_returnflag WHEN 'A' THEN 'corrective' WHEN 'R' THEN 'preventive' ELSE 'event' END AS event_type, strftime(l_shipdate, '%Y-%m-%d') AS date, 'P-' || l_partkey AS parts_used, CASE WHEN l_quantity > 10 THEN CAST(trunc(l_quantity) AS DOUBLE) ELSE 0.0 END AS downtime_hours, round(CASE WHEN trunc(l_quantity) > 1 THEN trunc(l_quantity) / 100 ELSE trunc(l_quantity) END, 4) AS confidence FROM lineitem WHERE l_linenumber <= 2"
