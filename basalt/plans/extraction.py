"""Queries over extraction: reports made of orders and line items, and all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.operators import extract as X
from basalt.plans.common import longs, table, words_sql

Q, O = {}, {}
_lit = lambda s: "'" + s.replace("'", "''") + "'"

FRAGMENTS = [
    "Failure mode: bearing wear. Root cause: misaligned shaft. Corrective action: replaced BRG-204 and MS-7. Severity: high. Downtime: 7.5 hours",
    "The pump tripped, caused by a seal leak. Action taken: flushed lines. Recommended: check the seal. cost: $1,200.50",
    "Inspected by Ada Lovelace. Manufacturer: Acme Works\nModel no: X-9 \nArea: North\nOperating hours: 8,100\nHealth score 82",
    "Work order closed. Replaced BRG-11 after vibration. Engineer: Grace Hopper. 3 hours downtime. critical severity",
    "make: Bolt & Co\nserial number: S/N 77-A.\npressure rating: 16 bar\nwarranty expiry: 2031-01-05\nPower: 45 kW -",
]
DATE_SQL = "CASE o_orderkey % 3 WHEN 0 THEN '20' || lpad(CAST(o_orderkey % 25 AS VARCHAR), 2, '0') || '-' || (1 + o_custkey % 12) || '-' || (1 + o_orderkey % 28) WHEN 1 THEN (1 + o_orderkey % 28) || ' ' || (['January', 'feb', 'Mar', 'April', 'MAY', 'june', 'Jul', 'August', 'Sept', 'October', 'Nov', 'december'])[1 + o_custkey % 12] || ' 20' || lpad(CAST(o_orderkey % 25 AS VARCHAR), 2, '0') ELSE 'no date' END"


def reports(spark, d):
    """(doc, text): one report for each order, with an asset or two, a date in some notation and a fragment."""
    month = F.element_at(F.array(*map(F.lit, ["January", "feb", "Mar", "April", "MAY", "june", "Jul", "August", "Sept", "October", "Nov", "december"])), (F.pmod("o_custkey", F.lit(12)) + 1).cast("int"))
    year, day = F.concat(F.lit("20"), F.lpad(F.pmod("o_orderkey", F.lit(25)).cast("string"), 2, "0")), 1 + F.pmod("o_orderkey", F.lit(28))
    k = F.pmod("o_orderkey", F.lit(3))
    date = F.when(k == 0, F.concat_ws("-", year, 1 + F.pmod("o_custkey", F.lit(12)), day)).when(k == 1, F.concat_ws(" ", day, month, year)).otherwise("no date")
    fragment = F.element_at(F.array(*map(F.lit, FRAGMENTS)), (F.pmod("o_orderkey", F.lit(len(FRAGMENTS))) + 1).cast("int"))
    text = F.concat(F.lit("WO-"), F.col("o_orderkey"), F.lit(" on P-"), F.lpad(F.pmod("o_custkey", F.lit(40)).cast("string"), 3, "0"), F.lit(" near valve FI-"), 10 + F.pmod("o_custkey", F.lit(80)), F.lit(", SOP-12, "), date, F.lit("\n"), fragment, F.lit("\n"), F.col("o_orderpriority"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), text.alias("text"))


REPORTS_SQL = f"rp AS (SELECT o_orderkey AS doc, 'WO-' || o_orderkey || ' on P-' || lpad(CAST(o_custkey % 40 AS VARCHAR), 3, '0') || ' near valve FI-' || (10 + o_custkey % 80) || ', SOP-12, ' || {DATE_SQL} || chr(10) || ([{', '.join(_lit(f).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39)) for f in FRAGMENTS)}])[1 + o_orderkey % {len(FRAGMENTS)}] || chr(10) || o_orderpriority AS text FROM orders)"


def first_sql(patterns, strip):
    return "CASE " + " ".join(f"WHEN regexp_matches(text, {_lit('(?i)' + p)}) THEN trim(regexp_extract(text, {_lit('(?i)' + p)}, 1), {_lit(strip)})" for p in patterns) + " ELSE '' END"


Q["guess_date"] = lambda spark, d: reports(spark, d).select("doc", X.guess_date(F.col("text")).alias("date"))
_g = lambda p, n: f"regexp_extract(text, {_lit(p)}, {n})"
GUESS_SQL = f"CASE WHEN regexp_matches(text, {_lit(X.ISO_DATE)}) THEN {_g(X.ISO_DATE, 1)} || '-' || lpad({_g(X.ISO_DATE, 2)}, 2, '0') || '-' || lpad({_g(X.ISO_DATE, 3)}, 2, '0') WHEN regexp_matches(text, {_lit(X.NAMED_DATE)}) THEN {_g(X.NAMED_DATE, 3)} || '-' || lpad(CAST(list_position([{words_sql(X.MONTHS)}], lower({_g(X.NAMED_DATE, 2)})) AS VARCHAR), 2, '0') || '-' || lpad({_g(X.NAMED_DATE, 1)}, 2, '0') ELSE '' END"
O["guess_date"] = f"WITH {REPORTS_SQL} SELECT doc, {GUESS_SQL} AS date FROM rp"

Q["metadata_fields"] = lambda spark, d: X.metadata(reports(spark, d), "doc", "text")
O["metadata_fields"] = f"WITH {REPORTS_SQL} SELECT doc, " + ", ".join(f"{first_sql(ps, ' .;:-')} AS {n}" for n, ps in X.METADATA.items()) + " FROM rp"


def raw_answers(spark, d):
    p, k = F.coalesce("props", F.lit("")), F.pmod("event_id", F.lit(5))
    text = F.when(k == 0, F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```\nDone."))).when(k == 1, F.concat(F.lit("Here [1] is "), p)).when(k == 2, F.concat(F.lit("["), p, F.lit(", "), p, F.lit("] as asked"))).when(k == 3, p).otherwise("no payload")
    return table(spark, d, "events").select("event_id", text.alias("text"))


Q["payload_repair"] = lambda spark, d: longs(raw_answers(spark, d).select("event_id", X.payload(F.col("text")).alias("payload"), F.size(X.payload_rows(F.col("text"))).alias("rows")))
O["payload_repair"] = """WITH r AS (SELECT event_id, coalesce(props, '') AS p, event_id % 5 AS k FROM events), t AS (SELECT event_id, trim(CASE k WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || p || chr(10) || '```' || chr(10) || 'Done.' WHEN 1 THEN 'Here [1] is ' || p WHEN 2 THEN '[' || p || ', ' || p || '] as asked' WHEN 3 THEN p ELSE 'no payload' END) AS t FROM r),
f AS (SELECT event_id, CASE WHEN regexp_matches(t, '(?s)```(?:json)?\\s*(.*?)```') THEN trim(regexp_extract(t, '(?s)```(?:json)?\\s*(.*?)```', 1)) ELSE t END AS t FROM t),
b AS (SELECT event_id, t, CASE WHEN contains(t, '[') THEN instr(t, '[') ELSE instr(t, '{') END AS a, greatest(CASE WHEN contains(t, ']') THEN length(t) - instr(reverse(t), ']') + 1 ELSE 0 END, CASE WHEN contains(t, '}') THEN length(t) - instr(reverse(t), '}') + 1 ELSE 0 END) AS z FROM f),
p AS (SELECT event_id, CASE WHEN a > 0 AND z > a THEN substr(t, a, z - a + 1) ELSE t END AS payload FROM b), w AS (SELECT event_id, payload, CASE WHEN starts_with(payload, '{') THEN '[' || payload || ']' ELSE payload END AS j FROM p)
SELECT event_id, payload, CASE WHEN json_valid(j) AND json_type(j) = 'ARRAY' THEN CAST(json_array_length(j) AS BIGINT) ELSE 0 END AS rows FROM w"""

Q["salient_terms"] = lambda spark, d: longs(table(spark, d, "conversations").select("conv_id", "turn", X.salient_terms(F.col("text")).alias("t")).select("conv_id", "turn", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("terms_md5")))
O["salient_terms"] = f"SELECT conv_id, turn, len(t) AS n, md5(array_to_string(t, ' ')) AS terms_md5 FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9.\\-]{{2,}}|[0-9]+(?:\\.[0-9]+)?'), lambda t: (regexp_matches(t, '[0-9]') OR regexp_matches(t, '^[A-Z]') OR length(t) >= 6) AND lower(t) NOT IN ({words_sql(X.SALIENT_STOP)})) AS t FROM conversations)"


def known_assets(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.lit("FI-"), F.col("s_suppkey")).alias("asset"))


_PRE = "CASE split_part(asset, '-', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.PREFIX_TYPES.items())
_NEAR = " ".join(f"WHEN contains(around, '{w}') THEN '{t}'" for w, t in X.NEARBY_TYPES)
ASSETS_SQL = f"""tags AS (SELECT doc, text, unnest(regexp_extract_all(coalesce(text, ''), {_lit(X.ASSET_TAG)})) AS asset FROM rp), an AS (SELECT doc, asset, count(*) AS n, any_value(lower(text)) AS low FROM tags WHERE split_part(asset, '-', 1) NOT IN ({words_sql(X.NOT_ASSETS)}) GROUP BY doc, asset),
aa AS (SELECT doc, asset, n, substr(low, greatest(1, instr(low, lower(asset)) - 100)) AS around FROM an),
ak AS (SELECT doc, asset, n, {_PRE} ELSE CASE {_NEAR} ELSE 'Equipment' END END AS type, round(CAST(least(0.98, 0.78 + 0.04 * least(n, 4)) AS DOUBLE), 2) AS confidence, asset IN (SELECT 'FI-' || s_suppkey FROM supplier) AS known FROM aa),
av AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY known DESC, n DESC, asset) AS place FROM ak)"""
Q["asset_candidates"] = lambda spark, d: longs(X.assets(reports(spark, d), "doc", "text", known_assets(spark, d)))
O["asset_candidates"] = f"WITH {REPORTS_SQL}, {ASSETS_SQL} SELECT * FROM av"


def drafted(spark, d):
    r = reports(spark, d)
    return X.events(r, X.assets(r, "doc", "text"), "doc", "text")


_EV = ", ".join(f"{first_sql(ps, ' .:-')} AS {n}" for n, ps in X.EVENT_FIELDS.items())
_DT = "coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract(text, {_lit('(?i)' + p)}, 1), '') AS DOUBLE)" for p in X.DOWNTIME) + ", 0.0)"
EVENTS_SQL = f"""{ASSETS_SQL}, ef AS (SELECT doc, {_EV}, {GUESS_SQL} AS date, CASE WHEN regexp_matches(text, {_lit(X.WORK_ORDER)}) THEN 'WO-' || regexp_extract(text, {_lit(X.WORK_ORDER)}, 1) ELSE '' END AS work_order, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, {_lit(X.PART)}), lambda x: upper(x)))), ',') AS parts_used, {_DT} AS downtime_hours FROM rp),
ev AS (SELECT ef.*, round(CAST(0.55 + CASE WHEN failure_mode <> '' THEN 0.1 ELSE 0 END + CASE WHEN corrective_action <> '' THEN 0.1 ELSE 0 END + CASE WHEN date <> '' THEN 0.1 ELSE 0 END AS DOUBLE), 2) AS confidence, asset FROM ef JOIN av USING (doc))"""
Q["event_extract"] = lambda spark, d: drafted(spark, d).withColumn("parts_used", F.array_join("parts_used", ","))
O["event_extract"] = f"WITH {REPORTS_SQL}, {EVENTS_SQL} SELECT * FROM ev"


def orchestrated(spark, d):
    """A model's events for pumps of even orders (some of unasked assets), drafts for all other assets."""
    drafts = drafted(spark, d).select("doc", "asset", "failure_mode", "confidence")
    given = drafts.where("doc % 2 = 0 and asset like 'P-%'").select("doc", F.when(F.pmod("doc", F.lit(8)) == 0, "P-999").otherwise(F.col("asset")).alias("asset"), F.lit("given").alias("failure_mode"), F.lit(0.9).alias("confidence"))
    return X.backfill(given, drafts, drafts)


Q["extract_orchestrate"] = orchestrated
O["extract_orchestrate"] = f"WITH {REPORTS_SQL}, {EVENTS_SQL} SELECT doc, asset, CASE WHEN g THEN 'given' ELSE failure_mode END AS failure_mode, CASE WHEN g THEN 0.9::DOUBLE ELSE confidence END AS confidence FROM (SELECT *, doc % 2 = 0 AND asset LIKE 'P-%' AND doc % 8 <> 0 AS g FROM ev)"

Q["page_lookup"] = lambda spark, d: X.page_of(pages(spark, d), needles(spark, d)).select("doc", F.md5("needle").alias("needle_md5"), "page")


def pages(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def needles(spark, d):
    """The longest word of each turn in capitals, and a word that stands nowhere."""
    word = F.array_max(F.transform(F.split(F.coalesce("text", F.lit("")), r"[ \t\n]+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.when(F.pmod("turn", F.lit(4)) == 0, "nowhere to be found").otherwise(F.translate(word, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("needle")).distinct()


O["page_lookup"] = """WITH n AS (SELECT DISTINCT conv_id AS doc, CASE WHEN turn % 4 = 0 THEN 'nowhere to be found' ELSE translate(list_max(list_transform(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n]+'), lambda w: {'n': length(w), 'w': w})).w, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS needle FROM conversations)
SELECT doc, md5(needle) AS needle_md5, coalesce(min(turn) FILTER (needle <> '' AND contains(lower(coalesce(text, '')), lower(needle))), min(turn)) AS page FROM n JOIN conversations ON conv_id = doc GROUP BY doc, needle"""

Q["safe_id"] = lambda spark, d: table(spark, d, "part").select("p_partkey", X.safe_id(F.concat(F.lit(" /"), "p_name", F.lit("/ "))).alias("id"))
O["safe_id"] = "SELECT p_partkey, trim(regexp_replace(upper(' /' || p_name || '/ '), '[^A-Za-z0-9_-]+', '-', 'g'), '-') AS id FROM part"

Q["asset_tag_filter"] = lambda spark, d: reports(spark, d).select("doc", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z]{1,3}-[0-9]+"), F.lit(0)))).alias("tag")).select("doc", "tag", X.is_asset(F.col("tag")).alias("asset"), X.is_asset(F.col("tag"), X.NOT_REGISTERED).alias("registered"))
O["asset_tag_filter"] = f"WITH {REPORTS_SQL}, t AS (SELECT doc, unnest(list_distinct(regexp_extract_all(text, '[A-Z]{{1,3}}-[0-9]+'))) AS tag FROM rp) SELECT doc, tag, split_part(tag, '-', 1) NOT IN ({words_sql(X.NOT_ASSETS)}) AS asset, split_part(tag, '-', 1) NOT IN ({words_sql(X.NOT_REGISTERED)}) AS registered FROM t"
