"""Extraction from maintenance documents: dates, labelled fields, payloads, assets and draft events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import text as T

# Patterns and tables of the specification; the first pattern that is met gives a field's value.
ASSET_TAG = r"\b[A-Z]{1,3}-[0-9]{2,3}\b"
NOT_ASSETS = ["BRG", "MS", "CE", "VG", "SEAL", "GKT", "BLT", "SOP", "SAF", "WO", "HS", "MCC", "PM", "RCA"]
NOT_REGISTERED = ["SOP", "SAF", "WO", "RCA", "BRG", "MS", "GKT", "BLT", "API", "ISO", "ASME", "ANSI", "CE", "CX", "IEC", "NEMA"]
PREFIX_TYPES = {
    "T": "Tank", "M": "Motor", "FI": "Instrument", "PI": "Instrument", "TI": "Instrument", "TT": "Instrument", "LT": "Instrument", "PT": "Instrument", "FT": "Instrument",
    "TANK": "Tank", "MOTOR": "Motor", "PUMP": "Pump", "COMPRESSOR": "Compressor", "VALVE": "Valve", "EXCHANGER": "Exchanger", "FAN": "Fan", "BLOWER": "Blower",
}
NEARBY_TYPES = [("compressor", "Compressor"), ("pump", "Pump"), ("heat exchanger", "Exchanger"), ("valve", "Valve"), ("tank", "Tank"), ("motor", "Motor"), ("fan", "Fan")]
METADATA = {
    "manufacturer": [r"manufacturer\s*[:#-]\s*([^\n]{2,80})", r"make\s*[:#-]\s*([^\n]{2,80})"],
    "vendor": [r"vendor\s*[:#-]\s*([^\n]{2,80})", r"supplier\s*[:#-]\s*([^\n]{2,80})"],
    "model_number": [r"model\s*(?:number|no\.?|#)?\s*[:#-]\s*([^\n]{2,80})"],
    "serial_number": [r"serial\s*(?:number|no\.?|#)?\s*[:#-]\s*([^\n]{2,80})"],
    "area": [r"\barea\s*[:#-]\s*([^\n]{2,80})"],
    "location": [r"\blocation\s*[:#-]\s*([^\n]{2,80})"],
    "department": [r"\bdepartment\s*[:#-]\s*([^\n]{2,80})"],
    "pressure_rating": [r"pressure\s*(?:rating)?\s*[:#-]\s*([^\n]{2,80})"],
    "temperature_rating": [r"temperature\s*(?:rating)?\s*[:#-]\s*([^\n]{2,80})"],
    "capacity": [r"\bcapacity\s*[:#-]\s*([^\n]{2,80})"],
    "flow_rate": [r"flow\s*(?:rate)?\s*[:#-]\s*([^\n]{2,80})"],
    "motor_power": [r"motor\s*power\s*[:#-]\s*([^\n]{2,80})", r"\bpower\s*[:#-]\s*([^\n]{2,80})"],
    "installation_date": [r"install(?:ation|ed)?\s*date\s*[:#-]\s*([^\n]{2,50})"],
    "service_date": [r"service\s*date\s*[:#-]\s*([^\n]{2,50})"],
    "inspection_date": [r"inspection\s*date\s*[:#-]\s*([^\n]{2,50})"],
    "failure_date": [r"failure\s*date\s*[:#-]\s*([^\n]{2,50})"],
    "engineer": [r"engineer\s*[:#-]\s*([^\n]{2,80})"],
    "supervisor": [r"supervisor\s*[:#-]\s*([^\n]{2,80})"],
    "operating_hours": [r"operating\s*hours?\s*[:#-]\s*([^\n]{2,50})"],
    "warranty_expiry": [r"warranty\s*(?:expiry|expiration|end)\s*[:#-]\s*([^\n]{2,50})"],
    "maintenance_frequency": [r"maintenance\s*frequency\s*[:#-]\s*([^\n]{2,80})"],
    "operating_conditions": [r"operating\s*conditions?\s*[:#-]\s*([^\n]{2,120})"],
    "criticality": [r"criticality\s*[:#-]\s*([^\n]{2,40})"],
    "health_score": [r"health\s*score\s*[:#-]?\s*([0-9]{1,3})"],
}
EVENT_FIELDS = {
    "failure_mode": [r"failure\s*mode[:\s]+([^\n.]{3,60})", r"\b(bearing failure|seal leak|tube fouling|misalignment|overheating|vibration)\b"],
    "root_cause": [r"root\s*cause[:\s]+([^\n.]{3,80})", r"\bcaused?\s+by\s+([^\n.]{3,80})", r"\bcause[:\s]+([^\n.]{3,80})"],
    "corrective_action": [r"corrective\s*action[:\s]+([^\n.]{3,100})", r"\baction\s*(?:taken)?[:\s]+([^\n.]{3,100})", r"\b(replaced?[^\n.]{3,80})"],
    "preventive_action": [r"preventive\s*action[:\s]+([^\n.]{3,100})", r"recommend(?:ed|ation)?[:\s]+([^\n.]{3,100})"],
    "severity": [r"severity[:\s]+([^\n.]{2,20})", r"\b(critical|high|medium|low)\s+severity\b"],
    "engineer": [r"engineer[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", r"(?:performed|carried out|inspected)\s+by[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"],
    "cost": [r"cost[:\s]*((?:USD|INR|Rs|\$|₹)?\s?[0-9,]+(?:\.[0-9]+)?)"],
}
WORK_ORDER, PART = r"\bWO-?([0-9]+)\b", r"\b(?:BRG|MS|GKT|BLT)-[0-9]+\b"
DOWNTIME = [r"\bdowntime[:\s]*([0-9.]+)\s*(?:h|hours?)\b", r"\b([0-9.]+)\s*hours?\s+downtime\b"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ISO_DATE, NAMED_DATE = r"\b(20[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})\b", r"(?i)\b([0-9]{1,2})\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(20[0-9]{2})\b"
SALIENT_STOP = (
    "the and for with this that from which into your their there here these those should would could about above below before after while when where what "
    "have has been being are was were will must may not any all each per via over under within also such more most than then requires required require using "
    "used based value values check checked provide provides including"
).split()
# End of fixed values.


def first_match(text: Column, patterns: list[str], strip: str) -> Column:
    """What the first of the patterns that is met takes out, without signs at its ends; empty if none is."""
    out = None
    for p in patterns:
        p = "(?i)" + T.ascii_boundaries(p)
        value = F.btrim(F.regexp_extract(text, p, 1), F.lit(strip))
        out = F.when(text.rlike(p), value) if out is None else out.when(text.rlike(p), value)
    return out.otherwise("")


def guess_date(text: Column) -> Column:
    """The first ISO date of a running text, else the first one with a named month, as yyyy-MM-dd; else empty."""
    iso, named = T.ascii_boundaries(ISO_DATE), T.ascii_boundaries(NAMED_DATE)
    two = lambda p, g: F.lpad(F.regexp_extract(text, p, g), 2, "0")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, named, 2)))
    a = F.concat_ws("-", F.regexp_extract(text, iso, 1), two(iso, 2), two(iso, 3))
    b = F.concat_ws("-", F.regexp_extract(text, named, 3), F.lpad(month.cast("string"), 2, "0"), two(named, 1))
    return F.when(text.rlike(iso), a).when(text.rlike(named), b).otherwise("")


def metadata(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, one column for each labelled field): only what is stated; blanks stay."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc"), *(first_match(t, ps, " .;:-").alias(n) for n, ps in METADATA.items()))


def payload(raw: Column) -> Column:
    """The JSON payload of an answer that may be fenced or surrounded by prose."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    t = F.when(t.rlike(fence), F.trim(F.regexp_extract(t, fence, 1))).otherwise(t)
    start = F.when(F.contains(t, F.lit("[")), F.instr(t, "[")).otherwise(F.instr(t, "{"))
    end = F.greatest(*(F.when(F.contains(t, F.lit(c)), F.length(t) - F.instr(F.reverse(t), c) + 1).otherwise(0) for c in "]}"))
    return F.when((start > 0) & (end > start), F.substring(t, start, end - start + 1)).otherwise(t)


def payload_rows(raw: Column) -> Column:
    """The payload's objects as maps of strings; none if it can't be read."""
    p = payload(raw)
    whole = F.when(F.startswith(p, F.lit("{")), F.concat(F.lit("["), p, F.lit("]"))).otherwise(p)
    return F.coalesce(F.from_json(whole, "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))


def salient_terms(text: Column) -> Column:
    """Terms that carry what can be checked: with a digit, a capital first letter or six letters, and no filler; in order, repeats kept."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9.\-]{2,}|[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.filter(found, lambda t: (t.rlike("[0-9]") | t.rlike("^[A-Z]") | (F.length(t) >= 6)) & ~F.lower(t).isin(SALIENT_STOP))


def is_asset(tag: Column, deny: list[str] = NOT_ASSETS) -> Column:
    return ~F.substring_index(tag, "-", 1).isin(deny)


def infer_type(tag: Column, text: Column) -> Column:
    """By the tag's prefix, else by a word behind its first mention (from 100 characters before it on), else Equipment."""
    prefix = F.substring_index(F.upper(tag), "-", 1)
    table = F.create_map(*(F.lit(x) for pair in PREFIX_TYPES.items() for x in pair))
    low = F.lower(text)
    around = F.substring(low, F.greatest(F.lit(1), F.instr(low, F.lower(tag)) - 100), F.length(low))
    near = F.coalesce(*(F.when(F.contains(around, F.lit(w)), t) for w, t in NEARBY_TYPES), F.lit("Equipment"))
    return F.coalesce(F.try_element_at(table, prefix), near)


def assets(docs: DataFrame, id_col: str, text_col: str, known: DataFrame | None = None) -> DataFrame:
    """(doc, asset, n, type, confidence, known, place): equipment tags of each document, known ones (column asset) first, then by count and name."""
    from pyspark.sql import Window

    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), t.alias("text"), F.explode(F.regexp_extract_all(t, F.lit(T.ascii_boundaries(ASSET_TAG)), F.lit(0))).alias("asset")).where(is_asset(F.col("asset")))
    n = rows.groupBy("doc", "asset").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    n = n.withColumn("type", infer_type(F.col("asset"), F.col("text"))).drop("text").withColumn("confidence", F.round(F.least(F.lit(0.98), 0.78 + 0.04 * F.least("n", F.lit(4))), 2))
    n = n.withColumn("known", F.lit(False)) if known is None else n.join(known.select("asset", F.lit(True).alias("known")).distinct(), "asset", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    order = Window.partitionBy("doc").orderBy(F.desc("known"), F.desc("n"), "asset")
    return n.withColumn("place", F.row_number().over(order)).select("doc", "asset", "n", "type", "confidence", "known", "place")


def events(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Draft events, one for each asset (doc, asset) of a document: labelled fields, work order, parts, downtime, date, confidence.

    Confidence .55 and .1 for each of a failure mode, an action and a date."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    of = {n: first_match(t, ps, " .:-") for n, ps in EVENT_FIELDS.items()}
    wo = T.ascii_boundaries(WORK_ORDER)
    hours = F.coalesce(*(F.nullif(F.regexp_extract(t, "(?i)" + T.ascii_boundaries(p), 1), F.lit("")).try_cast("double") for p in DOWNTIME), F.lit(0.0))
    rows = docs.select(F.col(id_col).alias("doc"), *(c.alias(n) for n, c in of.items()), guess_date(t).alias("date"), F.when(t.rlike(wo), F.concat(F.lit("WO-"), F.regexp_extract(t, wo, 1))).otherwise("").alias("work_order"), F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(T.ascii_boundaries(PART)), F.lit(0)), lambda x: F.upper(x)))).alias("parts_used"), hours.alias("downtime_hours"))
    some = lambda c: (F.col(c) != "").cast("int")
    return rows.withColumn("confidence", F.round(0.55 + 0.1 * some("failure_mode") + 0.1 * some("corrective_action") + 0.1 * some("date"), 2)).join(found.select("doc", "asset"), "doc")


def backfill(given: DataFrame, wanted: DataFrame, drafts: DataFrame) -> DataFrame:
    """Given events of wanted assets, and drafts for the wanted assets that they leave out.  All have doc and asset; given has the drafts' columns."""
    kept = given.join(wanted.select("doc", "asset").distinct(), ["doc", "asset"], "left_semi")
    missing = wanted.select("doc", "asset").distinct().join(kept.select("doc", "asset"), ["doc", "asset"], "left_anti")
    return kept.select(drafts.columns).unionByName(drafts.join(missing, ["doc", "asset"], "left_semi"))


def page_of(pages: DataFrame, needles: DataFrame) -> DataFrame:
    """(doc, needle, page): the first page whose text holds the needle (any case), else the document's first.
    pages: (doc, page, text); needles: (doc, needle)."""
    rows = needles.join(pages, "doc", "left")
    hit = (F.col("needle") != "") & F.contains(F.lower("text"), F.lower("needle"))
    return rows.groupBy("doc", "needle").agg(F.coalesce(F.min(F.when(hit, F.col("page"))), F.min("page")).alias("page"))


def safe_id(text: Column) -> Column:
    """An asset's id as a folder's name."""
    return F.btrim(F.regexp_replace(F.upper(text), "[^A-Za-z0-9_-]+", "-"), F.lit("-"))
