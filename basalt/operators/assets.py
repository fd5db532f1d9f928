"""Maintenance and asset views: overlays, roll-ups, spares, validation, documents' types."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.functions.text import ascii_boundaries

# Weighted signatures of document types, patterns and tables of the specification.
SIGNATURES = {
    "Work Order": [(r"\bwork\s*order\b", 3), (r"\bwo[-\s]?\d", 3), (r"\bjob\s*card\b", 2), (r"\bpermit\s*to\s*work\b", 1), (r"\bassigned\s*to\b", 1), (r"\blabou?r\s*hours\b", 1)],
    "Maintenance Report": [
        (r"\bmaintenance\s*(report|record|log)\b", 3), (r"\bcorrective\s*maintenance\b", 2), (r"\bpreventive\s*maintenance\b", 2), (r"\brepair(ed|s)?\b", 1),
        (r"\breplaced?\b", 1), (r"\bdowntime\b", 2), (r"\bparts?\s*used\b", 2),
    ],
    "Inspection Report": [
        (r"\binspection\s*(report|checklist|record)\b", 3), (r"\bvisual\s*inspection\b", 2), (r"\bthickness\s*measurement\b", 2), (r"\brecommended?\b", 1),
        (r"\bfindings?\b", 1), (r"\bcondition\b", 1), (r"\bntd\b|\bnon[-\s]?destructive\b", 2),
    ],
    "Failure Report": [(r"\bbreakdown\b", 3), (r"\bfailure\s*report\b", 3), (r"\bunplanned\s*(stop|shutdown|outage)\b", 2), (r"\btripped?\b", 1), (r"\bunexpected\s*(stop|failure)\b", 2)],
    "Root Cause Analysis": [
        (r"\broot\s*cause\b", 3), (r"\brca\b", 3), (r"\bfishbone\b", 2), (r"\b5\s*whys?\b", 2), (r"\bcontributing\s*factors?\b", 1), (r"\bcorrective\s*action\b", 1),
        (r"\bpreventive\s*action\b", 1),
    ],
    "Sensor Logs": [
        (r"\bvibration\b", 2), (r"\bmm/s\b", 2), (r"\bsensor\b", 2), (r"\btelemetry\b", 2), (r"\bcondition\s*monitoring\b", 3), (r"\biso\s*10816\b", 2), (r"\btrend\b", 1),
        (r"\bbearing\s*temp\b", 2), (r"\banomaly\b", 1),
    ],
    "OEM Manual": [
        (r"\b(operating|installation|service|user)\s*manual\b", 3), (r"\b(vendor|oem|equipment|pump|compressor)\s*manual\b", 5), (r"\bdatasheet\b", 2),
        (r"\bspecifications?\b", 1), (r"\btorque\s*settings?\b", 1), (r"\bmodel\s*(no|number)\b", 1), (r"\bmanufacturer\b", 1),
    ],
    "P&ID": [(r"\bp\s*&\s*id\b", 3), (r"\bpiping\s*and\s*instrumentation\b", 3), (r"\bloop\s*diagram\b", 2), (r"\bdrawing\s*(no|number)\b", 1), (r"\bline\s*list\b", 1)],
    "Operating Procedure": [(r"\bstandard\s*operating\s*procedure\b", 3), (r"\bsop[-\s]?\d", 3), (r"\bstep\s*\d+\b", 1), (r"\bprocedure\b", 1), (r"\bshall\b", 1)],
    "Safety SOP": [
        (r"\bsafety\s*(procedure|instruction|data\s*sheet)\b", 3), (r"\blockout[-/\s]?tagout\b|\bloto\b", 2), (r"\bhazard\b", 2), (r"\bppe\b", 1), (r"\bpermit\b", 1),
        (r"\bmsds\b|\bsds\b", 2),
    ],
    "Company Manual": [(r"\bcompany\s*manual\b", 3), (r"\basset\s*manual\b", 2)],
    "Commissioning Report": [(r"\bcommissioning\b", 3), (r"\bpre-commissioning\b", 2), (r"\bacceptance test\b", 2)],
    "Calibration Report": [(r"\bcalibration\b", 3), (r"\bas[- ]found\b", 2), (r"\bas[- ]left\b", 2)],
    "Warranty": [(r"\bwarranty\b", 3), (r"\bguarantee\b", 2)],
    "Datasheet": [(r"\bdatasheet\b", 3), (r"\btechnical data\b", 2), (r"\bdesign conditions\b", 2)],
    "Maintenance Checklist": [(r"\bmaintenance checklist\b", 3), (r"\bchecklist\b", 2)],
    "Vendor Report": [(r"\bvendor report\b", 3), (r"\bmanufacturer'?s report\b", 2)],
    "Service Report": [(r"\bservice report\b", 3), (r"\bservice engineer\b", 2)],
}
GENERAL_TYPE = "General Document"
MAINTENANCE_TYPES = [
    "Maintenance Report", "Inspection Report", "Work Order", "Failure Report", "Root Cause Analysis", "Sensor Logs", "Service Report", "Maintenance Checklist",
    "Calibration Report",
]
LEAST_CONFIDENCE = 0.4
# End of fixed values.


def overlay(base: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Rows of base replaced by the events row of the same key; keys of events alone are appended.  Same columns in both."""
    return base.join(events.select(key), key, "left_anti").unionByName(events.select(base.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, created: str = "created_at") -> DataFrame:
    """overlay that keeps the old row's creation time."""
    kept = old.select(key, F.col(created).alias("_created"))
    rows = new.join(kept, key, "left").withColumn(created, F.coalesce("_created", created)).drop("_created")
    return overlay(old, rows, key)


def rollup(orders: DataFrame, asset: str, hours: str, date: str, kind: str) -> DataFrame:
    """(asset, work_orders, downtime, last_date, last_preventive)."""
    return orders.groupBy(asset).agg(F.count("*").alias("work_orders"), F.round(F.sum(hours), 1).alias("downtime"), F.max(date).alias("last_date"), F.max(F.when(F.col(kind) == "preventive", F.col(date))).alias("last_preventive"))


def failure_modes(orders: DataFrame, asset: str, mode: str) -> DataFrame:
    """(asset, mode, n, place): failure modes by count, ties by name."""
    n = orders.groupBy(asset, mode).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(asset).orderBy(F.desc("n"), mode)))


def maintenance_type(raw: Column) -> Column:
    """Corrective, preventive or inspection by substring, else the lower-cased type or `event`."""
    t = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    has = lambda *words: t.rlike("|".join(words))
    return F.when(has("correct", "breakdown", "repair"), "corrective").when(has("prevent"), "preventive").when(has("inspect"), "inspection").when(t != "", t).otherwise("event")


def normalise_event(events: DataFrame) -> DataFrame:
    """Typed projection: parts split, downtime a number or 0, confidence over 1 taken as per cent."""
    c = F.expr("try_cast(confidence as double)")
    return events.select(
        "event_id",
        F.upper(F.trim("asset_id")).alias("asset_id"),
        maintenance_type(F.col("event_type")).alias("event_type"),
        T.parse_date(F.col("date")).alias("date"),
        T.parts_of(F.col("parts_used")).alias("parts_used"),
        F.coalesce(F.expr("try_cast(downtime_hours as double)"), F.lit(0.0)).alias("downtime_hours"),
        F.round(F.coalesce(F.when(c > 1, c / 100).otherwise(c), F.lit(0.0)), 4).alias("confidence"),
    )


def drawdown(spares: DataFrame, used: DataFrame, part: str, qty: str, least: str, n: str) -> DataFrame:
    """(part, before, used, after, low_stock) of the parts that were used; unknown parts are ignored, stock never falls below 0."""
    total = used.groupBy(part).agg(F.sum(n).alias("used"))
    after = F.greatest(F.lit(0), F.col(qty) - F.col("used"))
    return spares.join(total, part).select(part, F.col(qty).alias("before"), "used", after.alias("after"), (after <= F.col(least)).alias("low_stock"))


def low_stock(spares: DataFrame, qty: str, least: str) -> DataFrame:
    return spares.where(F.col(qty) <= F.col(least))


def validate(events: DataFrame, assets: DataFrame, parts: DataFrame, orders: DataFrame, today) -> DataFrame:
    """Adds errors, warnings and ok.  events: (event_id, asset, part, wo, date)."""
    a, p, o = assets.select(F.col("asset"), F.lit(True).alias("_a")).distinct(), parts.select(F.col("part"), F.lit(True).alias("_p")).distinct(), orders.select(F.col("wo"), F.lit(True).alias("_o")).distinct()
    rows = events.join(a, "asset", "left").join(p, "part", "left").join(o, "wo", "left")
    error = F.array_compact(F.array(F.when(F.col("asset").isNull(), "no asset"), F.when(F.col("date").isNull(), "no date")))
    warn = F.array_compact(F.array(
        F.when(F.col("asset").isNotNull() & F.col("_a").isNull(), "unknown asset"), F.when(F.col("part").isNotNull() & F.col("_p").isNull(), "unknown part"),
        F.when(F.col("_o").isNotNull(), "duplicate work order"), F.when(F.col("date") > F.lit(today), "future date"),
    ))
    return rows.withColumn("errors", error).withColumn("warnings", warn).withColumn("ok", F.size("errors") == 0).drop("_a", "_p", "_o")


def batch_ok(validated: DataFrame, batch: str) -> DataFrame:
    """(batch, commit): one error blocks the whole batch."""
    return validated.groupBy(batch).agg(F.bool_and("ok").alias("commit"))


def dedupe_events(new: DataFrame, known: DataFrame, key: list[str], some: list[str]) -> DataFrame:
    """New events with something in one of the columns `some`, once each, that are not known by the key (null equals null)."""
    rows = new.where(F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in some)).isNotNull()).dropDuplicates(key)
    return rows.alias("n").join(known.select(*key).distinct().alias("k"), [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in key], "left_anti")


def needed(pattern: str) -> list[str]:
    """Literals of which every match of a pattern holds one: the longest of each alternative; none if an alternative has no literal."""

    def of(items) -> list[str]:
        runs, some = [""], []
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(arg)
            elif name != "AT":  # what stands for several texts ends a run; a group that is always there may have literals of its own
                runs.append("")
                if name == "BRANCH":
                    each = [of(x) for x in arg[1]]
                    some.append(sum(each, []) if all(each) else [])
                elif name == "SUBPATTERN":
                    some.append(of(arg[3]))
        best = max(runs, key=len)
        some = [x for x in some if x and min(map(len, x)) > len(best)]
        return max(some, key=lambda x: min(map(len, x))) if some else [best] if best else []

    return of(re._parser.parse(pattern))


def found_in(text: Column, pattern: str) -> Column:
    """Does a pattern stand in a text?  Most texts lack the pattern's literals, which are sought as bytes; only the others are read by the pattern."""
    literals = needed(pattern)
    met = text.rlike(ascii_boundaries(pattern))
    return reduce(or_, (F.contains(text, F.lit(x)) for x in literals)) & met if literals else met


def document_types(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, type, confidence, maintenance): the type with the largest sum of weights of the signatures present, the first of equals.

    Confidence: min(.98, .45 + .35 top / total + .20 (top - second) / top), LEAST_CONFIDENCE for a general document."""
    # A column of its own, so that a text is lowered once.
    docs = docs.select(F.col(id_col).alias("doc"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    score = lambda rules: sum((F.when(found_in(F.col("t"), p), float(w)).otherwise(0.0) for p, w in rules), F.lit(0.0))
    scored = F.array(*(F.struct((-score(rules)).alias("s"), F.lit(i).alias("i"), F.lit(kind).alias("k")) for i, (kind, rules) in enumerate(SIGNATURES.items())))
    rows = docs.select("doc", F.array_sort(scored).alias("s"))
    top, second = -F.col("s")[0]["s"], -F.col("s")[1]["s"]
    total = F.aggregate("s", F.lit(0.0), lambda acc, x: acc - x["s"])
    conf = F.least(F.lit(0.98), 0.45 + 0.35 * top / total + 0.20 * (top - second) / top)
    kind = F.when(top > 0, F.col("s")[0]["k"]).otherwise(GENERAL_TYPE)
    return rows.select("doc", kind.alias("type"), F.round(F.when(top > 0, conf).otherwise(LEAST_CONFIDENCE), 2).alias("confidence"), kind.isin(MAINTENANCE_TYPES).alias("maintenance"))


def detect_assets(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """(doc, asset, n, confidence): how often each tag is named; confidence min(.98, .78 + .04 min(n, 4))."""
    found = docs.select(F.col(id_col).alias("doc"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), F.lit(0))).alias("asset"))
    n = found.groupBy("doc", "asset").agg(F.count("*").alias("n"))
    return n.withColumn("confidence", F.round(F.least(F.lit(0.98), 0.78 + 0.04 * F.least("n", F.lit(4))), 2))


def timeline(*sources: DataFrame) -> DataFrame:
    """(asset, entries): dated entries (asset, date string, label) of all sources in order, one text for each asset."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    ordered = F.array_sort(F.collect_list(F.struct("date", "label")))
    return rows.groupBy("asset").agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(" ", x["date"], x["label"])), "; ").alias("entries"))


def profile(assets: DataFrame, orders: DataFrame, asset: str, date: str, label: str, recent: int = 3) -> DataFrame:
    """(asset, n_orders, recent): one row for each asset with its latest work orders, a bounded list."""
    w = Window.partitionBy(asset).orderBy(F.desc(date), label)
    rows = orders.withColumn("_i", F.row_number().over(w))
    some = rows.groupBy(asset).agg(F.count("*").alias("n_orders"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_i") <= recent, F.struct("_i", label)))), lambda x: x[label].cast("string")), ",").alias("recent"))
    return assets.select(asset).join(some, asset, "left").select(asset, F.coalesce("n_orders", F.lit(0)).cast("bigint").alias("n_orders"), F.coalesce("recent", F.lit("")).alias("recent"))
