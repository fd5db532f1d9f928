"""Views over the registers: documents, assets, spares, gaps, conversations; unions, merges and graph building from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import text as T

# States, priorities and words of the specification.
ACTIVE = ["open", "assigned"]
STATES = ["open", "assigned", "captured", "dismissed"]
PRIORITIES = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
NOTHING = ["", "none", "n/a", "nil", "-"]
MOST_ENTITIES, ENTITIES_EACH = 40, 8
REFUSAL = (
    "I don't have grounded evidence to answer that, so I won't guess. Per the grounded-or-refuse policy this is escalated to a human expert — and logged as a "
    "**knowledge gap**: if this question matters to operations, the procedure should be captured before the expertise walks out the door."
)
# End of fixed values.


def document_list(docs: DataFrame, chunks: DataFrame, concepts: DataFrame) -> DataFrame:
    """(doc, uploaded, chunks, concepts), uploaded ones first, then by name.  docs: (doc, uploaded); chunks: (doc); concepts: (doc)."""
    n = lambda df, name: df.groupBy("doc").agg(F.count("*").alias(name))
    rows = docs.join(n(chunks, "chunks"), "doc", "left").join(n(concepts, "concepts"), "doc", "left").fillna(0, ["chunks", "concepts"])
    return rows.select("doc", "uploaded", "chunks", "concepts").orderBy(F.desc("uploaded"), "doc")


def document_hits(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """(asset, doc, n, place): how many chunks of a document name an asset, most first.  chunks: (doc, entities); assets: (asset)."""
    rows = chunks.select("doc", F.explode(F.array_distinct("entities")).alias("asset")).join(assets.distinct(), "asset").groupBy("asset", "doc").agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("n"), "doc")))


def asset_spares(assets: DataFrame, used: DataFrame, spares: DataFrame) -> DataFrame:
    """(asset, part): spares that an asset's history used, or whose description holds its id.
    assets: (asset); used: (asset, part); spares: (part, description).

    Descriptions meet ids by their substrings of the ids' lengths, an equi-join: descriptions are short, and no pairs of all are made."""
    size = assets.agg(F.coalesce(F.min(F.length("asset")), F.lit(1)).alias("least"), F.coalesce(F.max(F.length("asset")), F.lit(0)).alias("most"))
    cut = spares.crossJoin(F.broadcast(size)).where("most > 0")  # one row
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("description")))
    pieces = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.col("least"), F.col("most")), lambda n: F.substring(F.col("description"), i, n))))
    named = cut.select("part", F.explode(F.array_distinct(pieces)).alias("asset")).join(assets.distinct(), "asset").select("asset", "part")
    return used.join(assets.distinct(), "asset", "left_semi").join(spares.select("part"), "part", "left_semi").select("asset", "part").unionByName(named).distinct()


def union_ids(*sources: DataFrame) -> DataFrame:
    """Distinct ids (column id) of all sources."""
    out = sources[0].select("id")
    for s in sources[1:]:
        out = out.unionByName(s.select("id"))
    return out.distinct()


def merge(old: DataFrame, new: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """Records of both by key: list columns become their sorted distinct union, of other columns the new value wins unless it is empty."""
    cols = [c for c in old.columns if c != key]
    a, b = old.alias("a"), new.alias("b")
    rows = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")

    def pick(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in lists:
            none = F.array().cast(dict(old.dtypes)[c])
            return F.array_sort(F.array_union(F.coalesce(x, none), F.coalesce(y, none)))
        return F.coalesce(F.when(F.trim(y.cast("string")) != "", y), x)

    return rows.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *(pick(c).alias(c) for c in cols))


def numbered(evidence: DataFrame) -> DataFrame:
    """Evidence (qid, place, ...) with its citation number, from 1."""
    return evidence.withColumn("number", F.row_number().over(Window.partitionBy("qid").orderBy("place")))


def symbol_type(tags: DataFrame, symbols: DataFrame) -> DataFrame:
    """(tag, type): the type of the first symbol with the tag, else Unknown.  symbols: (pos, tag, type)."""
    first = symbols.groupBy("tag").agg(F.min_by("type", "pos").alias("type"))
    return tags.select("tag").join(first, "tag", "left").select("tag", F.coalesce("type", F.lit("Unknown")).alias("type"))


def assemble(chunks: DataFrame, between: str = "\n\n") -> DataFrame:
    """(doc, text): the chunks' texts in order.  chunks: (doc, pos, text)."""
    return chunks.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), between).alias("text"))  # one document


def expected_documents(several: Column, one: Column) -> Column:
    """The documents that a case expects, in lower case: the list, else the one, else none."""
    some = F.when(F.size(F.coalesce(several, F.array().cast("array<string>"))) > 0, several).when(one.isNotNull() & (one != ""), F.array(one))
    return F.transform(F.coalesce(some, F.array().cast("array<string>")), lambda x: F.lower(x))


def event_reads(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the events with an id, distinct work orders that are not empty)."""
    return events.where("event_id is not null and event_id <> ''"), events.select("work_order").where("trim(work_order) <> ''").distinct()


def root_cause(orders: DataFrame, mode: str) -> DataFrame:
    """(asset, similar, orders, candidate): past work orders with the failure mode, in order, and whether they suggest a cause.
    orders: (asset, wo, mode)."""
    hit = F.col("mode") == mode
    out = orders.groupBy("asset").agg(F.count_if(hit).alias("similar"), F.array_join(F.array_sort(F.collect_list(F.when(hit, F.col("wo")))), ",").alias("orders"))
    return out.withColumn("candidate", F.col("similar") > 0)


# ---------------------------------------------------------------- knowledge gaps


def gap_move(gaps: DataFrame, moves: DataFrame) -> DataFrame:
    """Gaps (id, status, owner) after moves (id, pos, action, value): `assign` gives an owner, `status` a state; unknown ids and states change nothing.

    The last move of each kind that counts wins, in the order of pos."""
    ok = moves.where((F.col("action") == "assign") | ((F.col("action") == "status") & F.col("value").isin(STATES)))
    assign = F.col("action") == "assign"
    state = F.when(assign, "assigned").otherwise(F.col("value"))
    last = ok.groupBy("id").agg(F.max_by(state, "pos").alias("to"), F.max_by(F.when(assign, F.col("value")), F.when(assign, F.col("pos"))).alias("by"))
    return gaps.join(last, "id", "left").select("id", F.coalesce("to", "status").alias("status"), F.coalesce("by", "owner").alias("owner"))


def gap_list(gaps: DataFrame, closed: bool = False) -> DataFrame:
    """Open and assigned gaps (all, if closed) by priority, most asked first, ties by key; gaps: (key, priority, ask_count, status)."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in PRIORITIES.items() for x in p)), F.col("priority")), F.lit(9))
    rows = gaps if closed else gaps.where(F.col("status").isin(ACTIVE))
    return rows.withColumn("rank", rank).orderBy("rank", F.desc("ask_count"), "key")


def gap_counters(gaps: DataFrame) -> DataFrame:
    """(gaps, unresolved)."""
    return gaps.agg(F.count("*").alias("gaps"), F.count_if(F.col("status").isin(ACTIVE)).alias("unresolved"))


# ---------------------------------------------------------------- conversations


def conversation_store(log: DataFrame) -> DataFrame:
    """(conv_id, title, pinned, messages, entities, documents, updated) after all operations of a log (conv_id, pos, op, value, items).

    Operations: create (value: title), append_user and append (value: text, items: entities), rename, pin, unpin, link (value: document), delete.
    A title comes from the first user message unless one is given; of the entities, eight a message, the last 40 in order of
    their first mention stay; what comes before a conversation's last creation or deletion is gone, deleted ones are left out."""
    life = log.where(F.col("op").isin("create", "delete")).groupBy("conv_id").agg(F.max(F.struct("pos", "op", "value")).alias("l"))
    rows = log.join(life, "conv_id").where((F.col("l.op") == "create") & (F.col("pos") >= F.col("l.pos")))
    at = lambda op: F.when(F.col("op") == op, F.col("pos"))
    value = lambda op: F.when(F.col("op") == op, F.col("value"))
    named = (F.col("op") == "rename") & (F.trim("value") != "")
    pins = F.col("op").isin("pin", "unpin")
    appended = F.col("op").isin("append", "append_user")
    base = rows.groupBy("conv_id").agg(
        F.max_by(F.when(named, F.trim("value")), F.when(named, F.col("pos"))).alias("renamed"), F.max("l.value").alias("given"), F.min_by(value("append_user"), at("append_user")).alias("asked"),
        F.coalesce(F.max_by(F.when(pins, F.col("op") == "pin"), F.when(pins, F.col("pos"))), F.lit(False)).alias("pinned"), F.count_if(appended).alias("messages"),
        F.array_join(F.array_sort(F.collect_set(value("link"))), ",").alias("documents"), F.max("pos").alias("updated"),
    )
    first = rows.where(appended).select("conv_id", "pos", F.posexplode(F.slice("items", 1, ENTITIES_EACH)).alias("i", "entity")).groupBy("conv_id", "entity").agg(F.min(F.struct("pos", "i")).alias("at"))
    last = first.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("at")))).where(F.col("back") <= MOST_ENTITIES)
    names = last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "entity"))), lambda x: x["entity"]), ",").alias("entities"))
    auto = F.when(F.col("given").isNull() | F.col("given").isin("", "New conversation"), F.when(F.col("asked").isNotNull(), T.title_from(F.col("asked"))).otherwise("New conversation")).otherwise(F.col("given"))
    return base.join(names, "conv_id", "left").select("conv_id", F.coalesce("renamed", auto).alias("title"), "pinned", "messages", F.coalesce("entities", F.lit("")).alias("entities"), "documents", "updated")


def conversation_order(store: DataFrame) -> DataFrame:
    """Pinned conversations first, then the latest."""
    return store.orderBy(F.desc("pinned"), F.desc("updated"), "conv_id")


# ---------------------------------------------------------------- the graph


def maintenance_edges(orders: DataFrame) -> DataFrame:
    """(src, dst, rel) of maintenance rows (wo, asset, failure_mode, cause, parts array, recommendation): failures, causes, parts, recommendations."""
    some = lambda c: ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(NOTHING)
    fm = F.concat(F.lit("FM:"), T.slug(F.col("failure_mode"), 1000))
    cut = lambda p, c: F.concat(F.lit(p), T.slug(F.col(c), 40))
    failed, caused = orders.where(some(F.col("failure_mode"))), orders.where(some(F.col("failure_mode")) & some(F.col("cause")))
    parts = orders.select("wo", F.explode("parts").alias("part"))
    rows = failed.select(F.col("asset").alias("src"), fm.alias("dst"), F.lit("HAS_FAILURE").alias("rel"))
    rows = rows.unionByName(failed.select(F.col("wo").alias("src"), fm.alias("dst"), F.lit("CAUSED_BY").alias("rel")))
    rows = rows.unionByName(caused.select(fm.alias("src"), cut("CAUSE:", "cause").alias("dst"), F.lit("CAUSED_BY").alias("rel")))
    rows = rows.unionByName(parts.select(F.col("wo").alias("src"), F.upper("part").alias("dst"), F.lit("USED_PART").alias("rel")))
    rows = rows.unionByName(orders.where(some(F.col("recommendation"))).select(F.col("wo").alias("src"), cut("REC:", "recommendation").alias("dst"), F.lit("RECOMMENDED").alias("rel")))
    return rows.distinct()


def document_edges(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, rel): documents (doc, governs array, permit, mentions array) govern and are documented by known nodes (id) only, and require permits."""
    known = nodes.select(F.col("id").alias("tag")).distinct()
    of = lambda c: docs.select("doc", F.explode(c).alias("tag")).join(known, "tag", "left_semi")
    rows = of("governs").select(F.col("doc").alias("src"), F.col("tag").alias("dst"), F.lit("GOVERNS").alias("rel"))
    rows = rows.unionByName(of("mentions").select(F.col("tag").alias("src"), F.col("doc").alias("dst"), F.lit("DOCUMENTED_BY").alias("rel")))
    rows = rows.unionByName(docs.where("permit is not null and permit <> ''").select(F.col("doc").alias("src"), F.concat(F.lit("PERMIT-"), "permit").alias("dst"), F.lit("REQUIRES").alias("rel")))
    return rows.distinct()


def topology_edges(connections: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, rel) of a drawing's connections (src, dst): MEASURED_BY from an instrument, else CONNECTED_TO.  symbols: (pos, tag, type)."""
    kind = symbol_type(connections.select(F.col("src").alias("tag")).distinct(), symbols).withColumnsRenamed({"tag": "src"})
    return connections.join(kind, "src").select("src", "dst", F.when(F.col("type") == "Instrument", "MEASURED_BY").otherwise("CONNECTED_TO").alias("rel")).distinct()


def concept_edges(chunks: DataFrame, most: int = 15, least: int = 2) -> DataFrame:
    """(src, dst, rel): a document MENTIONS its concepts; concepts that share a chunk are RELATED_TO, the `most` most frequent pairs of a document that share `least`.
    chunks: (doc, chunk, concepts array)."""
    named = chunks.select("doc", F.explode("concepts").alias("c")).distinct().select(F.col("doc").alias("src"), F.col("c").alias("dst"), F.lit("MENTIONS").alias("rel"))
    sorted_ = chunks.select("doc", F.array_sort(F.array_distinct("concepts")).alias("cs")).where(F.size("cs") > 1)
    pairs = F.flatten(F.transform("cs", lambda a, i: F.transform(F.slice("cs", i + 2, F.size("cs")), lambda b: F.struct(a.alias("a"), b.alias("b")))))  # one chunk's
    n = sorted_.select("doc", F.explode(pairs).alias("p")).groupBy("doc", "p.a", "p.b").agg(F.count("*").alias("n"))
    top = n.withColumn("i", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "a", "b"))).where((F.col("i") <= most) & (F.col("n") >= least))
    return named.unionByName(top.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("RELATED_TO").alias("rel")).distinct())


def scaled_degree(ranks: DataFrame, degrees: DataFrame) -> DataFrame:
    """(id, rank, degree): ranks as shares of the largest, four decimals.  ranks: (id, rank); degrees: (id, degree)."""
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.crossJoin(F.broadcast(top)).join(degrees, "id").select("id", F.round(F.col("rank") / F.col("top"), 4).alias("rank"), "degree")  # one row


def support_nodes(evidence: DataFrame, asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, node): what an answer stands on: its evidence's documents, and its names that the answer or the question holds, known nodes (id) only.
    evidence: (qid, doc, names array); asked: (qid, question, answer)."""
    docs = evidence.select("qid", F.col("doc").alias("node"))
    names = evidence.select("qid", F.explode("names").alias("node")).distinct().join(asked, "qid")
    said = F.contains(F.lower(F.concat_ws("\n", "question", "answer")), F.lower("node"))
    rows = docs.unionByName(names.where(said).select("qid", "node")).distinct()
    return rows.join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("qid", "node")


# ---------------------------------------------------------------- records as evidence


def telemetry_evidence(series: DataFrame, alert: float, danger: float) -> DataFrame:
    """(asset, text, score) of series (asset, latest, baseline, slope_day, rul_days, anomalous)."""
    zone = F.when(F.col("latest") >= danger, "above the danger limit").when(F.col("latest") >= alert, "in the alert zone").otherwise("within normal limits")
    number = lambda c: F.coalesce(F.format_number(c, 2), F.lit("unknown"))
    text = F.concat(F.lit("Live condition monitoring for "), F.col("asset"), F.lit(". Current value "), number("latest"), F.lit(", "), zone, F.lit(". Baseline "), number("baseline"), F.lit("; trend "), number("slope_day"), F.lit(" per day. Remaining useful life "), number("rul_days"), F.lit(" days. Anomaly detected: "), F.when(F.col("anomalous"), "yes").otherwise("no"), F.lit("."))
    return series.select("asset", text.alias("text"), F.lit(0.9).alias("score"))


def order_evidence(orders: DataFrame, most: int = 6) -> DataFrame:
    """(asset, wo, place, text, score): the latest work orders (asset, wo, date, kind, mode, cause, action, hours) as sentences."""
    recent = orders.withColumn("place", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date"), "wo"))).where(F.col("place") <= most)
    some = lambda c: F.when(~F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin("", "none"), F.trim(F.col(c)))
    parts = F.concat_ws("; ", F.concat(F.lit("Work order "), "wo", F.lit(" dated "), "date", F.lit(" on "), "asset"), F.concat(some("kind"), F.lit(" maintenance")), F.concat(F.lit("failure mode "), some("mode")), F.concat(F.lit("root cause "), some("cause")), F.concat(F.lit("action taken: "), some("action")), F.when(F.col("hours") > 0, F.concat(F.lit("downtime "), F.col("hours"), F.lit(" hours"))))
    return recent.select("asset", "wo", "place", F.concat(parts, F.lit(".")).alias("text"), F.lit(0.9).alias("score"))


def narrative(profiles: DataFrame) -> DataFrame:
    """(asset, answer): a template answer for each asset (asset, health, similar, last_date, permit), the refusal where nothing is known."""
    known = F.concat(F.lit("**What is happening.** "), "asset", F.lit(" is "), "health", F.lit(". **Why.** "), F.col("similar"), F.lit(" past work orders show the same failure; the last was on "), "last_date", F.lit(". **Safety.** "), F.coalesce("permit", F.lit("A permit")), F.lit(" is required before any work."))
    return profiles.select("asset", F.coalesce(known, F.lit(REFUSAL)).alias("answer"))
