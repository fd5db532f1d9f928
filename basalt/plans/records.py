"""Queries over the registers: documents, assets, spares, gaps, conversations, and the graph built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import graph as G
from basalt.operators import records as R
from basalt.operators import telemetry as M
from basalt.plans.answers import QUESTIONS_SQL, questions
from basalt.plans.assets import SERIES_SQL, WO_SQL, work_orders
from basalt.plans.common import lines_sql, longs, table
from basalt.plans.graph import _ROUND, GRAPH_SQL, plant, plant_trees
from basalt.plans.text import O as TEXT_SQL
from basalt.plans.text import concepts

Q, O = {}, {}
CONCEPTS_SQL = TEXT_SQL["concept_df"]
_lit = lambda s: "'" + s.replace("'", "''") + "'"
NAME = "[A-Z][A-Za-z]{3,}"


def chunks(spark, d):
    """(doc, pos, text, entities): lines of documents and the capitalised words in them."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(T.lines(F.col("text"))).alias("pos", "text"))
    return rows.withColumn("entities", F.regexp_extract_all("text", F.lit(NAME), F.lit(0)))


CHUNKS_SQL = f"ck AS (SELECT doc_id AS doc, CAST(i - 1 AS BIGINT) AS pos, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, {lines_sql('text')} AS ls FROM documents)))"

Q["document_list"] = lambda spark, d: longs(R.document_list(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), (F.col("source") == "src0").alias("uploaded")), chunks(spark, d), concepts(spark, d).select(F.col("doc_id").alias("doc"))))
O["document_list"] = f"WITH {CHUNKS_SQL}, k AS ({CONCEPTS_SQL}) SELECT doc_id AS doc, source = 'src0' AS uploaded, (SELECT count(*) FROM ck WHERE ck.doc = doc_id) AS chunks, (SELECT count(*) FROM k WHERE k.doc_id = documents.doc_id) AS concepts FROM documents"


def wanted(spark, d):
    return table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("asset")).distinct()


Q["asset_documents"] = lambda spark, d: longs(R.document_hits(chunks(spark, d), wanted(spark, d)))
O["asset_documents"] = f"WITH {CHUNKS_SQL}, e AS (SELECT doc, pos, unnest(list_distinct(regexp_extract_all(text, '{NAME}'))) AS asset FROM ck), w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{NAME}')) AS asset FROM benchmark), n AS (SELECT asset, doc, count(*) AS n FROM e JOIN w USING (asset) GROUP BY asset, doc) SELECT asset, doc, n, row_number() OVER (PARTITION BY asset ORDER BY n DESC, doc) AS place FROM n"


def spare_links(spark, d):
    assets = table(spark, d, "supplier").select(F.concat(F.lit("S-"), "s_suppkey").alias("asset"))
    used = table(spark, d, "lineitem").where("l_linenumber = 3").select(F.concat(F.lit("S-"), "l_suppkey").alias("asset"), F.col("l_partkey").alias("part"))
    spares = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.concat(F.lit("spare for S-"), F.pmod("p_partkey", F.lit(300)), F.lit(" and M-"), "p_size").alias("description"))
    return R.asset_spares(assets, used, spares)


Q["asset_spares"] = spare_links
O["asset_spares"] = "WITH a AS (SELECT 'S-' || s_suppkey AS asset FROM supplier), s AS (SELECT p_partkey AS part, 'spare for S-' || (p_partkey % 300) || ' and M-' || p_size AS description FROM part) SELECT DISTINCT 'S-' || l_suppkey AS asset, l_partkey AS part FROM lineitem WHERE l_linenumber = 3 AND 'S-' || l_suppkey IN (SELECT asset FROM a) AND l_partkey IN (SELECT part FROM s) UNION SELECT asset, part FROM a JOIN s ON contains(description, asset)"

Q["asset_union"] = lambda spark, d: R.union_ids(plant_trees(spark, d)[0].where("type = 'Supplier'"), table(spark, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey") + 3).alias("id")))
O["asset_union"] = "SELECT 'S' || s_suppkey AS id FROM supplier UNION SELECT 'S' || (l_suppkey + 3) FROM lineitem"


def graph_union(spark, d):
    """Nodes around a supplier, and those around a question's customer, once each."""
    n, e = plant(spark, d)
    near = lambda x: G.expand(e, spark.createDataFrame([(x,)], "node string"), 1).select(F.col("node").alias("id"))
    return R.union_ids(near("S3"), near("C12"))


Q["graph_entity_union"] = graph_union
O["graph_entity_union"] = f"WITH {GRAPH_SQL} SELECT other AS id FROM a WHERE node IN ('S3', 'C12') UNION SELECT unnest(['S3', 'C12'])"


def merged(spark, d):
    old = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("asset"), F.array(F.lit("manual"), F.concat(F.lit("doc"), F.pmod("c_custkey", F.lit(5)))).alias("documents"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("label"))
    new = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("asset"), F.array(F.lit("report"), F.concat(F.lit("doc"), F.pmod("c_custkey", F.lit(7)))).alias("documents"), F.when(F.pmod("c_custkey", F.lit(4)) == 0, " ").otherwise("running").alias("status"), F.lit(None).cast("string").alias("label"))
    return R.merge(old, new, "asset", ["documents"]).withColumn("documents", F.array_join("documents", ","))


Q["metadata_merge"] = merged
O["metadata_merge"] = """WITH a AS (SELECT c_custkey AS asset, ['manual', 'doc' || (c_custkey % 5)] AS documents, c_mktsegment AS status, c_name AS label FROM customer WHERE c_custkey % 3 <> 0),
b AS (SELECT c_custkey AS asset, ['report', 'doc' || (c_custkey % 7)] AS documents, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE 'running' END AS status, CAST(NULL AS VARCHAR) AS label FROM customer WHERE c_custkey % 2 = 0)
SELECT asset, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.documents, []), coalesce(b.documents, [])))), ',') AS documents, coalesce(CASE WHEN trim(b.status) <> '' THEN b.status END, a.status) AS status, coalesce(b.label, a.label) AS label FROM a FULL JOIN b USING (asset)"""

Q["citation_numbers"] = lambda spark, d: longs(R.numbered(table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("qid"), F.col("turn").alias("place"))))
O["citation_numbers"] = "SELECT conv_id AS qid, turn AS place, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM conversations WHERE role = 'user'"

Q["symbol_types"] = lambda spark, d: R.symbol_type(table(spark, d, "supplier").select(F.concat(F.lit("T"), F.pmod("s_suppkey", F.lit(40))).alias("tag")).distinct(), table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("T"), F.pmod("n_nationkey", F.lit(9))).alias("tag"), F.col("n_name").alias("type")))
O["symbol_types"] = "WITH s AS (SELECT 'T' || (n_nationkey % 9) AS tag, arg_min(n_name, n_nationkey) AS type FROM nation GROUP BY 1) SELECT DISTINCT 'T' || (s_suppkey % 40) AS tag, coalesce(type, 'Unknown') AS type FROM supplier LEFT JOIN s ON s.tag = 'T' || (s_suppkey % 40)"

Q["document_assemble"] = lambda spark, d: R.assemble(chunks(spark, d).select("doc", "pos", "text")).select("doc", F.md5("text").alias("text_md5"))
O["document_assemble"] = f"WITH {CHUNKS_SQL} SELECT doc, md5(string_agg(text, chr(10) || chr(10) ORDER BY pos)) AS text_md5 FROM ck GROUP BY doc"

Q["expected_documents"] = lambda spark, d: table(spark, d, "benchmark").select("item_id", F.array_join(R.expected_documents(F.when(F.pmod("item_id", F.lit(3)) == 0, F.array(F.lit("SOP-1"), F.concat(F.lit("Doc-"), "item_id"))), F.when(F.pmod("item_id", F.lit(2)) == 0, F.concat(F.lit("MAN-"), "item_id"))), ",").alias("expected"))
O["expected_documents"] = "SELECT item_id, lower(CASE WHEN item_id % 3 = 0 THEN 'SOP-1,Doc-' || item_id WHEN item_id % 2 = 0 THEN 'MAN-' || item_id ELSE '' END) AS expected FROM benchmark"


def reads(spark, d):
    rows = table(spark, d, "lineitem").select(F.when(F.pmod("l_partkey", F.lit(9)) != 0, F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("event_id"), F.when(F.pmod("l_suppkey", F.lit(4)) != 0, F.concat(F.lit("WO-"), "l_orderkey")).otherwise(" ").alias("work_order"))
    events, orders = R.event_reads(rows)
    return events.agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids")).crossJoin(orders.agg(F.count("*").alias("orders")))  # one row each


Q["event_reads"] = reads
O["event_reads"] = "SELECT count(*) FILTER (l_partkey % 9 <> 0) AS events, count(DISTINCT l_orderkey || '-' || l_linenumber) FILTER (l_partkey % 9 <> 0) AS ids, count(DISTINCT l_orderkey) FILTER (l_suppkey % 4 <> 0) AS orders FROM lineitem"

Q["root_cause"] = lambda spark, d: longs(R.root_cause(work_orders(spark, d), "F"))
O["root_cause"] = f"WITH {WO_SQL} SELECT asset, count(*) FILTER (mode = 'F') AS similar, coalesce(string_agg(CAST(wo AS VARCHAR), ',' ORDER BY wo) FILTER (mode = 'F'), '') AS orders, count(*) FILTER (mode = 'F') > 0 AS candidate FROM wo GROUP BY asset"

# ---- gaps


def gaps(spark, d):
    from basalt.operators import memory as C

    asks = questions(spark, d).select(F.col("text").alias("query"), (F.pmod("qid", F.lit(10)) / 10).alias("confidence"), F.col("qid").alias("at"))
    return C.gaps(asks).withColumn("status", F.element_at(F.array(*map(F.lit, R.STATES)), (F.pmod("first_asked", F.lit(4)) + 1).cast("int")))


GAPS_SQL = f"{QUESTIONS_SQL}, gr AS (SELECT trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS key, (qid % 10) / 10 AS c, qid AS asked FROM qs), gg AS (SELECT key, count(*) AS ask_count, min(asked) AS first_asked, min(c) AS c FROM gr WHERE key <> '' GROUP BY key), gp AS (SELECT key, ask_count, first_asked, CASE WHEN c < 0.2 THEN 'HIGH' WHEN c < 0.5 AND ask_count >= 3 THEN 'HIGH' WHEN c < 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS priority, (['open', 'assigned', 'captured', 'dismissed'])[1 + first_asked % 4] AS status FROM gg)"
Q["gap_list"] = lambda spark, d: longs(R.gap_list(gaps(spark, d)).select("key", "ask_count", "priority", "status", "rank"))
O["gap_list"] = f"WITH {GAPS_SQL} SELECT key, ask_count, priority, status, CAST(CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS BIGINT) AS rank FROM gp WHERE status IN ('open', 'assigned')"
Q["gap_counters"] = lambda spark, d: R.gap_counters(gaps(spark, d))
O["gap_counters"] = f"WITH {GAPS_SQL} SELECT count(*) AS gaps, count(*) FILTER (status IN ('open', 'assigned')) AS unresolved FROM gp"
Q["gap_find"] = lambda spark, d: gaps(spark, d).join(questions(spark, d).select(F.col("qid").alias("first_asked")), "first_asked", "left_semi").where("first_asked % 7 = 0").select("first_asked", "key", "status")
O["gap_find"] = f"WITH {GAPS_SQL} SELECT first_asked, key, status FROM gp WHERE first_asked % 7 = 0"


def moved(spark, d):
    start = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("owner"))
    moves = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("pos"), F.when(F.col("l_returnflag") == "A", "assign").otherwise("status").alias("action"), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("p"), "l_partkey")).when(F.col("l_returnflag") == "R", F.element_at(F.array(*map(F.lit, R.STATES)), (F.pmod("l_partkey", F.lit(4)) + 1).cast("int"))).otherwise("unheard of").alias("value"))
    return R.gap_move(start, moves)


Q["gap_moves"] = moved
O["gap_moves"] = """WITH m AS (SELECT l_suppkey AS id, l_orderkey AS pos, l_returnflag = 'A' AS assign, CASE WHEN l_returnflag = 'A' THEN 'assigned' ELSE (['open', 'assigned', 'captured', 'dismissed'])[1 + l_partkey % 4] END AS state, 'p' || l_partkey AS owner FROM lineitem WHERE l_linenumber = 1 AND l_returnflag IN ('A', 'R')),
l AS (SELECT id, arg_max(state, pos) AS state, arg_max(owner, pos) FILTER (assign) AS owner FROM m GROUP BY id) SELECT s_suppkey AS id, coalesce(state, 'open') AS status, owner FROM supplier LEFT JOIN l ON id = s_suppkey"""

# ---- conversations


def log(spark, d):
    """Operations that make the conversations' table, with renames, pins, documents and deletions here and there."""
    c = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    none = F.array().cast("array<string>")
    row = lambda df, pos, op, value, items=none: df.select("conv_id", (F.col("turn") * 10 + pos).alias("pos"), F.lit(op).alias("op") if isinstance(op, str) else op.alias("op"), value.cast("string").alias("value"), items.alias("items"))
    first = c.where("turn = 0")
    out = row(first, -9, "create", F.when(F.pmod("conv_id", F.lit(5)) == 0, "A given title").otherwise("New conversation"))
    out = out.unionByName(row(c, 0, F.when(F.col("role") == "user", "append_user").otherwise("append"), F.col("text"), F.regexp_extract_all("text", F.lit(NAME), F.lit(0))))
    out = out.unionByName(row(c.where("turn % 4 = 1 and conv_id % 3 = 0"), 1, "rename", F.when(F.col("turn") == 5, "  ").otherwise(F.concat(F.lit(" Chat "), "turn"))))
    out = out.unionByName(row(c.where("conv_id % 4 = 1"), 2, F.when(F.pmod("turn", F.lit(3)) == 0, "pin").otherwise("unpin"), F.lit(None)))
    out = out.unionByName(row(c.where("turn % 2 = 1"), 3, "link", F.concat(F.lit("doc"), F.pmod("turn", F.lit(3)))))
    return out.unionByName(row(first.where("conv_id % 11 = 10"), 25, "delete", F.lit(None)))


def store(spark, d):
    s = R.conversation_store(log(spark, d))
    return longs(s.select("conv_id", F.col("pinned"), "messages", F.md5("entities").alias("entities_md5"), "documents", "updated", F.when(F.col("title").startswith("Chat") | (F.col("title") == "A given title"), F.col("title")).alias("named")))


Q["conversation_store"] = store
O["conversation_store"] = f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id % 11 <> 10 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0)),
e AS (SELECT conv_id, turn, i, es[i] AS entity FROM (SELECT conv_id, turn, es, unnest(range(1, least(8, len(es)) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '{NAME}') AS es FROM c))),
f AS (SELECT conv_id, entity, min((turn, i)) AS first FROM e GROUP BY conv_id, entity), l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first DESC) AS back FROM f),
n AS (SELECT conv_id, string_agg(entity, ',' ORDER BY first) AS entities FROM l WHERE back <= 40 GROUP BY conv_id),
b AS (SELECT conv_id, count(*) AS messages, coalesce(arg_max(turn % 3 = 0, turn) FILTER (conv_id % 4 = 1), false) AS pinned, coalesce(string_agg(DISTINCT 'doc' || (turn % 3), ',' ORDER BY 'doc' || (turn % 3)) FILTER (turn % 2 = 1), '') AS documents,
  max(turn * 10 + CASE WHEN turn % 2 = 1 THEN 3 WHEN conv_id % 4 = 1 THEN 2 WHEN turn % 4 = 1 AND conv_id % 3 = 0 THEN 1 ELSE 0 END) AS updated, max(turn) FILTER (turn % 4 = 1 AND conv_id % 3 = 0 AND turn <> 5) AS renamed FROM c GROUP BY conv_id)
SELECT conv_id, pinned, messages, md5(coalesce(entities, '')) AS entities_md5, documents, updated, CASE WHEN renamed IS NOT NULL THEN 'Chat ' || renamed WHEN conv_id % 5 = 0 THEN 'A given title' END AS named FROM b LEFT JOIN n USING (conv_id)"""

Q["conversation_order"] = lambda spark, d: longs(R.conversation_order(R.conversation_store(log(spark, d))).select("conv_id", "pinned", "updated"))
O["conversation_order"] = "SELECT conv_id, pinned, updated FROM (" + O["conversation_store"] + ")"
Q["conversation_titles"] = lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", T.title_from(F.col("text")).alias("title"))
_ws = "array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n]+'), lambda w: w <> ''), ' ')"
O["conversation_titles"] = f"""WITH l AS (SELECT conv_id, turn, {_ws} AS line FROM conversations), b AS (SELECT conv_id, turn, line, trim(regexp_replace(line, '(?i)^(please|hey|hi|hello|can you|could you|tell me) +', '')) AS bare FROM l), t AS (SELECT conv_id, turn, CASE WHEN bare = '' THEN line ELSE bare END AS x FROM b),
c AS (SELECT conv_id, turn, CASE WHEN length(x) > 60 THEN regexp_replace(left(x, 60), '(.) [^ ]*$', '\\1') || '…' ELSE x END AS x FROM t) SELECT conv_id, turn, CASE WHEN x = '' THEN 'New conversation' ELSE upper(left(x, 1)) || substr(x, 2) END AS title FROM c"""
Q["clip_sentences"] = lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.clip(F.coalesce("text", F.lit("")), 120)).alias("clip_md5"))
O["clip_sentences"] = """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t, left(coalesce(text, ''), 120) AS h FROM conversations), s AS (SELECT *, regexp_extract(h, '(?s)^(.*(?:\\.[ \\n]|[!?] ))', 1) AS s FROM t)
SELECT conv_id, turn, md5(CASE WHEN length(t) <= 120 THEN t WHEN s <> '' AND length(s) - 2 >= 48 THEN left(s, length(s) - 1) ELSE regexp_replace(h, '(?s)(.) [^ ]*$', '\\1') || ' …' END) AS clip_md5 FROM s"""

# ---- the graph


def orders(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber <= 2")
    return li.select(
        F.concat(F.lit("WO-"), "l_orderkey").alias("wo"), F.concat(F.lit("S-"), "l_suppkey").alias("asset"), F.element_at(F.array(*map(F.lit, ["bearing failure", "None", "seal leak", " n/a "])), (F.pmod("l_partkey", F.lit(4)) + 1).cast("int")).alias("failure_mode"),
        F.element_at(F.array(*map(F.lit, ["shaft misalignment", "", "wrong grease in the housing, twice over the limit"])), (F.pmod("l_suppkey", F.lit(3)) + 1).cast("int")).alias("cause"), F.array(F.concat(F.lit("brg-"), F.pmod("l_partkey", F.lit(60)))).alias("parts"),
        F.when(F.col("l_returnflag") == "R", "Check alignment monthly").alias("recommendation"))


_ORDERS_SQL = "mo AS (SELECT 'WO-' || l_orderkey AS wo, 'S-' || l_suppkey AS asset, (['bearing failure', 'None', 'seal leak', ' n/a '])[1 + l_partkey % 4] AS fm, (['shaft misalignment', '', 'wrong grease in the housing, twice over the limit'])[1 + l_suppkey % 3] AS cause, 'BRG-' || (l_partkey % 60) AS part, l_returnflag = 'R' AS rec FROM lineitem WHERE l_linenumber <= 2)"
_slug = lambda x, n: f"left(trim(regexp_replace(upper({x}), '[^A-Z0-9]+', '-', 'g'), '-'), {n})"
Q["maintenance_graph"] = lambda spark, d: R.maintenance_edges(orders(spark, d))
O["maintenance_graph"] = f"""WITH {_ORDERS_SQL}, f AS (SELECT *, 'FM:' || {_slug('fm', 1000)} AS f FROM mo WHERE lower(trim(fm)) NOT IN ('', 'none', 'n/a', 'nil', '-'))
SELECT asset AS src, f AS dst, 'HAS_FAILURE' AS rel FROM f UNION SELECT wo, f, 'CAUSED_BY' FROM f UNION SELECT f, 'CAUSE:' || {_slug('cause', 40)}, 'CAUSED_BY' FROM f WHERE cause <> '' UNION SELECT wo, part, 'USED_PART' FROM mo UNION SELECT wo, 'REC:' || {_slug("'Check alignment monthly'", 40)}, 'RECOMMENDED' FROM mo WHERE rec"""


def document_graph(spark, d):
    n = plant_trees(spark, d)[0]
    docs = table(spark, d, "documents").select(F.concat(F.lit("D"), "doc_id").alias("doc"), F.array(F.concat(F.lit("N"), F.pmod("doc_id", F.lit(40)))).alias("governs"), F.when(F.pmod("doc_id", F.lit(3)) == 0, "SAF-12").alias("permit"), F.array(F.concat(F.lit("S"), F.pmod("doc_id", F.lit(150)))).alias("mentions"))
    pipes = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("N"), F.col("n_nationkey") + 1).alias("dst"))
    symbols = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("N"), "n_nationkey").alias("tag"), F.when(F.pmod("n_nationkey", F.lit(4)) == 0, "Instrument").otherwise("Valve").alias("type"))
    parts = chunks(spark, d).select(F.concat(F.lit("D"), "doc").alias("doc"), F.col("pos").alias("chunk"), F.filter("entities", lambda e: F.length(e) >= 9).alias("concepts"))
    return R.document_edges(docs, n).unionByName(R.topology_edges(pipes, symbols)).unionByName(R.concept_edges(parts))


Q["document_graph"] = document_graph
O["document_graph"] = f"""WITH {GRAPH_SQL}, {CHUNKS_SQL}, cc AS (SELECT 'D' || doc AS doc, pos, list_sort(list_distinct(list_filter(regexp_extract_all(text, '{NAME}'), lambda e: length(e) >= 9))) AS cs FROM ck),
x AS (SELECT doc, pos, unnest(cs) AS c FROM cc), p AS (SELECT l.doc, l.c AS a, r.c AS b, count(*) AS n FROM x l JOIN x r ON l.doc = r.doc AND l.pos = r.pos AND l.c < r.c GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, a, b) AS i FROM p)
SELECT 'D' || doc_id AS src, 'N' || (doc_id % 40) AS dst, 'GOVERNS' AS rel FROM documents WHERE 'N' || (doc_id % 40) IN (SELECT id FROM n) UNION SELECT 'S' || (doc_id % 150), 'D' || doc_id, 'DOCUMENTED_BY' FROM documents WHERE 'S' || (doc_id % 150) IN (SELECT id FROM n) UNION SELECT 'D' || doc_id, 'PERMIT-SAF-12', 'REQUIRES' FROM documents WHERE doc_id % 3 = 0
UNION SELECT 'N' || n_nationkey, 'N' || (n_nationkey + 1), CASE WHEN n_nationkey % 4 = 0 THEN 'MEASURED_BY' ELSE 'CONNECTED_TO' END FROM nation UNION SELECT doc, c, 'MENTIONS' FROM x UNION ALL SELECT DISTINCT a, b, 'RELATED_TO' FROM t WHERE i <= 15 AND n >= 2"""

Q["graph_overview"] = lambda spark, d: longs((lambda n, e: R.scaled_degree(G.pagerank(n, e).select("id", F.round("rank", 9).alias("rank")), G.degree(n, e)))(*plant(spark, d)))
O["graph_overview"] = f"WITH {GRAPH_SQL}, o AS MATERIALIZED (SELECT node, count(*) AS out FROM a GROUP BY node), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n), " + ", ".join(f"r{k + 1} AS MATERIALIZED ({_ROUND.format(prev=f'r{k}')})" for k in range(20)) + ", z AS (SELECT id, round(CAST(rank AS DOUBLE), 9) AS rank FROM r20) SELECT id, round(rank / (SELECT max(rank) FROM z), 4) AS rank, (SELECT count(*) FROM a WHERE node = z.id) AS degree FROM z"


def neighbourhood(spark, d):
    n, e = plant(spark, d)
    return G.weighted_expand(e, spark.createDataFrame([("S5",)], "node string"), 2, 60).join(n, F.col("node") == F.col("id")).select("node", "type", F.round("score", 3).alias("relevance")).orderBy(F.desc("relevance"), "node")


Q["graph_neighborhood"] = neighbourhood
_S1 = "s0 AS (SELECT 'S5' AS node, 1.0::DOUBLE AS score), s1 AS (SELECT other AS node, max(score * w) AS score FROM s0 JOIN w USING (node) GROUP BY other), s2 AS (SELECT other AS node, max(score * w) AS score FROM s1 JOIN w USING (node) GROUP BY other)"
O["graph_neighborhood"] = f"WITH {GRAPH_SQL}, w AS (SELECT node, other, max(0.85::DOUBLE * CASE rel WHEN 'GOVERNS' THEN 0.9 WHEN 'REQUIRES' THEN 0.9 WHEN 'CONNECTED_TO' THEN 0.7 ELSE 0.5 END) AS w FROM a GROUP BY node, other), {_S1}, t AS (SELECT node, round(max(score), 6) AS score FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY node ORDER BY score DESC, node LIMIT 60) SELECT node, type, round(score, 3) AS relevance FROM t JOIN n ON id = node"


def supports(spark, d):
    n = plant_trees(spark, d)[0].select(F.upper("label").alias("id"))
    conv = table(spark, d, "conversations")
    names = F.array(F.lit("GERMANY"), F.concat(F.lit("SUPPLIER#"), F.lpad("conv_id", 9, "0")), F.upper(F.regexp_extract(F.coalesce("text", F.lit("")), NAME, 0)))
    evidence = conv.select(F.col("conv_id").alias("qid"), F.lit("EUROPE").alias("doc"), names.alias("names"))
    asked = conv.groupBy(F.col("conv_id").alias("qid")).agg(F.concat(F.lit("What of Germany and supplier#"), F.lpad(F.first("conv_id"), 9, "0")).alias("question"), F.min("text").alias("answer"))
    return R.support_nodes(evidence, asked, n)


Q["support_graph"] = supports
O["support_graph"] = f"""WITH {GRAPH_SQL}, k AS (SELECT DISTINCT upper(label) AS id FROM n), q AS (SELECT conv_id AS qid, 'What of Germany and supplier#' || lpad(CAST(conv_id AS VARCHAR), 9, '0') || chr(10) || coalesce(min(text), '') AS said FROM conversations GROUP BY conv_id),
sn AS (SELECT conv_id AS qid, unnest(['GERMANY', 'SUPPLIER#' || lpad(CAST(conv_id AS VARCHAR), 9, '0'), upper(regexp_extract(coalesce(text, ''), '{NAME}'))]) AS node FROM conversations), u AS (SELECT qid, 'EUROPE' AS node FROM q UNION SELECT qid, node FROM sn JOIN q USING (qid) WHERE contains(lower(said), lower(node))) SELECT qid, node FROM u WHERE node IN (SELECT id FROM k)"""

# ---- records as evidence


def telemetry(spark, d):
    s = M.analyze(table(spark, d, "events"), "user_id", "ts", "value", alert=60, danger=75)
    return s.select(F.concat(F.lit("U-"), "user_id").alias("asset"), "latest", "baseline", "slope_day", (F.col("rul_hours") / 24).alias("rul_days"), F.col("anomalous"))


Q["telemetry_evidence"] = lambda spark, d: R.telemetry_evidence(telemetry(spark, d), 60, 75).select("asset", "text", "score")
_fixed = lambda x: f"coalesce(format('{{:,.2f}}', {x}), 'unknown')"
O["telemetry_evidence"] = f"""WITH {SERIES_SQL}, z AS (SELECT user_id, round(latest, 6) AS latest, round(baseline, 6) AS baseline, round(slope * 24, 6) AS trend, round(CASE WHEN latest >= 75 THEN 0.0 WHEN slope > 0.0001 THEN (75 - latest) / slope END, 4) / 24 AS rul,
  CASE WHEN round(latest, 6) >= 75 THEN 'above the danger limit' WHEN round(latest, 6) >= 60 THEN 'in the alert zone' ELSE 'within normal limits' END AS zone, recent_mean > 60 OR recent_mean - baseline > 0.8 AS odd FROM t)
SELECT 'U-' || user_id AS asset, 'Live condition monitoring for U-' || user_id || '. Current value ' || {_fixed('latest')} || ', ' || zone || '. Baseline ' || {_fixed('baseline')} || '; trend ' || {_fixed('trend')} || ' per day. Remaining useful life ' || {_fixed('rul')} || ' days. Anomaly detected: ' || CASE WHEN odd THEN 'yes' ELSE 'no' END || '.' AS text, 0.9::DOUBLE AS score FROM z"""

Q["order_evidence"] = lambda spark, d: longs(R.order_evidence(work_orders(spark, d).select(F.concat(F.lit("C-"), "asset").alias("asset"), F.concat(F.lit("WO-"), "wo").alias("wo"), "date", "kind", F.when(F.col("mode") == "F", "none").otherwise(F.col("mode")).alias("mode"), F.lit(None).cast("string").alias("cause"), F.lit("checked ").alias("action"), F.floor("hours").alias("hours"))).select("asset", "wo", "place", "text", "score"))
O["order_evidence"] = f"""WITH {WO_SQL}, r AS (SELECT 'C-' || asset AS asset, 'WO-' || wo AS wo, date, kind, mode, floor(hours) AS h, row_number() OVER (PARTITION BY asset ORDER BY date DESC, 'WO-' || wo) AS place FROM wo)
SELECT asset, wo, place, concat_ws('; ', 'Work order ' || wo || ' dated ' || date || ' on ' || asset, kind || ' maintenance', CASE WHEN mode <> 'F' THEN 'failure mode ' || mode END, 'action taken: checked', CASE WHEN h > 0 THEN 'downtime ' || CAST(h AS BIGINT) || ' hours' END) || '.' AS text, 0.9::DOUBLE AS score FROM r WHERE place <= 6"""


def narratives(spark, d):
    rows = R.root_cause(work_orders(spark, d), "F").join(work_orders(spark, d).groupBy("asset").agg(F.max("date").alias("last_date")), "asset")
    return R.narrative(rows.select(F.concat(F.lit("C-"), "asset").alias("asset"), F.when(F.pmod("asset", F.lit(5)) != 0, "in the alert zone").alias("health"), "similar", "last_date", F.when(F.pmod("asset", F.lit(2)) == 0, "SAF-12").alias("permit")))


Q["template_answer"] = narratives
O["template_answer"] = f"WITH {WO_SQL}, r AS (SELECT asset, count(*) FILTER (mode = 'F') AS s, max(date) AS l FROM wo GROUP BY asset) SELECT 'C-' || asset AS asset, CASE WHEN asset % 5 = 0 THEN {_lit(R.REFUSAL)} ELSE '**What is happening.** C-' || asset || ' is in the alert zone. **Why.** ' || s || ' past work orders show the same failure; the last was on ' || l || '. **Safety.** ' || CASE WHEN asset % 2 = 0 THEN 'SAF-12' ELSE 'A permit' END || ' is required before any work.' END AS answer FROM r"
