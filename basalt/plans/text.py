"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import concepts as C
from basalt.plans.common import keywords_sql, lines_sql, longs, table, tokens_sql, wc_sql, words_sql
from basalt.runtime import dealt

Q, O = {}, {}


def status_counts(spark, d):
    docs, events = table(spark, d, "documents"), table(spark, d, "events")
    a = docs.agg(F.count("*").alias("documents"), F.sum(F.size(T.lines(F.col("text"))).cast("bigint")).alias("chunks"))
    return a.crossJoin(events.agg(F.count("*").alias("points"), F.count_distinct("user_id").alias("series")))  # one row each


Q["corpus_status_counts"] = status_counts
O["corpus_status_counts"] = f"SELECT (SELECT count(*) FROM documents) AS documents, (SELECT CAST(sum(len({lines_sql('text')})) AS BIGINT) FROM documents) AS chunks, (SELECT count(*) FROM events) AS points, (SELECT count(DISTINCT user_id) FROM events) AS series"

Q["chunk_lines"] = lambda spark, d: longs(table(spark, d, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line")).select("doc_id", "pos", F.char_length("line").alias("n_chars"), F.md5("line").alias("line_md5")))
O["chunk_lines"] = f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, length(ls[i]) AS n_chars, md5(ls[i]) AS line_md5 FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, {lines_sql('text')} AS ls FROM documents))"


def pack_lines(text, limit=1200):
    """Lines packed greedily: a line joins the open chunk unless both together pass the limit."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, x):
        joined = F.concat(acc["cur"], F.lit("\n"), x)
        fits = F.length(acc["cur"]) + F.length(x) <= limit
        return F.when(acc["cur"] == "", F.struct(acc["done"].alias("done"), x.alias("cur"))).when(fits, F.struct(acc["done"].alias("done"), joined.alias("cur"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), x.alias("cur")))

    return F.aggregate(T.lines(text), start, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


Q["chunk_pack"] = lambda spark, d: longs(table(spark, d, "documents").select("doc_id", F.posexplode(pack_lines(F.col("text"))).alias("pos", "chunk")).select("doc_id", "pos", F.char_length("chunk").alias("n_chars")))
O["chunk_pack"] = f"""
WITH RECURSIVE l AS (SELECT doc_id, {lines_sql('text')} AS ls FROM documents),
f(doc_id, i, pos, n) AS (
  SELECT doc_id, 1, 0, length(ls[1]) FROM l WHERE len(ls) > 0
  UNION ALL
  SELECT f.doc_id, i + 1, CASE WHEN n + length(ls[i + 1]) <= 1200 THEN pos ELSE pos + 1 END, CASE WHEN n + length(ls[i + 1]) <= 1200 THEN n + 1 + length(ls[i + 1]) ELSE length(ls[i + 1]) END
  FROM f JOIN l USING (doc_id) WHERE i < len(ls))
SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(max(n) AS BIGINT) AS n_chars FROM f GROUP BY doc_id, pos"""

Q["tokenize_counts"] = lambda spark, d: longs(table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("ts")).select("doc_id", F.size("ts").alias("n_tokens"), F.size(F.array_distinct("ts")).alias("n_distinct")))
O["tokenize_counts"] = f"SELECT doc_id, len(ts) AS n_tokens, len(list_distinct(ts)) AS n_distinct FROM (SELECT doc_id, {tokens_sql('text')} AS ts FROM documents)"

Q["vocabulary_scan"] = lambda spark, d: table(spark, d, "documents").select(F.explode(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{3,}"), F.lit(0)), F.lower)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
O["vocabulary_scan"] = "SELECT term, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{3,}'))) AS term FROM documents) GROUP BY term"


def keyword_rows(docs, top):
    # Texts are dealt out once: counts and places of a document's words are then made where it lies.  Words are sifted as rows, in generated code.
    rows = dealt(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode_outer(T.keyword_words(F.col("text"))).alias("pos", "keyword")).where(F.col("keyword").isNotNull() & T.is_keyword(F.col("keyword")))
    n = rows.groupBy("doc_id", "keyword").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first_pos")
    return n.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("first_pos")


KEYWORDS_SQL = f"""
k AS (SELECT doc_id, ks[i] AS keyword, i FROM (SELECT doc_id, ks, unnest(range(1, len(ks) + 1)) AS i FROM (SELECT doc_id, {keywords_sql('text')} AS ks FROM documents))),
kn AS (SELECT doc_id, keyword, count(*) AS n, min(i) AS f FROM k GROUP BY doc_id, keyword),
kt AS (SELECT doc_id, keyword, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS place FROM kn)"""

Q["keywords_topk"] = lambda spark, d: longs(keyword_rows(table(spark, d, "documents"), 12))
O["keywords_topk"] = f"WITH {KEYWORDS_SQL} SELECT doc_id, keyword, n, place FROM kt WHERE place <= 12"


def cooccurrence(spark, d):
    """Keyword pairs of a document, counted by source: the 15 most frequent of each source that occur twice."""
    docs = table(spark, d, "documents")
    k = keyword_rows(docs, 6).select("doc_id", "keyword").join(docs.select("doc_id", "source"), "doc_id")
    sets = k.groupBy("doc_id", "source").agg(F.array_sort(F.collect_set("keyword")).alias("ks"))  # six at most
    pairs = F.flatten(F.transform("ks", lambda a, i: F.transform(F.slice("ks", i + 2, F.size("ks")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    n = sets.select("source", F.explode(pairs).alias("p")).groupBy("source", "p.a", "p.b").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy(F.desc("n"), "a", "b")
    return longs(n.withColumn("place", F.row_number().over(order)).where("place <= 15 and n >= 2"))


Q["cooccurrence_topk"] = cooccurrence
O["cooccurrence_topk"] = f"""
WITH {KEYWORDS_SQL}, s AS (SELECT doc_id, source, keyword FROM kt JOIN documents USING (doc_id) WHERE place <= 6),
p AS (SELECT x.source, x.keyword AS a, y.keyword AS b, count(*) AS n FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.keyword < y.keyword GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, a, b) AS place FROM p)
SELECT source, a, b, n, place FROM r WHERE place <= 15 AND n >= 2"""


def chunk_rows(spark, d):
    """(doc, pos, text): lines of the documents, which stand for chunks here."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode_outer(T.lines(F.col("text"))).alias("pos", "text")).where("pos is not null").withColumn("pos", F.col("pos").cast("bigint"))


def concepts(spark, d):
    """(doc_id, concept, df, score, place) of all documents."""
    return longs(C.extract(chunk_rows(spark, d)).withColumnRenamed("doc", "doc_id"))


Q["concept_df"] = concepts
_name = "length(w) >= 3 AND NOT regexp_matches(lower(w), '^www\\.|\\.(com|org|net|io)$') AND (" + " OR ".join(f"regexp_matches(w, '{p}')" for p in (C.ACRONYM, C.PASCAL, C.CAMEL)) + f" OR (regexp_matches(w, '{C.CODE}') AND length(w) >= 5))"
_title = lambda w: f"regexp_matches({w}, '{C.TITLE}') AND lower({w}) NOT IN ({words_sql(C.NO_CONCEPT)})"
LINES_SQL = f"l AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, {lines_sql('text')} AS ls FROM documents)))"
O["concept_df"] = f"""
WITH {LINES_SQL}, n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all(line, '{C.WORD}') AS ws FROM l),
c AS (SELECT doc_id, unnest(list_distinct(list_concat(list_filter(ws, lambda w: {_name}),
  list_transform(list_filter(range(1, len(ws)), lambda i: {_title('ws[i]')} AND {_title('ws[i + 1]')}), lambda i: ws[i] || ' ' || ws[i + 1])))) AS concept FROM w),
f AS (SELECT doc_id, concept, count(*) AS df FROM c GROUP BY doc_id, concept),
k AS (SELECT doc_id, concept, df FROM f JOIN n USING (doc_id) WHERE df >= CASE WHEN n_lines >= 3 THEN 2 ELSE 1 END),
p AS (SELECT DISTINCT doc_id, unnest(string_split(concept, ' ')) AS concept FROM k WHERE contains(concept, ' ')),
s AS (SELECT doc_id, concept, df, df + CASE WHEN contains(concept, ' ') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM k WHERE contains(concept, ' ') OR (doc_id, concept) NOT IN (SELECT doc_id, concept FROM p)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, concept) AS place FROM s)
SELECT doc_id, concept, df, score, place FROM r WHERE place <= {C.TOP}"""


def present(spark, d):
    """(doc, pos, concept): the concepts of its document in each chunk."""
    return C.presence(chunk_rows(spark, d), concepts(spark, d).withColumnRenamed("doc_id", "doc"))


Q["concept_presence"] = present
# Word boundaries of any alphabet; a name that ends in a sign wants a word behind it.
_edges = lambda x: f"'(^|[^{C.LETTERS}])' || regexp_escape(lower({x})) || CASE WHEN regexp_matches({x}, '[{C.LETTERS}]$') THEN '($|[^{C.LETTERS}])' ELSE '[{C.LETTERS}]' END"
PRESENT_SQL = f"k AS ({O['concept_df']}), pr AS (SELECT DISTINCT l.doc_id AS doc, pos, concept FROM l JOIN k ON k.doc_id = l.doc_id AND contains(lower(line), lower(concept)) WHERE regexp_matches(lower(line), {_edges('concept')}))"
O["concept_presence"] = f"WITH {LINES_SQL}, {PRESENT_SQL} SELECT doc, pos, concept FROM pr"

Q["chunk_entities"] = lambda spark, d: C.chunk_entities(chunk_rows(spark, d).select("doc", "pos", F.explode(T.tags(F.col("text"))).alias("tag")), present(spark, d)).select("doc", "pos", F.array_join("entities", "|").alias("entities"))
O["chunk_entities"] = f"WITH {LINES_SQL}, {PRESENT_SQL}, e AS (SELECT doc, pos, concept AS e FROM pr UNION SELECT doc_id, pos, unnest(regexp_extract_all(line, '{T.TAG}')) FROM l) SELECT doc, pos, string_agg(e, '|' ORDER BY e) AS entities FROM e GROUP BY doc, pos"
Q["document_mentions"] = lambda spark, d: C.document_entities(chunk_rows(spark, d).select("doc", "pos", F.explode(T.tags(F.col("text"))).alias("tag")), concepts(spark, d).withColumnRenamed("doc_id", "doc")).select("doc", F.array_join("mentions", "|").alias("mentions"))
O["document_mentions"] = f"WITH {LINES_SQL}, k AS ({O['concept_df']}), e AS (SELECT doc_id AS doc, concept AS m FROM k UNION SELECT doc_id, unnest(regexp_extract_all(line, '{T.TAG}')) FROM l) SELECT doc, string_agg(m, '|' ORDER BY m) AS mentions FROM e GROUP BY doc"

Q["summary_line"] = lambda spark, d: table(spark, d, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))
O["summary_line"] = f"SELECT doc_id, coalesce(CASE WHEN length(l) > 250 THEN left(l, 250) || '...' ELSE l END, '') AS summary FROM (SELECT doc_id, {lines_sql('text')}[1] AS l FROM documents)"

Q["prose_factor"] = lambda spark, d: table(spark, d, "documents").select("doc_id", F.round(T.prose_factor(F.col("text")), 4).alias("prose"))
PROSE_SQL = f"""
ls AS (SELECT doc_id, {lines_sql('text')} AS ls FROM documents),
prose AS (SELECT doc_id, CASE WHEN len(ls) = 0 THEN 0.0
  WHEN len(list_filter(ls, lambda x: regexp_matches(x, '\\.{{3,}}[ \\t]*[0-9]+[ \\t]*$'))) / len(ls) > 0.30 OR len(list_filter(ls, lambda x: regexp_matches(x, '^\\[[0-9]+\\][ \\t]'))) / len(ls) > 0.25
    OR len(list_filter(ls, lambda x: regexp_matches(x, '[^ \\t]+@[^ \\t]+\\.[^ \\t]+'))) / len(ls) > 0.15 THEN 0.0
  ELSE len(list_filter(ls, lambda x: len(list_filter(regexp_split_to_array(x, '[ \\t]+'), lambda w: w <> '')) >= 8)) / len(ls) END AS prose FROM ls)"""
O["prose_factor"] = f"WITH {PROSE_SQL} SELECT doc_id, round(CAST(prose AS DOUBLE), 4) AS prose FROM prose"


def header_strip(spark, d):
    """What running headers a page (document) of a source loses: its first line where that line, else its first four
    words where they, begin at least max(3, three tenths) of the source's pages that have text; sources under four pages keep all."""
    first = F.trim(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    words = F.filter(F.split(first, r"[ \t]+"), lambda w: w != "")
    docs = table(spark, d, "documents").select("doc_id", "source", first.alias("first"), F.when(F.size(words) >= 4, F.array_join(F.slice(words, 1, 4), " ")).alias("prefix"), (F.trim(F.coalesce("text", F.lit(""))) != "").cast("int").alias("some"))
    pages = docs.groupBy("source").agg(F.count("*").alias("pages"), F.greatest(F.lit(1), F.sum("some")).alias("n"))
    exact = docs.where("some = 1").groupBy("source", "first").agg(F.count("*").alias("same"))
    prefix = docs.where("some = 1 and prefix is not null").groupBy("source", "prefix").agg(F.count("*").alias("alike"))
    rows = docs.join(pages, "source").join(exact, ["source", "first"], "left").join(prefix, ["source", "prefix"], "left")
    least = F.greatest(F.lit(3), F.floor(0.3 * F.col("n")))
    lost = F.when((F.col("pages") < 4) | (F.col("first") == ""), "none").when(F.col("same") >= least, "line").when(F.col("alike") >= least, "prefix").otherwise("none")
    return rows.select("doc_id", lost.alias("lost"))


Q["header_strip"] = header_strip
O["header_strip"] = """
WITH f AS (SELECT doc_id, source, trim(split_part(coalesce(text, ''), chr(10), 1)) AS first, trim(coalesce(text, '')) <> '' AS full_ FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(first, '[ \\t]+'), lambda w: w <> '') AS ws FROM f), p AS (SELECT doc_id, source, first, full_, CASE WHEN len(ws) >= 4 THEN array_to_string(ws[1:4], ' ') END AS prefix FROM w),
c AS (SELECT *, count(*) OVER (PARTITION BY source) AS pages, greatest(1, count(*) FILTER (full_) OVER (PARTITION BY source)) AS n, count(*) FILTER (full_) OVER (PARTITION BY source, first) AS same, count(*) FILTER (full_ AND prefix IS NOT NULL) OVER (PARTITION BY source, prefix) AS alike FROM p)
SELECT doc_id, CASE WHEN pages < 4 OR first = '' THEN 'none' WHEN same >= greatest(3, floor(0.3 * n)) THEN 'line' WHEN prefix IS NOT NULL AND alike >= greatest(3, floor(0.3 * n)) THEN 'prefix' ELSE 'none' END AS lost FROM c"""

Q["tag_extract"] = lambda spark, d: table(spark, d, "part").select("p_partkey", F.array_join(T.tags(F.concat(F.lit("P-"), F.lpad(F.pmod("p_partkey", F.lit(1000)).cast("string"), 3, "0"), F.lit(" feeds BRG-"), F.col("p_size"), F.lit(" and WO-"), F.col("p_partkey"))), ",").alias("tags"))
O["tag_extract"] = "SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all('P-' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || ' feeds BRG-' || p_size || ' and WO-' || p_partkey, '\\b(?:[A-Z]{1,3}-\\d{2,3}|SAF-\\d+|SOP-\\d+|BRG-\\d+|MS-\\d+|CE-\\d+|WO-\\d+|MCC-\\d-\\d+|HS-\\d+)\\b'))), ',') AS tags FROM part"

Q["identifier_slugs"] = lambda spark, d: table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.doc_no(F.col("p_name")).alias("doc_no"), T.norm_id(F.concat("p_name", F.lit(".pdf"))).alias("norm"))
O["identifier_slugs"] = "SELECT p_partkey, left(regexp_replace(regexp_replace(upper(p_name), '[^A-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS slug, left(regexp_replace(p_name, '[^A-Za-z0-9_-]+', '-', 'g'), 40) AS doc_no, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS norm FROM part"

Q["parse_dates"] = lambda spark, d: table(spark, d, "orders").select("o_orderkey", F.date_format(T.parse_date(F.expr("CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE date_format(o_orderdate, 'd MMM yyyy') END")), "yyyy-MM-dd").alias("day"))
O["parse_dates"] = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"

Q["field_extract"] = lambda spark, d: table(spark, d, "documents").select("doc_id", *(F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), p, 0), F.lit("")).alias(n) for n, p in (("email", "[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]+"), ("address", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"), ("number", "[0-9]{4,}")))).where("email is not null or address is not null or number is not null")
O["field_extract"] = "SELECT * FROM (SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]+'), '') AS email, nullif(regexp_extract(coalesce(text, ''), '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}'), '') AS address, nullif(regexp_extract(coalesce(text, ''), '[0-9]{4,}'), '') AS number FROM documents) WHERE email IS NOT NULL OR address IS NOT NULL OR number IS NOT NULL"

Q["json_scalar"] = lambda spark, d: table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))
O["json_scalar"] = "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type"

Q["word_counts"] = lambda spark, d: longs(table(spark, d, "conversations").select("conv_id", "turn", T.word_count(F.col("text")).alias("words")))
O["word_counts"] = f"SELECT conv_id, turn, {wc_sql('text')} AS words FROM conversations"
