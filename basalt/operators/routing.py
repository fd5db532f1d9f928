"""From questions to places: nodes of a graph that a question names, and documents that it is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.operators import concepts as C
from basalt.operators import index as I

# Lengths, thresholds and words of the specification.
LEAST_CONCEPT, LEAST_SQUEEZED, LEAST_INSIDE = 4, 5, 5
TITLE_STOP = ["the", "and", "for", "with", "about", "explain", "detail", "overview", "definition", "what", "why", "how", "need"]
VETO_HITS, VETO_SCORE = 5, 4.0
# End of fixed values.


def squeezed(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))), lambda i: F.substring(text, i, F.lit(n))))


def words(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0)))


def _inside(shorter: DataFrame, longer: DataFrame, n: int) -> DataFrame:
    """Rows of both tables where `needle` (n characters or more) lies in `hay`: they meet by the needle's first n characters."""
    keyed = shorter.where(F.length("needle") >= n).withColumn("gram", F.substring("needle", 1, n))
    spots = longer.withColumn("gram", F.explode(grams(F.col("hay"), n)))
    return spots.join(I.held(keyed), "gram").where(F.contains("hay", F.col("needle"))).drop("gram", "needle", "hay")


def _plural_keys(ws: Column) -> Column:
    """Keys of words: two words share one if they are equal or one is the other with an s."""
    return F.array_distinct(F.flatten(F.transform(ws, lambda w: F.array(w, F.concat(w, F.lit("s"))))))


def concept_hits(queries: DataFrame, names: DataFrame, inside: bool = False) -> DataFrame:
    """(qid, name, rule): names (column name, four characters or more) that queries (qid, text) mean.

    phrase: the name stands there; squeezed: it does once signs and spaces are gone on both sides; word: one of its words
    does, singular or plural; inside (if asked for): a word of five letters or more of the query is part of the name.  Each rule is a join on equal keys."""
    names = names.select("name").distinct().where(F.length("name") >= LEAST_CONCEPT)
    asked = queries.select("qid", "text")
    phrase = C.mentions(asked, names).select("qid", "name", F.lit("phrase").alias("rule"))
    whole = _inside(names.select("name", squeezed(F.col("name")).alias("needle")), asked.select("qid", squeezed(F.col("text")).alias("hay")), LEAST_SQUEEZED).select("qid", "name", F.lit("squeezed").alias("rule"))
    token = r"[a-z0-9]{3,}"
    mine = asked.select("qid", F.explode(_plural_keys(words(F.col("text"), token))).alias("key"))
    their = names.select("name", F.explode(_plural_keys(words(F.col("name"), token))).alias("key"))
    word = mine.join(I.held(their), "key").select("qid", "name", F.lit("word").alias("rule"))
    out = phrase.unionByName(whole).unionByName(word)
    if inside:
        long = asked.select("qid", F.explode(words(F.col("text"), rf"[a-z][a-z0-9]{{{LEAST_INSIDE - 1},}}")).alias("needle"))
        distinct = long.select("needle").distinct()
        found = _inside(distinct.withColumn("w", F.col("needle")), names.select("name", F.lower("name").alias("hay")), LEAST_INSIDE)
        out = out.unionByName(long.join(found, long["needle"] == found["w"]).select("qid", "name", F.lit("inside").alias("rule")))
    return out.distinct()


def graph_seeds(queries: DataFrame, entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, seed, rules): nodes (id, type) that a question's expansion begins at: its entities (qid, entity) that are nodes,
    and concept nodes that it means.  rules: what spoke for the seed, sorted."""
    tags = entities.join(nodes.select(F.col("id").alias("entity")).distinct(), "entity", "left_semi").select("qid", F.col("entity").alias("seed"), F.lit("entity").alias("rule"))
    named = concept_hits(queries, nodes.where("type = 'Concept'").select(F.col("id").alias("name")), inside=True)
    return tags.unionByName(named.withColumnRenamed("name", "seed")).groupBy("qid", "seed").agg(F.array_join(F.array_sort(F.collect_set("rule")), "+").alias("rules"))  # five at most


def title_terms(text: Column) -> Column:
    return F.filter(words(text, r"[a-z0-9]{2,}"), lambda t: ~t.isin(TITLE_STOP) & ~t.rlike("^[0-9]+$"))


def route(queries: DataFrame, entities: DataFrame, chunk_entities: DataFrame, docs: DataFrame, concept_docs: DataFrame, lexical: DataFrame) -> DataFrame:
    """(qid, doc, rule): the documents that each question is explicitly about; none for most questions.

    Strong signals win: `entity`, an entity (qid, entity) of the question stands in a chunk of the document (doc, entity); `title`,
    two words of its id and title (docs: doc, name, title), or the only one, are in the question; `identifier`, id or title without signs are.  Without
    any, `concept`: documents (concept, doc) of the concepts it means, unless the question's five best lexical hits (lexical: qid, doc,
    score) are confident and all lie elsewhere."""
    by_entity = chunk_entities.join(I.held(entities.select("qid", "entity")), "entity").select("qid", "doc", F.lit("entity").alias("rule"), F.lit(0).alias("order")).distinct()
    bare = F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"\.pdf", "")
    terms = docs.select("doc", F.array_union(title_terms(F.col("name")), title_terms(bare)).alias("terms")).where(F.size("terms") > 0)
    asked = queries.select("qid", F.explode(words(F.col("text"), r"[a-z0-9]{3,}")).alias("term"))
    met = terms.select("doc", F.size("terms").alias("n"), F.explode("terms").alias("term")).join(I.held(asked), "term").groupBy("qid", "doc", "n").agg(F.count("*").alias("met"))
    by_title = met.where(F.col("met") >= F.least(F.lit(2), F.col("n"))).select("qid", "doc", F.lit("title").alias("rule"), F.lit(1).alias("order"))
    ids = docs.select("doc", F.explode(F.array_distinct(F.array(squeezed(F.col("name")), squeezed(bare)))).alias("needle"))
    by_id = _inside(ids, queries.select("qid", squeezed(F.col("text")).alias("hay")), 4).select("qid", "doc", F.lit("identifier").alias("rule"), F.lit(2).alias("order")).distinct()
    strong = by_entity.unionByName(by_title).unionByName(by_id).groupBy("qid", "doc").agg(F.min(F.struct("order", "rule"))["rule"].alias("rule"))
    open_ = queries.select("qid", "text").join(strong.select("qid").distinct(), "qid", "left_anti")
    weak = concept_hits(open_, concept_docs.select(F.col("concept").alias("name"))).select("qid", F.col("name").alias("concept")).distinct()
    weak = weak.join(concept_docs.select("concept", "doc"), "concept").select("qid", "doc").distinct()
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc")
    top = lexical.withColumn("i", F.row_number().over(order)).where(F.col("i") <= VETO_HITS)
    said = top.join(weak.withColumn("inside", F.lit(1)), ["qid", "doc"], "left").groupBy("qid").agg(F.max("score").alias("best"), F.count("inside").alias("inside"))
    vetoed = said.where((F.col("best") >= VETO_SCORE) & (F.col("inside") == 0)).select("qid")
    return strong.unionByName(weak.join(vetoed, "qid", "left_anti").withColumn("rule", F.lit("concept")))
