"""Tables, casts and SQL fragments that the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.text import KEYWORD_STOP, QUERY_STOP
from basalt.runtime import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts, which are costly to read through, are spread over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def longs(df: DataFrame) -> DataFrame:
    """All 32-bit integers as 64-bit ones, so that results have one integer type."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in df.dtypes))


def words_sql(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def sing_sql(x: str) -> str:
    return (
        f"CASE WHEN NOT regexp_full_match({x}, '[a-z]+') OR length({x}) <= 3 OR regexp_matches({x}, '(ss|us|is|ous)$') THEN {x} "
        f"WHEN ends_with({x}, 'ies') THEN left({x}, length({x}) - 3) || 'y' WHEN regexp_matches({x}, '(ses|xes|zes|ches|shes)$') THEN left({x}, length({x}) - 2) "
        f"WHEN ends_with({x}, 's') THEN left({x}, length({x}) - 1) ELSE {x} END"
    )


def tokens_sql(text: str) -> str:
    return (
        f"flatten(list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9][a-z0-9\\-./·°]*'), lambda t: list_concat([{sing_sql('t')}], "
        f"CASE WHEN contains(t, '-') THEN list_transform(list_filter(string_split(t, '-'), lambda p: length(p) >= 3 AND regexp_full_match(p, '[a-z]+')), lambda p: {sing_sql('p')}) ELSE [] END)))"
    )


def lines_sql(text: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def query_terms_sql(text: str) -> str:
    return f"list_filter(list_distinct({tokens_sql(text)}), lambda w: w NOT IN ({words_sql(QUERY_STOP)}))"


def keywords_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[A-Za-z][A-Za-z0-9\\-]+'), lambda w: length(w) > 2 AND w NOT IN ({words_sql(KEYWORD_STOP)}))"


def wc_sql(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '[ \\t\\n]+'), lambda w: w <> ''))"


INDEX_SQL = f"""
tok AS (SELECT doc_id AS doc, unnest({tokens_sql('text')}) AS term FROM documents),
postings AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY doc, term),
dl AS (SELECT doc_id AS doc, len({tokens_sql('text')}) AS dl FROM documents),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM dl),
qtok AS (SELECT item_id AS qid, unnest({tokens_sql('text')}) AS term FROM benchmark),
q AS (SELECT qid, term, count(*) AS qtf FROM qtok GROUP BY qid, term),
bm25 AS (SELECT qid, doc, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_dl))), 6) AS score
  FROM q JOIN postings USING (term) JOIN terms USING (term) JOIN dl USING (doc) CROSS JOIN st GROUP BY qid, doc)
"""

RANK_SQL = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) - 1"
