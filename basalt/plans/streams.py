"""Queries over sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import concepts as C
from basalt.plans.common import keywords_sql, table
from basalt.plans.text import _name, _title
from basalt.runtime import shared_folder
from basalt.sources.readers import html_to_text
from basalt.streaming import telemetry as S
from basalt.streaming import topics as P

Q, O = {}, {}


def workspace(spark) -> str:
    return shared_folder(spark, "stream")


def stream(spark, d):
    return S.read(spark, f"{d}/events.parquet", table(spark, d, "events").schema)


def window_counts(spark, d):
    out = S.drain(S.windows(stream(spark, d)), "complete", workspace(spark))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


Q["stream_windows"] = window_counts
O["stream_windows"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"


def running(spark, d):
    return S.drain(S.running(stream(spark, d)), "update", workspace(spark), "user_id").select("user_id", "n", "recent_mean", "latest")


Q["stream_running"] = running
O["stream_running"] = "WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL) SELECT user_id, max(n) AS n, round(avg(value) FILTER (i >= n - 24), 6) AS recent_mean, arg_max(value, i) AS latest FROM p GROUP BY user_id"

Q["html_to_text"] = lambda spark, d: html_to_text(table(spark, d, "pages")).select("page_id", F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def topics(spark, d):
    """The running topic after each turn of every conversation; a turn without text begins anew."""
    turns = S.files(spark, f"{d}/conversations.parquet", table(spark, d, "conversations").schema)
    rows = turns.select("conv_id", "turn", F.col("text").alias("query"), P.own_terms(F.col("text")).alias("terms"), (F.trim(F.coalesce("text", F.lit(""))) == "").alias("reset"))
    return S.drain(P.running(rows), "append", workspace(spark))


Q["running_topics"] = topics
_pairs = f"list_transform(list_filter(range(1, len(ws)), lambda i: {_title('ws[i]')} AND {_title('ws[i + 1]')}), lambda i: ws[i] || ' ' || ws[i + 1])"
O["running_topics"] = f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, trim(coalesce(text, '')) = '' AS reset, regexp_extract_all(coalesce(text, ''), '{C.WORD}') AS ws FROM conversations),
x AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '{T.TAG}'))) AS term, 3.0 AS w FROM c UNION ALL SELECT conv_id, turn, unnest(list_distinct(list_concat(list_filter(ws, lambda w: {_name}), {_pairs}))), 2.0 FROM c UNION ALL SELECT conv_id, turn, unnest(list_distinct({keywords_sql('text')})), 1.0 FROM c),
s AS (SELECT x.conv_id, x.turn, term, sum(w) AS w, length(term) >= 3 AND regexp_matches(lower(any_value(text)), '(^|[^a-z0-9])' || regexp_escape(lower(term)) || '([^a-z0-9]|$)') AS named FROM x JOIN c USING (conv_id, turn) GROUP BY x.conv_id, x.turn, term),
o AS (SELECT c.conv_id, c.turn, reset, (SELECT arg_min(term, (NOT named, -w, -length(term), term)) FROM s WHERE s.conv_id = c.conv_id AND s.turn = c.turn) AS own FROM c),
p AS (SELECT conv_id, turn, CASE WHEN reset THEN NULL ELSE own END AS own, sum(CAST(reset AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM o)
SELECT conv_id, turn, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS UNBOUNDED PRECEDING) AS topic FROM p"""
