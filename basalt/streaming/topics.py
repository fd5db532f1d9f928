"""The running topic of conversations as state: what each turn is about, with resets and a time to live.

A turn's evidence names terms with weights (entities 3, concepts 2, keywords 1; of one term they add up).  The turn's topic is the heaviest of the terms that the user
named, the longest of those, else the heaviest of all; a turn without evidence leaves the topic as it is; a reset clears it.  A follow-up is read with the topic
before it.  As state this is transformWithStateInPandas, a value for each conversation; batch() gives the same for turns that are all there."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from basalt.functions import text as T
from basalt.operators import concepts as C
from basalt.operators import query as G
from basalt.runtime import ship

# Weights of the kinds of terms, least length of a named one.
ENTITY, CONCEPT, KEYWORD, LEAST = 3.0, 2.0, 1.0, 3
# End of fixed values.
TERMS = "array<struct<term:string,weight:double>>"
RESULT = "conv_id bigint, turn bigint, before string, topic string"


def terms_of(entities: Column, concepts: Column, keywords: Column) -> Column:
    """array of (term, weight) of a turn's evidence; each list counts a term once."""
    weigh = lambda xs, w: F.transform(F.array_distinct(xs), lambda x: F.struct(x.alias("term"), F.lit(w).alias("weight")))
    return F.concat(weigh(entities, ENTITY), weigh(concepts, CONCEPT), weigh(keywords, KEYWORD))


def own_terms(text: Column) -> Column:
    """A text's tags, concepts and keywords as terms."""
    return terms_of(T.tags(text), C.candidates(text), T.keywords(text))


def heaviest(query: str, terms: list) -> str | None:
    """The topic of one turn, None without evidence."""
    score: dict[str, float] = {}
    for x in terms:
        score[x["term"]] = score.get(x["term"], 0.0) + x["weight"]
    low = query.lower()
    named = [t for t in score if len(t) >= LEAST and re.search(rf"(?<![a-z0-9]){re.escape(t.lower())}(?![a-z0-9])", low)]
    return min(named or score, key=lambda t: (-score[t], -len(t), t), default=None)


class RunningTopic(StatefulProcessor):
    """Rows (conv_id, turn, query, terms, reset) in order of turn within a batch; a turn of a later batch counts as later."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.topic = handle.getValueState("topic", StructType([StructField("topic", StringType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(rows)).sort_values("turn", kind="stable")
        topic = self.topic.get()[0] if self.topic.exists() else None
        out = []
        for turn, query, terms, reset in zip(turns["turn"], turns["query"], turns["terms"], turns["reset"], strict=True):
            before = None if reset else topic
            topic = None if reset else heaviest(query or "", terms if terms is not None else []) or topic
            out.append((key[0], turn, before, topic))
        if topic is None:
            self.topic.clear()
        else:
            self.topic.update((topic,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "before", "topic"])

    def close(self) -> None:
        pass


def running(turns: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(conv_id, turn, before, topic) of a stream of turns (conv_id, turn, query, terms, reset), in append mode.  A conversation that rests for ttl_ms is forgotten."""
    spark = turns.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("before", StringType()), StructField("topic", StringType())])
    return turns.select("conv_id", "turn", "query", "terms", "reset").groupBy("conv_id").transformWithStateInPandas(statefulProcessor=RunningTopic(ttl_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def batch(turns: DataFrame) -> DataFrame:
    """What running() gives once all turns are there, by windows alone."""
    each = turns.select("conv_id", "turn", "query", "reset", F.explode_outer("terms").alias("x")).groupBy("conv_id", "turn", F.col("x.term").alias("term")).agg(F.sum("x.weight").alias("weight"), F.first("query").alias("query"), F.first("reset").alias("reset"))
    low = F.lower(F.coalesce("query", F.lit("")))
    named = (F.length("term") >= LEAST) & F.rlike(low, F.concat(F.lit("(?<![a-z0-9])\\Q"), F.lower("term"), F.lit("\\E(?![a-z0-9])")))
    best = F.min(F.when(F.col("term").isNotNull(), F.struct((~named).alias("other"), (-F.col("weight")).alias("w"), (-F.length("term")).alias("n"), "term")))["term"]
    own = each.groupBy("conv_id", "turn").agg(F.when(~F.first("reset"), best).alias("own"), F.first("reset").alias("reset"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    own = own.withColumn("part", F.sum(F.col("reset").cast("int")).over(order))
    within = Window.partitionBy("conv_id", "part").orderBy("turn")
    return own.select("conv_id", "turn", F.last("own", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.last("own", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("topic"))


def followed(turns: DataFrame, topics: DataFrame) -> DataFrame:
    """(conv_id, turn, resolved): each turn's question, follow-ups read with the topic before them."""
    return turns.join(topics, ["conv_id", "turn"]).select("conv_id", "turn", G.resolve(F.col("query"), F.col("before")).alias("resolved"))


