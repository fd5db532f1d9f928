"""Running topics: the stream equals the batch, with a reset in the middle, a time to live, and literal turns."""

import time

from pyspark.sql import functions as F

from basalt.streaming import telemetry as S
from basalt.streaming import topics as P

SCHEMA = f"conv_id bigint, turn bigint, query string, terms {P.TERMS}, reset boolean"
TURNS = [
    (1, 0, "explain attention in detail", [("GPUs", 5.0), ("attention", 2.0)], False), (1, 1, "explain it in simple words", [("GPUs", 3.0)], False), (1, 2, "thanks", [], False), (1, 3, "", None, True),
    (1, 4, "how does that go", [], False), (1, 5, "of pumps and pump seals", [("pump", 1.0), ("pumps", 1.0), ("pump", 2.0)], False), (2, 0, "x", [("b", 1.0), ("a", 1.0), ("cc", 1.0)], False), (2, 1, None, [("zz", 1.0)], False),
]
WANT = {(1, 0): (None, "attention"), (1, 1): ("attention", "GPUs"), (1, 2): ("GPUs", "GPUs"), (1, 3): (None, None), (1, 4): (None, None), (1, 5): (None, "pump"), (2, 0): (None, "cc"), (2, 1): ("cc", "zz")}


def collected(df):
    return {(r["conv_id"], r["turn"]): (r["before"], r["topic"]) for r in df.collect()}


def test_batch_and_follow_ups(spark):
    turns = spark.createDataFrame(TURNS, SCHEMA)
    assert collected(P.batch(turns)) == WANT
    got = {(r["conv_id"], r["turn"]): r["resolved"] for r in P.followed(turns, P.batch(turns)).collect()}
    assert got[1, 1] == "explain attention in simple words" and got[1, 4] == "how does that go"


def test_stream_equals_batch(spark, tmp_path):
    """Two files, so two batches: the state carries the topic over, and a reset begins the second one's part of conversation 1."""
    for k, part in enumerate((TURNS[:3] + TURNS[6:7], TURNS[3:6] + TURNS[7:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken up by age
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert collected(S.drain(P.running(stream), "append", str(tmp_path / "work"))) == WANT


def test_terms(spark):
    row = spark.createDataFrame([("P-101 uses RAG and RAG",)], "t string").select(P.own_terms(F.col("t")).alias("x")).first()["x"]
    assert {(x["term"], x["weight"]) for x in row} == {("P-101", 3.0), ("RAG", 2.0), ("uses", 1.0), ("rag", 1.0), ("p-101", 1.0)}
