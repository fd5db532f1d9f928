"""A corpus pipeline of four stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents:

1. toxicity: documents that the nearest labelled examples call toxic go;
2. language ID: documents that can't be told go: no text, no letter, or no closer to any language than chance;
3. near-duplicates (five words, Jaccard 0.8): of each group the smallest id stays, and of
   repeated rows one;
4. packing: what is left, in windows of 1024 tokens; one row for each piece.

SQL cannot express these stages: each is tested against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import language, neardup, packing, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below one half."""
    model = toxicity.fit(docs, toxicity.learnable(shared.table(spark, sf_dir, "labels")))
    judged = toxicity.judge(docs, model.index)
    return judged.where("toxic_score < 0.5").select(docs.columns)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are closer to a learned language than random vectors are by chance; all rows with a letter if no row tells a language to learn."""
    model = language.fit(language.train_rows(docs))
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("lang_score") > language.NOISE)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; rows with a null id link with nothing and stay."""
    found = neardup.near_duplicates(docs, words=5)
    gone = found.where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in windows of 1024 tokens."""
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
