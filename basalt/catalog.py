"""All queries of the library by name, with the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basalt.plans import agents, answers, assets, extraction, graph, hybrid, records, retrieval, routing, shaping, streams, text, understanding

FLAGSHIP = "bm25_topk"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for part in (text, retrieval, graph, assets, answers, shaping, streams, understanding, extraction, records, routing, hybrid, agents):
    QUERIES |= part.Q
    ORACLES |= part.O
