"""Queries over the property graph: regions, nations, suppliers and customers of the plant hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.operators import graph as G
from basalt.plans.common import longs, table

Q, O = {}, {}


def plant_trees(spark, d):
    """Nodes and listed edges: region GOVERNS nation, nation REQUIRES its suppliers.  (Supplier CONNECTED_TO customers of its nation and balance class: see plant.)"""
    region, nation, supplier, customer = (table(spark, d, t) for t in ("region", "nation", "supplier", "customer"))
    n = G.nodes(
        region.select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit("Region").alias("type"), F.col("r_name").alias("label")),
        nation.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.lit("Nation").alias("type"), F.col("n_name").alias("label")),
        supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.lit("Supplier").alias("type"), F.col("s_name").alias("label")),
        customer.select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.lit("Customer").alias("type"), F.col("c_name").alias("label")),
    )
    trees = [
        nation.select(F.concat(F.lit("R"), "n_regionkey").alias("src"), F.concat(F.lit("N"), "n_nationkey").alias("dst"), F.lit("GOVERNS").alias("rel")),
        supplier.select(F.concat(F.lit("N"), "s_nationkey").alias("src"), F.concat(F.lit("S"), "s_suppkey").alias("dst"), F.lit("REQUIRES").alias("rel")),
    ]
    return n, G.edges(*trees)


def plant(spark, d):
    """Nodes and the whole graph, folded: its edges CONNECTED_TO, which grow with the square of the tables, are blocks that are not listed."""
    n, e = plant_trees(spark, d)
    block = lambda nation, key: F.concat_ws(":", nation, F.pmod(key, F.lit(7)))
    left = table(spark, d, "supplier").where("s_nationkey is not null").select(block("s_nationkey", "s_suppkey").alias("block"), F.concat(F.lit("S"), "s_suppkey").alias("node"))
    right = table(spark, d, "customer").where("c_nationkey is not null").select(block("c_nationkey", "c_custkey").alias("block"), F.concat(F.lit("C"), "c_custkey").alias("node"))
    return n, G.fold(e, ((left, right, "CONNECTED_TO"),))


GRAPH_SQL = """
n AS (SELECT 'R' || r_regionkey AS id, 'Region' AS type, r_name AS label FROM region UNION ALL SELECT 'N' || n_nationkey, 'Nation', n_name FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'Supplier', s_name FROM supplier UNION ALL SELECT 'C' || c_custkey, 'Customer', c_name FROM customer),
e AS (SELECT DISTINCT * FROM (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, 'GOVERNS' AS rel FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'REQUIRES' FROM supplier
  UNION ALL SELECT 'S' || s_suppkey, 'C' || c_custkey, 'CONNECTED_TO' FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 7 = s_suppkey % 7)),
a AS (SELECT src AS node, dst AS other, rel FROM e UNION ALL SELECT dst, src, rel FROM e)"""

Q["graph_nodes"] = lambda spark, d: plant_trees(spark, d)[0]
O["graph_nodes"] = f"WITH {GRAPH_SQL} SELECT * FROM n"
Q["graph_edges"] = lambda spark, d: G.unfolded(plant(spark, d)[1])
O["graph_edges"] = f"WITH {GRAPH_SQL} SELECT * FROM e"
Q["graph_degree"] = lambda spark, d: G.degree(*plant(spark, d))
O["graph_degree"] = f"WITH {GRAPH_SQL} SELECT id, count(other) AS degree FROM n LEFT JOIN a ON node = id GROUP BY id"
Q["graph_neighbors"] = lambda spark, d: (lambda n, e: G.neighbours(e, n.where("type = 'Nation'").select(F.col("id").alias("node")), "REQUIRES"))(*plant_trees(spark, d))
O["graph_neighbors"] = f"WITH {GRAPH_SQL} SELECT node, other, rel FROM a WHERE node LIKE 'N%' AND rel = 'REQUIRES'"


def seeds(spark):
    return spark.createDataFrame([("N3",), ("S7",)], "node string")


Q["khop_expand"] = lambda spark, d: longs(G.expand(plant(spark, d)[1], seeds(spark), 2))
O["khop_expand"] = f"WITH {GRAPH_SQL}, h1 AS (SELECT DISTINCT other AS node FROM a WHERE node IN ('N3', 'S7')), h2 AS (SELECT DISTINCT other AS node FROM a JOIN h1 USING (node)) SELECT node, CAST(min(hop) AS BIGINT) AS hop FROM (SELECT unnest(['N3', 'S7']) AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node"

Q["weighted_expand"] = lambda spark, d: G.weighted_expand(plant(spark, d)[1], seeds(spark), 2, 60)
O["weighted_expand"] = f"""WITH {GRAPH_SQL}, w AS (SELECT node, other, max(0.85::DOUBLE * CASE rel WHEN 'GOVERNS' THEN 0.9 WHEN 'REQUIRES' THEN 0.9 WHEN 'CONNECTED_TO' THEN 0.7 ELSE 0.5 END) AS w FROM a GROUP BY node, other),
s0 AS (SELECT unnest(['N3', 'S7']) AS node, 1.0::DOUBLE AS score), s1 AS (SELECT other AS node, max(score * w) AS score FROM s0 JOIN w USING (node) GROUP BY other), s2 AS (SELECT other AS node, max(score * w) AS score FROM s1 JOIN w USING (node) GROUP BY other)
SELECT node, round(max(score), 6) AS score FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY node ORDER BY score DESC, node LIMIT 60"""

Q["pagerank_20"] = lambda spark, d: (lambda n, e: G.pagerank(n, e).select("id", F.round("rank", 9).alias("rank")))(*plant(spark, d))
_ROUND = "SELECT n.id, (SELECT 0.15 / count(*) FROM n) + 0.85 * coalesce(g.got, 0.0) AS rank FROM n LEFT JOIN (SELECT other AS id, sum(r.rank / o.out) AS got FROM a JOIN {prev} r ON r.id = a.node JOIN o ON o.node = a.node GROUP BY other) g ON g.id = n.id"
O["pagerank_20"] = f"WITH {GRAPH_SQL}, o AS MATERIALIZED (SELECT node, count(*) AS out FROM a GROUP BY node), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n), " + ", ".join(f"r{k + 1} AS MATERIALIZED ({_ROUND.format(prev=f'r{k}')})" for k in range(20)) + " SELECT id, round(CAST(rank AS DOUBLE), 9) AS rank FROM r20"

Q["shortest_path"] = lambda spark, d: longs(G.path_lengths(plant(spark, d)[1], "R0", 5))
O["shortest_path"] = f"""WITH RECURSIVE {GRAPH_SQL}, b(node, hops) AS (SELECT 'R0', 0 UNION SELECT other, hops + 1 FROM b JOIN a USING (node) WHERE hops < 5),
m AS (SELECT node, min(hops) AS hops FROM b GROUP BY node) SELECT m.node, CAST(m.hops AS BIGINT) AS hops, min(p.node) AS previous FROM m LEFT JOIN a ON a.other = m.node AND m.hops > 0 LEFT JOIN m p ON p.node = a.node AND p.hops = m.hops - 1 GROUP BY m.node, m.hops"""

Q["permit_two_hop"] = lambda spark, d: G.two_hop(plant_trees(spark, d)[1], "GOVERNS", "REQUIRES")
O["permit_two_hop"] = f"WITH {GRAPH_SQL} SELECT DISTINCT x.src AS a, x.dst AS via, y.dst AS b FROM e x JOIN e y ON x.dst = y.src WHERE x.rel = 'GOVERNS' AND y.rel = 'REQUIRES'"

Q["relation_groups"] = lambda spark, d: (lambda n, e: G.relation_groups(e, n.select(F.col("id").alias("node"))))(*plant(spark, d))
O["relation_groups"] = f"WITH {GRAPH_SQL} SELECT node, count(*) FILTER (rel = 'CONNECTED_TO') AS connected, count(*) FILTER (rel = 'MEASURED_BY') AS measured, count(*) FILTER (rel IN ('DOCUMENTED_BY', 'GOVERNS')) AS documented, count(*) FILTER (rel IN ('HAS_FAILURE', 'CAUSED_BY')) AS failure, count(*) FILTER (rel NOT IN ('CONNECTED_TO', 'MEASURED_BY', 'DOCUMENTED_BY', 'GOVERNS', 'HAS_FAILURE', 'CAUSED_BY')) AS other FROM a GROUP BY node"

Q["induced_subgraph"] = lambda spark, d: (lambda n, e: G.induced(e, G.expand(e, seeds(spark), 1)))(*plant(spark, d))
O["induced_subgraph"] = f"WITH {GRAPH_SQL}, m AS (SELECT unnest(['N3', 'S7']) AS node UNION SELECT other FROM a WHERE node IN ('N3', 'S7')) SELECT src, dst, rel FROM e WHERE src IN (SELECT node FROM m) AND dst IN (SELECT node FROM m)"


def path_pairs(spark, d):
    """Each customer and the supplier whose number is the customer's, counted round."""
    n = table(spark, d, "supplier").count()
    return table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("a"), F.concat(F.lit("S"), F.pmod("c_custkey", F.lit(n)) + 1).alias("b"))


Q["path_edges"] = lambda spark, d: longs(G.paths_between(plant(spark, d)[1], path_pairs(spark, d), 5))
O["path_edges"] = f"""WITH RECURSIVE {GRAPH_SQL}, ad AS MATERIALIZED (SELECT node, other, min(rel) AS rel FROM a GROUP BY node, other), pr AS (SELECT 'C' || c_custkey AS a, 'S' || (1 + c_custkey % (SELECT count(*) FROM supplier)) AS b FROM customer),
fb(start, node, h) AS (SELECT DISTINCT b, b, 0 FROM pr UNION SELECT start, other, h + 1 FROM fb JOIN ad USING (node) WHERE h < 5), db AS MATERIALIZED (SELECT start AS b, node, min(h) AS h FROM fb GROUP BY start, node),
w(a, b, left_, node, source, rel) AS (SELECT pr.a, pr.b, h, pr.a, NULL::VARCHAR, NULL::VARCHAR FROM pr JOIN db ON db.b = pr.b AND db.node = pr.a WHERE h > 0
  UNION ALL SELECT a, b, left_ - 1, x.node, source, x.rel FROM (SELECT w.a, w.b, w.left_, w.node AS source, min((ad.other, ad.rel)) AS m FROM w JOIN ad ON ad.node = w.node JOIN db ON db.b = w.b AND db.node = ad.other AND db.h = w.left_ - 1 WHERE w.left_ > 0 GROUP BY ALL) g, LATERAL (SELECT m[1] AS node, m[2] AS rel) x),
t AS (SELECT a, b, max(left_) AS n FROM w GROUP BY a, b) SELECT a, b, CAST(n - left_ AS BIGINT) AS hop, source, node AS target, rel FROM w JOIN t USING (a, b) WHERE source IS NOT NULL"""
