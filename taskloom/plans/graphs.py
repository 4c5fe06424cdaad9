"""Graph queries over the orders of each customer: an order depends on the customer's two orders before it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import dag
from ..sources import adapters as src
from .catalogue import query


def _orders(s, d):
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    name = lambda c: c.cast("string")
    return src.table(s, d, "orders").select(
        name(F.col("o_orderkey")).alias("name"), F.col("o_totalprice").alias("estimated_s"), (F.col("o_orderkey") % 7 == 0).alias("optional"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"),
        *[name(F.lag("o_orderkey", i).over(by)).alias(f"_{i}") for i in (1, 2, 3)], F.row_number().over(by).alias("k"),
    )


def _edges(orders, *steps):
    return orders.select(F.explode(F.array(*[F.col(f"_{i}") for i in steps])).alias("src"), F.col("name").alias("dst"), "cust").where("src IS NOT NULL")


def g(s, d):
    """Nodes and edges."""
    o = _orders(s, d)
    return o.drop("_1", "_2", "_3"), _edges(o, 1, 2)


def _back(s, d):
    """Edges from the third order to the first, of every tenth customer."""
    return _orders(s, d).where("k = 3 AND cust % 10 = 0").select(F.col("name").alias("src"), F.col("_2").alias("dst"), "cust")


_N = "nodes AS (SELECT o_orderkey::VARCHAR AS name, o_totalprice AS estimated_s, o_orderkey % 7 = 0 AS optional, o_custkey AS cust, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)"
_E = _N + ", edges AS (SELECT p.name AS src, n.name AS dst FROM nodes p JOIN nodes n ON p.cust = n.cust AND n.k - p.k IN (1, 2))"
_W = _E + ", walk(name, depth) AS (SELECT name, 0 FROM nodes WHERE name NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, depth + 1 FROM walk JOIN edges e ON walk.name = e.src), lv AS (SELECT name, max(depth)::INT AS level FROM walk GROUP BY 1)"


def _q(name, more, body):
    return query(name, f"WITH RECURSIVE {more} {body}")


_q("J4_levels", _W, "SELECT name, level FROM lv")(lambda s, d: dag.levels(*g(s, d), within="cust"))
_q("J3_J12_execution_plan", _W, "SELECT name, row_number() OVER (ORDER BY level, name)::INT AS position, estimated_s FROM lv JOIN nodes USING (name)")(lambda s, d: dag.positions(*g(s, d), within="cust"))
_q("J5_ready", _E, "SELECT name FROM nodes WHERE status <> 'F' AND name NOT IN (SELECT dst FROM edges WHERE src NOT IN (SELECT name FROM nodes WHERE status = 'F'))")(lambda s, d: dag.ready(*g(s, d), g(s, d)[0].where("status = 'F'")))
_q("J6_direct", _E, "SELECT src AS root, dst AS name FROM edges JOIN nodes ON name = src AND k = 1")(lambda s, d: dag.direct(g(s, d)[1], g(s, d)[0].where("k = 1")))
_q("J7_dependents", _E, ", reach(root, node) AS (SELECT src, dst FROM edges UNION SELECT root, e.dst FROM reach JOIN edges e ON reach.node = e.src) SELECT root, node FROM reach")(lambda s, d: dag.dependents(g(s, d)[1], "cust"))
_q("I17_skipped_dependents", _E, ", reach(node) AS (SELECT dst FROM edges JOIN nodes ON name = src AND status = 'P' UNION SELECT e.dst FROM reach JOIN edges e ON reach.node = e.src) SELECT node AS name FROM reach JOIN nodes ON name = node AND optional")(
    lambda s, d: dag.reached(g(s, d)[1], g(s, d)[0].where("status = 'P'").select(F.lit(1).alias("label"), F.col("name").alias("node"))).select(F.col("node").alias("name")).join(g(s, d)[0].where("optional"), "name", "left_semi"))
_q("J2_cycle_check", _W, "SELECT (SELECT count(*) FROM lv) = (SELECT count(*) FROM nodes) AS acyclic")(lambda s, d: dag.cyclic_members(*g(s, d), within="cust").agg((F.count("*") == 0).alias("acyclic")))
# all times are over 0, so the dearest path to an order takes every order before it
_COST = _N + ", costs AS (SELECT name, cust, k, sum(estimated_s) OVER (PARTITION BY cust ORDER BY k) AS cost FROM nodes)"
_q("J8_path_costs", _COST, "SELECT name, round(cost, 2)::DOUBLE AS cost FROM costs")(lambda s, d: dag.path_costs(*g(s, d), within="cust"))
_q("J8_critical_path", _COST, "SELECT string_agg(name, '>' ORDER BY k) AS path, round(max(cost), 2)::DOUBLE AS cost FROM costs WHERE cust = (SELECT cust FROM costs ORDER BY cost DESC, name LIMIT 1)")(lambda s, d: dag.critical_path(*g(s, d), within="cust"))
_q("J9_J11_summary", _W, "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, count(*) AS levels, max(c) AS max_parallelism FROM (SELECT level, count(*) AS c FROM lv GROUP BY 1)")(lambda s, d: dag.summary(*g(s, d), within="cust"))
_q("J10_isolated", _E, "SELECT name FROM nodes WHERE name NOT IN (SELECT src FROM edges) AND name NOT IN (SELECT dst FROM edges)")(lambda s, d: dag.isolated(*g(s, d)))
_q("J10_warnings", _W, "SELECT 'isolated: ' || name AS warning FROM nodes WHERE name NOT IN (SELECT src FROM edges) AND name NOT IN (SELECT dst FROM edges) UNION ALL SELECT 'levels: ' || (max(level) + 1) FROM lv HAVING max(level) + 1 > 8")(lambda s, d: dag.validate(*g(s, d), most_levels=8, within="cust"))
_q("G4_cyclic_members", _E, """, e2 AS (SELECT src, dst FROM edges UNION ALL SELECT p.name, n.name FROM nodes p JOIN nodes n ON p.cust = n.cust AND p.k = 3 AND n.k = 1 AND p.cust % 10 = 0), own AS (SELECT e2.* FROM e2 JOIN nodes ON name = src AND cust % 10 = 0),
 reach(root, node) AS (SELECT src, dst FROM own UNION SELECT root, e.dst FROM reach JOIN own e ON reach.node = e.src) SELECT node AS name FROM reach WHERE root IN (SELECT root FROM reach WHERE root = node) UNION SELECT root FROM reach WHERE root = node""")(
    lambda s, d: dag.cyclic_members(g(s, d)[0], g(s, d)[1].unionByName(_back(s, d)), within="cust"))


def _added(s, d):
    edges, no = dag.add_edges(g(s, d)[1], _back(s, d), "cust")
    edges, yes = dag.add_edges(edges, _edges(_orders(s, d), 3), "cust")
    return edges.drop("cust").withColumn("applied", F.lit(f"{no},{yes}"))


_q("J1_add_edges", _N, "SELECT p.name AS src, n.name AS dst, 'False,True' AS applied FROM nodes p JOIN nodes n ON p.cust = n.cust AND n.k - p.k IN (1, 2, 3)")(_added)
