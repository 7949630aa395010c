"""Queries over the property graph of the trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import graph
from lattica.plans import tables
from lattica.plans.registry import query


@query(
    sql=tables.with_sql(tables.GRAPH_SQL)
    + "SELECT node_id, count(*) AS relation_count FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node_id",
    headline=True,
)
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations per node."""
    return graph.degrees(tables.edges(spark, sf_dir))


@query(
    sql=tables.with_sql(tables.GRAPH_SQL)
    + "SELECT DISTINCT node_id AS seed, neighbor FROM steps WHERE node_id IN (SELECT node_id FROM nodes WHERE class = 'Nation')"
)
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of all nations in both directions."""
    seeds = tables.nodes(spark, sf_dir).filter(F.col("class") == "Nation")
    return graph.neighbors(seeds, tables.edges(spark, sf_dir))


@query(
    sql=tables.with_sql(
        tables.GRAPH_SQL,
        """
walk AS (SELECT node_id AS seed, node_id, 0 AS hops FROM nodes WHERE class = 'Region'
  UNION SELECT w.seed, s.neighbor, w.hops + 1 FROM walk w JOIN steps s ON s.node_id = w.node_id WHERE w.hops < 3)""",
    )
    + "SELECT seed, node_id, CAST(min(hops) AS BIGINT) AS hops FROM walk GROUP BY seed, node_id",
    headline=True,
)
def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything within three steps of each region, with the smallest distance."""
    seeds = tables.nodes(spark, sf_dir).filter(F.col("class") == "Region")
    return graph.reachable(seeds, tables.edges(spark, sf_dir), depth=3)


@query(
    sql=tables.with_sql(tables.GRAPH_SQL)
    + """SELECT src, predicate, dst, confidence FROM edges
WHERE src IN (SELECT node_id FROM nodes WHERE class IN ('Supplier', 'Region')) OR dst IN (SELECT node_id FROM nodes WHERE class IN ('Supplier', 'Region'))"""
)
def graph_incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges touching suppliers or regions."""
    ids = tables.nodes(spark, sf_dir).filter(F.col("class").isin("Supplier", "Region"))
    return graph.incident_edges(ids, tables.edges(spark, sf_dir))


@query(
    sql=tables.with_sql(tables.GRAPH_SQL)
    + """SELECT src, predicate, dst, confidence FROM edges
WHERE src IN (SELECT node_id FROM nodes WHERE class IN ('Customer', 'Nation', 'Region')) AND dst IN (SELECT node_id FROM nodes WHERE class IN ('Customer', 'Nation', 'Region'))"""
)
def graph_induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among customers, nations and regions."""
    ids = tables.nodes(spark, sf_dir).filter(F.col("class").isin("Customer", "Nation", "Region"))
    return graph.induced_subgraph(ids, tables.edges(spark, sf_dir))


@query(
    sql=tables.with_sql(tables.GRAPH_SQL)
    + "SELECT node_id, text AS name, '[' || class || '] - ' || text || shown AS content FROM nodes"
)
def graph_node_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node as text, with its display name."""
    return tables.nodes(spark, sf_dir).select(
        "node_id",
        graph.display_name(F.col("properties")).alias("name"),
        graph.node_text(F.col("class"), F.col("text"), F.col("properties")).alias("content"),
    )


@query(
    sql=tables.with_sql(tables.GRAPH_SQL)
    + """SELECT e.src, e.predicate, e.dst, coalesce(s.text, e.src) || ' [' || e.predicate || '] ' || coalesce(o.text, e.dst) AS content
FROM edges e LEFT JOIN nodes s ON s.node_id = e.src LEFT JOIN nodes o ON o.node_id = e.dst"""
)
def graph_edge_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge as text with the names of its ends."""
    found = graph.edge_texts(tables.edges(spark, sf_dir), tables.nodes(spark, sf_dir))
    return found.select("src", "predicate", "dst", "content")


@query(
    sql=tables.with_sql(tables.GRAPH_SQL)
    + """SELECT d.node_id, d.direction, d.predicate, d.other_id, coalesce(n.text, d.other_id) AS other_name FROM (
  SELECT src AS node_id, predicate, dst AS other_id, 'outgoing' AS direction FROM edges
  UNION ALL SELECT dst, predicate, src, 'incoming' FROM edges) d
JOIN nodes w ON w.node_id = d.node_id AND w.class = 'Customer' LEFT JOIN nodes n ON n.node_id = d.other_id"""
)
def graph_entity_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming and outgoing relations of every customer."""
    nodes = tables.nodes(spark, sf_dir)
    return graph.entity_details(nodes.filter(F.col("class") == "Customer"), nodes, tables.edges(spark, sf_dir))


@query(
    sql=tables.with_sql(tables.GRAPH_SQL)
    + """SELECT n.node_id, a.dst AS first, b.dst AS second FROM nodes n JOIN edges a ON a.src = n.node_id AND a.predicate = 'inNation'
JOIN edges b ON b.src = n.node_id AND b.predicate = 'placed' WHERE n.class = 'Customer'"""
)
def graph_star_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation and each of their orders."""
    return graph.star_pattern(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), "Customer", "inNation", "placed")


@query(
    sql=tables.with_sql(tables.GRAPH_SQL)
    + "SELECT node_id, text FROM nodes WHERE contains(text, 'er#00000000') ORDER BY node_id LIMIT 100"
)
def graph_entity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose text contains a term, in id order."""
    return graph.list_entities(tables.nodes(spark, sf_dir), search="er#00000000").select("node_id", "text")


@query(
    sql=tables.with_sql(tables.GRAPH_SQL) + "SELECT node_id, text FROM nodes WHERE class = 'Supplier' ORDER BY node_id LIMIT 100"
)
def graph_entities_of_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a class in id order."""
    return graph.list_entities(tables.nodes(spark, sf_dir), node_class="Supplier").select("node_id", "text")
