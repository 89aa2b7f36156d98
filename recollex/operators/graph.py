"""Bounded traversal and views of a property graph kept in two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.runtime import stored


def explore(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "outgoing") -> DataFrame:
    """``(seed, node, depth)``: nodes reached from each seed in at most ``depth`` (1..5) steps, with the fewest.

    ``edges`` is (src, dst), ``seeds`` is (seed).  Each step joins the frontier
    with the edges and drops what earlier steps reached; what a step adds is
    stored once, so lineage doesn't grow and nothing is rewritten.  Cycles and repeated edges do no harm, the seed itself
    is left out, unknown seeds reach nothing.
    """
    depth = min(5, max(1, depth))
    out, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    links = {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction].where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    frontier = seeds.select("seed", F.col("seed").alias("node")).distinct()
    steps: list[DataFrame] = []
    for step in range(1, depth + 1):
        met = frontier.join(links.withColumnRenamed("src", "node"), "node").select("seed", F.col("dst").alias("node")).where("seed <> node").distinct()
        for before in steps:
            met = met.join(before.select("seed", "node"), ["seed", "node"], "left_anti")
        fresh = stored(met.withColumn("depth", F.lit(step)), "reached")
        steps.append(fresh)
        frontier = fresh.select("seed", "node")
    out = steps[0]
    for later in steps[1:]:
        out = out.unionByName(later)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)``: edges in and out; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    return edges.join(nodes.select(F.col(node).alias("src")), "src", "left_semi").join(nodes.select(F.col(node).alias("dst")), "dst", "left_semi")


def named_relations(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """``(src, relations)``: for each entity its outgoing (relation, target name), sorted."""
    names = entities.select(F.col("entity").alias("dst"), "name")
    return edges.join(names, "dst").groupBy("src").agg(F.sort_array(F.collect_set(F.struct("relation", "name"))).alias("relations"))
