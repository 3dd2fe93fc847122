"""Directed graphs as two tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes_and_edges(rows: DataFrame, node: str, relationships: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with attributes, with edge ends that have none, and distinct edges without nulls."""
    edges = rows.select(F.explode(relationships).alias("r")).select(F.col("r.source").alias("src"), F.col("r.target").alias("dst")).where("src is not null and dst is not null").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias(node)).distinct()
    return ends.join(rows.drop(relationships), node, "full_outer"), edges


def neighbours(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias(node)).agg(F.sort_array(F.collect_set("dst")).alias("out"))
    kind = dict(out.dtypes)["out"]
    return nodes.select(node).join(out, node, "left").withColumn("out", F.coalesce("out", F.array().cast(kind)))


def known_edges(edges: DataFrame, nodes: DataFrame, node: str, attrs: list[str]) -> DataFrame:
    a = nodes.select(F.col(node).alias("src"), *[F.col(c).alias(f"src_{c}") for c in attrs])
    b = nodes.select(F.col(node).alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in attrs])
    return edges.join(a, "src").join(b, "dst")


def shortest_path(edges: DataFrame, start: object, goal: object, save: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """(step, node) of one shortest path, of several the one with the least predecessors; empty
    where the goal cannot be reached, or not in ``most`` steps if that is given.

    Breadth-first rounds: each joins the frontier with the edges and keeps the least
    predecessor of every new node.  Each round's nodes are a table of their own, so a round
    reads no more than the frontier, the edges and the nodes seen.  The way back goes through
    the rounds' tables, one predecessor in each.
    """
    spark = edges.sparkSession
    e = save(edges.select("src", "dst").distinct())
    kind = dict(e.dtypes)["src"]
    start_, goal_ = F.lit(start).cast(kind), F.lit(goal).cast(kind)
    rounds = [save(spark.range(1).select(start_.alias("node"), F.lit(None).cast(kind).alias("pred")))]
    found, seen, merged = not rounds[0].where(F.col("node") == goal_).isEmpty(), rounds[0].select("node"), 1
    while not found and (most is None or len(rounds) <= most):
        front = rounds[-1].select(F.col("node").alias("src"))
        new = e.join(front, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("pred"))
        if len(rounds) - merged >= 16:  # few tables to read, each row written anew once in 16 rounds
            seen, merged = save(reduce(DataFrame.unionByName, [r.select("node") for r in rounds[merged:]], seen)), len(rounds)
        known = reduce(DataFrame.unionByName, [r.select("node") for r in rounds[merged:]], seen)
        rounds.append(save(new.join(known, "node", "left_anti")))
        if rounds[-1].isEmpty():
            break
        found = not rounds[-1].where(F.col("node") == goal_).isEmpty()
    if not found:
        return spark.createDataFrame([], f"step int, node {kind}")
    path, node = [], goal
    for step in range(len(rounds) - 1, -1, -1):
        path.append((step, node))
        node = rounds[step].where(F.col("node") == F.lit(node).cast(kind)).first()["pred"]
    return spark.createDataFrame(path, f"step int, node {kind}")
