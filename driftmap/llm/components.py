"""Connected components of a table of links, in rounds of joins; nothing goes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.functions.joins import salted_join
from driftmap.sources.scratch import materialize


def _settled(edges: DataFrame) -> bool:
    """Does every node have one edge, to a node that has none?"""
    ends = edges.select(F.col("u").alias("v")).distinct()
    return edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty() and edges.join(ends, "v", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every node of ``links`` (a, b) but the smallest of each component, which
    is its component_id.  Each round ties a node's neighbours to the smallest and then shortens paths,
    so a chain of n links takes about log n rounds.  Joins are salted: a hub is no burden to one task.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "edges")
    while not _settled(edges):
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = salted_join(edges, least, ["u"], ["v"]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        near = materialize(near, "near")
        onward = near.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        edges = materialize(salted_join(near, onward, ["v"], ["u"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
