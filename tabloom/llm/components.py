"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import cut, join_hot


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u, v) of longs, undirected -> (id, component_id), one row for each vertex of an edge.

    component_id is the smallest id reachable, the vertex itself included. Each round joins every vertex with the
    smallest of its neighbours: no list of neighbours is ever gathered and vertices with many edges meet theirs without a
    shuffle, so one vertex may hold any share of the edges.
    Self-loops, repeated edges and nulls are ignored; an empty table gives an empty table.
    """
    e = cut(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    before = _state(e)
    for _ in range(most_rounds):
        # large star: what is larger than u goes to the smallest neighbour of u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "low")
        large = join_hot(both, low, "u", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and what is smaller than u go to the smallest of them
        large = cut(large, "large")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        small = join_hot(large, low, "u", before[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
