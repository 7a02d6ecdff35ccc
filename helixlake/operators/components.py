"""Connected components of an edge list, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import save


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", vertices: DataFrame | None = None) -> DataFrame:
    """(node, component) of every vertex; a component is named by its smallest vertex.

    Each round every vertex joins its least neighbour, in an order hashed anew, if that is less than itself; edges
    between what is left go on to the next round. The order makes the number of vertices fall by a constant factor a
    round, whatever the graph's shape, so long paths take no more than a logarithm of their length. Rounds are cut by
    written tables; a hub's edges are never gathered in one task (only minima are taken, and joins can be split).
    ``vertices`` (one column, node) adds isolated vertices.
    """
    now = save(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v").distinct(), "edges")
    parents: list[DataFrame] = []
    first = left = now.count()
    while left:
        rank = len(parents)

        def place(name: str, salt: int = rank):
            return F.struct(F.xxhash64(F.col(name), F.lit(salt)), F.col(name).alias("id"))

        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(place("v")).alias("m"))
        parent = save(least.select(F.col("u").alias("node"), F.least(F.col("m"), place("u"))["id"].alias("up")), "parents", rows=2 * left)
        parents.append(parent)
        moved = now.join(parent.withColumnsRenamed({"node": "u", "up": "pu"}), "u").join(parent.withColumnsRenamed({"node": "v", "up": "pv"}), "v")
        now = save(moved.select(F.col("pu").alias("u"), F.col("pv").alias("v")).filter("u <> v").distinct(), "edges", rows=left)
        left = now.count()
    if parents:
        found = parents[-1].select("node", F.col("up").alias("root"))
        for parent in reversed(parents[:-1]):
            top = found.withColumnsRenamed({"node": "up", "root": "above"})
            found = parent.join(top, "up", "left").select("node", F.coalesce("above", "up").alias("root"))
        found = save(found, "roots", rows=2 * first)
    else:
        found = now.select(F.col("u").alias("node"), F.col("u").alias("root"))
    # written apart, so that the join of a component that holds very many vertices can be split over tasks
    names = save(found.groupBy("root").agg(F.min("node").alias("component")), "component-names", rows=2 * first)
    named = found.join(names, "root").select("node", "component")
    if vertices is not None:  # those without edges need no name
        alone = vertices.select("node").distinct().join(found, "node", "left_anti")
        named = named.unionByName(alone.select("node", F.col("node").alias("component")))
    return named
