"""Connected components of an edge table, by alternating large and small stars.

Each round every vertex points its neighbours to the smallest vertex it knows; the rounds needed grow with
the logarithm of the longest path, not with its length. Rounds are written to the shared folder, which cuts
the lineage. Edges of one vertex are reduced by min aggregation, so a vertex with very many edges is
combined map-side and is no hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemflow.session import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of an edge; the component is its smallest vertex.

    Null ends and loops add nothing; repeated and reversed edges count once. No edges give no rows.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna().where("u <> v")
    state = materialise(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")

    def checksum(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = checksum(state)
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("m"))
        # large star: larger neighbours go to the smallest
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours, and the vertex, go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        state = materialise(small.where("u <> v").distinct(), "cc")
        now = checksum(state)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
