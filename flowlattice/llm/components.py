"""Connected components of an edge list by alternating star contractions.

Every round is two joins and two aggregations on the edges; nothing is gathered
on the driver but a count and a checksum per round.  The edge list is written to
the shared folder after each round, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.llm.storage import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns); root is the smallest node reachable.

    Self-loops, repeated and reversed edges are allowed; no edges give no rows.
    """
    a, b = edges.columns
    stars = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
        if state == before or not state[0]:
            break
        before = state
        stars = materialise(_small_star(_large_star(stars)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
