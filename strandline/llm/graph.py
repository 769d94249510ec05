"""Connected components by alternating star contraction, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandline.llm._shared import scratch, written


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` written, and their number and checksum, taken by the same job."""
    seen = Observation()
    state = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("check")
    table = written(edges.observe(seen, *state), "edges")
    return table, (seen.get["n"], seen.get["check"])


def _hang(edges: DataFrame, only_larger: bool) -> DataFrame:
    """Hang each neighbour v of u on the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    # written, so that both sides of the join are plain exchanges and Spark can split the partition of a hub
    least = written(least, "least")
    joined = edges.join(least, "u")
    if only_larger:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return down.select("e.u", "e.v").filter("u <> v")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): component is the least node that it can reach.

    Nodes without an edge are not in the result. Loops and repeated edges are allowed; an empty table gives an
    empty result. The rounds grow with the logarithm of the longest path; each ends in a written table, and only the
    last one is left behind.
    """
    flat = edges.select("u", "v").filter("u <> v")
    with scratch(edges.sparkSession) as keep:
        now, before = _counted(flat.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        for _ in range(max_rounds):
            if not before[0]:
                break
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _hang(both, True).distinct()
            now, after = _counted(_hang(large, False).distinct())
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return keep(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
