"""Connected components of links between nodes. A node's links are dealt into SALTS parts
where they are joined, so that those of a hub are not one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Workspace


SALTS = 8


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """Adds m to links(a, b)."""
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    all_salts = F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])).alias("salt")
    return dealt.join(least.select("a", "m", all_salts), ["a", "salt"]).select("a", "b", "m")


def components(ws: Workspace, links: DataFrame, name: str, most: int = 60) -> DataFrame:
    """links(a, b) to (node, root), root being the least node that is reachable. Nodes
    without links aren't listed.

    Large and small stars in turn: links are moved to the least neighbour until each node
    is linked with the root alone. A round is an aggregation (which shrinks before it is
    shuffled) and a join with it; each is written, so a lost executor costs a task."""
    links = ws.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state = None
    for k in range(1, most + 1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # only nodes with a greater neighbour move links
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("top")).where("top > a").select("a", F.least("a", "m").alias("m"))
        large = _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(down, least).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        links = ws.write(small.where("a <> b").distinct(), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"links have not settled after {most} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
