"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasepivot.llm.common import Staged


def _shape(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another node;
    component is the smallest node reachable.

    Alternates large-star and small-star steps, each a minimum by node and a
    join, so that a hub of any degree is pre-aggregated before the shuffle and
    split by AQE in the join.  Each round is written to the shared folder; the
    driver sees three numbers of it.  Edges with a null end and loops are
    ignored; repeated edges do no harm; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    uv = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    now = Staged(spark, uv.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    shape = _shape(now.df)
    for _ in range(max_rounds):
        if not shape[0]:
            break
        # small star: u's smaller neighbours and u go to the smallest of them
        low = now.df.groupBy("u").agg(F.min("v").alias("m"))
        small = now.df.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        # large star: u's larger neighbours go to the smallest of u and all its neighbours
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        after = Staged(spark, large, "edges")
        now.drop()  # a later deletion of what is gone does no harm
        now, before, shape = after, shape, _shape(after.df)
        if shape == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
