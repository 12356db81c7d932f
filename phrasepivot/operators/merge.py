"""Rows of one phrase pair, by whatever pivot phrases, become one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasepivot.functions.columns import clip, ratio, union_alignments
from phrasepivot.schema import FEATURES

#: Of a feature and the number of rows.  Sums are cut to 1 where rows merged; a row of its own stays as it is.
FEATURE_MERGES = {
    "sum": lambda f, n: F.when(n > 1, clip(F.sum(f))).otherwise(F.first(f)),
    "max": lambda f, n: F.max(f),
    "occ": lambda f, n: F.first(f),
}
FEATURE_MERGES |= {"summation": FEATURE_MERGES["sum"], "maximization": FEATURE_MERGES["max"]}


def aligned_paths(bridged: DataFrame, how: str = "sum") -> DataFrame:
    """The unmerged rows of one pair and one alignment as one row: features by how (unclipped), c_raw and c_st summed, and
    paths, their number.

    Merged pairs and word counts both come from these rows as they would from the unmerged ones, as words depend on
    the pair and its alignment only."""
    fold = {"summation": F.sum, "sum": F.sum, "maximization": F.max, "max": F.max}.get(how, F.first)
    return bridged.groupBy("src", "tgt", "align").agg(*(fold(f).alias(f) for f in FEATURES), F.sum("c_raw").alias("c_raw"), F.sum("c_st").alias("c_st"), F.count(F.lit(1)).alias("paths"))


def merge(bridged: DataFrame, how: str = "sum") -> DataFrame:
    """src, tgt, features, align (the union) and c_st (the sum) of each phrase pair, of unmerged rows or of aligned_paths."""
    fold, n = FEATURE_MERGES[how], F.sum("paths") if "paths" in bridged.columns else F.count(F.lit(1))
    return bridged.groupBy("src", "tgt").agg(*(fold(f, n).alias(f) for f in FEATURES), union_alignments(F.col("align")).alias("align"), F.sum("c_st").alias("c_st"))


def marginals(table: DataFrame, by: str, name: str) -> DataFrame:
    return table.groupBy(by).agg(F.sum("c_st").alias(name))


def with_marginals(merged: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """c_t and c_s: sums of c_st by target and by source phrase, of the merged rows or of those that they were merged from,
    which spares the marginals the merge.

    Sums are pre-aggregated and joined, so that a phrase of very many rows isn't
    gathered in one task as a window would."""
    table = merged.drop("c_t", "c_s")
    rows = table if rows is None else rows
    table = table.join(marginals(rows, "tgt", "c_t"), "tgt").join(marginals(rows, "src", "c_s"), "src")
    return table.select("src", "tgt", *FEATURES, "align", "c_t", "c_s", "c_st")


def estimated_probabilities(table: DataFrame) -> DataFrame:
    """phi_st and phi_ts anew from the counts; 0 where there are none."""
    return table.withColumn("phi_st", ratio(F.col("c_st"), F.col("c_t"))).withColumn("phi_ts", ratio(F.col("c_st"), F.col("c_s")))
