"""Phrase pair counts of an endless stream of bridged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(stream: DataFrame) -> DataFrame:
    """src, tgt, c_st so far; for outputMode update or complete.  Rows need src, tgt and c_st."""
    return stream.groupBy("src", "tgt").agg(F.sum("c_st").alias("c_st"))
