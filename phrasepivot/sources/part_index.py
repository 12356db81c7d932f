"""A phrase table in parts with an index of these, so that a lookup of phrases opens few of them.

Parts are ranges of source phrases.  The index has a row for each: its file, its first and last phrase, and a Bloom
filter of all its phrases, as 64-bit words; it lies beside the parts under a name that Spark's readers pass over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for each phrase of the largest part, and places that a phrase has; about one of a hundred phrases that a part
#: lacks is then taken for one of its.
BITS, PLACES = 10, 7
INDEX = "_index"


def _places(phrase: Column, bits: int) -> Column:
    """Distinct places of a phrase among so many bits."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(PLACES)), lambda i: F.pmod(F.xxhash64(i, phrase), F.lit(bits).cast("long"))))


def _mask(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def write_indexed(table: DataFrame, path: str, parts: int) -> None:
    """Writes a phrase table as Parquet, in at most so many parts by src, and their index.

    Null source phrases are in no index and are found by no lookup.  The index is made of the written parts' phrases,
    which are read once more; a part's filter has as many bits as its distinct phrases need, the largest part's for all."""
    spark = table.sparkSession
    table.repartitionByRange(parts, "src").sortWithinPartitions("src", "tgt").write.mode("overwrite").option("compression", "zstd").parquet(path)
    phrases = spark.read.parquet(path).where("src is not null").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "src").groupBy("file", "src").agg(F.lit(1).alias("one"))
    sizes = phrases.groupBy("file").agg(F.count(F.lit(1)).alias("phrases"), F.min("src").alias("first"), F.max("src").alias("last"))
    largest = sizes.agg(F.max("phrases").alias("n")).first().n or 1
    bits = 64 * -(-BITS * largest // 64)
    words = phrases.select("file", F.explode(_places(F.col("src"), bits)).alias("place")).groupBy("file", F.floor(F.col("place") / 64).cast("int").alias("word")).agg(F.bit_or(_mask(F.col("place"))).alias("mask"))
    filters = words.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("filter"))
    sizes.join(filters, "file").select("file", "first", "last", "phrases", F.lit(bits).cast("long").alias("bits"), "filter").write.mode("overwrite").parquet(f"{path}/{INDEX}")


def parts_of(spark: SparkSession, path: str, phrases: DataFrame, column: str = "src") -> list[str]:
    """Files of the parts that may have one of the phrases: all that do, and few that don't.

    Ranges don't overlap, so a phrase has one part to ask: by the parts' first phrases, which are a row for each part.
    It and its part's filter then meet in a join."""
    index = spark.read.parquet(f"{path}/{INDEX}")
    heads = index.select("first", "last", "file", "bits").orderBy("first").collect()
    if not heads:
        return []
    firsts = F.array(*(F.lit(r["first"]) for r in heads))
    files = F.array(*(F.lit(r.file) for r in heads))
    asked = phrases.select(F.col(column).alias("phrase")).where("phrase is not null").distinct()
    at = F.size(F.filter(firsts, lambda f: f <= F.col("phrase")))
    asked = asked.where(at > 0).select("phrase", F.element_at(files, at).alias("file"))
    asked = asked.withColumn("places", _places(F.col("phrase"), heads[0].bits))
    met = asked.join(index, "file").where(F.col("phrase") <= F.col("last"))
    met = met.where(F.forall("places", lambda p: F.coalesce(F.try_element_at("filter", F.floor(p / 64).cast("int")), F.lit(0).cast("long")).bitwiseAND(_mask(p)) != 0))
    return sorted(f"{path}/{r.file}" for r in met.select("file").distinct().collect())  # a row a part


def lookup(spark: SparkSession, path: str, phrases: DataFrame, column: str = "src") -> DataFrame:
    """Rows of an indexed table whose source phrase is one of the phrases; opens the parts that may have it."""
    found = parts_of(spark, path, phrases, column)
    table = spark.read.parquet(*found) if found else spark.read.parquet(path).where("false")
    return table.join(phrases.select(F.col(column).alias("src")).distinct(), "src", "left_semi")
