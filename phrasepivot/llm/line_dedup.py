"""Lines that several documents hold stay in one of them: lines are exploded, hashed and counted, and texts put
together again by the places of what is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasepivot.llm.common import Carried, Staged, ascii_lower

_SPACES = " \t\n\v\f\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(_SPACES))
    # of ASCII alone, lower() changes A-Z only, and is quicker
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def _without(lines: Column, places: Column) -> Column:
    """The array without what lies at places (from 0, ascending): the runs between them, one after the other."""
    before, after = F.concat(F.array(F.lit(-1)), places), F.concat(places, F.array(F.size(lines)))
    return F.flatten(F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def dedup_lines(docs: DataFrame, min_documents: int = 2, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, the text without lines that occur elsewhere, then n_lines (before dropping) and n_dropped, long.

    A line's key is the line stripped of ASCII white space and A-Z lower-cased.  Of a key of min_chars code points or
    more that min_documents distinct ids hold, all lines go but those of the smallest of these ids.

    Keys are 128 bits of two hashes.  A key's documents are counted before the shuffle (for two documents by the
    smallest and the largest id), so a line of very many documents is a few rows; the keys over the threshold become
    a table that the lines meet in a join, which Spark splits where a key is met too often.  Texts are shuffled once.

    A null text is empty, which is one empty line.  A null id is one document, after all others.  Rows of one id are
    one document; they keep its lines all together, and repeated rows stay.  An empty table gives an empty result.
    Columns of docs named n_lines or n_dropped are left out."""
    spark, own = docs.sparkSession, {id_col.lower(), text_col.lower(), "n_lines", "n_dropped"}
    rest = Carried(docs, [c for c in docs.columns if c.lower() not in own])
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *rest.columns)
    texts = texts.withColumn("version", F.xxhash64("text"))  # tells rows of one id apart
    lines = texts.select("id", "version", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    keyed = lines.select("id", "version", "place", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    keyed = keyed.select("id", "version", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))

    none = F.coalesce(F.bool_or(F.col("id").isNull()), F.lit(False)).cast("int")
    if min_documents <= 2:
        many = F.when(F.min("id") < F.max("id"), 2).when(F.min("id").isNotNull(), 1).otherwise(0)
    else:
        many = F.count_distinct("id")
    counted = keyed.groupBy("h1", "h2").agg((many + none).alias("documents"), F.min("id").alias("first"))
    # a table of its own, as Spark splits a frequent key only where both sides of the join are dealt for it
    repeated = Staged(spark, counted.where(F.col("documents") >= min_documents).select("h1", "h2", "first"), "lines").df
    dropped = keyed.join(repeated, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first")))
    dropped = dropped.groupBy(F.col("id").alias("of"), F.col("version").alias("of_version")).agg(F.sort_array(F.collect_set("place")).alias("places"))

    out = texts.join(dropped, F.col("id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("of_version")), "left")
    split = F.split("text", "\n")
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(_without(split, F.col("places")), "\n"))
    n_dropped = F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long")
    out = out.select("*", kept.alias("kept"), F.size(split).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))
    named = {id_col: "id", text_col: "kept"} | dict(zip(rest.names, rest.inside))
    return out.select(*(F.col(named[c]).alias(c) for c in docs.columns if c in named), "n_lines", "n_dropped")
