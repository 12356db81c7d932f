"""Word counts of bridged pairs, and lexical weights from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasepivot.functions.columns import ratio, tokens, unaligned
from phrasepivot.schema import NULL_WORD
from phrasepivot.sources.files import staged
from phrasepivot.sources.shipping import ship

#: Most rows of a lexicon that is broadcast.
SMALL_LEXICON = 100_000


def word_pairs() -> Column:
    """Array of (s, t, i, j): aligned words, and unaligned ones with NULL (place -1), of columns src, tgt, align.

    Points beyond a phrase's words are dropped."""
    s, t = tokens(F.col("src")), tokens(F.col("tgt"))

    def pair(a: Column, b: Column, i: Column, j: Column) -> Column:
        return F.struct(a.alias("s"), b.alias("t"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    none, null = F.lit(-1), F.lit(NULL_WORD)
    met = F.transform("align", lambda p: pair(F.get(s, p.s), F.get(t, p.t), p.s, p.t))
    met = F.filter(met, lambda p: p.s.isNotNull() & p.t.isNotNull())
    left = F.transform(unaligned(F.col("src"), F.col("align"), "s"), lambda i: pair(F.get(s, i), null, i, none))
    right = F.transform(unaligned(F.col("tgt"), F.col("align"), "t"), lambda j: pair(null, F.get(t, j), none, j))
    return F.concat(met, left, right)


def build_lexicon(bridged: DataFrame) -> DataFrame:
    """LEXICON of unmerged rows: each aligned pair, and each unaligned word with NULL, counts c_raw."""
    words = bridged.select(F.explode(word_pairs()).alias("w"), F.col("c_raw").alias("x")).select("w.s", "w.t", "x")
    pairs = words.groupBy("s", "t").agg(F.sum("x").alias("c"))
    by_s, by_t = (pairs.groupBy(k).agg(F.sum("c").alias(n)) for k, n in (("s", "c_e"), ("t", "c_f")))
    return pairs.join(by_s, "s").join(by_t, "t").select("s", "t", "c", "c_e", "c_f")


def with_lexical_weights(merged: DataFrame, lexicon: DataFrame) -> DataFrame:
    """lex_st and lex_ts anew: over a phrase's words the product of the mean probability given the words
    that each is aligned to, or given NULL.  Words without counts give 0.

    A lexicon of up to SMALL_LEXICON rows goes to the rows, which stay where they are.  For a larger one the rows become a
    table with a number for each, so that words go about with a number and not with both phrases."""
    lexicon = staged(lexicon, "words")
    if lexicon.count() <= SMALL_LEXICON:
        return _weighed_in_place(merged, lexicon)
    table = staged(merged.withColumn("_pair", F.monotonically_increasing_id()), "weighed")
    words = table.select("_pair", F.explode(word_pairs()).alias("w")).select("_pair", "w.*")
    looked = words.join(lexicon, ["s", "t"], "left")
    looked = looked.select("_pair", "i", "j", ratio(F.col("c"), F.col("c_f")).alias("st"), ratio(F.col("c"), F.col("c_e")).alias("ts"))
    # both directions in one pass: a source word's mean goes to st, a target word's to ts; a pair's rows are dealt once,
    # for its words' means and for their product, and before each becomes two
    looked = looked.repartition("_pair")
    side = lambda name, at: F.struct(F.lit(name).alias("side"), F.col(at).alias("at"), F.col(name).alias("p"))
    sides = looked.select("_pair", F.explode(F.array(side("st", "i"), side("ts", "j"))).alias("x")).select("_pair", "x.*").where("at >= 0")
    means = sides.groupBy("_pair", "side", "at").agg(F.avg("p").alias("p"))
    weights = means.groupBy("_pair").agg(F.product(F.when(F.col("side") == "st", F.col("p"))).alias("_st"), F.product(F.when(F.col("side") == "ts", F.col("p"))).alias("_ts"))
    out = table.join(weights, "_pair", "left")
    return out.withColumn("lex_st", F.coalesce("_st", F.lit(0.0))).withColumn("lex_ts", F.coalesce("_ts", F.lit(0.0))).select(*merged.columns)


def _weighed_in_place(merged: DataFrame, lexicon: DataFrame) -> DataFrame:
    """with_lexical_weights by a lexicon that every task has whole."""
    spark, names = merged.sparkSession, merged.columns
    ship(spark)
    held = lexicon.select(F.concat_ws(" ", "s", "t").alias("key"), ratio(F.col("c"), F.col("c_f")).alias("st"), ratio(F.col("c"), F.col("c_e")).alias("ts")).toPandas()  # SMALL_LEXICON rows at most
    sent = spark.sparkContext.broadcast((held["key"].to_list(), held["st"].to_numpy(float), held["ts"].to_numpy(float)))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        keys, *given = sent.value
        keys = pa.array(keys, pa.string())

        def product_of_means(row, at, p, n):
            """Over each row's places the product of the mean of p at a place; 0 for a row without any."""
            row, at, p = (v[at >= 0] for v in (row, at, p))
            wide = int(at.max(initial=0)) + 1
            place, of = np.unique(row * wide + at, return_inverse=True)
            out = np.ones(n)
            np.multiply.at(out, place // wide, np.bincount(of, p, len(place)) / np.maximum(np.bincount(of, minlength=len(place)), 1))
            return np.where(np.bincount(row, minlength=n) > 0, out, 0.0)

        for b in batches:
            words, n = b.column(b.num_columns - 1), b.num_rows
            row, flat = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(words), 0)), words.flatten()
            asked = pc.binary_join_element_wise(flat.field("s").cast(pa.string()), flat.field("t").cast(pa.string()), " ")
            found = np.asarray(pc.fill_null(pc.index_in(asked, value_set=keys), -1))
            columns = dict(zip(names, b.columns))
            for name, at, p in (("lex_st", "i", given[0]), ("lex_ts", "j", given[1])):
                columns[name] = pa.array(product_of_means(row, np.asarray(flat.field(at)).astype(np.int64), np.append(p, 0.0)[found], n))
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return merged.withColumn("_words", word_pairs()).mapInArrow(run, merged.schema)
