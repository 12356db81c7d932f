"""From two tables over a pivot language to one: invert, join, compose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasepivot.functions.columns import compose_alignments, cooccurrence

#: Which of the two tables do not begin with the pivot phrase.
MODES = {"pspt": (False, False), "sppt": (True, False), "pstp": (False, True), "sptp": (True, True)}


def invert(table: DataFrame, swap_lexical: bool = False) -> DataFrame:
    """Both phrases, both translation probabilities and the ends of alignment points change places.

    The lexical weights stay where they are unless swap_lexical; counts stay."""
    lexical = ("lex_ts", "lex_st") if swap_lexical else ("lex_st", "lex_ts")
    turned = F.transform("align", lambda p: F.struct(p.t.alias("s"), p.s.alias("t")))
    return table.select(
        F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.col("phi_ts").alias("phi_st"), F.col(lexical[0]).alias("lex_st"), F.col("phi_st").alias("phi_ts"), F.col(lexical[1]).alias("lex_ts"), turned.alias("align"), "c_t", "c_s", "c_st"
    )


def pivot_first(a: DataFrame, b: DataFrame, mode: str, swap_lexical: bool = False) -> tuple[DataFrame, DataFrame]:
    """mode: of each table s(ource) or t(arget) and p(ivot), in the order of its phrases."""
    if mode not in MODES:
        raise ValueError(f"mode is {mode!r}, none of {', '.join(MODES)}")
    return tuple(invert(x, swap_lexical) if turn else x for x, turn in zip((a, b), MODES[mode]))


#: Most pivots that are split on account of their rows; they are broadcast.
HOT_PIVOTS = 10_000


def hot_pivots(a: DataFrame, b: DataFrame, hot_rows: int) -> DataFrame:
    """pvt, a_parts, b_parts: pivots of which the rows of a times those of b pass hot_rows squared, and into how many
    parts of about hot_rows either side's are dealt.  The HOT_PIVOTS of the largest products, if there are more."""
    n_a, n_b = (x.groupBy(F.col("src").alias("pvt")).agg(F.count(F.lit(1)).alias(n)) for x, n in ((a, "n_a"), (b, "n_b")))
    product = F.col("n_a").cast("double") * F.col("n_b").cast("double")
    parts = lambda n: F.ceil(F.col(n) / hot_rows).cast("int")
    found = n_a.join(n_b, "pvt").where(product > float(hot_rows) ** 2).orderBy(product.desc(), "pvt").limit(HOT_PIVOTS)
    return found.select("pvt", parts("n_a").alias("a_parts"), parts("n_b").alias("b_parts"))


def bridge(a: DataFrame, b: DataFrame, counts: str = "min", hot_rows: int | None = None) -> DataFrame:
    """A row for each two rows of a (pivot, source) and b (pivot, target) of one pivot phrase, unmerged.

    Probabilities multiply along the path; alignment points meet on pivot words;
    c_raw is the co-occurrence count by the named function, c_st the same cut to a
    whole number.  The pivot phrase is an equi-join key: AQE broadcasts a small
    side and splits the pivots that are met too often on one side.

    hot_rows: rows of a pivot that frequent pivots are split to, on both sides, as a product of two frequent sides is
    large however one of them is split.  A part of a's rows meets each part of b's in a task of its own, of about
    hot_rows squared results, and is copied for each of these.  This reads both tables once more, for their counts."""
    left = a.select(F.col("src").alias("pvt"), *(F.col(c).alias(f"a_{c}") for c in a.columns if c != "src"))
    right = b.select(F.col("src").alias("pvt"), *(F.col(c).alias(f"b_{c}") for c in b.columns if c != "src"))
    on = ["pvt"]
    if hot_rows:
        hot = F.broadcast(hot_pivots(a, b, hot_rows))  # HOT_PIVOTS rows at most
        part = lambda phrase, parts: F.coalesce(F.pmod(F.xxhash64(phrase), F.col(parts)).cast("int"), F.lit(0))
        each = lambda parts: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))
        left = left.join(hot, "pvt", "left").withColumn("_i", part("a_tgt", "a_parts")).withColumn("_j", each("b_parts")).drop("a_parts", "b_parts")
        right = right.join(hot, "pvt", "left").withColumn("_j", part("b_tgt", "b_parts")).withColumn("_i", each("a_parts")).drop("a_parts", "b_parts")
        on = ["pvt", "_i", "_j"]
    x = left.join(right, on)
    raw = cooccurrence(counts, F.col("a_c_st"), F.col("b_c_st"))
    return x.select(
        F.col("a_tgt").alias("src"), F.col("b_tgt").alias("tgt"), "pvt",
        (F.col("a_phi_ts") * F.col("b_phi_st")).alias("phi_st"), (F.col("a_lex_ts") * F.col("b_lex_st")).alias("lex_st"),
        (F.col("a_phi_st") * F.col("b_phi_ts")).alias("phi_ts"), (F.col("a_lex_st") * F.col("b_lex_ts")).alias("lex_ts"),
        compose_alignments(F.col("a_align"), F.col("b_align")).alias("align"),
        F.col("b_c_t").alias("c_t"), F.col("a_c_t").alias("c_s"), raw.alias("c_raw"), raw.cast("bigint").alias("c_st"),
    )


def table_limit(table: DataFrame, k: int) -> DataFrame:
    """At most k targets of each source phrase, by phi_ts; ties go to the smaller target."""
    from pyspark.sql import Window

    order = Window.partitionBy("src").orderBy(F.desc("phi_ts"), "tgt")
    return table.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
