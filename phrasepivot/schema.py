"""The relations of the engine."""

from pyspark.sql import types as T

FEATURES = ("phi_st", "lex_st", "phi_ts", "lex_ts")
COUNTS = ("c_t", "c_s", "c_st")
ALIGNMENT = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("t", T.IntegerType())]))

#: c_t and c_s are the counts of the target and source phrase, c_st of both together (null where not given).
PHRASE_TABLE = T.StructType(
    [T.StructField("src", T.StringType()), T.StructField("tgt", T.StringType())]
    + [T.StructField(f, T.DoubleType()) for f in FEATURES]
    + [T.StructField("align", ALIGNMENT)]
    + [T.StructField(c, T.LongType()) for c in COUNTS]
)
#: c: count of the word pair; c_e and c_f: of its source and of its target word.
LEXICON = T.StructType([T.StructField(n, T.StringType()) for n in ("s", "t")] + [T.StructField(n, T.DoubleType()) for n in ("c", "c_e", "c_f")])
#: The word that an unaligned word is paired with.
NULL_WORD = "NULL"
