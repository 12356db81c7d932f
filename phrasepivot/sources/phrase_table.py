"""Phrase tables and lexical files as text."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasepivot.functions.columns import format_f7, format_g6, line_key, show_alignment, strip, tokens
from phrasepivot.schema import COUNTS, FEATURES
from phrasepivot.sources.files import is_dir, is_file, lines, staged, write_lines

_POINT = r"^[+]?[0-9]+-[+]?[0-9]+$"


def resolve_model(spark: SparkSession, path: str) -> str:
    """A phrase table's file, or that of a model directory."""
    if is_file(spark, path) or is_file(spark, path + ".gz"):
        return path
    if is_dir(spark, path):
        return f"{path.rstrip('/')}/model/phrase-table"
    raise TypeError(f"{path} is no phrase table and no model directory")


def alignment_points(field: Column) -> Column:
    """Points s-t of a text; what is none is dropped."""
    points = F.filter(F.split(strip(field), " "), lambda p: p.rlike(_POINT))
    return F.transform(points, lambda p: F.struct(F.split(p, "-")[0].cast("int").alias("s"), F.split(p, "-")[1].cast("int").alias("t")))


def _inspected(text: DataFrame) -> DataFrame:
    """The rows of text with f (fields), features, counts, and reason: why a line is no phrase table row, null if it is one."""
    f = F.split(F.rtrim(F.col("value"), F.lit(" \t\n\r\v\f")), r"\|\|\|")
    numbers = lambda i: F.transform(F.split(strip(F.get("f", F.lit(i))), " "), lambda x: x.try_cast("double"))
    whole = lambda c: F.forall(c, lambda x: x.isNotNull())
    raw = text.withColumn("f", f).withColumns({"features": numbers(2), "counts": numbers(4)})
    reason = (
        F.when(F.col("value").isNull() | (F.size("f") < 5), "fewer than five fields").when(F.size("features") < 4, "fewer than four features").when(~whole("features"), "a feature is no number")
        .when(F.size("counts") < 2, "fewer than two counts").when(~whole("counts"), "a count is no number")
    )
    return raw.withColumn("reason", reason)


def _parsed() -> list[Column]:
    """PHRASE_TABLE columns of inspected rows."""
    columns = [strip(F.col("f")[0]).alias("src"), strip(F.col("f")[1]).alias("tgt")]
    columns += [F.col("features")[i].alias(name) for i, name in enumerate(FEATURES)]
    columns += [alignment_points(F.col("f")[3]).alias("align")]
    return columns + [F.get("counts", F.lit(i)).cast("bigint").alias(name) for i, name in enumerate(COUNTS)]


def parse_phrase_table(text: DataFrame, lenient: bool = False) -> DataFrame:
    """PHRASE_TABLE rows of column value.

    Fields are split at |||: phrases, four features and more, alignment points s-t
    (others are dropped), two counts or three (cut to whole numbers); what follows
    is ignored.  A line that is no such row fails the query; lenient drops it."""
    raw = _inspected(text)
    if lenient:
        raw = raw.where(F.col("reason").isNull())
    else:
        raw = raw.withColumn("f", F.when(F.col("reason").isNull(), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("no phrase table line, "), "reason", F.lit(": "), F.coalesce("value", F.lit("null"))))))
    return raw.select(*_parsed())


def _unsound() -> Column:
    """Why a parsed row can't be right, null if it can."""
    words = lambda c: F.size(tokens(F.col(c)))
    features = F.array(*FEATURES)
    return (
        F.when((F.col("src") == "") | (F.col("tgt") == ""), "an empty phrase").when(F.exists(features, lambda x: F.isnan(x) | (x < 0) | (x > 1)), "a feature is no probability")
        .when(F.exists("align", lambda p: (p.s >= words("src")) | (p.t >= words("tgt"))), "a point beyond the words").when(F.exists(F.array(*COUNTS), lambda x: x < 0), "a negative count")
    )


def sort_out(text: DataFrame, sound: bool = False) -> tuple[DataFrame, DataFrame]:
    """PHRASE_TABLE rows of column value, and a quarantine: the other columns of text, value and reason of all other lines.

    Both are parts of one table that one reading of text writes to the shared folder.  sound: rows of an empty phrase, of
    a feature outside 0 to 1, of points beyond the words or of a negative count are quarantined too."""
    raw, rest = _inspected(text), text.columns
    raw = raw.select(*rest, "reason", F.when(F.col("reason").isNull(), F.struct(*_parsed())).alias("row"))
    if sound:
        raw = raw.select(*rest, "row.*", "row", "reason").withColumn("reason", F.coalesce("reason", _unsound())).select(*rest, "reason", "row")
    good = F.col("reason").isNull()
    told = staged(raw.select(good.alias("good"), "reason", *(F.when(~good, F.col(c)).alias(c) for c in rest), F.when(good, F.col("row")).alias("row")), "lines", "good")
    return told.where("good").select("row.*"), told.where("not good").select(*rest, "reason")


def read_phrase_table(spark: SparkSession, path: str, lenient: bool = False, partitions: int | None = None) -> DataFrame:
    """partitions: deals the lines anew, which a gzip file, one task's work to read, needs."""
    text = lines(spark, resolve_model(spark, path))
    return parse_phrase_table(text.repartition(partitions) if partitions else text, lenient)


def phrase_table_lines(table: DataFrame, number_of_features: int = 4, writers: int | None = None, six_digit_counts: bool = False) -> DataFrame:
    """Column value: the rows as lines, in byte order; features beyond the fourth are 0.

    writers: into how many ranges the rows are dealt; by default Spark's own choice.  Counts are whole numbers;
    six_digit_counts: to six digits, as features are, which loses the rest of those from a million on."""
    if number_of_features < 4:
        raise ValueError("a phrase table has at least four features")
    features = F.concat_ws(" ", *(format_g6(F.col(c)) for c in FEATURES), *(F.lit("0") for _ in range(number_of_features - 4)))
    shown = (lambda c: format_g6(c.cast("double"))) if six_digit_counts else (lambda c: c.cast("bigint").cast("string"))
    counts = F.concat_ws(" ", *(shown(F.coalesce(F.col(c), F.lit(0))) for c in COUNTS))
    points = F.when(F.size("align") > 0, F.concat(show_alignment(F.col("align")), F.lit(" "))).otherwise("")
    value = F.concat("src", F.lit(" ||| "), "tgt", F.lit(" ||| "), features, F.lit(" ||| "), points, F.lit("||| "), counts, F.lit(" ||| |||"))
    ordered = table.repartitionByRange(writers, line_key()).sortWithinPartitions(line_key()) if writers else table.orderBy(line_key())
    return ordered.select(value.alias("value"))


def write_phrase_table(table: DataFrame, path: str, number_of_features: int = 4, single_file: bool = True, writers: int | None = None) -> None:
    write_lines(phrase_table_lines(table, number_of_features, writers), path, single_file)


def lexical_tables(lexicon: DataFrame) -> dict[str, DataFrame]:
    """Lines, by suffix: e2f has target, source, P(target | source); f2e source, target, P(source | target);
    the count files the pair's and the given word's counts in place of the probability."""
    whole = lambda c: F.col(c).cast("bigint").cast("string")

    def of(first: str, second: str, given: str) -> dict[str, Column]:
        words = [F.col(first), F.col(second)]
        return {"": F.concat_ws(" ", *words, format_f7(F.col("c") / F.col(given))), "count.": F.concat_ws(" ", *words, whole("c"), whole(given))}

    out = {}
    for name, columns, order in (("e2f", of("t", "s", "c_e"), ["s", "t"]), ("f2e", of("s", "t", "c_f"), ["t", "s"])):
        for kind, value in columns.items():
            out[f"{kind}{name}"] = lexicon.where(F.col("c_e" if name == "e2f" else "c_f") > 0).orderBy(*order).select(value.alias("value"))
    return out


def write_lexical(lexicon: DataFrame, output: str, base: str, single_file: bool = True) -> None:
    """Four files named base beside output.  The lexicon becomes a table, as each file's sort reads it twice."""
    folder, lexicon = os.path.dirname(output) or ".", staged(lexicon, "lexicon")
    for suffix, rows in lexical_tables(lexicon).items():
        write_lines(rows, f"{folder}/{base}.{suffix}", single_file)


def read_lexical(spark: SparkSession, path: str) -> DataFrame:
    """w1, w2, p of a lexical file."""
    f = F.split("value", " ")
    return lines(spark, path).where("value <> ''").select(f[0].alias("w1"), f[1].alias("w2"), f[2].cast("double").alias("p"))


def read_lexical_counts(spark: SparkSession, path: str) -> DataFrame:
    """w1, w2, c, n of a lexical count file."""
    f = F.split("value", " ")
    return lines(spark, path).where("value <> ''").select(f[0].alias("w1"), f[1].alias("w2"), f[2].cast("bigint").alias("c"), f[3].cast("bigint").alias("n"))
