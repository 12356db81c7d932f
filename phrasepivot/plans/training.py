"""From an alignment file and its corpora to a phrase table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasepivot.operators.extraction import MAX_LENGTH, extract_phrases, score_phrases
from phrasepivot.operators.lexicon import build_lexicon
from phrasepivot.sources.alignments import AlignmentName, parse_alignment_name
from phrasepivot.sources.files import numbered_lines, staged, write_lines
from phrasepivot.sources.phrase_table import alignment_points, lexical_tables, write_phrase_table


def aligned_sentences(alignment: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """src, tgt (words joined by single spaces), align: the lines of equal numbers of three tables of n, value.

    Only the part of an alignment line before its first tab counts.  A line that one of the three lacks fails the query;
    sentences without a word on either side are left out."""
    named = lambda df, name: df.select("n", F.col("value").alias(name))
    x = named(alignment, "points").join(named(source, "src"), "n", "full").join(named(target, "tgt"), "n", "full")
    there = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit(f"no line of {c}: "), F.col("n").cast("string")))).otherwise(F.col(c))
    words = lambda c: F.array_join(F.filter(F.split(there(c), "[ \t]+"), lambda w: w != ""), " ")
    x = x.select(words("src").alias("src"), words("tgt").alias("tgt"), alignment_points(F.split(there("points"), "\t")[0]).alias("align"))
    return x.where("src <> '' and tgt <> ''")


def read_sentences(spark: SparkSession, path: str) -> tuple[AlignmentName, DataFrame]:
    """The name and the sentences of an alignment file whose corpora lie beside it."""
    name = parse_alignment_name(path)
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    return name, aligned_sentences(numbered_lines(spark, path), *(numbered_lines(spark, corpus) for corpus in name.corpora(folder)))


def sentence_lexicon(sentences: DataFrame) -> DataFrame:
    """LEXICON of sentences: each aligned pair of words, and each unaligned word with NULL, counts one."""
    return build_lexicon(sentences.withColumn("c_raw", F.lit(1.0)))


def phrase_table(sentences: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """PHRASE_TABLE of sentences: extracted, counted and scored.  Sentences are read twice, for phrases and for words."""
    return score_phrases(extract_phrases(sentences, max_length), sentence_lexicon(sentences))


def train(spark: SparkSession, path: str, out: str, max_length: int = MAX_LENGTH, single_file: bool = True) -> str:
    """Writes model.<pipe>.<corpus>/model in out, as a trainer's lexical, extraction and scoring steps do, and gives the
    model's directory: phrase-table.gz, and lex.e2f and lex.f2e, P(source | target) and P(target | source)."""
    name, sentences = read_sentences(spark, path)
    model = f"{out.rstrip('/')}/model.{name.pipe}.{name.corpus}"
    sentences = staged(sentences, "sentences")
    lexicon = staged(sentence_lexicon(sentences), "lexicon")
    write_phrase_table(score_phrases(extract_phrases(sentences, max_length), lexicon), f"{model}/model/phrase-table.gz", 4, single_file)
    rows = lexical_tables(lexicon)
    for theirs, ours in (("lex.e2f", "f2e"), ("lex.f2e", "e2f")):  # a trainer names its files by the other direction
        write_lines(rows[ours], f"{model}/model/{theirs}", single_file)
    return model
