"""The registered queries: thin uses of the operators with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasepivot.llm.collocations import mine_phrases
from phrasepivot.llm.common import split_column, table
from phrasepivot.llm.decontaminate import contamination
from phrasepivot.llm.hilbert import hilbert_shards
from phrasepivot.llm.language_id import identify, train_language_id
from phrasepivot.llm.line_dedup import dedup_lines
from phrasepivot.llm.lm_scoring import score_documents
from phrasepivot.llm.simhash import simhash_components
from phrasepivot.llm.sql import CONTAMINATION, LINES, PHRASES, TOP_K, URLS
from phrasepivot.llm.suffix_dedup import remove_repeats
from phrasepivot.llm.tokenize_docs import encode_documents, length_histogram, token_lengths
from phrasepivot.llm.topk import top_k
from phrasepivot.llm.url_filters import filter_urls
from phrasepivot.llm.whitening import whiten

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SHARDS = 40
#: Bytes of a passage in the pipeline: fewer than 50 words have.
PASSAGE = 200


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held_out = split_column(F.col("doc_id"), 7) == 2
    return score_documents(table(spark, sf_dir, "documents"), held_out, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50_257)


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = hilbert_shards(rows, ["lang", "source", "size"], ["doc_id", "text_crc32"], SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "lang", "source")


def op3_byte_conv_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = split_column(F.col("doc_id"), 3) == 1
    model = train_language_id(docs.where(~held_out))
    return identify(docs, model).select("doc_id", (split_column(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return length_histogram(token_lengths(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op5_no_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op6_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op7_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op8_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), digests_only=True)


def op10_column_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), 400)


def op11_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_pair_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_attention_lm, op2_hilbert_shards, op3_byte_conv_language, op4_token_counts, op5_no_random_access, op6_prefix_decontamination, op7_simhash_bk_trees, op8_redirect_equivalence, op9_bpe_automaton, op10_column_suffix_dedup, op11_svd_whitening, op12_line_dedup, op13_pair_naming)}
ORACLE_SQL: dict[str, str] = {"op5_no_random_access": TOP_K, "op6_prefix_decontamination": CONTAMINATION, "op8_redirect_equivalence": URLS, "op12_line_dedup": LINES, "op13_pair_naming": PHRASES}
