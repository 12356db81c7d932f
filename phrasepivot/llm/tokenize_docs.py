"""Encoding and decoding of whole documents, and exact length histograms."""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasepivot.llm.common import Carried, Staged, ship_package, small_batches, tidy

_loaded: dict = {}


def word_bpe(spark: SparkSession, path: str):
    """The compiled automaton of a file, broadcast once in an application; its size is the vocabulary's."""
    from phrasepivot.llm.bpe_automaton import WordBpe

    key = spark.sparkContext.applicationId, path
    if key not in _loaded:
        _loaded[key] = spark.sparkContext.broadcast(WordBpe(path))
    return _loaded[key]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False, carry: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space), decoded for every row of docs, and the columns of carry.

    with_text: without it, decoded is null.  digests_only: ids_sha256 and decoded_sha256 (lowercase hex) in place of the
    long columns, so that these never leave the worker.  A null text counts as
    empty: no tokens.  Repeated rows and null ids are encoded row by row; an empty
    table gives an empty result; other columns of docs are not read.  path: a
    tokenizer file that the driver can open."""
    ship_package(docs.sparkSession)
    kind, carried = docs.schema[id_col].dataType.simpleString(), Carried(docs, carry or [])
    names = ("ids_sha256", "decoded_sha256") if digests_only else ("ids", "decoded")
    sent = word_bpe(docs.sparkSession, path)

    def run(batches):
        import pyarrow as pa

        bpe = sent.value
        try:
            for b in small_batches(batches, 2 << 20, "text"):
                n, a, d = [], [], []
                for text in b.column(1).to_pylist():
                    ids, decoded = bpe.encode(text or "", with_text or digests_only)
                    n.append(ids.count(" ") + 1 if ids else 0)
                    a.append(hashlib.sha256(ids.encode()).hexdigest() if digests_only else ids)
                    d.append(hashlib.sha256(decoded.encode()).hexdigest() if digests_only else decoded if with_text else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), *carried.of(b)], ["doc_id", "n_tokens", *names, *carried.inside])
        finally:
            bpe.forget()  # a worker lives on between tasks, of whatever query

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried.columns)
    return carried.named(rows.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, {names[0]} string, {names[1]} string{carried.schema}"), ["doc_id", "n_tokens", *names])


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded: the arc labels of the ids, which are decimal and joined by a space; null counts as none."""
    ship_package(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()
    sent = word_bpe(encoded.sparkSession, path)

    def run(batches):
        import pyarrow as pa

        bpe = sent.value
        for b in small_batches(batches, 4 << 20, "ids"):
            out = [bpe.decode(list(map(int, (x or "").split()))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "decoded"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(tidy(run), f"doc_id {kind}, decoded string")


def rank_encoder(path: str, pattern: str):
    """A byte-level encoder of a rank file (base64 token and rank in each line)."""
    import tiktoken

    if (path, pattern) not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


#: White space that the pattern takes as such, and how long a run of it the pattern is given: it needs a frame for each character.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{SPACES}]{{256,}}")


def token_ids(encoder, text: str) -> list[int]:
    """Ids of a text by rank_encoder's encoder, however long its runs of white space.

    The pattern takes a run as one piece but for its last character, which goes with what follows; a run that ends the
    text is one piece.  Long runs are cut out by that rule."""
    if len(text) < 256 or not (run := _LONG_RUN.search(text)):
        return encoder.encode_ordinary(text)
    ids, at = [], 0
    while run:
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoder.encode_ordinary(text[at : run.start()])
        ids += encoder._encode_single_piece(text[run.start() : end].encode())
        at = end
        run = _LONG_RUN.search(text, at + 1)
    return ids + encoder.encode_ordinary(text[at:])


def token_lengths(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens of every row of docs.

    A null or empty text has none; texts and runs of one character may be of any length.  Rows with repeated or null
    ids are encoded row by row; an empty table gives an empty result; other columns of docs are not read.  path: a file
    that every executor can open."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        from phrasepivot.llm.tokenize_docs import rank_encoder

        encoder = rank_encoder(path, pattern)
        for b in small_batches(batches, 4 << 20, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(token_ids(encoder, t)) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long")


#: Lengths in a bucket of the suffix sums.
BUCKET = 1024


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """For each length that occurs: n_tokens, n_docs, docs_from and tokens_from (documents at least that
    long, and their tokens), docs_total, tokens_total, tokens_within (the total if every document is
    truncated to that length) and share_within (of documents at most that long).

    Lengths are counted before any shuffle; suffix sums run within buckets of
    lengths, and over the buckets' sums.  Null lengths count as 0.  An empty
    table gives an empty result."""
    counts = lengths.groupBy(F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    counts = Staged(lengths.sparkSession, counts, "lengths").df  # both the buckets and their lengths read it
    counts = counts.withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    buckets = counts.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    buckets = buckets.select("bucket", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"), F.sum("d").over(whole).alias("docs_total"), F.sum("t").over(whole).alias("tokens_total"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens"))
    out = counts.join(buckets, "bucket").withColumn("docs_from", F.sum("n_docs").over(inside) + F.col("docs_above")).withColumn("tokens_from", F.sum("tokens").over(inside) + F.col("tokens_above"))
    within = F.col("tokens_total") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
    share = (F.col("docs_total") - F.col("docs_from") + F.col("n_docs")) / F.col("docs_total")
    return out.select("n_tokens", "n_docs", "docs_from", "tokens_from", "docs_total", "tokens_total", within.alias("tokens_within"), share.alias("share_within"))


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_cut (longer documents), tokens_kept (the total of lengths truncated to the limit):
    exact for any limit, from the suffix sums of the next longer length."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(x,) for x in limits], "context_limit long")
    longer = histogram.join(F.broadcast(asked), F.col("n_tokens") > F.col("context_limit"))
    least = longer.groupBy("context_limit").agg(F.min_by(F.struct("docs_from", "tokens_from", "tokens_total"), "n_tokens").alias("x"))
    total = histogram.agg(F.max("tokens_total").alias("all"))
    kept = F.col("x.tokens_total") - F.col("x.tokens_from") + F.col("context_limit") * F.col("x.docs_from")
    return asked.join(least, "context_limit", "left").join(F.broadcast(total)).select("context_limit", F.coalesce("x.docs_from", F.lit(0)).alias("docs_cut"), F.coalesce(kept, "all", F.lit(0)).alias("tokens_kept"))


def quantiles_of(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least that share of the documents does not exceed."""
    asked = histogram.sparkSession.createDataFrame([(x,) for x in shares], "share double")
    return histogram.join(F.broadcast(asked), F.col("share_within") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
