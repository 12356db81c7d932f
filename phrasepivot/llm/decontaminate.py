"""Benchmark decontamination: a prefix-filtered set join with exact verification.

A window of an item is the set of its shingles of two words (of one word: that
word).  A document holds the window only if it holds every shingle of it, so the
necessary prefix of a window is its single rarest shingle, by the counts of the
items' shingles over all documents.  Documents and windows are joined on that
shingle; its place in the window and the window's length bound where the window
must lie, and the words there are compared.  Documents are read twice, however many
items there are: to count the shingles, and to send on those that are a prefix, with
the words around them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasepivot.llm.common import STEP_BYTES, Carried, KeyFilter, Staged, scratch, ship_package, small_batches, texts_of, tidy
from phrasepivot.llm.suffix_dedup import text_key

#: Most texts, and most words with their hashes, that a worker remembers; it begins anew beyond.
KEPT, KEPT_WORDS = 200_000, 1 << 16
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; runs of digits, letters a-z and anything beyond ASCII."""
    return text.translate(_WORDS).split()


def windows_of(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """All runs of width words; of fewer words, but not none, the whole."""
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


class _Hashes(dict):
    """By word, its hash; begins anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles_of(h: np.ndarray) -> np.ndarray:
    """Hashes (int64) of the pairs of words that follow each other; h: hashes of the words."""
    x = h[:-1] * _MIX[0] + (h[1:] ^ h[1:] >> np.uint64(29)) * _MIX[1]
    return (x ^ x >> np.uint64(32)).view(np.int64)


def _windows(items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(w, item) of the distinct windows, words joined by spaces; (w, at, h) of each distinct window's shingles."""

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            ids, out = b.column(0).to_pylist(), [[], []]
            for i, text in zip(ids, texts_of(b.column(1))):
                for w in windows_of(words_of(text), width):
                    out[0].append(b" ".join(w).decode())
                    out[1].append(i or "")
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], ["w", "item"])

    def split(batches):
        import pyarrow as pa

        hashes = _Hashes()
        for b in batches:
            out = [[], [], []]
            for w in b.column(0).to_pylist():
                h = hashes.of(w.encode().split(b" "))
                for at, x in enumerate((shingles_of(h) if len(h) > 1 else h.view(np.int64)).tolist()):
                    for c, v in zip(out, (w, at, x)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], ["w", "at", "h"])

    windows = Staged(items.sparkSession, items.mapInArrow(tidy(cut), "w string, item string").distinct(), "windows").df
    return windows, Staged(items.sparkSession, windows.select("w").distinct().mapInArrow(tidy(split), "w string, at int, h long"), "shingles").df


def _hits_of(split: list[list[bytes]], hashes: _Hashes, wanted: KeyFilter, single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' words: (text, place, shingle) of the shingles that may be wanted, by text; single: words that make a
    window of their own count too."""
    begin = np.cumsum([0, *map(len, split)])
    h = hashes.of([w for words in split for w in words])
    pairs = shingles_of(h)
    at = np.flatnonzero(wanted.may(pairs))
    text = np.searchsorted(begin, at, "right") - 1
    keep = at + 1 < begin[text + 1]  # not of two texts
    at, text, found = at[keep], text[keep], pairs[at[keep]]
    if single:
        alone = np.flatnonzero(wanted.may(h.view(np.int64)))
        at, found = np.concatenate([at, alone]), np.concatenate([found, h.view(np.int64)[alone]])
        text = np.concatenate([text, np.searchsorted(begin, alone, "right") - 1])
        order = np.argsort(text, kind="stable")
        at, text, found = at[order], text[order], found[order]
    return text, at - begin[text], found


def _counts(docs: DataFrame, shingles: DataFrame, single: bool) -> DataFrame:
    """(h, n): in how many documents each of the items' shingles occurs, and some others."""
    sent = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(shingles.select("h").distinct(), "h"))

    def run(batches):
        import pyarrow as pa

        wanted, hashes, counts = sent.value, _Hashes(), Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["h", "n"])
            counts.clear()
            return out

        for b in small_batches(batches, STEP_BYTES, "text"):
            text, _, found = _hits_of([words_of(t) for t in texts_of(b.column(0))], hashes, wanted, single)
            order = np.lexsort((found, text))
            text, found = text[order], found[order]
            counts.update(found[np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (found[1:] != found[:-1])])].tolist() if len(found) else ())
            if len(counts) > KEPT:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, prefixes: DataFrame, width: int, single: bool, kind: str) -> DataFrame:
    """Per row: doc_id, k1, k2 (the text's key), n_words, and its prefix shingles (h, p, before, words), unless the
    task has met the text: p is the place, words are those around it, of which before lie before it."""
    sent = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(prefixes.select("h").distinct(), "h"))

    def run(batches):
        import pyarrow as pa

        wanted, hashes, seen = sent.value, _Hashes(), set()
        for b in small_batches(batches, STEP_BYTES, "text"):
            texts = texts_of(b.column(1))
            keys, split = [text_key(t) for t in texts], [words_of(t) for t in texts]
            many, fresh, flat = [len(w) for w in split], [], [[], [], [], []]
            for i, key in enumerate(keys):
                if key not in seen:
                    if len(seen) >= KEPT:
                        seen.clear()
                    seen.add(key)
                    fresh.append(i)
            text, at, h = _hits_of([split[i] for i in fresh], hashes, wanted, single)
            counts = np.zeros(len(texts), np.int64)
            counts[fresh] = np.bincount(text, minlength=len(fresh)) if fresh else 0
            for i, p, x in zip(text.tolist(), at.tolist(), h.tolist()):
                words, a = split[fresh[i]], max(0, p - width + 1)
                for c, v in zip(flat, (x, p, p - a, b" ".join(words[a : p + width]).decode())):
                    c.append(v)
            found = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["h", "p", "before", "words"])
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(many, pa.int64()), listed], ["doc_id", "k1", "k2", "n_words", "found"])

    return docs.mapInArrow(tidy(run), f"doc_id {kind}, k1 long, k2 long, n_words long, found array<struct<h:long,p:int,before:int,words:string>>")


def _covered(batches):
    """Of (k1, k2, spans): how many words lie inside any span."""
    import pyarrow as pa

    for b in batches:
        hit = []
        for x in b.column(2):
            a, z = np.asarray(x.values.field("a")).astype(np.int64), np.asarray(x.values.field("z")).astype(np.int64)
            order = np.argsort(a, kind="stable")
            a, z = a[order], np.maximum.accumulate(z[order])
            hit.append(int(np.maximum(z - np.maximum(a, np.append(0, z[:-1])), 0).sum()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.int64())], ["k1", "k2", "n_hit"])


def _judged(docs: DataFrame, items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Of docs(doc_id, text) and items(item, text): rows (doc_id, k1, k2, n_words) and, of texts with a
    hit, (k1, k2, n_hit, item_ids)."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    windows, shingles = _windows(items, width)
    words = F.size(F.split("w", " "))
    single = not windows.where(words == 1).isEmpty()
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "at")
    prefixes = shingles.join(_counts(docs, shingles, single), "h", "left").groupBy("w").agg(F.min(rarity).alias("x"))
    prefixes = Staged(spark, prefixes.select("w", F.col("x.h").alias("h"), F.col("x.at").alias("at"), words.alias("size")), "prefixes").df
    rows = Staged(spark, _candidates(docs, prefixes, width, single, kind), "candidates").df
    found = rows.where(F.size("found") > 0).select("k1", "k2", F.explode("found").alias("f")).select("k1", "k2", "f.*")
    there = F.array_join(F.slice(F.split("words", " "), F.greatest(F.col("before") - F.col("at") + 1, F.lit(1)), F.col("size")), " ")
    met = found.join(prefixes, "h").where((F.col("before") >= F.col("at")) & (there == F.col("w")))
    hits = Staged(spark, met.select("k1", "k2", (F.col("p") - F.col("at")).alias("a"), (F.col("p") - F.col("at") + F.col("size")).alias("z"), "w").distinct(), "hits").df
    covered = hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "z")).alias("spans")).mapInArrow(tidy(_covered), "k1 long, k2 long, n_hit long")
    named = hits.select("k1", "k2", "w").distinct().join(windows, "w").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    return rows.drop("found"), Staged(spark, covered.join(named, ["k1", "k2"]), "verdict").df


def _asked(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted strings) for every row of docs.

    n_hit: words inside any occurrence of a window of width consecutive item
    words; an item of fewer words, but not none, is one window.

    A null or empty text has no words.  A null item id counts as an empty string;
    repeated items and ids count once.  Rows of docs with repeated or null ids are
    judged row by row, as rows go by their texts.  Empty tables: no items, no hits; no docs, no rows.  Other
    columns are not read."""
    ship_package(docs.sparkSession)
    with scratch() as kept:
        rows, verdict = _judged(*_asked(docs, items, id_col, text_col, item_id, item_text), width)
        out = rows.join(verdict, ["k1", "k2"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
        out = Staged(docs.sparkSession, out, "judged")
        kept.append(out)
    return out.df


def drop_contaminated(docs: DataFrame, items: DataFrame, least_share: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13) -> DataFrame:
    """docs without the rows of which windows of items cover a share of least_share of the words or more.

    Rows that have no such text, and that no bitmap takes for one, stay where they are.  Nulls, repeats and empty tables
    are as in contamination."""
    spark = docs.sparkSession
    ship_package(spark)
    with scratch() as kept:
        rows, verdict = _judged(*_asked(docs, items, id_col, text_col, item_id, item_text), width)
        many = rows.groupBy("k1", "k2").agg(F.first("n_words").alias("n_words"))
        bad = Staged(spark, verdict.join(many, ["k1", "k2"]).where(F.col("n_hit") >= least_share * F.col("n_words")).select("k1", "k2"), "contaminated")
        kept.append(bad)
    carried = Carried(docs, docs.columns)
    sent = spark.sparkContext.broadcast(KeyFilter.of(bad.df, "k1"))

    def deal(batches, asked: bool):
        import pyarrow as pa

        judged = sent.value
        for b in small_batches(batches, STEP_BYTES, "text"):
            keys = [text_key(t) for t in texts_of(b.column(0))]
            k1 = np.array([k[0] for k in keys], np.int64)
            rows = pa.array(np.flatnonzero(judged.may(k1) == asked))
            own = [pa.array(k1), pa.array([k[1] for k in keys], pa.int64())] if asked else []
            yield pa.RecordBatch.from_arrays([*own, *carried.of(b)], [*["k1", "k2"][: len(own)], *carried.inside]).take(rows)

    texts = docs.select(F.col(text_col).alias("text"), *carried.columns)
    clean = texts.mapInArrow(tidy(partial(deal, asked=False)), carried.schema[2:])
    met = texts.mapInArrow(tidy(partial(deal, asked=True)), f"k1 long, k2 long{carried.schema}").join(bad.df, ["k1", "k2"], "left_anti")
    return clean.unionByName(met.select(*carried.inside)).select(*(F.col(i).alias(n) for i, n in zip(carried.inside, docs.columns)))


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
