"""Scores of whole documents by a word unigram and by a causal self-attention model over subword ids.

The attention model reads a text as the first subword ids of its words, each token
once; the rest of a word is what the words' counts say of its first id and, where these
leave room, its spelling by smoothed counts of pairs of subword ids.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from itertools import count, islice

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasepivot.llm.attention_lm import PARAMETERS, SLOTS, Frame, Model, Speller, first_parameters, slots_by_count
from phrasepivot.llm.common import ASCII_LOWER, Staged, scratch, ship_package, small_batches, texts_of, tidy
from phrasepivot.llm.suffix_dedup import text_key

#: Most words whose counts are broadcast; the counts of others are joined, for both scores.
TOP_WORDS = 100_000
#: Parts of the training texts, by their hashes: in a round every task trains a copy on its texts of one part, and the
#: copies' mean goes on, so that all training texts train once.
ROUNDS = 4
#: Words that a worker keeps encoded besides a batch's own, and that it counts before it sends them on.
KEPT, COUNTED = 400_000, 400_000
#: Texts whose scores a task keeps for their copies; when it has more, it begins anew.
CACHED = 1 << 17
BATCH_BYTES = 2 << 20
#: Adam's first step, divided by the round's number.
RATE = 0.02
#: What a word's count gives up to the spellings of other words.
DISCOUNT = 0.75
LOG10 = float(np.log(10))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _encode(words: list[bytes], path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, each encoded with a space before it, and where each word begins.

    A word's ids are those from one that begins with a space to the next.  Words with white space beyond ASCII inside,
    which the pattern joins with the space of the next word, are encoded one by one."""
    from phrasepivot.llm.tokenize_docs import SPACES, rank_encoder, token_ids

    encoder = rank_encoder(path, pattern)
    odd = re.compile(f"[{SPACES.removeprefix('\t-\r ')}]").search
    text, alone = b"".join([b" " + w for w in words]).decode(), {}
    if odd(text):
        alone = {i: token_ids(encoder, " " + t) for i, t in enumerate(w.decode() for w in words) if odd(t)}
        text = b"".join([b" " + w for i, w in enumerate(words) if i not in alone]).decode()
    flat = np.array(encoder.encode_ordinary(text), np.int64)
    begin = np.flatnonzero(_starts(path, pattern, encoder.n_vocab + 1)[flat])
    if alone:
        parts = iter(np.split(flat, begin[1:]) if len(begin) else [])
        each = [np.array(alone[i], np.int64) if i in alone else next(parts) for i in range(len(words))]
        flat, begin = np.concatenate(each), np.cumsum([0, *map(len, each[:-1])])
    if len(begin) != len(words):
        raise ValueError(f"{len(words)} words have {len(begin)} beginnings")
    return flat, begin


_tables: dict = {}


def _starts(path: str, pattern: str, size: int) -> np.ndarray:
    """Whether an id begins a word: its bytes begin with a space, or it is the end."""
    from phrasepivot.llm.tokenize_docs import rank_encoder

    if (path, pattern) not in _tables:
        encoder = rank_encoder(path, pattern)
        _tables[path, pattern] = np.array([*(encoder.decode_single_token_bytes(i).startswith(b" ") for i in range(size - 1)), True])
    return _tables[path, pattern]


class Vocabulary:
    """Numbers the words of texts as they come, with what describe(words' ids, begins, hashes) gives of each.  When it
    has more than limit, done is called, and it begins anew."""

    def __init__(self, path: str, pattern: str, limit: int, describe, done=lambda: None):
        self.path, self.pattern, self.limit, self.describe, self.done = path, pattern, limit, describe, done
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = defaultdict(count().__next__)
        self.columns: list[np.ndarray] = []

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of the texts' words, one text after the other; and how many words each text has."""
        if len(self.index) > self.limit:
            self.done()
            self.clear()
        at = len(self.index)
        words, place, many = _words(texts)
        out = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[place]
        if len(self.index) > at or not self.columns:
            new = list(islice(reversed(self.index), len(self.index) - at))[::-1]
            made = self.describe(*_encode(new, self.path, self.pattern), _hashes(new))
            self.columns = [np.concatenate([x, y]) for x, y in zip(self.columns, made)] if self.columns else list(made)
        return out, many


def _sequences(heads: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """The words' heads of texts of so many words, one text after the other, each closed by the end."""
    out = np.full(len(heads) + len(counts), end, heads.dtype)
    out[np.arange(len(heads)) + np.repeat(np.arange(len(counts)), counts)] = heads
    return out


def _words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of texts as they are first met, the place there of each word, one text after the other, and
    how many words each text has.  Arrow tells words apart, so that Python meets each once."""
    import pyarrow as pa

    data = np.frombuffer((b" ".join(texts) + b" ").translate(ASCII_LOWER), np.uint8)
    space = (data == 32) | (data - np.uint8(9) < 5)
    edge = np.flatnonzero(np.diff(space, prepend=True))  # begins and ends of words in turn, as the last byte is a space
    begin = edge[::2]
    offsets = np.append(0, np.cumsum(edge[1::2] - begin))
    each = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])]).dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts])
    return each.dictionary.to_numpy(zero_copy_only=False).tolist(), each.indices.to_numpy(), np.diff(np.searchsorted(begin, ends), prepend=0)


def _id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.int32


#: What a row of read_corpus holds.
WORDS, IDS, TEXTS, SEQUENCES = range(4)


def read_corpus(texts: DataFrame, path: str, pattern: str, size: int) -> DataFrame:
    """The training texts, read once.  Rows by kind: WORDS (k: 64-bit hashes; head: first ids; n: how often each is met;
    ids: the ids of all, of which each has sizes), IDS (k: ids; n), TEXTS (n: how many) and SEQUENCES (ids: words' first
    ids and ends of texts, of which each has sizes, one text after the other; part: by the texts' hashes).

    Each different word of a task is encoded once, or once for each COUNTED words."""

    def run(batches):
        import pyarrow as pa

        total, counts, kept, ready = 0, np.zeros(size, np.int64), [], []

        def row(kind, part=None, sizes=None, ids=None, k=None, head=None, n=None):
            binary = lambda x, of: pa.array([None if x is None else x.astype(of).tobytes()], pa.binary())
            longs = lambda x, of: pa.array([x], pa.list_(of))
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), binary(sizes, np.int32), binary(ids, _id_type(size)), longs(k, pa.int64()), longs(head, pa.int32()), longs(n, pa.int64())], ["kind", "part", "sizes", "ids", "k", "head", "n"])

        def describe(ids, begin, hashes):
            kept.append((ids, begin, hashes, np.zeros(len(begin), np.int64)))
            return (ids[begin],)

        def done():
            for ids, begin, hashes, met in kept:
                if len(begin):
                    sizes = np.diff(np.append(begin, len(ids)))
                    counts[:] += np.bincount(ids, np.repeat(met, sizes), size).astype(np.int64)
                    ready.append(row(WORDS, None, sizes, ids, hashes, ids[begin], met))
            kept.clear()

        vocabulary = Vocabulary(path, pattern, COUNTED, describe, done)
        for b in small_batches(batches, BATCH_BYTES, "text"):
            raw = texts_of(b.column(0))
            total += len(raw)
            if not raw:
                continue
            numbers, many = vocabulary.numbers(raw)
            yield from ready
            ready.clear()
            met, at = np.bincount(numbers, minlength=len(vocabulary.index)), 0
            for _, begin, _, times in kept:
                times += met[at : at + len(begin)]
                at += len(begin)
            heads = _sequences(vocabulary.columns[0][numbers], many, size - 1)
            part = np.array([zlib.crc32(t) % ROUNDS for t in raw])
            of = np.repeat(part, many + 1)
            for r in np.unique(part).tolist():
                yield row(SEQUENCES, r, many[part == r] + 1, heads[of == r])
        done()
        yield from ready
        at = np.flatnonzero(counts)
        yield row(IDS, k=at, head=np.zeros(len(at)), n=counts[at])
        yield row(TEXTS, k=[0], head=[0], n=[total])

    return texts.mapInArrow(tidy(run), "kind int, part int, sizes binary, ids binary, k array<long>, head array<int>, n array<long>")


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """(kind, k, head, n) of read_corpus' rows: WORDS, IDS and TEXTS, each k counted once."""
    each = corpus.where(F.col("kind") != SEQUENCES).select("kind", F.explode(F.arrays_zip("k", "head", "n")).alias("x"))
    return each.groupBy("kind", F.col("x.k").alias("k"), F.col("x.head").alias("head")).agg(F.sum("x.n").alias("n"))


def _encoded(corpus: DataFrame, head_slot: np.ndarray, word_slot: np.ndarray) -> DataFrame:
    """Of read_corpus' rows: rows (part, sizes, slots) of texts, and at a task's end one with part -1: k, n, counts of
    pairs of slots.

    Below SLOTS * SLOTS, k is (last slot, slot) of words' heads and ends; beyond, (last slot, slot or SLOTS for a word's
    end) of the ids of a word."""
    sent = corpus.sparkSession.sparkContext.broadcast((head_slot, word_slot))

    def run(batches):
        import pyarrow as pa

        head_slot, word_slot = sent.value
        pairs, inside = np.zeros(SLOTS * SLOTS, np.int64), np.zeros(SLOTS * (SLOTS + 1), np.int64)

        def row(part, sizes, slots, k, n):
            binary = lambda x, kind: pa.array([None if x is None else x.astype(kind).tobytes()], pa.binary())
            longs = lambda x: pa.array([x], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), binary(sizes, np.int32), binary(slots, np.uint16), longs(k), longs(n)], ["part", "sizes", "slots", "k", "n"])

        for b in batches:
            for kind, part, sizes, ids, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4)):
                sizes, ids = np.frombuffer(sizes.as_buffer(), np.int32), np.frombuffer(ids.as_buffer(), _id_type(len(head_slot)))
                begin = np.cumsum(sizes, dtype=np.int64) - sizes
                if kind == SEQUENCES:
                    slots = head_slot[ids].astype(np.int64)
                    last = np.roll(slots, 1)
                    last[begin] = SLOTS - 1
                    pairs += np.bincount(last * SLOTS + slots, minlength=SLOTS * SLOTS)
                    yield row(part, sizes, slots, None, None)
                else:
                    slots = word_slot[ids].astype(np.int64)
                    after = np.append(slots[1:], SLOTS)
                    after[begin[1:] - 1] = SLOTS
                    inside += np.bincount(slots * (SLOTS + 1) + after, np.repeat(np.asarray(n.values), sizes), len(inside)).astype(np.int64)
        both = np.concatenate([pairs, inside])
        at = np.flatnonzero(both)
        yield row(-1, None, None, at, both[at])

    rows = corpus.where(F.col("kind").isin(WORDS, SEQUENCES)).select("kind", "part", "sizes", "ids", F.when(F.col("kind") == WORDS, F.col("n")).alias("n"))
    return rows.mapInArrow(tidy(run), "part int, sizes binary, slots binary, k array<long>, n array<long>")


def _train_round(encoded: DataFrame, model: Model, rate: float) -> tuple[Model, float]:
    """Every task trains a copy on its own texts; the copies' mean, weighted by their windows, goes on.  With it, the
    mean loss of the classes in that round."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        own, state, seen = Model(sent.value.frame, sent.value.flat), {}, 0
        for b in batches:
            for sizes, slots in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen += own.train(np.frombuffer(slots, np.uint16), np.frombuffer(sizes, np.int32).astype(np.int64), rate, seen, state)
        if seen:
            x = np.concatenate([own.flat.astype(np.float64) * seen, [state["loss"], state["positions"]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARAMETERS + 2, dtype=np.int32)), pa.array(x), pa.array(np.full(PARAMETERS + 2, seen, np.int64))], ["i", "x", "w"])

    rows = encoded.select("sizes", "slots").mapInArrow(tidy(run), "i int, x double, w long").groupBy("i").agg(F.sum("x"), F.sum("w")).collect()  # a row for each parameter
    sent.unpersist()
    flat, loss = model.flat.copy(), [0.0, 0.0]
    for i, x, w in rows:
        if i < PARAMETERS:
            flat[i] = x / w
        else:
            loss[i - PARAMETERS] = x
    return Model(model.frame, flat), loss[0] / max(loss[1], 1)


def train_language_model(corpus: DataFrame, heads: np.ndarray, ids: np.ndarray) -> tuple[Model, Speller, list[float]]:
    """corpus: read_corpus' rows; heads: counts of the ids that their words begin with, the end among them; ids: counts of
    all ids.  With the model, the training loss of each round.  The driver holds 2 * SLOTS * SLOTS counts at most."""
    head_slot, word_slot = slots_by_count(heads), slots_by_count(ids)
    encoded = Staged(corpus.sparkSession, _encoded(corpus, head_slot, word_slot), "encoded")
    pairs = encoded.df.where("part = -1").select(F.explode(F.arrays_zip("k", "n")).alias("x")).groupBy(F.col("x.k").alias("k")).agg(F.sum("x.n").alias("n")).toPandas()
    both = np.zeros(SLOTS * SLOTS + SLOTS * (SLOTS + 1))
    both[pairs["k"].to_numpy(np.int64)] = pairs["n"].to_numpy()
    met, inside = both[: SLOTS * SLOTS].reshape(SLOTS, SLOTS), both[SLOTS * SLOTS :].reshape(SLOTS, SLOTS + 1)
    model, losses = Model(Frame(head_slot, met, heads), first_parameters()), []
    for r in range(ROUNDS):
        model, loss = _train_round(encoded.df.where(F.col("part") == r), model, RATE / (1 + r))
        losses.append(loss)
    encoded.drop()
    return model, Speller(word_slot, inside, np.maximum(ids - heads, 0)), losses


def top_words(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of at most TOP_WORDS words: all of at least the least count that keeps to that bound."""
    by_count = words.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).limit(TOP_WORDS).collect()
    held, least = 0, None
    for r in by_count:
        held += r.m
        if held > TOP_WORDS:
            break
        least = r.n
    got = words.where(F.col("n") >= F.lit(least)).select("k", "n").toPandas()
    return got["k"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def score_documents(docs: DataFrame, held_out: Column, path: str, pattern: str, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, attention_score for every row of docs.

    Words are runs without ASCII white space, A-Z lower-cased; a text's end is a
    token too.  base_score is of the add-one unigram of the rows that are not held
    out; score is the text's log10 probability by the model that they train: each
    word's first subword id by attention over the first ids of the words before, then the
    rest of the word by what the counts of words with that first id say, and by its spelling
    with what they leave.  attention_score has no counts of words: the rest of each word is its spelling.
    Windows of the attention model overlap, and each token is
    scored once, with at least WINDOW - STRIDE tokens before it where the text has them.

    path, pattern, size: a rank file that driver and executors can open, how it splits texts, and its ids and one for
    the end.  A null text counts as empty: its end only.  White space beyond ASCII belongs to words.  Rows are judged one by
    one, whatever their ids; nothing to learn from leaves uniform models.  An empty
    table gives an empty result; other columns of docs are not read."""
    ship_package(docs.sparkSession)
    with scratch() as kept:
        out = Staged(docs.sparkSession, _scores(docs, held_out, path, pattern, size, id_col, text_col), "scores")
        kept.append(out)
    return out.df


def _scores(docs: DataFrame, held_out: Column, path: str, pattern: str, size: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = rows.where(~F.col("held_out")).select("text")
    corpus = Staged(spark, read_corpus(training, path, pattern, size), "corpus")
    counts = Staged(spark, corpus_counts(corpus.df), "counts").df
    words = counts.where(F.col("kind") == WORDS)
    seen = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_texts = counts.where(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    train_tokens = seen.n + n_texts
    denominator = float(np.log10(train_tokens + seen.v + (n_texts > 0) + 1))
    ids, heads, lost = np.zeros(size), np.zeros(size), np.zeros(size)
    for k, many in counts.where(F.col("kind") == IDS).select("k", "n").collect():  # at most the vocabulary
        ids[k] = many
    for head, many, distinct in words.groupBy("head").agg(F.sum("n"), F.count(F.lit(1))).collect():  # at most the vocabulary
        heads[head], lost[head] = many, distinct
    heads[size - 1] = n_texts
    model, speller, _ = train_language_model(corpus.df, heads, ids)
    corpus.drop()
    hashes, n = top_words(words)
    known = spark.sparkContext.broadcast(dict(zip(hashes.tolist(), n.tolist())))
    # a word's share of its first id is its count less DISCOUNT; what that leaves, and one more, is for spellings
    sent = spark.sparkContext.broadcast((model, speller, np.log(heads + 1), np.log(DISCOUNT * lost + 1)))
    end_score = float(np.log10(n_texts + 1)) - denominator
    end_known = int(n_texts > 0)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        # a number for each row: copies of a text have that of the row whose rare words are listed for them
        turn = TaskContext.get().partitionId() << 36
        (model, speller, whole, spare), of = sent.value, known.value

        def describe(ids, begin, hashes):
            heads = ids[begin]
            n = np.fromiter((of.get(h, 0) for h in hashes.tolist()), np.int64, len(hashes))
            rest = speller.rest(ids, begin)
            # of a frequent word: its log share of its first id; of others, what its spelling alone gives it, as a log
            # count, and the share is added where their counts are joined
            left, other = spare[heads] + rest, n == 0
            share = np.where(other, 0, np.logaddexp(np.log(np.maximum(n - DISCOUNT, 1e-300)), left)) - whole[heads]
            return heads, other, rest, share, np.where(other, 0, np.log10(n + 1) - denominator), hashes, left

        vocabulary, seen = Vocabulary(path, pattern, KEPT, describe), {}
        for b in small_batches(batches, BATCH_BYTES, "text"):
            texts = texts_of(b.column(2))
            keys = [text_key(t) for t in texts]
            fresh = sorted({k: i for i, k in enumerate(keys) if k not in seen}.values())
            out, far, left, held = {}, np.zeros(0, np.int64), np.zeros(0), np.zeros(len(keys), np.int64)
            if fresh:
                numbers, sizes = vocabulary.numbers([texts[i] for i in fresh])
                heads, other, rest, share, own = (c[numbers] for c in vocabulary.columns[:5])
                text = np.repeat(np.arange(len(fresh)), sizes)
                others = np.bincount(text[other], minlength=len(fresh))
                base = np.bincount(text, own, len(fresh)) + end_score
                each = model.log_probabilities(_sequences(heads, sizes, size - 1), sizes + 1).astype(np.float64)
                last = np.cumsum(sizes + 1) - 1
                ends, first = each[last], np.delete(each, last)
                total = np.bincount(text, first + share, len(fresh)) + ends
                alone = np.bincount(text, first + rest, len(fresh)) + ends
                for j, i in enumerate(fresh):
                    out[keys[i]] = (int(sizes[j]) + 1, int(sizes[j] - others[j]) + end_known, float(base[j]), float(total[j] / LOG10), float(alone[j] / LOG10), turn + i)
                far, left, held[fresh] = *(c[numbers[other]] for c in vocabulary.columns[5:]), others
            mine = [out.get(k) or seen[k] for k in keys]
            if len(seen) > CACHED:
                seen = {}
            seen.update(out)
            rare = pa.StructArray.from_arrays([pa.array(far), pa.array(left)], ["w", "left"])
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)).astype(np.int32)), rare)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array([m[j] for m in mine], pa.float64() if 2 <= j < 5 else pa.int64()) for j in range(6)), listed],
                ["doc_id", "held_out", "n_tokens", "known", "base", "score", "attention_score", "turn", "rare"],
            )
            turn += len(keys)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, attention_score double, turn long, rare array<struct<w:long,left:double>>"
    scored = Staged(spark, rows.mapInArrow(tidy(run), schema), "scored").df
    each = scored.where(F.size("rare") > 0).select("turn", F.explode("rare").alias("r")).select("turn", "r.w", "r.left")
    counted = each.join(words.select(F.col("k").alias("w"), "n"), "w", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    mixed = F.when(c > 0, F.log(c - DISCOUNT + F.exp("left"))).otherwise(F.col("left")) / LOG10
    sums = counted.groupBy("turn").agg(F.sum(F.log10(c + 1) - denominator).alias("rare_base"), F.sum((c > 0).cast("long")).alias("rare_known"), F.sum(mixed).alias("rare_score"))
    return scored.drop("rare").join(sums, "turn", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"), "attention_score"
    )
