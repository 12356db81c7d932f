"""Phrases whose words occur together more often than their parts say, mined by hierarchical pair naming.

A text is a sequence of numbers of its words.  Of two (k-1)-grams that are frequent and lie side by side, sharing
all but their outer words, the pair of their ids is a k-gram's name; pairs are counted over all texts, and the
frequent ones get ids of their own, which take their places in the sequences.  An id's pair says of which shorter
grams it is made, so cuts and contained phrases are looked up along these pointers and never searched for.

Sequences stay in blocks, each a row: a block has its own small numbers, tells each of its distinct words or pairs and
its count, and is told in return which of them have ids.  So what is shuffled is a block's distinct pairs, not its
words.  Pairs go to buckets by their hash, as many as keep a bucket at BUCKET_WORDS or less, and packed: a bucket is
counted and named as a whole.
"""

from __future__ import annotations

import functools
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasepivot.llm.common import Staged, ship_package, small_batches, texts_of, tidy

#: Bytes of text in a block, for all languages of a task together.
BLOCK_BYTES = 32 << 20
#: Words of the corpus for each bucket of pairs: a bucket has fewer pairs, and a task holds one at a time.
BUCKET_WORDS = 2 << 20
#: Parts into which a language's phrases are dealt before its first ones are ranked together.
RANK_PARTS = 64
UNKNOWN = "und"
#: A-Z to lower case, separators of pieces to a full stop, tabs to spaces.
_SEPARATORS = b".,;:!?\n\v\f\r"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 46 if c in _SEPARATORS else 32 if c == 9 else c for c in range(256))
_BREAK = b"."
_BLOCK = "block long, lang string, words long, seq binary, keys array<binary>, counts array<long>"
#: Rows of a block: its sequence (bucket -1) and its pairs of each bucket.
_PAIRS = "block long, bucket int, data binary"
#: Rows of a bucket: what each block is told, and (block -1) the names.
_NAMED = "block long, told binary, lefts array<long>, rights array<long>, counts array<long>, ids array<long>"


def _pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length, one after the other; the reader knows their types."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, out, at = len(raw) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _bucket(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _slices(text: bytes, most: int = BLOCK_BYTES):
    """The text in pieces of at most ``most`` bytes, cut behind separators; longer where there is none."""
    at = 0
    while len(text) - at > most:
        cut = text.rfind(_BREAK, at, at + most) + 1
        cut = cut if cut > at else text.find(_BREAK, at + most) + 1
        if cut <= at:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class _Block:
    """Texts of one language: numbers of its words in order, a break (number 0) between pieces and texts."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[_BREAK]  # is 0
        self.parts: list[np.ndarray] = []

    def add(self, text: bytes) -> None:
        tokens = text.replace(_BREAK, b" . ").split()
        tokens.append(_BREAK)
        self.parts.append(np.fromiter(map(self.number.__getitem__, tokens), np.int32, len(tokens)))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The sequence, and the count of each number."""
        seq = np.concatenate(self.parts)
        counts = np.bincount(seq, minlength=len(self.number))
        counts[0] = 0
        return seq, counts


def _listed(values: np.ndarray):
    """An Arrow array of one list."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64()))


def _numbering(block_bytes: int):
    """Of batches of (lang, text): blocks, their sequences and the counts of their words."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 33, defaultdict(_Block), 0

        def flush():
            nonlocal block
            for lang, b in held.items():
                seq, counts = b.words()
                row = [pa.array([block]), pa.array([lang]), pa.array([int(counts.sum())]), pa.array([_pack(seq)]), pa.array([list(b.number)], pa.list_(pa.binary())), _listed(counts)]
                yield pa.RecordBatch.from_arrays(row, ["block", "lang", "words", "seq", "keys", "counts"])
                block += 1
            held.clear()

        for batch in small_batches(batches, block_bytes, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                for part in _slices(text.translate(_TABLE), block_bytes):
                    held[lang].add(part)
                    size += len(part)
                    if size >= block_bytes:
                        yield from flush()
                        size = 0
        yield from flush()

    return run


def _pairing(buckets: int, last: bool):
    """Of batches of (block, seq, numbers, ids) or (block, seq, told): the pairs of ids that lie side by side, by bucket,
    and unless last their sequence."""

    def run(batches):
        import pyarrow as pa

        def row(block: int, bucket: int, data: bytes):
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], ["block", "bucket", "data"])

        for batch in batches:
            for r in range(batch.num_rows):
                block, seq = batch.column(0)[r].as_py(), _unpack(batch.column(1)[r].as_py(), np.int32)[0]
                if batch.num_columns == 4:
                    numbers, ids = (np.asarray(batch.column(c)[r].values).astype(np.int64) for c in (2, 3))
                else:
                    numbers, ids = (np.concatenate(c) for c in zip(*(_unpack(x, np.int32, np.int64) for x in batch.column(2)[r].as_py())))
                rank = np.full(max(int(seq.max(initial=-1)), int(numbers.max(initial=-1))) + 2, -1, np.int64)  # its last is for -1
                rank[numbers] = np.arange(len(numbers))
                here = rank[seq]
                at = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0)) if len(here) else np.zeros(0, np.int64)
                pairs, number, counts = np.unique(here[at] * len(ids) + here[at + 1], return_inverse=True, return_counts=True)
                if not last:
                    found = np.full(len(here), -1, np.int32)
                    found[at] = number
                    yield row(block, -1, _pack(found))
                if not len(pairs):
                    continue
                left, right = ids[pairs // len(ids)], ids[pairs % len(ids)]
                bucket = _bucket(left, right, buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                for part in np.split(order, cuts):
                    yield row(block, int(bucket[part[0]]), _pack(left[part], right[part], part.astype(np.int32), counts[part].astype(np.int32)))

    return run


def _naming(least: int, last: bool):
    """Of batches of (block, bucket, data), in order of buckets: names of the frequent pairs, and unless last what each
    block is told of its own."""

    def run(batches):
        import pyarrow as pa

        held, now = [], None
        none = pa.array([None], pa.list_(pa.int64()))

        def named():
            left, right, number, count = (np.concatenate(c) for c in zip(*(x[1] for x in held)))
            order = np.lexsort((right, left))
            starts = np.flatnonzero(np.r_[True, (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)])
            sums = np.add.reduceat(count[order].astype(np.int64), starts)
            frequent = sums >= least
            ids = np.where(frequent, np.cumsum(frequent) - 1 + (now << 32), -1)
            first = order[starts[frequent]]
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([None], pa.binary()), *map(_listed, (left[first], right[first], sums[frequent], ids[frequent]))], names)
            if last:
                return
            given = np.empty(len(order), np.int64)
            given[order] = np.repeat(ids, np.diff(np.r_[starts, len(order)]))
            at = 0
            for block, columns in held:
                own = slice(at, at + len(columns[0]))
                kept = given[own] >= 0
                at = own.stop
                if kept.any():
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_pack(number[own][kept], given[own][kept])]), none, none, none, none], names)

        names = ["block", "told", "lefts", "rights", "counts", "ids"]
        for batch in batches:
            for block, bucket, data in zip(*(c.to_pylist() for c in batch.columns)):
                if held and bucket != now:
                    yield from named()
                    held = []
                now = bucket
                held.append((block, _unpack(data, np.int64, np.int64, np.int32, np.int32)))
        if held:
            yield from named()

    return run


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _grams(counted: DataFrame, shorter: DataFrame, k: int, scale: int) -> DataFrame:
    """Names of k words, counted by the ids of their parents, of the names of k - 1.

    best: the cut of the lowest score.  inner: ids of the grams of k - 1 words that it contains, then those of k - 2."""
    side = lambda s: shorter.select(*(F.col(c).alias(f"{s}_{c}") for c in shorter.columns))
    both = counted.join(side("l"), F.col("left") == F.col("l_id")).join(side("r"), F.col("right") == F.col("r_id"))
    # first and last word, and for four words both halves, by what the parents know of theirs
    parts = [("l_first", "r_a")] + [("l_left_a", "r_right_a")] * (k == 4) + [("l_a", "r_last")] * (k > 2)
    score = "cast(a as decimal(20,0)) * cast({} as decimal(18,0)) div cast({} + {} as decimal(20,0))"
    cuts = [F.struct(F.expr(score.format(scale, left, right)).alias("score"), F.lit(i).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")) for i, (left, right) in enumerate(parts, 1)]
    inner = [F.col("left"), F.col("right")] + [F.col(c) for c in ("l_left", "l_right", "r_right")] * (k == 4)
    return both.select(
        "id", F.col("l_lang").alias("lang"), "left", "right", F.concat_ws(" ", "l_phrase", "r_end").alias("phrase"), F.col("r_end").alias("end"), "a",
        F.col("l_first").alias("first"), F.col("r_last").alias("last"), F.col("l_a").alias("left_a"), F.col("r_a").alias("right_a"), F.array_min(F.array(*cuts)).alias("best"), F.array(*inner).alias("inner"),
    )


def mine_phrases(docs: DataFrame, least: int = 30, top: int = 2000, scale: int = 2_000_000, covered: int = 80, lang_col: str = "lang", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score (long): the first top phrases of 2 to 4 words of each language.

    Texts are lower-cased (A-Z), split into pieces at .,;:!? and line ends, pieces into words at spaces and tabs; a
    phrase lies within a piece.  Everything is by language.  a is how often a phrase occurs, overlaps included, at
    least ``least``; a cut after its first k words gives l and r, how often its parts occur, and floor(scale * a / (l + r));
    the cut of the lowest counts, ties to the smallest k.  A phrase goes if a longer candidate, itself gone or not,
    contains it and occurs ``covered`` hundredths as often or more.  Order: score and a falling, then the phrase's bytes.
    n: all word occurrences of the language.

    A null language is UNKNOWN, a null text empty; a language without a phrase has no row.  Repeated rows count each.  A
    text of over block_bytes is cut at separators, and stays whole where it has none.  An empty table gives an empty
    result.  Other columns are not read."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = Staged(spark, texts.mapInArrow(tidy(_numbering(block_bytes)), _BLOCK), "blocks")
    totals = Staged(spark, blocks.df.groupBy("lang").agg(F.sum("words").alias("n")), "totals").df
    entries = blocks.df.select("block", "lang", F.posexplode(F.arrays_zip("keys", "counts")).alias("number", "x")).select("block", "lang", "number", F.col("x.keys").alias("word"), F.col("x.counts").alias("c")).where("c > 0")
    words = entries.groupBy("lang", "word").agg(F.sum("c").alias("a")).where(F.col("a") >= least)
    text = F.col("word").cast("string")
    words = words.select("lang", "word", text.alias("phrase"), text.alias("end"), "a", F.col("a").alias("first"), F.col("a").alias("last"))
    names = Staged(spark, words.withColumn("id", F.monotonically_increasing_id()), "words").df
    met = entries.join(names.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("number", "id")).alias("x"))
    told = blocks.df.select("block", "seq").join(met, "block").select("block", "seq", F.col("x.number"), F.col("x.id"))  # a block without ids has no pairs
    size = totals.agg(F.sum("n").alias("n")).first().n or 0
    buckets, levels, before, names = 1 + size // bucket_words, [], [blocks], names.drop("word")
    for k in (2, 3, 4):
        pairs = Staged(spark, told.mapInArrow(tidy(_pairing(buckets, k == 4)), _PAIRS), "pairs")
        dealt = pairs.df.where("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket")
        answers = Staged(spark, dealt.mapInArrow(tidy(_naming(least, k == 4)), _NAMED), "answers")
        for x in before:
            x.drop()
        x = answers.df.where("block < 0").select(F.explode(F.arrays_zip("lefts", "rights", "counts", "ids")).alias("x"))
        counted = x.select(F.col("x.lefts").alias("left"), F.col("x.rights").alias("right"), F.col("x.counts").alias("a"), F.col("x.ids").alias("id"))
        names = Staged(spark, _grams(counted, names, k, scale), f"grams{k}").df
        levels.append(names)
        met = answers.df.where("block >= 0").groupBy("block").agg(F.collect_list("told").alias("told"))
        told = pairs.df.where("bucket < 0").select("block", F.col("data").alias("seq")).join(met, "block")
        before = [pairs, answers]
    for x in before:
        x.drop()
    return _first(_uncovered(levels, covered), top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


def _uncovered(levels: list[DataFrame], covered: int) -> DataFrame:
    """lang, phrase, a, best of the names of two, three and four words that no longer one covers."""
    found = None
    for i, level in enumerate(levels):
        rows = level
        # a gram's pointers lead to those of one word less, and of two less
        above = [x.select(F.explode(F.slice("inner", 1, 2) if j == 0 else F.slice("inner", 3, 3)).alias("id"), F.col("a").alias("longer")) for j, x in enumerate(levels[i + 1 :])]
        if above:
            most = functools.reduce(DataFrame.unionByName, above).groupBy("id").agg(F.max("longer").alias("most"))
            rows = level.join(most, "id", "left").where(F.col("most").isNull() | (_wide(F.col("most")) * 100 < _wide(F.col("a")) * covered))
        rows = rows.select("lang", "phrase", "a", "best")
        found = rows if found is None else found.unionByName(rows)
    return found


def _first(phrases: DataFrame, top: int) -> DataFrame:
    """With rank, the first top of each language: first of each of RANK_PARTS parts, so that no task ranks a language whole."""
    order = [F.desc("best.score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    near = phrases.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
