"""Phrase pairs of aligned sentences, and the phrase table that they make."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasepivot.operators.lexicon import with_lexical_weights
from phrasepivot.operators.merge import estimated_probabilities, with_marginals
from phrasepivot.schema import COUNTS, FEATURES
from phrasepivot.sources.files import staged
from phrasepivot.sources.shipping import ship

#: Words of the longest phrase, on either side.
MAX_LENGTH = 7
#: Words of the sentences that are laid out at a time; a longer sentence stands alone.
_WORDS = 20_000
#: Bytes of phrase pairs that a task holds and counts before it sends them on.
_COUNTED = 64 << 20
_NONE = 1 << 60


def _bytes(length: int) -> int:
    """Of a place in a phrase of up to length words."""
    return 1 if length <= 256 else 4


def _points(length: int) -> Column:
    """The alignment whose words are column points, as bytes."""
    size = _bytes(length)
    at = lambda i: F.conv(F.hex(F.substring("points", i * size + 1, F.lit(size))), 16, 10).cast("int")
    point = lambda k: F.struct(at(2 * k).alias("s"), at(2 * k + 1).alias("t"))
    return F.transform(F.sequence(F.lit(0), (F.octet_length("points") / (2 * size)).cast("int") - 1), point)


class _Side:
    """The words of one side of some sentences, one after the other.

    begins and ends: bytes of each word in data; base: the first word of each sentence, and of the one after the last;
    first and last: of each word's sentence."""

    def __init__(self, texts):
        import pyarrow as pa

        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        spaces = np.flatnonzero(self.data[at[0] : at[-1]] == 32) + at[0]
        self.begins, self.ends = np.sort(np.concatenate([at[:-1], spaces + 1])), np.sort(np.concatenate([spaces, at[1:]]))
        many = 1 + np.searchsorted(spaces, at[1:]) - np.searchsorted(spaces, at[:-1])
        self.base = np.concatenate([[0], np.cumsum(many)])
        self.first, self.last = np.repeat(self.base[:-1], many), np.repeat(self.base[1:] - 1, many)

    def phrases(self, a: np.ndarray, b: np.ndarray):
        """Texts of words a to b."""
        import pyarrow as pa

        begins, sizes = self.begins[a], self.ends[b] - self.begins[a]
        to = np.concatenate([[0], np.cumsum(sizes)])
        text = self.data[np.repeat(begins - to[:-1], sizes) + np.arange(to[-1])]
        return pa.StringArray.from_buffers(len(a), pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes()))


def _ends(key: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of values in order of keys 0 to n: the first place and the one after the last of each key, its least and its
    greatest value; _NONE and -1 where it has none."""
    a, z = np.searchsorted(key, np.arange(n)), np.searchsorted(key, np.arange(n), "right")
    low, high = np.full(n, _NONE), np.full(n, -1)
    low[z > a], high[z > a] = value[a[z > a]], value[z[z > a] - 1]
    return a, z, low, high


def _windows(values: np.ndarray, length: int, fold) -> np.ndarray:
    """Row d: fold of each d + 1 neighbours, from each place on."""
    out = [values]
    for d in range(1, length):
        full = max(len(values) - d, 0)  # places with so many neighbours
        out.append(np.concatenate([fold(out[-1][:full], values[d:]), out[-1][full:]]))
    return np.stack(out)


def _consistent(s: _Side, t: _Side, points: tuple[np.ndarray, np.ndarray], length: int):
    """Arrays i, j, a, b of all pairs of source words i to j and target words a to b that the points are consistent with,
    and the points in order of source words, with each word's first and last."""
    x, y = points
    back = np.lexsort((x, y))
    begin, end, least, greatest = _ends(x, y, len(s.begins))
    _, _, low, high = _ends(y[back], x[back], len(t.begins))
    lows, highs = _windows(low, length, np.minimum), _windows(high, length, np.maximum)
    spans = []
    a, b = least, greatest
    for d in range(length):
        i = np.arange(len(s.begins) - d)
        if not len(i):
            break
        a, b = np.minimum(a[: len(i)], least[d:]), np.maximum(b[: len(i)], greatest[d:])
        at = np.flatnonzero((i + d <= s.last[i]) & (b >= 0) & (b - a < length))
        at = at[(lows[b[at] - a[at], a[at]] >= at) & (highs[b[at] - a[at], a[at]] <= at + d)]
        spans.append((at, at + d, a[at], b[at]))
    i, j, a, b = (np.concatenate(c) for c in zip(*spans))
    # how many unaligned words lie side by side before a and after b
    before, after, left, right = np.zeros(len(i), int), np.zeros(len(i), int), np.ones(len(i), bool), np.ones(len(i), bool)
    for d in range(1, length):
        left &= (a - d >= t.first[a]) & (high[np.maximum(a - d, 0)] < 0)
        right &= (b + d <= t.last[b]) & (high[np.minimum(b + d, len(high) - 1)] < 0)
        before, after = before + left, after + right
    grown = []
    for d in range(length):
        for e in range(length - d):
            at = np.flatnonzero((before >= d) & (after >= e) & (b - a + d + e < length))
            grown.append((i[at], j[at], a[at] - d, b[at] + e))
    return tuple(np.concatenate(c) for c in zip(*grown)), begin, end


def _extracting(length: int):
    """Of batches of (src, tgt, align): their phrase pairs (src, tgt, points), and n, how many are alike in _COUNTED bytes.

    points: as bytes, the source and the target word of each point, one byte a word where these are enough."""
    kind = np.dtype(f">u{_bytes(length)}")

    def pairs(batch):
        import pyarrow as pa

        s, t, align = _Side(batch.column(0)), _Side(batch.column(1)), batch.column(2)
        many, struct = np.diff(np.asarray(align.offsets)), align.flatten()
        row = np.repeat(np.arange(batch.num_rows), many)
        p, q = (np.asarray(struct.field(f).fill_null(-1)).astype(np.int64) for f in ("s", "t"))
        inside = (p >= 0) & (q >= 0) & (p < np.diff(s.base)[row]) & (q < np.diff(t.base)[row])
        x, y = (p + s.base[row])[inside], (q + t.base[row])[inside]
        if not len(x):
            return
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.r_[True, (np.diff(x) != 0) | (np.diff(y) != 0)]
        x, y = x[new], y[new]
        (i, j, a, b), begin, end = _consistent(s, t, (x, y), length)
        for at in range(0, len(i), 100_000):
            i_, j_, a_, b_ = (v[at : at + 100_000] for v in (i, j, a, b))
            sizes = end[j_] - begin[i_]
            to = np.concatenate([[0], np.cumsum(sizes)])
            place = np.repeat(begin[i_] - to[:-1], sizes) + np.arange(to[-1])
            ends = np.stack([x[place] - np.repeat(i_, sizes), y[place] - np.repeat(a_, sizes)], axis=1).astype(kind)
            points = pa.BinaryArray.from_buffers(pa.binary(), len(i_), [None, pa.py_buffer((to * 2 * ends.itemsize).astype(np.int32).tobytes()), pa.py_buffer(ends.tobytes())])
            yield pa.RecordBatch.from_arrays([s.phrases(i_, j_), t.phrases(a_, b_), points], ["src", "tgt", "points"])

    def counted(held):
        import pyarrow as pa

        table = pa.Table.from_batches(held).group_by(["src", "tgt", "points"]).aggregate([([], "count_all")])
        yield from table.select(["src", "tgt", "points", "count_all"]).rename_columns(["src", "tgt", "points", "n"]).combine_chunks().to_batches(50_000)

    def found(batches):
        import pyarrow.compute as pc

        for batch in batches:
            words = np.asarray(pc.binary_length(batch.column(0))).astype(np.int64) // 2 + 1  # at most
            block = (np.cumsum(words) - words) // _WORDS
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                if z > a:
                    yield from pairs(batch.slice(a, z - a))

    def run(batches):
        held, size = [], 0
        for batch in found(batches):
            held, size = [*held, batch], size + batch.nbytes
            if size > _COUNTED:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    return run


def extract_phrases(sentences: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """src, tgt, align, n: the phrase pairs of sentences (src, tgt, align), and how often each occurs so aligned.

    A pair of up to max_length words each side has a point within, and no point that leads from one of its words to a
    word outside.  Unaligned words at its target's ends may belong to it or not, so each choice is a pair, and so are the
    source's.  Points beyond the words are dropped; a pair's own points count from its first words.  A null text or
    alignment has no pairs.

    Sentences stay where they are.  Their spans are laid out as arrays, batch by batch: as expressions of nested arrays
    the same takes 20 times as long.  Counts are added up before the shuffle, which deals the rows by both phrases, so that
    score_phrases needs no other, with alignments as bytes."""
    ship(sentences.sparkSession)
    rows = sentences.select("src", "tgt", "align").where("src is not null and tgt is not null and align is not null")
    found = rows.mapInArrow(_extracting(max_length), "src string, tgt string, points binary, n long").repartition("src", "tgt")
    return found.groupBy("src", "tgt", "points").agg(F.sum("n").alias("n")).select("src", "tgt", _points(max_length).alias("align"), "n")


def score_phrases(extracted: DataFrame, lexicon: DataFrame) -> DataFrame:
    """PHRASE_TABLE of counted phrase pairs.

    A pair has the alignment that it most often occurs with (ties: the first in order), probabilities from its counts,
    and lexical weights of that alignment."""
    often = F.min(F.struct((-F.col("n")).alias("less"), "align")).alias("often")
    merged = extracted.groupBy("src", "tgt").agg(often, F.sum("n").alias("c_st"))
    merged = staged(merged.select("src", "tgt", *(F.lit(0.0).alias(f) for f in FEATURES), F.col("often.align").alias("align"), "c_st"), "pairs")
    table = with_lexical_weights(estimated_probabilities(with_marginals(merged)), lexicon)
    return table.select("src", "tgt", *FEATURES, "align", *COUNTS)
