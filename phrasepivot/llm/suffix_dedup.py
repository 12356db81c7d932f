"""Removal of long byte strings that occur more than once in a table of texts.

A start is the place where a string of ``length`` bytes begins.  Every start has
an anchor: of the places from it on that leave at least SHARED bytes of its string,
the one of the least hash of the next 16 bytes, the first of these if equal.  This depends on the string
alone, so equal strings have the same anchor and the same distance to it.  Starts
of one anchor are a piece: the bytes from the first start to the end of the last
one's string, aligned at the anchor.  Pieces that share the bytes from the anchor
on that any of their strings must hold are a group, and only groups of several
pieces need comparing:

* groups that occur once are left out by a bitmap, which saves work and decides
  nothing; texts without a piece to compare are left out in the same way before
  any text is shuffled;
* equal pieces are counted before any shuffle, and stand for one;
* the other pieces of a group go through the column-wise construction of the
  collection's transform and common prefixes (``column_bwt``), whose rounds are
  as many as a piece has bytes, whatever the texts' lengths;
* a group of too many different pieces is dealt anew: each piece is cut into
  pieces of fewer starts, which share more bytes, at last the whole string.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasepivot.llm.column_bwt import Collection
from phrasepivot.llm.common import STEP_BYTES, Carried, KeyFilter, Staged, delete, scratch, shared_dir, ship_package, shuffle_partitions, small_batches, texts_of, tidy

#: Most different pieces of a group that one task compares; pieces whose columns are laid out in one go, and about how
#: many a collection has: what a task has is one collection, or a few.
GROUP, BATCH, COLLECTION = 1024, 8192, 1 << 18
#: Starts in a piece after a too large group is dealt anew, once and again.
CELLS = (16, 1)
HASHED = 16
#: Bytes from the anchor on that all strings of a piece hold, where the length allows more than half of it.
SHARED = 64
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_PLACE = 28


def span_of(length: int) -> int:
    """How far an anchor lies from its start at most."""
    return max(length // 2, length - SHARED)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first start, last start) of each piece; places count from the text's begin.

    data: all texts' bytes, fewer than 2**28; offsets: where they begin, and the end."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(4))
    span, n = span_of(length), len(data) - HASHED + 1
    if n - span <= 0:
        return empty
    word = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,)) if len(data) >= 8 else None
    h = (word[:n] * _MIX[0]) ^ ((word[8 : n + 8] + _MIX[2]) * _MIX[1])
    h ^= h >> np.uint64(29)
    h *= _MIX[2]
    h >>= np.uint64(_PLACE)
    h <<= np.uint64(_PLACE)
    h |= np.arange(n, dtype=np.uint64)
    step = 1
    while 2 * step <= span + 1:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = span + 1 - step
    if rest:
        h = np.minimum(h[:-rest], h[rest:])
    best = (h & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    sizes = np.diff(offsets)
    many = np.maximum(sizes - length + 1, 0)
    if not many.sum():
        return empty
    text = np.repeat(np.arange(len(sizes)), many)
    start = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + offsets[:-1][text]
    anchor = best[start]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[first[1:], len(text)] - 1
    base = offsets[:-1][text[first]]
    return text[first], anchor[first] - base, start[first] - base, start[last] - base


#: Periods that are looked for where a text has more pieces than a byte in so many.
PERIODS, DENSE = 32, 12


def periodic(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(spare, again): starts whose string is that of the start a short period before, and the starts that this makes
    repeated, both of each pair.

    Runs of one byte or of a few in turn have a piece for nearly every start; but for each run's first period their
    strings say nothing that an earlier start's doesn't."""
    n = len(data) - length + 1
    spare, again = np.zeros(max(n, 0), bool), np.zeros(max(n, 0), bool)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for p in range(1, PERIODS + 1):
        if len(data) - p < length:
            break
        edge = np.flatnonzero(np.diff(np.r_[False, (data[:-p] == data[p:]) & (text[:-p] == text[p:]), False].astype(np.int8)))
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if z - a >= length:  # the strings at a to z - length are those at a + p to z - length + p
                again[a : z - length + 1 + p] = True
                spare[a + p : z - length + 1 + p] = True
    return spare, again


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_key(text: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(text)
    return _signed(x >> 64), _signed(x & ((1 << 64) - 1))


def _scan(docs: DataFrame, length: int) -> DataFrame:
    """Per row: id, k1 and k2 (the text's key), n_bytes, sha, and, unless the task has met the text, its pieces and flat
    spans of what repeats itself in runs of a short period."""
    span = span_of(length)

    def run(batches):
        import pyarrow as pa

        seen = set()
        digest = xxhash.xxh3_64_intdigest
        for b in small_batches(batches, STEP_BYTES // 2, "text"):
            texts = texts_of(b.column(1))
            keys = [text_key(t) for t in texts]
            fresh = []
            for i, k in enumerate(keys):
                if k not in seen and len(texts[i]) >= length:
                    if len(seen) < 1 << 20:
                        seen.add(k)
                    fresh.append(i)
            cols, counts, own = [[], [], [], [], []], np.zeros(len(texts), np.int64), [[] for _ in texts]
            for part in _chunks(fresh, texts, length):
                raw = b"".join(t for _, _, t in part)
                offsets = np.cumsum([0, *(len(t) for _, _, t in part)])
                text, anchor, lo, hi = anchors(np.frombuffer(raw, np.uint8), offsets, length)
                if len(text) * DENSE > len(raw):
                    spare, again = periodic(np.frombuffer(raw, np.uint8), offsets, length)
                    kept = np.r_[0, np.cumsum(~spare)]
                    some = kept[offsets[text] + hi + 1] > kept[offsets[text] + lo]  # a start that isn't spare
                    text, anchor, lo, hi = text[some], anchor[some], lo[some], hi[some]
                    for x, z in _ranges(again):
                        at = int(np.searchsorted(offsets, x, "right")) - 1
                        i, begin = part[at][0], part[at][1] - int(offsets[at])
                        own[i] += [x + begin, z + begin + length]
                owner = np.array([i for i, _, _ in part], np.int64)[text]
                shift = np.array([s for _, s, _ in part], np.int64)[text]
                np.add.at(counts, owner, 1)
                base, view = offsets[text], memoryview(raw)
                a, z, g = (base + lo).tolist(), (base + hi + length).tolist(), (base + anchor).tolist()
                left = anchor - lo
                cols[0].append(anchor + shift)
                cols[1].append(left)
                cols[2].append(hi + length - anchor)
                cols[3].append(np.fromiter((digest(view[x : x + length - span], 1) for x in g), np.uint64, len(g)).view(np.int64))
                cols[4].append(np.fromiter((digest(view[x:y], d + 2) for x, y, d in zip(a, z, left.tolist())), np.uint64, len(a)).view(np.int64))
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            pieces = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds)], ["a", "l", "r", "g", "s"])
            listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pieces)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), listed, pa.array(own, pa.list_(pa.int64()))],
                ["doc_id", "k1", "k2", "n_bytes", "sha", "pieces", "own"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"doc_id {kind}, k1 long, k2 long, n_bytes long, sha string, pieces array<struct<a:long,l:int,r:int,g:long,s:long>>, own array<long>")


def _chunks(rows: list[int], texts: list[bytes], length: int, most: int = 1 << 21):
    """Parts of about most bytes: (row, where the part of its text begins, that part).  A longer text is
    cut into parts that overlap so that each start is in one of them."""
    part, held = [], 0
    for i in rows:
        t = texts[i]
        for s in range(0, max(1, len(t) - length + 1), most):
            piece = t[s : s + most + length - 1]
            if held + len(piece) > 2 * most and part:
                yield part
                part, held = [], 0
            part.append((i, s, piece))
            held += len(piece)
    if part:
        yield part


def _texts(docs: DataFrame, length: int, wanted: DataFrame) -> DataFrame:
    """(k1, k2, z): texts of length bytes and more, compressed: those of wanted(k1, ...) and some others; copies
    that one task meets go once."""
    sent = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(wanted, "k1"))

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack, seen, wanted = zstandard.ZstdCompressor(level=3).compress, set(), sent.value
        for b in small_batches(batches, STEP_BYTES, "text"):
            out = [[], [], []]
            texts = texts_of(b.column(0))
            keys = [text_key(t) for t in texts]
            for t, k, may in zip(texts, keys, wanted.may(np.array([k[0] for k in keys], np.int64)).tolist()):
                if not may or len(t) < length or k in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(k)
                for c, x in zip(out, (*k, pack(t))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["k1", "k2", "z"])

    return docs.select("text").mapInArrow(tidy(run), "k1 long, k2 long, z binary")


def _cut_pieces(joined: DataFrame) -> DataFrame:
    """From (z, list of g, s, n, a, l, r): rows g, s, n, l and the piece's bytes."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for row in range(b.num_rows):
                text, at = unpack(b.column(0)[row].as_py()), b.column(1)[row].values
                g, s, n, a, left, right = (np.asarray(at.field(x)) for x in ("g", "s", "n", "a", "l", "r"))
                bytes_of = [text[x - y : x + z] for x, y, z in zip(a.tolist(), left.tolist(), right.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(s), pa.array(n), pa.array(left, pa.int32()), pa.array(bytes_of, pa.binary())], ["g", "s", "n", "l", "piece"])

    return joined.mapInArrow(tidy(run), "g long, s long, n long, l int, piece binary")


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values: (first, last)."""
    edge = np.flatnonzero(np.diff(np.r_[False, starts, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _compare(pieces: DataFrame, length: int, folder: str) -> DataFrame:
    """(g, s, lo, hi): runs of repeated starts of each piece, as distances before the anchor (lo >= hi).

    The pieces of a task are one collection, whose files go to folder if they are long.  A group must fit into a task;
    n > 1: the whole piece occurs again."""
    spark = pieces.sparkSession

    def run(batches):
        import pyarrow as pa

        collection, groups, meta = Collection(folder), 0, []

        def add(rows) -> None:
            nonlocal groups
            g, s, n, left, bytes_of = rows
            group = groups + np.cumsum(np.r_[0, (g[1:] != g[:-1]).astype(np.int64)])
            collection.add(bytes_of, left, group)
            groups = int(group[-1]) + 1
            meta.append((g, s, n))

        def found():
            piece, lo, hi = collection.runs(length)
            g, s, n = map(np.concatenate, zip(*meta))
            once = n[piece] == 1
            piece, lo, hi = piece[once], lo[once], hi[once]
            meta.clear()
            return pa.RecordBatch.from_arrays([pa.array(g[piece]), pa.array(s[piece]), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["g", "s", "lo", "hi"])

        held = None
        for b in batches:
            new = [*(np.asarray(b.column(i)) for i in range(4)), b.column(4).to_pylist()]
            new[3] = new[3].astype(np.int64)
            held = new if held is None else [*(np.concatenate([x, y]) for x, y in zip(held[:4], new[:4])), held[4] + new[4]]
            while len(held[0]) >= BATCH:
                cut = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
                if not len(cut):
                    break
                at = int(cut[max(0, np.searchsorted(cut, BATCH, side="right") - 1)])
                add([x[:at] for x in held])
                held = [x[at:] for x in held]
                if sum(len(x[0]) for x in meta) >= COLLECTION:
                    yield found()
                    collection, groups = Collection(folder), 0
        if held is not None and len(held[0]):
            add(held)
        if meta:
            yield found()

    dealt = pieces.select("g", "s", "n", "l", "piece").repartition(shuffle_partitions(spark), "g").sortWithinPartitions("g", "s")
    return dealt.mapInArrow(tidy(run), "g long, s long, lo int, hi int")


def _smaller(pieces: DataFrame, cell: int, length: int) -> DataFrame:
    """Cuts each piece into pieces of at most cell starts: parent pg, ps; g, s, n, l, piece, and shift (how far
    the new anchor lies before the parent's).  The cells are the same for all pieces of a group, and g holds the bytes that all
    strings of a cell share."""

    def run(batches):
        import pyarrow as pa

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            out = [[] for _ in range(8)]
            for g, s, n, left, piece in zip(*(b.column(i).to_pylist() for i in range(5))):
                near = left + length - len(piece)  # distance of the last start before the anchor
                seed = g & ((1 << 64) - 1)
                for c in range(near // cell, left // cell + 1):
                    least, most = c * cell, (c + 1) * cell - 1
                    far, close = min(left, most), max(near, least)
                    shared = piece[left - least : left - most + length]
                    body = piece[left - far : left - close + length]
                    key = _signed(digest(shared, seed ^ c))
                    for column, x in zip(out, (g, s, key, _signed(digest(body, (far << 20) + close)), n, far - least, body, least)):
                        column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["pg", "ps", "g", "s", "n", "l", "piece", "shift"])

    return pieces.select("g", "s", "n", "l", "piece").mapInArrow(tidy(run), "pg long, ps long, g long, s long, n long, l int, piece binary, shift int")


def _resolve(pieces: DataFrame, length: int, cells: tuple[int, ...], folder: str) -> DataFrame:
    """(g, s, lo, hi) as _compare, for groups of any size; pieces are different within their group, and staged."""
    spark = pieces.sparkSession
    sizes = pieces.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    large = Staged(spark, sizes.where(F.col("size") > GROUP).select("g"), "pieces").df
    if not cells or large.isEmpty():
        return _compare(pieces, length, folder)
    small = _compare(pieces.join(large, "g", "left_anti"), length, folder)
    cut = Staged(spark, _smaller(pieces.join(large, "g"), cells[0], length), "pieces").df
    each = cut.groupBy("g", "s").agg(F.sum("n").alias("n"), F.first("l").alias("l"), F.first("piece").alias("piece"))
    each = Staged(spark, each, "pieces").df
    whole = each.where("n > 1").select("g", "s", F.col("l").alias("lo"), (F.col("l") - F.octet_length("piece") + length).alias("hi"))
    again = each.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("g")
    parts = whole.unionByName(_resolve(Staged(spark, each.join(again, "g"), "pieces").df, length, cells[1:], folder))
    back = cut.select("pg", "ps", "g", "s", "shift").join(parts, ["g", "s"]).select(F.col("pg").alias("g"), F.col("ps").alias("s"), (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi"))
    return small.unionByName(back)


def _of_repeated_groups(rows: DataFrame) -> DataFrame:
    """(k1, k2, a, l, r, g, s) of the pieces whose group occurs more than once, and of some others."""
    spark = rows.sparkSession
    groups = Staged(spark, rows.select(F.explode("pieces.g").alias("g")).groupBy("g").count().where("count > 1").select("g"), "groups")
    sent = spark.sparkContext.broadcast(KeyFilter.of(groups.df, "g"))
    groups.drop()

    def run(batches):
        import pyarrow as pa

        repeated = sent.value
        for b in batches:
            lists = b.column(2)
            owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
            pieces = lists.flatten()
            keep = np.flatnonzero(repeated.may(np.asarray(pieces.field("g"))))
            owner = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays([b.column(0).take(owner), b.column(1).take(owner), *(pieces.field(c).take(pa.array(keep)) for c in "alrgs")], ["k1", "k2", *"alrgs"])

    return rows.where(F.size("pieces") > 0).select("k1", "k2", "pieces").mapInArrow(tidy(run), "k1 long, k2 long, a long, l int, r int, g long, s long")


def repeated_spans(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Of docs(doc_id, text): the rows (doc_id, k1, k2, n_bytes, sha, copies) and the spans (k1, k2, spans) of
    each text that occurs once: flat [from, to, ...], maximal, in order."""
    spark = docs.sparkSession
    whole = Staged(spark, _scan(docs, length), "scan")
    whole_rows = Staged(spark, whole.df.drop("pieces"), "rows").df
    rows = whole_rows.drop("own")
    copies = rows.where(F.col("n_bytes") >= length).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    flat = Staged(spark, _of_repeated_groups(whole.df), "flat")
    whole.drop()
    kinds = flat.df.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "a", "l", "r")).alias("x"))
    kinds = Staged(spark, kinds, "kinds")
    shared = kinds.df.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("g")
    asked = kinds.df.join(shared, "g").select("g", "s", "n", "x.*")
    # a text's pieces go to it in lists of bounded length
    by_text = asked.groupBy("k1", "k2", F.floor(F.col("a") / (1 << 20)).alias("part")).agg(F.collect_list(F.struct("g", "s", "n", "a", "l", "r")).alias("at"))
    by_text = Staged(spark, by_text, "asked")
    pieces = _cut_pieces(by_text.df.join(_texts(docs, length, by_text.df), ["k1", "k2"]).select("z", "at"))
    pieces = Staged(spark, pieces.dropDuplicates(["g", "s"]), "pieces")
    by_text.drop()
    folder = f"{shared_dir(spark)}/columns-{uuid.uuid4().hex}"
    some = _resolve(pieces.df, length, CELLS, folder)
    full = kinds.df.where("n > 1").select("g", "s", F.col("x.l").alias("lo"), (F.lit(length) - F.col("x.r")).alias("hi"))
    starts = Staged(spark, full.unionByName(some), "starts").df
    delete(spark, folder)  # tasks that ended early may have left files
    pieces.drop()
    kinds.drop()
    inside = whole_rows.where(F.size("own") > 0).select("k1", "k2", F.explode(F.transform(F.sequence(F.lit(0), F.size("own") - 1, F.lit(2)), lambda i: F.struct(F.get("own", i).alias("from"), F.get("own", i + 1).alias("to")))).alias("span"))
    met = flat.df.join(starts, ["g", "s"]).select("k1", "k2", F.struct((F.col("a") - F.col("lo")).alias("from"), (F.col("a") - F.col("hi") + length).alias("to")).alias("span")).unionByName(inside)
    spans = met.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("span")).alias("spans"))

    def merge(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for x in b.column(2):
                at = x.values
                lo, hi = np.asarray(at.field("from")), np.asarray(at.field("to"))
                top = np.maximum.accumulate(hi)
                new = np.flatnonzero(np.r_[True, lo[1:] > top[:-1]])
                out.append(np.stack([lo[new], np.r_[top[new[1:] - 1], top[-1]]], axis=1).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["k1", "k2", "spans"])

    merged = Staged(spark, spans.mapInArrow(tidy(merge), "k1 long, k2 long, spans array<long>"), "spans").df
    flat.drop()
    rows = rows.join(copies, ["k1", "k2"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    return rows, merged


def cut_spans(text: bytes, spans: list[int]) -> bytes:
    kept, at = [], 0
    for a, z in zip(spans[::2], spans[1::2]):
        kept.append(text[at:a])
        at = z
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs; with_text: kept (binary) too.

    Removes each byte that a string of length bytes covers which also starts
    anywhere else, in any row; all is judged on the input.  Null and empty texts,
    and those shorter than length, lose nothing.  Texts of several rows are copies
    and lose all they have, if it is length bytes or more.  Repeated and null ids
    are judged row by row, as rows go by their texts.  Empty tables give an empty
    result; other columns of docs are not read.  length is at least 64."""
    if length < 64:
        raise ValueError("length must be at least 64")
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with scratch() as kept:
        out = Staged(spark, _removed(docs, length, with_text), "removed")
        kept.append(out)
    return out.df


def _removed(docs: DataFrame, length: int, with_text: bool) -> DataFrame:
    rows, spans = repeated_spans(docs, length)
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    # a text of one row is cut where it is; copies need no text
    once = spans.join(rows.where(~copy).select("k1", "k2"), ["k1", "k2"])

    def cut(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for row in range(b.num_rows):
                at = b.column(3)[row].as_py()
                kept = cut_spans(unpack(b.column(2)[row].as_py()), at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, 1), b.column(1).slice(row, 1), pa.array([sum(at[1::2]) - sum(at[::2])]), pa.array([len(at) // 2]), pa.array([hashlib.sha256(kept).hexdigest()]), pa.array([kept if with_text else None], pa.binary())], ["k1", "k2", "removed", "runs", "kept_sha", "kept"])

    done = once.join(_texts(docs, length, spans), ["k1", "k2"]).select("k1", "k2", "z", "spans").mapInArrow(tidy(cut), "k1 long, k2 long, removed long, runs long, kept_sha string, kept binary")
    out = rows.join(done, ["k1", "k2"], "left")
    some = F.col("removed").isNotNull()
    columns = [
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).when(some, F.col("removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).when(some, F.col("runs")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(copy, F.lit(nothing)).when(some, F.col("kept_sha")).otherwise(F.col("sha")).alias("kept_sha256"),
    ]
    return out.select(*columns, *([F.when(copy, F.lit(b"")).when(some, F.col("kept")).alias("kept")] if with_text else []))


def cut_repeats(docs: DataFrame, length: int, text_col: str = "text") -> DataFrame:
    """docs with the text column cut as remove_repeats says; other columns as they are.

    Where a cut goes through a character, the rest of it goes too.  Null texts stay
    null.  Texts meet their spans by key; AQE splits the keys of many copies."""
    ship_package(docs.sparkSession)
    spark, names = docs.sparkSession, [c for c in docs.columns if c != text_col]
    with scratch() as kept:
        rows, spans = repeated_spans(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")), length)
        copies = rows.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("k1", "k2", F.array(F.lit(0).cast("long"), F.col("n_bytes")).alias("spans")).distinct()
        verdict = Staged(spark, spans.join(copies, ["k1", "k2"], "left_anti").unionByName(copies), "verdict")
        kept.append(verdict)
    verdict = verdict.df
    carried = Carried(docs, names)
    sent = spark.sparkContext.broadcast(KeyFilter.of(verdict, "k1"))

    def key(batches, asked: bool):
        import pyarrow as pa

        filtered = sent.value
        for b in small_batches(batches, STEP_BYTES, "text"):
            keys = [text_key(t) for t in texts_of(b.column(0))]
            k1 = np.array([k[0] for k in keys], np.int64)
            rows = pa.array(np.flatnonzero(filtered.may(k1) == asked))
            out = pa.RecordBatch.from_arrays([pa.array(k1), pa.array([k[1] for k in keys], pa.int64()), b.column(0), *carried.of(b)], ["k1", "k2", "text", *carried.inside])
            yield (out if asked else out.drop_columns(["k1", "k2"])).take(rows)

    def cut(batches):
        import pyarrow as pa

        for b in small_batches(batches, STEP_BYTES, "text"):
            spans, texts = b.column(1).to_pylist(), b.column(0).to_pylist()
            out = [t if s is None or t is None else cut_spans(t.encode(), s).decode(errors="ignore") for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *carried.of(b)], ["text", *carried.inside])

    # texts that have no cut stay where they are
    rows = docs.select(F.col(text_col).alias("text"), *carried.columns)
    left = rows.mapInArrow(tidy(partial(key, asked=False)), f"text string{carried.schema}")
    met = rows.mapInArrow(tidy(partial(key, asked=True)), f"k1 long, k2 long, text string{carried.schema}")
    done = met.join(verdict, ["k1", "k2"], "left").select("text", "spans", *carried.inside).mapInArrow(tidy(cut), f"text string{carried.schema}").unionByName(left)
    whole = done.select(F.col("text").alias(text_col), *(F.col(i).alias(n) for i, n in zip(carried.inside, names)))
    return whole.select(*docs.columns)
