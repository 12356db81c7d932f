"""SimHash fingerprints, linked through BK-trees, and their components.

Every pair of distinct fingerprints within the radius is found: with ``blocks``
bit blocks, such a pair agrees on ``blocks - radius`` of them, so the pair meets
in a shard keyed by those blocks' bits.  Each shard's fingerprints make BK-trees
(children keyed by their integer Hamming distance to the parent) of at most
``TREE_NODES`` nodes; a tree goes with the rows that search it and only edges
within the radius are followed.  A larger shard is cut into chunks, and every
pair of chunks is searched on its own, so none is left out; a much larger one is
dealt anew by more bits first.
"""

from __future__ import annotations

import functools
from functools import partial
from itertools import chain, combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasepivot.llm.common import ASCII_LOWER, STEP_BYTES, Carried, KeyFilter, Staged, scratch, ship_package, shuffle_partitions, small_batches, texts_of, tidy
from phrasepivot.llm.components import connected_components

#: Most nodes of one tree; larger shards are searched chunk by chunk.
TREE_NODES = 2048
#: Most (query, node) pairs looked at in one step.
FRONTIER = 1 << 18
SEED = 42


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of width words, repeats included; fewer words: of all of them."""
    joined = b" ".join(text.translate(ASCII_LOWER).split())
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    digest = xxhash.xxh64_intdigest
    if len(gaps) < width:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = [0, *(gaps[: len(gaps) + 1 - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(joined)]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint as a signed 64-bit integer: bits set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    return majority(shingle_hashes(text or b"", width))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, fp) for each row; null and wordless texts have fingerprint 0."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches):
        import pyarrow as pa

        for b in small_batches(batches, STEP_BYTES, "text"):
            fp = np.array([fingerprint(t, width) for t in texts_of(b.column(1))], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind.simpleString()}, fp long")


class Forest:
    """BK-trees over many groups at once, built level by level.

    fps: uint64; group: non-decreasing group number of each.  Equal values of a
    group share the first one's node."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        self.fps = fps
        n = len(fps)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        self.root_of = dict(zip(group[first].tolist(), first.tolist()))
        parent = np.repeat(first, np.diff(np.r_[first, n]))
        at = np.arange(n)
        at, parent = at[at != parent], parent[at != parent]
        parents, edges, children = [], [], []
        while len(at):
            d = np.bitwise_count(fps[at] ^ fps[parent]).astype(np.int64)
            at, parent, d = at[d > 0], parent[d > 0], d[d > 0]
            if not len(at):
                break
            slot = parent * 65 + d
            _, where, back = np.unique(slot, return_index=True, return_inverse=True)
            parents.append(parent[where])
            edges.append(d[where])
            children.append(at[where])
            placed = at[where][back]
            at, parent = at[placed != at], placed[placed != at]
        if parents:
            parent, edge, child = np.concatenate(parents), np.concatenate(edges), np.concatenate(children)
            key = parent * 66 + edge
            order = np.argsort(key, kind="stable")
            self.keys, self.child = key[order], child[order]
        else:
            self.keys, self.child = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def search(self, query: np.ndarray, roots: np.ndarray, radius: int):
        """Yields (query index, node) arrays of all pairs within the radius.

        What is still to do lies on a stack as queries with runs of children, and at
        most about FRONTIER pairs are laid out at a time."""
        work = [(np.arange(a, min(a + 4096, len(query))), None, None) for a in range(0, len(query), 4096)]
        while work:
            q, lo, many = work.pop()
            if lo is None:
                node = roots[q]
            else:
                node = self.child[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                q = np.repeat(q, many)
            d = np.bitwise_count(query[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.keys, node * 66 + np.maximum(d - radius, 1))
            many = np.searchsorted(self.keys, node * 66 + np.minimum(d + radius, 64), side="right") - lo
            on = np.flatnonzero(many > 0)
            if len(on):
                step = np.cumsum(many[on]) // FRONTIER
                work += [(q[x], lo[x], many[x]) for x in np.split(on, np.flatnonzero(np.diff(step)) + 1)]


def _spanning(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Lowers label (of n) until it is one number for each component of the links a-b and those before."""
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def _links(fps: np.ndarray, group: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links within each group between rows that are in its tree and rows that ask."""
    tree = np.flatnonzero(in_tree)
    forest = Forest(fps[tree], group[tree])
    query = np.flatnonzero(asks)
    roots = np.array([forest.root_of.get(g, -1) for g in group[query].tolist()], np.int64)
    query, roots = query[roots >= 0], roots[roots >= 0]
    label = np.arange(len(fps))
    for q, node in forest.search(fps[query], roots, radius):
        a, b = query[q], tree[node]
        label = _spanning(len(fps), a[a != b], b[a != b], label)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _blocks(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """Bit ranges of each shard key, so that a key has about as many bits as n has."""
    want = max(8, int(n).bit_length() - 2)
    extra = next((e for e in range(1, 5) if 64 * e / (radius + e) >= want), 4)
    count = radius + extra
    cuts = [round(64 * i / count) for i in range(count + 1)]
    ranges = list(zip(cuts, cuts[1:]))
    return [list(c) for c in combinations(ranges, extra)]


def _mask(ranges: list[tuple[int, int]]) -> int:
    return sum(((1 << (b - a)) - 1) << a for a, b in ranges)


def _finer(mask: int, varied: int, radius: int) -> list[int]:
    """Masks that add one of radius + 1 parts of the varied bits: values that differ in radius of these agree on one.

    None where too few bits are varied."""
    bits = [i for i in range(64) if varied >> i & 1]
    cuts = [round(len(bits) * i / (radius + 1)) for i in range(radius + 2)]
    return [mask | sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:])] if len(bits) > radius else []


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _sharded(rows: DataFrame, kinds: Column) -> DataFrame:
    """fp, t, k: each row's fp in a shard of each of its kinds, (t, mask); k: the bits of fp in the mask."""
    return rows.select("fp", F.explode(kinds).alias("s")).select("fp", "s.t", F.col("fp").bitwiseAND(F.col("s.mask")).alias("k"))


def _kinds(masks: dict[int, int]) -> Column:
    return F.array(*(F.struct(F.lit(t).alias("t"), _signed(m).alias("mask")) for t, m in masks.items()))


def shards_within(fps: DataFrame, radius: int, rows: int) -> DataFrame:
    """fp, t, k, parts: each pair of values within the radius shares a shard (t, k); parts: chunks of TREE_NODES it makes.

    Chunk pairs of a shard grow as its square, so one of more than radius + 1 chunks is dealt anew, again and again, by parts
    of the bits in which its values differ: radius + 1 rows for one each time.  What is left has as many chunks at most."""
    spark = fps.sparkSession
    masks = dict(enumerate(map(_mask, _blocks(rows, radius))))
    shards, done = _sharded(fps, _kinds(masks)), []
    while True:
        sizes = shards.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "k", F.ceil(F.col("n") / TREE_NODES).cast("int").alias("parts"))
        sizes = Staged(spark, sizes, "shards").df
        large = F.col("parts") > radius + 1
        if sizes.where(large).isEmpty():
            return functools.reduce(DataFrame.unionByName, [*done, shards.join(sizes, ["t", "k"])])
        done.append(shards.join(sizes.where(~large), ["t", "k"]))
        hot = Staged(spark, shards.join(sizes.where(large), ["t", "k"]), "shards").df
        varied = hot.groupBy("t", "k").agg(F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("bits")).groupBy("t").agg(F.bit_or("bits").alias("bits"))
        kinds, again = [], []
        for r in varied.collect():  # a row a kind of shards
            if finer := _finer(masks[r.t], r.bits % (1 << 64), radius):
                more = {len(masks) + i: m for i, m in enumerate(finer)}
                masks |= more
                kinds += [F.lit(r.t), _kinds(more)]
                again.append(r.t)
        done.append(hot.where(~F.col("t").isin(again)))
        if not again:
            return functools.reduce(DataFrame.unionByName, done)
        shards = Staged(spark, _sharded(hot.where(F.col("t").isin(again)), F.create_map(*kinds)[F.col("t")]), "shards").df


def near_links(fps: DataFrame, radius: int, rows: int | None = None) -> DataFrame:
    """(src, dst): a spanning set of links between the distinct values of column fp within the radius.

    Its components are those of all the links.  Values must be distinct and not
    null.  An empty table gives no links."""
    spark = fps.sparkSession
    ship_package(spark)
    met = shards_within(fps, radius, rows if rows is not None else fps.count()).withColumn("c", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    pairs = met.select("fp", "t", "k", "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")).select("fp", "t", "k", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "c")
    dealt = pairs.repartition(shuffle_partitions(spark), "t", "k", "a", "b").sortWithinPartitions("t", "k", "a", "b", "fp")

    def run(batches):
        import pyarrow as pa

        def found(x, _):
            src, dst = _links(x[0].view(np.uint64), _numbered(x), x[5] == x[3], x[5] == x[4], radius)
            return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], ["src", "dst"])

        yield from _grouped(batches, found, 6)

    return dealt.mapInArrow(tidy(run), "src long, dst long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Words are runs without ASCII white space, A-Z lower-cased; a fingerprint bit
    is set if it is in over half the hashes of the shingles of width words.
    Fingerprints within the radius are linked; component_id is the smallest id
    reachable, the row's own included.

    Null, empty and wordless texts have fingerprint 0 and are linked like others.
    Rows of equal fingerprint are one node, so copies cost no pairs; repeated ids
    stay as rows.  A null id is no candidate for component_id, which is null if
    no row of the component has one.  Empty tables give an empty result; other
    columns of docs are not read."""
    spark = docs.sparkSession
    with scratch() as kept:
        rows = Staged(spark, fingerprints(docs, id_col, text_col, width), "fingerprints").df
        nodes = Staged(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints").df
        members = connected_components(near_links(nodes.select("fp"), radius), "src", "dst")
        by_fp = _least_of_components(nodes, members, "fp")
        out = Staged(spark, rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "components")
        kept.append(out)
    return out.df


def _least_of_components(nodes: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """key, component, component_id of all nodes (key, least); members (node, component) has those with links."""
    label = nodes.select(key, "least").join(members.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))
    label = Staged(nodes.sparkSession, label.select(key, "least", "component"), "labels").df
    least = label.groupBy("component").agg(F.min("least").alias("component_id"))
    return label.join(least, "component").select(key, "component", "component_id")


# ---- near duplicates by similarity: trees over the shards of equal minima -----------

#: Minima of a document's shingles, each by a hash of its own, and bands of two that make the shards' keys. Two documents of
#: similarity s share no band with probability (1 - s * s) ** BANDS: 0.00004 at 0.8, 0.00000006 at 0.9.
MINIMA, BANDS = 20, 10
#: Documents of a shard are compared if so many minima are equal at least: at 0.8 fewer are in 0.000015 of all pairs.
ALIKE = 8
#: Bits by which fingerprints of most similar documents differ at most: trees give those pairs first, the others follow.
WIDE = 21
#: Most nodes of a tree here, most bytes of their shingles, and most documents that one task compares with a root.
NEAR_NODES, NEAR_BYTES, FANS = 8192, 32 << 20, 2048
#: Roots that a document is compared with.
ROOTS = 3
_ODD = np.random.default_rng(17).integers(1, 1 << 62, MINIMA, dtype=np.uint64) | np.uint64(1)


def _minima(h: np.ndarray) -> np.ndarray:
    """The keys of a document's bands, as BANDS int64 of two 32-bit minima each; h: hashes of its shingles."""
    if not len(h):
        return np.zeros(BANDS, np.int64)
    low = np.array([(h * a).min() for a in _ODD], np.uint64)
    return (low ^ low >> np.uint64(32)).astype(np.uint32).view(np.int64)


def _node(text: bytes) -> int:
    """Documents of equal words are one node."""
    x = xxhash.xxh3_64_intdigest(b" ".join(text.translate(ASCII_LOWER).split()))
    return x - (1 << 64) if x >> 63 else x


def _sketch(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, mark (a hash of id and text), node, fp, keys and size (how many different shingles) of each row."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in small_batches(batches, STEP_BYTES, "text"):
            out = [[], [], [], []]
            for text in texts_of(b.column(2)):
                h = np.unique(shingle_hashes(text, width))
                for c, x in zip(out, (_node(text), majority(h), _minima(h), len(h))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.int32())], ["doc_id", "mark", "node", "fp", "keys", "size"])

    rows = docs.select(F.col(id_col).alias("doc_id"), _mark(id_col, text_col).alias("mark"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, mark long, node long, fp long, keys array<long>, size int")


def _mark(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _shingles(docs: DataFrame, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the sorted 64-bit hashes of the nodes of wanted(node), made anew from the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(wanted, "node"))

    def run(batches):
        import pyarrow as pa

        wanted, seen = sent.value, set()
        for b in small_batches(batches, STEP_BYTES, "text"):
            texts = texts_of(b.column(0))
            nodes = np.array([_node(t) for t in texts], np.int64)
            out = [[], []]
            for i in np.flatnonzero(wanted.may(nodes)).tolist():
                if (node := int(nodes[i])) not in seen:  # copies in this task
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(node)
                    out[0].append(node)
                    out[1].append(np.unique(shingle_hashes(texts[i], width)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["node", "shingles"])

    made = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "node long, shingles binary")
    return made.join(wanted.distinct(), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _near_roots(docs: DataFrame, text_col: str, width: int, nodes: DataFrame, bands: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): links of nodes to the roots of their shards' trees: a shard's root is its least node.

    A node asks the ROOTS roots that share most minima with it, so this takes what is linear in the nodes, however many
    copies of one text differ a little; what these leave is for the trees.
    A root that many nodes ask for goes to several tasks with a part of them each."""
    spark = nodes.sparkSession
    roots = bands.groupBy("t", "k").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "k", "root")
    pairs = bands.join(roots, ["t", "k"]).where("node <> root").select("node", "root").distinct()
    of = nodes.select("node", "keys", "size")
    met = pairs.join(of, "node").join(of.select(F.col("node").alias("root"), F.col("keys").alias("root_keys"), F.col("size").alias("root_size")), "root")
    same = lambda x, y, shift: (F.shiftrightunsigned(x.bitwiseXOR(y), shift).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) == 0).cast("int")
    equal = F.aggregate(F.zip_with("keys", "root_keys", lambda x, y: same(x, y, 0) + same(x, y, 32)), F.lit(0), lambda a, x: a + x)
    near = (equal >= ALIKE) & (F.least("size", "root_size") >= similarity * F.greatest("size", "root_size"))
    able = met.where(near).groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct((-equal).alias("e"), "root"))), 1, ROOTS).alias("roots"))
    asked = Staged(spark, able.select("node", F.explode("roots.root").alias("root")), "asked").df
    held = Staged(spark, _shingles(docs, text_col, width, asked.select("node").union(asked.select("root"))), "shingles").df
    fans = asked.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / FANS).cast("int").alias("parts"))
    asks = asked.join(fans, "root").join(held, "node").select("root", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", "shingles")
    own = fans.select(F.col("root").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(held, "node").select(F.col("node").alias("root"), "part", F.lit(None).cast("long").alias("node"), "shingles")
    # the root, whose node is null, comes first of its part
    dealt = asks.unionByName(own).repartition(shuffle_partitions(spark), "root", "part").sortWithinPartitions("root", "part", F.col("node").asc_nulls_first())

    def run(batches):
        import pyarrow as pa

        root = np.zeros(0, np.uint64)
        for b in small_batches(batches, 16 << 20, "shingles"):
            out = [[], []]
            for of, node, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if node is None:
                    root = own
                    continue
                at = np.minimum(np.searchsorted(root, own), len(root) - 1)
                both = int((root[at] == own).sum())
                if both >= similarity * (len(root) + len(own) - both) - 1e-9:
                    out[0].append(node)
                    out[1].append(of)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["src", "dst"])

    return dealt.mapInArrow(tidy(run), "src long, dst long")


def _grouped(batches, found, columns: int, bodies_at: int | None = None):
    """Calls found with whole groups (of equal t, k, a, b: columns 1 to 4, sorted) of Arrow batches, as int64
    arrays and a list of the column of binaries."""
    held, bodies = None, []
    for batch in batches:
        x = [np.asarray(batch.column(i)).copy() for i in range(columns)]
        x = x if held is None else [np.concatenate(y) for y in zip(held, x)]
        bodies = bodies + batch.column(bodies_at).to_pylist() if bodies_at is not None else bodies
        if not len(x[0]):
            continue
        last = np.logical_and.reduce([c == c[-1] for c in x[1:5]])  # rows of the last group may go on
        cut = int(len(last) - last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield found([c[:cut] for c in x], bodies[:cut])
        held, bodies = [c[cut:] for c in x], bodies[cut:]
    if held is not None and len(held[0]):
        yield found(held, bodies)


def _numbered(x: list[np.ndarray]) -> np.ndarray:
    same = np.zeros(len(x[0]), bool)
    same[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in x[1:5]])
    return np.cumsum(~same) - 1


class Shard:
    """Rows of some groups: which of them may be linked.  keys: (n, BANDS); part: the component so far."""

    def __init__(self, group, in_tree, asks, keys, size, part, turn, similarity):
        self.group, self.in_tree, self.query, self.size, self.part, self.turn, self.similarity = group, in_tree, np.flatnonzero(asks), size, part, turn, similarity
        self.keys, self.low = keys, np.ascontiguousarray(keys).view(np.uint32)

    def pairs(self):
        """All pairs of a row that asks and one of the tree of its group that differ in size by no more than the
        similarity allows, in bounded steps."""
        size, group, query, n = self.size, self.group, self.query, len(self.group)
        tree = np.flatnonzero(self.in_tree)
        rows = tree[np.lexsort((size[tree], group[tree]))]
        most = int(size.max(initial=0)) + 1
        keys = group[rows] * most + size[rows]
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        own = group[query] * most
        # a row that is in the tree itself meets those after it
        low = np.where(self.in_tree[query], place[query] + 1, np.searchsorted(keys, own + np.ceil(self.similarity * size[query] - 1e-9).astype(np.int64)))
        high = np.searchsorted(keys, own + np.minimum(np.floor(size[query] / self.similarity + 1e-9).astype(np.int64), most - 1), "right")
        count = np.maximum(high - low, 0)
        for cut in np.split(np.arange(len(query)), np.flatnonzero(np.diff(np.cumsum(count) // FRONTIER)) + 1):
            c = count[cut]
            yield np.repeat(query[cut], c), rows[np.repeat(low[cut] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]

    def may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs are to be compared: of different components, enough minima equal, and no band before this
        shard's equal, in whose shard they meet too."""
        keep = np.flatnonzero((self.part[a] != self.part[b]) & (self.size[a] > 0) & (np.minimum(self.size[a], self.size[b]) >= self.similarity * np.maximum(self.size[a], self.size[b])))
        x, y = a[keep], b[keep]
        keep = keep[(self.low[x] == self.low[y]).sum(axis=1) >= ALIKE]
        x, y = a[keep], b[keep]
        out = np.zeros(len(a), bool)
        out[keep] = (self.keys[x] == self.keys[y]).argmax(axis=1) == self.turn[x]
        return out


def _similar(nodes, fps, shard: Shard, shingles) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links in the groups: of pairs that their trees give, which these decide, then of all others
    that may be linked: those whose fingerprints differ in more than WIDE bits."""
    group, query, size = shard.group, shard.query, shard.size
    tree = np.flatnonzero(shard.in_tree)
    forest = Forest(fps[tree], group[tree])
    roots = np.array([forest.root_of.get(g, -1) for g in group[query].tolist()], np.int64)
    query, roots = query[roots >= 0], roots[roots >= 0]
    # rows of one group and fingerprint share a node of the tree: each node's rows are a run of an order
    order = tree[np.lexsort((tree, fps[tree], group[tree]))]
    new = np.r_[True, (fps[order[1:]] != fps[order[:-1]]) | (group[order[1:]] != group[order[:-1]])] if len(order) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    run_of = np.zeros(len(fps), np.int64)
    run_of[order] = np.cumsum(new) - 1
    many = np.diff(np.r_[begin, len(order)])
    begins = np.cumsum(size) - size
    ids = np.unique(np.frombuffer(b"".join(shingles), np.uint64), return_inverse=True)[1]
    marked = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    first = np.unique(shard.part, return_index=True, return_inverse=True)
    label = first[1][first[2]]  # a component's rows, in whatever group, are linked already

    def near(x: int, others: np.ndarray) -> np.ndarray:
        """Of a row and others: whether their shingles are similar enough."""
        own, count = ids[begins[x] : begins[x] + size[x]], size[others]
        marked[own] = True
        at = np.repeat(begins[others] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        both = np.add.reduceat(marked[ids[at]], np.cumsum(count) - count, dtype=np.int64)
        marked[own] = False
        return both >= shard.similarity * (size[x] + count - both) - 1e-9

    def candidates():
        """Pairs of rows from pairs of a query and a node, in bounded steps."""
        for q, at in forest.search(fps[query], roots, WIDE):
            run = run_of[tree[at]]
            for cut in np.split(np.arange(len(q)), np.flatnonzero(np.diff(np.cumsum(many[run]) // FRONTIER)) + 1):
                count = many[run[cut]]
                skip = np.repeat(begin[run[cut]] - (np.cumsum(count) - count), count)
                yield np.repeat(query[q[cut]], count), order[skip + np.arange(int(count.sum()))]

    def others():
        for a, b in shard.pairs():
            far = np.bitwise_count(fps[a] ^ fps[b]) > WIDE
            yield a[far], b[far]

    for a, b in chain(candidates(), others()):
        able = shard.may(a, b)
        order_a = np.argsort(a[able], kind="stable")
        a, b, rows = a[able][order_a], b[able][order_a], 1
        while len(a):  # more and more rows at a time: the first links leave fewer pairs to look at
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
            heads = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])[: rows + 1] if len(a) else np.zeros(0, np.int64)
            to = int(heads[rows]) if len(heads) > rows else len(a)
            ends = [*heads[1:].tolist(), to][: min(rows, len(heads))]
            for x, y in zip(heads.tolist(), ends):
                for z in range(x, y, 4096):
                    b[z : min(z + 4096, y)][~near(int(a[x]), b[z : min(z + 4096, y)])] = a[x]
            label = _spanning(len(fps), a[:to], b[:to], label)
            a, b, rows = a[to:], b[to:], min(2 * rows, 256)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return nodes[moved], nodes[label[moved]]


def _near_others(docs: DataFrame, text_col: str, width: int, nodes: DataFrame, bands: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): a spanning set of the links that the roots leave: of nodes of different components of a shard.

    parts(node, component).  Rows of a shard's root's component need not meet each other, so only the others are dealt as
    pairs of chunks; those that may be linked to another are found by their minima, and shingles are made for these only."""
    spark = nodes.sparkSession
    labelled = Staged(spark, nodes.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).select("node", "fp", "keys", "size", "part"), "nodes").df
    rows = bands.join(labelled.select("node", "size", "part"), "node")
    whole = rows.groupBy("t", "k").agg(F.min_by("part", "node").alias("main"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("t", "k", "main")
    mixed = Staged(spark, rows.join(whole, ["t", "k"]).withColumn("of_main", F.col("part") == F.col("main")), "mixed").df
    chunks = lambda of: F.ceil(F.greatest(F.sum(of.cast("long")) / NEAR_NODES, F.sum(F.when(of, F.col("size").cast("long")).otherwise(0)) * 8 / NEAR_BYTES)).cast("int")
    sizes = mixed.groupBy("t", "k").agg(chunks(F.col("of_main")).alias("p"), chunks(~F.col("of_main")).alias("o"))
    c = F.when(F.col("of_main"), F.pmod(F.xxhash64("node"), F.greatest("p", F.lit(1)))).otherwise(F.greatest("p", F.lit(1)) + F.pmod(F.xxhash64("node"), F.greatest("o", F.lit(1)))).cast("int")
    met = mixed.join(sizes, ["t", "k"]).withColumn("c", c).withColumn("p", F.greatest("p", F.lit(1))).withColumn("o", F.greatest("o", F.lit(1)))
    pairs = met.select("node", "t", "k", "c", F.explode(F.sequence(F.when(F.col("of_main"), F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("o") - 1)).alias("d")).select("node", "t", "k", F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"), "c")

    def dealt(df: DataFrame, *more: str) -> DataFrame:
        return df.join(labelled, "node").select("node", "t", "k", "a", "b", "c", "fp", "size", "part", "keys", *more).repartition(shuffle_partitions(spark), "t", "k", "a", "b").sortWithinPartitions("t", "k", "a", "b", "node")

    def shard_of(x, keys) -> Shard:
        keys = np.frombuffer(b"".join(keys), np.int64).reshape(-1, BANDS)
        return Shard(_numbered(x), x[5] == x[3], x[5] == x[4], keys, x[7].astype(np.int64), x[8], x[1].astype(np.int64), similarity)

    def flat(batches):
        """The lists of keys as binaries."""
        import pyarrow as pa

        for b in batches:
            keys = np.asarray(b.column(9).flatten()).reshape(-1, BANDS)
            yield pa.RecordBatch.from_arrays([*b.columns[:9], pa.array([k.tobytes() for k in keys], pa.binary()), *b.columns[10:]], b.schema.names)

    def ask(batches):
        import pyarrow as pa

        def found(x, keys):
            shard, on = shard_of(x, keys), np.zeros(len(x[0]), bool)
            for a, b in shard.pairs():
                may = shard.may(a, b)
                on[a[may]] = on[b[may]] = True
            return pa.RecordBatch.from_arrays([pa.array(c[on]) for c in x[:6]], ["node", "t", "k", "a", "b", "c"])

        yield from _grouped(flat(batches), found, 9, 9)

    able = Staged(spark, dealt(pairs).mapInArrow(tidy(ask), "node long, t int, k long, a int, b int, c int"), "able").df
    held = Staged(spark, _shingles(docs, text_col, width, able.select("node")), "shingles").df

    def run(batches):
        import pyarrow as pa

        def both(batches):
            for b in flat(batches):  # keys and shingles in one binary
                joined = [k + s for k, s in zip(b.column(9).to_pylist(), b.column(10).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:9], pa.array(joined, pa.binary())], b.schema.names[:10])

        def found(x, bodies):
            src, dst = _similar(x[0], x[6].view(np.uint64), shard_of(x, [y[: 8 * BANDS] for y in bodies]), [y[8 * BANDS :] for y in bodies])
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

        yield from _grouped(both(small_batches(batches, 16 << 20, "shingles")), found, 9, 9)

    return dealt(able.join(held, "node"), "shingles").mapInArrow(tidy(run), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, mark, component_id for every row of docs: the smallest id of the documents that a chain of
    Jaccard similarities of at least similarity leads to, by shingles of width words; mark: a hash of id and text.

    Documents meet in shards of two equal shingle minima.  Every document is first compared with the root of its shard's
    tree; in shards that this leaves in several components, BK-trees give the documents whose fingerprints differ in
    at most WIDE bits, and all others that may be linked follow.  Similarity is counted exactly, so links are lost only
    where two documents share no shard or fewer than ALIKE minima.
    Documents of equal words are one node.

    Null, empty and wordless texts are one group.  Repeated ids stay as rows; a null id
    is no candidate for component_id.  Empty tables give an empty result; other columns
    are not read."""
    with scratch() as kept:
        out = Staged(docs.sparkSession, _near_groups(docs, id_col, text_col, width, similarity).select("doc_id", "mark", "component_id"), "components")
        kept.append(out)
    return out.df


def _near_groups(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """doc_id, mark, component and component_id of each row."""
    spark = docs.sparkSession
    rows = Staged(spark, _sketch(docs, id_col, text_col, width), "sketches").df
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("size").alias("size"))
    nodes = Staged(spark, nodes, "nodes").df
    each = nodes.select("node", F.posexplode("keys").alias("t", "k"))
    shared = each.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "k")
    bands = Staged(spark, each.join(shared, ["t", "k"]), "bands").df
    first = Staged(spark, _near_roots(docs, text_col, width, nodes, bands, similarity), "links").df
    parts = Staged(spark, connected_components(first, "src", "dst"), "parts").df
    second = _near_others(docs, text_col, width, nodes, bands, parts, similarity)
    links = Staged(spark, parts.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(second), "links").df
    members = connected_components(links, "src", "dst")
    return rows.select("doc_id", "mark", "node").join(_least_of_components(nodes, members, "node"), "node").select("doc_id", "mark", "component", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near_duplicates: that of the smallest id, of several such that of the
    smallest hash of id and text; of rows without an id one stays where no other has an id.

    Rows that are the same in id and text are one document; which of
    them stays, if other columns differ, is not defined.  Rows that no other row is like stay where they are: only
    those that go, their copies and a few others are joined."""
    spark, names = docs.sparkSession, docs.columns
    with scratch() as kept:
        groups = Staged(spark, _near_groups(docs, id_col, text_col, width, similarity).select("doc_id", "mark", "component"), "groups").df
        best = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("best"), F.count(F.lit(1)).alias("n"))
        judged = groups.select("mark", "component").join(best.where("n > 1").select("component", F.col("best.mark").alias("stays")), "component")
        verdict = Staged(spark, judged.groupBy("mark").agg(F.max((F.col("mark") == F.col("stays")).cast("int")).alias("stays")), "verdict")
        kept.append(verdict)
    sent = spark.sparkContext.broadcast(KeyFilter.of(verdict.df, "mark"))
    carried = Carried(docs, names)

    def deal(batches, asked: bool):
        import pyarrow as pa

        judged = sent.value
        for b in batches:
            at = pa.array(np.flatnonzero(judged.may(np.asarray(b.column(0))) == asked))
            yield (b if asked else b.drop_columns(["mark"])).take(at)

    rows = docs.select(_mark(id_col, text_col).alias("mark"), *carried.columns)
    alone = rows.mapInArrow(tidy(partial(deal, asked=False)), carried.schema[2:])
    met = rows.mapInArrow(tidy(partial(deal, asked=True)), f"mark long{carried.schema}").join(verdict.df, "mark", "left").where(F.coalesce("stays", F.lit(1)) == 1)
    # rows repeated with their id and text are of one mark
    once = met.where("stays is not null").dropDuplicates(["mark"]).unionByName(met.where("stays is null"))
    return alone.unionByName(once.select(*carried.inside)).select(*(F.col(i).alias(n) for i, n in zip(carried.inside, names)))
