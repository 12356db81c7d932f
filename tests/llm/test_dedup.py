"""Operators 6, 7 and 10: against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import phrasepivot.llm.decontaminate as decontaminate
import phrasepivot.llm.simhash as simhash
import phrasepivot.llm.suffix_dedup as suffix_dedup
from phrasepivot.llm.column_bwt import Collection, SequentialFile, repeated_starts


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def letters(rng, n, of="abcdefghij klm"):
    return "".join(rng.choice(of) for _ in range(n))


# ---- suffix dedup ---------------------------------------------------------------------


def repeats_by_hand(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(t, hit) if not y)
        out.append((len(t), sum(hit), sum(1 for i, y in enumerate(hit) if y and (i == 0 or not hit[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repeated():
    rng = random.Random(3)
    parts = [letters(rng, n) for n in (70, 100, 150, 300, 900)] + ["é" * 120 + letters(rng, 80)]
    texts = [None, "", letters(rng, 63), "a" * 500, "ab" * 300, "a" * 64, letters(rng, 50)]
    for _ in range(70):
        t = ""
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(parts)
            a = rng.randint(0, len(p) // 2)
            t += letters(rng, rng.randint(0, 200)) + p[a : a + rng.randint(30, 900)]
        texts.append(t)
    return texts + texts[8:12] + [texts[9]] * 3


@pytest.mark.parametrize("length,group", [(64, 1024), (64, 4), (101, 1024)])
def test_repeats(spark, monkeypatch, repeated, length, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # a small one deals nearly all groups anew
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(repeated)], "doc_id long, text string, n_bytes int")
    got = [tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, length).orderBy("doc_id").collect()]
    assert got == repeats_by_hand([(t or "").encode() for t in repeated], length)


def test_passages_of_over_fifty_words(spark):
    """Passages under and over the length; clean texts lose nothing."""
    rng = random.Random(14)
    say = lambda n: " ".join(letters(rng, rng.randint(3, 8), "abcdefghijk") for _ in range(n))
    short, long = say(52), say(90)
    assert 250 < len(short) < 400 < len(long)
    texts = [say(80) for _ in range(20)] + [say(60) + " " + p + " " + say(50) for p in (short, long) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length, first in ((400, 23), (200, 20)):
        got = [r.n_removed for r in suffix_dedup.remove_repeats(df, length).orderBy("doc_id").collect()]
        assert got == [x[1] for x in repeats_by_hand([t.encode() for t in texts], length)] and [n > 0 for n in got] == [i >= first for i in range(26)]
    twice = spark.createDataFrame([(1, short), (2, short), (3, None), (4, "x")], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.remove_repeats(twice, 200).orderBy("doc_id").collect()] == [len(short), len(short), 0, 0]


def test_runs_of_a_short_period(spark):
    """Runs of one byte and of a few in turn, against brute force; strings that other texts hold once."""
    rng = random.Random(15)
    say = lambda n: letters(rng, n, "abcdefgh ")
    runs = [u * n for u, n in (("x", 300), ("-=", 200), ("abc", 90), ("0123456789", 30), ("x", 100), ("q", 64), ("z", 65))]
    texts = [say(50) + r + say(40) for r in runs] + [runs[1], say(30) + "x" * 64 + say(30), say(9) + "q" * 64, "y" * 40 + say(80), runs[0] + runs[1] + runs[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, 64).orderBy("doc_id").collect()]
    assert got == repeats_by_hand([t.encode() for t in texts], 64)


def test_ten_megabytes_of_one_byte(spark):
    long = "a" + "b" * 10_000_000 + "c" * 399
    df = spark.createDataFrame([(1, long), (2, "x" * 500 + "b" * 400 + "y"), (3, "z" * 399)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df, 400).collect()}
    assert got == {1: (10_000_000, 1), 2: (900, 1), 3: (0, 0)}


def test_cut_texts(spark, repeated):
    df = spark.createDataFrame([(i % 9 if i % 4 else None, t, i) for i, t in enumerate(repeated)], "doc_id long, text string, k1 int")
    cut = suffix_dedup.cut_repeats(df, 64)
    assert cut.columns == df.columns
    got = {r.k1: r.text for r in cut.collect()}
    for i, (t, want) in enumerate(zip(repeated, repeats_by_hand([(t or "").encode() for t in repeated], 64))):
        assert (got[i] is None) == (t is None)
        if t and "é" not in t:
            assert hashlib.sha256(got[i].encode()).hexdigest() == want[3]
    assert suffix_dedup.cut_repeats(df.limit(0), 64).count() == 0
    assert suffix_dedup.remove_repeats(df.limit(0), 64).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, 10)


def test_long_texts_are_cut_into_parts(monkeypatch):
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 5000).astype(np.uint8).tobytes()
    whole = suffix_dedup.anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 100)
    starts = {int(s): int(a) for a, lo, hi in zip(*whole[1:]) for s in range(lo, hi + 1)}
    parts = {}
    for part in suffix_dedup._chunks([0], [text], 100, most=700):
        raw = b"".join(t for _, _, t in part)
        at = np.cumsum([0, *(len(t) for _, _, t in part)])
        for t, a, lo, hi in zip(*suffix_dedup.anchors(np.frombuffer(raw, np.uint8), at, 100)):
            shift = part[t][1]
            parts.update({int(s) + shift: int(a) + shift for s in range(lo, hi + 1)})
    assert parts == starts and sorted(starts) == list(range(4901))


def test_column_transform(tmp_path):
    rng = random.Random(5)
    for case in range(20):
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(12, 40))) for _ in range(rng.randint(2, 30))]
        left = np.array([rng.randint(0, 8) for _ in pieces])
        group = np.sort(np.array([rng.randint(0, 2) for _ in pieces]))
        got = repeated_starts(pieces, left, group, 6, f"file://{tmp_path}")
        most = left.max()
        for i, p in enumerate(pieces):
            for column in range(most + 1):
                s = column - most + left[i]
                here = s >= 0 and s + 6 <= len(p) and any(j != i and group[j] == group[i] and column - most + left[j] >= 0 and o[column - most + left[j] :][:6] == p[s : s + 6] for j, o in enumerate(pieces))
                assert got[i, column] == here, (case, i, column)


@pytest.mark.parametrize("held", [0, 300, 1 << 20])
def test_collection_of_several_parts(tmp_path, held):
    rng = random.Random(held)
    for case in range(15):
        collection, whole, groups = Collection(f"file://{tmp_path}", held), [], 0
        for _ in range(rng.randint(1, 4)):
            pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(12, 40))) for _ in range(rng.randint(1, 20))]
            left = np.array([rng.randint(0, 8) for _ in pieces])
            group = np.sort(np.array([rng.randint(0, 2) for _ in pieces])) + groups
            groups = int(group[-1]) + 1
            collection.add(pieces, left, group)
            whole += zip(pieces, left.tolist(), group.tolist())
        assert held >= 1 << 20 or list(tmp_path.iterdir())
        got = {(i, d) for i, far, near in zip(*(x.tolist() for x in collection.runs(6))) for d in range(near, far + 1)}
        cell = Counter((g, d, p[n - d : n - d + 6]) for p, n, g in whole for d in range(n + 1))
        assert got == {(i, d) for i, (p, n, g) in enumerate(whole) for d in range(n + 1) if n - d + 6 <= len(p) and cell[g, d, p[n - d : n - d + 6]] > 1}, case
        assert not list(tmp_path.iterdir())


def test_sequential_file_goes_to_the_folder(tmp_path):
    f = SequentialFile(f"file://{tmp_path}", held=100)
    arrays = [np.arange(n, dtype=np.int32) for n in (10, 30, 7)]
    for a in arrays:
        f.write(a)
    assert len(list(tmp_path.iterdir())) == 1
    f.rewind()
    assert all((f.read(len(a), np.int32) == a).all() for a in arrays)
    f.drop()
    assert not list(tmp_path.iterdir())


# ---- SimHash ----------------------------------------------------------------------------


def fingerprint_by_hand(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(keys, near):
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if near(keys[i], keys[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(keys))]


def test_simhash(spark):
    rng = random.Random(6)
    texts = [None, "", " \n", "One", "one two", "É ünï x\x85y z w"]
    for _ in range(25):
        w = [letters(rng, rng.randint(1, 7), "abcdefgh") for _ in range(rng.randint(3, 300))]
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zz"
            texts.append("\t".join(w))
    texts += ["w " * 20_000, texts[7], texts[7]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()}
    prints = [fingerprint_by_hand(t) for t in texts]
    root = components_by_hand(prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    for i, f, r in zip(ids, prints, root):
        assert got[i] == (f"{f:016x}", min(j for j, q in zip(ids, root) if q == r))
    assert simhash.simhash_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("nodes", [2048, 16])
def test_links_lose_nothing(spark, monkeypatch, nodes):
    monkeypatch.setattr(simhash, "TREE_NODES", nodes)
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds[:12].tolist():
        for _ in range(40):
            s ^= 1 << int(rng.integers(0, 64))
            fps.add(s)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = [tuple(y % (1 << 64) for y in r) for r in simhash.near_links(df, 3).collect()]
    assert all(a != b for a, b in links)
    at = {x: i for i, x in enumerate(fps)}
    want = components_by_hand(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(at[a]), find(at[b])))
        parent[b] = a
    assert [find(i) for i in range(len(fps))] == want


def test_large_shards_are_dealt_anew(spark, monkeypatch):
    """Values that share most of their bits: every pair within the radius has a shard, and rows don't grow as the square."""
    monkeypatch.setattr(simhash, "TREE_NODES", 16)
    rng = np.random.default_rng(3)
    low = np.unique(rng.integers(0, 1 << 18, 1500, dtype=np.uint64))
    fps = [(0x8123 << 48) | (int(x) & 0x1FF) | (int(x) >> 9 << 30) for x in low] + [7, 6]
    assert len(set(fps)) == len(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    rows = simhash.shards_within(df, 3, len(fps)).collect()
    assert max(r.parts for r in rows) <= 4 and sum(r.parts for r in rows) < 80 * len(fps)
    met = {}
    for r in rows:
        met.setdefault((r.t, r.k), set()).add(r.fp % (1 << 64))
    of = {}
    for key, values in met.items():
        for x in values:
            of.setdefault(x, set()).add(key)
    all_ = np.array(fps, np.uint64)
    near = [(a, b) for a in all_ for b in all_[np.bitwise_count(all_ ^ a) <= 3].tolist() if int(a) < b]
    assert len(near) > 1000 and all(of[int(a)] & of[b] for a, b in near)


@pytest.mark.parametrize("nodes", [8192, 5])
def test_near_duplicates(spark, monkeypatch, nodes):
    monkeypatch.setattr(simhash, "NEAR_NODES", nodes)
    rng = random.Random(9)
    texts = [None, "", "a b", "a b"]
    for _ in range(20):
        w = [letters(rng, rng.randint(1, 7), "abcdefgh") for _ in range(rng.randint(5, 200))]
        for _ in range(rng.randint(1, 4)):
            texts.append(" ".join(w))
            w = list(w)
            w[rng.randrange(len(w))] = "zz"
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, node int")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    want = components_by_hand(sets, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b))
    assert [got[i] for i in range(len(texts))] == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# ---- decontamination ----------------------------------------------------------------------


def test_near_duplicates_of_far_fingerprints(spark):
    """Lines that one text repeats move its fingerprint, not its distinct shingles; so do pairs of any radius."""
    rng = random.Random(31)
    texts = []
    for _ in range(12):
        body, line = ([letters(rng, 6, "abcdefgh") for _ in range(n)] for n in (200, 30))
        texts += [" ".join(body + line), " ".join(body + line * 20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert all(got[i] == i // 2 * 2 for i in range(len(texts)))


def planted_pair(rng, n: int, similarity: float):
    """Hashes of two sets of about n shingles of that similarity."""
    whole = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    lost = round(n * (1 - similarity))
    at = rng.integers(0, lost + 1)
    return whole[at:], whole[: n - (lost - at)]


def test_recall_of_shards_at_the_least_similarity():
    """Pairs of 0.8 and 0.85 that meet in no shard, or are not compared there, are fewer than 1 in 2,000."""
    rng = np.random.default_rng(3)
    for similarity in (0.8, 0.85):
        missed = 0
        for _ in range(4000):
            a, b = (simhash._minima(x) for x in planted_pair(rng, 100, similarity))
            missed += not ((a == b).any() and (a.view(np.uint32) == b.view(np.uint32)).sum() >= simhash.ALIKE)
        assert missed <= 2


def test_trees_decide_the_pairs_within_their_radius(monkeypatch):
    """Those that follow are the others: without the trees' pairs, near ones aren't found a second time."""
    h = np.sort(np.random.default_rng(5).integers(0, 1 << 63, 200).astype(np.uint64))
    sets, fps = [h, h[1:]], np.array([simhash.majority(h), simhash.majority(h[1:])], np.int64).view(np.uint64)
    assert np.bitwise_count(fps[0] ^ fps[1]) <= simhash.WIDE
    keys, yes, none = np.array([simhash._minima(x) for x in sets]), np.ones(2, bool), np.zeros(2, np.int64)
    turn = np.repeat((keys[0] == keys[1]).argmax(), 2)
    links = lambda: len(simhash._similar(np.arange(2), fps, simhash.Shard(none, yes, yes, keys, np.array([200, 199]), np.arange(2), turn, 0.8), [x.tobytes() for x in sets])[0])
    assert links() == 1
    monkeypatch.setattr(simhash.Forest, "search", lambda *args: iter(()))
    assert links() == 0


def test_no_radius_filters_similar_rows():
    """Rows of a group whose fingerprints are opposite are linked if their shingles are similar."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(6)]
    sets += [s[: int(len(s) * 0.9)] for s in sets]
    keys = np.array([simhash._minima(s) for s in sets])
    turn = np.tile((keys[:6] == keys[6:]).argmax(axis=1), 2)
    fps = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps, group, size = np.r_[fps, ~fps], np.zeros(12, np.int64), np.array([len(s) for s in sets])
    for in_tree in (np.ones(12, bool), np.arange(12) < 6):
        asks = in_tree if in_tree.all() else ~in_tree
        shard = simhash.Shard(group, in_tree, asks, keys, size, np.arange(12), turn, 0.8)
        src, dst = simhash._similar(np.arange(12), fps, shard, [s.tobytes() for s in sets])
        assert sorted(tuple(sorted(p)) for p in zip(src.tolist(), dst.tolist())) == [(i, i + 6) for i in range(6)]


@pytest.mark.parametrize("nodes", [8192, 3])
def test_chains_that_no_root_joins(spark, monkeypatch, nodes):
    """Texts that differ from their neighbours a little and from the first a lot; chunks of few rows."""
    monkeypatch.setattr(simhash, "NEAR_NODES", nodes)
    monkeypatch.setattr(simhash, "FANS", nodes)
    rng = random.Random(12)
    texts = []
    for _ in range(5):
        w = [letters(rng, 6, "abcdefgh") for _ in range(150)]
        for step in range(24):
            texts.append(" ".join(w))
            w = w[4:] + [letters(rng, 6, "abcdefgh") for _ in range(4)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    want = components_by_hand(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert [got[i] for i in range(len(texts))] == want


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(5)
    w = [letters(rng, 5, "abcdefgh") for _ in range(80)]
    other = " ".join(letters(rng, 5, "abcdefgh") for _ in range(60))
    near = lambda k: " ".join(w[:k] + ["zz"] + w[k + 1 :])
    rows = [(5, near(3), 1), (5, near(3), 2), (5, other, 3), (2, " ".join(w), 4), (2, " ".join(w).upper(), 5), (None, near(9), 6), (None, "eins zwei drei", 7), (None, "eins  zwei drei", 8), (7, None, 9), (8, "", 10), (None, None, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id or -1, (r.text or "").lower()[:4]) for r in out.collect())
    assert got == sorted([(5, other[:4]), (2, " ".join(w)[:4]), (-1, "eins"), (7, "")])
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("kept", [200_000, 7])
def test_contamination(spark, monkeypatch, kept):
    monkeypatch.setattr(decontaminate, "KEPT", kept)
    rng = random.Random(10)
    vocabulary = ["the"] * 10 + [letters(rng, 4, "abcé1") for _ in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate((13, 14, 30, 5, 1, 40, 12, 20))] + [(10, None), (11, "..."), (12, " ".join(say(25))), (None, "zq zq zq")]
    items += [items[2], (77, items[0][1])]
    docs = [(0, None), (1, ""), (2, "-- !"), (3, "the " * 5000)]
    for i in range(40):
        parts = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, 6)
            parts += w[a : a + rng.randint(10, 30)] + say(rng.randint(0, 20))
        docs.append((i + 4, ", ".join(parts).upper() if i % 2 else "\n".join(parts)))
    docs += [docs[5], (None, docs[6][1])]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = pattern.findall(lower(t or ""))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add("" if i is None else str(i))
    want = []
    for i, t in docs:
        w, hit, ids = pattern.findall(lower(t or "")), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), sorted(ids)))
    docs_df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, hits int")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.contamination(docs_df, items_df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(x[2] for x in want)
    assert decontaminate.contamination(docs_df.limit(0), items_df).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs_df, items_df.limit(0)).collect()} == {0}
    clash = docs_df.withColumnsRenamed({"doc_id": "k1", "hits": "n_words"})
    left = decontaminate.drop_contaminated(clash, items_df, id_col="k1")
    assert left.columns == clash.columns
    clean = Counter(t for (i, t), (_, n, hit, _) in zip(docs, want) if not (hit and 20 * hit >= n))
    assert Counter(r.text for r in left.collect()) == clean and len(clean) < len(want)
    assert decontaminate.drop_contaminated(docs_df.limit(0), items_df).count() == 0
    assert decontaminate.drop_contaminated(docs_df, items_df.limit(0)).count() == len(docs)


def test_contamination_of_long_texts(spark):
    rng = random.Random(2)
    say = lambda n: [letters(rng, rng.randint(3, 7), "abcdefgh") for _ in range(n)]
    item, short = say(20), say(4)
    long = say(300_000)
    long[150_000:150_000] = item
    docs = [(0, " ".join(long)), (1, "x" * 500_000), (2, " ".join((item + ["and"]) * 10_000)), (3, " ".join(short * 50_000)), (4, "the " * 300_000)]
    items = [(1, " ".join(item)), (2, " ".join(short)), (3, " ".join(say(3000) + item[:13])), (4, "y" * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {0: (300_020, 20, ["1", "3"]), 1: (1, 0, []), 2: (210_000, 200_000, ["1", "3"]), 3: (200_000, 200_000, ["2"]), 4: (300_000, 0, [])}
