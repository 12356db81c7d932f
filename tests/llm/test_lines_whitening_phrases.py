"""Operators 11 to 13 against brute force."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasepivot.llm import collocations
from phrasepivot.llm.collocations import mine_phrases
from phrasepivot.llm.line_dedup import dedup_lines
from phrasepivot.llm.whitening import whiten

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ---- lines ---------------------------------------------------------------------------


def lines_by_hand(rows, least=2, chars=10):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    last = float("inf")
    first = {k: min(v, key=lambda i: last if i is None else i) for k, v in holders.items() if len(k) >= chars and len(v) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), i) == i or key(x) not in first]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(repr, out))


LINES = [
    (3, "a common line\nown of three\n\nA COMMON LINE \t"), (1, "short\n  A Common Line\nä long ünusual lÏne\nshort"), (2, "short\nä long ünusual lÏne\nÄ long ünusual line"), (4, None), (5, ""), (6, "a common line"),
    (6, "a common line"), (7, "one line of seven\r\none line of seven"), (None, "a common line\nonly null has this"), (None, "only null has this\nand once more"), (8, "exactly10!\n123456789"), (9, "exactly10!\n123456789"), (6, "another text of six\nexactly10!"),
]


@pytest.mark.parametrize("least", [2, 3, 4])
def test_lines(spark, least):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in LINES], "doc_id long, text string, id string, N_lines int")
    out = dedup_lines(df, least)
    assert out.columns == ["doc_id", "text", "id", "n_lines", "n_dropped"]
    got = sorted(repr((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in out.collect())
    assert got == lines_by_hand(LINES, least)


def test_lines_of_random_texts(spark):
    rng = random.Random(5)
    pool = [f"line number {i} of a pool" for i in range(60)] + ["", "short", " \t"]
    rows = [(rng.randrange(40), "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for _ in range(120)]
    # a line in every text, and a text of very many lines
    rows += [(i, "the line of all texts\nand one of its own %d" % i) for i in range(100, 400)]
    rows.append((50, "\n".join(f"a line of the long text {i % 5000}" for i in range(20_000))))
    rows.append((60, "\n".join(f"a line of the long text {i}" for i in range(4000, 6000))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(repr((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in dedup_lines(df).collect()) == lines_by_hand(rows)


def test_lines_of_an_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lines_without_python(spark):
    plan = dedup_lines(spark.createDataFrame(LINES, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- whitening -----------------------------------------------------------------------


def whitened_by_hand(vectors):
    x = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    y = (n * x - s) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return n, deviation, y, values[::-1], axes[:, ::-1]


def whitening_rows(out):
    found = defaultdict(dict)
    for r in out.collect():
        assert r.component not in found[r[0]]
        found[r[0]][r.component] = r
    return found


@pytest.mark.parametrize("dims", [5, 12, 40])
def test_whitening(spark, dims):
    rng = np.random.default_rng(dims)
    vectors = rng.normal(size=(300, dims)) * np.linspace(3, 0.2, dims)
    bad = [None, [None] * dims, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1)]
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(vectors)] + [(1000 + i, x) for i, x in enumerate(bad)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, component string").repartition(3)
    n, deviation, y, values, axes = whitened_by_hand(vectors)
    found = whitening_rows(whiten(df))
    assert found.keys() == set(range(300))
    many, trace = min(8, dims), values.sum()
    signs = [np.sign(found[0][c + 1].whitened * (y[0] @ axes[:, c])) for c in range(many)]
    for i, rows in found.items():
        assert sorted(rows) == list(range(1, many + 1))
        for c, r in rows.items():
            assert (r.n, r.deviation) == (n, deviation[i])
            assert abs(r.whitened - signs[c - 1] * (y[i] @ axes[:, c - 1]) / np.sqrt(values[c - 1])) < 1e-8
            assert abs(r.explained - values[c - 1] / trace) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_few_directions(spark):
    """Fewer components than asked for where the rows have no more; repeated rows and null ids stay."""
    rng = np.random.default_rng(1)
    vectors = [[float(a), float(-a), 1.0, 0.0] for a in rng.integers(-50, 50, 30)]
    df = spark.createDataFrame([(None if i < 2 else i // 2, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    rows = whiten(df).collect()
    assert len(rows) == 30 and {r.component for r in rows} == {1} and abs(rows[0].explained - 1) < 1e-9
    assert Counter(r.vec_id for r in rows) == Counter(None if i < 2 else i // 2 for i in range(30))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, [])]])
def test_whitening_of_nothing(spark, rows):
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.collect() == []


def test_whitening_pads_and_large_entries(spark):
    """Shorter vectors are padded; a deviation beyond 64 bits is null, and the shares stay right."""
    rows = [(1, [3.0, 1.0]), (2, [5.0]), (3, [-2.0, 4.0]), (4, [])]
    found = whitening_rows(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    n, deviation, y, values, axes = whitened_by_hand([v + [0.0] * (2 - len(v)) for _, v in rows])
    assert [found[i][1].deviation for i in range(1, 5)] == deviation
    big = [(i, [float(v) * 1e9, float(w)]) for i, (v, w) in enumerate(np.random.default_rng(2).normal(size=(20, 2)))]
    found = whitening_rows(whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")))
    assert all(r.deviation is None for rows in found.values() for r in rows.values()) and abs(found[0][1].explained - 1) < 1e-6


# ---- phrases -------------------------------------------------------------------------


def phrases_by_hand(docs, least, top):
    import re

    count, total, out = defaultdict(Counter), Counter(), []
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3, 4):
                for i in range(len(w) - k + 1):
                    count[lang][tuple(w[i : i + k])] += 1
    for lang, grams in count.items():
        candidates = {g: a for g, a in grams.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in candidates.items():
            if any(len(h) > len(g) and 100 * b >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in candidates.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (grams[g[:k]] + grams[g[k:]]), k, grams[g[:k]], grams[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for i, x in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def phrases(df, least, top, block=collocations.BLOCK_BYTES, bucket=collocations.BUCKET_WORDS):
    return sorted(tuple(r) for r in mine_phrases(df, least, top, block_bytes=block, bucket_words=bucket).collect())


@pytest.mark.parametrize("block,bucket", [(collocations.BLOCK_BYTES, collocations.BUCKET_WORDS), (400, 100)])
def test_phrases(spark, block, bucket):
    rng = random.Random(block)
    words = ["a", "B", "cc", "d\x1fd", "É", "eé", "x-y", "'", "\x00"]
    docs = [(None, "a b c d. a b c d! a b c d"), ("en", None), ("fr", ""), ("en", "  . , ;"), ("en", "A b\tA B\n\nA b"), ("de", "q q q q q q q q q q")]
    for _ in range(80):
        text = "".join(rng.choice(words if rng.random() < 0.6 else words[:2]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randrange(60)))
        docs.append((rng.choice(["en", "de", None, "und"]), text))
    docs += docs[:20]
    df = spark.createDataFrame([(*d, "clash", i) for i, d in enumerate(docs)], "lang string, text string, phrase string, a int").repartition(3)
    want = phrases_by_hand(docs, 3, 12)
    assert len(want) >= 20 and phrases(df, 3, 12, block, bucket) == want


def test_phrases_of_a_long_text(spark):
    """A text of more than a block, and one without a separator; the names of all blocks are the same."""
    rng = random.Random(1)
    piece = lambda n: " ".join(rng.choice(["aa", "b", "c", "dd"]) for _ in range(n))
    long = "ab " * 100 + ". ".join(piece(50) for _ in range(20_000))
    docs = [("en", long), ("en", piece(200)), ("en", long[: 1 << 20].replace(".", "")), ("fr", piece(300))]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    assert phrases(df, 30, 2000, 1 << 18, 1 << 16) == phrases_by_hand(docs, 30, 2000)


def test_slices():
    text = b"aa bb. cc dd ee ff gg hh ii. jj." + b"k" * 30 + b".l"
    parts = list(collocations._slices(text, 10))
    assert b"".join(parts) == text and all(p.endswith(b".") for p in parts[:-1]) and len(parts) > 3


def test_phrases_of_nothing(spark):
    out = mine_phrases(spark.createDataFrame([], "lang string, text string"))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.collect() == []


def test_score_passes_64_bits(spark):
    """Counts of 10**13 give the exact score."""
    names = spark.createDataFrame([(1, "en", "x", "x", 9_000_000_000_000_001, 9_000_000_000_000_001, 9_000_000_000_000_001), (2, "en", "y", "y", 9_000_000_000_000_000, 9_000_000_000_000_000, 9_000_000_000_000_000)], "id long, lang string, phrase string, end string, a long, first long, last long")
    counted = spark.createDataFrame([(1, 2, 8_999_999_999_999_999, 7)], "left long, right long, a long, id long")
    best = collocations._grams(counted, names, 2, 2_000_000).first().best
    assert best.score == 2_000_000 * 8_999_999_999_999_999 // 18_000_000_000_000_001


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["op12_line_dedup", "op13_pair_naming"])
def test_queries_against_sql(spark, name):
    import duckdb

    from phrasepivot.llm.queries import ORACLE_SQL, QUERIES

    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(got.columns)
    c = duckdb.connect()
    c.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, c.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_whitening_query(spark):
    from phrasepivot.llm.queries import op11_svd_whitening

    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, y, values, axes = whitened_by_hand([r.embedding for r in table])
    found = whitening_rows(op11_svd_whitening(spark, folder))
    for i, r in enumerate(table):
        for c in range(8):
            got = found[r.vec_id][c + 1]
            assert got.deviation == deviation[i] and abs(abs(got.whitened) - abs(y[i] @ axes[:, c]) / np.sqrt(values[c])) < 1e-8
