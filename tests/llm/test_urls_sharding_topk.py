"""Operators 2, 5 and 8, and connected components."""

import zlib

import duckdb
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasepivot.llm.components import connected_components
from phrasepivot.llm.hilbert import hilbert_index, hilbert_shards
from phrasepivot.llm.queries import URL_RULES, op2_hilbert_shards
from phrasepivot.llm.sql import URLS
from phrasepivot.llm.topk import SortedLists, top_k
from phrasepivot.llm.url_filters import filter_urls

PAGES = [
    (1, "http://A.example.org/en/1x?u#f", "<link rel='canonical' href='http://z.net/q'>"),
    (2, "http://z.net/q#abc", None),
    (3, None, "<html>"),
    (4, "nohost", ""),
    (5, "https://x.com/de/1", '<META http-equiv=refresh content="0; url=http://y.net/1">'),
    (6, "http://y.net/1", None),
    (7, "http://q.org", "x"),
    (8, "http://w.net/1", "<link href='/2' rel=canonical>"),
    (9, "http://k.net/1", '<link rel="canonical" href="http://w.example.org/es/"><link rel="canonical" href="http://b.com/fr/z">'),
    (10, "http://k.net/1", "again"),
    (None, "http://example.org/en/2", None),
]
VERDICTS = {1: ("example.org/en/1", "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("com/de/", "block"), 6: (None, "block"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), None: ("org/", "allow")}


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, host string")


@pytest.mark.parametrize("more", [[], [("block", f"h{i}.zz", "/") for i in range(100)]])
def test_urls(pages, more):
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(pages, URL_RULES + more).collect()}
    assert got == VERDICTS


def test_urls_against_sql(pages, spark):
    c = duckdb.connect()
    links = ["de/start.html", "../de/x", "../../../de/./y", "?id=2", "./", "..", "/p/../de/?u=http://z.net/", "x?u=http://z.net/#f", "#top", "mailto:a@b.c", "//m.com/de/2", "http://n.com/fr/", "de/.", "/de/a/.."]
    more = [(100 + 3 * i, f"http://s{i}.com/a/b/index.html?k", f"<link rel=canonical href='{to}'>", "clash") for i, to in enumerate(links)]
    more += [(101 + 3 * i, f"http://s{i}.com", f"<meta http-equiv=refresh content='0; url={to}'>", "clash") for i, to in enumerate(links)]
    more += [(102 + 3 * i, f"http://s{i}.com/{p}", None, "clash") for i in range(len(links)) for p in ("de/start.html", "a/b/", "x")]
    pages = pages.union(spark.createDataFrame(more, pages.schema))
    c.register("pages_frame", pages.drop("host").toPandas())
    c.execute("create table pages as select page_id::bigint as page_id, url, html from pages_frame")
    want = sorted(map(repr, c.execute(f"select page_id, host, path, rule, verdict from ({URLS})").fetchall()))
    assert sorted(repr(tuple(r)) for r in filter_urls(pages, URL_RULES).collect()) == want


def test_redirect_table_and_empty(spark, pages):
    links = spark.createDataFrame([("http://q.org", "http://m.com/de/x"), (None, "http://a.b"), ("http://q.org", "http://q.org")], "src string, dst string")
    got = {r.page_id: r.verdict for r in filter_urls(pages, URL_RULES, redirects=links).collect()}
    assert got[7] == "block"
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2100)] + [(5000, 5000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(edges + edges[:50] + [(None, 3)], "a long, b long")
    rows = connected_components(df, "a", "b").collect()
    assert dict(map(tuple, rows)) == want and len(rows) == len(want)
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_hilbert_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = hilbert_index(grid, bits)
        order = np.argsort(index)
        assert sorted(index) == list(range(len(grid)))
        assert np.abs(np.diff(grid[order], axis=0)).sum(axis=1).max() == 1


def test_shards(spark, tmp_path):
    rows = [(i, "x" * (i % 50) if i % 7 else None, None if i % 11 == 0 else "en", "src0" if i % 3 else f"src{i % 20}") for i in range(203)] + [(1, "x", "en", "src0")] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op2_hilbert_shards(spark, str(tmp_path)).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 205 and set(sizes.index) == set(range(40)) and sizes.max() - sizes.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    ordered = got.sort_values(["shard", "slot"])
    assert (np.diff(ordered.curve) >= 0).all() and got.grown_shard.isna().all() and set(got.law) == {"rows"}
    text = {r[0]: (r[1] or "").encode() for r in rows[:203]}
    assert all(r.size_ == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got.rename(columns={"size": "size_"}).itertuples())


def test_shards_of_clashing_columns(spark):
    df = spark.createDataFrame([(i, i % 3, "a", i, None) for i in range(30)], "size long, slot int, _part string, curve long, v string")
    got = hilbert_shards(df, ["size", "v"], ["size"], 4)
    assert got.count() == 30 and got.groupBy("shard", "slot").count().where("count > 1").isEmpty()


def test_shards_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, lang string, n long, shard string")
    assert hilbert_shards(df, ["lang", "n"], ["id"], 4).count() == 0


def by_hand(rows, cells, shards):
    """(id, shard, slot) from each row's cells: sorted by curve, then the tie's order, cut into runs."""
    index = hilbert_index(np.array(cells), 8).tolist()
    order = sorted(range(len(rows)), key=lambda i: (index[i], rows[i][1], rows[i][0]))
    out, n = {}, len(rows)
    for r, i in enumerate(order):
        shard = (shards * (r + 1) - 1) // n
        out[rows[i][0]] = shard, r - shard * n // shards, index[i]
    return out


def test_shards_as_sorted_by_hand(spark):
    """Over 256 different values; the order of all rows is recomputed."""
    rng = random.Random(8)
    names = sorted({"https://host/" + "".join(rng.choice("abcd") for _ in range(6)) for _ in range(700)})
    rows = [(i, rng.choice(names) if rng.random() < 0.6 else names[5], rng.choice(["en", "de", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, site string, lang string")
    got = {r.id: (r.shard, r.slot, r.curve) for r in hilbert_shards(df, ["site", "lang"], ["id"], 13).collect()}
    tie = dict(tuple(r) for r in df.select("id", F.xxhash64("id")).collect())
    counts, before, starts = Counter(r[1] for r in rows), 0, {}
    for name in sorted(counts):
        starts.setdefault(before * 256 // len(rows), name)
        before += counts[name]
    bounds = sorted(starts.values())
    cell = lambda site: sum(b <= site for b in bounds) - 1
    assert len(counts) > 256
    assert got == by_hand([(i, tie[i]) for i, _, _ in rows], [(cell(s), {None: 0, "de": 0, "en": 128}[x]) for _, s, x in rows], 13)


def test_shards_are_pruned(spark):
    """A range of one dimension meets few shards, and so does a range of the other."""
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 10**6), rng.randint(0, 10**6)) for i in range(8000)]
    df = spark.createDataFrame(rows, "id long, a long, b long")
    got = hilbert_shards(df, ["a", "b"], ["id"], 64)
    ranges = got.groupBy("shard").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    for x in "ab":
        assert ranges.where(f"{x}0 <= 310000 and {x}1 >= 300000").count() <= 20
    assert ranges.where("a0 <= 310000 and a1 >= 300000 and b0 <= 710000 and b1 >= 700000").count() <= 4


NOTHING = np.zeros(0, np.int64), np.zeros(0, np.int64)


def test_sorted_lists_give_the_best_rows():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(500, 16))).astype(np.int64)
    x[100:160] = x[7]
    ids = rng.permutation(500) // 2  # repeated ids
    before = np.array([9000, 9001]), np.array([10**7, -(10**7)])
    for best in (NOTHING, before):
        lists = SortedLists(x, ids)
        for q in [*x[:40], np.zeros(16, np.int64)]:
            got, score = lists.top(q, 5, 7, best)
            all_ids, exact = np.concatenate([best[0], ids[ids != 7]]), np.concatenate([best[1], (x @ q)[ids != 7]])
            order = np.lexsort((all_ids, -exact))[:5]
            assert (all_ids[order] == got).all() and (exact[order] == score).all()


@pytest.mark.parametrize("n", [500, 2000, 4096])
def test_reading_stops(n):
    """Bounds decide: only the k rows that are left are resolved.  Of random directions nearly all entries are read, as
    their bounds are wide; with a bar from earlier blocks, and where rows have few large components, under two thirds."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    sparse = np.where(rng.random((n, 64)) < 0.04, rng.integers(20, 200, (n, 64)), 0)
    sparse = sparse * (sparse.sum(axis=1, keepdims=True) > 0) + (np.arange(64) == 0)
    read = {}
    for name, rows, best in (("alone", x, NOTHING), ("bar", x, (np.arange(5) + 9000, np.full(5, 60000))), ("sparse", sparse, NOTHING)):
        lists, resolved = SortedLists(rows, np.arange(n)), 0
        for i in range(20):
            got, score = lists.top(rows[i], 5, i, best)
            exact = np.sort(np.concatenate([best[1], np.delete(rows @ rows[i], i)]))[::-1][:5]
            assert (score == exact).all()
        read[name] = lists.entries / (20 * rows.size), lists.resolved / 20
    assert all(r <= 5 or name == "sparse" for name, (_, r) in read.items())
    assert read["alone"][0] <= 1 and read["bar"][0] < 0.67 and read["sparse"][0] < 0.67 and read["sparse"][1] < n / 10


@pytest.mark.parametrize("grown", [1, 10**6])
def test_queries_share_what_is_read(grown, monkeypatch):
    """Many queries, blocks and copies, with sums that single precision holds and that it doesn't; each query has its k best."""
    import phrasepivot.llm.topk as topk

    monkeypatch.setattr(topk, "LOOK", 2000)
    monkeypatch.setattr(topk, "PAIRS", 50)
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.normal(size=(900, 16))).astype(np.int64) * grown
    x[300:420], x[500:540], x[700:800] = x[7], 0, x[7]
    ids = rng.permutation(900) // 2  # repeated ids
    queries, own, best = x[::9], ids[::9], (np.zeros(0, np.int64),) * 3
    for a, z in ((0, 3), (3, 64), (64, 500), (500, 900)):
        best = SortedLists(x[a:z], ids[a:z]).search(queries, own, 5, best)
    for i, q in enumerate(queries):
        order = np.lexsort((ids, -(x @ q)))
        order = order[ids[order] != own[i]][:5]
        assert best[1][best[0] == i].tolist() == ids[order].tolist() and best[2][best[0] == i].tolist() == (x @ q)[order].tolist()


def test_search_costs_few_products():
    """A task's search of a block takes a few times what plain products of its rows and queries take (before queries shared
    what is read, over twenty times)."""
    import time
    from types import SimpleNamespace

    import pyarrow as pa

    from phrasepivot.llm.topk import _searching

    rng = np.random.default_rng(3)
    x = rng.normal(size=(4096, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(list(x))], ["id", "x"])
    search = _searching(SimpleNamespace(value=(np.arange(400), x[:400])), 5, 64)

    def least(work) -> float:
        took = []
        for _ in range(3):
            t = time.perf_counter()
            work()
            took.append(time.perf_counter() - t)
        return min(took)

    assert least(lambda: list(search([rows]))) < 10 * least(lambda: [x @ q for q in x[:400]])


def test_top_k(spark):
    import phrasepivot.llm.topk as topk

    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(120)]
    rows += [(200, None), (250, [float("nan")] + [0.0] * 5), (300, [None] * 6), (310, [3e7] + [0.0] * 5), (350, [float("inf")] * 6), (400, []), (60, rows[60][1]), (1000, rows[3][1]), (1001, rows[3][1]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<float>, score int, rank int")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(topk, "BLOCK", 32)
        m.setattr(topk, "CHUNK_BYTES", 100)
        got = top_k(df, df.where("vec_id % 50 = 0"), 5).collect()
    live = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) if v else np.zeros(6, np.int64)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for q, a in {i: v for i, v in live if i % 50 == 0}.items():
        ranked = sorted(((-int(a @ b), i) for i, b in live if i != q))[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert top_k(df.limit(0), df, 5).count() == 0 and top_k(df, df.limit(0), 5).count() == 0
    assert top_k(df.where("vec_id in (0, 1, 2)"), df.where("vec_id = 0"), 5).agg(F.max("rank")).first()[0] == 2


def test_relative_links(spark):
    from phrasepivot.llm.url_filters import alias_edges

    cases = {"de/start.html": "/a/b/de/start.html", "../fr/x": "/a/fr/x", "../../../x/./y": "/x/y", "?id=2": "/a/b/index.html?id=2", "./": "/a/b/", "..": "/a/", "/p/../q?u=http://z.net/": "/q?u=http://z.net/", "x?u=http://z.net/#f": "/a/b/x?u=http://z.net/", "#top": None, "mailto:a@b.c": None}
    pages = spark.createDataFrame([(f"http://S{i}.com/a/b/index.html?k#f", f"<link rel=canonical href='{to}'>") for i, to in enumerate(cases)] + [("http://t.com", "<meta http-equiv=refresh content='0; url=de/1'>")], "url string, html string")
    got = {(r.src, r.dst) for r in alias_edges(pages).collect()}
    want = {(f"http://s{i}.com/a/b/index.html?k", f"http://s{i}.com{path}") for i, path in enumerate(cases.values()) if path}
    assert got == want | {("http://t.com", "http://t.com/de/1")}
    site = spark.createDataFrame([(1, "http://site.com/index.html", "<link rel=canonical href=de/start.html>")], "page_id long, url string, html string")
    assert filter_urls(site, [("block", "com", "/de/")]).first().verdict == "block"
