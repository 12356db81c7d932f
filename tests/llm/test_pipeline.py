"""The pipeline against a brute-force version, on a table with planted cases."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from phrasepivot.llm.decontaminate import words_of
from phrasepivot.llm.queries import tokenizer_file
from phrasepivot.llm.simhash import shingle_hashes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(rng.randint(60, 200))) for i in range(60)]
    rows += [(60, None), (61, "12 ,"), (62, ""), (63, rows[3][1]), (3, rows[3][1])]
    near = rows[4][1].split()
    near[50] = "changed"
    passage, item = say(60), say(40)
    rows += [(64, " ".join(near)), (65, say(90) + " " + passage + " " + say(80)), (66, say(70) + " " + passage + " " + say(90)), (67, say(20) + " " + item + " " + say(30)), (68, "Kurz."), (69, say(30_000)), (70, "q" * 90_000 + " " + say(40)), (71, "ab cd " * 10_000)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(i, t, rng.choice(["en", "de"]), "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, item


def by_hand(rows, item):
    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    sets = [set(shingle_hashes(t.encode(), 5).tolist()) for _, t in kept]
    out = []
    for k, (i, t) in enumerate(kept):
        if not any(len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j]) and (kept[j][0] < i or (kept[j][0] == i and j < k)) for j in range(len(kept)) if j != k):
            out.append((i, t))
    n, raw = corpus_pipeline.PASSAGE, [t.encode() for _, t in out]
    count = {}
    for t in raw:
        for s in range(len(t) - n + 1):
            count[t[s : s + n]] = count.get(t[s : s + n], 0) + 1
    cut = []
    for (i, _), t in zip(out, raw):
        hit = bytearray(len(t))
        for s in range(len(t) - n + 1):
            if count[t[s : s + n]] > 1:
                hit[s : s + n] = b"\1" * n
        left = bytes(x for x, y in zip(t, hit) if not y).decode(errors="ignore")
        if left:
            cut.append((i, left))
    w = words_of(item.encode())
    windows = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
    clean = []
    for i, t in cut:
        d = words_of(t.encode())
        hit = {p for k in range(len(d) - 12) if tuple(d[k : k + 13]) in windows for p in range(k, k + 13)}
        if not hit or 20 * len(hit) < len(d):
            clean.append((i, t))
    library = Tokenizer.from_file(tokenizer_file(corpus_pipeline.WORD_FILE))
    return {i: " ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for i, t in clean}


def test_pipeline(spark, folder):
    path, rows, item = folder
    got = corpus_pipeline.run(spark, path).collect()
    want = by_hand(rows, item)
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want)
    assert not {60, 61, 62, 63, 64, 67} & want.keys() and {65, 66, 68, 69, 70} <= want.keys()


def test_stages_keep_the_columns(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, path)
        assert out.dtypes == docs.dtypes
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), path).count() == 0


def test_language_stage(spark):
    rng = random.Random(4)
    of = {"aa": ["an", "th", "ing"], "bb": ["ö", "ung", "sch"], "cc": ["eau", "qu", "è"]}
    say = lambda lang, n: " ".join("".join(rng.choice(of[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(lang := rng.choice(list(of)), 60), lang) for i in range(240)]
    mixed = " ".join(say(lang, 200) for lang in of)
    rows += [(900, mixed, None), (901, "thing", None), (902, "12 !", None), (903, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "").collect()} == {*range(240), 901}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, unlabelled, "").collect()} == {*range(240), 900, 901}
