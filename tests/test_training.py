"""Phrase extraction and training against brute force and by hand."""

import gzip
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from phrasepivot.operators import lexicon
from phrasepivot.operators.extraction import extract_phrases
from phrasepivot.plans.training import aligned_sentences, phrase_table, read_sentences, train
from phrasepivot.sources.phrase_table import read_lexical, read_phrase_table

SENTENCE = "src string, tgt string, align array<struct<s:int,t:int>>"


def pairs_by_hand(src, tgt, align, length):
    s, t = src.split(" "), tgt.split(" ")
    align = {(i, j) for i, j in align if i < len(s) and j < len(t)}
    for i in range(len(s)):
        for j in range(i, min(len(s), i + length)):
            for a in range(len(t)):
                for b in range(a, min(len(t), a + length)):
                    inside = [(x, y) for x, y in align if i <= x <= j and a <= y <= b]
                    if inside and not any((i <= x <= j) != (a <= y <= b) for x, y in align):
                        yield " ".join(s[i : j + 1]), " ".join(t[a : b + 1]), tuple(sorted((x - i, y - a) for x, y in inside))


def random_sentences(n, seed, longest=9):
    rng = random.Random(seed)
    for _ in range(n):
        s, t = (" ".join(rng.choice("abc") for _ in range(rng.randint(1, longest))) for _ in range(2))
        points = [(rng.randrange(len(s.split()) + 1), rng.randrange(len(t.split()))) for _ in range(rng.randrange(8))]
        yield s, t, points


def frame(spark, sentences):
    return spark.createDataFrame([(s, t, [{"s": i, "t": j} for i, j in p]) for s, t, p in sentences], SENTENCE)


@pytest.mark.parametrize("length", [1, 3, 7])
def test_extraction(spark, length):
    sentences = list(random_sentences(120, length))
    want = Counter(x for s in sentences for x in pairs_by_hand(*s, length))
    got = {(r.src, r.tgt, tuple((p.s, p.t) for p in r.align)): r.n for r in extract_phrases(frame(spark, sentences), length).collect()}
    assert got == want


@pytest.mark.parametrize("words", [1, 2, 3, 5])
def test_extraction_of_fewer_words_than_a_phrase_may_have(spark, words):
    """A batch may end in a block of one short sentence."""
    sentence = ("a b c d e f g h", " ".join("xyzuv"[:words]), [(i, i) for i in range(words)])
    got = {(r.src, r.tgt, tuple((p.s, p.t) for p in r.align)): r.n for r in extract_phrases(frame(spark, [sentence]).coalesce(1), 7).collect()}
    assert got == Counter(pairs_by_hand(*sentence, 7))


def test_extraction_of_a_long_sentence(spark):
    """Work grows with the words and points, not with their square in phrases."""
    n = 800
    line = " ".join(f"w{i}" for i in range(n))
    got = extract_phrases(frame(spark, [(line, line.upper(), [(i, i) for i in range(n)])]), 3)
    assert got.count() == n + n - 1 + n - 2


def table_by_hand(sentences, length):
    seen, words = defaultdict(Counter), Counter()
    for src, tgt, align in sentences:
        s, t = src.split(" "), tgt.split(" ")
        points = [(i, j) for i, j in align if i < len(s) and j < len(t)]
        words.update((s[i], t[j]) for i, j in points)
        words.update((s[i], "NULL") for i in range(len(s)) if i not in {p[0] for p in align})
        words.update(("NULL", t[j]) for j in range(len(t)) if j not in {p[1] for p in align})
        for a, b, p in pairs_by_hand(src, tgt, align, length):
            seen[a, b][p] += 1
    by_s, by_t, c_s, c_t = Counter(), Counter(), Counter(), Counter()
    for (a, b), c in words.items():
        by_s[a] += c
        by_t[b] += c
    for (a, b), p in seen.items():
        c_s[a] += sum(p.values())
        c_t[b] += sum(p.values())
    out = {}
    for (a, b), p in seen.items():
        align = min(p, key=lambda x: (-p[x], x))
        s, t, n = a.split(" "), b.split(" "), sum(p.values())
        st = ts = 1.0
        for i, w in enumerate(s):
            met = [t[y] for x, y in align if x == i] or ["NULL"]
            st *= sum(words[w, v] / by_t[v] for v in met) / len(met)
        for j, v in enumerate(t):
            met = [s[x] for x, y in align if y == j] or ["NULL"]
            ts *= sum(words[w, v] / by_s[w] for w in met) / len(met)
        out[a, b] = (n / c_t[b], st, n / c_s[a], ts, align, c_t[b], c_s[a], n)
    return out


def test_training(spark):
    """Scores of phrases as worked out by hand; points beyond the words are left out of the texts first."""
    sentences = [(s, t, sorted({(i, j) for i, j in p if i < len(s.split())})) for s, t, p in random_sentences(80, 4, 6)]
    want = table_by_hand(sentences, 7)
    got = {(r.src, r.tgt): r for r in phrase_table(frame(spark, sentences)).collect()}
    assert got.keys() == want.keys() and len(want) > 200
    for k, (phi_st, lex_st, phi_ts, lex_ts, align, c_t, c_s, c_st) in want.items():
        r = got[k]
        assert (tuple((p.s, p.t) for p in r.align), r.c_t, r.c_s, r.c_st) == (align, c_t, c_s, c_st)
        assert (r.phi_st, r.lex_st, r.phi_ts, r.lex_ts) == pytest.approx((phi_st, lex_st, phi_ts, lex_ts), rel=1e-12)


def test_training_of_nothing(spark):
    assert phrase_table(frame(spark, [])).collect() == []
    assert phrase_table(frame(spark, [("a b", "c", [])])).collect() == []


def write(path, lines):
    path.write_bytes(gzip.compress("".join(f"{x}\n" for x in lines).encode()))


def test_train_from_files(spark, tmp_path):
    sentences = [("das haus", "the house", "0-0 1-1"), ("das  buch ", "the book", "0-0 1-1"), ("", "nothing", ""), ("ein haus", "a house", "0-0 1-1"), ("ja", "yes sir", "0-0")]
    write(tmp_path / "C.deen.ali.gz", [f"{a}\t{i}" for i, (_, _, a) in enumerate(sentences)])
    write(tmp_path / "C.de.tok.gz", [s for s, _, _ in sentences])
    write(tmp_path / "C.en.tok.gz", [t for _, t, _ in sentences])
    name, read = read_sentences(spark, f"{tmp_path}/C.deen.ali.gz")
    assert (name.source, name.target) == ("de", "en") and sorted((r.src, r.tgt) for r in read.collect()) == sorted((" ".join(s.split()), t) for s, t, _ in sentences if s)
    model = train(spark, f"{tmp_path}/C.deen.ali.gz", f"{tmp_path}/out")
    got = {(r.src, r.tgt): r for r in read_phrase_table(spark, model).collect()}
    assert got["das haus", "the house"].c_st == 1 and got["das", "the"].c_st == 2 and got["haus", "house"].phi_st == 1 and ("ja", "yes sir") in got and ("ja", "yes") in got
    lexicon = {(r.w1, r.w2): r.p for r in read_lexical(spark, f"{model}/model/lex.e2f").collect()}
    assert lexicon["das", "the"] == 1 and lexicon["NULL", "sir"] == 1
    again = {(r.src, r.tgt) for r in read_phrase_table(spark, train(spark, f"{tmp_path}/C.deen.ali.gz", f"{tmp_path}/parts", 1, False)).collect()}
    assert again == {k for k in got if all(" " not in x for x in k)}


def test_lines_of_unequal_number(spark):
    of = lambda *x: spark.createDataFrame(list(enumerate(x, 1)), "n long, value string")
    with pytest.raises(Exception, match="no line of tgt: 2"):
        aligned_sentences(of("0-0", "0-0"), of("a", "b"), of("c")).collect()
    assert aligned_sentences(of("0-0\tx"), of("\ta "), of("c")).select("src", F.size("align").alias("n")).first() == ("a", 1)


def test_lexical_weights_by_a_large_and_a_small_lexicon(spark, monkeypatch):
    sentences = frame(spark, list(random_sentences(60, 5)))
    shown = lambda df: sorted((r.src, r.tgt, round(r.lex_st, 12), round(r.lex_ts, 12)) for r in df.collect())
    small = shown(phrase_table(sentences, 3))
    monkeypatch.setattr(lexicon, "SMALL_LEXICON", 0)
    assert small == shown(phrase_table(sentences, 3)) and small


def test_phrases_are_dealt_once(spark):
    """By both phrases, for counting them with and without their alignment."""
    pairs = extract_phrases(frame(spark, list(random_sentences(20, 1)))).groupBy("src", "tgt").agg(F.min("align"), F.sum("n"))
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
