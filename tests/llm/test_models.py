"""Operators 1, 3, 4 and 9: against the library's tokenizer, by counting, and on held-out rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import phrasepivot.llm.lm_scoring as lm_scoring
from phrasepivot.llm.attention_lm import CLASSES, SLOTS, WINDOW, Frame, Model, Speller, first_parameters, slots_by_count, windows_of
from phrasepivot.llm.bpe_automaton import Automaton, WordBpe
from phrasepivot.llm.common import split_column, split_of
from phrasepivot.llm.language_id import UNKNOWN, WINDOW as BYTES, ByteConv, identify, train_language_id
from phrasepivot.llm.tokenize_docs import decode_documents, encode_documents, length_histogram, quantiles_of, rank_encoder, token_lengths, totals_at

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", "<|startoftext|>A b<|endoftext|>c", "ΑΣ Σας İI ŉ ſ Straße é é ﬁ \x1c\x1d a\x85b\xa0c ²³ ¼x it's we'll 'S", "日本語 テスト 🎉🎉 ​ áb", "a" * 1750, "!!!!???...---===~~~", "<|endoftext", "\x00\x01\x7f abc", "'ll'll's'T"]

SYLLABLES = {"aa": ["an", "th", "ing", "er", "ou", "sh"], "bb": ["ö", "ung", "sch", "ein", "ver", "ß"], "cc": ["eau", "qu", "è", "oi", "ment", "ç"]}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, lang := rng.choice("abc") * 2, rng.randint(4, 120)), lang) for i in range(240)]
    rows += [(300, None, "aa"), (301, "", "bb"), (302, "123 !!", "cc"), (303, prose(rng, "bb", 30), None), (None, prose(rng, "aa", 9000), "aa"), rows[5], rows[5]]
    return spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double").persist()


def test_split_column_agrees(spark):
    got = spark.createDataFrame([(0,), (7,), (123456,), (None,)], "d long").select("d", split_column(F.col("d"), 7)).collect()
    assert all(split_of(d, 7) == x for d, x in got)


# ---- language ------------------------------------------------------------------------------


def test_language(docs):
    held_out = split_column(F.col("doc_id"), 3) == 1
    model = train_language_id(docs.where(~held_out))
    got = identify(docs, model, carry=["lang", "score"]).collect()
    assert identify(docs, model, carry=["lang"]).columns == ["doc_id", "lang_pred", "score", "lang"] and len(got) == docs.count()
    tested = [r for r in got if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.lang_pred == r.lang for r in tested]) > 0.95
    assert {r.lang_pred for r in got if r.doc_id in (300, 301, 302)} == {UNKNOWN}
    assert all(0 <= r.score <= 1 for r in got)
    assert train_language_id(docs.where("lang is null")) is None
    assert {r.lang_pred for r in identify(docs.limit(3), None).collect()} == {UNKNOWN}
    assert identify(docs.limit(0), model).count() == 0


def test_folded_tables_equal_the_network():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (6, BYTES)).astype(np.uint8)
    model = ByteConv.train(rng.integers(97, 120, (40, BYTES)).astype(np.uint8), ["a", "b"] * 20, steps=5)
    e, feats = model.e[x], []
    for w, (k, b) in zip((2, 3, 4), model.conv):
        cols = np.concatenate([e[:, j : BYTES - w + 1 + j] for j in range(w)], axis=2)
        feats.append(np.maximum((cols @ k + b).max(axis=1), 0))
    s = np.exp(np.concatenate(feats, axis=1) @ model.out[0] + model.out[1])
    assert np.allclose(model.probabilities(x), s / s.sum(axis=1, keepdims=True), atol=1e-4)


def judged_by_hand(model, text):
    """Every window of the text through the network's own layers, a position and a filter at a time."""
    raw, total = (text or "").encode(), np.zeros(len(model.languages))
    if not any(c.isalpha() for c in text or ""):
        return UNKNOWN, 0.0
    for a in range(0, len(raw), BYTES):
        part = raw[a : a + BYTES]
        e, feats = model.e[list(part) + [0] * (BYTES - len(part))], []
        for w, (k, b) in zip((2, 3, 4), model.conv):
            z = [np.concatenate(e[i : i + w]) @ k + b for i in range(BYTES - w + 1)]
            feats.append(np.maximum(np.max(z, axis=0), 0))
        s = np.concatenate(feats) @ model.out[0] + model.out[1]
        s = np.exp(s - s.max())
        total += len(part) * s / s.sum()
    return model.languages[int(total.argmax())], float(total.max() / len(raw))


def test_language_by_hand(docs):
    model = train_language_id(docs)
    rows = docs.where("doc_id is null or doc_id % 4 = 0").collect()
    rows = [r for r in rows if len(r.text or "") < 20_000]
    some = docs.sparkSession.createDataFrame([(i, r.text) for i, r in enumerate(rows)] + [(-1, "é" * 128 + "x"), (-2, "a")], "doc_id long, text string")
    got = {r.doc_id: r for r in identify(some, model).collect()}
    for r in some.collect():
        lang, score = judged_by_hand(model, r.text)
        assert abs(got[r.doc_id].score - score) < 1e-4 and (got[r.doc_id].lang_pred == lang or abs(score - 1 / len(model.languages)) < 1e-3)
    assert len(got) == len(rows) + 2


# ---- encoding ------------------------------------------------------------------------------


def merges_by_hand(word, rank):
    parts = list(word)
    while True:
        best = min(((rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
        if best[0] == 1 << 30:
            return parts
        pair = parts[best[1] : best[1] + 2]
        out, i = [], 0
        while i < len(parts):
            if parts[i : i + 2] == pair:
                out.append("".join(pair))
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_automaton_on_random_merges():
    rng = random.Random(1)
    for _ in range(60):
        tokens, merges = ["a", "b", "c"], []
        for _ in range(rng.randint(1, 14)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens:
                merges.append((u, v))
                tokens.append(u + v)
        ids = {t: i for i, t in enumerate(tokens)}
        automaton, rank = Automaton(ids, merges), {m: i for i, m in enumerate(merges)}
        for _ in range(80):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 18)))
            assert [tokens[i] for i in automaton.encode(word)] == merges_by_hand(word, rank), (merges, word)


def test_table_is_that_of_the_gadgets():
    """Every arc of the compiled table against gadgets that are put in one by one."""
    rng = random.Random(3)
    for _ in range(40):
        tokens, merges = ["a", "b", "c"], []
        for _ in range(rng.randint(1, 25)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens:
                merges.append((u, v))
                tokens.append(u + v)
        arcs = {x: {"a", "b", "c"} for x in "abc"}
        for u, v in merges:
            arcs[u + v] = set(arcs[v])
            arcs[u].discard(v)
            for behind in arcs.values():
                if u in behind:
                    behind.add(u + v)
        ids = {t: i for i, t in enumerate(tokens)}
        automaton = Automaton(ids, merges)
        assert all(automaton.arc(ids[x], ids[y]) == (y in arcs[x]) for x in tokens for y in tokens), merges


def test_long_words_take_linear_time():
    import time

    bpe, library = WordBpe(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    took = []
    for n in (20_000, 160_000):
        word = "".join(random.Random(n).choice("theandiqx") for _ in range(n))
        begun = time.process_time()
        got = bpe.encode(word)[0]
        took.append(time.process_time() - begun)
        assert n > 20_000 or got == " ".join(map(str, library.encode(word, add_special_tokens=False).ids))
    assert took[1] < 25 * took[0]


def test_words_as_the_library(monkeypatch):
    import phrasepivot.llm.bpe_automaton as bpe_automaton

    monkeypatch.setattr(bpe_automaton, "WORDS", 50)
    bpe, library, rng = WordBpe(WORD_FILE), Tokenizer.from_file(WORD_FILE), random.Random(2)
    texts = ODD + ["".join(rng.choice("aabbtheinnñéß!?'.0123 \n<|>ZΩжи中") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), t
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_encode_documents(spark, docs):
    got = encode_documents(docs, WORD_FILE, carry=["lang"]).collect()
    library = Tokenizer.from_file(WORD_FILE)
    texts = [r.text or "" for r in docs.collect()]
    assert [r.n_tokens for r in got] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    back = decode_documents(encode_documents(docs, WORD_FILE), WORD_FILE).collect()
    assert [r.decoded for r in back] == [r.decoded for r in got]
    digests = encode_documents(docs, WORD_FILE, digests_only=True).collect()
    assert [r.ids_sha256 for r in digests] == [hashlib.sha256(r.ids.encode()).hexdigest() for r in got]
    assert encode_documents(docs.limit(0), WORD_FILE).count() == 0


# ---- lengths -------------------------------------------------------------------------------


def test_length_histogram(spark, docs):
    lengths = token_lengths(docs, RANKS, public_tokenizers.PATTERN)
    encoder = rank_encoder(RANKS, public_tokenizers.PATTERN)
    want = sorted(len(encoder.encode_ordinary(r.text)) if r.text else 0 for r in docs.collect())
    assert sorted(r.n_tokens for r in lengths.collect()) == want
    histogram = length_histogram(lengths).persist()
    assert {r.n_tokens: r.n_docs for r in histogram.collect()} == Counter(want)
    for r in histogram.collect():
        assert (r.docs_from, r.tokens_from) == (sum(x >= r.n_tokens for x in want), sum(x for x in want if x >= r.n_tokens))
        assert (r.docs_total, r.tokens_total, r.tokens_within) == (len(want), sum(want), sum(min(x, r.n_tokens) for x in want))
    limits = [0, 1, 57, 1023, 1024, 5000, 10**7]
    assert sorted(map(tuple, totals_at(histogram, limits).collect())) == [(c, sum(x > c for x in want), sum(min(x, c) for x in want)) for c in limits]
    for share, n in quantiles_of(histogram, [0.1, 0.5, 0.99, 1.0]).collect():
        assert n == want[math.ceil(share * len(want)) - 1]
    assert length_histogram(lengths.limit(0)).count() == 0


# ---- language model ----------------------------------------------------------------------------


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, 2000)
    model = Model(Frame(slots_by_count(counts), rng.integers(0, 5, (SLOTS, SLOTS)), counts.astype(float)), first_parameters())
    model.flat += rng.normal(0, 0.1, len(model.flat)).astype(np.float32)
    return model


def test_windows_score_each_position_once():
    sizes = np.array([1, WINDOW - 1, WINDOW, WINDOW + 1, 100, 7, 500])
    text, place, first, held = windows_of(sizes)
    seen = Counter()
    for t, p, f, h in zip(text, place, first, held):
        seen.update((t, int(p) + j) for j in range(f, h))
    begin = np.cumsum(sizes) - sizes
    assert seen == Counter((t, int(b) + j) for t, (b, n) in enumerate(zip(begin, sizes)) for j in range(n))


def test_probabilities_sum_to_one():
    model = small_model()
    ids = np.random.default_rng(1).integers(0, 1999, 20)
    assert sum(math.exp(model.log_probabilities(np.append(ids, [last]), np.array([21]))[-1]) for last in range(2000)) == pytest.approx(1, abs=1e-3)


def test_spellings_sum_to_one():
    """What may follow a first id: every id inside a word, and the word's end."""
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, 1500).astype(float)
    speller = Speller(slots_by_count(counts), rng.integers(0, 5, (SLOTS, SLOTS + 1)), counts)
    for first in (3, 700, 1499):
        ends = math.exp(speller.rest(np.array([first]), np.array([0]))[0])
        step = [math.exp(speller.log[speller.slot_of[first], speller.slot_of[i]] + speller.in_slot[i]) for i in range(1500)]
        assert ends + sum(step) == pytest.approx(1, abs=1e-3)
        two = speller.rest(np.array([first, 9, first]), np.array([0, 2]))
        assert two[1] == pytest.approx(math.log(ends)) and two[0] == pytest.approx(math.log(step[9]) + speller.log[speller.slot_of[9], SLOTS], rel=1e-5)


def test_attention_is_causal_and_gradients_hold():
    model = small_model()
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, SLOTS, (3, WINDOW)).astype(np.int32), rng.integers(0, CLASSES, (3, WINDOW))
    z = model.class_scores(x)
    changed = x.copy()
    changed[:, 20:] = 5
    assert np.allclose(model.class_scores(changed)[:, :20], z[:, :20], atol=1e-5)
    on = np.ones((3, WINDOW), bool)

    def loss():
        z = Model(model.frame, model.flat).class_scores(x).astype(float)
        return -np.take_along_axis(z - np.log(np.exp(z).sum(axis=2, keepdims=True)), y[:, :, None], axis=2).mean()

    g, total = model.gradient(x, y, on)
    assert total / on.sum() == pytest.approx(loss(), rel=1e-4)
    for i in np.argsort(-np.abs(g))[::400][:12]:
        at, step = model.flat[i], 1e-2
        model.flat[i] = at + step
        up = loss()
        model.flat[i] = at - step
        down = loss()
        model.flat[i] = at
        assert g[i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-4)


def score_by_hand(rows, held_out, model, speller, encode):
    """score and attention_score of each text, word by word, from the trained model and exact counts."""
    count, heads, distinct = Counter(), Counter(), Counter()
    for i, words in rows:
        if not held_out(i):
            count.update(words)
    for w, n in count.items():
        heads[encode(w)[0]] += n
        distinct[encode(w)[0]] += 1
    out = []
    for _, words in rows:
        ids = [encode(w) for w in words]
        sequence = np.array([x[0] for x in ids] + [50_256])
        each = model.log_probabilities(sequence, np.array([len(sequence)]))
        score = alone = float(each[-1])
        for w, x, p in zip(words, ids, each):
            rest = speller.rest(np.array(x), np.array([0]))[0]
            left = (lm_scoring.DISCOUNT * distinct[x[0]] + 1) * math.exp(rest)
            score += p + math.log((max(count[w] - lm_scoring.DISCOUNT, 0) + left) / (heads[x[0]] + 1))
            alone += p + rest
        out.append((score / math.log(10), alone / math.log(10)))
    return out


@pytest.mark.parametrize("top", [100_000, 40, 1])
def test_scores(spark, docs, monkeypatch, top):
    """All columns against sums by hand, whichever words' counts are broadcast."""
    monkeypatch.setattr(lm_scoring, "TOP_WORDS", top)
    monkeypatch.setattr(lm_scoring, "COUNTED", 30)
    trained, train = [], lm_scoring.train_language_model
    monkeypatch.setattr(lm_scoring, "train_language_model", lambda *x: trained.append(train(*x)) or trained[-1])
    held_out = split_column(F.col("doc_id"), 7) == 2
    got = lm_scoring.score_documents(docs, held_out, RANKS, public_tokenizers.PATTERN, 50_257).collect()
    rows = [(r.doc_id, (r.text or "").encode().translate(lm_scoring.ASCII_LOWER).split()) for r in docs.collect()]
    count, ends = Counter(), 0
    for i, w in rows:
        if split_of(i, 7) != 2:
            count.update(w)
            ends += 1
    total, d = sum(count.values()) + ends, sum(count.values()) + ends + len(count) + 1 + 1
    want = sorted(((-1 if i is None else i), split_of(i, 7) == 2, len(w) + 1, sum(count[x] > 0 for x in w) + 1, total) for i, w in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    base = sorted(sum(math.log10((count[x] + 1) / d) for x in w) + math.log10((ends + 1) / d) for i, w in rows)
    assert np.allclose(sorted(r.base_score for r in got), base, rtol=1e-9)
    model, speller, losses = trained[0]
    encode = lambda w: lm_scoring._encode([w], RANKS, public_tokenizers.PATTERN)[0].tolist()
    by_hand = score_by_hand(rows, lambda i: split_of(i, 7) == 2, model, speller, encode)
    for place, name in enumerate(("score", "attention_score")):
        assert np.allclose(sorted(getattr(r, name) for r in got), sorted(x[place] for x in by_hand), rtol=1e-4, atol=1e-3)
    assert len(losses) == lm_scoring.ROUNDS
    assert lm_scoring.score_documents(docs.limit(0), held_out, RANKS, public_tokenizers.PATTERN, 50_257).count() == 0
    assert all(r.n_known == 0 and r.base_score == 0 for r in lm_scoring.score_documents(docs.limit(4), F.lit(True), RANKS, public_tokenizers.PATTERN, 50_257).collect())


def test_all_training_texts_count_and_train(spark, docs, monkeypatch):
    """With the production settings: ids and what follows what are of every training text, and each trains once."""
    frames, spellers, trained, run = [], [], [], lm_scoring._train_round
    monkeypatch.setattr(lm_scoring, "Frame", lambda *x: frames.append(x) or Frame(*x))
    monkeypatch.setattr(lm_scoring, "Speller", lambda *x: spellers.append(x) or Speller(*x))
    monkeypatch.setattr(lm_scoring, "_train_round", lambda encoded, *x: trained.extend((r.sizes, r.slots) for r in encoded.collect()) or run(encoded, *x))
    held_out = split_column(F.col("doc_id"), 7) == 2
    lm_scoring.score_documents(docs, held_out, RANKS, public_tokenizers.PATTERN, 50_257)
    encoder, heads, ids, follows, inside, sequences = rank_encoder(RANKS, public_tokenizers.PATTERN), Counter(), Counter(), Counter(), Counter(), []
    (slot, pairs, head_counts), (word_slot, word_pairs, in_counts) = frames[0], spellers[0]
    for r in docs.collect():
        if split_of(r.doc_id, 7) != 2:
            words = [encoder.encode_ordinary((b" " + w).decode()) for w in (r.text or "").encode().translate(lm_scoring.ASCII_LOWER).split()]
            own = [w[0] for w in words] + [50_256]
            heads.update(own)
            follows.update((slot[a], slot[b]) for a, b in zip([50_256, *own], own))
            for w in words:
                ids.update(w[1:])
                inside.update((word_slot[a], b) for a, b in zip(w, [*(word_slot[x] for x in w[1:]), SLOTS]))
            sequences.append(tuple(slot[own].tolist()))
    assert {i: n for i, n in enumerate(head_counts) if n} == heads
    assert {i: n for i, n in enumerate(in_counts) if n} == ids
    for counts, got in ((follows, pairs), (inside, word_pairs)):
        want = np.zeros(got.shape)
        for (a, b), n in counts.items():
            want[a, b] = n
        assert (want == got).all()
    seen = []
    for sizes, slots in trained:
        cut = np.cumsum(np.frombuffer(sizes, np.int32))[:-1]
        seen += [tuple(x.tolist()) for x in np.split(np.frombuffer(slots, np.uint16), cut)]
    assert Counter(seen) == Counter(sequences)


def test_attention_beats_pairs_of_words():
    """Two kinds of text of the same pairs of words: only what lies further back tells them apart."""
    rng = np.random.default_rng(8)
    texts = []
    for i in range(600):
        base = 10 if i % 2 else 40
        first = rng.permutation(np.arange(base, base + 20))
        texts.append(np.append(np.ravel(np.stack([np.full(20, 5), first], axis=1)), 99))
    slots, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    counts = np.bincount(slots, minlength=100).astype(float)
    slot = slots_by_count(counts)
    last = np.roll(slot[slots], 1)
    last[np.cumsum(sizes) - sizes] = SLOTS - 1
    pairs = np.bincount(last.astype(np.int64) * SLOTS + slot[slots], minlength=SLOTS**2).reshape(SLOTS, SLOTS)
    frame = Frame(slot, pairs, counts)
    model, state = Model(frame, first_parameters()), {}
    for r in range(15):
        model.train(slot[slots][: 500 * 41], sizes[:500], state=state, seed=r)
    test = slots[500 * 41 :]
    got = model.log_probabilities(test, sizes[500:]).mean()
    by_pairs = (frame.class_log[last[500 * 41 :], frame.class_of[slot[test]]] + frame.slot_log[last[500 * 41 :], slot[test]] + frame.in_slot[test]).mean()
    assert got > by_pairs + 0.1


def test_copies_met_after_the_cache_began_anew(spark, monkeypatch):
    for name, value in (("TOP_WORDS", 0), ("CACHED", 1), ("BATCH_BYTES", 16)):
        monkeypatch.setattr(lm_scoring, name, value)
    texts = ["red green blue " + "red " * (i % 3 == 0) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = lm_scoring.score_documents(docs, F.lit(False), RANKS, public_tokenizers.PATTERN, 50_257).collect()
    assert all(r.n_known == r.n_tokens == len(texts[r.doc_id].split()) + 1 for r in got)
    total = sum(len(t.split()) + 1 for t in texts)
    count, d = Counter(w for t in texts for w in t.split()), total + 3 + 1 + 1
    for r in got:
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / d) for w in texts[r.doc_id].split()) + math.log10(13 / d), rel=1e-9)


def test_a_batch_asks_for_each_word_once():
    """Words are those of bytes.split, numbered as they are first met, and only a batch's different words go through Python."""

    class Asked(dict):
        times = 0

        def __missing__(self, word):
            return self.setdefault(word, len(self))

        def __getitem__(self, word):
            Asked.times += 1
            return super().__getitem__(word)

    texts = [b"", b" \t\n", b"Red red  GREEN\x0b\x0cblue", "a\x1fb \x85 \xa0c \u3000".encode(), b"red " * 500, b"\r\nlast", "\xc9\x00 \xe9".encode()]
    vocabulary = lm_scoring.Vocabulary(RANKS, public_tokenizers.PATTERN, 1000, lambda ids, begin, hashes: (ids[begin], hashes))
    vocabulary.index = Asked()
    split = [t.translate(lm_scoring.ASCII_LOWER).split() for t in texts]
    order = list(dict.fromkeys(w for words in split for w in words))
    for _ in range(2):
        Asked.times = 0
        numbers, many = vocabulary.numbers(texts)
        assert many.tolist() == [len(words) for words in split]
        assert [order[i] for i in numbers] == [w for words in split for w in words]
        assert Asked.times == len(order) < sum(many)
    assert list(vocabulary.index) == order and [len(c) for c in vocabulary.columns] == [len(order)] * 2
    for none in ([], [b""], [b"\n", b""]):
        numbers, many = vocabulary.numbers(none)
        assert len(numbers) == 0 and many.tolist() == [0] * len(none)


def test_rare_words_are_joined_by_a_row_number(spark, monkeypatch):
    """A task lists a text's rare words once, under its row's number, which copies share; nothing is dealt by texts' keys."""
    rows, stage = {}, lm_scoring.Staged

    def kept(spark, df, name):
        out = stage(spark, df, name)
        rows[name] = out.df.collect()
        return out

    monkeypatch.setattr(lm_scoring, "Staged", kept)
    monkeypatch.setattr(lm_scoring, "TOP_WORDS", 0)
    texts = ["red green", "blue", "red green", "", "red green", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = lm_scoring.score_documents(docs, F.lit(False), RANKS, public_tokenizers.PATTERN, 50_257).collect()
    assert {"k1", "k2"}.isdisjoint(rows["scored"][0].asDict())
    listed = {r.turn for r in rows["scored"] if r.rare}
    held = {r.doc_id: r.turn for r in rows["scored"]}
    assert all(held[i] in listed for i, t in enumerate(texts) if t)
    assert len(listed) == len({held[i] for i, t in enumerate(texts) if t})
    for r in got:
        assert r.n_known == r.n_tokens == len((texts[r.doc_id] or "").split()) + 1
    assert len({round(r.base_score, 9) for r in got if texts[r.doc_id] == "red green"}) == 1


# ---- runs of white space, and words with white space beyond ASCII ---------------------------


def test_long_runs_of_white_space(spark):
    from phrasepivot.llm.tokenize_docs import token_ids

    path = RANKS
    encoder = rank_encoder(path, public_tokenizers.PATTERN)
    for run in (" " * 600, "\n" * 300 + " " * 300, "\u3000\xa0" * 200, "\t" * 700):
        for before in ("", "ab", "'s"):
            for after in ("", "cd", "1", "!?", "\x1f"):
                assert token_ids(encoder, before + run + after) == encoder.encode_ordinary(before + run + after)
                assert token_ids(encoder, (before + run) * 2 + after) == encoder.encode_ordinary((before + run) * 2 + after)
    long = [" " * 1_000_000, "x" + "\n" * 1_000_000 + "y", "a" * 300_000]
    got = token_lengths(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), path, public_tokenizers.PATTERN)
    want = [len(encoder._encode_single_piece(long[0].encode())), 2 + len(encoder._encode_single_piece(b"\n" * 999_999)) + 1, len(encoder.encode_ordinary(long[2]))]
    assert [r.n_tokens for r in got.orderBy("doc_id").collect()] == want


def test_words_with_unicode_spaces_keep_their_numbers():
    from phrasepivot.llm.lm_scoring import _encode

    path = RANKS
    words = [w.encode() for w in ("\xa0", "\xa0\xa0", "x", "a\u3000", "b", "\u2028c", "\x1f", "\x85", "d")]
    ids, begin = _encode(words, path, public_tokenizers.PATTERN)
    assert len(begin) == len(words)
    for i, part in enumerate(np.split(ids, begin[1:])):
        alone, _ = _encode([words[i]], path, public_tokenizers.PATTERN)
        assert part.tolist() == alone.tolist()
    assert _encode([], path, public_tokenizers.PATTERN)[0].tolist() == []


# ---- very long texts, and extra columns of the operators' own names ------------------------------


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(200_000)), "q" * 120_000 + " end", " " * 50_000, "a b " * 100_000, None, ""]
    rows = [(i, t, "en", 1, 2, 3, "x") for i, t in enumerate(texts)] + [(0, "short one", None, 1, 2, 3, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, k1 int, score int, n_tokens int, ids string")


def test_long_texts_are_scored(long_docs):
    got = lm_scoring.score_documents(long_docs, F.col("doc_id") == 3, RANKS, public_tokenizers.PATTERN, 50_257).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 3, 3, 200_001, 200_001]
    assert all(np.isfinite([r.base_score, r.score, r.attention_score]).all() and r.score < 0 for r in got)


def test_long_texts_have_a_language(long_docs):
    labelled = long_docs.where("doc_id in (0, 1)").union(long_docs.where("doc_id = 3").withColumn("lang", F.lit("de")))
    got = identify(long_docs, train_language_id(labelled), carry=["score", "lang"])
    assert got.columns == ["doc_id", "lang_pred", "score", "lang"]
    assert [r.lang_pred for r in got.orderBy("doc_id").where("doc_id > 1").collect()] == [UNKNOWN, "de", UNKNOWN, UNKNOWN]


def test_long_texts_are_encoded(long_docs):
    library = Tokenizer.from_file(WORD_FILE)
    got = encode_documents(long_docs, WORD_FILE, carry=["ids", "k1"])
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded", "k1"]
    assert [r.ids for r in got.collect()] == [" ".join(map(str, library.encode(r.text or "", add_special_tokens=False).ids)) for r in long_docs.collect()]


def test_sample_of_labelled_texts(spark, monkeypatch):
    """At most so many texts of a language, copies once, the same whatever the partitions; no language is a third of rows' prey."""
    from phrasepivot.llm.language_id import labelled_windows

    monkeypatch.setattr("phrasepivot.llm.language_id.PER_LANGUAGE", 20)
    rows = [(f"text number {i} of en", "en") for i in range(900)] + [("the same", "en")] * 500 + [(f"de {i}", "de") for i in range(7)] + [("12", "fr"), (None, "fr"), ("x", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    a = labelled_windows(df.repartition(7), F.col("text"), F.col("lang"))
    b = labelled_windows(df.coalesce(1), F.col("text"), F.col("lang"))
    assert (a[0] == b[0]).all() and a[1] == b[1] and Counter(a[1]) == {"en": 20, "de": 7}
    assert len({x.tobytes() for x in a[0]}) == 27
