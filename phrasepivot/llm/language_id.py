"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasepivot.llm.common import STEP_BYTES, Carried, ship_package, small_batches, tidy, utf8_views

#: Bytes in a window; widths of the filters, and how many there are of each; size of a byte's vector.
WINDOW, WIDTHS, FILTERS, VECTOR = 256, (2, 3, 4), 8, 8
#: Bound of the labelled sample: windows of each language, languages, and windows in all.
PER_LANGUAGE, LANGUAGES, SAMPLE = 800, 1000, 16_000
#: Windows that are looked at in one step.
STEP = 256
UNKNOWN = "und"


@dataclass
class ByteConv:
    """languages; bytes' vectors E; for each width a filter matrix and bias; the output layer."""

    languages: list[str]
    e: np.ndarray
    conv: list[tuple[np.ndarray, np.ndarray]]
    out: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def train(windows: np.ndarray, labels: list[str], steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteConv:
        """windows: (n, WINDOW) bytes, 0 beyond a text's end.  Adam on cross-entropy, classes drawn evenly."""
        rng = np.random.default_rng(seed)
        languages = sorted(set(labels))
        y = np.array([languages.index(x) for x in labels])
        of = [np.flatnonzero(y == k) for k in range(len(languages))]
        f4 = np.float32
        p = [rng.normal(0, 0.5, (256, VECTOR)).astype(f4)]
        for w in WIDTHS:
            p += [rng.normal(0, (w * VECTOR) ** -0.5, (w * VECTOR, FILTERS)).astype(f4), np.zeros(FILTERS, f4)]
        p += [rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))).astype(f4), np.zeros(len(languages), f4)]
        m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
        for t in range(1, steps + 1):
            rows = np.array([rng.choice(of[k]) for k in rng.integers(0, len(languages), batch)])
            x, target = windows[rows], y[rows]
            g = ByteConv._gradient(p, x, target)
            for i in range(len(p)):
                m[i] += 0.1 * (g[i] - m[i])
                v[i] += 0.001 * (g[i] ** 2 - v[i])
                p[i] -= rate * (1 - t / steps * 0.9) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return ByteConv(languages, p[0], [(p[1 + 2 * i], p[2 + 2 * i]) for i in range(len(WIDTHS))], (p[-2], p[-1]))

    @staticmethod
    def _gradient(p: list[np.ndarray], x: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        n, length = x.shape
        g = [np.zeros_like(a) for a in p]
        e = p[0][x]
        feats, kept = [], []
        for i, w in enumerate(WIDTHS):
            cols = np.concatenate([e[:, j : length - w + 1 + j] for j in range(w)], axis=2)
            z = cols @ p[1 + 2 * i] + p[2 + 2 * i]
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None], axis=1)[:, 0]
            feats.append(np.maximum(top, 0))
            kept.append((cols, at, top > 0))
        h = np.concatenate(feats, axis=1)
        s = h @ p[-2] + p[-1]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        s[np.arange(n), target] -= 1
        s /= n
        g[-2], g[-1] = h.T @ s, s.sum(axis=0)
        dh = s @ p[-2].T
        for i, (w, (cols, at, on)) in enumerate(zip(WIDTHS, kept)):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS] * on
            picked = cols[np.arange(n)[:, None], at]  # n, FILTERS, w * VECTOR
            g[1 + 2 * i] = np.einsum("nfc,nf->cf", picked, d)
            g[2 + 2 * i] = d.sum(axis=0)
            back = d[:, :, None] * p[1 + 2 * i].T[None]  # n, FILTERS, w * VECTOR
            for j in range(w):
                np.add.at(g[0], x[np.arange(n)[:, None], at + j].ravel(), back[:, :, j * VECTOR : (j + 1) * VECTOR].reshape(-1, VECTOR))
        return g

    def tables(self) -> list[list[np.ndarray]]:
        """Each filter folded into sums of rows by byte pair, and by byte where the width is odd."""
        if not hasattr(self, "_tables"):
            self._tables = []
            for w, (k, b) in zip(WIDTHS, self.conv):
                taps = [self.e @ k[j * VECTOR : (j + 1) * VECTOR] for j in range(w)]
                taps[0] = taps[0] + b
                pairs = [(taps[j][:, None] + taps[j + 1][None]).reshape(65536, FILTERS) for j in range(0, w - 1, 2)]
                self._tables.append(pairs + ([taps[-1]] if w % 2 else []))
        return self._tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(n, languages) of each window."""
        n, length = windows.shape
        wide = windows.astype(np.int32)
        pair = (wide[:, :-1] << 8) | wide[:, 1:]
        out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        for i, (w, tables) in enumerate(zip(WIDTHS, self.tables())):
            size = length - w + 1
            z = tables[0].take(pair[:, :size], axis=0)
            for j, t in enumerate(tables[1:], 1):
                z += t.take((pair if len(t) == 65536 else wide)[:, 2 * j : 2 * j + size], axis=0)
            out[:, i * FILTERS : (i + 1) * FILTERS] = z.max(axis=1)
        s = np.maximum(out, 0) @ self.out[0] + self.out[1]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): the mean over a text's windows, weighted by their bytes; all of a text counts."""
        sizes = np.diff(offsets)
        counts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = offsets[:-1][owner] + nth * WINDOW
        held = np.minimum(offsets[1:][owner] - start, WINDOW)
        padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        span, total = np.arange(WINDOW), np.zeros((len(sizes), len(self.languages)))
        for a in range(0, len(owner), STEP):
            s, size = start[a : a + STEP], held[a : a + STEP]
            x = padded[s[:, None] + span]
            x[span >= size[:, None]] = 0
            np.add.at(total, owner[a : a + STEP], self.probabilities(x) * size[:, None])
        return total / np.maximum(sizes, 1)[:, None]


def labelled_windows(docs: DataFrame, text: Column, lang: Column) -> tuple[np.ndarray, list[str]]:
    """A bounded sample of WINDOW-byte pieces of labelled texts: for each language the texts of lowest hash, cut at a
    place that depends on the hash; PER_LANGUAGE of each of the LANGUAGES most frequent, and SAMPLE in all.

    How many texts a language has says how low a hash must be to be looked at, so that about twice the sample is
    gathered; copies count once and are counted as one before they are."""
    import pyarrow as pa

    mark = F.xxhash64(text)
    place = F.pmod(mark, F.greatest(F.length(text) - WINDOW, F.lit(1))).cast("int") + 1
    rows = docs.where(text.isNotNull() & lang.isNotNull() & text.rlike(r"\p{L}")).select(lang.alias("lang"), mark.alias("mark"), F.substring(text, place, F.lit(WINDOW)).alias("piece"))
    many = rows.groupBy("lang").agg(F.approx_count_distinct("mark", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not many:
        return np.zeros((0, WINDOW), np.uint8), []
    quota = max(1, min(PER_LANGUAGE, SAMPLE // len(many)))
    # a share of the hashes, as unsigned 53-bit numbers
    bounds = [(r.lang, int(min(1.0, (2 * quota + 50) / max(r.n, 1)) * (1 << 53))) for r in many]
    low = F.shiftrightunsigned("mark", 11)
    # as an Arrow table, which takes no Python worker of another kind on the executors
    langs, lows = zip(*bounds)
    asked = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(langs, pa.string()), "bound": pa.array(lows, pa.int64())}))
    picked = rows.join(F.broadcast(asked), "lang").where(low < F.col("bound")).groupBy("lang", low.alias("low"), "mark").agg(F.min("piece").alias("piece")).collect()
    by_lang: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: (r.low, r.mark)):
        by_lang.setdefault(r.lang, []).append(r.piece)
    chosen = [(k, piece) for k in sorted(by_lang) for piece in by_lang[k][:quota]]
    x = np.zeros((len(chosen), WINDOW), np.uint8)
    for i, (_, piece) in enumerate(chosen):
        raw = piece.encode()[:WINDOW]
        x[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    return x, [k for k, _ in chosen]


def train_language_id(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> ByteConv | None:
    """Null where there is nothing to learn from."""
    x, labels = labelled_windows(docs, F.col(text_col), F.col(lang_col))
    return ByteConv.train(x, labels) if labels else None


def identify(docs: DataFrame, model: ByteConv | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs, and the columns of carry.

    lang_pred is the language of the highest mean probability over the windows of
    the whole text, and score is that mean.  A null text, one without a letter, or
    a model that has learned nothing gives ``und`` and 0.  Repeated rows and null
    ids are judged row by row; other columns of docs are not read."""
    spark = docs.sparkSession
    ship_package(spark)
    kind, carried = docs.schema[id_col].dataType.simpleString(), Carried(docs, carry or [])
    sent = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        import pyarrow as pa

        model = sent.value
        for b in small_batches(batches, STEP_BYTES, "text"):
            known = np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool) & (model is not None)
            best, score = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            if known.any():
                p = model.texts(*utf8_views(b.column(1)))
                best, score = np.where(known, p.argmax(axis=1), -1), np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)
            names = [*(model.languages if model else []), UNKNOWN]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[i] for i in best], pa.string()), pa.array(score), *carried.of(b)], ["doc_id", "lang_pred", "score", *carried.inside])

    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lettered.alias("lettered"), *carried.columns)
    return carried.named(rows.mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double{carried.schema}"), ["doc_id", "lang_pred", "score"])
