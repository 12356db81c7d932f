"""A causal self-attention model over subword ids, trained in numpy.

Its tokens are words, each by its first subword id, and texts' ends.  Ids that are
frequent have a slot of their own; the others share slot 0.  The next slot's
probability is that of its class, from attention over the context, times that of the
slot in its class after the last slot, from smoothed counts of the whole corpus.  The
class scores begin as the corpus's own, so attention learns what the context adds to
them.  What follows a word's first id is spelled by counts (``Speller``).
"""

from __future__ import annotations

import numpy as np

#: Slots, classes, size of vectors, positions in a window, and by how many of them windows advance.
SLOTS, CLASSES, VECTOR, WINDOW, STRIDE = 1024, 64, 16, 32, 28
#: Windows in a step of training, and of scoring.
BATCH, STEP = 64, 256
DISCOUNT = 0.5
PARTS = (("e", (SLOTS, VECTOR)), ("qkv", (VECTOR, 3 * VECTOR)), ("r", (WINDOW,)), ("o", (VECTOR, CLASSES)))
PARAMETERS = sum(int(np.prod(s)) for _, s in PARTS)
_CAUSAL = np.where(np.arange(WINDOW)[:, None] >= np.arange(WINDOW), 0, -1e9).astype(np.float32)
_DISTANCE = np.maximum(np.arange(WINDOW)[:, None] - np.arange(WINDOW), 0)
#: Scores beyond are cut before they are exponentiated.
_MOST = np.float32(60)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in PARTS:
        size = int(np.prod(shape))
        out[name], at = flat[at : at + size].reshape(shape), at + size
    return out


def first_parameters(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    scale = {"e": 0.3, "qkv": VECTOR**-0.5, "r": 0.0, "o": 0.02}
    return np.concatenate([rng.normal(0, 1, s).astype(np.float32).ravel() * np.float32(scale[n]) for n, s in PARTS])


def slots_by_count(counts: np.ndarray) -> np.ndarray:
    """The most frequent ids have slots from 1 on, the end (the last id) the last slot; the others slot 0."""
    order = np.argsort(-counts, kind="stable")
    order = order[(order != len(counts) - 1) & (counts[order] > 0)][: SLOTS - 2]
    slot = np.zeros(len(counts), np.int32)
    slot[order] = np.arange(1, len(order) + 1)
    slot[-1] = SLOTS - 1
    return slot


def in_slot_log(slot_of: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log probability of each id in its slot, by counts; unseen ids count a little."""
    each = counts + 0.01
    total = np.bincount(slot_of, each, SLOTS)
    return np.log(each / total[slot_of]).astype(np.float32)


def smoothed(pairs: np.ndarray) -> np.ndarray:
    """Rows of probabilities from counts of pairs, backing off to how often the second is met at all."""
    pairs = pairs.astype(np.float64)
    single = pairs.sum(axis=0) + 0.5
    single /= single.sum()
    kept = np.maximum(pairs - DISCOUNT, 0)
    total = pairs.sum(axis=1, keepdims=True)
    return (kept + (total - kept.sum(axis=1, keepdims=True) + DISCOUNT) * single) / (total + DISCOUNT)


class Frame:
    """What the corpus's counts fix: the slot of each id, slots' classes, and log probabilities.

    pairs: counts of (last slot, slot); ids: counts of ids."""

    def __init__(self, slot_of: np.ndarray, pairs: np.ndarray, ids: np.ndarray, seed: int = 5):
        self.slot_of, self.in_slot = slot_of, in_slot_log(slot_of, ids)
        self.class_of = self._classes(pairs.astype(np.float64), seed)
        p = smoothed(pairs)
        by_class = p @ np.eye(CLASSES)[self.class_of]
        self.class_log = np.log(by_class + 1e-12).astype(np.float32)
        self.slot_log = (np.log(p) - np.log(by_class[:, self.class_of])).astype(np.float32)

    @staticmethod
    def _classes(pairs: np.ndarray, seed: int) -> np.ndarray:
        """Clusters of slots by what surrounds them: k-means of the leading singular vectors of their neighbours."""
        rng = np.random.default_rng(seed)
        seen = np.concatenate([pairs / (pairs.sum(axis=1, keepdims=True) + 5), (pairs / (pairs.sum(axis=0, keepdims=True) + 5)).T], axis=1)
        u, s, _ = np.linalg.svd(np.sqrt(seen).astype(np.float32), full_matrices=False)
        x = (u * s)[:, :24]
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-6
        weight = np.sqrt(pairs.sum(axis=0) + 1)
        centre = x[rng.choice(len(x), CLASSES, replace=False, p=weight / weight.sum())]
        for _ in range(15):
            best = (x @ centre.T).argmax(axis=1)
            for c in range(len(centre)):
                if (best == c).any():
                    centre[c] = (x[best == c] * weight[best == c, None]).sum(axis=0)
            centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-6
        return best


class Speller:
    """What follows a word's first id, up to the word's end, by smoothed counts of pairs of slots.

    pairs: (SLOTS, SLOTS + 1) counts of (last slot, slot), the last column a word's end; ids: counts of ids inside words."""

    def __init__(self, slot_of: np.ndarray, pairs: np.ndarray, ids: np.ndarray):
        self.slot_of, self.in_slot, self.log = slot_of, in_slot_log(slot_of, ids), np.log(smoothed(pairs)).astype(np.float32)

    def rest(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Natural log probability of each word given its first id; ids of all words one after the other, and where each begins."""
        if not len(begin):
            return np.zeros(0)
        slots = self.slot_of[ids]
        after = np.append(slots[1:], SLOTS)
        after[begin[1:] - 1] = SLOTS
        each = self.log[slots, after].astype(np.float64)
        inside = np.ones(len(ids), bool)
        inside[begin] = False
        each[inside] += self.in_slot[ids[inside]]
        return np.add.reduceat(each, begin)


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of so many tokens (one at least) that lie one after the other: text, place of the first
    position in the whole, first position scored, and positions held, for each window."""
    many = 1 + np.maximum(-(-(sizes - WINDOW) // STRIDE), 0)
    text = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    begin = np.cumsum(sizes) - sizes
    held = np.minimum(sizes[text] - nth * STRIDE, WINDOW)
    return text, begin[text] + nth * STRIDE, np.where(nth > 0, WINDOW - STRIDE, 0), held


class Model:
    def __init__(self, frame: Frame, flat: np.ndarray):
        self.frame, self.flat = frame, flat.astype(np.float32).copy()

    # -- scoring ---------------------------------------------------------------

    def _folded(self):
        if not hasattr(self, "_tables"):
            p = unpack(self.flat)
            qkv = p["e"] @ p["qkv"]
            qkv[:, :VECTOR] *= np.float32(VECTOR**-0.5)
            self._tables = *(np.ascontiguousarray(x) for x in np.split(qkv, 3, axis=1)), p["o"], p["r"][_DISTANCE] + _CAUSAL
        return self._tables

    def class_scores(self, x: np.ndarray) -> np.ndarray:
        """(windows, WINDOW, CLASSES) scores of the next class; x: slots, the last one known at each position."""
        q, k, v, o, bias = self._folded()
        a = np.matmul(q.take(x, axis=0), k.take(x, axis=0).transpose(0, 2, 1))
        a += bias
        np.minimum(a, _MOST, out=a)
        np.exp(a, out=a)
        h = np.matmul(a, v.take(x, axis=0))
        h /= a @ np.ones((WINDOW, 1), np.float32)  # sums by BLAS, which short rows sum up slowly without
        z = (h.reshape(-1, VECTOR) @ o).reshape(*x.shape, CLASSES)
        z += self.frame.class_log.take(x, axis=0)
        return np.minimum(z, _MOST, out=z)

    def log_probabilities(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log probability of each id; ids of all texts one after the other, each closed by its end."""
        f = self.frame
        slots, last, of = self._context(f.slot_of[ids], sizes)
        out = f.in_slot[ids] + f.slot_log.ravel().take(last[: len(ids)].astype(np.int64) * SLOTS + slots)
        _, place, first, held = windows_of(sizes)
        span, ones = np.arange(WINDOW), np.ones((CLASSES, 1), np.float32)
        for a in range(0, len(place), STEP):
            at = place[a : a + STEP, None] + span
            z = self.class_scores(last[at])
            top = z.reshape(-1, CLASSES)[np.arange(at.size), of[at].ravel()].reshape(at.shape)
            np.exp(z, out=z)
            top -= np.log(z.reshape(-1, CLASSES) @ ones).reshape(at.shape)
            on = (span >= first[a : a + STEP, None]) & (span < held[a : a + STEP, None])
            out[at[on]] += top[on]
        return out

    def _context(self, slots: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots; the slot before each (an end before a text) and each slot's class, padded by a window."""
        slots = slots.astype(np.int32)
        last = np.zeros(len(slots) + WINDOW, np.int32)
        last[1 : len(slots)] = slots[:-1]
        last[np.cumsum(sizes) - sizes] = SLOTS - 1
        return slots, last, np.concatenate([self.frame.class_of.astype(np.int32)[slots], np.zeros(WINDOW, np.int32)])

    # -- training --------------------------------------------------------------

    def train(self, slots: np.ndarray, sizes: np.ndarray, rate: float = 0.02, seed: int = 3, state: dict | None = None) -> int:
        """One pass of Adam over the texts' windows, in a random order; returns the windows seen.  state sums up the
        loss and the positions too."""
        rng = np.random.default_rng(seed)
        state = state if state is not None else {}
        m, v = state.setdefault("m", np.zeros_like(self.flat)), state.setdefault("v", np.zeros_like(self.flat))
        _, last, of = self._context(slots, sizes)
        span = np.arange(WINDOW)
        _, place, first, held = windows_of(sizes)
        order = rng.permutation(len(place))
        for a in range(0, len(order), BATCH):
            w = order[a : a + BATCH]
            at = place[w, None] + span
            on = (span >= first[w, None]) & (span < held[w, None])
            g, loss = self.gradient(last[at], of[at], on)
            state["loss"], state["positions"] = state.get("loss", 0.0) + loss, state.get("positions", 0) + int(on.sum())
            t = state["t"] = state.get("t", 0) + 1
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            self.flat -= np.float32(rate / (1 + t / 400) / (1 - 0.9**t)) * m / (np.sqrt(v / np.float32(1 - 0.99**t)) + np.float32(1e-6))
        if hasattr(self, "_tables"):
            del self._tables
        return len(order)

    def gradient(self, x: np.ndarray, target: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the mean negative log probability of the classes where on; and the sum of that."""
        p, scale, n = unpack(self.flat), np.float32(VECTOR**-0.5), max(int(on.sum()), 1)
        shape, ones = x.shape, np.ones((WINDOW, 1), np.float32)
        e = p["e"].take(x.ravel(), axis=0)
        qkv = e @ p["qkv"]
        q, k, v = (qkv[:, i * VECTOR : (i + 1) * VECTOR].reshape(*shape, VECTOR) for i in range(3))
        a = np.matmul(q * scale, k.transpose(0, 2, 1))
        a += p["r"][_DISTANCE] + _CAUSAL
        np.minimum(a, _MOST, out=a)
        np.exp(a, out=a)
        a /= a @ ones
        h = np.matmul(a, v)
        flat_h = h.reshape(-1, VECTOR)
        z = flat_h @ p["o"]
        z += self.frame.class_log.take(x.ravel(), axis=0)
        np.minimum(z, _MOST, out=z)
        np.exp(z, out=z)
        total, weight = z @ np.ones((CLASSES, 1), np.float32), on.ravel()[:, None] / np.float32(n)
        picked = np.arange(x.size) * CLASSES + target.ravel()
        loss = -float(np.log((z.ravel()[picked] / total[:, 0])[on.ravel()] + np.float32(1e-30)).sum())
        z *= weight / total
        z.ravel()[picked] -= weight[:, 0]
        g = {"o": flat_h.T @ z}
        flat_d = z @ p["o"].T
        dh = flat_d.reshape(h.shape)
        dv = np.matmul(a.transpose(0, 2, 1), dh)
        da = np.matmul(dh, v.transpose(0, 2, 1))
        da -= (flat_d * flat_h).sum(axis=1).reshape(*shape, 1)
        da *= a
        g["r"] = np.bincount(_DISTANCE.ravel(), np.where(_CAUSAL == 0, da.sum(axis=0), 0).ravel(), WINDOW)
        d = np.concatenate([np.matmul(da, k) * scale, np.matmul(da.transpose(0, 2, 1), q) * scale, dv], axis=2).reshape(-1, 3 * VECTOR)
        g["qkv"] = e.T @ d
        de = d @ p["qkv"].T
        place = (x.ravel()[:, None].astype(np.int64) * VECTOR + np.arange(VECTOR)).ravel()
        g["e"] = np.bincount(place, de.ravel(), SLOTS * VECTOR)
        return np.concatenate([np.asarray(g[name], np.float32).ravel() for name, _ in PARTS]), loss
