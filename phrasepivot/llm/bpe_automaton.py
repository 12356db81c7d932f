"""BPE as a deterministic automaton over token arcs.

The automaton begins with an arc for each base symbol from every state.  Each
merge (u, v) -> w, in order, puts a gadget in: the state behind w begins as a copy
of the state behind v, the state behind u loses its arc v, and every state that
still has an arc u gets an arc w.  A state is thus "the last token", and a path through
the arcs that spells a word is its one BPE encoding.

What a gadget takes from a state and an arc it takes from all their later copies.
States that are copies under the same later gadgets end up alike and share a row of
the table, arcs alike share a column: of 49k tokens these are 12k rows and 14k
columns, 20 MB of bits, which are compiled once and sent to the workers.

A word's prefixes have one encoding each, so its last token is found from left to
right: a suffix automaton of the tokens gives those that end at a place, longest
first, and the table says which of them may follow the last token of the prefix
before it.  Nothing is undone, and the time is linear in the word.
"""

from __future__ import annotations

import json
from collections import defaultdict

import numpy as np

#: Words that a worker keeps, and as many that it had before.
WORDS = 60_000
_SYMBOL = 21  # bits of a symbol's code point


def _spines(tokens, merges_of: dict[int, list[int]], rank: dict[int, int], part: dict[int, int], ties: bool) -> tuple[dict, list]:
    """The class of each token, and for each class the (token, number of its merges) from which gadgets reach it.

    part: a token's side that it is copied from; a copy at rank p has lost what merges before p took (ties: or p)."""
    classes: dict[tuple, int] = {}
    of = {}
    for t in tokens:
        key, x, copied = [], t, None
        while True:
            own = merges_of.get(x, ())
            n = len(own) if copied is None else int(np.searchsorted(own, copied, "right" if ties else "left"))
            if n:
                key.append((x, n))
            if x not in part:
                break
            x, copied = part[x], rank[x]
        of[t] = classes.setdefault(tuple(key), len(classes))
    return of, list(classes)


class Automaton:
    """ids: by token, base symbols and merged ones; merges: pairs of tokens in order.

    Tokens are strings of symbols; one token must come from one merge.  It is compiled when it is made, and small
    enough to be sent to workers."""

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]]):
        rank: dict[int, int] = {}
        first, second, behind, ahead = {}, {}, defaultdict(list), defaultdict(list)
        for r, (u, v) in enumerate(merges, 1):
            w, u, v = ids[u + v], ids[u], ids[v]
            if w in rank:
                raise ValueError(f"two merges make the token {w}")
            rank[w], first[w], second[w] = r, u, v
            behind[u].append(r)
            ahead[v].append(r)
        tokens = list(ids.values())
        # a state is copied from its token's second part, an arc from its first; of equal symbols the first pair merges
        state, rows = _spines(tokens, behind, rank, second, ties=False)
        arc, columns = _spines(tokens, ahead, rank, first, ties=True)

        def reached(classes: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            """By token: the classes that its gadgets reach and how many of its merges do, most first."""
            out = defaultdict(list)
            for c, key in enumerate(classes):
                for t, n in key:
                    out[t].append((-n, c))
            return {t: (-np.array([n for n, _ in sorted(x)]), np.array([c for _, c in sorted(x)])) for t, x in out.items()}

        by_state, by_arc = reached(rows), reached(columns)
        bits = np.full((len(rows), -(-len(columns) // 8)), 255, np.uint8)
        turn_u, turn_v, dead, mask = defaultdict(int), defaultdict(int), set(), np.zeros(bits.shape[1] * 8, bool)
        for w, u in first.items():  # the gadgets, in order
            v = second[w]
            # a merge whose second arc is gone from behind its first makes a token that no path has
            if u in dead or v in dead or not bits[state[u], arc[v] >> 3] & (1 << (arc[v] & 7)):
                dead.add(w)
            counts, x = by_state[u]
            x = x[: int(np.searchsorted(-counts, -turn_u[u], "left"))]
            counts, y = by_arc[v]
            y = y[: int(np.searchsorted(-counts, -turn_v[v], "left"))]
            turn_u[u] += 1
            turn_v[v] += 1
            mask[y] = True
            bits[x] &= ~np.packbits(mask, bitorder="little")
            mask[y] = False
        self.width, self.bits = bits.shape[1], bits.tobytes()
        self.states, self.arcs = len(rows), len(columns)
        size = max(tokens, default=-1) + 1
        self.row, self.column, self.size, self.link = (np.full(size, -1, np.int32) for _ in range(4))
        for t, i in ids.items():
            self.row[i], self.column[i], self.size[i] = state[i], arc[i], len(t)
        self._suffixes({t: i for t, i in ids.items() if i not in dead})

    def _suffixes(self, ids: dict[str, int]) -> None:
        """The suffix automaton of the live tokens: goto, failure, the longest token that ends at a node, and its next shorter one."""
        goto, out, ends = {}, [-1], {}
        for t, i in ids.items():
            node = 0
            for c in t:
                key = node << _SYMBOL | ord(c)
                if key not in goto:
                    goto[key] = len(out)
                    out.append(-1)
                node = goto[key]
            out[node], ends[i] = i, node
        own, fail, level = list(out), [0] * len(out), sorted(goto)
        by_node = defaultdict(list)
        for key in level:
            by_node[key >> _SYMBOL].append((key & ((1 << _SYMBOL) - 1), goto[key]))
        queue = [child for _, child in by_node[0]]
        for node in queue:
            for c, child in by_node[node]:
                at = fail[node]
                while at and (at << _SYMBOL | c) not in goto:
                    at = fail[at]
                fail[child] = goto.get(at << _SYMBOL | c, 0)
                queue.append(child)
            out[node] = own[node] if own[node] >= 0 else out[fail[node]]
        for i, node in ends.items():
            self.link[i] = out[fail[node]]
        self.keys, self.children = np.array(list(goto), np.int64), np.array(list(goto.values()), np.int32)
        self.fail, self.out = np.array(fail, np.int32), np.array(out, np.int32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "_ready"}

    def _tables(self) -> tuple:
        if not hasattr(self, "_ready"):
            self._ready = (dict(zip(self.keys.tolist(), self.children.tolist())).get, self.fail.tolist(), self.out.tolist(), self.size.tolist(), self.link.tolist(), (self.row.astype(np.int64) * self.width).tolist(), (self.column >> 3).tolist(), (1 << (self.column & 7)).tolist(), self.bits)
        return self._ready

    def arc(self, x: int, y: int) -> bool:
        """Whether the state behind x has an arc y."""
        *_, row, byte, bit, bits = self._tables()
        return bool(bits[row[x] + byte[y]] & bit[y])

    def encode(self, word: str) -> list[int]:
        """Arc labels of the one path that spells the word."""
        goto, fail, out, size, link, row, byte, bit, bits = self._tables()
        last, node = [-1], 0
        for i, c in enumerate(map(ord, word), 1):
            child = goto(node << _SYMBOL | c)
            while child is None and node:
                node = fail[node]
                child = goto(node << _SYMBOL | c)
            node = child or 0
            token = out[node]
            while token >= 0:  # the longest token that ends here and that the state before it has an arc for
                before = i - size[token]
                if not before or ((x := last[before]) >= 0 and bits[row[x] + byte[token]] & bit[token]):
                    break
                token = link[token]
            last.append(token)
        path, at = [], len(word)
        while at:
            if (token := last[at]) < 0:
                raise ValueError(f"no path for {word[:100]!r}")
            path.append(token)
            at -= size[token]
        return path[::-1]


class _Words(dict):
    """Fills itself: by word, the values that fill makes.  When it holds WORDS, those that were not asked for since it
    was last full go; long words are not kept."""

    def __init__(self, fill):
        self.fill, self.old = fill, {}

    def __missing__(self, word: str):
        made = self.old.pop(word, None) or self.fill(word)
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = made
        return made

    def forget(self) -> None:
        self.clear()
        self.old = {}


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it is printable and no space, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(x for x in range(256) if x not in table):
        table[b] = chr(256 + n)
    return table


class WordBpe:
    """Encodes and decodes as the tokenizers library does with a file of the kind of word_bpe_49k.json:
    NFC, white space to one space, lower case; words by a pattern; byte symbols; ``</w>`` at a word's end.

    A special token's string in a text is that token.  Decoding joins the tokens' strings by spaces."""

    END = "\n"  # stands for </w> inside the automaton: no byte symbol

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        if not suffix or spec["decoder"] is not None or spec["post_processor"] is not None or model["unk_token"] or model["continuing_subword_prefix"]:
            raise ValueError(f"{path} is no word BPE of the kind that this class knows")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        own = lambda t: t[: -len(suffix)] + self.END if t.endswith(suffix) else t
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = {own(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.automaton = Automaton(ids, [(own(u), own(v)) for u, v in pairs])
        self.text_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.symbols = byte_symbols()
        self.bytes = {ord(c): b for b, c in self.symbols.items()}
        # the library's own normalizer and splitter, without its model
        self.spec = json.dumps({**spec, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})
        self._prepare()

    def _prepare(self) -> None:
        import re

        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(self.spec)
        self.normalise, self.pieces = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Latin letters, digits and spaces up to U+017F, where re needs no Unicode tables of another version
        letter, digit, space = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
        self.plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{space}{letter}{digit}]+").findall
        self.odd = re.compile("[^\x00-\u012f\u0131-\u017f]").search
        self.printable = re.compile("[!-~]+").fullmatch
        self.known = _Words(self.word)

    def __getstate__(self) -> dict:
        return {k: vars(self)[k] for k in ("special", "automaton", "text_of", "symbols", "bytes", "spec")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self._prepare()

    def word(self, word: str) -> tuple[str, str]:
        """Ids of a word, and their tokens' strings, each joined by spaces."""
        spelled = word if self.printable(word) else "".join([self.symbols[b] for b in word.encode()])
        path = self.automaton.encode(spelled + self.END)
        return " ".join(map(str, path)), " ".join([self.text_of[i] for i in path])

    def forget(self) -> None:
        """Gives back what was kept of words."""
        self.known.forget()

    def words(self, text: str) -> list[str]:
        if text.isascii() or not self.odd(text):
            return self.plain(text.lower())
        pieces = self.pieces(self.normalise(text))
        return [bytes([self.bytes[ord(c)] for c in p]).decode() for p, _ in pieces]

    def encode(self, text: str, with_text: bool = True) -> tuple[str, str]:
        """Decimal ids joined by a space, and the decoded text, or nothing for it."""
        ids, decoded = [], []
        parts = self.splits.split(text) if self.splits and "<" in text else [text]
        for part in parts:
            if part in self.special:
                ids.append(str(self.special[part]))
                decoded.append(part)
                continue
            paths = list(map(self.known.__getitem__, self.words(part)))
            ids += [p[0] for p in paths]
            if with_text:
                decoded += [p[1] for p in paths]
        return " ".join(ids), " ".join(decoded)

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.text_of[i] for i in ids if i in self.text_of])
