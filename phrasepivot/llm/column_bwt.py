"""Column-wise construction of the Burrows-Wheeler transform and the common
prefixes of a collection of aligned pieces.

Every round puts one symbol in front of each piece's suffix, the pieces' columns
going from the right to the left.  Equal strings of the asked length lie at the
same column of their group (see ``suffix_dedup``), so a round's transform holds
the suffixes of one column, those of a group next to each other: the last round's
file is read in order, its suffixes are dealt stably by the new symbol, the common
prefix of two that follow each other becomes one more than the least between them,
and the next file is written in order.
"""

from __future__ import annotations

import io
import uuid

import numpy as np

#: Bytes of a file that are held in memory; a longer one goes to the shared folder.
HELD = 64 << 20


class SequentialFile:
    """Arrays that are written in order and then read in order, once."""

    def __init__(self, folder: str | None, held: int = HELD):
        self.folder, self.held, self.at = folder, held, 0
        self.stream: io.IOBase = io.BytesIO()
        self.path = self.store = None

    def write(self, array: np.ndarray) -> None:
        raw = np.ascontiguousarray(array).view(np.uint8).reshape(-1)
        if self.path is None and self.folder and self.at + len(raw) > self.held:
            from pyarrow.fs import FileSystem

            self.store, base = FileSystem.from_uri(self.folder)
            self.store.create_dir(base, recursive=True)
            self.path = f"{base}/column-{uuid.uuid4().hex}"
            begun, self.stream = self.stream.getvalue(), self.store.open_output_stream(self.path)
            self.stream.write(begun)
        self.stream.write(raw)
        self.at += len(raw)

    def rewind(self) -> SequentialFile:
        if self.path is not None:
            self.stream.close()
            self.stream = self.store.open_input_stream(self.path, buffer_size=1 << 20)
        else:
            self.stream.seek(0)
        return self

    def read(self, count: int, kind) -> np.ndarray:
        return np.frombuffer(self.stream.read(count * np.dtype(kind).itemsize), kind)

    def drop(self) -> None:
        self.stream.close()
        if self.path is not None:
            self.store.delete_file(self.path)


def _least_between(lcp: np.ndarray, before: np.ndarray, here: np.ndarray) -> np.ndarray:
    """The least of lcp over (before, here] of each pair."""
    out = lcp[here]
    far = np.flatnonzero(here != before + 1)
    if len(far):
        bounds = np.empty(2 * len(far), np.int64)
        bounds[::2], bounds[1::2] = before[far] + 1, here[far] + 1
        out[far] = np.minimum.reduceat(np.append(lcp, np.iinfo(lcp.dtype).max), bounds)[::2]
    return out


class Collection:
    """Pieces of any number of groups, whose transform and common prefixes go through files that are written and read in
    order: the columns of each part that is added, and the state of the last round."""

    def __init__(self, folder: str | None = None, held: int = HELD):
        self.folder, self.held, self.parts, self.group = folder, held, [], []

    def add(self, pieces: list[bytes], left: np.ndarray, group: np.ndarray) -> None:
        """left: bytes of each piece before its anchor; group: non-decreasing, over all that is added.  Files of held
        bytes in all stay in memory."""
        n, most = len(pieces), int(left.max(initial=0))
        sizes = np.array([len(p) for p in pieces], np.int64)
        right = int((sizes - left).max(initial=0))
        table = np.full((n, most + right), -1, np.int16)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        row = np.repeat(np.arange(n), sizes)
        table[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(most - left, sizes)] = flat
        columns = SequentialFile(self.folder, self.held)
        columns.write(table.T[::-1])
        self.held -= columns.at if columns.path is None else 0
        self.parts.append((columns.rewind(), n, most, right))
        self.group.append(group)

    def _column(self, place: int) -> np.ndarray:
        """The symbols of all pieces so far behind their anchors (before: less than 0), -1 where a piece has none."""
        return np.concatenate([columns.read(n, np.int16) if -most <= place < right else np.full(n, -1, np.int16) for columns, n, most, right in self.parts])

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, far, near): runs of starts, far to near before the anchor, whose strings of length bytes start at the
        same column of another piece of their group too.  Can be asked for once."""
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n = sum(p[1] for p in self.parts)
        if not n:
            return tuple(map(np.concatenate, out))
        # suffixes stay with their group, so that a place in the order has the same group in all rounds
        base = np.concatenate(self.group).astype(np.int64) * 257 + 1
        most, right = (max(p[i] for p in self.parts) for i in (2, 3))
        open_, since = np.zeros(n, bool), np.zeros(n, np.int64)

        def close(ended: np.ndarray, far: int) -> None:
            for column, x in zip(out, (ended, np.full(len(ended), far), since[ended])):
                column.append(x)

        state = SequentialFile(self.folder)
        state.write(np.arange(n, dtype=np.int32))
        state.write(np.zeros(n, np.int32))
        for place in range(right - 1, -most - 1, -1):
            state.rewind()
            order, lcp = state.read(n, np.int32), state.read(n, np.int32)
            state.drop()
            symbol = self._column(place)[order]  # the transform of the round before
            key = base + symbol
            if (key[1:] >= key[:-1]).all():
                after = lcp[1:] + 1
                same = (key[1:] == key[:-1]) & (symbol[1:] >= 0)
            else:
                dealt = np.argsort(key, kind="stable")
                order, key, symbol = order[dealt], key[dealt], symbol[dealt]
                same = (key[1:] == key[:-1]) & (symbol[1:] >= 0)
                after = np.zeros(n - 1, np.int32)
                after[same] = _least_between(lcp, dealt[:-1][same], dealt[1:][same]) + 1
            lcp = np.zeros(n, np.int32)
            lcp[1:] = np.where(same, after, 0)
            if place <= 0:
                hit, long = np.zeros(n, bool), lcp >= length
                hit[order] = long | np.append(long[1:], False)
                close(np.flatnonzero(open_ & ~hit), -place - 1)
                since[hit & ~open_] = -place
                open_ = hit
            state = SequentialFile(self.folder)
            state.write(order.astype(np.int32))
            state.write(lcp)
        state.drop()
        for columns, *_ in self.parts:
            columns.drop()
        close(np.flatnonzero(open_), most)
        return tuple(map(np.concatenate, out))


def repeated_starts(pieces: list[bytes], left: np.ndarray, group: np.ndarray, length: int, folder: str | None = None) -> np.ndarray:
    """(pieces, max(left) + 1) booleans: whether the string of length bytes that starts there, counted
    from max(left) before the anchor, starts at the same column of another piece of its group.

    left: bytes of each piece before its anchor; group: non-decreasing."""
    collection, most = Collection(folder), int(left.max(initial=0))
    collection.add(pieces, left, group)
    out = np.zeros((len(pieces), most + 1), bool)
    for i, far, near in zip(*(x.tolist() for x in collection.runs(length))):
        out[i, most - far : most - near + 1] = True
    return out
