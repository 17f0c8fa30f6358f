"""Token ids of many texts through a public byte-level BPE file of the tokenizers library.

The split pattern of this kind of tokenizer begins a new pre-token at every space that a character
other than white space follows, and before and after a line feed that stands alone between two such
characters.  So a text is the concatenation of the chunks between those places, and the ids of a
chunk can be looked up.  Chunks are found, hashed and looked up as numpy arrays over the bytes of a
whole batch; the tokenizer sees each new chunk once.  Texts that hold one of its added tokens go to it
whole, if those are asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pressroom.llm.common import span_hashes, text_buffer

U64 = np.uint64
CACHE_CHUNKS = 1_000_000     # bound of the chunk cache of one Python worker
LONG_CHUNK = 64             # longer chunks are not kept (bytes)
JOINED = 2_000              # new chunks that are encoded as one text
RUN_BYTES = 1 << 20         # bytes of text that are hashed and looked up at once

#: Bytes that are, or can begin, white space: what follows a space at a cut is none of them.
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Bytes of ASCII that are no white space: what stands on both sides of a line feed at a cut.
_SOLID = ~_SPACE
_SOLID[0x80:] = False


def cuts(buf: np.ndarray) -> np.ndarray:
    """Byte positions at which a chunk begins (places inside texts only; the row starts come besides)."""
    if len(buf) < 2:
        return np.empty(0, np.int64)
    cut = np.zeros(len(buf), bool)
    cut[:-1] = (buf[:-1] == 0x20) & ~_SPACE[buf[1:]]
    feed = np.flatnonzero(buf[1:-1] == 0x0A) + 1
    feed = feed[_SOLID[buf[feed - 1]] & _SOLID[buf[feed + 1]]]
    cut[feed] = True
    cut[feed + 1] = True
    return np.flatnonzero(cut)


class Table:
    """Open addressing over numpy arrays: 64-bit hashes to numbers 0, 1, 2 ... in the order of their coming."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.at = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is unknown (0 is no hash)."""
        mask = U64((1 << self.bits) - 1)
        slot = (h & mask).astype(np.int64)
        key, out = self.keys[slot], self.at[slot]
        open_ = np.flatnonzero((key != h) & (key != 0))
        out[key != h] = -1
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            key = self.keys[slot[open_]]
            here = key == h[open_]
            out[open_[here]] = self.at[slot[open_[here]]]
            open_ = open_[~here & (key != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Number new, different hashes."""
        while 2 * (self.n + len(h)) > 1 << self.bits:
            old = self.keys[np.argsort(np.where(self.keys != 0, self.at, 1 << 62))[: self.n]]
            self.bits, self.n = self.bits + 1, 0
            self.keys, self.at = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -1, np.int64)
            self._put(old)
        self._put(h)

    def _put(self, h: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot, number = (h & U64(mask)).astype(np.int64), self.n + np.arange(len(h))
        self.n += len(h)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            mine = free & (self.keys[slot] == h)
            self.at[slot[mine]] = number[mine]
            h, slot, number = h[~mine], (slot[~mine] + 1) & mask, number[~mine]


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (n[0] numbers), begin[1], ..."""
    ends = np.cumsum(n)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    some = np.flatnonzero(n)
    if len(some):
        at = ends[some] - n[some]
        out[at[0]] = begin[some[0]]
        out[at[1:]] = begin[some[1:]] - (begin[some[:-1]] + n[some[:-1]] - 1)
    return np.cumsum(out)


_KEPT: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_tokens: bool = False) -> Encoder:
    """The encoder of this Python worker: later tasks find its file read and its cache filled."""
    key = path, special_tokens
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(path, special_tokens)
    return _KEPT[key]


class Encoder:
    """The ids of known chunks lie one after the other in ``flat``, those of chunk i from ``begin[i]``."""

    def __init__(self, path: str, special_tokens: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True      # their strings in a text are ordinary text, if not asked for
        self.marks = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()] if special_tokens else []
        self.size = self.tok.get_vocab_size()
        self.led_by_space = np.array([(self.tok.id_to_token(i) or "").startswith("Ġ") for i in range(self.size)])
        self.ends: np.ndarray | None = None
        self._empty()

    def _empty(self) -> None:
        self.table = Table()
        self.flat, self.begin = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        enc = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        return [np.array(e.ids, np.uint32) for e in enc(texts, add_special_tokens=False)]

    def _marked(self, text: str) -> np.ndarray:
        """The ids of a text with the added tokens that it holds."""
        self.tok.encode_special_tokens = False     # for this text only: the file need not be held twice
        try:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
        finally:
            self.tok.encode_special_tokens = True

    def _chunk_ids(self, chunks: list[bytes], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks one after the other, and how many each has.  Chunks of a space and
        a word (``words``) are encoded many in one text, where an id that begins with a space begins a chunk."""
        ids: list[np.ndarray] = []
        n = np.zeros(len(chunks), np.int64)
        order: list[np.ndarray] = []
        single = np.flatnonzero(~words)
        joined = np.flatnonzero(words)
        for k in range(0, len(joined), JOINED):
            part = joined[k: k + JOINED]
            got = self._batch([b"".join([chunks[i] for i in part.tolist()]).decode()])[0]
            first = np.flatnonzero(self.led_by_space[got])
            if len(first) != len(part):              # a tokenizer of another kind: one by one
                single = np.append(single, part)
                continue
            ids.append(got)
            n[part] = np.diff(np.append(first, len(got)))
            order.append(part)
        got_each = self._batch([chunks[i].decode() for i in single.tolist()])
        n[single] = [len(x) for x in got_each]
        flat, order_ = np.concatenate([*ids, *got_each]), np.concatenate([*order, single])
        begin = np.empty(len(chunks), np.int64)
        begin[order_] = np.cumsum(n[order_]) - n[order_]
        return flat[spread(begin, n)], n

    def _learn(self, hashes: np.ndarray, chunks: list[bytes], words: np.ndarray) -> None:
        ids, n = self._chunk_ids(chunks, words)
        have, m = self.table.n, len(chunks)
        used = int(self.begin[have])
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.empty(used + 2 * len(ids), np.uint32)])
        if have + m + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin[: have + 1], np.empty(have + 2 * m, np.int64)])
        self.flat[used: used + len(ids)] = ids
        self.begin[have + 1: have + m + 1] = used + np.cumsum(n)
        self.table.add(hashes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; equal to encoding every text whole."""
        ids, ends = self.encode_column(pa.array(texts, pa.large_string()))
        return np.split(ids, ends[:-1]) if len(texts) else []

    def encode_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after the other, and where each row's end (null: no ids)."""
        buf, offs = text_buffer(col)
        rows = len(offs) - 1
        whole: dict[int, np.ndarray] = {}
        for mark in self.marks:
            data = buf.tobytes()
            at = data.find(mark)
            while at >= 0:
                i = int(np.searchsorted(offs, at, "right")) - 1
                if at + len(mark) <= offs[i + 1]:
                    if i not in whole:
                        text = buf[offs[i]: offs[i + 1]].tobytes().decode()
                        whole[i] = self._marked(text)
                    at = data.find(mark, int(offs[i + 1]))
                else:
                    at = data.find(mark, at + 1)
        starts = cuts(buf)
        starts = np.sort(np.concatenate([starts, offs[:-1][offs[:-1] < offs[1:]]]), kind="stable")
        starts = starts[np.append(True, starts[1:] != starts[:-1])] if len(starts) else starts
        ends = np.append(starts[1:], len(buf))
        if whole:
            left = ~np.isin(np.searchsorted(offs, starts, "right") - 1, np.array(list(whole)))
            starts, ends = starts[left], ends[left]
        n = np.zeros(rows, np.int64)
        got = []
        lo = 0
        while lo < len(starts):                      # bounded memory, however long a text is
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + RUN_BYTES)))
            ids, m = self._ids_of(buf[starts[lo]: ends[hi - 1]], starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo])
            got.append(ids)
            np.add.at(n, np.searchsorted(offs, starts[lo:hi], "right") - 1, m)
            lo = hi
        ids = np.concatenate(got) if got else np.empty(0, np.uint32)
        if whole:
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i, x in whole.items():
                parts[i], n[i] = x, len(x)
            ids = np.concatenate(parts)
        return ids, np.cumsum(n)

    def _ids_of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the given chunks one after the other, and how many each has."""
        h = span_hashes(buf, starts, ends)
        h[h == 0] = 1
        if self.table.n > CACHE_CHUNKS or int(self.begin[self.table.n]) > 8 * CACHE_CHUNKS:
            self._empty()
        long = ends - starts > LONG_CHUNK
        at = self.table.find(h)
        new = np.flatnonzero((at < 0) & ~long)
        if len(new):
            new = new[np.argsort(h[new])]
            one = new[np.append(True, h[new][1:] != h[new][:-1])]
            odd = np.append(0, np.cumsum(_SPACE[buf]))
            words = (buf[starts[one]] == 0x20) & (odd[ends[one]] - odd[starts[one]] == 1)
            data = buf.tobytes()
            self._learn(h[one], [data[i:j] for i, j in zip(starts[one].tolist(), ends[one].tolist())], words)
            at[new] = self.table.find(h[new])
        at[long] = self.table.n                      # an empty place, filled below
        self._place(self.table.n)
        lo, m = self.begin[at], self.begin[at + 1] - self.begin[at]
        flat = self.flat
        if long.any():
            where = np.flatnonzero(long)
            each = self._batch([buf[starts[i]: ends[i]].tobytes().decode() for i in where.tolist()])
            base = int(self.begin[self.table.n])
            flat = np.concatenate([flat[:base], *each])
            m[where] = [len(x) for x in each]
            lo[where] = base + np.cumsum(m[where]) - m[where]
        return flat[spread(lo, m)], m

    def _place(self, i: int) -> None:
        """Room for the begin after the last chunk."""
        if i + 1 >= len(self.begin):
            self.begin = np.concatenate([self.begin, np.empty(len(self.begin), np.int64)])
        self.begin[i + 1] = self.begin[i]

    def sentence_ends(self) -> np.ndarray:
        """For each id whether its text ends a sentence or line."""
        if self.ends is not None:
            return self.ends
        ends = np.zeros(self.size, bool)
        for i in range(self.size):
            ends[i] = self.tok.decode([i], skip_special_tokens=False).rstrip(" ").endswith((".", "!", "?", "\n", "。"))
        self.ends = ends
        return ends
