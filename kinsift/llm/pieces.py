"""Ids of whole texts by those of their pieces, for a tokenizer that drops white space and ends words at it. Operators 5 and 7.

A batch of texts is taken apart as bytes: pieces between blanks and line feeds are found, hashed and looked up in a table of
flat arrays, all at once in numpy. Only pieces that aren't in the table become strings, and are asked of the tokenizer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

#: Slots of a Python worker's table of pieces, of which half are used before it is emptied: some 60 MB with ids. Bytes of text
#: that are taken apart together, and that are hashed together.
TABLE_BITS, GROUP, PIECE = 21, 1 << 22, 1 << 16
#: Bytes in lower case, whether they are letters in ASCII, and masks for the first bytes of shorter pieces.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
SHORT = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
MIX = np.uint64(0xD6E8FEB86659FD93)


class Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            cls.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, INVERSE)]), dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


class Table:
    """Hashed pieces of text and their ids, in flat arrays: open addressing by a hash of 64 bits, a tag of length and first bytes
    beside it."""

    def __init__(self, bits: int = TABLE_BITS):
        self.usual = bits
        self.clear()

    def clear(self) -> None:
        self.slots(self.usual)
        self.first, self.size, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.n = self.used = 0

    def slots(self, bits: int) -> None:
        self.bits, self.mask = bits, np.uint64((1 << bits) - 1)
        self.keys, self.tags, self.entry = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def full(self) -> bool:
        return self.n > 1 << (self.usual - 1)

    def find(self, keys: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 where there is none. No key is zero."""
        out = np.full(len(keys), -1, np.int32)
        at, todo = keys & self.mask, np.arange(len(keys))
        while len(todo):
            seen = self.keys[at]
            hit = (seen == keys[todo]) & (self.tags[at] == tags[todo])
            out[todo[hit]] = self.entry[at[hit]]
            on = ~hit & (seen != 0)
            todo, at = todo[on], (at[on] + np.uint64(1)) & self.mask
        return out

    def put(self, keys: np.ndarray, tags: np.ndarray, ids: list[bytes]) -> None:
        """Adds pieces that differ from each other and from all known ones."""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        first = self.used + np.cumsum(size) - size
        self.first, self.size, self.flat = grown(self.first, self.n, first), grown(self.size, self.n, size), grown(self.flat, self.used, flat)
        entry = np.arange(self.n, self.n + len(ids), dtype=np.int32)
        self.n, self.used = self.n + len(ids), self.used + len(flat)
        if 2 * self.n > len(self.keys):  # a batch of more pieces than usual
            there = np.flatnonzero(self.keys)
            keys, tags, entry = np.concatenate([self.keys[there], keys]), np.concatenate([self.tags[there], tags]), np.concatenate([self.entry[there], entry])
            self.slots((2 * self.n).bit_length())
        self.place(keys, tags, entry)

    def place(self, keys: np.ndarray, tags: np.ndarray, entry: np.ndarray) -> None:
        at, todo = keys & self.mask, np.arange(len(keys))
        while len(todo):
            free = self.keys[at] == 0
            self.entry[at[free]] = entry[todo[free]]  # of several that want a slot, the last one written has it
            won = np.zeros(len(todo), bool)
            won[free] = self.entry[at[free]] == entry[todo[free]]
            self.keys[at[won]], self.tags[at[won]] = keys[todo[won]], tags[todo[won]]
            todo, at = todo[~won], (at[~won] + np.uint64(1)) & self.mask


def grown(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    if used + len(more) > len(array):
        array = np.concatenate([array[:used], np.zeros(max(used, len(more)) + len(more), array.dtype)])
    array[used : used + len(more)] = more
    return array


class Pieces:
    """Encodes texts by their pieces. Of a word of letters in ASCII, in any case and with a comma or full stop behind it, only the
    word in lower case counts. A subclass says what the ids are of new words of letters, and of other pieces as they stand."""

    def __init__(self) -> None:
        self.table = Table()
        marks = self.ids_of_pieces([",", "."])
        if any(len(ids) != 4 for ids in marks):
            raise ValueError("a comma or full stop isn't one token")
        self.marks = np.array([0, *(int.from_bytes(ids, "little") for ids in marks)], np.uint32)

    def ids_of_words(self, words: Sequence[str]) -> list[bytes]:
        """Ids of different words of ASCII letters in lower case, as little-endian 32-bit integers."""
        raise NotImplementedError

    def ids_of_pieces(self, pieces: Sequence[str]) -> list[bytes]:
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out: list[np.ndarray] = []
        while len(out) < len(texts):  # whole texts of about GROUP bytes together
            a = len(out)
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + GROUP, "right")) - 1)
            out += self.encode_bytes(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        return out

    def encode_bytes(self, raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The ids of texts that stand one behind the other between the bounds."""
        starts, ends, words, marks = pieces_of(raw, bounds)
        low = LOWER[raw]
        keys, tags = hashed(low, raw, starts, ends - (marks > 0), words)
        if self.table.full():
            self.table.clear()
        entry = self.table.find(keys, tags)
        new = np.flatnonzero(entry < 0)
        if len(new):
            self.learn(low, raw, starts, ends - (marks > 0), words, keys, tags, new)
            entry[new] = self.table.find(keys[new], tags[new])
        each = self.table.size[entry] + (marks > 0)
        last = np.cumsum(each)
        at = np.repeat(self.table.first[entry] - (last - each), each)
        at += np.arange(len(at))
        at[last[marks > 0] - 1] = 0  # a mark's place is behind its word's ids
        whole = self.table.flat[at]
        whole[last[marks > 0] - 1] = self.marks[marks[marks > 0]]
        cut = np.concatenate([[0], last])[np.searchsorted(starts, bounds)]
        return [whole[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def learn(self, low, raw, starts, ends, words, keys, tags, new) -> None:
        """Asks for the ids of the different ones of the new pieces."""
        _, first = np.unique(np.stack([keys[new], tags[new]], 1), axis=0, return_index=True)
        new = new[first]
        plain, odd = new[words[new]], new[~words[new]]
        text = lambda data, which: [data[a:b].tobytes().decode() for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
        order = np.concatenate([plain, odd])
        self.table.put(keys[order], tags[order], [*self.ids_of_words(text(low, plain)), *self.ids_of_pieces(text(raw, odd))])


def pieces_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as bytes, one behind the other: starts and ends of the pieces between blanks and line feeds, whether a piece is a
    word of letters in ASCII, and whether a comma (1) or a full stop (2) stands behind that."""
    n = len(raw)
    inside = (raw != 32) & (raw != 10)
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    before, behind = np.ones(n, bool), np.ones(n, bool)
    before[1:], behind[:-1] = ~inside[:-1], ~inside[1:]
    starts, ends = np.flatnonzero(inside & (before | fresh[:-1])), np.flatnonzero(inside & (behind | fresh[1:])) + 1
    last = raw[ends - 1]
    marks = np.where(last == 44, 1, np.where(last == 46, 2, 0))
    others = np.zeros(n + 1, np.int32)
    np.cumsum(~LETTER[raw], dtype=np.int32, out=others[1:])
    core = ends - (marks > 0)
    words = (core > starts) & (others[core] == others[starts])
    marks[~words] = 0
    return starts, ends, words, marks


def hashed(low: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and tags of pieces: of words in lower case, of others as they are but for the case of ASCII letters, which the
    tokenizer lowers too. Pieces with an angle may hold a special token, whose case counts: their keys are of their own bytes."""
    keys = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # whole pieces of about PIECE bytes together
        origin = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, origin + PIECE, "right")))
        part = low[origin : ends[b - 1]]
        up, down = Powers.of(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        s, e = starts[a:b] - origin, ends[a:b] - origin
        keys[a:b] = (total[e] - total[s]) * down[s]
        a = b
    size = (ends - starts).astype(np.uint64)
    keys = (keys ^ (keys >> np.uint64(29))) * MIX + np.uint64(2) * size + words
    keys = (keys ^ (keys >> np.uint64(32))) | np.uint64(1 << 63)  # never zero
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(low) + 1,), "<u8", padded, strides=(1,))
    tags = eight[starts] & SHORT[np.minimum(size, np.uint64(8))]
    tags ^= size << np.uint64(40)
    angle = np.zeros(len(low) + 1, np.int32)
    np.cumsum(low == 60, dtype=np.int32, out=angle[1:])
    for i in np.flatnonzero(angle[ends] > angle[starts]).tolist():
        keys[i] = np.uint64(int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little") | 1 << 63)
    return keys, tags
