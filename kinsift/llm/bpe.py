"""Operator 7. Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of slots. Leaf i of the tree holds rank * width + i for the pair that starts in slot i, or NONE, so
the root is the lowest rank and, among equal ranks, the leftmost slot. A merge changes three leaves; each change climbs
log2(width) levels. Words of equal width are merged together, a step of each at a time, in numpy.

Defined results: a null text is the empty text, and encodes to no ids. An empty table gives an empty table. Repeated
rows give repeated rows. A null id stays null. Columns other than the id and the text are not read, so names can't
clash. Texts are cut at blanks and line feeds only to look words up; ids are those of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_batches, worker_state
from .pieces import Pieces

NONE = np.int64(2**62)
#: Odd multiplier of the table of pairs.
SPREAD = np.int64(0x1E3779B97F4A7C15)
#: Wider words are merged one by one.
WIDEST = 64
#: From here on, versions of Unicode differ about letters, marks and their order.
FAR_LETTERS = "\u0250"


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if visible in Latin-1, else 256 and on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Bpe(Pieces):
    """A tokenizer file with the stages NFC, white space, lower case; a split by a pattern; byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stages = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split, level = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        model = spec["model"]
        if stages != ["NFC", "Replace", "Lowercase"] or split.get("type") != "Split" or level.get("type") != "ByteLevel" or model["type"] != "BPE":
            raise ValueError(f"{path}: stages of another kind")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        end = model["end_of_word_suffix"] or ""
        characters = byte_characters()
        self.inner = np.array([vocab[c] for c in characters], np.int64)
        self.last = np.array([vocab[c + end] for c in characters], np.int64)
        self.base = len(self.tokens)
        ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks[vocab[a] * self.base + vocab[b]] = (rank, vocab[a + b])
        self.merged = np.zeros(1 + max((r for r, _ in ranks.values()), default=0), np.int64)
        self.table_bits = max(4, (4 * len(ranks)).bit_length())
        self.table_keys, self.table_ranks = np.full(1 << self.table_bits, -1, np.int64), np.zeros(1 << self.table_bits, np.int64)
        for key, (rank, new) in ranks.items():
            self.merged[rank] = new
            at = (key * int(SPREAD) % 2**64) >> (64 - self.table_bits)
            while self.table_keys[at] >= 0:
                at = (at + 1) % len(self.table_keys)
            self.table_keys[at], self.table_ranks[at] = key, rank
        self.one = {k: v[0] for k, v in ranks.items()}
        self.byte_of = {c: b for b, c in enumerate(characters)}
        stages = Tokenizer.from_file(path)
        self.normal, self.pre = stages.normalizer, stages.pre_tokenizer
        super().__init__()

    def ranks_of(self, a: np.ndarray, b: np.ndarray, width: int, slot: np.ndarray) -> np.ndarray:
        """Leaves of the pairs (a, b) in the slots; b is -1 where a is the last symbol."""
        key = a * self.base + b
        at = (key * SPREAD).view(np.uint64) >> np.uint64(64 - self.table_bits)
        out = np.full(len(key), NONE, np.int64)
        open_ = np.flatnonzero(b >= 0)
        while len(open_):  # linear probing
            seen = self.table_keys[at[open_]]
            hit = open_[seen == key[open_]]
            out[hit] = self.table_ranks[at[hit]] * width + slot[hit]
            open_ = open_[(seen != key[open_]) & (seen >= 0)]
            at[open_] = (at[open_] + np.uint64(1)) & np.uint64(len(self.table_keys) - 1)
        return out

    def merge_together(self, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """All words of at most `width` symbols, by one segment tree each: their ids on end, and how many each has."""
        n = len(size)
        inside = np.arange(width + 1) < size[:, None]
        ids = np.full((n, width + 1), -1, np.int64)
        ids[inside] = start
        pair = inside[:, 1:] & inside[:, :-1]
        tree = np.full((n, 2 * width), NONE, np.int64)
        tree[:, width:][pair] = self.ranks_of(ids[:, :-1][pair], ids[:, 1:][pair], width, np.nonzero(pair)[1])
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        nxt = np.broadcast_to(np.arange(1, width + 2), ids.shape).flatten()
        prv = np.broadcast_to(np.arange(-1, width), ids.shape).flatten()
        flat, node = ids.ravel(), tree.ravel()

        def put(trees: np.ndarray, slots: np.ndarray, leaves: np.ndarray) -> None:
            at = slots + width
            node[trees + at] = leaves
            below = width
            while below > 1:
                at >>= 1
                below >>= 1
                child = trees + 2 * at
                node[trees + at] = np.minimum(node[child], node[child + 1])

        row = np.arange(n)
        row = row[node[row * (2 * width) + 1] < NONE]
        while len(row):
            trees, slots = row * (2 * width), row * (width + 1)
            root = node[trees + 1]
            slot, new = root % width, self.merged[root // width]
            gone = nxt[slots + slot]
            after = nxt[slots + gone]
            flat[slots + slot], flat[slots + gone], nxt[slots + slot], prv[slots + after] = new, -1, after, slot
            put(trees, gone, np.full(len(row), NONE))
            put(trees, slot, self.ranks_of(new, flat[slots + after], width, slot))  # past the end stands -1
            before = prv[slots + slot]
            has = np.flatnonzero(before >= 0)
            if len(has):
                b = before[has]
                put(trees[has], b, self.ranks_of(flat[slots[has] + b], new[has], width, b))
            row = row[node[trees + 1] < NONE]
        ids = flat.reshape(n, width + 1)
        kept = ids >= 0
        return ids[kept], kept.sum(1)

    def merge_alone(self, word: np.ndarray) -> np.ndarray:
        """One word of any length by the same tree, in logarithmic time a merge."""
        ids, n = word.tolist(), len(word)
        width = 1 << max(1, (n - 1).bit_length())
        none, base, one = int(NONE), self.base, self.one
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)

        def leaf(i: int) -> int:
            j = nxt[i]
            r = one.get(ids[i] * base + ids[j]) if j < n else None
            return none if r is None else r * width + i

        tree[width : width + n] = [leaf(i) for i in range(n)]
        for at in range(width - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

        def put(i: int, value: int) -> None:
            at = i + width
            tree[at] = value
            while at > 1:
                at >>= 1
                tree[at] = min(tree[2 * at], tree[2 * at + 1])

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = nxt[i]
            ids[i], ids[j], nxt[i] = int(self.merged[rank]), -1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            put(j, none)
            put(i, leaf(i))
            if prv[i] >= 0:
                put(prv[i], leaf(prv[i]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of byte words, each by its own tree, as little-endian 32-bit integers."""
        out = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, members in groups.items():
            raw = np.frombuffer(b"".join([words[i] for i in members]), np.uint8)
            ends = np.cumsum([len(words[i]) for i in members])
            start = self.inner[raw]
            start[ends - 1] = self.last[raw[ends - 1]]
            if width > WIDEST:
                for i, ids in zip(members, np.split(start, ends[:-1]), strict=True):
                    out[i] = self.merge_alone(ids).astype("<u4").tobytes()
            else:
                ids, count = self.merge_together(start, np.diff(ends, prepend=0), width)
                flat, at = ids.astype("<u4").tobytes(), 0
                for i, n in zip(members, (4 * count).tolist(), strict=True):
                    out[i] = flat[at : at + n]
                    at += n
        return out

    def split(self, piece: str) -> list[str | int]:
        """Byte words of a piece of text, and ids of the special tokens in it."""
        if piece.isalpha() and max(piece) < FAR_LETTERS:
            word = (piece if piece.isascii() else unicodedata.normalize("NFC", piece)).lower()
            if word.isalpha():  # a letter's lower case may hold a mark
                return [word]
        out: list[str | int] = []
        for k, part in enumerate(self.special_pattern.split(piece) if self.special_pattern else [piece]):
            if k % 2:
                out.append(self.special[part])
            elif max(part, default="") < FAR_LETTERS:
                out += self.pattern.findall(unicodedata.normalize("NFC", part).lower())
            elif part:  # which tables of Unicode hold is the library's business
                out += [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.pre.pre_tokenize_str(self.normal.normalize_str(part))]
        return out

    def ids_of_words(self, words: Sequence[str]) -> list[bytes]:
        return self.merge([w.encode() for w in words])

    def ids_of_pieces(self, pieces: Sequence[str]) -> list[bytes]:
        parts = [self.split(p) for p in pieces]
        words = list({w for ws in parts for w in ws if isinstance(w, str)})
        ids = dict(zip(words, self.merge([w.encode() for w in words]), strict=True))
        return [b"".join([ids[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in ws]) for ws in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids, joined by blanks: what a file without a decoder stage prescribes."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


def loaded(path: str) -> Bpe:
    """One model and one word cache for each Python worker, as long as it runs tasks of this operator."""
    return worker_state(("bpe", path), lambda: Bpe(path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row."""
    path, schema = tokenizer or default_tokenizer(), docs.select(F.col(id_col).alias("id")).schema
    kind = schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(path)
        ids = bpe.encode(batch.column(1).fill_null(""))
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], [id_col, "ids", "decoded"])

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, ids array<int>, decoded string", keeps_state=True)


def round_trip_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, decoded from the ids, and digested."""
    path = tokenizer or default_tokenizer()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(path)
        ids = bpe.encode(batch.column(1).fill_null(""))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps_state=True)
