"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged on its own. A segment tree over the
byte positions of the match holds, for every live token, the key
``(rank of the pair with its right neighbour, position)`` and at its root the
leftmost pair of least rank; a merge updates the three leaves it touches, so a
match of n bytes costs O(n log n) whatever it holds (one "word" may be a whole
document). New matches of up to 64 bytes are merged some thousand at a time, each on its
own tree, by array operations over all of them.

Cases: null text counts as empty; an empty text has no ids; a null id list
decodes to empty bytes; ids outside the vocabulary raise; of equal ranks the
leftmost merges first; a text is one value of any length. Repeated rows are
encoded alike, other columns pass through unchanged; ``token_ids`` and
``n_tokens`` replace columns of these names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from cellstrata.llm.memory import give_back, tidy

_NONE = 1 << 62
_SHIFT = 34
_MASK = (1 << _SHIFT) - 1
_SMALL_NONE = (1 << 31) - 1  # as _NONE, in trees of up to 64 bytes
_SIDE_BY_SIDE = 4096  # trees at once: what they hold stays in a core's cache


def rank_file() -> tuple[str, str]:
    """Place of the public rank file, and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one match, by one tree."""
    whole = ranks.get(word) if len(word) <= longest else None
    if whole is not None:
        return [whole]
    n = len(word)
    if n == 0:
        return []
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    end = list(range(1, n + 1))  # end[i]: where the live token that starts at i ends
    start = list(range(-1, n))  # start[j]: where the live token that ends at j starts

    def key(i: int) -> int:
        j = end[i]
        if j >= n or end[j] - i > longest:
            return _NONE
        rank = ranks.get(word[i : end[j]])
        return _NONE if rank is None else rank << _SHIFT | i

    def put(i: int, value: int) -> None:
        k = i + size
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    for i in range(n - 1):
        tree[size + i] = key(i)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    while tree[1] != _NONE:
        i = tree[1] & _MASK
        j = end[i]
        end[i] = end[j]
        start[end[i]] = i
        put(j, _NONE)
        put(i, key(i))
        if i:
            put(start[i], key(start[i]))
    out, i = [], 0
    while i < n:
        token = word[i : end[i]]
        if token not in ranks:
            raise ValueError(f"byte {token!r} is not in the vocabulary")
        out.append(ranks[token])
        i = end[i]
    return out


class _Vocabulary:
    """Rank tables of one file, and the ids of matches seen so far."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        pairs = [
            (ranks[token[:k]] << 32 | ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair, self.pair_rank = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.known: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or _NONE."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], _NONE)

    def merge_many(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many words of at most ``size`` bytes (a power of two): one tree for each, updated side by side.

        Returns all ids in order, and the number of ids of each word.
        """
        n_words, most, none = len(words), np.int32(size), np.int32(_SMALL_NONE)
        lengths = np.fromiter(map(len, words), np.int32, n_words)
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n_words, size)
        inside = np.arange(size) < lengths[:, None]
        if (self.byte[raw][inside] < 0).any():
            raise ValueError("a byte is not in the vocabulary")
        token = np.full((n_words, size + 1), -1, np.int32)  # id of the live token that starts here; the last column stays -1
        token[:, :size][inside] = self.byte[raw][inside]
        after = np.tile(np.minimum(np.arange(1, size + 2), size).astype(np.int32), (n_words, 1))
        after = np.where(after < lengths[:, None], after, most)
        before = np.tile(np.arange(-1, size, dtype=np.int32), (n_words, 1))
        tree = np.full((n_words, 2 * size), none, np.int32)

        def leaf(left, right, at):
            rank = self.rank_of(left, right)
            return np.where(rank == _NONE, none, rank * size + at).astype(np.int32)

        tree[:, size : 2 * size - 1] = leaf(token[:, : size - 1], token[:, 1:size], np.arange(size - 1))
        width = size // 2
        while width:
            below = tree[:, 2 * width : 4 * width]
            tree[:, width : 2 * width] = np.minimum(below[:, 0::2], below[:, 1::2])
            width //= 2
        live = np.flatnonzero(tree[:, 1] != none)
        while len(live):
            rank, at = np.divmod(tree[live, 1], most)
            gone = after[live, at]
            token[live, at], token[live, gone] = rank, -1
            far = after[live, gone]
            after[live, at] = far
            before[live, far] = at
            prior = before[live, at]
            tree[live, size + gone] = none
            tree[live, size + at] = leaf(rank, token[live, far], at)
            some = prior >= 0
            who, left = live[some], prior[some]
            tree[who, size + left] = leaf(token[who, left], rank[some], left)
            rows, nodes = np.concatenate([live, live, who]), np.concatenate([gone, at, left]) + most
            for _ in range(size.bit_length() - 1):
                nodes >>= 1
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
            live = live[tree[live, 1] != none]
        kept = token >= 0
        return token[kept], kept.sum(1)

    def learn(self, matches: set[str], most: int) -> None:
        """Put the ids of every new match into ``known``; forget the old ones first when it is full."""
        new = matches.difference(self.known)
        if len(self.known) + len(new) > most:
            self.known.clear()
            new = matches
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for match in new:
            word = match.encode()
            rank = self.ranks.get(word)
            if rank is not None:
                self.known[match] = rank.to_bytes(4, "little")
            elif len(word) > 64:
                self.known[match] = np.array(merge(word, self.ranks, self.longest), "<u4").tobytes()
            else:
                by_size.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append((match, word))
        for size, pairs in by_size.items():
            for k in range(0, len(pairs), _SIDE_BY_SIDE):
                part = pairs[k : k + _SIDE_BY_SIDE]
                ids, counts = self.merge_many([word for _, word in part], size)
                packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                for (match, _), start, end in zip(part, [0, *ends], ends):
                    self.known[match] = packed[start:end]

    def packed(self, texts, split, most: int, at_once: int = 100_000):
        """Packed ids of each text; matches are learnt some texts at a time, so few are in memory."""
        waiting: list[list[str]] = []
        size = 0

        def ready():
            self.learn(set().union(*waiting), most)
            for matches in waiting:
                yield b"".join(map(self.known.__getitem__, matches))

        for text in texts:
            waiting.append(split(text) if text else [])
            size += len(waiting[-1])
            if size >= at_once:
                yield from ready()
                waiting, size = [], 0
        yield from ready()


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> _Vocabulary:
    return _Vocabulary(load_ranks(path))


@lru_cache(maxsize=4)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(path).items()}


def encode(text: Column | str, path: str, pattern: str, memo: int = 150_000) -> Column:
    """Ids of a text, packed as little-endian unsigned 32-bit integers.

    ``memo`` bounds the matches whose ids are remembered within a batch (about
    0.2 kB each); it changes no result. Workers are used again, so the memory
    is given back after the batch.
    """

    @F.arrow_udf("binary")
    def packed(batch: pa.Array) -> pa.Array:
        vocabulary = _vocabulary(path)
        out = pa.array(vocabulary.packed((value.as_py() for value in batch), regex.compile(pattern).findall, memo), pa.binary())
        if len(vocabulary.known) > memo // 16:
            vocabulary.known.clear()
            give_back()
        return out

    return packed(F.col(text) if isinstance(text, str) else text)


def decode(ids: Column | str, path: str) -> Column:
    """Bytes of packed ids."""

    @F.arrow_udf("binary")
    def unpacked(batch: pa.Array) -> pa.Array:
        token = _tokens(path).__getitem__
        out = []
        for value in batch:
            b = value.as_py()
            out.append(b"".join(map(token, memoryview(b).cast("I"))) if b else b"")
        return pa.array(out, pa.binary())

    return unpacked(F.col(ids) if isinstance(ids, str) else ids)


def n_ids(ids: Column | str) -> Column:
    """Number of packed ids."""
    return F.floor(F.octet_length(ids) / 4).cast("long")


def as_array(ids: Column | str) -> Column:
    """Packed ids as ``array<int>`` (built-in functions only)."""
    h = F.hex(F.col(ids) if isinstance(ids, str) else ids)

    def one(i):
        at = lambda k: F.substring(h, i * 8 + 1 + 2 * k, F.lit(2))
        return F.conv(F.concat(at(3), at(2), at(1), at(0)), 16, 10).cast("int")

    n = F.floor(F.length(h) / 8).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<int>"))


def encode_documents(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of ``df`` plus ``token_ids`` (packed) and ``n_tokens``."""
    own_path, own_pattern = rank_file()
    out = df.withColumn("token_ids", encode(text, path or own_path, pattern or own_pattern))
    return out.withColumn("n_tokens", n_ids("token_ids"))


def code_documents(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, memo: int = 150_000) -> DataFrame:
    """``(key, token_ids, decoded)``: packed ids of every whole text, and the bytes that they decode to.

    Both are made for some rows at a time, so a task holds one batch of texts
    and little besides.
    """
    own_path, own_pattern = rank_file()
    path, pattern = path or own_path, pattern or own_pattern

    @tidy
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split, token = _Vocabulary(load_ranks(path)), regex.compile(pattern).findall, _tokens(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = list(vocabulary.packed((value.as_py() for value in part.column(1)), split, memo))
                texts = [b"".join(map(token.__getitem__, memoryview(b).cast("I"))) for b in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())], [key, "token_ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(code, f"`{key}` {kind}, token_ids binary, decoded binary")


def op2_byte_bpe(documents: DataFrame) -> DataFrame:
    """Encode and decode every whole text; digests of both."""
    return code_documents(documents).select(
        "doc_id",
        n_ids("token_ids").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
