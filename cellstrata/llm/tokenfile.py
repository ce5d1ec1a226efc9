"""Token ids of documents as binary files, with Elias-Fano coded boundaries.

A file holds the ids of many documents one after the other, little-endian, two
bytes each where the vocabulary allows it, else four; then the boundaries of
the documents and their keys, both ascending and therefore Elias-Fano coded
(low bits packed, high bits in unary, and the place of every 256th one for
selection), and a footer with the lengths of these parts and a checksum of the
index. A boundary costs about 2 + log2(ids / documents) bits instead of 64.

Documents are range partitioned by key, so a key with very many rows spans
several tasks and files; ties are ordered by a hash of the text. Tasks write
files under fresh names and report them in a manifest; only files of the
manifest are read, so what a lost or repeated attempt leaves behind does no
harm. The place of a file's first id among all ids is a running sum over the
manifest, which has a row for each file.

A writing task holds one Arrow batch of texts and the boundaries of one file,
a reading task the boundaries of one file and some 2**20 ids, or one document's.

Cases: a null text is an empty one; an empty text has the end id alone; null
keys come first; repeated keys and rows each are a document; an empty table
gives an empty manifest and no rows. Other columns of the input are ignored.
Special tokens that stand in a text are what the tokenizers library takes them for.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from cellstrata.llm.memory import tidy
from cellstrata.llm.warc import _open
from cellstrata.plans.lineage import shared_dir, written

END = 1
WHITE = " \t\n\v\f\r"
_WORDS = re.compile(r"[^ \t-\r]+").findall
#: Letters beyond ASCII that lower() alone normalises, and whose class no version of Unicode has changed.
_LETTERS = "À-ÖØ-öø-ÿ"
_MAGIC = b"EFTOKEN1"
_SAMPLE = 256  # ones between two kept places
_FOOTER = struct.Struct("<B7xQQQQqI4x8s")  # width, documents, null keys, bytes of boundaries and of keys, smallest key, checksum, magic
_MANIFEST = "part int, number int, file string, documents long, ids long, bytes long"


# ---- Elias-Fano ---------------------------------------------------------


class EliasFano:
    """An ascending sequence of unsigned integers below 2**64, by place."""

    _HEAD = struct.Struct("<QB7xQQ")  # values, low bits, bytes of low and of high bits

    def __init__(self, data: bytes | memoryview):
        self.n, self.width, low, high = self._HEAD.unpack_from(data, 0)
        at = self._HEAD.size
        self.low = np.frombuffer(data, np.uint8, low, at)
        self.high = np.frombuffer(data, np.uint8, high, at + low)
        self.marks = np.frombuffer(data, "<u8", -(-self.n // _SAMPLE), at + low + high)

    @classmethod
    def coded(cls, values: np.ndarray) -> bytes:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        part = v & np.uint64((1 << width) - 1)
        bits = (part[:, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1 if width else np.zeros(0, np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little")
        pad = bytes(-(len(low) + len(high)) % 8)
        return cls._HEAD.pack(n, width, len(low), len(high) + len(pad)) + low.tobytes() + high.tobytes() + pad + ones[::_SAMPLE].astype("<u8").tobytes()

    def __len__(self) -> int:
        return self.n

    def _one(self, i: int) -> int:
        """Place of the i-th one among the high bits: from the kept one before it, byte by byte."""
        place, left = int(self.marks[i // _SAMPLE]), i % _SAMPLE
        byte = place >> 3
        counts = np.bitwise_count(self.high[byte : byte + 64])
        left += int(np.bitwise_count(self.high[byte] & np.uint8((1 << (place & 7)) - 1)))
        while left >= (total := int(counts.sum())):
            left, byte = left - total, byte + 64
            counts = np.bitwise_count(self.high[byte : byte + 64])
        run = np.cumsum(counts)
        k = int(np.searchsorted(run, left, "right"))
        left -= int(run[k - 1]) if k else 0
        return (byte + k) * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte + k : byte + k + 1], bitorder="little"))[left])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.width
        window = int.from_bytes(self.low[first >> 3 : (first + self.width + 7) >> 3].tobytes(), "little")
        return (self._one(i) - i << self.width) | (window >> (first & 7) & ((1 << self.width) - 1))

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width)
            for k in range(self.width):
                out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def find(self, value: int) -> int:
        """Place of the first entry of at least ``value``."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self[middle] < value else (low, middle)
        return low


# ---- ids of texts -------------------------------------------------------


class _Memo(dict):
    """What a function gave for some strings, the first ``most`` of them."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        out = self.make(key)
        if len(self) < self.most:
            self[key] = out
        return out


class Coder:
    """Ids of whole texts by a tokenizer file of the tokenizers library, packed, an end id after each.

    With ``by_words`` each run without white space is encoded by itself, and
    ``memo`` results are remembered: right for tokenizers whose pieces never
    hold white space. Where the file composes, lower-cases and then splits by
    one pattern into bytes, texts and words of Latin letters, digits and marks
    are split here by the file's pattern, and the library's model is asked once
    for each piece; all other words go through the whole library.
    """

    PIECE = 4 << 20  # characters

    def __init__(self, path: str, end: int, by_words: bool, memo: int = 400_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = by_words
        self.kind = np.dtype("<u2" if max(end, self.tokenizer.get_vocab_size()) <= 1 << 16 else "<u4")
        self.end = self._packed([end])
        self.split = self._pattern(json.loads(self.tokenizer.to_str()))
        added = {t.content[:1] for t in self.tokenizer.get_added_tokens_decoder().values()}
        allowed = [c for c in map(chr, range(0x100)) if c not in added and re.fullmatch(f"[!-~ \\t-\\r{_LETTERS}]", c)]
        self.plain = re.compile(f"[{re.escape(''.join(allowed))}]*").fullmatch
        self.letters: dict[int, str] = {}
        self.pieces, self.words = _Memo(self._piece, memo), _Memo(self._word, memo // 4)

    @staticmethod
    def _pattern(file: dict) -> Callable[[str], list[str]] | None:
        """``findall`` of the pattern of a file of the known form, with its classes as they are among ``_LETTERS`` and ASCII."""
        normal, pieces = file.get("normalizer") or {}, (file.get("pre_tokenizer") or {}).get("pretokenizers") or []
        steps = [x["type"] for x in normal.get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pieces] != ["Split", "ByteLevel"]:
            return None
        split, to_bytes = pieces
        plain = split["behavior"] == "Removed" and split["invert"] and not to_bytes["add_prefix_space"] and not to_bytes["use_regex"]
        pattern = split["pattern"]["Regex"].replace("\\p{L}", f"A-Za-z{_LETTERS}").replace("\\p{N}", "0-9")
        return re.compile(pattern).findall if plain and "\\p" not in pattern else None

    def _packed(self, ids: Sequence[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            for c in piece:
                if ord(c) not in self.letters:
                    ((own, _),) = self.tokenizer.pre_tokenizer.pre_tokenize_str(c)
                    self.letters[ord(c)] = own
            piece = piece.translate(self.letters)
        return self._packed([t.id for t in self.tokenizer.model.tokenize(piece)])

    def _word(self, word: str) -> bytes:
        if self.split is not None and self.plain(word):
            return b"".join(map(self.pieces.__getitem__, self.split(word.lower())))
        return self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _parts(self, text: str) -> Iterator[str]:
        """A very long text cut at white space."""
        at = 0
        while len(text) - at > self.PIECE:
            cut = max(text.rfind(c, at, at + self.PIECE) for c in WHITE)
            if cut <= at:  # one word of more than a part stays whole
                cut = min((k for c in WHITE if (k := text.find(c, at + self.PIECE)) >= 0), default=len(text))
            yield text[at:cut]
            at = cut
        yield text[at:]

    def packed(self, text: str | None) -> bytes:
        """Ids of one text, and the end id."""
        if not text:
            return self.end
        if not self.by_words:
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids) + self.end
        out = []
        for part in self._parts(text):
            if self.split is not None and self.plain(part):
                out += map(self.pieces.__getitem__, self.split(part.lower()))
            else:
                out += map(self.words.__getitem__, _WORDS(part))
        out.append(self.end)
        return b"".join(out)


@lru_cache(maxsize=1)
def _coder(path: str, end: int, by_words: bool) -> Coder:
    return Coder(path, end, by_words)


# ---- files --------------------------------------------------------------


class _Writer:
    def __init__(self, files, path: str, kind: np.dtype):
        self.out, self.kind = files.open_output_stream(path, compression=None), kind
        self.sizes: list[int] = []
        self.keys: list[int] = []
        self.ids = 0

    def add(self, key: int | None, packed: bytes) -> None:
        self.out.write(packed)
        n = len(packed) // self.kind.itemsize
        self.ids += n
        self.sizes.append(n)
        if key is not None:
            self.keys.append(key)

    def close(self) -> int:
        least = self.keys[0] if self.keys else 0
        places = EliasFano.coded(np.cumsum([0, *self.sizes]))
        keys = EliasFano.coded(np.array([k - least for k in self.keys], np.uint64))
        pad = bytes(-self.ids * self.kind.itemsize % 8)
        foot = _FOOTER.pack(self.kind.itemsize, len(self.sizes), len(self.sizes) - len(self.keys), len(places), len(keys), least, zlib.crc32(keys, zlib.crc32(places)), _MAGIC)
        self.out.write(pad + places + keys + foot)
        self.out.close()
        return self.ids * self.kind.itemsize + len(pad) + len(places) + len(keys) + len(foot)


class TokenFile:
    """One file, open for reading; ``document`` reads no more than the index and that document."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        self.f = files.open_input_file(path)
        size = self.f.size()
        if size < _FOOTER.size:
            raise ValueError(f"{uri} is too short")
        width, self.n, self.nulls, places, keys, self.least, check, magic = _FOOTER.unpack(self.f.read_at(_FOOTER.size, size - _FOOTER.size))
        index = self.f.read_at(places + keys, size - _FOOTER.size - places - keys) if magic == _MAGIC else b""
        if magic != _MAGIC or zlib.crc32(index) != check:
            raise ValueError(f"{uri} is not a whole token file")
        self.kind = np.dtype(f"<u{width}")
        self.places, self.keys = EliasFano(index[:places]), EliasFano(index[places:])

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.f.close()

    def read(self, first: int, end: int) -> np.ndarray:
        """Ids from place ``first`` up to ``end`` of this file."""
        width = self.kind.itemsize
        got = self.f.read_at((end - first) * width, first * width)
        if len(got) != (end - first) * width:
            raise ValueError("the file ends within its ids")
        return np.frombuffer(got, self.kind)

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """Key and ids of the i-th document."""
        return None if i < self.nulls else self.keys[i - self.nulls] + self.least, self.read(self.places[i], self.places[i + 1])

    def find(self, key: int) -> Iterator[np.ndarray]:
        """Ids of every document of that key."""
        i = self.keys.find(key - self.least) if key >= self.least else len(self.keys)
        while i < len(self.keys) and self.keys[i] + self.least == key:
            yield self.document(i + self.nulls)[1]
            i += 1

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(key, first place, ids)`` of all documents in order."""
        ends, keys = self.places.all().astype(np.int64), self.keys.all()
        i = 0
        while i < self.n:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + at_once, "right")) - 1)
            block = self.read(int(ends[i]), int(ends[j]))
            for k in range(i, j):
                key = None if k < self.nulls else int(keys[k - self.nulls]) + self.least
                yield key, int(ends[k]), block[ends[k] - ends[i] : ends[k + 1] - ends[i]]
            i = j


# ---- operators ----------------------------------------------------------


def write_token_files(
    documents: DataFrame, folder: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end: int = END, by_words: bool = False, file_ids: int = 64 << 20, file_documents: int = 1 << 20
) -> DataFrame:
    """Write the ids of all texts in the order of ``key``; the manifest of the files.

    ``tokenizer`` is a path that every executor has; a file closes at
    ``file_ids`` ids or ``file_documents`` documents.
    """

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        coder, part, number, out, name = _coder(tokenizer, end, by_words), TaskContext.get().partitionId(), 0, None, ""
        names = [x.split()[0] for x in _MANIFEST.split(", ")]

        def done() -> pa.RecordBatch:
            size = out.close()
            row = ([part], [number], [f"{folder}/{name}"], [len(out.sizes)], [out.ids], [size])
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names)

        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is not None and (out.ids >= file_ids or len(out.sizes) >= file_documents):
                    yield done()
                    number, out = number + 1, None
                if out is None:
                    name = f"tokens-{uuid.uuid4().hex}.bin"
                    out = _Writer(files, f"{path}/{name}", coder.kind)
                out.add(k, coder.packed(value.as_py()))
        if out is not None:
            yield done()

    order = ["__key", "__h", "__row"]
    rows = documents.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    rows = rows.withColumns({"__h": F.xxhash64("__text"), "__row": F.monotonically_increasing_id()})
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("__key", "__text")
    return written(sorted_rows.mapInArrow(write, _MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of every document of the files, and with ``with_ids`` ``ids``, packed in four bytes each.

    ``start`` counts all ids before the document, also those of earlier files.
    """
    before = F.sum("ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    schema = "key long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    form = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in schema.split(", ")])

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for uri, first in zip(*(c.to_pylist() for c in batch.columns)):
                with TokenFile(uri) as f:
                    for key, place, ids in f.documents():
                        packed = ids.astype("<u4").tobytes()
                        rows.append((key, first + place, len(ids), zlib.crc32(packed), packed)[: len(form)])
                        size += 50 + len(packed) * with_ids
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), form)], schema=form)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), form)], schema=form)

    return files.repartition(max(1, manifest.count()), "file").mapInArrow(read, schema)


def op13_token_files(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the token files, read them back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = f"{shared_dir(documents.sparkSession)}/tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(documents, folder, tokenizer, by_words=True)
    return read_token_files(manifest).withColumnRenamed("key", "doc_id")
