"""Token files: the Elias-Fano sequence, the ids of the library, files there and back."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cellstrata.llm import tokenfile
from cellstrata.llm.tokenfile import Coder, EliasFano, TokenFile

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \t\n\v\f\r", "a b c\x1c\x1d\x85d don't I'll WE'RE é é 漢字🙂ß İ ΣΑΣ ς", "<|endoftext|>a <|startoftext|>", "a" * 300_000,
    "ab cd,12 " * 40_000, "́ ́a ̸= ≠", "\u0000 a\u0000b ​‍ x　y", "one two", "one two", "one two",
]


LIBRARY = Tokenizer.from_file(PATH)


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("n, top", [(0, 1), (1, 0), (1, 5), (1000, 10), (5000, 10**6), (3000, 2**63), (300, 300), (257, 2**40)])
def test_sequence(n, top):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, top, n, np.uint64, endpoint=True))
    data = EliasFano.coded(v)
    e = EliasFano(data)
    assert (e.all() == v).all() and [e[i] for i in range(n)] == v.tolist() and len(e) == n
    for q in [0, 1, top, *v[:: max(1, n // 50)].tolist()]:
        assert e.find(int(q)) == np.searchsorted(v, np.uint64(q))
    with pytest.raises(IndexError):
        e[n]
    if n > 1000:
        assert 8 * len(data) <= n * (3 + np.log2(max(2, top / n))) + 64 * n / 256 + 400


def test_ids_are_the_library_s(monkeypatch):
    monkeypatch.setattr(Coder, "PIECE", 1000)
    seen = [chr(c) for c in range(0x2FF)]
    TEXTS.extend(["".join(f"{a}{b}s'T{a} x" for a, b in zip(seen, seen[7:])), "".join(f" A{a}1{a}'re" for a in seen)])
    for by_words in (True, False):
        coder = Coder(PATH, 1, by_words, memo=3)
        assert [np.frombuffer(coder.packed(t), coder.kind).tolist() for t in TEXTS] == [plain(t) for t in TEXTS]
        assert coder.kind == np.dtype("<u2")


def test_files_there_and_back(spark, tmp_path):
    rows = [(k, t, "mine", 7) for k, t in zip([5, -3, None, 2, 2, 9, None, 40, 41, 7, 7, 7], TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, key int").repartition(3)
    manifest = tokenfile.write_token_files(df, f"file:{tmp_path}/t", PATH, by_words=True, file_ids=50, file_documents=2)
    assert manifest.count() > 3
    got = [tuple(r) for r in tokenfile.read_token_files(manifest, with_ids=True).orderBy("start").collect()]
    keys = [k for k, *_ in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and keys.count(None) == 2 and keys.count(7) == 3
    start, left = 0, sorted((k is not None, k or 0, plain(t)) for k, t, *_ in rows)
    for key, first, n, crc, packed in got:
        ids = np.frombuffer(packed, "<u4").tolist()
        left.remove((key is not None, key or 0, ids))
        assert (first, n, crc) == (start, len(ids), zlib.crc32(packed))
        start += n
    assert not left
    by_file = {r.file: r for r in manifest.collect()}
    found = 0
    for uri, row in by_file.items():
        with TokenFile(uri) as f:
            assert len(f.places) == row.documents + 1 and f.places[row.documents] == row.ids
            found += sum(ids.tolist() == plain("one two") for ids in f.find(7))
            assert not list(f.find(-100)) and not list(f.find(1000)) and not list(f.find(8))
            assert [(k, x.tolist()) for k, _, x in f.documents(at_once=1)] == [(k, x.tolist()) for k, x in map(f.document, range(f.n))]
    assert found == 3


def test_damaged_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    (row,) = tokenfile.write_token_files(df, str(tmp_path), PATH).collect()
    data = (tmp_path / row.file.rsplit("/", 1)[1]).read_bytes()
    assert len(data) == row.bytes
    for bad in (data[:-1], data[:-70] + b"\xff" + data[-69:], b""):
        (tmp_path / "bad.bin").write_bytes(bad)
        with pytest.raises((ValueError, pa.ArrowInvalid)):
            TokenFile(f"{tmp_path}/bad.bin")


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [tuple(r) for r in tokenfile.op13_token_files(docs).orderBy("doc_id").collect()]
    start, want = 0, []
    for r in docs.orderBy("doc_id").collect():
        ids = plain(r.text)
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert tokenfile.op13_token_files(docs.limit(0)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert tokenfile.op13_token_files(docs.limit(0)).count() == 0
