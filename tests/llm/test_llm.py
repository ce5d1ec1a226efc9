"""Operators of the subpackage against plain versions, and their odd cases."""

import base64
import hashlib
import io
import random
import re
import struct
from html import unescape

import duckdb
import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from cellstrata.llm import bpe, decontaminate, extract, jaccard, licences, neighbours, pii, quality, toxicity, warc, words
from cellstrata.llm.queries import ORACLE_SQL

SF = "/root/testdata/sf0.001"
LONG = "abc déf 1234 " * 40_000
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, "one two three four five six"), (5, "one two three four five six"),
    (6, "One TWO three four five six"), (None, "one two three four five six"), (7, "a" * 300_000), (8, "\u0000　 ß ñ 漢字 🙂"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", "y", 3, [1.0], 0.5) for i, t in ODD]
    schema = "doc_id long, text string, lang string, source string, n_chars long, figures array<double>, score double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# ---- 1 ------------------------------------------------------------------


def unit(r, n=64):
    v = np.array([r.gauss(0, 1) for _ in range(n)])
    return v / np.linalg.norm(v)


def brute_vectors(rows, threshold=0.98):
    ok = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    link = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is not None and la == lb and ok(a) and ok(b) and len(a) == len(b):
                a, b = np.float32(a).astype(float), np.float32(b).astype(float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    link[i].append(j)
                    link[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in link[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        c = min(rows[k][0] for k in seen)
        out.append((rows[i][0], len(link[i]), c, rows[i][0] == c))
    return sorted(out)


def test_vectors_against_brute_force(spark):
    r = random.Random(1)
    rows, k = [], 0
    for c in range(40):
        base = unit(r)
        for _ in range(r.choice([1, 2, 5, 9])):
            v = base + r.choice([0, 0.05, 0.15, 0.2]) * unit(r)
            rows.append((k, [float(x) for x in v * r.choice([1, 3])], c % 3))
            k += 1
    rows += [(k, rows[0][1], rows[0][2]), (k + 1, rows[0][1], None), (k + 2, None, 1), (k + 3, [], 1), (k + 4, [0.0] * 64, 1)]
    rows += [(k + 5, [float("nan")] * 64, 1), (k + 6, [None] * 64, 1), (k + 7, [1.0, 2.0], 1), (k + 8, [2.0, 4.0], 1), (k + 9, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "vec_id long, embedding array<float>, label int, node string")
    assert sorted(map(tuple, neighbours.op1_near_vectors(df).collect())) == brute_vectors(rows)
    assert neighbours.op1_near_vectors(df.limit(0)).count() == 0


def test_large_groups_and_extreme_lengths(spark, monkeypatch):
    """One label holds nine tenths of the rows, most of them near copies of one vector, some on the rim."""
    monkeypatch.setattr(neighbours, "MANY", 20)
    r = random.Random(3)
    base = unit(r)
    rows = [(k, [float(x) for x in base + r.choice([0.01, 0.05, 0.15, 0.2]) * unit(r)], 7) for k in range(160)]
    rows += [(k, rows[k % 5][1], 7) for k in range(160, 170)]
    rows += [(k, [float(x) for x in unit(r)], 7 if k % 2 else 8) for k in range(170, 200)]
    big = [[1e200, 0.0], [0.0, 1e200], [1e-200, 0.0], [0.0, 1e-200], [5e-324, 0.0], [1e308, 1e308]]
    rows += [(200 + k, v, 9) for k, v in enumerate(big)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: tuple(x) for x in neighbours.op1_near_vectors(df).collect()}
    near = [x for x in rows if x[2] != 9]
    f32 = lambda xs: [(k, [float(a) for a in np.float32(v)], c) for k, v, c in xs]
    small = spark.createDataFrame(f32(near), "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, neighbours.op1_near_vectors(small).collect())) == brute_vectors(near)
    assert [got[200 + k][1:3] for k in range(6)] == [(2, 200), (1, 201), (2, 200), (1, 201), (2, 200), (0, 205)]


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).standard_normal((5, 16))
    assert np.allclose(np.linalg.norm(neighbours.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(neighbours.hadamard(neighbours.hadamard(x)), x)


def test_recall_of_the_index_at_the_threshold():
    index = neighbours.plan(20_000, 64, 0.98, 1e-6)
    r = np.random.default_rng(8)
    a = r.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((3000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    (oa, la), (ob, lb) = index.buckets(a), index.buckets(b)
    found = [bool(set(oa[i]) & set(lb[i]) or set(ob[i]) & set(la[i])) for i in range(len(a))]
    assert np.mean(found) > 0.999


# ---- 2 ------------------------------------------------------------------


def test_bpe_is_the_library_s(spark, odd, documents):
    import tiktoken

    path, pattern = bpe.rank_file()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for df, rows in ((odd, ODD), (documents, [tuple(r) for r in documents.select("doc_id", "text").collect()])):
        want = []
        for i, t in rows:
            ids = library.encode_ordinary(t or "")
            packed = struct.pack(f"<{len(ids)}I", *ids)
            want.append((str(i), len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2_byte_bpe(df).collect()]
        assert sorted(got) == sorted(want)


def test_single_tree_and_side_by_side_agree():
    path, _ = bpe.rank_file()
    v = bpe._vocabulary(path)
    r = random.Random(3)
    ws = ["".join(r.choice("abceinorst ñß") for _ in range(r.randrange(1, 40))).encode()[:60] for _ in range(400)]
    ids, counts = v.merge_many(ws, 64)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for w, p in zip(ws, parts):
        whole = v.ranks.get(w)
        assert ([whole] if whole is not None else p.tolist()) == bpe.merge(w, v.ranks, v.longest)


def test_ids_as_array(spark):
    path, pattern = bpe.rank_file()
    df = spark.createDataFrame([("hello",), ("",), (None,)], "text string").withColumn("b", bpe.encode("text", path, pattern))
    out = [r.a for r in df.select(bpe.as_array("b").alias("a")).collect()]
    assert out[0] and out[1] == [] and out[2] == []


# ---- 3 and 9 ------------------------------------------------------------


def test_words_are_runs_of_letters_and_digits():
    a = words.word_hashes("Idiot!! the idiot, IDIOT-42 ñandú")
    assert len(a) == 6 and a[0] == a[2] == a[3] and len(set(a.tolist())) == 4
    long = "word " * 200_000
    assert len(words.word_hashes(long)) == 200_000 and len(set(words.word_hashes(long).tolist())) == 1
    assert len(words.word_hashes(None)) == len(words.word_hashes(" ,.")) == 0


def toy(spark, n=400):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        ws = [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(60)) for _ in range(r.randrange(20, 80))]
        for _ in range(3 * bad):
            ws.insert(r.randrange(len(ws)), r.choice(["blockhead", "nincompoop", "blighter"]))
        rows.append((i, " ".join(ws), "en", "s", 1))
        labels.append((i, int(not bad), int(bad)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toy(spark)
    out = toxicity.op3_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert out and np.mean([r.predicted == r.toxic for r in out]) > 0.95 and all(0 <= r.score <= 1 for r in out)


def test_toxicity_learns_verbatim_and_rare_expressions(spark):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(800):
        bad = i % 4 == 0
        lines = [" ".join(r.choice("alpha beta gamma delta epsilon zeta".split()) + str(r.randrange(60)) for _ in range(12)) for _ in range(3)]
        if bad:
            lines.insert(r.randrange(4), "vile wretch begone" if i % 200 else "lousy knave")
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    models = toxicity.fit_models(docs, toxicity.labelled(marks, "toxic"), "text", 4000)
    often, seldom = (models.ratio(words.word_hashes(t)) for t in ("vile wretch begone", "lousy knave"))
    assert often.min() > 1 and 0.2 < seldom.min() <= seldom.max() < often.max()
    out = toxicity.op3_toxicity(docs, marks).join(marks, "doc_id").where("held_out and doc_id % 200 <> 0").collect()
    assert out and all(x.predicted == x.toxic for x in out)


def test_toxicity_odd_cases(spark, odd):
    docs, labels = toy(spark)
    more = docs.unionByName(odd.select(docs.columns))
    nulls = spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 7, 7)], labels.schema)
    out = toxicity.op3_toxicity(more, labels.union(nulls)).collect()
    assert len(out) == more.count() and all(r.score is not None for r in out)
    assert {r.score for r in toxicity.op3_toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.op3_toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark, documents, labels):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.op9_quality(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95


def test_quality_odd_cases(spark, odd, documents, labels):
    more = documents.unionByName(odd.select(documents.columns))
    out = quality.op9_quality(more, labels.union(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema))).collect()
    assert len(out) == more.count() and all(0 <= r.score <= 1 for r in out)
    alone = quality.op9_quality(documents, labels.where("quality = 1")).collect()  # labels 0 are not needed
    assert sorted(map(tuple, alone)) == sorted(map(tuple, quality.op9_quality(documents, labels).collect()))
    assert {r.score for r in quality.op9_quality(documents, labels.where("quality = 0")).collect()} == {0.0}
    assert quality.op9_quality(documents.limit(0), labels.limit(0)).count() == 0


def test_risk_does_not_go_below_zero():
    r = np.random.default_rng(0)
    p, u = r.normal(1, 1, (300, 2)), np.concatenate([r.normal(1, 1, (300, 2)), r.normal(-2, 1, (300, 2))])
    m = quality.learn(p, u, 0.5)
    s = m.score(u)
    assert s[:300].mean() > 0.8 > 0.3 > s[300:].mean()


# ---- 4 ------------------------------------------------------------------


def test_archives_round_trip(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a/\r\nX: 1", big, "e"), (2, None, big, "e"), (3, "http://ü/ 1", "small", "e"), (4, "u", "small", "e"), (5, "u", None, "e"), (6, "u", "", "e")]
    rows += [(7, "u", big, "e"), (7, "u", big, "e"), (None, "u", big, "e"), (8, "u", "ß" * 999, "e"), (9, "u", "ß" * 999, "e"), (10, "u", "z" * 3_000_000, "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op4_warc(df).collect()), key=str)
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        last = max((k for k, _, x, _ in rows if k is not None and x == h), default=None)
        again = len(b) >= 1000 and i is not None and i < last
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None))
    assert got == sorted(want, key=str)
    assert warc.op4_warc(df.limit(0)).count() == 0


def test_archive_files_are_frames_behind_a_dictionary(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    known = warc.dictionary(df)
    manifest = warc.write_archives(warc.revisits(df), f"file://{tmp_path}/w", known, file_bytes=20_000)
    files = manifest.collect()
    assert sum(f.records for f in files) == df.count() and len(files) > 1
    raw = open(files[0].file.removeprefix("file://"), "rb").read()
    kinds = [k for k, _ in warc.frames(io.BytesIO(raw))]
    assert kinds[0] == "skip" and kinds[1:] == ["zstd"] * (files[0].records + 1)
    back = warc.read_archives(manifest).where("record_type = 'response'").select("page_id", F.col("payload").cast("string").alias("html"))
    assert {tuple(r) for r in back.collect()} <= {tuple(r) for r in df.select("page_id", "html").collect()}


def test_archives_are_read_in_several_tasks(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    manifest = warc.write_archives(warc.revisits(df.repartition(6)), f"file://{tmp_path}/w", warc.dictionary(df))
    read = warc.read_archives(manifest, with_payload=False).withColumn("task", F.spark_partition_id())
    assert manifest.count() == 6 and read.count() == df.count() and read.select("task").distinct().count() > 2
    shuffled = warc.revisits(df, most=0).select("page_id", "refers_to")
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, warc.revisits(df).select("page_id", "refers_to").collect()))


@pytest.mark.parametrize("harm", ["length", "digest", "version", "cut", "header"])
def test_broken_records_are_refused(harm):
    good = warc.build("response", "urn:page:1", "1970-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi")
    bad = {
        "length": good.replace(b"\nContent-Length: 40", b"\nContent-Length: 41"),
        "digest": good.replace(b"hi\r\n\r\n", b"ho\r\n\r\n"),
        "version": good.replace(b"WARC/1.1", b"WARC/3.0"),
        "cut": good[:-1],
        "header": good.replace(b"WARC-Date: 1970-01-01T00:00:00Z\r\n", b""),
    }[harm]
    assert warc.parse(good)[0]["warc-type"] == "response"
    assert bad != good
    with pytest.raises(ValueError):
        warc.parse(bad)


def test_a_cut_file_is_refused():
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(b"x" * 1000)
    assert [k for k, _ in warc.frames(io.BytesIO(frame * 2))] == ["zstd"] * 2
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(frame + frame[:-2])))


# ---- 5 ------------------------------------------------------------------


def brute_jaccard(rows, n=5, percent=75):
    upper = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().translate(upper)) if x]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = {i: i for i, _ in rows if i is not None}
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                a, b = rows[i][0], rows[j][0]
                same = len(sets[i] & sets[j])
                if None not in (a, b) and same and 100 * same >= percent * len(sets[i] | sets[j]):
                    label[a] = label[b] = min(label[a], label[b])
    return sorted(((i, len(s), label.get(i)) for (i, _), s in zip(rows, sets)), key=str)


def near_copies(seed=4, groups=14):
    r = random.Random(seed)
    rows, k, common = [], 0, " ".join(f"boiler{i}" for i in range(30))
    for g in range(groups):
        base = [f"g{g}w{r.randrange(30)}" for _ in range(r.choice([3, 5, 8, 30, 90]))]
        for _ in range(r.choice([1, 1, 3, 6])):
            ws = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                ws[r.randrange(len(ws))] = f"new{r.randrange(1000)}"
            rows.append((k, (common + " " if g % 3 == 0 else "") + " ".join(ws)))
            k += 1
    return rows


def test_jaccard_against_brute_force(spark):
    rows = near_copies() + [(1000 + i if i is not None else None, t) for i, t in ODD]
    df = spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, n string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op5_jaccard(df).collect()), key=str)
    assert got == brute_jaccard(rows)
    assert jaccard.op5_jaccard(df.limit(0)).count() == 0


def test_the_matrix_alone_finds_every_link(spark, monkeypatch):
    """Without the first step, all links have to come from the opened groups."""
    monkeypatch.setattr(jaccard, "similar_to_centre", lambda sets: sets.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    rows = near_copies(seed=9, groups=25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.op5_jaccard(df).collect()), key=str) == brute_jaccard(rows)


# ---- 6 ------------------------------------------------------------------


def luhn(s):
    ds = [int(c) for c in reversed(s)]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(ds)) % 10 == 0


def plain_feistel(digits, key, tweak):
    half = len(digits) // 2
    a, b = digits[:half], digits[half:]
    for i in range(pii.ROUNDS):
        text = "\x1f".join([key, tweak, str(len(digits)), str(i), b, key])
        f = int(hashlib.sha256(text.encode()).hexdigest()[:15], 16) % 10 ** len(a)
        a, b = b, str((int(a) + f) % 10 ** len(a)).zfill(len(a))
    return a + b


def test_unseparated_phones_and_ibans_before_other_words(spark):
    found = {
        "+15551234567": "phone", "+4915112345678": "phone", "+49 151 12345678": "phone", "+49 30 123 45678": "phone", "+33 1 23 45 67 89": "phone",
        "+44 (0)20 7946 0958": "phone", "+47123456": "phone", "+1 (555) 123-4567": "phone",
        "GB82 WEST 1234 5698 7654 32": "iban", "BE68 5390 0754 7034": "iban", "AT61 1904 3002 3457 3201": "iban", "DE89370400440532013000": "iban",
    }
    ends = ("", " 2024", " OK", " 5 items", ".")
    rows = [(f"{v}|{e}", f"call {v}{e}") for v in found for e in ends]
    rows += [("two", "BE68 5390 0754 7034 4111 1111 1111 1111"), ("few", "+1234567"), ("day", "+15551234567 2024-01-02")]
    out = {r.doc_id: r for r in pii.op6_pii(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for v, kind in found.items():
        for e in ends:
            r = out[f"{v}|{e}"]
            assert r.kinds == [kind] and v not in r.text and len(r.text) == len(f"call {v}{e}"), (v, e, r)
            if kind == "iban":
                assert r.text.endswith(e) and r.text[5:7] == v[:2]
                flat = r.text[5 : len(r.text) - len(e)].replace(" ", "")
                assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert out["+15551234567|"].text[5:7] == "+1" and out["+4915112345678|"].text[5:8] == "+49"
    assert out["two"].kinds == ["iban", "card"] and out["few"].kinds == [] and out["day"].kinds == ["phone", "date"]


def test_pseudonyms(spark):
    card = "4845168114407329"
    text = (
        f"Card {card}, 4845-1681-1440-7329, order 4845168114407328. Call +1 (017) 555-7713 or +1 (017) 555-7713! Mail der.55@mail4.example.com; "
        'SSN 123-45-6789, no 000-12-3456. At 97.51.17.173 not 300.1.2.3. Born 1985-02-28 = 28.02.1985, not 1985-02-30. GB82 WEST 1234 5698 7654 32 '
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962".'
    )
    df = spark.createDataFrame([(1, text, "c"), (2, f"again {card}", "c"), (3, None, "c"), (4, "clean 12 of 30", "c"), (5, "", "c")], "doc_id long, text string, kinds string")
    out = {r.doc_id: r for r in pii.op6_pii(df, "k").collect()}
    new = out[1].text
    assert out[3].text is None and out[4].text == "clean 12 of 30" and out[5].text == "" and out[4].n_private == 0
    assert out[1].kinds == ["card", "card", "phone", "phone", "email", "ssn", "ip", "date", "date", "iban", "secret"]
    for kept in ("order 4845168114407328", "000-12-3456", "300.1.2.3", "1985-02-30", "+1 (", "@mail4.example.com", "clean"[:0]):
        assert kept in new
    for gone in (card, "555-7713", "der.55@", "123-45-6789", "97.51.17.173", "1985-02-28", "28.02.1985", "WEST 1234", "04dbebab91ab"):
        assert gone not in new
    cards = re.findall(r"Card (\d{16}), ([\d-]{19}),", new)[0]
    assert luhn(cards[0]) and cards[1].replace("-", "") == cards[0] and out[2].text == f"again {cards[0]}"
    assert cards[0][:15] == plain_feistel(card[:15], "k", "card")
    y, m, d = re.search(r"Born (\d{4})-(\d\d)-(\d\d) = ", new).groups()
    assert f"= {d}.{m}.{y}," in new
    iban = re.search(r"[A-Z]{2}\d\d(?: [A-Z0-9]{1,4})+(?= token)", new)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pii.op6_pii(df.limit(0)).count() == 0


def test_long_names_and_all_kinds_of_secrets(spark):
    """No greatest length, and extra columns of any name."""
    r = random.Random(2)
    digits = "".join(r.choice("0123456789abcdef") for _ in range(160))
    name, key = "n" * 70 + ".x", "sk-Zx91qL_0pTr7vWn2"
    texts = [f'token = "{digits}"', f"write to {name}@mail.example.com", f'api_key = "{key}"', f"again api_key: '{key}'", "password: correct horse battery", f"x {'long ' * 50_000} token={digits.upper()} {name}@b.example"]
    df = spark.createDataFrame([(i, t, "f", "g") for i, t in enumerate(texts)], "doc_id long, text string, found string, gaps string")
    out = {x.doc_id: x for x in pii.pseudonymise(df, "k").collect()}
    assert [out[i].kinds for i in range(6)] == [["secret"], ["email"], ["secret"], ["secret"], [], ["secret", "email"]]
    assert out[0].found == "f" and out[0].gaps == "g" and out[4].text == texts[4]
    new = re.fullmatch(r'token = "([0-9a-f]{160})"', out[0].text)[1]
    assert new != digits and f"token={new.upper()} user" in out[5].text and len(out[5].text) < len(texts[5])
    other = re.fullmatch(r'api_key = "([a-z]{2}-[A-Z][a-z]\d\d[a-z][A-Z]_\d[a-z][A-Z][a-z]\d[a-z][A-Z][a-z]\d)"', out[2].text)[1]
    assert other != key and out[3].text == f"again api_key: '{other}'" and name not in out[1].text


def test_permutations_are_one_to_one(spark):
    df = spark.range(1000).select("id", F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert df.select(pii.permute_digits(F.col("d"), "k", "t").alias("x")).distinct().count() == 1000
    pair = df.where("id < 77").select(pii.permute_pair(F.floor(F.col("id") / 11), F.col("id") % 11, 7, 11, "k", "t").alias("x"))
    assert pair.distinct().count() == 77 and pair.where("x.a between 0 and 6 and x.b between 0 and 10").count() == 77


# ---- 7 ------------------------------------------------------------------


def plain_places(ws, phrase):
    """Every start of a key phrase, tried word by word."""
    follows = lambda p, q: q == len(phrase.words) or any(ws[e] == phrase.words[q] and follows(e, q + 1) for e in range(p + 1, min(p + 2 + phrase.gap, len(ws))))
    return [p for p in range(len(ws)) if ws[p] == phrase.words[0] and follows(p, 1)]


def plain_licences(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = [(p, label) for phrase, label in licences.BASE.items() for p in range(len(ws)) if ws[p : p + len(phrase.split())] == phrase.split()]
    labels, score = {x for _, x in base}, 0.0
    coded = [w.encode() for w in ws]
    for t in licences.parsed():
        first, *others = [(p, plain_places(coded, p)) for p in t.phrases]
        if any(all(any(abs(b - a - p.distance) <= p.slack for b in at) for p, at in others) for a in first[1]):
            labels.add(t.label)
            score = max(score, len(t.distinct & set(coded)) / len(t.distinct))
    places = [p for p, _ in base]
    return (len(ws), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score)


def licence_files():
    """Whole texts, texts with a foreign word in each key phrase, with two at one place, with a key phrase far off or absent."""
    fill = lambda n: " ".join(f"fill{i}" for i in range(n))
    out = []
    for label, text in licences.TEMPLATES:
        keys = re.findall(r"\[(.*?)\]", text, re.S)
        whole = re.sub(r"[\[\]]", " ", text)
        out.append(f"{fill(3)} {whole} {fill(2)} {whole}")
        for foreign in ("xx", "xx yy"):
            out.append(re.sub(r"\[(.*?)\]", lambda m: " ".join([*m[1].split()[:2], foreign, *m[1].split()[2:]]), text, flags=re.S))
        out += [f" {fill(300)} ".join(keys), " ".join(reversed(keys)), re.sub(r"\[[^\]]*\]$", "", text.strip().rstrip("."))]
    return out


def test_whole_licences_and_changed_ones():
    index = licences.Index(0, {})
    for (label, text), t in zip(licences.TEMPLATES, licences.parsed()):
        ws = licences.words(text)
        assert ws == t.words and label in index.scan([b"x", *ws])["labels"].split(",") and index.scan(ws)["score"] == 1.0
    mit = licences.TEMPLATES[2][1]
    labels = lambda text: index.scan(licences.words(text))["labels"]
    assert labels(mit.replace("free of charge", "entirely free of any charge").replace("obtaining", "who obtains")) == ""
    assert labels(mit.replace("free of charge", "free of all charge")) == "mit"
    assert labels("gnu lesser general public license") == "lgpl" and labels("gnu some public license") == ""


def test_licences_against_a_plain_scan(spark, odd):
    more = ["Released under the MIT License. under the mit license", "LICENSED!! UNDER!! THE!! APACHE!! LICENSE!! VERSION!! 2.0", "CC-BY-NC 4.0", "the gnu general public license, version 3"]
    rows = [(i, t) for i, t in ODD if t is None or len(t) < 5000] + [(100 + i, t) for i, t in enumerate(more + licence_files())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licences.op7_licences(df).collect()), key=str)
    assert got == sorted(((str(i), *plain_licences(t)) for i, t in rows), key=str)
    assert licences.op7_licences(odd).count() == len(ODD) and licences.op7_licences(odd.limit(0)).count() == 0


def test_licences_against_the_sql(spark):
    rows = [(i, t) for i, t in enumerate(licence_files())]
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text"])
    con.register("documents", frame)
    want = con.execute(ORACLE_SQL["op7_licences"]).fetchall()
    columns = [c[0] for c in con.description]
    got = licences.op7_licences(spark.createDataFrame(rows, "doc_id long, text string")).select(columns).collect()
    clean = lambda row: tuple(None if v is None or v != v else v for v in row)
    assert sorted(map(clean, got), key=str) == sorted(map(clean, want), key=str)


# ---- 8 ------------------------------------------------------------------


def test_leaks_and_paraphrases(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("aeioubdfglmnprst") for _ in range(r.randrange(3, 9)))
    items = [(i, " ".join(word() for _ in range(r.randrange(14, 50))) + ". " + " ".join(word() for _ in range(4)) + ".") for i in range(40)]
    docs = [(i, " ".join(word() for _ in range(r.randrange(30, 300)))) for i in range(120)]
    want = set()
    for k in range(0, 40, 2):
        i, ws = k, docs[k][1].split()
        at = r.randrange(len(ws))
        item = items[k][1].upper() if k % 4 else items[k][1]
        if k % 8 == 6:  # a paraphrase: one word in nine is another
            parts = item.split()
            for j in range(4, len(parts) - 5, 9):
                parts[j] = word()
            item = " ".join(parts)
        docs[i] = (i, " ".join(ws[:at] + [item] + ws[at:]))
        want.add((i, k))
    docs += [(500, None), (501, ""), (None, items[1][1]), (502, items[3][1]), (502, items[3][1])]
    bench = items + [(90, None), (91, ""), (92, "too short"), (3, items[3][1])]
    d = spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id long, text string, overlap double")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.op8_decontamination(d, b).collect()}
    assert got == want | {(None, 1), (502, 3)}
    assert decontaminate.op8_decontamination(d, b.limit(0)).count() == 0 and decontaminate.op8_decontamination(d.limit(0), b).count() == 0
    blocks = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(d, b, block=10).collect()}
    assert blocks == got


def brute_leaks(docs, items, weight, share=0.7, loose=0.5, answer=0.8):
    """The rule at every place of every text, without retrieval."""
    known = [decontaminate.Item(i, t, weight) for i, t in items if t and len(words.word_hashes(t))]
    out = set()
    for d, t in docs:
        w = words.word_hashes(t)
        for x in known:
            n = len(x.words)
            for s in np.flatnonzero(np.isin(w, x.words)):
                around = w[max(0, s - n) : s + decontaminate.WINDOW + n]
                if n < decontaminate.MIN_WORDS:
                    held = any(np.array_equal(around[k : k + n], x.words) for k in range(len(around) - n + 1))
                elif x.within(around) < loose:
                    continue
                else:
                    whole, end = x.overlap(around)
                    held = whole >= share or (whole >= loose and end >= answer)
                if held:
                    out.add((d, x.id))
                    break
    return out


def paraphrased(seed, every, short):
    """Documents, items, of these some short; each item once with a word in ``every`` replaced, and some hosts without any."""
    r = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "is", "it", "on"]
    word = lambda: r.choice(common) if r.random() < 0.35 else "".join(r.choice("aeioubdfglmnprst") for _ in range(r.randrange(3, 9)))
    items, docs = [], []
    for k in range(60):
        n = r.randrange(3, 12) if short else r.randrange(15, 60)
        items.append((k, " ".join("".join(r.choice("aeioubdfglmnprst") for _ in range(6)) if short else word() for _ in range(n)) + "."))
        ws = items[-1][1].rstrip(".").split()
        for j in range(r.randrange(every), len(ws), every):
            ws[j] = word()
        host = [word() for _ in range(r.randrange(20, 200))]
        at = r.randrange(len(host))
        docs.append((k, " ".join(host[:at] + ws + host[at:])))
    return docs + [(100 + k, " ".join(word() for _ in range(120))) for k in range(60)], items


@pytest.mark.parametrize("every", [3, 4, 6])
def test_recall_of_leaks_against_the_rule_everywhere(spark, every):
    docs, items = paraphrased(every, every, False)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items, decontaminate.word_rarity(d, "text", 1 << 20))
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(d, b).collect()}
    assert len(want) >= (10 if every == 3 else 35) and got <= want and len(got) >= 0.99 * len(want)
    if every == 4:
        assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(d, b, exact=True).collect()} == want


def test_share_of_an_item_s_words_needs_no_sort_of_them(monkeypatch):
    r = np.random.default_rng(1)
    weight = np.abs(r.standard_normal(1 << 10)).astype(np.float32)
    text = lambda n: " ".join(f"w{k}" for k in r.integers(0, 40, n))
    cases = [(decontaminate.Item(k, text(1 + k), weight), words.word_hashes(text(n))) for k in range(30) for n in (0, 3, 50)]
    want = [float(x.weight[np.isin(x.words, w)].sum() / x.weight.sum()) for x, w in cases]
    monkeypatch.setattr(decontaminate.np, "isin", None)
    monkeypatch.setattr(decontaminate.np, "unique", None)
    assert [x.within(w) for x, w in cases] == want


def test_short_items_are_found(spark):
    docs, items = paraphrased(5, 1000, True)
    docs += [(200, " ".join(["w"] * 30) + " " + items[0][1] + " " + "far away " * 60_000), (None, items[1][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(d, b).collect()}
    assert got == brute_leaks(docs, items, decontaminate.word_rarity(d, "text", 1 << 20)) and {(200, 0), (None, 1)} < got


def stretched(seed=3):
    """Each item once with a foreign word after every one of its words, so that half of each passage is foreign, and hosts without any."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubdfglmnprst") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(r.randrange(12, 40)))) for k in range(25)]
    host = lambda n: " ".join(word() for _ in range(n))
    docs = [(k, f"{host(30)} {' '.join(f'{x} {word()}' for x in text.split())} {host(30)}") for k, text in items]
    return docs + [(100 + k, host(100)) for k in range(25)], items


def test_leaks_whose_passages_are_half_foreign_are_found(spark):
    docs, items = stretched()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items, decontaminate.word_rarity(d, "text", 1 << 20))
    assert len(want) == 25
    for way in ({}, {"exact": True}, {"block": 10}):
        assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(d, b, **way).collect()} == want


def test_spans_hold_all_that_the_rule_looks_at(monkeypatch):
    """Whatever is held around a place is held in a span of the text, however few sums are taken at once."""
    r = np.random.default_rng(4)
    weight = np.abs(r.standard_normal(1 << 10)).astype(np.float32) + 0.1
    text = lambda n: " ".join(f"w{k}" for k in r.integers(0, 60, n))
    items = [decontaminate.Item(k, text(n), weight) for k, n in enumerate([1, 3, 4, 5, 8, 11, 12, 16, 17, 30, 70, 300])]
    texts = [words.word_hashes(t) for t in ("", text(1), text(7), "", text(40), text(90), text(700), text(3000), "")]
    space = decontaminate.Space(items, weight, 0.55, 0.5)
    found = sorted(space.spans(texts))
    for t, w in enumerate(texts):
        for k, x in enumerate(items):
            n = len(x.words)
            mine = [(a, e) for u, j, a, e in found if (u, j) == (t, k)]
            for s in range(len(w)):
                low, high = max(0, s - n), min(len(w), s + decontaminate.WINDOW + n)
                if x.within(w[low:high]) >= 0.5:
                    assert any(a <= low and high <= e for a, e in mine)
    monkeypatch.setattr(decontaminate, "_SCORES", 50)
    assert sorted(space.spans(texts)) == found


# ---- 10 -----------------------------------------------------------------


def test_pages_give_their_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    texts = {r.page_id: r.text for r in extract.op10_html(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"</?(?:p|h1)>", "\0", re.search(r"(?s)<article>(.*?)</article>", r.html)[1])
        want = (" ".join(unescape(s).split()) for s in re.sub("<[^>]*>", " ", body).split("\0"))
        assert texts[r.page_id] == "\n".join(x for x in want if x)


def test_labelled_pages_are_learnt_and_odd_pages_do_no_harm(spark):
    odd = [None, "", "   ", "just text", "<p>a<p>b", "<article><p>In &amp; out, &copy; of it all.", "<!-- never", "<script>x", "<div " + "a" * 20_000, "<" * 5000, "<p>" * 20_000 + "deep"]
    df = spark.createDataFrame([(i, None, h, "t") for i, h in enumerate(odd)], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in extract.op10_html(df).collect()}
    assert len(out) == len(odd) and out[0].text == "" and out[5].text == "In & out, © of it all." and out[5].n_chars == 22
    assert extract.op10_html(df.limit(0)).count() == 0
    model = extract.train(extract.labelled_pages(df.limit(0), "page_id", "html", 10, 1000))
    for page in extract.LABELLED:
        blocks = extract.leaf_blocks(page)
        assert model.decode(blocks) == [b.label for b in blocks]


def test_innermost_ancestors_of_deep_pages_count():
    many = [a + b for a in "qwxz" for b in "abcdefghijklmnopqrstuvwxyz"]
    page = "".join(f"<div class='{w}'>" for w in many) + f"<p>Story.</p><nav class='{' '.join(many[:9])} late'><ul><li>Home</ul></nav>"
    story, menu = extract.leaf_blocks(page)
    assert {"t:nav", "t:ul", "c:late", *(f"c:{w}" for w in many)} <= set(menu.above) and "t:nav" not in story.above
    assert extract.leaf_blocks(page, {"t:nav", "c:late"})[1].above == ("t:nav", "c:late")


def test_long_attributes_and_classes(spark):
    many = " ".join(f"w{i}" for i in range(12))
    page = f"<article><p title=\"{'a > b ' * 1000}\" data-x='1'>Body text here, of some length, with an end.</p><p>Next one.</p><div class='{many} comments'><p>Great.</p></div></article>"
    blocks = extract.leaf_blocks(page)
    assert [b.text for b in blocks] == ["Body text here, of some length, with an end.", "Next one.", "Great."]
    assert "c:comments" in blocks[2].above and "c:comments" not in blocks[0].above
    assert [b.text for b in extract.leaf_blocks("<p a='>one</p><p b=\"x>two</p>")] == ["one", "two"]


def test_viterbi_against_all_labelings():
    import itertools

    model = extract.Chain({"p:p": 0.3, "p:div": -0.7, "p:li": 0.1}, [[0.2, -0.4], [-0.3, 0.5]], -0.2)
    page = "".join(f"<{t}>x</{t}>" for t in ("p", "div", "li", "p", "div", "p"))
    blocks = extract.leaf_blocks(page)
    node = [sum(model.weights.get(f, 0) for f in extract.features(b, i, len(blocks))) for i, b in enumerate(blocks)]

    def total(y):
        return sum(s for s, v in zip(node, y) if v) + (model.start if y[0] else 0) + sum(model.turn[a][b] for a, b in zip(y, y[1:]))

    best = max(itertools.product([0, 1], repeat=len(blocks)), key=total)
    assert [int(x) for x in model.decode(blocks)] == list(best)
