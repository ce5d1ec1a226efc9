"""The prefix trie against dictionaries of whole prefixes, totals against sums over paths."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cellstrata.llm import trie


def sign_mod(a, b):
    return a - b * int(a / b) if abs(a) < 2**50 else (abs(a) % b) * (1 if a >= 0 else -1)


def brute(rows):
    """Nodes of ``(conv_id, turn, role, text)``, in plain Python."""
    convs = {c: [] for c, *_ in rows if c is not None}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn, role or "", text or ""))
    for own in convs.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = [x[1:] for x in convs.get(c - sign_mod(c, 100), [])[:h]] + [x[1:] for x in own[h:]]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(whole[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", 1) for r in rows], "conv_id long, turn long, role string, text string, v string, depth int")


@pytest.fixture(scope="module")
def odd():
    r = random.Random(5)
    say = ["a", "b", "", None, "漢字", "🙂"]
    rows = [(c, t, r.choice(["user", "assistant", None, ""]), r.choice(say)) for c in [*range(120), 200, 250, 299, -7, -107, -100, 2**40] for t in range(r.randrange(1, 8))]
    rows += [(300, t, "user", f"{t % 3}") for t in range(90)] + [(301, t, "user", f"{t % 3}") for t in range(60)]
    rows += [(400, None, "user", "x"), (400, None, "user", "y"), (400, 1, "user", "x"), (400, 1, "user", "x"), (None, 1, "user", "x"), (None, None, None, None)]
    rows += [(c, t, "user", "same") for c in range(500, 560) for t in range(4)] + [(600, 0, "user", "long " * 100_000)]
    return rows


def test_against_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    got = sorted((tuple(r) for r in trie.op12_prefix_trie(frame(spark, odd).repartition(5)).collect()), key=str)
    assert got == brute(odd)


def test_given_table_and_empty_one(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = sorted((tuple(r) for r in trie.op12_prefix_trie(table).collect()), key=str)
    assert got == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert trie.op12_prefix_trie(table.limit(0)).count() == 0


def test_contraction_of_any_forest(spark, monkeypatch):
    """Long chains, stars and random trees in few rounds; totals are sums over paths to the root."""
    r = random.Random(2)
    parent = {0: None, 1000: None}
    for k in range(1, 200):
        parent[k] = k - 1  # a chain
    for k in range(200, 320):
        parent[k] = r.choice([199, 0, r.randrange(k)])
    for k in range(1001, 1060):
        parent[k] = 1000  # a star
    depth, total = {}, {}
    for k in parent:
        depth[k] = 0 if parent[k] is None else depth[parent[k]] + 1
    for k in parent:
        at = k
        while at is not None:
            x, y = total.get(at, (0, 0))
            total[at], at = (x + k, y + 1), parent[at]
    n = {k: sum(p == k for p in parent.values()) for k in parent}
    tree = spark.createDataFrame([(k, parent[k], depth[k], n[k], k, 1) for k in parent], "v long, p long, depth long, n long, x long, y long")
    rounds = []
    monkeypatch.setattr(trie, "written", lambda df, name="t", own=trie.written: (rounds.append(name), own(df, name))[1])
    got = {r.v: (r.x, r.y) for r in trie.subtree_totals(tree, ["x", "y"]).collect()}
    assert got == total
    assert rounds.count("raked") <= 20


def test_end_digests_in_pieces(spark):
    ends = spark.range(10_000).select(F.lit(3).cast("long").alias("depth"), (F.col("id") % 2).alias("a"), F.lit(0).cast("long").alias("b"), F.col("id").alias("conv_id"))
    got = {r.a: r.ends_sha256 for r in trie.end_digests(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, range(k, 10_000, 2))).encode()).hexdigest() for k in (0, 1)}


def test_sql_of_the_query(odd):
    import duckdb
    import pandas as pd

    from cellstrata.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    columns = dict(zip(("conv_id", "turn", "role", "text"), zip(*odd)))
    con.register("rows", pd.DataFrame({k: pd.array(v, "Int64" if k in ("conv_id", "turn") else object) for k, v in columns.items()}))
    con.execute("create view conversations as select conv_id::bigint as conv_id, turn::bigint as turn, role, text from rows")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(con.execute(f"select {', '.join(names)} from ({ORACLE_SQL['op12_prefix_trie']})").fetchall(), key=str) == brute(odd)
