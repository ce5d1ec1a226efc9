"""Conversation repair against a plain search for the least (cost, initials)."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from cellstrata.llm import repair

WHITE = " \t\n\v\f\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """Least ``(cost, initials)`` over ``(initial, fault)`` rows, trying at most two inserts before each row."""

    @cache
    def best(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        add = lambda edit, cost, rest: found.append((cost + rest[0], edit + rest[1])) if rest else None
        if inserts < 2:
            add("I", 3, best(i, NEXT[state], inserts + 1))
        if i < len(rows):
            initial, fault = rows[i]
            add("D", 4, best(i + 1, state, 0))
            if fault in "kt":
                more = 3 * (fault == "t")
                if initial == NEXT[state] or (initial == "s" and not state):
                    add("K", more, best(i + 1, initial, 0))
                add("R", 3 + more, best(i + 1, NEXT[state], 0))
        return min(found, default=None)

    return best(0, "", 0)


def brute(rows):
    """Damage and repair of ``(conv_id, turn, role, text)``, in plain Python."""
    convs = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            convs[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        codes, seen = [], set()
        for _, role, text in own:
            end = text.rstrip(WHITE)
            fault = "b" if not end else "d" if (role, text) in seen else "k" if end[-1] in ".!?" else "t"
            seen.add((role, text))
            codes.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault))
        cost, audit = cheapest(codes)
        state, done, left = "", [], iter(own)
        for edit in audit:
            row = None if edit == "I" else next(left)
            if edit != "D":
                state = row[1][:1] if edit == "K" else NEXT[state]
                role = row[1] if edit == "K" else {"u": "user", "a": "assistant"}[state]
                done.append(f"{role}:{row[2] if row else ''}")
        turns = [t for t, *_ in own if t is not None]
        faults = [f for _, f in codes]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in "bdt"),
            sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(codes, codes[1:])),
            cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest(),
        )
    return out


def shapes():
    r = random.Random(4)
    for _ in range(400):
        n = r.randrange(9)
        yield [(r.choice("suuaaax"), r.choice("kkkktbd")) for _ in range(n)]
    yield from ([("u", "k")] * 12, [("a", "t")] * 9, [("s", "k")] * 5, [("x", "k")] * 6, [("u", "b")] * 7, [("s", "t")], [])


def test_search_and_chains():
    for rows in shapes():
        codes = "".join(map("".join, rows))
        want = cheapest(rows)
        assert repair.Search(codes).run() == want
        if len(rows) > 2:  # the same by runs of two or three rows
            runs, at = [], 0
            while at < len(codes):
                step = 4 + 2 * (at % 3 == 0)
                runs.append(codes[at : at + step])
                at += step
            tables = [repair.table_of(c) for c in runs]
            cost, taken = repair.chain([t[0] for t in tables], [t[1] for t in tables])
            last = repair.STATES[taken[-1] % len(repair.STATES)]
            audit = "".join(t[2][k] for t, k in zip(tables, taken)) + "I" * (repair.CLOSING[last] // 3)
            assert (cost, audit) == want


def test_longer_runs_stay_bounded():
    """Runs of the full length, of the shapes with the weakest estimates: the search sees few states."""
    r = random.Random(1)
    for codes in ["uk" * repair.RUN, "at" * repair.RUN, "xk" * repair.RUN, "".join(r.choice("sua") + r.choice("kt") for _ in range(repair.RUN))]:
        search = repair.Search(codes)
        assert search.run() == cheapest(list(zip(codes[::2], codes[1::2])))
        assert len(search.need) <= 4 * (repair.RUN + 1) * 2


@pytest.fixture(scope="module")
def odd():
    r = random.Random(7)
    say = ["Yes.", "No?", "Well", "so it is!", " \t", "", None, "a. \n", "漢字。", "x. "]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "", None, "ux"]), r.choice(say)) for c in range(60) for t in range(r.randrange(1, 12))]
    rows += [(100, None, "user", "Hi."), (100, None, "assistant", "Hi."), (100, None, "user", "Hi."), (101, None, None, None)]
    rows += [(102, 5, "user", "Hi."), (102, 5, "user", "Hi."), (102, 9, "assistant", "Ho."), (None, 1, "user", "Who?"), (None, 2, "assistant", "Me.")]
    rows += [(103, t, "user" if t % 3 else "assistant", f"{t % 40}" + "." * (t % 5 > 0)) for t in range(150)]
    rows += [(104, 0, "user", "long " * 100_000 + ".")]
    rows += [(-7, 2**62, "user", "a."), (-7, 2**62 + 5, "assistant", "b.")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, cost int")


@pytest.mark.parametrize("run", [32, 3])
def test_query_against_brute_force(spark, odd, monkeypatch, run):
    monkeypatch.setattr(repair.plans, "__defaults__", (run,))
    got = {r.conv_id: tuple(r)[1:] for r in repair.op11_repair(frame(spark, odd).repartition(5)).collect()}
    assert got == brute(odd)


def test_given_table_and_empty_one(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in repair.op11_repair(table).collect()}
    assert got == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert repair.op11_repair(table.limit(0)).count() == 0


def test_repaired_rows(spark, odd):
    turns = repair.damage(frame(spark, odd))
    done = repair.repaired_turns(turns, repair.plans(turns).cache())
    roles = done.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "role"))), lambda x: F.substring(x.role, 1, 1)), "").alias("r"))
    assert all(re.fullmatch("s?(ua)+", x.r) for x in roles.collect())
    assert not done.where("edit = 'I' and (text <> '' or turn is not null)").count()


def test_sql_of_the_query(odd):
    import duckdb
    import pandas as pd

    from cellstrata.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    columns = dict(zip(("conv_id", "turn", "role", "text"), zip(*odd)))
    con.register("rows", pd.DataFrame({k: pd.array(v, "Int64" if k in ("conv_id", "turn") else object) for k, v in columns.items()}))
    con.execute("create view conversations as select conv_id::bigint as conv_id, turn::bigint as turn, role, text from rows")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = con.execute(f"select {', '.join(names)} from ({ORACLE_SQL['op11_repair']})").fetchall()
    assert {r[0]: r[1:] for r in got} == brute(odd)
