"""Conversations brought to the form system? (user assistant)+ by their cheapest edits.

A row is blank, a duplicate (role and text stood before), truncated (its last
character that is no white space is none of ``.!?``) or sound; the first fault
that applies counts. Edits, by initial: Delete (4, the only one for blank and
duplicate rows), Insert an empty user or assistant turn (3), Keep (0), Rerole to
user or assistant (3); a truncated row that stays costs 3 more. Among the
cheapest sequences of initials the ASCII-least counts; it fixes all roles, as
after each turn only one role but "system" can follow.

The search is iterative-deepening A*: depth first in ASCII order of the edits,
under a cost bound that grows to the least cost that went beyond it, until a
path is accepted. The estimate of the rest is what blank, duplicate and
truncated rows cost at least, and the heaviest choice of disjoint neighbours
whose roles do not fit, each of which asks for an edit of its own. States
(row, last role) that failed are kept with the cost that they are known to
need, so that no later path enters them with less.

Rows are range partitioned by conversation, turn and content, so a conversation
of any length spans tasks; they are cut there in runs of at most ``RUN`` rows.
A conversation of one run is searched at once. For a longer one each run is
searched from every role to every role, in parallel; then the cheapest chain of
runs is chosen from these small tables. Two paths of a run from the same role
differ within the run, so ties are decided run by run. The text of a
conversation passes through one task as a stream, where a digest of it is asked
for; that task holds one Arrow batch.

Cases: nulls are read as one space, so a null text is blank, and rows without a
conv_id are one conversation (conv_id null); rows of equal turn come in the
order of a hash of role and text, null turns first; repeated rows are
duplicates; a table without rows gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from cellstrata.llm.memory import tidy
from cellstrata.plans.lineage import written

RUN = 32
WHITE = " \t\n\v\f\r"
#: Last role: none yet, system, user, assistant; and what closes a conversation after it.
STATES = "^sua"
CLOSING = {"^": 0, "s": 6, "u": 3, "a": 0}
NEXT = {"^": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
INFINITE = 1 << 60


# ---- the search ---------------------------------------------------------


def _fits(state: str, initial: str) -> bool:
    return initial == NEXT[state] or (state == "^" and initial == "s")


class Search:
    """Cheapest, then ASCII-least edits of a run of ``(initial, fault)`` pairs.

    ``leave`` None closes the conversation, by inserts after the last row too;
    a state is one to be in right after the last row.
    """

    def __init__(self, codes: str, leave: str | None = None):
        self.rows = list(zip(codes[::2], codes[1::2]))
        self.leave = leave
        self.n = len(self.rows)
        self.need: dict[tuple[int, str], int] = {}
        self.path: list[str] = []
        self.forced = [0] * (self.n + 1)
        self.ahead = [self.n] * (self.n + 1)  # the next row that may stay
        self.pairs = [0] * (self.n + 2)  # heaviest disjoint misfits from such a row on
        for i in range(self.n - 1, -1, -1):
            initial, fault = self.rows[i]
            may_stay = fault in "kt"
            self.forced[i] = self.forced[i + 1] + (TRUNCATED if fault == "t" else 0 if may_stay else DELETE)
            self.ahead[i] = i if may_stay else self.ahead[i + 1]
            if may_stay:
                j = self.ahead[i + 1]
                misfit = initial != (leave or "a") if j == self.n else initial not in "sua" or not _fits(initial, self.rows[j][0])
                both = self._light(i) if j == self.n else min(self._light(i), self._light(j))
                self.pairs[i] = max(self.pairs[j], misfit * both + (self.pairs[self.ahead[j + 1]] if j < self.n else 0))
            else:
                self.pairs[i] = self.pairs[i + 1]

    def _light(self, i: int) -> int:
        """The least that an edit of the row adds to what is forced: a truncated one saves by its deletion."""
        return DELETE - TRUNCATED if self.rows[i][1] == "t" else INSERT

    def estimate(self, i: int, state: str) -> int:
        j = self.ahead[i]
        if (self.leave == "^" and state != "^") or (self.leave == "s" and state in "ua"):
            return INFINITE
        if j == self.n:
            if self.leave is None:
                return self.forced[i] + CLOSING[state]
            return self.forced[i] + (0 if state == self.leave else INFINITE if i == self.n else INSERT)
        misfit = 0 if _fits(state, self.rows[j][0]) else self._light(j)
        return self.forced[i] + max(self.pairs[j], misfit + self.pairs[self.ahead[j + 1]])

    def edits(self, i: int, state: str) -> Iterator[tuple[str, int, int, str]]:
        """``(initial, cost, next row, next state)`` in ASCII order."""
        follow = NEXT[state]
        if i < self.n:
            yield "D", DELETE, i + 1, state
        if i < self.n or self.leave is None:
            yield "I", INSERT, i, follow
        if i < self.n and self.rows[i][1] in "kt":
            initial, fault = self.rows[i]
            more = TRUNCATED if fault == "t" else 0
            if _fits(state, initial):
                yield "K", more, i + 1, initial
            yield "R", REROLE + more, i + 1, follow

    def _within(self, i: int, state: str, budget: int) -> int:
        """Cost of an accepting path within the budget, left in ``path``; else a cost beyond it that is needed at least."""
        least = max(self.estimate(i, state), self.need.get((i, state), 0))
        if least > budget:
            return least
        if i == self.n and (CLOSING[state] == 0 if self.leave is None else state == self.leave):
            return 0
        least = INFINITE
        for edit, cost, j, then in self.edits(i, state):
            self.path.append(edit)
            rest = self._within(j, then, budget - cost)
            if rest <= budget - cost:
                return cost + rest
            self.path.pop()
            least = min(least, cost + rest)
        self.need[i, state] = least
        return least

    def possible(self, state: str) -> bool:
        if self.leave == "^":
            return state == "^"
        return self.leave != "s" or state == "s" or (state == "^" and any(r in (("s", "k"), ("s", "t")) for r in self.rows))

    def run(self, state: str = "^") -> tuple[int, str]:
        """``(cost, initials)`` from a state on; the cost is ``INFINITE`` where no edits lead there."""
        if not self.possible(state):
            return INFINITE, ""
        self.need.clear()
        bound = self.estimate(0, state)
        while True:
            self.path.clear()
            cost = self._within(0, state, bound)
            if cost <= bound:
                return cost, "".join(self.path)
            bound = cost


@lru_cache(maxsize=20_000)
def repaired_at_once(codes: str) -> tuple[int, str]:
    return Search(codes).run()


@lru_cache(maxsize=5_000)
def table_of(codes: str) -> tuple[list[int], list[int], list[str]]:
    """Costs, ranks among the edits from the same state, and initials, for each state before and each after the run."""
    found = [Search(codes, after).run(before) for before in STATES for after in STATES]
    ranks = []
    for k in range(0, len(found), len(STATES)):
        row = [edits for _, edits in found[k : k + len(STATES)]]
        ranks += [sorted(row).index(x) for x in row]
    return [c for c, _ in found], ranks, [e for _, e in found]


def chain(costs: Sequence[Sequence[int]], ranks: Sequence[Sequence[int]]) -> tuple[int, list[int]]:
    """The least cost over runs in order, and for each run the entry of its table that is taken."""
    k = len(STATES)
    rest, choice = [CLOSING[s] for s in STATES], []
    for cost, rank in zip(reversed(costs), reversed(ranks)):
        best = [min(range(k), key=lambda x, e=e: (cost[e * k + x] + rest[x], rank[e * k + x])) for e in range(k)]
        rest = [min(INFINITE, cost[e * k + best[e]] + rest[best[e]]) for e in range(k)]
        choice.append(best)
    at, taken = 0, []
    for best in reversed(choice):
        taken.append(at * k + best[at])
        at = best[at]
    return rest[0], taken


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


# ---- rows ---------------------------------------------------------------


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with planted faults, chosen by crc32(``conv_id:turn``) modulo 20: 0 to 4 drop the row, empty it, take its ``.!?``, repeat it, make it the user's."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    k = F.crc32(F.concat_ws(":", _text("conv_id"), _text("turn"))) % 20
    rows = rows.withColumn("k", k).where("k <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _rows(turns: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, print)``; ``print`` stands for role and text."""
    rows = turns.select(_text("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    return rows.withColumn("print", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _runs(rows: DataFrame, run: int) -> tuple[DataFrame, DataFrame]:
    """``(conv, at, codes)``: runs of rows in order, initial and fault of each; and the rows' own ``(conv, turn)``."""
    end = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    fault = F.when(end == "", "b").when(F.substring(end, -1, 1).isin(*".!?"), "k").otherwise("t")
    own = rows.select("conv", "turn", "print", F.when(initial.isin(*"sua"), initial).otherwise("x").alias("initial"), fault.alias("fault"))
    own = written(own.withColumn("row", F.monotonically_increasing_id()), "turns")
    first = own.where("fault <> 'b'").groupBy("conv", "print").agg(F.min(F.struct("turn", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select("conv", "print", F.col("first.row").alias("first"))
    again = F.col("first").isNotNull() & (F.col("first") != F.col("row"))
    coded = own.join(first, ["conv", "print"], "left").withColumn("code", F.concat("initial", F.when(again, "d").otherwise(F.col("fault"))))

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, now, codes, out = TaskContext.get().partitionId() << 36, None, [], []
        form = pa.schema([("conv", pa.string()), ("at", pa.int64()), ("codes", pa.string())])
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), form)], schema=form)
        for batch in batches:
            for conv, code in zip(*(c.to_pylist() for c in batch.columns)):
                if codes and (conv != now or len(codes) == run):
                    out.append((now, place, "".join(codes)))
                    place, codes = place + 1, []
                now = conv
                codes.append(code)
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if codes:
            out.append((now, place, "".join(codes)))
        if out:
            yield batch_of(out)

    order = ["conv", "turn", "print", "row"]
    ranged = coded.select(*order, "code").repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "code")
    return written(ranged.mapInArrow(cut, "conv string, at long, codes string"), "runs"), own.select("conv", "turn")


def _at_once(codes: str):
    cost, audit = repaired_at_once(codes)
    faults = codes[1::2]
    return cost, audit, faults.count("b"), faults.count("d"), faults.count("t"), illegal_pairs(codes[::2])


def _chained(runs: list):
    """Of ``(at, costs, ranks, initials)`` in order: the cost, misfits within and between runs, and the entries taken."""
    cost, taken = chain([r["costs"] for r in runs], [r["ranks"] for r in runs])
    between = sum(illegal_pairs(a["last"] + b["first"]) for a, b in zip(runs, runs[1:]))
    return cost, between + sum(r["illegal"] for r in runs), taken


def plans(turns: DataFrame, run: int = RUN) -> DataFrame:
    """``(conv, gaps, cost, audit, blank, duplicate, truncated, illegal)`` of every conversation that has rows.

    ``conv`` is conv_id as text, one space for null.
    """
    at_once = F.udf(_at_once, "cost long, audit string, blank long, duplicate long, truncated long, illegal long", useArrow=True)
    table = F.udf(table_of, "costs array<long>, ranks array<int>, edits array<string>", useArrow=True)
    chosen = F.udf(_chained, "cost long, illegal long, taken array<int>", useArrow=True)
    misfits = F.udf(lambda codes: illegal_pairs(codes[::2]), "long", useArrow=True)
    runs, own = _runs(_rows(turns), run)
    each = runs.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max("codes").alias("codes"))
    short = each.where("n = 1").select("conv", at_once("codes").alias("p")).select("conv", "p.*")
    long = runs.join(each.where("n > 1").select("conv"), "conv", "left_semi")
    faults = lambda c: (F.length("codes") - F.length(F.replace("codes", F.lit(c)))).cast("long")
    tables = written(
        long.select(
            "conv", "at", "codes", faults("b").alias("blank"), faults("d").alias("duplicate"), faults("t").alias("truncated"), misfits("codes").alias("illegal"),
            F.substring("codes", 1, 1).alias("first"), F.substring("codes", -2, 1).alias("last"), table("codes").alias("t"),
        ).select("*", "t.*").drop("t", "codes"),
        "tables",
    )
    small = F.sort_array(F.collect_list(F.struct("at", "costs", "ranks", "illegal", "first", "last")))
    chained = tables.groupBy("conv").agg(small.alias("r")).select("conv", F.col("r.at").alias("places"), chosen("r").alias("c"))
    taken = chained.select("conv", F.col("c.cost").alias("cost"), F.col("c.illegal").alias("misfits"), F.explode(F.arrays_zip("places", F.col("c.taken").alias("taken"))).alias("x"))
    taken = taken.select("conv", "cost", "misfits", F.col("x.places").alias("at"), F.col("x.taken").alias("taken"))
    last = F.sort_array(F.collect_list(F.struct("at", "edit", "after")))
    parts = taken.join(tables, ["conv", "at"]).withColumns({"edit": F.element_at("edits", F.col("taken") + 1), "after": F.col("taken") % len(STATES)})
    joined = parts.groupBy("conv").agg(
        F.max("cost").alias("cost"), last.alias("e"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")], F.max("misfits").alias("illegal")
    )
    closing = F.create_map(*[x for k, s in enumerate(STATES) for x in (F.lit(k), F.lit("I" * (CLOSING[s] // INSERT)))])
    audit = F.concat(F.array_join("e.edit", ""), closing[F.element_at("e.after", -1)])
    joined = joined.select("conv", "cost", audit.alias("audit"), "blank", "duplicate", "truncated", "illegal")
    span = F.try_subtract(F.max("turn"), F.min("turn")) + 1 - F.count_distinct("turn")
    gaps = own.groupBy("conv").agg(F.when(F.count("turn") == 0, 0).otherwise(span).cast("long").alias("gaps"))
    return short.unionByName(joined).join(gaps, "conv")


def repaired_turns(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """``(conv, place, turn, role, text, edit)`` of the repaired conversations, by the ``audit`` of ``plans``.

    The rows of a conversation stand together and in order within a partition.
    Inserted turns have an empty text and no number.
    """
    lead = planned.select("conv", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("print"))
    both = _rows(turns).withColumn("tag", F.lit(1)).unionByName(lead)
    both = both.repartition("conv").sortWithinPartitions("conv", "tag", "turn", "print").select("conv", "tag", "turn", "role", "text")
    form = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    @tidy
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, k, place, state, out, size = None, "", 0, 0, "^", [], 0

        def put(turn, role, text, edit):
            nonlocal place, size, state
            out.append((conv, place, turn, role, text, edit))
            place, size, state = place + 1, size + 100 + len(text), role[:1] if edit == "K" else NEXT[state]

        def inserts():
            nonlocal k
            while audit[k : k + 1] == "I":
                put(None, ROLES[NEXT[state]], "", "I")
                k += 1

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), form)], schema=form)

        for batch in batches:
            for own, tag, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if tag == 0:
                    inserts()
                    conv, audit, k, place, state = own, text, 0, 0, "^"
                    continue
                inserts()
                edit, k = audit[k], k + 1
                if edit != "D":
                    put(turn, role if edit == "K" else ROLES[NEXT[state]], text, edit)
                if size >= 4 << 20:
                    yield batch_of()
                    out.clear()
                    size = 0
        inserts()
        if out:
            yield batch_of()

    return both.mapInArrow(apply, "conv string, place long, turn long, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)``: SHA-256 of each conversation's ``role:text``, newline-joined, over rows as ``repaired_turns`` gives them."""
    form = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])

    @tidy
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, out = None, None, []
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now:
                    if h is not None:
                        out.append((now, h.hexdigest()))
                    now, h = conv, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], schema=form)
                out = []
        if h is not None:
            out.append((now, h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], schema=form)

    return repaired.select("conv", "role", "text").mapInArrow(hashed, "conv string, repaired_sha256 string")


def op11_repair(conversations: DataFrame) -> DataFrame:
    """Damage the conversations, repair them; a row for every original conv_id."""
    turns = damage(conversations)
    planned = written(plans(turns), "plans")
    found = planned.join(digests(repaired_turns(turns, planned)), "conv", "left")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", _text("conv_id"))
    numbers = [F.coalesce(c, F.when(F.col("audit").isNull(), 0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return ids.join(found, "conv", "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
