"""The prefix trie of conversations, and totals over its subtrees by parallel tree contraction.

Turns are range partitioned by conversation, number and content and get their
places from counts of the partitions, so a conversation of any length spans
tasks. A prefix is named by its depth and 128 bits, two exclusive-or sums of
hashes of (depth, SHA-256 of role and text), which are running sums over blocks
of ``BLOCK`` turns and over blocks. What shares a name is a node; members are
counted by partial sums, so a prefix that a third of all conversations share is
gathered nowhere.

Contraction works on all nodes in each round: leaves give their totals to their
parents (rake); of the unary nodes that remain, those with coin 1 whose only
child has coin 0 are taken out and their sums go onto the edge below (compress).
Coins are the bits of the depth, so a chain of any length halves in each round;
when these are used up, hashes. Then what was taken out is expanded again: each
such node points to the child below it, pointers are doubled until they reach a
raked node, and the sums on the way are added to its total.

Cases: a null role or text is empty; null turns come first, equal ones in the
order of a hash of role and text; rows without a conv_id belong to no
conversation and are left out; repeated rows are turns of their own; an empty
table has no node. Other columns are ignored. Of a negative conv_id c, c % 100
has the sign of c.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cellstrata.llm.memory import tidy
from cellstrata.plans.lineage import written

BLOCK = 1024
GROUP, MOST = 100, 6


# ---- turns --------------------------------------------------------------


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, print, points)``: places from 1, a hash of role and text, code points of the text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    flat = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")), 256)).alias("print"),
        F.length(text("text")).cast("long").alias("points"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "print", "row"]
    ranged = flat.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.select("conv_id", "print", "points", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    firsts = ranged.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    firsts = firsts.select("conv_id", "part", (F.col("first") - before - 1).alias("zero"))
    return ranged.join(firsts, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("zero")).alias("place"), "print", "points")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first of their hundred: ``(conv_id, length)`` and ``(conv_id, depth, print, points)``.

    Of ``ordered_turns``, conversation c takes the first h = crc32(c) % 6 turns
    of c - c % 100, then its own from place h + 1 on.
    """
    turns = written(turns, "places")
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < MOST)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "print", "points"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumns({"h": (F.crc32(F.col("conv_id").cast("string")) % MOST).cast("int"), "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    convs = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice(F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(b"").alias("print"), F.lit(0).cast("long").alias("points"))), 1, 0))
    convs = convs.select("conv_id", "n", "h", head.alias("head"))
    convs = written(convs.withColumn("m", F.size("head")), "conversations")
    first = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.print", "t.points")
    own = turns.join(convs.select("conv_id", "h", "m"), "conv_id").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("depth"), "print", "points")
    return convs.select("conv_id", (F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).cast("long").alias("length")), first.unionByName(own)


# ---- nodes --------------------------------------------------------------


def named(turns: DataFrame) -> DataFrame:
    """``turns`` with ``a, b``, the name of the prefix that ends here, and ``pa, pb``, that of the prefix before."""
    step = turns.withColumns({c: F.xxhash64(F.lit(k), "depth", "print") for k, c in enumerate("xy")}).withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    sums = step.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "xy"])
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    step = step.withColumns({f"{c}1": F.bit_xor(c).over(within) for c in "xy"}).join(sums, ["conv_id", "block"])
    step = step.withColumns({"a": F.col("x0").bitwiseXOR(F.col("x1")), "b": F.col("y0").bitwiseXOR(F.col("y1"))})
    step = step.withColumns({"pa": F.col("a").bitwiseXOR(F.col("x")), "pb": F.col("b").bitwiseXOR(F.col("y"))})
    return step.select("conv_id", "depth", "points", "a", "b", "pa", "pb")


def nodes_of(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``(depth, a, b, conv_id, n_convs, points, parent_conv_id)`` of each distinct prefix of ``named`` turns, and of the root."""
    own = prefixes.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("points", "pa", "pb")])
    zero = lambda c: F.lit(0).cast("long").alias(c)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero("depth"), zero("a"), zero("b"), "conv_id", "n_convs", zero("points"), zero("pa"), zero("pb"))
    own = written(own.unionByName(root), "nodes")
    above = own.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    return own.join(above, ["depth", "pa", "pb"], "left").drop("pa", "pb")


# ---- contraction --------------------------------------------------------


def subtree_totals(tree: DataFrame, values: Sequence[str]) -> DataFrame:
    """``(v, *values)``: sums over each node's subtree, itself included.

    ``tree`` has rows ``(v, p, depth, n, *values)``: node, parent (null for
    roots), a depth that grows downward, number of children, own values.
    """
    add = [f"add_{c}" for c in values]
    live = written(tree.select("v", "p", "depth", "n", *[F.lit(0).cast("long").alias(a) for a in add], *[F.col(c).cast("long").alias(c) for c in values]), "live")
    most = live.agg(F.max("depth")).first()[0]
    bits, r, done, spliced = int(most or 0).bit_length(), 0, [], []

    def coin(v: str, depth: str) -> Column:
        return F.shiftright(depth, r).bitwiseAND(1) if r < bits else F.pmod(F.xxhash64(F.lit(r), v), F.lit(2))

    while not live.isEmpty():
        leaf = F.col("n") == 0
        done.append(live.where(leaf).select("v", *values))
        # rake: what leaves give, and how many other children there are
        given = [F.sum(F.when(leaf, F.col(c) + F.col(a)).otherwise(0)).alias(f"given_{c}") for c, a in zip(values, add)]
        kid = F.max(F.when(~leaf, F.struct(F.col("depth"), F.col("v"), *add))).alias("kid")
        said = live.where("p is not null").groupBy("p").agg(F.count(F.when(~leaf, 1)).alias("left"), kid, *given).withColumnRenamed("p", "v")
        rest = live.where(~leaf).join(said, "v").withColumns({c: F.col(c) + F.col(f"given_{c}") for c in values})
        # compress: unary nodes with coin 1 above a child with coin 0
        out = F.coalesce((F.col("left") == 1) & F.col("p").isNotNull() & (coin("v", "depth") == 1) & (coin("kid.v", "kid.depth") == 0), F.lit(False))
        rest = rest.select("v", "p", "depth", F.col("left").alias("n"), *add, *values, "kid", out.alias("out"))
        rest = written(rest, "raked")
        gone = rest.where("out")
        spliced.append(gone.select("v", F.col("kid.v").alias("c"), *[(F.col(c) + F.col(f"kid.{a}")).alias(c) for c, a in zip(values, add)]))
        moved = gone.select(F.col("kid.v").alias("v"), F.col("p").alias("up"), *[(F.col(c) + F.col(a)).alias(f"more_{a}") for c, a in zip(values, add)])
        live = rest.where("not out").drop("out", "kid").join(moved, "v", "left")
        more = [(F.col(a) + F.coalesce(f"more_{a}", F.lit(0))).alias(a) for a in add]
        live = written(live.select("v", F.coalesce("up", "p").alias("p"), "depth", "n", *more, *values), "live")
        r += 1
    if not done:
        return tree.select("v", *values)
    raked, jump = written(reduce(DataFrame.unionByName, done), "raked"), written(reduce(DataFrame.unionByName, spliced), "spliced")
    for _ in range(len(spliced).bit_length()):
        onward = jump.select(F.col("v").alias("c"), F.col("c").alias("c2"), *[F.col(x).alias(f"{x}2") for x in values])
        jump = jump.join(onward, "c", "left").select("v", F.coalesce("c2", "c").alias("c"), *[(F.col(x) + F.coalesce(f"{x}2", F.lit(0))).alias(x) for x in values])
        jump = written(jump, "spliced")
    below = raked.select(F.col("v").alias("c"), *[F.col(x).alias(f"{x}2") for x in values])
    return raked.unionByName(jump.join(below, "c").select("v", *[(F.col(x) + F.col(f"{x}2")).alias(x) for x in values]))


# ---- members that end at a node -----------------------------------------


def end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, a, b, ends_sha256)`` of rows ``(depth, a, b, conv_id)``: SHA-256 of the ids in ascending order, comma-joined.

    Ids are range partitioned and joined into texts of some thousand where they
    are; one task then reads these texts of a node as a stream.
    """
    names = ["depth", "a", "b"]
    some = pa.schema([*[(c, pa.int64()) for c in [*names, "first"]], ("ids", pa.string())])
    final = pa.schema([*[(c, pa.int64()) for c in names], ("ends_sha256", pa.string())])
    batch_of = lambda rows, form: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), form)], schema=form)

    @tidy
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, out = None, [], []
        for batch in batches:
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (node != now or len(ids) >= 4096):
                    out.append((*now, ids[0], ",".join(map(str, ids))))
                    ids = []
                now = node
                ids.append(conv)
            if out:
                yield batch_of(out, some)
                out = []
        if ids:
            yield batch_of([(*now, ids[0], ",".join(map(str, ids)))], some)

    @tidy
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, out = None, None, []
        for batch in batches:
            for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node == now:
                    h.update(b",")
                else:
                    if h is not None:
                        out.append((*now, h.hexdigest()))
                    now, h = node, hashlib.sha256()
                h.update(ids.encode())
            if out:
                yield batch_of(out, final)
                out = []
        if h is not None:
            yield batch_of([(*now, h.hexdigest())], final)

    order = [*names, "conv_id"]
    texts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "depth long, a long, b long, first long, ids string")
    return texts.repartition(*names).sortWithinPartitions(*names, "first").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def op12_prefix_trie(conversations: DataFrame) -> DataFrame:
    """Rebuild the conversations, name their prefixes, total the subtrees; a row for every node."""
    convs, turns = rebuilt(ordered_turns(conversations))
    prefixes = written(named(turns), "prefixes")
    nodes = nodes_of(convs, prefixes)
    at_end = prefixes.join(convs, "conv_id").where("depth = length").select("depth", "a", "b", "conv_id")
    zero = lambda c: F.lit(0).cast("long").alias(c)
    ends = end_digests(at_end.unionByName(convs.where("length = 0").select(zero("depth"), zero("a"), zero("b"), "conv_id")))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["depth", "conv_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).join(ends, ["depth", "a", "b"], "left")
    nodes = written(nodes.withColumn("v", F.struct("depth", "conv_id")), "nodes")
    parent = F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")))
    own = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("points")}
    totals = subtree_totals(nodes.select("v", parent.alias("p"), "depth", F.col("n_children").alias("n"), *[c.alias(k) for k, c in own.items()]), list(own))
    return nodes.join(totals, "v").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *own, F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )
