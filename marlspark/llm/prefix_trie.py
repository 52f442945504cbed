"""The prefix trie of conversations, by partition refinement.

All conversations start as one class; turn by turn a class splits by the next
turn's role and text, and a class is a node. A class of one sequence is retired:
the rest of its turns are a unary chain, written straight from its rows. Then
counts of children, leaves and tokens saved are folded back to their ancestors.

What bounds the work:

* Copies are folded first: equal sequences are one with a multiplicity, so that
  a class of copies is a singleton, and only sequences that differ are split.
* A class is named by its depth and the running exclusive-or of two 64-bit
  hashes of (depth, turn), so that a round splits by several turns: 8, then 16,
  32, up to 256. Rounds grow with the logarithm of the longest prefix that two
  different sequences share; a window holds a round's turns of one sequence.
* A node's own value is put to its smallest member, which is a member of all its
  ancestors. Folding back is then a sum over a class's members, without those
  values that its smallest member has higher up: no pass for each level.
* Turns are ordered by ranges (`global_rank`); sums along a chain go by blocks
  of BLOCK turns; members are joined to texts of at most RUN ids before a
  node's hash reads them in order. No conversation, class or group of copies is
  gathered in a task.

Defined results: rows with a null conv_id belong to no conversation; equal turn
numbers (null is the lowest) go by a hash of role and text, and repeated rows
are turns of their own; a null role or text is empty. No conversations, no
nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from .common import bounded, drop, materialize, pick

FIRST, MOST, BLOCK, RUN = 8, 256, 4096, 50_000
#: Conversations of so many ids in a row share their first turns.
FAMILY, SHARED = 100, 6

NODE = ("depth", "y1", "y2")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), two hashes of role and text, and the text's characters, stored."""
    c = pick(conversations, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = c.select("conv_id", "turn", F.xxhash64(role, text).alias("x1"), F.xxhash64(F.lit(1), text, F.lit(2), role).alias("x2"), F.length(text).cast("bigint").alias("chars"))
    ranked = global_rank(slim, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("x1"), F.col("x2")], "at")
    first = ranked.groupBy("conv_id").agg(F.min("at").alias("start"))
    return materialize(ranked.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("start") + 1).alias("pos"), "x1", "x2", "chars"), "turns")


def rebuilt(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n_turns) and their turns (conv_id, depth, x1, x2, chars): the first turns are the family's, as many as a hash of the id says."""
    sizes = ordered.groupBy("conv_id").agg(F.max("pos").alias("n"))
    of = F.col("conv_id")
    c = sizes.select("conv_id", "n", (F.crc32(of.cast("string")) % SHARED).alias("h"), (of - F.pmod(of, F.lit(FAMILY))).alias("base"))
    heads = sizes.filter(of % FAMILY == 0).select(of.alias("base"), F.col("n").alias("n_base"))
    c = c.join(heads, "base", "left").withColumn("given", F.least("h", F.coalesce("n_base", F.lit(0))))
    c = c.select("conv_id", "base", "h", "given", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    own = ordered.join(c, "conv_id").filter("pos > h").select("conv_id", (F.col("given") + F.col("pos") - F.col("h")).alias("depth"), "x1", "x2", "chars")
    head = ordered.filter((F.col("pos") < SHARED) & (of % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    lent = c.filter("given > 0").select("conv_id", "base", "given").join(head, "base").filter("pos <= given").select("conv_id", F.col("pos").alias("depth"), "x1", "x2", "chars")
    return c.select("conv_id", "n_turns"), own.unionByName(lent)


def _ids_joined(pairs: DataFrame) -> DataFrame:
    """Of pairs (rep, conv_id): rep, at and ids, the decimal ids in order, at most RUN in a row."""
    ordered = pairs.select("rep", "conv_id").repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")

    def run(batches):
        rep, ids = None, []
        out: tuple[list, list, list] = ([], [], [])

        def put():
            out[0].append(rep), out[1].append(ids[0]), out[2].append(",".join(map(str, ids)))

        for b in batches:
            for r, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (r != rep or len(ids) >= RUN):
                    put()
                    ids = []
                rep = r
                ids.append(i)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["rep", "at", "ids"])
                out = ([], [], [])
        if ids:
            put()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["rep", "at", "ids"])

    return ordered.mapInArrow(run, "rep bigint, at bigint, ids string")


def ends(members: DataFrame, groups: DataFrame) -> DataFrame:
    """rep and ends_sha256 of groups of copies (rep, m, sequence's key): a hash of all members' ids in order, which one task reads as joined runs of them."""
    several = groups.filter("m > 1").select("rep", "n_turns", "d1", "d2")
    runs = _ids_joined(members.join(several, ["n_turns", "d1", "d2"]))

    def run(batches):
        rep, h = None, None
        for b in batches:
            reps, shas = [], []
            for r, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if r != rep or h is None:
                    if h is not None:
                        reps.append(rep), shas.append(h.hexdigest())
                    rep, h = r, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if reps:
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(shas, pa.string())], names=["rep", "ends_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([h.hexdigest()], pa.string())], names=["rep", "ends_sha256"])

    hashed = runs.repartition("rep").sortWithinPartitions("rep", "at").select("rep", "ids").mapInArrow(run, "rep bigint, ends_sha256 string")
    return hashed.unionByName(groups.filter("m = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("ends_sha256")))


def refine(groups: DataFrame, steps: DataFrame) -> list[DataFrame]:
    """Rounds of splitting, stored: for each sequence and turn while its class has others, and for all turns of the round in which it is left alone, the node, its parent (q1, q2) and n_seq, the sequences in its class.

    groups: rep, m, n_turns. steps: rep, depth, p1, p2 (hashes of depth and turn), chars.
    """
    active = groups.select("rep", "m", "n_turns", F.lit(0).cast("bigint").alias("o1"), F.lit(0).cast("bigint").alias("o2")).filter("n_turns > 0")
    rounds: list[DataFrame] = []
    depth, width = 0, FIRST
    while True:
        part = steps.filter((F.col("depth") > depth) & (F.col("depth") <= depth + width)).join(active, "rep")
        w = Window.partitionBy("rep").orderBy("depth")
        for o, p, y, q in (("o1", "p1", "y1", "q1"), ("o2", "p2", "y2", "q2")):
            part = part.withColumn(y, F.col(o).bitwiseXOR(F.expr(f"bit_xor({p})").over(w))).withColumn(q, F.lag(y).over(w))
            part = part.withColumn(q, F.coalesce(q, o))
        path = part.select("rep", "m", "n_turns", *NODE, "q1", "q2", "chars")
        alone = path.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_seq"))
        rounds.append(materialize(path.join(alone, [*NODE]), "round"))
        depth, width = depth + width, min(2 * width, MOST)
        active = rounds[-1].filter((F.col("depth") == depth) & (F.col("n_seq") > 1) & (F.col("n_turns") > depth)).select("rep", "m", "n_turns", F.col("y1").alias("o1"), F.col("y2").alias("o2"))
        if active.isEmpty():
            return rounds


def _suffix(chain: DataFrame) -> DataFrame:
    """With `below`, the characters from each turn of a chain (rep, depth, chars) to its end: sums within blocks, and of later blocks."""
    c = chain.withColumn("block", F.floor(F.col("depth") / BLOCK))
    later = Window.partitionBy("rep").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = c.groupBy("rep", "block").agg(F.sum("chars").alias("all")).withColumn("later", F.coalesce(F.sum("all").over(later), F.lit(0))).drop("all")
    here = Window.partitionBy("rep", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.join(sums, ["rep", "block"]).withColumn("below", F.sum("chars").over(here) + F.col("later")).drop("block", "later")


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, n_turns) with turns (conv_id, depth from 1, x1, x2, chars)."""
    spark = convs.sparkSession
    bounded(spark)
    at = F.col("depth")
    rows = materialize(rows.select("conv_id", "depth", F.xxhash64(at, "x1", "x2").alias("p1"), F.xxhash64("x2", at, "x1", F.lit(3)).alias("p2"), "chars"), "rows")
    digest = rows.groupBy("conv_id").agg(F.expr("bit_xor(p1)").alias("d1"), F.expr("bit_xor(p2)").alias("d2"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    members = materialize(convs.join(digest, "conv_id", "left").select("conv_id", "n_turns", zero("d1"), zero("d2")), "members")
    groups = materialize(members.groupBy("n_turns", "d1", "d2").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("m")), "groups")
    steps = materialize(rows.withColumnRenamed("conv_id", "rep").join(groups.select("rep"), "rep", "left_semi"), "steps")
    drop(spark, rows)
    rounds = refine(groups, steps)
    paths = reduce(DataFrame.unionByName, rounds)

    # where a sequence is left alone its chain begins
    begins = paths.filter("n_seq = 1").groupBy("rep").agg(F.min(F.struct("depth", "q1", "q2")).alias("b")).select("rep", F.col("b.depth").alias("begin"), "b.q1", "b.q2")
    begins = materialize(begins, "begins")
    chain = materialize(steps.join(begins, "rep").filter("depth >= begin").join(groups.select("rep", "m", "n_turns"), "rep").select("rep", "depth", "chars", "m", "n_turns", "begin", "q1", "q2"), "chain")
    copied = chain.filter("m > 1")
    saved_below = copied.groupBy("rep").agg(F.sum((F.col("m") - 1) * F.col("chars")).alias("own"))

    shared = paths.filter("n_seq > 1")
    agg = [F.min("rep").alias("conv_id"), F.sum("m").alias("n_convs")]
    nodes = shared.groupBy(*NODE).agg(*agg, F.max("chars").alias("chars"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    nothing = F.lit(0).cast("bigint")
    top = groups.groupBy(nothing.alias("depth"), nothing.alias("y1"), nothing.alias("y2")).agg(*agg, nothing.alias("chars"), F.lit(None).cast("bigint").alias("q1"), F.lit(None).cast("bigint").alias("q2"))
    nodes = materialize(nodes.unionByName(top).withColumn("value", (F.col("n_convs") - 1) * F.col("chars")), "nodes")

    # fold back: what a sequence brings to every class it is in
    owned = nodes.groupBy(F.col("conv_id").alias("rep")).agg(F.sum("value").alias("own")).unionByName(saved_below).groupBy("rep").agg(F.sum("own").alias("own"))
    brings = groups.select("rep").join(owned, "rep", "left").join(begins.select("rep", F.lit(1).alias("leaf")), "rep", "left")
    brings = materialize(brings.select("rep", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "brings")
    sums = [F.sum("own").alias("all"), F.sum("leaf").alias("leaves")]
    inside = shared.select("rep", *NODE).join(brings, "rep").groupBy(*NODE).agg(*sums)
    inside = inside.unionByName(brings.groupBy(nothing.alias("depth"), nothing.alias("y1"), nothing.alias("y2")).agg(*sums))
    above = F.coalesce(F.sum("value").over(Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    one = lambda df, d: df.select((F.col(d) - 1).alias("depth"), F.col("q1").alias("y1"), F.col("q2").alias("y2"))
    children = one(nodes.filter("depth > 0"), "depth").unionByName(one(begins, "begin")).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    ended = groups.join(ends(members, groups), "rep").select("rep", "n_turns", "ends_sha256")
    none = F.lit(hashlib.sha256(b"").hexdigest())

    # the sequence that ends at a shared node is in its class, at its last turn
    last = shared.filter("depth = n_turns").select("rep", *NODE).unionByName(groups.filter("n_turns = 0").select("rep", nothing.alias("depth"), nothing.alias("y1"), nothing.alias("y2")))
    told = last.join(ended.select("rep", "ends_sha256"), "rep").select(*NODE, "ends_sha256")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("y1").alias("q1"), F.col("y2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.withColumn("above", above).join(parents, ["depth", "q1", "q2"], "left").join(inside, [*NODE]).join(children, [*NODE], "left").join(told, [*NODE], "left")
    inner = full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.greatest("leaves", F.lit(1)).alias("n_leaves"),
        (F.col("all") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )

    tails = chain.filter("m = 1").withColumn("below", nothing).unionByName(_suffix(copied))
    begun = begins.select("rep", F.col("begin").alias("depth"), "q1", "q2").join(parents, ["depth", "q1", "q2"]).select("rep", "depth", "parent_conv_id")
    hashes = ended.select("rep", F.col("n_turns").alias("depth"), "ends_sha256")
    final = F.col("depth") == F.col("n_turns")
    outer = tails.drop("q1", "q2").join(begun, ["rep", "depth"], "left").join(hashes, ["rep", "depth"], "left").select(
        F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("begin"), F.col("parent_conv_id")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("m").alias("n_convs"),
        F.when(final, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("m") - 1) * F.col("below")).alias("saved_tokens"), F.when(final, F.col("ends_sha256")).otherwise(none).alias("ends_sha256"),
    )
    return inner.unionByName(outer)


def build(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    ordered = turns(conversations)
    return trie(ordered.groupBy("conv_id").agg(F.max("pos").alias("n_turns")), ordered.withColumnRenamed("pos", "depth"))


def query(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations."""
    return trie(*rebuilt(turns(conversations)))
