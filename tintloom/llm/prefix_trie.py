"""The trie of conversation prefixes, by partition refinement.

All conversations begin in one class. Turn by turn the active classes, those of several different conversations, are
split by what the turn says; a class of one conversation is retired and emits the rest of it as a chain of nodes with
one child each. Then the nodes are folded back, from the deepest turn of the active classes to the root. A round is a
few jobs over the members of active classes, and there are as many rounds as the deepest turn that two different
conversations share: conversations that are equal to their end are one member that counts for all of them, so copies
cost no rounds.

A conversation is an ordered sequence of (role, text). Turns are ordered by turn (null first), role and a hash of the
text; rows that repeat are turns that repeat. Null roles and texts are empty. Rows with a null conv_id belong to no
conversation and are left out. An empty table gives an empty result, not even a root. Texts are known by two 64-bit
hashes, and are never moved. Only the four named columns are read, whatever other columns there are.

Skew: a conversation of any length is numbered in blocks by range, its rows are joined with its figures by broadcast
where it is long, and so are the members of a large class with theirs.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, join_by_key, materialize, small_batches, table

#: Rows of a block within which turns are numbered.
BLOCK = 50_000
#: Conversations whose ids differ by their last so many bits are joined into one string at a time.
ID_BITS = 12
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def numbered(conversations: DataFrame) -> DataFrame:
    """Rows (conv, pos, t1, t2, bytes, cum): pos from 1; t1 and t2 stand for role and text; cum: bytes so far."""
    said = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(NO_ID)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    key = ["conv", "turn", "role", "t1", "t2"]
    slim = said.select("conv", "turn", "role", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2"), F.octet_length("text").cast("long").alias("bytes"))
    slim = materialize(slim.groupBy(*key, "bytes").agg(F.count("*").alias("copies")), "turns")
    n = max(1, -(-slim.count() // BLOCK))
    blocks = materialize(slim.repartitionByRange(n, *key).withColumn("part", F.spark_partition_id()), "blocks")
    before = Window.partitionBy("part", "conv").orderBy(*key[1:]).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    inner = blocks.withColumns({"n_in": zero(F.sum("copies").over(before)), "bytes_in": zero(F.sum(F.col("copies") * F.col("bytes")).over(before))})
    sums = blocks.groupBy("part", "conv").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("bytes")).alias("bytes"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", "conv", zero(F.sum("n").over(earlier)).alias("n_before"), zero(F.sum("bytes").over(earlier)).alias("bytes_before"))
    each = inner.join(starts, ["part", "conv"]).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("conv", (F.col("n_before") + F.col("n_in") + F.col("k")).alias("pos"), "t1", "t2", "bytes", (F.col("bytes_before") + F.col("bytes_in") + F.col("k") * F.col("bytes")).alias("cum"))


def shared_openings(turns: DataFrame, *, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that they share openings: (turns as of ``numbered``, rows (conv, len, total)).

    Of conversation c the first h = crc32(c) % most turns become those of c - c % family (fewer, if that has fewer; the remainder isn't
    negative).
    len: turns, total: bytes of the rebuilt conversation.
    """
    turns = materialize(turns, "numbered")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    dropped = F.col("pos") <= h
    own = turns.groupBy("conv").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.when(dropped, 1)).alias("n_less"), F.sum(F.when(dropped, F.col("bytes")).otherwise(0)).alias("less"))
    own = materialize(own.withColumns({"h": h, "base": F.col("conv") - F.pmod("conv", F.lit(family))}), "convs")
    opening = turns.where(F.col("pos") < most).withColumnRenamed("conv", "base")
    begun = materialize(own.select("conv", "h", "base").join(opening, "base").where(F.col("pos") <= F.col("h")), "openings")
    taken = begun.groupBy("conv").agg(F.count("*").alias("p"), F.sum("bytes").alias("p_bytes"))
    p, p_bytes = F.coalesce("p", F.lit(0)), F.coalesce("p_bytes", F.lit(0))
    shift = materialize(own.join(taken, "conv", "left").select("conv", "h", "n", (p - F.col("n_less")).alias("by"), (p_bytes - F.col("less")).alias("bytes_by"), "bytes"), "shifts")
    rest = join_by_key(turns, shift.drop("bytes"), ["conv"], "n").where(F.col("pos") > F.col("h"))
    rest = rest.select("conv", (F.col("pos") + F.col("by")).alias("pos"), "t1", "t2", "bytes", (F.col("cum") + F.col("bytes_by")).alias("cum"))
    heads = shift.select("conv", (F.col("n") + F.col("by")).alias("len"), (F.col("bytes") + F.col("bytes_by")).alias("total"))
    return begun.select(*rest.columns).unionByName(rest), heads


def _members(turns: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal conversations: rows (conv, rep), and rows (rep, m, len, total); rep: the smallest of m that are equal."""
    at = ("pos", "t1", "t2")
    marks = turns.groupBy("conv").agg(F.bit_xor(F.xxhash64(*at)).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), *at)).alias("x2"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    marked = materialize(heads.join(marks, "conv", "left").select("conv", "len", "total", zero("x1"), zero("x2")), "marked")
    same = materialize(marked.groupBy("len", "total", "x1", "x2").agg(F.min("conv").alias("rep"), F.count("*").alias("m")), "equal")
    members = join_by_key(marked, same, ["len", "total", "x1", "x2"], "m").select("conv", "rep")
    return members, same.select("rep", "m", "len", "total")


def _ends(members: DataFrame) -> DataFrame:
    """Rows (rep, ends_sha256): the hash of the ids of equal conversations, joined by commas.

    Ids are joined in ranges of 2**ID_BITS; the strings of a group with several are hashed one after the other, as
    a stream, so that no list is held.
    """
    small_batches(members.sparkSession)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    chunks = members.groupBy("rep", F.shiftright("conv", ID_BITS).alias("range")).agg(ids.alias("ids"))
    chunks = materialize(chunks, "ends")
    several = chunks.groupBy("rep").count().where("count > 1").select("rep")
    alone = chunks.join(several, "rep", "left_anti").select("rep", F.sha2("ids", 256).alias("ends_sha256"))

    def run(batches):
        rep, state = None, None
        for batch in batches:
            done = []
            for now, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if now != rep:
                    if state:
                        done.append((rep, state.hexdigest()))
                    rep, state = now, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([s for _, s in done], pa.string())], names=["rep", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], names=["rep", "ends_sha256"])

    streamed = chunks.join(several, "rep", "left_semi").repartition("rep").sortWithinPartitions("rep", "range").select("rep", "ids")
    return alone.unionByName(streamed.mapInArrow(run, "rep long, ends_sha256 string"))


def trie(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows of ``NODES`` and ends_sha256, one for each node. turns: as of ``numbered``; heads: rows (conv, len, total).

    saved_tokens is summed over a node's subtree: for each node, bytes of its last text, for all members but one.
    """
    heads = materialize(heads, "heads")
    n_convs, least = heads.agg(F.count("*"), F.min("conv")).first()
    turns = materialize(turns, "rebuilt")
    members, reps = _members(turns, heads)
    reps = materialize(reps, "reps")
    seqs = materialize(join_by_key(turns.withColumnRenamed("conv", "rep"), reps, ["rep"], "len"), "sequences")
    root = F.lit(least).cast("long")
    # level by level: the members of classes of several conversations
    active = materialize(reps.select("rep", root.alias("cls"), "len"), "active")
    ended = [active.where("len = 0").select("rep", F.col("cls").alias("conv_id"), F.lit(0).cast("long").alias("depth"))]
    levels, depth = [], 0
    while active.limit(1).count():
        depth += 1
        turn = materialize(active.select("rep", "cls").join(seqs.where(F.col("pos") == depth), "rep"), "turn")
        highest = lambda c: F.max(c).alias(c)
        split = turn.groupBy("cls", "t1", "t2").agg(F.min("rep").alias("conv_id"), F.count("*").alias("k"), F.sum("m").alias("n_convs"), *map(highest, ("bytes", "m", "cum", "total", "len")))
        split = materialize(split, "split")
        levels.append(split)
        before, active = active, materialize(join_by_key(turn.select("rep", "cls", "t1", "t2", "len"), split.where("k > 1").select("cls", "t1", "t2", "conv_id", "k"), ["cls", "t1", "t2"], "k").select("rep", F.col("conv_id").alias("cls"), "len"), "active")
        ended.append(active.where(F.col("len") == depth).select("rep", F.col("cls").alias("conv_id"), F.lit(depth).cast("long").alias("depth")))
    # classes of one conversation: what follows the turn at which they were retired is a chain
    retired = None
    for at, split in enumerate(levels, 1):
        own = split.where("k = 1").select(F.col("conv_id").alias("rep"), F.lit(at).cast("long").alias("at"), F.col("len").alias("times"))
        retired = own if retired is None else retired.unionByName(own)
    left = (F.col("m") - 1) * (F.col("total") - F.col("cum") + F.col("bytes"))
    one = F.lit(1).cast("long")
    parts = []
    if retired is not None:
        retired = materialize(retired, "retired")
        chain = join_by_key(seqs, retired, ["rep"], "times").where(F.col("pos") > F.col("at"))
        parts.append(chain.select(F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("m").alias("n_convs"), (F.col("pos") < F.col("len")).cast("long").alias("n_children"), one.alias("n_leaves"), left.alias("saved_tokens")))
        ended.append(join_by_key(reps, retired.withColumn("one", one), ["rep"], "one").select("rep", F.col("rep").alias("conv_id"), F.col("len").alias("depth")))
    # folding back
    below = None
    for at in range(len(levels), 0, -1):
        node = levels[at - 1]
        node = node.join(_folded(below), "conv_id", "left") if below is not None else node.withColumns({c: F.lit(None).cast("long") for c in ("children", "leaves", "saved")})
        single = F.col("k") == 1
        node = node.select(
            "conv_id",
            F.lit(at).cast("long").alias("depth"),
            F.col("cls").alias("parent_conv_id"),
            "n_convs",
            F.when(single, (F.col("len") > at).cast("long")).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"),
            F.coalesce("leaves", one).alias("n_leaves"),
            F.when(single, left).otherwise((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        )
        below = materialize(node, "nodes")
        parts.append(below)
    null = F.lit(None).cast("long")
    if n_convs:
        # all nodes of the first level are the root's children
        top = below if below is not None else heads.sparkSession.range(0).select(null.alias("n_leaves"), null.alias("saved_tokens"))
        top = top.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        parts.append(top.select(root.alias("conv_id"), F.lit(0).cast("long").alias("depth"), null.alias("parent_conv_id"), F.lit(n_convs).cast("long").alias("n_convs"), "n_children", F.coalesce("leaves", one).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens")))
    else:
        parts.append(heads.sparkSession.range(0).select(*(null.alias(c) for c in NODES)))
    nodes, where = parts[0], ended[0]
    for more in parts[1:]:
        nodes = nodes.unionByName(more)
    for more in ended[1:]:
        where = where.unionByName(more)
    marks = _ends(members).join(where, "rep").drop("rep")
    return nodes.join(marks, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def _folded(nodes: DataFrame) -> DataFrame:
    """What the children of each node add up to."""
    return nodes.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def op12_prefix_trie(spark, sf_dir):
    return trie(*shared_openings(numbered(table(spark, sf_dir, "conversations"))))
