"""Operator 12, conversation prefix trie by the Euler-tour technique.

Every distinct sequence of the first d turns (role, text) of a conversation is a node of depth d. A prefix is known by the
exclusive or of 128 bits of hash of its turns, each hashed with its place, so prefixes of long conversations are made
from pieces; a node is the aggregate of the equal prefixes. Each node has an enter and an exit arc. Enter leads to the
first child's enter or the own exit, exit to the next sibling's enter or the parent's exit; children are in the order of
their smallest member. The tour is ranked as a list (tour.py), arcs are placed by rank, and the leaves and savings of a
subtree are differences of prefix sums at the places of its node's two arcs.

Turns are ordered by turn, nulls first; rows of the same turn by role, then by the MD5 of the text; repeated rows stay. A
null role or text counts as empty. Rows without conv_id belong to no conversation and are left out. An empty table gives
no nodes. Extra columns are not read.

A conversation of any length is cut into pieces before it is summed, and a node with any number of members or children is
pre-aggregated; the members that end at a node are joined to one string piece by piece, as their digest is read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import cut, prepare
from podium.llm.tour import BLOCK, list_ranks, numbered, prefix_sums

#: Conversations of one group share the first turns of its first one, up to this many.
GROUP, SHARED = 5, 8
#: Turns of a conversation summed together, as a power of two, and the ids joined to one piece of text.
PIECE_BITS, IDS_BITS = 10, 12
KEY = ["depth", "k1", "k2"]


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, role, digest, size, depth): every turn with its place in its conversation, from 1."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.md5(text.cast("binary")).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    rows = numbered(rows, "conv_id", "turn", "role", "digest")
    first = rows.groupBy("conv_id").agg(F.min("n").alias("first"))
    placed = rows.join(first, "conv_id").withColumn("depth", F.col("n") - F.col("first") + 1)
    return cut(placed.select("conv_id", "role", "digest", "size", "depth"), "turns")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns in order, and (conv_id, n_turns)."""
    rows = in_order(turns)
    return rows, cut(rows.groupBy("conv_id").agg(F.count("*").alias("n_turns")), "conversations")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``as_they_are``, each conversation beginning with turns of the first of its group of GROUP.

    Of h = crc32 of the id modulo SHARED + 1, the first h turns of that one come first, then what the conversation has
    after its own first h.
    """
    rows, convs = as_they_are(turns)
    base = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).alias("h")
    of_base = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base"))
    plan = convs.select("*", base, h).join(of_base, "base", "left")
    own = F.col("base") == F.col("conv_id")
    plan = plan.select(
        "conv_id",
        "base",
        F.when(own, 0).otherwise(F.col("h")).alias("skipped"),
        F.when(own, 0).otherwise(F.least("h", F.coalesce("n_base", F.lit(0)))).alias("given"),
        "n_turns",
    )
    plan = cut(plan.withColumn("n_turns", F.col("given") + F.greatest(F.col("n_turns") - F.col("skipped"), F.lit(0))), "plan")
    names = ["conv_id", "role", "digest", "size", "depth"]
    later = rows.join(plan.select("conv_id", "skipped", "given"), "conv_id").where("depth > skipped")
    later = later.withColumn("depth", F.col("depth") - F.col("skipped") + F.col("given"))
    # at most SHARED turns of each base
    heads = rows.where(F.col("depth") <= SHARED).withColumnRenamed("conv_id", "base")
    heads = heads.join(plan.where("given > 0").select("conv_id", "base", "given"), "base").where("depth <= given")
    return later.select(names).unionByName(heads.select(names)), plan.select("conv_id", "n_turns")


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, size, last) of every prefix but the empty one: its key and its parent's."""
    rows = rows.join(convs, "conv_id").select(
        "conv_id",
        "depth",
        "size",
        (F.col("depth") == F.col("n_turns")).alias("last"),
        F.shiftright("depth", PIECE_BITS).alias("piece"),
        *[F.xxhash64(F.lit(seed), "depth", "role", "digest").alias(f"x{seed}") for seed in (1, 2)],
    )
    rows = cut(rows, "hashed")
    pieces = rows.groupBy("conv_id", "piece").agg(*[F.bit_xor(f"x{k}").alias(f"x{k}") for k in (1, 2)])
    up_to = Window.partitionBy("conv_id").orderBy("piece")
    pieces = pieces.select("conv_id", (F.col("piece") + 1).alias("piece"), *[F.bit_xor(f"x{k}").over(up_to).alias(f"b{k}") for k in (1, 2)])
    inside = Window.partitionBy("conv_id", "piece").orderBy("depth")
    summed = rows.select("*", *[F.bit_xor(f"x{k}").over(inside).alias(f"own{k}") for k in (1, 2)])
    later = summed.where("piece > 0").join(pieces, ["conv_id", "piece"])
    zero = F.lit(0).cast("long")
    summed = later.unionByName(summed.where("piece = 0").select("*", zero.alias("b1"), zero.alias("b2")))
    keys = [F.col(f"own{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"k{k}") for k in (1, 2)]
    found = summed.select("*", *keys)
    parents = [F.col(f"k{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)]
    return cut(found.select("conv_id", *KEY, *parents, "size", "last"), "prefixes")


def nodes_of(found: DataFrame, convs: DataFrame) -> DataFrame:
    """(v, conv_id, depth, k1, k2, p1, p2, n_convs, size): the distinct prefixes, numbered by (conv_id, depth)."""
    nodes = found.groupBy(KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        *[F.max(c).alias(c) for c in ("size", "p1", "p2")],
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in KEY], "conv_id", "n_convs", zero.alias("size"), zero.alias("p1"), zero.alias("p2"))
    nodes = nodes.withColumn("depth", F.col("depth").cast("long")).unionByName(root)
    return cut(numbered(nodes, "conv_id", "depth").withColumnRenamed("n", "v"), "nodes")


def family(nodes: DataFrame) -> DataFrame:
    """Nodes with parent, parent_conv_id, first child, next sibling and n_children."""
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("v").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
    )
    tree = cut(nodes.join(above, ["depth", "p1", "p2"], "left"), "tree")
    # children of one parent follow each other in this order
    children = cut(numbered(tree.where("parent is not null").select("parent", "v"), "parent", "v"), "children")
    after = children.select(F.col("parent").alias("after"), F.col("v").alias("sibling"), (F.col("n") - 1).alias("n"))
    siblings = children.join(after, "n").where("parent = after").select("v", "sibling")
    kids = children.groupBy(F.col("parent").alias("v")).agg(F.min("v").alias("child"), F.count("*").alias("n_children"))
    return cut(tree.join(siblings, "v", "left").join(kids, "v", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "family")


def arcs_of(tree: DataFrame) -> DataFrame:
    """(id, follows): the enter arc of node v is 2 v, its exit arc 2 v + 1."""
    enter, leave = F.col("v") * 2, F.col("v") * 2 + 1
    into = F.coalesce(F.col("child") * 2, leave)
    out = F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1, F.lit(-1))
    pair = F.array(F.struct(enter.alias("id"), into.alias("follows")), F.struct(leave.alias("id"), out.alias("follows")))
    return tree.select(F.inline(pair))


def subtree_sums(tree: DataFrame, count: int, block: int) -> DataFrame:
    """(v, n_leaves, saved_tokens) of every node's subtree."""
    ranks = list_ranks(arcs_of(tree), 2 * count, block)
    own = tree.select("v", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    arcs = ranks.select((F.lit(2 * count) - F.col("rank")).alias("place"), F.shiftright("id", 1).alias("v"), (F.col("id") % 2 == 0).alias("enters"))
    arcs = arcs.join(own, "v")
    entered = [F.when(F.col("enters"), F.col(c)).otherwise(0).alias(c) for c in ("leaf", "saved")]
    arcs = cut(arcs.select("place", "v", "enters", *entered, *[e.alias(f"{c}_sum") for e, c in zip(entered, ("leaf", "saved"), strict=True)]), "arcs")
    sums = prefix_sums(arcs, "place", ["leaf_sum", "saved_sum"])

    def difference(name: str) -> Column:
        at_exit = F.max(F.when(~F.col("enters"), F.col(f"{name}_sum")))
        before_enter = F.max(F.when(F.col("enters"), F.col(f"{name}_sum") - F.col(name)))
        return at_exit - before_enter

    return sums.groupBy("v").agg(difference("leaf").alias("n_leaves"), difference("saved").alias("saved_tokens"))


def end_digests(found: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end: SHA-256 of their ids, ascending."""
    zero = F.lit(0).cast("long")
    ends = found.where("last").select(*[F.col(c).cast("long").alias(c) for c in KEY], "conv_id")
    ends = ends.unionByName(convs.where("n_turns = 0").select(*[zero.alias(c) for c in KEY], "conv_id"))
    pieces = ends.groupBy(*KEY, F.shiftright("conv_id", IDS_BITS).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    prepare(found.sparkSession)

    def run(batches):
        node, digest = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if key != node:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            if done:
                yield as_batch(done)
        if node:
            yield as_batch([(*node, digest.hexdigest())])

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*KEY, "ends_sha256"])

    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    return ordered.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of
    every node, of turns in order and (conv_id, n_turns)."""
    found = prefixes(rows, convs)
    nodes = nodes_of(found, convs)
    tree = family(nodes)
    sums = subtree_sums(tree, tree.count(), block)
    ends = end_digests(found, convs)
    result = tree.join(sums, "v").join(ends, KEY, "left")
    return result.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
