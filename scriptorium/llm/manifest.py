"""Merkle manifests of a dataset: a tree over each group's rows, one over the groups, and a proof for each row."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Levels that a block reduces at once, and nodes that the driver may be given: the upper tree.
BITS, TOP = 10, 4096
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<before:string,after:string>>"


def leaf_hash(*values: Column) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and itself, or a dash if null."""
    parts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def _digest(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def _next(level: list[str]) -> list[str]:
    return [_digest("".join(level[j : j + 2])) for j in range(0, len(level), 2)]


def _step(level: list[str], at: int) -> tuple[str, str]:
    """What stands before and after a node in its run."""
    return (level[at - 1], "") if at % 2 else ("", level[at + 1] if at + 1 < len(level) else "")


def _reduced(bits: int):
    """A block of up to 2**bits neighbouring nodes: their steps up to the block's node, and that node. A tree's root ends them early."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("i")
        level, count = block["node"].to_pylist(), block["n"][0].as_py()
        levels = []
        while count > 1 and len(levels) < bits:
            levels.append(level)
            level, count = _next(level), (count + 1) // 2
        steps = [_step(own, k >> s) for k in range(block.num_rows) for s, own in enumerate(levels)]
        offsets = pa.array(np.arange(block.num_rows + 1, dtype=np.int32) * len(levels))
        pairs = pa.StructArray.from_arrays([pa.array([x[i] for x in steps], pa.string()) for i in (0, 1)], ["before", "after"])
        return block.append_column("steps", pa.ListArray.from_arrays(offsets, pairs)).append_column("up", pa.array([level[0]] * block.num_rows))

    return run


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with i, their place in their tree t by `order`, and n, the tree's size.

    Rows, which a table holds, are dealt out by ranges of tree and order; what crosses ranges are counts.
    """
    dealt = cut(rows.repartitionByRange("t", *order).withColumn("_p", F.spark_partition_id()))
    over = Window.partitionBy("t")
    counts = dealt.groupBy("t", "_p").agg(F.count("*").alias("c"))
    counts = counts.select("t", "_p", (F.sum("c").over(over.orderBy("_p")) - F.col("c")).alias("_before"), F.sum("c").over(over).alias("n"))
    local = F.row_number().over(Window.partitionBy("t", "_p").orderBy(*order))
    return dealt.withColumn("_local", local).join(counts, ["t", "_p"]).withColumn("i", F.col("_before") + F.col("_local") - 1).drop("_p", "_local", "_before")


def _climb(nodes: DataFrame, bits: int, top: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Rounds of block reductions, the nodes (t, i, n, node) that are left, and their number: at most `top`, unless each tree is one node."""
    rounds = []
    while True:
        shape = ", ".join(f"`{c}` {kind}" for c, kind in nodes.dtypes)
        rounds.append(cut(nodes.groupBy("t", F.shiftright("i", bits)).applyInArrow(_reduced(bits), f"{shape}, steps {_STEPS}, up string")))
        size = F.ceil(F.col("n") / F.lit(1 << bits)).cast("long")
        nodes = rounds[-1].where(F.col("i").bitwiseAND(F.lit((1 << bits) - 1)) == 0).select("t", F.shiftright("i", bits).alias("i"), size.alias("n"), F.col("up").alias("node"))
        left = nodes.agg(F.count("*").alias("c"), F.max("n").alias("n")).first()
        if left["c"] <= top or left["n"] <= 1:
            return rounds, nodes, left["c"]


def upper_tree(nodes: list[tuple[str, int, str]]) -> list[tuple[str, int, list[tuple[str, str]], str, str]]:
    """(t, i, steps, subroot, root) for nodes (t, i, node) that come by tree and place: the rest of each tree, then the tree over their roots."""
    trees: dict[str, list[str]] = {}
    for t, _, node in nodes:
        trees.setdefault(t, []).append(node)
    steps: dict[str, list[list[tuple[str, str]]]] = {}
    roots = []
    for t, level in trees.items():
        own: list[list[tuple[str, str]]] = [[] for _ in level]
        depth = 0
        while len(level) > 1:
            for k, path in enumerate(own):
                path.append(_step(level, k >> depth))
            level, depth = _next(level), depth + 1
        steps[t] = own
        roots.append(level[0])
    level, depth, over = roots, 0, [[] for _ in roots]
    while len(level) > 1:
        for k, path in enumerate(over):
            path.append(_step(level, k >> depth))
        level, depth = _next(level), depth + 1
    return [(t, i, path + over[k], roots[k], level[0]) for k, (t, own) in enumerate(steps.items()) for i, path in enumerate(own)]


def _suffixes(nodes: DataFrame, rounds: list[DataFrame], bits: int) -> DataFrame:
    """(t, i, steps, subroot, root) of the nodes of the first round, from the driver's upper tree down through the other rounds."""
    rows = upper_tree([(r["t"], r["i"], r["node"]) for r in nodes.orderBy("t", "i").collect()])
    out = nodes.sparkSession.createDataFrame(rows, f"t string, i long, steps {_STEPS}, subroot string, root string")
    for depth, done in enumerate(reversed(rounds[1:])):
        out = _below(done, out if depth else F.broadcast(out), bits).select("t", "i", "steps", "subroot", "root")
    return out


def _below(done: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """Nodes of a round with the steps above their block added."""
    above = above.withColumnsRenamed({"t": "_t", "i": "_i", "steps": "_steps"})
    out = done.join(above, (F.col("t") == F.col("_t")) & (F.shiftright("i", bits) == F.col("_i")))
    return out.withColumn("steps", F.concat("steps", "_steps")).drop("_t", "_i", "_steps")


def build_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", carry: dict[str, Column] | None = None, bits: int = BITS, top: int = TOP) -> DataFrame:
    """One row per row of docs: key, group, leaf, place, proof, subroot, root and what `carry` names.

    Leaves stand by key (nulls first, equal keys by digest) in a binary tree for each group, whose roots, by group in bytewise
    order (null first), stand in a tree of their own. Blocks of 2**bits neighbours are reduced by tasks, round by round,
    until `top` nodes are left; the driver builds that upper tree and broadcasts the steps above each of its nodes, and tasks
    put proofs together. If there are more groups than `top`, their tree is reduced in the same way first. proof: for each
    level what stands before and after the node in its run, both empty where it stands alone, so fold() of a leaf and its
    proof is the root.

    Nulls in any field are told from empty texts. Rows that repeat are leaves each. Long texts are hashed whole. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    carry = carry or {}
    rows = docs.select(F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("t"), F.col(key).alias("key"), leaf_hash(*[F.col(c) for c in fields]).alias("node"), *[c.alias(f"c_{n}") for n, c in carry.items()])
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()))  # texts are read once
    leaves = _numbered(rows, "key", "node", "rid").drop("rid")
    rounds, nodes, left = _climb(leaves, bits, top)
    if left <= top:
        above = _suffixes(nodes, rounds, bits)
    else:
        trees = cut(nodes.select(F.lit("").alias("t"), F.col("t").alias("of"), "node"))
        again, last, _ = _climb(_numbered(trees, "of"), bits, top)
        higher = _suffixes(last, again, bits).drop("subroot")
        names = _below(again[0], higher, bits).select(F.col("of").alias("t"), F.lit(0).cast("long").alias("i"), "steps", F.col("node").alias("subroot"), "root")
        for done in reversed(rounds[1:]):
            names = _below(done, names, bits).select("t", "i", "steps", "subroot", "root")
        above = names
    if left <= top and len(rounds) == 1:
        above = F.broadcast(above)  # at most `top` rows
    out = _below(rounds[0], above, bits)
    return out.select(F.col("key").alias(key), F.when(F.col("t") != "", F.substr("t", F.lit(2))).alias(group), F.col("node").alias("leaf"), F.col("i").alias("place"), F.col("steps").alias("proof"), "subroot", "root", *[F.col(f"c_{n}").alias(n) for n in carry])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def manifest_report(docs: DataFrame) -> DataFrame:
    """Proofs as digests, and the roots that leaves give after every seventh row or so has been tampered with: one more in n_chars."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = F.when(hit, leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")))
    out = build_manifest(docs, carry={"_changed": changed})
    siblings = F.concat_ws("", F.transform("proof", lambda s: F.concat(s["before"], s["after"])))
    folded = fold(F.coalesce("_changed", "leaf"), F.col("proof"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
