"""Merkle manifest of a table, with a proof for every row by pointer jumping.

Rows are the leaves of one tree per group; the roots of these trees, in order of the
groups, are the leaves of a last tree.  Shallower trees are topped up with levels that
hold their root unchanged, so every leaf is as far from the root of all.

A node holds a pointer to an ancestor and the siblings on the way there.  At first that
is the parent.  In a round nodes join the table of nodes by their pointers, take over the
pointers found there and put the siblings found there after their own: the distance
doubles, and after log2(height) rounds every leaf has its whole proof.  Only nodes whose
level is a multiple of the distance are ever pointed at, so the table of inner nodes
shrinks from round to round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.joins import keyed_join
from codesift.operators.ranking import number_within
from codesift.session import durable

#: Children of a node, and most nodes that are folded into an ancestor in one group.
ARITY, BLOCK = 2, 256
#: Larger tables of ancestors are shuffled; an ancestor at distance d has ARITY^d leaves at most.
BROADCAST_BYTES = 16 << 20
#: The tree over the groups' trees.
TOP = -1
_SIBLINGS = "struct<left:string,right:string>"


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 of the fields, each as ``-`` if null, else its UTF-8 bytes, ``:`` and its value."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The digest that a leaf and the siblings of its path lead to."""
    up = lambda acc, s: F.when(s.isNull(), acc).otherwise(F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    return F.aggregate(path, leaf, up)


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings of a path, from the leaf to the root and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.coalesce(F.concat(s["left"], s["right"]), F.lit(""))), ""), 256)


def _height(n: Column, arity: int) -> Column:
    """Levels above n leaves, exactly."""
    powers = [arity**k for k in range(63) if arity**k < 1 << 62]
    return sum((F.when(n > p, 1).otherwise(0) for p in powers), F.lit(0))


def _levels(base: DataFrame, first: int, last: int, arity: int) -> tuple[DataFrame, DataFrame]:
    """Nodes above ``base(tree, height, pos, digest, leaf)``, which is level ``first``: those below level ``last``, and those there.

    A tree ends at its height; on the levels above its root is repeated.  The nodes below
    have tree, level, pos, siblings (null where the next level repeats this one) and
    leaf (what base carries), the last ones tree and digest.  Several levels are folded in
    one group of at most BLOCK neighbours, whatever the size of a tree.
    """
    most = next(k for k in range(1, 99) if arity ** (k + 1) > BLOCK)
    below = []
    while first < last:
        steps = min(most, last - first)
        block = F.expr(f"pos div {arity**steps}").alias("block")
        items = F.sort_array(F.collect_list(F.struct("pos", "digest", "leaf")))
        blocks = base.groupBy("tree", "height", block).agg(items.alias("items"))
        folded = f"""aggregate(sequence(1, {steps}), array(transform(items, x -> x.digest)), (levels, k) -> concat(levels, array(
            if({first} + k > height, element_at(levels, -1), transform(sequence(0, (size(element_at(levels, -1)) - 1) div {arity}),
                i -> sha2(array_join(slice(element_at(levels, -1), i * {arity} + 1, {arity}), ''), 256))))))"""
        widths = ", ".join(f"{arity ** (steps - k)}L" for k in range(steps + 1))
        nodes = f"""flatten(transform({folded}, (nodes, k) -> transform(nodes, (digest, i) -> named_struct(
            'level', {first} + k,
            'pos', if({first} + k >= height, 0L, block * array({widths})[k] + i),
            'siblings', if({first} + k >= height OR k = {steps}, CAST(null AS {_SIBLINGS}), named_struct(
                'left', array_join(slice(nodes, i - i % {arity} + 1, i % {arity}), ''),
                'right', array_join(slice(nodes, i + 2, {arity} - 1 - i % {arity}), ''))),
            'digest', if(k = {steps}, digest, CAST(null AS STRING)),
            'leaf', if(k = 0, items[i].leaf, null)))))"""
        built = durable(blocks.select("tree", "height", F.inline(F.expr(nodes))))
        first += steps
        below.append(built.where(F.col("level") < first).select("tree", "level", "pos", "siblings", "leaf"))
        base = built.where(F.col("level") == first)
    return reduce(DataFrame.unionByName, below), base.select("tree", "digest")


def _jump(nodes: DataFrame, ancestors: DataFrame, distance: int, arity: int) -> DataFrame:
    """Point ``nodes`` at what their pointers' nodes point at; nodes whose pointer is at the root or beyond stay."""
    there = ancestors.select(
        (F.col("level") - distance).alias("level"),
        F.col("tree").alias("up_tree"),
        F.col("pos").alias("up_pos"),
        F.col("up_tree").alias("_tree"),
        F.col("up_pos").alias("_pos"),
        F.col("path").alias("_path"),
    )
    on = ["level", "up_tree", "up_pos"]
    width = 64 + 140 * distance * (arity - 1)
    # An ancestor is met by ARITY^distance nodes at most: a key is never hot while its table is large.
    small = there.count() * width <= BROADCAST_BYTES
    met = nodes.join(F.broadcast(there) if small else there, on, "left")
    path = F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path"))
    moved = {"path": path, "up_tree": F.coalesce("_tree", "up_tree"), "up_pos": F.coalesce("_pos", "up_pos")}
    return met.withColumns(moved).drop("_tree", "_pos", "_path")


def prove(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """``leaves(group, key, digest, ...)`` with the proof of every row.

    A group's leaves ascend by key (null first; ties by digest, and rows equal in both are
    interchangeable); groups by the bytes of their name, null first.  While a tree has
    several nodes, every ``arity`` of them in a row, or what is left at the end, become
    the sha256 of their joined digests.  Added: subroot, root, path (array of structs of
    the joined digests to the left and right, leaf first; null where a level repeats the
    one below).  Further columns, of types that can be ordered, stay if they do not bear these names.  An empty table
    gives an empty result.
    """
    rest = [c for c in leaves.columns if c not in ("group", "key", "digest", "subroot", "root", "path")]
    named = F.coalesce(F.concat(F.lit("="), "group"), F.lit(""))
    packed = F.struct("group", "key", "digest", *[F.col(f"`{c}`") for c in rest]).alias("leaf")
    rows = durable(leaves.select(named.alias("_group"), "key", "digest", F.monotonically_increasing_id().alias("_tie"), packed))
    rows = number_within(rows, "_group", [F.col("key").asc_nulls_first(), F.col("digest"), F.col("_tie")], "pos")
    trees = rows.groupBy("_group").agg(F.count("*").alias("n")).withColumn("_all", F.lit(0))
    trees = number_within(trees, "_all", [F.col("_group")], "tree")
    trees = durable(trees.select("_group", (F.col("tree") - 1).alias("tree"), _height(F.col("n"), arity).alias("height")))
    size = trees.agg(F.count("*").alias("trees"), F.max("height").alias("height")).first()
    below, over = size["height"] or 0, 0
    while arity**over < size["trees"]:
        over += 1
    top = max(below, 1)
    end = top + max(over, 1)
    base = keyed_join(rows, trees, ["_group"], "inner", 256, ["_tie"])
    base = base.select("tree", "height", (F.col("pos") - 1).alias("pos"), "digest", "leaf")
    nodes, subroots = _levels(base, 0, top, arity)
    no_leaf = F.lit(None).cast(rows.schema["leaf"].dataType).alias("leaf")
    base = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(top + over).alias("height"), F.col("tree").alias("pos"), "digest", no_leaf)
    above, root = _levels(base, top, end, arity)
    root = root.first()

    def pointing(part: DataFrame) -> DataFrame:
        """Nodes that point at their parents."""
        leaves_tree = (F.col("tree") != TOP) & (F.col("level") == top - 1)
        up = F.when(leaves_tree, F.col("tree")).otherwise(F.expr(f"pos div {arity}"))
        return part.withColumns(
            {"up_tree": F.when(leaves_tree, F.lit(TOP).cast("long")).otherwise(F.col("tree")), "up_pos": up, "path": F.array("siblings")}
        ).drop("siblings")

    proofs = pointing(nodes.where("level = 0"))
    inner = pointing(nodes.where("level > 0").unionByName(above)).drop("leaf")
    distance = 1
    while distance < end:
        ancestors = inner.where(F.col("level") % (2 * distance) == distance)
        proofs = _jump(proofs, ancestors.where(F.col("level") == distance), distance, arity)
        if 2 * distance < end:
            inner = durable(_jump(inner.where(F.col("level") % (2 * distance) == 0), ancestors, distance, arity))
        distance *= 2
    proofs = keyed_join(proofs, subroots.select("tree", F.col("digest").alias("subroot")), ["tree"], "left", 128, ["pos"])
    return proofs.select("leaf.*", "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "path")
