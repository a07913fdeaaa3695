"""Merkle manifest of a table: a digest tree a group, a tree over the groups.

The leaves of a group are put in order and numbered without a gap.  An aligned
block of ``3 ** DEPTH`` nodes keeps each of its levels as one hex string: level
k+1 is the digests of the 192-character pieces of level k, and a node's
siblings are what flanks it in its piece.  Blocks have one root each, which are
the nodes of the next round, until a group has one node, its subroot; the
subroots of all groups, in order, go through the same rounds.  Everything is
SQL expressions over rows of bounded size: a group of any size is as many blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions, stage

FANOUT, DEPTH = 3, 6
BLOCK = FANOUT ** DEPTH
HEX = 64
RUN = FANOUT * HEX
PID_BITS = 33  # monotonically_increasing_id: the partition's number stands above them


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


def positions(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with pos (from 0, gapless in each group, by ``order``) and n (rows
    of the group).  One range sort, so a hot group is spread over partitions;
    offsets come from the counts a (group, partition)."""
    keys = [group, *order]
    parts = partitions(rows.sparkSession)
    sorted_rows = stage(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                        .withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", PID_BITS).alias("part")
    counts = sorted_rows.groupBy(group, part).agg(F.count("*").alias("own"), F.min("at").alias("from"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "part", "from", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("base"),
                            F.sum("own").over(Window.partitionBy(group)).alias("n"))
    return (sorted_rows.withColumn("part", part).join(offsets, [group, "part"])
            .withColumn("pos", F.col("base") + F.col("at") - F.col("from")).drop("at", "part", "from", "base"))


def _hashed(level: str) -> str:
    """SQL: the digests of a level's pieces as the level above."""
    return (f"cast(array_join(transform(sequence(1, int(ceil(length({level}) / {RUN}))), "
            f"i -> sha2(substring({level}, {RUN} * (i - 1) + 1, {RUN}), 256)), '') as binary)")


def _flanks(k: int) -> str:
    """SQL: what stands left and right of node ``i div 3**k`` in its piece of level k."""
    node = f"int(i div {FANOUT ** k})"
    piece, place = f"{RUN} * int({node} div {FANOUT})", f"{HEX} * ({node} % {FANOUT})"
    return (f"named_struct('left', substring(level{k}, {piece} + 1, {place}), "
            f"'right', substring(level{k}, {piece} + {place} + {HEX + 1}, {RUN - HEX} - {place}))")


def climb(nodes: DataFrame, carry: Sequence[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of (grp, pos, n, digest, *carry) with their levels and the siblings
    above them, and (grp, subroot).  ``most``: the largest n."""
    member = F.struct("pos", "digest", *carry)
    steps = reduce(lambda a, b: a + b, [(F.col("n") > FANOUT ** k).cast("int") for k in range(DEPTH)])
    rows = nodes.groupBy("grp", "n", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    rows = rows.select("*", steps.alias("steps"), F.expr("cast(array_join(transform(members, m -> m.digest), '') as binary)").alias("level0"))
    for k in range(DEPTH):
        rows = rows.select("*", F.expr(f"case when steps > {k} then {_hashed(f'level{k}')} else level{k} end").alias(f"level{k + 1}"))
    blocks = stage(rows, "blocks")
    roots = blocks.select("grp", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"),
                          F.col(f"level{DEPTH}").cast("string").alias("digest"))
    if most <= BLOCK:
        return blocks.withColumn("above", F.expr("cast(array() as array<struct<left:binary,right:binary>>)")), roots.select(
            "grp", F.col("digest").alias("subroot"))
    upper, subroots = climb(roots, [], -(-most // BLOCK))
    above = spread(upper).select("grp", F.col("pos").alias("block"), F.col("siblings").alias("above"))
    return blocks.join(above, ["grp", "block"]), subroots


def spread(blocks: DataFrame, *keep: str) -> DataFrame:
    """One row a node: (grp, *keep, the fields of its member, siblings), level by level."""
    own = f"slice(array({', '.join(_flanks(k) for k in range(DEPTH))}), 1, steps)"
    each = F.expr(f"transform(members, (m, i) -> named_struct('m', m, 'siblings', concat({own}, above)))")
    return blocks.select("grp", *keep, F.explode(each).alias("node")).select("grp", *keep, "node.m.*", "node.siblings")


def proof_digest(siblings: Column) -> Column:
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"]).cast("string")), ""), 256)


def folded(start: Column, siblings: Column) -> Column:
    """The root that ``start`` and the siblings lead to."""
    return F.aggregate(siblings, start, lambda now, s: F.sha2(F.concat(s["left"], now.cast("binary"), s["right"]), 256))


def manifest(rows: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source",
             order: str = "doc_id", altered: dict[str, Column] | None = None) -> DataFrame:
    """(order, group, leaf, again, subroot, root, siblings) for every row.

    ``leaf`` is the digest of the row's fields, ``again`` that of the row with
    ``altered`` columns in their place.  A null field counts as ``-``, an empty
    one as ``0:``; a null group is a group of its own and comes first.  Leaves
    ascend by ``order``, nulls first, ties (repeated rows included) by digest.
    Siblings are structs (left, right) from the leaf's level to the root's.  An
    empty table gives an empty result; other columns are left behind.
    """
    altered = altered or {}
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = stage(rows.select(
        key.alias("grp"), F.col(order).alias("item"), leaf([F.col(f) for f in fields]).alias("digest"),
        leaf([altered.get(f, F.col(f)) for f in fields]).alias("again")), "leaves")
    placed = stage(positions(leaves, "grp", "item", "digest"), "placed")
    discard(leaves)
    blocks, subroots = climb(placed, ["item", "again"], placed.agg(F.max("n")).first()[0] or 0)
    subroots = stage(subroots.withColumn("every", F.lit("")), "subroots")
    tops = stage(positions(subroots.select(F.lit("").alias("tree"), "grp", "subroot"), "tree", "grp"), "tops")
    over, root = climb(tops.select(F.lit("").alias("grp"), "pos", "n", F.col("subroot").alias("digest"), F.col("grp").alias("below")),
                       ["below"], tops.agg(F.max("n")).first()[0] or 0)
    tree = spread(over).select(F.col("below").alias("grp"), F.col("digest").alias("subroot"), F.col("siblings").alias("over"))
    root = [r["subroot"] for r in root.collect()]  # one row, or none for an empty table
    whole = blocks.join(tree, "grp").withColumn("above", F.concat("above", "over"))
    return spread(whole, "subroot").select(
        F.col("item").alias(order), F.when(F.col("grp") != "0", F.expr("substring(grp, 2)")).alias(group), F.col("digest").alias("leaf"),
        "again", "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "siblings")
