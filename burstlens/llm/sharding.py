"""Sharding by minimax contiguous partition (DataFrame functions only).

Rows with equal texts form one atomic group; groups are ordered by the digest
of their text, and the order is cut into ``shards`` runs whose largest total
size is the smallest possible.  The smallest feasible capacity is found by
binary search with the greedy check "fill a shard until the next group does
not fit".  Within that capacity the cuts are as even as the groups allow, and
where one group alone sets it, the groups before and after it are partitioned
again in the same way over the other shards.

The search never needs all groups on the driver.  It works on *units*: digest
prefixes with (total size, largest group, number of groups).  Treating units
as unbreakable gives a capacity that is certainly feasible, treating units of
many groups as divisible gives one that no partition can beat; while the two
differ, the units in which a cut can fall are split by two more hex digits.
At most ``16**FIRST_DIGITS`` units are read first, and each refinement reads
only the few units around the possible cuts (256 sub-units each at most).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, stage

FIRST_DIGITS = 3
SALTS = 256


class Units:
    """Digest-ordered units: prefix, total size, number of groups, largest group."""

    def __init__(self, rows):
        rows = sorted((r["unit"], r["size"], r["groups"], r["largest"]) for r in rows)
        self.prefix = [r[0] for r in rows]
        self.size, self.groups, self.largest = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size
        self.total = int(self.size.sum())

    def cuts(self, capacity: int, shards: int, divisible: bool) -> list[int] | None:
        """Greedy positions where shards end, or None if they are too few.
        ``divisible``: units of several groups may be cut anywhere."""
        at, out = 0, []
        while at < self.total:
            if len(out) == shards:
                return None
            to = at + capacity
            if to >= self.total:
                to = self.total
            else:
                i = int(np.searchsorted(self.ends, to, "right"))  # the unit that `to` falls into
                if not divisible or self.groups[i] == 1:
                    to = int(self.starts[i])
            if to <= at:
                return None
            at = to
            out.append(at)
        return out

    def smallest(self, shards: int, divisible: bool) -> int:
        low = max(-(-self.total // shards), int(self.largest.max()), 1)
        high = max(self.total, low)
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, divisible) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def even(self, capacity: int, shards: int) -> list[int]:
        """Positions where shards end, as even as unbreakable units allow: each
        cut is the boundary nearest to an equal share of what is left, among
        those that keep its shard within ``capacity`` and leave no more than
        the other shards can hold."""
        edges = np.concatenate([[0], self.ends])
        earliest = [self.total]  # greedy from the right
        for _ in range(shards - 1):
            earliest.append(int(edges[np.searchsorted(edges, earliest[-1] - capacity, "left")]))
        earliest.reverse()  # earliest[i]: least end of shard i
        at, out = 0, []
        for i in range(shards):
            share = at + (self.total - at) / (shards - i)
            near = int(np.searchsorted(edges, share, "left"))
            if near and share - edges[near - 1] <= edges[min(near, len(edges) - 1)] - share:
                near -= 1
            last = int(edges[np.searchsorted(edges, at + capacity, "right") - 1])
            at = min(max(int(edges[near]), earliest[i]), last)
            out.append(at)
        return out

    def rest_share(self, shards: int) -> float:
        """An equal share of what is left once every group above such a share
        has a shard of its own (of a unit's groups, the largest is known)."""
        rest, n = self.total, shards
        for x in np.sort(self.largest)[::-1].tolist():
            if n == 1 or x * n <= rest:
                break
            rest, n = rest - x, n - 1
        return rest / n

    def open_units(self, low: int, high: int, shards: int) -> list[str]:
        """Prefixes of the many-group units in which an optimal cut can fall."""
        a = b = 0
        found = np.zeros(len(self.size), bool)
        biggest = int(self.largest.max())
        for _ in range(shards):
            i = int(np.searchsorted(self.ends, a + low, "right"))
            edge = int(self.starts[i]) if i < len(self.size) else self.total
            a = max(a, edge, a + low - biggest)
            b = min(b + high, self.total)
            if a >= self.total:
                break
            found |= (self.ends >= a) & (self.starts <= b) & (self.groups > 1)
        return [p for p, f in zip(self.prefix, found) if f]


def _units(groups: DataFrame, digits: int):
    return groups.groupBy(F.substring("gkey", 1, digits).alias("unit")).agg(
        F.sum("gsize").alias("size"), F.count("*").alias("groups"), F.max("gsize").alias("largest"))


def plan_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(smallest capacity, digest prefixes at which shards 1, 2, ... begin) of
    a frame (gkey hex digest, gsize); no group is ever split."""
    digits = FIRST_DIGITS
    rows = [r.asDict() for r in _units(groups, digits).collect()]
    if not rows:
        return 0, []
    while True:
        units = Units(rows)
        low, high = units.smallest(shards, True), units.smallest(shards, False)
        todo = [] if low == high else units.open_units(low, high, shards)
        if not todo:
            ends = [e for e in units.even(high, shards) if 0 < e < units.total]
            return high, [units.prefix[int(np.searchsorted(units.starts, e))] for e in sorted(set(ends))]
        digits += 2
        by_length: dict[int, list[str]] = {}
        for p in todo:
            by_length.setdefault(len(p), []).append(p)
        inside = reduce(lambda x, y: x | y,
                        (F.substring("gkey", 1, n).isin(ps) for n, ps in by_length.items()))
        drop = set(todo)
        rows = [r for r in rows if r["unit"] not in drop] + [
            r.asDict() for r in _units(groups.filter(inside), digits).collect()]


def balanced_cuts(groups: DataFrame, shards: int, found: tuple[int, list[str]] | None = None) -> tuple[int, list[str]]:
    """Like ``plan_cuts``, but where a single group sets the capacity, that
    group has a shard of its own and the partition goes on left and right of
    it, so that the other shards share the rest evenly.  Each step settles one
    shard; a step reads unit aggregates and one group only."""
    capacity, cuts = found or plan_cuts(groups, shards)
    if shards == 1 or not capacity:
        return capacity, cuts
    hot = groups.filter(F.col("gsize") == capacity).agg(F.min("gkey").alias("gkey")).first()["gkey"]
    if hot is None:
        return capacity, cuts
    sides = (groups.filter(F.col("gkey") < hot), groups.filter(F.col("gkey") > hot))
    units = [Units(r.asDict() for r in _units(side, FIRST_DIGITS).collect()) for side in sides]
    if not units[0].total and not units[1].total:
        return capacity, []
    found_cuts: list[list[str]] = [[], []]
    if not units[0].total or not units[1].total:
        one = int(units[0].total == 0)
        found_cuts[one] = balanced_cuts(sides[one], shards - 1)[1]
    else:
        # shares of the shards by what no partition can beat, then by the share left beside groups as hot;
        # the best first, until no share can be better
        least = sorted((max(units[0].smallest(k, True), units[1].smallest(shards - 1 - k, True)),
                        max(units[0].rest_share(k), units[1].rest_share(shards - 1 - k)), k) for k in range(1, shards - 1))
        plans, best = {}, None
        for bound, _, k in least:
            if best is not None and bound >= best[0]:
                break
            both = tuple(plans.get((i, n)) or plan_cuts(side, n) for i, (side, n) in enumerate(zip(sides, (k, shards - 1 - k))))
            plans.update({(0, k): both[0], (1, shards - 1 - k): both[1]})
            if best is None or max(both[0][0], both[1][0]) < best[0]:
                best = max(both[0][0], both[1][0]), k, both
        _, k, both = best
        found_cuts = [balanced_cuts(side, n, plan)[1] for side, n, plan in zip(sides, (k, shards - 1 - k), both)]
    before = [*found_cuts[0], hot] if units[0].total else []
    after = [hot + "0", *found_cuts[1]] if units[1].total else []  # the first string after the group's digest
    return capacity, before + after


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, gkey, shard, slot, capacity) for every row.

    size: UTF-8 bytes of the text plus 1.  A null text counts as empty and
    belongs to the group of empty texts.  Rows with a null doc_id or a repeated
    doc_id are kept and get slots of their own.  An empty table gives an empty
    result.  Slots number a shard's rows from 0 without a gap, in the order of
    (salt of doc_id, doc_id); the salt splits the numbering of a hot group or
    shard into ``SALTS`` independent parts whose offsets come from their counts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(id_text(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("gkey")), "sized")
    groups = stage(rows.groupBy("gkey").agg(F.sum("size").alias("gsize")), "groups")
    capacity, cuts = balanced_cuts(groups, shards)
    shard = reduce(lambda s, c: s + (F.col("gkey") >= c).cast("int"), cuts, F.lit(0))
    placed = rows.select("*", shard.alias("shard"),
                         F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    offsets = (placed.groupBy("shard", "salt").count()  # at most shards * SALTS rows
               .withColumn("base", F.coalesce(F.sum("count").over(
                   Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .drop("count"))
    order = Window.partitionBy("shard", "salt").orderBy("doc_id", "gkey")
    return (placed.withColumn("rank", F.row_number().over(order) - 1)
            .join(F.broadcast(offsets), ["shard", "salt"])  # bounded by shards * SALTS rows
            .select("doc_id", "size", "text_crc32", "gkey", "shard",
                    (F.col("base") + F.col("rank")).cast("long").alias("slot"),
                    F.lit(capacity).cast("long").alias("capacity")))
