"""Shards of near-equal bytes: a minimax contiguous partition of groups that stay whole.

Groups (equal texts) are ordered by the digest of their text. The smallest shard
capacity for which cutting the ordered groups greedily needs no more than the wanted
shards is found by binary search; the groups are then cut there.

The driver never sees single groups as such: it walks a tree of digest prefixes, with
at most 16**STEP children of a node, and opens only those nodes in which a cut falls.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.closure import numbered
from .common import saved

#: Hexadecimal digits by which a tree node is opened: at most 65,536 children.
STEP = 4


def minimax_capacity(sizes: list[int], shards: int) -> int:
    """Smallest capacity for which greedy cuts of these ordered sizes need at most `shards` runs."""
    return _Tree([(f"{i:08x}", s, 1) for i, s in enumerate(sizes)]).capacity(shards, None)


class _Tree:
    """Ordered leaves (prefix, bytes, groups); a leaf with several groups can be opened."""

    def __init__(self, leaves: list[tuple[str, int, int]]):
        self._set(leaves)

    def _set(self, leaves):
        self.leaves = sorted(leaves)
        self.sizes = np.array([x[1] for x in self.leaves], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.total = int(self.ends[-1]) if self.leaves else 0

    def walk(self, capacity: int) -> tuple[list[int], set[int]]:
        """Leaves before which greedy cutting starts a shard, and the leaves that must be opened to be sure."""
        cuts, unsure, start = [], set(), 0
        while start < len(self.leaves):
            base = int(self.ends[start - 1]) if start else 0
            stop = int(np.searchsorted(self.ends, base + capacity, side="right"))
            if stop < len(self.leaves) and self.leaves[stop][2] > 1:
                unsure.add(stop)
            if stop == start:  # it doesn't fit in a shard of its own
                if self.leaves[stop][2] == 1:
                    return [], {-1}
                stop += 1
            if stop < len(self.leaves):
                cuts.append(stop)
            start = stop
        return cuts, unsure

    def cuts(self, capacity: int, expand) -> list[int] | None:
        """Exact greedy cuts, None if a single group is larger than the capacity."""
        while True:
            cuts, unsure = self.walk(capacity)
            if unsure == {-1}:
                return None
            if not unsure:
                return cuts
            opened = expand([self.leaves[i][0] for i in sorted(unsure)])
            self._set([x for i, x in enumerate(self.leaves) if i not in unsure] + opened)

    def capacity(self, shards: int, expand) -> int:
        """Smallest feasible capacity: growing steps up from the mean find a feasible one, then binary search below it."""

        def feasible(capacity: int) -> bool:
            cuts = self.cuts(capacity, expand)
            return cuts is not None and len(cuts) < shards

        low = max(1, -(-self.total // shards))
        high, step = low, max(1, self.total >> 16)
        while not feasible(high):
            low, high, step = high + 1, high + step, 2 * step
        while low < high:
            middle = (low + high) // 2
            if feasible(middle):
                high = middle
            else:
                low = middle + 1
        return low


def shard_bounds(groups: DataFrame, shards: int) -> list[str]:
    """First digests of shards 1, 2, ... over `groups` (digest, bytes), one row a group."""

    def level(rows: DataFrame, depth: int) -> list[tuple[str, int, int]]:
        summed = rows.groupBy(F.substring("digest", 1, depth).alias("p")).agg(F.sum("bytes"), F.count("*"))
        table = summed.toArrow()
        return list(zip(*[c.to_pylist() for c in table.columns], strict=True))

    def expand(prefixes: list[str]) -> list[tuple[str, int, int]]:
        found = []
        for depth in sorted({len(p) for p in prefixes}):
            own = [p for p in prefixes if len(p) == depth]
            found += level(groups.filter(F.substring("digest", 1, depth).isin(own)), depth + STEP)
        return found

    tree = _Tree(level(groups, STEP))
    capacity = tree.capacity(shards, expand)
    return [tree.leaves[i][0] for i in tree.cuts(capacity, expand) or []]


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Size is the text's UTF-8 bytes plus 1; a null text counts as empty and shares a group
    with empty ones. Rows of equal text share a shard. No shard is larger than the minimax
    capacity. slot counts a shard's rows from 0 without gaps. Repeated rows and repeated or
    null ids each get their own slot; an empty table gives an empty result; other columns
    are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = saved(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    groups = saved(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    bounds = shard_bounds(groups, shards)
    shard: Column = F.lit(0)
    for b in bounds:
        shard = shard + (F.col("digest") >= F.lit(b)).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", "row", shard.cast("int").alias("shard"))
    # rows of one text or one id fall apart by their own numbers, so no task has all of them
    slots = numbered(placed, "shard", "doc_id", "row")
    first = F.broadcast(slots.groupBy("shard").agg(F.min("_number").alias("first")))  # a row a shard
    return slots.join(first, "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_number") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
