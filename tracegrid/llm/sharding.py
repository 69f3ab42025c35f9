"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows with equal texts form one group that no cut may split. Groups are ordered by a 128-bit hash of
their text; the smallest capacity for which a greedy walk needs no more than the asked number of
shards is found by binary search, and the order is cut there. The law is ``bytes``: shard sizes come
as near to equal as groups allow. A group as large as a whole fair share would only distort the
others' capacity, so each such group (there are fewer than shards) takes a shard of its own first and
the search runs over the rest.

The search never pulls all groups to the driver. Sizes are first summed over a fixed number of hash
cells; walks over whole cells bound the capacity and every cut from both sides, and only the cells in which
these walks cut, at most four for each shard, are split further, until the groups between the bounds are few enough
to be read exactly. What reaches the driver at a time is bounded by ``MAX_CELLS`` and ``MAX_GROUPS``, heavy
groups or not, and the result equals the search over all groups.

Defined cases: a null text has size 8 and is grouped with the empty text; rows with a null or repeated
``doc_id`` are placed like all others; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrid.llm.runtime import materialised, text_key

SHARDS = 24
ROW_OVERHEAD = 8
CELL_BITS = 16
MAX_CELLS = 1 << 18
MAX_GROUPS = 200_000
ROWS_PER_SLOT_TASK = 100_000
_LOW = -(1 << 63)


def greedy_cuts(sizes: np.ndarray, capacity: int) -> list[int]:
    """Starts of the shards after the first when each is filled from the left up to ``capacity``."""
    ends = np.cumsum(sizes)
    cuts, at, n = [], 0, len(sizes)
    while True:
        base = int(ends[at - 1]) if at else 0
        at = int(np.searchsorted(ends, base + capacity, side="right"))
        if at >= n:
            return cuts
        cuts.append(at)


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity for which the greedy walk needs at most ``shards`` shards."""
    total = int(sizes.sum())
    low, high = max(int(sizes.max(initial=0)), -(-total // shards)), total
    while low < high:
        mid = (low + high) // 2
        if len(greedy_cuts(sizes, mid)) < shards:
            high = mid
        else:
            low = mid + 1
    return low


def _reached(sizes: np.ndarray, most: np.ndarray, capacity: int, shards: int, far: bool) -> tuple[list[int], bool]:
    """Cells in which the cuts of a greedy walk over cells lie, and whether ``shards`` shards of that capacity reach the end.

    ``most`` is the largest group of each cell. The near walk stops before a cell that does not fit whole, so it is
    never ahead of the walk over groups. The far walk fills its shard up, but where a cell's largest group cannot
    fit it takes no more than the cell's others, so it is never behind.
    """
    ends = np.cumsum(sizes)
    cuts, base = [], 0
    for _ in range(shards - 1):
        i = int(np.searchsorted(ends, base + capacity, side="right"))
        if i >= len(ends):
            return cuts, True
        cuts.append(i)
        start = int(ends[i - 1]) if i else 0
        reach = base + capacity
        fits = reach - start >= int(most[i])
        base = start if not far else reach if fits else min(reach, start + int(sizes[i] - most[i]))
    return cuts, int(ends[-1]) - base <= capacity


def _open_cells(sizes: np.ndarray, most: np.ndarray, shards: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Ranges of cell numbers that can hold a cut of the exact answer, and the cells whose contents decide how wide they are.

    Cells taken as whole give a feasible, hence an upper, capacity. A capacity with which even the far walk does
    not reach the end is too small, which gives a lower one. Cut t of the exact answer lies no further left than
    that of the near walk at the lower capacity and no further right than that of the far walk at the upper one.
    A heavy group that just fits or just does not moves all later cuts, so the ranges may be wide; they close in
    once the few cells in which these walks cut are split.
    """
    upper = smallest_capacity(sizes, shards)
    low, high = max(-(-int(sizes.sum()) // shards), int(most.max())), upper
    while low < high:
        mid = (low + high) // 2
        if _reached(sizes, most, mid, shards, far=True)[1]:
            high = mid
        else:
            low = mid + 1
    walks = {(c, far): _reached(sizes, most, c, shards, far)[0] for c in (low, upper) for far in (False, True)}
    lefts, rights = walks[low, False], walks[upper, True]
    found: list[tuple[int, int]] = []
    for t, left in enumerate(lefts):
        right = rights[t] if t < len(rights) else len(sizes) - 1
        if found and left <= found[-1][1] + 1:
            found[-1] = (found[-1][0], max(right, found[-1][1]))
        else:
            found.append((left, right))
    return found, {i for cuts in walks.values() for i in cuts}


def _within(ranges: list[tuple[int, int]]) -> Column:
    cond = F.lit(False)
    for lo, hi in ranges:
        cond = cond | F.col("h1").between(lo, hi)
    return cond


def _cells(groups: DataFrame, ranges: list[tuple[int, int]], shifts: list[int]) -> list[np.ndarray]:
    """First hash, size, groups, largest group and shift of the cells of some ranges of hashes, each cut at its own shift."""
    cell, shift = F.lit(None).cast("long"), F.lit(0)
    for (lo, hi), k in zip(ranges, shifts):
        own = F.col("h1").between(lo, hi)
        cell = F.when(own, F.shiftleft(F.shiftright("h1", k), k)).otherwise(cell)
        shift = F.when(own, F.lit(k)).otherwise(shift)
    found = groups.filter(_within(ranges)).groupBy(cell.alias("cell"), shift.alias("shift")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most"))
    rows = found.toPandas().sort_values("cell")
    return [rows[c].to_numpy(np.int64) for c in ("cell", "size", "n", "most", "shift")]


def plan_cuts(groups: DataFrame, shards: int) -> tuple[list[tuple[int, int]], int]:
    """Cut keys ``(h1, h2)`` (each starts a shard) and the capacity, over ``groups(h1, h2, size)``."""
    known = _cells(groups, [(_LOW, -_LOW - 1)], [64 - CELL_BITS])
    if not len(known[0]):
        return [], 0
    while True:
        starts, sizes, counts, most, shift = known
        spans, deciding = _open_cells(sizes, most, shards)
        last = lambda j: int(starts[j]) + (1 << int(shift[j])) - 1
        split = [i for i in sorted(deciding) if counts[i] > 1 and shift[i] > 0]
        if sum(int(counts[i : j + 1].sum()) for i, j in spans) <= MAX_GROUPS or not split:
            break
        finer = max(1, int(np.log2(max(2, MAX_CELLS // len(split)))))
        fresh = _cells(groups, [(int(starts[i]), last(i)) for i in split], [max(0, int(shift[i]) - finer) for i in split])
        keep = np.ones(len(starts), bool)
        keep[split] = False
        order = np.argsort(np.concatenate([starts[keep], fresh[0]]), kind="stable")
        known = [np.concatenate([a[keep], b])[order] for a, b in zip(known, fresh)]
    if not spans:
        return [], int(sizes.sum())
    ranges = [(int(starts[i]), last(j)) for i, j in spans]
    exact = groups.filter(_within(ranges)).select("h1", "h2", "size").toPandas().sort_values(["h1", "h2"])
    keep = np.ones(len(starts), bool)
    for i, j in spans:
        keep[i : j + 1] = False
    h1 = np.concatenate([starts[keep], exact["h1"].to_numpy(np.int64)])
    h2 = np.concatenate([np.full(int(keep.sum()), _LOW, np.int64), exact["h2"].to_numpy(np.int64)])
    size = np.concatenate([sizes[keep], exact["size"].to_numpy(np.int64)])
    order = np.lexsort((h2, h1))
    h1, h2, size = h1[order], h2[order], size[order]
    capacity = smallest_capacity(size, shards)
    return [(int(h1[i]), int(h2[i])) for i in greedy_cuts(size, capacity)], capacity


def alone_first(groups: DataFrame, shards: int) -> tuple[list[tuple[int, int]], int]:
    """Groups that fill a fair share of what is left by themselves, largest first, and the total of the rest."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    alone: list[tuple[int, int]] = []
    for row in groups.orderBy(F.desc("size"), "h1", "h2").limit(shards - 1).collect():
        left = shards - len(alone)
        if left <= 1 or row["size"] * left < total or row["size"] == total:
            break
        alone.append((row["h1"], row["h2"]))
        total -= row["size"]
    return alone, total


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2 = text_key(F.col("text"))
    rows = materialised(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            h1.alias("h1"),
            h2.alias("h2"),
        ),
        "shard-rows",
    )
    groups = materialised(rows.groupBy("h1", "h2").agg(F.sum("size").alias("size")), "shard-groups")
    alone, _ = alone_first(groups, shards)
    is_alone = F.lit(False)
    for a, b in alone:
        is_alone = is_alone | ((F.col("h1") == a) & (F.col("h2") == b))
    cuts, _ = plan_cuts(groups.filter(~is_alone), shards - len(alone))
    number = F.lit(len(alone))
    for a, b in cuts:
        number = number + ((F.col("h1") > a) | ((F.col("h1") == a) & (F.col("h2") >= b))).cast("int")
    for k, (a, b) in enumerate(alone):
        number = F.when((F.col("h1") == a) & (F.col("h2") == b), F.lit(k)).otherwise(number)
    return numbered(rows.withColumn("shard", number.cast("int"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard, without sorting a shard in one task.

    Rows are dealt to salts by their own hash; each (shard, salt) is numbered by itself and starts
    where the salts before it end. There are as many offsets as shards times salts.
    """
    n = rows.count()
    salts = max(1, -(-n // ROWS_PER_SLOT_TASK))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text_crc32", "h2"), F.lit(salts)).cast("int"))
    inner = Window.partitionBy("shard", "_salt").orderBy("doc_id", "text_crc32", "h1", "h2")
    counts = salted.groupBy("shard", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        salted.withColumn("_rn", F.row_number().over(inner) - 1)
        .join(offsets, ["shard", "_salt"])
        .withColumn("slot", (F.col("_base") + F.col("_rn")).cast("long"))
    )
