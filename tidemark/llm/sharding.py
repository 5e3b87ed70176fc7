"""Minimax contiguous sharding of atomic groups.

Groups (rows with an equal order key) lie on a line, ordered by that key.  The line is cut into
``n_shards`` contiguous pieces whose largest size is as small as can be.  The smallest feasible
capacity is found by binary search, each probe checked greedily.

The line is never collected.  The driver holds a histogram of key intervals with their exact
sizes.  A capacity is bounded from below by a search that may split an interval and from above by
one that may not; only the intervals in which a cut can fall between these bounds are refined, each
by one aggregation, until they hold a single group.  The histogram has at most
``FAN_OUT`` cells for each refined interval, whatever the number of rows.

Cases: a null text counts as the empty text; equal texts share a group and so a shard; an empty
table gives an empty result; fewer groups than shards leaves the last shards empty; one group
larger than the mean sets the capacity; repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.base import materialise, text_key

KEY_BITS = 60
FAN_OUT = 1024
#: Intervals refined by one aggregation.
REFINED = 64
#: Cells of the slot numbering: by the key's leading bits, and by doc_id so that a hot group is dealt out.
SLOT_BUCKETS, SLOT_SALTS = 256, 64


def greedy_cuts(sizes: list[int], n_shards: int, capacity: float, divisible: bool = False) -> list[float]:
    """Ends (in size from the left) of the pieces that a greedy fill by ``capacity`` makes."""
    ends, total = [0, *accumulate(sizes)], sum(sizes)
    at, cuts = 0.0, []
    for _ in range(n_shards):
        reach = at + capacity
        at = min(reach, total) if divisible else ends[bisect_right(ends, reach) - 1]
        cuts.append(at)
    return cuts


def smallest_capacity(sizes: list[int], n_shards: int, floor: int = 0) -> int:
    """Binary search over integer capacities; each is feasible if the greedy fill reaches the end."""
    total = sum(sizes)
    low = max(floor, -(-total // n_shards))
    high = low + max(sizes, default=0)
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(sizes, n_shards, mid)[-1] >= total:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """(capacity, last key of each shard but the last) for ``groups(key, size)``, one row for each key."""
    top = 1 << KEY_BITS
    largest = groups.agg(F.max("size")).first()[0]
    if largest is None:
        return 0, [top] * (n_shards - 1)
    cells = {(0, top): None}  # (from, to) -> (size, groups)

    def refine(wanted: list[tuple[int, int]]) -> None:
        """Replace each of the wanted intervals by those of its FAN_OUT parts that hold groups."""
        parts = []
        for low, high in wanted:
            width = max(1, -(-(high - low) // FAN_OUT))
            parts.append(f"WHEN key >= {low}L AND key < {high}L THEN named_struct('low', {low}L + (key - {low}L) DIV {width}L * {width}L, 'width', {width}L)")
        part = F.expr(f"CASE {' '.join(parts)} END")
        found = (
            groups.select(part.alias("part"), "size").where(F.col("part").isNotNull())
            .groupBy("part.low", "part.width").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        )
        for cell in wanted:
            del cells[cell]
        for r in found:
            cells[(r["low"], r["low"] + r["width"])] = (int(r["size"]), int(r["n"]))

    refine([(0, top)])
    while True:
        order = sorted(cells)
        sizes, single = [cells[c][0] for c in order], [cells[c][1] == 1 for c in order]
        ends = [0, *accumulate(sizes)]
        low = max(largest, -(-ends[-1] // n_shards))
        high = smallest_capacity(sizes, n_shards, low)
        wanted = set()
        if low < high:  # for any capacity between, the k-th cut lies between these two reaches
            for a, b in zip(greedy_cuts(sizes, n_shards, low), greedy_cuts(sizes, n_shards, high, divisible=True), strict=True):
                wanted.update(order[i] for i in range(max(0, bisect_right(ends, a) - 1), min(len(sizes), bisect_right(ends, b))) if not single[i])
        if not wanted:
            cuts = greedy_cuts(sizes, n_shards, high)
            return high, [order[bisect_right(ends, c) - 2][1] - 1 if c else -1 for c in cuts[:-1]]
        refine(sorted(wanted, key=lambda c: -cells[c][0])[:REFINED])


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, key, shard, slot) for every row of ``docs(doc_id, text)``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = materialise(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            text_key(F.col("text")).alias("key"),
        ),
        "shard-base",
    )
    _, cuts = minimax_cuts(base.groupBy("key").agg(F.sum("size").alias("size")), n_shards)
    shard = F.lit(n_shards - 1)
    for k in range(n_shards - 2, -1, -1):
        shard = F.when(F.col("key") <= cuts[k], F.lit(k)).otherwise(shard)
    placed = base.withColumn("shard", shard.cast("int")).select(
        "*",
        F.shiftright("key", KEY_BITS - SLOT_BUCKETS.bit_length() + 1).alias("bucket"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_SALTS)).alias("salt"),
    )
    return number_rows(placed, ["shard"], ["bucket", "salt"], ["key", "doc_id"], "slot")


def number_rows(df: DataFrame, group: list[str], cell: list[str], order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within each ``group``, by ``cell`` and then ``order``, a cell at a time.

    Only a cell's rows meet in one task.  The cells' counts are summed up within each group.
    """
    before = Window.partitionBy(*group).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*group, *cell).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_start", *(F.col(c).alias(f"_of_{c}") for c in (*group, *cell)))
    within = Window.partitionBy(*group, *cell).orderBy(*order)
    numbered = df.withColumn("_row", F.row_number().over(within))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*group, *cell)))
    return numbered.join(starts, same).select(*df.columns, (F.col("_start") + F.col("_row") - 1).cast("bigint").alias(name))
