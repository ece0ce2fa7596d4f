"""Problem 7: texts of varying length packed into containers of fixed capacity.

Only the histogram of lengths reaches the driver (at most one row per length up to the capacity, whatever the data).
Shortest-pack-first places the lengths longest first, each into the open packs with the most free space, and keeps
counts of packing patterns instead of packs. The patterns give every length ranges of ranks, and a document finds
its pack by its rank among the documents of its length. Ranks are taken in hash buckets with offsets from bucket
counts, as many as the largest count needs, so a length that a third of all documents share is ranked by many tasks;
ranks and ranges meet by an equi-join on blocks of ranks.

Defined results: a text longer than the capacity is cut into full packs and one remainder that is packed like any
other item; no other text is cut; texts without tokens are listed with a null pack; repeated rows are items of
their own; an empty table gives no packs.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows of one length that one task ranks at most, and buckets at least
BUCKET_ROWS, BUCKETS = 1_000_000, 64
#: ranks per block; a document is compared only with the ranges that lie in its block
BLOCK = 4096


@dataclass
class Pattern:
    """`count` packs that all hold the same lengths; holds maps a length to how often it occurs."""

    count: int
    free: int
    holds: dict[int, int]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that together hold every item of the histogram (lengths within 1..capacity)."""
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("lengths must lie within the capacity")
    done: list[Pattern] = []
    heap: list[tuple[int, int, Pattern]] = []  # the shortest pack, that is most free space, first
    serial = 0
    least = min(histogram, default=0)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if not heap or -heap[0][0] < length:
                # opened one by one, a new pack would be the shortest until it is full of this length
                times = min(capacity // length, left)
                new = Pattern(left // times, capacity - times * length, {length: times})
                left -= new.count * times
            else:
                old = heapq.heappop(heap)[2]
                take = min(left, old.count)
                if take < old.count:
                    serial += 1
                    heapq.heappush(heap, (-old.free, serial, Pattern(old.count - take, old.free, dict(old.holds))))
                holds = old.holds
                holds[length] = holds.get(length, 0) + 1
                new = Pattern(take, old.free - length, holds)
                left -= take
            serial += 1
            if new.free < least:
                done.append(new)
            else:
                heapq.heappush(heap, (-new.free, serial, new))
    return done + [p for _, _, p in sorted(heap, key=lambda h: h[1])]


def rank_ranges(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, start, end, first_pack, times): ranks start..end-1 of a length fill packs from first_pack on, `times` a pack."""
    out, used, pack = [], {}, 0
    for p in patterns:
        for length, times in p.holds.items():
            start = used.get(length, 0)
            used[length] = start + p.count * times
            out.append((length, start, used[length], pack, times))
        pack += p.count
    return out


def ranked(items: DataFrame, group: list[str], order: list[str], buckets: int) -> DataFrame:
    """Append rank (0-based) of each row among the rows of its group, without one task per group."""
    b = items.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    within = F.row_number().over(Window.partitionBy(*group, "__b").orderBy(*order)) - 1
    return b.withColumn("__w", within).join(offsets, [*group, "__b"]).withColumn("rank", F.col("__o") + F.col("__w")).drop("__b", "__c", "__o", "__w")


def items_of(sized: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """(pack_id, doc_id, part, n_tokens) of every text and capacity; only texts over the capacity have several parts."""
    caps = F.array(*[F.struct(F.lit(i).alias("pack_id"), F.lit(c).cast("long").alias("cap")) for i, c in capacities])
    n, cap = F.col("n_tokens"), F.col("cap")
    each = sized.select("doc_id", "n_tokens", F.inline(caps))
    last = F.greatest(F.ceil(n / cap) - 1, F.lit(0)).cast("int")
    parts = each.select("pack_id", "doc_id", "cap", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return parts.select("pack_id", "doc_id", "part", F.least(cap, n - F.col("part") * cap).cast("long").alias("n_tokens"))


def pack(sized: DataFrame, capacities: list[tuple[int, int]], buckets: int | None = None, block: int = BLOCK) -> DataFrame:
    """(pack_id, doc_id, part, n_tokens, pack_no): sized has doc_id and n_tokens, capacities are (pack_id, tokens).

    sized is read twice; give a materialised table. pack_no numbers the packs of one pack_id from 0.
    """
    if len({i for i, _ in capacities}) != len(capacities) or any(c is None or c < 1 for _, c in capacities):
        raise ValueError("capacities need different ids and at least one token")
    items = items_of(sized, capacities)
    filled = items.where(F.col("n_tokens") > 0)
    histograms: dict[int, dict[int, int]] = {i: {} for i, _ in capacities}
    for i, length, count in filled.groupBy("pack_id", "n_tokens").agg(F.count(F.lit(1))).collect():  # at most one row per length up to a capacity
        histograms[i][length] = count
    ranges = [(i, *r) for i, cap in capacities for r in rank_ranges(shortest_pack_first(histograms[i], cap))]
    spark = sized.sparkSession
    table = spark.createDataFrame(ranges, "pack_id int, n_tokens long, start long, end long, first long, times long")
    blocks = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)))
    table = table.select("*", blocks.alias("__block"))
    buckets = buckets or max(BUCKETS, -(-max((n for h in histograms.values() for n in h.values()), default=0) // BUCKET_ROWS))
    placed = ranked(filled, ["pack_id", "n_tokens"], ["doc_id", "part"], buckets).withColumn("__block", F.floor(F.col("rank") / block))
    placed = placed.join(table, ["pack_id", "n_tokens", "__block"]).where((F.col("start") <= F.col("rank")) & (F.col("rank") < F.col("end")))
    placed = placed.select("pack_id", "doc_id", "part", "n_tokens", (F.col("first") + F.floor((F.col("rank") - F.col("start")) / F.col("times"))).cast("long").alias("pack_no"))
    return placed.unionByName(items.where(F.col("n_tokens") <= 0).select("pack_id", "doc_id", "part", "n_tokens", F.lit(None).cast("long").alias("pack_no")))


def fill(packs: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """Per capacity: packs, tokens and the share of the space that is used."""
    cap = F.create_map(*[x for i, c in capacities for x in (F.lit(i), F.lit(c).cast("long"))])[F.col("pack_id")]
    per = packs.where(F.col("pack_no").isNotNull()).groupBy("pack_id", "pack_no").agg(F.sum("n_tokens").alias("t"))
    out = per.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_packs"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    return out.select("pack_id", cap.alias("capacity_tokens"), "n_packs", "n_tokens", "fullest", F.round(F.col("n_tokens") / (F.col("n_packs") * cap), 6).alias("fill_share"))
