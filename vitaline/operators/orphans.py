"""Problem 6: references to records that are missing, deleted or arrive later.

One operator, orphan_keys, does the work for both results. References are pre-aggregated per key and period (map-side
combine), so a key that holds a third of all rows becomes a few rows before anything is shuffled. Keys with more than a
share of all references are heavy, at most 1 / share of them: their parent state is broadcast and checked without moving
a row. The remaining keys meet the parents in a shuffle join, and both halves are united. What comes out is one row per
orphaned key and period, with counts; orphan_report sums them, orphan_rows goes back to the child rows of these keys,
those of heavy keys again by broadcast, the others by shuffle.

Defined results: a null or blank key refers to nothing (missing); parents with a null key are no parents; rows
without received_at have a null period and are never late; repeated child rows each count; an empty parent table
makes every reference missing; an empty child table gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline.functions.cols import key_norm

#: Keys with more than this share of all references are heavy, so there are at most 1 / SHARE of them.
SHARE = 0.001
_ALWAYS = "0001-01-01 00:00:00"


def parent_state(parent: DataFrame, key: str, deleted: str = "deleted_at", received: str = "received_at") -> DataFrame:
    """(k, live_from): per key the first arrival of a row that is not deleted, null where all are deleted.

    A live row without arrival time counts as always there.
    """
    live = F.when(F.col(deleted).isNull(), F.coalesce(F.col(received), F.lit(_ALWAYS).cast(parent.schema[received].dataType)))
    return parent.select(key_norm(F.col(key)).alias("k"), live.alias("__live")).where(F.col("k").isNotNull()).groupBy("k").agg(F.min("__live").alias("live_from"), F.lit(True).alias("found"))


def _rows(child: DataFrame, key: str, received: str, *more: Column) -> DataFrame:
    return child.select(key_norm(F.col(key)).alias("k"), F.col(received).alias("__at"), F.date_format(F.col(received), "yyyy-MM").alias("period"), *more)


def references(child: DataFrame, key: str, received: str = "received_at") -> DataFrame:
    """(k, period, n, first_at, last_at): the references of the child, one row per key and period; null keys refer to nothing."""
    rows = _rows(child, key, received).where(F.col("k").isNotNull())
    return rows.groupBy("k", "period").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first_at"), F.max("__at").alias("last_at"))


def heavy_keys(child: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """(k) of the keys with more than `share` of all rows; at most 1 / share of them, so they may be broadcast."""
    keys = child.select(key_norm(F.col(key)).alias("k"))
    total = keys.agg(F.count(F.lit(1)).alias("t")).scalar()
    return keys.where(F.col("k").isNotNull()).groupBy("k").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > total * share).select("k")


def _kind(first: Column, last: Column) -> Column:
    """late if the parent came after the last reference of the period, part if only after some of them."""
    live = F.col("live_from")
    return F.when(F.col("found").isNull(), "missing").when(live.isNull(), "deleted").when(live > last, F.when(live > first, "late")).when(live > first, "part")


def orphan_keys(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None, received: str = "received_at", share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """Heavy and other keys with a reference that does not hold: two frames (k, period, n, kind, live_from).

    kind is missing, deleted, late, or part where only the references before live_from are late. The first holds every
    heavy key, with a null kind in periods where all is well.
    """
    state, heavy = parent_state(parent, parent_key or key), heavy_keys(child, key, share)
    checked = heavy.join(state, "k", "left").select("k", F.lit(True).alias("heavy"), "live_from", "found")
    # both halves read the same pre-aggregated references; a left join keeps that one exchange, where a semi join would be
    # moved below it
    marked = references(child, key, received).join(F.broadcast(checked), "k", "left")
    kind = _kind(F.col("first_at"), F.col("last_at"))
    hot = marked.where("heavy").select("k", "period", "n", kind.alias("kind"), "live_from")
    cold = marked.where("heavy is null").select("k", "period", "n", "first_at", "last_at").join(state, "k", "left")
    return hot, cold.select("k", "period", "n", kind.alias("kind"), "live_from").where(F.col("kind").isNotNull())


def orphan_rows(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None, rec_id: str = "rec_id", received: str = "received_at", share: float = SHARE) -> DataFrame:
    """(rec_id, period, kind) of every child row whose reference does not hold when the row arrives."""
    hot, cold = orphan_keys(child, parent, key, parent_key, received, share)
    rows = _rows(child, key, received, F.col(rec_id).alias("rec_id"))

    def late(kind: Column, live: Column) -> Column:
        return F.when(kind.isin("missing", "deleted"), kind).when(live > F.col("__at"), "late")

    # one row per heavy key, with its periods (months), so this side is as bounded as the keys are
    cell = F.struct(F.coalesce("period", F.lit("")).alias("p"), F.struct("kind", "live_from").alias("v"))
    periods = hot.groupBy(F.col("k").alias("__k")).agg(F.map_from_entries(F.collect_list(cell)).alias("__m"))
    marked = rows.join(F.broadcast(periods), F.col("k") == F.col("__k"), "left")
    v = F.col("__m")[F.coalesce("period", F.lit(""))]
    direct = marked.where(F.col("k").isNull() | F.col("__k").isNotNull())
    direct = direct.select("rec_id", "period", F.when(F.col("k").isNull(), "missing").otherwise(late(v["kind"], v["live_from"])).alias("kind"))
    other = cold.select(F.col("k").alias("__c"), F.col("period").alias("__p"), "kind", "live_from")
    rest = marked.where(F.col("k").isNotNull() & F.col("__k").isNull()).select("rec_id", "k", "period", "__at")
    rest = rest.join(other, (F.col("k") == F.col("__c")) & F.col("period").eqNullSafe(F.col("__p"))).select("rec_id", "period", late(F.col("kind"), F.col("live_from")).alias("kind"))
    return direct.unionByName(rest).where(F.col("kind").isNotNull())


def orphan_report(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None, received: str = "received_at", share: float = SHARE) -> DataFrame:
    """(period, kind, n_rows, n_keys): the orphan counts of both halves united; only where a parent arrives within a
    period are that key's rows of the period counted one by one."""
    hot, cold = orphan_keys(child, parent, key, parent_key, received, share)
    found = hot.where("kind is not null").unionByName(cold)
    rows = _rows(child, key, received)
    none = rows.where(F.col("k").isNull()).groupBy("k", "period").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("missing"))
    part = rows.join(found.where("kind = 'part'").select("k", "period", "live_from"), ["k", "period"]).where(F.col("live_from") > F.col("__at"))
    split = part.groupBy("k", "period").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("late"))
    # each key stands once in a period and kind
    whole = found.where("kind <> 'part'").select("k", "period", "n", "kind")
    return whole.unionByName(split).unionByName(none).groupBy("period", "kind").agg(F.sum("n").alias("n_rows"), F.count("k").alias("n_keys"))
