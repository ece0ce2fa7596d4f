"""Dependency graphs as two tables: nodes (id, layer) and edges (from_id, to_id, edge_type), to_id needing from_id."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaline.session import cut_lineage

BLOCKING = ("requires", "validates")


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(id, side) of the direct predecessors and successors of a node."""
    before = edges.where(F.col("to_id") == node).select(F.col("from_id").alias("id"), F.lit("predecessor").alias("side"))
    return before.unionByName(edges.where(F.col("from_id") == node).select(F.col("to_id").alias("id"), F.lit("successor").alias("side"))).distinct()


def frontier(nodes: DataFrame, edges: DataFrame, done: DataFrame, blocking: Sequence[str] = BLOCKING) -> DataFrame:
    """Nodes not done whose blocking predecessors all are."""
    open_edges = edges.where(F.col("edge_type").isin(*blocking)).join(done.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    return nodes.join(done.select("id"), "id", "left_anti").join(open_edges.select(F.col("to_id").alias("id")), "id", "left_anti").select("id", "layer")


def progress(nodes: DataFrame, done: DataFrame) -> DataFrame:
    j = nodes.join(done.select("id", F.lit(1).alias("__d")).distinct(), "id", "left")
    return j.groupBy("layer").agg(F.count(F.lit(1)).alias("total"), F.count("__d").alias("done"))


def backward_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Required dependencies that point from a higher layer to a lower one."""
    a, b = nodes.select(F.col("id").alias("from_id"), F.col("layer").alias("lf")), nodes.select(F.col("id").alias("to_id"), F.col("layer").alias("lt"))
    return edges.where(F.col("edge_type") == "requires").join(a, "from_id").join(b, "to_id").where(F.col("lf") > F.col("lt")).select("from_id", "to_id", "lf", "lt")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends that are no node."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def topological(edges: Iterable[tuple[str, str]], nodes: Iterable[str]) -> tuple[list[str], list[str]]:
    """(order, nodes on or behind cycles) of a graph small enough for the driver; ties in name order."""
    import heapq

    after: dict[str, list[str]] = {n: [] for n in nodes}
    waiting = dict.fromkeys(after, 0)
    for a, b in edges:
        if a in after and b in after:
            after[a].append(b)
            waiting[b] += 1
    ready = [n for n, k in waiting.items() if not k]
    heapq.heapify(ready)
    order = []
    while ready:
        order.append(n := heapq.heappop(ready))
        for b in after[n]:
            waiting[b] -= 1
            if not waiting[b]:
                heapq.heappush(ready, b)
    return order, sorted(n for n in after if waiting[n] > 0)


#: (1 - step) to this power is below the rounding of a double at the default step; older outcomes change nothing
MEMORY = 400


def stuck(nodes: DataFrame, edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(id) of the nodes on or behind a cycle: round by round, nodes that wait for no other are taken away with their edges.

    The number of rounds is the depth of the graph; each keeps its edges in the shared checkpoint folder. Edges whose ends
    are no nodes are ignored.
    """
    ids = nodes.select("id").distinct()
    left = edges.select("from_id", "to_id").distinct().join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    left = cut_lineage(left)
    size = left.count()
    for _ in range(rounds):
        kept = cut_lineage(left.join(left.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi"))
        now = kept.count()
        if now == size:
            return kept.select(F.col("to_id").alias("id")).unionByName(kept.select(F.col("from_id").alias("id"))).distinct()
        left, size = kept, now
    raise ValueError(f"more than {rounds} rounds")


def weights(history: DataFrame, keys: Sequence[str], order: str, outcome: str, step: float = 0.1, start: float = 0.5, memory: int = MEMORY) -> DataFrame:
    """Exponential moving average of outcomes in order: w = (1 - step) w + step outcome.

    In closed form a sum over the outcomes by their rank from the end, so no key's history is gathered: the last
    `memory` outcomes are picked with a limit on the map side, older ones weigh less than a double can show.
    """
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    recent = history.select(*keys, order, F.col(outcome).cast("double").alias("__x")).withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= memory)
    tail = recent.groupBy(*keys).agg(F.sum(F.col("__x") * step * F.pow(F.lit(1 - step), F.col("__r") - 1)).alias("__s"))
    size = history.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__n"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return tail.join(size, on).select(*keys, (F.col("__s") + start * F.pow(F.lit(1 - step), F.col("__n"))).alias("weight"))


def laplace(uses: DataFrame, keys: Sequence[str], success: str) -> DataFrame:
    g = uses.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(success)).alias("s"))
    return g.select(*keys, ((F.col("s") + 1) / (F.col("n") + 2)).alias("score"))


def schedule(items: DataFrame, budget: int, share: float = 0.25, least: int = 100) -> DataFrame:
    """Greedy allocation of a budget to (grp, name, priority, tokens, current): by priority, then name.

    An item that fits is loaded, but one that isn't current gets at most `share` of the budget; one that doesn't fit
    is cut to what is left if that is at least `least`, else dropped.
    """
    cap = int(budget * share)
    g = items.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct((-F.col("priority")).alias("p"), "name", "tokens", "current"))).alias("q"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<name:string,given:bigint,status:string>>").alias("out"))

    def put(s, x):
        left = F.lit(budget) - s["used"]
        t = x["tokens"].cast("long")
        capped = (t > cap) & ~x["current"]
        status = F.when(left <= 0, "dropped").when(t <= left, F.when(capped, "truncated").otherwise("loaded")).when(left >= least, "truncated").otherwise("dropped")
        given = F.when(status == "dropped", F.lit(0).cast("long")).when(status == "loaded", t).otherwise(F.when(t <= left, F.lit(cap).cast("long")).otherwise(left.cast("long")))
        return F.struct((s["used"] + given).alias("used"), F.concat(s["out"], F.array(F.struct(x["name"].alias("name"), given.alias("given"), status.alias("status")))).alias("out"))

    return g.select("grp", F.inline(F.aggregate("q", zero, put, lambda s: s["out"])))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def similar_each(items: DataFrame, queries: DataFrame, vector: str, id_col: str, k: int, least: float) -> DataFrame:
    """(query_id, id, rank, score): for every row of queries the k items of highest cosine similarity, at least `least`.

    Every query meets every item; each task keeps its k best of a query before anything is shuffled.
    """
    v = F.col(vector)
    a = items.select(id_col, v.cast("array<double>").alias("__a"), F.sqrt(_dot(v, v)).alias("__n"))
    b = queries.select(F.col(id_col).alias("query_id"), v.cast("array<double>").alias("__b"), F.sqrt(_dot(v, v)).alias("__m"))
    scored = a.crossJoin(b).select("query_id", id_col, F.try_divide(_dot(F.col("__a"), F.col("__b")), F.col("__n") * F.col("__m")).alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
