"""Problem 8: records of several sources combined to target shares of all tokens, with capped repetition.

Documents are aggregated by membership pattern (the set of sources they belong to), so the driver sees one row per
pattern. A min-cost flow routes tokens from patterns to the sources' quotas; the r-th use of a document costs r
squared, so small sources are repeated only as far as needed and evenly. Without a given size the largest total is
taken at which every quota can be met. A pattern's flow is then an interval of tokens on repeated passes over its
documents in seeded order, and a document's uses follow from its place on that line in closed form. Places are
prefix sums over hash buckets, so a source that holds most documents is summed by many tasks.

Defined results: each source gets its quota up to one document at each end of its interval; documents without
tokens or without a listed source are not used; a source that has a target but no tokens makes the total 0 unless a
size is given, and then stays short (the report shows it); ties in the seeded order fall to doc_id.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows of a pattern that one task sums at most, and buckets at least
BUCKET_ROWS, BUCKETS = 1_000_000, 64
#: 385 patterns of ten sources took 2.4 seconds of the driver; the time grows about with the square
MAX_PATTERNS = 1_000


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


@dataclass
class Network:
    """Flow network with integer capacities and costs."""

    heads: list[list[int]] = field(default_factory=list)
    to: list[int] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)

    def node(self) -> int:
        self.heads.append([])
        return len(self.heads) - 1

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.heads[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def reachable(self, s: int) -> set[int]:
        """Nodes that could still get flow from s."""
        seen, stack = {s}, [s]
        while stack:
            for e in self.heads[stack.pop()]:
                if self.room[e] > 0 and self.to[e] not in seen:
                    seen.add(self.to[e])
                    stack.append(self.to[e])
        return seen

    def send(self, s: int, t: int) -> int:
        """Largest flow of least cost, along successive cheapest paths; the amount sent."""
        total = 0
        while True:
            far = [None] * len(self.heads)
            by = [-1] * len(self.heads)
            far[s] = 0
            queue, waiting = deque([s]), {s}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for e in self.heads[a]:
                    b = self.to[e]
                    if self.room[e] > 0 and (far[b] is None or far[a] + self.cost[e] < far[b]):
                        far[b], by[b] = far[a] + self.cost[e], e
                        if b not in waiting:
                            waiting.add(b)
                            queue.append(b)
            if far[t] is None:
                return total
            amount, b = None, t
            while b != s:
                amount = self.room[by[b]] if amount is None else min(amount, self.room[by[b]])
                b = self.to[by[b] ^ 1]
            b = t
            while b != s:
                self.room[by[b]] -= amount
                self.room[by[b] ^ 1] += amount
                b = self.to[by[b] ^ 1]
            total += amount


def _network(patterns: list[tuple[tuple[str, ...], int]], targets: list[Target], total: int, priced: bool) -> tuple[Network, int, int, dict[str, int], dict[tuple[int, str], int]]:
    """(network, source, sink, node per target, edge per pattern and member); unpriced, all uses of a pattern are one free edge."""
    net = Network()
    s, t = net.node(), net.node()
    by_source = {x.source: x for x in targets}
    sinks, edges = {}, {}
    for x in targets:
        sinks[x.source] = net.node()
        net.edge(sinks[x.source], t, int(x.share * total))
    for k, (members, tokens) in enumerate(patterns):
        p = net.node()
        uses = max(by_source[m].max_repeats for m in members)
        for room, cost in [(tokens, r * r) for r in range(1, uses + 1)] if priced else [(tokens * uses, 0)]:
            net.edge(s, p, room, cost)
        for m in members:
            edges[k, m] = net.edge(p, sinks[m], tokens * by_source[m].max_repeats)
    return net, s, t, sinks, edges


def route(patterns: list[tuple[tuple[str, ...], int]], targets: list[Target], total: int) -> tuple[dict[tuple[int, str], int], int]:
    """Flow of tokens per (pattern number, source) to the quotas of `total`, and the sum of the flow."""
    net, s, t, _, edges = _network(patterns, targets, total, priced=True)
    sent = net.send(s, t)
    return {k: net.room[e ^ 1] for k, e in edges.items() if net.room[e ^ 1] > 0}, sent


def largest_total(patterns: list[tuple[tuple[str, ...], int]], targets: list[Target]) -> int:
    """The largest total at which every source's quota can be met, up to the rounding of the quotas.

    While a total is too large, the smallest cut names sources whose quotas together exceed what can reach them; the total at
    which just these are met is the next to try. That takes few rounds, one flow without costs each.
    """
    total = sum(n for _, n in patterns) * max((x.max_repeats for x in targets), default=0)
    share = {x.source: x.share for x in targets}
    while total > 0:
        net, s, t, sinks, _ = _network(patterns, targets, total, priced=False)
        sent, quotas = net.send(s, t), {m: int(f * total) for m, f in share.items()}
        if sent == sum(quotas.values()):
            return total
        reached = net.reachable(s)
        short = [m for m in share if sinks[m] not in reached]
        supply = sent - sum(q for m, q in quotas.items() if m not in short)
        total = min(total - 1, int(supply / sum(share[m] for m in short)))
    return 0


def by_text(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, sources, ids) of the distinct texts of docs (doc_id, source, n_tokens, text_key).

    A text sent to several sources belongs to all of them, and however often it was sent it is one document, so a cap on
    its uses holds over its copies; ids names the smallest doc_id of each source. Documents without tokens are left out.
    """
    each = docs.where("n_tokens > 0 and source is not null").groupBy("text_key", "source").agg(F.min("doc_id").alias("d"), F.first("n_tokens").alias("n"))
    cells = F.sort_array(F.collect_list(F.struct("source", "d")))  # at most one cell per source
    return each.groupBy("text_key").agg(F.min("d").alias("doc_id"), F.first("n").alias("n_tokens"), cells.alias("c")).select("doc_id", "n_tokens", F.col("c.source").alias("sources"), F.map_from_entries("c").alias("ids"))


def places(docs: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Append c: tokens before the document in its pattern's seeded order."""
    h = docs.withColumn("__h", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    # buckets are ranges of the hash, so bucket order and order within buckets make one order
    h = h.withColumn("__b", (F.floor((F.col("__h").cast("double") / 2.0**63 + 1.0) / 2.0 * buckets)).cast("int"))
    sums = h.groupBy("pattern", "__b").agg(F.sum("n_tokens").alias("__s"))
    before = Window.partitionBy("pattern").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("pattern", "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    within = Window.partitionBy("pattern", "__b").orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("__w", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return h.join(offsets, ["pattern", "__b"]).withColumn("c", F.col("__o") + F.col("__w")).drop("__h", "__b", "__s", "__o", "__w")


def mix(sized: DataFrame, targets: list[Target], total: int | None = None, seed: int = 17, buckets: int | None = None) -> DataFrame:
    """(source, doc_id, n_tokens, uses) of the documents used: sized has doc_id, n_tokens and sources (array of names).

    sized is read twice; give a materialised table. A document of several sources may be used for each of them; with a
    column ids (source to doc_id) it goes by the id it has there.
    """
    if len({x.source for x in targets}) != len(targets) or any(x.share < 0 or x.max_repeats < 0 for x in targets) or sum(x.share for x in targets) > 1 + 1e-6:
        raise ValueError("targets need different sources and shares that sum to 1")
    spark = sized.sparkSession
    listed = F.array(*[F.lit(x.source) for x in targets]).cast("array<string>")
    members = F.array_sort(F.array_intersect(F.filter("sources", lambda x: x.isNotNull()), listed))
    ids = F.col("ids") if "ids" in sized.columns else F.lit(None).cast(f"map<string,{dict(sized.dtypes)['doc_id']}>")
    docs = sized.select("doc_id", "n_tokens", ids.alias("ids"), F.array_join(members, "\u001f").alias("pattern")).where((F.col("pattern") != "") & (F.col("n_tokens") > 0))
    rows = docs.groupBy("pattern").agg(F.sum("n_tokens"), F.count(F.lit(1))).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = sorted((tuple(p.split("\u001f")), n) for p, n, _ in rows)
    buckets = buckets or max(BUCKETS, -(-max((c for *_, c in rows), default=0) // BUCKET_ROWS))
    size = largest_total(patterns, targets) if total is None else total
    flows, _ = route(patterns, targets, size)
    plan, start = [], {}
    for (k, source), f in sorted(flows.items()):
        name, tokens = "\u001f".join(patterns[k][0]), patterns[k][1]
        plan.append((name, source, start.get(k, 0), f, tokens))
        start[k] = start.get(k, 0) + f
    intervals = spark.createDataFrame(plan, "pattern string, source string, a long, f long, t long")
    a, f, t, c = (F.col(x) for x in "aftc")

    def passes(x):  # passes over the pattern that start before token x of the line
        return F.ceil((x - c).cast("decimal(38,0)") / t.cast("decimal(38,0)"))

    used = places(docs, buckets, seed).join(intervals, "pattern")
    used = used.withColumn("uses", (F.greatest(passes(a + f), F.lit(0)) - F.greatest(passes(a), F.lit(0))).cast("int"))
    return used.where(F.col("uses") > 0).select("source", F.coalesce(F.col("ids")[F.col("source")], F.col("doc_id")).alias("doc_id"), "n_tokens", "uses")


def shares(mixture: DataFrame, targets: list[Target]) -> DataFrame:
    """Per target source: share asked for, tokens and share reached, documents and the most uses of one."""
    spark = mixture.sparkSession
    t = spark.createDataFrame([(x.source, float(x.share), x.max_repeats) for x in targets], "source string, target_share double, max_repeats int")
    per = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("uses").alias("most_uses"))
    j = t.join(per, "source", "left").select("source", "target_share", "max_repeats", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("tokens", "n_docs", "most_uses")])
    total = F.sum("tokens").over(Window.partitionBy())  # one row per target
    return j.select("*", F.round(F.try_divide(F.col("tokens").cast("double"), total.cast("double")), 6).alias("share"))
