"""Tables and statistics: grouped aggregates in long numeric form; formatting belongs to sinks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaline.operators.ranks import ranked


def descriptive(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, sd (0 for one value), median, min, max of a numeric column per group."""
    v = F.col(value).cast("double")
    out = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.withColumn("sd", F.when(F.col("n") == 1, 0.0).otherwise(F.col("sd")))


def demographics(subjects: DataFrame, arm: str, age: str, categories: Sequence[tuple[str, str, Sequence[str]]]) -> DataFrame:
    """Rows (block, item, arm, value): age statistics and n and percent of each category; the arm's size is the base."""
    d = descriptive(subjects, [arm], age)
    stats = F.array(*[F.struct(F.lit(s).alias("item"), F.col(s).cast("double").alias("value")) for s in ("n", "mean", "sd", "median", "min", "max")])
    parts = [d.select(F.lit("AGE").alias("block"), F.col(arm).alias("arm"), F.inline(stats))]
    aggs, names = [], []
    for block, col, values in categories:
        for k, v in enumerate(values):
            aggs.append(F.count_if(F.upper(F.col(col)) == v).cast("double").alias(f"__{len(names)}"))
            names.append((block, v))
    g = subjects.groupBy(F.col(arm).alias("arm")).agg(F.count(F.lit(1)).alias("__n"), *aggs)
    cells = [F.struct(F.lit(b).alias("block"), F.lit(f"{v} {s}").alias("item"), x.alias("value")) for i, (b, v) in enumerate(names) for s, x in (("n", F.col(f"__{i}")), ("pct", F.col(f"__{i}") / F.col("__n") * 100))]
    parts.append(g.select("arm", F.inline(F.array(*cells))).select("block", "arm", "item", "value"))
    return parts[0].select("block", "item", "arm", "value").unionByName(parts[1].select("block", "item", "arm", "value"))


def arm_sizes(subjects: DataFrame, arm: str) -> DataFrame:
    """Subjects per arm and in total."""
    g = subjects.rollup(arm).agg(F.count(F.lit(1)).alias("n"), F.grouping(arm).alias("__g"))
    return g.select(F.when(F.col("__g") == 1, "Total").otherwise(F.col(arm)).alias("arm"), "n")


def frequency(events: DataFrame, subjects: DataFrame, levels: Sequence[str], arm: str = "arm") -> DataFrame:
    """Subjects and records per level and arm, with zero cells, a Total arm and percent of the arm's subjects.

    events has usubjid, the levels and the arm, and an arm is a property of the subject, so one count of subjects per
    level and arm also gives the total. The zero cells come from the arm sizes, a scalar subquery.
    """
    e = events.groupBy(*levels, arm, "usubjid").agg(F.count(F.lit(1)).alias("r"))
    cell = F.struct(F.col(arm).alias("arm"), F.col("s").alias("s"), F.col("r").alias("r"))
    per = e.groupBy(*levels, arm).agg(F.count(F.lit(1)).alias("s"), F.sum("r").alias("r")).groupBy(*levels).agg(F.collect_list(cell).alias("cells"), F.sum("s").alias("ts"), F.sum("r").alias("tr"))
    sizes = arm_sizes(subjects, arm).agg(F.collect_list(F.struct("arm", "n")).alias("arms"))  # one row; arms are the columns of a table
    out = per.withColumn("arms", sizes.scalar()).select(*levels, "cells", "ts", "tr", F.inline("arms"))
    mine = F.get(F.filter("cells", lambda c: c["arm"].eqNullSafe(F.col("arm"))), F.lit(0))
    total = F.col("arm") == "Total"
    out = out.withColumn("n_subjects", F.when(total, F.col("ts")).otherwise(F.coalesce(mine["s"], F.lit(0)))).withColumn("n_records", F.when(total, F.col("tr")).otherwise(F.coalesce(mine["r"], F.lit(0))))
    return out.select(*levels, "arm", "n_subjects", "n_records", F.when(F.col("n") > 0, F.col("n_subjects") / F.col("n") * 100).alias("pct"))


def shift_table(rows: DataFrame, by: Sequence[str], base: str = "bnrind", post: str = "anrind", codes: Sequence[str] = ("L", "N", "H")) -> DataFrame:
    """Counts of baseline against later indicator."""
    return rows.where(F.col(base).isNotNull()).groupBy(*by, base).pivot(post, list(codes)).count().na.fill(0, list(codes))


def at_risk(tte: DataFrame, by: Sequence[str], time: str = "aval", censor: str = "cnsr") -> DataFrame:
    """Per distinct time: d events, c censored, n at risk (whose time is at least this)."""
    g = tte.groupBy(*by, time).agg(F.count_if(F.col(censor) == 0).alias("d"), F.count_if(F.col(censor) != 0).alias("c"))
    w = Window.partitionBy(*by).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("n", F.sum(F.col("d") + F.col("c")).over(w))


def kaplan_meier(tte: DataFrame, by: Sequence[str], time: str = "aval") -> DataFrame:
    """Survival after each time with an event; 0 from the time on at which all at risk have it."""
    r = at_risk(tte, by, time).where(F.col("d") > 0)
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    gone = F.max(F.when(F.col("d") == F.col("n"), 1).otherwise(0)).over(w)
    log = F.sum(F.when(F.col("d") < F.col("n"), F.log(1 - F.col("d") / F.col("n"))).otherwise(0.0)).over(w)
    return r.select(*by, time, "n", "d", F.when(gone == 1, 0.0).otherwise(F.exp(log)).alias("surv"))


def log_rank(tte: DataFrame, strata: Sequence[str], arm: str, test: str, time: str = "aval", censor: str = "cnsr") -> DataFrame:
    """Observed, expected, variance, chi-square and O/E hazard ratio of arm `test` against all others, per stratum set."""
    mine = (F.col(arm) == test).cast("int")
    g = tte.groupBy(*strata, time).agg(F.count_if(F.col(censor) == 0).alias("d"), F.count(F.lit(1)).alias("k"), F.sum(F.when(F.col(censor) == 0, mine).otherwise(0)).alias("d1"), F.sum(mine).alias("k1"))
    w = Window.partitionBy(*strata).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("n", F.sum("k").over(w)).withColumn("n1", F.sum("k1").over(w)).where(F.col("d") > 0)
    n, n1, d = F.col("n").cast("double"), F.col("n1").cast("double"), F.col("d").cast("double")
    e = d * n1 / n
    v = F.when(n > 1, d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)).otherwise(0.0)
    out = g.groupBy(*strata).agg(F.sum("d1").alias("observed"), F.sum("d").alias("events"), F.sum(e).alias("expected"), F.sum(v).alias("variance"))
    o, x = F.col("observed"), F.col("expected")
    rest_o, rest_e = F.col("events") - o, F.col("events") - x
    return out.withColumn("chisq", F.try_divide((o - x) * (o - x), F.col("variance"))).withColumn("hr", F.try_divide(F.try_divide(o, x), F.try_divide(rest_o, rest_e)))


def cmh(df: DataFrame, stratum: str, exposed: Column, case: Column, by: Sequence[str] = ()) -> DataFrame:
    """Cochran-Mantel-Haenszel chi-square (no correction) and common odds ratio over strata."""
    g = df.groupBy(*by, stratum).agg(
        F.count_if(exposed & case).cast("double").alias("a"), F.count_if(exposed & ~case).cast("double").alias("b"), F.count_if(~exposed & case).cast("double").alias("c"), F.count_if(~exposed & ~case).cast("double").alias("d")
    )
    a, b, c, d = (F.col(x) for x in "abcd")
    n = a + b + c + d
    g = g.where(n > 1)
    terms = g.select(*by, (a - (a + b) * (a + c) / n).alias("x"), ((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).alias("v"), (a * d / n).alias("p"), (b * c / n).alias("q"))
    out = terms.groupBy(*by).agg(F.sum("x").alias("x"), F.sum("v").alias("v"), F.sum("p").alias("p"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("strata"))
    return out.select(*by, "strata", F.try_divide(F.col("x") * F.col("x"), F.col("v")).alias("chisq"), F.try_divide("p", "q").alias("odds_ratio"))


def ancova(df: DataFrame, by: Sequence[str], y: str, covariate: str, treated: Column) -> DataFrame:
    """Treatment effect adjusted for one covariate, from sums of squares and products within arms."""
    t = treated.cast("int")
    g = df.where(F.col(y).isNotNull() & F.col(covariate).isNotNull()).groupBy(*by, t.alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(covariate).alias("mx"), F.covar_pop(y, covariate).alias("cxy"), F.var_pop(covariate).alias("vx")
    )
    def pick(c: str, k: int) -> Column:
        return F.max(F.when(F.col("t") == k, F.col(c)))

    w = g.groupBy(*by).agg(F.sum(F.col("n") * F.col("cxy")).alias("sxy"), F.sum(F.col("n") * F.col("vx")).alias("sxx"), *[pick(c, k).alias(f"{c}{k}") for c in ("n", "my", "mx") for k in (0, 1)])
    slope = F.try_divide("sxy", "sxx")
    return w.select(*by, F.col("n0").alias("n_control"), F.col("n1").alias("n_treated"), slope.alias("slope"), ((F.col("my1") - F.col("my0")) - slope * (F.col("mx1") - F.col("mx0"))).alias("effect"))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of a 2x2 table that an aggregation has already reduced to four counts."""
    def log_p(x: int) -> float:
        return math.fsum(s * math.lgamma(k + 1) for s, k in ((1, a + b), (1, c + d), (1, a + c), (1, b + d), (-1, a + b + c + d), (-1, x), (-1, a + b - x), (-1, a + c - x), (-1, d - a + x)))

    here = log_p(a)
    return min(1.0, math.fsum(math.exp(p) for x in range(max(0, a - d), min(a + b, a + c) + 1) if (p := log_p(x)) <= here + 1e-9))


def paginate(df: DataFrame, order: Sequence[str], by: Sequence[str], lines: int) -> DataFrame:
    """Row and page number within each listing (for instance a study or site); the first column of the order splits it."""
    return ranked(df, by, order, F.col(order[0]), "row").withColumn("page", F.ceil(F.col("row") / lines).cast("int"))


def waterfall(rows: DataFrame, by: Sequence[str], best: str, tie: str) -> DataFrame:
    """Append rank: the largest value first; whole numbers of the value split the groups."""
    return ranked(rows, by, [F.desc(best), tie], F.floor(-F.col(best)), "rank")


def compare(prod: DataFrame, qc: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Cell by cell comparison of two results: match, differ, prod only, qc only."""
    j = prod.select(*keys, F.col(value).alias("prod"), F.lit(1).alias("__p")).join(qc.select(*keys, F.col(value).alias("qc"), F.lit(1).alias("__q")), list(keys), "full_outer")
    same = F.col("prod").eqNullSafe(F.col("qc")) | (F.abs(F.col("prod") - F.col("qc")) <= tolerance)
    status = F.when(F.col("__q").isNull(), "prod only").when(F.col("__p").isNull(), "qc only").when(same, "match").otherwise("differ")
    return j.select(*keys, "prod", "qc", status.alias("status"))


def _segments(length: Column, most: int) -> list[tuple[Column, Column]]:
    """(start from 0, length) of the most + 1 parts that a label of this length is cut into."""
    ends = [F.floor(length * i / (most + 1)).cast("int") for i in range(most + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _candidates(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """Pairs (l, r) that may be within `most` edits; none that is gets lost.

    So many edits leave one of r's most + 1 parts as it is, in l at most that many places away; that part is the key.
    """
    n = F.length("r")
    right = F.array(*[F.struct(n.alias("n"), F.lit(i).alias("i"), F.substr("r", at + 1, size).alias("part")) for i, (at, size) in enumerate(_segments(n, most))])
    left, m = [], F.length("l")
    for more in range(-most, most + 1):
        for i, (at, size) in enumerate(_segments(m + more, most)):
            for off in range(-most, most + 1):
                inside = (m + more >= 0) & (at + off >= 0) & (at + off + size <= m)
                left.append(F.when(inside, F.struct((m + more).alias("n"), F.lit(i).alias("i"), F.substr("l", at + off + 1, size).alias("part"))))
    lk = a.select("l", F.explode(F.array_distinct(F.array_compact(F.array(*left)))).alias("k"))
    rk = b.select("r", F.explode(right).alias("k"))
    return lk.select("l", "k.*").join(rk.select("r", "k.*"), ["n", "i", "part"]).select("l", "r").distinct()


def fuzzy_labels(left: DataFrame, right: DataFrame, label: str, most: int) -> DataFrame:
    """Closest label of the right side for every left label without an exact partner, within `most` edits.

    Candidates come from an index over parts of the labels that is complete for `most` edits.
    """
    a = left.select(F.col(label).alias("l")).distinct().join(right.select(F.col(label).alias("l")).distinct(), "l", "left_anti")
    j = _candidates(a, right.select(F.col(label).alias("r")).distinct(), most)
    j = j.withColumn("edits", F.levenshtein("l", "r")).where(F.col("edits") <= most)
    return j.groupBy("l").agg(F.min_by(F.struct("r", "edits"), F.struct("edits", "r")).alias("m")).select("l", "m.r", "m.edits")
