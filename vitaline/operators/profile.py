"""Problem 3: column-level quality profile of loads, and departures between consecutive loads.

Numeric columns are described by mergeable exact power sums (count, sum, sum of squares as decimals) and by the
standardised difference of their means between loads, categorical ones by grouped distinct values; both combine on the
map side, so a load that holds a third of all rows costs one partial row per task and value. All comparisons of findings are made on integers by cross-multiplication, so a
share that equals a threshold exactly is never a finding.

Defined results: null and blank are missing; a load without rows does not exist; the first load and loads whose
neighbour has no filled values have no shift; rows without load_no form no load; an empty table has no profile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaline.functions.cols import filled

BIG = "decimal(38,0)"


@dataclass(frozen=True)
class Expectation:
    """What a column should hold: lo..hi for a numeric one, a codelist for a categorical one; shares in percent."""

    tab: str
    col: str
    lo: int | None = None
    hi: int | None = None
    codes: tuple[str, ...] = ()
    null_rise: int = 15
    range_share: int = 8
    pattern_share: int = 20
    mean_shift: int = 8
    share_shift: int = 22


def power_sums(df: DataFrame, col: str, lo: int, hi: int, load: str = "load_no") -> DataFrame:
    """Per load: n, missing, inside, outside, s1 and s2 (sum and sum of squares of the values within lo..hi)."""
    x = F.col(col).cast(BIG)
    inside = x.between(lo, hi)
    return (
        df.where(F.col(load).isNotNull())
        .groupBy(F.col(load).alias("load_no"))
        .agg(
            F.count(F.lit(1)).cast(BIG).alias("n"),
            F.count_if(filled(F.col(col)).isNull()).cast(BIG).alias("missing"),
            F.count_if(inside).cast(BIG).alias("inside"),
            F.count_if(~inside).cast(BIG).alias("outside"),
            F.coalesce(F.sum(F.when(inside, x)), F.lit(0)).cast(BIG).alias("s1"),
            F.coalesce(F.sum(F.when(inside, (x * x).cast(BIG))), F.lit(0)).cast(BIG).alias("s2"),
        )
    )


def squares(n: Column, s1: Column, s2: Column) -> Column:
    """Sum of squared deviations from the mean, exact up to its last step; null where it leaves 38 digits."""
    n, s1, s2 = (c.cast(BIG) for c in (n, s1, s2))
    return F.try_divide(F.try_subtract(F.try_multiply(n, s2).cast(BIG), F.try_multiply(s1, s1).cast(BIG)).cast("double"), n.cast("double"))


def deviation(n: Column, around: Column) -> Column:
    """Standard deviation of n values from the sum of their squared deviations; null for fewer than two."""
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), around) / (n.cast("double") - 1)))


def pooled_deviation(sd: Column, p_sd: Column) -> Column:
    return F.sqrt((sd * sd + p_sd * p_sd) / 2)


def standardised_difference(mean: Column, sd: Column, p_mean: Column, p_sd: Column) -> Column:
    """Difference of the means of two loads in units of their pooled deviation; null where there is no spread."""
    pooled = pooled_deviation(sd, p_sd)
    return F.when(pooled > 0, (mean - p_mean) / pooled)


def value_counts(df: DataFrame, col: str, load: str = "load_no") -> DataFrame:
    """Per load and value as written: rows; missing values are one group with a null value."""
    return df.where(F.col(load).isNotNull()).groupBy(F.col(load).alias("load_no"), filled(F.col(col)).alias("value")).agg(F.count(F.lit(1)).cast(BIG).alias("c"))


def _labelled(stats: DataFrame, e: Expectation, tests: dict[str, Column]) -> DataFrame:
    hits = F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()])
    return stats.select(F.lit(e.tab).alias("tab"), F.lit(e.col).alias("col"), "load_no", F.explode(F.array_compact(hits)).alias("finding"))


def _rise(e: Expectation) -> Column:
    m, n, pm, pn = (F.col(c) for c in ("missing", "n", "p_missing", "p_n"))
    return pn.isNotNull() & (((m * pn - pm * n) * 100) > n * pn * e.null_rise)


def numeric_findings(df: DataFrame, e: Expectation) -> DataFrame:
    """(tab, col, load_no, finding) of a numeric column: nulls, range, shift."""
    w = Window.orderBy("load_no")  # one row per load: the number of loads bounds it, not the data
    s = power_sums(df, e.col, e.lo, e.hi)
    i, s1 = F.col("inside"), F.col("s1")
    s = s.withColumn("mean", F.try_divide(s1.cast("double"), i.cast("double"))).withColumn("sd", deviation(i, squares(i, s1, F.col("s2"))))
    s = s.select("*", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("n", "missing", "inside", "s1", "mean", "sd")])
    pi, p1 = F.col("p_inside"), F.col("p_s1")
    # the standardised difference finds the shifts; what is decided at its rounding, or has no spread, is decided exactly
    d = standardised_difference(F.col("mean"), F.col("sd"), F.col("p_mean"), F.col("p_sd"))
    far = F.coalesce(F.abs(d) * pooled_deviation(F.col("sd"), F.col("p_sd")) > e.mean_shift - 1e-6, F.lit(True))
    return _labelled(s, e, {
        "nulls": _rise(e),
        "range": F.col("outside") * 100 > (F.col("inside") + F.col("outside")) * e.range_share,
        "shift": (i > 0) & (pi > 0) & far & (F.abs(s1 * pi - p1 * i) > i * pi * e.mean_shift),
    })


def categorical_findings(df: DataFrame, e: Expectation) -> DataFrame:
    """(tab, col, load_no, finding) of a categorical column: nulls, pattern, shift.

    The shares of two neighbouring loads are compared by sending each count to its own load and to the next one and
    summing per (load, value); that is one more aggregation over distinct values, not a join.
    """
    counts = value_counts(df, e.col)
    v, c = F.col("value"), F.col("c")
    totals = counts.groupBy("load_no").agg(
        F.sum(c).cast(BIG).alias("n"), F.coalesce(F.sum(F.when(v.isNull(), c)), F.lit(0)).cast(BIG).alias("missing"),
        F.coalesce(F.sum(F.when(v.isNotNull(), c)), F.lit(0)).cast(BIG).alias("filled"),
        F.coalesce(F.sum(F.when(~v.isin(*e.codes), c)), F.lit(0)).cast(BIG).alias("off"),
    )
    w = Window.orderBy("load_no")
    t = totals.select("*", F.lead("load_no").over(w).alias("next"), *[F.lag(x).over(w).alias(f"p_{x}") for x in ("n", "missing", "filled")])
    here = counts.where(v.isNotNull()).join(t.select("load_no", "next", "filled", "p_filled"), "load_no")
    zero = F.lit(0).cast(BIG)
    both = here.select(F.col("load_no"), "value", c.alias("now"), zero.alias("was")).unionByName(
        here.where(F.col("next").isNotNull()).select(F.col("next").alias("load_no"), "value", zero.alias("now"), c.alias("was"))
    )
    per = both.groupBy("load_no", "value").agg(F.sum("now").cast(BIG).alias("now"), F.sum("was").cast(BIG).alias("was"))
    diff = (
        per.join(t.select("load_no", "filled", "p_filled"), "load_no")
        .groupBy("load_no")
        .agg(F.sum(F.abs(F.col("now") * F.col("p_filled") - F.col("was") * F.col("filled")).cast(BIG)).cast(BIG).alias("diff"))
    )
    s = t.join(diff, "load_no", "left")
    f, pf = F.col("filled"), F.col("p_filled")
    return _labelled(s, e, {
        "nulls": _rise(e),
        "pattern": F.col("off") * 100 > f * e.pattern_share,
        "shift": (f > 0) & (pf > 0) & (F.col("diff") * 100 > f * pf * 2 * e.share_shift),
    })


def findings(tables: dict[str, DataFrame], expectations: list[Expectation]) -> DataFrame:
    out = None
    for e in expectations:
        one = (categorical_findings if e.codes else numeric_findings)(tables[e.tab], e)
        out = one if out is None else out.unionByName(one)
    return out


def _share_changes(counts: DataFrame) -> DataFrame:
    """(col, load_no, share_diff): half the sum over the values of the differences of their shares to the load before.

    As in categorical_findings, but of all columns at once: counts (col, load_no, value, c) go to their own load and to the
    next one. Null where one of the two loads has no filled value.
    """
    w, c, zero = Window.partitionBy("col").orderBy("load_no"), F.col("c"), F.lit(0).cast(BIG)
    totals = counts.groupBy("col", "load_no").agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), c)), zero).cast(BIG).alias("f"))
    t = totals.select("*", F.lag("f").over(w).alias("pf"), F.lead("load_no").over(w).alias("next"))
    here = counts.where(F.col("value").isNotNull()).join(t.select("col", "load_no", "next"), ["col", "load_no"])
    ends = F.array(F.struct(F.col("load_no"), c.alias("now"), zero.alias("was")), F.struct(F.col("next").alias("load_no"), zero.alias("now"), c.alias("was")))
    per = here.select("col", "value", F.explode(ends).alias("e")).where(F.col("e.load_no").isNotNull()).select("col", "value", "e.*").groupBy("col", "load_no", "value").agg(F.sum("now").cast(BIG).alias("now"), F.sum("was").cast(BIG).alias("was"))
    diff = F.sum(F.abs(F.col("now") * F.col("pf") - F.col("was") * F.col("f")).cast(BIG)).cast("double")
    return per.join(t.select("col", "load_no", "f", "pf").where("f > 0 and pf > 0"), ["col", "load_no"]).groupBy("col", "load_no").agg((diff / (2 * F.max(F.col("f").cast("double") * F.col("pf").cast("double")))).alias("share_diff"))


def profile(df: DataFrame, tab: str, patterns: dict[str, str] | None = None, load: str = "load_no") -> DataFrame:
    """Profile of every column and load: rows, missing, distinct values, range, violations of a pattern, mean, standard
    deviation and the change to the load before: the standardised difference of means of a numeric column, half the sum
    of the differences of the values' shares of any other one.

    Every cell is counted once as (column, load, value), so distinct counts are exact and duplicates collapse on the
    map side. Ranges compare numbers as numbers and anything else as text. The power sums of integer columns are exact
    decimals, those of fractions (and sums beyond 38 digits) doubles.
    """
    patterns = patterns or {}
    kinds = dict(df.dtypes)
    numeric = [c for c, k in kinds.items() if k in ("int", "bigint", "double", "float", "smallint", "tinyint") or k.startswith("decimal")]
    cols = [c for c in df.columns if c != load and not kinds[c].startswith(("array", "map", "struct", "binary"))]
    whole = [c for c in numeric if kinds[c].endswith("int") or kinds[c].endswith(",0)")]
    if not cols:
        raise ValueError("no column to profile")
    bad = {c: ~filled(F.col(f"`{c}`")).rlike(p) for c, p in patterns.items()}
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("col"), filled(F.col(f"`{c}`")).alias("value"),
            (F.col(f"`{c}`").cast("double") if c in numeric else F.lit(None).cast("double")).alias("num"),
            bad.get(c, F.lit(None).cast("boolean")).alias("bad"),
        ) for c in cols
    ])
    long = df.where(F.col(load).isNotNull()).select(F.col(load).alias("load_no"), F.inline(cells))
    groups = long.groupBy("col", "load_no", "value").agg(F.count(F.lit(1)).alias("c"), F.first("num").alias("num"), F.first("bad").alias("bad"))
    c, x = F.col("c").cast("double"), F.when(~F.isnan("num"), F.col("num"))
    k, z = F.col("c").cast(BIG), F.when(F.col("col").isin(*whole), F.col("value")).cast(BIG)
    sums = {"__e1": F.try_multiply(k, z), "__e2": F.try_multiply(k, F.try_multiply(z, z))}
    agg = groups.groupBy("col", "load_no").agg(
        F.sum("c").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("c"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"), F.min("value").alias("min_text"), F.max("value").alias("max_text"), F.min(x).alias("min_num"), F.max(x).alias("max_num"),
        F.when(F.count("bad") > 0, F.sum(F.when(F.col("bad"), F.col("c")).otherwise(0))).alias("n_violations"),
        F.sum(F.when(x.isNotNull(), c)).alias("__n"), F.sum(c * x).alias("__s1"), F.sum(c * x * x).alias("__s2"),
        *[F.when(F.count(v) == F.count(z), F.try_sum(v)).alias(name) for name, v in sums.items()],
    )
    n = F.col("__n")
    agg = agg.withColumn("mean", F.coalesce(F.col("__e1").cast("double"), F.col("__s1")) / n)
    around = F.coalesce(squares(n, F.col("__e1"), F.col("__e2")), F.col("__s2") - n * F.col("mean") * F.col("mean"))
    agg = agg.withColumn("sd", deviation(n, around))
    shares = _share_changes(groups.where(~F.col("col").isin(*numeric)) if numeric else groups)
    agg = agg.join(shares, ["col", "load_no"], "left")
    w = Window.partitionBy("col").orderBy("load_no")
    std_diff = standardised_difference(F.col("mean"), F.col("sd"), F.lag("mean").over(w), F.lag("sd").over(w))
    text = F.when(F.col("__n").isNull(), F.col("min_text")), F.when(F.col("__n").isNull(), F.col("max_text"))
    return agg.select(
        F.lit(tab).alias("tab"), "col", "load_no", "n_rows", "n_missing", "n_distinct", text[0].alias("min_text"), text[1].alias("max_text"), "min_num", "max_num",
        "n_violations", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"),
        F.round(std_diff, 6).alias("std_diff"),
        F.round("share_diff", 6).alias("share_diff"),
    )
