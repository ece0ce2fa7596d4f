"""Tabulation domains to analysis datasets.

Lookups are equi joins on subject keys, parents reduced to one row per key first. Baselines are aggregates per subject
and parameter, combined on the map side and joined back, and values are carried forward bucket by bucket, so that a
subject with a large part of all rows is no task of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaline import registry as R
from vitaline.functions import cols as C
from vitaline.operators.ranks import carried


def treatment_n(c: Column) -> Column:
    pairs = [F.lit(x) for kv in R.TREATMENT_N.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.upper(c)], F.lit(99))


def age_group(age: Column, cutoff: int = 65, missing_is_young: bool = False) -> tuple[Column, Column]:
    a = F.coalesce(age, F.lit(0)) if missing_is_young else age
    return F.when(a < cutoff, f"<{cutoff}").when(a >= cutoff, f">={cutoff}"), F.when(a < cutoff, 1).when(a >= cutoff, 2)


def adsl(dm: DataFrame, ex: DataFrame, ds: DataFrame | None = None, any_dose: bool = False, cutoff: int = 65) -> DataFrame:
    """One row per subject of dm (its rows must be unique by usubjid).

    Dates are the first and last dosed exposure; SAFFL needs a dose over 0 unless any_dose; disposition flags follow
    all records of the subject, the reason is that of the last one.
    """
    start, end = C.iso_date(F.col("exstdtc")), C.iso_date(F.col("exendtc"))
    dosed = F.lit(True) if any_dose else F.col("exdose") > 0
    x = ex.where(dosed).groupBy("usubjid").agg(F.min(start).alias("trtsdt"), F.max(end).alias("trtedt"), F.sum("exdose").alias("cumdose"), F.count(F.lit(1)).alias("n_doses"))
    out = dm.join(x, "usubjid", "left")
    if ds is not None:
        left = ~F.col("dsdecod").isin("COMPLETED", "SCREEN FAILURE")
        d = ds.groupBy("usubjid").agg(
            F.max(F.when(F.col("dsdecod") == "COMPLETED", "Y")).alias("compltfl"), F.max(F.when(left, "Y")).alias("disconfl"),
            F.max_by(F.when(left, F.col("dsdecod")), F.when(left, F.struct("dsstdtc", "dsseq"))).alias("dctreasn"),
        )
        out = out.join(d, "usubjid", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("string") for c in ("compltfl", "disconfl", "dctreasn")})
    group, group_n = age_group(F.col("age"), cutoff)
    white = F.upper(F.col("race")) == "WHITE"
    return out.select(
        "studyid", "usubjid", "subjid", "siteid", "age", "sex", "race", "ethnic", "arm", "armcd", "country",
        F.col("arm").alias("trt01p"), treatment_n(F.col("arm")).alias("trt01pn"), F.col("actarm").alias("trt01a"), treatment_n(F.col("actarm")).alias("trt01an"),
        F.when(F.col("n_doses") > 0, "Y").otherwise("N").alias("saffl"), F.when(F.col("armcd").isNotNull() & (F.col("armcd") != "SCRNFAIL"), "Y").otherwise("N").alias("ittfl"),
        F.coalesce("compltfl", F.lit("N")).alias("compltfl"), F.coalesce("disconfl", F.lit("N")).alias("disconfl"), "dctreasn",
        "trtsdt", "trtedt", (F.datediff("trtedt", "trtsdt") + 1).alias("trtdurd"), F.col("cumdose"),
        group.alias("agegr1"), group_n.alias("agegr1n"), F.when(white, "WHITE").otherwise("NON-WHITE").alias("racegr1"), F.when(white, 1).otherwise(2).alias("racegr1n"),
    )


def adae(ae: DataFrame, subjects: DataFrame, window_days: int = 30) -> DataFrame:
    """Events with subject attributes: imputed dates and flags, study days, treatment emergence, first occurrence."""
    s = subjects.select("usubjid", "trt01a", "trt01p", "saffl", "ittfl", "trtsdt", "trtedt")
    j = ae.join(s, "usubjid", "left")
    start, end = C.impute_date(F.col("aestdtc")), C.impute_date(F.col("aeendtc"), end=True)
    j = C.bind(j, astdt=start, aendt=end)
    a, t0, t1 = F.col("astdt"), F.col("trtsdt"), F.col("trtedt")
    emergent = F.when(F.coalesce(F.col("saffl"), F.lit("N")) != "Y", "N").when(a.isNull() | t0.isNull(), None).when((a >= t0) & (t1.isNull() | (a <= F.date_add(t1, window_days))), "Y").otherwise("N")
    j = C.bind(j, trtemfl=emergent)
    order = F.struct(a.isNull(), a, F.col("rec_id"))
    first = j.where("trtemfl = 'Y'").groupBy(F.col("usubjid").alias("__u"), F.col("aedecod").alias("__d")).agg(F.min(order)["rec_id"].alias("__first"))
    j = j.join(first, F.col("usubjid").eqNullSafe(F.col("__u")) & F.col("aedecod").eqNullSafe(F.col("__d")), "left")
    sev = F.create_map(*[F.lit(x) for kv in R.SEVERITY_N.items() for x in kv])[F.col("aesev")]
    return j.select(
        "studyid", "usubjid", "rec_id", "aeterm", "aedecod", "aebodsys", "aesev", "aeser", "aerel", "trt01a", "saffl", "astdt", C.imputation_flag(F.col("aestdtc")).alias("astdtf"), "aendt",
        C.study_day(a, t0).alias("astdy"), C.study_day(F.col("aendt"), t0).alias("aendy"), (F.datediff("aendt", "astdt") + 1).alias("adurn"), "trtemfl",
        F.when((F.col("trtemfl") == "Y") & (F.col("rec_id") == F.col("__first")), "Y").otherwise("N").alias("aoccfl"), sev.alias("aesevn"),
    )


def visit_of(day: Column, windows: Sequence[tuple[int, int, str, int]]) -> tuple[Column, Column]:
    """(visit, number) of a study day by windows (from, to, visit, number); a later window overrides an earlier one."""
    name, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    for lo, hi, v, n in windows:
        name, number = F.when(day.between(lo, hi), v).otherwise(name), F.when(day.between(lo, hi), n).otherwise(number)
    return name, number


def bds(rows: DataFrame, windows: Sequence[tuple[int, int, str, int]] = (), keys: Sequence[str] = ("usubjid", "paramcd")) -> DataFrame:
    """Baseline, change, ranges and shift of findings (usubjid, paramcd, aval, adt, trtsdt, lo, hi, rec_id).

    Baseline is the last value on or before first dose; change exists after baseline only; percent change is null
    where the baseline is 0.
    """
    ind = F.when(F.col("aval").isNull() | F.col("lo").isNull() | F.col("hi").isNull(), None).when(F.col("aval") < F.col("lo"), "L").when(F.col("aval") > F.col("hi"), "H").otherwise("N")
    marked = rows.withColumn("anrind", ind).withColumn("ady", C.study_day(F.col("adt"), F.col("trtsdt")))
    before = F.col("aval").isNotNull() & (F.col("adt") <= F.col("trtsdt"))
    last = F.max(F.struct("adt", "rec_id", F.col("aval").alias("base"), F.col("anrind").alias("bnrind"))).alias("__l")
    bases = marked.where(before).groupBy(*keys).agg(last).select(*keys, F.col("__l.rec_id").alias("__base_rec"), "__l.base", "__l.bnrind")
    out = marked.join(bases, list(keys), "left")
    out = out.withColumn("ablfl", F.when(before & (F.col("rec_id") == F.col("__base_rec")), "Y")).drop("__base_rec")
    post = F.col("adt") > F.col("trtsdt")
    out = out.withColumn("chg", F.when(post, F.col("aval") - F.col("base")))
    out = out.withColumn("pchg", F.when(F.col("base") != 0, F.col("chg") / F.col("base") * 100)).withColumn("shift1", F.concat("bnrind", "anrind"))
    visit, number = visit_of(F.col("ady"), windows)
    return out.withColumn("avisit", visit).withColumn("avisitn", number)


def locf(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "aval") -> DataFrame:
    """Append {value}_locf: the last known value up to the row; the first column of the order splits the groups."""
    return carried(rows, keys, order, F.col(order[0]), value, f"{value}_locf")


def derived_records(rows: DataFrame, keys: Sequence[str], value: str = "aval") -> DataFrame:
    """AVERAGE and WORST (highest) records per group."""
    g = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("a"), F.max(value).alias("w"))
    return g.select(*keys, F.inline(F.array(F.struct(F.lit("AVERAGE").alias("dtype"), F.col("a").cast("double").alias(value)), F.struct(F.lit("WORST").alias("dtype"), F.col("w").cast("double").alias(value)))))


def adtte(subjects: DataFrame, events: DataFrame, params: Sequence[tuple[str, str]], cutoff: str) -> DataFrame:
    """Time to the first event of each parameter for safety subjects; censored at the end of treatment or the cutoff.

    events has usubjid, paramcd, edt; the earliest date from the first dose on counts; time is end - start + 1 days.
    """
    grid = F.array(*[F.struct(F.lit(p).alias("paramcd"), F.lit(n).alias("param")) for p, n in params])
    safe = subjects.where((F.col("saffl") == "Y") & F.col("trtsdt").isNotNull())
    s = safe.select("usubjid", "trt01a", "trtsdt", "trtedt", F.inline(grid))
    since = events.join(safe.select("usubjid", F.col("trtsdt").alias("__s")), "usubjid").where(F.col("edt") >= F.col("__s"))
    first = since.groupBy("usubjid", "paramcd").agg(F.min("edt").alias("edt"))
    j = s.join(first, ["usubjid", "paramcd"], "left")
    adt = F.coalesce("edt", "trtedt", F.lit(cutoff).cast("date"))
    return j.select("usubjid", "trt01a", "paramcd", "param", F.when(F.col("edt").isNull(), 1).otherwise(0).alias("cnsr"), adt.alias("adt"), (F.datediff(adt, "trtsdt") + 1).alias("aval"))


def tte_unit(days: Column, unit: str) -> Column:
    return days / {"days": 1.0, "weeks": 7.0, "months": 30.4375}[unit]


def nca(conc: DataFrame, keys: Sequence[str], time: str, value: str, dose: Column | None = None) -> DataFrame:
    """Non-compartmental summary per profile: cmax, tmax (earliest), auc by trapezoids, clearance dose / auc."""
    w = Window.partitionBy(*keys).orderBy(time)
    t, c = F.col(time), F.col(value)
    area = (t - F.lag(time).over(w)) * (c + F.lag(value).over(w)) / 2
    g = conc.where(t.isNotNull() & c.isNotNull()).withColumn("__a", area)
    out = g.groupBy(*keys).agg(F.max(value).alias("cmax"), F.min_by(time, F.struct(-c, t)).alias("tmax"), F.sum("__a").alias("auc"))
    return out if dose is None else out.withColumn("cl", F.try_divide(dose, F.col("auc")))


def scale_score(items: DataFrame, keys: Sequence[str], value: str, n_items: int) -> DataFrame:
    """Sum score with missing items prorated; null where fewer than half are answered."""
    g = items.groupBy(*keys).agg(F.count(value).alias("answered"), F.sum(value).alias("s"))
    return g.select(*keys, "answered", F.when(F.col("answered") * 2 >= n_items, F.col("s") * n_items / F.col("answered")).alias("score"))


def responder(rows: DataFrame, criterion: Column) -> DataFrame:
    """Append avalc Y or N and aval 1 or 0 by a criterion; a criterion that can't be told gives nulls. aval is replaced."""
    kept = [c for c in rows.columns if c not in ("aval", "avalc")]
    return rows.select(*kept, F.when(criterion, "Y").when(~criterion, "N").alias("avalc"), F.when(criterion, 1.0).when(~criterion, 0.0).alias("aval"))


def trace(variables: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether analysis variables (dataset, variable, source_dataset, source_variable) lead back to a column.

    Yes: the source column exists; Partial: only its dataset does; No: neither, or no source is named.
    """
    cols = sources.select(F.upper("dataset").alias("__d"), F.upper("variable").alias("__v")).distinct()
    v = variables.withColumn("__d", F.upper("source_dataset")).withColumn("__v", F.upper("source_variable"))
    full = v.join(cols.withColumn("__c", F.lit(1)), ["__d", "__v"], "left")
    out = full.join(cols.select("__d", F.lit(1).alias("__s")).distinct(), "__d", "left")
    return out.select("dataset", "variable", "source_dataset", "source_variable", F.when(F.col("__c") == 1, "Yes").when(F.col("__s") == 1, "Partial").otherwise("No").alias("traceable"))
