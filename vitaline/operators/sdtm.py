"""Raw records to tabulation domains: projections over built-in expressions; sequences are ranks per subject that no hot subject holds up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaline import registry as R
from vitaline.functions import cols as C
from vitaline.operators.ranks import ranked


def usubjid(study: Column, site: Column, subj: Column, pad: int | None = None) -> Column:
    """study-site-subject; a missing part is an empty text; pad left-fills site and subject with zeros."""
    parts = [F.coalesce(C.clean(c), F.lit("")) for c in (study, site, subj)]
    if pad:
        parts[1:] = [F.when(F.length(p) < pad, F.lpad(p, pad, "0")).otherwise(p) for p in parts[1:]]
    return F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2])


def with_seq(rows: DataFrame, name: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Append 1, 2, ... per subject; the order must end in a unique key. A subject's rows are split by the day (or the
    range of whole numbers) the first column of the order begins with."""
    first, kind = F.col(order[0]), dict(rows.dtypes)[order[0]]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    return ranked(rows, by, order, F.floor(first / 10_000) if whole else F.substring(first.cast("string"), 1, 10), name)


def upper_map(c: Column, mapping: Mapping[str, str], otherwise: Column | None = None) -> Column:
    return C.map_lookup(F.upper(C.clean(c)), mapping, otherwise)


def armcd(arm: Column, given: Column) -> Column:
    """The given code, else the first 8 letters and digits of the arm in upper case."""
    return F.coalesce(C.clean(given), F.upper(F.substring(F.regexp_replace(C.clean(arm), "[^A-Za-z0-9]", ""), 1, 8)))


def age_at(birth: Column, ref: Column) -> Column:
    """Completed years between two dates; someone born on 29 February completes a year on 1 March of common years."""
    early = (F.month(ref) < F.month(birth)) | ((F.month(ref) == F.month(birth)) & (F.dayofmonth(ref) < F.dayofmonth(birth)))
    return (F.year(ref) - F.year(birth) - early.cast("int")).cast("int")


def map_dm(raw: DataFrame, country: str = "USA") -> DataFrame:
    c = {n: F.col(n) for n in raw.columns}
    arm = C.clean(c["arm"])
    return raw.select(
        C.clean(c["studyid"]).alias("studyid"), F.lit("DM").alias("domain"), usubjid(c["studyid"], c["siteid"], c["subjid"]).alias("usubjid"),
        C.clean(c["subjid"]).alias("subjid"), C.clean(c["siteid"]).alias("siteid"), C.safe_int(c["age"]).alias("age"), F.lit("YEARS").alias("ageu"),
        upper_map(c["sex"], R.SEX, F.lit("U")).alias("sex"), upper_map(c["race"], R.RACE, F.upper(C.clean(c["race"]))).alias("race"),
        upper_map(c["ethnic"], R.ETHNIC, F.upper(C.clean(c["ethnic"]))).alias("ethnic"), arm.alias("arm"), armcd(c["arm"], c["armcd"]).alias("armcd"),
        F.coalesce(C.clean(c["actarm"]), arm).alias("actarm"), F.coalesce(C.clean(c["actarmcd"]), armcd(c["arm"], c["armcd"])).alias("actarmcd"),
        F.coalesce(C.clean(c["country"]), F.lit(country)).alias("country"), "rec_id",
    )


def iso_text(c: Column) -> Column:
    """Slashes to hyphens, nothing checked; null stays null."""
    return F.translate(C.clean(c), "/", "-")


def map_ae(raw: DataFrame) -> DataFrame:
    term = C.clean(F.col("aeterm"))
    out = raw.select(
        C.clean(F.col("studyid")).alias("studyid"), F.lit("AE").alias("domain"), C.clean(F.col("usubjid")).alias("usubjid"), term.alias("aeterm"),
        F.upper(F.substring(term, 1, 50)).alias("aedecod"), F.when(term.isNotNull(), F.coalesce(C.clean(F.col("aebodsys")), F.lit("GENERAL DISORDERS"))).alias("aebodsys"),
        upper_map(F.col("aesev"), R.SEVERITY).alias("aesev"), C.yes_no(F.col("aeser")).alias("aeser"), upper_map(F.col("aerel"), R.RELATION, F.lit("NOT RELATED")).alias("aerel"),
        C.clean(F.col("aeout")).alias("aeout"), iso_text(F.col("aestdtc")).alias("aestdtc"), iso_text(F.col("aeendtc")).alias("aeendtc"), "rec_id",
    )
    return with_seq(out, "aeseq", ["studyid", "usubjid"], ["aestdtc", "aeterm", "rec_id"])


def map_ex(raw: DataFrame) -> DataFrame:
    route, freq = F.lower(C.clean(F.col("exroute"))), F.lower(C.clean(F.col("exdosfrq")))
    out = raw.select(
        C.clean(F.col("studyid")).alias("studyid"), F.lit("EX").alias("domain"), C.key_norm(F.col("usubjid")).alias("usubjid"), F.upper(C.clean(F.col("extrt"))).alias("extrt"),
        F.coalesce(C.safe_double(F.col("exdose")), F.lit(0.0)).alias("exdose"), C.clean(F.col("exdosu")).alias("exdosu"),
        C.map_lookup(route, R.ROUTE, F.upper(route)).alias("exroute"), C.map_lookup(freq, R.FREQUENCY, F.upper(freq)).alias("exdosfrq"),
        iso_text(F.col("exstdtc")).alias("exstdtc"), iso_text(F.col("exendtc")).alias("exendtc"), "rec_id",
    )
    return with_seq(out, "exseq", ["studyid", "usubjid"], ["exstdtc", "rec_id"])


def map_ds(raw: DataFrame) -> DataFrame:
    """raw has studyid, usubjid, dsterm, dsstdtc, rec_id."""
    term = F.lower(C.clean(F.col("dsterm")))
    out = raw.select(
        C.clean(F.col("studyid")).alias("studyid"), F.lit("DS").alias("domain"), C.key_norm(F.col("usubjid")).alias("usubjid"), C.clean(F.col("dsterm")).alias("dsterm"),
        C.map_lookup(term, R.DISPOSITION, F.upper(term)).alias("dsdecod"), iso_text(F.col("dsstdtc")).alias("dsstdtc"), "rec_id",
    )
    return with_seq(out, "dsseq", ["studyid", "usubjid"], ["dsstdtc", "rec_id"])


def map_domain(raw: DataFrame, domain: str, mapping: Mapping[str, Column | str], order: Sequence[str], by: Sequence[str] = ("studyid", "usubjid")) -> DataFrame:
    """Domain from a declarative mapping of variables to columns or expressions, with its sequence number."""
    cols = [(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in mapping.items()]
    return with_seq(raw.select(F.lit(domain).alias("domain"), *cols), f"{domain.lower()}seq", by, order)


def code_terms(rows: DataFrame, dictionary: DataFrame, term: str, key: str, keep: Sequence[str]) -> DataFrame:
    """Left lookup of a verbatim term in a dictionary (compared trimmed, without case); unmatched terms keep nulls."""
    d = dictionary.groupBy(C.key_norm(F.col(key)).alias("__k")).agg(*[F.min(k).alias(k) for k in keep]).where(F.col("__k").isNotNull())
    return rows.withColumn("__k", C.key_norm(F.col(term))).join(d, "__k", "left").drop("__k")


def range_indicator(value: Column, lo: Column, hi: Column) -> Column:
    return F.when(value.isNull() | lo.isNull() | hi.isNull(), None).when(value < lo, "L").when(value > hi, "H").otherwise("N")


def supp_unpivot(parent: DataFrame, domain: str, idvar: str | None, qualifiers: Sequence[tuple[str, str]]) -> DataFrame:
    """Supplemental qualifiers (column, label) as rows; missing values give none; idvar None leaves it blank."""
    cells = F.array(*[F.struct(F.lit(c.upper()).alias("qnam"), F.lit(label).alias("qlabel"), C.clean(F.col(c)).alias("qval")) for c, label in qualifiers])
    value = F.col(idvar).cast("string") if idvar else F.lit("")
    return parent.select("studyid", F.lit(domain).alias("rdomain"), "usubjid", F.lit((idvar or "").upper()).alias("idvar"), value.alias("idvarval"), F.inline(cells)).where(F.col("qval").isNotNull())


def supp_rejoin(parent: DataFrame, supp: DataFrame, idvar: str, names: Sequence[str]) -> DataFrame:
    """Qualifiers back as columns of the parent."""
    wide = supp.groupBy("usubjid", F.col("idvarval").alias("__v")).pivot("qnam", [n.upper() for n in names]).agg(F.min("qval"))
    wide = wide.select("usubjid", "__v", *[F.col(n.upper()).alias(f"supp_{n}") for n in names])
    return parent.withColumn("__v", F.col(idvar).cast("string")).join(wide, ["usubjid", "__v"], "left").drop("__v")


def relrec(left: DataFrame, right: DataFrame, ldomain: str, rdomain: str, lkey: str, rkey: str, on: Sequence[str]) -> DataFrame:
    """Related records as rows of both sides with one relation number per pair within a subject."""
    pairs = left.select(*on, F.col(lkey).cast("string").alias("l")).join(right.select(*on, F.col(rkey).cast("string").alias("r")), list(on))
    pairs = pairs.distinct().withColumn("relid", F.row_number().over(Window.partitionBy(*on).orderBy("l", "r")))
    sides = F.array(
        F.struct(F.lit(ldomain).alias("rdomain"), F.lit(lkey.upper()).alias("idvar"), F.col("l").alias("idvarval")),
        F.struct(F.lit(rdomain).alias("rdomain"), F.lit(rkey.upper()).alias("idvar"), F.col("r").alias("idvarval")),
    )
    return pairs.select(*on, "relid", F.inline(sides))


def trial_summary(studies: DataFrame, params: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Study attributes (code, label, column) as parameter rows; missing values give none."""
    cells = F.array(*[F.struct(F.lit(c).alias("tsparmcd"), F.lit(n).alias("tsparm"), C.clean(F.col(x)).alias("tsval")) for c, n, x in params])
    return studies.select("studyid", F.lit("TS").alias("domain"), F.inline(cells)).where(F.col("tsval").isNotNull())


def trial_elements(config: DataFrame, items: str, kind: str) -> DataFrame:
    """Arms (TA), criteria (TI) or visits (TV) listed in an array column as numbered rows of each study.

    TI criteria get codes I001...; TV visits get the running day: none for the first, 1 for the second, then windows summed.
    """
    rows = config.select("studyid", F.lit(kind).alias("domain"), F.posexplode(items).alias("pos", "item"))
    if kind == "TA":
        return rows.select("studyid", "domain", F.col("item.name").alias("arm"), F.col("item.code").alias("armcd"), (F.col("pos") + 1).alias("taetord"))
    if kind == "TI":
        return rows.select("studyid", "domain", F.concat(F.lit("I"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0")).alias("ietestcd"), F.col("item").alias("ietest"))
    w = Window.partitionBy("studyid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    later = F.sum(F.when(F.col("pos") >= 2, F.col("item.window")).otherwise(0)).over(w)
    day = F.when(F.col("pos") == 0, None).otherwise(later + 1).cast("int")
    return rows.select("studyid", "domain", (F.col("pos") + 1).alias("visitnum"), F.col("item.name").alias("visit"), day.alias("visitdy"))


def seriousness(*criteria: Column) -> Column:
    """Y if any criterion is Y, else N."""
    out = F.lit(False)
    for c in criteria:
        out = out | F.coalesce(F.upper(F.trim(c)) == "Y", F.lit(False))
    return F.when(out, "Y").otherwise("N")


def to_standard(value: Column, unit: Column, factors: Mapping[str, float]) -> Column:
    """Value times the factor of its unit; unknown units give null."""
    return value * F.create_map(*[F.lit(x) for k, f in factors.items() for x in (k.lower(), float(f))])[F.lower(F.trim(unit))]
