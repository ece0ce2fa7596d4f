"""Rule packs over several datasets: analysis datasets, dates across domains, reconciliation of forms.

Every pack returns (rule_id, severity, dataset, record): one row per finding, so packs are united by name and summed by
checks of any kind. Row rules run in the pass that reads the rows; rules between datasets are equi joins on subject
keys (trimmed, without case) with one row per subject on one side. A missing value breaks no comparison: rules on the
presence of values are rules of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline.functions import cols as C

FLAGS = ("saffl", "ittfl", "pprotfl", "efffl")
Rules = Mapping[tuple[str, str], Column]


def findings(df: DataFrame, dataset: str, record: str, rules: Rules) -> DataFrame:
    """All (rule, severity) whose condition holds, in one pass."""
    hits = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for (r, s), bad in rules.items()]))
    return df.select(F.inline(hits), F.lit(dataset).alias("dataset"), F.col(record).cast("string").alias("record"))


def _groups(df: DataFrame, dataset: str, keys: Sequence[str], rule: str, severity: str = "ERROR") -> DataFrame:
    """One finding per key that occurs more than once."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return g.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(dataset).alias("dataset"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("record"))


def _absent(df: DataFrame, parent: DataFrame, dataset: str, rules: Sequence[str]) -> DataFrame:
    """One finding per rule and key of df (k) that parent (k) does not hold."""
    k = df.select("k").where(F.col("k").isNotNull()).distinct().join(parent.select("k"), "k", "left_anti")
    return k.select(F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule_id"), F.lit("ERROR").alias("severity"), F.lit(dataset).alias("dataset"), F.col("k").alias("record"))


def _differ(a: Column, b: Column) -> Column:
    return C.clean(a).isNotNull() & C.clean(b).isNotNull() & (C.clean(a) != C.clean(b))


def keyed(df: DataFrame, key: str = "usubjid") -> DataFrame:
    return df.withColumn("k", C.key_norm(F.col(key)))


def latest(df: DataFrame, columns: Sequence[str], key: str = "usubjid", received: str = "received_at", rec_id: str = "rec_id") -> DataFrame:
    """(k, columns) of the last received row of every key."""
    row = F.max(F.struct(received, rec_id, F.struct(*columns).alias("v")))["v"].alias("v")
    return keyed(df, key).where(F.col("k").isNotNull()).groupBy("k").agg(row).select("k", "v.*")


def adsl_pack(adsl: DataFrame, dm: DataFrame, ex: DataFrame) -> list[DataFrame]:
    """ADSL001 to ADSL010; adsl has rec_id."""
    s = keyed(adsl)
    dosed = keyed(ex).where("exdose > 0 and k is not null").select("k").distinct().withColumn("dosed", F.lit(True))
    j = s.join(dosed, "k", "left")
    safe = F.when(F.col("dosed"), "Y").otherwise("N")
    itt = F.when(C.clean(F.col("armcd")).isNotNull() & (F.col("armcd") != "SCRNFAIL"), "Y").otherwise("N")
    off = [C.clean(F.col(c)).isNotNull() & ~F.col(c).isin("Y", "N") for c in FLAGS]
    empty = [C.clean(F.col(c)).isNull() for c in ("studyid", "usubjid", "trt01p", "saffl")]
    start, end = C.iso_date(F.col("trtsdt")), C.iso_date(F.col("trtedt"))
    planned, actual = C.clean(F.col("trt01p")), C.clean(F.col("trt01a"))
    rows = findings(j, "ADSL", "rec_id", {
        ("ADSL003", "ERROR"): F.col("saffl").isin("Y", "N") & (F.col("saffl") != safe), ("ADSL004", "ERROR"): F.col("ittfl").isin("Y", "N") & (F.col("ittfl") != itt),
        ("ADSL005", "ERROR"): C.clean(F.col("arm")).isNotNull() & ~planned.eqNullSafe(C.clean(F.col("arm"))),
        ("ADSL006", "WARNING"): F.coalesce(C.clean(F.col("actarm")), C.clean(F.col("arm"))).isNotNull() & ~actual.eqNullSafe(F.coalesce(C.clean(F.col("actarm")), C.clean(F.col("arm")))),
        ("ADSL007", "ERROR"): start > end, ("ADSL008", "ERROR"): off[0] | off[1] | off[2] | off[3], ("ADSL009", "ERROR"): empty[0] | empty[1] | empty[2] | empty[3],
    })
    known = s.where(F.col("k").isNotNull())
    return [rows, _groups(known, "ADSL", ["k"], "ADSL001"), _groups(known, "ADSL", ["k"], "ADSL010"), _absent(keyed(dm), s, "ADSL", ["ADSL002"])]


def bds_pack(bds: DataFrame, adsl: DataFrame) -> list[DataFrame]:
    """BDS001 to BDS008; bds has usubjid, paramcd, adt, aval, avalc, base, chg, pchg, ablfl, saffl, trtp and rec_id."""
    b = keyed(bds)
    s = latest(adsl, [F.col("saffl").alias("__saffl"), F.col("trt01p").alias("__trtp")])
    near = F.lit(1e-6)
    chg, pchg = F.col("aval") - F.col("base"), F.col("chg") / F.when(F.col("base") != 0, F.col("base")) * 100
    number = C.safe_double(F.col("avalc"))
    rows = findings(b.join(s, "k", "left"), "BDS", "rec_id", {
        ("BDS002", "ERROR"): number.isNotNull() & (F.abs(number - F.col("aval")) > near), ("BDS003", "WARNING"): (F.col("ablfl") == "Y") & (F.abs(F.col("base") - F.col("aval")) > near),
        ("BDS004", "ERROR"): F.abs(F.col("chg") - chg) > near, ("BDS005", "ERROR"): F.abs(F.col("pchg") - pchg) > near,
        ("BDS007", "ERROR"): _differ(F.col("saffl"), F.col("__saffl")), ("BDS008", "ERROR"): _differ(F.col("trtp"), F.col("__trtp")),
    })
    timed = b.where("paramcd is not null and adt is not null and k is not null")
    return [rows, _groups(timed, "BDS", ["k", "paramcd", "adt"], "BDS001"), _absent(b, s, "BDS", ["BDS006"])]


def adae_pack(adae: DataFrame, adsl: DataFrame, window_days: int = 30) -> list[DataFrame]:
    """ADAE001 to ADAE006; adae has ISO dates astdt and a flag trtemfl."""
    a = keyed(adae)
    s = latest(adsl, [F.col("saffl").alias("__saffl"), C.iso_date(F.col("trtsdt")).alias("__t0"), C.iso_date(F.col("trtedt")).alias("__t1")])
    at, t0, t1 = C.iso_date(F.col("astdt")), F.col("__t0"), F.col("__t1")
    emergent = F.when(at.isNull() | t0.isNull(), None).when((at >= t0) & (t1.isNull() | (at <= F.date_add(t1, window_days))), "Y").otherwise("N")
    rows = findings(a.join(s, "k", "left"), "ADAE", "rec_id", {
        ("ADAE002", "ERROR"): F.col("trtemfl").isin("Y", "N") & (F.col("__saffl") == "Y") & (F.col("trtemfl") != emergent), ("ADAE003", "ERROR"): (F.col("trtemfl") == "Y") & (at < t0),
        ("ADAE004", "ERROR"): C.clean(F.col("aedecod")).isNull(), ("ADAE005", "ERROR"): C.clean(F.col("aebodsys")).isNull(),
    })
    return [rows, _absent(a, s, "ADAE", ["ADAE001", "ADAE006"])]


def cross_pack(adsl: DataFrame, dm: DataFrame, others: Mapping[str, DataFrame]) -> list[DataFrame]:
    """X001 to X004; others are analysis datasets with usubjid, trtp, saffl, ittfl and rec_id."""
    s = latest(adsl, [F.col("trt01p").alias("__trtp"), F.col("saffl").alias("__saffl"), F.col("ittfl").alias("__ittfl")])
    sizes = [F.count_distinct("k").alias("n")]
    n = s.agg(*sizes).withColumn("m", keyed(dm).agg(*sizes).scalar()).where("n <> m")
    out = [n.select(F.lit("X001").alias("rule_id"), F.lit("ERROR").alias("severity"), F.lit("ADSL").alias("dataset"), F.concat_ws("|", F.col("n").cast("string"), F.col("m").cast("string")).alias("record"))]
    for name, df in others.items():
        d = keyed(df)
        out.append(_absent(d, s, name, ["X002"]))
        flags = _differ(F.col("saffl"), F.col("__saffl")) | _differ(F.col("ittfl"), F.col("__ittfl"))
        out.append(findings(d.join(s, "k"), name, "rec_id", {("X003", "ERROR"): _differ(F.col("trtp"), F.col("__trtp")), ("X004", "ERROR"): F.coalesce(flags, F.lit(False))}))
    return out


def _before(a: Column, b: Column) -> Column:
    """Result of the demand that a is not after b: FAIL, WARN where a partial date leaves it open, null where it holds."""
    x, y = C.clean(a), C.clean(b)
    iso = r"^\d{4}(-\d{2}(-\d{2}([T ].*)?)?)?$"
    n = F.least(F.length(x), F.length(y), F.lit(10))
    p, q = F.substr(x, F.lit(1), n), F.substr(y, F.lit(1), n)
    return F.when(x.rlike(iso) & y.rlike(iso), F.when(p > q, "FAIL").when((p == q) & (n < 10) & (F.length(x) != F.length(y)), "WARN"))


def date_order_pack(dm: DataFrame, ae: DataFrame, ex: DataFrame, sv: DataFrame, ds: DataFrame) -> DataFrame:
    """XC002, seven pairs: (pair, dataset, record, result) of dates in the wrong order at the precision both have.

    Starts of exposure, visits, events and dispositions must not lie before the subject's reference start, and no end
    before its start; sv and ds have rec_id or any column of that name.
    """
    ref = latest(dm, [F.col("rfstdtc").alias("__ref")])

    def checked(df: DataFrame, dataset: str, pairs: Mapping[str, Column]) -> DataFrame:
        j = keyed(df).join(ref, "k", "left")
        hits = F.filter(F.array(*[F.struct(F.lit(p).alias("pair"), r.alias("result")) for p, r in pairs.items()]), lambda h: h["result"].isNotNull())
        return j.select(F.lit(dataset).alias("dataset"), F.col("rec_id").cast("string").alias("record"), F.inline(hits))

    c, r = F.col, F.col("__ref")
    parts = [
        checked(ex, "EX", {"RFSTDTC<=EXSTDTC": _before(r, c("exstdtc")), "EXSTDTC<=EXENDTC": _before(c("exstdtc"), c("exendtc"))}),
        checked(ae, "AE", {"RFSTDTC<=AESTDTC": _before(r, c("aestdtc")), "AESTDTC<=AEENDTC": _before(c("aestdtc"), c("aeendtc"))}),
        checked(sv, "SV", {"RFSTDTC<=SVSTDTC": _before(r, c("svstdtc")), "SVSTDTC<=SVENDTC": _before(c("svstdtc"), c("svendtc"))}),
        checked(ds, "DS", {"RFSTDTC<=DSSTDTC": _before(r, c("dsstdtc"))}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("pair", "dataset", "record", "result")


def sae_pack(forms: DataFrame, ae: DataFrame) -> DataFrame:
    """RECON-SAE-001 to 003: serious forms (usubjid, aeterm, aestdtc, rec_id) without an event, events not flagged serious,
    and forms whose event has other dates. Terms are compared trimmed and without case."""
    f = forms.select(C.key_norm(F.col("usubjid")).alias("k"), C.key_norm(F.col("aeterm")).alias("t"), C.clean(F.col("aestdtc")).alias("d"), F.col("rec_id").cast("string").alias("record")).where("k is not null and t is not null")
    e = ae.select(C.key_norm(F.col("usubjid")).alias("k"), C.key_norm(F.col("aeterm")).alias("t"), C.clean(F.col("aestdtc")).alias("d"), (F.upper(F.trim("aeser")) == "Y").alias("y"))
    per = e.groupBy("k", "t").agg(F.max("y").alias("serious"))
    dated = e.where("d is not null").select("k", "t", "d").distinct().withColumn("same", F.lit(True))
    j = f.join(per.withColumn("found", F.lit(True)), ["k", "t"], "left").join(dated, ["k", "t", "d"], "left")
    return findings(j, "SAE", "record", {
        ("RECON-SAE-001", "ERROR"): F.col("found").isNull(), ("RECON-SAE-002", "ERROR"): F.col("found").isNotNull() & ~F.coalesce(F.col("serious"), F.lit(False)),
        ("RECON-SAE-003", "WARNING"): F.col("found").isNotNull() & F.col("d").isNotNull() & F.col("same").isNull(),
    })


def randomisation_pack(listed: DataFrame, dm: DataFrame, strata: Sequence[str]) -> DataFrame:
    """RECON-RAND-001 to 003: listed (usubjid, arm, strata, rec_id) against the last row of each subject of dm."""
    s = latest(dm, [F.col("arm").alias("__arm"), *[F.col(c).alias(f"__{c}") for c in strata], F.lit(True).alias("found")])
    j = keyed(listed).where("k is not null").join(s, "k", "left")
    other = F.lit(False)
    for c in strata:
        other = other | F.coalesce(_differ(F.col(c), F.col(f"__{c}")), F.lit(False))
    return findings(j, "RAND", "rec_id", {
        ("RECON-RAND-001", "WARNING"): _differ(F.col("arm"), F.col("__arm")), ("RECON-RAND-002", "ERROR"): F.col("found").isNull(), ("RECON-RAND-003", "WARNING"): other,
    })
