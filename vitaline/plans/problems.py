"""Queries of the general problems, with production parameters over whole tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaline import registry as R
from vitaline.operators import orphans, profile, reshape, timestamps, units
from vitaline.session import spread, table

TIMES = (("dm", "rfstdtc"), ("ae", "aestdtc"), ("ex", "exstdtc"))
EXPECTED = [
    profile.Expectation("dm", "age", lo=0, hi=120),
    profile.Expectation("adsl", "saffl", codes=("Y", "N")),
    profile.Expectation("ae", "aesev", codes=("MILD", "MODERATE", "SEVERE")),
]


def _codes(values) -> str:
    return "^(" + "|".join(re.escape(v) for v in values) + ")$"


_DATE = r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01])([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?)?)?$"
_KEYS = {"studyid": r"^ST\d{6}$", "usubjid": r"^ST\d{6}-\d{3}-\d{6}$", "rec_id": r"^\d+$", "received_at": _DATE}
_SUBJECT = _KEYS | {"subjid": r"^\d{6}$", "siteid": r"^\d{3}$", "domain": "^DM$", "ageu": "^YEARS$", "country": "^[A-Z]{3}$", "deleted_at": _DATE} | {
    "sex": _codes(R.CODELISTS["sex"]), "race": _codes(R.CODELISTS["race"]), "ethnic": _codes(R.CODELISTS["ethnicity"]),
    **dict.fromkeys(("armcd", "actarmcd"), "^[A-Z][A-Z0-9]{0,7}$"), **dict.fromkeys(("arm", "actarm"), r"^(Placebo|[A-Z][a-z]+ \d+ mg)$"), **dict.fromkeys(("rfstdtc", "rfendtc"), _DATE),
}
#: What a filled value of each coded, date and key column looks like; free text (aeterm) and measures (age) have none.
PATTERNS = {
    "dm": _SUBJECT,
    "adsl": _SUBJECT | {
        **dict.fromkeys(("saffl", "ittfl", "pprotfl", "efffl", "compltfl", "disconfl"), "^[YN]$"), **dict.fromkeys(("trtsdt", "trtedt"), _DATE), **dict.fromkeys(("trt01p", "trt01a"), _SUBJECT["arm"]),
        **dict.fromkeys(("trt01pn", "trt01an", "agegr1n", "racegr1n"), r"^\d$"), "agegr1": "^(<65|>=65)$", "racegr1": "^(WHITE|NON-WHITE)$", "dctreasn": "^[A-Z][A-Z -]*$",
    },
    "ae": _KEYS | {
        "domain": "^AE$", "aeseq": r"^\d+$", "aespid": r"^E\d+$", "aedecod": r"^[A-Z][A-Z0-9 ,()'/-]*$", "aebodsys": "^[A-Z][A-Z ,()'/-]*$", "aestdtc": _DATE, "aeendtc": _DATE,
        **{c: _codes(R.CODELISTS[c]) for c in ("aesev", "aeser", "aerel", "aeout")},
    },
}
REFERENCES = (("adae", "adsl"), ("ex", "adsl"), ("adsl", "dm"))


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _times(spark: SparkSession, d: str) -> DataFrame:
    rows = _union(table(spark, d, t).select(F.lit(t).alias("tab"), "rec_id", "usubjid", F.col(c).alias("value")) for t, c in TIMES)
    return timestamps.normalise_site_times(spread(rows), table(spark, d, "sites"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    t = _times(spark, d).where(F.col("utc_seconds").isNotNull())
    return t.select("tab", "rec_id", timestamps.utc_text(F.col("utc_seconds")).alias("utc"))


def p1_status(spark: SparkSession, d: str) -> DataFrame:
    """How each field's values were understood."""
    return _times(spark, d).groupBy("tab", F.coalesce("utc_status", F.lit("unreadable")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _wide(spark: SparkSession, d: str, tab: str) -> tuple[DataFrame, list[tuple[str, str]], str]:
    attrs = reshape.spec_attrs(table(spark, d, "param_spec"), tab)
    entity, code, value = {"ts": ("studyid", "tsparmcd", "tsval"), "adtte": ("usubjid", "paramcd", "aval")}[tab]
    rows = table(spark, d, tab).select(entity, code, value, "received_at", "rec_id")
    return reshape.to_wide(rows, attrs, entity, code, value, source=f"{d}/{tab}.parquet"), attrs, entity


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for tab in ("ts", "adtte"):
        wide, attrs, entity = _wide(spark, d, tab)
        parts.append(reshape.to_long(wide, attrs, entity).select(F.lit(tab).alias("tab"), "entity", "attr", "val"))
    return _union(parts)


def p2_wide_ts(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "ts")[0]


def p2_wide_adtte(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "adtte")[0]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    tables = {e.tab: table(spark, d, e.tab).select("load_no", e.col) for e in EXPECTED}
    return profile.findings(tables, EXPECTED)


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the loads; every coded, date and key column has a pattern."""
    return _union(profile.profile(table(spark, d, t), t, p) for t, p in PATTERNS.items())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    vs = spread(table(spark, d, "vs").select("rec_id", "vstestcd", "vsorres", "vsorresu"))
    out = units.standardise(vs, table(spark, d, "vs_units"))
    return out.where(~F.col("is_std") & F.col("std_tenths").isNotNull()).select("rec_id", "std_tenths")


def p5_standard(spark: SparkSession, d: str) -> DataFrame:
    """Measured values per test and unit as understood, in the standard unit."""
    vs = spread(table(spark, d, "vs").select("vstestcd", "vsorres", "vsorresu"))
    out = units.standardise(vs, table(spark, d, "vs_units")).where(F.col("std_tenths").isNotNull())
    return out.groupBy("vstestcd", "unit", "std_unit").agg(F.count(F.lit(1)).alias("n"), F.min("std_tenths").alias("min_tenths"), F.max("std_tenths").alias("max_tenths"))


def _reference(spark: SparkSession, d: str, child: str, parent: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, child).select("rec_id", "usubjid", "received_at")
    return c, table(spark, d, parent).select("usubjid", "received_at", "deleted_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _union(
        orphans.orphan_rows(*_reference(spark, d, c, p), "usubjid").select(F.lit(c).alias("tab"), "rec_id", "period", "kind") for c, p in REFERENCES
    )


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return _union(
        orphans.orphan_report(*_reference(spark, d, c, p), "usubjid").select(F.lit(c).alias("tab"), "period", "kind", "n_rows", "n_keys") for c, p in REFERENCES
    )


QUERIES = {
    "p1_found": p1_found, "p1_status": p1_status,
    "p2_found": p2_found, "p2_wide_ts": p2_wide_ts, "p2_wide_adtte": p2_wide_adtte,
    "p3_found": p3_found, "p3_profile": p3_profile,
    "p5_found": p5_found, "p5_standard": p5_standard,
    "p6_found": p6_found, "p6_report": p6_report,
}
