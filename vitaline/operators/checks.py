"""Declarative checks. Every check returns rows of one issues schema, so results are united by name."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline import registry as R
from vitaline.functions import cols as C

ISSUES = "rule_id string, severity string, category string, dataset string, variable string, record string, value string, message string"


def _issues(df: DataFrame, rule: str, severity: str, category: str, dataset: str, variable: str, record: Column, value: Column, message: str) -> DataFrame:
    lit = {"rule_id": rule, "severity": severity, "category": category, "dataset": dataset, "variable": variable}
    return df.select(*[F.lit(v).alias(k) for k, v in lit.items()], record.cast("string").alias("record"), value.cast("string").alias("value"), F.lit(message).alias("message"))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Rule:
    """A row rule: an issue where `bad` holds."""

    rule_id: str
    severity: str
    category: str
    variable: str
    bad: Column
    message: str


def rows(df: DataFrame, dataset: str, rules: Sequence[Rule], record: str = "rec_id") -> DataFrame:
    """All row rules in one pass over the data."""
    hits = F.array_compact(F.array(*[
        F.when(r.bad, F.struct(*[F.lit(x).alias(n) for n, x in (("rule_id", r.rule_id), ("severity", r.severity), ("category", r.category), ("variable", r.variable))], F.col(r.variable).cast("string").alias("value"), F.lit(r.message).alias("message")))
        for r in rules
    ]))
    out = df.select(F.lit(dataset).alias("dataset"), F.col(record).cast("string").alias("record"), F.inline(hits))
    return out.select("rule_id", "severity", "category", "dataset", "variable", "record", "value", "message")


def not_in_codelist(c: Column, codelist: str | Sequence[str], ignore_case: bool = True) -> Column:
    """A filled value outside a codelist; an unknown codelist holds nothing."""
    values = R.CODELISTS.get(codelist, ()) if isinstance(codelist, str) else codelist
    x = C.clean(c)
    return x.isNotNull() & ~(F.upper(x).isin(*[v.upper() for v in values]) if ignore_case else x.isin(*values))


def iso_kind(c: Column) -> Column:
    """datetime, duration, date, partial datetime or null (not ISO), in that order of trial; ranges are checked, the calendar is not."""
    s = C.clean(c)
    ok = (
        (F.coalesce(F.substring(s, 6, 2).try_cast("int"), F.lit(1)).between(1, 12)) & (F.coalesce(F.substring(s, 9, 2).try_cast("int"), F.lit(1)).between(1, 31))
        & (F.coalesce(F.substring(s, 12, 2).try_cast("int"), F.lit(0)) <= 23) & (F.coalesce(F.substring(s, 15, 2).try_cast("int"), F.lit(0)) <= 59) & (F.coalesce(F.substring(s, 18, 2).try_cast("int"), F.lit(0)) <= 59)
    )
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"), F.when(ok, "datetime"))
        .when(s.rlike(r"^P(\d+Y)?(\d+M)?(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?$"), "duration")
        .when(s.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), F.when(ok, "date"))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}(:\d{2})?$"), F.when(ok, "partial datetime"))
    )


def duplicates(df: DataFrame, dataset: str, keys: Sequence[str], rule: str = "DUP-001") -> DataFrame:
    """One issue per key that occurs more than once; keys with a missing part are left to the required check."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    g = g.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    return _issues(g, rule, "ERROR", "key", dataset, ",".join(keys), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), F.col("c"), "key occurs more than once")


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n, n_missing, pct): one aggregation over all columns, then rows."""
    g = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(C.filled(F.col(c)).isNull()).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("n_missing")) for c in columns])
    return g.select(F.col("__n").alias("n"), F.inline(cells)).select("variable", "n", "n_missing", F.when(F.col("n") > 0, F.col("n_missing") * 100.0 / F.col("n")).alias("pct"))


def orphans(child: DataFrame, parent: DataFrame, dataset: str, key: str = "usubjid", rule: str = "XC001") -> DataFrame:
    """One issue per child key without a parent row."""
    c = child.select(C.key_norm(F.col(key)).alias("k")).where(F.col("k").isNotNull()).groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    return _issues(c.join(parent.select(C.key_norm(F.col(key)).alias("k")), "k", "left_anti"), rule, "ERROR", "cross", dataset, key, F.col("k"), F.col("c"), "subject is not in the parent")


def date_order(start: Column, end: Column) -> Column:
    """Start after end, compared at equal precision only."""
    s, e = C.clean(start), C.clean(end)
    n = F.least(F.length(s), F.length(e))
    return s.rlike(r"^\d{4}") & e.rlike(r"^\d{4}") & n.isin(4, 7, 10) & (F.substring(s, 1, 10) > F.substring(e, 1, 10)) & (F.length(s) == F.length(e))


def structure(columns: Sequence[str], dataset: str) -> list[tuple[str, str, str, str]]:
    """(rule, severity, variable, message) from the schema alone: required variables, naming, subject key."""
    up = [c.upper() for c in columns]
    out = [("SDTM-REQ-001", "ERROR", v, "required variable is absent") for v in R.REQUIRED.get(dataset, ()) if v not in up]
    if dataset not in R.KEYS and dataset not in R.REQUIRED:
        out.append(("SDTM-000", "WARNING", "", "unknown dataset"))
    if dataset not in R.NO_SUBJECT and "USUBJID" not in up:
        out.append(("SDTM-002", "ERROR", "USUBJID", "subject key is absent"))
    for c in up:
        if not re.fullmatch(r"[A-Z][A-Z0-9_]*", c):
            out.append(("SDTM-NAM-001", "ERROR", c, "name has characters that are not allowed"))
        if len(c) > 8:
            out.append(("SDTM-NAM-002", "WARNING", c, "name is longer than 8"))
    return out


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("dataset", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def quality(issues: DataFrame, datasets: DataFrame) -> DataFrame:
    """Score per dataset: 100 less 15 an error rule and 5 a warning rule, not under 0; 80 passes."""
    kinds = issues.select("dataset", "rule_id", "variable", "severity").distinct().groupBy("dataset").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    j = datasets.join(kinds, "dataset", "left").na.fill(0, ["errors", "warnings"])
    score = F.greatest(F.lit(0), 100 - 15 * F.col("errors") - 5 * F.col("warnings"))
    return j.select("dataset", "errors", "warnings", score.cast("int").alias("score"), (score >= 80).alias("passed"))


def message_group(message: Column) -> Column:
    """Family of a report message by its words; the first that applies."""
    m, out = F.lower(message), F.when(F.lit(False), "")
    for family, words in (("missing", ("missing", "required", "absent", "null")), ("terminology", ("codelist", "terminology", "not found in")), ("date", ("date", "iso 8601")), ("cross", ("not in dm", "parent", "cross")), ("structure", ("duplicate", "key", "length", "name"))):
        out = out.when(reduce(Column.__or__, [m.contains(w) for w in words]), family)
    return out.otherwise("other")


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, relative: float = 0.01) -> DataFrame:
    """Two sources of one measurement: RECON-001 only in a, 002 only in b, 003 values that differ by more than `relative`."""
    j = a.select(*keys, F.col(value).alias("a"), F.lit(1).alias("__a")).join(b.select(*keys, F.col(value).alias("b"), F.lit(1).alias("__b")), list(keys), "full_outer")
    far = F.abs(F.col("a") - F.col("b")) > F.abs(F.col("b")) * relative
    kind = F.when(F.col("__b").isNull(), "RECON-001").when(F.col("__a").isNull(), "RECON-002").when(far | (F.col("a").isNull() != F.col("b").isNull()), "RECON-003")
    return j.select(*keys, kind.alias("rule_id"), "a", "b").where(F.col("rule_id").isNotNull())


def cross_references(refs: DataFrame, targets: DataFrame, ref: str, target: str, rule: str, dataset: str) -> DataFrame:
    """References in metadata (object ids, codelists, annotations) that no target defines."""
    known = targets.select(F.col(target).alias("__r")).distinct()
    open_refs = refs.select(F.col(ref).alias("__r")).where(F.col("__r").isNotNull()).groupBy("__r").agg(F.count(F.lit(1)).alias("c")).join(known, "__r", "left_anti")
    return _issues(open_refs, rule, "ERROR", "metadata", dataset, ref, F.col("__r"), F.col("c"), "reference has no definition")


def file_rules(files: DataFrame, pattern: str = r"^[a-z][a-z0-9]{0,7}\.(xpt|xml|pdf|csv|json)$", most_bytes: int = 5 * 1024**3) -> DataFrame:
    """Naming and size rules of a package listing (name, bytes)."""
    return rows(files, "package", [
        Rule("NAME-001", "ERROR", "package", "name", ~F.col("name").rlike(pattern), "file name is not allowed"),
        Rule("STRUCT-001", "ERROR", "package", "bytes", F.col("bytes") == 0, "file is empty"),
        Rule("STRUCT-002", "WARNING", "package", "bytes", F.col("bytes") > most_bytes, "file is larger than allowed"),
    ], record="name")


def readiness(items: DataFrame, group: str, done: str) -> DataFrame:
    """Completed items and percent per group of a checklist."""
    g = items.groupBy(group).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col(done)).alias("complete"))
    return g.withColumn("pct", F.col("complete") * 100.0 / F.col("items"))


def composite(completeness: Column, consistency: Column, types: Column, ranges: Column) -> Column:
    """Weighted quality score of four scores in percent."""
    return completeness * 0.4 + consistency * 0.3 + types * 0.2 + ranges * 0.1
