"""Problem 1: timestamps in many notations and zones become one UTC instant.

An ordered cascade of anchored patterns rewrites a value to `y|mo|d|h|mi|s|half|zone`; the first pattern that
matches the whole trimmed value decides, and a field out of its range makes the value unreadable (strict). All of
it is one projection of built-in expressions, so it runs in the scan's stage; the zone lookup is a join to a small
table that the planner broadcasts by its known size.

Defined results: null, blank, partial (coarser than a minute) and unreadable values give null; a value without zone
whose source has no known default zone gives null; duplicates give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline.functions.cols import bind

# fixed values: months and zone abbreviations as minutes from UTC; the last table holds the ones that depend on the source's zone
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
BY_ZONE = {("CST", "Asia/Shanghai"): 480, ("IST", "Europe/Dublin"): 60, ("IST", "Asia/Jerusalem"): 120}

_MON = r"(?i:(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)"
_ZONE = r"(?i: ?(Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5}))?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_HALF = r"(?: ?(?i:([AP])\.?M\.?))?"

#: (pattern, replacement) in the order they are tried; every pattern is anchored at both ends.
CASCADE = [
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[Tt ]{_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6||$7"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,]\d+)?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6||$7"),
    (rf"^(\d{{1,2}})-?{_MON})-?(\d{{4}})[: ]{_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6||$7"),
    (rf"^(?:[A-Za-z]{{3}}, )?(\d{{1,2}}) {_MON}[A-Za-z]*) (\d{{4}}),? {_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6||$7"),
    (rf"^{_MON}[A-Za-z]*)\.? (\d{{1,2}}),? (\d{{4}}),? {_CLOCK}{_HALF}$", "$3|$1|$2|$4|$5|$6|$7|"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_CLOCK}{_HALF}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}) {_CLOCK}{_HALF}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8"),
]
#: Dates with slashes and the year last; the source's date order says which part is the day.
SLASH = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_CLOCK}{_HALF}{_ZONE}$"
SLASH_ORDERS = {"MDY": "$3|$1|$2|$4|$5|$6|$7|$8", "DMY": "$3|$2|$1|$4|$5|$6|$7|$8"}
EPOCH = r"^(\d{10})(?:\d{3})?$"


def with_utc(
    df: DataFrame,
    value: str,
    tz: str,
    date_order: str,
    ambiguous: str = "earlier",
    nonexistent: str = "before",
    prefix: str = "utc",
) -> DataFrame:
    """Append {prefix}_seconds (epoch seconds, fractions cut) and {prefix}_status to df.

    status: exact (the value names its offset), unique, ambiguous or nonexistent (local time), null if unreadable.
    ambiguous: earlier or later instant; nonexistent: offset before or after the change. Columns of df with the
    appended names are replaced.
    """
    if ambiguous not in ("earlier", "later") or nonexistent not in ("before", "after"):
        raise ValueError("ambiguous is earlier or later, nonexistent is before or after")
    df = df.drop(f"{prefix}_seconds", f"{prefix}_status")
    p = f"__{prefix}_"
    v = F.trim(F.regexp_replace(F.col(value).cast("string"), r"\s+", " "))
    parts = F.when(F.lit(False), F.lit(""))
    for pattern, rewrite in CASCADE:
        parts = parts.when(F.col(f"{p}v").rlike(pattern), F.regexp_replace(f"{p}v", pattern, rewrite))
    for order, rewrite in SLASH_ORDERS.items():
        parts = parts.when(F.col(f"{p}v").rlike(SLASH) & (F.upper(F.col(date_order)) == order), F.regexp_replace(f"{p}v", SLASH, rewrite))
    out = bind(bind(df, **{f"{p}v": v}), **{f"{p}p": F.split(parts, r"\|", -1)})

    def part(i: int) -> Column:
        return F.get(F.col(f"{p}p"), F.lit(i))

    month = F.upper(part(1))
    mon = F.coalesce(F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(i + 1))])[month], month.try_cast("int"))
    hour, half = part(3).cast("int"), F.upper(part(6))
    hour = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "P", 12).otherwise(0))
    second = F.when(part(5) == "", F.lit("0")).otherwise(part(5)).cast("int")
    local = F.when(
        hour.between(0, 23) & part(4).cast("int").between(0, 59) & second.between(0, 59),
        F.try_make_timestamp(part(0).cast("int"), mon, part(2).cast("int"), hour, part(4).cast("int"), second.cast("decimal(8,6)"), F.lit("UTC")),
    )
    zone = F.upper(part(7))
    digits = F.regexp_replace(zone, "[^0-9]", "")
    off = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    named = F.when(F.lit(False), F.lit(0))
    for (abbr, where), minutes in BY_ZONE.items():
        named = named.when((zone == abbr) & (F.col(tz) == where), F.lit(minutes))
    named = named.otherwise(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])[zone])
    offset = F.when(zone.rlike(r"^[+-]"), F.when(off <= 18 * 60, F.when(zone.startswith("-"), -off).otherwise(off))).otherwise(named)
    epoch = F.when(F.col(f"{p}v").rlike(EPOCH), F.substring(F.col(f"{p}v"), 1, 10).cast("long"))
    out = bind(out, **{f"{p}l": local, f"{p}z": zone, f"{p}o": offset, f"{p}e": epoch})

    # Local times: to_utc_timestamp reads a time that occurs twice as its first instant and a skipped one with the
    # offset before the change; the other reading uses the offset that holds a day later.
    l, z = F.col(f"{p}l"), F.col(tz)
    known = l.isNotNull() & (F.col(f"{p}z") == "") & z.isNotNull()
    out = bind(out, **{f"{p}first": F.when(known, F.unix_seconds(F.to_utc_timestamp(l, z)))})
    first = F.col(f"{p}first")
    day_on = F.timestamp_seconds(first + 86400)
    out = bind(out, **{f"{p}other": F.unix_seconds(l) - (F.unix_seconds(F.from_utc_timestamp(day_on, z)) - F.unix_seconds(day_on))})
    other = F.col(f"{p}other")

    def back(s: Column) -> Column:
        return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), z))

    status = (
        F.when(F.col(f"{p}e").isNotNull(), "exact")
        .when(l.isNotNull() & (F.col(f"{p}z") != "") & F.col(f"{p}o").isNotNull(), "exact")
        .when(first.isNull(), None)
        .when(back(first) != F.unix_seconds(l), "nonexistent")
        .when((other != first) & (back(other) == F.unix_seconds(l)), "ambiguous")
        .otherwise("unique")
    )
    out = bind(out, **{f"{prefix}_status": status})
    st = F.col(f"{prefix}_status")
    seconds = (
        F.when(F.col(f"{p}e").isNotNull(), F.col(f"{p}e"))
        .when(st == "exact", F.unix_seconds(l) - F.col(f"{p}o").cast("long") * 60)
        .when((st == "ambiguous") & F.lit(ambiguous == "later"), other)
        .when((st == "nonexistent") & F.lit(nonexistent == "after"), other)
        .otherwise(first)
    )
    out = bind(out, **{f"{prefix}_seconds": seconds})
    return out.select(*df.columns, f"{prefix}_seconds", f"{prefix}_status")


def utc_text(seconds: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ of epoch seconds, whatever the session's zone is."""
    day = F.floor(seconds / F.lit(86400.0)).cast("int")
    rest = F.pmod(seconds, F.lit(86400)).cast("int")

    def two(c: Column) -> Column:
        return F.lpad(c.cast("int").cast("string"), 2, "0")

    return F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"),
        two(F.floor(rest % 3600 / 60)), F.lit(":"), two(rest % 60), F.lit("Z"),
    )


def normalise_site_times(rows: DataFrame, sites: DataFrame, value: str = "value", subject: str = "usubjid") -> DataFrame:
    """with_utc for rows of trial subjects: the site is the second piece of the subject key.

    A site listed more than once takes its smallest (tz, date_order), so that rows never multiply.
    """
    s = sites.groupBy(F.upper(F.trim("siteid")).alias("__site")).agg(F.min(F.struct("tz", "date_order")).alias("__s")).select("__site", "__s.tz", "__s.date_order")
    s = s.select("__site", F.col("tz").alias("__tz"), F.col("date_order").alias("__order")).where(F.col("__site").isNotNull())
    site = F.upper(F.trim(F.get(F.split(F.trim(F.col(subject)), "-"), F.lit(1))))
    joined = rows.withColumn("__k", site).join(s, F.col("__k") == F.col("__site"), "left")
    kept = [c for c in rows.columns if c not in ("utc_seconds", "utc_status")]
    return with_utc(joined, value, "__tz", "__order").select(*kept, "utc_seconds", "utc_status")
