"""Column helpers shared by all operators. Null and blank both mean missing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    """The value as written, or null where it is missing (null or only white space)."""
    s = c.cast("string")
    return F.when(F.trim(s) != "", s)


def clean(c: Column) -> Column:
    """Trimmed value, null where blank."""
    s = F.trim(c.cast("string"))
    return F.when(s != "", s)


def standard_null(c: Column) -> Column:
    """Trimmed value; blank, NULL, N/A and a single dot become null."""
    s = F.trim(c.cast("string"))
    return F.when(~F.upper(s).isin("", "NULL", "N/A", "."), s)


def or_default(df: DataFrame, name: str, default) -> Column:
    """Value of a column, or a default where it is missing or the column is absent."""
    d = F.lit(default)
    return F.coalesce(filled(F.col(name)), d) if name in df.columns else d


#: A decimal number as text. Casting alone would also read the type suffixes 1d and 1f.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def safe_double(c: Column) -> Column:
    """Number of a numeric text; null where it does not parse."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(NUMBER), s).try_cast("double")


def safe_int(c: Column) -> Column:
    """Integer part of a numeric text (towards zero); null where it does not parse or leaves the int range."""
    return safe_double(c).try_cast("int")


def map_lookup(c: Column, mapping: Mapping[str, str], otherwise: Column | None = None) -> Column:
    """Lookup in a small literal map; keys not found give `otherwise` (null by default)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    hit = F.create_map(*pairs)[c]
    return hit if otherwise is None else F.coalesce(hit, otherwise)


def yes_no(c: Column) -> Column:
    """Y for Y, YES, 1, TRUE in any case, N for everything else and for missing."""
    return F.when(F.upper(F.trim(c.cast("string"))).isin("Y", "YES", "1", "TRUE"), "Y").otherwise("N")


def key_norm(c: Column) -> Column:
    """Key comparison form: trimmed, upper case; blank is null."""
    s = F.upper(F.trim(c.cast("string")))
    return F.when(s != "", s)


def iso_date(c: Column) -> Column:
    """Date of a complete ISO date (or the date part of a datetime); null for partial or malformed text."""
    s = F.translate(F.trim(c.cast("string")), "/", "-")
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def impute_date(c: Column, end: bool = False) -> Column:
    """Complete a partial ISO date: start takes the first day or month, end the last."""
    s = F.trim(c.cast("string"))
    month = F.try_to_timestamp(F.concat(s, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")
    year = F.try_to_timestamp(F.concat(s, F.lit("-12-31" if end else "-01-01")), F.lit("yyyy-MM-dd")).cast("date")
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), iso_date(s))
        .when(s.rlike(r"^\d{4}-\d{2}$"), F.last_day(month) if end else month)
        .when(s.rlike(r"^\d{4}$"), year)
    )


def imputation_flag(c: Column) -> Column:
    """D: day was imputed; M: month and day were; null for a complete or unreadable date."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(r"^\d{4}-\d{2}$"), "D").when(s.rlike(r"^\d{4}$"), "M")


def study_day(d: Column, ref: Column) -> Column:
    """(d - ref) in days + 1; null where either is null."""
    return F.datediff(d, ref) + 1


def bind(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later steps refer to several times, evaluated once a row.

    A generator over a one-element array is a barrier to the optimiser: filters and projections above it see plain
    columns instead of copies of the expressions, whose size would otherwise double with every layer.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
