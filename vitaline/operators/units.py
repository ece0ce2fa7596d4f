"""Problem 5: quantities in different units, the unit sometimes only in the text, become one common unit.

A multi-pattern automaton (Aho-Corasick) finds unit aliases in the result text; the longest alias that ends at a
word boundary wins, and the test a row belongs to decides which unit an alias means (M is metres for a height,
"bpm" beats for a pulse and breaths for a respiratory rate). The Python stage only splits a text into numbers and
units, in Arrow batches with a bounded memo, as texts repeat; the conversion factors are a small table joined
afterwards, and the arithmetic is exact decimal arithmetic in the JVM. Nothing is shuffled (the registered queries spread
inputs of fewer partitions than the cluster has cores).

Defined results: a result without a number is no measurement (nulls, blanks, "not done"); an unknown unit text is
no unit; a result without unit gets the standard unit if its range holds the value, else the one unit whose range
does, else none; a comma is the decimal sign; repeated rows each give a row; an empty table gives an empty table;
a unit's range without lo or hi is open at that end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaline.functions.cols import bind

# fixed values: aliases of units, and per (test, unit) the standard unit's value = value * num / den + add
ALIASES = {
    "mmHg": ["mmhg", "mm hg", "mm[hg]", "mm [hg]", "millimeters of mercury", "millimetres of mercury", "torr"],
    "cmHg": ["cmhg", "cm hg", "cm[hg]", "cm [hg]"],
    "kPa": ["kpa", "kilopascal", "kilopascals"],
    "beats/min": ["beats/min", "beats per minute", "bpm", "/min", "beats/minute", "1/min", "per min", "per minute", "{beats}/min", "b/min"],
    "breaths/min": ["breaths/min", "breaths per minute", "bpm", "/min", "brpm", "breaths/minute", "1/min", "per min", "per minute", "{breaths}/min", "rpm"],
    "C": ["c", "°c", "degc", "deg c", "celsius", "cel", "degrees c", "degrees celsius", "℃", "º c", "ºc", "° c"],
    "F": ["f", "°f", "degf", "deg f", "fahrenheit", "[degf]", "degrees f", "degrees fahrenheit", "℉", "ºf", "° f"],
    "K": ["k", "kelvin", "kelvins", "°k"],
    "kg": ["kg", "kgs", "kilogram", "kilograms", "kilo", "kilos"],
    "lb": ["lb", "lbs", "pound", "pounds", "[lb_av]", "#"],
    "g": ["g", "gram", "grams", "gm", "gms"],
    "st": ["st", "stone", "stones", "[stone_av]"],
    "cm": ["cm", "cms", "centimeter", "centimeters", "centimetre", "centimetres"],
    "in": ["in", "ins", "inch", "inches", "\"", "[in_i]", "″", "”", "''"],
    "m": ["m", "meter", "meters", "metre", "metres"],
    "mm": ["mm", "millimeter", "millimeters", "millimetre", "millimetres"],
    "ft": ["ft", "foot", "feet", "'", "[ft_i]", "′", "’"],
    "%": ["%", "pct", "percent", "per cent", "prct"],
    "fraction": ["fraction", "ratio", "1", "frac"],
}
FACTORS = [
    ("SYSBP", "mmHg", "1", "1", "0"), ("SYSBP", "kPa", "760", "101.325", "0"), ("SYSBP", "cmHg", "10", "1", "0"),
    ("DIABP", "mmHg", "1", "1", "0"), ("DIABP", "kPa", "760", "101.325", "0"), ("DIABP", "cmHg", "10", "1", "0"),
    ("PULSE", "beats/min", "1", "1", "0"), ("RESP", "breaths/min", "1", "1", "0"),
    ("TEMP", "C", "1", "1", "0"), ("TEMP", "F", "5", "9", "-17.7777777777777777778"), ("TEMP", "K", "1", "1", "-273.15"),
    ("WEIGHT", "kg", "1", "1", "0"), ("WEIGHT", "lb", "0.45359237", "1", "0"), ("WEIGHT", "g", "1", "1000", "0"), ("WEIGHT", "st", "6.35029318", "1", "0"),
    ("HEIGHT", "cm", "1", "1", "0"), ("HEIGHT", "in", "2.54", "1", "0"), ("HEIGHT", "m", "100", "1", "0"), ("HEIGHT", "mm", "1", "10", "0"), ("HEIGHT", "ft", "30.48", "1", "0"),
    ("OXYSAT", "%", "1", "1", "0"), ("OXYSAT", "fraction", "100", "1", "0"),
]
#: Units that are written in two parts, and how many of the lesser make one of the greater.
COMPOUND = {("ft", "in"): 12, ("st", "lb"): 14}
NUMBER = re.compile(r"\d+(?:[.,]\d+)?|[.,]\d+")
MEMO = 200_000


class UnitReader:
    """Finds numbers and, by an automaton over all aliases, the unit after or beside them."""

    def __init__(self, by_test: dict[str, list[str]]):
        import ahocorasick

        self.by_test = {t: set(u) for t, u in by_test.items()}
        means: dict[str, set[str]] = {}
        for unit in {u for us in by_test.values() for u in us}:
            for alias in {unit.lower(), *ALIASES.get(unit, [])}:
                means.setdefault(alias, set()).add(unit)
        self.automaton = ahocorasick.Automaton()
        for alias, units in means.items():
            self.automaton.add_word(alias, (len(alias), frozenset(units)))
        if means:
            self.automaton.make_automaton()
        self.empty = not means
        self.memo: dict[tuple, tuple] = {}

    def units_in(self, test: str, text: str, bare: bool) -> list[tuple[int, int, str]]:
        """(start, end, unit) of the aliases in a lower-case text that are units of the test, longest match first."""
        mine, hits = self.by_test.get(test, set()), []
        if self.empty or not mine:
            return []
        for end, (size, units) in self.automaton.iter(text):
            start = end - size + 1
            before, after = text[start - 1 : start], text[end + 1 : end + 2]
            if text[start].isalnum() and (before.isalpha() or (before.isdigit() and text[start].isdigit())):
                continue
            if text[end].isalnum() and (after.isalpha() or (after.isdigit() and text[end].isdigit())):
                continue
            if not bare and text[start : end + 1] == "1":
                continue
            fits = units & mine
            if len(fits) == 1:
                hits.append((start, end + 1, next(iter(fits))))
        kept: list[tuple[int, int, str]] = []
        for h in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
            if all(h[1] <= k[0] or h[0] >= k[1] for k in kept):
                kept.append(h)
        return sorted(kept)

    def read(self, test: str | None, text: str | None, field: str | None) -> tuple[str | None, str | None, str | None, str | None]:
        """(number, number of the lesser unit, unit in the text, unit in the unit field)."""
        key = (test, text, field)
        hit = self.memo.get(key)
        if hit is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            hit = self.memo[key] = self._read(test or "", (text or "").lower(), (field or "").strip().lower())
        return hit

    def _read(self, test: str, text: str, field: str) -> tuple[str | None, str | None, str | None, str | None]:
        units = self.units_in(test, text, bare=False)
        inside = [(s, e) for s, e, _ in units]
        numbers = [m for m in NUMBER.finditer(text) if not any(s < m.end() and m.start() < e for s, e in inside)]
        named = [u for s, e, u in self.units_in(test, field, bare=True) if s == 0 and e == len(field)]
        if not numbers:
            return None, None, None, None
        first = numbers[0]
        after = [u for u in units if u[0] >= first.end()]
        mine = after[0] if after else (units[0] if units else None)
        unit, lesser = (mine[2] if mine else None), None
        if len(numbers) > 1 and mine and mine[1] <= numbers[1].start():
            then = [u for u in units if u[0] >= numbers[1].end()]
            if (unit, then[0][2] if then else "") in COMPOUND or (not then and any(g == unit for g, _ in COMPOUND)):
                lesser = numbers[1][0].replace(",", ".")
        return first[0].replace(",", "."), lesser, unit, (named[0] if named else None)


def read_quantities(df: DataFrame, by_test: dict[str, list[str]], test: str, text: str, field: str) -> DataFrame:
    """Append __num, __num2, __unit_text and __unit_field to df."""

    @F.pandas_udf("num string, num2 string, ut string, uf string")
    def parse(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        reader = UnitReader(by_test)
        for t, x, f in batches:
            t, x, f = (s.astype(object).where(s.notna(), None) for s in (t, x, f))
            yield pd.DataFrame([reader.read(*k) for k in zip(t, x, f, strict=True)], columns=["num", "num2", "ut", "uf"], dtype=object)

    out = df.withColumn("__q", parse(F.upper(F.trim(F.col(test).cast("string"))), F.col(text).cast("string"), F.col(field).cast("string")))
    return out.select(*df.columns, *[F.col(f"__q.{a}").alias(b) for a, b in (("num", "__num"), ("num2", "__num2"), ("ut", "__unit_text"), ("uf", "__unit_field"))])


def unit_list(units: DataFrame, limit: int = 5000) -> list[tuple[str, str, bool, float, float]]:
    """The unit table as rows held by the driver; more than `limit` rows raise."""
    rows = units.select(F.upper(F.trim("vstestcd")), F.trim("unit"), "is_std", "lo", "hi").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} units")
    return [tuple(r) for r in rows if r[0] and r[1]]


def factor_table(spark: SparkSession) -> DataFrame:
    d = "decimal(30,20)"
    return spark.createDataFrame(FACTORS, "__f_test string, __f_unit string, __f_num string, __f_den string, __f_add string").select("__f_test", "__f_unit", *[F.col(c).cast(d).alias(c) for c in ("__f_num", "__f_den", "__f_add")])


def standardise(df: DataFrame, units: DataFrame, test: str = "vstestcd", text: str = "vsorres", field: str = "vsorresu") -> DataFrame:
    """Append unit (as understood), is_std, std_unit and std_tenths (tenths of the standard unit, half up) to df.

    Columns of df with these names are replaced.
    """
    listed = unit_list(units)
    by_test: dict[str, list[str]] = {}
    for t, u, *_ in listed:
        by_test.setdefault(t, []).append(u)
    q = read_quantities(df, by_test, test, text, field)
    t = F.upper(F.trim(F.col(test).cast("string")))
    x = F.col("__num").try_cast("decimal(20,8)")
    none = F.lit(None).cast("string")
    # range rule, compiled from the bounded unit table
    in_std, fits = F.lit(None).cast("string"), F.array().cast("array<string>")
    std = F.lit(None).cast("string")
    for tt, u, is_std, lo, hi in sorted(listed, key=lambda r: (r[0], r[1])):
        # a range without one of its ends is open there; one without both holds nothing
        ends = [x >= F.lit(str(lo)).cast("decimal(20,8)")] * (lo is not None) + [x <= F.lit(str(hi)).cast("decimal(20,8)")] * (hi is not None)
        hold = reduce(Column.__and__, ends, t == tt) if ends else F.lit(False)
        if is_std:
            in_std = F.when(hold, F.lit(u)).otherwise(in_std)
            std = F.when(t == tt, F.lit(u)).otherwise(std)
        else:
            fits = F.concat(fits, F.when(hold, F.array(F.lit(u))).otherwise(F.array().cast("array<string>")))
    guess = F.coalesce(in_std, F.when(F.size(fits) == 1, F.get(fits, F.lit(0))).otherwise(none))
    unit = F.coalesce(F.col("__unit_text"), F.col("__unit_field"), guess)
    q = bind(q, __t=t, __x=x, __unit=F.when(F.col("__num").isNotNull(), unit), __std=std)
    j = q.join(factor_table(df.sparkSession), (F.col("__t") == F.col("__f_test")) & (F.col("__unit") == F.col("__f_unit")), "left")
    per = F.lit(None).cast("int")
    for (great, _), n in COMPOUND.items():
        per = F.when(F.col("__unit") == great, F.lit(n)).otherwise(per)
    kept = [c for c in df.columns if c not in ("unit", "is_std", "std_unit", "std_tenths")]
    return j.select(
        *kept, F.col("__unit").alias("unit"), (F.col("__unit") == F.col("__std")).alias("is_std"), F.col("__std").alias("std_unit"),
        _tenths(F.col("__x"), F.col("__num2").try_cast("decimal(20,8)"), per).alias("std_tenths"),
    )


def _tenths(x: Column, lesser: Column, per: Column) -> Column:
    """Half up of 10 * ((x + lesser / per) * num / den + add) in decimals wide enough to be exact to 1e-9."""
    wide = "decimal(38,12)"
    whole = F.when(lesser.isNotNull() & per.isNotNull(), ((x * per + lesser).cast("decimal(24,8)") * F.col("__f_num").cast("decimal(13,8)")).cast(wide) / (F.col("__f_den").cast("decimal(8,4)") * per)).otherwise(
        (x.cast("decimal(20,8)") * F.col("__f_num").cast("decimal(13,8)")).cast(wide) / F.col("__f_den").cast("decimal(8,4)")
    )
    value = whole.cast("decimal(30,12)") + F.col("__f_add").cast("decimal(20,12)")
    tenths = (value * 10).cast("decimal(30,9)")
    return F.floor(tenths + F.lit("0.5").cast("decimal(2,1)")).cast("long")
