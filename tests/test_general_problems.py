import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vitaline.operators import orphans, profile, reshape, units

D = datetime(2023, 1, 1)


# --- reshape


def test_cells_and_types(spark):
    attrs = [("A", "txt"), ("N", "int"), ("X", "num"), ("T", "date"), ("B", "yn")]
    rows = [
        ("e1", " a ", " hello  ", D, 1, 9), ("e1", "A", "", D + timedelta(9), 2, 9), ("e1", "a", "later", D + timedelta(1), 3, 9), ("e1", "n", "8 764", D, 4, 9), ("e1", "n", "TBD", D + timedelta(5), 5, 9),
        ("e2", "n", "07,715.0", D, 6, 9), ("e2", "N", "1,006", D, 7, 9), ("e2", "x", "+12,50", D, 8, 9), ("e3", "x", "5.0e+01", D, 9, 9), ("e3", "t", "05.06.2020", D, 10, 9), ("e4", "t", "February 29, 2020", D, 11, 9),
        ("e4", "t", "30FEB2021", D + timedelta(3), 12, 9), ("e4", "b", "false", D, 13, 9), ("e4", "b", "maybe", D + timedelta(3), 14, 9), (None, "A", "x", D, 15, 9), ("", "A", "x", D, 16, 9), ("e5", None, "x", D, 17, 9),
        ("e5", "ZZ", "x", D, 18, 9), ("e6", "A", "one", None, 19, 9), ("e6", "A", "two", D, 20, 9), ("e7", "A", "tie1", D, 21, 9), ("e7", "A", "tie2", D, 22, 9), ("e8", "A", "y" * 100_000, D, 23, 9), ("e9", "A", "N/A", D, 24, 9),
    ]
    df = spark.createDataFrame(rows, "e string, k string, v string, received_at timestamp, rec_id long, `__v` int")
    wide = reshape.to_wide(df, attrs, "e", "k", "v")
    got = {r.e: r for r in wide.collect()}
    assert set(got) == {"e1", "e2", "e3", "e4", "e6", "e7", "e8"}
    assert got["e1"].A == "later" and got["e1"].N == Decimal(8764) and got["e2"].N == Decimal(1006) and got["e2"].X == Decimal("12.5")
    assert got["e3"].X == 50 and got["e3"]["T"] == date(2020, 6, 5) and got["e4"]["T"] == date(2020, 2, 29) and got["e4"].B == "N"
    assert got["e6"].A == "two" and got["e7"].A == "tie2" and len(got["e8"].A) == 100_000
    cells = {(r.entity, r.attr): r.val for r in reshape.to_long(wide, attrs, "e").collect()}
    assert cells["e2", "X"] == "12.5" and cells["e3", "X"] == "50" and cells["e3", "T"] == "2020-06-05" and ("e1", "B") not in cells
    empty = reshape.to_wide(df.limit(0), attrs, "e", "k", "v")
    assert empty.collect() == [] and empty.columns == ["e", "A", "N", "X", "T", "B"]
    with pytest.raises(ValueError):
        reshape.to_wide(df, [("A", "txt"), ("A", "num")], "e", "k", "v")


def test_reshape_against_loop(spark):
    rng = random.Random(5)
    rows = [(f"e{rng.choice([0, 0, 0, rng.randrange(40)])}", rng.choice("ABC"), rng.choice(["1", "2", "x", " ", "3.0"]), D + timedelta(hours=rng.randrange(50)), i) for i in range(3000)]
    want = {}
    for e, a, v, t, i in sorted(rows, key=lambda r: (r[3], r[4])):
        if v.strip() not in ("", "x"):
            want[e, a] = v.removesuffix(".0")
    df = spark.createDataFrame(rows, "e string, k string, v string, received_at timestamp, rec_id long").repartition(7)
    attrs = [(a, "int") for a in "ABC"]
    got = {(r.entity, r.attr): r.val for r in reshape.to_long(reshape.to_wide(df, attrs, "e", "k", "v"), attrs, "e").collect()}
    assert got == want


# --- profile

AGE = profile.Expectation("t", "x", lo=0, hi=120)
FLAG = profile.Expectation("t", "f", codes=("Y", "N"))


def test_numeric_findings_and_thresholds(spark):
    rows = [(0, a) for a in [40] * 20] + [(2, a) for a in [48] * 17 + [None] * 3] + [(3, a) for a in [57] * 92 + [999] * 8] + [(5, a) for a in [57] * 91 + [999] * 9] + [(7, None)] * 4 + [(None, 1)]
    df = spark.createDataFrame(rows, "load_no int, x int")
    got = sorted((r.load_no, r.finding) for r in profile.numeric_findings(df, AGE).collect())
    assert got == [(3, "shift"), (5, "range"), (7, "nulls")]  # 15 %, 8 years and 8 % exactly are none
    assert profile.numeric_findings(df.limit(0), AGE).collect() == []


def test_categorical_findings_and_thresholds(spark):
    def load(k, **n):
        return [(k, {"blank": " ", "none": None}.get(v, v)) for v, c in n.items() for _ in range(c)]

    rows = load(1, Y=50, N=50) + load(2, Y=72, N=28) + load(4, Y=49, N=51) + load(5, Y=60, y=20, N=20) + load(6, Y=59, y=21, N=20) + load(8, Y=84, none=8, blank=8) + load(9, none=3)
    df = spark.createDataFrame(rows, "load_no int, f string")
    got = sorted((r.load_no, r.finding) for r in profile.categorical_findings(df, FLAG).collect())
    assert got == [(4, "shift"), (5, "shift"), (6, "pattern"), (8, "nulls"), (8, "shift"), (9, "nulls")]
    assert profile.categorical_findings(df.limit(0), FLAG).collect() == []


def test_profile_cells(spark):
    df = spark.createDataFrame([(0, 1, "a"), (0, 3, " "), (0, None, "bb"), (1, 5, "a"), (1, 7, None)], "load_no int, n int, `s.x` string")
    got = {(r["col"], r.load_no): r for r in profile.profile(df, "t", {"s.x": "^a$"}).collect()}
    assert got["n", 0].n_missing == 1 and got["n", 0].mean == 2 and got["n", 0].n_distinct == 2 and (got["n", 1].min_num, got["n", 1].max_num) == (5, 7)
    assert got["s.x", 0].n_violations == 1 and got["s.x", 0].n_missing == 1 and got["s.x", 1].n_missing == 1
    assert got["n", 1].std_diff == round(4 / 2**0.5, 6)
    assert profile.profile(df.limit(0), "t").collect() == []


# --- units


def test_quantities(spark):
    table = [("SYSBP", "mmHg", True, 60.0, 260.0), ("SYSBP", "kPa", False, 8.0, 35.0), ("SYSBP", "cmHg", False, 6.0, 26.0), ("PULSE", "beats/min", True, 30.0, 220.0), ("RESP", "breaths/min", True, 4.0, 60.0), ("TEMP", "C", True, 30.0, 45.0),
             ("TEMP", "F", False, 86.0, 113.0), ("TEMP", "K", False, 303.0, 318.0), ("WEIGHT", "kg", True, 25.0, 250.0), ("WEIGHT", "st", False, 4.0, 40.0), ("WEIGHT", "lb", False, 55.0, 550.0), ("HEIGHT", "cm", True, 91.0, 250.0), ("HEIGHT", "m", False, 0.9, 2.5),
             ("HEIGHT", "mm", False, 910.0, 2500.0), ("HEIGHT", "ft", False, 3.0, 8.2), ("HEIGHT", "in", False, 36.0, 90.0), ("OXYSAT", "%", True, 50.0, 100.0), ("OXYSAT", "fraction", False, 0.5, 1.0)]
    cases = [
        ("SYSBP", "120 mm Hg", None, "mmHg", 1200), ("SYSBP", "16,0 kPa", "mmHg", "kPa", 1200), ("SYSBP", "12.5cm Hg - repeat", "", "cmHg", 1250), ("SYSBP", "120", None, "mmHg", 1200), ("SYSBP", "7.0", None, "cmHg", 700),
        ("SYSBP", "15", None, None, None), ("PULSE", "80bpm", None, "beats/min", 800), ("RESP", "16 bpm", None, "breaths/min", 160), ("TEMP", "98.6", "deg F", "F", 370), ("TEMP", "310.15", "", "K", 370), ("TEMP", "37,05°C", None, "C", 371),
        ("WEIGHT", "9st 9lbs", "kg", "st", 612), ("WEIGHT", "11 stone 0 lb", None, "st", 699), ("HEIGHT", "5'6\"", "cm", "ft", 1676), ("HEIGHT", "5ft11", None, "ft", 1803), ("HEIGHT", "1.7", "M", "m", 1700), ("HEIGHT", "1700 mm", None, "mm", 1700),
        ("OXYSAT", "0.97", "1", "fraction", 970), ("OXYSAT", "97 % (manual)", None, "%", 970), ("oxysat ", "0.97", None, "fraction", 970), ("TEMP", "not done", "C", None, None), ("TEMP", None, "C", None, None), ("TEMP", "", None, None, None),
        (None, "37", "C", None, None), ("OTHER", "37", "C", None, None), ("TEMP", "x" * 20000 + " 37.0 C", None, "C", 370), ("TEMP", "approx 37.0C clothed", "K", "C", 370),
    ]
    df = spark.createDataFrame([(i, *c[:3], "clash") for i, c in enumerate(cases)], "rec_id int, vstestcd string, vsorres string, vsorresu string, num string").withColumn("unit", F.lit("clash")).withColumn("den", F.lit(1))
    u = spark.createDataFrame(table, "vstestcd string, unit string, is_std boolean, lo double, hi double")
    got = {r.rec_id: (r.unit, r.std_tenths) for r in units.standardise(df, u).collect()}
    assert got == {i: (c[3], c[4]) for i, c in enumerate(cases)}
    assert units.standardise(df.limit(0), u).count() == 0 and units.standardise(df, u.limit(0)).where("unit is not null").count() == 0


# --- references


def test_orphans_against_loop(spark):
    rng = random.Random(8)
    parents = [(rng.choice(["k%d", "K%d ", " k%d"]) % rng.randrange(30), D + timedelta(days=rng.randrange(60)), None if rng.random() < 0.7 else D, i) for i in range(60)] + [(None, D, None, 99)]
    children = [(rng.choice(["k%d", " K%d"]) % (7 if rng.random() < 0.4 else rng.randrange(45)), D + timedelta(days=rng.randrange(90), minutes=i), i) for i in range(4000)] + [(None, D, 90001), ("  ", D, 90002), ("k1", None, 90003)]
    state = {}
    for k, at, gone, _ in parents:
        if k is not None:
            state.setdefault(k.strip().upper(), []).append(None if gone else at)
    want = set()
    for k, at, i in children:
        k = (k or "").strip().upper()
        rows = state.get(k) if k else None
        live = [x for x in rows or [] if x is not None]
        kind = "missing" if not rows else "deleted" if not live else "late" if at is not None and min(live) > at else None
        if kind:
            want.add((i, at and at.strftime("%Y-%m"), kind))
    p = spark.createDataFrame(parents, "usubjid string, received_at timestamp, deleted_at timestamp, k int")
    c = spark.createDataFrame(children, "usubjid string, received_at timestamp, rec_id long").withColumn("k", F.lit(1)).withColumn("kind", F.lit("x"))
    counts, keys = {}, {}
    by_id = {i: (k or "").strip().upper() for k, _, i in children}
    for i, m, k in want:
        counts[m, k] = counts.get((m, k), 0) + 1
        keys.setdefault((m, k), set()).add(by_id[i])
    assert orphans.heavy_keys(c, "usubjid", 0.1).count() == 1
    # no key is heavy, one is, some are, all are
    for share in (1.0, 0.1, 0.015, 0.0):
        assert sorted(map(str, orphans.orphan_rows(c, p, "usubjid", share=share).collect())) == sorted(str(Row(rec_id=i, period=m, kind=k)) for i, m, k in want)
        report = {(r.period, r.kind): (r.n_rows, r.n_keys) for r in orphans.orphan_report(c, p, "usubjid", share=share).collect()}
        assert report == {x: (n, len(keys[x] - {""})) for x, n in counts.items()}
    assert orphans.orphan_rows(c.limit(0), p, "usubjid").count() == 0
    assert {r.kind for r in orphans.orphan_rows(c, p.limit(0), "usubjid").collect()} == {"missing"}
