from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from vitaline.operators import timestamps as t

ZONES = ["America/New_York", "Europe/Paris", "Australia/Adelaide", "Asia/Kolkata", "America/Phoenix", "Europe/London", "Asia/Shanghai"]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id int, v string, tz string, o string")
    out = t.with_utc(df, "v", "tz", "o", **kw).withColumn("utc", t.utc_text(F.col("utc_seconds")))
    return {r.id: (r.utc, r.utc_status) for r in out.collect()}


def brute(local: datetime, tz: str) -> datetime:
    """Earlier instant of a repeated time; a skipped one with the offset before the change (fold 0 means both)."""
    return local.replace(tzinfo=ZoneInfo(tz), fold=0).astimezone(timezone.utc)


def test_local_times_against_zoneinfo(spark):
    rows, want = [], {}
    for z in ZONES:
        for day in ("2021-03-14", "2021-11-07", "2022-03-27", "2022-10-30", "2023-04-02", "2023-10-01", "2024-07-01"):
            for m in range(0, 24 * 60, 37):
                x = datetime.fromisoformat(day) + timedelta(minutes=m)
                rows.append((len(rows), x.strftime("%Y-%m-%dT%H:%M:%S"), z, "MDY"))
                want[rows[-1][0]] = brute(x, z).strftime("%Y-%m-%dT%H:%M:%SZ")
    got = run(spark, rows)
    assert {k: v[0] for k, v in got.items()} == want


CASES = [
    ("2020-08-16T05:21:59Z", "2020-08-16T05:21:59Z"), ("  2021-02-16T02:42 ", "2021-02-16T07:42:00Z"), ("20240223T024823Z", "2024-02-23T02:48:23Z"), ("1691086617744", "2023-08-03T18:16:57Z"), ("1670301829", "2022-12-06T04:43:49Z"),
    ("2021-11-19T12:53:09+08:00", "2021-11-19T04:53:09Z"), ("2024-01-21T12:26:31+01", "2024-01-21T11:26:31Z"), ("2021-09-11T14:53:46-0330", "2021-09-11T18:23:46Z"), ("2022-11-20T22:02:17.576139+01:00", "2022-11-20T21:02:17Z"),
    ("12Apr2021:12:40:45", "2021-04-12T16:40:45Z"), ("30 Sep 2022 17:21:59 +0200", "2022-09-30T15:21:59Z"), ("17.02.2023 03:06", "2023-02-17T08:06:00Z"), ("12/08/2021 01:56 PM", "2021-12-08T18:56:00Z"), ("5/9/2022 10:10", "2022-05-09T14:10:00Z"),
    ("2020/10/26 00:02", "2020-10-26T04:02:00Z"), ("February 10, 2021 7:33 pm", "2021-02-11T00:33:00Z"), ("May 4, 2022 12:05 am", "2022-05-04T04:05:00Z"), ("2022-10-23 19:39:55 EDT", "2022-10-23T23:39:55Z"), ("2021-06-04 17:15:25 CEST", "2021-06-04T15:15:25Z"),
    (None, None), ("", None), (" ", None), ("2023-10-31", None), ("2021-03", None), ("14JUN2020", None), ("25:61", None), ("2O23-O4-12T10:00", None), ("2023-02-30T10:00", None), ("13/13/2021 10:00", None), ("2021-01-01T24:00:00", None),
    ("13:00 PM", None), ("1/2/2021 13:00 PM", None), ("2022-01-01 10:00:00 XYZ", None), ("ongoing", None), ("x" * 10000, None),
]


def test_notations(spark):
    got = run(spark, [(i, v, "America/New_York", "MDY") for i, (v, _) in enumerate(CASES)])
    assert {CASES[i][0]: u for i, (u, _) in got.items()} == dict(CASES)


def test_order_zone_and_policy(spark):
    rows = [(0, "03/04/2021 10:00", "Europe/Paris", "DMY"), (1, "03/04/2021 10:00", "Europe/Paris", None), (2, "2021-01-01T10:00", None, "MDY"), (3, "2021-01-01 10:00:00 CST", "Asia/Shanghai", "YMD"), (4, "2021-01-01 10:00:00 CST", "America/Chicago", "MDY")]
    got = run(spark, rows)
    assert [got[i][0] for i in range(5)] == ["2021-04-03T08:00:00Z", None, None, "2021-01-01T02:00:00Z", "2021-01-01T16:00:00Z"]
    twice, skipped = [(0, "2020-10-25T02:30", "Europe/Paris", "DMY")], [(0, "2021-03-28T02:30", "Europe/Paris", "DMY")]
    assert run(spark, twice)[0] == ("2020-10-25T00:30:00Z", "ambiguous") and run(spark, twice, ambiguous="later")[0][0] == "2020-10-25T01:30:00Z"
    assert run(spark, skipped)[0] == ("2021-03-28T01:30:00Z", "nonexistent") and run(spark, skipped, nonexistent="after")[0][0] == "2021-03-28T00:30:00Z"
    with pytest.raises(ValueError):
        run(spark, twice, ambiguous="never")


def test_sites_never_multiply_rows_and_columns_may_clash(spark):
    rows = spark.createDataFrame([("ST1-001-7", "2021-01-01T10:00", "a"), ("ST1-001-7", "2021-01-01T10:00", "a"), (None, "2021-01-01T10:00", "b"), ("odd", "1670301829", "c")], "usubjid string, value string, tz string")
    sites = spark.createDataFrame([("001", "X", "Asia/Tokyo", "YMD"), ("001", "X", "Asia/Tokyo", "YMD"), (None, "Y", "UTC", "YMD")], "siteid string, country string, tz string, date_order string")
    out = t.normalise_site_times(rows, sites)
    assert out.columns == ["usubjid", "value", "tz", "utc_seconds", "utc_status"]
    got = sorted((r.tz, r.utc_seconds) for r in out.collect() if r.utc_seconds)
    assert got == [("a", 1609462800), ("a", 1609462800), ("c", 1670301829)] and out.count() == 4
    assert t.normalise_site_times(rows.limit(0), sites.limit(0)).count() == 0
