"""Every rule of the packs fires on the row made for it and on no other."""

from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from vitaline.operators import rulepacks

T = datetime(2024, 1, 1)
ADSL = "studyid string, usubjid string, arm string, actarm string, armcd string, trt01p string, trt01a string, saffl string, ittfl string, pprotfl string, efffl string, trtsdt string, trtedt string, received_at timestamp, rec_id long"


def subject(rec_id, key, **changes):
    row = dict(studyid="S", usubjid=key, arm="A", actarm=None, armcd="A1", trt01p="A", trt01a="A", saffl="Y", ittfl="Y", pprotfl="Y", efffl=None, trtsdt="2024-01-10", trtedt="2024-02-10", received_at=T, rec_id=rec_id) | changes
    return tuple(row.values())


def adsl(spark, *rows):
    return spark.createDataFrame(rows, ADSL)


def hits(parts):
    out = Counter()
    for p in parts if isinstance(parts, list) else [parts]:
        for r in p.collect():
            out[r.rule_id, r.record] += 1
    return dict(out)


def test_adsl(spark):
    s = adsl(
        spark, subject(1, "u1"), subject(2, " U1 "), subject(3, "u3", saffl="N"), subject(4, "u4", ittfl="N"), subject(5, "u5", trt01p=None), subject(6, "u6", trt01a="B"),
        subject(7, "u7", trtedt="2024-01-09"), subject(8, "u8", efffl="X"), subject(9, "u9", studyid=" "), subject(10, None), subject(11, "u11", trtsdt="2024", trtedt=None),
    )
    keys = [(k,) for k in ("U1", "u3", "u4", "u5", "u6", "u7", "u8", "u9", "u11")]
    ex = spark.createDataFrame([(k, 5.0) for (k,) in keys] + [("u99", None)], "usubjid string, exdose double")
    dm = spark.createDataFrame([*keys, ("u12",), (None,)], "usubjid string")
    assert hits(rulepacks.adsl_pack(s, dm, ex)) == {
        ("ADSL001", "U1"): 1, ("ADSL010", "U1"): 1, ("ADSL002", "U12"): 1, ("ADSL003", "3"): 1, ("ADSL003", "10"): 1, ("ADSL004", "4"): 1, ("ADSL005", "5"): 1, ("ADSL009", "5"): 1,
        ("ADSL006", "6"): 1, ("ADSL007", "7"): 1, ("ADSL008", "8"): 1, ("ADSL009", "9"): 1, ("ADSL009", "10"): 1,
    }
    assert hits(rulepacks.adsl_pack(s.limit(0), dm.limit(0), ex.limit(0))) == {}


def test_bds(spark):
    cols = "usubjid string, paramcd string, adt date, aval double, avalc string, base double, chg double, pchg double, ablfl string, saffl string, trtp string, rec_id long"
    day = T.date()
    rows = [
        ("u1", "P", day, 5.0, "5", 5.0, None, None, "Y", "Y", "A", 1), ("u1", "P", day, 6.0, "7", 5.0, 1.0, 20.0, None, "Y", "A", 2), ("u1", "Q", day, 6.0, None, 5.0, None, None, "Y", "Y", "A", 3),
        ("u1", "R", day, 6.0, "x", 5.0, 2.0, 40.0, None, "N", "B", 4), ("u1", "S", day, 6.0, None, 0.0, 6.0, None, None, None, None, 5), ("u2", "S", None, None, None, None, None, None, None, "Y", "A", 6), ("u1", "T", day, 6.0, None, 5.0, 1.0, 21.0, None, "Y", "A", 7),
    ]
    got = hits(rulepacks.bds_pack(spark.createDataFrame(rows, cols), adsl(spark, subject(1, "U1", saffl="N"), subject(2, "u1"))))
    assert got == {("BDS001", "U1|P|2024-01-01"): 1, ("BDS002", "2"): 1, ("BDS003", "3"): 1, ("BDS004", "4"): 1, ("BDS005", "7"): 1, ("BDS006", "U2"): 1, ("BDS007", "4"): 1, ("BDS008", "4"): 1}


def test_adae_and_cross(spark):
    cols = "usubjid string, astdt string, trtemfl string, aedecod string, aebodsys string, trtp string, saffl string, ittfl string, rec_id long"
    rows = [("u1", "2024-01-11", "Y", "D", "B", "A", "Y", "Y", 1), ("u1", "2024-01-09", "Y", "D", "B", "B", "Y", "Y", 2), ("u1", "2024-05-01", "N", None, " ", "A", "Y", "N", 3), ("u2", None, "Y", "D", "B", None, None, None, 4), (None, None, None, "D", "B", "A", "N", "Y", 5)]
    a, s = spark.createDataFrame(rows, cols), adsl(spark, subject(1, "U1"))
    assert hits(rulepacks.adae_pack(a, s)) == {("ADAE002", "2"): 1, ("ADAE003", "2"): 1, ("ADAE004", "3"): 1, ("ADAE005", "3"): 1, ("ADAE001", "U2"): 1, ("ADAE006", "U2"): 1}
    dm = spark.createDataFrame([("u1",), ("u2",)], "usubjid string")
    assert hits(rulepacks.cross_pack(s, dm, {"ADAE": a})) == {("X001", "1|2"): 1, ("X002", "U2"): 1, ("X003", "2"): 1, ("X004", "3"): 1}


def test_dates(spark):
    dm = spark.createDataFrame([("u1", "2024-01-10", T, 1), ("u2", "10JAN2024", T, 2)], "usubjid string, rfstdtc string, received_at timestamp, rec_id long")
    ae = [("U1", "2024-01-09", "2024-01-08", 1), ("u1", "2024-01", None, 2), ("u1", "2023", "2023-05", 3), ("u2", "2024-01-01", "2024-01-01T10:00", 4), ("u3", "2024-02-01", "2024-01-31", 5), ("u1", None, "", 6)]
    ae = spark.createDataFrame(ae, "usubjid string, aestdtc string, aeendtc string, rec_id long")
    none = [spark.createDataFrame([], f"usubjid string, {c}stdtc string, {c}endtc string, rec_id long") for c in ("ex", "sv", "ds")]
    got = {(r.pair, r.record, r.result) for r in rulepacks.date_order_pack(dm, ae, *none).collect()}
    ref, own = "RFSTDTC<=AESTDTC", "AESTDTC<=AEENDTC"
    assert got == {(ref, "1", "FAIL"), (own, "1", "FAIL"), (ref, "2", "WARN"), (ref, "3", "FAIL"), (own, "3", "WARN"), (own, "5", "FAIL")}


def test_forms(spark):
    e = spark.createDataFrame([("u1", "Rash", "2024-01-01", "Y"), ("u1", "Fever", "2024-01-02", "N"), ("u1", None, None, "Y")], "usubjid string, aeterm string, aestdtc string, aeser string")
    f = spark.createDataFrame([(" U1", "rash ", "2024-01-01", 1), ("u1", "RASH", "2024-01-03", 2), ("u1", "fever", "2024-01-02", 3), ("u2", "rash", None, 4), ("u1", None, None, 5)], "usubjid string, aeterm string, aestdtc string, rec_id long")
    assert hits(rulepacks.sae_pack(f, e)) == {("RECON-SAE-003", "2"): 1, ("RECON-SAE-002", "3"): 1, ("RECON-SAE-001", "4"): 1}
    dm = spark.createDataFrame([("u1", "A", "DEU", T, 1), ("u2", "B", None, T, 2)], "usubjid string, arm string, country string, received_at timestamp, rec_id long")
    listed = spark.createDataFrame([("U1", "A", "DEU", 1), ("u1", "B", "FRA", 2), ("u3", "A", "DEU", 3), ("u2", "B", "DEU", 4), (None, "A", "DEU", 5)], "usubjid string, arm string, country string, rec_id long")
    assert hits(rulepacks.randomisation_pack(listed, dm, ["country"])) == {("RECON-RAND-001", "2"): 1, ("RECON-RAND-003", "2"): 1, ("RECON-RAND-002", "3"): 1}
    assert rulepacks.sae_pack(f.where(F.lit(False)), e).count() == 0
