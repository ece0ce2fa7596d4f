import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitaline.sources import datasets, xport
from vitaline.streaming import events


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('A;B;C\n1;"x;y";\n2;z\n')
    df = datasets.read_dataset(spark, str(p))
    assert [tuple(r) for r in df.collect()] == [("1", "x;y", None), ("2", "z", None)] and datasets.sniff_delimiter(spark, str(p)) == ";"
    assert [tuple(r) for r in datasets.read_csv(spark, str(p), header=False).collect()][0] == ("A", "B", "C")
    e = tmp_path / "e.csv"
    e.write_text("")
    assert datasets.sniff_delimiter(spark, str(e)) == ","


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), (None, None), (" N/A ", -2.0)], "s string, x double")
    for fmt in ("parquet", "orc"):
        datasets.write_dataset(df, str(tmp_path / f"t.{fmt}"), fmt)
        assert sorted(map(str, datasets.read_dataset(spark, str(tmp_path / f"t.{fmt}")).collect())) == sorted(map(str, df.collect()))
    assert [r.s for r in datasets.standardise_nulls(df).collect()] == ["a", None, None]
    assert datasets.merge_parts([df, df.select("s").withColumn("y", F.lit(1))]).columns == ["s", "x", "y"]
    with pytest.raises(ValueError):
        datasets.read_dataset(spark, "x.unknown")
    with pytest.raises(NotImplementedError):
        datasets.read_dataset(spark, "x.sas7bdat")


def test_sidecar_and_files(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps({"A": [1, 2, None], "B": ["x"]}))
    assert [tuple(r) for r in datasets.read_dataset(spark, str(p)).collect()] == [(1, "x"), (2, None), (None, None)]
    assert datasets.list_files(spark, str(tmp_path)).first().suffix == "json"
    assert datasets.describe(spark.range(3))["n_records"] == 3
    assert datasets.load_rules('{"rules": [{"a": 1}]}') == [{"a": 1}]


@settings(max_examples=300, deadline=None)
@given(st.floats(min_value=-1e60, max_value=1e60).filter(lambda x: x == 0 or abs(x) > 1e-60))
def test_ibm_doubles(x):
    assert xport.from_ibm(xport.to_ibm(x)) == pytest.approx(x, rel=1e-15)


def test_transport_file(spark, tmp_path):
    rows = [("u%d" % i, None if i == 3 else i / 3, "é" if i == 5 else None) for i in range(57)]
    df = spark.createDataFrame(rows, "USUBJID string, AVAL double, TXT string").repartition(3)
    p = str(tmp_path / "adlb.xpt")
    datasets.write_dataset(df, p, "xpt")
    back = datasets.read_dataset(spark, p)
    assert back.columns == ["USUBJID", "AVAL", "TXT"] and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    with pytest.raises(ValueError):
        xport.write(df.withColumnRenamed("AVAL", "TOOLONGNAME"), p)
    empty = str(tmp_path / "none.xpt")
    xport.write(df.limit(0), empty)
    assert xport.read(spark, empty).count() == 0
    (tmp_path / "bad.xpt").write_bytes(b"x" * 1000)
    with pytest.raises(ValueError):
        xport.read(spark, str(tmp_path / "bad.xpt"))


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = events.tumbling(stream, "1 hour", "1 day").writeStream.format("memory").queryName("hourly").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda rs: sorted((r.event_type, r.start, r.n) for r in rs)
    assert key(spark.table("hourly").collect()) == key(events.tumbling(src, "1 hour").collect())
    w = events.write_batches(events.range_alerts(stream, 1.0, 50.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    w.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.range_alerts(src, 1.0, 50.0).count()
