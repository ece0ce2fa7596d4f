"""Readers and writers of dataset files, dispatched by suffix. Text formats come in as strings; typing is a later step."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaline.functions.cols import standard_null
from vitaline.sources import xport

DELIMITERS = (",", "\t", ";", "|")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The first of comma, tab, semicolon and bar that occurs in the first line."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return next((d for d in DELIMITERS if d in line), ",")


def read_csv(spark: SparkSession, path: str, sep: str | None = None, header: bool = True) -> DataFrame:
    """All columns as text; short rows are padded with nulls; without header the columns are COL0, COL1, ... and no row is lost."""
    df = spark.read.csv(path, sep=sep or sniff_delimiter(spark, path), header=header, inferSchema=False, mode="PERMISSIVE", escape='"', multiLine=False)
    return df if header else df.toDF(*[f"COL{i}" for i in range(len(df.columns))])


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """JSON object of column arrays as rows; shorter columns are padded with nulls."""
    df = spark.read.json(path, multiLine=True)
    cols = [c for c in df.columns if isinstance(df.schema[c].dataType, T.ArrayType)]
    if not cols:
        raise ValueError("the document holds no column arrays")
    rows = df.select(F.inline(F.arrays_zip(*[F.col(f"`{c}`") for c in cols])))
    return rows.toDF(*cols)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix in (".csv", ".txt", ".tsv"):
        return read_csv(spark, path)
    if suffix == ".json":
        return read_sidecar(spark, path)
    if suffix in (".xpt", ".xpt5"):
        return xport.read(spark, path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".orc":
        return spark.read.orc(path)
    if suffix == ".sas7bdat":
        raise NotImplementedError("sas7bdat needs a reader library that is not part of this engine; export XPT, CSV or Parquet")
    raise ValueError(f"no reader for {suffix or 'files without suffix'}")


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", one_file: bool = False) -> None:
    """Write as parquet, orc, csv or xpt; one_file is for report-size frames only. Missing text is written as blank in csv."""
    out = df.coalesce(1) if one_file else df
    if fmt == "csv":
        out.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")
    elif fmt == "xpt":
        xport.write(df, path)
    elif fmt in ("parquet", "orc"):
        out.write.mode("overwrite").format(fmt).save(path)
    else:
        raise ValueError(f"no writer for {fmt}")


def standardise_nulls(df: DataFrame) -> DataFrame:
    """Blank, NULL, N/A and a single dot become null in every text column; other text is trimmed."""
    return df.select(*[standard_null(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def merge_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Split exports of one dataset under each other; columns a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, suffix, bytes, md5) of the files of a folder, without moving their content to the driver."""
    f = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return f.select(name.alias("name"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("suffix"), F.col("length").alias("bytes"), F.md5("content").alias("md5"))


def describe(df: DataFrame) -> dict:
    """Names, types and number of rows of a dataset."""
    return {"variables": df.columns, "types": dict(df.dtypes), "n_variables": len(df.columns), "n_records": df.count()}


def load_rules(text: str) -> list[dict]:
    """Declarative specification as JSON: a list of objects, or an object with one list."""
    x = json.loads(text)
    return x if isinstance(x, list) else next((v for v in x.values() if isinstance(v, list)), [])
