"""SAS Transport version 5 files (a public format: 80-byte records, IBM doubles).

Reading is distributed: the driver parses the header, and tasks read disjoint ranges of the fixed-length records, so
the path must be visible to all executors. When writing, partitions are encoded by executors and the driver writes
them one by one; the format is a single file, so it is meant for export-size datasets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the format: the header records, each 80 bytes
LIBRARY = b"HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!000000000000000000000000000000  "
MEMBER = b"HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!000000000000000001600000000140  "
DESCRIPTOR = b"HEADER RECORD*******DSCRPTR HEADER RECORD!!!!!!!000000000000000000000000000000  "
NAMESTR = b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!000000%04d00000000000000000000  "
OBS = b"HEADER RECORD*******OBS     HEADER RECORD!!!!!!!000000000000000000000000000000  "
CARD = 80


def to_ibm(x: float | None) -> bytes:
    """IBM double of a number; missing is a dot followed by zeros."""
    if x is None or x != x:
        return b"." + b"\0" * 7
    if x == 0:
        return b"\0" * 8
    bits = struct.unpack(">Q", struct.pack(">d", x))[0]
    sign, exponent, fraction = bits >> 63, (bits >> 52) & 0x7FF, bits & ((1 << 52) - 1)
    if exponent == 0:
        return b"\0" * 8  # below the range of the format
    mantissa, power = (1 << 52) | fraction, exponent - 1022  # value = mantissa / 2**53 * 2**power
    shift = -power % 4
    base16 = (power + shift) // 4 + 64
    if not 0 <= base16 <= 127:
        raise OverflowError(f"{x} is out of the range of the format")
    return struct.pack(">Q", sign << 63 | base16 << 56 | (mantissa << 3) >> shift)


def from_ibm(b: bytes) -> float | None:
    b = b.ljust(8, b"\0")
    if b[1:] == b"\0" * 7 and b[0] in b"._ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        return None
    v = struct.unpack(">Q", b)[0]
    fraction = v & ((1 << 56) - 1)
    return (-1.0 if v >> 63 else 1.0) * fraction * 16.0 ** (((v >> 56) & 0x7F) - 64) / 2.0**56


@dataclass(frozen=True)
class Variable:
    name: str
    numeric: bool
    length: int
    label: str
    position: int


def header(name: str, variables: Sequence[Variable], label: str = "") -> bytes:
    stamp = b"01JAN20:00:00:00"
    out = [LIBRARY, (b"SAS     SAS     SASLIB  9.4     " + b" " * 32).ljust(64) + stamp, stamp.ljust(CARD), MEMBER, DESCRIPTOR]
    out += [(b"SAS     " + name.upper().encode().ljust(8)[:8] + b"SASDATA 9.4     ").ljust(64) + stamp, (stamp + b" " * 16 + label.encode("ascii", "replace").ljust(40)[:40]).ljust(CARD), NAMESTR % len(variables)]
    body = b""
    for i, v in enumerate(variables, 1):
        entry = struct.pack(">hhhh", 1 if v.numeric else 2, 0, v.length, i) + v.name.upper().encode().ljust(8)[:8] + v.label.encode("ascii", "replace").ljust(40)[:40]
        body += (entry + b" " * 8 + struct.pack(">hhh", 0, 0, 0) + b"\0\0" + b" " * 8 + struct.pack(">hhi", 0, 0, v.position)).ljust(140, b"\0")
    out.append(body.ljust(-(-len(body) // CARD) * CARD))
    return b"".join([*out, OBS])


def parse_header(data: bytes) -> tuple[list[Variable], int]:
    """Variables and the offset of the first observation."""
    at = data.find(b"NAMESTR HEADER RECORD")
    if not data.startswith(LIBRARY[:40]) or at < 0:
        raise ValueError("not a version 5 transport file")
    start = at - 20
    count, size = int(data[start + 54 : start + 58]), int(data[data.find(b"MEMBER  HEADER RECORD") - 20 + 74 :][:4])
    first, out = start + CARD, []
    for i in range(count):
        e = data[first + i * size :][:size]
        kind, _, length, _ = struct.unpack(">hhhh", e[:8])
        out.append(Variable(e[8:16].decode("ascii").strip(), kind == 1, length, e[16:56].decode("ascii", "replace").strip(), struct.unpack(">i", e[84:88])[0]))
    obs = first + -(-count * size // CARD) * CARD + CARD
    return out, obs


def _encode(rows: Iterable, variables: Sequence[Variable]) -> Iterable[bytes]:
    for r in rows:
        parts = []
        for v, x in zip(variables, r, strict=True):
            if v.numeric:
                parts.append(to_ibm(None if x is None else float(x))[: v.length])
                continue
            b = ("" if x is None else str(x)).rstrip(" ").encode("utf-8")
            if len(b) > v.length:
                raise ValueError(f"{v.name}: a text of {len(b)} bytes, {v.length} can be written")
            parts.append(b.ljust(v.length))
        yield b"".join(parts)


def write(df: DataFrame, path: str, name: str | None = None, char_length: int = 200) -> None:
    """One transport file; names longer than 8, types other than numbers and text, and texts of more than char_length
    bytes of UTF-8 (version 5 has at most 200) raise before anything is written. Blanks at the end are not kept."""
    variables, at = [], 0
    for f in df.schema:
        numeric = isinstance(f.dataType, T.NumericType)
        if len(f.name) > 8 or not (numeric or isinstance(f.dataType, (T.StringType, T.DateType))):
            raise ValueError(f"{f.name}: names have at most 8 characters, and only numbers, text and dates can be written")
        length = 8 if numeric else char_length
        variables.append(Variable(f.name, numeric, length, (f.metadata or {}).get("label", ""), at))
        at += length
    texts = [v.name for v in variables if not v.numeric]
    if texts:
        longest = df.agg(*[F.max(F.octet_length(F.rtrim(F.col(f"`{c}`").cast("string")))) for c in texts]).head()
        if over := [f"{c} has {n}" for c, n in zip(texts, longest, strict=True) if (n or 0) > char_length]:
            raise ValueError(f"texts of at most {char_length} bytes can be written: {', '.join(over)}")
    rows = df.rdd.mapPartitions(lambda it: [b"".join(_encode(it, variables))])
    total = 0
    with open(path, "wb") as f:
        f.write(header(name or Path(path).stem[:8], variables))
        for part in rows.toLocalIterator():  # one partition at a time
            f.write(part)
            total += len(part)
        f.write(b" " * (-total % CARD))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first member; blank text and missing numbers are null."""
    head = 8 * CARD
    with open(path.removeprefix("file://"), "rb") as f:
        data = f.read(head)
        count = int(data[data.find(b"NAMESTR HEADER RECORD") - 20 + 54 :][:4]) if b"NAMESTR" in data else 0
        data += f.read(-(-count * 140 // CARD) * CARD + 2 * CARD)
        variables, start = parse_header(data)
        f.seek(0, 2)
        end = f.tell()
    width = sum(v.length for v in variables)
    records = (end - start) // width if width else 0
    schema = T.StructType([T.StructField(v.name, T.DoubleType() if v.numeric else T.StringType(), True, {"label": v.label}) for v in variables])

    def decode(batches):
        import pandas as pd

        for b in batches:
            rows = []
            ids = b["id"].tolist()
            if ids:
                low = min(ids)
                with open(path.removeprefix("file://"), "rb") as f:
                    f.seek(start + low * width)
                    block = f.read((max(ids) - low + 1) * width)
                for k in ids:
                    r = block[(k - low) * width :][:width]
                    if start + k * width >= end - CARD and not r.strip(b" "):
                        continue  # blanks that fill the last card are no record
                    rows.append([from_ibm(r[v.position :][: v.length]) if v.numeric else (r[v.position :][: v.length].decode("utf-8", "replace").rstrip() or None) for v in variables])
            yield pd.DataFrame(rows, columns=[v.name for v in variables])

    return spark.range(records).mapInPandas(decode, schema)
