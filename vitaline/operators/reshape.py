"""Problem 2: attribute-value rows become one typed row per entity.

Values are typed by built-in expressions in the scan's stage; the reshape itself is an RDD combineByKey whose
combiner is a register with one slot per attribute. The mergers are associative and commutative (the last received
readable value wins, then the larger rec_id), so duplicates collapse on the map side: one record per entity and map
task is shuffled, however many rows a hot entity has.

Defined results: rows without entity or with an attribute outside the specification are no cells; empty and
unreadable values never replace a readable one; an entity without any readable value has no row; repeated rows
change nothing; an empty table gives an empty table with the full schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaline.functions.cols import bind, standard_null
from vitaline.operators.timestamps import MONTHS

#: fixed values: spellings of yes and no
YES, NO = ("Y", "YES", "1", "TRUE"), ("N", "NO", "0", "FALSE")
NUM = T.DecimalType(38, 10)
SQL_TYPES = {"txt": T.StringType(), "int": T.DecimalType(38, 0), "num": NUM, "date": T.DateType(), "yn": T.StringType()}
_MON = "(?i:(" + "|".join(MONTHS) + ")"
_DATES = [
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1|$2|$3"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1|$2|$3"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1|$2|$3"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3|$2|$1"),
    (rf"^(\d{{1,2}})[- ]?{_MON})[A-Za-z]*[- ]?(\d{{4}})$", "$3|$2|$1"),
    (rf"^{_MON}[A-Za-z]*)\.? (\d{{1,2}}),? (\d{{4}})$", "$3|$1|$2"),
]


def read_as(df: DataFrame, value: str, val_type: Column, out: str) -> DataFrame:
    """Append to df the canonical text of a value read as its type, null if empty or unreadable.

    int: digits; num: plain decimal without trailing zeros; date: yyyy-MM-dd; yn: Y or N; txt: trimmed.
    The steps are bound one after another, so each is evaluated once and the generated code stays small.
    """
    s, kind = F.col(f"{out}_s"), F.col(f"{out}_k")
    parts = F.when(F.lit(False), F.lit(""))
    for pattern, rewrite in _DATES:
        parts = parts.when(s.rlike(pattern), F.regexp_replace(s, pattern, rewrite))
    bound = bind(df, **{f"{out}_s": standard_null(F.regexp_replace(F.col(value).cast("string"), "[\u00a0\u202f]", " ")), f"{out}_k": val_type})
    bound = bind(
        bound,
        **{
            f"{out}_d": F.when(kind == "date", F.split(parts, r"\|")),
            f"{out}_i": F.when(
                (kind == "int") & s.rlike(r"^\+?(\d+|\d{1,3}(,\d{3})+|\d{1,3}( \d{3})+)(\.0*)?$"),
                F.regexp_replace(F.regexp_replace(s, r"\.0*$", ""), "[+, ]", ""),
            ).try_cast("decimal(38,0)"),
            f"{out}_n": F.when((kind == "num") & s.rlike(r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?$"), F.translate(s, ",", ".")).try_cast(NUM),
        },
    )
    part, name = F.col(f"{out}_d"), F.upper(F.get(F.col(f"{out}_d"), F.lit(1)))
    month = F.coalesce(F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(i + 1))])[name], name.try_cast("int"))
    zero = F.lit(0)
    day = F.try_make_timestamp(F.get(part, F.lit(0)).cast("int"), month, F.get(part, F.lit(2)).cast("int"), zero, zero, zero.cast("decimal(8,6)"), F.lit("UTC"))
    bound = bind(bound, **{f"{out}_t": (F.unix_seconds(day) / 86400).cast("int")})
    plain = F.regexp_replace(F.regexp_replace(F.col(f"{out}_n").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    text = (
        F.when(kind == "txt", standard_null(F.col(value)))
        .when(kind == "int", F.col(f"{out}_i").cast("string"))
        .when(kind == "num", plain)
        .when(kind == "date", F.date_from_unix_date(F.col(f"{out}_t")).cast("string"))
        .when(F.upper(s).isin(*YES), "Y")
        .when(F.upper(s).isin(*NO), "N")
    )
    return bind(bound, **{out: text}).select(*df.columns, out)


def _later(a: tuple | None, b: tuple | None) -> tuple | None:
    return b if a is None or (b is not None and b > a) else a


def to_wide(rows: DataFrame, attrs: list[tuple[str, str]], entity: str, attr: str, value: str, received: str = "received_at", rec_id: str = "rec_id", source: str | None = None) -> DataFrame:
    """One row per entity with a typed column for each (attribute, type) of attrs.

    The columns are entity, then the attributes by their names; other columns of rows are ignored, so clashing names
    do no harm. attrs is a specification held by the driver, so its length bounds the register. source names the input in
    Spark's interface and event log, which show no query plan for an RDD's stages.
    """
    names = [a for a, _ in attrs]
    if len(set(names)) != len(names):
        raise ValueError("an attribute is specified twice")
    slot = {a.upper(): i for i, a in enumerate(names)}
    lookup = F.create_map(*[x for a, i in slot.items() for x in (F.lit(a), F.lit(i))])
    types = F.create_map(*[x for a, t in attrs for x in (F.lit(a.upper()), F.lit(t))])
    code = F.upper(F.trim(F.col(attr).cast("string")))
    cells = rows.select(
        F.trim(F.col(entity).cast("string")).alias("__e"), code.alias("__a"), F.col(value).alias("__v"),
        F.coalesce(F.unix_micros(F.col(received).cast("timestamp")), F.lit(-(2**62))).alias("__t"),
        F.coalesce(F.col(rec_id).cast("long"), F.lit(-1)).alias("__r"),
    ).where((F.col("__e") != "") & lookup[F.col("__a")].isNotNull())
    cells = read_as(cells, "__v", types[F.col("__a")], "__c")
    cells = cells.where(F.col("__c").isNotNull()).select("__e", lookup[F.col("__a")].alias("__s"), "__t", "__r", "__c")
    width = len(names)

    def create(v: tuple) -> list:
        register = [None] * width
        register[v[0]] = v[1:]
        return register

    def add(register: list, v: tuple) -> list:
        register[v[0]] = _later(register[v[0]], v[1:])
        return register

    def merge(x: list, y: list) -> list:
        return [_later(p, q) for p, q in zip(x, y, strict=True)]

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = cells.rdd
    if source:
        base.setName(f"cells of {source}")
    pairs = base.map(lambda r: (r[0], (r[1], r[2], r[3], r[4])))
    wide = pairs.combineByKey(create, add, merge, parts).map(lambda kv: (kv[0], *[None if c is None else c[2] for c in kv[1]]))
    schema = T.StructType([T.StructField("__entity", T.StringType()), *[T.StructField(f"__{i}", T.StringType()) for i in range(width)]])
    text = rows.sparkSession.createDataFrame(wide, schema, verifySchema=False)
    return text.select(F.col("__entity").alias(entity), *[F.col(f"__{i}").cast(SQL_TYPES[t]).alias(a) for i, (a, t) in enumerate(attrs)])


def cell_text(c: Column, val_type: str) -> Column:
    """A typed cell as canonical text."""
    s = c.cast("string")
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "") if val_type == "num" else s


def to_long(wide: DataFrame, attrs: list[tuple[str, str]], entity: str) -> DataFrame:
    """(entity, attr, val) of the filled cells of a wide table; the inverse of to_wide."""
    cells = F.array(*[F.struct(F.lit(a).alias("attr"), cell_text(F.col(f"`{a}`"), t).alias("val")) for a, t in attrs])
    return wide.select(F.col(entity).alias("entity"), F.inline(cells)).where(F.col("val").isNotNull())


def spec_attrs(spec: DataFrame, tab: str, limit: int = 2000) -> list[tuple[str, str]]:
    """(attr, val_type) of one table from the specification; more than `limit` attributes raise."""
    rows = spec.where(F.col("tab") == tab).select(F.upper(F.trim("attr")), F.trim("val_type")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} attributes")
    return sorted((a, t) for a, t in rows if a)
