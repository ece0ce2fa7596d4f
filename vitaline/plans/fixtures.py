"""Input frames of the clinical queries, each with the SQL of the same frame for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitaline.functions import cols as C
from vitaline.operators import sdtm
from vitaline.session import table


def sql_map(expr: str, mapping: dict, otherwise: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else chr(39) + v + chr(39)}" for k, v in mapping.items()) + f" ELSE {otherwise} END"


def live_dm(spark: SparkSession, d: str) -> DataFrame:
    """The last received row of every subject that is not deleted."""
    w = Window.partitionBy("usubjid").orderBy(F.desc("received_at"), F.desc("rec_id"))
    return table(spark, d, "dm").where(F.col("deleted_at").isNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


LIVE_DM = "live_dm AS (SELECT * FROM dm WHERE deleted_at IS NULL QUALIFY row_number() OVER (PARTITION BY usubjid ORDER BY received_at DESC, rec_id DESC) = 1)"


def dispositions(spark: SparkSession, d: str) -> DataFrame:
    """Raw disposition records: the reason subjects left for, or completion, as typed in mixed case."""
    a = table(spark, d, "adsl").where(F.col("deleted_at").isNull())
    term = F.coalesce(F.initcap("dctreasn"), F.lit("completed study"))
    return a.select("studyid", "usubjid", F.when(term == "Lost To Follow-up", "LTFU").otherwise(term).alias("dsterm"), F.col("rfendtc").alias("dsstdtc"), "rec_id")


DISPOSITIONS = "raw_ds AS (SELECT studyid, usubjid, CASE WHEN dctreasn = 'LOST TO FOLLOW-UP' THEN 'LTFU' WHEN dctreasn IS NULL THEN 'completed study' ELSE dctreasn END AS dsterm, rfendtc AS dsstdtc, rec_id FROM adsl WHERE deleted_at IS NULL)"


ISO = "CASE WHEN regexp_matches(replace(trim({c}),'/','-'), '^\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?$') THEN try_cast(substr(replace(trim({c}),'/','-'),1,10) AS DATE) END"
#: Normal range per vital sign, in its standard unit; set here, not given by the data.
RANGES = {"SYSBP": (100.0, 140.0), "PULSE": (60.0, 100.0), "WEIGHT": (50.0, 90.0), "DIABP": (60.0, 90.0), "RESP": (12.0, 20.0), "TEMP": (36.0, 38.0), "OXYSAT": (95.0, 100.0), "HEIGHT": (150.0, 190.0)}


def lab_rows(spark: SparkSession, d: str) -> DataFrame:
    """Findings (subject, parameter, value, day, first dose, range) from vital signs; a test without a range keeps a null one."""
    ranges = spark.createDataFrame([(k, *v) for k, v in RANGES.items()], "paramcd string, lo double, hi double")
    starts = table(spark, d, "ex").groupBy(C.key_norm(F.col("usubjid")).alias("usubjid")).agg(F.min(C.iso_date(F.col("exstdtc"))).alias("trtsdt"))
    v = table(spark, d, "vs").select("usubjid", F.col("vstestcd").alias("paramcd"), F.col("vsstresn").alias("aval"), C.iso_date(F.col("vsdtc")).alias("adt"), "rec_id")
    return v.join(ranges, "paramcd", "left").join(starts, "usubjid", "left")


LAB = f"""starts AS (SELECT upper(trim(usubjid)) AS usubjid, min({ISO.format(c="exstdtc")}) AS trtsdt FROM ex GROUP BY 1),
ranges(vstestcd, lo, hi) AS (VALUES {", ".join(f"('{k}', {lo}::DOUBLE, {hi}::DOUBLE)" for k, (lo, hi) in RANGES.items())}),
lab AS (SELECT v.usubjid, v.vstestcd AS paramcd, vsstresn AS aval, {ISO.format(c="vsdtc")} AS adt, r.lo, r.hi, v.rec_id, s.trtsdt FROM vs v LEFT JOIN ranges r ON v.vstestcd = r.vstestcd LEFT JOIN starts s ON v.usubjid = s.usubjid)"""


def studies(spark: SparkSession, d: str) -> DataFrame:
    """Every study of dm: attributes, arms, criteria and visits (from vs) as a study's configuration holds them.

    The arrays are the distinct arms, countries and visits of a study, which are bounded by its design.
    """
    dm, vs = table(spark, d, "dm"), table(spark, d, "vs")
    arms = dm.where("trim(armcd) <> ''").select("studyid", F.struct(F.col("armcd").alias("code"), F.col("arm").alias("name")).alias("a")).distinct().groupBy("studyid").agg(F.sort_array(F.collect_list("a")).alias("arms"))
    criteria = dm.where("trim(country) <> ''").select("studyid", F.concat(F.lit("Resident of "), "country").alias("c")).distinct().groupBy("studyid").agg(F.sort_array(F.collect_list("c")).alias("criteria"))
    visit = F.struct(F.col("visitnum").alias("n"), F.concat(F.lit("Visit "), F.col("visitnum")).alias("name"), F.col("window"))
    visits = vs.where("visitnum is not null").select("studyid", "visitnum", (F.col("visitnum") % 3 * 7).alias("window")).distinct().groupBy("studyid").agg(F.sort_array(F.collect_list(visit)).alias("visits"))
    base = dm.where("trim(studyid) <> ''").groupBy("studyid").agg(F.concat(F.lit("Study "), F.first("studyid")).alias("title"), F.max(F.when(F.col("ageu") != "YEARS", F.col("ageu"))).alias("indication"), F.count_distinct("usubjid").cast("string").alias("enrolment"))
    return base.join(arms, "studyid", "left").join(criteria, "studyid", "left").join(visits, "studyid", "left")


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and finished nodes of a dependency graph over the whole trade tables: nations, suppliers, parts,
    customers and orders, with an edge where a row of one needs the other. Orders in part point back to their customer, urgent ones to nothing."""
    t = {n: table(spark, d, n) for n in ("nation", "supplier", "part", "customer", "orders", "lineitem")}

    def name(letter: str, c: str):
        return F.concat(F.lit(letter), F.col(c).cast("string"))

    ids = [("nation", "n", "n_nationkey", 0), ("supplier", "s", "s_suppkey", 1), ("customer", "c", "c_custkey", 1), ("part", "p", "p_partkey", 2), ("orders", "o", "o_orderkey", 3)]
    nodes = None
    for tab, letter, c, layer in ids:
        one = t[tab].select(name(letter, c).alias("id"), F.lit(layer).alias("layer"))
        nodes = one if nodes is None else nodes.unionByName(one)
    kind = F.when(F.col("k") % 3 == 0, "enables").when(F.col("k") % 3 == 1, "validates").otherwise("requires")
    lines = t["lineitem"]
    edges = (
        t["supplier"].select(name("n", "s_nationkey").alias("from_id"), name("s", "s_suppkey").alias("to_id"), F.lit("requires").alias("edge_type"))
        .unionByName(t["customer"].select(name("n", "c_nationkey").alias("from_id"), name("c", "c_custkey").alias("to_id"), F.lit("requires").alias("edge_type")))
        .unionByName(t["orders"].select(name("c", "o_custkey").alias("from_id"), name("o", "o_orderkey").alias("to_id"), F.lit("requires").alias("edge_type")))
        .unionByName(lines.select(name("s", "l_suppkey").alias("from_id"), name("p", "l_partkey").alias("to_id"), F.col("l_suppkey").alias("k")).distinct().select("from_id", "to_id", kind.alias("edge_type")))
        .unionByName(lines.select(name("p", "l_partkey").alias("from_id"), name("o", "l_orderkey").alias("to_id"), F.col("l_partkey").alias("k")).distinct().select("from_id", "to_id", kind.alias("edge_type")))
        .unionByName(t["orders"].where("o_orderstatus = 'P'").select(name("o", "o_orderkey").alias("from_id"), name("c", "o_custkey").alias("to_id"), F.lit("requires").alias("edge_type")))
        .unionByName(t["orders"].where("o_orderpriority = '1-URGENT'").select(name("x", "o_orderkey").alias("from_id"), name("o", "o_orderkey").alias("to_id"), F.lit("enables").alias("edge_type")))
    )
    done = (
        t["nation"].select(name("n", "n_nationkey").alias("id")).unionByName(t["customer"].select(name("c", "c_custkey").alias("id"))).unionByName(t["supplier"].where("s_acctbal >= 0").select(name("s", "s_suppkey").alias("id")))
        .unionByName(t["part"].where("p_size <= 25").select(name("p", "p_partkey").alias("id"))).unionByName(t["orders"].where("o_orderstatus = 'F'").select(name("o", "o_orderkey").alias("id")))
    )
    return nodes, edges, done


_KIND = "CASE k % 3 WHEN 0 THEN 'enables' WHEN 1 THEN 'validates' ELSE 'requires' END"
GRAPH = f"""nodes AS (SELECT 'n' || n_nationkey AS id, 0 AS layer FROM nation UNION ALL SELECT 's' || s_suppkey, 1 FROM supplier UNION ALL SELECT 'c' || c_custkey, 1 FROM customer UNION ALL SELECT 'p' || p_partkey, 2 FROM part UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders),
edges AS (SELECT 'n' || s_nationkey AS from_id, 's' || s_suppkey AS to_id, 'requires' AS edge_type FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'requires' FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'requires' FROM orders
  UNION ALL SELECT 's' || k, 'p' || l_partkey, {_KIND} FROM (SELECT DISTINCT l_suppkey AS k, l_partkey FROM lineitem) UNION ALL SELECT 'p' || k, 'o' || l_orderkey, {_KIND} FROM (SELECT DISTINCT l_partkey AS k, l_orderkey FROM lineitem)
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'requires' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'x' || o_orderkey, 'o' || o_orderkey, 'enables' FROM orders WHERE o_orderpriority = '1-URGENT'),
done AS (SELECT 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size <= 25 UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'F')"""

def subjects(spark: SparkSession, d: str) -> DataFrame:
    """The subject-level dataset from raw demographics, exposure and dispositions."""
    from vitaline.operators import adam

    ex = sdtm.map_ex(table(spark, d, "ex"))
    return adam.adsl(sdtm.map_dm(live_dm(spark, d)), ex, sdtm.map_ds(dispositions(spark, d)))
