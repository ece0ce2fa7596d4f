"""Queries of the clinical operators, each beside its SQL; SQL is written from the semantics, not from the DataFrame code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitaline import registry as R
from vitaline.functions import cols as C
from vitaline.operators import adam, checks, graph, rulepacks, sdtm, text, tfl
from vitaline.plans import fixtures as X
from vitaline.session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _r(c: str, n: int = 6):
    return F.round(F.col(c).cast("double"), n).alias(c)


# --- tabulation ---------------------------------------------------------------------------------------------------

_T = "nullif(trim({0}), '')"
MDM = f"""{X.LIVE_DM}, mdm AS (SELECT studyid, coalesce({_T.format('studyid')},'') || '-' || coalesce({_T.format('siteid')},'') || '-' || coalesce({_T.format('subjid')},'') AS usubjid, subjid, siteid, age,
  {X.sql_map("upper(trim(sex))", R.SEX, "'U'")} AS sex, {X.sql_map("upper(trim(race))", R.RACE, "nullif(upper(trim(race)),'')")} AS race,
  {X.sql_map("upper(trim(ethnic))", R.ETHNIC, "nullif(upper(trim(ethnic)),'')")} AS ethnic, {_T.format('arm')} AS arm,
  coalesce({_T.format('armcd')}, upper(substr(regexp_replace(trim(arm),'[^A-Za-z0-9]','','g'),1,8))) AS armcd, coalesce({_T.format('actarm')}, {_T.format('arm')}) AS actarm,
  coalesce({_T.format('actarmcd')}, {_T.format('armcd')}, upper(substr(regexp_replace(trim(arm),'[^A-Za-z0-9]','','g'),1,8))) AS actarmcd,
  coalesce({_T.format('country')}, 'USA') AS country, rec_id FROM live_dm)"""


@query(f"WITH {MDM} SELECT *, 'DM' AS domain, 'YEARS' AS ageu FROM mdm")
def sdtm_dm(spark: SparkSession, d: str) -> DataFrame:
    return sdtm.map_dm(X.live_dm(spark, d))


MAE = f"""mae AS (SELECT studyid, 'AE' AS domain, {_T.format('usubjid')} AS usubjid, {_T.format('aeterm')} AS aeterm, upper(substr(nullif(trim(aeterm),''),1,50)) AS aedecod,
  CASE WHEN trim(aeterm) <> '' THEN coalesce({_T.format('aebodsys')}, 'GENERAL DISORDERS') END AS aebodsys, {X.sql_map("upper(trim(aesev))", R.SEVERITY)} AS aesev,
  CASE WHEN upper(trim(aeser)) IN ('Y','YES','1','TRUE') THEN 'Y' ELSE 'N' END AS aeser, {X.sql_map("upper(trim(aerel))", R.RELATION, "'NOT RELATED'")} AS aerel, {_T.format('aeout')} AS aeout,
  replace({_T.format('aestdtc')},'/','-') AS aestdtc, replace({_T.format('aeendtc')},'/','-') AS aeendtc, rec_id FROM ae)"""


@query(f"WITH {MAE} SELECT *, row_number() OVER (PARTITION BY studyid, usubjid ORDER BY aestdtc NULLS FIRST, aeterm NULLS FIRST, rec_id) AS aeseq FROM mae")
def sdtm_ae(spark: SparkSession, d: str) -> DataFrame:
    return sdtm.map_ae(table(spark, d, "ae"))


MEX = f"""mex AS (SELECT studyid, 'EX' AS domain, nullif(upper(trim(usubjid)),'') AS usubjid, upper({_T.format('extrt')}) AS extrt, coalesce(exdose, 0) AS exdose, {_T.format('exdosu')} AS exdosu,
  {X.sql_map("lower(trim(exroute))", R.ROUTE, "nullif(upper(trim(exroute)),'')")} AS exroute, {X.sql_map("lower(trim(exdosfrq))", R.FREQUENCY, "nullif(upper(trim(exdosfrq)),'')")} AS exdosfrq,
  replace({_T.format('exstdtc')},'/','-') AS exstdtc, replace({_T.format('exendtc')},'/','-') AS exendtc, rec_id FROM ex)"""


@query(f"WITH {MEX} SELECT *, row_number() OVER (PARTITION BY studyid, usubjid ORDER BY exstdtc NULLS FIRST, rec_id) AS exseq FROM mex")
def sdtm_ex(spark: SparkSession, d: str) -> DataFrame:
    return sdtm.map_ex(table(spark, d, "ex"))


MDS = f"""{X.DISPOSITIONS}, mds AS (SELECT studyid, 'DS' AS domain, nullif(upper(trim(usubjid)),'') AS usubjid, lower(dsterm) AS dsterm,
  {X.sql_map("lower(trim(dsterm))", R.DISPOSITION, "upper(trim(dsterm))")} AS dsdecod, replace({_T.format('dsstdtc')},'/','-') AS dsstdtc, rec_id,
  row_number() OVER (PARTITION BY studyid, upper(trim(usubjid)) ORDER BY dsstdtc NULLS FIRST, rec_id) AS dsseq FROM raw_ds)"""


@query(f"WITH {MDS} SELECT * FROM mds")
def sdtm_ds(spark: SparkSession, d: str) -> DataFrame:
    return sdtm.map_ds(X.dispositions(spark, d)).withColumn("dsterm", F.lower("dsterm"))


@query("""SELECT 'VS' AS domain, studyid, usubjid, vstestcd, vstest, nullif(trim(vsorres),'') AS vsorres, coalesce(vsstresn, try_cast(trim(vsorres) AS DOUBLE)) AS vsstresn, visitnum, rec_id,
  row_number() OVER (PARTITION BY studyid, usubjid ORDER BY vsdtc NULLS FIRST, vstestcd, rec_id) AS vsseq FROM vs""")
def sdtm_vs(spark: SparkSession, d: str) -> DataFrame:
    spec = {"studyid": "studyid", "usubjid": "usubjid", "vstestcd": "vstestcd", "vstest": "vstest", "vsorres": "nullif(trim(vsorres), '')",
            "vsstresn": F.coalesce("vsstresn", C.safe_double(F.col("vsorres"))), "visitnum": "visitnum", "rec_id": "rec_id", "vsdtc": "vsdtc"}
    return sdtm.map_domain(table(spark, d, "vs"), "VS", spec, ["vsdtc", "vstestcd", "rec_id"]).drop("vsdtc")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, p_type AS lbtestcd, l_quantity AS lbstresn, CAST(10 + p_size % 10 AS DOUBLE) AS lo, CAST(30 + p_size % 15 AS DOUBLE) AS hi,
  CASE WHEN l_quantity IS NULL OR p_size IS NULL THEN NULL WHEN l_quantity < 10 + p_size % 10 THEN 'L' WHEN l_quantity > 30 + p_size % 15 THEN 'H' ELSE 'N' END AS lbnrind
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def sdtm_lb(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"), "left")
    j = j.withColumns({"lo": (10 + F.col("p_size") % 10).cast("double"), "hi": (30 + F.col("p_size") % 15).cast("double")})
    return j.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.col("p_type").alias("lbtestcd"), F.col("l_quantity").alias("lbstresn"), "lo", "hi", sdtm.range_indicator(F.col("l_quantity"), F.col("lo"), F.col("hi")).alias("lbnrind"))


@query("""WITH v AS (SELECT studyid, usubjid, visitnum, min(substr(vsdtc,1,10)) AS svstdtc, max(substr(vsdtc,1,10)) AS svendtc, count(*) AS n FROM vs WHERE visitnum IS NOT NULL GROUP BY 1,2,3)
  SELECT *, coalesce(svstdtc < lag(svstdtc) OVER (PARTITION BY studyid, usubjid ORDER BY visitnum), false) AS out_of_order FROM v""")
def sdtm_sv(spark: SparkSession, d: str) -> DataFrame:
    """Subject visits with the ascending check: a visit that starts before the one numbered before it."""
    day = F.substring("vsdtc", 1, 10)
    v = table(spark, d, "vs").where("visitnum is not null").groupBy("studyid", "usubjid", "visitnum").agg(F.min(day).alias("svstdtc"), F.max(day).alias("svendtc"), F.count(F.lit(1)).alias("n"))
    return v.withColumn("out_of_order", F.coalesce(F.col("svstdtc") < F.lag("svstdtc").over(Window.partitionBy("studyid", "usubjid").orderBy("visitnum")), F.lit(False)))


@query("""SELECT a.rec_id, a.usubjid, a.aeterm AS mhterm, t.term AS mhdecod, t.code AS mhcode FROM ae a LEFT JOIN (SELECT upper(trim(term)) AS k, min(term) AS term, min(code) AS code FROM canon_terms WHERE codelist = 'aeterm' GROUP BY 1) t
  ON upper(trim(a.aeterm)) = t.k""")
def sdtm_mh_coding(spark: SparkSession, d: str) -> DataFrame:
    dic = table(spark, d, "canon_terms").where("codelist = 'aeterm'").select(F.col("term").alias("key"), "term", "code")
    out = sdtm.code_terms(table(spark, d, "ae").select("rec_id", "usubjid", "aeterm"), dic, "aeterm", "key", ["term", "code"])
    return out.select("rec_id", "usubjid", F.col("aeterm").alias("mhterm"), F.col("term").alias("mhdecod"), F.col("code").alias("mhcode"))


@query("""SELECT 'CM' AS domain, studyid, nullif(upper(trim(usubjid)),'') AS usubjid, upper(trim(extrt)) AS cmtrt, exdose AS cmdose, rec_id,
  row_number() OVER (PARTITION BY studyid, nullif(upper(trim(usubjid)),'') ORDER BY rec_id) AS cmseq FROM ex WHERE exroute IS NOT NULL""")
def sdtm_cm(spark: SparkSession, d: str) -> DataFrame:
    spec = {"studyid": "studyid", "usubjid": "nullif(upper(trim(usubjid)), '')", "cmtrt": "upper(trim(extrt))", "cmdose": "exdose", "rec_id": "rec_id"}
    return sdtm.map_domain(table(spark, d, "ex").where("exroute is not null"), "CM", spec, ["rec_id"])


_SUPP = [("aespid", "Sponsor id"), ("aeout", "Outcome"), ("aeser", "Serious")]
SUPP = "supp AS (" + " UNION ALL ".join(f"SELECT studyid, 'AE' AS rdomain, usubjid, 'REC_ID' AS idvar, CAST(rec_id AS VARCHAR) AS idvarval, '{c.upper()}' AS qnam, '{n}' AS qlabel, trim({c}) AS qval FROM ae WHERE trim({c}) <> ''" for c, n in _SUPP) + ")"


@query(f"WITH {SUPP} SELECT * FROM supp")
def sdtm_supp(spark: SparkSession, d: str) -> DataFrame:
    return sdtm.supp_unpivot(table(spark, d, "ae"), "AE", "rec_id", _SUPP)


@query("SELECT rec_id, usubjid, nullif(trim(aespid),'') AS supp_aespid, nullif(trim(aeout),'') AS supp_aeout FROM ae")
def sdtm_supp_rejoin(spark: SparkSession, d: str) -> DataFrame:
    ae = table(spark, d, "ae")
    return sdtm.supp_rejoin(ae.select("rec_id", "usubjid"), sdtm.supp_unpivot(ae, "AE", "rec_id", _SUPP), "rec_id", ["aespid", "aeout"]).select("rec_id", "usubjid", "supp_aespid", "supp_aeout")


@query("""WITH p AS (SELECT DISTINCT a.studyid, a.usubjid, CAST(a.rec_id AS VARCHAR) AS l, CAST(d.rec_id AS VARCHAR) AS r FROM (SELECT * FROM ae WHERE upper(trim(aeser)) = 'Y') a
  JOIN (SELECT * FROM adsl WHERE disconfl = 'Y') d ON a.studyid = d.studyid AND a.usubjid = d.usubjid),
  n AS (SELECT *, row_number() OVER (PARTITION BY studyid, usubjid ORDER BY l, r) AS relid FROM p)
  SELECT studyid, usubjid, relid, 'AE' AS rdomain, 'AEREC' AS idvar, l AS idvarval FROM n UNION ALL SELECT studyid, usubjid, relid, 'DS', 'DSREC', r FROM n""")
def sdtm_relrec(spark: SparkSession, d: str) -> DataFrame:
    """Serious events related to the disposition record of subjects who left."""
    ae = table(spark, d, "ae").where("upper(trim(aeser)) = 'Y'").select("studyid", "usubjid", F.col("rec_id").alias("aerec"))
    ds = table(spark, d, "adsl").where("disconfl = 'Y'").select("studyid", "usubjid", F.col("rec_id").alias("dsrec"))
    return sdtm.relrec(ae, ds, "AE", "DS", "aerec", "dsrec", ["studyid", "usubjid"])


_ARMS = "arms AS (SELECT DISTINCT studyid, armcd, arm FROM dm WHERE trim(armcd) <> '' AND trim(studyid) <> '')"


@query("""WITH b AS (SELECT studyid, 'Study ' || studyid AS title, max(CASE WHEN ageu <> 'YEARS' THEN ageu END) AS indication, CAST(count(DISTINCT usubjid) AS VARCHAR) AS enrolment FROM dm WHERE trim(studyid) <> '' GROUP BY 1)
  SELECT studyid, 'TS' AS domain, 'TITLE' AS tsparmcd, 'Trial Title' AS tsparm, title AS tsval FROM b UNION ALL SELECT studyid, 'TS', 'INDIC', 'Indication', trim(indication) FROM b WHERE trim(indication) <> ''
  UNION ALL SELECT studyid, 'TS', 'PLANSUB', 'Planned Number of Subjects', enrolment FROM b""")
def trial_summary(spark: SparkSession, d: str) -> DataFrame:
    params = [("TITLE", "Trial Title", "title"), ("INDIC", "Indication", "indication"), ("PLANSUB", "Planned Number of Subjects", "enrolment")]
    return sdtm.trial_summary(X.studies(spark, d), params)


@query(f"WITH {_ARMS} SELECT studyid, 'TA' AS domain, arm, armcd, CAST(row_number() OVER (PARTITION BY studyid ORDER BY armcd, arm) AS INTEGER) AS taetord FROM arms")
def trial_arms(spark: SparkSession, d: str) -> DataFrame:
    return sdtm.trial_elements(X.studies(spark, d), "arms", "TA")


@query("""WITH c AS (SELECT DISTINCT studyid, 'Resident of ' || country AS ietest FROM dm WHERE trim(country) <> '' AND trim(studyid) <> '')
  SELECT studyid, 'TI' AS domain, 'I' || lpad(CAST(row_number() OVER (PARTITION BY studyid ORDER BY ietest) AS VARCHAR), 3, '0') AS ietestcd, ietest FROM c""")
def trial_criteria(spark: SparkSession, d: str) -> DataFrame:
    return sdtm.trial_elements(X.studies(spark, d), "criteria", "TI")


@query("""WITH v AS (SELECT DISTINCT vs.studyid, visitnum AS n, visitnum % 3 * 7 AS w FROM vs JOIN (SELECT DISTINCT studyid FROM dm) s ON vs.studyid = s.studyid WHERE visitnum IS NOT NULL AND trim(vs.studyid) <> ''),
  k AS (SELECT *, row_number() OVER (PARTITION BY studyid ORDER BY n) AS pos FROM v)
  SELECT studyid, 'TV' AS domain, CAST(pos AS INTEGER) AS visitnum, 'Visit ' || n AS visit, CAST(CASE WHEN pos > 1 THEN 1 + sum(CASE WHEN pos > 2 THEN w ELSE 0 END) OVER (PARTITION BY studyid ORDER BY pos) END AS INTEGER) AS visitdy FROM k""")
def trial_visits(spark: SparkSession, d: str) -> DataFrame:
    return sdtm.trial_elements(X.studies(spark, d), "visits", "TV")


# --- analysis -----------------------------------------------------------------------------------------------------

_I = X.ISO
ADSL = f"""{MDM}, {MEX}, {MDS},
x AS (SELECT usubjid, min({_I.format(c='exstdtc')}) AS trtsdt, max({_I.format(c='exendtc')}) AS trtedt, sum(exdose) AS cumdose, count(*) AS n_doses FROM mex WHERE exdose > 0 GROUP BY 1),
d1 AS (SELECT usubjid, max(CASE WHEN dsdecod = 'COMPLETED' THEN 'Y' END) AS compltfl, max(CASE WHEN dsdecod NOT IN ('COMPLETED','SCREEN FAILURE') THEN 'Y' END) AS disconfl FROM mds GROUP BY 1),
d2 AS (SELECT usubjid, dsdecod AS dctreasn FROM mds WHERE dsdecod NOT IN ('COMPLETED','SCREEN FAILURE') QUALIFY row_number() OVER (PARTITION BY usubjid ORDER BY dsstdtc DESC NULLS LAST, dsseq DESC) = 1),
asl AS (SELECT m.studyid, m.usubjid, m.subjid, m.siteid, m.age, m.sex, m.race, m.ethnic, m.arm, m.armcd, m.country, m.arm AS trt01p, {X.sql_map('upper(m.arm)', R.TREATMENT_N, '99')} AS trt01pn,
  m.actarm AS trt01a, {X.sql_map('upper(m.actarm)', R.TREATMENT_N, '99')} AS trt01an, CASE WHEN x.n_doses > 0 THEN 'Y' ELSE 'N' END AS saffl,
  CASE WHEN m.armcd IS NOT NULL AND m.armcd <> 'SCRNFAIL' THEN 'Y' ELSE 'N' END AS ittfl, coalesce(d1.compltfl,'N') AS compltfl, coalesce(d1.disconfl,'N') AS disconfl, d2.dctreasn,
  x.trtsdt, x.trtedt, date_diff('day', x.trtsdt, x.trtedt) + 1 AS trtdurd, x.cumdose,
  CASE WHEN m.age < 65 THEN '<65' WHEN m.age >= 65 THEN '>=65' END AS agegr1, CASE WHEN m.age < 65 THEN 1 WHEN m.age >= 65 THEN 2 END AS agegr1n,
  CASE WHEN upper(m.race) = 'WHITE' THEN 'WHITE' ELSE 'NON-WHITE' END AS racegr1, CASE WHEN upper(m.race) = 'WHITE' THEN 1 ELSE 2 END AS racegr1n
  FROM mdm m LEFT JOIN x ON m.usubjid = x.usubjid LEFT JOIN d1 ON m.usubjid = d1.usubjid LEFT JOIN d2 ON m.usubjid = d2.usubjid)"""


@query(f"WITH {ADSL} SELECT * FROM asl")
def adam_adsl(spark: SparkSession, d: str) -> DataFrame:
    return X.subjects(spark, d)


_IMP = """CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN {iso} WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}$') THEN {m} WHEN regexp_matches({c}, '^\\d{{4}}$') THEN {y} END"""
_AST = _IMP.format(c="aestdtc", iso=_I.format(c="aestdtc"), m="try_cast(aestdtc || '-01' AS DATE)", y="try_cast(aestdtc || '-01-01' AS DATE)")
_AEN = _IMP.format(c="aeendtc", iso=_I.format(c="aeendtc"), m="last_day(try_cast(aeendtc || '-01' AS DATE))", y="try_cast(aeendtc || '-12-31' AS DATE)")
ADAE = f"""{ADSL}, {MAE}, aa AS (SELECT e.*, s.trt01a, s.saffl, s.trtsdt, s.trtedt, {_AST} AS astdt, {_AEN} AS aendt FROM mae e LEFT JOIN asl s ON e.usubjid = s.usubjid),
ab AS (SELECT *, CASE WHEN coalesce(saffl,'N') <> 'Y' THEN 'N' WHEN astdt IS NULL OR trtsdt IS NULL THEN NULL WHEN astdt >= trtsdt AND (trtedt IS NULL OR astdt <= trtedt + 30) THEN 'Y' ELSE 'N' END AS trtemfl FROM aa),
ac AS (SELECT studyid, usubjid, rec_id, aeterm, aedecod, aebodsys, aesev, aeser, aerel, trt01a, saffl, astdt,
  CASE WHEN regexp_matches(aestdtc, '^\\d{{4}}-\\d{{2}}$') THEN 'D' WHEN regexp_matches(aestdtc, '^\\d{{4}}$') THEN 'M' END AS astdtf, aendt,
  date_diff('day', trtsdt, astdt) + 1 AS astdy, date_diff('day', trtsdt, aendt) + 1 AS aendy, date_diff('day', astdt, aendt) + 1 AS adurn, trtemfl,
  CASE WHEN trtemfl = 'Y' AND row_number() OVER (PARTITION BY usubjid, aedecod, coalesce(trtemfl,'N') ORDER BY astdt NULLS LAST, rec_id) = 1 THEN 'Y' ELSE 'N' END AS aoccfl,
  CASE aesev WHEN 'MILD' THEN 1 WHEN 'MODERATE' THEN 2 WHEN 'SEVERE' THEN 3 END AS aesevn FROM ab)"""


def _adae(spark: SparkSession, d: str) -> DataFrame:
    return adam.adae(sdtm.map_ae(table(spark, d, "ae")), X.subjects(spark, d))


@query(f"WITH {ADAE} SELECT * FROM ac")
def adam_adae(spark: SparkSession, d: str) -> DataFrame:
    return _adae(spark, d)


WINDOWS = [(-400, 0, "Baseline", 0), (1, 60, "Early", 1), (61, 200, "Middle", 2), (180, 2000, "Late", 3)]
BDS = f"""{X.LAB}, b1 AS (SELECT *, aval IS NOT NULL AND adt <= trtsdt AS bef FROM lab),
b2 AS (SELECT *, CASE WHEN bef AND row_number() OVER (PARTITION BY usubjid, paramcd ORDER BY CASE WHEN bef THEN 0 ELSE 1 END, adt DESC NULLS LAST, rec_id DESC) = 1 THEN 'Y' END AS ablfl,
  CASE WHEN aval IS NULL THEN NULL WHEN aval < lo THEN 'L' WHEN aval > hi THEN 'H' ELSE 'N' END AS anrind, date_diff('day', trtsdt, adt) + 1 AS ady FROM b1),
b3 AS (SELECT *, max(CASE WHEN ablfl = 'Y' THEN aval END) OVER (PARTITION BY usubjid, paramcd) AS base, max(CASE WHEN ablfl = 'Y' THEN anrind END) OVER (PARTITION BY usubjid, paramcd) AS bnrind FROM b2),
b4 AS (SELECT *, CASE WHEN adt > trtsdt THEN aval - base END AS chg FROM b3),
bds AS (SELECT usubjid, paramcd, rec_id, aval, adt, ady, ablfl, base, chg, CASE WHEN base <> 0 THEN chg / base * 100 END AS pchg, anrind, bnrind, bnrind || anrind AS shift1,
  CASE WHEN ady BETWEEN 180 AND 2000 THEN 'Late' WHEN ady BETWEEN 61 AND 200 THEN 'Middle' WHEN ady BETWEEN 1 AND 60 THEN 'Early' WHEN ady BETWEEN -400 AND 0 THEN 'Baseline' END AS avisit,
  CASE WHEN ady BETWEEN 180 AND 2000 THEN 3 WHEN ady BETWEEN 61 AND 200 THEN 2 WHEN ady BETWEEN 1 AND 60 THEN 1 WHEN ady BETWEEN -400 AND 0 THEN 0 END AS avisitn FROM b4)"""
_BDS_COLS = ["usubjid", "paramcd", "rec_id", "aval", "adt", "ady", "ablfl", "base", "anrind", "bnrind", "shift1", "avisit", "avisitn"]


def _bds(spark: SparkSession, d: str) -> DataFrame:
    return adam.bds(X.lab_rows(spark, d), WINDOWS)


@query(f"WITH {BDS} SELECT {', '.join(_BDS_COLS)}, round(chg, 6) AS chg, round(pchg, 6) AS pchg FROM bds")
def adam_adlb(spark: SparkSession, d: str) -> DataFrame:
    return _bds(spark, d).select(*_BDS_COLS, _r("chg"), _r("pchg"))


@query(f"WITH {BDS} SELECT paramcd, avisit, bnrind, count(CASE WHEN anrind = 'L' THEN 1 END) AS \"L\", count(CASE WHEN anrind = 'N' THEN 1 END) AS \"N\", count(CASE WHEN anrind = 'H' THEN 1 END) AS \"H\" FROM bds WHERE bnrind IS NOT NULL GROUP BY 1, 2, 3")
def adam_shift(spark: SparkSession, d: str) -> DataFrame:
    return tfl.shift_table(_bds(spark, d), ["paramcd", "avisit"])


@query(f"WITH {BDS} SELECT usubjid, paramcd, rec_id, last_value(aval IGNORE NULLS) OVER (PARTITION BY usubjid, paramcd ORDER BY adt NULLS FIRST, rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS aval_locf FROM bds")
def adam_locf(spark: SparkSession, d: str) -> DataFrame:
    return adam.locf(_bds(spark, d), ["usubjid", "paramcd"], ["adt", "rec_id"]).select("usubjid", "paramcd", "rec_id", "aval_locf")


@query(f"WITH {BDS}, g AS (SELECT usubjid, paramcd, avg(aval) AS a, max(aval) AS w FROM bds WHERE aval IS NOT NULL GROUP BY 1, 2) SELECT usubjid, paramcd, 'AVERAGE' AS dtype, round(a, 6) AS aval FROM g UNION ALL SELECT usubjid, paramcd, 'WORST', round(w, 6) FROM g")
def adam_derived_records(spark: SparkSession, d: str) -> DataFrame:
    return adam.derived_records(_bds(spark, d), ["usubjid", "paramcd"]).select("usubjid", "paramcd", "dtype", _r("aval"))


TTE_PARAMS = [("TTDISC", "Time to Discontinuation (Days)"), ("TTFSAE", "Time to First SAE (Days)")]
CUTOFF = "2025-12-31"
TTE = f"""{ADAE}, ev AS (SELECT usubjid, 'TTFSAE' AS paramcd, astdt AS edt FROM ac WHERE aeser = 'Y' UNION ALL SELECT usubjid, 'TTDISC', {_I.format(c='dsstdtc')} FROM mds WHERE dsdecod NOT IN ('COMPLETED','SCREEN FAILURE')),
gr AS (SELECT s.usubjid, s.trt01a, s.trtsdt, s.trtedt, p.paramcd, p.param FROM asl s CROSS JOIN (VALUES ('TTDISC','Time to Discontinuation (Days)'),('TTFSAE','Time to First SAE (Days)')) p(paramcd, param) WHERE s.saffl = 'Y' AND s.trtsdt IS NOT NULL),
tte AS (SELECT g.usubjid, g.trt01a, g.paramcd, g.param, CASE WHEN min(e.edt) IS NULL THEN 1 ELSE 0 END AS cnsr, coalesce(min(e.edt), g.trtedt, DATE '{CUTOFF}') AS adt,
  date_diff('day', g.trtsdt, coalesce(min(e.edt), g.trtedt, DATE '{CUTOFF}')) + 1 AS aval FROM gr g LEFT JOIN ev e ON g.usubjid = e.usubjid AND g.paramcd = e.paramcd AND e.edt >= g.trtsdt GROUP BY g.usubjid, g.trt01a, g.paramcd, g.param, g.trtsdt, g.trtedt)"""


def _tte(spark: SparkSession, d: str) -> DataFrame:
    s = X.subjects(spark, d)
    sae = _adae(spark, d).where("aeser = 'Y'").select("usubjid", F.lit("TTFSAE").alias("paramcd"), F.col("astdt").alias("edt"))
    ds = sdtm.map_ds(X.dispositions(spark, d)).where(~F.col("dsdecod").isin("COMPLETED", "SCREEN FAILURE"))
    return adam.adtte(s, sae.unionByName(ds.select("usubjid", F.lit("TTDISC").alias("paramcd"), C.iso_date(F.col("dsstdtc")).alias("edt"))), TTE_PARAMS, CUTOFF)


@query(f"WITH {TTE} SELECT * FROM tte")
def adam_adtte(spark: SparkSession, d: str) -> DataFrame:
    return _tte(spark, d)


@query("""WITH g AS (SELECT user_id, date_trunc('day', ts) AS day, ts, value, epoch_us(ts) / 3600000000.0 AS h FROM events WHERE value IS NOT NULL),
  a AS (SELECT *, (h - lag(h) OVER w) * (value + lag(value) OVER w) / 2 AS area FROM g WINDOW w AS (PARTITION BY user_id, day ORDER BY h))
  SELECT user_id, CAST(day AS DATE) AS day, max(value) AS cmax, round(arg_min(h, struct_pack(c := -value, t := h)), 6) AS tmax, round(sum(area), 4) AS auc, round(100 / nullif(sum(area), 0), 6) AS cl FROM a GROUP BY 1, 2""")
def adam_nca(spark: SparkSession, d: str) -> DataFrame:
    """Daily concentration profiles of the event stream."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0).alias("h"), "value")
    out = adam.nca(e, ["user_id", "day"], "h", "value", F.lit(100.0))
    return out.select("user_id", "day", "cmax", _r("tmax"), _r("auc", 4), _r("cl"))


@query("""WITH i AS (SELECT usubjid, visitnum, CASE WHEN vsstresn IS NULL THEN NULL ELSE vsseq % 5 END AS item FROM vs)
  SELECT usubjid, visitnum, count(item) AS answered, round(CASE WHEN count(item) * 2 >= 4 THEN sum(item) * 4 / count(item) END, 6) AS score FROM i GROUP BY 1, 2""")
def adam_scale_score(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "vs").select("usubjid", "visitnum", F.when(F.col("vsstresn").isNotNull(), F.col("vsseq") % 5).cast("double").alias("item"))
    return adam.scale_score(items, ["usubjid", "visitnum"], "item", 4).select("usubjid", "visitnum", "answered", _r("score"))


@query(f"WITH {BDS} SELECT usubjid, paramcd, rec_id, CASE WHEN pchg <= -5 THEN 'Y' WHEN pchg > -5 THEN 'N' END AS avalc, CASE WHEN pchg <= -5 THEN 1.0 WHEN pchg > -5 THEN 0.0 END AS aval FROM bds WHERE chg IS NOT NULL")
def adam_responder(spark: SparkSession, d: str) -> DataFrame:
    """Responders: a fall of at least 5 percent from baseline."""
    changed = _bds(spark, d).where("chg is not null").select("usubjid", "paramcd", "rec_id", "pchg")
    return adam.responder(changed, F.col("pchg") <= -5).drop("pchg")


_TRACE = {"adsl": "dm", "adae": "ae", "adtte": "adsl"}


@query("WITH c AS (SELECT upper(table_name) AS t, upper(column_name) AS v FROM duckdb_columns()), p(a, b) AS (VALUES ('ADSL','DM'),('ADAE','AE'),('ADTTE','ADSL')) SELECT p.a AS dataset, c.v AS variable, p.b AS source_dataset, c.v AS source_variable, CASE WHEN s.v IS NULL THEN 'Partial' ELSE 'Yes' END AS traceable FROM p JOIN c ON c.t = p.a LEFT JOIN c s ON s.t = p.b AND s.v = c.v")
def adam_trace(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the analysis tables traced to the column of its name in the table it comes from."""
    text = "dataset string, variable string"
    cols = [(t, c) for t in _TRACE.values() for c in table(spark, d, t).columns]
    v = [(a.upper(), c.upper(), s.upper(), c.upper()) for a, s in _TRACE.items() for c in table(spark, d, a).columns]
    return adam.trace(spark.createDataFrame(v, f"{text}, source_dataset string, source_variable string"), spark.createDataFrame(cols, text))


# --- tables and statistics ----------------------------------------------------------------------------------------

_CATS = [("AGEGR1", "agegr1", ["<65", ">=65"]), ("SEX", "sex", ["M", "F"]), ("RACE", "race", ["WHITE", "BLACK OR AFRICAN AMERICAN", "ASIAN"])]
_POP = "pop AS (SELECT * FROM asl WHERE saffl = 'Y')"
DEMO = (
    f"WITH {ADSL}, {_POP}, st AS (SELECT arm, count(age) AS n, avg(age) AS mean, CASE WHEN count(age) = 1 THEN 0 ELSE stddev_samp(age) END AS sd, median(age) AS median, min(age) AS min, max(age) AS max FROM pop GROUP BY arm) "
    + " UNION ALL ".join(f"SELECT 'AGE' AS block, '{s}' AS item, arm, round(CAST({s} AS DOUBLE), 6) AS value FROM st" for s in ("n", "mean", "sd", "median", "min", "max"))
    + "".join(f" UNION ALL SELECT '{b}', '{v} n', arm, CAST(count(CASE WHEN upper({c}) = '{v}' THEN 1 END) AS DOUBLE) FROM pop GROUP BY arm UNION ALL SELECT '{b}', '{v} pct', arm, round(count(CASE WHEN upper({c}) = '{v}' THEN 1 END) * 100.0 / count(*), 6) FROM pop GROUP BY arm" for b, c, vs in _CATS for v in vs)
)


@query(DEMO)
def demographics(spark: SparkSession, d: str) -> DataFrame:
    pop = X.subjects(spark, d).where("saffl = 'Y'")
    return tfl.demographics(pop, "arm", "age", _CATS).select("block", "item", "arm", _r("value"))


@query(f"WITH {ADSL} SELECT coalesce(arm, 'none') AS arm, count(*) AS n FROM asl GROUP BY 1 UNION ALL SELECT 'Total', count(*) FROM asl")
def tfl_arm_sizes(spark: SparkSession, d: str) -> DataFrame:
    return tfl.arm_sizes(X.subjects(spark, d).withColumn("arm", F.coalesce("arm", F.lit("none"))), "arm")


FREQ = f"""WITH {ADAE}, {_POP}, e AS (SELECT c.*, upper(trim(regexp_replace(c.aedecod,'[^A-Z ]','','g'))) AS pt, p.arm FROM ac c JOIN pop p ON c.usubjid = p.usubjid WHERE c.trtemfl = 'Y'),
lv AS (SELECT DISTINCT aebodsys, pt FROM e), sz AS (SELECT arm, count(*) AS big_n FROM pop GROUP BY 1 UNION ALL SELECT 'Total', count(*) FROM pop),
f AS (SELECT aebodsys, pt, arm, count(DISTINCT usubjid) AS s, count(*) AS r FROM e GROUP BY 1, 2, 3 UNION ALL SELECT aebodsys, pt, 'Total', count(DISTINCT usubjid), count(*) FROM e GROUP BY 1, 2)
SELECT lv.aebodsys, lv.pt, sz.arm, coalesce(f.s, 0) AS n_subjects, coalesce(f.r, 0) AS n_records, round(coalesce(f.s, 0) * 100.0 / sz.big_n, 6) AS pct FROM lv CROSS JOIN sz LEFT JOIN f ON lv.aebodsys IS NOT DISTINCT FROM f.aebodsys AND lv.pt IS NOT DISTINCT FROM f.pt AND sz.arm IS NOT DISTINCT FROM f.arm"""


@query(FREQ)
def tfl_ae_frequency(spark: SparkSession, d: str) -> DataFrame:
    pop = X.subjects(spark, d).where("saffl = 'Y'").select("usubjid", "arm")
    e = _adae(spark, d).where("trtemfl = 'Y'").join(pop, "usubjid").withColumn("pt", F.upper(F.trim(F.regexp_replace("aedecod", "[^A-Z ]", ""))))
    return tfl.frequency(e, pop, ["aebodsys", "pt"]).select("aebodsys", "pt", "arm", "n_subjects", "n_records", _r("pct"))


@query(f"""WITH {ADSL} SELECT trt01a, count(*) AS n, round(avg(cumdose), 6) AS mean_dose, round(median(trtdurd), 6) AS median_days, round(sum(cumdose) / nullif(sum(trtdurd), 0), 6) AS intensity FROM asl WHERE saffl = 'Y' GROUP BY 1""")
def tfl_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative dose and intensity (dose per treated day) by treatment."""
    s = X.subjects(spark, d).where("saffl = 'Y'")
    return s.groupBy("trt01a").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cumdose"), 6).alias("mean_dose"), F.round(F.median("trtdurd"), 6).alias("median_days"), F.round(F.try_divide(F.sum("cumdose"), F.sum("trtdurd")), 6).alias("intensity"))


KM = f"""WITH {TTE}, g AS (SELECT paramcd, trt01a, aval, count(CASE WHEN cnsr = 0 THEN 1 END) AS d, count(*) AS k FROM tte GROUP BY 1, 2, 3),
r AS (SELECT *, sum(k) OVER (PARTITION BY paramcd, trt01a ORDER BY aval DESC) AS n FROM g), q AS (SELECT * FROM r WHERE d > 0)
SELECT paramcd, trt01a, aval, n, d, round(CASE WHEN max(CASE WHEN d = n THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END, 6) AS surv FROM q WINDOW w AS (PARTITION BY paramcd, trt01a ORDER BY aval ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query(KM)
def tfl_kaplan_meier(spark: SparkSession, d: str) -> DataFrame:
    return tfl.kaplan_meier(_tte(spark, d), ["paramcd", "trt01a"]).select("paramcd", "trt01a", "aval", "n", "d", _r("surv"))


@query(f"""WITH {TTE}, g AS (SELECT paramcd, aval, count(CASE WHEN cnsr = 0 THEN 1 END) AS d, count(*) AS k, count(CASE WHEN cnsr = 0 AND trt01a = 'Placebo' THEN 1 END) AS d1, count(CASE WHEN trt01a = 'Placebo' THEN 1 END) AS k1 FROM tte GROUP BY 1, 2),
r AS (SELECT *, CAST(sum(k) OVER w AS DOUBLE) AS n, CAST(sum(k1) OVER w AS DOUBLE) AS n1 FROM g WINDOW w AS (PARTITION BY paramcd ORDER BY aval DESC)),
t AS (SELECT paramcd, sum(d1) AS observed, sum(d) AS events, sum(d * n1 / n) AS expected, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS variance FROM r WHERE d > 0 GROUP BY 1)
SELECT paramcd, CAST(observed AS BIGINT) AS observed, CAST(events AS BIGINT) AS events, round(expected, 6) AS expected, round(variance, 6) AS variance, round((observed - expected) * (observed - expected) / variance, 6) AS chisq,
  round((observed / expected) / ((events - observed) / (events - expected)), 6) AS hr FROM t""")
def tfl_log_rank(spark: SparkSession, d: str) -> DataFrame:
    return tfl.log_rank(_tte(spark, d), ["paramcd"], "trt01a", "Placebo").select("paramcd", "observed", "events", *[_r(c) for c in ("expected", "variance", "chisq", "hr")])


@query(f"""WITH {ADSL}, g AS (SELECT country, count(CASE WHEN trt01a = 'Placebo' AND disconfl = 'Y' THEN 1 END)::DOUBLE AS a, count(CASE WHEN trt01a = 'Placebo' AND disconfl <> 'Y' THEN 1 END)::DOUBLE AS b,
  count(CASE WHEN trt01a <> 'Placebo' AND disconfl = 'Y' THEN 1 END)::DOUBLE AS c, count(CASE WHEN trt01a <> 'Placebo' AND disconfl <> 'Y' THEN 1 END)::DOUBLE AS d FROM asl GROUP BY 1),
h AS (SELECT *, a + b + c + d AS n FROM g WHERE a + b + c + d > 1)
SELECT count(*) AS strata, round(sum(a - (a + b) * (a + c) / n) ^ 2 / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))), 6) AS chisq, round(sum(a * d / n) / sum(b * c / n), 6) AS odds_ratio FROM h""")
def tfl_cmh(spark: SparkSession, d: str) -> DataFrame:
    out = tfl.cmh(X.subjects(spark, d), "country", F.col("trt01a") == "Placebo", F.col("disconfl") == "Y")
    return out.select("strata", _r("chisq"), _r("odds_ratio"))


@query(f"""WITH {BDS}, {MDM}, r AS (SELECT b.paramcd, b.chg AS y, b.base AS x, CASE WHEN m.actarm = 'Placebo' THEN 0 ELSE 1 END AS t FROM bds b JOIN mdm m ON b.usubjid = m.usubjid WHERE b.chg IS NOT NULL AND b.base IS NOT NULL),
g AS (SELECT paramcd, t, count(*) AS n, avg(y) AS my, avg(x) AS mx, covar_pop(y, x) AS cxy, var_pop(x) AS vx FROM r GROUP BY 1, 2),
w AS (SELECT paramcd, sum(n * cxy) / nullif(sum(n * vx), 0) AS slope, max(CASE WHEN t = 0 THEN n END) AS n0, max(CASE WHEN t = 1 THEN n END) AS n1, max(CASE WHEN t = 0 THEN my END) AS my0, max(CASE WHEN t = 1 THEN my END) AS my1, max(CASE WHEN t = 0 THEN mx END) AS mx0, max(CASE WHEN t = 1 THEN mx END) AS mx1 FROM g GROUP BY 1)
SELECT paramcd, n0 AS n_control, n1 AS n_treated, round(slope, 6) AS slope, round((my1 - my0) - slope * (mx1 - mx0), 6) AS effect FROM w""")
def tfl_ancova(spark: SparkSession, d: str) -> DataFrame:
    dm = sdtm.map_dm(X.live_dm(spark, d)).select("usubjid", "actarm")
    j = _bds(spark, d).join(dm, "usubjid")
    return tfl.ancova(j, ["paramcd"], "chg", "base", F.coalesce(F.col("actarm"), F.lit("")) != "Placebo").select("paramcd", "n_control", "n_treated", _r("slope"), _r("effect"))


@query("SELECT siteid, usubjid, age, rec_id, row_number() OVER (PARTITION BY siteid ORDER BY usubjid, rec_id) AS row, CAST(ceil(row_number() OVER (PARTITION BY siteid ORDER BY usubjid, rec_id) / 35.0) AS INTEGER) AS page FROM dm")
def tfl_listing(spark: SparkSession, d: str) -> DataFrame:
    return tfl.paginate(table(spark, d, "dm").select("siteid", "usubjid", "age", "rec_id"), ["usubjid", "rec_id"], ["siteid"], 35)


@query(f"WITH {BDS}, g AS (SELECT paramcd, usubjid, min(pchg) AS best FROM bds WHERE pchg IS NOT NULL GROUP BY 1, 2) SELECT paramcd, usubjid, round(best, 6) AS best, row_number() OVER (PARTITION BY paramcd ORDER BY round(best, 6) DESC, usubjid) AS rank FROM g")
def tfl_waterfall(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of each parameter ranked by their best percent change."""
    g = _bds(spark, d).where("pchg is not null").groupBy("paramcd", "usubjid").agg(F.round(F.min("pchg"), 6).alias("best"))
    return tfl.waterfall(g, ["paramcd"], "best", "usubjid")


@query(f"""WITH {ADSL}, u AS (SELECT 'sex' AS factor, sex AS level, disconfl, trt01a FROM asl UNION ALL SELECT 'agegr1', agegr1, disconfl, trt01a FROM asl UNION ALL SELECT 'racegr1', racegr1, disconfl, trt01a FROM asl)
SELECT factor, level, count(*) AS n, count(CASE WHEN trt01a = 'Placebo' THEN 1 END) AS n_placebo, count(CASE WHEN disconfl = 'Y' THEN 1 END) AS events, round(count(CASE WHEN disconfl = 'Y' THEN 1 END) * 100.0 / count(*), 6) AS pct FROM u WHERE level IS NOT NULL GROUP BY 1, 2""")
def tfl_forest(spark: SparkSession, d: str) -> DataFrame:
    """Event rates by subgroup."""
    s = X.subjects(spark, d)
    cells = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("level")) for c in ("sex", "agegr1", "racegr1")])
    u = s.select("trt01a", "disconfl", F.inline(cells)).where("level is not null")
    e = F.count_if(F.col("disconfl") == "Y")
    return u.groupBy("factor", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("trt01a") == "Placebo").alias("n_placebo"), e.alias("events"), F.round(e * 100.0 / F.count(F.lit(1)), 6).alias("pct"))


@query("""WITH p AS (SELECT siteid, count(*)::DOUBLE AS n FROM dm GROUP BY 1), q AS (SELECT siteid, count(*)::DOUBLE AS n FROM adsl GROUP BY 1)
SELECT coalesce(p.siteid, q.siteid) AS siteid, p.n AS prod, q.n AS qc, CASE WHEN q.siteid IS NULL THEN 'prod only' WHEN p.siteid IS NULL THEN 'qc only' WHEN abs(p.n - q.n) <= 1 THEN 'match' ELSE 'differ' END AS status FROM p FULL OUTER JOIN q ON p.siteid = q.siteid""")
def tfl_compare(spark: SparkSession, d: str) -> DataFrame:
    p, q = (table(spark, d, t).groupBy("siteid").agg(F.count(F.lit(1)).cast("double").alias("n")) for t in ("dm", "adsl"))
    return tfl.compare(p, q, ["siteid"], "n", 1.0)


@query("""WITH l AS (SELECT DISTINCT upper(aeterm) AS l FROM adae), r AS (SELECT DISTINCT upper(term) AS r FROM canon_terms),
a AS (SELECT l FROM l WHERE l IS NOT NULL AND l NOT IN (SELECT r FROM r WHERE r IS NOT NULL)), j AS (SELECT l, r, levenshtein(l, r) AS e FROM a JOIN r ON abs(length(l) - length(r)) <= 2)
SELECT l, r, e AS edits FROM j WHERE e <= 2 QUALIFY row_number() OVER (PARTITION BY l ORDER BY e, r) = 1""")
def tfl_fuzzy_labels(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "adae").select(F.upper("aeterm").alias("label"))
    return tfl.fuzzy_labels(left, table(spark, d, "canon_terms").select(F.upper("term").alias("label")), "label", 2)


# --- checks -------------------------------------------------------------------------------------------------------


def _ct(t: str, c: str, codelist: str) -> str:
    vals = ", ".join(f"'{v.upper()}'" for v in R.CODELISTS[codelist])
    return f"SELECT 'CT-001' AS rule_id, 'ERROR' AS severity, 'terminology' AS category, '{t}' AS dataset, '{c}' AS variable, CAST(rec_id AS VARCHAR) AS record, {c} AS value, 'value is not in its codelist' AS message FROM {t} WHERE trim({c}) <> '' AND upper(trim({c})) NOT IN ({vals})"


_CT = {"dm": [("sex", "sex"), ("race", "race"), ("country", "country")], "ae": [("aesev", "aesev"), ("aerel", "aerel"), ("aeout", "aeout")], "adsl": [("saffl", "yn")]}


def _issues(spark: SparkSession, d: str) -> DataFrame:
    return checks.union([
        checks.rows(table(spark, d, t), t, [checks.Rule("CT-001", "ERROR", "terminology", c, checks.not_in_codelist(F.col(c), lst), "value is not in its codelist") for c, lst in cs]) for t, cs in _CT.items()
    ])


CT = " UNION ALL ".join(_ct(t, c, lst) for t, cs in _CT.items() for c, lst in cs)


@query(CT)
def check_codelists(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d)


_OKR = "coalesce(try_cast(nullif(substr(s,6,2),'') AS INT),1) BETWEEN 1 AND 12 AND coalesce(try_cast(nullif(substr(s,9,2),'') AS INT),1) BETWEEN 1 AND 31 AND coalesce(try_cast(nullif(substr(s,12,2),'') AS INT),0) <= 23 AND coalesce(try_cast(nullif(substr(s,15,2),'') AS INT),0) <= 59 AND coalesce(try_cast(nullif(substr(s,18,2),'') AS INT),0) <= 59"


@query(f"""WITH v AS (SELECT rec_id, nullif(trim(aestdtc),'') AS s FROM ae) SELECT coalesce(kind,'not ISO') AS kind, count(*) AS n FROM (SELECT CASE
  WHEN regexp_matches(s,'^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?(Z|[+-]\\d{{2}}:\\d{{2}})?$') THEN CASE WHEN {_OKR} THEN 'datetime' END
  WHEN regexp_matches(s,'^P(\\d+Y)?(\\d+M)?(\\d+D)?(T(\\d+H)?(\\d+M)?(\\d+S)?)?$') THEN 'duration'
  WHEN regexp_matches(s,'^\\d{{4}}(-\\d{{2}}(-\\d{{2}})?)?$') THEN CASE WHEN {_OKR} THEN 'date' END
  WHEN regexp_matches(s,'^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}(:\\d{{2}})?$') THEN CASE WHEN {_OKR} THEN 'partial datetime' END END AS kind FROM v WHERE s IS NOT NULL) GROUP BY 1""")
def check_iso_dates(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "ae").where(C.clean(F.col("aestdtc")).isNotNull())
    return a.groupBy(F.coalesce(checks.iso_kind(F.col("aestdtc")), F.lit("not ISO")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_MISS = ["aeterm", "aesev", "aestdtc", "aeendtc", "aespid"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) AS n, count(CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 1 END) AS n_missing, round(count(CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 1 END) * 100.0 / count(*), 6) AS pct FROM ae" for c in _MISS))
def check_missing(spark: SparkSession, d: str) -> DataFrame:
    return checks.missing_profile(table(spark, d, "ae"), _MISS).select("variable", "n", "n_missing", _r("pct"))


@query("""SELECT 'DUP-001' AS rule_id, 'ERROR' AS severity, 'key' AS category, 'ae' AS dataset, 'studyid,usubjid,aeseq' AS variable, studyid || '|' || usubjid || '|' || aeseq AS record, CAST(count(*) AS VARCHAR) AS value, 'key occurs more than once' AS message
  FROM ae WHERE studyid IS NOT NULL AND usubjid IS NOT NULL AND aeseq IS NOT NULL GROUP BY studyid, usubjid, aeseq HAVING count(*) > 1""")
def check_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicates(table(spark, d, "ae"), "ae", ["studyid", "usubjid", "aeseq"])


@query("""SELECT 'RANGE-001' AS rule_id, 'WARNING' AS severity, 'range' AS category, 'dm' AS dataset, 'age' AS variable, CAST(rec_id AS VARCHAR) AS record, CAST(age AS VARCHAR) AS value, 'outside 0-120' AS message FROM dm WHERE age NOT BETWEEN 0 AND 120
  UNION ALL SELECT 'LEN-001', 'ERROR', 'length', 'dm', 'armcd', CAST(rec_id AS VARCHAR), armcd, 'longer than 8' FROM dm WHERE length(armcd) > 8
  UNION ALL SELECT 'TYPE-001', 'ERROR', 'type', 'dm', 'subjid', CAST(rec_id AS VARCHAR), subjid, 'not a number' FROM dm WHERE trim(subjid) <> '' AND try_cast(trim(subjid) AS DOUBLE) IS NULL
  UNION ALL SELECT 'MISS-001', 'ERROR', 'missing', 'dm', 'country', CAST(rec_id AS VARCHAR), country, 'required value is missing' FROM dm WHERE country IS NULL OR trim(country) = ''""")
def check_row_rules(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rules = [
        checks.Rule("RANGE-001", "WARNING", "range", "age", ~c("age").between(0, 120), "outside 0-120"), checks.Rule("LEN-001", "ERROR", "length", "armcd", F.length("armcd") > 8, "longer than 8"),
        checks.Rule("TYPE-001", "ERROR", "type", "subjid", C.clean(c("subjid")).isNotNull() & C.safe_double(c("subjid")).isNull(), "not a number"),
        checks.Rule("MISS-001", "ERROR", "missing", "country", C.filled(c("country")).isNull(), "required value is missing"),
    ]
    return checks.rows(table(spark, d, "dm"), "dm", rules)


@query("""SELECT 'XC001' AS rule_id, 'ERROR' AS severity, 'cross' AS category, 'ex' AS dataset, 'usubjid' AS variable, upper(trim(usubjid)) AS record, CAST(count(*) AS VARCHAR) AS value, 'subject is not in the parent' AS message FROM ex
  WHERE trim(usubjid) <> '' AND upper(trim(usubjid)) NOT IN (SELECT upper(trim(usubjid)) FROM dm WHERE usubjid IS NOT NULL) GROUP BY upper(trim(usubjid))""")
def check_orphans(spark: SparkSession, d: str) -> DataFrame:
    return checks.orphans(table(spark, d, "ex"), table(spark, d, "dm"), "ex")


@query("""SELECT rec_id, aestdtc, aeendtc FROM ae WHERE length(trim(aestdtc)) = length(trim(aeendtc)) AND length(trim(aestdtc)) IN (4, 7, 10) AND regexp_matches(trim(aestdtc),'^\\d{4}') AND regexp_matches(trim(aeendtc),'^\\d{4}') AND substr(trim(aestdtc),1,10) > substr(trim(aeendtc),1,10)""")
def check_date_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ae").where(checks.date_order(F.col("aestdtc"), F.col("aeendtc"))).select("rec_id", "aestdtc", "aeendtc")


@query("""WITH u AS (SELECT DISTINCT armcd FROM dm WHERE trim(armcd) <> ''), k(armcd) AS (VALUES ('PBO'),('VEL10'),('VEL25'),('QUO50'),('NONE'))
  SELECT armcd, 'FAIL' AS result, 'not configured' AS message FROM u WHERE armcd NOT IN (SELECT armcd FROM k) UNION ALL SELECT armcd, 'WARN', 'not used' FROM k WHERE armcd NOT IN (SELECT armcd FROM u)""")
def check_arms(spark: SparkSession, d: str) -> DataFrame:
    """Arm codes in use against the configured ones, both ways."""
    used = table(spark, d, "dm").where("trim(armcd) <> ''").select("armcd").distinct()
    known = spark.createDataFrame([(x,) for x in ("PBO", "VEL10", "VEL25", "QUO50", "NONE")], "armcd string")
    fail = used.join(known, "armcd", "left_anti").select("armcd", F.lit("FAIL").alias("result"), F.lit("not configured").alias("message"))
    return fail.unionByName(known.join(used, "armcd", "left_anti").select("armcd", F.lit("WARN").alias("result"), F.lit("not used").alias("message")))


_STRUCTURE = ("dm", "ae", "ex", "vs", "ts", "adsl", "adtte")


@query("""WITH c AS (SELECT upper(table_name) AS t, upper(column_name) AS v FROM duckdb_columns() WHERE table_name IN ('dm','ae','ex','vs','ts','adsl','adtte')),
  req(t, v) AS (VALUES ('DM','STUDYID'),('DM','DOMAIN'),('DM','USUBJID'),('DM','SUBJID'),('DM','SITEID'),('DM','ARM'),('DM','ARMCD'),('AE','STUDYID'),('AE','DOMAIN'),('AE','USUBJID'),('AE','AESEQ'),('AE','AETERM'),('AE','AEBODSYS'),
    ('EX','STUDYID'),('EX','DOMAIN'),('EX','USUBJID'),('EX','EXSEQ'),('EX','EXTRT'),('VS','STUDYID'),('VS','DOMAIN'),('VS','USUBJID'),('VS','VSSEQ'),('VS','VSTESTCD'),('VS','VSTEST'),('ADSL','STUDYID'),('ADSL','USUBJID'),('ADSL','TRT01P'),('ADSL','TRT01A'),('ADSL','SAFFL'))
  SELECT t AS dataset, 'SDTM-NAM-002' AS rule_id, 'WARNING' AS severity, v AS variable, 'name is longer than 8' AS message FROM c WHERE length(v) > 8
  UNION ALL SELECT t, 'SDTM-REQ-001', 'ERROR', v, 'required variable is absent' FROM req WHERE (t, v) NOT IN (SELECT t, v FROM c)""")
def check_structure(spark: SparkSession, d: str) -> DataFrame:
    """Structure issues of the tables at hand, from their schemas alone."""
    found = [(t.upper(), *f) for t in _STRUCTURE for f in checks.structure(table(spark, d, t).columns, t.upper())]
    return spark.createDataFrame(found, "dataset string, rule_id string, severity string, variable string, message string")


@query(f"SELECT dataset, rule_id, severity, count(*) AS n FROM ({CT}) GROUP BY 1, 2, 3")
def check_summary(spark: SparkSession, d: str) -> DataFrame:
    return checks.summary(_issues(spark, d))


@query(f"""WITH i AS (SELECT DISTINCT dataset, rule_id, variable, severity FROM ({CT})), c AS (SELECT dataset, count(CASE WHEN severity = 'ERROR' THEN 1 END) AS errors, count(CASE WHEN severity = 'WARNING' THEN 1 END) AS warnings FROM i GROUP BY 1),
  s(dataset) AS (VALUES ('dm'),('ae'),('adsl'),('ex')) SELECT s.dataset, coalesce(errors,0) AS errors, coalesce(warnings,0) AS warnings, CAST(greatest(0, 100 - 15 * coalesce(errors,0) - 5 * coalesce(warnings,0)) AS INTEGER) AS score,
  greatest(0, 100 - 15 * coalesce(errors,0) - 5 * coalesce(warnings,0)) >= 80 AS passed FROM s LEFT JOIN c ON s.dataset = c.dataset""")
def check_quality(spark: SparkSession, d: str) -> DataFrame:
    return checks.quality(_issues(spark, d), spark.createDataFrame([(x,) for x in ("dm", "ae", "adsl", "ex")], "dataset string"))


@query("""WITH a AS (SELECT usubjid, avg(age)::DOUBLE AS v FROM dm GROUP BY 1), b AS (SELECT upper(trim(usubjid)) AS usubjid, avg(age)::DOUBLE AS v FROM adsl GROUP BY 1)
  SELECT coalesce(a.usubjid, b.usubjid) AS usubjid, CASE WHEN b.usubjid IS NULL THEN 'RECON-001' WHEN a.usubjid IS NULL THEN 'RECON-002' ELSE 'RECON-003' END AS rule_id, a.v AS a, b.v AS b FROM a FULL OUTER JOIN b ON a.usubjid = b.usubjid
  WHERE a.usubjid IS NULL OR b.usubjid IS NULL OR abs(a.v - b.v) > abs(b.v) * 0.01 OR (a.v IS NULL) <> (b.v IS NULL)""")
def check_reconcile(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "dm").groupBy("usubjid").agg(F.avg("age").alias("v"))
    b = table(spark, d, "adsl").groupBy(F.upper(F.trim("usubjid")).alias("usubjid")).agg(F.avg("age").alias("v"))
    return checks.reconcile(a, b, ["usubjid"], "v")


@query("""WITH g AS (SELECT load_no, count(*) * 3 AS cells, count(nullif(trim(aeterm),'')) + count(nullif(trim(aesev),'')) + count(nullif(trim(aestdtc),'')) AS filled FROM ae GROUP BY 1)
  SELECT load_no, cells, filled, round(filled * 100.0 / cells, 6) AS score, round(filled * 100.0 / cells - lag(filled * 100.0 / cells) OVER (ORDER BY load_no), 6) AS change FROM g""")
def check_completeness_trend(spark: SparkSession, d: str) -> DataFrame:
    """Completeness of each load and its change from the load before."""
    names = ("aeterm", "aesev", "aestdtc")
    filled = sum(F.count_if(C.filled(F.col(c)).isNotNull()) for c in names)
    g = table(spark, d, "ae").groupBy("load_no").agg((F.count(F.lit(1)) * 3).alias("cells"), filled.alias("filled"))
    score = F.col("filled") * 100.0 / F.col("cells")
    w = Window.orderBy("load_no")  # one row per load
    return g.select("load_no", "cells", "filled", F.round(score, 6).alias("score"), F.round(score - F.lag(score).over(w), 6).alias("change"))


_LAST = "SELECT upper(trim(usubjid)) AS k, * EXCLUDE (usubjid) FROM {t} WHERE trim(usubjid) <> '' QUALIFY row_number() OVER (PARTITION BY upper(trim(usubjid)) ORDER BY received_at DESC NULLS LAST, rec_id DESC) = 1"
_ISO_D = "CASE WHEN regexp_matches(replace(trim({c}),'/','-'), '^\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?$') THEN try_cast(substr(replace(trim({c}),'/','-'),1,10) AS DATE) END"
_NE = "(trim({0}) <> '' AND trim({1}) <> '' AND trim({0}) <> trim({1}))"


def _n(rule: str, severity: str, dataset: str, rest: str) -> str:
    return f"SELECT '{rule}' AS rule_id, '{severity}' AS severity, '{dataset}' AS dataset, count(*) AS n FROM {rest} HAVING count(*) > 0"


def _summed(parts) -> DataFrame:
    return checks.union(parts).groupBy("rule_id", "severity", "dataset").agg(F.count(F.lit(1)).alias("n"))


_SL = "sl AS (" + _LAST.format(t="adsl") + ")"
_DOSED = "dosed AS (SELECT DISTINCT upper(trim(usubjid)) AS k FROM ex WHERE exdose > 0 AND trim(usubjid) <> '')"
_DUP = "(SELECT upper(trim(usubjid)) AS k FROM adsl WHERE trim(usubjid) <> '' GROUP BY 1 HAVING count(*) > 1)"


@query(f"WITH {_DOSED}, " + "s AS (SELECT a.*, CASE WHEN d.k IS NULL THEN 'N' ELSE 'Y' END AS safe FROM adsl a LEFT JOIN dosed d ON upper(trim(a.usubjid)) = d.k) " + " UNION ALL ".join([
    _n("ADSL001", "ERROR", "ADSL", _DUP), _n("ADSL010", "ERROR", "ADSL", _DUP), _n("ADSL002", "ERROR", "ADSL", "(SELECT DISTINCT upper(trim(usubjid)) AS k FROM dm WHERE trim(usubjid) <> '') d WHERE k NOT IN (SELECT upper(trim(usubjid)) FROM adsl WHERE usubjid IS NOT NULL)"),
    _n("ADSL003", "ERROR", "ADSL", "s WHERE saffl IN ('Y','N') AND saffl <> safe"), _n("ADSL004", "ERROR", "ADSL", "s WHERE ittfl IN ('Y','N') AND ittfl <> CASE WHEN trim(armcd) <> '' AND armcd <> 'SCRNFAIL' THEN 'Y' ELSE 'N' END"),
    _n("ADSL005", "ERROR", "ADSL", "s WHERE trim(arm) <> '' AND nullif(trim(trt01p),'') IS DISTINCT FROM trim(arm)"), _n("ADSL006", "WARNING", "ADSL", "s WHERE coalesce(nullif(trim(actarm),''), nullif(trim(arm),'')) IS NOT NULL AND nullif(trim(trt01a),'') IS DISTINCT FROM coalesce(nullif(trim(actarm),''), nullif(trim(arm),''))"),
    _n("ADSL007", "ERROR", "ADSL", f"s WHERE {_ISO_D.format(c='trtsdt')} > {_ISO_D.format(c='trtedt')}"), _n("ADSL008", "ERROR", "ADSL", "s WHERE " + " OR ".join(f"(trim({c}) <> '' AND {c} NOT IN ('Y','N'))" for c in ("saffl", "ittfl", "pprotfl", "efffl"))),
    _n("ADSL009", "ERROR", "ADSL", "s WHERE " + " OR ".join(f"coalesce(trim({c}), '') = ''" for c in ("studyid", "usubjid", "trt01p", "saffl"))),
]))
def check_adsl_pack(spark: SparkSession, d: str) -> DataFrame:
    return _summed(rulepacks.adsl_pack(*[table(spark, d, t) for t in ("adsl", "dm", "ex")]))


_EM = f"CASE WHEN {_ISO_D.format(c='a.astdt')} IS NULL OR {_ISO_D.format(c='s.trtsdt')} IS NULL THEN NULL WHEN {_ISO_D.format(c='a.astdt')} >= {_ISO_D.format(c='s.trtsdt')} AND ({_ISO_D.format(c='s.trtedt')} IS NULL OR {_ISO_D.format(c='a.astdt')} <= {_ISO_D.format(c='s.trtedt')} + 30) THEN 'Y' ELSE 'N' END"
_AE_OUT = "(SELECT DISTINCT upper(trim(usubjid)) AS k FROM {t} WHERE trim(usubjid) <> '') x WHERE k NOT IN (SELECT k FROM sl)"


@query(f"WITH {_SL} " + " UNION ALL ".join([
    _n("ADAE001", "ERROR", "ADAE", _AE_OUT.format(t="adae")), _n("ADAE006", "ERROR", "ADAE", _AE_OUT.format(t="adae")), _n("ADAE004", "ERROR", "ADAE", "adae WHERE coalesce(trim(aedecod), '') = ''"), _n("ADAE005", "ERROR", "ADAE", "adae WHERE coalesce(trim(aebodsys), '') = ''"),
    _n("ADAE002", "ERROR", "ADAE", f"adae a JOIN sl s ON upper(trim(a.usubjid)) = s.k WHERE a.trtemfl IN ('Y','N') AND s.saffl = 'Y' AND a.trtemfl <> {_EM}"),
    _n("ADAE003", "ERROR", "ADAE", f"adae a JOIN sl s ON upper(trim(a.usubjid)) = s.k WHERE a.trtemfl = 'Y' AND {_ISO_D.format(c='a.astdt')} < {_ISO_D.format(c='s.trtsdt')}"),
]))
def check_adae_pack(spark: SparkSession, d: str) -> DataFrame:
    return _summed(rulepacks.adae_pack(table(spark, d, "adae"), table(spark, d, "adsl")))


@query(f"WITH {_SL}, z AS (SELECT (SELECT count(*) FROM sl) AS n, (SELECT count(DISTINCT upper(trim(usubjid))) FROM dm WHERE trim(usubjid) <> '') AS m) " + " UNION ALL ".join([_n("X001", "ERROR", "ADSL", "z WHERE n <> m")] + [
    p for t in ("adae", "adtte") for p in (
        _n("X002", "ERROR", t.upper(), _AE_OUT.format(t=t)), _n("X003", "ERROR", t.upper(), f"{t} a JOIN sl s ON upper(trim(a.usubjid)) = s.k WHERE {_NE.format('a.trtp', 's.trt01p')}"),
        _n("X004", "ERROR", t.upper(), f"{t} a JOIN sl s ON upper(trim(a.usubjid)) = s.k WHERE {_NE.format('a.saffl', 's.saffl')} OR {_NE.format('a.ittfl', 's.ittfl')}"),
    )
]))
def check_cross_pack(spark: SparkSession, d: str) -> DataFrame:
    return _summed(rulepacks.cross_pack(table(spark, d, "adsl"), table(spark, d, "dm"), {t.upper(): table(spark, d, t) for t in ("adae", "adtte")}))


@query(f"""WITH {BDS}, {_SL}, b AS (SELECT b.*, nullif(trim(v.vsorres),'') AS avalc, s.saffl AS saffl, s.trt01p AS trtp, upper(trim(b.usubjid)) AS k FROM bds b JOIN vs v ON b.rec_id = v.rec_id LEFT JOIN sl s ON upper(trim(b.usubjid)) = s.k) """ + " UNION ALL ".join([
    _n("BDS001", "ERROR", "BDS", "(SELECT k, paramcd, adt FROM b WHERE k <> '' AND paramcd IS NOT NULL AND adt IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1)"),
    _n("BDS002", "ERROR", "BDS", "b WHERE regexp_matches(avalc, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') AND abs(CAST(avalc AS DOUBLE) - aval) > 1e-6"), _n("BDS006", "ERROR", "BDS", "(SELECT DISTINCT k FROM b WHERE k <> '') WHERE k NOT IN (SELECT k FROM sl)"),
]))
def check_bds_pack(spark: SparkSession, d: str) -> DataFrame:
    """Rules of the findings dataset; texts of results that were not converted differ from their value (BDS002)."""
    adsl = table(spark, d, "adsl")
    s = rulepacks.latest(adsl, ["saffl", F.col("trt01p").alias("trtp")])
    raw = table(spark, d, "vs").select("rec_id", C.clean(F.col("vsorres")).alias("avalc"))
    b = rulepacks.keyed(_bds(spark, d)).join(raw, "rec_id").join(s, "k", "left").drop("k")
    return _summed(rulepacks.bds_pack(b, adsl))


_OK = "regexp_matches(trim({c}), '^\\d{{4}}(-\\d{{2}}(-\\d{{2}}([T ].*)?)?)?$')"


def _pair(name: str, dataset: str, a: str, b: str, rest: str) -> str:
    n = f"least(length(trim({a})), length(trim({b})), 10)"
    p, q = f"substr(trim({a}), 1, {n})", f"substr(trim({b}), 1, {n})"
    both = f"{_OK.format(c=a)} AND {_OK.format(c=b)}"
    return (f"SELECT '{name}' AS pair, '{dataset}' AS dataset, CASE WHEN {p} > {q} THEN 'FAIL' ELSE 'WARN' END AS result, count(*) AS n FROM {rest} "
            f"WHERE {both} AND ({p} > {q} OR ({p} = {q} AND {n} < 10 AND length(trim({a})) <> length(trim({b})))) GROUP BY 3")  # fmt: skip


_SV = "(SELECT usubjid, min(substr(vsdtc,1,10)) AS svstdtc, max(substr(vsdtc,1,10)) AS svendtc FROM vs WHERE visitnum IS NOT NULL GROUP BY usubjid, visitnum)"
_DS = "(SELECT usubjid, rfendtc AS dsstdtc FROM adsl WHERE deleted_at IS NULL)"


@query("WITH r AS (" + _LAST.format(t="dm") + ") " + " UNION ALL ".join([
    *[_pair(f"RFSTDTC<={c.upper()}", t, "r.rfstdtc", f"x.{c}", f"{src} x JOIN r ON upper(trim(x.usubjid)) = r.k") for c, t, src in (("exstdtc", "EX", "ex"), ("aestdtc", "AE", "ae"), ("svstdtc", "SV", _SV), ("dsstdtc", "DS", _DS))],
    *[_pair(f"{p.upper()}STDTC<={p.upper()}ENDTC", p.upper(), f"{p}stdtc", f"{p}endtc", src) for p, src in (("ex", "ex"), ("ae", "ae"), ("sv", _SV))],
]))
def check_date_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Seven pairs of dates across domains, counted by result."""
    day = F.substring("vsdtc", 1, 10)
    sv = table(spark, d, "vs").where("visitnum is not null").groupBy("usubjid", "visitnum").agg(F.min(day).alias("svstdtc"), F.max(day).alias("svendtc")).withColumn("rec_id", F.col("visitnum"))
    dm, ae, ex = (table(spark, d, t) for t in ("dm", "ae", "ex"))
    return rulepacks.date_order_pack(dm, ae, ex, sv, X.dispositions(spark, d)).groupBy("pair", "dataset", "result").agg(F.count(F.lit(1)).alias("n"))


_KT = "upper(trim(usubjid)) AS k, upper(trim(aeterm)) AS t, nullif(trim(aestdtc),'') AS d"


@query(f"""WITH f AS (SELECT {_KT} FROM adae WHERE upper(trim(aeser)) = 'Y' AND trim(usubjid) <> '' AND trim(aeterm) <> ''), e AS (SELECT {_KT}, upper(trim(aeser)) = 'Y' AS y FROM ae),
p AS (SELECT k, t, max(CASE WHEN y THEN 1 ELSE 0 END) AS y FROM e GROUP BY 1, 2), j AS (SELECT f.*, p.k IS NOT NULL AS found, p.y, (f.k, f.t, f.d) IN (SELECT (k, t, d) FROM e WHERE d IS NOT NULL AND k IS NOT NULL AND t IS NOT NULL) AS same FROM f LEFT JOIN p ON f.k = p.k AND f.t = p.t) """ + " UNION ALL ".join([
    _n("RECON-SAE-001", "ERROR", "SAE", "j WHERE NOT found"), _n("RECON-SAE-002", "ERROR", "SAE", "j WHERE found AND y = 0"), _n("RECON-SAE-003", "WARNING", "SAE", "j WHERE found AND d IS NOT NULL AND NOT same"),
]))
def check_sae(spark: SparkSession, d: str) -> DataFrame:
    """Serious events of the analysis dataset as forms against the events recorded."""
    return _summed([rulepacks.sae_pack(table(spark, d, "adae").where("upper(trim(aeser)) = 'Y'"), table(spark, d, "ae"))])


@query("WITH r AS (" + _LAST.format(t="dm") + "), j AS (SELECT a.*, r.k AS rk, r.arm AS rarm, r.country AS rcountry, r.sex AS rsex FROM adsl a LEFT JOIN r ON upper(trim(a.usubjid)) = r.k WHERE trim(a.usubjid) <> '') " + " UNION ALL ".join([
    _n("RECON-RAND-001", "WARNING", "RAND", f"j WHERE {_NE.format('arm', 'rarm')}"), _n("RECON-RAND-002", "ERROR", "RAND", "j WHERE rk IS NULL"),
    _n("RECON-RAND-003", "WARNING", "RAND", f"j WHERE {_NE.format('country', 'rcountry')} OR {_NE.format('sex', 'rsex')}"),
]))
def check_randomisation(spark: SparkSession, d: str) -> DataFrame:
    """Treatment lists of the analysis dataset against demographics; country and sex are the strata."""
    return _summed([rulepacks.randomisation_pack(table(spark, d, "adsl"), table(spark, d, "dm"), ["country", "sex"])])


@query(f"""SELECT CASE WHEN lower(message) SIMILAR TO '.*(missing|required|absent|null).*' THEN 'missing' WHEN lower(message) SIMILAR TO '.*(codelist|terminology|not found in).*' THEN 'terminology' ELSE 'other' END AS family, count(*) AS n FROM ({CT}) GROUP BY 1""")
def check_message_families(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d).groupBy(checks.message_group(F.col("message")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS n_rows, count(DISTINCT usubjid) AS n_subjects FROM {t}" for t in ("dm", "adsl", "ae", "adae", "ex", "vs", "adtte")))
def manifest(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).agg(F.lit(t).alias("dataset"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("usubjid").alias("n_subjects")) for t in ("dm", "adsl", "ae", "adae", "ex", "vs", "adtte")]
    return checks.union(parts)


@query("""SELECT 'XREF-001' AS rule_id, 'ERROR' AS severity, 'metadata' AS category, 'ae' AS dataset, 'attr' AS variable, upper(trim(tsparmcd)) AS record, CAST(count(*) AS VARCHAR) AS value, 'reference has no definition' AS message FROM ts
  WHERE upper(trim(tsparmcd)) NOT IN (SELECT upper(trim(attr)) FROM param_spec WHERE tab = 'ts' AND attr IS NOT NULL) GROUP BY upper(trim(tsparmcd))""")
def check_cross_references(spark: SparkSession, d: str) -> DataFrame:
    """Parameters in use that the specification of the table does not define."""
    refs = table(spark, d, "ts").select(F.upper(F.trim("tsparmcd")).alias("attr"))
    return checks.cross_references(refs, table(spark, d, "param_spec").where("tab = 'ts'").select(F.upper(F.trim("attr")).alias("attr")), "attr", "attr", "XREF-001", "ae")


@query("""WITH g AS (SELECT load_no, count(*) AS n, count(nullif(trim(aesev),'')) * 100.0 / count(*) AS a, count(CASE WHEN upper(aeterm) = aedecod THEN 1 END) * 100.0 / count(*) AS b, count(CASE WHEN rec_id IS NOT NULL THEN 1 END) * 100.0 / count(*) AS c,
  count(CASE WHEN upper(trim(aesev)) IN ('MILD','MODERATE','SEVERE') THEN 1 END) * 100.0 / count(*) AS e FROM ae GROUP BY 1) SELECT load_no, n, round(a * 0.4 + b * 0.3 + c * 0.2 + e * 0.1, 6) AS score FROM g""")
def check_composite_score(spark: SparkSession, d: str) -> DataFrame:
    """Weighted score of each load: completeness, consistency of term and code, types, terminology."""
    n = F.count(F.lit(1))
    parts = [F.col("aesev").isNotNull() & (F.trim("aesev") != ""), F.upper("aeterm") == F.col("aedecod"), F.col("rec_id").isNotNull(), F.upper(F.trim("aesev")).isin("MILD", "MODERATE", "SEVERE")]
    pct = [F.count_if(p) * 100.0 / n for p in parts]
    return table(spark, d, "ae").groupBy("load_no").agg(n.alias("n"), F.round(checks.composite(*pct), 6).alias("score"))


# --- graph --------------------------------------------------------------------------------------------------------


@query(f"WITH {X.GRAPH} SELECT id, layer FROM nodes WHERE id NOT IN (SELECT id FROM done) AND id NOT IN (SELECT to_id FROM edges WHERE edge_type IN ('requires','validates') AND from_id NOT IN (SELECT id FROM done))")
def graph_frontier(spark: SparkSession, d: str) -> DataFrame:
    return graph.frontier(*X.graph(spark, d))


@query(f"WITH {X.GRAPH} SELECT DISTINCT from_id AS id, 'predecessor' AS side FROM edges WHERE to_id = 'p1' UNION SELECT DISTINCT to_id, 'successor' FROM edges WHERE from_id = 'p1'")
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(X.graph(spark, d)[1], "p1")


@query(f"WITH {X.GRAPH} SELECT layer, count(*) AS total, count(done.id) AS done FROM nodes LEFT JOIN done ON nodes.id = done.id GROUP BY 1")
def graph_progress(spark: SparkSession, d: str) -> DataFrame:
    n, _, done = X.graph(spark, d)
    return graph.progress(n, done)


@query(f"WITH {X.GRAPH} SELECT e.from_id, e.to_id, a.layer AS lf, b.layer AS lt FROM edges e JOIN nodes a ON e.from_id = a.id JOIN nodes b ON e.to_id = b.id WHERE edge_type = 'requires' AND a.layer > b.layer")
def graph_backward_edges(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = X.graph(spark, d)
    return graph.backward_edges(n, e)


@query(f"WITH {X.GRAPH} SELECT id FROM (SELECT from_id AS id FROM edges UNION SELECT to_id FROM edges) WHERE id NOT IN (SELECT id FROM nodes)")
def graph_dangling(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = X.graph(spark, d)
    return graph.dangling(n, e)


@query()
def graph_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Nodes on or behind a cycle, found by taking away nodes that wait for nothing; tested against the driver's order."""
    n, e, _ = X.graph(spark, d)
    return graph.stuck(n, e)


@query("""WITH h AS (SELECT user_id, event_type, CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
  SELECT user_id, event_type, round(sum(CASE WHEN value IS NULL THEN 0 ELSE o * 0.1::DOUBLE * pow(0.9::DOUBLE, back) END) + 0.5 * pow(0.9::DOUBLE, max(n)), 6) AS weight FROM h GROUP BY 1, 2""")
def graph_weights(spark: SparkSession, d: str) -> DataFrame:
    """Moving average of outcomes per user and event type."""
    e = table(spark, d, "events").withColumn("ok", (F.col("value") > 20).cast("int"))
    return graph.weights(e, ["user_id", "event_type"], "event_id", "ok").select("user_id", "event_type", _r("weight"))


@query("SELECT user_id, round((count(CASE WHEN value > 20 THEN 1 END) + 1) / (count(*) + 2), 6) AS score FROM events GROUP BY 1")
def graph_laplace(spark: SparkSession, d: str) -> DataFrame:
    return graph.laplace(table(spark, d, "events").withColumn("ok", F.col("value") > 20), ["user_id"], "ok").select("user_id", _r("score"))


@query()
def graph_schedule(spark: SparkSession, d: str) -> DataFrame:
    """A budget of tokens per subject over all its documents, recent sources of a protocol counting as current; tested against a loop."""
    items = table(spark, d, "documents").where("usubjid is not null").select(
        F.col("usubjid").alias("grp"), F.col("doc_id").cast("string").alias("name"), (F.length("source") / 10.0).alias("priority"), text.token_estimate(F.col("text")).alias("tokens"), (F.col("source") == "narrative").alias("current")
    )
    return graph.schedule(items, 1000)


@query("""SELECT query_id, vec_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
  (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE score >= 0.1) WHERE rank <= 10""")
def graph_similar(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar vectors to every hundredth one (a top-k report)."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return graph.similar_each(spread(e), e.where("vec_id % 100 = 0"), "embedding", "vec_id", 10, 0.1).select("query_id", "vec_id", "rank", _r("score", 5))


# --- text ---------------------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query()
def text_shells(spark: SparkSession, d: str) -> DataFrame:
    """Shells announced in whole documents; tested against plain regular expressions, as their end needs a look ahead."""
    return text.shells(_documents(spark, d))


@query()
def text_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return text.endpoints(_documents(spark, d))


@query("""WITH t AS (SELECT doc_id, regexp_extract(text, '\\b(?i:(?:study|trial|protocol)\\s+(?:identifier|number|code|id|no\\.))[:#\\s]+([A-Z0-9][A-Z0-9-]*[0-9][A-Z0-9-]*)', 1) AS a,
  regexp_extract(text, '(?:^|[^A-Za-z0-9_-])([A-Z]{2,6}[0-9]{4,9})(?:[^0-9]|$)', 1) AS b, upper(regexp_extract(text, '\\b(?i:phase)[\\s-]+([1-4][ab]?|I{1,3}[ab]?|IV[ab]?)\\b', 1)) AS p FROM documents)
SELECT doc_id, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE 'UNKNOWN' END AS study_id, CASE WHEN coalesce(p, '') = '' THEN 'Unknown' WHEN p LIKE 'IV%' THEN '4' || lower(substr(p, 3)) WHEN p LIKE 'III%' THEN '3' || lower(substr(p, 4)) WHEN p LIKE 'II%' THEN '2' || lower(substr(p, 3)) WHEN p LIKE 'I%' THEN '1' || lower(substr(p, 2)) ELSE lower(p) END AS phase FROM t""")
def text_study(spark: SparkSession, d: str) -> DataFrame:
    return text.study(_documents(spark, d))


@query()
def text_arms(spark: SparkSession, d: str) -> DataFrame:
    return text.arms(_documents(spark, d))


#: The SQL's own list of phrases, looked up in texts reduced to letters and digits, with no regular expression per phrase.
_PHRASES = """m(kind, name, phrase) AS (VALUES ('M','ANCOVA','ancova'),('M','ANCOVA','analysis of covariance'),('M','ANOVA','anova'),('M','ANOVA','analysis of variance'),('M','CMH','cmh'),('M','CMH','cochran mantel haenszel'),
  ('M','Chi-square','chi square'),('M','Chi-square','chi squared'),('M','Chi-square','chi2'),('M','Chi-square','χ²'),('M','Cox','cox model'),('M','Cox','cox regression'),('M','Cox','cox proportional hazards'),('M','Cox','proportional hazards model'),
  ('M','Descriptive','descriptive analysis'),('M','Descriptive','descriptive statistics'),('M','Descriptive','descriptive summary'),('M','Descriptive','summarised descriptively'),('M','Fisher','fisher exact'),('M','Fisher','fisher s exact'),
  ('M','Fisher','fisher test'),('M','Fisher','fisher s test'),('M','Kaplan-Meier','kaplan meier'),('M','Kaplan-Meier','km'),('M','Kaplan-Meier','product limit'),('M','Log-rank','log rank'),('M','Log-rank','logrank'),('M','Log-rank','mantel cox'),
  ('M','Mixed Model','mixed model'),('M','Mixed Model','mixed effect model'),('M','Mixed Model','mixed effects model'),('M','Mixed Model','mmrm'),('M','Wilcoxon','wilcoxon'),('M','Wilcoxon','mann whitney'),('M','t-test','t test'),('M','t-test','student t'),('M','t-test','student s t'),
  ('P','ITT','itt'),('P','ITT','intent to treat'),('P','ITT','intention to treat'),('P','ITT','fas'),('P','ITT','full analysis set'),('P','PP','per protocol'),('P','PP','pp population'),('P','PP','pp set'),('P','SAF','as treated'),('P','SAF','saf'),
  ('P','SAF','safety population'),('P','SAF','safety set'),('P','SAF','safety analysis set'),('P','mITT','mitt'),('P','mITT','modified itt'),('P','mITT','modified intent to treat'),('P','mITT','modified intention to treat'))"""


@query(f"""WITH {_PHRASES}, t AS (SELECT doc_id, length(text) AS n, ' ' || regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' AS s FROM documents WHERE text IS NOT NULL),
h AS (SELECT t.doc_id, m.kind, arg_min(m.name, strpos(t.s, ' ' || m.phrase || ' ') * 100 - length(m.phrase)) AS name FROM t, m WHERE strpos(t.s, ' ' || m.phrase || ' ') > 0 GROUP BY 1, 2)
SELECT coalesce(a.name, 'Descriptive') AS method, coalesce(b.name, 'ITT') AS population, count(*) AS n, sum(greatest(1, t.n // 4)) AS tokens FROM t LEFT JOIN h a ON a.doc_id = t.doc_id AND a.kind = 'M' LEFT JOIN h b ON b.doc_id = t.doc_id AND b.kind = 'P' GROUP BY 1, 2""")
def text_methods(spark: SparkSession, d: str) -> DataFrame:
    """Statistical methods and populations that whole documents name first."""
    t = table(spark, d, "documents").where("text is not null")
    return t.groupBy(text.method(F.col("text")).alias("method"), text.population(F.col("text")).alias("population")).agg(F.count(F.lit(1)).alias("n"), F.sum(text.token_estimate(F.col("text"))).alias("tokens"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of the event table; the streaming form is in vitaline.streaming."""
    from vitaline.streaming.events import tumbling

    out = tumbling(table(spark, d, "events"), "1 hour")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", _r("total", 4))
