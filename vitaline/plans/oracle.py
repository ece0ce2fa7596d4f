"""SQL equivalents of the queries, for a second engine to run over the same tables."""

from __future__ import annotations

from vitaline.plans import reference


def _categorical(tab: str, col: str, codes: str) -> str:
    return f"""SELECT '{tab}' AS tab, '{col}' AS col, load_no, unnest(list_filter([CASE WHEN n_rise THEN 'nulls' END, CASE WHEN off * 100 > filled * 20 THEN 'pattern' END, CASE WHEN filled > 0 AND p_filled > 0 AND diff * 100 > filled * p_filled * 44 THEN 'shift' END], lambda x: x IS NOT NULL)) AS finding
  FROM (WITH a AS (SELECT load_no, CASE WHEN trim({col}) <> '' THEN {col} END AS v FROM {tab} WHERE load_no IS NOT NULL),
  t AS (SELECT load_no, count(*)::HUGEINT AS n, count(v)::HUGEINT AS filled, count(CASE WHEN v NOT IN ({codes}) THEN 1 END)::HUGEINT AS off FROM a GROUP BY 1),
  u AS (SELECT *, lag(load_no) OVER w AS p, lag(n) OVER w AS p_n, lag(filled) OVER w AS p_filled FROM t WINDOW w AS (ORDER BY load_no)),
  c AS (SELECT load_no, v, count(*)::HUGEINT AS k FROM a WHERE v IS NOT NULL GROUP BY 1, 2),
  k AS (SELECT u.load_no, v FROM u JOIN c ON c.load_no = u.load_no UNION SELECT u.load_no, v FROM u JOIN c ON c.load_no = u.p),
  d AS (SELECT u.load_no, sum(abs(coalesce(x.k, 0) * u.p_filled - coalesce(y.k, 0) * u.filled)) AS diff FROM u JOIN k ON k.load_no = u.load_no LEFT JOIN c x ON x.load_no = u.load_no AND x.v = k.v LEFT JOIN c y ON y.load_no = u.p AND y.v = k.v GROUP BY 1)
  SELECT u.*, d.diff, ((n - filled) * p_n - (p_n - p_filled) * n) * 100 > 15 * n * p_n AS n_rise FROM u LEFT JOIN d ON u.load_no = d.load_no)"""


_NUMERIC = """SELECT 'dm' AS tab, 'age' AS col, load_no, unnest(list_filter([CASE WHEN (miss * p_n - p_miss * n) * 100 > 15 * n * p_n THEN 'nulls' END, CASE WHEN outside * 100 > (inside + outside) * 8 THEN 'range' END,
  CASE WHEN inside > 0 AND p_inside > 0 AND abs(s * p_inside - p_s * inside) > 8 * inside * p_inside THEN 'shift' END], lambda x: x IS NOT NULL)) AS finding FROM (SELECT *, lag(n) OVER w AS p_n, lag(miss) OVER w AS p_miss, lag(inside) OVER w AS p_inside, lag(s) OVER w AS p_s FROM
  (SELECT load_no, count(*)::HUGEINT AS n, count(CASE WHEN age IS NULL THEN 1 END)::HUGEINT AS miss, count(CASE WHEN age BETWEEN 0 AND 120 THEN 1 END)::HUGEINT AS inside, count(CASE WHEN age NOT BETWEEN 0 AND 120 THEN 1 END)::HUGEINT AS outside,
  coalesce(sum(CASE WHEN age BETWEEN 0 AND 120 THEN age END), 0)::HUGEINT AS s FROM dm WHERE load_no IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY load_no))"""


def _orphans(tab: str, parent: str) -> str:
    return f"""SELECT '{tab}' AS tab, c.rec_id, strftime(c.received_at, '%Y-%m') AS period, CASE WHEN p.k IS NULL THEN 'missing' WHEN p.live IS NULL THEN 'deleted' ELSE 'late' END AS kind FROM {tab} c
  LEFT JOIN (SELECT upper(trim(usubjid)) AS k, min(CASE WHEN deleted_at IS NULL THEN received_at END) AS live FROM {parent} WHERE trim(usubjid) <> '' GROUP BY 1) p ON upper(trim(c.usubjid)) = p.k
  WHERE p.k IS NULL OR p.live IS NULL OR p.live > c.received_at"""


_P6 = " UNION ALL ".join(_orphans(c, p) for c, p in (("adae", "adsl"), ("ex", "adsl"), ("adsl", "dm")))
_MON = "CASE upper(substr({0},1,3)) " + " ".join(f"WHEN '{m}' THEN '{i:02d}'" for i, m in enumerate(("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"), 1)) + " END"
_P2_VAL = f"""CASE t WHEN 'txt' THEN s
  WHEN 'yn' THEN CASE WHEN upper(s) IN ('Y','YES','1','TRUE') THEN 'Y' WHEN upper(s) IN ('N','NO','0','FALSE') THEN 'N' END
  WHEN 'int' THEN CASE WHEN regexp_matches(s,'^\\+?(\\d+|\\d{{1,3}}(,\\d{{3}})+|\\d{{1,3}}( \\d{{3}})+)(\\.0*)?$') THEN CAST(CAST(regexp_replace(regexp_replace(s,'\\.0*$',''),'[+, ]','','g') AS HUGEINT) AS VARCHAR) END
  WHEN 'num' THEN CASE WHEN regexp_matches(s,'^[+-]?(\\d+([.,]\\d*)?|[.,]\\d+)([eE][+-]?\\d+)?$') THEN regexp_replace(regexp_replace(CAST(CAST(CAST(replace(s,',','.') AS DOUBLE) AS DECIMAL(38,10)) AS VARCHAR),'0+$',''),'\\.$','') END
  WHEN 'date' THEN CAST(try_cast(CASE WHEN regexp_matches(s,'^\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}$') THEN replace(s,'/','-') WHEN regexp_matches(s,'^\\d{{8}}$') THEN substr(s,1,4) || '-' || substr(s,5,2) || '-' || substr(s,7,2)
    WHEN regexp_matches(s,'^\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}$') THEN split_part(s,'.',3) || '-' || split_part(s,'.',2) || '-' || split_part(s,'.',1)
    WHEN regexp_matches(s,'^\\d{{2}}[A-Za-z]{{3}}\\d{{4}}$') THEN substr(s,6,4) || '-' || {_MON.format('substr(s,3,3)')} || '-' || substr(s,1,2)
    WHEN regexp_matches(s,'^[A-Za-z]{{3,9}} \\d{{1,2}}, \\d{{4}}$') THEN substr(s,-4) || '-' || {_MON.format('s')} || '-' || regexp_extract(s,' (\\d{{1,2}}),',1) END AS DATE) AS VARCHAR) END"""
P2_CELLS = f"""WITH raw AS (SELECT 'ts' AS tab, trim(studyid) AS entity, upper(trim(tsparmcd)) AS attr, tsval AS v, received_at, rec_id FROM ts
  UNION ALL SELECT 'adtte', trim(usubjid), upper(trim(paramcd)), CAST(aval AS VARCHAR), received_at, rec_id FROM adtte),
  j AS (SELECT raw.*, p.val_type AS t, CASE WHEN upper(trim(v)) NOT IN ('','NULL','N/A','.') THEN trim(v) END AS s FROM raw JOIN param_spec p ON p.tab = raw.tab AND p.attr = raw.attr WHERE entity <> ''),
  k AS (SELECT *, {_P2_VAL} AS val FROM j)
  SELECT tab, entity, attr, val FROM k WHERE val IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tab, entity, attr ORDER BY received_at DESC NULLS LAST, rec_id DESC) = 1"""

SQL: dict[str, str] = {
    "p2_found": P2_CELLS,
    "p3_found": " UNION ALL ".join([_NUMERIC, _categorical("adsl", "saffl", "'Y','N'"), _categorical("ae", "aesev", "'MILD','MODERATE','SEVERE'")]),
    "p6_found": _P6,
    "p6_report": f"WITH f AS ({_P6}) SELECT f.tab, period, kind, count(*) AS n_rows, count(DISTINCT upper(trim(u.usubjid))) AS n_keys FROM f JOIN (SELECT 'adae' AS tab, rec_id, usubjid FROM adae UNION ALL SELECT 'ex', rec_id, usubjid FROM ex UNION ALL SELECT 'adsl', rec_id, usubjid FROM adsl) u ON f.tab = u.tab AND f.rec_id = u.rec_id GROUP BY 1, 2, 3",
    **reference.SQL,
}

#: Aliases of the units per test as the SQL knows them: after folding of case, blanks and brackets; p / q is the factor to tenths, off is taken off first.
_UNITS = """u(test, unit, aliases, off, p, q) AS (VALUES
  ('BP','mmHg','mmhg|torr',0,10,1),('BP','kPa','kpa|kilopascal|kilopascals',0,7600000,101325),('BP','cmHg','cmhg',0,100,1),('PULSE','beats/min','beats/min|beatsperminute|bpm|/min|b/min',0,10,1),
  ('RESP','breaths/min','breaths/min|breathsperminute|bpm|/min|brpm',0,10,1),('TEMP','C','c|degc|°c|celsius|degreesc',0,10,1),('TEMP','F','f|degf|°f|fahrenheit|degreesf',32,50,9),('TEMP','K','k|kelvin',273.15,10,1),
  ('WEIGHT','kg','kg|kgs|kilogram|kilograms',0,10,1),('WEIGHT','lb','lb|lbs|pound|pounds',0,45359237,10000000),('WEIGHT','g','g|gram|grams',0,1,100),('WEIGHT','st','st|stone|stones',0,635029318,10000000),
  ('HEIGHT','cm','cm|cms|centimeter|centimeters|centimetre|centimetres',0,10,1),('HEIGHT','in','in|inch|inches|"',0,254,10),('HEIGHT','m','m|meter|meters|metre|metres',0,1000,1),('HEIGHT','mm','mm|millimeter|millimeters|millimetre|millimetres',0,1,1),
  ('HEIGHT','ft','ft|foot|feet|''',0,3048,10),('OXYSAT','%','%|pct|percent',0,10,1),('OXYSAT','fraction','fraction|ratio|1',0,1000,1))"""
_FOLD = "regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[][]', '', 'g'), '(mm|cm) hg', '\\1hg', 'g'), '(deg|degrees|beats|breaths|per) ', '\\1', 'g')"
P5_FOUND = f"""WITH {_UNITS}, ux AS (SELECT t.test, u.unit, unnest(string_split(aliases, '|')) AS alias, off::DECIMAL(18,4) AS off, p::HUGEINT AS p, q::HUGEINT AS q FROM u JOIN (VALUES ('SYSBP','BP'),('DIABP','BP'),('PULSE','PULSE'),('RESP','RESP'),('TEMP','TEMP'),('WEIGHT','WEIGHT'),('HEIGHT','HEIGHT'),('OXYSAT','OXYSAT')) t(test, fam) ON t.fam = u.test),
v AS (SELECT rec_id, vstestcd AS test, replace(regexp_extract(vsorres, '[0-9]+([.,][0-9]+)?'), ',', '.') AS num, {_FOLD.format("regexp_extract(vsorres, '[0-9]+(?:[.,][0-9]+)?(.*)', 1)")} AS rest, {_FOLD.format('vsorresu')} AS field FROM vs WHERE regexp_matches(vsorres, '[0-9]')),
w AS (SELECT *, try_cast(num AS DECIMAL(18,4)) AS x, regexp_extract(rest, '^(?:st|stone|ft|feet|'') *([0-9]+(?:[.,][0-9]+)?)', 1) AS lesser FROM v),
it AS (SELECT w.rec_id, arg_max(ux.unit, length(ux.alias)) AS unit FROM w JOIN ux ON ux.test = w.test AND ux.alias <> '1' AND starts_with(w.rest, ux.alias) AND NOT regexp_matches(substr(w.rest, length(ux.alias) + 1, 1), CASE WHEN regexp_matches(right(ux.alias, 1), '[a-z]') THEN '^[a-z]' ELSE '^$x' END) GROUP BY 1),
fi AS (SELECT w.rec_id, min(ux.unit) AS unit FROM w JOIN ux ON ux.test = w.test AND ux.alias = w.field GROUP BY 1),
rg AS (SELECT w.rec_id, coalesce(max(CASE WHEN is_std THEN r.unit END), CASE WHEN count(*) = 1 THEN max(r.unit) END) AS unit FROM w JOIN vs_units r ON r.vstestcd = w.test AND w.x BETWEEN r.lo AND r.hi GROUP BY 1),
k AS (SELECT w.*, coalesce(it.unit, fi.unit, rg.unit) AS unit FROM w LEFT JOIN it ON it.rec_id = w.rec_id LEFT JOIN fi ON fi.rec_id = w.rec_id LEFT JOIN rg ON rg.rec_id = w.rec_id),
c AS (SELECT rec_id, test, unit AS named, CASE WHEN lesser <> '' AND unit = 'st' THEN 'lb' WHEN lesser <> '' AND unit = 'ft' THEN 'in' ELSE unit END AS unit, CASE WHEN lesser <> '' AND unit = 'st' THEN x * 14 + CAST(replace(lesser, ',', '.') AS DECIMAL(18,4)) WHEN lesser <> '' AND unit = 'ft' THEN x * 12 + CAST(replace(lesser, ',', '.') AS DECIMAL(18,4)) ELSE x END AS x FROM k)
SELECT c.rec_id, CAST((2 * CAST((c.x - f.off) * 10000 AS HUGEINT) * f.p + f.q * 10000) // (2 * f.q * 10000) AS BIGINT) AS std_tenths FROM c JOIN (SELECT DISTINCT test, unit, off, p, q FROM ux) f ON f.test = c.test AND f.unit = c.unit JOIN vs_units s ON s.vstestcd = c.test AND s.unit = c.named WHERE NOT s.is_std"""
SQL["p5_found"] = P5_FOUND

#: Times by the parser's own formats, after the zone at the end was taken off; a local time is read by the zone database and, where it
#: occurs twice, moved to its first occurrence.
P1_FOUND = """WITH a AS (SELECT 'dm' AS tab, rec_id, usubjid, rfstdtc AS v FROM dm UNION ALL SELECT 'ae', rec_id, usubjid, aestdtc FROM ae UNION ALL SELECT 'ex', rec_id, usubjid, exstdtc FROM ex),
z(name, m) AS (VALUES ('Z',0),('UTC',0),('GMT',0),('BST',60),('CET',60),('CEST',120),('MEZ',60),('MESZ',120),('WET',0),('WEST',60),('EET',120),('EEST',180),('JST',540),('KST',540),('SGT',480),('HKT',480),('AEST',600),('AEDT',660),('NZST',720),('NZDT',780),
  ('EST',-300),('EDT',-240),('CDT',-300),('MST',-420),('MDT',-360),('PST',-480),('PDT',-420)),
b AS (SELECT a.tab, a.rec_id, trim(regexp_replace(a.v, '\\s+', ' ', 'g')) AS s, t.tz, t.date_order FROM a LEFT JOIN (SELECT upper(trim(siteid)) AS k, min(tz) AS tz, min(date_order) AS date_order FROM sites GROUP BY 1) t ON t.k = upper(trim(split_part(trim(a.usubjid), '-', 2)))),
c AS (SELECT *, CASE WHEN regexp_matches(s, '(:\\d\\d(\\.\\d+)?|T\\d{6}) ?(Z|[+-]\\d\\d:?(\\d\\d)?|[A-Z]{2,5})$') AND NOT regexp_matches(upper(s), '[AP]M$') THEN regexp_extract(s, '(:\\d\\d(?:\\.\\d+)?|T\\d{6}) ?(Z|[+-]\\d\\d:?(?:\\d\\d)?|[A-Z]{2,5})$', 2) ELSE '' END AS zone FROM b),
d AS (SELECT *, trim(left(s, length(s) - length(zone))) AS base FROM c),
e AS (SELECT *, coalesce(try_strptime(base, ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y%m%dT%H%M%S', '%d%b%Y:%H:%M:%S', '%d %b %Y %H:%M:%S', '%B %d, %Y %I:%M %p', '%d.%m.%Y %H:%M', '%Y/%m/%d %H:%M']),
  CASE date_order WHEN 'MDY' THEN try_strptime(base, ['%m/%d/%Y %I:%M %p', '%m/%d/%Y %H:%M']) WHEN 'DMY' THEN try_strptime(base, ['%d/%m/%Y %I:%M %p', '%d/%m/%Y %H:%M']) END) AS l FROM d),
f AS (SELECT e.*, z.m, CASE WHEN regexp_matches(zone, '^[+-]') THEN (CASE WHEN zone LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr(zone, 2, 2) AS INT) * 60 + CASE WHEN length(zone) > 3 THEN CAST(right(zone, 2) AS INT) ELSE 0 END) WHEN zone = 'CST' THEN CASE WHEN tz = 'Asia/Shanghai' THEN 480 ELSE -360 END
  WHEN zone = 'IST' THEN CASE tz WHEN 'Europe/Dublin' THEN 60 WHEN 'Asia/Jerusalem' THEN 120 ELSE 330 END WHEN zone <> '' THEN z.m END AS off, CASE WHEN l IS NOT NULL AND zone = '' AND tz IS NOT NULL THEN timezone(tz, date_trunc('second', l)) END AS t FROM e LEFT JOIN z ON z.name = zone),
g AS (SELECT *, CASE WHEN regexp_matches(s, '^\\d{10}(\\d{3})?$') THEN CAST(left(s, 10) AS BIGINT) WHEN l IS NOT NULL AND off IS NOT NULL THEN epoch(date_trunc('second', l))::BIGINT - off * 60 WHEN t IS NULL THEN NULL
  WHEN timezone(tz, t - INTERVAL 1 HOUR) = date_trunc('second', l) THEN epoch(t)::BIGINT - 3600 WHEN timezone(tz, t - INTERVAL 30 MINUTE) = date_trunc('second', l) THEN epoch(t)::BIGINT - 1800 ELSE epoch(t)::BIGINT END AS x FROM f)
SELECT tab, rec_id, strftime(make_timestamp(x * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS utc FROM g WHERE x IS NOT NULL"""
SQL["p1_found"] = P1_FOUND
