import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from vitaline.functions import cols as C
from vitaline.operators import adam, checks, graph, sdtm, text, tfl
from vitaline.plans import fixtures


def one(spark, expr_by_name: dict, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(*[e.alias(n) for n, e in expr_by_name.items()]).first()


def test_scalar_helpers(spark):
    c = F.col
    r = one(
        spark,
        {
            "i": C.safe_int(c("a")), "suffix": C.safe_double(c("b")), "big": C.safe_int(c("big")), "yn": C.yes_no(c("y")), "null": C.standard_null(c("n")), "start": C.impute_date(c("p")), "end": C.impute_date(c("p"), end=True), "flag": C.imputation_flag(c("p")),
            "bad": C.iso_date(c("d")), "day": C.study_day(F.lit(date(2020, 1, 1)), F.lit(date(2020, 1, 2))), "arm": sdtm.armcd(F.lit("Low dose: 10 mg"), F.lit(None)), "id": sdtm.usubjid(c("a"), F.lit(None), F.lit("7"), pad=3),
        },
        a=" 65.9 ", b="98.2F", big="9e99", y="true", n=" N/A", p="2020-02", d="2021-02-30",
    )
    assert (r.i, r.suffix, r.big, r.yn, r.null, r.flag, r.bad, r.day, r.arm) == (65, None, None, "Y", None, "D", None, 0, "LOWDOSE1")
    assert (r.start, r.end, r.id) == (date(2020, 2, 1), date(2020, 2, 29), " 65.9 ".strip() + "-000-007")


def test_range_and_maps(spark):
    r = one(spark, {"l": sdtm.range_indicator(F.lit(1), F.lit(2), F.lit(3)), "n": sdtm.range_indicator(F.lit(2), F.lit(2), F.lit(3)), "x": sdtm.range_indicator(F.lit(2), F.lit(None).cast("int"), F.lit(3)), "sex": sdtm.upper_map(F.col("s"), {"MALE": "M"}, F.lit("U"))}, s=" male ")
    assert (r.l, r.n, r.x, r.sex) == ("L", "N", None, "M")


def test_supp_round_trip(spark):
    p = spark.createDataFrame([("S", "u1", 1, "a", None), ("S", "u1", 2, " ", "b"), ("S", "u2", 1, None, None)], "studyid string, usubjid string, aeseq int, qa string, qb string")
    supp = sdtm.supp_unpivot(p, "AE", "aeseq", [("qa", "A"), ("qb", "B")])
    assert sorted((r.usubjid, r.idvarval, r.qnam, r.qval) for r in supp.collect()) == [("u1", "1", "QA", "a"), ("u1", "2", "QB", "b")]
    back = {(r.usubjid, r.aeseq): (r.supp_qa, r.supp_qb) for r in sdtm.supp_rejoin(p, supp, "aeseq", ["qa", "qb"]).collect()}
    assert back == {("u1", 1): ("a", None), ("u1", 2): (None, "b"), ("u2", 1): (None, None)}


def test_baseline_change_windows(spark):
    d = lambda k: date(2020, 1, k)
    rows = [("u", "P", 10.0, d(1), d(3), 1.0, 20.0, 1), ("u", "P", 12.0, d(3), d(3), 1.0, 20.0, 2), ("u", "P", None, d(3), d(3), 1.0, 20.0, 3), ("u", "P", 30.0, d(5), d(3), 1.0, 20.0, 4), ("u", "Q", 0.0, d(2), d(3), 1.0, 20.0, 5), ("u", "Q", 5.0, d(9), d(3), 1.0, 20.0, 6)]
    df = spark.createDataFrame(rows, "usubjid string, paramcd string, aval double, adt date, trtsdt date, lo double, hi double, rec_id int")
    got = {r.rec_id: r for r in adam.bds(df, [(1, 10, "W1", 1), (5, 20, "W2", 2)]).collect()}
    assert [k for k, r in got.items() if r.ablfl == "Y"] == [2, 5] and {got[k].base for k in (1, 2, 3, 4)} == {12.0}
    assert got[4].chg == 18.0 and got[4].pchg == 150.0 and got[4].shift1 == "NH" and got[6].pchg is None and got[1].chg is None
    assert got[4].avisit == "W1" and got[6].avisit == "W2"
    locf = {r.rec_id: r.aval_locf for r in adam.locf(df, ["usubjid", "paramcd"], ["adt", "rec_id"]).collect()}
    assert locf[3] == 12.0


def test_survival(spark):
    times = [(1, 0, "a"), (2, 0, "a"), (2, 1, "a"), (3, 0, "a"), (1, 1, "b"), (4, 0, "b"), (5, 0, "b")]
    df = spark.createDataFrame(times, "aval int, cnsr int, g string")
    s = {(r.g, r.aval): r.surv for r in tfl.kaplan_meier(df, ["g"]).collect()}
    assert s["a", 1] == pytest.approx(0.75) and s["a", 2] == pytest.approx(0.5) and s["a", 3] == 0.0 and s["b", 4] == pytest.approx(0.5) and s["b", 5] == 0.0
    r = tfl.log_rank(df, [], "g", "a").first()
    e = v = 0.0
    for t in {x for x, c, _ in times if c == 0}:
        n, n1 = sum(x >= t for x, _, _ in times), sum(x >= t and g == "a" for x, _, g in times)
        k = sum(x == t and c == 0 for x, c, _ in times)
        e += k * n1 / n
        v += k * n1 / n * (1 - n1 / n) * (n - k) / (n - 1) if n > 1 else 0
    assert r.observed == 3 and r.expected == pytest.approx(e) and r.variance == pytest.approx(v)


def test_fisher_and_descriptive(spark):
    assert tfl.fisher_exact(3, 1, 1, 3) == pytest.approx(0.485714, abs=1e-6) and tfl.fisher_exact(8, 2, 1, 5) == pytest.approx(0.034965, abs=1e-6)
    d = tfl.descriptive(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0), ("b", None)], "g string, x double"), ["g"], "x")
    got = {r.g: (r.n, r["mean"], r.sd, r["median"]) for r in d.collect()}
    assert got["a"] == (1, 1.0, 0.0, 1.0) and got["b"] == (2, 2.0, pytest.approx(math.sqrt(2)), 2.0)


def test_frequency_has_zero_cells(spark):
    ev = spark.createDataFrame([("u1", "A", "x"), ("u1", "A", "x"), ("u2", "B", "y")], "usubjid string, arm string, pt string")
    su = spark.createDataFrame([("u1", "A"), ("u2", "B"), ("u3", "B")], "usubjid string, arm string")
    got = {(r.pt, r.arm): (r.n_subjects, r.n_records) for r in tfl.frequency(ev, su, ["pt"]).collect()}
    assert got == {("x", "A"): (1, 2), ("x", "B"): (0, 0), ("x", "Total"): (1, 2), ("y", "A"): (0, 0), ("y", "B"): (1, 1), ("y", "Total"): (1, 1)}


def test_compare_and_labels(spark):
    a = spark.createDataFrame([("p", 1.0), ("q", 2.0), ("r", None)], "k string, v double")
    b = spark.createDataFrame([("p", 1.0005), ("q", 3.0), ("s", 1.0), ("r", None)], "k string, v double")
    assert {r.k: r.status for r in tfl.compare(a, b, ["k"], "v", 0.001).collect()} == {"p": "match", "q": "differ", "r": "match", "s": "qc only"}
    x, y = (spark.createDataFrame([(s,) for s in v], "label string") for v in (["Mean (SD)", "Median", "Total"], ["Mean (SD)", "Medain", "Max"]))
    assert [tuple(r) for r in tfl.fuzzy_labels(x, y, "label", 2).collect()] == [("Median", "Medain", 2)]


def test_checks(spark):
    kinds = spark.createDataFrame([(v,) for v in ("2020", "2020-13", "2020-01-01T10:00:00Z", "P1Y2M", "P", "2020-01-01T10:00", "01JAN2020", None)], "v string").select(checks.iso_kind(F.col("v")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["date", None, "datetime", "duration", "duration", "partial datetime", None, None]
    found = checks.structure(["STUDYID", "DOMAIN", "SUBJID"], "DM")
    assert {v for r, _, v, _ in found if r == "SDTM-REQ-001"} == {"USUBJID", "SITEID", "ARM", "ARMCD"} and ("SDTM-002", "ERROR", "USUBJID", "subject key is absent") in found
    df = spark.createDataFrame([(1, "Y"), (2, "x"), (3, None)], "rec_id int, f string")
    bad = checks.rows(df, "t", [checks.Rule("CT", "ERROR", "ct", "f", checks.not_in_codelist(F.col("f"), "yn"), "m"), checks.Rule("MISS", "WARNING", "miss", "f", F.col("f").isNull(), "m")])
    assert sorted((r.rule_id, r.record) for r in bad.collect()) == [("CT", "2"), ("MISS", "3")]
    assert set(bad.columns) == {x.split()[0] for x in checks.ISSUES.split(", ")}
    q = {r.dataset: (r.score, r.passed) for r in checks.quality(bad, spark.createDataFrame([("t",), ("u",)], "dataset string")).collect()}
    assert q == {"t": (80, True), "u": (100, True)}


def test_graph(spark):
    order, stuck = graph.topological([("a", "b"), ("b", "c")], ["a", "b", "c"])
    assert (order, stuck) == (["a", "b", "c"], [])
    assert graph.topological([("a", "b"), ("b", "a"), ("b", "c")], ["a", "b", "c", "d"]) == (["d"], ["a", "b", "c"])
    h = spark.createDataFrame([("s", 2, 1), ("s", 1, 0), ("s", 3, 1)], "k string, t int, o int")
    w = 0.5
    for o in (0, 1, 1):
        w = w * 0.9 + o * 0.1
    assert graph.weights(h, ["k"], "t", "o").first().weight == pytest.approx(w)
    nodes = spark.createDataFrame([("protocol", 0), ("raw", 1), ("dm", 2)], "id string, layer int")
    edges = spark.createDataFrame([("protocol", "raw", "requires"), ("raw", "dm", "requires"), ("dm", "protocol", "enables")], "from_id string, to_id string, edge_type string")
    none = spark.createDataFrame([], "id string")
    assert {r.id for r in graph.frontier(nodes, edges, none).collect()} == {"protocol"}


def test_cycles_against_the_drivers_order(spark):
    import random

    rng = random.Random(4)
    for n_edges in (0, 12, 20, 45):
        ids = [f"n{i}" for i in range(20)]
        pairs = [(rng.choice(ids), rng.choice([*ids, "ghost"])) for _ in range(n_edges)]
        e = spark.createDataFrame([(a, b, "requires") for a, b in pairs], "from_id string, to_id string, edge_type string")
        found = {r.id for r in graph.stuck(spark.createDataFrame([(i,) for i in ids], "id string"), e).collect()}
        assert found == set(graph.topological(set(pairs), ids)[1])


def test_moving_average_of_a_long_history(spark):
    rows = [("k", i, int(i * 7919 % 3 == 0)) for i in range(1000)] + [(None, 1, 1)]
    w = 0.5
    for _, _, o in rows[:-1]:
        w = w * 0.9 + o * 0.1
    got = {r.k: r.weight for r in graph.weights(spark.createDataFrame(rows, "k string, t int, o int"), ["k"], "t", "o").collect()}
    assert got["k"] == pytest.approx(w, abs=1e-12) and got[None] == pytest.approx(0.55)


def test_schedule_against_a_loop(spark):
    import random

    rng = random.Random(8)
    items = [(rng.choice("gh"), f"i{k:02d}", rng.choice((0.2, 0.5, 1.0)), rng.randrange(1, 500), rng.random() < 0.3) for k in range(60)]
    want = {}
    for g in "gh":
        used = 0
        for _, name, _, t, current in sorted((i for i in items if i[0] == g), key=lambda i: (-i[2], i[1])):
            left = 1000 - used
            if left > 0 and t <= left:
                give, status = (250, "truncated") if t > 250 and not current else (t, "loaded")
            else:
                give, status = (left, "truncated") if left >= 100 else (0, "dropped")
            used += give
            want[g, name] = (give, status)
    out = graph.schedule(spark.createDataFrame(items, "grp string, name string, priority double, tokens int, current boolean"), 1000)
    assert {(r.grp, r.name): (r.given, r.status) for r in out.collect()} == want


def test_ranks_of_groups_split_by_buckets(spark):
    import random

    from vitaline.operators import ranks

    rng = random.Random(2)
    rows = [(rng.choice(("a", "a", "a", "b", None)), rng.choice((None, "2020-01-01", "2020-01-02T10", "2020-01-02", "2021")), k, rng.choice((None, float(k)))) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, d string, k long, v double")
    got = {r.k: (r.rank, r.last) for r in ranks.carried(ranks.ranked(df, ["g"], ["d", "k"], F.substring("d", 1, 10)), ["g"], ["d", "k"], F.substring("d", 1, 10), "v", "last").collect()}
    for g in ("a", "b", None):
        last = None
        for i, (_, _, k, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or "", r[2])), 1):
            last = v if v is not None else last
            assert got[k] == (i, last)
    assert ranks.ranked(df.limit(0), ["g"], ["d", "k"], F.col("d")).count() == 0


def test_completed_years(spark):
    from vitaline.operators import sdtm

    days = [("2000-02-29", "2001-02-28", 0), ("2000-02-29", "2001-03-01", 1), ("1999-12-31", "2000-12-30", 0), ("1999-12-31", "2000-12-31", 1), (None, "2000-01-01", None)]
    df = spark.createDataFrame(days, "b string, r string, want int").select(sdtm.age_at(F.col("b").cast("date"), F.col("r").cast("date")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_phrases_as_whole_words(spark):
    texts = ["The committee supports a safe design", "in the modified intent-to-treat set", "ITT and per-protocol", "Fisher's exact test, then ANOVA", "analysis of covariance", "KM", "kmart", None, "", "the t-test", "Safety  set"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.method(F.col("t")).alias("m"), text.population(F.col("t")).alias("p"))
    assert [tuple(r) for r in df.collect()] == [
        ("Descriptive", "ITT"), ("Descriptive", "mITT"), ("Descriptive", "ITT"), ("Fisher", "ITT"), ("ANCOVA", "ITT"), ("Kaplan-Meier", "ITT"), ("Descriptive", "ITT"),
        ("Descriptive", "ITT"), ("Descriptive", "ITT"), ("t-test", "ITT"), ("Descriptive", "SAF"),
    ]


def test_study_and_lists(spark):
    plan = "Study Number: AB-1234\nPhase III\nPrimary endpoints:\n1. Change from baseline in score. ANCOVA in the ITT set\n2. short\nSecondary endpoints:\n- Time to first event by log-rank test\n- Responder rate in the per-protocol set by CMH\nStatistical methods\n"
    df = spark.createDataFrame([(1, plan), (2, "see ST001 and ST000123, phase 2b"), (3, None), (4, "")], "doc_id long, text string")
    assert [tuple(r) for r in text.study(df).orderBy("doc_id").collect()] == [(1, "AB-1234", "3"), (2, "ST000123", "2b"), (3, "UNKNOWN", "Unknown"), (4, "UNKNOWN", "Unknown")]
    assert [tuple(r)[1:] for r in text.endpoints(df).collect()] == [
        ("primary", "EP001", "Change from baseline in score", "ANCOVA", "ITT"), ("secondary", "EP_S01", "Time to first event by log-rank test", "Log-rank", "ITT"),
        ("secondary", "EP_S02", "Responder rate in the per-protocol set by CMH", "CMH", "PP"),
    ]


def test_text(spark):
    r = spark.createDataFrame([("x" * 30, None)], "t string, n string").select(text.cut_text(F.col("t"), 5).alias("c"), text.token_estimate(F.col("n")).alias("k"), text.display_date(F.lit(date(2020, 3, 5))).alias("d"), text.display_date(F.lit(None).cast("date")).alias("m")).first()
    assert tuple(r) == ("xxxxx...", 1, "05MAR2020", "NK")


def test_subject_level_invariants(spark):
    d = "/root/testdata/sf0.001"
    s = fixtures.subjects(spark, d).cache()
    assert s.count() == fixtures.live_dm(spark, d).count() == s.select("usubjid").distinct().count()
    assert s.where("saffl = 'Y' and cumdose is null").count() == 0 and s.where("trtedt < trtsdt").count() == s.where("trtdurd < 1").count()


def test_package_and_checklist(spark):
    files = spark.createDataFrame([("dm.xpt", 10), ("Bad Name.xpt", 0)], "name string, bytes long")
    assert sorted((r.rule_id, r.record) for r in checks.file_rules(files).collect()) == [("NAME-001", "Bad Name.xpt"), ("STRUCT-001", "Bad Name.xpt")]
    r = checks.readiness(spark.createDataFrame([("DATA", True), ("DATA", False)], "g string, ok boolean"), "g", "ok").first()
    assert (r["items"], r.complete, r.pct) == (2, 1, 50.0)
    s = one(spark, {"y": sdtm.seriousness(F.col("a"), F.col("b")), "n": sdtm.seriousness(F.col("b")), "v": sdtm.to_standard(F.lit(2.0), F.col("u"), {"lb": 0.5}), "z": sdtm.to_standard(F.lit(2.0), F.col("b"), {"lb": 0.5})}, a="y", b=None, u=" LB ")
    assert (s.y, s.n, s.v, s.z) == ("Y", "N", 1.0, None)
