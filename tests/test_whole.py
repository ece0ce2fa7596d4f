"""Registered queries and operators over whole tables, compared with plain Python or counted in the tables."""

import re

import duckdb

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def test_text_queries_read_every_document(spark):
    q = entry.queries()
    docs = dict(duckdb.sql(f"select doc_id, text from '{D}/documents.parquet'").fetchall())
    shells = {(i, k.lower(), n) for i, t in docs.items() for k, n in re.findall(r"(?i)\b(table|figure|listing)\s+(\d+(?:\.\d+)*)\s*[:\-–]\s*[^\s]", t)}
    found = q["text_shells"](spark, D).collect()
    assert {(r.doc_id, r.kind, r.number) for r in found} == shells and shells
    ends = q["text_endpoints"](spark, D).collect()
    named = {(i, k) for i, t in docs.items() for k in ("primary", "secondary") if re.search(rf"(?i){k} endpoint", t)}
    assert {(r.doc_id, r.kind) for r in ends} == named and named
    assert {r.doc_id for r in q["text_study"](spark, D).collect()} == set(docs)
    assert {r.doc_id for r in q["text_arms"](spark, D).collect()} == set(docs)


def test_every_section_and_shell_of_a_line(spark):
    from vitaline.operators import text

    docs = spark.createDataFrame([(1, "The primary endpoint is survival at Week 4. 10.8 The primary endpoint is rescue doses. Table 1.1: One. Table 1.2: Two.")], "doc_id long, text string")
    assert [r.name for r in text.endpoints(docs).collect()] == ["is survival at Week 4", "is rescue doses"]
    assert [(r.number, r.title) for r in text.shells(docs).collect()] == [("1.1", "One."), ("1.2", "Two.")]


def test_findings_of_every_test_and_lineitem(spark):
    q = entry.queries()
    tests = duckdb.sql(f"select vstestcd, count(*) from '{D}/vs.parquet' group by 1").fetchall()
    assert len(tests) == 8
    assert sorted(q["adam_adlb"](spark, D).groupBy("paramcd").count().collect()) == sorted(tests)
    assert q["adam_derived_records"](spark, D).select("paramcd").distinct().count() == 8
    assert q["sdtm_lb"](spark, D).count() == duckdb.sql(f"select count(*) from '{D}/lineitem.parquet'").fetchall()[0][0]


def test_fuzzy_labels_meet_whatever_their_first_letters(spark):
    import random

    from vitaline.operators import tfl

    rnd = random.Random(5)

    def typo(w):
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(w) + 1)
            w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("ABÉ") + w[i:], w[:i] + rnd.choice("ABÉ") + w[i + 1 :]])
        return w

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    right = {"VOMITING", "TACHYCARDIA", "SYNCOPE", "A", "AB", "BA", "FEVER", "FEVERS"}
    left = {typo(rnd.choice(sorted(right))) for _ in range(200)} | {"VAMITING", "TCHYCARDIA"}
    df = [spark.createDataFrame([(x,) for x in sorted(s)], "label string") for s in (left, right)]
    want = {(x, *min((distance(x, y), y) for y in right)[::-1]) for x in left - right}
    assert {tuple(r) for r in tfl.fuzzy_labels(*df, "label", 2).collect()} == {w for w in want if w[2] <= 2}


def test_profile_shows_violations_and_share_changes_of_every_column(spark):
    from vitaline.plans import problems

    rows = entry.queries()["p3_profile"](spark, D).collect()
    got = {(r.tab, r["col"], r.load_no): r for r in rows}
    for (tab, col, load), r in got.items():
        if col in problems.PATTERNS[tab] and r.n_missing < r.n_rows:
            assert r.n_violations is not None, (tab, col, load)
    for tab, col in (("dm", "sex"), ("dm", "race"), ("adsl", "ethnic"), ("ae", "aeout")):
        counts = {}
        for load, v, n in duckdb.sql(f"select load_no, {col}, count(*) from '{D}/{tab}.parquet' where load_no is not null and trim({col}) <> '' group by 1, 2").fetchall():
            counts.setdefault(load, {})[v] = n
        loads = sorted({k[2] for k in got if k[:2] == (tab, col)})
        for was, now in zip(loads, loads[1:], strict=False):
            a, b = counts.get(was), counts.get(now)
            want = a and b and sum(abs(b.get(v, 0) / sum(b.values()) - a.get(v, 0) / sum(a.values())) for v in a | b) / 2
            have = got[tab, col, now].share_diff
            assert (have is None and not want) or abs(have - want) < 2e-6
        assert got[tab, col, loads[0]].share_diff is None


def test_profile_sums_of_integers_are_exact(spark):
    from vitaline.operators import profile

    df = spark.createDataFrame([(0, 10**15 + 1), (0, 10**15 + 2), (0, 10**15 + 3), (1, 2**62), (1, 2**62)], "load_no int, n long")
    assert [r.sd for r in profile.profile(df, "t").orderBy("load_no").collect()] == [1.0, 0.0]


def test_vector_search_of_every_query(spark):
    import math

    vec = dict(duckdb.sql(f"select vec_id, embedding::double[] from '{D}/embeddings.parquet'").fetchall())
    got = {}
    for r in entry.queries()["graph_similar"](spark, D).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = {i for i in vec if i % 100 == 0}
    assert set(got) == want and len(want) > 1
    for i in want:
        score = {j: math.sumprod(vec[i], v) / math.hypot(*vec[i]) / math.hypot(*v) for j, v in vec.items()}
        best = sorted((j for j in score if score[j] >= 0.1), key=lambda j: (-score[j], j))[:10]
        assert [j for _, j in sorted(got[i])] == best


def test_transport_file_refuses_what_it_would_cut(spark, tmp_path):
    import pytest

    from vitaline.sources import xport

    path = str(tmp_path / "a.xpt")
    df = spark.createDataFrame([("é" * 100, 1.0), (None, 2.0)], "t string, n double")
    xport.write(df, path)
    assert [r[0] for r in xport.read(spark, path).collect()] == ["é" * 100, None]
    with pytest.raises(ValueError, match="t has 201"):
        xport.write(spark.createDataFrame([("é" * 100 + "x", 1.0)], "t string, n double"), str(tmp_path / "b.xpt"))
    assert not (tmp_path / "b.xpt").exists()
