from hypothesis import given, settings
from hypothesis import strategies as st

from vitaline.llm import terms

TERMS = [("sex", 1, "M", "male|1"), ("sex", 2, "F", None), ("ae", 10, "Headache", "head pain"), ("ae", 11, "Migraine", "sick headache"), ("ae", 12, "Hypotension", "low blood pressure"), ("ae", 13, "Diarrhoea", "the runs"), ("ae", None, "x", ""), (None, 5, "y", "")]


def brute_distance(a: str, b: str) -> int:
    """Unrestricted edit distance with swaps, by the textbook recurrence over all earlier positions."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            for k in range(1, i):
                for m in range(1, j):
                    if a[k - 1] == b[j - 1] and a[i - 1] == b[m - 1]:
                        d[i, j] = min(d[i, j], d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
    return d[len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_edit_distance_against_brute_force(a, b):
    assert terms.edit_distance(a, b, 2) == min(3, brute_distance(a, b))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abcd", min_size=4, max_size=9), min_size=1, max_size=12), st.text("abcd", min_size=1, max_size=10))
def test_deletion_index_finds_every_near_word(words, token):
    found = {w for w, _ in terms.Vocabulary(words).nearest(token)}
    near = {w for w in words if brute_distance(token, w) <= terms.allowed_edits(len(w))}
    assert found == ({token} if token in words else near)


def codes(spark, rows, entries=TERMS):
    r = spark.createDataFrame(rows, "field string, rec_id long, value string")
    t = spark.createDataFrame(entries, "codelist string, code int, term string, aliases string")
    return sorted(tuple(x) for x in terms.match_terms(r, t).collect())


def test_values(spark):
    rows = [("ae", i, v) for i, v in enumerate([
        "Headache", "headache", "HEADAHCE.", "severe headache, resolved", "sick headache", "pain, head", "LO WBLOOD PRESSURE", "hypotenosn",
        None, "  ", "--", "missed the bus to visit 8", "kit 9 left outside", "head", "x" * 5000 + " headache", "headache",
    ])]
    got = {i: c for _, i, c in codes(spark, rows)}
    assert got == {1: 10, 2: 10, 3: 10, 4: 11, 5: 10, 6: 12, 7: 12, 10: -1, 11: -1, 12: -1, 13: -1, 14: 10, 15: 10}


def test_field_context_and_empty(spark):
    assert codes(spark, [("sex", 1, "1"), ("sex", 2, "m"), ("sex", 3, "headache"), ("other", 4, "m"), (None, 5, "m")]) == [("other", 4, -1), ("sex", 1, 1), ("sex", 2, 1), ("sex", 3, -1)]
    assert codes(spark, []) == []
    assert codes(spark, [("ae", 1, "Headache")], []) == [("ae", 1, -1)]


def test_runs_of_any_number_of_tokens(spark):
    entries = [("ae", 1, "Constipation", None), ("ae", 2, "Redness at injection site", None), ("ae", 3, "Neck pain", None)]
    values = ["c o n s t i p a t i o n", "c o n s t i p a t i o n at night", "redness at injec tion site NOS", "red ness at injec tion site NOS", "neckpain after dosing", "a " * 3000 + "neck pain", "no pain"]
    assert [c for _, _, c in codes(spark, [("ae", i, v) for i, v in enumerate(values)], entries)] == [1, 1, 2, 2, 3, 3, -1]


def test_heavy_values_come_out_as_the_others(spark):
    rows = [("ae", i, "headahce" if i % 3 else f"value {i}") for i in range(60)] + [("ae", 100 + i, "hypotenosn") for i in range(5)]
    r = spark.createDataFrame(rows, "field string, rec_id long, value string")
    t = spark.createDataFrame(TERMS, "codelist string, code int, term string, aliases string")
    want = sorted((f, i, 10 if v == "headahce" else 12 if v == "hypotenosn" else -1) for f, i, v in rows)
    for share in (1.0, 0.3, 0.0):
        assert sorted(tuple(x) for x in terms.match_terms(r, t, share).collect()) == want
