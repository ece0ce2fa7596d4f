from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from vitaline.llm import packing, tokens


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 60), max_size=15))
def test_patterns_hold_the_histogram(h):
    ps = packing.shortest_pack_first(h, 30)
    held = Counter()
    for p in ps:
        assert sum(n * k for n, k in p.holds.items()) == 30 - p.free >= 0
        for n, k in p.holds.items():
            held[n] += k * p.count
    assert held == Counter(h)
    packs, load = sum(p.count for p in ps), sum(n * k for n, k in h.items())
    assert packs <= 2 * -(-load // 30) + 1  # all packs but one are at least half full


def test_packs_are_within_capacity_and_whole(spark):
    rows = [(i, n) for i, n in enumerate([0, 1, 3, 3, 3, 10, 11, 25, 7, 7, 2, 10, 1, 1, 1, 5] + [4] * 400)]
    sized = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    out = packing.pack(sized, [(1, 10), (2, 16)], buckets=7, block=16).collect()
    for pid, cap in ((1, 10), (2, 16)):
        mine = [r for r in out if r.pack_id == pid]
        total, packs, parts = Counter(), Counter(), Counter()
        for r in mine:
            total[r.doc_id] += r.n_tokens
            parts[r.doc_id] += 1
            if r.pack_no is not None:
                packs[r.pack_no] += r.n_tokens
        assert dict(total) == dict(rows)
        assert max(packs.values()) <= cap and sorted(packs) == list(range(len(packs)))
        assert all(k == max(1, -(-dict(rows)[d] // cap)) for d, k in parts.items())
        assert [r.doc_id for r in mine if r.pack_no is None] == [0]
        assert sum(packs.values()) / (len(packs) * cap) > 0.75
    again = packing.pack(sized, [(1, 10), (2, 16)], buckets=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_empty(spark):
    sized = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(sized, [(1, 10)]).collect() == []


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "x " * 20000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(df).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] >= 20000
