import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from vitaline.llm import mixing
from vitaline.llm.mixing import Target


def test_shares_and_repeats(spark):
    rows = [(i, 50 + i % 7, ["big"]) for i in range(3000)] + [(9000 + i, 40, ["small"]) for i in range(50)] + [(9900, 10, ["none"]), (9901, 0, ["big"]), (9902, 5, None), (9903, 5, [None])]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, sources array<string>")
    targets = [Target("big", 0.8, 1), Target("small", 0.2, 3)]
    out = mixing.mix(df, targets, buckets=16)
    got = {r.source: r for r in mixing.shares(out, targets).collect()}
    assert abs(got["small"].share - 0.2) < 0.01 and got["small"].most_uses == 3 and got["big"].most_uses == 1
    assert got["small"].tokens == 3 * 50 * 40
    assert {r.doc_id for r in out.collect()}.isdisjoint({9900, 9901, 9902, 9903})


def test_overlapping_sources(spark):
    rows = [(i, 10, ["a", "b"]) for i in range(100)] + [(1000 + i, 10, ["a"]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, sources array<string>")
    targets = [Target("a", 0.5, 1), Target("b", 0.5, 1)]
    out = mixing.mix(df, targets, buckets=4).collect()
    total = {s: sum(r.n_tokens * r.uses for r in out if r.source == s) for s in "ab"}
    assert abs(total["a"] - total["b"]) <= 20 and sum(total.values()) >= 1180
    assert max(r.uses for r in out) == 1


def test_missing_source_and_empty(spark):
    df = spark.createDataFrame([(1, 10, ["a"])], "doc_id long, n_tokens long, sources array<string>")
    assert mixing.mix(df, [Target("a", 0.5, 1), Target("z", 0.5, 1)]).collect() == []
    out = mixing.mix(df, [Target("a", 0.5, 1), Target("z", 0.5, 1)], total=20).collect()
    assert [(r.source, r.uses) for r in out] == [("a", 1)]
    assert mixing.mix(df.limit(0), [Target("a", 1.0, 1)]).collect() == []


def test_texts_of_several_sources_are_one_document(spark):
    rows = [(1, "a", 10, "x"), (2, "b", 10, "x"), (3, "b", 10, "x"), (4, "a", 7, "y"), (5, "a", 7, "y"), (6, None, 7, "y"), (7, "b", 0, "z"), (8, "c", 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, text_key string")
    got = {r.doc_id: (r.n_tokens, r.sources, r.ids) for r in mixing.by_text(df).collect()}
    assert got == {1: (10, ["a", "b"], {"a": 1, "b": 2}), 4: (7, ["a"], {"a": 4}), 8: (3, ["c"], {"c": 8})}
    docs = [(i, "ab"[i % 2], 10, f"t{i // 2}") for i in range(400)] + [(1000 + i, "a", 10, f"u{i}") for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, text_key string")
    targets = [Target("a", 0.5, 1), Target("b", 0.5, 1)]
    out = mixing.mix(mixing.by_text(df), targets).collect()
    key = {d: k for d, _, _, k in docs}
    uses = {}
    for r in out:
        assert dict((d, s) for d, s, *_ in docs)[r.doc_id] == r.source
        uses[key[r.doc_id]] = uses.get(key[r.doc_id], 0) + r.uses
    # a text in the middle of the line may be cut by the border of two sources, all others are used once
    assert sum(n > 1 for n in uses.values()) <= 1 and sum(r.n_tokens * r.uses for r in out) >= 2980


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "b", "c")]), st.integers(1, 60)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.tuples(*[st.integers(1, 3)] * 3))
def test_largest_total_against_trying_all(patterns, repeats):
    targets = [Target("a", 0.5, repeats[0]), Target("b", 0.25, repeats[1]), Target("c", 0.25, repeats[2])]

    def met(total):
        return mixing.route(patterns, targets, total)[1] == sum(int(t.share * total) for t in targets)

    got = mixing.largest_total(patterns, targets)
    assert met(got)
    assert not any(met(total) for total in range(got + 12, sum(n for _, n in patterns) * 3 + 12))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([("a",), ("b",), ("a", "b")]), st.integers(1, 6)), min_size=1, max_size=3, unique_by=lambda x: x[0]), st.integers(1, 12))
def test_flow_is_largest_and_cheapest(patterns, total):
    targets = [Target("a", 0.5, 2), Target("b", 0.5, 1)]
    flows, sent = mixing.route(patterns, targets, total)
    quota = {t.source: int(t.share * total) for t in targets}

    def cost(used, n):
        return sum(min(max(used - n * (r - 1), 0), n) * r * r for r in range(1, 4))

    def value(f):
        return sum(f.values()), -sum(cost(sum(v for (k, _), v in f.items() if k == i), n) for i, (_, n) in enumerate(patterns))

    edges = [(i, s, n * dict((t.source, t.max_repeats) for t in targets)[s]) for i, (m, n) in enumerate(patterns) for s in m]
    best = None
    for xs in itertools.product(*[range(min(c, quota[s]) + 1) for _, s, c in edges]):
        f = {(i, s): x for (i, s, _), x in zip(edges, xs, strict=True)}
        if any(sum(v for (_, t), v in f.items() if t == s) > q for s, q in quota.items()):
            continue
        if any(sum(v for (k, _), v in f.items() if k == i) > n * max(2 if s == "a" else 1 for s in m) for i, (m, n) in enumerate(patterns)):
            continue
        best = max(best or (-1, 0), value(f))
    assert (sent, value(flows)[1]) == best
