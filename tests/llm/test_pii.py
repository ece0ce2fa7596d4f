import itertools

import numpy as np
import pytest

from vitaline.llm import crf, pii, pii_labels, pii_train

TEXT = (
    "Dr. Zoltana Falombe-Ostertz asked for kit 123456. Contact: Ulmlisse, Meilin, +1 415 555 0199, meilin.x (at) uk-osten.example. "
    "Home visit took place at 2211 N. Sycamore Run Blvd Suite 210, Grindle Bay, ZZ 00502. The Ostertz index was 81. "
    "Uploaded scan shows SSN 961-27-2014 in clear text. Subject ST001503-019-000029 has Parkinson's disease. Castellum Research agreed."
)


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.load_model())


def test_passages(tagger):
    found = [(k, TEXT[a:b]) for k, a, b in tagger.tag([TEXT])[0]]
    assert found == [
        ("name", "Zoltana Falombe-Ostertz"), ("name", "Ulmlisse, Meilin"), ("phone", "+1 415 555 0199"), ("email", "meilin.x (at) uk-osten.example"),
        ("address", "2211 N. Sycamore Run Blvd Suite 210, Grindle Bay, ZZ 00502"), ("id_no", "961-27-2014"),
    ]


def test_edge_texts(tagger):
    long = "The value was complete. " * 3000 + "Signed: Keiko Halvanne"
    assert tagger.tag([None, "", " \n", "x"]) == [[], [], [], []]
    (k, a, b), = tagger.tag([long])[0]
    assert (k, long[a:b]) == ("name", "Keiko Halvanne")
    assert tagger.tag([TEXT] * 3) == [tagger.tag([TEXT])[0]] * 3


def test_frame(spark):
    df = spark.createDataFrame([(1, TEXT, 7), (2, None, 8), (3, "", 9), (1, TEXT, 7)], "doc_id long, text string, kind int")
    found = pii.find(df).collect()
    assert len(found) == 12 and all(TEXT[r.start_pos : r.end_pos] for r in found)
    red = {r.doc_id: r for r in pii.redact(df).collect()}
    assert red[2].text is None and red[3].text == "" and red[1].n_found == 6
    assert red[1].text.startswith("Dr. [NAME] asked for kit 123456. Contact: [NAME], [PHONE], [EMAIL]. Home visit took place at [ADDRESS]. The Ostertz index")
    assert pii.find(df.limit(0)).collect() == []


def test_unknown_names_by_context(tagger):
    t = "The pharmacist on duty, Bertil Gorvek, repacked kit 222409."
    assert [(k, t[a:b]) for k, a, b in tagger.tag([t])[0]] == [("name", "Bertil Gorvek")]


def _brute(node, trans):
    paths = {}
    for p in itertools.product(range(crf.N_LABELS), repeat=len(node)):
        paths[p] = node[range(len(node)), p].sum() + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False)) + crf.STARTS[p[0]]
    return paths


def test_chain_inference_against_enumeration():
    rng = np.random.default_rng(3)
    trans = rng.normal(size=(crf.N_LABELS,) * 2) + crf.allowed_transitions()
    for n in (1, 2, 3):
        node = rng.normal(size=(n, crf.N_LABELS)) * 2
        paths = _brute(node, trans)
        padded = np.concatenate([node, np.zeros((4 - n, crf.N_LABELS))])[None]
        f, b, z = crf.marginals(padded, trans, np.array([n]))
        top = max(paths.values())
        log_z = top + np.log(sum(np.exp(v - top) for v in paths.values()))
        assert abs(z[0] - log_z) < 1e-6
        for i in range(n):
            exact = np.array([sum(np.exp(v - log_z) for p, v in paths.items() if p[i] == y) for y in range(crf.N_LABELS)])
            assert np.allclose(np.exp(f[0, i] + b[0, i] - z[0]), exact, atol=1e-6)
        assert tuple(crf.best(padded, trans, np.array([n]))[0, :n]) == max(paths, key=paths.get)


def test_skip_edges_bring_repeated_words_together():
    trans = crf.allowed_transitions().astype(float)
    node = np.full((12, crf.N_LABELS), -9.0)
    node[:, 0] = 0.0
    name = crf.LABELS.index("B-name")
    node[0, name], node[4, name], node[8, name], node[10, name] = 6.0, -0.9, -9.0, -0.9
    doc, word = np.zeros(12, dtype=int), np.array([1, -1, -1, -1, 1, -1, -1, -1, 1, -1, 2, -1])
    alone, linked = np.zeros(6), np.array([0.25, 0, 0, 0, 0, 1.5])
    assert np.flatnonzero(crf.decode(node, trans, doc, word, alone)).tolist() == [0]
    # the second mention follows the first; one whose own score is far outside stays, and so does another word
    assert np.flatnonzero(crf.decode(node, trans, doc, word, linked)).tolist() == [0, 4]
    # however far outside, every mention of a linked word is looked at
    assert np.flatnonzero(crf.decode(node, trans, doc, word, linked * 10)).tolist() == [0, 4, 8]


def test_edges_reach_every_mention_in_one_step():
    gain = np.array([-1.0, -2.0, 5.0, -3.0, -1.0, 0.0])
    left, right = crf.skip_edges(gain, np.array([0, 0, 0, 0, 0, 1]), np.array([7, 7, 7, 7, 7, 7]))
    assert {frozenset(e) for e in zip(left.tolist(), right.tolist(), strict=True)} == {frozenset(e) for e in ((0, 1), (1, 2), (2, 3), (3, 4), (2, 0), (2, 4))}


def test_similar_words_are_linked():
    assert pii.link_key("OKONKWO") == pii.link_key("Okonkwo") == pii.link_key("Okonkwos")
    assert pii.link_key("Müller") == pii.link_key("MULLER")
    assert pii.link_key("okonkwo") is pii.link_key("Al") is pii.link_key("A1b") is None


def test_second_mention_needs_the_skip_chain(tagger):
    text = "Dr. Jane Okonkwo signed the page on 2021-05-04. Okonkwo confirmed the event."
    alone = pii.Tagger(pii.load_model() | {"skip": {"O": 0.0, "name": 0.0}})
    assert [text[a:b] for _, a, b in tagger.tag([text])[0]] == ["Jane Okonkwo", "Okonkwo"]
    assert [text[a:b] for _, a, b in alone.tag([text])[0]] == ["Jane Okonkwo"]


def test_eponyms_do_not_hide_a_person(tagger):
    text = "Dr Jane Okonkwo signed the page. The Okonkwo score was 12."
    assert [text[a:b] for _, a, b in tagger.tag([text])[0]] == ["Jane Okonkwo"]


def test_blocks_and_neighbours_change_nothing(tagger):
    texts = [TEXT, "", None, "A\x00B " + TEXT, "Signed: Keiko Halvanne", "Halvanne", TEXT.replace("Ostertz", "Ôstertz")] * 3
    one_by_one = [tagger.tag([t])[0] for t in texts]
    assert tagger.tag(texts) == one_by_one
    small = pii.Tagger(pii.load_model())
    assert [small.tag([t])[0] for t in texts] == one_by_one


def test_rules_harvest_names_without_lists():
    texts = ["Dr. Jane Okonkwo called. Mr. Okonkwo agreed.", "Mrs. Jane Bellweather and Okonkwo, Jane signed.", "Prof. Adebayo Bellweather left; The Okonkwo index was 3.", "Dr. Adebayo Okonkwo and OKONKWO Jane came."]
    lex = pii_labels.harvest(texts)
    assert lex.given == {"Jane", "Adebayo"} and lex.family == {"Okonkwo", "Bellweather"}
    found = [[(k, t[a:b]) for k, a, b in pii_labels.label(t, lex)] for t in texts]
    assert found[0] == [("name", "Jane Okonkwo"), ("name", "Okonkwo")] and found[2] == [("name", "Adebayo Bellweather")] and found[3][1] == ("name", "OKONKWO Jane")
    got = pii_labels.label("Call +44 20 7000 1234, lot 123 456 789. SSN: 123-45-6789; 12 High Street, Oldtown AB1 2CD", lex)
    assert [k for k, _, _ in got] == ["phone", "id_no", "address"]


def test_replacements_keep_passages_in_place():
    text, found = pii_train.replaced("The monitor met Jane Roe at 5.", [("name", 16, 24)], [(0, 11, "Roe", True), (16, 20, "Bamira", False)])
    assert text == "Roe met Bamira Roe at 5." and [text[a:b] for _, a, b in found] == ["Roe", "Bamira Roe"]
