import numpy as np
import pytest

from folioworks.llm.personal import SKIP, find_personal, fit, graph, infer, mentions, redact

GIVEN, FAMILY = ["Abrin", "Corsa", "Haldis"], ["Aldermoss", "Varbeck", "Wexholm"]
SEEN = ["signed, Abrin Varbeck", "reported by Corsa Wexholm", "my contact is Haldis Aldermoss", "interview with Ms. Corsa Varbeck is planned", "Mr. Aldermoss opened the attachment"]
PLAIN = ["the drill for Pellic Mail moves to Vesper Harbor after lunch", "nobody at Vesper Harbor can confirm the drill for Pellic Mail"]


@pytest.fixture(scope="module")
def model():
    return fit(SEEN * 30 + PLAIN * 60 + ["hash prefix 4155550151 is not in the feed", "ring +1 303 555 0108 for the keys"] * 40, GIVEN, FAMILY)


CASES = {
    "mail ‹zelby.x+a@mail.dunmoor.example› with it": "email", "‹a_b [at] calmere [dot] example› wrote": "email", "<‹n dot c at ops dot internal›> after": "email",
    "mailto:‹x@y.test› was": "email", "tel:‹(415) 555‑0199› is": "phone", "ring ‹0044 1632 960 883› now": "phone", "‹five five five zero one nine five› rang": "phone",
    "call ‹617 555-0101 ext. 116› now": "phone", "ring ‹4155550138› for the keys": "phone", "+44 is ‹+44 (0)20 7946 0687›": "phone", "employee no. ‹241465› must": "id_number",
    "lists ‹EMP-53558› in": "id_number", "national ID ‹964-69-4478›": "id_number", "driving licence ‹DK 104 387 96› in": "id_number", "| passport ‹L5912611› |": "id_number",
    "tax number ‹12.345.678-9› at": "id_number", "near ‹161A Windlass Court, Apt 30› on": "address", "at ‹9, rue Saint Orin, Tollgate›": "address",
    "at ‹Calderstrasse 80, 41902 East Quillon› behind": "address", "‹92 TANNERY STREET›": "address", "at ‹142 Lindholt Court›. Abc": "address",
    "signed, ‹VARBECK, Corsa›.": "name", "of ‹corsa varbeck› was": "name", "Dr. ‹Jastrowe› opened": "name", "Capt. ‹E. Crundale› opened": "name", "‹D. Wexholm›": "name",
    "‹Abrin K. Wexholm›'s laptop": "name", "signed, ‹Torbet Umberlind›": "name",
}


@pytest.mark.parametrize("case", CASES)
def test_mentions(model, case):
    text = case.replace("‹", "").replace("›", "")
    a = case.index("‹")
    assert mentions([text], model)[0] == [(CASES[case], a, case.index("›") - 1)]


@pytest.mark.parametrize(
    "text",
    [
        "part number 417-82-9034 is back", "hash prefix 4155550186 is not in the feed", "lane 3 dropped 2,004,155,566 bytes", "build 20265900 shipped", "relaykit@7.4.1 is", "see INC-919248",
        "redis://svc:33544x@edge-gw-10/0", "points at https://cdn-plume.example/@news/415", "@greyowl posted", "traffic to 198.51.100.233", "the Street Court exercise runs for 18 days",
        "rack 14 drive 20 failed on 2026-04-11", *PLAIN, "", "CVE-2024-95712",
    ],
)
def test_others_are_left_alone(model, text):
    assert mentions([text], model) == [[]]


def test_redaction_keeps_the_rest(model):
    text = "Dr. Varbeck (EMP-5512) lives at 9 Gannet Lane; mail x@y.test."
    assert redact(text, mentions([text], model)[0]) == "Dr. [NAME] ([ID_NUMBER]) lives at [ADDRESS]; mail [EMAIL]."


def test_message_passing_against_brute_force():
    from itertools import product

    from folioworks.llm.personal import _CHAIN, _LINK

    rng = np.random.default_rng(4)
    for _ in range(20):
        unary = rng.normal(0, 3, (4, 6))
        chain, links = np.array([[0, 1], [2, 3]]), np.array([[1, 2]])
        best = max(product(range(6), repeat=4), key=lambda y: sum(unary[i, y[i]] for i in range(4)) + sum(_CHAIN[y[a], y[b]] for a, b in chain) + sum(_LINK[y[a], y[b]] for a, b in links))
        assert tuple(infer(unary, chain, links, 40)) == best  # a tree, so the result is exact


def test_linked_tokens_agree():
    sure, weak = np.array([0.0, -9, -9, -9, -9, 4]), np.array([0.0, -9, -9, -9, -9, -SKIP / 2])
    none = np.zeros((0, 2), np.int64)
    assert list(infer(np.array([sure, weak]), none, none)) == [5, 0]
    assert list(infer(np.array([sure, weak]), none, np.array([[0, 1]]))) == [5, 5]


def test_similar_tokens_are_linked(model):
    def pairs(text):
        g = graph([text], model)
        return {(g.tokens[0].text[g.where[a][1]], g.tokens[0].text[g.where[b][1]]) for a, b in g.links}

    assert ("Varbeck", "VARBECK") in pairs("Dr. Varbeck spoke. Later Mr. VARBECK left.")
    assert ("Corsa", "C.") in pairs("signed, Corsa Wexholm. With C. Wexholm now.")
    assert ("(415) 555-0199", "415.555.0199") in pairs("ring (415) 555-0199 or 415.555.0199 now")
    assert ("Jórun", "Jorun") in pairs("Dr. Jórun Hale and Dr. Jorun Hale")


def test_estimated_potentials(model):
    """Neighbours of one mention attract each other, labels of different kinds repel each other."""
    names = model.chain_table[1:, 1:]
    assert model.chain_table[5, 5] > 0 and (names[~np.eye(5, dtype=bool)] < 0).all()
    assert np.isfinite(model.chain_table).all() and np.isfinite(model.link_table).all() and (np.diag(model.link_table)[1:] > 0).all()


def test_links_decide_a_weak_mention():
    """A word too weak by itself is a name because the same word elsewhere in the text surely is one; without links it isn't."""
    sure, weak = np.array([0.0, -9, -9, -9, -9, 6]), np.array([0.0, -9, -9, -9, -9, -1])
    chain = np.array([[0, 1], [2, 3]])
    args = (np.array([sure, sure, weak, weak]), chain)
    assert list(infer(*args, np.array([[1, 3], [0, 2]]))) == [5, 5, 5, 5]
    assert list(infer(*args, np.zeros((0, 2), np.int64))) == [5, 5, 0, 0]


def test_rows(spark, model):
    ddl = "row_id long, match string, pii_type string, redacted string, extra int"
    rows = [(1, "x@y.test", "a", "b", 1), (1, "x@y.test", "a", "b", 1), (2, None, "", "", 1), (3, "", "", "", 1), (None, "Dr. Varbeck", "", "", 1), (4, "word " * 200_000 + "x@y.test", "", "", 1)]
    df = spark.createDataFrame(rows, ddl)
    got = sorted(((r.row_id or 0, r.pii_type, r.match_start) for r in find_personal(df, "row_id", "match", model).collect()))
    assert got == [(0, "name", 5), (1, "email", 1), (1, "email", 1), (4, "email", 1_000_001)]
    whole = {r.row_id: r.redacted for r in find_personal(df.where("row_id < 4"), "row_id", "match", model, with_text=True).collect()}
    assert whole == {1: "[EMAIL]", 2: None, 3: ""}
    assert find_personal(df.limit(0), "row_id", "match", model).count() == 0
