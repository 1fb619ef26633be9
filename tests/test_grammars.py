"""Clauses, segments and guards against outcomes on both sides of each rule, without Spark."""

import random

import pytest

from quillstone.functions import clauses as C
from quillstone.functions import guards as G
from quillstone.functions import segments as S

CONTRACT = """MASTER AGREEMENT
This agreement is made between Acme and Bolt.
ARTICLE 1 - DEFINITIONS
1.1 Terms. In this agreement, words have meaning.
They do.
1.2 Payment Terms
The buyer shall pay.
ARTICLE II
PAYMENT
2.1 Fees. All fees are due.
INSURANCE
3. Cover. The seller insures.
3.1 Limits
A limit."""


def read(text, page=1):
    return C.clauses([(line, page) for line in text.split("\n")])


def test_a_contract():
    got = [(c.headings, c.number, c.article, c.parent, c.opening, c.heading_only, c.uncertain) for c in read(CONTRACT)]
    assert got == [
        ([], None, None, None, True, False, False), (["DEFINITIONS"], None, 1, None, False, True, False), (["Terms"], ("1", "1"), None, 1, False, False, False), (["Payment Terms"], ("1", "2"), None, 1, False, False, False),
        (["PAYMENT"], None, 2, None, False, True, False), (["Fees"], ("2", "1"), None, 4, False, False, False), (["INSURANCE", "Cover"], ("3",), None, 4, False, False, False), (["Limits"], ("3", "1"), None, 6, False, False, False),
    ]


@pytest.mark.parametrize("text, want", [("7", 7), ("999", 999), ("1000", None), ("0", None), ("007", 7), ("IV", 4), ("XLII", 42), ("MMMCMXCIX", 3999), ("IIII", None), ("VX", None), ("IC", None), ("MMMM", None), ("", None), ("x", None)])
def test_ordinals(text, want):
    assert C.ordinal(text) == want


@pytest.mark.parametrize("text, want", [("Term and Termination.", True), ("Term and termination", False), ("INDEMNITY & INSURANCE:", True), ("and of", False), ("Fees 5", False), ("", False), ("A", True)])
def test_titles(text, want):
    assert C.title_shaped(text) == want


@pytest.mark.parametrize("text, want", [("Cover. The seller", ("Cover", True)), ("Cover.", ("Cover", False)), ("Cover 2.5 of it", ("Cover 2.5 of it", False)), ("Cover: x", ("Cover", True))])
def test_title_and_body(text, want):
    assert C.title_and_body(text) == want


@pytest.mark.parametrize("line, want", [("ARTICLE 1 - DEFINITIONS", (1, "DEFINITIONS")), ("Article IV: Fees.", (4, "Fees")), ("ARTICLE 2 PAYMENT", (2, "PAYMENT")), ("Article 2 PAYMENT", None), ("ARTICLE 2 Payment", None), ("ARTICLE 2", None), ("ARTICLE IIII - X", None)])
def test_articles(line, want):
    assert C.shape(line, 1).article == want


def test_a_table_of_contents_leaves_bounds_in_doubt():
    assert all(c.uncertain for c in read("TABLE OF CONTENTS\n1 Terms 3\n2 Fees 5"))


def test_roman_titles_go_on_or_are_taken_up():
    assert [c.article for c in read("I. TERMS\n1.1 Scope. It is.\nII. FEES\nThey are due.")] == [1, None, 2]
    assert [c.article for c in read("V. NOTES\nSome text.")] == [None]


def test_a_bare_number_in_a_marked_section_is_in_doubt():
    got = read("Section 2.1 Fees. All due.\n1. First item of it.\nMore.")
    assert [c.uncertain for c in got] == [True, True]


def test_a_wrapped_sentence_isnt_a_section():
    got = read("Section 1.1 Scope. As set out in\nSection 2.1 Every buyer who pays late owes more.\nEnd.")
    assert len(got) == 1


def test_the_title_before_a_deeper_number_names_the_section():
    got = read("Intro ends.\nPAYMENT\n4.1 Fees. Due.\n4.2 Late. Not.")
    assert [(c.headings, c.number, c.parent) for c in got[1:]] == [(["PAYMENT"], ("4",), None), (["Fees"], ("4", "1"), 1), (["Late"], ("4", "2"), 1)]


def test_numbered_units():
    got = C.numbered_units(["INTRO\n1. Scope of work\ntext\n1.1 Limits\nmore", "2. Fees\nx"])
    assert [(b, n) for b, _, _, n in got] == [(0, "1"), (0, "1.1"), (1, "2")] and got[1][2] == "INTRO\n1. Scope of work\ntext\n\n1.1 Limits\nmore"
    twice = C.numbered_units(["1. One\na\n1.1 Same\nb\n2. Two\nc\n1.1 Same\nb"])
    assert [c for _, t, c, _ in twice if t.startswith("1.1")] == ["", ""]  # the same words under two numbers have no context


def test_sentences():
    text = "Mr. Smith paid 3.5 dollars. He left... Then no. 5 came. U.S. law applies. Ends here"
    assert [text[a:b].strip() for a, b in zip([0, *S.sentence_ends(text)], S.sentence_ends(text))] == ["Mr. Smith paid 3.5 dollars.", "He left... Then no. 5 came.", "U.S. law applies."]


def test_segments_keep_whole_units():
    short = "A short page."
    assert S.segments(f"  {short}\n") == ([short], 0) and S.segments(" \n") == ([], 0)
    text = "One sentence here. " * 40
    got, lost = S.segments(text)
    assert lost == 0 and all(len(s) <= S.LIMIT and s.endswith(".") for s in got) and " ".join(got) == text.strip()
    assert S.segments("x" * 601) == ([], 1)
    cut, lost = S.segments("A first one. " * 40 + "a tail without end " * 10)
    assert lost == 1 and all(s.endswith("one.") for s in cut)


def test_segments_stay_with_what_qualifies_them():
    text = "The buyer pays all. " * 28 + "Unless the seller " + "waits " * 8 + "too long."
    got, _ = S.segments(text)
    assert any("pays all. Unless the seller" in s for s in got) or not any(s.startswith("Unless") for s in got)


@pytest.mark.parametrize("text, want", [("Name: Ann\nAge: 5", 2), ("Name: Ann", 1), ("Prose here.\nName: Ann", 0), ("2 Name: x", 0), ("Heading:\nName: Ann", 1)])
def test_forms(text, want):
    assert S.form_fields(text) == want


@pytest.mark.parametrize("text, want", [("It is done. And mor", "It is done."), ("It is done. Unless th", None), ("It is done. But", None), ("It is done. Subject t", "It is done."), ("It is done. Subject to", None), ("It is done. Only", None), ("no end", None), ("Costs rose 5 %. X", "Costs rose 5 %.")])
def test_safe_prefix(text, want):
    assert S.safe_prefix(text) == want


def test_recover():
    assert S.recover(["It is done. And mor", "Fine.", "It is done. Unless "], 19) == (["It is done.", "Fine."], ["It is done."], 1)


@pytest.mark.parametrize("words, value", [("twenty one", "21"), ("one hundred and five", "105"), ("two million three hundred thousand", "2300000"), ("minus two", "-2"), ("hundred", None), ("and five", None), ("zero", "0"), ("nineteen", "19")])
def test_spelled(words, value):
    m = G.spelled(words.split(), 0)
    assert (m and m.value) == value


@pytest.mark.parametrize("text, want", [
    ("at most 5", "<="), ("not at most 5", ">"), ("no more than 5", "<="), ("5 or fewer", "<="), ("at least 5", ">="), ("5 or more", ">="), ("more than 5", ">"), ("not to be more than 5", "<="), ("under 5", "<"), ("over 5", ">"), ("exactly 5", "="), ("is 5", "="), ("is not 5", "!="),
    ("up to 5", "<="), ("a minimum of 5", ">="), ("≥ 5", ">="), ("< 5", "<"), ("about 5", None),
])
def test_relations(text, want):
    tokens = G.clauses(text)[0]
    m = G.mentions(tokens)[0]
    assert G.relation(tokens, m.start, m.end) == want


def test_entailment_is_inclusion():
    from decimal import Decimal

    allowed = {"<": lambda x, v: x < v, "<=": lambda x, v: x <= v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "=": lambda x, v: x == v, "!=": lambda x, v: x != v}
    grid = [Decimal(x) / 2 for x in range(-20, 21)]
    for a in allowed:
        for b in allowed:
            for s in (0, 1, 2):
                for c in (0, 1, 2):
                    assert G.entails(a, Decimal(s), b, Decimal(c)) == all(allowed[b](x, c) for x in grid if allowed[a](x, s))


@pytest.mark.parametrize("text, want", [("5 dollars", "dollar"), ("$5", "dollar"), ("5 square feet", "square foot"), ("5 degrees celsius per day", "degree celsius per day"), ("5 of them", None), ("5 or more kg", "kilogram"), ("5 per", None)])
def test_units(text, want):
    tokens = G.clauses(text)[0]
    m = G.mentions(tokens)[0]
    assert G.unit(tokens, m.start, m.end) == want


CASES = [
    ("The fee is at most 10 dollars.", "The fee is at most 5 dollars.", []), ("The fee is at most 5 dollars.", "The fee is at most 10 dollars.", ["numbers"]), ("The fee is more than 5 dollars.", "The fee is exactly ten dollars.", []),
    ("The fee is at most 5 euros.", "The fee is at most 5 dollars.", ["numbers"]), ("The term is at least 3 days.", "Rain fell.", []),
    ("Buses run from the home to the workplace.", "Buses run from housing to the work site.", []), ("Buses run from the worksite to housing.", "Buses run from housing to the work site.", ["directions"]),
    ("Bolt carries goods from Rome to Paris.", "Acme carries goods from Rome to Paris. Bolt waits.", ["directions"]), ("Acme carries goods from Rome to Paris.", "Acme and Bolt carries goods from Rome to Paris.", []),
    ("His relatives may stay.", "Guests may stay.", ["enumeration"]), ("Family members may stay.", "Immediate family members may stay.", ["enumeration"]), ("Immediate family members may stay.", "Immediate family members may stay.", []),
    ("ABC only if paid must register.", "A broker company (ABC) must register. Agents (AGT) only for payment register.", ["conditions"]), ("ABC only if paid must register.", "A broker company (ABC) only for payment must register.", []),
    ("The lamp is safe.", "The lamp is not safe.", ["judgements"]), ("The lamp is unsafe.", "The lamp is not safe.", []), ("The lamp is safe.", "The door is safe.", []),
    ("Tenants must pay rent.", "Tenants may pay rent.", ["obligations"]), ("Tenants must pay rent.", "Tenants shall pay rent.", []), ("Tenants must not pay rent.", "Tenants must pay rent.", ["obligations"]), ("Tenants mustn't pay.", "Tenants must not pay.", []),
]


@pytest.mark.parametrize("claim, proof, want", CASES)
def test_guards(claim, proof, want):
    assert G.broken(claim, [proof]) == want


def test_any_text_is_read():
    r = random.Random(4)
    alphabet = ["1.", "ARTICLE", "IV", "Section", "§", "a", "Fees", "\n", " ", ". ", "from", "to", "must", "(ABC)", "%", "é", "-5", "two", "and", ":", "...", "\t"]
    for _ in range(300):
        text = " ".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        found = read(text) if text.strip() else []
        assert sorted(i for c in found for i in c.lines) == list(range(len(text.split("\n")) if found else 0)) or any(not t.strip() for t in text.split("\n"))
        S.segments(text * 20)
        G.broken(text, [text])
        C.numbered_units(text.split("\n"))
