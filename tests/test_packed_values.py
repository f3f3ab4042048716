import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.operators.packed_values import PackedGrammar, split_packed

TERMS = ["Psykiatri, vuxna", "Psykiatri", "Hud & kön", '"röd" rutin', "Öron/näsa/hals", "Primärvård | jour", "Medicin; akut"]


def values(s):
    return [v for _, v, _ in PackedGrammar(TERMS).parse(s)]


@pytest.mark.parametrize(
    "s, want",
    [
        ("a, b;c|d", ["a", "b", "c", "d"]),
        ("Psykiatri, vuxna, Psykiatri", ["Psykiatri, vuxna", "Psykiatri"]),
        ('"Psykiatri, vuxna";#x', ["Psykiatri, vuxna", "x"]),
        ("«Hud &amp; kön» • ”b”", ["Hud & kön", "b"]),
        ("Psykiatri\\, vuxna / x", ["Psykiatri, vuxna", "x"]),
        ('["\\"röd\\" rutin", "b c"]', ['"röd" rutin', "b c"]),
        ('"""röd"" rutin",x', ['"röd" rutin', "x"]),
        ('"röd" rutin · x', ['"röd" rutin', "x"]),
        ("a /  / b / ", ["a", "b"]),
        ("Hud\xa0& kön\r\n\r\nx", ["Hud & kön", "x"]),
        ("a, a,, a", ["a", "a", "a"]),
        ("Öron/näsa/hals/x", ["Öron/näsa/hals/x"]),
        ("Ej angivet", []),
        (" - ", []),
        ("", []),
        (None, []),
        ("   ", []),
    ],
)
def test_values(s, want):
    assert values(s) == want


def test_malformed_quotes_fall_back_and_are_flagged():
    got = PackedGrammar(TERMS).parse('"öppen, b')
    assert [(v, e) for _, v, e in got] == [("öppen", "unclosed"), ("b", "")]
    assert [n for n, _, _ in got] == [1, 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcåäö ", min_size=1, max_size=6).map(lambda x: " ".join(x.split())).filter(bool), max_size=6), st.sampled_from([", ", ";", " | ", "\n", "\t", " • ", " / "]), st.booleans())
def test_round_trip(parts, sign, quoted):
    packed = sign.join(f'"{p}"' if quoted else p for p in parts)
    assert [v for _, v, _ in PackedGrammar([]).parse(packed)] == [p for p in parts if p not in ("ingen",)]


def test_frame(spark):
    df = spark.createDataFrame([(1, "a,b", None, "clash"), (2, None, "", "x"), (1, "a,b", "c", "y")], "id long, f string, g string, value string")
    rows = split_packed(df, {"f": TERMS}, "id", ["f", "g"]).collect()
    assert sorted((r.id, r.field, r.position, r.value) for r in rows) == [(1, "f", 1, "a"), (1, "f", 1, "a"), (1, "f", 2, "b"), (1, "f", 2, "b"), (1, "g", 1, "c")]
    assert split_packed(df.limit(0), {}, "id", ["f", "g"]).count() == 0


def test_long_field():
    assert len(PackedGrammar(TERMS).parse(",".join(["x"] * 20_000))) == 20_000


@pytest.mark.parametrize("s", ["[" * 100_000, "[" * 100_000 + "]" * 100_000, "[1," * 50_000, '["a",' * 40_000, 'a;"a' * 50_000, '"a;' * 60_000, " " * 200_000 + "a" + " " * 200_000 + "b", "[a]b" * 50_000, "x" * 200_000, "{" * 1000 + ";" + "}" * 1000, "\\" * 100_000, "&" * 100_000, '""' * 100_001])
def test_no_text_takes_more_than_linear_time(s):
    start = time.process_time()
    got = PackedGrammar(TERMS).parse(s)
    assert time.process_time() - start < 5 and all(v for _, v, _ in got)


def test_lists():
    assert values('["a, b", "c\\"d", 7, null]; x') == ["a, b", 'c"d', "7", "x"]
    assert values("[a, [b, c]]") == ["a", "b", "c"]
    assert PackedGrammar([]).parse('"a; b') == [(1, "a", "unclosed"), (2, "b", "")]
