import math

import pytest

from fathom.llm import scan_repair as r

WORDS = "kontrollera enhetschef sjuksköterska förlossningen ansvarig övriga rutin gäller avdelning dagar inom antecknas kunskapsblanketten modern passeras"


@pytest.fixture(scope="module")
def lex():
    text = [f"Den som läser {w} samt {w} inom {k} dagar och med IT-avdelning. IT-avdelning är {w}." for w in WORDS.split() for k in range(1, 40)]
    text += ["rad som går vidare utan slut på meningen här\nKopia – original förvaras\nfortsätter den sedan på nästa rad och slutar."] * 20
    c = r.count_chunks(iter([*text, None, ""]))
    n = {k[1]: v for k, v in c.items() if k[0] == "n"}
    words = {k[1]: v for k, v in c.items() if k[0] == "w"}
    pairs = {k[1]: v for k, v in c.items() if k[0] == "p"}
    heads = {k[1] for k, v in c.items() if k[0] == "l" and v >= max(5, math.ceil(n["line"] * r.LINE_SHARE)) and c["b", k[1]] >= r.BREAKS * v}
    return r.Lexicon(words, pairs, heads, n["word"])


def found(s, lex, title="Rutin för modern", heading=None):
    return [(d.kind, d.repaired) for d in r.repair(s, title, heading, True, lex)[0]]


def test_hyphens(lex):
    assert found("vem som är enhets-\nchef, och", lex) == [("hyphen", "enhetschef")]
    assert found("en sjuk\xad\nsköterska.", lex) == [("hyphen", "sjuksköterska")]
    assert found("på IT-\navdelning är", lex) == [("hyphen", "IT-avdelning")]
    assert found("dag-\neller nattpersonal", lex) == [] and found("För- och\nnackdelar", lex) == []


def test_hyphen_over_page_furniture(lex):
    s = "vem som är enhets-\nRutin för modern\n- 3 -\nchef inom"
    assert sorted(found(s, lex)) == [("header", "Rutin för modern"), ("hyphen", "enhetschef"), ("page_number", "- 3 -")]
    assert r.repair(s, "Rutin för modern", None, True, lex, True)[1] == "vem som är enhetschef inom"


@pytest.mark.parametrize("line", ["3", "- 3 -", "3 (14)", "Sidan 3", "sid. 3", "Page 3 of 9", "Sida 3 av 9", "3/9", "[ 3 ]"])
def test_page_numbers(lex, line):
    assert found(f"en rad som slutar\n{line}\nOch en till.", lex) == [("page_number", line)]


@pytest.mark.parametrize("line", ["3–9 kPa", "2+0+7", "34 ml/h", "B39: ja", "9/3", "14.30"])
def test_no_page_numbers(lex, line):
    assert ("page_number", line) not in found(f"En rad.\n\n{line}\n\nOch en till.", lex)


def test_headers(lex):
    s = "rad som går vidare\nRegion X   RUTIN FÖR MODERN | sid. 3\nmed mera. Kopia\n  Kopia –  original förvaras\nslut."
    assert found(s, lex) == [("header", "Region X RUTIN FÖR MODERN | sid. 3"), ("header", "Kopia – original förvaras")]
    assert found("1 Modern\n\nText som är kort.", lex, heading="1 Modern") == []


@pytest.mark.parametrize("bad, good", [("kontro11era", "kontrollera"), ("kontrolIera", "kontrollera"), ("öyriga", "övriga"), ("Ansvar!g", "Ansvarig"), ("antecknas", None), ("rnodern", "modern"), ("dagaf", "dagar"), ("avde|ning", "avdelning")])
def test_misread_words(lex, bad, good):
    assert found(f"Den som läser {bad} här.", lex) == ([("misread", good)] if good else [])


def test_misread_numbers(lex):
    assert found("samt rutin inom l0 dagar och", lex) == [("misread", "10")]
    assert found("samt rutin inom 2O dagar och", lex) == [("misread", "20")]
    assert found("på enhet B12 och LT-O12 i N0M8", lex) == []


def test_clean_text_stays(lex):
    s = "Den som läser modern.\n\n5 mg\n\n  Indraget stycke utan slut"
    assert r.repair(s, None, None, True, lex, True) == ([], s)
    for empty in (None, "", "  \n"):
        assert r.repair(empty, None, None, True, lex, True) == ([], empty)


def test_long_text(lex):
    s = "Den som läser öyriga.\n" * 3000
    assert len(found(s, lex)) == 3000


def test_frames(spark):
    rows = [(k, "section", f"Den som läser {w} samt enhetschef.\n\nInget annat gäller inom {k} dagar.", None, '{"title": "T"}', None, "x") for k, w in enumerate(WORDS.split() * 40)]
    rows += [(9000, "section", "Den som läser enhetschet samt enhets-\nchef.", "enhetschet samt", "no json", None, "y"), (9001, "title", "enhetschet", "", None, None, "z"), (9002, "section", None, "", None, None, None)]
    df = spark.createDataFrame(rows, "chunk_id long, chunk_type string, text string, preview_text string, metadata_json string, section_heading string, kind string")
    got = sorted((x.chunk_id, x.field, x.kind, x.repaired) for x in r.find_defects(df).collect())
    assert got == [(9000, "preview_text", "misread", "enhetschef"), (9000, "text", "hyphen", "enhetschef"), (9000, "text", "misread", "enhetschef")]
    back = {x.chunk_id: x for x in r.repair_chunks(df).collect()}
    assert back[9000].text == "Den som läser enhetschef samt enhetschef." and back[9001].text == "enhetschet" and back[9002].text is None and len(back) == len(rows)
    assert r.find_defects(df.limit(0)).count() == 0


def test_copies_do_not_hide_a_misread_word(spark):
    rows = [(k, "section", f"Den som läser {w} samt enhetschef.\n\nInget annat gäller inom {k} dagar.", None, '{"title": "T"}', None) for k, w in enumerate(WORDS.split() * 40)]
    rows += [(9000 + k, "section", "Den som läser enhetschet samt enhetschef.", None, None, None) for k in range(300)]
    df = spark.createDataFrame(rows, "chunk_id long, chunk_type string, text string, preview_text string, metadata_json string, section_heading string")
    assert sorted((x.chunk_id, x.kind, x.repaired) for x in r.find_defects(df).collect()) == [(9000 + k, "misread", "enhetschef") for k in range(300)]
    assert r.repair_chunks(df).where("text like '%enhetschet%'").count() == 0


def test_a_long_address_does_not_hide_its_line(lex):
    s = "Den som läser öyriga rutin, se https://dokument.lovtuna.example/a/kontrolIera/mycket/djup/vag.pdf och inom l0 dagar."
    assert found(s, lex) == [("misread", "övriga"), ("misread", "10")]


@pytest.mark.parametrize("bad, good", [("kunskapsb1anketfen", "kunskapsblanketten"), ("sjukskötcrskn", None), ("sjnksköferska", "sjuksköterska"), ("SJNKSKÖFERSKA", "SJUKSKÖTERSKA"), ("Sjnksköferska", "Sjuksköterska"), ("förlossningens", None), ("oförlossningen", None)])
def test_two_errors_in_a_word(lex, bad, good):
    assert found(f"En text där {bad} nämns.", lex) == ([("misread", good)] if good else [])


@pytest.mark.parametrize("bad", ["sjuksköterka", "sjuksköaterska", "sjukskzterska", "sjuksktrska"])
def test_odd_changes_need_a_context(lex, bad):
    """A character left out, put in or changed at will is repaired where the word is known between these neighbours."""
    assert found(f"Den som läser {bad} samt annat.", lex) == [("misread", "sjuksköterska")]
    assert found(f"Zebror jagar {bad} utan orsak.", lex) == []


def test_the_context_keeps_a_word():
    """A single candidate isn't taken for a word that is itself known between its neighbours, and among several the neighbours choose."""
    words, pairs = {"rutan": 500, "rutin": 20_000, "ritan": 9000, "den": 50_000, "här": 9000, "ny": 9000}, {"den rutan": 400, "rutan här": 300, "ny rutin": 800, "den rutin": 100}
    lex = r.Lexicon({**words, "rutfn": 90}, {**pairs, "den rutfn": 80}, set(), 10_000)
    assert lex.repair("rutfn", "den", "x") is None and lex.repair("rutfn", "ny", "x") is None
    other = r.Lexicon({"moden": 500, "modcn": 1, "mocten": 500}, {"den moden": 5, "ny mocten": 5}, set(), 10_000)
    assert other.repair("modcn", "den", "x") == "moden"


def test_distance():
    assert r.distance("rn", "m", 2) == 0.4 and r.distance("c", "e", 2) == 0.3 and r.distance("lcx", "ieb", 2) == pytest.approx(1.6) and r.distance("abc", "abc", 2) == 0
    assert r.distance("abcdef", "uvwxyz", 2) == 9 and r.distance("", "ab", 2) == 2 and r.distance("ab", "a", 2) == 1
    near = [(a, b) for a in ("patienten", "patientn", "ptientn", "barn", "bam") for b in ("patienten", "barn", "bam")]
    assert all(r.deletions(a) & r.deletions(b) for a, b in near if r.distance(a, b, 2) <= 2)


def test_rare_words_and_long_lines(lex):
    """What lies below the floor is no candidate; a line of any length is read."""
    assert lex.need(None) == 3 and found("Den som läser zebran samt zehran.", lex) == []
    assert found("Den som läser öyriga samt. " * 400, lex) == [("misread", "övriga")] * 400
