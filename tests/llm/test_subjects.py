import random

import numpy as np
import pytest

from fathom.llm import subjects as s

AREAS = {1: ["fostret", "amningen", "barnmorskan", "vaggan", "modern", "värkarbetet"], 2: ["smittan", "viruset", "handspriten", "utbrottet", "isoleringen", "kohorten"], 3: ["momsen", "fakturan", "budgeten", "attesten", "bokslutet", "anbudet"]}
TEMPLATES = ["Kontrollera {} och {} enligt mallen.", "Om {} avviker kontaktas enheten om {}.", "Först {}, sedan {} och sist en rad i listan."]
ROUTINE = ["Dokumentet ersätter listan från i fjol.", "Frågor besvaras av chefen på enheten.", "Rutinen gäller för all personal här."]


def text(rng, *areas, n=4, also=0):
    out = [rng.choice(TEMPLATES).format(*rng.sample(AREAS[a], 2)) for a in areas for _ in range(n)] + rng.sample(ROUTINE, 2)
    if also:
        out.append(TEMPLATES[0].format(*rng.sample(AREAS[also], 2)))
    rng.shuffle(out)
    return "Rubrik om något\n\n" + " ".join(out)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    texts, labels = [], []
    for k in range(240):
        areas = [1 + k % 3] if k % 4 else rng.sample([1, 2, 3], 2)
        texts.append(text(rng, *areas))
        labels.append({rng.choice([1, 2, 3])} if k % 17 == 0 else set(areas))  # some are wrong
    return s.fit(texts, labels, [1, 2, 3], dimensions=6)


def test_held_out(model):
    rng = random.Random(2)
    right = 0
    for _ in range(100):
        areas = sorted(rng.sample([1, 2, 3], rng.choice([1, 2])))
        right += s.assign([text(rng, *areas)], model)[0] == areas
    assert right >= 95


def test_rules(model):
    rng = random.Random(3)
    assert s.assign([text(rng, 1, also=2)], model) == [[1]], "one sentence in passing"
    assert s.assign(["Kontrollera smittan och viruset enligt mallen."], model) == [[2]]
    assert s.assign([" ".join(ROUTINE)], model) == [[]]
    assert s.assign([None, "", "  "], model) == [[], [], []]
    assert s.assign(["KONTROLLERA SMITTAN OCH VIRUSET ENLIGT MALLEN."], model) == [[2]]
    assert s.assign([], model) == []


def test_cleaning():
    assert s.plain("fÃ¶r VÃ¤gen â€“ x") == "för vägen – x"
    assert s.plain("enhetsc <b>OBS!</b> &nbsp;hef") == "enhetschef"
    assert s.plain("referensi ​​ ntervallet") == "referensintervallet"
    assert s.plain("bo 血液 кровь دم rt") == "bort"
    assert s.plain("för") == "för"
    assert s.sentences("Rubrik\n\nVarför ska det ske? Därför att det måste ske. Klockan 14.30 är bra.") == ["varför ska det ske? därför att det måste ske.", " klockan 14.30 är bra."]


def test_empty_fit():
    m = s.fit([], [], [1, 2])
    assert s.assign(["Kontrollera smittan."], m) == [[]]


def test_frames(spark):
    rng = random.Random(4)
    rows = [(k, text(rng, 1 + k % 3), "x") for k in range(90)] + [(100, None, "y"), (101, "", None), (102, text(rng, 1), "z"), (102, text(rng, 1), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, subject_id string")
    labels = spark.createDataFrame([(k, 1 + k % 3) for k in range(0, 90, 2)] + [(0, 1), (4, None), (777, 2), (None, 1)], "doc_id long, subject_id int")
    areas = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "never")], "subject_id int, code string")
    m = s.fit_model(docs, labels, areas)
    got = s.assign_documents(docs, m)
    found = {(r.doc_id, r.subject_id) for r in got.collect()}
    assert len(found & {(k, 1 + k % 3) for k in range(90)}) >= 85 and (102, 1) in found and not {r for r in found if r[0] in (100, 101)}
    comp = {r.subject_id: r for r in s.composition(got, docs, areas).collect()}
    assert comp[4].n_docs == 0 and len(comp) == 4


def test_decomposition_by_either_side():
    rng = np.random.default_rng(3)
    x = np.where(rng.random((30, 50)) < 0.3, rng.random((30, 50)), 0)
    for m in (x, x.T):
        rows, cols = np.nonzero(m)
        got = s.decompose(rows, cols, m[rows, cols], *m.shape, 5)
        want = np.linalg.svd(m)[2][:5].T
        assert np.allclose(np.abs((got * want).sum(0)), 1, atol=1e-4)


def test_other_scripts():
    """Some words of another script are left out, a text in one is read."""
    assert s.sentences("Först modern, sedan 血液検査 vaggan här.") == ["först modern, sedan vaggan här."] or "血" not in s.sentences("Först modern, sedan 血液検査 vaggan här.")[0]
    assert len(s.sentences("Η εξέταση αίματος γίνεται το πρωί. Ο ασθενής περιμένει στην αίθουσα.")) == 2
    assert len(s.sentences("血液検査は朝に行われます。患者は待合室で待ちます。")) == 2
    greek = {1: ["αίματος", "καρδιά", "πίεση", "φλέβα"], 2: ["φόρος", "τιμολόγιο", "προϋπολογισμός", "σύμβαση"]}
    rng = random.Random(4)
    made = lambda k: " ".join(f"Ελέγξτε {rng.choice(greek[k])} και {rng.choice(greek[k])} σήμερα." for _ in range(4))
    model = s.fit([made(1 + k % 2) for k in range(60)], [{1 + k % 2} for k in range(60)], [1, 2], dimensions=4)
    assert s.assign([made(1), made(2), ""], model) == [[1], [2], []]
