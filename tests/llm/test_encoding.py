import random

import pytest

from tidemark.llm import encoding as E

CLEAN = [
    "Der nächtliche Abgleich löscht die Gebühren für Händler während der Zusammenführung",
    "La tâche différée répète le résumé français dès la première erreur",
    "El año anterior protege la página número siete según la compañía",
    "Ночной робот проверяет старые адреса после слияния",
    "Zapytanie nie śledzi części odnośników od początku",
]
PAIRS = [("utf-8", "cp1252"), ("utf-8", "iso8859-1"), ("utf-8", "cp1251"), ("utf-8", "mac-roman"), ("cp1252", "mac-roman"), ("cp1251", "iso8859-1"), ("cp1250", "iso8859-2"), ("cp1251", "koi8-r")]


def corpus():
    r = random.Random(9)
    docs, bad = [], {}
    for i in range(900):
        docs.append((i, " ".join(r.sample(CLEAN[i % 5].split(), 6)), "x", 1))
    for k, pair in enumerate(PAIRS * 2):
        for j, line in enumerate(CLEAN):
            g = E.garble(line, (pair,))
            if g and g != line:
                bad[2000 + 10 * k + j] = line
                docs.append((2000 + 10 * k + j, g, "x", 1))
    docs.append((3000, CLEAN[0].encode("cp1252").decode("utf-8", "replace"), "x", 1))
    bad[3000] = CLEAN[0]
    return docs, bad


QUOTES = [(5000, 'The list has the pair "Ã©" and "é" as an example', "x", 1), (5001, "Readers who see “Ã¼” should report it", "x", 1), (5002, None, "x", 1), (5003, "", "x", 1), (5004, "plain", "x", 1), (5005, "«\xa0Une tâche\xa0» für Händler", "x", 1)]


def test_finds_and_restores(spark):
    docs, bad = corpus()
    df = spark.createDataFrame(docs + QUOTES, "doc_id long, text string, form string, n int")
    assert {r.doc_id for r in E.garbled_documents(df).collect()} == {*bad}
    back = {r.doc_id: r for r in E.restored_documents(df).collect()}
    assert set(back) == {*bad}
    right = sum(back[d].restored == bad[d] for d in bad)
    assert right >= 0.95 * len(bad)


def test_repeated_rows(spark):
    docs, bad = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, form string, n int")
    assert {r.doc_id for r in E.garbled_documents(df.union(df)).collect()} == {*bad}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert E.garbled_documents(df).collect() == []
    assert E.restored_documents(df).collect() == []


@pytest.mark.parametrize("chain", E.TRANSFORMATIONS[::9])
def test_restore_inverts_garble(chain):
    if chain[-1][1] == "utf-8":
        return
    for line in CLEAN:
        g = E.garble(line, chain)
        if g is not None:
            assert E.restore(g, chain) == line


def test_alignment_votes():
    k = E.TRANSFORMATIONS.index((("utf-8", "cp1252"),))
    assert k in E.explain("précédent", "prÃ©cÃ©dent")
    assert E.explain("precedént", "prÃ©cedent") == []
