import random

import pytest

from tests.llm.test_encoding import CLEAN
from tidemark.llm import encoding as E

TURNS = [("cp866", "cp1251"), ("cp1251", "koi8-r"), ("cp1252", "mac-roman"), ("utf-8", "cp1252")]


def found(spark, docs):
    return {r.doc_id for r in E.garbled_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("turn", TURNS)
def test_copies_of_a_garbled_text(spark, turn):
    """A garbled text that was copied often isn't sound for that."""
    r = random.Random(3)
    docs = [(i, " ".join(r.sample(CLEAN[i % 5].split(), 6))) for i in range(300)]
    line = CLEAN[3] if turn[0] in ("cp866", "cp1251") else CLEAN[0]
    docs += [(1000 + i, E.garble(line, (turn,))) for i in range(400)]
    assert found(spark, docs) == {*range(1000, 1400)}


@pytest.mark.parametrize("turn", TURNS)
def test_site_of_garbled_texts(spark, turn):
    """As many distinct texts in the wrong encoding as in the right one, or twice as many."""
    for many in (1, 2):
        r = random.Random(4)
        docs = [(i, " ".join(r.sample(CLEAN[i % 5].split(), 6)) + f" {i}") for i in range(300)]
        line = CLEAN[3] if turn[0] in ("cp866", "cp1251") else CLEAN[0]
        docs += [(1000 + i, E.garble(" ".join(r.sample(line.split(), 6)) + f" {i}", (turn,))) for i in range(60 * many)]
        assert found(spark, docs) == {*range(1000, 1000 + 60 * many)}


def test_flaw():
    assert [E.flaw(x) for x in ("précédent", "don’t", "«робот»", "5°", "m²", "ÉTÉ")] == [0] * 6
    assert [E.flaw(x) for x in ("prÈcÈdent", "f¸r", "оНЮМНИ", "Ќ®з\xad®©", "СѓР·РµР»", "x\x85")] == [1] * 5 + [2]
