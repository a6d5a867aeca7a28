import random

from tests.llm.test_encoding import CLEAN
from tidemark.llm import encoding as E

QUOTE = "«Новый узел» хранит «журнал», “память” и \"запись\" (после)"


def corpus():
    r = random.Random(5)
    words = (CLEAN[3] + " Новый узел хранит журнал память и запись после").split()
    docs = [(i, " ".join(r.sample(words, 7)) + f" {i}") for i in range(400)]
    docs += [(900, 'The list has the pair "Ð½" and "н" as an example'), (901, "Readers who see “Ð½Ð¾” should report it")]
    for k, turn in enumerate([("utf-8", "cp1251"), ("utf-8", "cp1252"), ("cp866", "cp1251")]):
        docs.append((1000 + k, E.garble(CLEAN[3] + " " + QUOTE.replace("“", "«").replace("”", "»"), (turn,)) if turn[0] == "utf-8" else E.garble(CLEAN[3] + ' "журнал" (после)', (turn,))))
    return docs


def test_quotes_in_garbled_texts(spark):
    """Quote marks within garbled runs are letters, and quoted words of garbled texts are garbled as well."""
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = {r.doc_id: r for r in E.restored_documents(df).collect()}
    assert set(got) == {1000, 1001, 1002}
    whole = CLEAN[3] + " " + QUOTE.replace("“", "«").replace("”", "»")
    assert [got[d].restored for d in (1000, 1001)] == [whole, whole]
    assert got[1002].restored == CLEAN[3] + ' "журнал" (после)'
    assert all(got[d].left == 0 for d in got)


def test_quoted():
    assert E.quoted_in('a pair "Ã©" and “Ã¼”, (Ð½)') >= {"Ã©", "Ã¼", "Ð½"}
    assert E._quoted.search("бзЁвҐ«®Є» — §") is None
    assert E._quoted.search("В«РњРµРґР»РµРЅРЅС‹Р№") is None
