from pyspark.sql import functions as F

from tidemark.llm import encoding as E


def forms(spark, rows):
    made = spark.createDataFrame([(f, n, E.flaw(f)) for f, n in rows], "form string, n long, flaw int")
    return made.withColumn("skeleton", F.regexp_replace("form", r"[^\x00-\x7F]+", ""))


PAIRS = [(w, turn) for turn, words in [(("utf-8", "cp1252"), ("précis", "né", "début", "créer")), (("cp1252", "mac-roman"), ("über", "für", "Größe"))] for w in words]


def test_every_way_votes(spark):
    """However many ways there are, the choice is the same."""
    rows = [(w, 50) for w, _ in PAIRS] + [(E.garble(w, (turn,)), 1) for w, turn in PAIRS]
    f = forms(spark, rows)
    chosen = E.learn(f)
    assert len(chosen) >= 2
    assert E.learn(f, most_sets=1) == chosen


def test_rarer_twins_vote(spark):
    """A clean form votes even where another one with the same skeleton is more frequent."""
    rows = [("dêcade", 90), ("rôle", 90), ("fûrs", 90), ("décade", 50), ("rèle", 50), ("fêrs", 50)]
    rows += [(E.garble(w, (("utf-8", "cp1250"),)), 1) for w in ("décade", "rèle", "fêrs")]
    k = E.TRANSFORMATIONS.index((("utf-8", "cp1250"),))
    chosen = E.learn(forms(spark, rows))
    assert any(all(E.garble(w, E.TRANSFORMATIONS[c]) == E.garble(w, E.TRANSFORMATIONS[k]) for w in ("décade", "rèle", "fêrs")) for c in chosen)
