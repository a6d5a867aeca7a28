import math
import random

import pytest

from tidemark.functions.query import parse
from tidemark.operators import index, ranking, search
from tidemark.session import scratch

FIELDS = (("title", "title"), ("url", "url"), ("domain", "domain"), ("body", "text"))
SCHEMA = "doc_id string, url string, title string, text string, domain string, h int, df int"
FLAGS = "doc_id string, exact_duplicate boolean, possible_duplicate boolean, active boolean"


def docs(spark, rows):
    return spark.createDataFrame([(i, f"https://example.com/{u}", t, x, "example.com", 1, 1) for i, u, t, x in rows], SCHEMA)


def built(spark, rows, **options):
    return index.add_segment(spark, scratch(spark, "index"), docs(spark, rows), FIELDS, buckets=4, **options)


def run(spark, rows, query="search technology", flags=None, **options):
    made = built(spark, rows, flags=spark.createDataFrame(flags, FLAGS) if flags else None)
    best = search.search(made, query, **({"profile": "full"} | options))
    return [(r.doc_id, round(r.score, 4)) for r in best.orderBy("rank").collect()]


GATES = {
    "relevance": (
        [
            ("DOC-TOP-0001", "search-technology", "Search Technology", "search technology search technology information retrieval ranking"),
            ("DOC-MID-0001", "search", "Search Information", "search information retrieval"),
            ("DOC-LOW-0001", "other", "Other Information", "search information information information unrelated content"),
        ],
        [("DOC-TOP-0001", 503.5729), ("DOC-MID-0001", 23.7652), ("DOC-LOW-0001", 0.6266)],
    ),
    "proximity": (
        [
            ("DOC-PROX-0001", "a", "Search Technology", "search technology information"),
            ("DOC-PROX-0002", "b", "Search Information", "search information unrelated technology"),
            ("DOC-PROX-0003", "c", "Technology Information", "technology information unrelated search"),
        ],
        [("DOC-PROX-0001", 456.8448), ("DOC-PROX-0002", 20.0449), ("DOC-PROX-0003", 20.0449)],
    ),
    "title": (
        [("DOC-TITLE-0001", "general", "Search Technology", "general information about technology"), ("DOC-TITLE-0002", "search", "General Information", "search technology information")],
        [("DOC-TITLE-0001", 457.2993), ("DOC-TITLE-0002", 8.8816)],
    ),
    "global": (
        [
            ("DOC-GLOBAL-0001", "a", "Information Page", "search information"),
            ("DOC-GLOBAL-0002", "b", "Search Technology", "search technology ranking retrieval"),
            ("DOC-GLOBAL-0003", "c", "Technology", "technology information"),
            ("DOC-GLOBAL-0004", "d", "Search", "search engine information"),
        ],
        [("DOC-GLOBAL-0002", 465.3601), ("DOC-GLOBAL-0003", 18.7173), ("DOC-GLOBAL-0004", 18.5336), ("DOC-GLOBAL-0001", 0.8603)],
    ),
}


@pytest.mark.parametrize("gate", GATES)
def test_known_rankings(spark, gate):
    rows, want = GATES[gate]
    got = run(spark, rows)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-3)


def test_or_holds_and(spark):
    rows = [("1", "a", "Search Technology", "x"), ("2", "b", "Database Technology", "y"), ("3", "c", "Web", "search of technology"), ("4", "d", None, None)]
    some = {d for d, _ in run(spark, rows, profile="bm25")}
    both = {d for d, _ in run(spark, rows, profile="bm25", mode="and")}
    assert some == {"1", "2", "3"} and both == {"1", "3"}
    assert run(spark, rows, query="  ") == [] and run(spark, [], query="search") == []
    assert run(spark, rows, query="nowhere") == []


def test_equal_documents_come_in_order_of_ids(spark):
    rows = [(f"D{i:03}", f"page/{i}", "Search Technology", "same text") for i in range(100)]
    got = run(spark, rows, k=10, profile="bm25")
    assert [d for d, _ in got] == [f"D{i:03}" for i in range(10)]


def test_term_score_matches_the_formula(spark):
    rows = [("1", "a", "alpha", "beta beta gamma"), ("2", "b", "beta", "delta")]
    got = dict(run(spark, rows, query="beta", profile="bm25"))
    length = {"1": 4 + 4 + 2, "2": 2 + 4 + 2}  # title and body, url (https example com x), domain (example com)
    avg, idf = 9.0, math.log(1 + 0.5 / 2.5)
    for d, tf in (("1", 2), ("2", 1)):
        assert got[d] == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[d] / avg)), abs=1e-4)


def test_smallest_span_matches_brute_force(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    rows = [[sorted(r.sample(range(60), r.randrange(0, 5))) for _ in range(3)] for _ in range(80)]
    got = spark.createDataFrame([(x,) for x in rows], "at array<array<int>>").select(ranking.proximity([F.col("at")[i] for i in range(3)]).alias("p")).collect()
    for x, g in zip(rows, got, strict=True):
        best = min((max(c) - min(c) for c in [(a, b, d) for a in x[0] for b in x[1] for d in x[2]]), default=None)
        assert g.p == pytest.approx(0 if best is None else 1 / (1 + best))


def test_positions_run_over_fields(spark):
    rows = index.token_rows(docs(spark, [("1", "A-b", "Don't re-use X_y", "Straße ΣΑΣ")]), FIELDS).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(rows)))
    assert [r.term for r in rows if r.field == "title"] == ["don't", "re-use", "x", "y"]
    assert [r.term for r in rows if r.field == "body"] == ["strasse", "σασ"]


def test_segments_prune_and_merge(spark, tmp_path):
    path = str(tmp_path / "index")
    for k, text in enumerate(("alpha beta", "alpha gamma gamma")):
        made = index.add_segment(spark, path, docs(spark, [("1", "a", None, text), (f"only{k}", "b", "omega", None)]), FIELDS, k, buckets=8)
    # A document's newest version counts, with all its terms.
    want = {("alpha", "1", 1), ("gamma", "1", 2), ("omega", "only0", 1), ("omega", "only1", 1)}
    terms = ["alpha", "gamma", "beta", "omega"]
    assert {(r.term, r.doc_id, r.tf) for r in made.postings(terms).collect()} == want
    assert index.maintain(made, 2) is made
    merged = index.maintain(made, 1)
    assert len(merged.segments) == 1 and merged.docs == 3 and len(made.segments) == 2
    assert {(r.term, r.doc_id, r.tf) for r in merged.postings(terms).collect()} == want
    assert merged.frequencies(terms) == {"alpha": 1, "gamma": 1, "omega": 2}
    assert {r.doc_id for r in merged.documents().collect()} == {"1", "only0", "only1"}
    assert [r.healthy for r in index.verify(merged).collect()] == [True]
    left = index.active(merged.postings(), spark.createDataFrame([("2",)], "doc_id string"))
    assert left.count() == 0


def test_only_the_buckets_of_terms_are_read(spark):
    made = built(spark, [("1", "a", "Alpha", "alpha beta")])
    found = search.search(made, "alpha beta", profile="full")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in found and "text" not in found
    assert "BroadcastHashJoin" in search.candidates(made, ["alpha", "beta"], "and")._jdf.queryExecution().executedPlan().toString()


def test_a_damaged_segment_is_told(spark, tmp_path):
    made = index.add_segment(spark, str(tmp_path), docs(spark, [("1", "a", "Alpha", "alpha beta"), ("2", "b", "Beta", "x")]), FIELDS, buckets=1)
    assert [r.healthy for r in index.verify(made).collect()] == [True]
    at = str(tmp_path / "postings" / "segment_id=0" / "bucket=0")
    rows = spark.read.parquet(at).collect()
    spark.createDataFrame(rows[1:], "term string, doc_id string, tf int, positions array<int>, length int, fields int").write.mode("overwrite").parquet(at)
    assert [r.healthy for r in index.verify(index.Index.open(spark, str(tmp_path))).collect()] == [False]


def test_compatibility_characters(spark):
    rows = [("1", "a", None, "the ﬁle system"), ("2", "b", None, "the file system"), ("3", "c", None, "ｆｉｌｅ"), ("4", "d", None, "files")]
    assert {d for d, _ in run(spark, rows, query="file", profile="bm25")} == {"1", "2", "3"}
    assert {d for d, _ in run(spark, rows, query="ﬁLE", profile="bm25")} == {"1", "2", "3"}


def test_copies_count_less_and_inactive_documents_nothing(spark):
    rows = [(str(i), "search", "Search Technology", "search technology information") for i in range(4)]
    scores = dict(run(spark, rows, flags=[("1", True, False, True), ("2", False, True, True), ("3", False, False, False)]))
    # 1 + .1 x .5 (freshness) + .1 x .4 (quality) + .05 x .8 (trust) - .2 x .5 (one word of three: spam), less the penalty
    base = scores["0"]
    factor = 1 + 0.05 + 0.1 * (0.2 + 0.2) + 0.05 * 0.8 - 0.2 * 0.35
    assert scores["1"] == pytest.approx(base * (factor - 0.15) / factor, rel=1e-4)
    assert scores["2"] == pytest.approx(base * (factor - 0.15 * 0.45) / factor, rel=1e-4)
    assert scores["3"] == 0


def test_structural_fields(spark):
    """A document's factor is that of the field that holds the query."""
    factors = {"headings": 2.0, "anchor_text": 0.75, "navigation": 0.25, "sidebar": 0.2, "footer": 0.05, "canonical_url": 4.0, "domain": 4.0}
    rows = [(f, "other words", *["zebra" if f == g else None for g in factors]) for f in factors]
    made = spark.createDataFrame(rows, "doc_id string, title string, " + ", ".join(f"{f} string" for f in factors))
    one = index.add_segment(spark, scratch(spark, "index"), made, [("title", "title"), *[(f, f) for f in factors]], buckets=2)
    n = len(factors)
    term = math.log(1 + 0.5 / (n + 0.5)) * 2.2 / (1 + 1.2)
    signals = 1 + 0.1 * 0.5 + 0.1 * 0.2 + 0.05 * (0.45 + 0.1 - 0.2)  # unknown age, a title, no url
    got = {r.doc_id: r.score for r in search.search(one, "zebra", profile="full").collect()}
    assert got == {f: pytest.approx((term + 1) * signals * x, abs=1e-4) for f, x in factors.items()}


def test_phrases_fields_and_exclusions(spark):
    rows = [("1", "a", "Alpha", "red green blue"), ("2", "b", "Beta", "green red blue"), ("3", "c", "Alpha", "red green black")]
    ask = lambda q: {d for d, _ in run(spark, rows, query=parse(q), profile="bm25")}
    assert ask('"red green"') == {"1", "3"} and ask('"red green" NOT black') == {"1"}
    assert ask("blue title:alpha") == {"1", "3"} and ask("red intitle:beta") == {"2"} and ask("nowhere title:gamma") == set()
    assert [d for d, _ in run(spark, rows, query=parse("red blue NOT beta"), profile="bm25", mode="and")] == ["1"]


def test_rarest_first():
    assert search.selectivity({"a": 5, "b": 2, "c": 5}, ["a", "b", "c", "d"]) == ["d", "b", "a", "c"]
