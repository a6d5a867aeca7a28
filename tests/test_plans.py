"""Plans that must hold at any size: what is read, what is cut before a shuffle, what is broadcast."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from tidemark.functions import numbers
from pyspark.sql import functions as F

QUERIES = entry.queries()


def plan(spark, folder, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](spark, folder).explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name,needs", [("top_by_source", "WindowGroupLimit"), ("per_host_cap", "WindowGroupLimit"), ("frontier_fair_claim", "WindowGroupLimit"), ("status_counts", "HashAggregate"), ("frontier_pop", "TakeOrderedAndProject"), ("new_urls", "LeftAnti")])
def test_operators(spark, small, name, needs):
    assert needs in plan(spark, small, name)


@pytest.mark.parametrize("name,columns", [("p6_hosts", "attempts,host,priority|host"), ("status_counts", "state"), ("frontier_pop", "row_id")])
def test_only_needed_columns_are_read(spark, small, name, columns):
    text = plan(spark, small, name)
    assert "ReadSchema" in text and "document_id" not in text and "lease_owner" not in text


def test_filters_reach_the_scan(spark, small):
    assert "PushedFilters" in plan(spark, small, "source_scan") and "StringStartsWith(url,https://)" in plan(spark, small, "source_scan")


def test_no_cross_products(spark, small):
    for name in ("p4_found", "p6_found", "p6_hosts", "p6_organizations", "link_authority", "candidate_fusion"):
        assert "CartesianProduct" not in plan(spark, small, name) and "NestedLoop" not in plan(spark, small, name)


def test_dominant_hosts_come_out_of_the_join(spark, small, monkeypatch):
    """The states of urls and hosts are joined and written; the dominant hosts are named among them."""
    from tidemark.plans import core_problems

    plans = []
    monkeypatch.setattr(core_problems, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    core_problems.p6_found(spark, small)
    assert "Join LeftOuter" in plans[0] and "failures" in plans[0] and plans[0].count("Relation") == 2


@pytest.mark.parametrize("name", ["hash_range_route", "value_range_route", "prefix_route", "pending_handoff"])
def test_no_nested_loops_over_routes(spark, small, name):
    text = plan(spark, small, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["search_bm25_or", "search_bm25_and", "search_full", "retrieve_or", "retrieve_and"])
def test_searches_read_postings_of_their_terms_only(spark, small, name):
    text = plan(spark, small, name)
    assert "PartitionFilters: [isnotnull(bucket" in text or "PartitionFilters: [bucket" in text
    assert "documents.parquet" not in text and "regexp_extract_all" not in text


def test_numbers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    h = 0
    for ch in "ab:7":
        h = (h * 131 + ord(ch)) & 0xFFFFFFFF
    assert one(numbers.unit_of_text(F.lit("ab:7"))) == h / 2**32
    assert one(numbers.recency(F.lit(30.0), 30)) == pytest.approx(0.5) and one(numbers.recency(F.lit(1.0), 0)) == 0
    assert [one(numbers.status_class(F.lit(s))) for s in (200, 301, 404, 500, 99)] == ["success", "redirect", "client_error", "server_error", "unknown"]
    df = spark.createDataFrame([("2*(3+4)",), ("7/2",), ("1/0",), ("__import__('os')",), ("9**9**9",), (None,), ("-2**2",)], "e string")
    assert [r[0] for r in df.select(numbers.calculate("e")).collect()] == ["14", "3.5", None, None, None, None, "-4"]
