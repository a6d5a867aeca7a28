"""Keyword search over a stored index: retrieval, scoring, top results.

A search reads the buckets of its terms only. Its statistics (documents, average length, frequencies of the terms) are
stored; lengths and fields stand in the postings themselves; the full profile joins the candidates with the stored
signals of documents. No text is read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.query import Query
from tidemark.functions.text import folded
from tidemark.operators import ranking
from tidemark.operators.index import Index

#: Postings of the rarest term up to which they're broadcast to those of the others.
BROADCAST_POSTINGS = 100_000


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query in order of their first place."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", folded(query))))


def selectivity(frequencies: dict[str, int], terms: Sequence[str]) -> list[str]:
    """Terms in the order in which they're looked up: the rarest first, then by their place in the query."""
    return sorted(terms, key=lambda t: (frequencies.get(t, 0), terms.index(t)))


def candidates(index: Index, terms: Sequence[str], mode: str = "or", columns: Sequence[str] = ("tf", "positions", "fields"), frequencies: dict[str, int] | None = None) -> DataFrame:
    """Documents with any (or) or every (and) term: doc_id, length, and ``<column><i>`` for each term i, null where it's absent.

    Postings of all terms are added up by document, in one shuffle of the terms' buckets. Where every term is asked for,
    the rarest one's documents come first: a short list is broadcast to the others, whose postings are never shuffled; a
    term without postings ends the search before any is read.
    """
    known = index.frequencies(terms) if frequencies is None else frequencies
    names = [f"{c}{i}" for i in range(len(terms)) for c in columns]

    def of(i: int) -> DataFrame:
        return index.postings([terms[i]]).select("doc_id", "length", *[F.col(c).alias(f"{c}{i}") for c in columns])

    if not known or (mode == "and" and len(known) < len(terms)):
        some = index.postings(terms[:1]).where(F.lit(False))
        return some.select("doc_id", "length", *[F.lit(None).cast(dict(some.dtypes)[c]).alias(f"{c}{i}") for i in range(len(terms)) for c in columns])
    rarest = selectivity(known, terms)
    if len(terms) == 1:
        return of(0)
    if mode == "and" and known[rarest[0]] <= BROADCAST_POSTINGS:
        at = [terms.index(t) for t in rarest]
        return reduce(lambda found, i: of(i).join(F.broadcast(found.drop("length")), "doc_id"), at[1:], of(at[0])).select("doc_id", "length", *names)  # BROADCAST_POSTINGS rows at most
    rows = index.postings(terms).select("doc_id", "length", "term", F.struct(*columns).alias("p"))
    sums = rows.groupBy("doc_id").agg(F.first("length").alias("length"), *[F.first(F.when(F.col("term") == t, F.col("p")), ignorenulls=True).alias(f"p{i}") for i, t in enumerate(terms)])
    if mode == "and":
        sums = sums.where(reduce(Column.__and__, [F.col(f"p{i}").isNotNull() for i in range(len(terms))]))
    return sums.select("doc_id", "length", *[F.col(f"p{i}.{c}").alias(f"{c}{i}") for i in range(len(terms)) for c in columns])


def matched_terms(terms: Sequence[str], column: str = "tf") -> Column:
    """Terms of the query that a candidate holds, in the query's order."""
    return F.filter(F.array(*[F.when(F.col(f"{column}{i}").isNotNull(), F.lit(t)) for i, t in enumerate(terms)]), lambda x: x.isNotNull())


def bm25(index: Index, terms: Sequence[str], frequencies: dict[str, int]) -> Column:
    docs = F.lit(float(index.docs))
    scores = [ranking.term_score(F.col(f"tf{i}"), F.col("length"), ranking.idf(docs, F.lit(float(frequencies.get(t, 0)))), index.average_length) for i, t in enumerate(terms)]
    return sum(scores, F.lit(0.0))


def _hits(terms: Sequence[str], numbers: Sequence[int], at: Sequence[int] | None = None) -> Column:
    """How many terms stand in any of the fields with these numbers."""
    mask = sum(1 << n for n in numbers)
    return sum((F.when(F.coalesce(F.col(f"fields{i}").bitwiseAND(mask), F.lit(0)) != 0, 1).otherwise(0) for i in (at if at is not None else range(len(terms)))), F.lit(0))


def _wanted(index: Index, terms: Sequence[str], parsed: Query) -> Column:
    """What a parsed query asks for besides its terms: whole phrases, terms in fields, none of what is excluded."""
    there = lambda t: F.col(f"tf{terms.index(t)}").isNotNull()
    number = {f: n for n, f in enumerate(index.fields)}
    out = F.lit(True)
    for p in parsed.phrases:
        at = [F.col(f"positions{terms.index(t)}") for t in p]
        out = out & reduce(Column.__and__, [there(t) for t in p]) & (F.size(ranking.phrase_places(at)) > 0)
    for name, value in parsed.fields:
        for t in query_terms(value):
            out = out & (_hits(terms, [number[name]], [terms.index(t)]) > 0 if name in number else F.lit(False))
    for t in parsed.excluded:
        out = out & ~there(t)
    return out


def search(index: Index, query: str | Query, *, mode: str = "or", k: int = 10, profile: str = "bm25", now: float = 0.0) -> DataFrame:
    """Top k documents: doc_id, score, matched (number of matched terms), rank.

    profile ``bm25``: term scores alone. ``full``: with coverage, proximity, title and url bonuses, quality signals and
    field multiplier; of queries of several terms, documents with fewer than half of them drop out unless title, url or
    domain holds a term. Order: score, matched terms, smaller id. An empty query gives no rows. A parsed query
    (``functions.query.parse``) also holds its phrases, fields and exclusions; excluded terms don't score.
    """
    parsed = query if isinstance(query, Query) else None
    text = folded(" ".join(parsed.terms) if parsed else query).strip()
    scored = list(dict.fromkeys([*parsed.terms, *(t for p in parsed.phrases for t in p), *(t for _, v in parsed.fields for t in query_terms(v))])) if parsed else query_terms(query)
    terms = [*scored, *(t for t in (parsed.excluded if parsed else []) if t not in scored)]
    empty = "doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("matched"), F.lit(0).alias("rank")
    if not scored or not index.segments:
        return index.documents().select(*empty).limit(0) if index.segments else index.spark.createDataFrame([], "doc_id long, score double, matched int, rank int")
    frequencies = index.frequencies(terms)
    full = profile != "bm25"
    columns = ("tf", "positions", "fields") if full or parsed else ("tf",)
    if mode == "and" and len(terms) > len(scored):
        found = candidates(index, terms, "or", columns, frequencies).where(reduce(Column.__and__, [F.col(f"tf{i}").isNotNull() for i in range(len(scored))]))
    else:
        found = candidates(index, terms, mode, columns, frequencies)
    if parsed:
        found = found.where(_wanted(index, terms, parsed))
    n = len(scored)
    matched = sum((F.when(F.col(f"tf{i}").isNotNull(), 1).otherwise(0) for i in range(n)), F.lit(0))
    rows = found.withColumn("matched", matched).where("matched > 0").withColumn("bm25", bm25(index, scored, frequencies))
    if not full:
        rows = rows.select("doc_id", "matched", F.round("bm25", 6).alias("score"))
    else:
        number = {f: i for i, f in enumerate(index.fields)}
        at = {f: [number[f]] for f in number} | {"url": [number[f] for f in ("url", "canonical_url") if f in number]}
        hits = {f: _hits(scored, ns) for f, ns in at.items() if ns}
        strong = sum((hits.get(f, F.lit(0)) for f in ("title", "url", "domain")), F.lit(0)) > 0
        rows = rows.select("doc_id", "matched", "bm25", ranking.proximity([F.col(f"positions{i}") for i in range(n)]).alias("near"), strong.alias("strong"), *[c.alias(f"in_{f}") for f, c in hits.items()])
        if n > 1:
            rows = rows.where((F.col("matched") >= (n + 1) // 2) | F.col("strong"))
        d = rows.join(index.documents(), "doc_id")
        title, url = F.col("title"), F.col("url")
        bonus = 8 * ranking.title_bonus(text, title) + 4 * 3 * ranking.substring_share(scored, title) + 3 * 1.5 * ranking.substring_share(scored, url)
        factor = ranking.adjustment(ranking.freshness(F.col("crawled"), now), F.col("quality"), F.col("trust"), F.col("spam"), F.col("duplicate"), F.col("active"))
        factor = factor * ranking.field_multiplier(text, n, title, url, {f: F.col(f"in_{f}") for f in hits})
        rows = d.select("doc_id", "matched", F.round((F.col("bm25") + F.col("matched") / n + F.col("near") + bonus) * factor, 6).alias("score"))
    best = rows.orderBy(F.col("score").desc(), F.col("matched").desc(), "doc_id").limit(k)
    # k rows: they may be numbered in one task.
    return best.select("doc_id", "score", "matched").withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("matched").desc(), "doc_id")))
