"""Parts of a document's score as expressions: term scores, bonuses, signals of its texts, field multiplier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Factor of a document by the field that represents the query best, in order; none of them.
EXACT_TITLE, ALL_TITLE, ALL_URL, ANY_TITLE, ANY_URL, ALL_DOMAIN, ANY_DOMAIN = 8.0, 5.0, 4.0, 2.5, 2.0, 4.0, 2.0
ANY_HEADING, ANY_BODY, ANY_ANCHOR, ANY_NAVIGATION, ANY_SIDEBAR, ANY_FOOTER, NONE = 2.0, 1.0, 0.75, 0.25, 0.20, 0.05, 0.25
#: Weights of the signals of a document's texts.
FRESH, QUALITY, TRUST, SPAM, DUPLICATE = 0.10, 0.10, 0.05, 0.20, 0.15
#: What marks a url as spam.
SPAM_URL = "casino|betting|viagra|payday-loan"


def idf(docs: Column, df: Column) -> Column:
    df = F.least(df, docs)
    return F.when((docs > 0) & (df > 0), F.log1p((docs - df + 0.5) / (df + 0.5))).otherwise(0.0)


def term_score(tf: Column, length: Column, weight: Column, average_length: float) -> Column:
    """BM25 of one term; 0 where the document hasn't it."""
    norm = K1 * (1 - B + B * length / F.lit(average_length))
    return F.coalesce(weight * tf * (K1 + 1) / (tf + norm), F.lit(0.0))


def proximity(at: Sequence[Column]) -> Column:
    """1 / (1 + smallest span that holds a place of every term); 0 for a term without place or a single term.

    at: sorted places of each term. The places of all terms are merged in order and gone through once, with the last
    place of each term kept: the smallest span ends at some place and reaches back to the oldest of those.
    """
    n = len(at)
    if n < 2:
        return F.lit(0.0)
    none = -(1 << 30)

    def numbered(i: int) -> Column:
        return F.transform(F.coalesce(at[i], F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), F.lit(i).alias("t")))

    merged = F.array_sort(F.flatten(F.array(*map(numbered, range(n)))))
    start = F.struct(*[F.lit(none).alias(f"l{i}") for i in range(n)], F.lit(1 << 30).alias("best"))

    def step(s: Column, x: Column) -> Column:
        last = [F.when(x["t"] == i, x["p"]).otherwise(s[f"l{i}"]) for i in range(n)]
        low = F.least(*last)
        return F.struct(*[v.alias(f"l{i}") for i, v in enumerate(last)], F.when(low >= 0, F.least(s["best"], x["p"] - low)).otherwise(s["best"]).alias("best"))

    best = F.aggregate(merged, start, step)["best"]
    return F.when(best < (1 << 30), 1 / (1 + best)).otherwise(0.0)


def gap_proximity(positions: Column) -> Column:
    """1 / (1 + average gap) of a term's places in order; 0 below two."""
    n = F.size(positions)
    return F.when(n >= 2, 1 / (1 + (F.array_max(positions) - F.array_min(positions)) / (n - 1))).otherwise(0.0)


def phrase_places(at: Sequence[Column]) -> Column:
    """Places at which terms stand one after another."""
    return F.filter(at[0], lambda p: _all([F.array_contains(a, p + k) for k, a in enumerate(at) if k]))


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def quality(title: Column, words: Column) -> Column:
    """Length and variety of a text's ASCII words, and whether it has a title."""
    n = F.size(words)
    score = F.when(F.length(F.trim(F.coalesce(title, F.lit("")))) > 0, 0.2).otherwise(0.0)
    for least, part in ((20, 0.2), (100, 0.15), (300, 0.15), (800, 0.1)):
        score = score + F.when(n >= least, part).otherwise(0.0)
    return score + F.when(n > 0, F.least(F.lit(0.2), 0.2 * F.size(F.array_distinct(words)) / n)).otherwise(0.0)


def top_share(words: Column) -> Column:
    """Share of the most frequent word: the longest run in the sorted words."""
    runs = F.aggregate(
        F.sort_array(words),
        F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("best")),
        lambda s, w: F.struct(w.alias("w"), F.when(s["w"] == w, s["n"] + 1).otherwise(1).alias("n"), F.greatest(s["best"], F.when(s["w"] == w, s["n"] + 1).otherwise(1)).alias("best")),
    )
    return runs["best"] / F.greatest(F.size(words), F.lit(1))


def spam(title: Column, words: Column, url: Column, share: Column) -> Column:
    """Repetition of one word (``share`` of the most frequent), marked urls, long titles."""
    score = F.when(share >= 0.4, 0.65).when(share >= 0.25, 0.35).otherwise(0.0)
    score = score + F.when((F.size(words) >= 12) & (share >= 0.25), 0.15).otherwise(0.0)
    score = score + F.when(F.lower(F.coalesce(url, F.lit(""))).rlike(SPAM_URL), 0.1).otherwise(0.0)
    score = score + F.when(F.size(F.split(F.trim(F.coalesce(title, F.lit(""))), r"\s+")) > 25, 0.1).otherwise(0.0)
    return F.when(F.size(words) > 0, F.least(score, F.lit(1.0))).otherwise(0.0)


def trust(url: Column, title: Column, words: Column) -> Column:
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    score = F.lit(0.45) + F.when(u.startswith("https://"), 0.2).otherwise(0.0)
    score = score + F.when(F.length(F.coalesce(title, F.lit(""))) > 0, 0.1).otherwise(0.0)
    score = score + F.when(F.size(words) >= 100, 0.1).otherwise(0.0)
    score = score + F.when(u != "", 0.05).otherwise(0.0)
    return score - F.when(~u.contains("://") | u.contains(" "), 0.2).otherwise(0.0)


def freshness(crawled: Column, now: float, half_life_days: float = 30.0) -> Column:
    """Half-life decay of the age in seconds; 0.5 where it isn't known."""
    return F.when(crawled.isNull(), 0.5).otherwise(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), now - crawled) / (max(1.0, half_life_days) * 86400)))


def duplicate_penalty(exact: Column, possible: Column) -> Column:
    """1 for an exact copy, 0.45 for a possible one (fixed values)."""
    return F.when(exact, 1.0).when(possible, 0.45).otherwise(0.0)


def adjustment(fresh: Column, quality_: Column, trust_: Column, spam_: Column, duplicate: Column, active: Column) -> Column:
    """Factor of a document by the signals of its texts; 0 where it isn't active."""
    return F.when(~active, 0.0).otherwise(1 + FRESH * fresh + QUALITY * quality_ + TRUST * trust_ - SPAM * spam_ - DUPLICATE * duplicate)


def substring_share(terms: Sequence[str], folded: Column) -> Column:
    """Share of the terms that stand in a folded text, as substrings."""
    return sum((F.when(folded.contains(t), 1).otherwise(0) for t in terms), F.lit(0)) / len(terms)


def title_bonus(query: str, folded: Column) -> Column:
    """query: folded, without space around it."""
    t = F.trim(folded)
    return F.lit(0.0) if not query else F.when(t == "", 0.0).when(t == query, 5.0).when(t.contains(query), 1.5).otherwise(0.0)


def field_multiplier(query: str, n: int, title: Column, url: Column, hits: dict[str, Column]) -> Column:
    """Factor by the field in which the query is represented best; the first case that holds. hits: terms in a field."""
    of = lambda f: hits.get(f, F.lit(0))
    return (
        F.when(F.lit(query != "") & (title == query), EXACT_TITLE)
        .when(of("title") == n, ALL_TITLE)
        .when((of("url") == n) | (F.lit(query != "") & url.contains(query)), ALL_URL)
        .when(of("title") > 0, ANY_TITLE)
        .when(of("url") > 0, ANY_URL)
        .when(of("domain") == n, ALL_DOMAIN)
        .when(of("domain") > 0, ANY_DOMAIN)
        .when(of("headings") > 0, ANY_HEADING)
        .when(of("body") > 0, ANY_BODY)
        .when(of("anchor_text") > 0, ANY_ANCHOR)
        .when(of("navigation") > 0, ANY_NAVIGATION)
        .when(of("sidebar") > 0, ANY_SIDEBAR)
        .when(of("footer") > 0, ANY_FOOTER)
        .otherwise(NONE)
    )
