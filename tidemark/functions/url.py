"""Url expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that span a space of views rather than pages, path patterns alike, and static files.
VIEW_PARAMETERS = ["sort", "order", "filter", "filters", "facet", "facets", "category", "categories", "tag", "tags", "page", "offset", "limit", "start", "cursor", "price", "min_price", "max_price", "rating", "color", "size", "brand", "brands", "search", "query", "q"]
VIEW_PATHS = r"(?i)/(?:(?:page|p|offset|start)/\d+|search|filters?|facets?)(?:/|$)"
STATIC = r"(?i)\.(?:jpg|jpeg|png|gif|webp|svg|ico|mp3|wav|ogg|mp4|webm|avi|mov|zip|gz|tar|rar|7z|exe|dmg|iso)$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """Host of a url in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def parameters(url: Column) -> Column:
    """``name=value`` parts of the query."""
    q = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.array_remove(F.split(q, "&"), "")


def is_valid(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (host(url) != "")


def is_host(name: Column) -> Column:
    """Whether a cleaned name is a host: labels of letters, digits and inner hyphens, at least two, 253 characters at most."""
    return (F.length(name) <= 253) & name.rlike(r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$")


def registrable(name: Column) -> Column:
    """Last two labels of a host: the registrable domain, but for public suffixes of several labels."""
    return F.regexp_extract(name, r"[^.]+\.[^.]+$", 0)


def crawl_space(url: Column, deepest: int = 20, most_parameters: int = 12) -> Column:
    """Score from 0 to 100: how far a url looks like a page rather than one of many views of the same."""
    segments = F.array_remove(F.split(path(url), "/"), "")
    names = F.transform(parameters(url), lambda p: F.lower(F.substring_index(p, "=", 1)))
    n, views = F.size(names), F.size(F.filter(names, lambda x: x.isin(VIEW_PARAMETERS)))
    pattern = path(url).rlike(VIEW_PATHS)
    shapes = F.transform(segments, lambda s: F.regexp_replace(F.lower(s), r"\d+", "{n}"))
    most = F.array_max(F.transform(shapes, lambda s: F.size(F.filter(shapes, lambda x: x == s))))
    numeric = F.size(F.filter(segments, lambda s: s.rlike(r"^\d+$")))
    score = (
        F.lit(100)
        - F.least(n * 3, F.lit(18))
        - F.least(views * 7, F.lit(28))
        - F.when(n > most_parameters, 20).otherwise(0)
        - F.when(pattern, 30).otherwise(0)
        - F.when((numeric >= 3) & ~pattern, 8).otherwise(0)
        - F.when((F.size(segments) >= 5) & (most >= 3), 15).otherwise(0)
        - F.when(F.size(segments) > deepest, 15).otherwise(0)
    )
    return F.when(path(url).rlike(STATIC), 0).otherwise(F.greatest(score, F.lit(0)))
