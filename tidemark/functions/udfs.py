"""Arrow UDFs for what Spark has no function for: full case folding, HTML structure, url parts."""

from __future__ import annotations

import sys
import unicodedata
from html.parser import HTMLParser
from urllib.parse import parse_qsl, quote, unquote, urldefrag, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship

ship(sys.modules[__name__])

#: Parameters that only track visitors.
TRACKING = {"utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "dclid", "fbclid", "msclkid", "mc_cid", "mc_eid"}
#: Elements without visible text, and regions of a page.
HIDDEN = {"script", "style", "noscript", "template"}
REGIONS = {"article": "main", "main": "main", "nav": "navigation", "footer": "footer", "aside": "sidebar"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARTS = ("title", "canonical", "text", "main", "headings", "navigation", "footer", "sidebar", "anchor_text")
PAGE = T.StructType([*(T.StructField(x, T.StringType()) for x in PARTS), T.StructField("links", T.ArrayType(T.StringType()))])


@F.pandas_udf(T.StringType())
def nfkc_fold(text: pd.Series) -> pd.Series:
    """Compatibility-normalised, case-folded text; null gives the empty text."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x).casefold() if isinstance(x, str) else "")


def canonical_url(url: str | None) -> str | None:
    """A url in one form: lower-case scheme and host, no default port, dot segments, tracking parameters or fragment,
    parameters in order. None for what is no http(s) url."""
    if not isinstance(url, str):
        return None
    try:
        u = urlsplit(url.strip())
        scheme, host, port = u.scheme.lower(), (u.hostname or "").rstrip(".").lower(), u.port
    except ValueError:
        return None
    if scheme not in ("http", "https") or not host:
        return None
    try:
        host = host.encode("idna").decode("ascii")
    except UnicodeError:
        pass
    if port is not None and port != {"http": 80, "https": 443}[scheme]:
        host = f"{host}:{port}"
    user = ""
    if u.username is not None:
        secret = "" if u.password is None else ":" + quote(u.password, safe="")
        user = f"{quote(u.username, safe='')}{secret}@"
    path: list[str] = []
    for part in unquote(u.path).split("/"):
        if part == "..":
            del path[-1:]
        elif part not in ("", "."):
            path.append(part)
    query = sorted((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in TRACKING)
    return urlunsplit((scheme, user + host, "/" + "/".join(path), urlencode(query), ""))


@F.pandas_udf(T.StringType())
def url_normalize(url: pd.Series) -> pd.Series:
    return url.map(canonical_url)


def joined(base: str | None, link: str | None) -> str | None:
    """A link on a page, absolute and without fragment; None if it doesn't lead to an http(s) page."""
    try:
        out = urldefrag(urljoin(base or "", (link or "").strip()))[0]
        return out if link and urlsplit(out).scheme in ("http", "https") and urlsplit(out).netloc else None
    except ValueError:
        return None


#: Parameters that track, or begin so.
TRACKING_PREFIXES = ("utm_", "mc_", "fbclid", "gclid", "dclid", "msclkid", "ref_", "ref")


def prefixed_url(url: str | None) -> str | None:
    """A crawlable url with its parameters in their order, without those whose name begins with a tracking prefix; the
    scheme is written in small letters, the host has a dot. None for others."""
    text = (url or "").strip()
    if not text.startswith(("http://", "https://")):
        return None
    try:
        u = urlsplit(text)
        host, port = (u.hostname or "").rstrip("."), u.port
    except ValueError:
        return None
    if "." not in host:
        return None
    usual = {"http": 80, "https": 443}[u.scheme]
    kept = [(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if not k.casefold().startswith(TRACKING_PREFIXES)]
    return urlunsplit((u.scheme, host if port in (None, usual) else f"{host}:{port}", u.path.rstrip("/") or "/", urlencode(kept), ""))


@F.pandas_udf(T.StringType())
def url_prefixed(url: pd.Series) -> pd.Series:
    return url.map(prefixed_url)


@F.pandas_udf(T.StringType())
def url_join(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([joined(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


class Page(HTMLParser):
    """What a page holds, by region. A region lasts until its own end tag."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.canonical, self.links = base, None, []
        self.open: list[str] = []
        self.parts: dict[str, list[str]] = {k: [] for k in ("title", "text", "main", "headings", "navigation", "footer", "sidebar", "anchor_text")}

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and (x := joined(self.base, a.get("href"))):
            self.links.append(x)
        elif tag == "link" and "canonical" in (a.get("rel") or "").lower().split() and self.canonical is None:
            self.canonical = joined(self.base, a.get("href"))
        if tag in HIDDEN or tag in REGIONS or tag in HEADINGS or tag in ("title", "a"):
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data):
        if not data.strip() or HIDDEN & {*self.open}:
            return
        if "title" in self.open:
            self.parts["title"].append(data)
            return
        self.parts["text"].append(data)
        for tag in self.open:
            if tag in HEADINGS:
                self.parts["headings"].append(data)
            elif tag == "a":
                self.parts["anchor_text"].append(data)
        region = next((REGIONS[t] for t in reversed(self.open) if t in REGIONS), None)
        if region:
            self.parts[region].append(data)


def page_of(url: str | None, html: str | None) -> dict:
    p = Page(url or "")
    p.feed(html or "")
    p.close()
    return {k: " ".join(" ".join(v).split()) for k, v in p.parts.items()} | {"canonical": p.canonical, "links": list(dict.fromkeys(p.links))}


@F.pandas_udf(PAGE)
def html_page(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    """Title, canonical link, visible text, regions, headings, anchors and distinct links of pages."""
    return pd.DataFrame([page_of(u, h) for u, h in zip(url, html, strict=True)], columns=[*PARTS, "links"])


@F.pandas_udf(T.StringType())
def highlight(text: pd.Series, terms: pd.Series) -> pd.Series:
    """Marks every occurrence of a term with brackets, the longest term first; marks don't nest."""
    import re

    def one(t, ws):
        ws = sorted({w for w in (ws if ws is not None else []) if w}, key=lambda w: (-len(w), w))
        return re.sub("|".join(map(re.escape, ws)), lambda m: f"[{m.group()}]", t, flags=re.I) if t and ws else t or ""

    return pd.Series([one(t, w) for t, w in zip(text, terms, strict=True)], dtype=object)
