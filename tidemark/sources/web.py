"""Sources of hosts and urls: pages, sitemaps, feeds, certificate logs, JSON lines, key prefixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clean_host
from tidemark.functions.udfs import html_page, url_join


def pages(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages (url, html) with what they hold, one struct of columns each."""
    return df.select("*", html_page(F.col(url), F.col(html)).alias("page")).select(*df.columns, "page.*")


def links(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, link): distinct absolute http(s) links of pages, without fragments."""
    return pages(df, url, html).select(F.col(url).alias("url"), F.explode("links").alias("link")).distinct()


def sitemap_locations(df: DataFrame, xml: str = "xml") -> DataFrame:
    """(kind, loc): entries of sitemaps (urlset) and sitemap indexes. Namespaces are dropped first."""
    bare = F.regexp_replace(F.col(xml), r'\sxmlns(:\w+)?="[^"]*"', "")
    found = df.select(F.when(bare.rlike(r"<sitemapindex[\s>]"), "sitemap").otherwise("url").alias("kind"), F.explode(F.xpath(bare, F.lit("//loc/text()"))).alias("loc"))
    return found.select("kind", F.trim("loc").alias("loc")).where("loc <> ''")


def feed_links(df: DataFrame, url: str = "url", xml: str = "xml") -> DataFrame:
    """(url, link): links of RSS (text) and Atom (href) feeds, absolute."""
    bare = F.regexp_replace(F.col(xml), r'\sxmlns(:\w+)?="[^"]*"', "")
    raw = F.concat(F.xpath(bare, F.lit("//link/text()")), F.xpath(bare, F.lit("//link/@href")))
    found = df.select(F.col(url).alias("url"), F.explode(raw).alias("raw"))
    return found.select("url", url_join("url", F.trim("raw")).alias("link")).where("link is not null").distinct()


def feed_endpoints(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, link): feeds that pages announce."""
    tag = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<link\b[^>]*type=[\"']application/(?:rss|atom)\+xml[\"'][^>]*>)"), F.lit(1)))
    found = df.select(F.col(url).alias("url"), tag.alias("tag"))
    return found.select("url", url_join("url", F.regexp_extract("tag", r"(?i)href=[\"']([^\"']*)", 1)).alias("link")).where("link is not null").distinct()


def certificate_names(df: DataFrame, json: str = "json") -> DataFrame:
    """Distinct host names of certificate log records (JSON arrays of name_value, one name a line); wildcards lose their star."""
    records = F.from_json(json, "array<struct<name_value string, common_name string>>")
    each = df.select(F.explode(records).alias("r")).select(F.explode(F.split(F.concat_ws("\n", "r.name_value", "r.common_name"), "\n")).alias("name"))
    return each.select(clean_host(F.regexp_replace("name", r"^\*\.", "")).alias("hostname")).where("hostname is not null").distinct()


def federated(sources: dict[str, DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Union of candidate tables with the source each row came from; of rows with one key the one of the first source."""
    from pyspark.sql import Window

    both = reduce(DataFrame.unionByName, [df.select(*columns).withColumn("source", F.lit(n)).withColumn("__o", F.lit(i)) for i, (n, df) in enumerate(sources.items())])
    w = Window.partitionBy(key).orderBy("__o", *[F.col(c) for c in columns if c != key])
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__o")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def objects(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(key, length, modified) of stored files whose key begins with a prefix, as keys relative to the path."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = base.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(base).getPath().toUri().getPath()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    key = F.regexp_replace(F.substring_index("path", root.rstrip("/"), -1), "^/", "")
    return files.select(key.alias("key"), "length", "modified").where(F.col("key").startswith(prefix)).orderBy("key")


def valid_links(link: Column) -> Column:
    return link.rlike(r"^(?i)https?://[^/?#]+")
