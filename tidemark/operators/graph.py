"""Link graphs and triples: degrees, diversity, reciprocity, paths, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize


def edges(links: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target, links): distinct edges with their number of links; null ends and loops are left out."""
    s, t = F.col(source), F.col(target)
    return links.where(s.isNotNull() & t.isNotNull() & (s != t)).groupBy(s.alias("source"), t.alias("target")).agg(F.count("*").alias("links"))


def saturation(x: Column, full: float = 1000.0) -> Column:
    """log1p(x) / log1p(full), within 0 and 1."""
    return F.least(F.lit(1.0), F.log1p(F.greatest(x, F.lit(0))) / F.log1p(F.lit(full)))


def inbound(edge: DataFrame, domain: Column) -> DataFrame:
    """For each target: links, linking hosts and domains, their logarithmic scores and one-hop authority."""
    by_domain = edge.withColumn("domain", domain).groupBy("target", "domain").agg(F.sum("links").alias("links"), F.count("*").alias("hosts"))
    out = by_domain.groupBy("target").agg(F.sum("links").alias("links"), F.sum("hosts").alias("hosts"), F.count("*").alias("domains"))
    return out.withColumn("volume", F.round(saturation(F.col("links")), 6)).withColumn("diversity", F.round(F.col("domains") / F.col("links"), 6)).withColumn("authority", F.round((saturation(F.col("links")) + saturation(F.col("hosts")) + saturation(F.col("domains"))) / 3, 6))


def spread_of(edge: DataFrame, domain: Column) -> DataFrame:
    """For each target: how evenly its sources link (population variance, 1 - its root), and whether many links come of few
    domains (10 links or more, 0.7 of them beyond the first of a domain) or there is a flood of them."""
    each = edge.withColumn("domain", domain)
    domains = each.groupBy("target", "domain").agg(F.sum("links").alias("links")).groupBy("target").agg(F.count("*").alias("domains"))
    out = edge.groupBy("target").agg(F.var_pop("links").alias("variance"), F.count("*").alias("sources"), F.sum("links").alias("links")).join(domains, "target")
    few = (F.col("links") >= 10) & (1 - F.col("domains") / F.col("links") >= 0.7)
    flood = F.log1p("links") / F.log1p(F.lit(1_000_000.0)) >= 0.8
    return out.select("target", F.round("variance", 6).alias("variance"), F.round(F.greatest(F.lit(0.0), 1 - F.sqrt("variance")), 6).alias("evenness"), few.alias("few_domains"), flood.alias("flooded"), "sources")


def reciprocal(edge: DataFrame) -> DataFrame:
    """Pairs that link to each other, each once, by the order of their names."""
    pair = edge.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), (F.col("source") < F.col("target")).alias("forth"), "links")
    return pair.groupBy("a", "b").agg(F.max("forth").alias("forth"), F.min("forth").alias("back"), F.sum("links").alias("links")).where("forth and not back").select("a", "b", "links")


def within(edge: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, hops): everything reached from the start nodes in at most ``depth`` hops, with the fewest hops.

    Breadth first: each round joins only the nodes that are new, and is written, so that plans stay short.
    """
    graph = edge.select("source", "target").distinct()
    seen = materialize(starts.select("node").where(F.col("node").isNotNull()).distinct().withColumn("hops", F.lit(0)), "reached")
    newest = seen
    for k in range(1, depth + 1):
        step = graph.join(newest.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        newest = materialize(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(k)), "reached")
        seen = seen.unionByName(newest)
    return seen


def conflicts(facts: DataFrame) -> DataFrame:
    """(subject, predicate) with several values: their number, and the first and second in order."""
    each = facts.where(F.col("value").isNotNull()).select("subject", "predicate", "value").distinct()
    n = each.groupBy("subject", "predicate").agg(F.count("*").alias("values")).where("values > 1")
    rank = F.row_number().over(Window.partitionBy("subject", "predicate").orderBy("value"))
    two = each.withColumn("__n", rank).where("__n <= 2").groupBy("subject", "predicate").agg(F.max(F.when(F.col("__n") == 1, F.col("value"))).alias("first"), F.max(F.when(F.col("__n") == 2, F.col("value"))).alias("second"))
    return n.join(two, ["subject", "predicate"])


def spread(activation: DataFrame, edge: DataFrame, decay: float = 0.75) -> DataFrame:
    """One hop of activation: each neighbour gets the strongest ``decay`` times what reaches it, next to its own."""
    passed = edge.join(activation.select(F.col("node").alias("source"), "strength"), "source").select(F.col("target").alias("node"), (F.col("strength") * decay).alias("strength"))
    return activation.unionByName(passed).groupBy("node").agg(F.max("strength").alias("strength"))


def components(edge: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest name in each node's connected component, edges (source, target) taken both ways.

    Alternating stars: in turn every node's larger and smaller neighbours are tied to its smallest one, until nothing
    moves; rounds grow with the logarithm of the size. Edges are only ever rewritten, never paired, and a hub's edges
    are cut to their minimum by a partial aggregation in each task. Every round is written, so plans stay short. Where
    ``most_rounds`` is given and labels still move after that many rounds, it raises.
    """
    e = edge.where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target"))).select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct()
    e = materialize(e, "stars")
    nodes = materialize(e.select(F.col("u").alias("node")).union(e.select("v")).distinct(), "nodes")
    before, rounds = None, 0
    while True:
        if rounds == most_rounds:
            raise RuntimeError(f"components still move after {most_rounds} rounds")
        rounds += 1
        # Large star: all larger neighbours of a node go to the smallest of its neighbourhood.
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the smaller neighbours of a node, and itself, go to the smallest.
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
