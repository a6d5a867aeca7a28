"""Presentation of results: snippets, concepts, related results, sentences and facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import ascii_words, fold

#: Words that are no concepts.
STOP = ["the", "and", "for", "with", "that", "this", "from", "what", "when", "where", "which", "into", "about", "have", "has", "are", "was", "were", "how", "why"]


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def snippet(text: Column, terms: Sequence[str], size: int = 180) -> Column:
    """Up to ``size`` characters around the earliest term, with an ellipsis where text is left out."""
    t = squeeze(text)
    places = [F.nullif(F.instr(F.lower(t), F.lit(x.lower())), F.lit(0)) for x in terms]
    at = F.least(*places) - 1 if len(places) > 1 else places[0] - 1
    start = F.greatest(F.lit(0), at - size // 2)
    end = F.least(F.length(t), start + size)
    start = F.greatest(F.lit(0), F.least(start, end - size))
    cut = F.trim(F.substring(t, start + 1, end - start))
    cut = F.concat(F.when(start > 0, F.lit("… ")).otherwise(""), cut)
    cut = F.when(end < F.length(t), F.concat(F.rtrim(cut), F.lit(" …"))).otherwise(cut)
    return F.when(at.isNull(), F.rtrim(F.substring(t, 1, size))).otherwise(cut)


def concept_words(text: Column) -> Column:
    return F.array_distinct(F.filter(ascii_words(text), lambda w: (F.length(w) > 2) & ~w.isin(STOP)))


def concepts(results: DataFrame, text: str, query: Sequence[str], limit: int = 12) -> DataFrame:
    """(name, sources, relevance) of the results of a search: words of their text by the share of results that hold them, more if the query holds them."""
    n = F.greatest(results.agg(F.count("*")).scalar(), F.lit(1))
    words = results.select(F.explode(concept_words(F.col(text))).alias("name")).groupBy("name").agg(F.count("*").alias("sources"))
    score = F.round(F.col("sources") / n + F.when(F.col("name").isin(*query), 0.5).otherwise(0.0), 6)
    return words.withColumn("relevance", score).orderBy(F.col("relevance").desc(), F.col("sources").desc(), F.col("name").desc()).limit(limit)


def related(results: DataFrame, source_id: int, limit: int = 5) -> DataFrame:
    """Results like one of them: 0.6 x Jaccard of words + 0.3 x that of matched terms + 0.1 for the same domain.

    results: doc_id, text, matched_terms (array), domain; a page of results (hundreds of rows).
    """
    w = results.select("doc_id", concept_words(F.col("text")).alias("words"), "matched_terms", "domain")
    s = w.where(F.col("doc_id") == source_id).select(F.col("words").alias("w0"), F.col("matched_terms").alias("m0"), F.col("domain").alias("d0"))

    def jaccard(a: str, b: str) -> Column:
        union = F.size(F.array_union(a, b))
        return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)

    both = w.where(F.col("doc_id") != source_id).crossJoin(F.broadcast(s))  # one row
    lexical = F.when((F.size("words") == 0) | (F.size("w0") == 0), 0.0).otherwise(0.6 * jaccard("words", "w0") + 0.3 * jaccard("matched_terms", "m0") + F.when(F.col("domain") == F.col("d0"), 0.1).otherwise(0.0))
    return both.select("doc_id", F.round(lexical, 6).alias("score")).where("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(limit)


def sentences(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, sentence): texts cut after a full stop, question or exclamation mark with space behind."""
    parts = F.split(squeeze(F.col(text)), r"(?<=[.!?])\s+")
    return documents.where(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("n", "sentence")).where("sentence <> ''")


#: What stands between subject and value of a definition, and of a relation by its name.
DEFINES = [r"is\s+(?:a|an|the)", "are"]
RELATES = [("located in", r"(?:is|was)\s+located\s+in"), ("part of", r"is\s+part\s+of"), ("uses", "uses"), ("contains", "contains"), ("created", "created")]
DEFINITION, RELATION = 0.72, 0.65
MOST_CHARACTERS, MOST_WORDS = 300, 40


def stated(verb: str) -> str:
    """Pattern of a sentence that says something of a subject with a verb."""
    return rf"(?i)^\s*(.+?)\s+{verb}\s+(.+?)[.!?]\s*$"


def phrase(c: Column) -> Column:
    """Single blanks, no space or commas, points, colons and semicolons at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ .,;:]+|[ .,;:]+$", "")


def facts(sentence: Column) -> Column:
    """ARRAY of STRUCT(subject, predicate, value, confidence): what a sentence defines, and what it relates.

    Both are looked for, so a sentence may state two facts. Parts of a definition have at most 300 characters and 40
    words; where the first pattern gives longer ones, the next is tried. No part is empty. A plain look for the verb
    saves most sentences the patterns.
    """
    low = F.lower(sentence)

    def first(rules: list[tuple[str, str]], confidence: float, fits) -> Column:
        out = None
        for predicate, verb in rules:
            part = [phrase(F.regexp_extract(sentence, stated(verb), k)) for k in (1, 2)]
            word = next(w for w in reversed(verb.split(r"\s+")) if "(" not in w)
            holds = low.contains(f" {word} ") & sentence.rlike(stated(verb)) & fits(part[0]) & fits(part[1])
            made = F.struct(part[0].alias("subject"), F.lit(predicate).alias("predicate"), part[1].alias("value"), F.lit(confidence).alias("confidence"))
            out = F.when(holds, made) if out is None else out.when(holds, made)
        return out

    def short(c: Column) -> Column:
        return (c != "") & (F.length(c) <= MOST_CHARACTERS) & (F.size(F.split(c, " ")) <= MOST_WORDS)

    defined = first([("definition", v) for v in DEFINES], DEFINITION, short)
    related_ = first(RELATES, RELATION, lambda c: c != "")
    return F.filter(F.array(defined, related_), lambda x: x.isNotNull())


def evidence(rows: DataFrame, key: str, text: str, words: Sequence[str], k: int = 5, url: str | None = None, title: str | None = None) -> DataFrame:
    """The k rows whose text holds most of the words of three letters or more (as substrings); then those with a url,
    those with a title, ties by key."""
    long = [w for w in words if len(w) > 2]
    hits = sum((F.when(fold(F.col(text)).contains(w), 1).otherwise(0) for w in long), F.lit(0))
    has = [F.when(F.length(F.coalesce(c, F.lit(""))) > 0, 1).otherwise(0).desc() for c in (url, title) if c]
    return rows.where(F.length(squeeze(F.col(text))) > 0).withColumn("overlap", hits).orderBy(F.col("overlap").desc(), *has, key).limit(k).select(key, "overlap")


def entities(text: Column) -> Column:
    """Distinct runs of words that begin with a capital, by their first writing; marks around words don't count."""
    words = F.filter(F.transform(F.split(squeeze(text), " "), lambda w: F.regexp_replace(w, r"""^[.,!?;:()\[\]{}"']+|[.,!?;:()\[\]{}"']+$""", "")), lambda w: w != "")
    # Runs come apart at a word that begins with no capital.
    marked = F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^\p{Lu}"), w).otherwise("\x1f")), " ")
    runs = F.filter(F.transform(F.split(marked, "\x1f"), lambda r: F.trim(r)), lambda r: r != "")
    numbered = F.transform(runs, lambda r, i: F.struct(F.lower(r).alias("k"), i.alias("i"), r.alias("r")))
    return F.transform(F.filter(numbered, lambda x: ~F.exists(numbered, lambda y: (y["k"] == x["k"]) & (y["i"] < x["i"]))), lambda x: x["r"])


def last_turns(turns: DataFrame, conversation: str, order: str, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    w = Window.partitionBy(conversation).orderBy(F.col(order).desc())
    return turns.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
