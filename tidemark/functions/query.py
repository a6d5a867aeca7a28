"""Query understanding: lexer, field constraints, kinds of tokens and questions. Plain Python for one query, and columns
for tables of queries."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEX = r'"[^"]*"|\(|\)|[^\s()]+'
#: Field prefixes and the field each means.
FIELD_OF = {"title": "title", "intitle": "title", "url": "url", "inurl": "url", "domain": "domain", "site": "domain"}
#: Question words and the kind of answer they ask for.
ASKS = {"what": "definition", "who": "person", "where": "location", "when": "time", "why": "cause", "how": "method", "which": "selection"}
EXPLAIN = ("does", "do", "can", "is", "are")


@dataclass
class Query:
    """A parsed query. terms: first token of each word, once; phrases: their tokens; fields: (field, value); excluded: tokens
    of words right after NOT."""

    terms: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    operators: list[str] = field(default_factory=list)
    fields: list[tuple[str, str]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)


def lex(text: str) -> list[tuple[str, str]]:
    """(kind, value) of each token: PHRASE, AND, OR, NOT, LPAREN, RPAREN, TERM."""
    kinds = {"(": "LPAREN", ")": "RPAREN"}
    out = []
    for v in re.findall(LEX, text):
        quoted = len(v) > 1 and v[0] == v[-1] == '"'
        out.append(("PHRASE" if quoted else kinds.get(v) or (v.upper() if v.upper() in ("AND", "OR", "NOT") else "TERM"), v))
    return out


def lexemes(text: Column) -> Column:
    """ARRAY of STRUCT(kind, value): the tokens of ``lex`` for a column of queries."""
    found = F.regexp_extract_all(text, F.lit(f"({LEX})"), F.lit(1))

    def kind(v: Column) -> Column:
        quoted = (F.length(v) > 1) & v.startswith('"') & v.endswith('"')
        return F.when(quoted, "PHRASE").when(v == "(", "LPAREN").when(v == ")", "RPAREN").when(F.upper(v).isin("AND", "OR", "NOT"), F.upper(v)).otherwise("TERM")

    return F.transform(found, lambda v: F.struct(kind(v).alias("kind"), v.alias("value")))


def parse(text: str) -> Query:
    from tidemark.operators.search import query_terms

    q = Query()
    negated = False
    for kind, v in lex(text):
        if kind == "PHRASE":
            words = query_terms(v[1:-1])
            if words and words not in q.phrases:
                q.phrases.append(words)
        elif kind in ("AND", "OR", "NOT"):
            q.operators.append(kind)
            negated = kind == "NOT"
            continue
        elif kind == "TERM":
            name, colon, value = v.partition(":")
            if colon and value and name.lower() in FIELD_OF:
                q.fields.append((FIELD_OF[name.lower()], value.casefold()))
            elif negated:
                q.excluded += [w for w in query_terms(v) if w not in q.excluded]
            elif (words := query_terms(v)) and words[0] not in q.terms:
                q.terms.append(words[0])
        negated = False
    return q


#: Marks that don't belong to a token at its ends.
EDGE = r"^[.,;!?()\[\]{}]+|[.,;!?()\[\]{}]+$"


def bare_token(token: Column) -> Column:
    """A token without the marks around it."""
    return F.regexp_replace(token, EDGE, "")


def token_kind(token: Column) -> Column:
    """URL, EMAIL, NUMBER, OPERATOR, SYMBOL (holds anything but letters and digits) or TERM, of a token without marks around it."""
    return (
        F.when(token.rlike(r"(?i)^(?:https?://|www\.)\S+$"), "URL")
        .when(token.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "EMAIL")
        .when(token.rlike(r"^\p{Nd}+$"), "NUMBER")
        .when(token.rlike(r"(?i)^(?:AND|OR|NOT)$"), "OPERATOR")
        .when(token.rlike(r"[^\p{L}\p{N}]"), "SYMBOL")
        .otherwise("TERM")
    )


def question_kind(text: Column) -> Column:
    """Kind of answer a sentence asks for, by its first words; ``question`` by its mark, else ``statement``."""
    t = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    first, second = F.substring_index(t, " ", 1), F.substring_index(F.substring_index(t, " ", 2), " ", -1)
    out = F.when(t == "", "unknown").when((first == "how") & second.isin(*EXPLAIN), "explanation")
    for w, kind in ASKS.items():
        out = out.when(t.startswith(w + " "), kind)
    return out.when(t.endswith("?"), "question").otherwise("statement")


def script(text: Column) -> Column:
    """Script of most letters; Latin where several tie with it, Unknown without letters."""
    blocks = ["Latin", "Cyrillic", "Greek", "Han", "Arabic", "Hebrew"]
    counts = [F.struct(F.length(F.regexp_replace(text, rf"[^\p{{Is{b}}}]", "")).alias("n"), F.lit(-i).alias("i"), F.lit(b).alias("b")) for i, b in enumerate(blocks)]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["b"]).otherwise("Unknown")


def expand(terms: DataFrame, synonyms: DataFrame, *, per_term: int = 8, total: int = 128, least: float = 0.45) -> DataFrame:
    """Terms (query_id, term) with their synonyms (term, synonym, confidence), the surest first, within both budgets."""
    s = terms.join(synonyms.where(F.col("confidence") >= least), "term")
    order = [F.col("confidence").desc(), F.col("synonym")]
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "term").orderBy(*order))).where(F.col("n") <= per_term)
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "term"))).where(F.col("n") <= total)
    return s.select("query_id", "term", "synonym", "confidence")


def learned_synonyms(sets: DataFrame, *, least_common: int = 2, least: float = 0.45) -> DataFrame:
    """Vocabulary for ``expand`` from a corpus: (term, synonym, confidence). sets: (context, term), a context's terms.

    Terms that stand in the same contexts mean much the same: confidence is the share of their contexts that two terms
    share (Jaccard). Only contexts of two to eight terms pair them, so pairs grow with the contexts, not with their squares.
    """
    each = sets.where(F.col("term").isNotNull() & F.col("context").isNotNull()).distinct()
    n = each.groupBy("term").agg(F.count("*").alias("n"))
    small = each.groupBy("context").agg(F.count("*").alias("size")).where("size between 2 and 8").select("context")
    few = each.join(small, "context").groupBy("context").agg(F.collect_set("term").alias("terms"))  # eight at most
    pairs = few.select(F.explode("terms").alias("term"), "terms").select("term", F.explode("terms").alias("synonym")).where("term <> synonym").groupBy("term", "synonym").agg(F.count("*").alias("common")).where(F.col("common") >= least_common)
    both = pairs.join(n, "term").join(n.select(F.col("term").alias("synonym"), F.col("n").alias("m")), "synonym")
    share = F.col("common") / (F.col("n") + F.col("m") - F.col("common"))
    return both.select("term", "synonym", F.round(share, 6).alias("confidence")).where(F.col("confidence") >= least)


def intents(terms: DataFrame, vocabulary: DataFrame, keep: int = 6) -> DataFrame:
    """Intents of queries (query_id, term) by the summed weights of a vocabulary (term, intent, weight), best first."""
    sums = terms.join(vocabulary, "term").groupBy("query_id", "intent").agg(F.round(F.sum("weight"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("intent").desc())
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def canonical_hash(*parts: Column) -> Column:
    """Hash of several texts and arrays as they stand: another order gives another hash."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def learned_intents(terms: DataFrame) -> DataFrame:
    """Vocabulary for ``intents`` from known cases (query_id, term, intent): a term's share of its cases with each intent."""
    n = terms.groupBy("term", "intent").agg(F.count("*").alias("n"))
    all_ = n.groupBy("term").agg(F.sum("n").alias("all"))
    return n.join(all_, "term").select("term", "intent", F.round(F.col("n") / F.col("all"), 6).alias("weight"))


def fingerprint(*parts: Column) -> Column:
    """Hash of several arrays as sets: equal for queries that say the same in another order."""
    return F.sha2(F.to_json(F.struct(*[F.array_sort(F.array_distinct(p)).alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def any_of(text: Column, words: Sequence[str]) -> Column:
    return F.arrays_overlap(F.split(text, " "), F.array(*map(F.lit, words)))
