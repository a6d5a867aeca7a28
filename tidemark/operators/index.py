"""Inverted index as tables: tokens, postings, statistics, segments, versions.

An index is a folder. Each segment holds its documents with their stored signals, its postings in buckets by term, and
its terms with their numbers; its line in the manifest is written last, so that a segment is there as a whole or not at
all. A search reads the buckets of its terms and the rows of its candidates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import TOKEN, ascii_words, fold, folded_tokens, tokens
from tidemark.operators import ranking
from tidemark.session import files_of

#: Fields in the order in which their tokens are numbered.
FIELDS = ("title", "url", "domain", "body", "canonical_url", "headings", "navigation", "footer", "sidebar", "anchor_text")
VERSION = 1
#: Documents whose postings of one term make a file, about, and buckets of terms.
DOCS_PER_FILE, BUCKETS = 1_000_000, 32


def token_arrays(documents: DataFrame, fields: Sequence[tuple[str, str]], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, and the tokens of each field, one array each (``__<field>``). Null fields hold no tokens."""
    return documents.select(*keep, *[tokens(F.col(c)).alias(f"__{f}") for f, c in fields])


def token_rows(documents: DataFrame, fields: Sequence[tuple[str, str]], key: str = "doc_id") -> DataFrame:
    """(key, field, term, pos) for every token. fields: (field, column) in order; positions run on from field to field.

    One array is exploded in the row's own task; nothing is shuffled.
    """
    rows = _exploded(token_arrays(documents, fields, [key]), fields, [key])
    name = F.lit(fields[-1][0])
    for i, (f, _) in reversed([*enumerate(fields)][:-1]):
        name = F.when(F.col("number") == i, f).otherwise(name)
    return rows.select(key, name.alias("field"), "term", "pos")


def _exploded(arrays: DataFrame, fields: Sequence[tuple[str, str]], keep: Sequence[str]) -> DataFrame:
    """(keep, length, number, term, pos): number is that of the token's field among ``fields``."""
    ends, n = [], F.lit(0)
    for f, _ in fields:
        n = n + F.size(f"__{f}")
        ends.append(n)
    rows = arrays.select(*keep, *[e.alias(f"__end{i}") for i, e in enumerate(ends)], F.posexplode(F.concat(*[F.col(f"__{f}") for f, _ in fields])).alias("pos", "term"))
    number = F.lit(len(ends) - 1)
    for i in reversed(range(len(ends) - 1)):
        number = F.when(F.col("pos") < F.col(f"__end{i}"), i).otherwise(number)
    return rows.select(*keep, F.col(f"__end{len(ends) - 1}").alias("length"), number.alias("number"), "term", "pos")


def doc_stats(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, length, terms): tokens and distinct terms of each document with any."""
    return rows.groupBy(key, "term").agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("length"), F.count("*").alias("terms"))


def postings(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, key, tf, positions): a term's places in a document, in order."""
    return rows.groupBy("term", key).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def posting_stats(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, df, positions, average): documents, places, and places a document, of each term.

    Added up a (term, document) first, so that a term that stands everywhere is spread by document.
    """
    each = rows.groupBy("term", key).agg(F.count("*").alias("tf"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("positions"), F.avg("tf").alias("average"))


def active(postings_: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Postings of documents that are active."""
    return postings_.join(documents.select(key).distinct(), key, "left_semi")


def latest(versions: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The newest row of each key, by the given columns in turn; a key's versions are cut to one in each task first."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return versions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_segments(segments: DataFrame) -> DataFrame:
    """Newest posting of each (term, doc_id) over segments (segment_id, term, doc_id, ...)."""
    w = Window.partitionBy("term", "doc_id").orderBy(F.col("segment_id").desc())
    return segments.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _digest() -> Column:
    """Sum of the rows' hashes: the same for the same rows in whatever order and files."""
    return F.coalesce(F.sum(F.xxhash64("term", "doc_id", "tf", "positions", "length", "fields").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


MANIFEST = "segment_id long, version int, documents long, with_tokens long, tokens long, postings long, checksum decimal(38,0), buckets int, fields string"


@dataclass
class Index:
    """An index stored at a path; ``segments`` are the lines of its manifest."""

    spark: SparkSession
    path: str
    segments: list = field(default_factory=list)
    #: Its tables; their files are listed once.
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        there = [n for n, _, _ in files_of(spark, f"{path}/manifest")]
        lines = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").drop("line").orderBy("segment_id").collect() if there else []  # a line a segment
        merged = [r for r in files_of(spark, f"{path}/merged")]
        gone = {int(x) for n, _, _ in merged for x in n.split("-")}
        return cls(spark, path, [r for r in lines if r.segment_id not in gone])

    def _table(self, name: str) -> DataFrame:
        if not self.segments:
            raise ValueError(f"no segment at {self.path}")
        if name not in self.tables:
            self.tables[name] = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/segment_id={r.segment_id}" for r in self.segments])
        return self.tables[name]

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """Postings (term, doc_id, tf, positions, length, fields, segment_id), of some terms from their buckets alone;
        of a document's versions those of the newest."""
        rows = self._table("postings")
        if terms is not None:
            # Constants by the time the files are chosen.
            at = [bucket(F.lit(t), n) for t in terms for n in {r.buckets for r in self.segments}]
            rows = rows.where(F.col("bucket").isin(*at) & F.col("term").isin(*terms))
        return self._live(rows.drop("bucket"))

    def _live(self, rows: DataFrame) -> DataFrame:
        if len(self.segments) < 2:
            return rows
        newest = self._table("documents").groupBy("doc_id").agg(F.max("segment_id").alias("segment_id"))
        return rows.join(newest, ["doc_id", "segment_id"], "left_semi")

    def documents(self) -> DataFrame:
        """Documents with their stored signals, the newest version of each."""
        return self._live(self._table("documents"))

    def frequencies(self, terms: Sequence[str]) -> dict[str, int]:
        """Documents of each term; those of replaced versions count until segments are merged."""
        rows = self._table("terms").where(F.col("term").isin(*terms)).groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row a term asked for
        return {r.term: r.df for r in rows}

    @property
    def docs(self) -> int:
        return sum(r.with_tokens for r in self.segments)

    @property
    def average_length(self) -> float:
        return sum(r.tokens for r in self.segments) / self.docs if self.docs else 1.0

    @property
    def fields(self) -> list[str]:
        return self.segments[0].fields.split(",") if self.segments else []


def stored_documents(documents: DataFrame, fields: Sequence[tuple[str, str]], flags: DataFrame | None = None) -> DataFrame:
    """What a search takes from a document besides its postings: folded title and url, and the signals of its texts.

    documents: doc_id, the fields' columns, and, where there is one, crawled (seconds). flags: exact_duplicate,
    possible_duplicate, active of documents; those without are no copies and active.
    """
    of = dict(fields)
    text = {f: F.col(of[f]) if f in of else F.lit(None).cast("string") for f in ("title", "url", "body")}
    crawled = F.col("crawled") if "crawled" in documents.columns else F.lit(None)
    some = documents.select("doc_id", *[c.alias(f"__{f}") for f, c in text.items()], crawled.cast("double").alias("crawled"), ascii_words(text["body"]).alias("__words"), F.coalesce(F.concat_ws(" ", *[c for _, c in fields]).rlike(TOKEN_LETTER), F.lit(False)).alias("with_tokens"))
    some = some.withColumn("__share", ranking.top_share(F.col("__words")))
    title, url, words = F.col("__title"), F.col("__url"), F.col("__words")
    made = some.select(
        "doc_id", "with_tokens", fold(title).alias("title"), fold(url).alias("url"), "crawled", ranking.quality(title, words).alias("quality"), ranking.trust(url, title, words).alias("trust"),
        ranking.spam(title, words, url, F.col("__share")).alias("spam"),
    )
    if flags is None:
        return made.withColumns({"duplicate": F.lit(0.0), "active": F.lit(True)})
    known = flags.select("doc_id", ranking.duplicate_penalty(F.col("exact_duplicate"), F.col("possible_duplicate")).alias("duplicate"), "active").dropDuplicates(["doc_id"])
    return made.join(known, "doc_id", "left").withColumns({"duplicate": F.coalesce("duplicate", F.lit(0.0)), "active": F.coalesce("active", F.lit(True))})


#: Whether a text holds a token: a letter or digit of any script, compatibility characters too.
TOKEN_LETTER = r"[a-zA-Z0-9\p{L}\p{N}]"


def add_segment(spark: SparkSession, path: str, documents: DataFrame, fields: Sequence[tuple[str, str]], segment_id: int | None = None, *, flags: DataFrame | None = None, buckets: int = BUCKETS) -> Index:
    """Indexes documents as one more segment; a segment written again under its number replaces itself.

    Token rows are shuffled once, by bucket of the term and by a salt of the document, so that the postings of a stop
    word fill as many files as they need (a file a million documents, about). Null ids are left out. flags (doc_id,
    exact_duplicate, possible_duplicate, active) join the stored signals, not the texts.
    """
    known = documents.where(F.col("doc_id").isNotNull())
    number = segment_id if segment_id is not None else max([r.segment_id for r in Index.open(spark, path).segments], default=-1) + 1
    at = f"segment_id={number}"
    docs_seen, seen = Observation(), Observation()
    stored_documents(known, fields, flags).observe(docs_seen, F.count("*").alias("documents"), F.count_if("with_tokens").alias("with_tokens")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/documents/{at}")
    documents_, with_tokens = docs_seen.get["documents"], docs_seen.get["with_tokens"]
    salts = max(1, math.ceil(with_tokens / DOCS_PER_FILE))
    rows = _exploded(token_arrays(known, fields, ["doc_id"]), fields, ["doc_id"])
    rows = rows.withColumn("bucket", bucket(F.col("term"), buckets)).withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    rows = rows.repartition(min(buckets * salts, max(buckets, 100_000)), "bucket", "__salt")
    made = rows.groupBy("bucket", "__salt", "term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"), F.first("length").alias("length"), F.bit_or(F.expr("shiftleft(1, number)")).alias("fields"))
    made = made.drop("__salt").observe(seen, F.count("*").alias("postings"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"), _digest().alias("checksum"))
    made.sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings/{at}")
    if seen.get["postings"]:
        written = spark.read.parquet(f"{path}/postings/{at}")
        terms = written.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("positions"))
        terms.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms/{at}")
    else:
        spark.createDataFrame([], "term string, doc_id long, tf int, positions array<int>, length int, fields int, bucket int").write.mode("overwrite").parquet(f"{path}/postings/{at}")
        spark.createDataFrame([], "term string, df long, positions long").write.mode("overwrite").parquet(f"{path}/terms/{at}")
    line = (number, VERSION, documents_, with_tokens, int(seen.get["tokens"]), seen.get["postings"], seen.get["checksum"], buckets, ",".join(f for f, _ in fields))
    spark.createDataFrame([line], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/line={number}")
    return Index.open(spark, path)


def verify(index: Index) -> DataFrame:
    """(segment_id, version, healthy): whether each segment's postings are those that were written, in this version."""
    found = index._table("postings").groupBy("segment_id").agg(F.count("*").alias("found"), _digest().alias("digest"))
    lines = index.spark.createDataFrame(index.segments, MANIFEST)
    healthy = (F.coalesce("found", F.lit(0)) == F.col("postings")) & (F.coalesce("digest", F.lit(0).cast("decimal(38,0)")) == F.col("checksum")) & (F.col("version") == VERSION)
    return lines.join(found, "segment_id", "left").select("segment_id", "version", healthy.alias("healthy"))


def maintain(index: Index, most_segments: int = 10) -> Index:
    """Merges all segments into one where there are more than ``most_segments``: live postings, documents and terms.

    The merged segment bears a new number; then the old ones are named as merged. Readers that opened the index before
    go on with the old files.
    """
    if len(index.segments) <= most_segments:
        return index
    spark, path = index.spark, index.path
    number, buckets = index.segments[-1].segment_id + 1, index.segments[-1].buckets
    docs_seen, seen = Observation(), Observation()
    index.documents().drop("segment_id").observe(docs_seen, F.count("*").alias("documents"), F.count_if("with_tokens").alias("with_tokens")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/documents/segment_id={number}")
    live = index.postings().drop("segment_id").withColumn("bucket", bucket(F.col("term"), buckets))
    salts = max(1, math.ceil(docs_seen.get["with_tokens"] / DOCS_PER_FILE))
    live = live.repartition(min(buckets * salts, max(buckets, 100_000)), "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    live = live.observe(seen, F.count("*").alias("postings"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"), _digest().alias("checksum"))
    live.sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings/segment_id={number}")
    spark.read.parquet(f"{path}/postings/segment_id={number}").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("positions")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms/segment_id={number}")
    line = (number, VERSION, docs_seen.get["documents"], docs_seen.get["with_tokens"], int(seen.get["tokens"]), seen.get["postings"], seen.get["checksum"], buckets, index.segments[0].fields)
    spark.createDataFrame([line], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/line={number}")
    for r in index.segments:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/merged/{r.segment_id}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return Index.open(spark, path)


def compaction_plan(segments: DataFrame, *, level0: int = 8, level: int = 16, most: int = 32, ratio: float = 10.0) -> DataFrame:
    """Segments to merge, by level: (level, segment_id, place). segments: segment_id, bytes.

    A segment's level is the number of times that its bytes hold ``ratio`` of the smallest. Level 0 is merged from
    ``level0`` segments on, others from ``level``; of each level the ``most`` smallest, ties by id.
    """
    least = segments.agg(F.min(F.when(F.col("bytes") > 0, F.col("bytes"))).alias("__least"))
    leveled = segments.join(F.broadcast(least)).withColumn("level", F.floor(F.coalesce(F.log(F.greatest("bytes", F.lit(1)) / F.col("__least")), F.lit(0.0)) / math.log(ratio) + 1e-9).cast("int"))  # one row
    n = leveled.groupBy("level").agg(F.count("*").alias("__n"))
    place = F.row_number().over(Window.partitionBy("level").orderBy("bytes", "segment_id"))
    due = leveled.withColumn("place", place).where(F.col("place") <= most).join(n, "level")
    return due.where(F.col("__n") >= F.when(F.col("level") == 0, level0).otherwise(level)).select("level", "segment_id", "place")
