"""Duplicates hidden by formatting: range partitions, external sort, scan of adjacent runs.

Records are reduced to a canonical key, ordered over the whole cluster by (table, key, id)
and scanned once. The id is part of the range order, so a key that holds a third of all rows
is cut over as many partitions as its rows need. Runs that touch a partition's edge are put
together afterwards from at most two rows a partition.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import words_text
from tidemark.session import materialize, parallelism, ship

ship(sys.modules[__name__])

SCANNED = "kind string, part int, tbl string, key string, head long, id long, n long"


def url_key(c: Column) -> Column:
    """Canonical form of a url: words up to the first ``?``, then its parameters in a fixed order.

    Parameters are parted by ``&`` or ``;``; those without words are left out. Null stays null.
    """
    parts = F.split(c, r"\?", 2)
    query = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ";", "&")
    query = F.lower(F.regexp_replace(query, r"[^a-zA-Z0-9\p{L}\p{N}&]++", " "))
    params = F.sort_array(F.array_remove(F.split(F.trim(query), " ?& ?"), ""))
    return F.concat(words_text(F.get(parts, F.lit(0))), F.lit("?"), F.array_join(params, "&"))


def text_key(*columns: Column) -> Column:
    """Canonical form of a record whose fields may stand in any order: its fields' words, sorted.

    Null and wordless fields don't count.
    """
    fields = [F.coalesce(words_text(c.cast("string")), F.lit("")) for c in columns]
    return F.array_join(F.sort_array(F.array_remove(F.array(*fields), "")), "\x1f")


def _scan(copies: bool):
    """Scans sorted (tbl, key, id). Rows out, by kind:

    copy: a row after the first of its run; open: any row of the partition's first run, whose
    head may lie in an earlier partition; run: a whole run inside the partition; first and last:
    the runs at the partition's edges, with their keys.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        #: of the run that is open at the end of the last batch: table, key, head, rows
        at: tuple[str, str, int, int] | None = None
        first = True  # that run is the partition's first

        def rows(kind, tbl, head, ids, n, key=None):
            k = len(head)
            fill = lambda x, t: pa.array([x] * k, t) if not isinstance(x, (np.ndarray, pa.Array)) else pa.array(x, t)
            return pa.RecordBatch.from_arrays(
                [fill(kind, pa.string()), fill(part, pa.int32()), fill(tbl, pa.string()), fill(key, pa.string()), fill(head, pa.int64()), fill(ids, pa.int64()), fill(n, pa.int64())],
                names=["kind", "part", "tbl", "key", "head", "id", "n"],
            )

        def one(kind, tbl, key, head, n):
            return rows(kind, tbl, np.array([head]), None, np.array([n]), key)

        for b in batches:
            if not b.num_rows:
                continue
            tbl, key, ids = b.column("tbl"), b.column("key"), b.column("id").to_numpy()
            new = np.ones(len(ids), bool)
            new[1:] = pc.or_(pc.not_equal(key[1:], key[:-1]), pc.not_equal(tbl[1:], tbl[:-1])).to_numpy(zero_copy_only=False)
            joins = at is not None and tbl[0].as_py() == at[0] and key[0].as_py() == at[1]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(ids)))
            heads = ids[starts].copy()
            if joins:
                heads[0] = at[2]
                sizes[0] += at[3]
            elif at is not None:
                if first or not copies:
                    yield one("first" if first else "run", at[0], at[1] if first else None, at[2], at[3])
                first = False
            run = np.cumsum(new) - 1
            lead = first & (run == 0)  # rows of the partition's first run
            if copies:
                dup = (ids != heads[run]) & ~lead
                if dup.any():
                    yield rows("copy", pc.filter(tbl, pa.array(dup)), heads[run[dup]], ids[dup], None)
                if lead.any():
                    yield rows("open", pc.filter(tbl, pa.array(lead)), heads[run[lead]], ids[lead], None)
            last = len(starts) - 1
            if last:
                if first:
                    yield one("first", tbl[0].as_py(), key[0].as_py(), int(heads[0]), int(sizes[0]))
                inner = slice(1 if first else 0, last)
                if not copies and last > inner.start:
                    yield rows("run", pc.take(tbl, pa.array(starts[inner])), heads[inner], None, sizes[inner])
                first = False
            at = (tbl[len(ids) - 1].as_py(), key[len(ids) - 1].as_py(), int(heads[last]), int(sizes[last]))
        if at is not None:
            yield one("first" if first else "last", *at)

    return scan


def _scanned(records: DataFrame, copies: bool, partitions: int | None) -> DataFrame:
    n = partitions or parallelism(records.sparkSession)
    # Range partitions are found from a sample: keys are written once, so that they aren't worked out for it again.
    keyed = materialize(records.where(F.col("key").isNotNull()), "keys")
    ordered = keyed.repartitionByRange(n, "tbl", "key", "id").sortWithinPartitions("tbl", "key", "id")
    return materialize(ordered.mapInArrow(_scan(copies), SCANNED), "runs")


def _edges(scanned: DataFrame) -> DataFrame:
    """Runs at partition edges put together: at most two rows a partition."""
    return scanned.where(F.col("kind").isin("first", "last")).groupBy("tbl", "key").agg(F.min("head").alias("kept_id"), F.sum("n").alias("copies"))


def copies_of(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row (tbl, kept_id, copy_id) for each row that isn't the first, by id, of its group.

    records: tbl, key, id; other columns are left aside. Rows with a null key are never copies. A row
    that bears the id of its group's first is that record again, no copy; other repeated rows come out
    each time. No rows in: no rows out.
    """
    scanned = _scanned(records.select("tbl", "key", F.col("id").cast("long").alias("id")), True, partitions)
    # The global head of each partition's first run; one row a partition, so it is small enough to broadcast.
    heads = scanned.where(F.col("kind") == "first").select("tbl", "key", "part", F.col("head").alias("own")).join(_edges(scanned), ["tbl", "key"]).select("part", "own", F.col("kept_id").alias("whole"))
    whole = scanned.where(F.col("kind") == "copy").select("tbl", F.col("head").alias("kept_id"), F.col("id").alias("copy_id"))
    open_ = scanned.where(F.col("kind") == "open").join(F.broadcast(heads), "part").where(F.col("id") != F.col("whole")).select("tbl", F.col("whole").alias("kept_id"), F.col("id").alias("copy_id"))
    return whole.unionByName(open_)


def collapse(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row (tbl, kept_id, copies) for each group: its smallest id and its exact number of rows.

    Rows with a null key belong to no group. No rows in: no rows out.
    """
    scanned = _scanned(records.select("tbl", "key", F.col("id").cast("long").alias("id")), False, partitions)
    inner = scanned.where(F.col("kind") == "run").select("tbl", F.col("head").alias("kept_id"), F.col("n").alias("copies"))
    return inner.unionByName(_edges(scanned).select("tbl", "kept_id", "copies"))
