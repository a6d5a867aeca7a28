"""Test passages inside a training corpus: greedy string tiling over whole documents.

Words are hashed in a window that rolls over each text (Karp-Rabin). The windows of the passages are a
table of seeds; a bitmap of their hashes, of bounded size whatever the suite, tells which windows of the
corpus may be seeds, so that only those leave the one pass over the documents. They join the seeds on
hash and words. Seeds in a row are matches, and the longest matches that don't overlap are marked one
after another as tiles: the parts of a passage are found in whatever order they stand.
"""

from __future__ import annotations

import heapq
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import words_text
from tidemark.session import materialize, parallelism, ship

ship(sys.modules[__name__])

#: Bytes of texts handled at once by a task.
PIECE_BYTES = 8 << 20
#: Bits of the bitmap as powers of two, at least and at most (32 MB); about so many bits a seed.
LEAST_BITS, MOST_BITS, BITS_A_SEED = 16, 28, 16
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WINDOWS = "id long, version long, place int, size int, hash long, words string"
FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("tiles", pa.int32()), ("longest", pa.int32()), ("covered", pa.int32()), ("words", pa.int32())])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Hash of each word of all texts, where each text starts (and the end), and the words."""
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy()
    words = lists.values
    d = words.dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in d.dictionary.to_pylist()], np.uint64)
    return known[d.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64), offsets, words


def _windows(w: np.ndarray, offsets: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window of m words starts inside one text, and the windows' rolling hashes."""
    if len(w) < m:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * _powers(BASE, len(w)), dtype=np.uint64)))
    h = (total[m:] - total[:-m]) * _powers(INVERSE, len(w) - m + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(len(h)) + m <= ends[: len(h)])
    return at, h[at]


def tile(matches: list[tuple[int, int, int]], m: int) -> list[tuple[int, int, int]]:
    """Greedy tiling. matches: maximal (place in document, place in passage, length); m: shortest tile.

    The longest match is marked first, the earliest among equals; what others have left unmarked counts on.
    """
    heap = [(-n, i, j) for i, j, n in matches]
    heapq.heapify(heap)
    used_d: set[int] = set()
    used_p: set[int] = set()
    tiles = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = [i + k not in used_d and j + k not in used_p for k in range(n)]
        if all(free):
            tiles.append((i, j, n))
            used_d.update(range(i, i + n))
            used_p.update(range(j, j + n))
            continue
        k = 0
        while k < n:
            if free[k]:
                e = k
                while e < n and free[e]:
                    e += 1
                if e - k >= m:
                    heapq.heappush(heap, (k - e, i + k, j + k))
                k = e
            else:
                k += 1
    return tiles


def _matches(i: np.ndarray, j: np.ndarray, m: int) -> list[tuple[int, int, int]]:
    """Maximal matches from seeds (i, j): seeds in a row on one diagonal."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    cut = np.flatnonzero((np.diff(i - j) != 0) | (np.diff(i) != 1)) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(i)]))
    return [(int(i[s]), int(j[s]), int(e - s + m - 1)) for s, e in zip(starts, ends, strict=True)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Ids, versions and texts, some megabytes at a time."""
    for b in batches:
        ids, versions, texts = b.column("id").to_numpy(), b.column("version").to_numpy(), b.column("words")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE_BYTES, "right")))
            yield ids[lo:hi], versions[lo:hi], texts.slice(lo, hi - lo)
            lo = hi


def _cut(m: int, bitmap=None, bits: int = 0):
    """Windows of m words with their hashes and words; only those whose hash is in the bitmap (a broadcast), if there is one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bitmap is None else bitmap.value
        for ids, versions, texts in _pieces(batches):
            w, offsets, words = _words(texts)
            at, h = _windows(w, offsets, m)
            if held is not None:
                b = h >> np.uint64(64 - bits)
                some = ((held[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1)).astype(bool)
                at, h = at[some], h[some]
            if not len(at):
                continue
            of = np.searchsorted(offsets, at, "right") - 1
            # The words of each window: a list of m places a window, put together.
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * m), words.take(pa.array((at[:, None] + np.arange(m)).ravel())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[of]), pa.array(versions[of]), pa.array((at - offsets[of]).astype(np.int32)), pa.array((offsets[of + 1] - offsets[of]).astype(np.int32)), pa.array(h.view(np.int64)), pc.binary_join(lists, " ")],
                names=["id", "version", "place", "size", "hash", "words"],
            )

    return cut


def _texts(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, version, words) of texts with words: the version tells texts under one id apart; repeated rows count once."""
    words = rows.where(F.col(text).isNotNull() & F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), words_text(F.col(text)).alias("words"))
    return words.select("id", F.xxhash64("words").alias("version"), "words")


def _bitmap(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """One bit for each hash prefix of the seeds. Words of 64 bits are put together by the cluster; the driver gets at most 2^22 of them."""
    n = seeds.count()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, n) * BITS_A_SEED))))
    at = F.shiftrightunsigned("hash", 64 - bits)
    made = seeds.select(F.shiftrightunsigned(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63L as int))").alias("bit"))
    made = made.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(1 << (bits - 6), np.uint64)
    held[made.column("word").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
    return held, bits


def _tile(m: int, coverage: float, least: int):
    """Tilings of sorted seeds (doc, dver, item, iver, i, j, size); a pair's seeds stand in a row, over batches too."""
    names = ["doc", "dver", "item", "iver", "i", "j", "size"]

    def tilings(c: list[np.ndarray], cuts: np.ndarray) -> pa.RecordBatch | None:
        out = []
        for s, e in zip(cuts, cuts[1:], strict=False):
            i, j, size = c[4][s:e], c[5][s:e], int(c[6][s])
            enough = max(least, coverage * size)
            places = np.unique(j)
            if int(np.minimum(np.diff(places, append=places[-1] + m), m).sum()) < enough:  # no tiling covers more
                continue
            found = tile(_matches(i, j, m), m)
            covered = sum(n for _, _, n in found)
            if found and covered >= enough:
                out.append((int(c[0][s]), int(c[2][s]), len(found), max(n for _, _, n in found), covered, size))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), FOUND.types, strict=True)], schema=FOUND) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            c = [b.column(n).to_numpy() for n in names]
            new = np.zeros(b.num_rows, bool)
            for x in c[:4]:
                new[1:] |= x[1:] != x[:-1]
            new[0] = not held or any(x[0] != h[-1] for x, h in zip(c[:4], held[-1][:4], strict=True))
            starts = np.flatnonzero(new)
            if len(starts):
                if held and starts[0] >= 0:
                    held.append([x[: starts[0]] for x in c])
                    whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                    if (out := tilings(whole, np.array([0, len(whole[0])]))) is not None:
                        yield out
                if len(starts) > 1 and (out := tilings(c, starts)) is not None:
                    yield out
                held = [[x[starts[-1] :] for x in c]]
            else:
                held.append(c)
        if held:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            if (out := tilings(whole, np.array([0, len(whole[0])]))) is not None:
                yield out

    return run


def leaks(documents: DataFrame, items: DataFrame, *, shortest: int = 13, coverage: float = 0.0, least: int = 1) -> DataFrame:
    """Tilings of passages by documents: (doc_id, item_id, tiles, longest, covered, words).

    documents: doc_id, text; items: item_id, passage. Tiles have at least ``shortest`` words; those of a pair cover at
    least the share ``coverage`` of a passage's ``words`` and at least ``least`` words of it. Null and empty texts, null
    ids and passages of fewer words hold no tile. Repeated rows count once; different texts under one id come out one by
    one. No rows in: no rows out. A word is a longest run of letters and digits, in lower case.
    """
    spark, m = documents.sparkSession, shortest
    seeds = materialize(_texts(items, "item_id", "passage").distinct().mapInArrow(_cut(m), WINDOWS), "seeds")
    held, bits = _bitmap(seeds)
    # 32 MB at most, however large the suite; what passes by chance finds no seed.
    hits = _texts(documents, "doc_id", "text").mapInArrow(_cut(m, spark.sparkContext.broadcast(held), bits), WINDOWS)
    i = hits.select(F.col("id").alias("doc"), F.col("version").alias("dver"), F.col("place").alias("i"), "hash", "words")
    j = seeds.select(F.col("id").alias("item"), F.col("version").alias("iver"), F.col("place").alias("j"), "size", "hash", "words")
    pairs = i.join(j.hint("merge"), ["hash", "words"]).select("doc", "dver", "item", "iver", "i", "j", "size").repartition(parallelism(spark), "doc", "dver", "item", "iver")
    # A text that stands twice under one id gives each seed twice.
    rows = pairs.dropDuplicates().sortWithinPartitions("doc", "dver", "item", "iver", "i", "j")
    return rows.mapInArrow(_tile(m, coverage, least), "doc_id long, item_id long, tiles int, longest int, covered int, words int")
