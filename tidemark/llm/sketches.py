"""Distinct counts over huge identifier sets: registers of minimum exponential hash values.

A sketch has m registers. Each identifier stands for an exponential value in every register, fixed
by its hash; a register keeps the minimum. So registers of a union are the elementwise minima, and
with n identifiers each register is exponential with rate n. Their sum is gamma distributed, which
gives the unbiased count ``(m - 1) / sum``, its relative standard error ``1 / sqrt(m - 2)`` and exact
confidence intervals.

An identifier's values are drawn in rising order, as arrivals of a Poisson process of rate m that fall
on registers evenly; they stop counting as soon as they pass the largest register. A full sketch
costs about one draw an identifier. Groups of fewer than m / 2 identifiers are held and shuffled as their
hashes, 8 bytes each.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import parallelism, ship

ship(sys.modules[__name__])

#: Rows gathered before they're added, groups held before they're handed on.
ROWS, GROUPS = 100_000, 2048
DRAWS = 1 << 19
PARTIAL = pa.schema([("grp", pa.string()), ("registers", pa.binary())])


def _mix(x: np.ndarray) -> np.ndarray:
    """Evenly spread 64 bits from any 64 bits (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def add(registers: np.ndarray, groups: np.ndarray, hashes: np.ndarray) -> None:
    """Adds identifiers to the sketches of their groups. registers: one row a group, start at infinity."""
    m = registers.shape[1]
    flat = registers.reshape(-1)
    order = np.lexsort((hashes, groups))
    g, h = groups[order], hashes[order].view(np.uint64)
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
    g, h = g[new], h[new]
    t, step, k = np.zeros(len(g)), 0, 1
    top = registers.max(axis=1)
    while len(g):
        # Ever more arrivals at once, in steps that don't depend on the other identifiers: the same sums, to the last bit.
        at = np.arange(step + 1, step + k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for lo in range(0, len(g), max(1, DRAWS // k)):
            part = slice(lo, lo + max(1, DRAWS // k))
            r = _mix(h[part, None] + at[None, :])
            gaps = -np.log1p(-((r >> np.uint64(11)).astype(np.float64)) / (1 << 53)) / m
            when = t[part, None] + np.cumsum(gaps, axis=1)
            hit = when < top[g[part]][:, None]
            place = (_mix(r + np.uint64(1)) % np.uint64(m)).astype(np.int64) + (g[part] * m)[:, None]
            np.minimum.at(flat, place[hit], when[hit])
            touched = np.unique(g[part])
            top[touched] = registers[touched].max(axis=1)
            t[part] = when[:, -1]
        step, k = step + k, min(4096, 4 * k)
        on = t < top[g]
        g, h, t = g[on], h[on], t[on]


def _out(groups: list[str], held: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array([x.tobytes() for x in held], pa.binary())], schema=PARTIAL)


def _load(raw: bytes, m: int) -> np.ndarray:
    """Registers, or the hashes of a group that has few: those are always shorter than registers."""
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * m else "<u8")


def _dense(held: list[np.ndarray], m: int) -> np.ndarray:
    """Registers of several sketches, one row each."""
    few = [i for i, x in enumerate(held) if x.dtype != np.float32]
    out = np.full((len(held), m), np.inf)
    if few:
        add(out, np.repeat(few, [len(held[i]) for i in few]), np.concatenate([held[i] for i in few]).view(np.int64))
    for i, x in enumerate(held):
        if x.dtype == np.float32:
            out[i] = x
    return out.astype("<f4")


def _union(parts: list[np.ndarray], m: int) -> np.ndarray:
    """Sketches as one. Few hashes are kept as they are; the registers of a set are the same whenever they're made."""
    few, full = [x for x in parts if x.dtype != np.float32], [x for x in parts if x.dtype == np.float32]
    hashes = np.unique(np.concatenate(few)) if few else None
    if not full:
        return hashes if len(hashes) < m // 2 else _dense([hashes], m)[0]
    held = np.minimum.reduce(full)
    if few:
        registers = held.astype(np.float64)[None]
        add(registers, np.zeros(len(hashes), np.int64), hashes.view(np.int64))
        held = registers[0].astype("<f4")
    return held


def _sketch(m: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few: dict[str, np.ndarray] = {}
        held: dict[str, int] = {}
        registers = np.full((64, m), np.inf)
        waiting: list[pa.RecordBatch] = []

        def flush():
            nonlocal registers
            if not waiting:
                return
            t = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            d = t.column("grp").chunk(0).dictionary_encode()
            g, h = d.indices.to_numpy(), t.column("h").chunk(0).to_numpy().view(np.uint64)
            order = np.lexsort((h, g))
            g, h = g[order], h[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
            g, h = g[new], h[new]
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            rows, hashes = [], []
            for name, s, e in zip(d.dictionary.take(pa.array(g[starts])).to_pylist(), starts, [*starts[1:], len(g)], strict=True):
                if name not in held:
                    both = np.union1d(few[name], h[s:e]) if name in few else h[s:e]
                    if len(both) < m // 2:
                        few[name] = both
                        continue
                    few.pop(name, None)
                    held[name] = len(held)
                    hashes.append(both)
                else:
                    hashes.append(h[s:e])
                rows.append(np.full(len(hashes[-1]), held[name]))
            while len(held) > len(registers):
                registers = np.concatenate([registers, np.full_like(registers, np.inf)])
            if rows:
                add(registers, np.concatenate(rows), np.concatenate(hashes).view(np.int64))

        def out():
            nonlocal registers
            if few:
                yield _out([*few], [*few.values()])
                few.clear()
            for lo in range(0, len(held), 256):
                yield _out([*held][lo : lo + 256], [x.astype("<f4") for x in registers[lo : min(len(held), lo + 256)]])
            held.clear()
            registers = np.full((64, m), np.inf)

        n = 0
        for b in batches:
            if b.num_rows:
                waiting.append(b)
                n += b.num_rows
            if n >= ROWS:
                flush()
                n = 0
                if len(held) + len(few) > GROUPS:
                    yield from out()
        flush()
        yield from out()

    return sketch


#: Parts of one group that are gathered before they're put together.
PARTS = 64


def _merge(m: int, up: tuple[tuple[bool, ...], ...] | None):
    """Merges partial sketches in a task. up: which dimensions stay, for each level rolled up to."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def out():
            yield _out([*held], [_union(x, m) for x in held.values()])
            held.clear()

        for b in batches:
            for name, raw in zip(b.column("grp").to_pylist(), b.column("registers").to_pylist(), strict=True):
                part = _load(raw, m)
                names = [name] if up is None else ["\x1f".join([str(k), *(d if keep else "" for d, keep in zip(name.split("\x1f"), level, strict=True))]) for k, level in enumerate(up)]
                for x in names:
                    parts = held.setdefault(x, [])
                    parts.append(part)
                    if len(parts) > PARTS:
                        held[x] = [_union(parts, m)]
                if len(held) > 4 * GROUPS:
                    yield from out()
        if held:
            yield from out()

    return merge


def _merge_sorted(m: int):
    """Merges sketches that come sorted by group, one group in memory at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for b in batches:
            names, held = [], []
            for name, raw in zip(b.column("grp").to_pylist(), b.column("registers").to_pylist(), strict=True):
                if name != at and parts:
                    names.append(at)
                    held.append(_union(parts, m))
                    parts = []
                at = name
                parts.append(_load(raw, m))
                if len(parts) > PARTS:
                    parts = [_union(parts, m)]
            if names:
                yield _out(names, held)
        if parts:
            yield _out([at], [_union(parts, m)])

    return merge


def sketches(rows: DataFrame, dims: list[str], identifier: str, m: int = 1024) -> DataFrame:
    """Partial sketches (grp, registers) of each group, several a group: one a task that saw it.

    They can be stored and merged with others at any time. Null identifiers aren't counted; a null dimension
    is a group of its own. Dimensions are taken as strings.
    """
    # A leading mark tells null from empty; the separator can't stand in a dimension.
    marks = [F.coalesce(F.concat(F.lit("="), F.translate(F.col(d).cast("string"), "\x1f", " ")), F.lit("~")) for d in dims]
    flat = rows.where(F.col(identifier).isNotNull()).select(F.concat_ws("\x1f", *marks).alias("grp"), F.xxhash64(identifier).alias("h"))
    return flat.mapInArrow(_sketch(m), "grp string, registers binary")


def merged(partial: DataFrame, m: int = 1024) -> DataFrame:
    """One sketch a group, of ``m`` registers as the partial ones. Tasks first merge what they hold; the shuffle carries at most 4 m bytes a group and task."""
    return partial.repartition(parallelism(partial.sparkSession), "grp").sortWithinPartitions("grp").mapInArrow(_merge_sorted(m), "grp string, registers binary")


def cube(partial: DataFrame, dims: list[str], m: int = 1024) -> DataFrame:
    """Sketches of every combination of dimensions, from those of the finest groups. grp: level number, then dimensions."""
    n = len(dims)
    levels = tuple(tuple(bool(k >> i & 1) for i in range(n)) for k in range(1 << n))
    return merged(partial.mapInArrow(_merge(m, levels), "grp string, registers binary"), m)


def interval(total: float, m: int, confidence: float) -> tuple[float, float, float]:
    """Count with its confidence interval, from the sum of the registers (gamma with shape m, rate: the count)."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)

    def quantile(z: float) -> float:  # of the gamma distribution, by Wilson and Hilferty
        c = 1 / (9 * m)
        return m * (1 - c + z * math.sqrt(c)) ** 3

    return (m - 1) / total, quantile(-z) / total, quantile(z) / total


def _estimate(dims: int, confidence: float, m: int):
    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            registers = _dense([_load(raw, m) for raw in b.column("registers").to_pylist()], m) if b.num_rows else ()
            for name, x in zip(b.column("grp").to_pylist(), registers, strict=True):
                level, *values = name.split("\x1f")
                x = x.astype(np.float64)
                count, lo, hi = interval(float(x.sum()), len(x), confidence)
                out.append([int(level), *(v[1:] if v[:1] == "=" else None for v in values), count, lo, hi, 1 / math.sqrt(len(x) - 2)])
            columns = list(zip(*out, strict=True)) if out else [[]] * (dims + 5)
            types = [pa.int32(), *[pa.string()] * dims, *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f"c{i}" for i in range(dims + 5)])

    return estimate


def distinct_cube(rows: DataFrame, dims: list[str], identifier: str, *, m: int = 1024, confidence: float = 0.95) -> DataFrame:
    """Distinct identifiers for each combination of dimensions and each of their values.

    Rows out: ``grouped`` (names of the dimensions that count, joined by ``,``; empty for the total), the dimensions
    (null where they don't count, or are null), ``estimate``, ``lo`` and ``hi`` (confidence interval), ``rel_error``
    (relative standard error). No rows in: no rows out.
    """
    n = len(dims)
    made = cube(sketches(rows, dims, identifier, m), dims, m).mapInArrow(_estimate(n, confidence, m), ", ".join(f"c{i} {'int' if i == 0 else 'string' if i <= n else 'double'}" for i in range(n + 5)))
    names = F.array_join(F.filter(F.array(*[F.when(F.col("c0").bitwiseAND(1 << i) > 0, F.lit(d)) for i, d in enumerate(dims)]), lambda x: x.isNotNull()), ",")
    return made.select(names.alias("grouped"), *[F.col(f"c{i + 1}").alias(d) for i, d in enumerate(dims)], *[F.col(f"c{n + 1 + i}").alias(x) for i, x in enumerate(("estimate", "lo", "hi", "rel_error"))])
