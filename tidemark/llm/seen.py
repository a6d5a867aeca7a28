"""Has this key been seen before? Chains of Bloom layers over shards of the key space.

Keys are hashed in the JVM and sharded by hash, so that all arrivals of a key meet the same
chain, in arrival order. A chain starts small; when a layer is half full, a larger one with a
tighter error rate is added, so the compounded rate stays under ``error / (1 - tightening)``
however long the history grows. Only the layers' bits are held, never the keys. Chains can be stored: later
arrivals go on where earlier ones ended, without those being read again, and chains of two histories merge.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize, parallelism, ship

ship(sys.modules[__name__])

VERDICTS = "kind string, tbl string, id long, h long, n long, bound double"
#: Pieces of stored layers. home: hash of a key of the chain, by which its shard is found again.
LAYERS = "tbl string, layer int, piece int, capacity long, error double, held long, home long, bits binary, shards int"
PIECE = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Layer:
    """One Bloom filter: capacity at which half of its bits are set, and the error rate there."""

    def __init__(self, capacity: int, error: float):
        self.capacity, self.error, self.n = capacity, error, 0
        self.k = max(1, math.ceil(math.log2(1 / error)))
        self.m = max(64, math.ceil(capacity * self.k / math.log(2)))
        self.bits = np.zeros(-(-self.m // 64), np.uint64)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Bit numbers of each key: double hashing, one row a key."""
        a = h * GOLDEN
        b = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
        b ^= b >> np.uint64(32)
        b |= np.uint64(1)
        return (a[:, None] + np.arange(self.k, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(self.m)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h)
        return ((self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)

    def add(self, h: np.ndarray) -> None:
        at = self.places(h).ravel()
        np.bitwise_or.at(self.bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        self.n += len(h)

    def pieces(self) -> list[bytes]:
        """The bits, in pieces that fit into rows."""
        raw = self.bits.tobytes()
        return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]

    @classmethod
    def stored(cls, capacity: int, error: float, n: int, raw: bytes) -> Layer:
        out = cls(capacity, error)
        out.n, out.bits = n, np.frombuffer(raw, np.uint64).copy()
        return out

    def full(self) -> bool:
        return self.n >= self.capacity or 2 * int(np.bitwise_count(self.bits).sum()) >= self.m


class Chain:
    """A scalable Bloom filter: layers grow by ``growth``, their error rates shrink by ``tightening``."""

    def __init__(self, capacity: int, error: float, growth: float, tightening: float):
        self.growth, self.tightening = growth, tightening
        self.layers = [Layer(capacity, error)]

    def bound(self) -> float:
        """Compounded rate of wrong answers: of all layers so far, each as if full."""
        return 1 - math.prod(1 - x.error for x in self.layers)

    def seen(self, h: np.ndarray) -> np.ndarray:
        """Verdict on each key, in order; unseen keys are added."""
        _, first = np.unique(h, return_index=True)
        out = np.ones(len(h), bool)
        first.sort()
        known = np.zeros(len(first), bool)
        for x in self.layers:
            rest = np.flatnonzero(~known)
            if not len(rest):
                break
            known[rest] = x.has(h[first[rest]])
        new = first[~known]
        out[new] = False
        new = h[new]
        while len(new):
            x = self.layers[-1]
            part, new = np.split(new, [max(1, x.capacity - x.n)])
            x.add(part)
            if x.full():
                self.layers.append(Layer(int(x.capacity * self.growth), x.error * self.tightening))
        return out


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks what can be told from a batch alone: a row with a smaller id and the same hash beside it."""
    for b in batches:
        if not b.num_rows:
            continue
        tbl = b.column("tbl").dictionary_encode().indices.to_numpy()
        ids, h = b.column("id").to_numpy(), b.column("h").to_numpy()
        order = np.lexsort((ids, h, tbl))
        sure = np.zeros(len(ids), bool)
        sure[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (tbl[order[1:]] == tbl[order[:-1]]) & (ids[order[1:]] != ids[order[:-1]])
        yield pa.RecordBatch.from_arrays([b.column("tbl"), b.column("id"), b.column("h"), pa.array(sure)], names=["tbl", "id", "h", "sure"])


def _judge(capacity: int, error: float, growth: float, tightening: float, shards: int, keep: bool):
    """Verdicts on sorted arrivals of a shard; rows of stored layers (kind ``layer``) come before a table's arrivals."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, at, asked, last_id, home = None, None, 0, None, None
        loading: list[tuple[int, int, int, float, int, bytes]] = []

        def loaded():
            """Puts stored layers together, in order; the newest is the last."""
            nonlocal loading
            layers: dict[int, list] = {}
            for layer, piece, cap, err, n, raw in sorted(loading, key=lambda x: x[:2]):
                layers.setdefault(layer, [cap, err, n, b""])[3] += raw
            loading = []
            if layers:
                chain.layers = [Layer.stored(*x) for _, x in sorted(layers.items())]

        def stats():
            rows = [{"kind": "chain", "tbl": at, "id": len(chain.layers), "h": sum(x.n for x in chain.layers), "n": asked, "bound": chain.bound()}]
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
            for k, x in enumerate(chain.layers if keep else ()):
                for p, raw in enumerate(x.pieces()):
                    row = {"kind": "layer", "tbl": at, "layer": k, "piece": p, "capacity": x.capacity, "error": x.error, "held": x.n, "home": home, "bits": raw, "shards": shards}
                    yield pa.RecordBatch.from_pylist([row], schema=SCHEMA)

        for whole in batches:
            tables = whole.column("tbl")
            cuts = [0, *(np.flatnonzero(np.diff(tables.dictionary_encode().indices.to_numpy())) + 1).tolist(), whole.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                b = whole.slice(lo, hi - lo)
                tbl = b.column("tbl")[0].as_py()
                if tbl != at:
                    if at is not None:
                        loaded()
                        yield from stats()
                    chain, at, asked, last_id, home = Chain(capacity, error, growth, tightening), tbl, 0, None, None
                if keep:
                    stored = b.column("layer").is_valid().to_numpy(zero_copy_only=False)
                    if stored.any():
                        rows = b.filter(pa.array(stored)).to_pylist()
                        loading += [(r["layer"], r["piece"], r["capacity"], r["error"], r["held"], r["bits"]) for r in rows]
                        home = rows[0]["h"]
                        b = b.filter(pa.array(~stored))
                        if not b.num_rows:
                            continue
                if loading:
                    loaded()
                ids, h = b.column("id").to_numpy(), b.column("h").to_numpy()
                seen = b.column("sure").to_numpy(zero_copy_only=False).copy()
                ask = np.flatnonzero(~seen)
                if home is None and len(ask):
                    home = int(h[ask[0]])
                seen[ask] = chain.seen(h[ask].view(np.uint64))
                asked += len(ids)
                # A row delivered again under one id is one arrival.
                again = np.concatenate(([ids[0] == last_id], ids[1:] == ids[:-1]))
                last_id = ids[-1]
                out = np.flatnonzero(seen & ~again)
                if len(out):
                    k = len(out)
                    columns = {"kind": pa.array(["seen"] * k), "tbl": pa.array([tbl] * k), "id": pa.array(ids[out]), "h": pa.array(h[out])}
                    yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(k, f.type)) for f in SCHEMA], schema=SCHEMA)
        if at is not None:
            loaded()
            yield from stats()

    return judge


_KEPT = [("layer", pa.int32()), ("piece", pa.int32()), ("capacity", pa.int64()), ("error", pa.float64()), ("held", pa.int64()), ("home", pa.int64()), ("bits", pa.binary()), ("shards", pa.int32())]
SCHEMA = pa.schema([("kind", pa.string()), ("tbl", pa.string()), ("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("bound", pa.float64()), *_KEPT])
ALL = VERDICTS + ", " + LAYERS.split(", ", 1)[1]


def verdicts(arrivals: DataFrame, *, capacity: int = 1 << 14, error: float = 0.004, growth: float = 2.0, tightening: float = 0.5, shards: int | None = None, before: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """What the chains say. arrivals: tbl, id (in arrival order, unique in a table), key.

    Rows out: kind ``seen`` (tbl, id, h) for each arrival said to have come before, and kind ``chain``
    (one a shard and table: id layers, h keys held, n arrivals, bound on the rate of wrong answers); with ``keep`` also
    kind ``layer``, the chains as they stand in the end (``layers``). ``before``: layers kept earlier; the chains go on
    from there. No earlier key is ever missed; wrong answers are first arrivals said to be seen. Null keys are never
    seen and never kept. The result is a written table.

    Of arrivals with one key only the first in each Arrow batch goes to the key's shard; the others
    are spread by id. So a key that holds a third of all rows adds one row a batch to its shard.
    """
    keep = keep or before is not None
    n = (before.agg(F.max("shards")).first()[0] if before is not None else None) or shards or parallelism(arrivals.sparkSession)
    hashed = arrivals.where(F.col("key").isNotNull()).select("tbl", F.col("id").cast("long").alias("id"), F.xxhash64("key").alias("h"))
    rows = hashed.mapInArrow(_combine, "tbl string, id long, h long, sure boolean")
    if keep:
        kept = ["layer", "piece", "capacity", "error", "held", "bits"]
        kinds = dict(x.split(" ") for x in LAYERS.split(", "))
        rows = rows.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in kept])
        if before is not None:
            rows = rows.unionByName(before.select("tbl", F.lit(None).cast("long").alias("id"), F.col("home").alias("h"), F.lit(False).alias("sure"), *kept))
    spread = rows.repartition(n, F.when(F.col("sure"), F.xxhash64("id")).otherwise(F.col("h")))
    # Null ids, those of layers, come first.
    said = spread.sortWithinPartitions("tbl", "id").mapInArrow(_judge(capacity, error, growth, tightening, n, keep), ALL)
    return materialize(said, "seen")


def layers(said: DataFrame) -> DataFrame:
    """The chains of verdicts made with ``keep``, to be stored: tables of LAYERS."""
    return said.where(F.col("kind") == "layer").select(*[x.split(" ")[0] for x in LAYERS.split(", ")])


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """Chains of two histories as one: the layers of both, whose error rates add up. Both have the same number of shards."""
    if len({r[0] for x in (one, other) for r in x.select("shards").distinct().limit(3).collect()}) > 1:
        raise ValueError("chains with different numbers of shards")
    # Shards meet by their number, as worked out from their keys by the function that dealt them.
    n = one.agg(F.max("shards")).first()[0] or 1
    shard = F.pmod(F.hash("home"), F.lit(n))
    homes = one.unionByName(other).groupBy("tbl", shard.alias("s")).agg(F.min("home").alias("__home"))
    last = one.groupBy("tbl", shard.alias("s")).agg((F.max("layer") + 1).alias("__more"))
    later = other.withColumn("s", shard).join(last, ["tbl", "s"], "left").withColumn("layer", F.col("layer") + F.coalesce("__more", F.lit(0))).drop("__more")
    return one.withColumn("s", shard).unionByName(later).join(homes, ["tbl", "s"]).withColumn("home", F.col("__home")).drop("s", "__home").select(*one.columns)


def wrong(arrivals: DataFrame, said: DataFrame, share: float = 1.0) -> DataFrame:
    """Exact check of the verdicts: (tbl, id) of arrivals said to be seen that were the first of their key.

    Only keys under suspicion are looked at again: those whose hash bears a verdict ``seen``; with a ``share``, those of
    that share of all hashes. Verdicts are as many as repeated arrivals, so they're joined by sorting, never broadcast.
    """
    part = F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int(share * (1 << 20))
    seen = said.where((F.col("kind") == "seen") & part)
    keys = arrivals.where(F.col("key").isNotNull()).select("tbl", F.col("id").cast("long").alias("id"), "key", F.xxhash64("key").alias("h")).where(part)
    first = keys.join(seen.select("tbl", "h").distinct().hint("merge"), ["tbl", "h"], "left_semi").groupBy("tbl", "key").agg(F.min("id").alias("id"))
    return first.select("tbl", "id").join(seen.select("tbl", "id").hint("merge"), ["tbl", "id"], "left_semi")


def seen_before(arrivals: DataFrame, **options) -> DataFrame:
    """(tbl, id) of arrivals whose key came before, checked exactly. No rows in: no rows out."""
    said = verdicts(arrivals, **options)
    return said.where(F.col("kind") == "seen").select("tbl", "id").join(wrong(arrivals, said).hint("merge"), ["tbl", "id"], "left_anti")


def error_report(arrivals: DataFrame, share: float = 1.0, **options) -> DataFrame:
    """One row a table: arrivals, distinct keys by the chains, said seen, wrong answers, their rate among
    first arrivals as measured, and the largest bound of any chain. Wrong answers are counted over a ``share`` of all
    keys, chosen by hash, and scaled."""
    said = verdicts(arrivals, **options)
    chains = said.where(F.col("kind") == "chain").groupBy("tbl").agg(F.sum("n").alias("arrivals"), F.sum("h").alias("kept_keys"), F.max("bound").alias("bound"), F.max("id").alias("layers"))
    seen = said.where(F.col("kind") == "seen").groupBy("tbl").agg(F.count("*").alias("said_seen"))
    bad = wrong(arrivals, said, share).groupBy("tbl").agg(F.round(F.count("*") / share).cast("long").alias("wrong"))
    n = F.coalesce("wrong", F.lit(0))
    return (
        chains.join(seen, "tbl", "left")
        .join(bad, "tbl", "left")
        .select("tbl", "arrivals", "kept_keys", "layers", F.coalesce("said_seen", F.lit(0)).alias("said_seen"), n.alias("wrong"), (n / F.greatest(n + F.col("kept_keys"), F.lit(1))).alias("wrong_rate"), "bound")
    )
