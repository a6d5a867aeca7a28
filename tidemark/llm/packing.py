"""Texts of varying length into containers of fixed capacity, with balanced cost.

Lengths are tokens of a public tokenizer. A text longer than a container is cut into full containers
and a rest; nothing else is cut. Texts are dealt evenly to shards; within a shard the longest come
first and each goes to the container of lowest cost that still has room, where cost is linear plus
quadratic in a text's length, as for attention within texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize, ship

ship(sys.modules[__name__])

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text before byte pairs are merged (the pattern published with this vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[int, object] = {}


def tokenizer(raw: bytes):
    """The tokenizer of a stored vocabulary, made once a process."""
    if (name := hash(raw)) not in _loaded:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        _loaded[name] = tiktoken.Encoding("stored", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[name]


def _count(vocabulary):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            encode = encode or tokenizer(vocabulary.value).encode_ordinary
            n = [len(encode(x)) if x else 0 for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return count


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null and empty texts have 0. The vocabulary (about a megabyte) is read where the
    job is made and travels with it: executors needn't have it."""
    with open(path, "rb") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(vocabulary), "doc_id long, n_tokens long")


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1e-4) -> np.ndarray:
    """Container of each item (none longer than capacity): descending items, each to the cheapest container with room.

    As many containers as the total needs at least are open from the start; more open when an item fits nowhere.
    """
    order = np.argsort(-lengths, kind="stable")
    n = max(1, -(-int(lengths.sum()) // capacity))
    room, cost = np.full(n, capacity, np.int64), np.zeros(n)
    out = np.empty(len(lengths), np.int64)
    item_cost = linear * lengths + quadratic * lengths.astype(float) ** 2
    for i in order:
        x = lengths[i]
        fits = room >= x
        at = int(np.argmin(np.where(fits, cost, np.inf)))
        if not fits[at]:
            at = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        room[at] -= x
        cost[at] += item_cost[i]
        out[i] = at
    return out


def _pack(capacity: int, linear: float, quadratic: float):
    def pack(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("n_tokens", "descending"), ("doc_id", "ascending")])
        n = shard.column("n_tokens").to_numpy()
        whole = np.where(n > capacity, n // capacity, 0)
        rest = n - whole * capacity
        # Full containers of texts that had to be cut.
        cut = np.repeat(np.arange(len(n)), whole)
        piece = np.arange(len(cut)) - np.repeat(np.cumsum(whole) - whole, whole)
        items = np.flatnonzero(rest > 0)
        put = assign(rest[items], capacity, linear, quadratic) + len(cut)
        of = np.concatenate([cut, items])
        return pa.table(
            {
                "shard": pa.array(np.full(len(of), shard.column("shard")[0].as_py())),
                "container": pa.array(np.concatenate([np.arange(len(cut)), put])),
                "doc_id": shard.column("doc_id").take(pa.array(of)),
                "piece": pa.array(np.concatenate([piece, whole[items]])),
                "from_token": pa.array(np.concatenate([piece * capacity, whole[items] * capacity])),
                "n_tokens": pa.array(np.concatenate([np.full(len(cut), capacity), rest[items]])),
            }
        )

    return pack


def pack(sizes: DataFrame, capacity: int, *, docs_per_shard: int = 20_000, linear: float = 1.0, quadratic: float = 1e-4) -> DataFrame:
    """Places (shard, container, doc_id, piece, from_token, n_tokens) for sizes (doc_id, n_tokens).

    A container is named by shard and number and holds at most ``capacity`` tokens. Texts of no tokens take no room:
    they come out once, with a null container. Null ids are spread like others. A text longer than a container comes out in several pieces. No rows in: no
    rows out. Each shard is one task's arrays of two numbers a text, about ``docs_per_shard`` of them; only its last few
    containers can be short of full.
    """
    shards = max(1, -(-sizes.count() // docs_per_shard))
    some = sizes.where(F.col("n_tokens") > 0).withColumn("shard", F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), F.lit(shards)))
    schema = "shard long, container long, doc_id long, piece long, from_token long, n_tokens long"
    placed = some.groupBy("shard").applyInArrow(_pack(capacity, linear, quadratic), schema)
    nothing = F.lit(None).cast("long")
    return placed.unionByName(sizes.where(F.col("n_tokens") == 0).select(nothing.alias("shard"), nothing.alias("container"), "doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("from_token"), "n_tokens"))


def pack_documents(documents: DataFrame, capacity: int, path: str = TOKENIZER, **options) -> DataFrame:
    """Packs whole documents; their token counts are written once, as they're the costly part."""
    return pack(materialize(token_counts(documents, path), "tokens"), capacity, **options)


def containers(placed: DataFrame, capacity: int, linear: float = 1.0, quadratic: float = 1e-4) -> DataFrame:
    """Each container with its texts, tokens, unused tokens and cost."""
    n = F.col("n_tokens")
    return (
        placed.where(F.col("container").isNotNull())
        .groupBy("shard", "container")
        .agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"), (F.lit(capacity) - F.sum("n_tokens")).alias("unused"), F.sum(linear * n + quadratic * n * n).alias("cost"))
    )
