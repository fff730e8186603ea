"""Requests to shards and replies: how documents ask what the whole corpus knows of a key.

Documents are grouped in batches. A batch sends each shard (a range of 64-bit keys) one row with its distinct
keys and what belongs to them; a key held by a third of all documents is thus one entry of each batch. A shard
sees all entries of its keys, and replies to each batch in one row. No row is made for each occurrence, and
neither a shard nor a batch grows with the corpus: their numbers do. (Batches times shards is a bound on the
rows: where it passes the number of entries, a row has one entry, and there are as many as an ordinary join of
distinct keys would shuffle.)

Batches are of so many bytes of text, not of so many documents. Keys must be spread evenly over 64 bits: what
isn't, such as minima, is mixed first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a batch: a thousandth of the corpus, but within these bounds.
LEAST_BYTES, MOST_BYTES = 1 << 19, 1 << 23
#: Batches for each shard: a shard gets the entries of so many batches' worth of text.
BATCHES_PER_SHARD = 4
#: Documents in a batch on average, at most, however short they are.
MOST_DOCS = 1 << 14


def batch_of(id_column: Column, text: Column, batches: int) -> Column:
    """By the id; documents without one, which ask nothing, are dealt out by their texts."""
    return F.pmod(F.xxhash64(F.coalesce(id_column.cast("string"), text)), F.lit(batches).cast("long"))


def first_and_last(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and for each its smallest document, its largest and how many it has."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(keys)) - 1 if len(at) else at
    fresh = new.copy()
    fresh[1:] |= docs[1:] != docs[:-1]
    return keys[at], docs[at], docs[end], np.add.reduceat(fresh.astype(np.int64), at) if len(at) else at


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the keys' high bits: sorted keys lie in ascending shards."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, slice]]:
    """The stretch of sorted keys that goes to each shard, where there is one."""
    of = shard_of(keys, shards)
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
    return [(int(of[a]), slice(a, b)) for a, b in zip(at, [*at[1:], len(of)])]


def packed(rows: list, kinds: str, names: list[str]):
    """An Arrow table of rows: i a 32-bit integer, l a 64-bit one, b bytes."""
    import pyarrow as pa

    of = {"i": pa.int32(), "l": pa.int64(), "b": pa.binary()}
    return pa.table([pa.array([r[i] for r in rows], of[k]) for i, k in enumerate(kinds)], names)


def sizes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many batches and shards there are."""
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string"))), F.lit(0))).head()
    batches = max(1, -(-total // max(LEAST_BYTES, min(MOST_BYTES, total // 1000))), -(-n // MOST_DOCS))
    return batches, max(1, batches // BATCHES_PER_SHARD)
