"""Removal of lines that many documents share, with a sharded minimal perfect hash.

Counting: documents tell the 128-bit hashes of their long lines, and batches of them send each shard their distinct ones,
with the number of documents and the largest. A shard keeps those that enough documents hold, numbers them with a
minimal perfect hash, and writes this and the three arrays that it indexes: a compact fingerprint, the count of
documents and the largest document.

Probing: documents look their lines up in the arrays; a fingerprint that differs rejects a line that isn't held. If all arrays
together have at most ARRAYS_BYTES (they are measured), each task reads them from the shared folder and no text
is moved. If not, batches of documents send the shards' arrays the hashes of their lines, and drop what comes back.

A null or empty text is one empty line. Ids are integers. A document with a null id is not counted and keeps
all its lines; rows that repeat an id are one document for the count, and each gives its own row; an empty
table gives no rows; columns besides those named are not looked at (with carry, they are passed on). A line
of any length is hashed whole.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import SLICE, Written, kept, opened, texts, two_columns
from .perfect_hash import PerfectHash
from .shards import batch_of, by_shard, first_and_last, packed, sizes

BLANK = " \t\n\x0b\x0c\r"
ARRAYS_BYTES = 64 << 20
LINES = "batch long, id long, lines binary"
COUNTED = "shard int, keys binary, prints binary, counts binary, last binary"
ARRAYS = "shard int, arrays binary"
PROBES = "shard int, batch long, keys binary, prints binary"
REPLIES = "batch long, keys binary, prints binary, last binary"
NOBODY = np.iinfo(np.int64).min


def line_hashes(text: str, min_chars: int) -> tuple[list[str], list[int], bytes]:
    """The lines, which of them are long enough, and those lines' hashes, 16 bytes each."""
    lines, at, out = text.split("\n"), [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars and len(key := line.strip(BLANK)) >= min_chars:
            at.append(i)
            out.append(xxhash.xxh3_128_digest(key.encode("utf-8").lower()))  # lower(): of bytes, A-Z only
    return lines, at, b"".join(out)


def keys_and_prints(hashes: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(hashes, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def distinct(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each line's entry, and the entries' keys and prints, by key. A key with several prints, rare as
    it is, has several entries."""
    order = np.lexsort((prints, keys))
    new = np.append(True, (keys[order][1:] != keys[order][:-1]) | (prints[order][1:] != prints[order][:-1]))
    number = np.empty(len(order), np.uint64)
    number[order] = np.cumsum(new).astype(np.uint64) - np.uint64(1)
    return number, keys[order][new], prints[order][new]


def lines_of(min_chars: int):
    """The hashes of each document's long lines."""

    def mapped(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                found = [(k, i, h) for i, t, k in zip(part.column(0).to_pylist(), texts(part.column(1)), part.column(2).to_pylist()) if i is not None and (h := line_hashes(t, min_chars)[2])]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], k) for c, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["batch", "id", "lines"])

    return mapped


def counted(shards: int):
    """To each shard, a batch's distinct lines: how many documents hold them, and the largest."""

    def of_batch(table):
        hashes = table.column("lines").to_pylist()
        keys, prints = keys_and_prints(b"".join(hashes))
        docs = np.repeat(np.array(table.column("id").to_pylist(), np.int64), [len(h) // 16 for h in hashes])
        number, keys, prints = distinct(keys, prints)
        _, _, last, counts = first_and_last(number, docs)
        rows = [(s, keys[p].tobytes(), prints[p].tobytes(), counts[p].astype(np.uint32).tobytes(), last[p].tobytes()) for s, p in by_shard(keys, shards)]
        return packed(rows, "ibbbb", [c.split()[0] for c in COUNTED.split(", ")])

    return of_batch


class Arrays:
    """fingerprint, count and last document of each key, indexed by a minimal perfect hash. Keys that come
    with a second fingerprint are so rare that they are held aside."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        """Entries by key: a key's first one is in the arrays."""
        first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.empty(0, bool)
        self.hash = PerfectHash(keys[first])
        at = self.hash(keys[first])
        self.prints, self.counts, self.last = (np.empty(len(at), t) for t in (np.uint64, np.uint32, np.int64))
        for own, given in ((self.prints, prints), (self.counts, counts), (self.last, last)):
            own[at] = given[first]
        self.aside = np.array([keys[~first], prints[~first]], np.uint64), np.array([counts[~first], last[~first]], np.int64)

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0 for a line not held) and last documents (NOBODY)."""
        if not self.hash.size:
            return np.zeros(len(keys), np.int64), np.full(len(keys), NOBODY)
        at = self.hash(keys)
        held = (at >= 0) & (self.prints[at] == prints)
        counts, last = np.where(held, self.counts[at], 0).astype(np.int64), np.where(held, self.last[at], NOBODY)
        for k, p, n, d in zip(*self.aside[0].tolist(), *self.aside[1].tolist()):
            own = (keys == np.uint64(k)) & (prints == np.uint64(p))
            counts[own], last[own] = n, d
        return counts, last

    def to_bytes(self) -> bytes:
        out, levels = io.BytesIO(), {f"{name}{i}": x for i, level in enumerate(self.hash.levels) for name, x in zip(("places", "words", "before"), level)}
        np.savez(out, size=self.hash.size, prints=self.prints, counts=self.counts, last=self.last, aside=self.aside[0], told=self.aside[1], **levels)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Arrays:
        got, of = np.load(io.BytesIO(raw)), cls.__new__(cls)
        of.prints, of.counts, of.last, of.aside = got["prints"], got["counts"], got["last"], (got["aside"], got["told"])
        of.hash = PerfectHash(np.empty(0, np.uint64))
        of.hash.size = int(got["size"])
        of.hash.levels = [(int(got[f"places{i}"]), got[f"words{i}"], got[f"before{i}"]) for i in range(sum(x.startswith("places") for x in got.files))]
        return of


def built(min_docs: int):
    """The arrays of a shard, over the distinct hashes of lines that enough documents hold."""

    def of_shard(table):
        keys, prints, counts, last = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("keys", "<u8"), ("prints", "<u8"), ("counts", "<u4"), ("last", "<i8")))
        number, keys, prints = distinct(keys, prints)
        number = number.astype(np.int64)
        total, largest = np.bincount(number, weights=counts, minlength=len(keys)).astype(np.int64), np.full(len(keys), NOBODY)
        np.maximum.at(largest, number, last)
        many = total >= min_docs
        arrays = Arrays(keys[many], prints[many], total[many].astype(np.uint32), largest[many])
        return packed([(table.column("shard")[0].as_py(), arrays.to_bytes())] if many.any() else [], "ib", ["shard", "arrays"])

    return of_shard


def stored(files: tuple[str, ...]) -> dict[int, Arrays]:
    """The arrays of all shards, as they were written; a worker reads them once."""
    return kept(("line_dedup", files), lambda: loaded(files))


def loaded(files: tuple[str, ...]) -> dict[int, Arrays]:
    import pyarrow.parquet as pq

    out = {}
    for path in files:
        with opened(path) as f:
            table = pq.read_table(f)
        out |= {s: Arrays.from_bytes(x) for s, x in zip(table.column("shard").to_pylist(), table.column("arrays").to_pylist())}
    return out


def last_documents(arrays: dict[int, Arrays], shards: int, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The last document of each line that is held, else NOBODY."""
    out = np.full(len(keys), NOBODY)
    order = np.argsort(keys)
    for s, part in by_shard(keys[order], shards):
        if s in arrays:
            out[order[part]] = arrays[s].probe(keys[order[part]], prints[order[part]])[1]
    return out


def dropped(ids: list, many: list[str], min_chars: int, with_text: bool, last_of) -> dict:
    """The columns made of documents; last_of maps keys and prints of lines to their last documents, or NOBODY."""
    import pyarrow as pa

    cut = [line_hashes(t, min_chars) if i is not None else (None, [], b"") for i, t in zip(ids, many)]
    hashes = b"".join(h for _, _, h in cut)
    last = last_of(*keys_and_prints(hashes)) if hashes else np.empty(0, np.int64)
    n_lines, n_dropped, out, at = [], [], [], 0
    for i, t, (lines, places, _) in zip(ids, many, cut):
        own = last[at : at + len(places)]
        at += len(places)
        gone = {p for p, x in zip(places, ((own != NOBODY) & (own != i)).tolist()) if x} if len(own) else ()
        n_lines.append(t.count("\n") + 1)
        n_dropped.append(len(gone))
        kept = "\n".join(x for p, x in enumerate(lines) if p not in gone) if gone else t
        out.append(kept if with_text else hashlib.sha256(kept.encode("utf-8")).hexdigest())
    return {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept": pa.array(out, pa.string())}


def probed_here(files: tuple[str, ...], shards: int, min_chars: int, with_text: bool):
    """Documents probe the stored arrays where they are."""

    def mapped(batches):
        import pyarrow as pa

        arrays = stored(files)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                made = dropped(part.column(0).to_pylist(), list(texts(part.column(1))), min_chars, with_text, lambda k, p: last_documents(arrays, shards, k, p))
                yield pa.RecordBatch.from_pydict({"id": part.column(0)} | made | {"carried": part.column(2)})

    return mapped


def probes(shards: int):
    """To each shard, the distinct lines of a batch."""

    def of_batch(table):
        _, keys, prints = distinct(*keys_and_prints(b"".join(table.column("lines").to_pylist())))
        rows = [(s, table.column("batch")[0].as_py(), keys[p].tobytes(), prints[p].tobytes()) for s, p in by_shard(keys, shards)]
        return packed(rows, "ilbb", [c.split()[0] for c in PROBES.split(", ")])

    return of_batch


def replies(asked, arrays):
    """What the stored arrays of a shard hold of each batch's lines."""
    rows = []
    for raw in arrays.column("arrays").to_pylist():
        held = Arrays.from_bytes(raw)
        for batch, k, p in zip(*(asked.column(c).to_pylist() for c in ("batch", "keys", "prints"))):
            keys, prints = np.frombuffer(k, "<u8"), np.frombuffer(p, "<u8")
            count, last = held.probe(keys, prints)
            if (hit := count > 0).any():
                rows.append((batch, keys[hit].tobytes(), prints[hit].tobytes(), last[hit].tobytes()))
    return packed(rows, "lbbb", [c.split()[0] for c in REPLIES.split(", ")])


def probed_there(min_chars: int, with_text: bool):
    """Documents drop what the shards told them."""

    def of_batch(docs, found):
        import pyarrow as pa

        told = {}
        for k, p, d in zip(*(found.column(c).to_pylist() for c in ("keys", "prints", "last"))):
            told |= dict(zip(zip(np.frombuffer(k, "<u8").tolist(), np.frombuffer(p, "<u8").tolist()), np.frombuffer(d, "<i8").tolist()))
        last_of = lambda k, p: np.array([told.get(x, NOBODY) for x in zip(k.tolist(), p.tolist())], np.int64)
        made = dropped(docs.column("id").to_pylist(), list(texts(docs.column("text"))), min_chars, with_text, last_of)
        return pa.table({"id": docs.column("id")} | made | {"carried": docs.column("carried")})

    return of_batch


def line_arrays(named: DataFrame, batches: int, shards: int, min_chars: int, min_docs: int) -> Written:
    """named: (id, text). The table of the shards' arrays: (shard, arrays); shards without a common line have no row."""
    own = named.select("id", "text").withColumn("batch", batch_of(F.col("id"), F.col("text"), batches))
    told = own.mapInArrow(lines_of(min_chars), LINES).groupBy("batch").applyInArrow(counted(shards), COUNTED)
    return Written(told.groupBy("shard").applyInArrow(built(min_docs), ARRAYS), "line-arrays", few=True)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), arrays_bytes: int = ARRAYS_BYTES) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, and kept_text (or, without text, kept_sha256); and the
    columns named in carry, unchanged. Lines of at least min_chars code points, stripped of blanks and with
    A-Z in lower case, that at least min_docs documents hold are dropped but in the last of these."""
    batches, shards = sizes(docs, text_col)
    two_columns(docs, id_col, text_col)
    carried = F.struct(F.lit(None).cast("int").alias("_"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)])
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), carried.alias("carried"))
    arrays = line_arrays(named, batches, shards, min_chars, min_docs).df
    schema = StructType([StructField("id", LongType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", StringType()), named.schema["carried"]])
    total = arrays.agg(F.coalesce(F.sum(F.octet_length("arrays")), F.lit(0))).head()[0]
    if total <= arrays_bytes:
        out = named.mapInArrow(probed_here(tuple(sorted(arrays.inputFiles())), shards, min_chars, with_text), schema)
    else:
        own = named.withColumn("batch", batch_of(F.col("id"), F.col("text"), batches))
        asked = own.select("id", "text", "batch").mapInArrow(lines_of(min_chars), LINES).groupBy("batch").applyInArrow(probes(shards), PROBES)
        found = asked.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInArrow(replies, REPLIES)
        out = own.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(probed_there(min_chars, with_text), schema)
    kept = F.col("kept").alias("kept_text" if with_text else "kept_sha256")
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", kept, *[F.col(f"carried.c{k}").alias(c) for k, c in enumerate(carry)])
