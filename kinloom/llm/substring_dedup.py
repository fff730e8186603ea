"""Removal of passages that an earlier document holds, by relative Lempel-Ziv parsing.

The reference is the corpus itself, indexed in blocks. Each window (n consecutive words) names an anchor, the
least hash of the runs of five words in it, and windows in a row with one anchor are a stretch of text. A block
holds the stretches whose anchors fall in its range of hashes, as words, and an index of their windows; equal
windows have equal anchors, so a document is parsed against every block that can hold a match of it, a stretch
at a time, and no block meets documents that share nothing with it. The parse is greedy: at a place whose window
an earlier document has, a factor (reference document, place, length) begins, and it goes on, word by word, as long
as the reference goes on with the same words. Where it ends, the windows across its boundary are looked up as
well, and may begin a factor elsewhere. Factors are at least n words long and are the duplicate spans; those that go on
from one stretch to the next are put together in the document.

Most windows are found nowhere else, so documents first tell their anchors alone, and only stretches whose anchor
is in another document go to blocks. An anchor with HOT stretches or more (a phrase that a third of all documents hold, in
as many contexts) would make one block of them: its windows are stretches of their own, by their own hashes. A batch
sends a stretch once, however many of its documents hold it.

Hashes only bring stretches together; words decide. A null text has no words. Ids are integers. A document with a null
id is neither reference nor changed; rows that repeat an id are one document and never duplicates of each other; an
empty table gives no rows; columns besides those named are not looked at. Of a very long text a task holds the
words and a few numbers for each.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, kept, two_columns
from .perfect_hash import mixed
from .shards import batch_of, by_shard, packed, sizes

ANCHOR_WORDS = 5
#: Windows in a stretch at most, and stretches of an anchor from which on its windows are dealt out one by one.
STRETCH, HOT = 64, 512
MANY = 127  # of a batch's stretches of an anchor, so many are told; that many are HOT
ASK_ANCHORS = "shard int, batch long, keys binary, counts binary"
ANCHORS = "batch long, keys binary, hot binary"
STRETCHES = "shard int, batch long, keys binary, texts binary, docs binary, at binary, held binary, own binary, rows binary, starts binary"
FACTORS = "batch long, rows binary, starts binary, lengths binary, refs binary, at binary"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def word_hashes() -> WordHashes:
    return kept("substring_dedup", lambda: WordHashes(seed=1))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    m = len(h) - n + 1
    out = h[:m].copy()
    for i in range(1, n):
        out *= _STEP
        out += h[i : i + m]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors_and_windows(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor, spread evenly over 64 bits (minima crowd at the low end), and its hash."""
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    k = min(ANCHOR_WORDS, n)
    return mixed(sliding_least(rolling(h, k), n - k + 1), 7), rolling(h, n)


def stretches(anchors: np.ndarray) -> np.ndarray:
    """Where the windows begin that have another anchor than those before, or would be too many with them."""
    if not len(anchors):
        return np.empty(0, np.int64)
    new = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    size = np.diff(np.append(new, len(anchors)))
    if size.max() <= STRETCH:
        return new
    parts = -(-size // STRETCH)
    first = np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(new, parts) + (np.arange(parts.sum()) - first) * STRETCH


def rows_of(table) -> list[tuple[int, int | None, str]]:
    """(row, id, text) by id and text: rows have the same number wherever a batch is looked at."""
    both = sorted(zip(table.column("id").to_pylist(), table.column("text").to_pylist()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    return [(r, i, t or "") for r, (i, t) in enumerate(both)]


def ask_anchors(shards: int, n: int):
    """Each anchor of the batch, with the number of its stretches and (the high bit) whether documents share it."""

    def of_batch(table):
        batch, keys, docs = table.column("batch")[0].as_py(), [], []
        for _, i, text in rows_of(table):
            if i is not None and text:
                anchors, _ = anchors_and_windows(text.encode("utf-8").split(), n)
                keys.append(anchors[stretches(anchors)])
                docs.append(np.full(len(keys[-1]), i, np.int64))
        if not keys or not len(every := np.concatenate(keys)):
            return packed([], "ilbb", ["shard", "batch", "keys", "counts"])
        docs = np.concatenate(docs)
        order = np.argsort(every, kind="stable")  # documents come by id
        every, docs = every[order], docs[order]
        at = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        end = np.append(at[1:], len(every))
        counts = (np.minimum(end - at, MANY) | ((docs[at] != docs[end - 1]).astype(np.int64) << 7)).astype(np.uint8)
        keys = every[at]
        return packed([(s, batch, keys[p].tobytes(), counts[p].tobytes()) for s, p in by_shard(keys, shards)], "ilbb", ["shard", "batch", "keys", "counts"])

    return of_batch


def answer_anchors(table):
    """To each batch, those of its anchors that two documents hold, and which of them are hot."""
    keys, counts = ([np.frombuffer(x, k) for x in table.column(c).to_pylist()] for c, k in (("keys", "<u8"), ("counts", np.uint8)))
    distinct, number, batches = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    told = np.concatenate(counts)
    shared = batches > 1
    shared[number[told > MANY]] = True
    many = np.bincount(number, weights=told & MANY, minlength=len(distinct)) >= HOT
    many[number[(told & MANY) == MANY]] = True
    rows, at = [], 0
    for batch, k in zip(table.column("batch").to_pylist(), keys):
        own = number[at : at + len(k)]
        at += len(k)
        if (hit := shared[own]).any():
            rows.append((batch, k[hit].tobytes(), many[own][hit].astype(np.uint8).tobytes()))
    return packed(rows, "lbb", ["batch", "keys", "hot"])


def gathered(table, *columns: tuple[str, str]) -> list[np.ndarray]:
    """Arrays of all rows put together, by the first of them in order."""
    arrays = [np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in columns]
    order = np.argsort(arrays[0], kind="stable")
    return [x[order] for x in arrays]


def ask_stretches(shards: int, n: int):
    """The batch's distinct stretches with shared anchors: key, words, first document and place there, and the
    rows and places of all that hold them, those of the first document (`own` many) in front."""
    names = [c.split()[0] for c in STRETCHES.split(", ")]

    def of_batch(docs, answer):
        held, hot = gathered(answer, ("keys", "<u8"), ("hot", np.uint8))
        found: dict[bytes, list] = {}
        for row, i, text in rows_of(docs) if len(held) else ():
            if i is None or not text:
                continue
            words = text.encode("utf-8").split()
            anchors, windows = anchors_and_windows(words, n)
            begin = stretches(anchors)
            keys = anchors[begin]
            at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
            hit = np.flatnonzero(held[at] == keys)
            end = np.append(begin[1:], len(anchors))
            for a, b, key, one in zip(begin[hit].tolist(), end[hit].tolist(), keys[hit].tolist(), hot[at[hit]].tolist()):
                for x, y in ((k, k + 1) for k in range(a, b)) if one else ((a, b),):
                    stretch = b" ".join(words[x : y + n - 1])
                    e = found.get(stretch)
                    if e is None:
                        found[stretch] = [int(windows[x]) if one else key, stretch, i, x, 1, [row], [x]]
                    else:
                        e[4] += e[2] == i
                        e[5].append(row)
                        e[6].append(x)
        if not found:
            return packed([], "il" + "b" * 8, names)
        entries = list(found.values())
        keys = np.array([e[0] for e in entries], np.uint64)
        order, batch, rows = np.argsort(keys, kind="stable"), docs.column("batch")[0].as_py(), []
        for s, p in by_shard(keys[order], shards):
            part = [entries[k] for k in order[p].tolist()]
            numbers = lambda k, t: np.array([e[k] for e in part], t).tobytes()
            lists = lambda k: np.concatenate([np.array(e[k], np.uint32) for e in part]).tobytes()
            many = np.array([len(e[5]) for e in part], np.uint32).tobytes()
            rows.append((s, batch, numbers(0, np.uint64), b"\n".join(e[1] for e in part), numbers(2, np.int64), numbers(3, np.uint32), many, numbers(4, np.uint32), lists(5), lists(6)))
        return packed(rows, "il" + "b" * 8, names)

    return of_batch


class Reference:
    """The texts of a block that share a key, of the documents seen so far, and an index of their windows."""

    def __init__(self, n: int):
        self.n, self.windows = n, {}

    def add(self, words: list[bytes], doc: int, place: int) -> None:
        for k in range(len(words) - self.n + 1):
            self.windows.setdefault(tuple(words[k : k + self.n]), (words, k, doc, place + k))

    def factors(self, words: list[bytes], doc: int) -> list[tuple[int, int, int, int]]:
        """The greedy parse against documents before `doc`: (start, length, document, place) of each factor."""
        n, at, out = self.n, 0, []
        while at + n <= len(words):
            hit = self.windows.get(tuple(words[at : at + n]))
            if hit is None or hit[2] >= doc:  # added in the order of documents: no earlier one has it
                at += 1
                continue
            reference, k, other, place = hit
            length = n
            while at + length < len(words) and k + length < len(reference) and words[at + length] == reference[k + length]:
                length += 1
            out.append((at, length, other, place))
            at += length - n + 1  # the next windows lie across the boundary
        return out


def parsed_against_block(n: int):
    """Factors of each batch's stretches, against all stretches of the block with the same key."""

    def of_shard(table):
        arrays = {c: [np.frombuffer(x, k) for x in table.column(c).to_pylist()] for c, k in (("keys", "<u8"), ("docs", "<i8"), ("at", "<u4"), ("held", "<u4"), ("own", "<u4"), ("rows", "<u4"), ("starts", "<u4"))}
        batches, texts = table.column("batch").to_pylist(), [x.split(b"\n") for x in table.column("texts").to_pylist()]
        every = np.concatenate(arrays["keys"])
        of = np.repeat(np.arange(len(batches)), [len(k) for k in arrays["keys"]])
        inner = np.concatenate([np.arange(len(k)) for k in arrays["keys"]])
        docs, held, own = (np.concatenate(arrays[c]) for c in ("docs", "held", "own"))
        offsets = [np.cumsum(h) - h for h in arrays["held"]]
        order = np.lexsort((docs, every))
        new = np.append(True, every[order][1:] != every[order][:-1])
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(order))
        # One entry that one document holds has nothing to be told.
        some = np.flatnonzero((end - at > 1) | (held[order[at]] > own[order[at]]))
        out: list[list] = [[] for _ in batches]
        for a, b in zip(at[some].tolist(), end[some].tolist()):
            first, reference, several = {}, None, b - a > 1
            for e in order[a:b].tolist():
                r, k = int(of[e]), int(inner[e])
                text, doc, place, o = texts[r][k], int(docs[e]), int(arrays["at"][r][k]), int(offsets[r][k])
                rows, starts = (arrays[c][r][o : o + int(held[e])].tolist() for c in ("rows", "starts"))
                before, mine, words = first.get(text), int(own[e]), None
                if before is None:
                    first[text] = before = (doc, place)
                    if several:
                        words = text.split(b" ")
                        for x, length, other, p in reference.factors(words, doc) if reference else ():
                            out[r] += [(row, start + x, length, other, p) for row, start in zip(rows[:mine], starts)]
                        reference = reference or Reference(n)
                        reference.add(words, doc, place)
                    rows, starts = rows[mine:], starts[mine:]
                if rows:  # the text itself is an earlier document's
                    length = text.count(b" ") + 1
                    out[r] += [(row, start, length, *before) for row, start in zip(rows, starts)]
        replies = [(batch, *(np.array(x, t).tobytes() for x, t in zip(zip(*found), ("<u4", "<u4", "<u4", "<i8", "<u4")))) for batch, found in zip(batches, out) if found]
        return packed(replies, "lbbbbb", [c.split()[0] for c in FACTORS.split(", ")])

    return of_shard


def joined(found: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Factors by place, those put together that go on where another one lies."""
    out: list[list[int]] = []
    for start, length, doc, place in sorted(found):
        last = out[-1] if out else None
        if last and start <= last[0] + last[1] and doc == last[2] and place - start == last[3] - last[0]:
            last[1] = max(last[1], start + length - last[0])
        else:
            out.append([start, length, doc, place])
    return out


def apply_spans(with_text: bool):
    def of_batch(table, answer):
        import pyarrow as pa

        row, *rest = gathered(answer, ("rows", "<u4"), ("starts", "<u4"), ("lengths", "<u4"), ("refs", "<i8"), ("at", "<u4"))
        ids, n_words, n_removed, out, spans = [], [], [], [], []
        for r, i, text in rows_of(table):
            words, gone, found = text.encode("utf-8").split(), None, []
            a, b = np.searchsorted(row, (r, r + 1))
            if b > a:
                found = joined(list(zip(*(x[a:b].tolist() for x in rest))))
                gone = np.zeros(len(words), bool)
                for start, length, _, _ in found:
                    gone[start : start + length] = True
            kept = b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g])
            ids.append(i)
            n_words.append(len(words))
            n_removed.append(0 if gone is None else int(gone.sum()))
            out.append(kept.decode("utf-8") if with_text else hashlib.sha256(kept).hexdigest())
            spans.append([dict(zip(("start", "length", "ref_id", "ref_start"), f)) for f in found] if with_text else None)
        made = {"id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(out, pa.string())}
        if with_text:
            made["spans"] = pa.array(spans, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "ref_id", "ref_start")])))
        return pa.table(made)

    return of_batch


def substring_dedup(docs: DataFrame, n: int = 13, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed (words in windows of n that also start in a document of
    a smaller id), kept_text and spans (the factors), or without text kept_sha256; kept words are joined by
    one space."""
    batches, shards = sizes(docs, text_col)
    named = two_columns(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    named = named.withColumn("batch", batch_of(F.col("id"), F.col("text"), batches))
    by_batch = named.groupBy("batch")
    anchors = by_batch.applyInArrow(ask_anchors(shards, n), ASK_ANCHORS).groupBy("shard").applyInArrow(answer_anchors, ANCHORS)
    asked = by_batch.cogroup(anchors.groupBy("batch")).applyInArrow(ask_stretches(shards, n), STRETCHES)
    found = asked.groupBy("shard").applyInArrow(parsed_against_block(n), FACTORS)
    schema = "id long, n_words long, n_removed long, kept string" + ", spans array<struct<start: long, length: long, ref_id: long, ref_start: long>>" * with_text
    out = by_batch.cogroup(found.groupBy("batch")).applyInArrow(apply_spans(with_text), schema)
    kept = F.col("kept").alias("kept_text" if with_text else "kept_sha256")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", kept, *["spans"] * with_text)
