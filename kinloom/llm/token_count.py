"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

Null text counts as empty (0 tokens); a null id is passed on; each row of repeated ids gives its
own row; an empty table gives no rows; columns besides the two named are not looked at. A text of
any length is counted whole: splitting walks long texts, merging takes O(n log n) of a pre-token.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, field_type, kept, two_columns
from .pretokens import Vocabulary, split, vocabulary_path


class Counts(dict):
    """pre-token -> number of tokens; short ones are remembered, up to `limit`."""

    def __init__(self, path: str, limit: int = 1 << 18):
        self.vocabulary = Vocabulary(path)
        self.rank = {a << 32 | b: r for r, (a, b) in reversed(list(enumerate(self.vocabulary.merges)))}
        self.limit = limit

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece.encode("utf-8"))
        if len(piece) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = n
        return n

    def merged(self, piece: bytes) -> int:
        """Initial symbols less merges. The heap holds rank << 32 | position of the pair's left symbol;
        an entry whose pair has changed since no longer has that rank and is passed over."""
        n = len(piece)
        if n < 2:
            return n
        rank = self.rank.get
        symbol = list(piece)
        heap = [r << 32 | i for i, pair in enumerate(zip(piece, piece[1:])) if (r := rank(pair[0] << 32 | pair[1])) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n or rank(symbol[i] << 32 | symbol[j]) != r:
                continue
            merges += 1
            symbol[i], symbol[j] = 256 + r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank(symbol[i] << 32 | symbol[k])) is not None:
                    heappush(heap, x << 32 | i)
            h = before[i]
            if h >= 0 and (x := rank(symbol[h] << 32 | symbol[i])) is not None:
                heappush(heap, x << 32 | h)
        return n - merges

    def of(self, text: str) -> int:
        total = 0
        for part, added in self.vocabulary.pieces(text):
            total += 1 if added is not None else sum(map(self.__getitem__, split(part)))
        return total


def counter(path: str) -> Counts:
    return kept(("token_count", path), lambda: Counts(path))


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    named = two_columns(docs, id_col, text_col)

    def counted(many: list[str]) -> dict:
        import pyarrow as pa

        of = counter(path).of
        return {"n_bytes": pa.array([len(t.encode("utf-8")) for t in many], pa.int64()), "n_tokens": pa.array([of(t) for t in many], pa.int64())}

    out = named.mapInArrow(by_batch(counted), f"id {field_type(named, 'id')}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
