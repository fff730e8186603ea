"""Quality rules on repetition: how many characters lie in n-grams of words, or in lines, found twice.

Word hashes are combined into rolling hashes of each n-gram length with numpy; a sort finds the n-grams
found twice or more, and a difference array the words that they cover. A text is rejected if its base
counts fail, or if the share of its word characters in duplicated lines, or in n-grams duplicated beyond
their first occurrence, passes the limit of that length and these are more than `allowed` characters.

A null text counts as one without words (n_words 0, base_failed, not kept); a null id is passed on; each
row of repeated ids gives its own row; an empty table gives no rows; columns besides the two named are not
looked at. Texts are taken whole; memory is a few numbers per word of the longest text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, WordHashes, by_batch, field_type, kept, two_columns

#: Largest shares of characters in n-grams found before in the text, by length, and in lines found before: the
#: published limits.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
#: Characters found before that never reject a text: an ordinary line said twice is a large share of a short text, but no
#: repetition that tells anything of it.
ALLOWED = 100
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8

_SPACE, _SYMBOL, _INNER, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x80:0xC0] = _INNER  # bytes within a code point
_KIND[list(SYMBOLS)] = _SYMBOL
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes() -> WordHashes:
    return kept("quality_rules", WordHashes)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    m = len(h) - n + 1
    out = h[:m].copy()
    for i in range(1, n):
        out *= _STEP
        out += h[i : i + m]
    return out ^ (out >> np.uint64(29))


def occurrences(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: whether its value is found at another place, and whether at an earlier one."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(h), bool)
    again[order[1:]] = same
    twice = again.copy()
    twice[order[:-1]] |= same
    return twice, again


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in n-grams that begin where `starts` is true."""
    edge = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    np.subtract.at(edge, at + n, 1)
    return np.cumsum(edge[:-1]) > 0


def measured(text: str, limits: dict[int, float], line_limit: float, allowed: int = ALLOWED) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, whether the method's verdict is good,
    the share in duplicated lines and the largest share in duplicated n-grams."""
    raw = text.encode("utf-8")
    words = raw.split()
    n = len(words)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=4)
    word_chars = int(kinds[_SYMBOL] + kinds[_OTHER])
    seen, dup_lines, dup_chars = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                dup_lines += 1
                dup_chars += sum(len(w.decode("utf-8")) for w in line.split())
            else:
                seen.add(line)
    line_share = dup_chars / word_chars if word_chars else 0.0
    good, worst, repeat = line_share <= line_limit or dup_chars <= allowed, 0.0, 0
    shortest = min([REPEAT_WINDOW, *limits])
    if n >= shortest:
        h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, n)
        first = occurrences(rolling(h, shortest))
        if first[1].any():  # else no longer n-gram is found twice
            length = None
            for k in sorted({REPEAT_WINDOW, *limits}):
                if n < k:
                    break
                twice, again = first if k == shortest else occurrences(rolling(h, k))
                if k == REPEAT_WINDOW:
                    repeat = int(covered(twice, k, n).sum())
                if k in limits:
                    if length is None:
                        length = np.fromiter((len(w.decode("utf-8")) for w in words), np.int64, n)
                    chars = int(length[covered(again, k, n)].sum())
                    share = chars / word_chars
                    worst, good = max(worst, share), good and (share <= limits[k] or chars <= allowed)
    return n, word_chars, int(kinds[_SYMBOL]), dup_lines, repeat, good, line_share, worst


def quality(docs: DataFrame, ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, allowed: int = ALLOWED, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    (under 20 words, or over 30 % of them in repeated windows), kept, dup_line_share, dup_ngram_share; and
    the columns named in carry, unchanged."""
    limits = NGRAM_LIMITS if ngram_limits is None else ngram_limits
    named = two_columns(docs, id_col, text_col)
    others = [c for c in carry if c != text_col]  # the text goes through once
    if carry:
        named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("carried"))
    kinds = {"n_words": "int64", "word_chars": "int64", "n_symbols": "int64", "n_dup_lines": "int64", "n_repeat_words": "int64", "base_failed": "bool", "kept": "bool", "dup_line_share": "float64", "dup_ngram_share": "float64"}

    def ruled(many: list[str]) -> dict:
        import pyarrow as pa

        rows = []
        for t in many:
            n, chars, symbols, lines, repeat, good, by_line, by_ngram = measured(t, limits, line_limit, allowed)
            failed = n < 20 or 100 * repeat > 30 * n
            rows.append((n, chars, symbols, lines, repeat, failed, good and not failed, by_line, by_ngram))
        return {c: pa.array([r[i] for r in rows], getattr(pa, k + "_" * (k == "bool"))()) for i, (c, k) in enumerate(kinds.items())}

    spark_kind = {"int64": "long", "bool": "boolean", "float64": "double"}
    schema = f"id {field_type(named, 'id')}, " + ", ".join(f"{c} {spark_kind[k]}" for c, k in kinds.items())
    if not carry:
        return named.mapInArrow(by_batch(ruled), schema).withColumnRenamed("id", id_col)

    def carried(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                made = ruled(["" if x is None else x for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_pydict({"id": part.column(0)} | made | {"text": part.column(1), "carried": part.column(2)})

    out = named.mapInArrow(carried, schema + f", text string, carried {field_type(named, 'carried')}")
    return out.select(F.col("id").alias(id_col), *kinds, *[F.col("text").alias(c) if c == text_col else F.col(f"carried.`{c}`").alias(c) for c in carry])
