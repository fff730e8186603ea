"""The split of a text into pre-tokens that byte-level vocabularies use before merging."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import regex

#: Texts beyond this are walked, not split at once, so that memory stays bounded.
WALK = 4_000_000


PLAIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@lru_cache(maxsize=1)
def pattern() -> regex.Pattern:
    """PLAIN for any text. The regex module's tables of letters and numbers are of a later Unicode version than those of
    the vocabularies' library. The characters that may differ, unassigned in the interpreter's own older
    tables, are looked up in the library once: those it takes for neither are put with the others."""
    import unicodedata

    from tokenizers.pre_tokenizers import ByteLevel

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    late = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    cut = {span for _, span in ByteLevel(add_prefix_space=False).pre_tokenize_str("\n".join(f"a{c}1" for c in late))}
    late = [c for i, c in enumerate(late) if (4 * i + 1, 4 * i + 2) in cut]  # neither with a nor with 1
    runs: list[list[int]] = []
    for c in map(ord, late):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    later = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    letter, number = (rf"[\p{{{k}}}--[{later}]]" if later else rf"\p{{{k}}}" for k in "LN")
    other = rf"[[^\s\p{{L}}\p{{N}}]||[{later}]]" if later else r"[^\s\p{L}\p{N}]"
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+", regex.V1)


def split(text: str) -> Iterator[str] | list[str]:
    try:
        text.encode("latin-1")
        p = PLAIN  # what differs lies far beyond these characters
    except UnicodeEncodeError:
        p = pattern()
    return p.findall(text) if len(text) <= WALK else (m.group() for m in p.finditer(text))


class Vocabulary:
    """A byte-level vocabulary file: its merges over symbols, its added strings, its ids.

    Symbol b < 256 is the byte b, symbol 256 + r what the merge of rank r makes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
        self.byte_of = {c: b for b, c in letters.items()}
        symbol = {letters[b]: b for b in range(256)}
        self.merges: list[tuple[int, int]] = []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.append((symbol[a], symbol[b]))
            symbol.setdefault(a + b, 256 + rank)
        vocab = spec["model"]["vocab"]
        self.id_of = [0] * (256 + len(self.merges))
        self.label = [b""] * len(self.id_of)  # bytes of each symbol
        for s, k in symbol.items():
            self.id_of[k] = vocab[s]
            self.label[k] = bytes(self.byte_of[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary stretches with None, and added strings found in the text with their ids."""
        if not self.added_pattern or not any(x in text for x in self.added):
            yield text, None
            return
        at = 0
        for m in self.added_pattern.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], None
            yield m.group(), self.added[m.group()]
            at = m.end()
        if at < len(text):
            yield text[at:], None


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """In the folder given, or where the public vocabularies are installed."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
