"""Byte-pair encoding and decoding with a tokenization automaton.

The automaton reads tokens. It begins with one state that has an arc for every byte. Each merge (u, v),
in order of rank, is a gadget: the state that u leads to loses its arc v, and every state with an arc u
gets an arc uv, to where v led. As all arcs of one token lead to one state, a state is named by the token
read last. It accepts each text in exactly one way, the one the merges give, and so it does each prefix of a text.
What a gadget did to an arc is told by the gadgets alone (`arc`), so no table of states times tokens is kept.

Encoding goes byte by byte. Spelled out in bytes, the automaton is one of pairs: the token read last, and the node
of a trie of labels that the bytes since have led to. Sets of such pairs are the states of a deterministic
automaton over bytes, made when they are first reached and kept in a table: one transition a byte, without a
way back. In each state exactly one token can have ended, as each prefix is accepted in one way; from the last one the
tokens are read off backwards. The table is emptied when it holds `limit` states.
Decoding emits the labels (bytes) of the arcs.

Null text is encoded as empty (no ids); a null id is passed on; each row of repeated ids gives its own
row; an empty table gives no rows; columns besides the two named are not looked at. Texts are encoded
whole, in time linear in their length: a transition is one look in the table, and one that must be made first takes
time in proportion to the longest label.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, field_type, kept, two_columns
from .pretokens import Vocabulary, split, vocabulary_path


class Automaton:
    """Compiled from the merges, one gadget after the other."""

    START = -1

    def __init__(self, vocabulary: Vocabulary, limit: int = 1 << 17):
        merges, label = vocabulary.merges, vocabulary.label
        self.left, self.right = [0] * 256 + [u for u, _ in merges], [0] * 256 + [v for _, v in merges]
        self.fired: dict[int, int] = {}  # merges whose gadget had an arc to take away, and their ranks
        opens = [True] * 256 + [False] * len(merges)
        for rank, (u, v) in enumerate(merges):
            if label[256 + rank] and opens[u] and opens[v] and self.arc(u, v, rank):
                opens[256 + rank] = True
                self.fired[u << 32 | v] = rank
        self.child: dict[int, int] = {}  # node << 8 | byte -> node; node 0 is the root
        self.token, inner = [self.START], [False]  # what ends at a node, and whether the node goes on
        for t in range(len(label)):
            if opens[t] and label[t]:
                node = 0
                for byte in label[t]:
                    inner[node] = True
                    at = node << 8 | byte
                    if at not in self.child:
                        self.child[at] = len(self.token)
                        self.token.append(self.START)
                        inner.append(False)
                    node = self.child[at]
                self.token[node] = t
        self.first = {label[t]: t for t in range(len(label)) if opens[t] and label[t]}  # arcs of the first state
        self.inner, self.size, self.limit = inner, [len(x) for x in label], limit
        self.emptied()

    def arc(self, p: int, t: int, gadgets: int = 1 << 60) -> bool:
        """Whether the state p has an arc t after so many gadgets. The later of the two tokens got its arcs from its own
        gadget: p = uv those of v as it was before, t = uv where u had them just after."""
        while True:
            if self.fired.get(p << 32 | t, gadgets) < gadgets:
                return False
            if p < 256 and t < 256:
                return True
            if p == t:
                gadgets, p, t = p - 256, self.right[p], self.left[t]
            elif p > t:
                gadgets, p = p - 256, self.right[p]
            else:
                gadgets, t = t - 255, self.left[t]

    def emptied(self) -> None:
        begin = struct.pack("<ii", self.START, 0)
        self.states, self.ended, self.number, self.step = [begin], [self.START], {begin: 0}, {}

    def moved(self, state: int, byte: int) -> int:
        """The state that a byte leads to, which the table doesn't hold yet; its last pair is (the token that ends here, root)."""
        was, pairs, ended = self.states[state], [], None
        flat = struct.unpack(f"<{len(was) // 4}i", was)
        child, token, inner = self.child, self.token, self.inner
        for p, node in zip(flat[::2], flat[1::2]):
            to = child.get(node << 8 | byte)
            if to is not None:
                if ended is None and (t := token[to]) >= 0 and (p < 0 or self.arc(p, t)):
                    ended = t
                if inner[to]:
                    pairs += (p, to)
        packed = struct.pack(f"<{len(pairs) + 2}i", *pairs, ended, 0)
        at = self.number.get(packed)
        if at is None:
            if len(self.states) >= self.limit:
                self.emptied()
                state = None
            at = self.number[packed] = len(self.states)
            self.states.append(packed)
            self.ended.append(ended)
        if state is not None:
            self.step[state << 8 | byte] = at
        return at

    def tokens(self, piece: bytes) -> list[int]:
        """The only accepted way to read the piece: an arc of the first state, if it has one for all of it."""
        whole = self.first.get(piece)
        if whole is not None:
            return [whole]
        state, ends, step, ended = 0, [], self.step, self.ended
        for byte in piece:
            to = step.get(state << 8 | byte)
            if to is None:
                to = self.moved(state, byte)
                step, ended = self.step, self.ended
            state = to
            ends.append(ended[state])
        read, at = [], len(piece)
        while at:
            read.append(ends[at - 1])
            at -= self.size[read[-1]]
        return read[::-1]


class Codec(dict):
    """pre-token -> ids as little-endian 32-bit integers; short ones are remembered, up to `limit` and those of them
    that were asked for again as many before."""

    def __init__(self, path: str, limit: int = 1 << 17):
        self.vocabulary = v = Vocabulary(path)
        self.automaton = Automaton(v)
        self.limit, self.before = limit, {}
        self.label = {i: x for i, x in zip(v.id_of, v.label) if x} | {i: s.encode("utf-8") for s, i in v.added.items()}

    def __missing__(self, piece: str) -> bytes:
        packed = self.before.get(piece)
        if packed is None:
            ids = self.vocabulary.id_of
            read = self.automaton.tokens(piece.encode("utf-8"))
            packed = struct.pack(f"<{len(read)}I", *[ids[t] for t in read])
        if len(piece) <= 48:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, four bytes each."""
        out = []
        for part, added in self.vocabulary.pieces(text):
            out.append(added.to_bytes(4, "little") if added is not None else b"".join(map(self.__getitem__, split(part))))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    return kept(("bpe_codec", path), lambda: Codec(path))


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ids, an array of integers."""
    path, named = vocabulary or vocabulary_path("byte_bpe_50k.json"), two_columns(docs, id_col, text_col)

    def encoded(many: list[str]) -> dict:
        import pyarrow as pa

        code = codec(path)
        return {"ids": pa.array([np.frombuffer(code.encode(t), "<u4").astype(np.int32) for t in many], pa.list_(pa.int32()))}

    return named.mapInArrow(by_batch(encoded), f"id {field_type(named, 'id')}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id and the text its ids stand for (null: empty)."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    named = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").cast("array<int>").alias("text"))

    def decoded(many: list) -> dict:
        import pyarrow as pa

        code = codec(path)
        return {"text": pa.array([code.decode(np.asarray(x or [], "<u4").tobytes()) for x in many], pa.string())}

    return named.mapInArrow(by_batch(decoded), f"id {field_type(named, 'id')}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (of the ids, little-endian, 32 bits each) and
    decoded_sha256 (of the text decoded from those ids), without carrying ids and texts between stages."""
    path, named = vocabulary or vocabulary_path("byte_bpe_50k.json"), two_columns(docs, id_col, text_col)

    def digested(many: list[str]) -> dict:
        import pyarrow as pa

        code, n, of_ids, of_text = codec(path), [], [], []
        for t in many:
            packed = code.encode(t)
            n.append(len(packed) // 4)
            of_ids.append(hashlib.sha256(packed).hexdigest())
            of_text.append(hashlib.sha256(code.decode(packed).encode("utf-8")).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": of_ids, "decoded_sha256": of_text}

    out = named.mapInArrow(by_batch(digested), f"id {field_type(named, 'id')}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
