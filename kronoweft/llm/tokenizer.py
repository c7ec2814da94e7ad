"""Encoding of texts with a public byte-pair tokenizer, by an automaton over its tokens.

The rank file is compiled once, at the driver. Every token starts as a state of the free automaton over bytes; the
merges are then taken in rank order and each adds its gadget: the merged token becomes a state, and from now on
its left part may not be followed by its right part wherever both are still whole at that rank. A token's outer
parts and the ranks at which they vanish are its left and right edge; an arc u -> v is open iff no merge joins a
part of u's right edge with a part of v's left edge while both exist. That is the automaton of all correct
tokenizations: a byte string has exactly one path through it, and so has each of its prefixes. Encoding a
pre-split word walks the byte strings of tokens from each position already reached, takes open arcs from the
transition table (filled as arcs are first used), and emits the arc labels of the one path; decoding emits the
bytes of the labels.

Defined cases: NULL and empty texts have no ids (an empty list); strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronoweft.llm.text import spread

#: Fixed value: how the rank files' vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 30


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    return str(Path(folder) / name)


class MergeAutomaton:
    """Tokens, merges and the transition table. Plain containers, so that it can be broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pattern = pattern
        self.ids: dict[bytes, int] = {}
        self.labels = dict(zip(ranks.values(), ranks.keys()))
        top = max(ranks.values(), default=-1) + 1
        self.left = array("i", [-1]) * top
        self.right = array("i", [-1]) * top
        self.merge: dict[int, int] = {}
        self.prefixes: set[bytes] = set()
        for label, i in sorted(ranks.items(), key=lambda x: x[1]):
            self._gadget(label, i)
        self.arcs: dict[int, bool] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str = PATTERN) -> MergeAutomaton:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}, pattern)

    def _gadget(self, label: bytes, i: int) -> None:
        """Add the state of one token. A longer token is the merge of the two labels its path has so far."""
        if len(label) > 1:
            path = self._path(label, {}, NEVER)
            if path is None or len(path) != 2:
                return  # no merge yields it: the token is never emitted
            self.left[i], self.right[i] = path
            self.merge[path[0] << 20 | path[1]] = i
        self.ids[label] = i
        self.prefixes.update(label[:n] for n in range(1, len(label) + 1))

    def open_arc(self, u: int, v: int) -> bool:
        """Whether v may follow u: no merge joins an outer part of u with one of v while both are whole.

        Of equal ranks the left pair is merged first, hence < on the one side and <= on the other.
        """
        a, a_ends = u, NEVER
        while a >= 0:
            b, b_ends = v, NEVER
            while b >= 0:
                r = self.merge.get(a << 20 | b)
                if r is not None and r < a_ends and r <= b_ends:
                    return False
                b, b_ends = self.left[b], b
            a, a_ends = self.right[a], a
        return True

    def _path(self, word: bytes, arcs: dict[int, bool], _limit: int = NEVER) -> list[int] | None:
        """Labels of the one path that spells word."""
        n, ids, prefixes = len(word), self.ids, self.prefixes
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            u = last[i]
            if i and u < 0:
                continue
            for j in range(i + 1, n + 1):
                piece = word[i:j]
                if piece not in prefixes:
                    break
                v = ids.get(piece)
                if v is None or last[j] >= 0:
                    continue
                if i:
                    arc = u << 20 | v
                    ok = arcs.get(arc)
                    if ok is None:
                        ok = arcs[arc] = self.open_arc(u, v)
                    if not ok:
                        continue
                last[j], back[j] = v, i
        if n and last[n] < 0:
            return None
        out, j = [], n
        while j:
            out.append(last[j])
            j = back[j]
        return out[::-1]

    def encoder(self, cache: int = 1 << 17):
        """A function from text to ids, with a bounded memory of words."""
        split = regex.compile(self.pattern).findall
        arcs, ids, path = self.arcs, self.ids, self._path

        @lru_cache(maxsize=cache)
        def word(w: str) -> tuple[int, ...]:
            b = w.encode("utf-8", "surrogatepass")
            i = ids.get(b)
            if i is not None:
                return (i,)
            if len(arcs) > 4_000_000:
                arcs.clear()
            return tuple(path(b, arcs))

        def encode(text: str | None) -> list[int]:
            out: list[int] = []
            if text:
                for w in split(text):
                    out.extend(word(w))
            return out

        return encode

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 (of ids cut within a character) come out as U+FFFD."""
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


def encode_column(docs: DataFrame, automaton: MergeAutomaton, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encoder()
        for b in batches:
            flat, offsets = array("i"), [0]
            for t in b.column(1).to_pylist():
                flat.extend(encode(t))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    rows = spread(docs.select(key, F.col(text).cast("string").alias(text)), key)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_column(encoded: DataFrame, automaton: MergeAutomaton, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text of every row; NULL and empty ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
