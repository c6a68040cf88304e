"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece of text there is exactly one token that its encoding can end with: a token that ends there and
may follow the last token of the prefix before it. Two tokens may follow each other if merging their joined bytes gives
just these two. So a table of last tokens, filled from left to right, holds the encoding of every prefix; bytes can
be appended without looking back, and after an edit only the part of the table from the edit on is filled again.

Tasks encode the texts they have read; nothing is shuffled. A worker remembers the encodings of pieces it has met, and
which pairs of tokens may follow each other, both up to a fixed number.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payproof.llm.arrow import small, texts

SIZE = 1 << 17                       # pieces, and pairs, of one generation that a worker remembers
SLICE = 2 << 20                      # bytes of text a task takes at once


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Tokens by rank from lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Remembered:
    """A dictionary of the entries met last: it starts anew at SIZE entries and looks up what it lacks in the one before."""

    def __init__(self, make):
        self.make, self.new, self.old = make, {}, {}

    def find(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self.new) >= SIZE:
            self.old, self.new = self.new, {}
        self.new[key] = found
        return found


class Coder:
    """Encodes pieces by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.tokens = ranks, [b""] * (max(ranks.values()) + 1)
        self.longest = [0] * 256                         # of the tokens that end with a byte
        for t, r in ranks.items():
            self.tokens[r] = t
            self.longest[t[-1]] = max(self.longest[t[-1]], len(t))
        self.split = regex.compile(pattern)
        self.pairs, self.pieces = Remembered(self._may_follow), Remembered(self._piece)

    def merged(self, data: bytes) -> list[bytes]:
        """The merges one after the other, lowest rank first; for the few bytes of one or two tokens."""
        get, never = self.ranks.get, 1 << 40
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = [get(data[i:i + 2], never) for i in range(len(data) - 1)]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], never)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], never)
        return parts

    def _may_follow(self, key: int) -> bool:
        last, token = (key >> 32) - 1, key & 0xFFFFFFFF
        want = [self.tokens[token]] if last < 0 else [self.tokens[last], self.tokens[token]]
        return self.merged(b"".join(want)) == want

    def extend(self, data: bytes, table: list[int]) -> list[int]:
        """table[i] is the last token of the encoding of the first i bytes (table[0] is -1). Fills it up to all of data; what it holds stays."""
        get, longest, find = self.ranks.get, self.longest, self.pairs.find
        for end in range(len(table), len(data) + 1):
            known = self.pairs.new
            for start in range(max(0, end - longest[data[end - 1]]), end):
                token = get(data[start:end])
                if token is not None:
                    key = (table[start] + 1) << 32 | token
                    ok = known.get(key)
                    if find(key) if ok is None else ok:
                        table.append(token)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return table

    def along(self, table: list[int]) -> list[int]:
        """The tokens of the whole table, followed back from its end."""
        out, end = [], len(table) - 1
        while end:
            out.append(table[end])
            end -= len(self.tokens[table[end]])
        return out[::-1]

    def _piece(self, text: str) -> bytes:
        data = text.encode()
        whole = self.ranks.get(data)                     # a piece that is a token is that token, whatever its merges would give
        return np.array([whole] if whole is not None else self.along(self.extend(data, [-1])), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, find = [], self.pieces.find
        for piece in self.split.findall(text):
            known = self.pieces.new.get(piece)
            out.append((find(piece) if len(piece) <= 64 else self._piece(piece)) if known is None else known)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Edited:
    """A text with its pieces' tables, for appends and edits that encode again no more than they must."""

    def __init__(self, coder: Coder, text: str = ""):
        self.coder, self.text, self.tables = coder, "", []
        self.replace(0, 0, text)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put `new` in place of the characters from start to end. Pieces that end two pieces before the edit stay as they
        are (a piece can depend on the character after it); of later ones a piece that stood before is taken over, and a
        piece that begins like the one that stood at its place keeps that part of its table."""
        self.text = self.text[:start] + new + self.text[end:]
        stay, at = 0, 0
        while stay < len(self.tables) and at + sum(len(p) for p, _ in self.tables[stay:stay + 3]) <= start and stay + 3 <= len(self.tables):
            at += len(self.tables[stay][0])
            stay += 1
        old, kept = self.tables[stay:], self.tables[:stay]
        ready = dict(old)
        for i, m in enumerate(self.coder.split.finditer(self.text, at)):
            piece = m.group()
            table = ready.get(piece)
            if table is None:
                data = piece.encode()
                before, had = (old[i][0].encode(), old[i][1]) if i < len(old) else (b"", [-1])
                same = next((k for k, (x, y) in enumerate(zip(data, before, strict=False)) if x != y), min(len(data), len(before)))
                table = self.coder.extend(data, had[:same + 1])
            kept.append((piece, table))
        self.tables = kept

    def append(self, new: str) -> None:
        self.replace(len(self.text), len(self.text), new)

    def ids(self) -> list[int]:
        return [t for p, table in self.tables for t in ([self.coder.ranks[p.encode()]] if p.encode() in self.coder.ranks else self.coder.along(table))]


_coders: dict[str, Coder] = {}


def coder(content: bytes, pattern: str) -> Coder:
    """One for each vocabulary and worker."""
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(read_ranks(content), pattern)
    return _coders[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, check: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Every text of docs (doc_id, text) as token ids: doc_id (or the columns `keep`), n_tokens, ids (little-endian unsigned 32-bit integers). With
    `check`, also decoded: the bytes that the ids give.

    A null text is an empty one; an empty text has no ids. Strings that look like special tokens are ordinary text. Every row
    gives a row, whatever its doc_id; an empty table gives an empty result; other columns are ignored. `vocabulary` is
    the path of a rank file, read by the driver and sent with the tasks (a fixed size)."""
    content = Path(vocabulary).read_bytes()
    docs = docs.select(F.struct(*keep or ["doc_id"]).alias("row"), F.col("text").cast("string").alias("text"))
    names = ["row", "n_tokens", "ids", *["decoded"] * check]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(content, pattern)
        for batch in small(batches, most=SLICE):
            ids = [c.encode(t.decode()) for t in texts(batch)]
            cols = [batch.column("row"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            if check:
                cols.append(pa.array([c.decode(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return docs.mapInArrow(run, f"row {dict(docs.dtypes)['row']}, n_tokens long, ids binary{', decoded binary' * check}").select("row.*", *names[1:])


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The text bytes of rows (doc_id, ids): doc_id, decoded. Null ids give no bytes."""
    content = Path(vocabulary).read_bytes()
    encoded = encoded.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(content, pattern)
        for batch in small(batches, "ids", SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.decode(i) for i in texts(batch, "ids")], pa.binary())],
                                             names=["doc_id", "decoded"])
    return encoded.mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, decoded binary")
