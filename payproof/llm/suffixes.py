"""Suffix-array dedup of bytes: bucket-pointer refinement.

Suffixes are sorted no further than `length` bytes: what counts is which of them share their first 400 bytes. A suffix's
bucket after q bytes is named by those bytes; the bucket after 2q bytes is refined from two bucket pointers, the one at
the suffix and the one at the suffix q bytes later, and these names serve the next refinement (50, 100, 200, then 400 bytes).
A name is a hash of the two pointers it is made of, 128 bits in the last step, so a task can follow pointers within
its text alone, and only the sizes of buckets need the other documents.

Sorting every suffix would move many times the input. Of the 201 buckets after 200 bytes that a 400-byte string passes
through, the one with the lowest name is its pivot; equal strings have equal pivots. About one suffix in a hundred is a
pivot. First all pivots are put into their buckets after 200 bytes; those alone in theirs are done, as are their strings.
The strings with one pivot follow each other; as one stretch they are refined at once by the pointers all along it. Only
where stretches with one pivot differ are they opened, first into blocks of 16 strings, and blocks that agree in what
their strings share but not in the whole into single strings; each time a text of every kind is enough.

Buckets are counted by map-side combined aggregates and joined back by plain joins. Each text sends a bucket once with its
count, so a run of one repeated line is a few rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payproof.llm.arrow import lists, small, texts
from payproof.llm.hashing import BASES, BLOCK, BYTE, U, Runs, lowest_in_window, mix, signed
from payproof.llm.steps import Steps
from payproof.llm.substrings import _listed, _ranges

LENGTH = 400         # bytes of a repeated string
HALVINGS = 3         # the initial buckets take length / 2**HALVINGS bytes
BLOCKS = 25          # a block is this part of `length` strings
PIECE = 1 << 18      # bytes of short texts sorted at once: a byte takes some two hundred in names and places
SLICE = 2 << 20      # bytes of text a task takes at once


def _refined(name: np.ndarray, later: np.ndarray) -> np.ndarray:
    return mix(name * U(0xC2B2AE3D27D4EB4F) + later * U(0x165667B19E3779F9) + U(1))


class Buckets:
    """Bucket pointers of all suffixes of a piece of bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.length, self.names, self.tokens = length, {}, BYTE[data]
        q = max(1, length >> HALVINGS)
        self.names[q] = Runs(self.tokens).grams(q)
        while q * 2 <= length // 2:
            self._double(q)
            q *= 2
        self.half = q

    def _double(self, q: int) -> None:
        name = self.names[q]
        self.names[2 * q] = _refined(name[:-q], name[q:]) if len(name) > q else name[:0]

    def stretch(self, s: np.ndarray, e: np.ndarray, seed: int) -> np.ndarray:
        """The bucket of bytes s to e: pointers every `half` bytes from s and the last that ends at e, in turn."""
        name, at = self.names[self.half], s.copy()
        out = mix(name[s] + BASE[seed])
        while len(at):
            more = at + self.half < e
            if not more.any():
                break
            at = np.where(more, np.minimum(at + self.half, e - self.half), at)
            out = np.where(more, _refined(out ^ BASE[seed], name[at]), out)
        return mix(out + (e - s).astype(U))


    def core(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return self.stretch(s, e, 0) ^ U(1)


BASE = [U(b) for b in BASES]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of at least `length` bytes, several together or blocks of one: (bytes, texts, place of the piece in them, starts, ends)."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > BLOCK:
            for b in range(0, len(t) - length + 1, BLOCK - length + 1):
                part = np.frombuffer(t, np.uint8, min(BLOCK, len(t) - b), b)
                yield part, np.array([i]), np.array([b]), np.array([0]), np.array([len(part)])
            continue
        if group and size + len(t) > PIECE:
            yield _packed(texts, group)
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        yield _packed(texts, group)


def _packed(texts: list[bytes], group: list[int]):
    ends = np.cumsum([len(texts[i]) for i in group])
    starts = np.concatenate([[0], ends[:-1]])
    return np.frombuffer(b"".join([texts[i] for i in group]), np.uint8), np.array(group), -starts, starts, ends


def _stretches(batch: list[bytes], length: int) -> Iterator[tuple]:
    """(buckets, text of each stretch, shift to places in the text, first string, last string, place of the pivot) by piece."""
    for data, owner, shift, _, ends in _pieces(batch, length):
        b = Buckets(data, length)
        name = b.names[b.half]
        low = lowest_in_window(name, length - b.half + 1)
        if not len(low):
            continue
        part = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))[:len(low)]
        ok = np.arange(len(low)) + length <= ends[part]
        new = ok.copy()
        new[1:] &= (low[1:] != low[:-1]) | ~ok[:-1] | (part[1:] != part[:-1])
        stop = ok.copy()
        stop[:-1] &= new[1:] | ~ok[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(stop)
        yield b, owner[part[first]], shift[part[first]], first, last, low[first]


def _units(level: int, pivot: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """What a stretch opens into: blocks of strings that begin in one BLOCKS-th of the way to the pivot, or single strings.
    Gives the stretch of each unit, its pivot, first and last string, and the run of bytes that all strings of the block share
    whatever part of it the stretch holds: its core. Units of two texts with a string in common have a core in common."""
    step = 1 if level == 2 else max(1, length // BLOCKS)
    lo, hi = (pivot - last) // step, (pivot - first) // step
    of = np.repeat(np.arange(len(lo)), hi - lo + 1)
    block = _ranges(lo, hi)
    far, near = pivot[of] - block * step - step + 1, pivot[of] - block * step
    return of, pivot[of], np.maximum(first[of], far), np.minimum(last[of], near), near, far + length


def _opened(b: Buckets, owner, shift, first, last, pivot, length: int, listed: list[np.ndarray], below) -> tuple[np.ndarray, ...]:
    """The units that listed stretches, and then listed blocks, open into."""
    for level in range(1, below + 1):
        wanted = np.flatnonzero(_listed(signed(b.stretch(first, last + length, 0)), owner, listed))
        of, pivot, first, last, near, far = _units(level, pivot[wanted], first[wanted], last[wanted], length)
        owner, shift = owner[wanted][of], shift[wanted][of]
    return owner, shift, first, last, pivot, near, far


def _counted(*keys: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of parallel columns and how often each occurs."""
    if not len(keys[0]):
        return [*keys, np.zeros(0, np.int64)]
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    new = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
    return [*[k[new] for k in keys], np.diff(np.concatenate([new, [len(order)]]))]


def _emit(level: int | None, length: int):
    """Rows of one text's pivots (level None), stretches (0), opened blocks (1) or opened strings (2): the bucket of the core,
    the bucket of the whole in 128 bits, the text's rid, and how often the text has it."""
    names = ["core", "n"] if level is None else ["core", "s1", "s2", "rid", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, most=SLICE):
            rid = batch.column("rid").to_numpy(zero_copy_only=False) if level is not None else None
            opened = lists(batch, "opened") if level else None
            for b, owner, shift, first, last, pivot in _stretches(texts(batch), length):
                core = b.names[b.half][pivot]
                if level:
                    owner, shift, first, last, pivot, near, far = _opened(b, owner, shift, first, last, pivot, length, opened, level)
                    core = b.core(near, far)
                cols = [signed(core)]
                if level is not None:
                    cols += [signed(b.stretch(first, last + length, k)) for k in (0, 1)] + [owner]
                cols = _counted(*cols)
                if level is not None:
                    cols[3] = rid[cols[3]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)
    return run, ", ".join(f"{n} long" for n in names)


def _spans(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(hits):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _cut(length: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, most=SLICE):
            repeated, opened = (lists(batch, c) for c in ("repeated", "opened"))
            own_texts = texts(batch)
            hits: list[list[tuple[int, int]]] = [[] for _ in own_texts]
            some = np.array([i for i in range(len(own_texts)) if len(repeated[i])], np.int64)
            for b, owner, shift, first, last, pivot in _stretches([own_texts[i] for i in some], length):
                unit = some[owner], shift, first, last, pivot
                for level in (0, 1, 2):
                    o, h, s, e, *_ = _opened(b, *unit, length, opened, level) if level else unit
                    gone = _listed(signed(b.stretch(s, e + length, 0)), o, repeated)
                    for i, x, y in zip(o[gone].tolist(), (s + h)[gone].tolist(), (e + h)[gone].tolist(), strict=True):
                        hits[i].append((x, y + length))
            spans = [[(s, e) for s, e in _spans(h) if e - s >= LENGTH or len(t[s:e].split()) >= words] for t, h in zip(own_texts, hits, strict=True)]
            kept = []
            for t, ss in zip(own_texts, spans, strict=True):
                ends = [0, *[e for _, e in ss]]
                kept.append(b"".join(t[a:s] for a, s in zip(ends, [*[s for s, _ in ss], len(t)], strict=True)) if ss else t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([len(t) for t in own_texts], pa.int64()), pa.array([sum(e - s for s, e in ss) for ss in spans], pa.int64()),
                 pa.array([[{"start": s, "end": e} for s, e in ss] for ss in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())], names=["row", "n_bytes", "n_removed", "spans", "kept_bytes", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Without the bytes of strings of `length` bytes that start anywhere else too, in this or another text: one row per row of
    docs (doc_id, text) with n_bytes, n_removed, spans (maximal removed runs, start and end in bytes), kept_bytes and kept_text (these
    bytes without the rest of characters that a removal cut).

    Strings are judged on the texts as given; all places of a repeated string go. A null text is an empty one.
    Null and repeated doc_ids are fine: every row's text counts. An empty table gives an empty result; other columns are
    ignored."""
    return _removed(docs.select(F.struct("doc_id").alias("row"), "doc_id", F.col("text").cast("string").alias("text")), length).select("row.*", "n_bytes", "n_removed", "spans", "kept_bytes", "kept_text")


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """docs with what `remove_repeats` leaves of their texts, all columns kept. Runs of fewer than `words` words stay, if they have less
    than LENGTH bytes; a repeated passage lies in one run, so none of `words` words and `length` bytes is lost. Of a character that a removal cut the rest goes too;
    n_chars, if there is such a column, counts what is left where something went. Texts of which only white space is left go, unless
    they were so before."""
    left = _removed(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), length, words)
    shorter = F.col("n_removed") > 0
    out = left.where(~shorter | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    fresh = {"text": F.when(shorter, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(shorter, F.char_length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[(fresh[c] if c in fresh else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _removed(docs: DataFrame, length: int, words: int = 0) -> DataFrame:
    """From (row, doc_id, text): row, n_bytes, n_removed, spans, kept_bytes, kept_text."""
    steps = Steps(docs.sparkSession)
    # equal rows share a rid; all that is joined on it below is true of a string wherever it stands
    docs = docs.select("row", F.xxhash64("doc_id", "text").alias("rid"), "text")
    full = docs.where(F.octet_length("text") >= length).select("rid", "text")
    key = ["core", "s1", "s2"]
    repeated, opened = [], []
    for level in (0, 1, 2):
        if level:
            listed = opened[0] if level == 1 else opened[0].union(opened[1])
            rows = full.join(listed.groupBy("rid").agg(F.collect_set("s1").alias("opened")), "rid").mapInArrow(*_emit(level, length))
        else:
            shared = full.mapInArrow(*_emit(None, length)).groupBy("core").agg(F.sum("n").alias("n")).where("n > 1").select("core")
            rows = full.mapInArrow(*_emit(0, length)).join(shared, "core")
        rows = steps.write(rows)
        sizes = steps.write(rows.groupBy(*key).agg(F.sum("n").alias("n"), F.min("rid").alias("first")))
        repeated.append(steps.write(rows.join(sizes.where("n > 1").select(*key), key).select("rid", "s1")))
        # wholes that share a core and differ, one of them alone: one text of each opens it
        mixed = sizes.groupBy("core").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("core")
        opened.append(steps.write(sizes.join(mixed, "core").select(F.col("first").alias("rid"), "s1")))
        steps.drop(rows, sizes)
    gather = lambda tables, name: reduce(DataFrame.union, tables).groupBy("rid").agg(F.collect_set("s1").alias(name))
    lists = steps.write(gather(repeated, "repeated").join(gather(opened[:2], "opened"), "rid", "left"))
    steps.drop(*repeated, *opened)
    out = f"row {dict(docs.dtypes)['row']}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_bytes binary, kept_text string"
    return docs.join(lists, "rid", "left").select("row", "text", "repeated", "opened").mapInArrow(_cut(length, words), out)
