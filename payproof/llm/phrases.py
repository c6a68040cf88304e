"""Phrase collocation mining by partitioning (SON).

Documents are dealt to SHARDS shards. A phrase with SUPPORT occurrences has SUPPORT / SHARDS of them, rounded up, in some
shard, so each shard is mined completely at that lower support: words first, then pairs of frequent words, then triples of
which both pairs are frequent in the shard. The union of what is frequent in a shard holds every phrase looked for, and
a last pass over the texts counts all of these exactly, by the phrase itself.

Sets of frequent phrases go to the tasks as bit tables of fixed size (2**BITS bits, whatever the corpus). Two phrases on one
bit only let one more be counted: the supports and the exact counts decide. Tasks count a slice of text before they move anything, so a phrase
that every document has is one row per slice.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payproof.llm.arrow import small, texts
from payproof.llm.hashing import BASES, BYTE, Runs, U, mix, signed, word_spans
from payproof.llm.steps import Steps

SUPPORT = 10
SHARDS = 2                   # a power of two: a shard's number takes the place of a phrase hash's last bits
LONGEST = 3                  # words of a phrase
BEST = 2000
INSIDE = 50                  # percent of a phrase's occurrences inside a longer phrase at which it goes
BITS = 27                    # a bit table has 16 MB
BLOCK = 1 << 18              # bytes of text handled at once
ROOM = 1 << 20               # phrases that a task counts before it passes them on
#: A-Z to lower case, every byte that ends a piece to a line end, a tab to a space
FOLD = bytes(0x0A if b in b".,;:!?\x0A\x0B\x0C\x0D" else 0x20 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
GAP = re.compile(rb"[ \n]")
SPACES = re.compile(rb" {2,}")
AHEAD = re.compile(rb"(?:[ \n]*[^ \n]+){0,%d}" % (LONGEST - 1))


class Slice:
    """The words of some texts, hashed, with the piece and the language that each is in."""

    def __init__(self, raw: bytes, first: np.ndarray, owner: np.ndarray, tags: np.ndarray, shards: np.ndarray, limit: int):
        """Text owner[i] begins at first[i] in raw; words from `limit` on only continue phrases, they begin none."""
        data = np.frombuffer(raw, np.uint8)
        self.raw, (self.start, self.end) = raw, word_spans(data)
        self.begins = int(np.searchsorted(self.start, limit))
        self.piece = np.cumsum(data == 10, dtype=np.int32)[self.start]
        self.text = owner[np.searchsorted(first, self.start, side="right") - 1]
        self.shard, self.tag, self.runs, self.words = shards[self.text], tags[self.text], Runs(BYTE[data]), {}

    def at(self, k: int) -> np.ndarray:
        """The places where a phrase of k words begins."""
        n = max(0, min(self.begins, len(self.start) - k + 1))
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1:n + k - 1])

    def hashes(self, at: np.ndarray, k: int, base: int = 0) -> np.ndarray:
        """Hashes of the phrases of k words at these places, their last bits left to the shard."""
        if base not in self.words:
            self.words[base] = self.runs.name(self.start, self.end, BASES[base]) ^ self.tag
        h = np.full(len(at), U(k))
        for i in range(k):
            h = mix(h * U(BASES[0]) + self.words[base][at + i])
        return h & ~U(SHARDS - 1)

    def spans(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the phrases of k words at these places stand in raw, and their length: words are one space apart."""
        return self.start[at], self.end[at + k - 1] - self.start[at]


def slices(batch: pa.RecordBatch) -> Iterator[Slice]:
    """The texts of a batch together up to BLOCK bytes; a longer text in blocks, with the words that a block's last phrases go on with."""
    tags = batch.column("tag").to_numpy().view(U)
    shards = batch.column("shard").to_numpy().astype(U)
    group: list[int] = []
    own: list[bytes] = []
    size = 0

    def together() -> Slice:
        lengths = np.array([len(t) + 1 for t in own])
        raw = b"\n".join(own) + b"\n"
        return Slice(raw, np.cumsum(lengths) - lengths, np.array(group), tags, shards, len(raw))
    folded = (SPACES.sub(b" ", t) if b"  " in t else t for part in small(iter([batch])) for t in (x.translate(FOLD) for x in texts(part)))
    for i, t in enumerate(folded):
        if len(t) > BLOCK:
            at = 0
            while at < len(t):
                cut = GAP.search(t, at + BLOCK)
                stop = cut.start() if cut else len(t)
                yield Slice(t[at:AHEAD.match(t, stop).end()], np.zeros(1, np.int64), np.array([i]), tags, shards, stop - at)
                at = stop
            continue
        group.append(i)
        own.append(t)
        size += len(t)
        if size > BLOCK:
            yield together()
            group, own, size = [], [], 0
    if group:
        yield together()


def _bit(h: np.ndarray) -> np.ndarray:
    return mix(h + U(1)) >> U(64 - BITS)


def _has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = _bit(h)
    return (table[bit >> U(6)] >> (bit & U(63))) & U(1) == 1


def _bit_table(hashes: DataFrame, column: str) -> np.ndarray:
    """The bits of all hashes, combined by Spark: the driver gets 2**BITS bits at most."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _bit(batch.column(0).to_numpy().view(U))
            yield pa.RecordBatch.from_arrays([pa.array((bit >> U(6)).astype(np.int64)), pa.array(signed(U(1) << (bit & U(63))))], names=["slot", "bits"])
    found = hashes.select(column).mapInArrow(bits, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), U)
    table[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(U)
    return table


def _counted(h: np.ndarray) -> pa.RecordBatch:
    h, n = np.unique(h, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n.astype(np.int32))], names=["h", "n"])


def _level(k: int, shorter):
    """Phrases of k words in each shard, of which both parts of one word less are frequent there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for s in slices(batch):
                at = s.at(k)
                for part in range(2) if k > 1 else ():
                    at = at[_has(shorter.value, s.hashes(at + part, k - 1) | s.shard[at])]
                found.append(s.hashes(at, k) | s.shard[at])
                size += len(at)
                if size > ROOM:
                    yield _counted(np.concatenate(found))
                    found, size = [], 0
        if found:
            yield _counted(np.concatenate(found))
    return run


def _gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes raw[start:start + size] of each."""
    ends = np.concatenate([[0], np.cumsum(size)])
    data = raw[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    return pa.BinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _exact(candidates):
    """Counts of candidates in a slice, by language and phrase; words of each text as a phrase of no words."""
    def counted(s: Slice, table: np.ndarray, base: int) -> Iterator[tuple]:
        for k in range(1, LONGEST + 1):
            at = s.at(k)
            h = s.hashes(at, k)
            some = _has(table, h)
            at, h = at[some], h[some]
            start, size = s.spans(at, k)
            yield h, s.hashes(at, k, 1), s.text[at], start + base, size
        s.runs = None

    def batch_of(found: list, raw: list[bytes], words: np.ndarray, lang: pa.Array) -> pa.RecordBatch:
        h, second, text, start, size = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((second, h))
        h, second = h[order], second[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (second[1:] != second[:-1])])[:len(h)])
        first, own = order[new], np.flatnonzero(words)
        phrase = _gathered(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([start[first], np.zeros(len(own), np.int64)]), np.concatenate([size[first], np.zeros(len(own), np.int64)]))
        n = np.concatenate([np.diff(np.append(new, len(h))), words[own]])
        return pa.RecordBatch.from_arrays([lang.take(pa.array(np.concatenate([text[first], own]))), phrase, pa.array(n)], names=["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, raw, at, size, words = [], [], 0, 0, np.zeros(batch.num_rows, np.int64)
            for s in slices(batch):
                words += np.bincount(s.text[:s.begins], minlength=len(words))
                found += counted(s, candidates.value, at)
                raw.append(s.raw)
                at, size = at + len(s.raw), size + sum(len(f[0]) for f in found[-LONGEST:])
                if size > ROOM:
                    yield batch_of(found, raw, np.zeros(0, np.int64), batch.column("lang"))
                    found, raw, at, size = [], [], 0, 0
            none = (np.zeros(0, U),) * 2 + (np.zeros(0, np.int64),) * 3
            yield batch_of([none, *found], raw, words, batch.column("lang"))
    return run


def _ranked(counts: DataFrame, best: int, inside: int) -> DataFrame:
    counts = counts.withColumn("phrase", F.col("phrase").cast("string"))
    counts = counts.withColumn("k", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))))
    parts, found = counts.where("k > 0").select("lang", "phrase", "a"), counts.where("k > 1")
    word = F.split("phrase", " ")
    some = lambda i, j: F.array_join(F.slice(word, i + 1, j - i), " ")
    # phrases inside a longer one
    longer = (found.where(F.col("k") == LONGEST).select("lang", F.explode(F.array(some(0, 2), some(1, 3))).alias("phrase"), F.col("a").alias("b"))
              .groupBy("lang", "phrase").agg(F.max("b").alias("longer")))
    found = found.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    cut = lambda i, k: F.struct(F.lit(i).alias("cut"), some(0, i).alias("left"), some(i, k).alias("right"))
    cuts = found.select("lang", "phrase", "a", F.explode(F.when(F.col("k") == 2, F.array(cut(1, 2))).otherwise(F.array(cut(1, 3), cut(2, 3)))).alias("c")).select("lang", "phrase", "a", "c.*")
    cuts = (cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
            .join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"]))
    # whole numbers of up to 38 digits
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(13,0)) * cast(a as decimal(13,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # first within slices of a language, then among the slices' best
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    sliced = lowest.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= best)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return (first.join(counts.where("k = 0").select("lang", F.col("a").alias("n")), "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def phrases(docs: DataFrame, support: int = SUPPORT, best: int = BEST, inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `best` phrases of 2 to 3 words with `support` occurrences or more.

    A-Z are taken in lower case, pieces end at .,;:!? and line ends, words are runs of anything but spaces and tabs, and a phrase
    lies within a piece. n counts the words of the language, a the phrase's occurrences, overlaps included. Cut after its k-th word a phrase scores
    floor(1000000*a*a/(l*r)), l and r being the occurrences of its parts; its lowest cut counts, the first of equals. A phrase
    whose words lie inside a longer one with at least `inside` percent of its occurrences goes, whatever becomes of the longer one. Ranked by
    score, then a, both falling, then by phrase. A null text is empty, a null lang is `und`; repeated rows count each. An empty table gives
    an empty result; other columns are ignored. Long texts are read in blocks."""
    spark, steps = docs.sparkSession, Steps(docs.sparkSession)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(lang, F.lit("lang")).alias("tag"),
                       F.pmod(F.xxhash64("text", *[c for c in ("doc_id",) if c in docs.columns]), F.lit(SHARDS)).alias("shard"))
    local = -(-support // SHARDS)
    schema = "h long, n int"
    frequent = lambda found: found.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= local).select("h")
    levels, table = [], None
    for k in range(1, LONGEST + 1):
        levels.append(steps.write(frequent(rows.mapInArrow(_level(k, table), schema))))
        if k < LONGEST:
            table = spark.sparkContext.broadcast(_bit_table(levels[-1], "h"))
    union = reduce(DataFrame.union, levels).select(F.col("h").bitwiseAND(F.lit(~(SHARDS - 1))).alias("h")).distinct()
    candidates = spark.sparkContext.broadcast(_bit_table(union, "h"))
    exact = rows.mapInArrow(_exact(candidates), "lang string, phrase binary, n long")
    counts = steps.write(exact.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where((F.col("a") >= support) | (F.length("phrase") == 0)))
    steps.drop(*levels)
    return _ranked(counts, best, inside)
