"""Substring dedup: seed and extend.

Seeds are winnowed anchors: of the 9 five-word grams in a window of 13 words the one with the lowest hash, so that equal
windows have equal seeds. Neighbouring windows with one seed make a stretch: the seed extended both ways up to the next
seeds. Documents meet on seeds, then on whole stretches, and only stretches that no smaller document has are opened into
their windows. What remains on a window that starts in a smaller document is a repeat of at least 13 words, and its
windows together are the maximal repeat.

Every meeting is one map-side combined aggregate (the smallest document of a seed, stretch or window) and a plain join
back, so a passage that a third of the documents share is one row after the combine and a join partition Spark can split.
Each document sends a seed, stretch or window once.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payproof.llm.arrow import lists, small, texts
from payproof.llm.hashing import BASES, pieces, shared_seeds, signed, word_hashes
from payproof.llm.steps import Steps

LENGTH = 13          # words of a window
SEED = 5             # words of an anchor
SLICE = 2 << 20      # bytes of text a task takes at once: a word takes some twenty times its bytes in names and windows


def _unique(*keys: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of parallel columns."""
    if not len(keys[0]):
        return list(keys)
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    return [k[new] for k in keys]


def _stretches(batch: list[bytes], length: int, seed: int) -> Iterator[tuple]:
    """(runs, text of each stretch, place of the piece in it, first window, last window, seed) by piece."""
    words, counts = word_hashes(batch)
    for x, owner, offset, ends in pieces(words, counts, length - 1):
        runs, part, first, last, name = shared_seeds(x, ends, length, seed)
        if len(part):
            yield runs, owner[part], offset[part] - np.concatenate([[0], ends[:-1]])[part], first, last, name


def _emit(kind: str, length: int, seed: int):
    """Rows by document: its seeds, or its stretches with their seeds, or the windows of the stretches listed in `own`."""
    names = {"seeds": ["doc_id", "seed"], "stretches": ["doc_id", "seed", "s1", "s2"], "windows": ["doc_id", "w1", "w2"]}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, most=SLICE):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            own = lists(batch, "own") if kind == "windows" else None
            for runs, owner, _, first, last, name in _stretches(texts(batch), length, seed):
                cols = [owner, signed(name)]
                if kind != "seeds":
                    cols += [signed(runs.name(first, last + length, b)) for b in BASES]
                if kind == "windows":
                    wanted = _listed(cols[2], owner, own)
                    at = _ranges(first[wanted], last[wanted])
                    cols = [np.repeat(owner[wanted], (last - first + 1)[wanted])] + [signed(runs.name(at, at + length, b)) for b in BASES]
                cols = _unique(*cols[::-1])[::-1]
                yield pa.RecordBatch.from_arrays([pa.array(ids[cols[0]], pa.int64()), *map(pa.array, cols[1:])], names=names)
    return run, ", ".join(f"{n} long" for n in names)


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., last[0], first[1], ..."""
    n = last - first + 1
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def _listed(names: np.ndarray, owner: np.ndarray, listed: list[np.ndarray]) -> np.ndarray:
    """Whether each name is in its owner's list. Owners ascend."""
    out = np.zeros(len(names), bool)
    edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(owner) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if len(listed[owner[a]]):
            out[a:b] = np.isin(names[a:b], listed[owner[a]])
    return out


def _cut(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, most=SLICE):
            covered, own, windows = (lists(batch, c) for c in ("covered", "own", "windows"))
            own_texts = texts(batch)
            words = [t.split() for t in own_texts]
            hit = [np.zeros(len(w) + 1, np.int64) for w in words]
            some = np.array([i for i in range(len(words)) if len(covered[i]) or len(windows[i])], np.int64)
            for runs, owner, shift, first, last, _ in _stretches([own_texts[i] for i in some], length, seed):
                owner = some[owner]
                s1 = signed(runs.name(first, last + length))
                whole = _listed(s1, owner, covered)
                opened = np.flatnonzero(_listed(s1, owner, own) & ~whole)
                at = _ranges(first[opened], last[opened])
                at_owner, at_shift = (np.repeat(c[opened], (last - first + 1)[opened]) for c in (owner, shift))
                found = _listed(signed(runs.name(at, at + length)), at_owner, windows)
                for o, a, b in ((owner[whole], (first + shift)[whole], (last + shift)[whole] + length),
                                (at_owner[found], (at + at_shift)[found], (at + at_shift)[found] + length)):
                    for i, s, e in zip(o.tolist(), a.tolist(), b.tolist(), strict=True):
                        hit[i][s] += 1
                        hit[i][e] -= 1
            gone = [np.cumsum(h[:-1]) > 0 for h in hit]
            kept = [b" ".join(w) if not g.any() else b" ".join([x for x, y in zip(w, g.tolist(), strict=True) if not y]) for w, g in zip(words, gone, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([int(g.sum()) for g in gone], pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])
    return run, "doc_id long, n_words long, n_removed long, kept_text string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Without the passages of `length` words or more that a document with a smaller doc_id has too: one row per row of
    docs (doc_id, text) with n_words, n_removed and kept_text (the words left, joined by a space).

    Words are what stands between ASCII white space, unchanged. Windows are judged on the texts as given. A null text
    has no words. A row without doc_id takes no part: it loses nothing and takes nothing. Rows with one doc_id are equal
    in rank and don't cut each other; a window that stands in its own document only, however often, stays. An empty table gives
    an empty result; other columns are ignored. Windows are told apart by 128 bits."""
    steps = Steps(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranked = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    # seeds that two documents have
    shared = (ranked.mapInArrow(*_emit("seeds", length, seed)).groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
              .where("lo < hi").select("seed"))
    stretches = steps.write(ranked.mapInArrow(*_emit("stretches", length, seed)).join(shared, "seed").select("doc_id", "s1", "s2"))
    # whole stretches of a smaller document; the others are opened
    first = stretches.groupBy("s1", "s2").agg(F.min("doc_id").alias("lo"))
    later = F.col("lo") < F.col("doc_id")
    lists = steps.write(stretches.join(first, ["s1", "s2"]).groupBy("doc_id")
                        .agg(F.collect_set(F.when(later, F.col("s1"))).alias("covered"), F.collect_set(F.when(~later, F.col("s1"))).alias("own")))
    steps.drop(stretches)
    windows = steps.write(ranked.join(lists.where(F.size("own") > 0).select("doc_id", "own"), "doc_id").mapInArrow(*_emit("windows", length, seed)))
    lowest = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    opened = steps.write(windows.join(lowest, ["w1", "w2"]).where(later).groupBy("doc_id").agg(F.collect_set("w1").alias("windows")))
    steps.drop(windows)
    return docs.join(lists.join(opened, "doc_id", "left"), "doc_id", "left").select("doc_id", "text", "covered", "own", "windows").mapInArrow(*_cut(length, seed))
