"""MinHash near-dedup: universal hash minima, banding, signature verification, exact check, components.

128 hash functions a * x + b modulo 2**64 give each set of five-word shingles 128 minima. 32 bands of 4 minima are the
buckets: two sets with similarity 0.85 share none with probability (1 - 0.85**4)**32 < 1e-10, and with
similarity 0.80 (1 - 0.8**4)**32 < 5e-8. Equal sets are one class from the
start, so copies cost one row of the class aggregate.

Nothing emits all pairs of a bucket. Round one compares each member with its bucket's smallest document, and the links
found give components. Members of buckets that still hold several components then meet on their rarest shingles, which
loses no pair that is similar enough and leaves alone what is only alike. Every candidate passes its signature
estimate before texts are fetched for the exact check of the full sets.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payproof.llm.arrow import small, texts
from payproof.llm.graph import components
from payproof.llm.hashing import BASES, U, Runs, mix, signed, word_hashes
from payproof.llm.steps import Steps

WORDS = 5
PERCENT = 85         # linked from this similarity on
BANDS, ROWS = 32, 4
#: A pair that is just similar enough fails its signature estimate at most this often.
LOSS = 1e-12
MULTIPLY = mix(np.arange(1, BANDS * ROWS + 1, dtype=U)) | U(1)
ADD = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) << U(32))
PART = 1 << 16       # shingles hashed at once, so that they stay in the processor's cache
SLICE = 2 << 20      # bytes of text a task takes at once: a word takes some hundred bytes in names and sets


def shingle_sets(batch: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts one after the other, and how many each has. Only A to Z are lowered."""
    hashes, counts = word_hashes([t.lower() for t in batch])
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    if not len(hashes):
        return hashes, n
    runs, ends = Runs(hashes), np.cumsum(counts)
    first = np.repeat(ends - counts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return runs.name(first, np.minimum(first + words, np.repeat(ends, n))), n


def minima(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over each text's shingles, one row for each text."""
    out = np.full((len(MULTIPLY), len(n)), ~U(0))
    has = np.flatnonzero(n)
    stops = np.cumsum(n[has])
    i = 0
    while i < len(has):
        at = stops[i] - n[has[i]]
        j = max(i + 1, int(np.searchsorted(stops, at + PART, side="right")))
        for lo in range(at, stops[j - 1], PART):                  # a long text takes several parts
            part = x[lo:min(lo + PART, stops[j - 1])]
            cuts = np.array([0]) if j == i + 1 else stops[i:j] - n[has[i:j]] - at
            for k in range(len(MULTIPLY)):
                least = np.minimum.reduceat(part * MULTIPLY[k] + ADD[k], cuts)
                out[k, has[i:j]] = np.minimum(out[k, has[i:j]], least)
        i = j
    return out.T


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, most=SLICE):
            x, n = shingle_sets(texts(batch), words)
            sets = [np.unique(p) for p in np.split(x, np.cumsum(n)[:-1])]
            size = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            cut = np.cumsum(size) - size
            key = [np.where(size > 0, np.add.reduceat(np.append(mix(flat * U(b)), U(0)), np.minimum(cut, len(flat))), U(0)) for b in BASES]
            low = minima(flat, size)
            band = low[:, ::ROWS].copy()
            for r in range(1, ROWS):
                band = mix(band) + low[:, r::ROWS]
            band = signed(mix(band + np.arange(BANDS, dtype=U)))
            sig = (low >> U(32)).astype(np.uint32).view(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel())) for v in (band, sig)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), *[pa.array(signed(k)) for k in key], *lists],
                                             names=["doc_id", "n_shingles", "k1", "k2", "bands", "sig"])
    return run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sig array<int>"


def _confirm(words: int, percent: int):
    """Pairs whose full sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(small(batches, "text_a", SLICE), "text_b", SLICE):
            (xa, na), (xb, nb) = (shingle_sets(texts(batch, c), words) for c in ("text_a", "text_b"))
            keep = []
            for p, q in zip(np.split(xa, np.cumsum(na)[:-1]), np.split(xb, np.cumsum(nb)[:-1]), strict=True):
                p, q = np.unique(p), np.unique(q)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run, "a long, b long"


def fewest(percent: int) -> int:
    """The most equal minima that a pair of `percent` similarity has fewer of with a probability of LOSS at most."""
    n, p = BANDS * ROWS, percent / 100
    k, below = 0, (1 - p) ** n
    while k < n and below <= LOSS:
        k += 1
        below += math.comb(n, k) * p ** k * (1 - p) ** (n - k)
    return k


def _similar(a: str, b: str, percent: int):
    """Whether two signatures agree in enough places."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda t: t)) >= fewest(percent)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text): n_shingles, component_id (the smallest doc_id reachable by links) and kept.

    A set holds the distinct `words`-word shingles of the text in lower case (A-Z); a shorter text is one shingle, a null
    or blank one has none and is linked with nothing. Two documents are linked if 100 * intersection >= percent * union of
    their full sets. Rows with one doc_id are one document: they share links, component and `kept`. A row without doc_id
    takes no part: its component is null and it is kept. An empty table gives an empty result; other columns are
    ignored. `percent` below 80 would need more bands."""
    steps = Steps(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = steps.write(docs.mapInArrow(*_signatures(words)))
    known = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    key = ["n_shingles", "k1", "k2"]
    classes = steps.write(known.groupBy(*key).agg(F.min_by(F.struct(F.col("doc_id").alias("id"), "bands", "sig"), "doc_id").alias("s")).select(*key, "s.*"))
    copies = known.join(classes.select(*key, "id"), key).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct()
    # the members of buckets that hold more than one, each beside the smallest of its bucket
    rows = classes.select(F.posexplode("bands").alias("band", "h"), "id", F.col("n_shingles").alias("n"))
    crowded = rows.groupBy("band", "h").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1").drop("m")
    rows = steps.write(rows.join(crowded, ["band", "h"]))
    near = lambda p, q: 100 * F.least(p, q) >= percent * F.greatest(p, q)
    tried = steps.write(rows.where((F.col("id") != F.col("hub.id")) & near(F.col("n"), F.col("hub.n"))).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct())
    links = steps.write(copies.union(_verified(steps, tried, classes, docs, words, percent)))
    part = steps.write(components(steps, links))
    # members of one bucket that are still apart
    rows = rows.select("band", "h", "id").join(part.withColumnRenamed("node", "id"), "id")
    mixed = rows.groupBy("band", "h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "h")
    left = steps.write(rows.join(mixed, ["band", "h"]).select("id", "component").distinct())
    apart = _by_rare_shingles(steps, docs, left, words, percent).join(tried, ["a", "b"], "left_anti")
    late = steps.write(_verified(steps, apart, classes, docs, words, percent))
    if not late.isEmpty():
        part = steps.write(components(steps, part.select(F.col("node").alias("a"), F.col("component").alias("b")).union(late)))
    steps.keep(sets, part)
    return (sets.select("doc_id", "n_shingles").join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, most=SLICE):
            x, n = shingle_sets(texts(batch), words)
            sets = [np.unique(p) for p in np.split(x, np.cumsum(n)[:-1])]
            size = np.array([len(s) for s in sets])
            of = np.repeat(np.arange(len(sets)), size)
            flat = np.concatenate(sets)
            key = np.array([mix(s).sum() if len(s) else U(0) for s in sets], U)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(of)) for c in ("id", "component")], pa.array(signed(key[of])), pa.array(size[of], pa.int64()), pa.array(signed(flat))],
                                             names=["id", "component", "k", "n", "shingle"])
    return run, "id long, component long, k long, n long, shingle long"


def _by_rare_shingles(steps: Steps, docs: DataFrame, left: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a < b) of documents of different components (left: id, component) that can be similar enough: none is lost.

    Each set is put in order, its rarest shingles first. Two sets that are similar enough share one among the first
    shingles of each: among the first n - ceil(percent * n / 100) + 1 of the larger, and fewer of the smaller; and behind the
    first they share enough must be left in both. Edits of a text are its rarest shingles, so members of a large group
    that have too many of them meet nobody. Of a shingle's members those outside its commonest component meet the others."""
    rows = steps.write(docs.withColumnRenamed("doc_id", "id").join(left, "id").select("id", "component", "text").mapInArrow(*_shingles(words)))
    common = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("id", "k")
    # shingles of one document only come first of all; they are counted, not kept
    shared = rows.join(common, "shingle").withColumn("rank", F.dense_rank().over(own.orderBy("df", "shingle")))
    shared = shared.withColumn("pos", F.col("n") - F.max("rank").over(own) + F.col("rank"))
    first = lambda top, low: F.col("n") - F.floor((top * F.col("n") + low - 1) / low) + 1
    shared = steps.write(shared.where(F.col("pos") <= first(percent, 100)).withColumn("early", F.col("pos") <= first(2 * percent, 100 + percent))
                         .select("shingle", "id", "component", "n", "pos", "early"))
    steps.drop(rows)
    parts = shared.groupBy("shingle", "component").agg(F.count("*").alias("m")).groupBy("shingle").agg(F.max_by("component", "m").alias("most"), F.count("*").alias("parts"))
    shared = shared.join(parts.where("parts > 1").select("shingle", "most"), "shingle").withColumn("outside", F.col("component") != F.col("most"))
    shared = steps.write(shared.drop("most"))
    side = lambda s, rows: rows.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "component", "n", "pos")])
    early = shared.where("early")
    fits = ((F.struct("n_s", "id_s") < F.struct("n_l", "id_l")) & (F.col("component_s") != F.col("component_l")) & (100 * F.col("n_s") >= percent * F.col("n_l"))
            & ((100 + percent) * (1 + F.least(F.col("n_s") - F.col("pos_s"), F.col("n_l") - F.col("pos_l"))) >= percent * (F.col("n_s") + F.col("n_l"))))
    met = [side("s", a).join(side("l", b), "shingle").where(fits).select(F.least("id_s", "id_l").alias("a"), F.greatest("id_s", "id_l").alias("b"))
           for a, b in ((early.where("outside"), shared), (early.where("NOT outside"), shared.where("outside")))]
    return met[0].union(met[1]).where("a < b").distinct()


def _verified(steps: Steps, pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures, and then full sets, are similar enough."""
    sig = lambda c: classes.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    text = lambda c: docs.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    likely = steps.write(pairs.join(sig("a"), "a").join(sig("b"), "b").where(_similar("sig_a", "sig_b", percent)).select("a", "b").distinct())
    return likely.join(text("a"), "a").join(text("b"), "b").mapInArrow(*_confirm(words, percent)).distinct()
