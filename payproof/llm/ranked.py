"""Ranked lexical search: the terms of all items found in the texts by one automaton, without an index of the documents.

The items are dealt to blocks of bounded size. Of a block's terms an Aho-Corasick automaton is made, each term guarded by a space on either
side, and broadcast with the items that its terms lead to. The texts go through it twice: for the statistics (documents of each term, number
and length of documents), which are combined in the task before they are moved, and for the scores. A task adds up the scores of its documents by
item and keeps the best of each item only, so what is shuffled is a few rows per item and task.

Scores are sums of whole numbers below 2**53 (a block has at most 2**17 terms of items, each worth less than 2**36), so adding them up in doubles is exact.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payproof.llm.arrow import small, texts
from payproof.llm.steps import Steps
from payproof.llm.terms import folded
from payproof.scale import running

BEST = 50
BLOCK = 1 << 17              # terms of items in one automaton
TERM_BYTES = 8               # a term weighs one and one for each so many of its bytes
ROOM = 1 << 21               # scores added up, or rows kept, at once
NO_ID = np.iinfo(np.int64).max


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        found = [set().union(*(block.split() for block in folded(t))) for t in texts(batch)]
        which = np.repeat(np.arange(len(found)), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(which)), pa.array([t for f in found for t in sorted(f)], pa.binary())], names=["item_id", "term"])


def _blocks(items: DataFrame, steps: Steps) -> DataFrame:
    """(block, unit, item_id, whole, term): every term of an item once. A unit is an item, or a part of one with more terms than a block holds."""
    kind = items.schema["item_id"].dataType.simpleString()
    terms = steps.write(items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(_terms, f"item_id {kind}, term binary").distinct(), tidy=False)
    weight = 1 + F.floor(F.length("term") / TERM_BYTES)
    sizes = terms.groupBy("item_id").agg(F.sum(weight).alias("size")).select("*", F.ceil(2 * F.col("size") / BLOCK).alias("parts"))
    terms = terms.join(sizes.withColumnRenamed("item_id", "__item"), F.col("item_id").eqNullSafe(F.col("__item"))) \
        .select("item_id", "term", (F.col("size") <= BLOCK).alias("whole"), F.when(F.col("size") <= BLOCK, 0).otherwise(F.pmod(F.xxhash64("term"), "parts")).alias("part"))
    terms = steps.write(terms, tidy=False)
    units = terms.groupBy("item_id", "part").agg(F.sum(weight).alias("size"))
    units = running(units, [], [("slice", F.pmod(F.xxhash64("item_id", "part"), F.lit(4096)))], [F.col("item_id"), F.col("part")], {"before": F.col("size")})
    units = units.select(F.col("item_id").alias("__item"), F.col("part").alias("__part"), F.floor(F.col("before") / BLOCK).alias("block"))
    return steps.write(terms.join(units, F.col("item_id").eqNullSafe(F.col("__item")) & (F.col("part") == F.col("__part"))).select("block", "item_id", "part", "whole", "term"), tidy=False)


class Terms:
    """One block: its terms, and the units of items that each leads to."""

    def __init__(self, rows: pa.Table):
        term = rows.column("term").combine_chunks()
        self.terms = sorted(set(term.to_pylist()))
        place = {t: i for i, t in enumerate(self.terms)}
        unit = rows.select(["item_id", "part", "whole"]).group_by(["item_id", "part", "whole"], use_threads=False).aggregate([])
        self.item_id, self.part, self.whole = unit.column("item_id").combine_chunks(), unit.column("part").to_numpy(), unit.column("whole").to_numpy()
        of = {k: i for i, k in enumerate(zip(self.item_id.to_pylist(), self.part.tolist(), strict=True))}
        t = np.array([place[x] for x in term.to_pylist()], np.int64)
        u = np.array([of[k] for k in zip(rows.column("item_id").to_pylist(), rows.column("part").to_pylist(), strict=True)], np.int64)
        order = np.lexsort((u, t))
        self.units, self.first = u[order], np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(self.terms)))])
        self.weight, self.n, self.total, self._automaton = np.zeros(len(self.terms), np.int64), 0, 0, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def counts(self, text: bytes) -> tuple[int, Counter]:
        """(words of a text, occurrences of each term by its place)."""
        if self._automaton is None:
            import ahocorasick
            self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, t in enumerate(self.terms):
                self._automaton.add_word(f" {t.decode('latin-1')} ", i)
            self._automaton.make_automaton()
        n, found = 0, Counter()
        for block in folded(text):
            guarded = b" " + block + b" "
            space = np.frombuffer(guarded, np.uint8) == 0x20
            n += int(np.count_nonzero(space[:-1] & ~space[1:]))
            found.update(map(itemgetter(1), self._automaton.iter(guarded.decode("latin-1"))))
        return n, found


def _statistics(broadcast):
    """Documents of each term in a task; under -1 documents with a term, under -2 their length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = broadcast.value
        df, n, total = np.zeros(len(look.terms), np.int64), 0, 0
        for batch in small(batches):
            for text in texts(batch):
                words, found = look.counts(text)
                n, total = n + (words > 0), total + words
                df[np.fromiter(found.keys(), np.int64, len(found))] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([df[some], [n, total]]))], names=["term", "n"])
    return run


class _Best:
    """The rows of the best scores of each unit so far, ties by document."""

    def __init__(self, units: int, best: int):
        self.best, self.bar, self.found, self.size = best, np.zeros(units, np.int64), [], 0

    def add(self, unit: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        good = (score > 0) & (score >= self.bar[unit])
        self.found.append((unit[good], score[good], doc[good]))
        self.size += len(self.found[-1][0])
        if self.size > ROOM:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        unit, score, doc = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((doc, -score, unit))
        place = np.arange(len(order)) - np.searchsorted(unit[order], unit[order])
        order, place = order[place < self.best], place[place < self.best]
        unit, score, doc = unit[order], score[order], doc[order]
        self.bar[unit[place == self.best - 1]] = score[place == self.best - 1]
        self.found, self.size = [(unit, score, doc)], len(unit)
        return unit, score, doc


def _scored(broadcast, best: int, kind: pa.DataType):
    """The best documents of each item in a task, and all of those items that stand in several parts."""
    def rows(look: Terms, unit: np.ndarray, score: np.ndarray, doc: np.ndarray, mark) -> pa.RecordBatch:
        ids = pa.array(doc, pa.int64(), mask=doc == NO_ID)
        return pa.RecordBatch.from_arrays([look.item_id.take(pa.array(unit)).cast(kind), pa.array(look.part[unit], pa.int64()), pa.array(look.whole[unit]), ids, mark, pa.array(score)],
                                          names=["item_id", "part", "whole", "doc_id", "mark", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = broadcast.value
        units, kept = len(look.part), _Best(len(look.part), best)
        for batch in small(batches):
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            marks = batch.column("mark")
            found = [look.counts(t) for t in texts(batch)]
            sizes = np.array([len(c) for _, c in found])
            doc = np.repeat(np.arange(len(found)), sizes)
            term = np.fromiter((t for _, c in found for t in c.keys()), np.int64, sizes.sum())
            tf = np.fromiter((t for _, c in found for t in c.values()), np.int64, sizes.sum())
            m = 50 + (50 * np.array([n for n, _ in found], np.int64) * look.n) // max(look.total, 1)
            worth = look.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            reach = look.first[term + 1] - look.first[term]
            ends = np.cumsum(np.bincount(doc, reach, len(found)).astype(np.int64))
            a = 0
            while a < len(found):                        # as many documents as fit at once, one at least
                b = max(a + 1, min(a + ROOM // units, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ROOM, side="right"))))
                lo, hi = np.searchsorted(doc, [a, b])
                r = reach[lo:hi]
                at = np.repeat(look.first[term[lo:hi]] - np.cumsum(r) + r, r) + np.arange(r.sum())
                key = np.repeat(doc[lo:hi] - a, r) * units + look.units[at]
                sums = np.bincount(key, np.repeat(worth[lo:hi], r), (b - a) * units).astype(np.int64)
                some = np.flatnonzero(sums)
                d, u = some // units + a, some % units
                kept.add(*(x[look.whole[u]] for x in (u, sums[some], ids[d])))
                parts = ~look.whole[u]
                if parts.any():
                    yield rows(look, u[parts], sums[some][parts], ids[d][parts], marks.take(pa.array(d[parts])).cast(pa.binary()))
                a = b
        unit, score, doc = kept.cut()
        yield rows(look, unit, score, doc, pa.nulls(len(unit), pa.binary()))
    return run


def _top(found: DataFrame, best: int) -> DataFrame:
    """Ranks by item: first within slices of an item's rows, then among the slices' best."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    sliced = found.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    first = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "slice").orderBy(*order))).where(F.col("rank") <= best)
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= best)
            .select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` documents (doc_id, text) of each item (item_id, text), those with a score above 0.

    Terms are runs of letters, digits and everything beyond ASCII, A-Z in lower case. With N documents with a term and L terms in
    them, a term weighs floor(1000 * ln((2N+2)/(2df+1))); a document of n terms adds weight * (10**9 * tf div (1000 * tf + 20 * m)) for each
    term of the item, m = 50 + 50nN div L. Equal scores are ordered by doc_id. A null text has no terms. Rows of docs are documents of their own, those
    without doc_id come last among equals; rows with one item_id (or none) are one item with the terms of all. An item
    without terms, or whose terms are nowhere, has no rows; neither has an empty table. Other columns are ignored. Long texts are
    scanned in blocks; an item with more terms than a block is scored in parts that are added up by document."""
    spark = docs.sparkSession
    steps = Steps(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(items, steps)
    kind = items.schema["item_id"].dataType
    several = blocks.where("NOT whole").limit(1).count() > 0
    parts = []
    for number in range(blocks.agg(F.coalesce(F.max("block") + 1, F.lit(0)).alias("n")).first()["n"]):
        rows = blocks.where(F.col("block") == number).drop("block").toArrow()      # at most BLOCK terms and one more item's
        if not rows.num_rows:
            continue
        look = Terms(rows)
        first = spark.sparkContext.broadcast(look)
        counted = steps.write(docs.select("text").mapInArrow(_statistics(first), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), tidy=False)
        head = {r["term"]: r["n"] for r in counted.where("term < 0").collect()}
        look.n, look.total = head.get(-1, 0), head.get(-2, 0)
        weight = F.floor(1000 * F.log(F.lit(float(2 * look.n + 2)) / (2 * F.col("n") + 1).cast("double"))).cast("long")
        for r in counted.where("term >= 0").select("term", weight.alias("weight")).collect():
            look.weight[r["term"]] = r["weight"]
        schema = f"item_id {kind.simpleString()}, part long, whole boolean, doc_id long, mark binary, score long"
        from pyspark.sql.pandas.types import to_arrow_type
        marked = docs.withColumn("mark", F.unhex(F.md5("text")) if several else F.lit(None).cast("binary"))
        parts.append(marked.mapInArrow(_scored(spark.sparkContext.broadcast(look), best, to_arrow_type(kind)), schema))
    if not parts:
        return blocks.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    found = reduce(DataFrame.union, parts)
    whole = found.where("whole").select("item_id", "doc_id", "score")
    if not several:
        return _top(whole, best)
    # equal rows of docs have equal scores: so many of them stand in each part
    added = (found.where("NOT whole").groupBy("item_id", "doc_id", "mark", "part").agg(F.max("score").alias("score"), F.count("*").alias("copies"))
             .groupBy("item_id", "doc_id", "mark").agg(F.sum("score").alias("score"), F.max("copies").alias("copies")))
    copies = added.select("item_id", "doc_id", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(best)))).alias("copy")).drop("copy")
    return _top(whole.union(copies), best)
