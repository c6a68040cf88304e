"""Quality classifier: a sparse rule ensemble.

Statistics of a text (columns made of built-in functions) feed shallow trees; every path from a root to a node is a rule, a
conjunction of comparisons. A logistic regression with an L1 penalty weighs the rules and leaves most at zero. What remains is compiled into one
Spark column expression, so that scoring is a projection.

Trees and regression are Spark ML's, fitted on all labelled rows that are not held out; only rules and weights, a fixed number of them, reach the driver.
"""
from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payproof.llm.quality import SPACE, SYMBOLS, _chars_of, _let, surface
from payproof.llm.steps import Steps

TREES, DEPTH = 20, 3
PENALTY = 0.002
STATISTICS = ("n_words", "word_length", "symbols", "capitals", "digits", "marks", "dup_lines", "repeats", "line_words", "distinct")


def statistics(text: Column) -> list[Column]:
    """The numbers that rules compare: none is null, an empty text gives zeros."""
    text = F.coalesce(text, F.lit(""))
    per = lambda a, b: (a / F.greatest(b, F.lit(1))).cast("double")
    s = F.col("__s")
    words, chars = s["w"]["n_words"], s["w"]["word_chars"]
    lines = F.size(F.split(text, "\n"))
    distinct = _let(F.filter(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), lambda w: w != ""), lambda w: F.size(F.array_distinct(w)))
    return [c.alias(n) for n, c in zip(STATISTICS, (
        words.cast("double"), per(chars, words), per(s["n_symbols"], chars), per(_chars_of(text, "A-Z"), chars), per(_chars_of(text, "0-9"), chars),
        per(_chars_of(text, r"!?.,;:|\-_=~\^@/\\()\[\]{}\"'"), chars), per(s["n_dup_lines"], lines), per(s["w"]["n_repeat_words"], words), per(words, lines), per(distinct, words)), strict=True)]


@dataclass(frozen=True)
class Rules:
    """Conjunctions of (statistic, is above, limit), a weight for each, and a constant."""
    paths: tuple[tuple[tuple[str, bool, float], ...], ...]
    weights: tuple[float, ...]
    constant: float

    def score(self) -> Column:
        """Between 0 and 1."""
        total = reduce(lambda a, b: a + b, [F.when(_holds(p), w).otherwise(0.0) for p, w in zip(self.paths, self.weights, strict=True) if w], F.lit(self.constant))
        return 1 / (1 + F.exp(-total))


def _holds(path: tuple) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n) > limit if above else F.col(n) <= limit for n, above, limit in path])


def _paths(tree) -> set[tuple]:
    """The paths of a fitted tree to all its nodes, from its printed form."""
    found, way = set(), []
    for line in tree.toDebugString.splitlines():
        m = re.match(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if m:
            depth = len(m[1])
            while way and way[-1][0] >= depth:
                way.pop()
            way.append((depth, (STATISTICS[int(m[2])], m[3] == ">", float(m[4]))))
            found.add(tuple(c for _, c in way))
    return found


def _simple(path: tuple) -> tuple:
    """Of several limits on one side of a statistic, the tightest."""
    kept: dict[tuple[str, bool], float] = {}
    for name, above, limit in path:
        old = kept.get((name, above), limit)
        kept[(name, above)] = max(old, limit) if above else min(old, limit)
    return tuple(sorted((n, a, v) for (n, a), v in kept.items()))


def fit(rows: DataFrame, label: str) -> Rules:
    """Rules from rows of statistics and a 0/1 label. Without rows, or with one label only, the constant alone."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        return Rules((), (), math.log((good + 0.5) / (bad + 0.5)) if good + bad else 0.0)
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="__x").transform(rows).select("__x", F.col(label).cast("double").alias("__y"))
    forest = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=TREES, maxDepth=DEPTH, seed=1, featureSubsetStrategy="onethird", minInstancesPerNode=20).fit(vectors)
    paths = sorted({_simple(p) for t in forest.trees for p in _paths(t)})
    if not paths:
        return Rules((), (), math.log((good + 0.5) / (bad + 0.5)))
    hits = rows.select(F.col(label).cast("double").alias("__y"), *[_holds(p).cast("double").alias(f"__r{i}") for i, p in enumerate(paths)])
    vectors = VectorAssembler(inputCols=[f"__r{i}" for i in range(len(paths))], outputCol="__x").transform(hits).select("__x", "__y")
    fitted = LogisticRegression(featuresCol="__x", labelCol="__y", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=100).fit(vectors)
    return Rules(tuple(paths), tuple(float(w) for w in fitted.coefficients), float(fitted.intercept))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5) -> tuple[DataFrame, Rules]:
    """One row per row of docs (doc_id, text): doc_id, held_out (crc32 of doc_id as text, modulo folds, is 0), score, statistics;
    and the rules. Labels of rows held out are not used.

    A document may have several labels: each is a row for the fit; null labels and labels of unknown documents are none.
    A null text is an empty one and gets a score too. A null doc_id is not held out and has no label. An empty table gives
    an empty result; without labels every score is 0.5. Other columns are ignored."""
    steps = Steps(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    facts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("__s", surface(F.col("text")))
    facts = steps.write(facts.select("doc_id", held.alias("held_out"), *statistics(F.col("text"))))
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("__label"))
    rules = fit(steps.write(facts.where(~F.col("held_out")).join(known, "doc_id").select("__label", *STATISTICS)), "__label")
    return facts.withColumn("score", rules.score()), rules
