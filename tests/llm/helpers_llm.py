"""Small tables of documents."""
import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, quality string, rid string, repeated string, size long"


def rows_of(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", f"s{k % 4}" if k % 5 else None, None if t is None else len(t), "x", "x", "x", "x", -1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from texts: with extra columns whose names operators use inside or in results."""
    return lambda texts, ids=None: spark.createDataFrame(rows_of(texts, ids), DOCS).repartition(3, F.col("doc_id"))


def corpus(seed, n=60, words=("a", "bé", "c", "D", "e漢"), longest=60, copies=True):
    """Random texts over few words, with copies, passages taken from others, blanks and nulls."""
    rnd = random.Random(seed)
    out = [None, "", " \n\t", "a", "\x0b\x0c"]
    while len(out) < n:
        t = "".join(rnd.choice(words) + rnd.choice([" ", "\n", "  ", "\t"]) for _ in range(rnd.randrange(longest)))
        if copies and rnd.random() < 0.3:
            other = rnd.choice(out) or ""
            at = rnd.randrange(len(other) + 1)
            t = rnd.choice([other, t + other[at:], other[:at] + t, other[:at] + "x" + other[at + 1:]])
        out.append(t)
    return out


def ids_with_gaps(n):
    """Null and repeated doc_ids among others."""
    return [None if i % 17 == 3 else i - 1 if i % 13 == 5 else i for i in range(n)]
