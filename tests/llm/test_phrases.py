"""Phrases against counts by hand."""
import random
import re
from collections import Counter

import pytest
from helpers_llm import corpus, docs, ids_with_gaps  # noqa: F401
from pyspark.sql import functions as F

from payproof.llm import phrases


def brute(rows, support, best, inside):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if a >= support and len(p) > 2}
    out = []
    for p, a in found.items():
        if len(p) == 3 and any(p[1:] in (q[1:3], q[2:]) and 100 * b >= inside * a for q, b in found.items() if len(q) == 4 and q[0] == p[0]):
            continue
        cuts = [(1000000 * a * a // (f[p[:1 + k]] * f[(p[0], *p[1 + k:])]), k, f[p[:1 + k]], f[(p[0], *p[1 + k:])]) for k in range(1, len(p) - 1)]
        score, _, left, right = min(cuts)
        out.append((p[0], " ".join(p[1:]), a, left, right, n[p[0]], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:best]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(ranked)


def mined(table, **how):
    return sorted(tuple(r) for r in phrases.phrases(table, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed,support,best,inside", [(1, 10, 2000, 50), (2, 4, 7, 50), (3, 3, 30, 90)])
def test_equals_brute_force(docs, seed, support, best, inside):
    rnd = random.Random(seed)
    texts = [None if t is None else "".join(rnd.choice([c, c, c, c + ", ", c + "."]) if c == " " else c for c in t) for t in corpus(seed, n=90)]
    table = docs(texts, ids_with_gaps(len(texts))).withColumn("lang", F.when(F.length("text") % 3 == 0, "en").when(F.length("text") % 3 == 1, "fr").when(F.length("text") % 7 < 3, "und"))
    rows = [(r.text, r.lang) for r in table.collect()]
    want = brute(rows, support, best, inside)
    assert want and mined(table, support=support, best=best, inside=inside) == want


def test_long_texts_are_read_in_blocks(docs, monkeypatch):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcd") + rnd.choice([" ", "\t ", " , ", "\n"]) for _ in range(900))
    monkeypatch.setattr(phrases, "BLOCK", 40)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([text, "a b", ""]), pa.array([5, 6, 7]), pa.array([0, 1, 2])], names=["text", "tag", "shard"])
    got = Counter(s.raw[a:a + n] for s in phrases.slices(batch) for k in (1, 2, 3) for a, n in zip(*s.spans(s.at(k), k), strict=True))
    want = Counter()
    for t in (text, "a b"):
        for piece in re.split(r"[,\n]", t):
            w = piece.split()
            want.update(" ".join(w[i:i + k]).encode() for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert got == want


def test_nothing_and_exact_arithmetic(spark, docs):
    assert mined(docs([])) == [] and mined(docs([None, "", "a b"])) == []
    big = spark.createDataFrame([("en", "p q", 4 * 10**12), ("en", "p", 5 * 10**12), ("en", "q", 7 * 10**12), ("en", "", 10**13)], "lang string, phrase string, a long")
    assert [r.score for r in phrases._ranked(big, 10, 50).collect()] == [10**6 * 16 * 10**24 // (35 * 10**24)]
