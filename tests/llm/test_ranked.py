"""Ranked search against scores added up one by one."""
import math
import re
from collections import Counter

import pytest
from helpers_llm import corpus, docs, ids_with_gaps  # noqa: F401

from payproof.llm import ranked

ITEMS = "item_id long, text string, score long"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, best):
    counts = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for name, text in items:
        asked.setdefault(name, set()).update(terms(text))
    out = []
    for name, words in asked.items():
        mine = []
        for i, c in counts:
            m = 50 + 50 * c.total() * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in words if c[t])
            if score > 0:
                mine.append((-score, i is None, i or 0))
        out += [(name, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(mine)[:best])]
    return sorted(map(str, out))


def found(docs, items, best):
    r = ranked.search(docs, items, best)
    assert r.columns == ["item_id", "rank", "doc_id", "score"] and r.schema["rank"].dataType.simpleString() == "int"
    return sorted(str(tuple(x)) for x in r.collect())


QUESTIONS = [(1, "A bé nowhere"), (2, "c D e漢 c"), (2, "a"), (None, "D"), (3, None), (4, ""), (5, "a, bé; c! d e漢 only once here"), (6, "nothing")]


@pytest.mark.parametrize("seed,best,block", [(1, 50, None), (2, 5, 9), (3, 3, 4)])
def test_equals_brute_force(spark, docs, seed, best, block, monkeypatch):
    if block:                                            # several blocks, and items that stand in several parts
        monkeypatch.setattr(ranked, "BLOCK", block)
        monkeypatch.setattr(ranked, "ROOM", 11)
    texts = corpus(seed, n=80)
    ids = ids_with_gaps(len(texts))
    items = spark.createDataFrame([(i, t, 0) for i, t in QUESTIONS], ITEMS)
    assert found(docs(texts, ids), items, best) == brute(list(zip(ids, texts, strict=True)), QUESTIONS, best)


def test_long_texts_are_scanned_in_blocks(monkeypatch):
    import pyarrow as pa

    from payproof.llm import terms as words
    look = ranked.Terms(pa.table({"item_id": [1, 1], "part": [0, 0], "whole": [True, True], "term": pa.array([b"ab", b"b"], pa.binary())}))
    text = b"ab,ab b-bb  AB" * 50
    want = look.counts(text)
    monkeypatch.setattr(words, "BLOCK", 3)
    assert look.counts(text) == want == (len(terms(text.decode())), Counter({look.terms.index(t): terms(text.decode()).count(t.decode()) for t in look.terms}))


def test_nothing_to_find(spark, docs):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a", 0)], ITEMS)
    assert found(docs(["a"]), none, 5) == [] and found(docs([]), some, 5) == [] and found(docs([None, "b"]), some, 5) == []
