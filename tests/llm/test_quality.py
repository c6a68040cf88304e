import math
import random
import re
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from helpers_llm import corpus, docs, ids_with_gaps  # noqa: F401
from payproof.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\x0b\f\r]+")


def surface(t):
    w = WORD.findall(t)
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {p for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def bucket(*tokens):
    """A token's hash, or the hash of two tokens' hashes."""
    seed = 42
    hashes = [xxhash.xxh64_intdigest(t.encode(), seed) for t in tokens]
    if len(hashes) > 1:
        for h in hashes:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        hashes = [seed]
    return hashes[0] % quality.BUCKETS


def grams(t):
    x = TOKEN.findall(t)
    return [bucket(a) for a in x] + [bucket(a, b) for a, b in zip(x, x[1:])]


def brute(texts):
    raw, good = Counter(), Counter()
    for t in texts:
        if t is None:
            continue
        raw.update(grams(t))
        caps = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t)
        if len(t) >= 300 and surface(t)[2] <= 0.01 * len(t) and caps <= 0.2 * len(t):
            good.update(grams(t))
    n, m, b = sum(raw.values()), sum(good.values()), quality.BUCKETS
    weight = [math.log((good[i] + 1) / (m + b)) - math.log((raw[i] + 1) / (n + b)) for i in range(b)]
    for t in texts:
        g, s = grams(t or ""), surface(t or "")
        failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
        llr = sum(weight[i] for i in g) / len(g) if g else 0.0
        yield *s, failed, llr, not failed and llr >= quality.THRESHOLD


def prose(n):
    words = "river stone under light while many small boats cross toward quiet harbour towns before evening".split()
    rnd = random.Random(3)
    return [" ".join(rnd.choice(words) + "," * (j % 9 == 0) for j in range(120)) for _ in range(n)]


def test_equals_brute_force(docs):
    texts = corpus(11, 60) + prose(40) + [("#%& " + "$$$ *** " * 30)] * 3 + ["LOUD!! " * 4 + " ".join(f"W{i}!!" for i in range(80)), "word " * 30_000]
    ids = ids_with_gaps(len(texts))
    got = quality.judged(docs(texts, ids)).select("doc_id", "text", "quality.*").collect()
    want = {}
    for t, row in zip(texts, brute(texts), strict=True):
        want[t] = row
    assert len(got) == len(texts)
    for r in got:
        w = want[r.text]
        assert tuple(r)[2:8] == w[:6] and r.llr == pytest.approx(w[6], abs=1e-9) and r.kept == w[7]
    verdict = {r.text: r.kept for r in got}
    assert all(verdict[t] for t in prose(40)) and not verdict["#%& " + "$$$ *** " * 30]


def test_extra_columns_and_empty_table(docs):
    table = docs(["some text of more than ten words is here for you to read"])
    out = quality.judged(table, out="kept")
    assert sorted(out.columns) == sorted(table.columns) and out.first().rid == "x"
    assert quality.judged(table.where(F.lit(False))).collect() == []
