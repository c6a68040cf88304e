import math
import random
import re

from helpers_llm import docs  # noqa: F401
from payproof.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets, links = [], {}
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[s:s + 5]) for s in range(max(1, len(w) - 4))} if w else set()))
    for a, p in sets:
        links.setdefault(a, {a})
        for b, q in sets:
            if a is not None and b is not None and p and q and 100 * len(p & q) >= 85 * len(p | q):
                links[a].add(b)
    out = []
    for i, s in sets:
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        low = None if i is None else min(reach)
        out.append((i, len(s), low, i is None or i == low))
    return sorted(out, key=str)


def texts_with_near_copies(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7)))
    out = [None, "", " \n", "one", "ONE", "one two", "x " * 400]
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([8, 60, 150, 400]))]
        out.append(" ".join(base))
        for _ in range(rnd.randrange(6)):
            base = list(base)                              # chains: each copy is made from the one before
            for _ in range(rnd.randrange(4)):
                base[rnd.randrange(len(base))] = word()
            out.append(rnd.choice([" ", "\n"]).join(base).upper() if rnd.random() < .2 else " ".join(base))
    return out


def test_equals_brute_force(docs):
    texts = texts_with_near_copies(1)
    ids = [None if i == 9 else i for i in range(len(texts))]
    ids[11] = ids[10]
    got = minhash.near_duplicates(docs(texts, ids)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(list(zip(ids, texts, strict=True)))


def test_a_large_group(docs):
    """Copies of one text with an edit each: no two buckets are alike, one component comes out."""
    rnd = random.Random(2)
    base = [str(rnd.randrange(10**6)) for _ in range(300)]
    texts = []
    for i in range(300):
        w = list(base)
        w[rnd.randrange(300)] = f"edit{i}"
        texts.append(" ".join(w))
    got = minhash.near_duplicates(docs(texts)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_empty_table(docs):
    assert minhash.near_duplicates(docs([])).collect() == []


def test_the_pipeline_links_from_080(docs):
    """A changed last word leaves n - 1 of n + 1 shingles: 0.80 to 0.846 for 9 to 12 shingles, 0.778 for 8."""
    import corpus_pipeline
    texts = []
    for n in range(8, 13):
        words = [f"n{n}w{i}" for i in range(n + 4)]
        texts += [" ".join(words), " ".join([*words[:-1], "else"])]
    table = docs(texts)
    left = corpus_pipeline.near_duplicates(table.sparkSession, table, "")
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == {0, 1, 2, 4, 6, 8}


def test_signature_estimate_keeps_an_unlucky_pair(docs):
    """A pair of exactly 0.80 with so few equal minima as one in 20,000 has."""
    words = [f"s20945w{i}" for i in range(13)]
    texts = [" ".join(words), " ".join([*words[:-1], "else"])]
    low = minhash.minima(*minhash.shingle_sets([t.encode() for t in texts], 5))
    assert (low[0] == low[1]).sum() < 84
    got = minhash.near_duplicates(docs(texts), percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 0)]


def test_signature_estimate_follows_the_percent():
    for percent in (80, 85, 90):
        p, k = percent / 100, minhash.fewest(percent)
        below = [sum(math.comb(128, i) * p ** i * (1 - p) ** (128 - i) for i in range(n)) for n in (k, k + 1)]
        assert below[0] <= 1e-12 < below[1]


def test_a_task_takes_little_text_at_once():
    """A worker's memory follows SLICE and PIECE, not the size of a batch; what it finds is the same."""
    import numpy as np
    import pyarrow as pa
    from payproof.llm import hashing
    rnd = random.Random(9)
    texts = [" ".join(str(rnd.randrange(10 ** 6)) for _ in range(n)) for n in (60_000, 300_000, *[2_000] * 300, 0, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = list(minhash._signatures(5)[0](iter([batch])))
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(len(texts)))
    size = [sum(len(texts[i]) for i in b.column("doc_id").to_pylist()) for b in out]
    assert len(out) > 3 and all(s <= 2 << 20 or b.num_rows == 1 for s, b in zip(size, out, strict=True))
    raw = [t.encode() for t in texts]
    joined = list(hashing._joined(raw))
    assert all(len(data) <= (1 << 18) + 20_000 or n <= 1 for _, n, data in joined)
    words, counts = hashing.word_hashes(raw)
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert np.array_equal(words, np.concatenate([hashing.word_hashes([t])[0] for t in raw]))
