import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from payproof.llm import substrings
from helpers_llm import corpus, docs, ids_with_gaps  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    lowest = {}
    for i, w in words:
        if i is not None:
            for s in range(len(w) - length + 1):
                g = tuple(w[s:s + length])
                lowest[g] = min(lowest.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - length + 1):
            if i is not None and lowest[tuple(w[s:s + length])] < i:
                gone.update(range(s, s + length))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,length,k", [(1, 4, 2), (2, 6, 3)])
def test_equals_brute_force(docs, seed, length, k):
    texts = corpus(seed)
    rows = list(zip(ids_with_gaps(len(texts)), texts, strict=True))
    got = substrings.remove_repeats(docs(texts, [i for i, _ in rows]), length, k).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, length)


def test_very_long_texts_and_one_word(docs):
    long = " ".join(str(i) for i in range(300_000))                  # more than one block of bytes
    texts = [long, "x " * 100, long[len(long) // 2:], "x " * 20, "start " + long]
    got = {r.doc_id: r for r in substrings.remove_repeats(docs(texts)).collect()}
    assert [got[i].n_removed for i in range(5)] == [0, 0, got[2].n_words - (got[2].kept_text != ""), 20, 300_000]
    assert got[4].kept_text == "start"


def test_empty_table(docs):
    assert substrings.remove_repeats(docs([])).collect() == []


def test_a_task_holds_little_beside_its_batch():
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 50_000, 4_000))) for _ in range(400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(400), pa.int64()), "text": texts})
    stretches = pa.Table.from_batches(substrings._emit("stretches", 13, 5)[0](iter([batch]))).to_pandas().groupby("doc_id")["s1"].apply(list)
    batch = batch.append_column("own", pa.array([stretches[i] for i in range(400)], pa.list_(pa.int64())))
    tracemalloc.start()
    rows = [(b.num_rows, b.nbytes) for b in substrings._emit("windows", 13, 5)[0](iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for n, _ in rows) == 400 * (4_000 - 12)
    assert peak < 120 << 20 and max(size for _, size in rows) < 12 << 20
