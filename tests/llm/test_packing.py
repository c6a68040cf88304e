import random

import numpy as np
from pyspark.sql import functions as F

from helpers_llm import docs  # noqa: F401
from payproof.llm import packing


def _letters():
    def letters():                                             # sent to the workers whole, as this module isn't there
        import numpy
        return lambda t: numpy.array([ord(c) for c in t], numpy.uint32)
    return letters


letters = _letters()


def test_best_fit_equals_a_search():
    rnd = random.Random(1)
    for length in (1, 7, 64):
        sizes = np.array([rnd.randrange(1, length + 1) for _ in range(300)])
        room, want = [], []
        for i in sorted(range(300), key=lambda i: -sizes[i]):
            fit = [r for r in range(len(room)) if room[r] >= sizes[i]]
            least = min((room[r] for r in fit), default=None)
            if least is None:
                room.append(length)
                want.append([])
                row = len(room) - 1
            else:
                row = next(r for r in fit if room[r] == least)
            room[row] -= sizes[i]
            want[row].append(i)
        got = packing.best_fit(sizes, length)
        assert sorted(sum(sizes[r]) for r in got) == sorted(sum(sizes[r]) for r in want)
        assert sorted(i for r in got for i in r) == list(range(300)) and all(sum(sizes[r]) <= length for r in got)


def test_packed_rows_give_every_document_back(docs):
    rnd = random.Random(2)
    texts = [None, ""] + ["".join(rnd.choice("abcé漢") for _ in range(rnd.choice([1, 5, 31, 32, 33, 64, 200]))) for _ in range(80)]
    ids = [None if i == 5 else i for i in range(len(texts))]
    rows = packing.pack(docs(texts, ids), letters, pad=7, length=32).collect()
    found = {}
    for r in rows:
        x, at = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<i4")
        assert len(x) == len(at) == 32 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and (x[r.n_tokens:] == 7).all()
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert at[a:b].tolist() == list(range(b - a))
            found.setdefault(doc, {})[start] = "".join(map(chr, x[a:b]))
    assert {d: "".join(p[s] for s in sorted(p)) for d, p in found.items()} == {i: t for i, t in zip(ids, texts, strict=True) if t}
    assert sum(r.n_tokens for r in rows) > 0.9 * 32 * (len(rows) - 6)
    assert packing.pack(docs([]), letters, pad=0).collect() == []


def test_written_matrices(spark, docs, tmp_path):
    packed = packing.pack(docs(["hello", "there " * 30]), letters, pad=0, length=16)
    packing.write_matrices(packed, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).agg(F.sum("n_tokens")).first()[0] == 185
