import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from helpers_llm import corpus, docs  # noqa: F401
from payproof.llm import bpe, queries

CONTENT = open(queries.VOCABULARY, "rb").read()


@pytest.fixture(scope="module")
def own():
    return bpe.Coder(bpe.read_ranks(CONTENT), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(CONTENT), special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def odd_texts(seed, n):
    rnd = random.Random(seed)
    parts = ["the ", "  ", "'ll", "ing", "漢字", "🙂", " ", "\n\n", "é", "1234567", "<|endoftext|>", "#$%", "a" * 40, "\x00", "Straße"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(n)]


def test_as_the_library(own, library):
    for t in odd_texts(1, 400) + ["a" * 3000 + " " * 2000, "x" * 50_000]:
        assert ids(own.encode(t)) == library.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()


def test_edits_and_appends(own, library):
    rnd = random.Random(2)
    for t in odd_texts(3, 60):
        e = bpe.Edited(own, t)
        for _ in range(4):
            i = rnd.randrange(len(e.text) + 1)
            e.replace(i, min(len(e.text), i + rnd.randrange(6)), rnd.choice(["", "a", " ", "'s", "é the", "\n\n", "9"]))
            assert e.ids() == library.encode_ordinary(e.text)
        e.append("'t more")
        assert e.ids() == library.encode_ordinary(e.text)


def test_forgetting_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "SIZE", 5)
    for t in corpus(4, 20, words=("alpha", "bravo", "Charlie", "délta")):
        assert ids(own.encode(t or "")) == library.encode_ordinary(t or "")


def test_over_a_table(docs, library):
    texts = [None, "", *odd_texts(5, 40), "word " * 40_000]
    doc_ids = [None if i == 4 else 5 if i == 6 else i for i in range(len(texts))]
    coded = bpe.encode(docs(texts, doc_ids), queries.VOCABULARY, public_tokenizers.PATTERN, check=True).collect()
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in zip(doc_ids, texts, strict=True))
    assert sorted((str(r.doc_id), ids(r.ids), bytes(r.decoded)) for r in coded) == want
    assert all(r.n_tokens == len(ids(r.ids)) for r in coded)
    kept = bpe.encode(docs(texts), queries.VOCABULARY, public_tokenizers.PATTERN, keep=["doc_id", "kept", "source"])
    assert kept.columns == ["doc_id", "kept", "source", "n_tokens", "ids"]
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(kept, queries.VOCABULARY, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(docs([]), queries.VOCABULARY, public_tokenizers.PATTERN).collect() == []


def test_a_worker_remembers_a_bounded_number():
    """Two generations of pieces and two of pairs stay in a worker's memory through all later stages."""
    kept = bpe.Remembered(lambda key: key)
    for key in range(400_000):
        assert kept.find(key) == key
    assert len(kept.new) + len(kept.old) <= 1 << 18 and 399_999 in kept.new
