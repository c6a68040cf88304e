from collections import Counter

import pytest
from pyspark.sql import functions as F

from payproof.llm import suffixes
from helpers_llm import corpus, docs, ids_with_gaps  # noqa: F401


def brute(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s:s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = set()
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone.update(range(s, s + length))
        spans = sum(p not in gone or p - 1 not in gone for p in gone)
        out.append((i, len(b), len(gone), spans, bytes(x for p, x in enumerate(b) if p not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,length", [(1, 24), (2, 50), (3, 17)])
def test_equals_brute_force(docs, seed, length):
    texts = corpus(seed)
    rows = list(zip(ids_with_gaps(len(texts)), texts, strict=True))
    got = suffixes.remove_repeats(docs(texts, [i for i, _ in rows]), length).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept_bytes)) for r in got], key=str) == brute(rows, length)


def test_edited_copies(docs):
    """Many copies of a passage, each with an edit at another place: stretches, blocks and strings are all needed."""
    import random
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(1500))
    texts = [base] + [base[:p] + "#" + base[p + 1:] for p in rnd.sample(range(1500), 25)] + ["q" * 900, "".join(rnd.choice("xyz") for _ in range(700))]
    got = suffixes.remove_repeats(docs(texts)).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept_bytes)) for r in got], key=str) == brute(list(enumerate(texts)), 400)


def test_repeats_where_nothing_is_opened(docs):
    """Texts with repeated stretches, none of which was opened, have no list of opened ones."""
    import random
    rnd = random.Random(7)
    copy, other = ("".join(rnd.choice("abcdefgh ") for _ in range(600)) for _ in range(2))
    texts = [copy, copy, copy, other, None, "short"]
    got = suffixes.remove_repeats(docs(texts)).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept_bytes)) for r in got], key=str) == brute(list(enumerate(texts)), 400)


def test_the_query_returns_what_is_left(docs, tmp_path):
    """Passages of 400 bytes go wherever they stand, shorter ones and clean documents stay as they are; n_bytes counts whole texts."""
    import hashlib
    import random
    from payproof.llm import queries
    rnd = random.Random(8)
    prose = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    long, short = prose(401), prose(398)
    clean = [prose(700), "é" * 50, ""]
    table = docs([f"1{long}2", f"3{long}4", f"5{short}6", f"7{short}8", *clean])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op7_suffix_array_dedup"](table.sparkSession, str(tmp_path)).collect()
    want = dict(enumerate(["12", "34", f"5{short}6", f"7{short}8", *clean]))
    assert {r.doc_id: r.text for r in rows} == want
    assert {r.doc_id: r.kept_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in rows) == [(0, 403, 401), (1, 403, 401), (2, 400, 0), (3, 400, 0), (4, 700, 0), (5, 100, 0), (6, 0, 0)]


def test_short_texts_share_small_pieces():
    """A task's memory follows the bytes of a piece; every text of `length` bytes is in one, whole."""
    texts = [b"x" * n for n in (300_000, 400, 399, 262_144, 100_000, 200_000, 500)]
    pieces = [(owner.tolist(), ends.tolist()) for _, owner, _, _, ends in suffixes._pieces(texts, 400)]
    assert pieces == [([0], [300_000]), ([1], [400]), ([3], [262_144]), ([4], [100_000]), ([5, 6], [200_000, 200_500])]


def test_longer_than_a_block(docs):
    import random
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefghijklmnop") for _ in range(1_300_000))
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs([long, "-" + long[1_048_000:1_049_500] + "-"])).collect()}
    assert (got[0].n_removed, got[1].n_removed, bytes(got[1].kept_bytes)) == (1500, 1500, b"--")


def test_documents_keep_their_columns(docs):
    texts = ["é" * 300 + "tail", "é" * 300, "short", None]
    table = docs(texts)
    got = {r.doc_id: r for r in suffixes.without_repeats(table).collect()}
    assert suffixes.without_repeats(table).columns == table.columns
    assert got[0].text == "tail" and got[0].n_chars == 4 and 1 not in got and got[2].text == "short" and got[3].text is None
    assert got[2].rid == "x" and suffixes.without_repeats(table.where(F.lit(False))).collect() == []


def test_the_pipeline_cuts_passages_of_51_words(docs):
    """Passages of 51 to 60 words under 400 bytes go from both documents; shorter ones and clean documents stay."""
    import random
    import corpus_pipeline
    rnd = random.Random(6)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    texts, kept = [], []
    for n in (40, 51, 55, 60):
        passage = prose(n)
        assert 200 <= len(passage) < 400
        for own in ("One", "Two"):
            head, tail = f"{prose(30)} {own}", f"{own}! {prose(30)}"
            texts.append(f"{head} {passage} {tail}")
            kept.append(texts[-1] if n < 51 else f"{head}{tail}")
    for _ in range(3):
        texts.append(prose(150))
        kept.append(texts[-1])
    table = docs(texts)
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_bytes(table.sparkSession, table, "").collect()}
    assert got == dict(enumerate(kept))
