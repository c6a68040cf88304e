"""Leaks against windows looked up one by one."""
import random
import re

import pytest
from helpers_llm import corpus, docs, ids_with_gaps  # noqa: F401
from pyspark.sql import functions as F

from payproof.llm import decontaminate, terms

ITEMS = "item_id long, text string, leak string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        x = words(item)
        k = min(window, len(x))
        for i in range(len(x) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j:j + k] == x[i:i + k]:
                    hit.update(range(j, j + k))
                    found.add(name)
    return len(w), len(hit), sorted(str(f) for f in found if f is not None)


def some_items(texts, seed):
    rnd = random.Random(seed)
    cut = [" ".join(words(t)[a:a + rnd.randrange(1, 14)]).upper() for t in texts if t for a in [rnd.randrange(1 + len(words(t)))]][:14]
    return [*((i // 2 if i % 5 == 1 else i, t) for i, t in enumerate(cut)), (None, "a c"), (90, None), (91, " ,;"), (92, "nowhere to be found"), (93, "c a c"), (94, "c a c")]


@pytest.mark.parametrize("seed,window", [(1, 4), (2, 10), (3, 3)])
def test_equals_brute_force(spark, docs, seed, window, monkeypatch):
    texts = corpus(seed)
    items = some_items(texts, seed)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 25)            # several automata, more than one pass goes through
    table = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = decontaminate.leaks(docs(texts, ids_with_gaps(len(texts))), table, window).select("doc_id", "text", "kept", "leak.*").collect()
    assert len(got) == len(texts) and all(r.kept == "x" for r in got)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == brute(r.text, items, window)
        assert r.n_hit == sum(s.last - s.first + 1 for s in r.spans)
    assert sum(r.n_hit > 0 for r in got) > 5


def test_long_texts_and_items_are_read_in_blocks(monkeypatch):
    rnd = random.Random(5)
    text = " ".join(rnd.choice("abcd") for _ in range(400)) + ",,, " * 90 + "b a d"
    items = [(str(i), text[a:a + 60]) for i, a in enumerate((0, 100, 300, 560))]
    whole = decontaminate.Automaton([(n, t.split(), True) for n, t in [(n, t.encode()) for n, t in items]], 6)
    monkeypatch.setattr(terms, "BLOCK", 7)
    n, spans, found = whole.scan(text.encode())
    assert (n, sum(b - a + 1 for a, b in spans), sorted(found)) == brute(text, items, 6)
    assert terms.folded.__defaults__[1] == terms.INK and len(list(terms.folded(text.encode()))) > 50


def test_a_long_item_is_cut_into_pieces(spark, docs, monkeypatch):
    rnd = random.Random(6)
    item = " ".join(rnd.choice("abc") for _ in range(120))
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 9)
    texts = [item, item[31:70], "a b c a", "x " + item[40:140] + " x"]
    r = decontaminate.leaks(docs(texts), spark.createDataFrame([(1, item, "x")], ITEMS), 5).select("text", "leak.*").collect()
    assert [(x.n_words, x.n_hit, x["items"]) for x in r] == [brute(x.text, [(1, item)], 5) for x in r]


def test_nothing_to_find(spark, docs):
    none = spark.createDataFrame([], ITEMS)
    r = decontaminate.leaks(docs(["a b", None]), none).select("leak.*").collect()
    assert sorted((x.n_words, x.n_hit, len(x.spans), len(x["items"])) for x in r) == [(0, 0, 0, 0), (2, 0, 0, 0)]
    assert decontaminate.leaks(docs([]), none).count() == 0


def test_spans_and_coverage(spark, docs):
    item = "one two three four five six"
    texts = ["Start: ONE, two; three four five six! End é", "one two three four five six seven", "one two 漢", None, "nothing here"]
    table = spark.createDataFrame([(1, item, "x")], ITEMS)
    cut = {r.doc_id: r for r in decontaminate.decontaminated(docs(texts), table, 5, coverage=0.8).collect()}
    assert {i: r.text for i, r in cut.items()} == {0: "Start: ! End é", 2: "one two 漢", 3: None, 4: "nothing here"}
    assert cut[0].n_chars == len("Start: ! End é") and cut[4].n_chars == len(texts[4])
    long = {r.doc_id: r.text for r in decontaminate.decontaminated(docs(texts), table, 5, longest=6, coverage=1.0).collect()}
    assert long == dict(enumerate(texts))


def test_clashing_names(spark, docs):
    d = docs(["a b c"]).withColumn("leak", F.lit(1)).withColumn("__text", F.lit("t"))
    r = decontaminate.leaks(d, spark.createDataFrame([(1, "b", "x")], ITEMS)).first()
    assert r.leak.n_hit == 1 and r["__text"] == "t"
