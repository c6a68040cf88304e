import math
import random
import re
import string
import zlib
from collections import Counter

from pyspark.sql import functions as F

from helpers_llm import corpus, docs  # noqa: F401
from payproof.llm import rules


def labelled(seed, n=400):
    rnd = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        w = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(rnd.randrange(15, 60))]
        texts.append(" ".join(x + ("" if good else rnd.choice(["***", "$$$", "!!"])) for x in w))
        labels.append((i, int(good), 0))
    return texts, labels


def test_held_out_accuracy_without_leakage(spark, docs):
    texts, labels = labelled(1)
    table = docs(texts + ["", None])
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    truth = {i: q for i, q, _ in labels}
    marks = spark.createDataFrame([*labels, (3, None, 1), (None, 1, 0), (10**6, 0, 0)], "doc_id long, quality int, toxic int")
    scored, fitted = rules.scored(table, marks)
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in got.values())
    mine = [i for i in truth if held(i)]
    assert sum((got[i].score >= 0.5) == truth[i] for i in mine) >= 0.95 * len(mine)
    assert 0 < sum(w != 0 for w in fitted.weights) < len(fitted.weights)
    # other labels on the held-out rows change nothing
    turned = spark.createDataFrame([(i, 1 - q if held(i) else q, 0) for i, q, _ in labels] + [(3, None, 1)], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in rules.scored(table, turned)[0].collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in rules.scored(docs(["a", None]), none)[0].collect()] == [0.5, 0.5]
    assert rules.scored(docs([]), none)[0].collect() == []


def statistics_of(text):
    """The statistics of a text, counted plainly."""
    text = text or ""
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    lines = text.split("\n")
    seen, dup_lines = set(), 0
    for line in lines:
        if re.search(r"[^ \t-\r]", line):
            dup_lines += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    chars, n = sum(map(len, words)), len(words)
    count = lambda wanted: sum(c in wanted for c in text)
    per = lambda a, b: a / max(b, 1)
    return {"n_words": n, "word_length": per(chars, n), "symbols": per(count("#*$%&|<>"), chars), "capitals": per(count(string.ascii_uppercase), chars),
            "digits": per(count(string.digits), chars), "marks": per(count("!?.,;:|-_=~^@/\\()[]{}\"'"), chars), "dup_lines": per(dup_lines, len(lines)),
            "repeats": per(len(repeated), n), "line_words": per(n, len(lines)), "distinct": per(len(set(words)), n)}


def test_scores_against_brute_force(spark, docs):
    texts, labels = labelled(2)
    odd = ["A-1 {x} [y] \"z\" 'q' \\ ^ ~", "one two three four five six\none two three four five six\n\n\n", "é漢😀 ABC\tABC\x0bABC", "word " * 30000, "a\nb\na\nb\na"]
    texts += [*corpus(5, 60), *odd, *odd]                   # nulls, empty, very long and repeated texts
    table = docs(texts, [*range(400), *[None if i % 17 == 3 else 400 + i for i in range(len(texts) - 400)]])
    marks = spark.createDataFrame([*labels, (401, 1, 0), (401, 0, 0)], "doc_id long, quality int, toxic int")
    scored, fitted = rules.scored(table, marks)
    assert any(fitted.weights)
    want = []
    for r in table.select("doc_id", "text").collect():
        s = statistics_of(r.text)
        total = fitted.constant + sum(w for p, w in zip(fitted.paths, fitted.weights) if all((s[n] > at) == above for n, above, at in p))
        want.append((-1 if r.doc_id is None else r.doc_id, *[round(s[n], 9) for n in rules.STATISTICS], round(1 / (1 + math.exp(-total)), 9)))
    got = [(-1 if r.doc_id is None else r.doc_id, *[round(r[n], 9) for n in rules.STATISTICS], round(r.score, 9)) for r in scored.collect()]
    assert sorted(got) == sorted(want)
