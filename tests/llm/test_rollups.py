import random
import uuid
from collections import defaultdict

import pytest

from payproof.llm.rollups import EVENT, Rollup


def brute(batches):
    held = {}
    for events in batches:
        by = defaultdict(list)
        for e in set(events):
            if e[0] is not None and e[3] is not None and e[4] in ("insert", "revise", "delete"):
                by[e[0], e[3]].append(e)
        for key, es in by.items():
            e = max(es, key=lambda e: (e[4] == "delete", e[5] or 0))
            held.pop(key, None)
            if e[4] != "delete":
                held[key] = (e[1], e[2], e[5] or 0)
    out = defaultdict(lambda: [0, 0])
    for (_, version), (source, lang, n) in held.items():
        out[source, lang, version][0] += 1
        out[source, lang, version][1] += n
    return {k: tuple(v) for k, v in out.items()}


def totals(r):
    return {(t.source, t.lang, t.version): (t.docs, t.tokens) for t in r.totals().collect()}


def test_batches_replays_and_broken_commits(spark, tmp_path):
    rnd = random.Random(1)
    event = lambda: (rnd.choice([None, *range(30)]), None, "en", rnd.choice(["v1", "v2", None]), rnd.choice(["insert", "revise", "delete", "odd"]), rnd.choice([None, 1, 5, 70]))
    batches = []
    for _ in range(4):
        events, seen = [], set()
        for _ in range(40):
            e = event()
            if (e[0], e[3]) not in seen:                       # a source for each document and batch
                seen.add((e[0], e[3]))
                events.append((e[0], rnd.choice([None, "s1", "s2"]), *e[2:]))
        batches.append(events + events[:5])
    r = Rollup(spark, str(tmp_path / uuid.uuid4().hex))
    assert totals(r) == {}
    for number, events in enumerate(batches):
        frame = spark.createDataFrame(events, EVENT)
        assert r.commit(number, frame)
        assert not r.commit(number, frame)                     # a replay
        assert totals(r) == brute(batches[:number + 1])
    with pytest.raises(ValueError):
        Rollup(spark, r.folder).commit(-1, frame)


def test_a_commit_that_broke_off(spark, tmp_path):
    r = Rollup(spark, str(tmp_path / "r"))
    r.commit(1, spark.createDataFrame([(1, "s", "en", "v", "insert", 5)], EVENT))
    (tmp_path / "r" / "done" / "1").unlink()                   # as if it had stopped before its marker
    assert totals(r) == {}
    assert r.commit(1, spark.createDataFrame([(1, "s", "en", "v", "insert", 5)], EVENT)) and totals(r) == {("s", "en", "v"): (1, 5)}
    assert r.commit(2, spark.createDataFrame([], EVENT)) and totals(r) == {("s", "en", "v"): (1, 5)}
    assert r.commit(3, spark.createDataFrame([(1, "s", "en", "v", "delete", None)], EVENT)) and totals(r) == {}
