"""Benchmark decontamination: a generalised suffix automaton of the test items' words.

The items are dealt to blocks of bounded length and one task builds the automaton of a block. Every text is streamed through it
word by word: the automaton's state and the length of the match give the longest passage of any item that ends at this word. From
`window` words on the whole match is a hit; an item of fewer words is hit where all of it stands. Each state of `window` words knows
its items. Spans and coverage then decide what is cut from a text and which texts go.

Texts are only read, never shuffled. What is broadcast is one block's automaton, at most 2 * (BLOCK_WORDS + PIECE_WORDS) states
whatever the size of the benchmark; a larger benchmark has more blocks, which the texts go through one after the other.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from payproof.llm.arrow import small, texts
from payproof.llm.steps import Steps
from payproof.llm.terms import WORD, folded
from payproof.scale import running

WINDOW = 10                  # words of an item that count as a leak
BLOCK_WORDS = 1 << 17        # words of items in one automaton
PIECE_WORDS = 1 << 15        # a longer item is cut into pieces that overlap by a window
STAGES = 4                   # automata that one pass over the texts goes through
SPANS = "array<struct<first:bigint,last:bigint>>"


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class Automaton:
    """All passages of some items' words. State 0 is the empty one; a state stands for passages that end at the same places."""

    def __init__(self, items: list[tuple[str | None, list[bytes], bool]], window: int = WINDOW):
        """items: (item id, words, whether these are all words of the item)."""
        self.window, self.ids = window, _Ids()
        self.length, self.link, steps = [0], [-1], [{}]
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words, _ in items]
        for words in coded:
            last = 0
            for w in words:
                last = self._grown(steps, last, w)
        self.step = {s * len(self.ids) + w: t for s, out in enumerate(steps) for w, t in out.items()}
        self._mark(items, coded)

    def _state(self, steps: list[dict], length: int, link: int, out: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        steps.append(out)
        return len(steps) - 1

    def _apart(self, steps: list[dict], p: int, w: int) -> int:
        """The state of p's longest passage followed by w: where the step leads, or a state split off it."""
        q = steps[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(steps, self.length[p] + 1, self.link[q], dict(steps[q]))
        self.link[q] = own
        while p >= 0 and steps[p].get(w) == q:
            steps[p][w] = own
            p = self.link[p]
        return own

    def _grown(self, steps: list[dict], last: int, w: int) -> int:
        if w in steps[last]:
            return self._apart(steps, last, w)
        new = self._state(steps, self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in steps[p]:
            steps[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._apart(steps, p, w)
        return new

    def _mark(self, items: list, coded: list[list[int]]) -> None:
        """Which windows end in a state: `leak` leads to the state of the last `window` words, `whole` to the next shorter state that is
        a short item; `owners` are the items of such states."""
        n, size = len(self.length), len(self.ids)
        owners: dict[int, set] = {}
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.leak, self.whole, short = [0] * n, [0] * n, set()
        for s in order:
            if self.length[s] >= self.window:
                up = self.link[s]
                self.leak[s] = s if self.length[up] < self.window else self.leak[up]
        for (name, _, all_), words in zip(items, coded, strict=True):
            s = 0
            for i, w in enumerate(words):
                s = self.step[s * size + w]
                if i + 1 >= self.window:
                    owners.setdefault(self.leak[s], set()).add(name)
            if all_ and 0 < len(words) < self.window:
                short.add(s)
                owners.setdefault(s, set()).add(name)
        for s in order:
            self.whole[s] = s if s in short else self.whole[self.link[s]]
        self.fewest = min([self.window, *[self.length[s] for s in short]]) if items else self.window
        self.owners = {s: tuple(x for x in names if x is not None) for s, names in owners.items()}

    def scan(self, text: bytes) -> tuple[int, list[list[int]], set[str]]:
        """(words, spans of hit words as first and last, items)."""
        n, at, state, matched, spans, states = 0, 0, 0, 0, [], set()
        size, step, length, link = len(self.ids), self.step, self.length, self.link
        for block in folded(text):
            words = block.split()
            if not words:
                continue
            n += len(words)
            ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
            # words of no item end every match: only runs of item words are walked, and those too short for any window aren't
            known = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]])))
            if not len(known) or known[0] > 0:
                state = matched = 0
            for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
                if a:
                    state = matched = 0
                if b - a + matched < self.fewest and b < len(words):
                    continue
                for i, w in enumerate(ids[a:b].tolist(), at + a):
                    to = step.get(state * size + w)
                    while to is None and state:
                        state = link[state]
                        matched = length[state]
                        to = step.get(state * size + w)
                    if to is None:
                        continue
                    state, matched = to, matched + 1
                    found = state if matched == length[state] else link[state]
                    inner = self.whole[found]
                    if matched >= self.window:
                        states.add(self.leak[state])
                        first = i - matched + 1
                    elif inner:
                        first = i - length[inner] + 1
                    else:
                        continue
                    while inner:
                        states.add(inner)
                        inner = self.whole[link[inner]]
                    while spans and spans[-1][0] >= first:
                        spans.pop()
                    if spans and spans[-1][1] >= first - 1:
                        spans[-1][1] = i
                    else:
                        spans.append([first, i])
            if len(known) and known[-1] < len(words):
                state = matched = 0
            at += len(words)
        return n, spans, {x for s in states for x in self.owners[s]}


def _pieces(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for name, text in zip(batch.column("item").to_pylist(), texts(batch), strict=True):
                words = [w for block in folded(text) for w in block.split()]
                starts = range(0, max(1, len(words) - window + 1), PIECE_WORDS)
                rows += [(name, i, len(p), b" ".join(p), len(starts) == 1) for i, s in enumerate(starts) if (p := words[s:s + PIECE_WORDS + window - 1])]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item", "piece", "n", "words", "all"])
    return run


def _built(window: int):
    def run(group: pa.Table) -> pa.Table:
        from pyspark import cloudpickle
        rows = sorted(zip(*[group.column(c).to_pylist() for c in ("words", "item", "all")], strict=True), key=lambda r: (r[0], r[1] or "", r[2]))
        made = Automaton([(name, words.split(), all_) for words, name, all_ in rows], window)
        return pa.table({"block": group.column("block")[:1], "automaton": pa.array([cloudpickle.dumps(made)], pa.binary())})
    return run


def automata(items: DataFrame, steps: Steps, window: int = WINDOW) -> Iterator[Automaton]:
    """The automata of all items (item_id, text), one block at a time; one without items if there are none."""
    from pyspark import cloudpickle
    pieces = steps.write(items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
                         .mapInArrow(_pieces(window), "item string, piece long, n long, words binary, all boolean"), tidy=False)
    place = running(pieces, [], [("slice", F.pmod(F.xxhash64("item", "piece", "words"), F.lit(4096)))], [F.col("words"), F.col("item"), F.col("piece")],
                    {"before": F.col("n")}, settle=False)
    blocks = steps.write(place.withColumn("block", F.floor(F.col("before") / BLOCK_WORDS)).groupBy("block").applyInArrow(_built(window), "block long, automaton binary"), tidy=False)
    numbers = range(blocks.agg(F.coalesce(F.max("block") + 1, F.lit(0)).alias("n")).first()["n"])
    found = 0
    for number in numbers:
        for row in blocks.where(F.col("block") == number).collect():       # one row, its size bounded by the block's words
            found += 1
            yield cloudpickle.loads(bytes(row["automaton"]))
    if not found:
        yield Automaton([], window)


def _merged(a: list, b: list) -> list:
    out: list = []
    for first, last in sorted(map(tuple, a + b)):
        if out and out[-1][1] >= first - 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _scanned(automaton, columns: list[str]):
    """Adds what this automaton finds to what earlier ones found."""
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = automaton.value
        for batch in small(batches, "__text"):
            spans, names, n_words = [], [], []
            before = zip(batch.column("__spans").to_pylist(), batch.column("__items").to_pylist(), strict=True)
            for text, (old, known) in zip(texts(batch, "__text"), before, strict=True):
                n, here, found = look.scan(text)
                spans.append([{"first": a, "last": b} for a, b in _merged(here, [(s["first"], s["last"]) for s in old])])
                names.append(sorted(found.union(known)))
                n_words.append(n)
            new = [pa.array(n_words, pa.int64()), pa.array(spans, spans_type), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + new, names=[*columns, "__n", "__spans", "__items"])
    return run


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, out: str = "leak", text: str = "text") -> DataFrame:
    """docs with a struct column `out`: n_words, n_hit, spans (first and last hit word of each, from 0), items (ids as text, sorted as text).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Words are runs of letters,
    digits and everything beyond ASCII, with A-Z in lower case. Every word inside an occurrence of a window is hit. A null text has
    no words. Items with one item_id are one item with the windows of each; an item without item_id hits words but isn't
    listed. Repeated rows of docs each get their result, and an empty table gives an empty one. All other columns stay; one
    named like `out` is replaced. Texts of any length are streamed in blocks."""
    spark = docs.sparkSession
    steps, others = Steps(spark), [c for c in docs.columns if c != out]
    names = [f"__{i}" for i in range(len(others))]
    renamed = [F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)]
    at = docs.select(*renamed, F.col(text).cast("string").alias("__text"), F.lit(0).cast("long").alias("__n"), F.array().cast(SPANS).alias("__spans"), F.array().cast("array<string>").alias("__items"))
    schema = at.schema
    for i, automaton in enumerate(automata(items, steps, window)):
        if i and i % STAGES == 0:
            at = steps.write(at)
        at = at.mapInArrow(_scanned(spark.sparkContext.broadcast(automaton), [*names, "__text"]), schema)
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    found = F.struct(F.col("__n").alias("n_words"), hit.alias("n_hit"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))
    return at.select(*[F.col(n).alias(c) for c, n in zip(others, names, strict=True)], found.alias(out))


@F.pandas_udf(StringType())
def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the bytes from each span's first word to its last."""
    def cut(t: str, gone) -> str:
        raw, ends, at, kept = t.encode(), iter(gone), 0, []
        span = next(ends, None)
        for i, m in enumerate(WORD.finditer(raw)):
            if span is None:
                break
            if i == span["first"]:
                kept.append(raw[at:m.start()])
            if i == span["last"]:
                at, span = m.end(), next(ends, None)
        return b"".join([*kept, raw[at:]]).decode()
    return text.combine(spans, lambda t, s: t if t is None or not len(s) else cut(t, s))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, longest: int = 0, coverage: float = 0.5, text: str = "text") -> DataFrame:
    """docs without leaked passages: hit spans of more than `longest` words are cut from the text, and documents of which more than the
    share `coverage` of words is hit go altogether. The columns are those of docs; n_chars, if there is one, counts what is left of a cut text."""
    found = leaks(docs, items, window, "__leak", text).where("__leak.n_hit <= __leak.n_words * %r" % coverage)
    gone = F.filter("__leak.spans", lambda s: s["last"] - s["first"] + 1 > longest)
    cut = found.withColumn("__cut", F.when(F.size(gone) > 0, _without(F.col(text), gone)))
    columns = {text: F.coalesce("__cut", text)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("__cut").isNull(), F.col("n_chars")).otherwise(F.char_length("__cut")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumns(columns).select(*docs.columns)


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)
