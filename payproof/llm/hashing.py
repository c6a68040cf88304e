"""Hashes of words, of runs of words and of runs of bytes, over numpy arrays inside a task.

A run of tokens x[s:e] is named by (P[e] - P[s]) * r**-s with P the running sum of x[i] * r**i modulo 2**64, so that any
run of any length costs two lookups. Two bases give 128 bits."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BLOCK = 1 << 20                     # tokens handled at once; a longer text goes through in blocks of as many
PIECE = 1 << 18                     # bytes of short texts whose words are hashed at once
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, U(base)), np.full(size, U(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


class Runs:
    """Names of runs x[s:e] of one array of tokens."""

    def __init__(self, x: np.ndarray):
        self.x, self.sums = x, {}

    def name(self, s: np.ndarray, e: np.ndarray, base: int = BASES[0]) -> np.ndarray:
        up, down = powers(base, len(self.x) + 1)
        if base not in self.sums:
            self.sums[base] = np.concatenate([np.zeros(1, U), np.cumsum(self.x * up[:len(self.x)], dtype=U)])
        p = self.sums[base]
        return mix((p[e] - p[s]) * down[s] + U(BASES[1]) * (np.asarray(e) - s).astype(U))

    def grams(self, k: int) -> np.ndarray:
        """The name of x[i:i+k] for every i that has k tokens."""
        n = len(self.x) - k + 1
        if n <= 0:
            return np.zeros(0, U)
        up, down = powers(BASES[0], len(self.x) + 1)
        if BASES[0] not in self.sums:
            self.sums[BASES[0]] = np.concatenate([np.zeros(1, U), np.cumsum(self.x * up[:len(self.x)], dtype=U)])
        p = self.sums[BASES[0]]
        return mix((p[k:] - p[:n]) * down[:n] + U(BASES[1] * k % 2**64))


def lowest_in_window(g: np.ndarray, w: int) -> np.ndarray:
    """For every i the place of the smallest of g[i:i+w], the first of equals: two windows with equal contents choose
    the same place in them. g has at most 2**21 entries."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (g >> U(21) << U(21)) | np.arange(len(g), dtype=U)
    pad = np.concatenate([key, np.full(-len(key) % w, ~U(0))]).reshape(-1, w)
    left = np.minimum.accumulate(pad, axis=1).ravel()                       # from the start of its block to i
    right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()    # from i to the end of its block
    return (np.minimum(right[:n], left[w - 1:w - 1 + n]) & U((1 << 21) - 1)).astype(np.int64)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text's bytes."""
    ink = np.concatenate([[False], ~SPACE[data], [False]])
    edge = np.flatnonzero(ink[1:] != ink[:-1])
    return edge[::2], edge[1::2]


def _joined(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Texts joined into pieces of about PIECE bytes, or blocks of one of more than BLOCK bytes, words whole: (first text, texts, bytes); a long text's pieces have 0 texts but its last."""
    first, group, size = 0, [], 0
    for i, t in enumerate(texts):
        if len(t) > BLOCK:
            if group:
                yield first, len(group), b"\n".join(group) + b"\n"
            at = 0
            while len(t) - at > BLOCK:
                cut = at + BLOCK
                while cut < len(t) and not SPACE[t[cut]]:
                    cut += 1
                yield i, 0, t[at:cut]
                at = cut
            yield i, 1, t[at:] + b"\n"
            first, group, size = i + 1, [], 0
            continue
        group.append(t)
        size += len(t) + 1
        if size >= PIECE:
            yield first, len(group), b"\n".join(group) + b"\n"
            first, group, size = i + 1, [], 0
    if group:
        yield first, len(group), b"\n".join(group) + b"\n"


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other, and each text's number of words."""
    counts, out = np.zeros(len(texts), np.int64), [np.zeros(0, U)]
    for first, n, data in _joined(texts):
        raw = np.frombuffer(data, np.uint8)
        s, e = word_spans(raw)
        out.append(Runs(BYTE[raw]).name(s, e))
        if n <= 1:
            counts[first] += len(s)
        else:
            ends = np.cumsum([len(t) + 1 for t in texts[first:first + n]])
            counts[first:first + n] = np.bincount(np.searchsorted(ends, s, side="right"), minlength=n)
    return np.concatenate(out), counts


def pieces(tokens: np.ndarray, counts: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole texts together up to BLOCK tokens, and blocks of longer texts that overlap by `overlap` tokens so that every
    run of overlap + 1 tokens is in one. Gives (tokens, text of each part, its first token's place in the text, its end in the piece)."""
    ends = np.cumsum(counts)
    i = 0
    while i < len(counts):
        at = ends[i] - counts[i]
        if counts[i] > BLOCK:
            for b in range(0, int(counts[i]) - overlap, BLOCK - overlap):
                part = tokens[at + b:min(at + b + BLOCK, ends[i])]
                yield part, np.array([i]), np.array([b]), np.array([len(part)])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, at + BLOCK, side="right")))
        yield tokens[at:ends[j - 1]], np.arange(i, j), np.zeros(j - i, np.int64), ends[i:j] - at
        i = j


def shared_seeds(x: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of every run of `length` tokens that lies in one part (the parts end at `ends`): the lowest k-gram of the run.
    Equal runs have equal seeds, wherever they stand. Neighbouring runs with one seed make a stretch.
    Gives the runs' names, and by stretch: its part, its first run, its last run, the name of its seed."""
    runs = Runs(x)
    g = runs.grams(k)
    low = lowest_in_window(g, length - k + 1)
    if not len(low):
        none = np.zeros(0, np.int64)
        return runs, none, none, none, np.zeros(0, U)
    at = np.arange(len(low))
    part = np.searchsorted(ends, at, side="right")
    ok = np.flatnonzero(at + length <= ends[part])
    if not len(ok):
        return runs, ok, ok, ok, np.zeros(0, U)
    new = np.flatnonzero(np.concatenate([[True], (low[ok][1:] != low[ok][:-1]) | (ok[1:] != ok[:-1] + 1) | (part[ok][1:] != part[ok][:-1])]))
    last = np.concatenate([new[1:], [len(ok)]]) - 1
    return runs, part[ok[new]], ok[new], ok[last], g[low[ok[new]]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)
