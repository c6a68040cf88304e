"""Token ids packed into rows of a fixed length: best fit decreasing.

Each task packs the documents it has read, so nothing is shuffled and more executors pack more at once. A task goes through its
input in shards of some thousand pieces, longest first: a piece goes into the row with the least room that is
enough, found in a segment tree over the amounts of room. Documents longer than a row are split into whole rows and a rest, in order;
nothing is dropped.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payproof.llm.arrow import small, texts

LENGTH = 2048
SHARD = 4 << 20      # token ids packed together: what a task holds at once


class Room:
    """Rows by the room they have left, in a segment tree: each node counts the rows below it."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room of at least `need`, and that room."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):        # up until a right neighbour holds a row
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Pieces by row; sizes are at most `length`. Longest first, equal ones in order."""
    room, rows = Room(length), []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[piece])
        found = room.take(need)
        if found is None:
            found = len(rows), length
            rows.append([])
        rows[found[0]].append(piece)
        if found[1] > need:
            room.put(found[0], found[1] - need)
    return rows


def _packed(ids: list[np.ndarray], doc: list, length: int, pad: int) -> Iterator[tuple]:
    """For each row: its ids, the cumulative lengths of its segments, positions that begin anew in each, and of each segment the
    document and its place in it."""
    pieces = [(i, s, x[s:s + length]) for i, x in enumerate(ids) for s in range(0, len(x), length)]
    for row in best_fit(np.array([len(p) for _, _, p in pieces], np.int64), length):
        parts = [pieces[i] for i in row]
        ends = np.cumsum([0, *[len(p) for _, _, p in parts]])
        rest = np.full(length - ends[-1], pad, np.uint32)
        at = np.concatenate([*[np.arange(len(p), dtype=np.int32) for _, _, p in parts], np.zeros(len(rest), np.int32)])
        yield np.concatenate([*[p for _, _, p in parts], rest]), ends, at, [doc[i] for i, _, _ in parts], [s for _, s, _ in parts]


def pack(docs: DataFrame, encode: Callable[[], Callable[[str], np.ndarray]], pad: int, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text) as rows of `length` token ids: ids (little-endian unsigned 32-bit integers, padded with `pad`), n_tokens
    (without padding), cu_seqlens (0, then the end of each segment), position_ids (little-endian signed 32-bit integers that
    begin anew with each segment), doc_ids and starts (each segment's document, and the place of its first id in it).

    encode() is called in each worker and gives the function from text to ids. Every id of every document is in one row:
    segments of one document (doc_id and, in a task, its order) put together by their starts give it back. A document
    without ids (null or empty text) is in no row; null and repeated doc_ids are packed like others. An empty table gives an
    empty result; other columns are ignored. Which documents share a row depends on how the input is read; reruns over
    the same files agree."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def shard(ids: list, doc: list) -> pa.RecordBatch:
        rows = list(_packed(ids, doc, length, pad))
        return pa.RecordBatch.from_arrays([
            pa.array([r[0].astype("<u4").tobytes() for r in rows], pa.binary()), pa.array([int(r[1][-1]) for r in rows], pa.int64()),
            pa.array([r[1].tolist() for r in rows], pa.list_(pa.int32())), pa.array([r[2].astype("<i4").tobytes() for r in rows], pa.binary()),
            pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array([r[4] for r in rows], pa.list_(pa.int64()))],
            names=["ids", "n_tokens", "cu_seqlens", "position_ids", "doc_ids", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, ids, doc, held = encode(), [], [], 0
        for batch in small(batches):
            for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                x = to_ids(t.decode())
                if len(x):
                    ids.append(np.asarray(x, np.uint32))
                    doc.append(i)
                    held += len(x)
                if held >= SHARD:
                    yield shard(ids, doc)
                    ids, doc, held = [], [], 0
        if ids:
            yield shard(ids, doc)
    return docs.mapInArrow(run, "ids binary, n_tokens long, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>")


def write_matrices(packed: DataFrame, folder: str) -> None:
    """Parquet files of the rows: each file a matrix of ids with its cumulative lengths and positions, readable without Spark."""
    packed.write.option("compression", "zstd").mode("overwrite").parquet(folder)
