"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of sign flips and a fast Hadamard transform; a vector's hash is the axis (with sign) nearest to
the rotated vector. Two hashes make a table's bucket. Multiprobe: a vector enters its own bucket and the two buckets in which
one hash is its second nearest axis. In one table a pair of cosine 0.93 shares a bucket with probability 0.72; sixteen
tables miss one pair in 10**9. Every candidate pair is verified by its cosine in double precision.

Equal vectors are one class, counted instead of paired. The members of a bucket are dealt into blocks of about 256; a task compares
two blocks by one matrix product and returns, for each member, how many vectors it is linked with and one edge to its
component within the blocks, never the pairs. So a dense bucket becomes many equal tasks whose results are as long as their inputs.
A pair that meets in several tables counts only in the first."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payproof.llm.graph import components
from payproof.llm.steps import Steps

COSINE = 0.93
TABLES, PROBES = 16, 3
BLOCK = 256          # members of a bucket that a task compares with as many others
SMALL = 32           # groups up to this size are compared together


def rotated(v: np.ndarray, seed: int) -> np.ndarray:
    """Rows of v (a power of two long) after a random rotation."""
    sign = np.random.default_rng(seed)
    for _ in range(3):
        v, h = v * sign.choice([-1.0, 1.0], v.shape[1]), 1
        while h < v.shape[1]:
            v = v.reshape(len(v), -1, 2, h)
            v = np.concatenate([v[:, :, :1] + v[:, :, 1:], v[:, :, :1] - v[:, :, 1:]], 2).reshape(len(v), -1)
            h *= 2
    return v


def _axes(v: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and the second nearest axis: its number, and v's length more if it points backwards."""
    r, rows = rotated(v, seed), np.arange(len(v))
    out = []
    for _ in range(2):
        i = np.abs(r).argmax(1)
        out.append(np.where(r[rows, i] < 0, i + v.shape[1], i))
        r = r.copy()
        r[rows, i] = 0
    return out[0], out[1]


def buckets(v: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """The buckets of each row of v: PROBES for each table."""
    wide = np.zeros((len(v), max(2, 1 << (v.shape[1] - 1).bit_length())))
    wide[:, :v.shape[1]] = v
    out = np.empty((len(v), tables * PROBES), np.int64)
    for t in range(tables):
        (a, a2), (b, b2) = _axes(wide, 2 * t), _axes(wide, 2 * t + 1)
        n = 2 * wide.shape[1]
        out[:, t * PROBES:(t + 1) * PROBES] = np.stack([a * n + b, a2 * n + b, a * n + b2], 1) + t * n * n
    return out


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vec, n = batch.column("vec"), batch.num_rows
        size = np.diff(vec.offsets.to_numpy())
        flat, at = vec.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(size) - size
        out = np.zeros((n, TABLES * PROBES), np.int64)
        for d in np.unique(size):                        # one length, but for odd tables
            rows = np.flatnonzero(size == d)
            v = flat[at[rows][:, None] + np.arange(d)]
            out[rows] = buckets(v / np.abs(v).max(1, keepdims=True))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "k", "label", "m", "vec")],
                                          pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))],
                                         names=["id", "k", "label", "m", "vec", "buckets"])


def _rows(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


KEY = ["label", "size", "bucket", "bi", "bj"]


def _near_pairs(v: np.ndarray, length: np.ndarray, group: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows x < y of one group (its rows follow each other) that are near. Large groups by a matrix product; the
    rows of all small ones are compared with the next of their group, then with the next but one, and so on."""
    xs, ys = [], []
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([starts, [len(group)]]))
    for at, n in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        part = v[at:at + n]
        x, y = np.nonzero(np.triu(part @ part.T >= cosine * length[at:at + n, None] * length[None, at:at + n], 1))
        xs.append(x + at)
        ys.append(y + at)
    left = np.repeat(starts + size, size) - np.arange(len(group))           # rows of the group from this one on
    x = np.flatnonzero((np.repeat(size, size) <= SMALL) & (left > 1))
    for step in range(1, SMALL):
        for part in np.array_split(x, len(x) // 50_000 + 1):
            near = part[np.einsum("ij,ij->i", v[part], v[part + step]) >= cosine * length[part] * length[part + step]]
            xs.append(near)
            ys.append(near + step)
        x = x[left[x] > step + 1]
        if not len(x):
            break
    return np.concatenate(xs), np.concatenate(ys)


def _compared(rows: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of some groups, sorted by KEY: how many vectors it is linked with in its group, and the first row of its component there."""
    n = rows.num_rows
    col = {c: rows.column(c).to_numpy() for c in [*KEY, "side", "at", "m"]}
    group = np.cumsum(np.concatenate([[False], np.logical_or.reduce([col[c][1:] != col[c][:-1] for c in KEY])]))
    links, first, old = np.zeros(n), np.arange(n), None
    vec, places = rows.column("vec").combine_chunks(), _rows(rows.column("buckets").combine_chunks())
    cut = vec.offsets.to_numpy()
    flat, xs, ys = vec.flatten().to_numpy(zero_copy_only=False), [], []
    for d in np.unique(col["size"]):                     # one length, but for odd tables
        own = np.flatnonzero(col["size"] == d)
        v = flat[(cut[:-1] - cut[0])[own][:, None] + np.arange(d)].astype(float)
        v = np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])      # exact, and its square can't overflow
        x, y = _near_pairs(v, np.sqrt((v * v).sum(1)), group[own], cosine)
        xs.append(own[x])
        ys.append(own[y])
    x, y = np.concatenate(xs), np.concatenate(ys)
    other = (col["bi"][x] == col["bj"][x]) | (col["side"][x] != col["side"][y])          # of two blocks, pairs across
    x, y = x[other], y[other]
    for t in range(TABLES):                              # a pair counts in the first table where it meets, there in its lowest bucket
        table = col["at"][x] // PROBES
        p, q = (places[:, t * PROBES:(t + 1) * PROBES][i] for i in (x, y))
        met = (p[:, :, None] == q[:, None, :]).any(2)
        take = (table < t) | np.where(table > t, ~met.any(1), np.where(met, p, np.iinfo(np.int64).max).min(1) == col["bucket"][x])
        x, y = x[take], y[take]
    links += np.bincount(x, col["m"][y], n) + np.bincount(y, col["m"][x], n)
    while old is None or (old != first).any():
        old = first.copy()
        np.minimum.at(first, x, old[y])
        np.minimum.at(first, y, old[x])
    return links.astype(np.int64), first


def _links(cosine: float):
    def done(rows: pa.Table) -> pa.RecordBatch:
        links, first = _compared(rows, cosine)
        some = np.flatnonzero(links)
        ids = rows.column("id").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(rows.column("k").to_numpy()[some]), pa.array(ids[first[some]]), pa.array(links[some])],
                                          names=["id", "k", "first", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []                  # rows whose last group may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in KEY]
            same = not held or all(held[-1].column(c)[-1] == batch.column(c)[0] for c in KEY)
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
            last = int(cuts[-1]) if len(cuts) else 0     # where this batch's last group begins
            if last or not same:
                yield done(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield done(pa.Table.from_batches(held))
    return run, "id long, k long, first long, links long"


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): n_links (other vectors linked directly), component_id (the smallest
    vec_id reachable by links, its own included), kept (vec_id = component_id).

    Two vectors are linked if their labels are equal and not null, they are equally long, and their cosine in double
    precision is `cosine` or more. A null, empty or zero vector, or one with a null or non-finite component, is linked with
    nothing, and so is a row without vec_id (its component is null and it is kept). Rows with one vec_id are one node of the
    components, but vectors of their own in n_links. An empty table gives an empty result; other columns are ignored. A
    smaller `cosine` needs more tables."""
    steps = Steps(vectors.sparkSession)
    vec = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    all_rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.when(fine, F.transform(vec, lambda x: x + 0.0)).alias("vec"), F.col("label").cast("long").alias("label"))
    all_rows = steps.write(all_rows.withColumn("k", F.xxhash64("label", "vec")))
    classes = all_rows.where("vec IS NOT NULL").groupBy("label", "vec", "k").agg(F.min("id").alias("id"), F.count("*").alias("m"))
    classes = steps.write(classes.select("id", "k", "label", "m", "vec").mapInArrow(_hash, "id long, k long, label long, m long, vec array<double>, buckets array<long>"))
    entries = classes.select("label", F.size("vec").alias("size"), "id", "k", F.posexplode("buckets").alias("at", "bucket"))
    place = ["label", "size", "bucket"]
    crowded = entries.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    dealt = entries.join(crowded, place).withColumn("side", F.pmod(F.xxhash64("k", "id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(*place, F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "side", "at", "id", "k")
    key = [*place, "bi", "bj"]
    met = dealt.join(classes.select("id", "k", "m", "vec", "buckets"), ["id", "k"]).select(*key, "side", "at", "id", "k", "m", "vec", "buckets")
    found = steps.write(met.repartition(*key).sortWithinPartitions(*key).mapInArrow(*_links(cosine)))
    counts = found.groupBy("id", "k").agg(F.sum("links").alias("links"))
    sizes = classes.select("id", "k", "m").join(counts, ["id", "k"], "left").select("k", F.col("id").alias("rep"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = all_rows.select("id", F.when(F.col("vec").isNotNull(), F.col("k")).alias("k"))
    named = steps.write(named.join(sizes, "k", "left"))
    edges = found.select(F.col("id").alias("a"), F.col("first").alias("b")).union(named.where("rep IS NOT NULL").select("id", "rep"))
    part = components(steps, edges).withColumnRenamed("node", "id")
    return (named.select("id", "n_links").join(part, "id", "left")
            .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
