"""Embedding near-dedup: a pivot-permutation index, exact cosine, components.

A few reference vectors (pivots) are drawn from a bounded sample, leaving out those
close to one already drawn. Every vector is described by its nearest pivots. The
inverted lists are keyed by sets of pivots_shared pivots, one list for each such set
among a vector's nearest, so two vectors meet in a list exactly if they share that many
pivots; they are then verified by cosine in double precision. A pair that meets in
several lists counts in the first of them only.

A long list is cut into blocks of block rows and dealt out as pairs of blocks, so no
task holds more than two blocks at a time. Each task returns link counts and a spanning
forest of its links, not the pairs themselves.

How many pivots describe a vector, and how many key a list, follows the number of rows,
so that lists stay short: list_size(). More of both find more, see the tests.

Vectors that are null, zero, or hold null or non-finite components link with nothing.
Vectors are compared with those of their own length; the pivots of lengths other than
the sample's commonest are random directions. Rows that repeat a vec_id are one vector,
the smallest of them; rows with a null vec_id are left out. Ties of cosine at the
threshold link. Vectors of any length are read whole. Columns other than vec_id and
embedding, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dealt_in_blocks, dropped, in_groups, saved, small_batches, smallest_hashes

#: Rows of the sample that pivots are drawn from (those with the smallest hashes of vec_id); all rows are indexed.
SAMPLE = 4096


def clean(v: list | None) -> np.ndarray | None:
    """The vector in double precision, or None if it can't be compared."""
    if not v or any(x is None for x in v):
        return None
    a = np.asarray(v, dtype=np.float64)
    if not np.isfinite(a).all() or not a.any():
        return None
    return a


def directions(n: int, dims: int) -> np.ndarray:
    """n random directions, the same each time."""
    out = np.random.default_rng(17).normal(size=(n, dims))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def choose_pivots(vectors: DataFrame, n: int = 128, apart: float = 0.7) -> np.ndarray:
    """n pivots of unit length at most, from the sample; where fewer than n are apart, the rest are random directions from a fixed seed."""
    if not 1 <= n <= 256:
        raise ValueError("from 1 to 256 pivots: a byte numbers them")
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding", F.xxhash64("vec_id").alias("h"))
    # ids first, so that no more vectors than the sample's leave their tasks
    most = smallest_hashes(rows.select("h").distinct(), "h", SAMPLE)
    sample = sorted((r.h, r.vec_id, r.embedding) for r in (rows if most is None else rows.where(F.col("h") <= most)).collect())
    found = [a for *_, v in sample if (a := clean(v)) is not None]
    if not found:
        return np.zeros((0, 0))
    sizes, counts = np.unique([len(a) for a in found], return_counts=True)
    dims = int(sizes[np.argmax(counts)])
    out = np.zeros((n, dims))
    at = 0
    for a in found:
        if len(a) == dims and at < n:
            unit = a / np.linalg.norm(a)
            if not at or float((out[:at] @ unit).max()) < apart:
                out[at] = unit
                at += 1
    out[at:] = directions(n - at, dims)
    return out


def list_size(rows: int, pivots: int, most: int = 1024) -> tuple[int, int]:
    """(nearest, shared): how many pivots describe a vector and how many key a list, so that lists of evenly spread vectors hold at most most rows."""
    for nearest, shared in ((6, 2), (8, 3), (10, 4), (12, 5)):
        if rows * comb(nearest, shared) <= most * comb(pivots, shared):
            return nearest, shared
    return 12, 5


def describe(vectors: DataFrame, pivots: np.ndarray, nearest: int, shared: int) -> DataFrame:
    """(vec_id, nearest pivots as bytes, vector as doubles' bytes, list keys) of each vector that can be compared."""
    small_batches(vectors.sparkSession)
    n, dims = pivots.shape
    subsets = np.array(list(combinations(range(nearest), shared)))
    base = n ** np.arange(shared - 1, -1, -1, dtype=np.int64)
    out = pa.schema([("vec_id", pa.int64()), ("near", pa.binary()), ("vec", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        of = {dims: pivots}
        for batch in batches:
            by_length: dict[int, list] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = clean(v)
                if a is not None:
                    by_length.setdefault(len(a), []).append((i, a / np.abs(a).max()))
            for length, found in by_length.items():
                if length not in of:
                    of = {dims: pivots, length: directions(n, length)}
                x = np.array([a for _, a in found])
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                near = np.sort(np.argsort(-(unit @ of[length].T), axis=1, kind="stable")[:, :nearest], axis=1)
                # lists of other lengths are others
                keys = (near[:, subsets] * base).sum(axis=2) + (0 if length == dims else length * n**shared)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([r.tobytes() for r in near.astype("u1")]), pa.array([r.tobytes() for r in unit]), pa.array(list(keys), pa.list_(pa.int64()))], schema=out)

    return vectors.mapInArrow(run, "vec_id long, near binary, vec binary, keys array<long>")


def _first_keys(near_a: np.ndarray, near_b: np.ndarray, shared: int, base: np.ndarray) -> np.ndarray:
    """The first list that both of each pair are in: that of their smallest shared pivots."""
    both = (near_a[:, :, None] == near_b[:, None, :]).any(axis=2)
    rank = np.cumsum(both, axis=1)
    key = np.zeros(len(near_a), dtype=np.int64)
    for k in range(shared):
        at = np.argmax(both & (rank == k + 1), axis=1)
        key += near_a[np.arange(len(near_a)), at].astype(np.int64) * base[k]
    return key


def _links(ids, near, unit, rows_a, rows_b, same, key, threshold, shared, base):
    """Counts of the links between two sets of rows that are this list's to count, and forest edges over all links there."""
    n = np.zeros(len(ids), dtype=np.int64)
    label = np.arange(len(ids))
    found_a, found_b = [], []
    for s in range(0, len(rows_a), 256):
        part = rows_a[s : s + 256]
        hit = unit[part] @ unit[rows_b].T >= threshold
        i, j = np.nonzero(hit)
        i, j = part[i], rows_b[j]
        keep = i < j if same else i != j
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        found_a.append(i)
        found_b.append(j)
        for t in range(0, len(i), 100_000):
            a, b = i[t : t + 100_000], j[t : t + 100_000]
            mine = _first_keys(near[a], near[b], shared, base) == key
            np.add.at(n, a[mine], 1)
            np.add.at(n, b[mine], 1)
    if found_a:
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
    return n, label


def link(described: DataFrame, rows: int, pivots: int, nearest: int, shared: int, threshold: float = 0.9, block: int = 2048) -> DataFrame:
    """(kind, x, y): kind 0: vector x has y further links; kind 1: an edge of a spanning forest."""
    base = pivots ** np.arange(shared - 1, -1, -1, dtype=np.int64)
    met = described.select("vec_id", "near", "vec", F.explode("keys").alias("key"))
    dealt = dealt_in_blocks(met, "key", "vec_id", block, met=rows * comb(nearest, shared))
    out = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64())])

    def group(rows: pa.Table):
        key, lo, hi = (rows.column(c)[0].as_py() for c in ("key", "lo", "hi"))
        key %= pivots**shared
        ids = rows.column("vec_id").to_numpy()
        if len(ids) < 2:
            return None
        near = np.frombuffer(b"".join(rows.column("near").to_pylist()), "u1").reshape(len(ids), -1)
        unit = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float64).reshape(len(ids), -1)
        every = np.arange(len(ids))
        if lo == hi:
            n, label = _links(ids, near, unit, every, every, True, key, threshold, shared, base)
        else:
            own = rows.column("own").to_numpy()
            n, label = _links(ids, near, unit, every[own == lo], every[own == hi], False, key, threshold, shared, base)
        c, e = np.flatnonzero(n), np.flatnonzero(label != every)
        if not len(c) and not len(e):
            return None
        return np.repeat([0, 1], [len(c), len(e)]).astype(np.int32), np.concatenate([ids[c], ids[e]]), np.concatenate([n[c], ids[label[e]]])

    def run(batches):
        for rows in in_groups(batches):
            if g := group(rows):
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in g], schema=out)

    return dealt.mapInArrow(run, "kind int, x long, y long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, pivots: int = 128, lists: tuple[int, int] | None = None) -> DataFrame:
    """vectors (vec_id, embedding) to (vec_id, n_links, component_id, kept): one row for each distinct vec_id. lists: nearest and shared pivots, by default those of list_size()."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = saved(rows, "vectors")
    chosen = choose_pivots(rows, pivots)
    links = None
    if len(chosen):
        n = rows.count()
        nearest, shared = lists or list_size(n, pivots)
        described = saved(describe(rows, chosen, nearest, shared), "described")
        links = saved(link(described, n, pivots, nearest, shared, threshold), "links")
        counts = links.where("kind = 0").groupBy(F.col("x").alias("vec_id")).agg(F.sum("y").alias("n_links"))
        dropped(vectors.sparkSession, described)
        groups = components(links.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("id", "vec_id")
        out = rows.select("vec_id").join(counts, "vec_id", "left").join(groups, "vec_id", "left")
    else:
        out = rows.select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
    component = F.coalesce("component", "vec_id")
    result = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    result = saved(result, "near-vectors")
    dropped(vectors.sparkSession, rows)
    dropped(vectors.sparkSession, links)
    return result
