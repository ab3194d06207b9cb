"""Nearest neighbours by largest inner product: a forest of hash prefix trees over sorted arrays.

Each tree hashes a vector to a string of 64 bits, the signs of random projections. A tree
is kept as sorted arrays of those strings: its first levels tell the array (so arrays are
dealt out over tasks), the rest of the string the place in it. A query goes down each tree
to its longest matching prefix, of whatever length, and then up in all trees together, a
level at a time, until the subtrees it stands in hold `enough` candidates over all trees
or it stands at the arrays' level everywhere. All rows of those subtrees are compared:

1. counting: each array tells, for each of its queries, how many strings share each
   prefix length (two searches in the sorted array a level, no pairs); the sums over the
   trees give the level at which the query stops;
2. comparing: each array takes the rows between the two ends of that prefix and compares them
   by byte sketches with proven error bounds; it gives back the rows that can be among its
   first `k`, a few more than k of them;
3. the rows that can still be among the first k over all arrays get their exact
   product, in double precision, from the original vectors.

Signs of projections find large cosines. For large products, vectors are put in bands of
about equal length (a factor of two), each filled up to its band's largest by one more
coordinate; each band has a forest of its own, and a query goes to every band.

Equal vectors are one entry with the k + 1 smallest of their vec_ids, as no list of k can
name others; queries of equal vectors share one search. An array that holds far more than
the average is dealt out in blocks, and its queries go to each; counts add up and lists
merge, so nothing is lost, but near the limit (no two vectors equal, all with one prefix)
the cost is quadratic there, by matrix products without pairs as rows.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
of a null vec_id. Vectors of other lengths than the query's are no candidates. Of rows that share
a vec_id one takes part, the one whose vector's digest is smallest. Ties of the product go to the smaller vec_id. With fewer
than k candidates all that the subtrees hold come back; an empty table gives no rows.
Columns other than vec_id and embedding, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, join_hot, picked, saved, small_batches, task_starts

#: Trees, the average number of rows of an array, bits of a hash string.
TREES, ARRAY, BITS = 24, 4096, 64
#: A query stops at the level at which its subtrees hold so many rows, counted once for each tree.
ENOUGH = 48_000
SEED = 20


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Usable vectors as doubles, None for others."""
    out = []
    for v in column.to_pylist():
        x = None if not v or None in v else np.asarray(v, np.float64)
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def _length(x: np.ndarray) -> float:
    """The Euclidean length, without overflow of the squares."""
    most = float(np.abs(x).max())
    return min(most * float(np.linalg.norm(x / most)), np.finfo(np.float64).max)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, dim, band, size, embedding) of the rows that take part: a digest of the vector, its length and band."""

    def run(batches):
        task_starts("hash_forest")
        for batch in batches:
            xs = _vectors(batch.column(1))
            keep = [i for i, x in enumerate(xs) if x is not None and batch.column(0)[i].is_valid]
            if not keep:
                continue
            at = pa.array(keep)
            sizes = np.array([_length(xs[i]) for i in keep])
            # a band's limits lie off the powers of two, so unit vectors, give or take rounding, are in one
            bands = np.floor(np.log2(sizes) + 0.5).astype(np.int32)
            keys = [hashlib.blake2b((xs[i] + 0.0).tobytes(), digest_size=16).digest() for i in keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(keys, pa.binary()), pa.array([len(xs[i]) for i in keep], pa.int32()), pa.array(bands), pa.array(sizes), batch.column(1).take(at)],
                names=["vec_id", "key", "dim", "band", "size", "embedding"],
            )

    rows = picked(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, key binary, dim int, band int, size double, embedding array<double>")


def projections(dim: int, trees: int) -> np.ndarray:
    """Directions of the hash bits, dim + 1 by trees * BITS, the same in every task."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim + 1, trees * BITS)).astype(np.float32)


def _strings(filled: np.ndarray, directions: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings as unsigned numbers, rows by trees, the first level in the highest bit."""
    bits = (filled.astype(np.float32) @ directions) >= 0
    return np.packbits(bits.reshape(len(filled), trees, BITS), axis=2).view(">u8")[..., 0].astype(np.uint64)


def hashed(entries: DataFrame, trees: int) -> DataFrame:
    """entries with what the forest holds of each: strings for its place as a row and as a query, and a byte sketch (see _sketch)."""

    def run(batches):
        task_starts("hash_forest", held := {})
        for batch in batches:
            xs = [np.asarray(v, np.float64) for v in batch.column("embedding").to_pylist()]
            dims, tops = batch.column("dim").to_numpy(), batch.column("top").to_numpy()
            own, ask, sketch = np.zeros((len(xs), trees), np.uint64), np.zeros((len(xs), trees), np.uint64), [b""] * len(xs)
            for dim in np.unique(dims).tolist():
                if dim not in held:
                    held.clear()
                    held[dim] = projections(dim, trees)
                at = np.flatnonzero(dims == dim)
                x = np.stack([xs[i] for i in at])
                scaled = x / tops[at, None]
                square = (scaled * scaled).sum(axis=1)
                own[at] = _strings(np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - square))]), held[dim], trees)
                unit = scaled / np.sqrt(square)[:, None]
                ask[at] = _strings(np.column_stack([unit, np.zeros(len(at))]), held[dim], trees)
                for i, s in zip(at.tolist(), _sketch(scaled), strict=True):
                    sketch[i] = s
            lists = lambda a: pa.array(list(a.view(np.int64)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("dim"), batch.column("band"), batch.column("top"), batch.column("levels"), lists(own), lists(ask), pa.array(sketch, pa.binary())], names=["key", "dim", "band", "top", "levels", "own", "ask", "sketch"])

    return entries.select("key", "dim", "band", "top", "levels", "embedding").mapInArrow(run, "key binary, dim int, band int, top double, levels int, own array<long>, ask array<long>, sketch binary")


def _sketch(x: np.ndarray) -> list[bytes]:
    """Rows as signed bytes, with the step and the length of what the bytes leave out (rounded up) before them."""
    step = np.maximum(np.abs(x).max(axis=1) / 127, 1e-30).astype(np.float32)
    q = np.rint(x / step[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
    left = np.linalg.norm(x - q * step[:, None].astype(np.float64), axis=1)
    left = np.nextafter(left.astype(np.float32), np.float32(np.inf))
    return [s.tobytes() + e.tobytes() + r.tobytes() for s, e, r in zip(step, left, q, strict=True)]


def _read_sketches(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes times their step, and the errors' lengths."""
    raw = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
    step, left = np.ascontiguousarray(raw[:, :4]).view(np.float32)[:, 0], np.ascontiguousarray(raw[:, 4:8]).view(np.float32)[:, 0]
    return np.ascontiguousarray(raw[:, 8:]).view(np.int8).astype(np.float32) * step[:, None], left


def _ends(strings: np.ndarray, asked: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings with each asked one's first depth bits begin and end."""
    rest = np.uint64(BITS) - np.asarray(depth, np.uint64)
    mask = np.where(rest >= BITS, ~np.uint64(0), (np.uint64(1) << (rest % np.uint64(BITS))) - np.uint64(1))
    return np.searchsorted(strings, asked & ~mask, "left"), np.searchsorted(strings, asked | mask, "right")


def _arrays(batches, name_columns: int):
    """Streams what _dealt() gives: ("rows", columns) of an array, then ("queries", columns) of as many batches of its queries as there are; columns after name_columns and the kind."""
    name, rows, ready = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in range(name_columns + 1)])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            mark, part = tuple(marks[:, s].tolist()), batch.slice(s, e - s)
            if mark[:-1] != name:
                name, rows, ready = mark[:-1], [], None
            if mark[-1] == 0:
                rows.append(part)
            elif rows:
                if ready is None:
                    ready = pa.Table.from_batches(rows).combine_chunks()
                yield name, ready, part


NAME = ("dim", "band", "tree", "prefix", "block")


def _placed(table: DataFrame, strings: str) -> DataFrame:
    """A row for each tree: its string and the array that it belongs to."""
    out = table.select("*", F.posexplode(strings).alias("tree", "string"))
    return out.withColumn("prefix", F.when(F.col("levels") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", "string", F.lit(BITS) - F.col("levels"))))


def _dealt(rows: DataFrame, queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows and queries of each array together, rows first and sorted; rows of large arrays in blocks, their queries with each."""
    array = ["dim", "band", "tree", "prefix"]
    n = F.coalesce("_blocks", F.lit(1))
    r = rows.join(F.broadcast(blocks), array, "left").withColumn("block", F.pmod(F.xxhash64("key"), n).cast("int")).drop("_blocks").withColumn("kind", F.lit(0))
    q = queries.join(F.broadcast(blocks), array, "left").withColumn("block", F.explode(F.sequence(F.lit(0), n - 1))).drop("_blocks").withColumn("kind", F.lit(1))
    both = r.unionByName(q, allowMissingColumns=True)
    # the sign bit is turned, as Spark sorts the strings as signed numbers
    order = F.col("string").bitwiseXOR(F.lit(-(2**63)))
    rest = [c for c in both.columns if c not in NAME and c != "kind"]
    return both.select(*NAME, "kind", *rest).repartition(*NAME).sortWithinPartitions(*NAME, "kind", order)


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def counted(dealt: DataFrame) -> DataFrame:
    """(key, band, depth, n): for each query and array, how many rows share its first depth bits, from the arrays' level to the longest match."""

    def run(batches):
        task_starts("hash_forest")
        for _, rows, part in _arrays(batches, len(NAME)):
            strings, asked = _unsigned(rows.column("string").chunk(0)), _unsigned(part.column("string"))
            level = part.column("levels").to_numpy()
            sizes = np.zeros((len(asked), BITS + 1), np.int64)
            for depth in range(int(level.min()), BITS + 1):
                lo, hi = _ends(strings, asked, depth)
                sizes[:, depth] = np.where(depth >= level, hi - lo, 0)
                if not sizes[:, depth].any():
                    break
            q, d = np.nonzero(sizes)
            if len(q):
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(q)), part.column("band").take(pa.array(q)), pa.array(d.astype(np.int32)), pa.array(sizes[q, d])], names=["key", "band", "depth", "n"])

    return dealt.select(*NAME, "kind", "key", "levels", "string").mapInArrow(run, "key binary, band int, depth int, n long")


def compared(dealt: DataFrame, k: int) -> DataFrame:
    """(key, other, low, high): for each query and array, the rows under its prefix that can be among the first k of them, with bounds of the product with the query's unit vector."""

    def run(batches):
        task_starts("hash_forest")
        at = None
        for name, rows, part in _arrays(batches, len(NAME)):
            if at is not rows:
                at, strings = rows, _unsigned(rows.column("string").chunk(0))
                x, left = _read_sketches(rows.column("sketch").to_pylist())
                top, length = float(rows.column("top")[0].as_py()), np.linalg.norm(x, axis=1)
            lo, hi = _ends(strings, _unsigned(part.column("string")), part.column("depth").to_numpy())
            y = np.stack([np.asarray(v, np.float32) for v in part.column("unit").to_pylist()])
            # what the bytes leave out, and the rounding of the query and of so many terms in single precision
            slack = (left + length * (name[0] + 8) * 1.2e-7) * (1 + 1e-6)
            of, to, low, high = [], [], [], []
            for a, b in sorted(set(zip(lo.tolist(), hi.tolist(), strict=True))):
                mine = np.flatnonzero((lo == a) & (hi == b))
                if b <= a:
                    continue
                for some in np.array_split(mine, -(-len(mine) // 64)):
                    near = y[some] @ x[a:b].T
                    least, most = near - slack[a:b], near + slack[a:b]
                    bar = np.partition(least, b - a - k, axis=1)[:, b - a - k] if b - a > k else np.full(len(some), -np.inf)
                    i, j = np.nonzero(most >= bar[:, None])
                    of.append(some[i])
                    to.append(j + a)
                    low.append(least[i, j].astype(np.float64) * top)
                    high.append(most[i, j].astype(np.float64) * top)
            if of:
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(np.concatenate(of))), rows.column("key").chunk(0).take(pa.array(np.concatenate(to))), pa.array(np.concatenate(low)), pa.array(np.concatenate(high))], names=["key", "other", "low", "high"])

    return dealt.select(*NAME, "kind", "key", "string", "sketch", "top", "depth", "unit").mapInArrow(run, "key binary, other binary, low double, high double")


def product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, enough: int = ENOUGH, array: int = ARRAY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k found with the largest inner products of each row for which is_query (an expression over vec_id) holds, itself aside."""
    spark = vectors.sparkSession
    small_batches(spark)
    first = usable(vectors).withColumn("_n", F.row_number().over(Window.partitionBy("vec_id").orderBy("key"))).where("_n = 1").drop("_n")
    rows = saved(first, "forest-rows")
    # equal vectors: the k + 1 smallest ids
    firsts = rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    entries = saved(firsts.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), *[F.first(c).alias(c) for c in ("dim", "band", "size", "embedding")]), "forest-entries")
    bands = entries.groupBy("dim", "band").agg(F.max("size").alias("top"), F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / F.lit(array)))).cast("int").alias("levels"))
    forest = saved(hashed(entries.join(bands, ["dim", "band"]), trees), "forest")

    own = _placed(forest.select("key", "dim", "band", "top", "levels", "sketch", "own"), "own").drop("own")
    total = forest.count() * trees
    least = max(2 * array, total // 20_000)
    blocks = own.groupBy("dim", "band", "tree", "prefix").count().where(F.col("count") > least).select("dim", "band", "tree", "prefix", F.ceil(F.col("count") / array).cast("int").alias("_blocks"))
    blocks = saved(blocks, "forest-blocks")

    asked = rows.where(is_query).select("vec_id", "key")
    keys = asked.select("key").distinct()
    # a query's own top scales nothing: it goes to every band of its length
    questions = saved(keys.join(forest.select("key", "dim", "ask"), "key").join(bands.select("dim", "band", "levels"), "dim"), "forest-questions")
    placed = _placed(questions, "ask").drop("ask")
    sums = counted(_dealt(own.drop("sketch"), placed, blocks)).groupBy("key", "band", "depth").agg(F.sum("n").alias("n"))
    stops = sums.groupBy("key", "band").agg(F.max(F.when(F.col("n") >= enough, F.col("depth"))).alias("depth"))
    units = keys.join(entries.select("key", "embedding", "size"), "key").select("key", F.transform("embedding", lambda x: (x / F.col("size")).cast("float")).alias("unit"))
    told = placed.join(stops, ["key", "band"], "left").withColumn("depth", F.coalesce("depth", "levels")).join(units, "key")
    bounds = compared(_dealt(own, told, blocks), k + 1).groupBy("key", "other").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    order = Window.partitionBy("key").orderBy(F.desc("low"), "other")
    ranked = bounds.withColumn("_n", F.row_number().over(order))
    bar = F.max(F.when(F.col("_n") == k + 1, F.col("low"))).over(Window.partitionBy("key"))
    possible = ranked.withColumn("_bar", bar).where(F.col("_bar").isNull() | (F.col("high") >= F.col("_bar"))).select("key", "other")

    a = entries.select("key", F.col("embedding").alias("_a"))
    b = entries.select(F.col("key").alias("other"), F.col("embedding").alias("_b"), "ids")
    scored = possible.join(b, "other").join(a, "key").select("key", "ids", product(F.col("_a"), F.col("_b")).alias("score"))
    found = scored.select("key", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    tops = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    lists = tops.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("list"))
    # a list for each different vector; equal queries, however many, share it
    weights = asked.groupBy("key").agg(F.count("*").alias("_weight"))
    met = join_hot(asked, saved(lists.join(weights, "key"), "forest-lists"), "key", "_weight", asked.count())
    mine = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    out = met.select(F.col("vec_id").alias("query_id"), F.posexplode(mine).alias("_at", "_hit"))
    ready = saved(out.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_hit.vec_id").alias("vec_id"), F.col("_hit.score").alias("score")), "forest-nearest")
    for table in (rows, entries, forest, blocks, questions):
        dropped(spark, table)
    return ready
