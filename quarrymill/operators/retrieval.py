"""Vector search, lexical scores, rank fusion and retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import stats
from quarrymill.session import shipped


#: Corpus rows of a block.
BLOCK = 4096
#: Pairs of rows that are scored at once.
PAIRS = 1 << 16


def _packed(rows: DataFrame, size: int, first: int | None = None) -> DataFrame:
    """(block, dim, ids, vecs): rows (id, vec) in blocks of at most size, ids in order, the vectors one after another as bytes. dim is 0 for vectors that are null, empty or hold a null; those have no bytes. Of equal vectors in a block only the first so many ids are kept: no list of that length can name others."""
    name, vec = rows.columns
    kind = np.dtype("f4" if rows.schema[vec].dataType.simpleString() == "array<float>" else "f8")

    def run(batches):
        number = 0
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            dims = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).copy()
            if lists.flatten().null_count:
                holes = pc.list_parent_indices(lists).filter(lists.flatten().is_null())
                dims[holes.to_numpy()] = 0
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                for s in range(0, len(mine), size):
                    at = mine[s : s + size]
                    at = at[_order(pa.table({"id": ids.take(pa.array(at))}), [("id", "ascending")])]
                    x = lists.take(pa.array(at)).flatten().to_numpy().astype(kind, copy=False).reshape(len(at), dim) if dim else np.zeros((len(at), 0), kind)
                    if first is not None:
                        keep = _firsts(np.ascontiguousarray(x).view(f"V{dim * kind.itemsize}")[:, 0] if dim else np.zeros(len(at)), first)
                        at, x = at[keep], x[keep]
                    own = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids.take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([dim], pa.int32()), own, pa.array([x.tobytes()], pa.binary())], names=["block", "dim", "ids", "vecs"])
                    number += 1

    listed = rows.select(F.col(name), F.col(vec).cast(f"array<{'float' if kind.itemsize == 4 else 'double'}>").alias(vec))
    return listed.mapInArrow(run, f"block int, dim int, ids array<{rows.schema[name].dataType.simpleString()}>, vecs binary")


def _order(table: pa.Table, keys: list[tuple[str, str]]) -> np.ndarray:
    """Spark's order: NaN before other numbers where they fall, null before all where they rise."""
    return pc.sort_indices(table, sort_keys=keys, null_placement="at_start").to_numpy()


def _firsts(values: np.ndarray, n: int) -> np.ndarray:
    """The places of the first n of each value, in order."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    within = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    return np.sort(order[within < n])


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums over the first axis of the products, one after another as SQL adds them up."""
    out = np.zeros(x.shape[1])
    for a, b in zip(x, y, strict=True):
        out += a * b
    return out


class _Block:
    """Vectors by component, their squares' sums, and unit vectors in single precision."""

    def __init__(self, dim: int, kind: np.dtype, vecs: bytes) -> None:
        self.x = np.ascontiguousarray(np.frombuffer(vecs, kind).reshape(-1, dim).T.astype(np.float64))
        self.squares = _sums(self.x, self.x)
        # of numbers whose squares are lost or overflow, the unit is not a number and they are always scored
        ordinary = (self.squares > 1e-140) & (self.squares < 1e140)
        size = np.where(self.squares == 0, 1.0, np.sqrt(np.where(ordinary | (self.squares == 0), self.squares, np.nan)))
        self.unit = np.ascontiguousarray((self.x / size).T.astype(np.float32))


def _cosines(q: _Block, c: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs of places in double precision, to the last bit as in SQL; 0 with a zero vector."""
    out = np.zeros(len(i))
    for s in range(0, len(i), PAIRS):
        a, b = i[s : s + PAIRS], j[s : s + PAIRS]
        dot = np.zeros(len(a))
        for x, y in zip(q.x, c.x, strict=True):
            dot += x[a] * y[b]
        m, n = q.squares[a], c.squares[b]
        both = m * n
        norm = np.where((both > 1e-290) & (both < 1e290), np.sqrt(both), np.sqrt(m) * np.sqrt(n))
        with np.errstate(all="ignore"):
            out[s : s + PAIRS] = np.where(norm == 0, 0.0, np.clip(dot / norm, -1.0, 1.0)) + 0.0
    return out


def nearest(queries: DataFrame, corpus: DataFrame, k: int, query_bound: int = 1000) -> DataFrame:
    """(qid, id, score, rank): the k nearest corpus rows of each query by cosine, ties by id. queries (qid, vec), corpus (id, vec).

    Exact search of a query set against all rows. Queries are dealt out in blocks of about
    query_bound, the corpus in blocks over so few parts that all cores have work; a task meets one
    part with one block of queries, a block at a time, and keeps the k best of each
    query. Products of unit vectors in single precision tell, with their error bound, which
    pairs can be among these; only those are scored, in double precision. Time grows with
    queries x rows, memory with neither, and what is shuffled is the corpus once and k rows a query and part.
    Vectors that are null, empty, zero, of another length or hold a null have the score 0.
    """
    spark = queries.sparkSession
    shipped(spark)
    k = max(k, 0)
    blocks = max(1, -(-queries.count() // query_bound))
    parts = max(1, -(-4 * spark.sparkContext.defaultParallelism // blocks))
    asked, rows = queries.select("qid", "vec"), corpus.select("id", "vec")
    c = _packed(rows, BLOCK, max(k, 1)).repartition(parts).drop("block")
    q = _packed(asked.repartition(blocks), 2 * query_bound).select("block", F.col("dim").alias("_dim"), F.col("ids").alias("qids"), F.col("vecs").alias("_vecs"))
    kinds = [np.dtype("f4" if x.schema["vec"].dataType.simpleString() == "array<float>" else "f8") for x in (rows, asked)]

    def run(batches):
        read: dict[int, _Block] = {}
        found: dict[int, pa.Table] = {}
        more: dict[int, list[pa.Table]] = {}
        bars: dict[int, np.ndarray] = {}
        names: dict[int, pa.Array] = {}
        for batch in batches:
            last, y = None, None
            for r in range(batch.num_rows):
                dim, ids, vecs, number, other, qids, asks = (batch.column(x)[r] for x in ("dim", "ids", "vecs", "block", "_dim", "qids", "_vecs"))
                dim, number, ids = dim.as_py(), number.as_py(), ids.values
                if number not in names:
                    names[number], bars[number] = qids.values, np.full(len(qids.values), -np.inf)
                    read[number] = _Block(other.as_py(), kinds[1], asks.as_py()) if other.as_py() else None
                x, bar = read[number], bars[number]
                if x is None or dim != len(x.x):
                    # every score is 0: the first ids
                    n = min(k, len(ids))
                    i, j = (a.ravel() for a in np.mgrid[0 : len(bar), 0:n])
                    scores = np.zeros(len(i))
                else:
                    own = vecs.as_buffer()
                    if last != own.address:
                        last, y = own.address, _Block(dim, kinds[0], own)
                    i, j, scores = _above(x, y, bar, k)
                reach = ~(scores < bar[i])
                more.setdefault(number, []).append(pa.table({"q": i[reach], "score": scores[reach], "id": ids.take(pa.array(j[reach]))}))
                # not at each block, as lists are long beside what comes later
                if number not in found or 4 * sum(map(len, more[number])) >= len(found[number]):
                    found[number] = _best([*([found[number]] if number in found else []), *more.pop(number)], k, bar)
        for number, table in found.items():
            for b in _best([table, *more.get(number, [])], k, bars[number]).to_batches(max_chunksize=BLOCK):
                yield pa.RecordBatch.from_arrays([names[number].take(b.column("q")), b.column("id"), b.column("score")], names=["qid", "id", "score"])

    kind = lambda df, x: df.schema[x].dataType.simpleString()
    met = c.crossJoin(q.hint("shuffle_replicate_nl")).mapInArrow(run, f"qid {kind(asked, 'qid')}, id {kind(rows, 'id')}, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(parts: list[pa.Table], k: int, bar: np.ndarray) -> pa.Table:
    """The first k of each query of parts (q, score, id); their k-th scores go to bar."""
    every = pa.concat_tables(parts)
    every = every.take(pa.array(_order(every, [("q", "ascending"), ("score", "descending"), ("id", "ascending")])))
    of = every["q"].to_numpy()
    at = np.arange(len(of)) - np.searchsorted(of, of)
    ends = at == k - 1
    bar[of[ends]] = np.nan_to_num(every["score"].to_numpy()[ends], nan=np.inf)
    return every.filter(pa.array(at < k)).combine_chunks()


def _above(q: _Block, c: _Block, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and rows, and their cosines: of all pairs that can be among a query's first k, whose k-th best so far is bar."""
    # of the units, of so many terms' products and of their sums
    slack = (len(q.x) + 16) * 1.2e-7
    of, to, n = [], [], max(1, (1 << 22) // max(1, len(c.unit)))
    for s in range(0, len(q.unit), n):
        near = q.unit[s : s + n] @ c.unit.T
        least = bar[s : s + n] - slack
        new = np.flatnonzero(np.isneginf(least))
        if len(new) and near.shape[1] > k > 0:
            low = np.where(np.isnan(near[new]), -np.inf, near[new])
            least[new] = np.partition(low, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - 2 * slack
        i, j = np.nonzero(~(near < least.astype(np.float32)[:, None]))
        of.append(i + s)
        to.append(j)
    i, j = np.concatenate(of), np.concatenate(to)
    return i, j, _cosines(q, c, i, j)


def bm25(queries: DataFrame, docs: DataFrame, tokens: Column, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, id, score) of the documents that share a term with a query. queries (qid, term), distinct.

    The tokens are cut down to the terms of the queries first. Terms and queries are joined
    as Spark sees fit: broadcast below its size limit, else shuffled by term.
    """
    terms = queries.select("term").distinct()
    t = docs.select("id", tokens.alias("t")).withColumn("len", F.size("t"))
    corpus = t.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    tf = t.select("id", "len", F.explode("t").alias("term")).join(terms, "term").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    met = tf.join(df, "term").join(queries, "term").crossJoin(F.broadcast(corpus))
    return met.groupBy("qid", "id").agg(F.sum(score).alias("score"))


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """rank of each positive score within its query, from 1, ties by id; the first k."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    out = scores.where("score > 0").withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def rrf(channels: list[DataFrame], constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked channels (qid, id, rank)."""
    every = None
    for c in channels:
        part = c.select("qid", "id", "rank")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("qid", "id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))


def minmax(score: str, per: str) -> Column:
    """The score scaled to [0, 1] within per; .5 where all are equal."""
    w = Window.partitionBy(per)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 0.5).otherwise((F.col(score) - low) / (high - low))


def weighted(dense: DataFrame, lexical: DataFrame, alpha: float) -> DataFrame:
    """alpha of the scaled dense and 1 - alpha of the scaled lexical score; a missing one counts 0."""
    d = dense.select("qid", "id", minmax("score", "qid").alias("d"))
    x = lexical.select("qid", "id", minmax("score", "qid").alias("x"))
    return d.join(x, ["qid", "id"], "full_outer").select("qid", "id", (alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("x", F.lit(0.0))).alias("score"))


def multi_query(results: DataFrame, constant: int = 60) -> DataFrame:
    """(qid, id, score): rank fusion of the results of a query's variants; of a query with results for one variant only, these with their own scores. results: qid, variant, id, rank, score."""
    several = F.max("variant").over(Window.partitionBy("qid")) != F.min("variant").over(Window.partitionBy("qid"))
    part = F.when(several, 1.0 / (constant + F.col("rank"))).otherwise(F.col("score"))
    return results.withColumn("part", part).groupBy("qid", "id").agg(F.sum("part").alias("score"))


def hit_metrics(ranks: DataFrame, totals: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """recall, precision, mrr and ndcg at k for each row of totals (by..., n: how many rows are relevant, 1 or more). ranks (by..., id, rank, relevant), an id once a query. What is relevant is told on the ranks, so the relevant rows themselves are never paired with queries."""
    keys = list(by)
    hits = ranks.where(F.col("relevant") & (F.col("rank") <= k)).groupBy(*keys).agg(F.count("*").alias("h"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return totals.join(hits, keys, "left").select(*keys, z(F.col("h") / F.col("n")).alias("recall"), z(F.col("h") / F.lit(k)).alias("precision"), z(1 / F.col("first")).alias("mrr"), z(F.col("dcg") / ideal).alias("ndcg"))


def metrics(ranks: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """hit_metrics() of ranks (qid, id, rank) and listed relevant rows (qid, id); an id that is ranked twice counts once."""
    best = ranks.groupBy("qid", "id").agg(F.min("rank").alias("rank")).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    listed = relevant.distinct()
    told = best.join(listed.withColumn("relevant", F.lit(True)), ["qid", "id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    return hit_metrics(told, listed.groupBy("qid").agg(F.count("*").alias("n")), k)


def alpha_grid(dense: DataFrame, lexical: DataFrame, alphas: list[float], depth: int = 10) -> DataFrame:
    """(alpha, qid, id, rank): the first depth rows of the weighted fusion for each alpha. dense and lexical (qid, id, score)."""
    d = dense.select("qid", "id", minmax("score", "qid").alias("d"))
    x = lexical.select("qid", "id", minmax("score", "qid").alias("x"))
    both = d.join(x, ["qid", "id"], "full_outer").na.fill(0.0, ["d", "x"])
    scored = both.select("qid", "id", "d", "x", F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha")).withColumn("score", F.round(F.col("alpha") * F.col("d") + (1 - F.col("alpha")) * F.col("x"), 9))
    w = Window.partitionBy("alpha", "qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth).select("alpha", "qid", "id", "rank")


def votes(hits: DataFrame, label: str) -> DataFrame:
    """(qid, voted, share, margin, unanimous): the label with the most summed score among a query's hits, ties to the smaller label."""
    s = hits.groupBy("qid", label).agg(F.sum("score").alias("s"))
    ranked_labels = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("m"), F.col(label).alias("l"))))
    g = s.groupBy("qid").agg(ranked_labels.alias("r"), F.sum("s").alias("t"))
    top, second = -F.get("r", F.lit(0))["m"], F.coalesce(-F.get("r", F.lit(1))["m"], F.lit(0.0))
    return g.select("qid", F.get("r", F.lit(0))["l"].alias("voted"), stats.ratio(top, F.col("t")).alias("share"), stats.ratio(top - second, F.col("t")).alias("margin"), (F.size("r") == 1).alias("unanimous"))


def expanded(queries: DataFrame, rules: Column, suggested: DataFrame | None = None, most: int = 5) -> DataFrame:
    """queries (qid, text) with variants: the text, then those of rules (an array), then those of suggested (qid, variants; from a model, say), each once, the first most."""
    out = queries.withColumn("_rules", rules)
    out = out.join(suggested.select("qid", F.col("variants").alias("_more")), "qid", "left") if suggested is not None else out.withColumn("_more", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    every = F.concat(F.array("text"), F.coalesce("_rules", none), F.coalesce("_more", none))
    return out.withColumn("variants", F.slice(F.array_distinct(F.array_compact(every)), 1, most)).drop("_rules", "_more")


def reindexed(index: DataFrame, stored: DataFrame, cut: Column) -> DataFrame:
    """index (doc, id, content) in which the documents of stored (doc, n, ...) have new rows only: each stored chunk is cut again (cut: an array of texts), numbered on through the document, with ids doc:c0, doc:c1, ..."""
    parts = stored.select("doc", "n", F.posexplode(cut).alias("k", "content"))
    at = F.row_number().over(Window.partitionBy("doc").orderBy("n", "k")) - 1
    fresh = parts.select("doc", F.concat(F.col("doc").cast("string"), F.lit(":c"), at.cast("string")).alias("id"), "content")
    return index.select("doc", "id", "content").join(stored.select("doc").distinct(), "doc", "left_anti").unionByName(fresh)


def cached_embeddings(texts: DataFrame, embed, model: str, path: str) -> DataFrame:
    """(key, vector) of the distinct texts (text) under a model: those in the Parquet cache at path as they are, the others by embed (a function of a column), added to the cache. The key is the SHA-1 of model, a unit separator and the text."""
    spark = texts.sparkSession
    wanted = texts.where("text is not null").select(F.sha1(F.concat(F.lit(model + "\x1f"), "text").cast("binary")).alias("key"), "text").dropDuplicates(["key"])
    schema = "key string, vector array<double>"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    known = spark.read.schema(schema).parquet(path)
    wanted.join(known.select("key"), "key", "left_anti").select("key", embed("text").alias("vector")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).join(wanted.select("key"), "key", "left_semi")


def candidates_for(k: int, filtered: bool = False) -> int:
    """How many candidates to take for the first k: 20 for each, 100 at least; 50 for each where a filter will drop some."""
    base = max(100, 20 * k)
    return max(base, 50 * k) if filtered else base


def rule_expansion(text: Column, synonyms: dict[str, list[str]], most: int = 3) -> Column:
    """array of queries: the text, then the text with each of the first most synonyms that it doesn't hold yet; a key counts in any case, a synonym as it is written. An empty text or none has no queries."""
    low, none = F.lower(text), F.array().cast("array<string>")
    parts = [F.when(F.contains(low, F.lit(k.lower())), F.array(*[F.lit(x) for x in v])).otherwise(none) for k, v in synonyms.items() if v]
    fresh = F.slice(F.array_distinct(F.filter(F.concat(none, *parts), lambda x: ~F.contains(text, x))), 1, most)
    queries = F.concat(F.array(text), F.transform(fresh, lambda x: F.trim(F.concat(text, F.lit(" "), x))))
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, queries).otherwise(none)


def reranked(hits: DataFrame, scorer: Callable[[str, list[str]], list[float]], k: int) -> DataFrame:
    """(qid, id, rank, score) of hits (qid, id, rank, score, query, text), at most some hundreds a query: those with a text by the scorer, ties by their rank before, then those without, as they were; the first k of that.

    scorer takes a query and its hits' texts. Where it fails, or gives another number of
    scores, that query's hits keep their order and scores, and other queries aren't
    touched. So it is too where no hit has a text. A score of NaN counts as the lowest.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"]).reset_index(drop=True)
        has = pdf["text"].fillna("") != ""
        if has.any():
            try:
                scores = [float(x) for x in scorer(pdf["query"][0], pdf["text"][has].tolist())]
                if len(scores) == has.sum():
                    first = pdf[has].assign(score=scores)
                    first = first.assign(_order=first["score"].fillna(float("-inf"))).sort_values("_order", ascending=False, kind="stable").drop(columns="_order")
                    pdf = pd.concat([first, pdf[~has]], ignore_index=True)
            except Exception:  # noqa: BLE001 - whatever a model raises, the hits stay as they are
                pass
        pdf = pdf.head(k)
        return pd.DataFrame({"qid": pdf["qid"], "id": pdf["id"], "rank": range(1, len(pdf) + 1), "score": pdf["score"]})

    shipped(hits.sparkSession)
    rows = hits.select(F.col("qid").cast("long").alias("qid"), F.col("id").cast("long").alias("id"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), "query", "text")
    return rows.groupBy("qid").applyInPandas(run, "qid long, id long, rank int, score double")


def keep_order(query: str, texts: list[str]) -> list[float]:
    """The scorer that changes nothing: 1, falling evenly."""
    return [1.0 - i / len(texts) for i in range(len(texts))]
