"""Relational operators: first and last per key, merges, anti-joins, caps, run lengths."""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order, which should end in a unique column. Spark turns the filter into a limit inside each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def latest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key: latest at, then largest tie. An aggregation with partial maxima, so a hot key is no burden."""
    rest = [c for c in df.columns if c not in (key, at, tie)]
    best = F.max(F.struct(F.col(at), F.col(tie), *[F.col(c) for c in rest])).alias("_best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in (at, tie, *rest)])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones whose key has no new row."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in new give way to the new ones."""
    return upsert(children, new, [parent])


def promote_or_append(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Matched rows take the new values where these aren't null; unmatched new rows are added."""
    rest = [c for c in old.columns if c != key]
    met = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return met.select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest])


def not_in_either(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df that share none of the keys with other: one anti-join a key, each hashable."""
    for k in keys:
        df = df.join(other.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return df


def ranked_by_bins(df: DataFrame, group: str, order: list[str], bin_: Column) -> DataFrame:
    """df with rn, a row's place in its group by order, from 1, and n, the group's size.

    bin_ must not fall as order rises. Rows are sorted within a group's bins and the
    bins' sizes are summed up, so a group with most of the rows is spread over as many
    tasks as it has bins; a plain window would sort it in one. Null groups are left out.
    """
    binned = df.withColumn("_bin", bin_)
    sizes = binned.groupBy(group, "_bin").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group)
    sizes = sizes.select(group, "_bin", (F.sum("_c").over(w.orderBy("_bin")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("n"))
    inside = F.row_number().over(Window.partitionBy(group, "_bin").orderBy(*order))
    return binned.join(sizes, [group, "_bin"]).withColumn("rn", F.col("_before") + inside).drop("_bin", "_before")


def cross_tab(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def overlaps(df: DataFrame, split: str, key: str) -> DataFrame:
    """Shared distinct keys for each pair of splits: from the set of splits of each key, so no self-join."""
    sets = df.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(F.explode(F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x as split_a, y as split_b))))")).alias("p"))
    return pairs.groupBy("p.split_a", "p.split_b").agg(F.count("*").alias("n_shared"))


def chain_breaks(df: DataFrame, order: list[str], before: str, own: str, chain: str | None = None) -> DataFrame:
    """Rows with link_ok: whether before equals the first sixteen digits of the latest non-empty own of the rows ahead of it, of its chain if there are several."""
    w = (Window.partitionBy(chain) if chain else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_last", F.last(F.nullif(F.col(own), F.lit("")), ignorenulls=True).over(w)).withColumn("link_ok", F.coalesce(F.col(before) == F.substring("_last", 1, 16), F.lit(True))).drop("_last")


def chain_links(df: DataFrame, chain: str, order: list[str], payload: str, secret: str = "") -> DataFrame:
    """df (chain, order..., payload) with link: prev16:full32, the first sixteen digits of the link before in the chain (zeros at the first) and 32 digits of the digest of the whole of that and the payload: SHA-256, or its HMAC with a secret.

    Each chain is walked in its order as its rows stream by; none is gathered.
    """
    columns = [chain, *order, payload]
    key = secret.encode()

    def walk(batches):
        last, before = object(), ""
        for batch in batches:
            out = []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if at != last:
                    last, before = at, "0" * 16
                message = f"{before}|{text or ''}".encode()
                full = (hmac.new(key, message, hashlib.sha256) if key else hashlib.sha256(message)).hexdigest()[:32]
                out.append(f"{before[:16]}:{full}")
                before = full
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], schema=batch.schema.append(pa.field("link", pa.string())))

    rows = df.select(*columns).repartition(chain).sortWithinPartitions(chain, *order)
    return rows.mapInArrow(walk, T.StructType([*rows.schema.fields, T.StructField("link", T.StringType())]))


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(code, change, retrain): added, removed, reordered or kept codes of two lists (code, place); all but the last need a new model."""
    met = old.select("code", F.col("place").alias("was")).join(new.select("code", F.col("place").alias("now")), "code", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "reordered").otherwise("kept")
    return met.select("code", change.alias("change"), (change != "kept").alias("retrain"))


def runs_of(df: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """streak: how many rows in a row, up to this one, have the flag set."""
    w = Window.partitionBy(key).orderBy(order)
    grouped = df.withColumn("_g", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w))
    return grouped.withColumn("streak", F.sum(F.when(F.col(flag), 1).otherwise(0)).over(Window.partitionBy(key, "_g").orderBy(order))).drop("_g")


def rolled_back(versions: DataFrame, version: str, active: str, deactivated_at: str) -> DataFrame:
    """(version, active_after, deactivated) once the active version gives way to the one deactivated last (ties to the greater name); it stays where there is no other. One row a version."""
    others = versions.where(F.col(version) != active).agg(F.max_by(version, F.struct(deactivated_at, version)).alias("_next"))
    out = versions.crossJoin(F.broadcast(others))
    return out.select(version, (F.col(version) == F.coalesce("_next", F.lit(active))).alias("active_after"), ((F.col(version) == active) & F.col("_next").isNotNull()).alias("deactivated"))
