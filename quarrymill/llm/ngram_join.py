"""N-gram Jaccard join: parity sketches, a pigeonhole join by size band, exact verification.

A document is the set of its shingles of words words. Two documents link when their
sets' Jaccard similarity is at least percent hundredths. Documents with equal sets are
one class, represented by its smallest doc_id.

Sketches. Each shingle hashes to a bit; a sketch is the exclusive or of its shingles'
bits, so two sketches differ in at most as many bits as the sets differ in shingles.
A linked pair differs in at most d = (a + b)(100 - p) / (100 + p) shingles. A class is
put in the band of its size (and the next, if a larger partner may be there); in each
the sketch is cut into more blocks than d for that band, so linked classes agree on
some block: the join keys are the blocks' contents. Blocks without a shingle are keys
only for classes that have more of them than the spare blocks make up for.

Candidates. Keys are dealt out packed in arrays, not as rows. In a key's group every
class is paired with the smallest; the pairs whose sketches differ in at most d bits are
verified by their whole sets; linked classes form components. In groups that then still
hold several components, if they are linked for the most part, every class is paired with
two more of the group, the largest and one chosen by hash. Groups that hold several components even then are gone through
in blocks of rows, all pairs across components by sketch distance, and what passes is
verified too. So no pair is left out, yet a group of thousands of near copies costs
three passes and not the square of its size. A key that is common within a batch of
rows sends one row on for all of them. Joins on a centre that many pairs share are dealt
out by the pairs' other ends.

Nulls: a null text, or one without words, has an empty set and links with nothing; a
text with fewer words than words has its whole sequence as its one shingle. Rows with a
null doc_id link with nothing and have a null component. Rows that share a doc_id are
one document: what either links with, both do. Texts are read whole; a set takes memory
as the number of its shingles. A similarity of exactly percent hundredths links. Columns
other than doc_id and text, whatever their names, are not read, and passed on by
keep_one(). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dealt_in_blocks, dropped, in_groups, join_hot, join_salted, released, saved, small_batches, task_starts, together

#: A-Z to a-z, all else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Odd multipliers (fractional bits of square roots of primes) of a shingle's words.
_ODD = [np.uint64(x) for x in (0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)]
#: Most bits (16 MB) of the filter of candidate ids that is broadcast.
FILTER_BITS = 1 << 27
#: Bytes that are kept of a join key. Keys that agree in them by chance make candidates that the sketches reject.
KEY_BYTES = 6
#: Fewest bits of a sketch. Sketches of small sets as narrow as the sets let many pairs pass that don't link.
LEAST_BITS = 512


class WordHashes(dict):
    """64-bit hashes of words seen; bounded: cleared when it holds most words."""

    most = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 48:
            self[word] = h
        return h


_HASHES = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.array([_HASHES[x] for x in w], dtype=np.uint64)
    size = min(words, len(w))
    n = len(w) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = mixed(total + h[k : k + n] * _ODD[k % len(_ODD)] + np.uint64(k))
    return np.unique(total)


def most_apart(size: int, percent: int) -> int:
    """The most shingles that linked sets of size shingles in all can differ in."""
    return size * (100 - percent) // (100 + percent)


class Bands:
    """Size bands: (first size, blocks, spare blocks) each; smaller sets link with equal ones only."""

    def __init__(self, percent: int, longest: int = 1 << 40) -> None:
        if not 1 <= percent <= 100:
            raise ValueError("percent must be from 1 to 100")
        self.percent = percent
        # sets so small that linked ones are equal need no band; at 100 percent all are
        edge = next((b for b in range(1, 10_000) if most_apart(2 * b, percent) >= 1), longest)
        self.edges, self.blocks, self.spare = [], [], []
        while edge < longest:
            after = max(edge + 1, edge * 3 // 2)
            apart = most_apart(2 * (after - 1), percent)
            spare = 1 + apart // 16
            self.edges.append(edge)
            self.spare.append(spare)
            self.blocks.append(apart + 1 + spare)
            edge = after

    def of(self, size: int) -> list[int]:
        """The bands that a set of size shingles is keyed in: its own, and every one above where a partner may be."""
        first = int(np.searchsorted(self.edges, size, side="right")) - 1
        last = int(np.searchsorted(self.edges, size * 100 // self.percent, side="right")) - 1
        return list(range(max(first, 0), last + 1))


def block_keys(h: np.ndarray, bands: Bands) -> np.ndarray:
    """The join keys of a set: for each of its bands, the sketch blocks that hold a shingle."""
    out = []
    for k in bands.of(len(h)):
        n = bands.blocks[k]
        at = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        starts = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]])
        filled = sorted_at[starts]
        bits = np.bitwise_xor.reduceat(np.uint64(1) << (h[order] & np.uint64(63)), starts)
        rest = np.bitwise_xor.reduceat(mixed(h[order]), starts)
        band = np.full(1, k + 1, np.uint64) * _ODD[3]
        tag = (filled.astype(np.uint64) + np.uint64(1)) * _ODD[2] + band
        out.append(mixed(tag + bits * _ODD[4] + rest))
        if n - len(filled) > bands.spare[k]:
            empty = np.setdiff1d(np.arange(n), filled).astype(np.uint64)
            out.append(mixed((empty + np.uint64(1)) * _ODD[2] + band))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def packed_keys(keys: np.ndarray) -> bytes:
    return keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked_keys(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel()


def packed_ids(ids: np.ndarray) -> bytes:
    """Rising ids as differences, byte by byte of their places, so that the shuffle's compression finds the zeros."""
    return np.diff(ids, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_ids(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel())


def parity(h: np.ndarray) -> bytes:
    """The parity sketch of a set, of at least as many bits (a power of two) as it has shingles, and LEAST_BITS."""
    width = max(LEAST_BITS, 1 << (len(h) - 1).bit_length()) if len(h) else LEAST_BITS
    odd = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the narrowest: the exclusive or of halves is the sketch of half as many bits."""
    least = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), least), np.uint64)
    for k, s in enumerate(sketches):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, least), axis=0)
    return out


_DESCRIBED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("keys", pa.binary()), ("sketch", pa.binary())])


def describe(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, same: a 128-bit hash of the set, keys, sketch); no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        task_starts("ngram_join", _HASHES)
        bands = Bands(percent)
        for batch in batches:
            rows: list[list] = [[] for _ in range(4)]
            for t in batch.column(1).to_pylist():
                h = shingles(t, words)
                for to, v in zip(rows, (len(h), xxhash.xxh128_digest(h.tobytes()) if len(h) else None, packed_keys(block_keys(h, bands)), parity(h)), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, f.type) for r, f in zip(rows, list(_DESCRIBED)[1:], strict=True))], schema=_DESCRIBED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, same binary, keys binary, sketch binary")


def _sorted_keys(batch) -> tuple[np.ndarray, np.ndarray]:
    keys = [unpacked_keys(b) for b in batch.column(1).to_pylist()]
    docs = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
    keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.lexsort((docs, keys))
    return keys[order], docs[order]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(keys)])


#: A key that this many classes of one batch share sends one row on for them.
COMMON_IN_BATCH = 16

_MET = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64())])


def _met(keys: np.ndarray, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """kind 0: the two classes of a group of two. kind 1: (key, class) of groups of three and more."""
    two = starts[sizes == 2]
    pairs = np.unique(np.stack([docs[two + 1], docs[two]], axis=1), axis=0)
    many = np.repeat(sizes > 2, sizes)
    k, d = keys[many].view(np.int64), docs[many]
    once = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])] if len(k) else np.zeros(0, bool)
    k, d = k[once], d[once]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(pairs), len(k)]).astype(np.int32)), pa.array(np.concatenate([pairs[:, 0], k])), pa.array(np.concatenate([pairs[:, 1], d]))], schema=_MET)


def met_in_groups(classes: DataFrame, buckets: int) -> DataFrame:
    """(kind, x, y), as of _met(), over all keys of classes (doc, keys)."""
    small_batches(classes.sparkSession)
    packed = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])

    def deal(batches):
        for batch in batches:
            keys, docs = _sorted_keys(batch)
            starts, sizes = _runs(keys)
            common = sizes >= COMMON_IN_BATCH
            # three equal rows stand for a common key's classes, so that its group counts as one of three and more
            keep = np.repeat(~common, sizes)
            docs = docs.copy()
            for k in range(3):
                keep[starts[common] + k] = True
                docs[starts[common] + k] = docs[starts[common]]
            keys, docs = keys[keep], docs[keep]
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((docs, bucket))
            cuts, counts = _runs(bucket[order])
            parts = [order[s : s + c] for s, c in zip(cuts.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array([packed_keys(keys[p]) for p in parts], pa.binary()), pa.array([packed_ids(docs[p]) for p in parts], pa.binary())], schema=packed)

    def local(batches):
        for batch in batches:
            keys, docs = _sorted_keys(batch)
            starts, sizes = _runs(keys)
            common = np.repeat(sizes >= COMMON_IN_BATCH, sizes)
            yield _met(keys[common], docs[common], *_runs(keys[common]))

    def gather(batches):
        task_starts("ngram_join", _HASHES)
        keys, docs = [], []
        for batch in batches:
            keys += [unpacked_keys(b) for b in batch.column(1).to_pylist()]
            docs += [unpacked_ids(b) for b in batch.column(2).to_pylist()]
        if keys:
            k, d = np.concatenate(keys), np.concatenate(docs)
            del keys, docs
            order = np.lexsort((d, k))
            k, d = k[order], d[order]
            yield _met(k, d, *_runs(k))

    rows = classes.select("doc", "keys")
    dealt = rows.mapInArrow(deal, "bucket int, keys binary, docs binary").repartition(buckets, "bucket")
    return dealt.mapInArrow(gather, "kind int, x long, y long").unionByName(rows.mapInArrow(local, "kind int, x long, y long"))


def _close(na, nb, words_a, words_b, percent: int) -> np.ndarray:
    apart = np.bitwise_count(words_a ^ words_b).sum(axis=-1, dtype=np.int64)
    return (apart <= (na + nb) * (100 - percent) // (100 + percent)) & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent)


def _both(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """pairs (a, b), a table, with the other columns of of (doc, ...) for both, their names followed by a and b. Either end may be a hot group's centre."""
    side = lambda c: of.select(*[F.col(x).alias(c if x == "doc" else x + c) for x in of.columns])
    return join_salted(join_salted(pairs, side("a"), "a", "b", pairs), side("b"), "b", "a", pairs)


def sketch_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a table, whose sketches and sizes allow a link."""
    met = _both(pairs, classes.select("doc", "n", "sketch")).select("a", "b", "na", "nb", "sketcha", "sketchb")

    def run(batches):
        task_starts("ngram_join", _HASHES)
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                w = folded([x, y])
                keep.append(bool(_close(na[k], nb[k], w[0], w[1], percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, "a long, b long").distinct()


def across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one key and different components whose sketches and sizes allow a link. members: key, doc, component, n, sketch."""
    dealt = dealt_in_blocks(members, "key", "doc", block=1024)
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        task_starts("ngram_join", _HASHES)
        for rows in in_groups(batches):
            lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
            doc, part, n, own = (rows.column(c).to_numpy() for c in ("doc", "component", "n", "own"))
            if len(doc) < 2 or (part == part[0]).all():
                continue
            words = folded(rows.column("sketch").to_pylist())
            left = np.arange(len(doc)) if lo == hi else np.flatnonzero(own == lo)
            right = left if lo == hi else np.flatnonzero(own == hi)
            step = max(1, (1 << 22) // max(1, len(right) * words.shape[1]))
            for s in range(0, len(left), step):
                i = left[s : s + step]
                ok = _close(n[i][:, None], n[right][None, :], words[i][:, None, :], words[right][None, :, :], percent) & (part[i][:, None] != part[right][None, :])
                x, y = np.nonzero(ok)
                a, b = doc[i[x]], doc[right[y]]
                got = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
                if len(got):
                    yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], schema=out)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def maybe_among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows with maybe: true where column is among ids (doc, distinct, a table), and for some others.

    A bit for the hash of each id, in 16 an id, or FILTER_BITS if that is less, is
    broadcast in chunks; it decides without a shuffle of rows.
    """
    chunk = 1 << 16
    size = min(FILTER_BITS, 1 << max(16, (16 * ids.count() - 1).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(size))

    def mark(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch.column(0).to_numpy()
            for c in np.unique(slots // chunk).tolist():
                held.setdefault(c, np.zeros(chunk, np.uint8))[slots[slots // chunk == c] % chunk] = 1
        if held:
            yield pa.RecordBatch.from_pydict({"_chunk": pa.array(list(held), pa.int64()), "_bits": pa.array([np.packbits(b, bitorder="little").tobytes() for b in held.values()], pa.binary())})

    bits = ids.select(slot("doc").alias("slot")).repartition(min(64, size // chunk), F.floor(F.col("slot") / chunk)).mapInArrow(mark, "_chunk long, _bits binary")
    found = rows.withColumn("_slot", slot(F.col(column).cast("long"))).withColumn("_chunk", F.floor(F.col("_slot") / chunk)).join(F.broadcast(bits), "_chunk", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_slot % 65536 as int) div 8 + 1, 1)")), 16, 10).cast("int")
    test = byte.bitwiseAND(F.expr("shiftleft(1, cast(_slot % 8 as int))")) != 0
    return found.withColumn("maybe", F.coalesce(test, F.lit(False))).drop("_slot", "_chunk", "_bits")


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc, items array<long>): the whole sets of the documents in ids (doc, distinct), a table. A filter of bounded size keeps other texts from being read into sets; a semi-join removes those that still pass."""
    small_batches(docs.sparkSession)

    def run(batches):
        task_starts("ngram_join", _HASHES)
        for batch in batches:
            items = [shingles(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(pa.int64()))], names=["doc", "items"])

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    found = maybe_among(rows, "doc", ids).where("maybe").select("doc", "text").mapInArrow(run, "doc long, items array<long>")
    return found.join(ids.select("doc"), "doc", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a table, whose sets' (doc, items) Jaccard similarity is at least percent hundredths."""
    both = F.size(F.array_intersect("itemsa", "itemsb"))
    return _both(pairs, sets).where(both * 100 >= (F.size("itemsa") + F.size("itemsb") - both) * percent).select("a", "b").distinct()


def _stars(members: DataFrame, centres: DataFrame, rows: int) -> DataFrame:
    """Pairs (a, b) of every class of a group with the group's centre, where their components differ. members: key, doc, component; centres: key, centre, of, met."""
    met = join_hot(members, centres, "key", "met", rows).where("component <> of")
    return met.select(F.greatest("doc", "centre").alias("a"), F.least("doc", "centre").alias("b")).distinct()


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Tables (doc_id, n, same) of all documents and (same, doc, copies, n, keys, sketch) of the classes of equal sets."""
    whole = saved(describe(docs, words, percent), "sketches")
    firsts = [F.first(c).alias(c) for c in ("n", "keys", "sketch")]
    keyed = whole.where("same is not null and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), *firsts)
    out = saved(whole.select("doc_id", "n", "same"), "documents"), saved(keyed, "keyed")
    dropped(docs.sparkSession, whole)
    return out


def _several(members: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """members (key, doc) of the groups that hold several components, with component. found: id, component."""
    named = saved(members.join(found.withColumnRenamed("id", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component")), "named")
    several = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("_met")).where("low <> high").select("key", "_met")
    out = saved(join_hot(named, several, "key", "_met", total), "several")
    dropped(members.sparkSession, named)
    return out


def _of_one_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of the doc_ids that stand for texts of several classes, with each of these."""
    known = rows.where("same is not null and doc_id is not null")
    mark = F.xxhash64("same")
    several = known.groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("doc_id")
    met = join_hot(known.join(several, "doc_id", "left_semi"), classes.select("same", "doc", "copies"), "same", "copies", rows.count())
    return met.where("doc_id <> doc").select(F.greatest("doc_id", "doc").alias("a"), F.least("doc_id", "doc").alias("b")).distinct()


def near_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_shingles, component_id), a row each: the component's id is the smallest doc_id that links reach."""
    Bands(percent)  # refuses what isn't a percentage
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    rows, keyed = _classes(docs, words, percent)
    released(spark)
    keys = keyed.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0)) / KEY_BYTES).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = saved(met_in_groups(keyed, max(least, int(keys // 400_000) + 1)), "met")
    classes = saved(keyed.drop("keys"), "classes")
    dropped(spark, keyed)
    del keyed
    released(spark)

    members = saved(met.where("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("doc")).distinct(), "members")
    two = saved(met.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "two")
    dropped(spark, met)
    sketches = classes.select("doc", "n", "sketch")
    linked, sets, found = saved(_of_one_id(rows, classes), "linked"), None, None
    for step in ("first", "more", "rest"):
        if found is not None:
            before, members = members, _several(members.select("key", "doc"), found, members.count())
            dropped(spark, before)
        total = members.count()
        if found is not None and not total:
            break
        if step == "rest":
            candidates = saved(across(members.join(sketches, "doc"), percent), "candidates")
        else:
            if step == "first":
                centres = members.groupBy("key").agg(F.min("doc").alias("centre"), F.min("doc").alias("of"), F.count("*").alias("met"))
                pairs = two.unionByName(_stars(members.withColumn("component", F.col("doc")), centres, total))
            else:
                # groups of mostly linked classes; in others few pairs pass the sketches, so they wait for the last step
                sizes = members.groupBy("key").agg(F.count("*").alias("_met"), F.countDistinct("component").alias("parts")).where("parts * 2 <= _met").select("key", "_met")
                mostly = saved(join_hot(members, sizes, "key", "_met", total), "mostly")
                by = (F.struct("doc"), F.struct(F.xxhash64("key", "doc").alias("h"), "doc"))
                stars = [_stars(mostly, mostly.groupBy("key").agg(F.max_by("doc", x).alias("centre"), F.max_by("component", x).alias("of"), F.count("*").alias("met")), total) for x in by]
                pairs = stars[0].unionByName(stars[1])
            pairs = saved(pairs.distinct(), "pairs")
            candidates = saved(sketch_filter(pairs, sketches, percent), "candidates")
            dropped(spark, pairs)
        # the sets of earlier steps' candidates are there already
        ids = candidates.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        ids = saved(ids if sets is None else ids.join(sets.select("doc"), "doc", "left_anti"), "ids")
        more = saved(sets_of(docs, ids, words), "sets")
        sets = together(sets, more)
        now = saved(verified(candidates, sets, percent), "linked")
        linked = together(linked, now)
        dropped(spark, ids)
        dropped(spark, candidates)
        dropped(spark, found)
        found = saved(components(linked), "components")
        released(spark)

    named = classes.select("same", "doc", "copies").join(found.withColumnRenamed("id", "doc"), "doc", "left").select("same", "copies", F.coalesce("component", "doc").alias("component_id"))
    named = saved(named, "named")
    out = join_hot(rows.where("same is not null and doc_id is not null"), named, "same", "copies", rows.count())
    lone = rows.where("same is null or doc_id is null").withColumn("component_id", F.col("doc_id"))
    out = saved(out.unionByName(lone).select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "near")
    for table in (rows, classes, members, two, sets, linked, found, named):
        dropped(spark, table)
    return out


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, without the documents whose component holds a smaller doc_id. Only texts that a filter of bounded size can't tell from such are shuffled."""
    near = near_components(docs, words, percent)
    gone = saved(near.where("doc_id <> component_id").select(F.col("doc_id").alias("doc")).distinct(), "gone")
    dropped(docs.sparkSession, near)
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    own = f"c{docs.columns.index('doc_id')}"
    told = maybe_among(named, own, gone)
    left = told.where("not maybe").unionByName(told.where("maybe").join(gone, F.col(own).cast("long") == gone["doc"], "left_anti"))
    return left.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
