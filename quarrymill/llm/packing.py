"""Best-fit packing: bounded-space online best-fit of token pieces into fixed-length sequences.

A document's ids end with an end mark. Only documents longer than a sequence are cut,
into pieces of exactly that length but for the first. A fixed number of bins is open
in each task; a bitset keyed by free space finds the fullest bin that still takes a
piece; where all are open and none takes it, the fullest closes. Pieces of a whole
sequence take one each.

Two steps: the texts become rows of piece lengths (narrow; no text is shuffled), which
are written to the shared folder; these are dealt out by hash into tasks of about
pieces_a_task, in the order of a hash, and packed there. A document in a group of
copies is a row like any other, and rows of one doc_id or of none are told apart by
their place in the table, so no key can be hot.

Null texts count as empty: the end mark alone. Texts are encoded whole. Repeated rows
are packed each. Pieces of equal length are taken in the order of the hash. Columns
other than doc_id and text, whatever their names, are not read; pack() passes all
columns on. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches, task_starts


class Packer:
    """Bounded-space best-fit: bit f of the set is on while an open bin has f tokens free."""

    def __init__(self, capacity: int, most_open: int) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.bits = 0
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        """The (bin, offset) where a piece of size tokens goes."""
        if size >= self.capacity:
            self.made += 1
            return self.made - 1, 0
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            which, used = self._take(free)
        else:
            if self.open >= self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
            which, used = self.made, 0
            self.made += 1
        left = self.capacity - used - size
        if left:
            self.bins[left].append((which, used + size))
            self.bits |= 1 << left
            self.open += 1
        return which, used

    def _take(self, free: int) -> tuple[int, int]:
        bins = self.bins[free]
        got = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return got


#: The byte-level pre-tokenization splits before every single space between other characters, so a space and what follows is encoded on its own.
class Chunks(dict):
    """Little-endian ids of space-led chunks seen; bounded: cleared when it holds most chunks. A chunk that white space touches can't stand alone: KeyError."""

    def __init__(self, encode, most: int = 400_000) -> None:
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise KeyError(chunk)
        if len(self) >= self.most:
            self.clear()
        ids = self.encode(" " + chunk)
        if len(chunk) <= 48:
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of a byte-level tokenizer file, as little-endian unsigned 32-bit bytes; equal to what the tokenizers library gives."""

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        from .token_counts import byte_letters

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        letters, added = byte_letters(), set(self.added)
        ranks = {bytes(letters[c] for c in t): k for t, k in spec["model"]["vocab"].items() if t not in added}
        # Fixed value: the pattern of the library's ByteLevel pre-tokenizer.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        # the merged ids must follow the merges' order for ranks to stand for them; else the library encodes all
        merged = [k for t, k in spec["model"]["vocab"].items() if len(t) > 1 and t not in added]
        order = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"][m] for m in order]
        fast = spec.get("pre_tokenizer", {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer") and ids == sorted(ids) and len(ids) == len(merged)
        if fast:
            plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.plain = lambda t: np.array(plain.encode_ordinary(t), dtype="<u4").tobytes()
            self.chunks = Chunks(self.plain)
        else:
            self.plain = self.chunks = None

    def __call__(self, text: str) -> bytes:
        if self.chunks is None or any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return self.plain(text)
        chunks = self.chunks
        try:
            return b"".join([self.plain(first), *[chunks[c] for c in rest]]) if first else b""
        except KeyError:
            return self.plain(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, ids: bool = False) -> DataFrame:
    """docs (doc_id, text) to (doc_id, piece, start, length, ids_crc32), with ids=True also the ids themselves."""
    small_batches(docs.sparkSession)
    schema = _PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if ids else _PIECES

    def run(batches):
        task_starts("packing", _ENCODERS)
        encode, end = encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = (encode(t) if t else b"") + end
                n = len(b) // 4
                cut = [0] if n <= capacity else [0, *range(n % capacity or capacity, n, capacity)]
                for k, (s, e) in enumerate(zip(cut, [*cut[1:], n], strict=True)):
                    part = b[4 * s : 4 * e]
                    for to, v in zip(rows, (doc, k, s, e - s, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if ids else [])), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema, strict=True)], schema=schema)

    spark_schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, spark_schema)


def pack(parts: DataFrame, capacity: int = 1024, most_open: int = 4096, window: int = 4096, pieces_a_task: int = 50_000) -> DataFrame:
    """parts (with doc_id, piece, length) with sequence_id and offset added.

    The pieces come to the packer in windows, the longest of a window first, which
    leaves about a thousandth of the space unused where arrival order leaves a fortieth.
    parts is read twice, so it should be a table. The number of tasks follows the
    number of pieces; each holds one window and the free space of its open bins only.
    """
    n = max(4, -(-parts.count() // pieces_a_task))
    order = F.xxhash64("doc_id", "piece")
    dealt = parts.withColumn("_order", order).repartition(n, F.xxhash64("doc_id", "piece", "start", "length", F.monotonically_increasing_id() % 1024)).sortWithinPartitions("_order", "doc_id", "piece", "start", "length").drop("_order")
    dealt = dealt.withColumn("_task", F.spark_partition_id())
    of = dealt.columns.index("_task")

    def packed(table: pa.Table, packer: Packer):
        sizes = table.column("length").to_numpy()
        first = table.column(of)[0].as_py() << 40
        ids, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int32)
        for k in np.argsort(-sizes, kind="stable").tolist():
            which, offsets[k] = packer.put(int(sizes[k]))
            ids[k] = first + which
        out = table.remove_column(of).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))
        return out.combine_chunks().to_batches()

    def run(batches):
        packer, held, rows = Packer(capacity, most_open), [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= window:
                table = pa.Table.from_batches(held)
                yield from packed(table.slice(0, window), packer)
                held, rows = table.slice(window).to_batches(), rows - window
        if rows:
            yield from packed(pa.Table.from_batches(held), packer)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields if f.name != "_task"]
    return dealt.mapInArrow(run, ", ".join([*kept, "sequence_id long", "offset int"]))


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of docs with the sequence and offset that each goes to."""
    return pack(saved(pieces(docs, path, capacity, end_id), "pieces"), capacity)
