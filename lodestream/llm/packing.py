"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents are tokenised and cut into pieces in one map; only the pieces' sizes are shuffled, into random groups
of about ``GROUP`` documents, whatever the input. In a group a best-fit pass gives the first bins. Then
underfull bins are taken apart, emptiest first: a piece moves to another underfull bin, is exchanged for a smaller
piece, or two pieces are exchanged for one, if the sum of squared fills grows. Bins that come out empty are gone. The
search ends when no such step is left in the group.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .util import read, slices

LENGTH, END, GROUP = 1024, 2, 16_384


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and then ``end``; longer ones are cut into pieces of
    ``length``, of which the first may be shorter. Null texts count as empty, so every document has a piece."""
    source = bpe.vocabulary(docs.sparkSession, tokenizer)
    last = end.to_bytes(4, "little")

    def run(batches):
        encode = bpe.ready(source.value)
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            out = []
            for a, b in bpe.blocks(texts):
                for doc, row in zip(ids[a:b], encode(texts[a:b]), strict=True):
                    row += last
                    n = len(row) // 4
                    at, k = 0, 0
                    while at < n:
                        size = (n - at) % length or length if at == 0 else length
                        out.append((doc, k, at, size, zlib.crc32(row[4 * at : 4 * (at + size)])))
                        at, k = at + size, k + 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each piece: longest first, each into the fullest bin that has room. Bins by free room, so a step is a bit scan."""
    bins = np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, b, made = capacity, made, made + 1
        bins[i] = b
        if room > size:
            free[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


class _Underfull:
    """Bins with room by their room, and their pieces by size and room, so the best partner of a size is looked up, not searched."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.capacity, self.kinds = capacity, np.unique(sizes)
        self.kind = np.searchsorted(self.kinds, sizes).tolist()
        self.by_room: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.rooms = 0
        self.cells: dict[tuple[int, int], dict[int, None]] = {}
        self.there = np.zeros((len(self.kinds), capacity + 1), bool)
        #: For each size and room the least room that is as large and that a bin with such a piece has; capacity + 1 if none.
        self.least = np.full((len(self.kinds), capacity + 1), capacity + 1, np.int32)

    def _row(self, kind: int) -> None:
        at = np.where(self.there[kind], np.arange(self.capacity + 1), self.capacity + 1)
        self.least[kind] = np.minimum.accumulate(at[::-1])[::-1]

    def add(self, b: int, room: int, pieces: list[int]) -> None:
        if not 0 < room < self.capacity:
            return
        self.by_room[room][b] = None
        self.rooms |= 1 << room
        for i in pieces:
            cell = self.cells.setdefault((self.kind[i], room), {})
            if not cell:
                self.there[self.kind[i], room] = True
                self._row(self.kind[i])
            cell[i] = None

    def remove(self, b: int, room: int, pieces: list[int]) -> None:
        if not 0 < room < self.capacity:
            return
        del self.by_room[room][b]
        if not self.by_room[room]:
            self.rooms ^= 1 << room
        for i in pieces:
            cell = self.cells[self.kind[i], room]
            del cell[i]
            if not cell:
                del self.cells[self.kind[i], room]
                self.there[self.kind[i], room] = False
                self._row(self.kind[i])

    def best(self, fill: int, own: list[int], sizes: list[int]):
        """The step out of a bin (not in here) that raises the sum most: (pieces given, piece taken, other bin or None); None if none does."""
        ones, given = {}, {}
        for i in own:
            ones.setdefault(sizes[i], i)
        for size, i in ones.items():
            given[size] = (i,)
        distinct = {}
        for i in own:
            distinct.setdefault(sizes[i], []).append(i)
        firsts = [x for same in distinct.values() for x in same[:2]]
        for k, x in enumerate(firsts):
            for y in firsts[k + 1 :]:
                given.setdefault(sizes[x] + sizes[y], (x, y))
        best, choice = 0, None
        for size, i in ones.items():  # into another bin: the fullest that has room
            fitting = self.rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                gain = 2 * size * (self.capacity - room + size - fill)
                if gain > best:
                    best, choice = gain, ((i,), None, next(iter(self.by_room[room])))
        g = np.fromiter(given, np.int64, len(given))
        more = g[:, None] - self.kinds  # what the other bin gains in the exchange
        ok = (more > 0) & (more <= self.capacity)
        room = self.least[np.arange(len(self.kinds)), np.where(ok, more, 0)]
        gains = np.where(ok & (room <= self.capacity), 2 * more * (self.capacity - room + more - fill), 0)
        k = int(np.argmax(gains))
        if gains.flat[k] > best:
            k, kind = divmod(k, len(self.kinds))
            choice = (given[int(g[k])], next(iter(self.cells[kind, int(room[k, kind])])), None)
        return choice


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Better bins by moves, one-for-one and two-for-one exchanges, each of which raises the sum of squared fills.

    Partners are looked for in all underfull bins. Ends at the least number of bins, or when no step out of any bin helps.
    """
    bins, least = bins.tolist(), -(-int(sizes.sum()) // capacity)
    held: dict[int, list[int]] = {}
    for i, b in enumerate(bins):
        held.setdefault(b, []).append(i)
    index, sizes = _Underfull(sizes, capacity), sizes.tolist()
    fill = {b: sum(sizes[i] for i in own) for b, own in held.items()}
    for b, own in held.items():
        index.add(b, capacity - fill[b], own)
    changed = True
    while changed and len(held) > least:
        changed = False
        for a in sorted((b for b in held if fill[b] < capacity), key=lambda b: (fill[b], b)):
            while a in held and fill[a] < capacity and len(held) > least:
                index.remove(a, capacity - fill[a], held[a])
                step = index.best(fill[a], held[a], sizes)
                if step is None:
                    index.add(a, capacity - fill[a], held[a])
                    break
                changed = True
                xs, y, b = step
                b = bins[y] if b is None else b
                index.remove(b, capacity - fill[b], held[b])
                held[a] = [i for i in held[a] if i not in xs] + ([y] if y is not None else [])
                held[b] = [i for i in held[b] if i != y] + list(xs)
                for c in (a, b):
                    fill[c] = sum(sizes[i] for i in held[c])
                    for i in held[c]:
                        bins[i] = c
                    index.add(c, capacity - fill[c], held[c])
                if not held[a]:
                    del held[a], fill[a]
    return np.array(bins, np.int64)


def place(sizes: np.ndarray, capacity: int = LENGTH) -> np.ndarray:
    """The bin of each piece. Pieces that fill a bin have one of their own; the others go through the search."""
    bins = np.empty(len(sizes), np.int64)
    whole = sizes == capacity
    rest = np.flatnonzero(~whole)
    first = 0
    if len(rest):
        packed = local_search(sizes[rest], best_fit(sizes[rest], capacity), capacity)
        _, bins[rest] = np.unique(packed, return_inverse=True)
        first = int(bins[rest].max()) + 1
    bins[whole] = first + np.arange(whole.sum())
    return bins


def assign(rows: DataFrame, documents: int, capacity: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces. Groups are a hash of id, piece, content and place in the scan, so they have about
    ``group`` documents each, however many rows are equal."""
    groups = max(1, round(documents / group))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = table.column("length").to_numpy()
        bins = place(sizes, capacity)
        order = np.lexsort((np.arange(len(bins)), bins))
        ends = np.cumsum(sizes[order])
        starts = ends - sizes[order]
        fresh = np.concatenate(([True], bins[order][1:] != bins[order][:-1]))
        offset = np.empty(len(bins), np.int64)
        offset[order] = starts - np.maximum.accumulate(np.where(fresh, starts, 0))
        key = table.column("part")[0].as_py()
        return table.drop_columns("part").append_column("sequence_id", pa.array((key << 32) + bins)).append_column("offset", pa.array(offset))

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))).groupBy("part").applyInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, **columns) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null ids are kept as null; repeated rows have places of their own; an empty table gives no rows; other columns
    are ignored. ``sequences`` gives the tokens themselves.
    """
    return assign(pieces(docs, tokenizer, length=length, end=end, **columns), docs.count(), length)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """(sequence_id, tokens array<int>) of packed documents with unique ids; a null id counts as an id."""
    ids = bpe.encode(docs, tokenizer).select("doc_id", F.concat("ids", F.array(F.lit(end))).alias("ids"))
    parts = packed.join(ids.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"])).alias("tokens"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), bpe.default_tokenizer())
