"""Sharding by histogram sort, in DataFrame functions only.

Documents are ordered by (hash of the text, id, place in the scan), so equal texts are neighbours and a group of copies of
any size, even of rows that repeat the id too, can be cut. Splitters come from exact byte counts below candidate boundaries:
each round counts the bytes in every slice of the still open key ranges over all partitions, and probes
only the slices that hold a wanted cut more finely, until each cut lies within the tolerance. Cuts that fall inside one
key are looked for in the next part of the key, for all such keys at once. One
exchange then brings every cell to one task, and positions follow from the cells' exact row counts.

Only counts come to the driver: ``2**FIRST_BITS`` at first, then ``2**STEP_BITS`` for each open cut.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import fresh, materialize, read

FIRST_BITS, STEP_BITS = 12, 8
ROW_BYTES = 16
#: The sign bit; with it flipped, signed order is the order of the 64 bits.
LOW = -(2**63)
#: The order's key, one after another.
KEY = ("hash", "id", "row")


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint")


def _unsigned(c: Column) -> Column:
    """64-bit numbers so that unsigned order is the signed order of ``c``."""
    return c.bitwiseXOR(F.lit(LOW))


def _table(spark: SparkSession, rows: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """A few rows of numbers, as one literal."""
    data = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{', '.join(f'{n}:bigint' for n in names)}>>")))


def _slices(rows: DataFrame, lead: tuple[str, ...], key: str, ranges: set[tuple[tuple[int, ...], int]], width: int, bits: int) -> dict[tuple[int, ...], list[tuple[int, int, int]]]:
    """For each group (the leading keys' values) exact (start, bytes, rows) of the slices that hold rows, when each range [start, start + 2**width) is cut into 2**bits."""
    unsigned = _unsigned(F.col(key))
    if width < 64 or lead:
        names = [*(f"_{c}" for c in lead), "_prefix"]
        prefix = F.shiftrightunsigned(unsigned, width) if width < 64 else F.lit(0)
        wanted = _table(rows.sparkSession, sorted({(*map(_signed, g), _bits(lo >> width)) for g, lo in ranges}), names)  # at most one for each cut
        same = [F.col(c) == F.col(f"_{c}") for c in lead] + [prefix == F.col("_prefix")]
        rows = rows.join(F.broadcast(wanted), same)
    cell = F.shiftrightunsigned(unsigned, width - bits) if width > bits else unsigned
    found: dict[tuple[int, ...], list] = {}
    for r in rows.groupBy(*lead, cell.alias("cell")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():  # at most len(ranges) * 2**bits rows
        found.setdefault(tuple(r[c] - LOW for c in lead), []).append(((r["cell"] % 2**64) << (width - bits), r["size"], r["n"]))
    return {g: sorted(x) for g, x in found.items()}


def _cuts(rows: DataFrame, lead: tuple[str, ...], key: str, todo: dict[int, tuple[tuple[int, ...], int]], slack: int, done: dict[int, tuple[int, ...]]) -> dict[int, tuple[tuple[int, ...], int]]:
    """Finds each target (bytes that should precede a cut) among the rows of its group: ``todo`` has the group and the exact bytes before it.

    Each round counts exactly and probes finer, until a boundary is within ``slack`` bytes of the target, or the slice
    holds one row (then the nearer side is taken); these go to ``done``, as unsigned keys. Targets inside the rows of one key are returned."""
    start, width = {(): 0}, 64
    if lead:  # the ids of few copies are close together: only their common range is probed
        names = [f"_{c}" for c in lead]
        groups = _table(rows.sparkSession, sorted({tuple(map(_signed, g)) for g, _ in todo.values()}), names)
        mine = rows.join(F.broadcast(groups), [F.col(c) == F.col(f"_{c}") for c in lead]).groupBy(*lead).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        ends = {tuple(r[c] - LOW for c in lead): (r["lo"] - LOW, r["hi"] - LOW) for r in mine}
        width = max(1, *((a ^ b).bit_length() for a, b in ends.values()))
        start = {g: a >> width << width for g, (a, _) in ends.items()}
    ranges, inside = {t: (g, start[g], below) for t, (g, below) in todo.items()}, {}
    bits = min(STEP_BITS if lead else FIRST_BITS, width)
    while ranges:
        counted = _slices(rows, lead, key, {(g, lo) for g, lo, _ in ranges.values()}, width, bits)
        finer, nxt = width - bits, {}
        for t, (g, lo, below) in ranges.items():
            slices = counted.get(g, [])
            for k in range(bisect_left(slices, (lo,)), len(slices)):
                at, size, n = slices[k]
                if below + size < t and at < lo + 2**width:
                    below += size
                    continue
                if t - below <= slack:
                    done[t] = (*g, at)
                elif below + size - t <= slack or n == 1:
                    done[t] = (*g, at + 2**finer) if below + size - t < t - below else (*g, at)
                elif finer == 0:
                    inside[t] = ((*g, at), below)
                else:
                    nxt[t] = (g, at, below)
                break
            else:
                done[t] = (*g, min(lo + 2**width, 2**64 - 1))
        ranges, width = nxt, finer
        bits = min(STEP_BITS, width)
    return inside


def splitters(rows: DataFrame, parts: int, slack: int) -> list[tuple[int, ...]]:
    """``parts - 1`` ascending (hash, id, row) as signed numbers: a part begins with the first row at or after its splitter."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    todo = {t: ((), 0) for t in {total * k // parts for k in range(1, parts)}} if total else {}
    done: dict[int, tuple[int, ...]] = {}
    for depth, key in enumerate(KEY):
        todo = _cuts(rows, KEY[:depth], key, todo, slack, done) if todo else {}
    out = [(*cut, *[0] * (len(KEY) - len(cut))) for cut in done.values()]
    out += [(2**64 - 1,) * len(KEY)] * (parts - 1 - len(out))  # fewer rows than parts
    return [tuple(map(_signed, cut)) for cut in sorted(out)]


def _signed(x: int) -> int:
    return min(x, 2**64 - 1) - 2**63


def _bits(x: int) -> int:
    """64 bits as Spark's signed number."""
    return x - 2**64 if x >= 2**63 else x


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.005, cells: int = 8, stored: bool = False) -> DataFrame:
    """All columns of ``docs`` plus size, text_crc32, shard (0 to ``shards`` - 1, by bytes) and slot (gapless from 0).

    Every shard holds the mean bytes, give or take ``tolerance`` of it and half a document at each end. Equal texts are
    neighbours in the order. Null texts count as empty, null ids come first, rows that repeat in id and text come in
    the order of the scan and are cut like others. An empty table gives no rows. Columns of ``docs`` that are named like an added one are replaced.
    ``docs`` is written to the shared folder first unless it is ``stored``, a plain read of a table.
    """
    docs = docs if stored else materialize(docs, "shard-docs")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.xxhash64(text).alias("hash"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOW)).alias("id"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(docs.select(key.alias("key"), size_of(F.col(text_col)).alias("size")).select("key.*", "size"), "shard-keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    cut = splitters(rows, shards * cells, int(total / shards * tolerance))
    bounds = F.from_json(F.lit(json.dumps([dict(zip(KEY, x, strict=True)) for x in cut])), f"array<struct<{', '.join(f'{c}:bigint' for c in KEY)}>>")  # folded to one literal

    def cell_of(k: Column) -> Column:
        return F.size(F.filter(bounds, lambda b: b <= k)) if cut else F.lit(0)

    counts = dict(rows.groupBy(cell_of(F.struct(*KEY)).alias("cell")).count().collect())  # shards * cells rows
    before, at = [], 0
    for c in range(shards * cells):
        at = 0 if c % cells == 0 else at
        before.append(at)
        at += counts.get(c, 0)
    name, cell = fresh(docs, "key", "cell")
    out = docs.withColumn(name, key).withColumns({"size": size_of(F.col(text_col)), "text_crc32": F.crc32(text)})
    out = out.withColumn(cell, cell_of(F.col(name)))
    in_cell = F.row_number().over(Window.partitionBy(cell).orderBy(name))
    offset = F.element_at(F.from_json(F.lit(json.dumps(before)), "array<bigint>"), F.col(cell) + 1)
    return out.withColumns({"slot": in_cell - 1 + offset, "shard": F.floor(F.col(cell) / cells).cast("int")}).drop(name, cell)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents").select("doc_id", "text"), 40, stored=True)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
