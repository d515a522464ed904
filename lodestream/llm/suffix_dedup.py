"""Removal of repeated byte strings by suffix arrays, for a corpus of any size.

A string of ``MATCH`` bytes that occurs twice has the same least hash among its ``GRAM``-byte substrings, its anchor. So every
text is cut into runs of window starts that share an anchor:

1. Each chunk of the input sends its distinct anchors to buckets; a bucket answers, bit by bit, which of them
   another document has too.
2. For shared anchors a chunk sends the distinct strings of its runs, each with the least and the greatest id that has it there, to
   the anchor's bin. So a hot anchor or a text of which there are many copies costs a bin a string for each chunk, however often
   it occurs. A bin writes the distinct strings to a scratch file, in shards by anchor, and sorts all suffixes of a shard by external induced
   sorting; the order comes out block by block, and where common prefixes reach ``MATCH``, the least id that has a window is read off.
3. Stretches of windows that a smaller id has go back to the chunks, which apply them to each occurrence and remove
   the bytes they cover.

Chunks are written once, as compressed Arrow, and meet what comes back for them by their number: a task holds one chunk of
bounded size at a time, whatever the splits of the scan. Every exchange holds arrays compressed as blobs. Chunks are
stored, so a lost task reads the same rows again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .suffix_sort import BUDGET, descending, room
from .util import materialize, read, release, slices

MATCH, GRAM = 50, 16
#: Byte between the strings of a shard: never part of UTF-8.
BORDER = 0xFF
#: Anchors in a bucket, bytes of text that are hashed at a time (a document may be longer), windows in a run, bytes of text in a chunk (a document may be longer).
BUCKET, BLOCK, RUN, CHUNK = 1_500_000, 1 << 20, 128, 12 << 20
#: Bytes of strings that are sorted at a time, and of text for which there is a bin: SHARD, but BIN for what is beyond MANY bins, as every chunk
#: sends something to every bin. A bin gets the strings of shared anchors, up to four times as much if all are.
SHARD, BIN, MANY = 2 << 20, 32 << 20, 256
#: Parts of a bin, by anchor, that are told apart; the tag of stretches among answers.
LEVELS, SPANS = 256, -1
NO_ID = 2**63 - 1


def _hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    h, width, power = text.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while width < GRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power % 2**64, width * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def runs(texts: list[bytes]) -> list[np.ndarray]:
    """Runs of windows with one anchor, RUN of them at most: (document number, first window's place, its last one's, anchor's hash)."""
    out = []
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        lengths = np.array([len(t) for t in texts[start:end]], np.int64)
        base = np.cumsum(lengths) - lengths
        if size >= MATCH:
            out.append(_block_runs(np.frombuffer(b"".join(texts[start:end]), np.uint8), base, lengths, start))
        start = end
    if not out:
        return [np.zeros(0, np.int32)] * 3 + [np.zeros(0, np.uint64)]
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _block_runs(text: np.ndarray, base: np.ndarray, lengths: np.ndarray, first: int):
    h = _hashes(text)
    least, span, width = h, MATCH - GRAM + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    windows = np.maximum(lengths - MATCH + 1, 0)
    new = np.empty(len(least), bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    edges = np.concatenate((base[windows > 0], (base + windows)[windows > 0]))
    new[edges[edges < len(new)]] = True
    new = np.flatnonzero(new)
    doc = np.searchsorted(base, new, side="right") - 1
    real = new < base[doc] + windows[doc]  # a window must not cross into the next document
    until = np.append(new[1:], len(least))[real] - 1
    new, doc = new[real], doc[real]
    many = (until - new) // RUN + 1
    part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    doc, new, until = np.repeat(doc, many), np.repeat(new, many) + part * RUN, np.repeat(until, many)
    last = np.minimum(until, new + RUN - 1)
    key = least[new]  # a least hash is small, so mix it again before hashes are dealt by their size
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return (doc + first).astype(np.int32), (new - base[doc]).astype(np.int32), (last - base[doc]).astype(np.int32), key ^ (key >> np.uint64(32))


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(a.tobytes() for a in arrays), 1)


def shared_anchors(blobs: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Per partition's ascending anchor hashes (lowest bit: two documents of it have it): bits of those that two documents have."""
    hashes = [np.frombuffer(b, np.uint64) for _, b in blobs]
    both = np.concatenate([h | np.uint64(1) for h in hashes]) if hashes else np.zeros(0, np.uint64)
    several = [h[(h & np.uint64(1)) == 1] for h in hashes]
    both.sort()
    shared = np.unique(np.concatenate([both[1:][both[1:] == both[:-1]], *several]))
    out = []
    for (part, _), h in zip(blobs, hashes, strict=True):
        k = np.minimum(np.searchsorted(shared, h | np.uint64(1)), max(0, len(shared) - 1))
        out.append((part, np.packbits(shared[k] == (h | np.uint64(1)) if len(shared) else np.zeros(len(h), bool)).tobytes()))
    return out


def _grouped(doc: np.ndarray, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs by anchor: their order, where each anchor's begin, and the anchors (lowest bit: documents with two ids have it)."""
    h = h & ~np.uint64(1)
    order = np.argsort(h, kind="stable")
    h, who = h[order], ids[doc[order]]
    if not len(h):
        return order, np.zeros(0, np.int64), h
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    several = np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts)
    return order, starts, h[starts] | several.astype(np.uint64)


def _own_anchors(doc: np.ndarray, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ascending distinct anchor hashes; the lowest bit is set if documents with two ids have it."""
    return _grouped(doc, h, ids)[2]


def _cuts(h: np.ndarray, parts: int) -> np.ndarray:
    """Where each bucket's part of ascending hashes begins."""
    edges = np.array([(k << 64) // parts for k in range(parts)], np.uint64)
    return np.concatenate((np.searchsorted(h, edges), [len(h)]))


def shared_strings(texts: list[bytes], ids: np.ndarray, answers: list[tuple[int, bytes]], buckets: int):
    """Runs whose anchor another document has: (document number, first window's place, string's number) of each, and of each distinct string
    (bytes, anchor's hash, least id, greatest id). The same texts and answers give the same numbers."""
    doc, first, last, h = runs(texts)
    order, starts, own = _grouped(doc, h, ids)
    cut = _cuts(own, buckets)
    shared = np.zeros(len(own), bool)
    for bucket, bits in answers:
        n = cut[bucket + 1] - cut[bucket]
        shared[cut[bucket] : cut[bucket + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    hit = order[np.repeat(shared, np.diff(np.append(starts, len(order))))]
    doc, first, last, h = doc[hit], first[hit], last[hit], h[hit] & ~np.uint64(1)
    known: dict[bytes, int] = {}
    spans = zip(doc.tolist(), first.tolist(), last.tolist(), strict=True)
    which = np.fromiter((known.setdefault(texts[d][a : b + MATCH], len(known)) for d, a, b in spans), np.int64, len(doc))
    least, greatest = np.full(len(known), NO_ID, np.int64), np.full(len(known), -(2**63), np.int64)
    np.minimum.at(least, which, ids[doc])
    np.maximum.at(greatest, which, ids[doc])
    anchor = np.zeros(len(known), np.uint64)
    anchor[which] = h
    return doc, first, which, list(known), anchor, least, greatest


def first_owners(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owners: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretches of windows with one first owner, the least owner of a string that has the window: (string, first window, last window, owner), block by block.

    ``text`` has the strings one after another, each with a border; suffixes come from the greatest on, and a group of
    equal windows that goes on in the next block is held until it ends."""
    found, none = room(len(text), np.int64), NO_ID
    found[:] = none
    string, starting = room(len(text), np.int32), room(len(text), bool)
    for a in range(0, len(starts), 1 << 18):
        size = sizes[a : a + (1 << 18)] + 1
        part = np.repeat(np.arange(a, a + len(size), dtype=np.int32), size)
        here = slice(starts[a], starts[a] + len(part))
        string[here] = part
        starting[here] = np.arange(len(part)) <= np.repeat(np.cumsum(size) - 1 - MATCH, size)
    held_at, held_least = np.zeros(0, np.int64), NO_ID
    for at, lcp in descending(text, 256, MATCH, budget, starting):
        whole = starting[at]
        group = np.cumsum(lcp < MATCH, dtype=np.int32)
        at, group = at[whole], group[whole]
        own = string[at]
        at, group = np.concatenate((held_at, at)), np.concatenate((np.zeros(len(held_at), np.int32), group))
        value = np.concatenate((np.full(len(held_at), held_least), owners[own]))
        if not len(at):
            continue
        new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        least = np.minimum.reduceat(value, new)
        ended = new[-1]
        found[at[:ended]] = np.repeat(least[:-1], np.diff(new))
        held_at, held_least = at[ended:], int(least[-1])
    found[held_at] = held_least
    step = 1 << 18
    for a in range(0, len(starts), step):
        low, high = int(starts[a]), int(starts[min(len(starts), a + step) - 1] + sizes[min(len(starts), a + step) - 1]) + 1
        here, own = found[low:high], string[low:high].astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (here[1:] != here[:-1]))))
        end = np.append(new[1:], len(here)) - 1
        real = here[new] != none
        new, end = new[real], end[real]
        yield own[new], new + low - starts[own[new]], end + low - starts[own[new]], np.array(here[new])


def _levels(anchor: np.ndarray, bucket: int, bins: int) -> np.ndarray:
    """Where anchors lie in their bin, in LEVELS parts."""
    inside = (anchor - np.uint64(-(-(bucket << 64) // bins))).astype(np.float64)
    return np.minimum(inside * (LEVELS * bins / 2**64), LEVELS - 1).astype(np.uint8)


#: What is told of a bin's strings: number, windows less one, level, least id, greatest id.
META = np.int32, np.uint8, np.uint8, np.int64, np.int64


def _opened(n: int, meta: bytes) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(meta), 0, []
    for kind in META:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def settle(blobs: list[tuple[int, int, bytes, bytes]], budget: int = BUDGET, shard: int = SHARD) -> Iterator[tuple[int, bytes]]:
    """A bin's answers from (chunk, strings, what is told of them, their bytes): for each chunk, of its strings the stretches of
    windows that an id has which is smaller than the greatest id of the string there.

    Equal strings of several chunks are one; they are told by 128-bit hashes, and only compressed blobs, hashes and
    numbers are held. Distinct strings go to a scratch file, in shards of about ``shard`` bytes, or one level, that are sorted one after another."""
    known: dict[bytes, int] = {}
    which, sizes, least, levels, opener = [], [], [], [], zstandard.ZstdDecompressor()
    for _, n, meta, data in blobs:
        _, size, level, low, _ = _opened(n, meta)
        size = size.astype(np.int64) + MATCH
        text, ends = opener.decompress(data), np.cumsum(size).tolist()
        of = xxhash.xxh3_128_digest
        which.append(np.fromiter((known.setdefault(of(text[a:b]), len(known)) for a, b in zip([0, *ends], ends, strict=False)), np.int64, n))
        sizes.append(size)
        least.append(low)
        levels.append(level)
    if not known:
        return
    count, edges = len(known), np.cumsum([0, *map(len, which)])
    known.clear()
    which = np.concatenate(which)
    first = np.flatnonzero(np.concatenate(([True], which[1:] > np.maximum.accumulate(which)[:-1])))  # strings are numbered as they first occur
    level, size = np.concatenate(levels)[first], np.concatenate(sizes)[first]
    part = (np.cumsum(np.bincount(level, size + 1, LEVELS)) // shard)[level]
    order = np.argsort(part, kind="stable")  # now as they lie in the scratch file
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)
    which, size, part = rank[which], size[order], part[order]
    owners = np.full(count, NO_ID, np.int64)
    np.minimum.at(owners, which, np.concatenate(least))
    ends = np.cumsum(size + 1)
    starts = ends - size - 1
    text = room(int(ends[-1]), np.uint8)
    text[ends - 1] = BORDER
    for k, (*_, data) in enumerate(blobs):
        mine = first[np.searchsorted(first, edges[k]) : np.searchsorted(first, edges[k + 1])]
        if len(mine):
            raw, new = np.frombuffer(opener.decompress(data), np.uint8), which[mine]
            own, begin = size[new], (np.cumsum(sizes[k]) - sizes[k])[mine - edges[k]]
            step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            text[np.repeat(starts[new], own) + step] = raw[np.repeat(begin, own) + step]
            del raw, step
    found = []
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        low = int(starts[a])
        found += [(string + a, *rest) for string, *rest in first_owners(text[low : int(ends[b - 1])], starts[a:b] - low, size[a:b], owners[a:b], budget)]
    string, a, b, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    a, b = a.astype(np.uint8), b.astype(np.uint8)
    begin = np.concatenate(([0], np.cumsum(np.bincount(string, minlength=count))))
    for k, (chunk, n, meta, _) in enumerate(blobs):
        numbers, *_, greatest = _opened(n, meta)
        mine = which[edges[k] : edges[k + 1]]
        many = (begin[1:] - begin[:-1])[mine]
        row = np.repeat(np.arange(n), many)
        stretch = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + begin[mine][row]
        lost = owner[stretch] < greatest[row]
        row, stretch = row[lost], stretch[lost]
        if len(row):
            yield chunk, _pack(numbers[row], a[stretch], b[stretch], owner[stretch])


def lost_spans(doc: np.ndarray, first: np.ndarray, which: np.ndarray, ids: np.ndarray, strings: int, blobs: list[bytes]) -> np.ndarray:
    """(document number, start, end) of what a smaller id has, from the stretches of the partition's strings."""
    if not blobs:
        return np.zeros((0, 3), np.int64)
    columns = [], [], [], []
    for blob in blobs:
        raw = zlib.decompress(blob)
        n = len(raw) // 14
        for column, (a, b, t) in zip(columns, ((0, 4 * n, np.int32), (4 * n, 5 * n, np.uint8), (5 * n, 6 * n, np.uint8), (6 * n, 14 * n, np.int64)), strict=True):
            column.append(np.frombuffer(raw[a:b], t))
    string, a, b, owner = (np.concatenate(c) for c in columns)
    order = np.argsort(string, kind="stable")
    string, a, b, owner = string[order], a[order].astype(np.int64), b[order].astype(np.int64), owner[order]
    begin = np.searchsorted(string, np.arange(strings + 1))
    many = (begin[1:] - begin[:-1])[which]
    row = np.repeat(np.arange(len(which)), many)
    stretch = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + begin[which][row]
    lost = owner[stretch] < ids[doc[row]]
    row, stretch = row[lost], stretch[lost]
    return np.stack([doc[row].astype(np.int64), first[row] + a[stretch], first[row] + b[stretch] + MATCH], axis=1)


def covered(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of overlapping or touching (number, start, end), in order."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    far = spans[:, 2] + spans[:, 0] * (1 << 40)
    reach = np.maximum.accumulate(far)
    new = np.concatenate(([True], spans[1:, 1] + spans[1:, 0] * (1 << 40) > reach[:-1]))
    starts = np.flatnonzero(new)
    ends = np.concatenate((starts[1:], [len(spans)])) - 1
    return np.stack([spans[starts, 0], spans[starts, 1], reach[ends] - spans[starts, 0] * (1 << 40)], axis=1)


def chunks(plain: DataFrame) -> DataFrame:
    """(chunk, size, rows): the rows of (doc_id, text, ...) in parts of about CHUNK bytes of text, or one document, as compressed Arrow."""

    def run(batches):
        number = TaskContext.get().partitionId() << 33

        def packed(held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
            nonlocal number
            sink, table = pa.BufferOutputStream(), pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "size", "rows"])

        held, size, most = [], 0, 0
        for batch in slices(batches):
            start = 0
            for k, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
                size, most = size + n, most + n + 64
                if most >= CHUNK:
                    yield packed([*held, batch.slice(start, k + 1 - start)], size)
                    held, size, most, start = [], 0, 0, k + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield packed(held, size)

    return plain.mapInArrow(run, "chunk bigint, size bigint, rows binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), as_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, kept binary, spans array<struct<start, stop>> of the maximal removed runs.

    Every byte goes that a string of ``MATCH`` bytes covers which also starts in a document with a smaller id. Null
    texts are empty, null ids come after all others, rows with one id don't count as each other's earlier documents; an
    empty table gives no rows. The columns in ``carry`` come along. With
    ``as_text`` kept is a string, without what is left of a cut character. ``docs`` is read once and written to the shared folder in chunks.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *carry)
    stored = materialize(chunks(plain), "suffix-chunks")
    total = stored.agg(F.sum("size")).first()[0] or 0
    base = stored.select("chunk", "rows")
    buckets = max(12, -(-total * 2 // ((MATCH - GRAM + 2) * BUCKET)))
    bins = max(12, min(-(-total // SHARD), MANY + -(-total // BIN)))

    def rows_of(blob) -> tuple[np.ndarray, list[bytes], pa.Table]:
        table = pa.ipc.open_stream(blob).read_all()
        return table.column(0).fill_null(NO_ID).to_numpy(), table.column(1).cast(pa.binary()).to_pylist(), table

    def send_anchors(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, texts, _ = rows_of(blob.as_buffer())
                doc, _, _, h = runs(texts)
                own = _own_anchors(doc, h, ids)
                cut = _cuts(own, buckets)
                full = np.flatnonzero(np.diff(cut))
                hashes = pa.array([own[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk, np.int64)), hashes], names=["bucket", "chunk", "hashes"])
        release()

    def answer(table: pa.Table) -> pa.Table:
        out = shared_anchors([(c, h.as_buffer()) for c, h in zip(table.column("chunk").to_pylist(), table.column("hashes"), strict=True)])
        release()
        chunk, bits = zip(*out, strict=True)
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "tag": pa.array([table.column("bucket")[0].as_py()] * len(out), pa.int32()), "found": pa.array(bits, pa.binary())})

    def tagged(table: pa.Table):
        return zip(table.column("tag").to_pylist(), (x.as_buffer() for x in table.column("found")), strict=True)

    def send_strings(here: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if here.num_rows and answers.num_rows:
            ids, texts, _ = rows_of(here.column("rows")[0].as_buffer())
            _, _, _, strings, anchor, least, greatest = shared_strings(texts, ids, list(tagged(answers)), buckets)
            texts.clear()
            edges = _cuts(anchor, bins)  # strings come by anchor
            closer = zstandard.ZstdCompressor(3)
            for k in np.flatnonzero(np.diff(edges)).tolist():
                s = slice(edges[k], edges[k + 1])
                sizes = np.array([len(x) - MATCH for x in strings[s]], np.uint8)
                out.append((k, len(sizes), _pack(np.arange(s.start, s.stop, dtype=np.int32), sizes, _levels(anchor[s], k, bins), least[s], greatest[s]), closer.compress(b"".join(strings[s]))))
        release()
        k, n, meta, data = zip(*out, strict=True) if out else [()] * 4
        chunk = [here.column("chunk")[0].as_py()] * len(out) if out else []
        return pa.table({"bin": pa.array(k, pa.int32()), "chunk": pa.array(chunk, pa.int64()), "n": pa.array(n, pa.int32()), "meta": pa.array(meta, pa.binary()), "data": pa.array(data, pa.binary())})

    def sort_bin(table: pa.Table) -> pa.Table:
        columns = [[x.as_buffer() for x in table.column(c)] for c in ("meta", "data")]
        out = list(settle(list(zip(table.column("chunk").to_pylist(), table.column("n").to_pylist(), *columns, strict=True)), shard=SHARD))
        release()
        chunk, found = zip(*out, strict=True) if out else [()] * 2
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "tag": pa.array([SPANS] * len(out), pa.int32()), "found": pa.array(found, pa.binary())})

    def keep(here: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts, rows = rows_of(here.column("rows")[0].as_buffer())
        both = list(tagged(answers))
        found = [x for tag, x in both if tag == SPANS]
        gone = np.zeros((0, 3), np.int64)
        if found:
            doc, first, which, strings, *_ = shared_strings(texts, ids, [x for x in both if x[0] != SPANS], buckets)
            gone = covered(lost_spans(doc, first, which, ids, len(strings), found))
            del strings
        edges = np.searchsorted(gone[:, 0], np.arange(len(texts) + 1))
        sizes, spans = pa.array(list(map(len, texts)), pa.int64()), gone[:, 1:].tolist()
        for k, raw in enumerate(texts):
            at, left = 0, []
            for a, b in spans[edges[k] : edges[k + 1]]:
                left.append(raw[at:a])
                at = b
            left.append(raw[at:])
            kept = b"".join(left)
            texts[k] = kept.decode("utf-8", "ignore") if as_text else kept
        both = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(gone[:, k])) for k in (1, 2)], names=["start", "stop"])
        columns = [rows.column(0), sizes, pa.array(texts, pa.string() if as_text else pa.binary()), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), both)]
        out = pa.table([*columns, *(rows.column(c) for c in carry)], names=["doc_id", "n_bytes", "kept", "spans", *carry])
        release()
        return out

    found = "chunk bigint, tag int, found binary"
    anchors = base.mapInArrow(send_anchors, "bucket int, chunk bigint, hashes binary")
    answers = materialize(anchors.groupBy("bucket").applyInArrow(answer, found), "suffix-shared")
    strings = base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(send_strings, "bin int, chunk bigint, n int, meta binary, data binary")
    spans = materialize(strings.groupBy("bin").applyInArrow(sort_bin, found), "suffix-spans")
    schema = T._parse_datatype_string(f"doc_id bigint, n_bytes bigint, kept {'string' if as_text else 'binary'}, spans array<struct<start:bigint,stop:bigint>>")
    both = answers.unionByName(spans)
    return base.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(keep, T.StructType([*schema, *(plain.schema[c] for c in carry)]))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the text; what is left of a cut character goes too. Every row stays."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    hidden = {c: f"_{k}" for k, c in enumerate(others)}
    out = remove_repeats(docs.withColumnsRenamed(hidden), id_col, text_col, carry=list(hidden.values()), as_text=True, **options)
    whole = out.select(F.col("doc_id").alias(id_col), F.col("kept").alias(text_col), *[F.col(v).alias(k) for k, v in hidden.items()])
    return whole.select(*docs.columns)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", n_removed.cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
