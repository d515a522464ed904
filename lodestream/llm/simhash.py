"""SimHash near-dedup with covering locality-sensitive hashing.

Give every bit of a fingerprint a non-zero vector of ``radius + 1`` bits. For each non-zero vector v there is a
table whose mask has the bits with an odd product with v. At most ``radius`` differing bits leave some v
orthogonal to all of their vectors, so the pair agrees under that mask: every pair within the radius
collides in some table, with certainty.

Tables hold distinct fingerprints only. Inside a bucket links are found by a walk that compares each
fingerprint with those not reached yet, so a dense bucket gives a spanning forest, not all its pairs. Heavy buckets,
which a frequent-items sketch proposes and an exact count verifies, are dealt again by quarters of the fingerprint, twice
with other borders: one quarter of a close pair is always equal. What a bucket has left after that agrees in
most bits, and a walk over many fingerprints goes on dealing them by quarters in its task.

With ``percent`` the fingerprints only propose: a document gets several of them, documents that links of any one reach
are compared by the exact Jaccard similarity of their sets of shingles, and only pairs that are similar enough count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .util import fresh, materialize, read, release, slices

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints in a bucket from which it is dealt again, rows that one call looks at on average, and buckets the sketch proposes and tracks.
SPLIT, CHUNK, HEAVY, TRACKED = 20_000, 600_000, 1024, 8192
#: For ``percent``: fingerprints of a document, words in a shingle of them, differing bits up to which a shared bucket proposes, and shingles of the sets that one call compares.
PRINTS, PRINT_SHINGLE, REACH, COMPARED = 12, 2, 8, 4_000_000


def digests(raw: bytes, shingle: int) -> list[bytes]:
    """XXH64 hashes (seed 42) of all word shingles, A-Z lower-cased; a shorter text is one shingle, none without words."""
    words = raw.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    of = xxhash.xxh64_digest
    return [of(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)]


def simhashes(raw: bytes, shingle: int = SHINGLE, prints: int = 1) -> list[int]:
    """Bits set in over half of the hashes of all word shingles; 0 without words. The hash of the first is XXH64, of others XXH64 mixed with their number."""
    hashes = np.frombuffer(b"".join(digests(raw, shingle)), ">u8").astype(np.uint64)
    n = len(hashes)
    if not n:
        return [0] * prints
    mixed = np.empty((n, prints), ">u8")
    mixed[:, 0] = hashes
    for k in range(1, prints):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed[:, k] = x ^ (x >> np.uint64(31))
    bits = np.unpackbits(mixed.view(np.uint8), axis=1)
    total = np.zeros(64 * prints, np.int64)
    for start in range(0, n, 255):  # sums of 255 bits fit a byte
        total += bits[start : start + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > n).view(">u8").tolist()


def simhash(raw: bytes, shingle: int = SHINGLE) -> int:
    return simhashes(raw, shingle)[0]


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp bigint): the signed form of each whole text's fingerprint; null texts count as empty."""

    def run(batches):
        for batch in slices(batches):
            out = [simhash(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return _plain(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def masks(radius: int = RADIUS) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits, as signed 64-bit numbers."""
    vectors = [k % (2 ** (radius + 1) - 1) + 1 for k in range(64)]
    out = [sum(1 << k for k, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - 2**64 if m >= 2**63 else m for m in out]


def _walk(fps: np.ndarray, at: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (as numbers in ``at``) that connect what fingerprints within the radius connect: each is compared with those not reached yet."""
    links = []
    while len(at):
        queue, at, fps = [(at[0], fps[0])], at[1:], fps[1:]
        while queue and len(at):
            k, fp = queue.pop()
            near = np.bitwise_count(fps ^ fp) <= radius
            if near.any():
                links += [(k, x) for x in at[near]]
                queue += zip(at[near], fps[near], strict=True)
                at, fps = at[~near], fps[~near]
    return links


def linked(fps: np.ndarray, at: np.ndarray, radius: int, reach: int, low: int = 0, high: int = 64) -> list[tuple[int, int]]:
    """``_walk``; many fingerprints are dealt by blocks of their bits from ``low`` to ``high``, of which a close pair has one in common, again and again."""
    width = (high - low) // (radius + 1)
    if len(fps) <= SPLIT or not width:
        return _walk(fps, at, reach)
    out = []
    for j in range(radius + 1):
        block = (fps >> np.uint64(low + j * width)) & np.uint64((1 << width) - 1)
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], block[order][1:] != block[order][:-1], [True])))
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                here = order[a:b]  # the next deal is by the larger part beside this block
                below, above = (low, low + j * width), (low + (j + 1) * width, high)
                out += linked(fps[here], at[here], radius, reach, *max(below, above, key=lambda x: x[1] - x[0]))
    return out


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    return [(fps[a], fps[b]) for a, b in linked(fps, np.arange(len(fps)), radius, radius)]


def spanning(links: np.ndarray) -> np.ndarray:
    """Those of the links (rows of two numbers) that join something not joined yet, the first first."""
    names, ends = np.unique(links, return_inverse=True)
    root, kept = list(range(len(names))), []
    for k, (a, b) in enumerate(ends.reshape(-1, 2).tolist()):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(k)
    return links[kept]


def _quarters(fp: Column, radius: int, turn: int) -> Column:
    """Blocks (number, bits) of the fingerprint, turned by ``turn`` bits first."""
    turned = F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, 64 - turn)) if turn else fp
    width = 64 // (radius + 1)
    return F.array(*[F.struct(F.lit(j).alias("j"), F.shiftrightunsigned(F.shiftleft(turned, 64 - width * (j + 1)), 64 - width).alias("bits")) for j in range(radius + 1)])


def _heavy(rows: DataFrame) -> list[int]:
    """Buckets with more than SPLIT rows. A sketch proposes; a bucket that it could miss has under 1/1000 of all rows."""
    top = rows.agg(F.expr(f"approx_top_k(bucket, {HEAVY}, {TRACKED})").alias("top")).select(F.explode("top").alias("t"))
    names = [r[0] for r in top.filter(F.col("t.count") > SPLIT).select("t.item").collect()]  # at most HEAVY
    counted = rows.filter(F.col("bucket").isin(names)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")) if names else None
    return [r[0] for r in counted.filter(F.col("n") > SPLIT).select("bucket").collect()] if names else []


def links(nodes: DataFrame, radius: int = RADIUS, reach: int | None = None) -> DataFrame:
    """(a, b): links among nodes (node bigint, prints array<bigint>) that join all pairs which are within the radius in some of their fingerprints, directly or not.

    A ``reach`` above the radius also links pairs that share a bucket and differ in as many bits at most."""
    reach = reach or radius
    made = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks(radius))])
    rows = nodes.select("node", F.posexplode("prints").alias("p", "fp")).select("node", "p", "fp", F.explode(made).alias("t"))
    rows = rows.select("node", "fp", F.xxhash64("p", "t.table", "t.key").alias("bucket"))
    size = nodes.agg(F.sum(F.size("prints").cast("bigint"))).first()[0] or 0
    calls = size * (2 ** (radius + 1) - 1) // CHUNK + 1
    parts = []
    for turn in (0, 8):
        hot = _heavy(rows)
        if not hot:
            break
        parts.append(rows.filter(~F.col("bucket").isin(hot)))
        again = rows.filter(F.col("bucket").isin(hot)).select("node", "fp", "bucket", F.explode(_quarters(F.col("fp"), radius, turn)).alias("b"))
        rows = again.select("node", "fp", F.xxhash64("bucket", "b.j", "b.bits").alias("bucket"))
    for part in parts:
        rows = rows.unionByName(part)

    def run(table: pa.Table) -> pa.Table:
        bucket, fp, node = (table.column(c).to_numpy() for c in ("bucket", "fp", "node"))
        order = np.lexsort((fp, bucket))
        bucket, fp, node = bucket[order], fp[order].view(np.uint64), node[order]
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        many = np.flatnonzero(np.diff(edges) > 1)
        found = [x for a, b in zip(edges[many], edges[many + 1], strict=True) for x in linked(fp[a:b], node[a:b], radius, reach)]
        both = spanning(np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0))
        del bucket, fp, node, order, found
        release()
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return rows.groupBy(F.pmod("bucket", F.lit(calls)).alias("call")).applyInArrow(run, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest id that links reach, itself included).

    Documents are linked if their fingerprints differ in ``radius`` bits at most; texts without words have fingerprint
    0 and are linked like any other. Repeated rows stay; null ids never name a component that has others. An
    empty table gives no rows; other columns are ignored.
    """
    own = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links(nodes.select(F.col("fp").alias("node"), F.array("fp").alias("prints")), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return own.join(materialize(named, "simhash-names"), "fp").select("doc_id", "fp", "component_id")


def shingle_set(raw: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of all word shingles, in order."""
    return np.unique(np.frombuffer(b"".join(digests(raw, shingle)), np.uint64))


def alike(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what a Jaccard similarity of at least ``percent`` connects: each set is compared with those not reached yet, through lists of who has a shingle."""
    sizes = np.array(list(map(len, sets)), np.int64)
    ends = np.cumsum(sizes)
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    who = owner[np.argsort(gram, kind="stable")]
    count = np.bincount(gram) if len(gram) else np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    reached, out = np.zeros(len(sets), bool), []
    for k in range(len(sets)):
        queue = [] if reached[k] else [k]
        reached[k] = True
        while queue and not reached.all():
            x = queue.pop()
            grams = gram[ends[x] - sizes[x] : ends[x]]
            lengths = count[grams]
            at = np.repeat(first[grams] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            both = np.bincount(who[at], minlength=len(sets))
            near = np.flatnonzero(~reached & (100 * both >= percent * (sizes + sizes[x] - both)))
            reached[near] = True
            out += [(x, y) for y in near]
            queue += near.tolist()
    return out


def similar_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members (part, node, grams binary of 64-bit hashes): links that join all pairs of a part which are similar enough, directly or not.

    A part with more than COMPARED shingles is cut into blocks; each pair of blocks is compared on its own, so memory is bounded whatever the part's size."""
    sized = members.withColumn("size", F.floor(F.octet_length("grams") / 8))
    parts = sized.groupBy("part").agg(F.ceil(F.sum("size") / COMPARED).alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = sized.join(parts, "part").withColumn("own", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest("blocks", F.lit(1)) - 1)))
    dealt = dealt.withColumn("cell", F.xxhash64("part", F.least("own", "other"), F.greatest("own", "other"))).select("cell", "node", "grams")
    calls = (parts.join(sized, "part").agg(F.sum("size")).first()[0] or 0) // (COMPARED // 4) + 1  # a call holds all of its cells

    def run(table: pa.Table) -> pa.Table:
        cell, node, grams = table.column("cell").to_numpy(), table.column("node").to_numpy(), table.column("grams")
        order = np.argsort(cell, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], cell[order][1:] != cell[order][:-1], [True])))
        found = []
        for a, b in zip(edges, edges[1:], strict=False):
            rows = order[a:b]
            sets = [np.frombuffer(grams[int(k)].as_py(), np.uint64) for k in rows]
            found += [(node[rows[x]], node[rows[y]]) for x, y in alike(sets, percent)] if b - a > 1 else []
        both = np.array(found, np.int64).reshape(-1, 2)
        release()
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return dealt.groupBy(F.pmod("cell", F.lit(calls)).alias("call")).applyInArrow(run, "a bigint, b bigint").distinct()


def similar_groups(docs: DataFrame, percent: int, shingle: int, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, prints: int = PRINTS, stored: bool = False) -> DataFrame:
    """One row per document: row (its place in the scan), doc_id, component_id (the smallest id that links reach, itself included).

    Documents are linked if the links of their fingerprints (``prints`` of them, over shingles of two words) connect them
    and their sets of ``shingle``-word shingles have a Jaccard similarity of at least ``percent``. Pairs within ``radius`` in some
    fingerprint are never missed; others may be, the less similar the sooner. Texts without words are linked to each
    other. Repeated rows stay; null ids never name a component that has others; an empty table gives no rows; other columns are ignored.
    ``docs`` is written to the shared folder first unless it is ``stored``, a plain read of a table.
    """
    plain = _plain(docs, id_col, text_col)
    plain = plain if stored else materialize(plain, "near-docs")

    def first(batches):
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            several = pa.array([np.array(simhashes(t, PRINT_SHINGLE, prints), np.uint64).view(np.int64) for t in texts], pa.list_(pa.int64()))
            signs = pa.array([xxhash.xxh3_128_digest(shingle_set(t, shingle).tobytes()) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), several, signs], names=["row", "doc_id", "prints", "sign"])

    placed = plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    own = materialize(placed.mapInArrow(first, "row bigint, doc_id bigint, prints array<bigint>, sign binary"), "near-prints")
    nodes = materialize(own.groupBy("sign").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.min_by("prints", "row").alias("prints")), "near-nodes")
    close = components(links(nodes, radius, REACH))

    def second(batches):
        for batch in slices(batches):
            sets = pa.array([shingle_set(t or b"", shingle).tobytes() for t in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], names=["part", "node", "grams"])

    # texts come a batch at a time, not a split; the join is the same at every size
    proposed = placed.join(close.hint("merge"), F.col("row") == F.col("node")).select("root", "node", "text")
    members = materialize(proposed.mapInArrow(second, "part bigint, node bigint, grams binary"), "near-members")
    roots = components(similar_links(members, percent))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sign", "component_id"), "near-names")
    return own.join(named, "sign").select("row", "doc_id", "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int | None = None, shingle: int | None = None, **options) -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group stays, all columns unchanged.

    Without ``percent`` links are those of ``near_groups``, with it those of ``similar_groups`` (five words a shingle unless
    said otherwise). Null texts count as empty. Rows that repeat the id that stays are that document and stay too, as do
    rows without an id; an empty table stays empty."""
    if percent is None:
        groups = near_groups(docs, id_col, text_col, shingle or SHINGLE, **options)
    else:
        groups = similar_groups(docs, percent, shingle or 5, id_col, text_col, **options)
    (number,) = fresh(docs, "lost")
    lost = groups.filter("doc_id != component_id").select(F.col("doc_id").alias(number)).distinct()
    return docs.join(materialize(lost, "simhash-lost"), F.col(id_col) == F.col(number), "left_anti")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
