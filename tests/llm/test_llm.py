import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from conftest import SMALL, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.llm import bpe, chat_format, exact_dedup, nbsvm, packing, quality_rules, queries, sharding, simhash, suffix_dedup, suffix_sort, url_filter

WORD = r"[^\x20\x09-\x0D]+"
random.seed(4)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "Theta", "iota", "x"]


def prose(n):
    return " ".join(random.choice(WORDS) + random.choice(["", "", ".", ","]) for _ in range(n))


LONG = prose(12_000)
#: Null and empty texts, a very long one, copies, a repeated row, a null id, near copies.
EDGE = [(1, None), (2, ""), (3, LONG), (4, prose(80)), (5, "x"), (6, "x"), (None, "null id " + prose(60)), (8, "  \n\t "), (9, LONG + " tail"), (10, "é😀 <|endoftext|> " * 9), (11, prose(60) + "\n" + prose(3))]
EDGE += [(12, EDGE[3][1]), (12, EDGE[3][1]), (13, EDGE[3][1] + " more"), (14, "a" * 30_000), (15, "*** ### $$$ " * 40)]


@pytest.fixture(scope="module")
def edge(spark):
    """The odd cases, with extra columns named like what the operators add."""
    extra = ", ".join(f"{c} string" for c in ("lang", "kept", "digest", "_digest", "fp", "_id", "_lost", "_key", "_cell", "size", "shard", "slot", "component_id", "spans", "score"))
    df = spark.createDataFrame([(i, t, *["z"] * 15) for i, t in EDGE], f"doc_id bigint, text string, {extra}")
    return df.repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 16)] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def text_of(t):
    return t or ""


def test_trie_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    with open(path) as f:
        source = f.read()
    trie = bpe.Trie(source)
    library = Tokenizer.from_file(path)
    letters = "ab \n\t\x0b\x1d\x85\xa0é1²٣_'s-<|👍日"
    odd = [t for _, t in EDGE if t is not None] + ["".join(random.choice(letters) for _ in range(random.randint(1, 60))) for _ in range(500)]
    want = [e.ids for e in library.encode_batch(odd, add_special_tokens=False)]
    got = [np.frombuffer(x, np.uint32).tolist() for x in trie.encode(odd)]
    assert got == want
    assert [np.frombuffer(x, np.uint32).tolist() for x in bpe.ready(source)(odd)] == want
    ends = np.cumsum([0, *map(len, want)])
    assert bpe.Table(source).decode(np.concatenate([np.array(w, np.int64) for w in want]), ends) == [library.decode(w, skip_special_tokens=False) for w in want]


def test_encode_decode(spark, edge):
    path = bpe.default_tokenizer()
    out = bpe.decode(bpe.encode(edge, path), path)
    got = sorted(((r.doc_id or 0), r.decoded) for r in out.collect())
    assert got == sorted((i or 0, text_of(t)) for i, t in EDGE)
    assert bpe.decode(bpe.encode(edge.limit(0), path), path).count() == 0


def test_packing(spark, edge):
    path = bpe.default_tokenizer()
    rows = packing.pack(edge, path).collect()
    ids = dict(((r.doc_id or 0), r.ids) for r in bpe.encode(edge, path).collect())
    by_sequence = {}
    for r in rows:
        whole = [*ids[r.doc_id or 0], 2]
        part = whole[r.start : r.start + r.length]
        assert len(part) == r.length and (r.length == 1024 or r.piece == 0) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 1024
    assert sum(r.length for r in rows) == sum(len(ids[i or 0]) + 1 for i, _ in EDGE)
    assert packing.pack(edge.limit(0), path).count() == 0


def test_sequences(spark, documents):
    path = bpe.default_tokenizer()
    packed = packing.pack(documents, path)
    got = {r.sequence_id: r.tokens for r in packing.sequences(documents, packed, path).collect()}
    for r in packed.collect():
        assert zlib.crc32(np.array(got[r.sequence_id][r.offset : r.offset + r.length], "<u4").tobytes()) == r.ids_crc32


@given(st.lists(st.integers(1, 1023), min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_local_search_never_gets_worse(sizes):
    sizes = np.array(sizes)
    first = packing.best_fit(sizes, 1024)
    after = packing.local_search(sizes, first, 1024)
    fill = np.bincount(after, sizes)
    assert fill.max() <= 1024 and fill.sum() == sizes.sum() and len(set(after)) <= len(set(first))
    assert (fill**2).sum() >= (np.bincount(first, sizes) ** 2).sum()


@given(st.binary(max_size=120), st.integers(1, 12), st.sampled_from([1, 1 << 20]))
@settings(max_examples=150, deadline=None)
def test_suffixes(raw, depth, budget):
    for text in (raw, bytes(b % 3 for b in raw)):
        at, common = suffix_sort.sort_suffixes(np.frombuffer(text, np.uint8), depth, budget)
        assert sorted(at.tolist()) == list(range(len(text)))
        for a, b, n in zip(at, at[1:], common[1:], strict=False):
            x, y = text[a : a + depth], text[b : b + depth]
            assert x <= y and n == next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def brute_repeats(rows):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw, lost = text_of(t).encode(), set()
        for k in range(len(raw) - 49):
            first = seen.setdefault(raw[k : k + 50], i)
            if first != i:
                lost.update(range(k, k + 50))
        out.setdefault(i, []).append((len(raw), len(lost), sum(1 for k in lost if k - 1 not in lost), hashlib.sha256(bytes(b for k, b in enumerate(raw) if k not in lost)).hexdigest()))
    return out


def repeats_of(df, **options):
    out = {}
    for r in suffix_dedup.remove_repeats(df, **options).collect():
        out.setdefault(r.doc_id, []).append((r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return out


def test_repeats(spark, edge, documents, monkeypatch):
    assert repeats_of(edge) == brute_repeats(EDGE)
    monkeypatch.setattr(suffix_dedup, "RUN", 7)
    small = documents.select("doc_id", F.substring("text", 1, 1500).alias("text"))
    assert repeats_of(small.repartition(4)) == brute_repeats([tuple(r) for r in small.collect()])
    assert suffix_dedup.remove_repeats(edge.limit(0)).count() == 0
    cleaned = suffix_dedup.drop_repeats(edge)
    assert cleaned.columns == edge.columns and cleaned.count() == len(EDGE)


def test_shard_far_larger_than_the_budget(documents):
    """A text with 10 times as many places as the queues hold tuples: they spill, names recurse, and the order is that of plain sorting."""
    text = b"\xff".join(text_of(r.text).encode() for r in documents.collect())[:150_000]
    budget, depth = len(text) // 10, 50
    deep, spilled, recursed, spill = [], [], suffix_sort.descending, suffix_sort.Queues._spill

    def watched(text, *rest):
        deep.append(len(text))
        yield from recursed(text, *rest)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffix_sort, "descending", watched)
        m.setattr(suffix_sort.Queues, "_spill", lambda q: spilled.append(q.inside) or spill(q))
        m.setattr(suffix_sort, "BLOCK", 1000)
        at, common = suffix_sort.sort_suffixes(np.frombuffer(text, np.uint8), depth, budget)
    assert len(deep) >= 2 and deep[1] > budget  # names of a level that doesn't fit are sorted by recursion
    assert sum(spilled) > len(text) // 2 and max(spilled) < 2 * budget
    keys = [text[k : k + depth] for k in at.tolist()]
    assert keys == sorted(text[k : k + depth] for k in range(len(text))) and sorted(at.tolist()) == list(range(len(text)))
    for a, b, n in zip(keys, keys[1:], common[1:].tolist(), strict=False):
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_queues_stream_from_disk():
    rng = np.random.default_rng(0)
    queues, want = suffix_sort.Queues(3, 100), [[], [], []]
    for _ in range(200):
        q, n = int(rng.integers(3)), int(rng.integers(1, 40))
        at = rng.integers(0, 10**12, n)
        queues.push(q, at.astype(np.int32) % 7, at, (at % 51).astype(np.uint8))
        want[q] += at.tolist()
        assert queues.inside <= 100
        if rng.random() < 0.3 and queues.size[q]:
            symbol, got, lcp = queues.pop(q, 15)
            assert len(got) <= 15 and got.tolist() == want[q][: len(got)] and (lcp == got % 51).all()
            del want[q][: len(got)]
    assert queues.spilled > 1000 and [queues.rest(q)[1].tolist() for q in range(3)] == want


def test_boilerplate_costs_a_shard_little(spark):
    """One boilerplate in every document: a partition sends its strings once, not once a document, and the result is that of brute force."""
    boiler = " ".join(f"boiler{k}" for k in range(14))
    rows = [(k, f"start {k * 7919} " + boiler + f" end {k * 104729}") for k in range(300)]
    texts = [t.encode() for _, t in rows]
    ids = np.arange(len(rows))
    doc, _, _, h = suffix_dedup.runs(texts)
    own = suffix_dedup._own_anchors(doc, h, ids)
    bits = np.packbits(np.ones(len(own), bool)).tobytes()
    *_, strings, _, least, greatest = suffix_dedup.shared_strings(texts, ids, [(0, bits)], 1)
    inside = [k for k, x in enumerate(strings) if x in boiler.encode()]
    assert 1 <= len(inside) <= 30 and all(least[k] == 0 and greatest[k] == len(rows) - 1 for k in inside)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert repeats_of(df) == brute_repeats(rows)


@pytest.mark.parametrize("table", ["edge", "documents"])
def test_sharding(spark, table, request):
    df = request.getfixturevalue(table)
    rows = sharding.shard(df, 5).collect()
    assert len(rows) == df.count()
    places = {}
    for r in rows:
        raw = text_of(r.text).encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and 0 <= r.shard < 5
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    if table == "documents":
        sizes = [sum(r.size for r in rows if r.shard == k) for k in range(5)]
        assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)
    assert sharding.shard(df.limit(0), 5).count() == 0


def test_sharding_cuts_one_text(spark):
    copies = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    sizes = [r["sum(size)"] for r in sharding.shard(copies, 4).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) < 0.02 * sum(sizes)


def test_exact(spark, edge):
    got = sorted(((r.doc_id or 0), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(edge, least=2).collect())
    groups = {}
    for i, t in EDGE:
        groups.setdefault(text_of(t), []).append(i)
    want = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        for n, i in enumerate(ids):
            want.append((i or 0, keep, len(ids), i == keep and i not in ids[:n]))
    assert got == sorted(want)
    left = exact_dedup.drop_copies(edge)
    assert left.columns == edge.columns
    assert sorted(((r.doc_id or 0), r.text) for r in left.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()) == sorted((max(i or 0 for i in ids), t) for t, ids in groups.items())
    assert exact_dedup.exact_groups(edge.limit(0)).count() == 0 and exact_dedup.drop_copies(edge.limit(0)).count() == 0


def test_exact_with_hot_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_groups(df)
    assert got.count() == 3000 and got.filter("kept").count() == 2001
    assert got.filter("doc_id = 2997").first().kept and got.filter("doc_id = 0").first().group_size == 1000


def brute_simhash(t):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_by_hand(rows):
    fps = [brute_simhash(text_of(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    return fps, [min((rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None), default=None) for k in range(len(rows))]


@pytest.mark.parametrize("split", [20_000, 2])
def test_near(spark, edge, split, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", split)
    fps, names = near_by_hand(EDGE)
    got = sorted(((r.doc_id or 0), r.fp % 2**64, r.component_id or 0) for r in simhash.near_groups(edge).collect())
    assert got == sorted((i or 0, f, n or 0) for (i, _), f, n in zip(EDGE, fps, names, strict=True))
    left = simhash.drop_near(edge)
    assert left.columns == edge.columns and simhash.near_groups(edge.limit(0)).count() == 0


def test_masks_cover():
    masks = simhash.masks()
    for _ in range(3000):
        differ = sum(1 << b for b in random.sample(range(64), random.randint(0, 3)))
        assert any(m & differ == 0 for m in masks)


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=20), st.lists(st.tuples(st.integers(0, 63), st.integers(0, 63)), max_size=10))
@settings(max_examples=60, deadline=None)
def test_forest_connects(fps, flips):
    fps = list(dict.fromkeys(fps + [f ^ (1 << a) ^ (1 << b) for f in fps[:3] for a, b in flips]))
    links = simhash.forest(np.array(fps, np.uint64), 3)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert (int(a) ^ int(b)).bit_count() <= 3
        root[find(int(a))] = find(int(b))
    assert all(find(a) == find(b) for a in fps for b in fps if (a ^ b).bit_count() <= 3)


def brute_rules(t):
    words = re.findall(WORD, t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    marked = {i + k for i, w in enumerate(windows) if w in many for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(marked), failed


def test_rules(spark, edge, documents, labels):
    for df, found in ((edge, labels), (documents, spark.read.parquet(f"{SMALL}/labels.parquet"))):
        texts = sorted(brute_rules(text_of(r.text)) for r in df.select("text").collect())
        out = quality_rules.judge(df, found)
        assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()) == texts
        assert out.filter("kept and base_failed").count() == 0
        left = quality_rules.drop_poor(df, found)
        assert left.columns == df.columns and left.count() == out.filter("kept").count()
    assert quality_rules.judge(edge.limit(0), labels).count() == 0 and quality_rules.judge(edge, labels.limit(0)).count() == len(EDGE)


def test_rules_tell_junk(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = quality_rules.judge(spark.read.parquet(f"{d}/documents.parquet"), labels).filter("not base_failed").join(labels, "doc_id")
    assert out.filter("quality = 1 and not kept").count() == 0 and out.filter("quality = 0 and kept").count() == 0


def test_bucket_borders():
    hashed, starts = quality_rules.buckets([b"abcd", b"", b"abc", b"abcde"])
    assert starts.tolist() == [0, 1, 1, 1] and len(hashed) == 3 and hashed[0] == hashed[1]


def test_classifier(spark, edge, labels):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/labels.parquet")
    out = nbsvm.classify(spark.read.parquet(f"{d}/documents.parquet"), truth)
    rows = out.join(truth, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert nbsvm.classify(edge, labels).count() == len(EDGE) and nbsvm.classify(edge.limit(0), labels).count() == 0
    assert {r.score for r in nbsvm.classify(edge, labels.limit(0)).collect()} == {0.5}


def test_urls(spark):
    urls = ["http://A.Example.com/en/7x?q", "https://example.com/en/8", "x://b.net/de/", "http://example.net/de/8", "http://org/es/1#f", "nothing", None, "", "http://notcom/en/", "http://h.org?x/es/", "http://h.org/es", "ftp://com"]
    rows = [(i, u, f'<a href="http://{"bad.net" if i % 2 else "example.com"}/x">') for i, u in enumerate(urls)]
    pages = spark.createDataFrame([*rows, (3, urls[3], None)], "page_id bigint, url string, html string").withColumns({"host": F.lit("z"), "verdict": F.lit(1)})
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert [got[k].rule for k in range(12)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None, None, None, None, None]
    assert [got[k].host for k in (0, 5, 6, 9, 11)] == ["a.example.com", "", "", "h.org", "com"] and got[0].path == "/en/7x" and got[9].path == ""
    assert [got[k].verdict for k in range(5)] == ["allow", "block", "block", "block", "block"]
    assert url_filter.judge(pages).count() == 13 and url_filter.judge(pages.limit(0)).count() == 0


def test_trust_flows(spark):
    edges = spark.createDataFrame([("good", "a", 1), ("a", "b", 1), ("c", "bad", 3)], "src string, dst string, links bigint")
    one = lambda h: spark.createDataFrame([(h, 10**9)], "host string, mass bigint")
    trust = dict(tuple(r) for r in url_filter.spread(one("good"), edges, 85).collect())
    back = edges.selectExpr("dst as src", "src as dst", "links")
    distrust = dict(tuple(r) for r in url_filter.spread(one("bad"), back, 85).collect())
    assert trust["good"] > trust["a"] > trust["b"] > 0 and "c" not in trust and distrust["c"] > 0 and "a" not in distrust


def page_rank(seeds, edges, follow=0.85):
    """Personalised PageRank by plain power iteration, dangling mass lost."""
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    at = {h: k for k, h in enumerate(hosts)}
    move = np.zeros((len(hosts), len(hosts)))
    for a, b in edges:
        move[at[a], at[b]] += 1
    move /= np.maximum(move.sum(axis=1, keepdims=True), 1)
    base = np.zeros(len(hosts))
    for h, share in seeds.items():
        base[at[h]] = share / sum(seeds.values())
    now = base.copy()
    for _ in range(400):
        now = (1 - follow) * base + follow * now @ move
    return dict(zip(hosts, now, strict=True))


def test_linked_hosts_equal_plain_page_rank(spark):
    """A random host graph with a chain of 30 hosts, self links and seeds on both sides, against power iteration."""
    rng = random.Random(11)
    hosts = [f"h{k}.org" for k in range(40)] + [f"c{k}.net" for k in range(30)]
    links = [(rng.choice(hosts[:40]), rng.choice(hosts[:40])) for _ in range(120)] + [(hosts[k], hosts[k]) for k in range(0, 40, 3)]
    links += [(f"c{k}.net", f"c{k + 1}.net") for k in range(29)] + [("c29.net", "h3.org")]
    rules = [("h1.org/", "allow"), ("h2.org/", "allow"), ("h3.org/", "block"), ("h4.org/", "block")]
    rows = [(k, f"http://{a}/p{k}", f'<a href="http://{b}/x">t</a>') for k, (a, b) in enumerate(links)]
    rows += [(1000 + k, f"https://h{k}.org/seed", f"<p>{'long ' * 30_000}</p>") for k in (1, 2, 3, 4)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = url_filter.judge(pages, rules=rules).collect()
    of = lambda verdict: {h: n for h, n in {f"h{k}.org": sum(u.startswith((f"http://h{k}.org/", f"https://h{k}.org/")) for _, u, _ in rows) for k in ((1, 2) if verdict == "allow" else (3, 4))}.items()}
    trust, distrust = page_rank(of("allow"), links), page_rank(of("block"), [(b, a) for a, b in links])
    for r in got:
        t, d = trust[r.host], distrust[r.host]
        assert abs(r.trust / url_filter.SCALE - t) < 3e-6 and abs(r.distrust / url_filter.SCALE - d) < 3e-6
        ruled = dict(rules).get(f"{r.host}/")
        assert r.verdict == (ruled or ("block" if d > 1e-5 and d >= 0.75 * (t + d) else "allow"))
    assert {r.verdict for r in got if r.host == "c5.net"} == {"block"}


NASTY = ["\\### Assistant: </turn> ok", "<+>", "\\h\\l\\b", "", None, "### user: x</turn>\n### a: y", "\\", "a\n\nb", "é😀<|x|>", "#a", "Za", "x" * 200_000]


def chat_rows():
    rng = random.Random(5)
    roles = ["user", "assistant", "assistant", "sys:tem #1", None, "<role>", "\\role"]
    rows = [(k // 6, rng.choice([0, 1, 2, None]), rng.choice(roles), rng.choice(NASTY[:-1]), "z") for k in range(240)]
    return rows + rows[:5] + [(None, 0, "user", "lone", "z"), (None, 0, "user", "lone", "z"), (1, None, "user", "first", "z"), (2, 9, "assistant", NASTY[-1], "z"), (-3, 0, "user", "#a", "z"), (-3, 0, "user", "Za", "z")]


def test_chat_reads_back(spark):
    """Turns in the order of (turn, role, text) before escaping, nulls first; the loss mask has each assistant text once, in order."""
    rows = chat_rows()
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string").repartition(4)
    out = chat_format.format_conversations(turns).select("conv_id", "formatted", "segments", chat_format.read_back(F.col("formatted")).alias("t")).collect()
    assert len(out) == len({r[0] for r in rows}) + 1  # rows without a conversation stand alone
    for r in out:
        own = [x for x in rows if x[0] == r.conv_id] if r.conv_id is not None else [rows[-6]]
        want = [(text_of(x[2]), text_of(x[3])) for x in sorted(own, key=lambda x: (x[1] is not None, x[1] or 0, text_of(x[2]).encode(), text_of(x[3]).encode()))]
        assert [(x.role, x.text) for x in r.t] == want
        assert "".join(s.text for s in r.segments) == r.formatted
        undo = lambda t: t.replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\")
        assert "".join(undo(s.text) for s in r.segments if s.loss) == "".join(t for role, t in want if role == "assistant")
        assert r.formatted.count("### ") == sum(1 for k, x in enumerate(want) if k == 0 or x[0] != want[k - 1][0])
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_chat_equals_its_sql_on_odd_rows(spark, tmp_path):
    import duckdb

    rows = chat_rows()
    spark.createDataFrame([r[:4] for r in rows], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    same(chat_format.op8_chat_format(spark, str(tmp_path)), con, chat_format.OP8_SQL)


def test_exact_equals_its_sql_on_odd_rows(spark, tmp_path):
    import duckdb

    spark.createDataFrame(EDGE * 2 + [(None, None)] * 3, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same(exact_dedup.op10_exact_dedup(spark, str(tmp_path)), con, exact_dedup.OP10_SQL)


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """100,000 rows with null id and one text, 20,000 that repeat id and text, 5,000 others."""
    path = f"{tmp_path_factory.mktemp('repeated')}/docs"
    null = spark.range(100_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("the same words").alias("text"))
    twice = spark.range(20_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("another text").alias("text"))
    others = spark.range(5_000).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    null.union(twice).union(others).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def test_exact_with_repeated_rows(spark, repeated):
    got = {tuple(r) for r in exact_dedup.exact_groups(repeated).groupBy("keep_id", "group_size", "kept").count().filter("group_size > 1").collect()}
    assert got == {(None, 100_000, True, 1), (None, 100_000, False, 99_999), (7, 20_000, True, 1), (7, 20_000, False, 19_999)}
    assert exact_dedup.drop_copies(repeated, stored=True).count() == 5_002


def test_sharding_with_repeated_rows(spark, repeated):
    out = sharding.shard(repeated, 10, stored=True)
    sizes = [r["sum(size)"] for r in out.groupBy("shard").sum("size").collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 10 + 2 * 40
    assert out.groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("m"), F.count("*").alias("c")).filter("n != c or m != c - 1").count() == 0


def test_packing_with_repeated_rows(spark, repeated):
    rows = packing.pieces(repeated, bpe.default_tokenizer())
    out = packing.assign(rows, 125_000, group=10_000)
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert out.count() == 125_000 and used.filter("fill > 1024 or fill != end").count() == 0
    sizes = [r["count"] for r in out.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 12_000  # equal rows are spread over the groups


def least_bins(sizes, capacity):
    """The least number of bins, by trying all ways to fill them."""
    sizes = sorted(sizes, reverse=True)

    def fits(k, rooms):
        if k == len(sizes):
            return True
        return any(fits(k + 1, tuple(sorted([*rooms[:i], room - sizes[k], *rooms[i + 1 :]]))) for i, room in enumerate(rooms) if room >= sizes[k] and room not in rooms[:i])

    n = -(-sum(sizes) // capacity)
    while not fits(0, (capacity,) * n):
        n += 1
    return n


def test_packing_against_the_optimum():
    """On small sets the search needs the least number of bins nearly always, and never more than best fit; where best fit is poor it gains."""
    rng = random.Random(2)
    first = after = best = 0
    for _ in range(150):
        sizes = np.array([rng.choice([rng.randint(1, 1023), rng.randint(250, 400)]) for _ in range(9)])
        bins = packing.best_fit(sizes, 1024)
        first += len(set(bins.tolist()))
        after += len(set(packing.place(sizes, 1024).tolist()))
        best += least_bins(sizes.tolist(), 1024)
    assert best <= after <= first and after - best <= 0.01 * best
    sizes = np.random.default_rng(1).integers(257, 511, 3000)
    poor = packing.best_fit(sizes, 1024)
    assert len(set(packing.local_search(sizes, poor, 1024).tolist())) < 0.98 * len(set(poor.tolist()))


def test_fit_is_the_optimum():
    """The gap between the primal objective and a bound from the dual, both computed here from dense rows, is small."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.choice(60, 12) + (20 if k % 2 else 0)).astype(np.int32) for k in range(200)]
    labels = np.arange(200) % 2
    weights, bias = nbsvm.fit(rows, labels, passes=400, cost=1.0)
    seen = np.array([[k in set(r.tolist()) for k in range(80)] for r in rows], float)
    count = [seen[labels == y].sum(axis=0) + 1 for y in (0, 1)]
    total = [c.sum() + nbsvm.SIZE - 80 for c in count]
    x = seen * (np.log(count[1] / total[1]) - np.log(count[0] / total[0]))
    x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((200, 1))])
    w, y = np.append(weights[:80], bias), np.where(labels == 1, 1.0, -1.0)
    primal = w @ w / 2 + np.maximum(0, 1 - y * (x @ w)).sum()
    least = primal
    v = w.copy()
    for k in range(1, 20_000):  # an independent solver: subgradient steps from the same place
        v -= (v - ((y * (x @ v) < 1) * y) @ x) / (k + 200)
        least = min(least, v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum())
    assert primal <= least * 1.002


def test_fit_counts_a_repeated_row_once(spark, labels):
    rows = [(i, f"words of document {i} and more") for i in range(1, 40)]
    once = spark.createDataFrame(rows, "doc_id bigint, text string")
    often = spark.createDataFrame(rows + rows[:9] * 50, "doc_id bigint, text string").repartition(3)
    a, b = nbsvm.train(once, labels), nbsvm.train(often, labels)
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    assert len(nbsvm.sampled(once, labels, 5, 10**9)) == 5 and len(nbsvm.sampled(once, labels, 100, 60)) == 2


def test_rules_equal_brute_force(spark, documents):
    """Log-likelihood ratio and verdict from n-grams counted here in a dictionary."""
    from collections import Counter

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    rows = {r.doc_id: text_of(r.text).encode() for r in documents.collect()}
    of = lambda raw: [(int.from_bytes(raw[k : k + 4], "little") * 2654435761 % 2**32) >> 16 for k in range(len(raw) - 3)]
    grams = {i: of(raw) for i, raw in rows.items()}
    corpus, target = Counter(g for x in grams.values() for g in x), Counter(g for i, x in grams.items() if i in good for g in x)
    n, m = (sum(c.values()) + 2**16 for c in (target, corpus))
    ratio = {g: np.log((target[g] + 1) / n) - np.log((corpus[g] + 1) / m) for g in corpus}
    for r in quality_rules.judge(documents, labels).collect():
        want = sum(ratio[g] for g in grams[r.doc_id]) / max(1, len(grams[r.doc_id]))
        assert abs(r.llr - want) < 1e-6
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD) and r.base_failed == brute_rules(rows[r.doc_id].decode())[-1]


def test_bpe_query_equals_the_library(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    library.no_truncation()
    library.no_padding()
    rows = documents.collect()
    ids = [e.ids for e in library.encode_batch([text_of(r.text) for r in rows], add_special_tokens=False)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {r.doc_id: (len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for r, x in zip(rows, ids, strict=True)}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op1_bpe(spark, SMALL).collect()} == want
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert [r.decoded for r in bpe.decode(none, bpe.default_tokenizer()).collect()] == ["", ""]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_tables(spark, edge, labels, tmp_path, empty):
    """Every stage takes null ids and texts, repeated rows and extra columns, and an empty table; clean rows come out whole."""
    import corpus_pipeline as p

    clean = [(100 + k, " ".join(f"w{k}x{j}" for j in range(120))) for k in range(20)]
    docs = edge.select("doc_id", "text", F.col("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"), "kept", "_lost")
    docs = docs.union(spark.createDataFrame([(i, t, "z", "s", len(t), "z", "z") for i, t in clean], docs.schema)).limit(0 if empty else 10**6)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
    assert {i for i, _ in clean} <= {r.doc_id for r in docs.collect()} if not empty else docs.count() == 0
    assert (p.run(spark, str(tmp_path)).count() == 0) == empty


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, oracle, name):
    df = queries.queries()[name](spark, SMALL)
    if name in queries.oracle_sql():
        same(df, oracle, queries.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = p.read(spark, SMALL, "documents")
    names = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, SMALL), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == names and set(after) <= set(before)
        if name == "exact_dedup":
            assert len(set(after.values())) == len(after) == len(set(before.values()))
        if name == "simhash":
            ids = sorted(before)
            assert set(after) == {ids[k] for k in alike_by_hand([before[i] for i in ids])}
        if name == "suffix_dedup":
            want = brute_repeats(before.items())
            assert all(len(before[i].encode()) - want[i][0][1] >= len(t.encode()) for i, t in after.items())
        else:
            assert all(before[i] == t for i, t in after.items())
        before = after
    got = p.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in got.collect()} == set(before)
    assert p.run(spark, SMALL).count() == got.count()


def alike_by_hand(texts, shingle=5, percent=80):
    """The least number among the texts that Jaccard similarities of shingle sets connect with each."""
    sets = [{tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set() for w in (re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    return root


@pytest.mark.parametrize("compared", [simhash.COMPARED, 2000])
def test_near_stage_equals_brute_force(spark, compared, monkeypatch, tmp_path):
    """Copies with a changed word or more are found however many bits their SimHash differs in, and others stay."""
    import corpus_pipeline

    monkeypatch.setattr(simhash, "COMPARED", compared)
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([60, 120, 200]))]
        texts.append(words)
        for changes in (1, 2, 3, 4, 5, 6, 8):
            copy = list(words)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = f"new{rng.randrange(10**6)}"
            texts.append(copy)
    texts += [["Short", "text"], ["short", "TEXT"], [], [" "]]
    texts = [" ".join(t) for t in texts]
    root = alike_by_hand(texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == set(root) and 12 < len(kept) < len(texts) - 12
    far = [(a, b) for a in range(len(texts)) for b in range(a) if root[a] == root[b] and (simhash.simhash(texts[a].encode()) ^ simhash.simhash(texts[b].encode())).bit_count() > 3]
    assert far


def test_local_search_ends_at_an_optimum():
    """No move, exchange or two-for-one exchange between any two underfull bins raises the sum of squared fills."""
    sizes = np.random.default_rng(0).integers(257, 511, 2000)
    bins = packing.local_search(sizes, packing.best_fit(sizes, 1024), 1024)
    fill = np.bincount(bins, sizes).astype(int)
    under = np.flatnonzero(fill[bins] < 1024)
    assert len(set(bins.tolist())) > -(-sizes.sum() // 1024)
    for a in {int(b) for b in bins[under]}:
        own = np.flatnonzero(bins == a)
        other = under[bins[under] != a]
        y, to = np.concatenate((np.zeros(len(other), int), sizes[other])), np.tile(fill[bins[other]], 2)
        for k, given in enumerate([*sizes[own], *(sizes[i] + sizes[j] for n, i in enumerate(own) for j in own[n + 1 :])]):
            ok = (given > y) & (to + given - y <= 1024) & ((y > 0) | (k < len(own)))
            assert not (ok & (2 * (given - y) * (to + given - y - fill[a]) > 0)).any()


def test_rules_trust_every_good_label(spark):
    """More good labels than the 20,000 there once was room for: all of their n-grams count."""
    n = 20_500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"))
    good = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    taken = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality_rules, "log_ratios", lambda counts: taken.extend(counts.collect()))
        quality_rules.model(docs, good)
    assert [(r.target, r.corpus) for r in taken] == [(n, n)]


def test_asked_places_come_in_order(documents):
    """Places asked for come in the order and with the common prefixes of a whole sort, and far fewer suffixes are induced; plain sorting is the judge."""
    text = np.frombuffer(b"".join(text_of(r.text).encode()[:120] + b"\xff" for r in documents.limit(300).collect()), np.uint8)
    asked = np.arange(len(text)) % 121 < 12
    for budget, block in ((1 << 22, 1 << 18), (len(text) // 10, 1000)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(suffix_sort, "BLOCK", block)
            got = list(suffix_sort.descending(text, 256, 50, budget, asked))
        at, values = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        keys = [text[k : k + 50].tobytes() for k in at.tolist()]
        assert keys == sorted(keys, reverse=True) and set(np.flatnonzero(asked)) <= set(at.tolist()) and len(set(at.tolist())) == len(at) < len(text) // 2
        for a, b, n in zip(keys, keys[1:], values[1:].tolist(), strict=False):
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_a_bin_is_sorted_in_shards(spark, documents, monkeypatch):
    """Chunks of few documents and shards far smaller than a bin give the result of brute force; a chunk is one record, whatever the splits of the scan."""
    small = documents.select("doc_id", F.substring("text", 1, 1500).alias("text"))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 40_000)
    stored = suffix_dedup.chunks(small.coalesce(1)).collect()
    assert len(stored) > 3 and len({r.chunk for r in stored}) == len(stored) and max(r.size for r in stored) <= 41_500
    monkeypatch.setattr(suffix_dedup, "SHARD", 3000)
    monkeypatch.setattr(suffix_dedup, "MANY", 0)
    assert repeats_of(small.coalesce(1)) == brute_repeats([tuple(r) for r in small.collect()])


def test_no_task_holds_a_split_of_texts(spark, edge, documents, monkeypatch):
    """Texts reach the counts and the shingle sets a batch at a time, by a join, not as lists of a whole split; the counts are those of brute force."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    trusted = spark.createDataFrame([(4,), (9,), (99,), (None,)], "doc_id bigint")
    counts = quality_rules.gram_counts(edge, trusted)
    rows = [r for r in counts.collect() if r.target or r.corpus]
    want = np.zeros((2, 1 << quality_rules.BITS), np.int64)
    for i, t in EDGE:
        own = np.bincount(quality_rules.buckets([text_of(t).encode()])[0], minlength=1 << quality_rules.BITS)
        want += [own * (i in (4, 9)), own]
    assert len(rows) == (want[1] > 0).sum() and all((r.target, r.corpus) == tuple(want[:, r.bucket]) for r in rows)
    plans, write = {}, simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: plans.setdefault(name, plan(df)) and write(df, name))
    simhash.similar_groups(documents, 80, 5)
    stored = documents.select("doc_id", "text")
    for text in (plan(quality_rules.gram_counts(stored, trusted.limit(2))), plans["near-members"]):
        assert "Join" in text and "MapInArrow" in text and "MapPartitions" not in text and "zip" not in text
    assert "ExistingRDD" not in plans["near-members"].split("MapInArrow")[0]
