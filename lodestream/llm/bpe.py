"""Byte-level BPE encoding by prefix sharing, and decoding.

The encoding of a prefix of a word is the encoding of a shorter prefix plus one last token, and that last
token is unique: it must be a valid neighbour of the shorter prefix's last token. So the distinct words of a
batch go into a trie, and a depth-first walk computes one state per trie node, the last token; words with
a common prefix share its states. A word's ids are read off by walking back from its node.

A trie is walked depth-first by visiting its words in sorted order and keeping the states of the current path,
so only one path is in memory. Words and space-separated chunks that were seen stay in bounded caches.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import read

#: Fixed value: how byte-level BPE splits text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of each cache, and the longest chunk (characters) that is kept in one.
CACHED, SHORT = 300_000, 48
#: Characters of text that are encoded at a time, or one document.
BLOCK = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where it is visible, else the next one from 256 on."""
    seen = {chr(b): b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r}
    hidden = [b for b in range(256) if chr(b) not in seen]
    return seen | {chr(256 + k): b for k, b in enumerate(hidden)}


class Trie:
    """Encoder of one byte-level vocabulary (the JSON of the tokenizers library)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, alphabet = spec["model"], byte_alphabet()
        plain = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.ids = {plain(s): i for s, i in model["vocab"].items() if s not in self.special}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.rank, self.parts, self.merged = [-1] * size, [None] * size, {}
        for k, pair in enumerate(model["merges"]):
            a, b = (self.ids[plain(s)] for s in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = self.ids[plain("".join(pair) if isinstance(pair, list) else pair.replace(" ", ""))]
            self.merged[a, b] = (k, whole)
            if self.parts[whole] is None:
                self.rank[whole], self.parts[whole] = k, (a, b)
        self.ends: dict[bytes, tuple] = {b[:k]: () for b in self.ids for k in range(1, len(b) + 1)}
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.words = regex.compile(PATTERN)
        self.inner_space = regex.compile(r" (?!\S)")
        self.cut = regex.compile(r" (?=\S)")
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.word_cache: dict[str, bytes] = {}
        self.chunk_cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether the text of tokens a and b encodes as just these two.

        Take the merges apart again, the latest first, on the sides that face each other. A merge across the
        border that comes before one of the merges taken apart would have been made instead. Equal merges are made
        from left to right, so against a merge on its right the border's merge also wins when equal.
        """
        rank, parts, merged = self.rank, self.parts, self.merged
        limit = len(rank) + 1
        while True:
            across = merged.get((a, b))
            if across is not None and across[0] < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], parts[a][1]
            elif parts[b] is not None:
                limit, b = rank[b] + 1, parts[b][0]
            elif parts[a] is not None:
                limit, a = rank[a], parts[a][1]
            else:
                return True

    def stands(self, token: int) -> bool:
        """Whether a token's own text encodes as this token."""
        found = self.alone.get(token)
        if found is None:
            parts = self.parts[token]
            found = True
            if parts is not None:
                a, b = parts
                found = self.stands(a) and self.stands(b) and self._joins(a, b, self.rank[token])
            self.alone[token] = found
        return found

    def _joins(self, a: int, b: int, k: int) -> bool:
        """Whether a and b arise unharmed and then merge: no earlier merge crosses their border."""
        rank, parts, merged = self.rank, self.parts, self.merged
        limit = k
        while True:
            across = merged.get((a, b))
            if across is not None and across[0] < limit and across[0] != k:
                return False
            if rank[a] > rank[b]:
                limit, a = min(limit, rank[a]), parts[a][1]
            elif parts[b] is not None:
                limit, b = min(limit, rank[b] + 1), parts[b][0]
            elif parts[a] is not None:
                limit, a = min(limit, rank[a]), parts[a][1]
            else:
                return True

    def ending(self, text: bytes) -> tuple[tuple[int, int], ...]:
        """The tokens, with their lengths, that end a text which itself begins a token; the longest first."""
        found = ((self.ids.get(text[-k:]), k) for k in range(len(text), 0, -1))
        self.ends[text] = out = tuple((t, k) for t, k in found if t is not None and self.stands(t))
        return out

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each distinct word, by one depth-first walk over their trie."""
        out = {}
        pairs, fits, packed, ends = self.pairs, self.fits, self.packed, self.ends
        last, steps, starts, before = [0], [0], [0], b""  # per depth of the path: the last token, its length, the length of its end that may begin a token
        if len(pairs) > CACHED:
            pairs.clear()
        for raw, word in sorted((w.encode(), w) for w in words):
            n = len(raw)
            depth, most = 0, min(n, len(before))
            while depth < most and raw[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :], steps[depth + 1 :], starts[depth + 1 :]
            start = starts[-1]
            for i in range(depth + 1, n + 1):
                start += 1
                while (tokens := ends.get(raw[i - start : i])) is None:
                    start -= 1
                for token, size in tokens or self.ending(raw[i - start : i]):
                    if size < i:
                        pair = (last[i - size], token)
                        good = pairs.get(pair)
                        if good is None:
                            good = pairs[pair] = fits(*pair)
                        if not good:
                            continue
                    last.append(token)
                    steps.append(size)
                    starts.append(start)
                    break
                else:
                    raise ValueError(f"the vocabulary can't encode {raw!r}")
            i, back = n, []
            while i:
                back.append(packed[last[i]])
                i -= steps[i]
            out[word] = b"".join(reversed(back))
            before = raw
        return out

    def _chunks(self, chunks: set[str], lead: str) -> dict[str, bytes]:
        """Ids of chunks that were not seen; ``lead`` stands before each."""
        find, split, known = self.words.findall, {}, self.word_cache
        new = set()
        for c in chunks:
            split[c] = w = [lead + c] if c.isalpha() else find(lead + c)
            new.update(w)
        new = new.difference(known)
        fresh = self.encode_words(new)
        out = {}
        for c, words in split.items():
            out[c] = b"".join([fresh[w] if w in fresh else known[w] for w in words])
        if len(known) + len(fresh) > CACHED:
            known.clear()
        known.update((w, b) for w, b in fresh.items() if len(w) <= SHORT)
        return out

    def _recall(self, chunks: set[str]) -> set[str]:
        """Chunks that are in neither cache; those in the older one are brought into the newer one."""
        if len(self.chunk_cache) > CACHED:
            self.chunk_cache, self.older = {}, self.chunk_cache
        known, older = self.chunk_cache, self.older
        missing = chunks.difference(known)
        if older:
            again = {c: older[c] for c in missing if c in older}
            known.update(again)
            missing = missing.difference(again)
        return missing

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, as many bytes as four times its tokens.

        Before a space that a non-space follows, a word always begins; so such chunks are encoded apart, once each.
        """
        cut_up, later, first = [], set(), set()
        for text in texts:
            parts = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
            row = []
            for k, part in enumerate(parts):
                if k % 2:
                    row.append(part)
                    continue
                chunks = self.cut.split(part) if self.inner_space.search(part) else part.split(" ")
                first.add(chunks[0])
                later.update(chunks[1:])
                row.append(chunks)
            cut_up.append(row)
        fresh = self._chunks(self._recall(later), " ")
        known = self.chunk_cache
        known.update((c, b) for c, b in fresh.items() if len(c) <= SHORT)
        rare = {c: b for c, b in fresh.items() if len(c) > SHORT}
        heads = self._chunks(first, "")
        out = []
        for row in cut_up:
            whole = []
            for part in row:
                if isinstance(part, str):
                    whole.append(self.packed[self.special[part]])
                    continue
                whole.append(heads[part[0]])
                if rare and not rare.keys().isdisjoint(part):
                    whole.extend(rare[c] if c in rare else known[c] for c in part[1:])
                else:
                    whole.extend(map(known.__getitem__, part[1:]))
            out.append(b"".join(whole))
        return out


class Table:
    """The bytes of each token, special ones included, end to end; it takes far less memory than an encoder."""

    def __init__(self, source: str):
        spec, alphabet = json.loads(source), byte_alphabet()
        special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", ())}
        texts = {i: bytes(alphabet[c] for c in s) for s, i in spec["model"]["vocab"].items() if i not in special} | special
        size = max(texts) + 1
        self.lengths = np.array([len(texts.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(texts.get(i, b"") for i in range(size)), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each row of ids; rows lie between consecutive offsets. Broken UTF-8 becomes U+FFFD."""
        ids = ids[offsets[0] : offsets[-1]]
        sizes = self.lengths[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        flat = self.bytes[at].tobytes()
        edges = ends[offsets - offsets[0]].tolist()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=2)
def trie(source: str) -> Trie:
    """One encoder for each Python worker and vocabulary."""
    return Trie(source)


@lru_cache(maxsize=2)
def table(source: str) -> Table:
    return Table(source)


@lru_cache(maxsize=2)
def ready(source: str):
    """texts -> little-endian ids, by a ready-made encoder if merges come in the order of their ids, as it assumes; else by the trie.

    For operators whose subject isn't the encoding itself.
    """
    spec, alphabet = json.loads(source), byte_alphabet()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    ids = {s: i for s, i in spec["model"]["vocab"].items() if s not in special}
    made = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
    if made != sorted(made):
        return trie(source).encode
    import tiktoken

    coder = tiktoken.Encoding("ready", pat_str=PATTERN, mergeable_ranks={bytes(alphabet[c] for c in s): i for s, i in ids.items()}, special_tokens=special)
    return lambda texts: [coder.encode_to_numpy(t, allowed_special="all").tobytes() for t in texts]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read by the driver and sent to the executors once: its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about BLOCK characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) per row, whole texts; null texts count as empty, repeated rows stay, other columns are ignored."""
    source = vocabulary(docs.sparkSession, tokenizer)

    def run(batches):
        bpe = trie(source.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                rows = bpe.encode(texts[a:b])
                offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows]))).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(rows), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), ids)], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) plus decoded text, special tokens included; null ids give an empty text."""
    source = vocabulary(tokens.sparkSession, tokenizer)

    def run(batches):
        bpe = table(source.value)
        for batch in batches:
            ids = batch.column(1)
            lengths = np.array(ids.value_lengths().fill_null(0))
            step = max(1, int(BLOCK // max(1, lengths.mean() * 3))) if len(lengths) else 1
            for a in range(0, len(ids), step):
                part = ids.slice(a, step)
                size = lengths[a : a + step]
                flat = np.asarray(part.flatten())
                text = bpe.decode(flat, np.concatenate(([0], np.cumsum(size))).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, step), part, pa.array(text, pa.string())], names=["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ``encode`` and ``decode`` of its ids in one pass over the texts, block by block."""
    source = vocabulary(docs.sparkSession, tokenizer)

    def run(batches):
        bpe, back = trie(source.value), table(source.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                rows = bpe.encode(texts[a:b])
                texts[a:b] = [None] * (b - a)
                offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows])))
                flat = np.frombuffer(b"".join(rows), np.int32)
                decoded = pa.array(back.decode(flat, offsets), pa.string())
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, decoded], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(read(spark, sf_dir, "documents"), default_tokenizer())
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
