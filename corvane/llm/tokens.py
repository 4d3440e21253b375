"""Problem 7: ids of a public byte-level BPE tokenizer for whole corpora.

Two tiers. A minimal perfect hash over the vocabulary (hash and displace: as many slots as entries, one displacement per bucket)
resolves whole pre-tokens, all distinct ones of a batch at once; what it returns is compared byte for byte. Pre-tokens that
aren't in the vocabulary are merged by a heap over linked bytes: entries (merged id, place) wait in order of rank, and a merge
relinks its neighbours and pushes their new pairs. A task works out each distinct pre-token once as long as its bounded table
of known ones lasts.

Defined results: a null text and an empty text both give an empty array; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import heapq
import json
import os
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.session import ship, table

#: The folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("CORVANE_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN = 400_000
PER_BUCKET = 4
DIRECT = 1 << 40


def _hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte strings, all at once."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    at = np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)
    power = np.ones(int(n.max(initial=0)) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(power), 0x9E3779B97F4A7C15 + 2 * seed, np.uint64), out=power)
    mixed = data * power[at]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    h = total[np.cumsum(n)] - total[np.cumsum(n) - n] + n.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct byte strings to their values."""

    def __init__(self, values: dict[bytes, int]) -> None:
        words = sorted(values)
        n = self.n = len(words)
        self.buckets = max(1, n // PER_BUCKET)
        h = _hashes(words)
        if len(np.unique(h)) != n:
            raise ValueError("two entries share a hash")
        bucket, first, step = (x.tolist() for x in self._split(h))
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for k, b in enumerate(bucket):
            members[b].append(k)
        taken, shift, slot = bytearray(n), [0] * self.buckets, [0] * n
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            m = members[b]
            if len(m) < 2:
                break
            d = 0
            while True:
                s = [(first[k] + d * step[k] + d * d * (d >> 4)) % n for k in m]
                if len(set(s)) == len(m) and not any(taken[x] for x in s):
                    break
                d += 1
            shift[b] = d
            for k, x in zip(m, s):
                slot[k], taken[x] = x, 1
        free = iter([k for k in range(n) if not taken[k]])
        for b, m in enumerate(members):  # buckets of one entry name their slot
            if len(m) == 1:
                slot[m[0]] = next(free)
                shift[b] = DIRECT + slot[m[0]]
        self.shift = np.array(shift, np.uint64)
        self.words, self.values = [b""] * n, np.zeros(n, np.int32)
        for w, s in zip(words, slot):
            self.words[s] = w
            self.values[s] = values[w]

    def _split(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (h % np.uint64(self.buckets)).astype(np.int64), (h >> np.uint64(20)) % np.uint64(self.n), (h >> np.uint64(7)) % np.uint64(self.n - 1 or 1) + np.uint64(1)

    def lookup(self, words: list[bytes]) -> list[int]:
        """The values of `words`, -1 for those that aren't held."""
        if not words:
            return []
        bucket, first, step = self._split(_hashes(words))
        d = self.shift[bucket]
        slot = np.where(d >= DIRECT, d - np.uint64(DIRECT), (first + d * step + d * d * (d >> np.uint64(4))) % np.uint64(self.n)).astype(np.int64)
        held, values = self.words, self.values[slot].tolist()
        return [v if held[s] == w else -1 for w, s, v in zip(words, slot.tolist(), values)]


class ByteBpe:
    """The tokenizer: ids of texts."""

    def __init__(self, name: str = NAME, folder: str | None = None) -> None:
        with open(os.path.join(folder or TOKENIZERS, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        to_bytes = lambda s: bytes(byte[c] for c in s)
        vocab = {to_bytes(s): i for s, i in model["vocab"].items() if all(c in byte for c in s)}
        self.bytes = [vocab[bytes([b])] for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = {}
        for rank, (a, b) in enumerate(merges):
            a, b = to_bytes(a), to_bytes(b)
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        # what merges into an entry by itself; others can't be resolved as a whole
        self.perfect = PerfectHash({w: i for w, i in vocab.items() if self.merge(w) == [i]})
        self.known: dict[str, list[int]] = {}
        self.pattern = None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank merges first, the leftmost of equals."""
        ids, pairs = [self.bytes[b] for b in word], self.pairs
        n = len(ids)
        heap = [(*found, k) for k in range(n - 1) if (found := pairs.get(ids[k] << 20 | ids[k + 1]))]
        if not heap:
            return ids
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, get = heapq.heappop, heapq.heappush, pairs.get
        while heap:
            _, new, k = pop(heap)
            a = ids[k]
            j = after[k]
            if a < 0 or j >= n:
                continue
            found = get(a << 20 | ids[j])
            if found is None or found[1] != new:
                continue  # one of the two is gone
            ids[k], ids[j] = new, -1
            j = after[k] = after[j]
            if j < n:
                before[j] = k
                if found := get(new << 20 | ids[j]):
                    push(heap, (*found, k))
            i = before[k]
            if i >= 0 and (found := get(ids[i] << 20 | new)):
                push(heap, (*found, i))
        return [i for i in ids if i >= 0]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of every text."""
        if self.pattern is None:
            self.pattern = regex.compile(PATTERN)
        find = self.pattern.findall
        cut = [find(t) if t else [] for t in texts]
        new = list({w for c in cut for w in c}.difference(self.known))
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = list({w for c in cut for w in c})
        data = [w.encode("utf-8", "surrogatepass") for w in new]
        known, merge = self.known, self.merge
        for w, b, i in zip(new, data, self.perfect.lookup(data)):
            known[w] = [i] if i >= 0 else merge(b)
        return [[i for w in c for i in known[w]] for c in cut]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "pattern": None}


_models: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(name: str = NAME, folder: str | None = None) -> ByteBpe:
    """The tokenizer, read once a process."""
    key = (name, folder or TOKENIZERS)
    if key not in _models:
        _models[key] = ByteBpe(*key)
    return _models[key]


def _encoder(held, count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(held.value)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids = model.encode(part.column(part.num_columns - 1).to_pylist())
                if count:
                    last = pa.array([len(x) for x in ids], pa.int64())
                else:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
                    last = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], last], [*part.schema.names[:-1], "ids"])

    return run


def encoded(df: DataFrame, keys: list[str], text: str, count: bool = False, name: str = NAME) -> DataFrame:
    """(keys, ids) of every row, or (keys, n_tokens) if only counts are asked for. Nothing is shuffled."""
    spark = df.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(pickle.dumps(tokenizer(name)))
    rows = df.select(*keys, F.col(text).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(_encoder(held, count), f"{schema}, ids {'long' if count else 'array<int>'}")
    return out.withColumnRenamed("ids", "n_tokens") if count else out


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encoded(table(spark, sf_dir, "documents"), ["doc_id"], "text")
