"""Problem 1: near-duplicate records by b-bit MinHash.

Each text's set of 4-character runs (of its reduced plain form) is hashed by K functions. Of each minimum only low bits are
kept: 8 of them in the bands of four functions that give candidate pairs, one of each of 64 functions packed into a
64-bit signature that travels with the bands. Within a bucket the share of equal bits, corrected for chance collisions, drops
candidates far below the threshold; an exact comparison of the sets decides on the rest. Groups are the connected
components of the pairs that are left.

Texts are worked on by a 64-bit hash of their reduced form, so exact copies are one text from the start, whatever their
number: a task emits a text's bands once. Buckets of different texts are streamed in sorted order; one that exceeds
BLOCK members is handed on as blocks whose pairs are compared in separate tasks, so no bucket has to fit into a task.

Defined results: null texts and texts whose reduced form is shorter than MIN_CHARS have no similarity and are in no group;
rows that are repeated count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm.plain import reduce_text
from corvane.operators.graph import components
from corvane.session import ship, stage, table

RUN, MIN_CHARS = 4, 40
#: No two bands share a function.
ROWS, BANDS = 4, 24
K = ROWS * BANDS
#: Functions that give a bit of the sketch.
BITS = 64
#: Candidates whose corrected estimate is further below the threshold than this are dropped: three standard deviations at 64 bits.
MARGIN = 0.3
BLOCK = 512
#: Pairs of small buckets that are held in memory at once, about.
PAIRS_AT_ONCE = 1_000_000
#: Texts that a task remembers, about.
SEEN = 500_000
#: Hashes of texts that are sent to all tasks at most; beyond it Spark shuffles.
BROADCAST_ROWS = 4_000_000

_rng = np.random.RandomState(20240607)
_MUL = (_rng.randint(0, 2**31, K).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.randint(0, 2**31, K).astype(np.uint32)
_BAND = _rng.permutation(K).reshape(BANDS, ROWS)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def runs(texts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all character runs of `texts`, one text after the other, and where each text's begin (with the end)."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(len(code) - run + 1, 0), np.uint64)
    for k in range(run):
        h = h * np.uint64(0x100000001B3) + code[k : len(code) - run + 1 + k] + np.uint64(1)
    each = np.maximum(n - run + 1, 0)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(each)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], each)
    return _mix(h[at]), offsets


def signatures(texts: list[str]) -> np.ndarray:
    """Packed signatures (len(texts), K) of one byte per function; every text must hold one run at least."""
    h, offsets = runs(texts)
    x = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32)
    out, buf = np.empty((len(texts), K), np.uint8), np.empty(len(x), np.uint32)
    for k in range(K):
        np.multiply(x, _MUL[k], out=buf)
        np.add(buf, _ADD[k], out=buf)
        low = np.minimum.reduceat(buf, offsets[:-1])
        low ^= low >> np.uint32(15)
        low *= np.uint32(0x2C1B3C6D)
        out[:, k] = (low >> np.uint32(12)).astype(np.uint8)
    return out


def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, reduced) -> (key, h, sketch) of every band; a copy is passed over if its text came by lately in the task (others fall out in the buckets)."""
    seen: set[int] = set()
    for b in batches:
        if len(seen) > SEEN:
            seen.clear()
        h, texts, keep = b.column(0).to_pylist(), b.column(1).to_pylist(), []
        for k, x in enumerate(h):
            if x not in seen:
                seen.add(x)
                keep.append(k)
        if keep:
            sig, h = signatures([texts[k] for k in keep]), np.array([h[k] for k in keep], np.int64)
            sketch = np.packbits(sig[:, :BITS] & 1, axis=1, bitorder="little").view(np.int64).ravel()
            keys = [_mix(sig[:, rows].astype(np.uint64) @ (np.uint64(256) ** np.arange(ROWS, dtype=np.uint64)) + np.uint64((k + 1) << 40)).view(np.int64) for k, rows in enumerate(_BAND)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(h, BANDS)), pa.array(np.tile(sketch, BANDS))], ["key", "h", "sketch"])


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sketch", pa.int64()), ("block", pa.int64())])


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from one bit of each minimum, corrected for the even chance that bits of different minima agree."""
    return 1 - np.bitwise_count((a ^ b).view(np.uint64)).astype(np.float64) * (2 / BITS)


def _all_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within runs of a sorted column, run by run size."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(sizes):
        i, j = np.triu_indices(n, 1)
        s = starts[sizes == n][:, None]
        left.append((s + i).ravel())
        right.append((s + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(key, h, sketch), sorted within the task, -> (a, b, null, null): pairs of different texts in one bucket whose estimate
    doesn't rule them out, each once a batch. A bucket of more than BLOCK texts comes out as rows (key, h, sketch, block
    number) instead. Only one bucket's tail is held from batch to batch."""
    none = np.zeros((3, 0), np.int64)
    tail, spilled = none, {}

    def emit(rows: np.ndarray, last: bool):
        nonlocal tail
        if not rows.shape[1]:
            return
        keep = np.ones(rows.shape[1], bool)
        keep[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
        rows = rows[:, keep]
        key, h, sketch = rows
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([cut, [len(key)]]))
        tail = none if last else rows[:, cut[-1] :]
        if not last:  # the last bucket may go on
            cut, sizes = cut[:-1], sizes[:-1]
        big = (sizes > BLOCK) | np.isin(key[cut], np.fromiter(spilled, np.int64, len(spilled)))
        for s, n in zip(cut[big], sizes[big]):
            yield from give(rows[:, s : s + n])
        ok = ~big & (sizes > 1)
        starts, sizes = cut[ok], sizes[ok]
        made = np.cumsum(sizes * (sizes - 1) // 2)
        ends = np.unique(np.append(np.searchsorted(made, np.arange(PAIRS_AT_ONCE, made[-1] + 1, PAIRS_AT_ONCE)) + 1, len(made))) if len(made) else []
        for a, b in zip([0, *ends[:-1]], ends):
            i, j = _all_pairs(starts[a:b], sizes[a:b])
            near = estimate(sketch[i], sketch[j]) >= threshold - MARGIN
            if near.any():
                both = np.unique(np.sort(np.stack([h[i[near]], h[j[near]]]), axis=0), axis=1)
                empty = pa.nulls(both.shape[1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), empty, empty], schema=PAIR)
        if tail.shape[1] > 4 * BLOCK:
            rows, tail = tail[:, :-1], tail[:, -1:]
            yield from give(rows)

    def give(rows: np.ndarray):
        k = int(rows[0, 0])
        n = spilled.get(k, 0)
        spilled.clear()  # buckets come in order, so only the current one can go on
        spilled[k] = n + rows.shape[1]
        yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array((n + np.arange(rows.shape[1])) // BLOCK)], schema=PAIR)

    held, size = [], 0
    for b in batches:  # a few batches at a time, so that little is cut off
        held.append(np.stack([c.to_numpy() for c in b.columns]))
        size += b.num_rows
        if size >= 200_000:
            yield from emit(np.concatenate([tail, *held], axis=1), False)
            held, size = [], 0
    yield from emit(np.concatenate([tail, *held], axis=1), True)


def block_pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(hs, sketches, hs_b, sketches_b) of two blocks of a large bucket -> (a, b) that the estimate allows."""
    for t in batches:
        for row in zip(*(c.to_pylist() for c in t.columns)):
            ha, sa, hb, sb = (np.array(x, np.int64) for x in row)
            i, j = np.nonzero((estimate(sa[:, None], sb[None]) >= threshold - MARGIN) & (ha[:, None] != hb[None]))
            if len(i):
                both = np.unique(np.sort(np.stack([ha[i], hb[j]]), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def similarity(left: list[str], right: list[str]) -> np.ndarray:
    """Exact similarity of the sets of character runs, text by text."""

    def sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        h, offsets = runs(texts)
        n = np.diff(offsets)
        row = np.repeat(np.arange(len(texts)), n)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        return h[keep], row[keep]

    (hl, rl), (hr, rr) = sets(left), sets(right)
    h, row = np.concatenate([hl, hr]), np.concatenate([rl, rr])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    both = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=len(left))
    total = np.bincount(row, minlength=len(left)) - both
    return both / np.maximum(total, 1)


def verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> (a, b, similarity) of the pairs at or above the threshold."""
    for t in batches:
        if t.num_rows:
            s = similarity(t.column(2).to_pylist(), t.column(3).to_pylist())
            ok = pa.array(s >= threshold)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(ok), t.column(1).filter(ok), pa.array(s).filter(ok)], ["a", "b", "similarity"])


def links(texts: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(a, b, similarity): hashes of different reduced texts of `texts` (h, reduced) that are similar enough; a < b."""
    spark = texts.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    buckets = texts.mapInArrow(bands, "key long, h long, sketch long").repartition(n, "key").sortWithinPartitions("key", "h")
    found = stage(buckets.mapInArrow(partial(pairs, threshold=threshold), "a long, b long, sketch long, block long"))
    likely = found.where("block is null").select("a", "b")
    large = found.where("block is not null").select(F.col("a").alias("key"), F.col("b").alias("h"), "sketch", "block")
    if not large.isEmpty():
        blocks = stage(large.groupBy("key", "block").agg(F.collect_list("h").alias("hs"), F.collect_list("sketch").alias("ss")))  # BLOCK rows each
        heads = blocks.select("key", F.col("block").alias("block_b"))
        other = blocks.select("key", F.col("block").alias("block_b"), F.col("hs").alias("hs_b"), F.col("ss").alias("ss_b"))
        two = blocks.join(heads, "key").where("block_b >= block").join(other, ["key", "block_b"]).select("hs", "ss", "hs_b", "ss_b")
        likely = likely.unionByName(two.repartition(n).mapInArrow(partial(block_pairs, threshold=threshold), "a long, b long"))
    likely = stage(likely.distinct())
    ends = stage(likely.select(F.explode(F.array("a", "b")).alias("h")).distinct())
    if ends.count() <= BROADCAST_ROWS:
        ends = F.broadcast(ends)
    held = stage(texts.join(ends, "h", "left_semi").groupBy("h").agg(F.first("reduced").alias("reduced")))
    both = likely.join(held.select(F.col("h").alias("a"), F.col("reduced").alias("text_a")), "a").join(held.select(F.col("h").alias("b"), F.col("reduced").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(partial(verify, threshold=threshold), "a long, b long, similarity double")


def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, h, reduced) of the texts that have a similarity."""
    for b in batches:
        rows = [(k, reduce_text(t)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and len(t) >= MIN_CHARS]
        rows = [(k, np.uint64(xxhash.xxh64_intdigest(r)).astype(np.int64), r) for k, r in rows if len(r) >= MIN_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.column(0).type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["key", "h", "reduced"])


def hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h, reduced) of the rows whose text has a similarity, as a staged table; the key is a string."""
    return stage(df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null").mapInArrow(prepare, "key string, h long, reduced string"))


def groups(df: DataFrame, key: str, text: str, threshold: float = 0.6) -> DataFrame:
    """(key, group): the group of every row key that shares its group with another; groups are closed under similarity."""
    ship(df.sparkSession)
    base = hashed(df, key, text)
    comp = components(stage(links(base.select("h", "reduced"), threshold)))
    ids = base.select(F.col("key").alias(key), "h").distinct()
    grouped = ids.join(comp.withColumnRenamed("node", "h"), "h", "left").select(key, F.coalesce("component", "h").alias("group"))
    several = grouped.groupBy("group").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("group")
    return grouped.join(several, "group").select(key, "group").distinct()


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, group_id) of the segments that have a near-duplicate; group_id is the smallest id of the group."""
    g = groups(table(spark, sf_dir, "segments"), "id", "text_original")
    return g.join(g.groupBy("group").agg(F.min("id").alias("group_id")), "group").select("id", "group_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b): all pairs of segment ids in one group, as the result is defined."""
    g = stage(groups(table(spark, sf_dir, "segments"), "id", "text_original"))
    return g.select(F.col("id").alias("id_a"), "group").join(g.select(F.col("id").alias("id_b"), "group"), "group").where("id_a < id_b").select("id_a", "id_b").distinct()
