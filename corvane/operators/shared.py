"""Texts that share words with queries, ranked and counted, without a row for each word or pair of theirs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Characters of texts that one task indexes; copies of the texts at most, made so that all cores have work; queries that are worth a copy.
BLOCK, COPIES, WORTH = 1 << 25, 4, 1000
#: Score from which a match is a strong one.
STRONG = 4

TOP = pa.struct([("kind", pa.int32()), ("lost", pa.int64()), ("none", pa.bool_()), ("id", pa.string()), ("hits", pa.int64())])
FOUND = "key string, n long, best long, strong long, first string, top array<struct<kind:int,lost:long,none:boolean,id:string,hits:long>>"


def words(c: str) -> Column:
    """Distinct lower-case words of a text; null of a null."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def shared_words(queries: DataFrame, texts: DataFrame, most: int = 0, whole: int = 0, each: bool = False) -> DataFrame:
    """(id, n, best, strong, first, top) of the queries (id, text) that share a word with a text (id, text, kind).

    A match is a query's id with a text's id; its hits are the words both hold, its score the hits, and `whole` more if they
    are as many as the query has words. n: matches; best: the highest score; strong: matches of score STRONG or more, and
    first: the smallest id among them. top: up to `most` matches (kind, score, id, hits) by kind, score from the highest and id,
    nulls last, of texts of kind 1 or more, once, or with `each` as often as there are rows of that id and kind. As in a join,
    rows of one id count together, on either side.

    A text goes to one block by its id, a block's index of words is held by as many tasks as there are slices of queries, and
    queries of the same words are one. So what is shuffled are the texts, COPIES times at most, and one row for each query and
    block; the postings of a query's words are added up in memory."""
    spark = texts.sparkSession
    lines = texts.select("id", words("text").alias("w"), "kind")
    asked = queries.select("id", words("text").alias("w")).where(F.size("w") > 0).select("id", F.array_join(F.array_sort("w"), " ").alias("line"))
    asked = asked.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("line")), "|").alias("key"))
    blocks = max(1, -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK))
    slices = max(1, min(COPIES, -(-spark.sparkContext.defaultParallelism // blocks), -(-queries.count() // WORTH)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = lines.select("id", F.coalesce(F.array_join("w", " "), F.lit("")).alias("line"), F.col("kind").cast("int").alias("kind"), part("id", blocks).alias("block"), all_(slices).alias("slice"), F.lit(False).alias("asks")).where("line <> '' or kind > 0")
    right = asked.select(F.col("key").alias("line")).distinct().select(F.lit(None).cast("string").alias("id"), "line", F.lit(0).alias("kind"), all_(blocks).alias("block"), part("line", slices).alias("slice"), F.lit(True).alias("asks"))
    rows = left.unionByName(right).select((F.col("block") * slices + F.col("slice")).alias("unit"), "asks", "id", "line", "kind")
    found = rows.repartitionById(blocks * slices, "unit").sortWithinPartitions("unit", "asks").mapInArrow(partial(meet, most=most, whole=whole, each=each), FOUND)
    if blocks > 1:
        top = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, most) if most else F.first("top")
        found = found.groupBy("key").agg(F.sum("n").alias("n"), F.max("best").alias("best"), F.sum("strong").alias("strong"), F.min("first").alias("first"), top.alias("top"))
    top = F.transform("top", lambda x: F.struct(x["kind"].alias("kind"), (-x["lost"]).alias("score"), x["id"].alias("id"), x["hits"].alias("hits")))
    return asked.join(found, "key").select("id", "n", "best", "strong", "first", top.alias("top"))


def ranked(found: DataFrame) -> DataFrame:
    """(query, id, hits, score, rank): a row for each match in the `top` of `shared_words`."""
    x = found.select(F.col("id").alias("query"), F.posexplode("top").alias("at", "x"))
    return x.select("query", "x.id", "x.hits", "x.score", (F.col("at") + 1).cast("long").alias("rank"))


def meet(batches: Iterator[pa.RecordBatch], most: int, whole: int, each: bool) -> Iterator[pa.RecordBatch]:
    """Rows (unit, asks, id, line, kind) by unit, texts before queries: the texts become an index, each batch of queries is answered."""
    unit, texts, index = None, [], None
    for b in batches:
        u, asks = (b[c].to_numpy(zero_copy_only=False) for c in ("unit", "asks"))
        cuts = [0, *(np.flatnonzero((u[1:] != u[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(u)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if u[i] != unit:
                unit, texts, index = u[i], [], None
            if not asks[i]:
                texts.append(b.slice(i, j - i))
                continue
            if texts:
                index, texts = Index(pa.Table.from_batches(texts), each), []
            if index:
                yield index.answers(b["line"].slice(i, j - i), most, whole)


class Index:
    """Postings of a block's words: places of ids in their order, with the number of rows that hold the word where ids repeat."""

    def __init__(self, texts: pa.Table, each: bool) -> None:
        ids = texts["id"].combine_chunks().dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(ids.dictionary, null_placement="at_end")
        self.ids, n = ids.dictionary.take(order), len(order)
        rank = np.empty(n, np.int64)
        rank[order.to_numpy()] = np.arange(n)
        place = rank[ids.indices.to_numpy()]
        kind = texts["kind"].to_numpy()
        self.rows = {k: np.minimum(np.bincount(place[kind == k], minlength=n), np.iinfo(np.int64).max if each else 1) for k in np.unique(kind).tolist() if k > 0}
        self.all = {k: bool((r > 0).all()) for k, r in self.rows.items()}
        some = pc.not_equal(texts["line"], "")  # no words are no word
        place, lines = place[some.to_numpy()], pc.split_pattern(texts["line"].filter(some).cast(pa.large_string()).combine_chunks(), " ")
        w = lines.flatten().dictionary_encode()
        self.words = w.dictionary
        at = w.indices.to_numpy().astype(np.int64) * n + np.repeat(place, pc.list_value_length(lines).to_numpy())
        at.sort()
        new = np.flatnonzero(np.diff(at, prepend=-1))
        self.weights = None if len(new) == len(at) else np.diff(new, append=len(at))
        at = at[new]
        self.starts = np.searchsorted(at, np.arange(len(self.words) + 1) * n).tolist()
        self.posts = at % max(n, 1)
        self.hits, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def answers(self, keys: pa.Array, most: int, whole: int) -> pa.RecordBatch:
        prompts = pc.split_pattern(keys, "|")
        lines = pc.split_pattern(prompts.flatten(), " ")
        codes = pc.fill_null(pc.index_in(lines.flatten().cast(pa.large_string()), value_set=self.words), -1).to_numpy().tolist()
        sizes, counts = pc.list_value_length(lines).to_numpy().tolist(), pc.list_value_length(prompts).to_numpy().tolist()
        out, tops, ends, p, c = [], [], [0], 0, 0
        for q, count in enumerate(counts):
            asked = []
            for size in sizes[p : p + count]:
                asked.append((size, [x for x in codes[c : c + size] if x >= 0]))
                c += size
            p += count
            if not any(x for _, x in asked):
                continue
            at, hits, score = self.scored(asked, whole)
            strong = at[score >= STRONG]
            out.append((q, len(at), int(score.max()), len(strong), int(strong.min()) if len(strong) else None))
            if most:
                tops += self.top(at, hits, score, most)
            ends.append(len(tops))
        q, n, best, strong, first = zip(*out) if out else [()] * 5
        kind, lost, at, hits = zip(*tops) if tops else [()] * 4
        ids = self.ids.take(pa.array(at, pa.int64()))
        top = pa.StructArray.from_arrays([pa.array(kind, pa.int32()), pa.array(lost, pa.int64()), pc.is_null(ids), ids, pa.array(hits, pa.int64())], fields=list(TOP))
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([keys.take(long(q)), long(n), long(best), long(strong), self.ids.take(long(first)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), top)], names=["key", "n", "best", "strong", "first", "top"])

    def scored(self, asked: list[tuple[int, list[int]]], whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places that hold a word, their hits and scores. Of several prompts the size counts that is largest among those met."""
        parts, several = [], len(asked) > 1
        for size, codes in asked:
            for x in codes:
                i, j = self.starts[x], self.starts[x + 1]
                at = self.posts[i:j]
                have = self.hits[at]
                parts.append(at[have == 0] if parts else at)
                self.hits[at] = have + (1 if self.weights is None else self.weights[i:j])
                if several:
                    self.size[at] = np.maximum(self.size[at], size)
        at = np.concatenate(parts) if len(parts) > 1 else parts[0]
        hits = self.hits[at]
        self.hits[at] = 0
        size = asked[0][0]
        if several:
            size = self.size[at]
            self.size[at] = 0
        return at, hits, hits + whole * (hits == size) if whole else hits

    def top(self, at: np.ndarray, hits: np.ndarray, score: np.ndarray, most: int) -> list[tuple[int, int, int, int]]:
        """(kind, -score, place, hits) of the first `most`: kind by kind, score by score, by place."""
        out: list[tuple[int, int, int, int]] = []
        for kind, rows in sorted(self.rows.items()):
            a, h, s = at, hits, score
            if not self.all[kind]:
                own = rows[at] > 0
                a, h, s = at[own], hits[own], score[own]
            while len(s) and len(out) < most:
                level, need = s.max(), most - len(out)
                here = s == level
                x, y = a[here], h[here]
                if len(x) > need:
                    near = np.argpartition(x, need - 1)[:need]
                    x, y = x[near], y[near]
                for k in np.argsort(x).tolist():
                    out += [(kind, -int(level), int(x[k]), int(y[k]))] * min(int(rows[x[k]]), most)
                if len(out) < most:
                    a, h, s = a[~here], h[~here], s[~here]
        return out[:most]
