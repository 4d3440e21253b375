"""Problem 4: splits that keep related records together (largest differencing into equal bins, bins to splits).

Records are the pairs with an effective split. Two are related if they share an owner, a request or a noted source; groups are
the connected components of the graph of records and the values they share. A value links each of its records to itself, so a
value that a third of all rows hold costs as many edges as it has rows, never their pairs.

Assignment: groups heavier than a bin are few (at most as many as there are bins) and are placed first, each into the split
with the largest unmet share; the others are dealt to shards of bounded size, and each shard's groups are combined by
repeatedly joining the two partial partitions of largest spread in opposite order (multiway largest differencing) until BINS
equal bins are left. Whole bins then go to the splits by what each still lacks.

Defined results: nulls, blanks and entries that say "not known" relate nothing; a record without any related record is a
group of its own; repeated rows count once; without records the results are empty; a target share below zero counts as 0.
"""

from __future__ import annotations

import heapq
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.operators.graph import components
from corvane.session import ship, stage, table

#: Entries that merely say that the source isn't known.
UNKNOWN = ("n/a", "na", "n.a.", "n. a.", "unknown", "not known", "none", "null", "nil", "-", "--", "–", "—", "?", "??", "б/и", "б/н", "б.и.", "неизвестно", "неизвестен", "нет", "нет данных", "не указано", "не указан", "source unknown", "unbekannt", "anonymous", "аноним", "tbd", "xxx", "no source", "unk", "unspecified")
BINS = 200
SHARD = 20_000


def effective_splits(adjudications: DataFrame) -> DataFrame:
    """(pair_id, split): the effective split of every pair that has one.

    The row with the highest pair_version counts; rows of one pair and version that differ are taken in order of created_at,
    loaded_at and id, the last one first. Blanks are any white space.
    """
    order = F.struct("pair_version", "created_at", "loaded_at", "id", F.struct("decision", "split").alias("x"))
    last = adjudications.where("pair_id is not null and pair_version is not null").groupBy("pair_id").agg(F.max(order).alias("last"))
    split = F.lower(F.trim(F.regexp_replace("last.x.split", r"[\s\p{Z}]+", " ")))
    return last.where(F.lower(F.trim("last.x.decision")) == "approve").select("pair_id", split.alias("split")).where("split is not null and split <> ''")


def source_key(c: str | Column) -> Column:
    """The noted source: the text before the first `;`, in lower case and with single blanks; null where it isn't known."""
    c = F.col(c) if isinstance(c, str) else c
    key = F.trim(F.lower(F.regexp_replace(F.substring_index(c, ";", 1), r"[\s\p{Z}]+", " ")))
    known = key.rlike(r"[\p{L}\p{N}]") & ~key.isin(*UNKNOWN) & ~F.regexp_replace(key, r"[^\p{L}\p{N}/ ]+", "").isin(*UNKNOWN)
    return F.when(known, key)


def _known(c: str) -> Column:
    key = F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))
    return F.when((key != "") & ~F.lower(key).isin(*UNKNOWN), key)


def related(records: DataFrame) -> DataFrame:
    """(pair_id, group_id) of records (pair_id, owner_id, request_id, source_provenance); group_id is the group's smallest pair id."""
    keys = F.array(F.concat(F.lit("o\t"), _known("owner_id")), F.concat(F.lit("r\t"), _known("request_id")), F.concat(F.lit("s\t"), source_key("source_provenance")))
    held = stage(records.select("pair_id", F.explode(keys).alias("key")).where("key is not null and pair_id is not null").distinct())
    first = held.groupBy("key").agg(F.min("pair_id").alias("first"))
    edges = held.join(first, "key").select(F.col("pair_id").alias("a"), F.col("first").alias("b"))
    found = components(edges).select(F.col("node").alias("pair_id"), F.col("component").alias("group_id"))
    return records.select("pair_id").where("pair_id is not null").distinct().join(found, "pair_id", "left").select("pair_id", F.coalesce("group_id", "pair_id").alias("group_id"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with an effective split: (pair_id, split, owner_id, request_id, source_provenance), once per row and content."""
    pairs = table(spark, sf_dir, "parallel_pairs").select(F.col("id").alias("pair_id"), "owner_id", "request_id", "source_provenance")
    return pairs.join(effective_splits(table(spark, sf_dir, "pair_adjudications")), "pair_id").distinct()


def difference(weights: list[int], bins: int) -> list[int]:
    """The bin of each weight by multiway largest differencing; bins are numbered from 0."""
    heap = [(-w, k, [(0, None)] * (bins - 1) + [(w, (k, None, None))]) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:  # each entry: sums in rising order with a linked tree of their items
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = sorted(((x + y, tx if ty is None else ty if tx is None else (None, tx, ty)) for (x, tx), (y, ty) in zip(a, reversed(b))), key=lambda s: s[0])
        low = both[0][0]
        heapq.heappush(heap, (low - both[-1][0], tick, [(s, t) for s, t in both]))
        tick += 1
    out = [0] * len(weights)
    for number, (_, tree) in enumerate(heap[0][2] if heap else []):
        todo = [tree] if tree is not None else []
        while todo:
            item, left, right = todo.pop()
            if item is not None:
                out[item] = number
            todo += [t for t in (left, right) if t is not None]
    return out


def _pack(pdf: pd.DataFrame, bins: int, shares: dict[str, float]) -> pd.DataFrame:
    """Bins of one shard, whole bins to the splits. What rounding gives away is spread over the shards by a shift that differs from shard to shard."""
    pdf = pdf.sort_values(["size", "group_id"], ascending=[False, True])
    n = min(bins, max(len(pdf), 1))
    pdf = pdf.assign(bin=difference(pdf["size"].tolist(), n))
    load = pdf.groupby("bin")["size"].sum().sort_values(ascending=False, kind="stable")
    shard = int(pdf["shard"].iloc[0])
    lacks = {k: s * load.sum() + ((shard * (0.618 + 0.1 * i)) % 1 - 0.5 if shard else 0) * load.sum() / n for i, (k, s) in enumerate(shares.items())}
    split = {}
    for number, weight in load.items():
        split[number] = best = max(lacks, key=lambda k: (lacks[k], k))
        lacks[best] -= weight
    return pdf.assign(split=pdf["bin"].map(split))[["group_id", "split"]]


def assign(groups: DataFrame, targets: dict[str, float], bins: int = BINS, shard: int = SHARD) -> DataFrame:
    """(pair_id, group_id, split) for the rows (pair_id, group_id) of `groups`, near the shares of `targets`."""
    spark = groups.sparkSession
    sizes = stage(groups.groupBy("group_id").agg(F.count("*").alias("size")))
    total, n = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    whole = sum(max(s, 0) for s in targets.values()) or 1
    lacks = {k: max(s, 0) / whole * total for k, s in sorted(targets.items())}
    limit = total / bins

    def place(size: int) -> str:
        best = max(lacks, key=lambda k: (lacks[k], k))
        lacks[best] -= size
        return best

    large = [(r.group_id, place(r["size"])) for r in sizes.where(F.col("size") > limit).orderBy(F.desc("size"), "group_id").collect()]  # at most `bins` rows
    shards = max(1, -(-n // shard))
    rest = sizes.where(F.col("size") <= limit).withColumn("shard", F.pmod(F.xxhash64("group_id"), F.lit(shards)).cast("int"))
    left = {k: max(x, 0) for k, x in lacks.items()}
    shares = {k: x / (sum(left.values()) or 1) for k, x in left.items()}
    small = rest.groupBy("shard").applyInPandas(partial(_pack, bins=bins, shares=shares), "group_id string, split string")
    placed = spark.createDataFrame(large, "group_id string, split string").unionByName(small)
    return groups.join(placed, "group_id").select("pair_id", "group_id", "split")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, group_id) of pairs whose group holds more than one effective split today."""
    ship(spark)
    r = stage(records(spark, sf_dir))
    g = stage(related(r))
    split = r.select("pair_id", "split").distinct()
    torn = g.join(split, "pair_id").groupBy("group_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("group_id")
    return g.join(torn, "group_id").select("pair_id", "group_id").distinct()


def p4_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, group_id, split): a split for every pair with an effective split, no group torn, near the shares of split_targets."""
    ship(spark)
    targets = {r.split_name: r.target_share for r in table(spark, sf_dir, "split_targets").where("split_name is not null and target_share is not null").collect()}  # a row per split
    return assign(stage(related(stage(records(spark, sf_dir)))), targets)


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, n_pairs, n_groups, share, target_share) of that assignment."""
    a = stage(p4_assignment(spark, sf_dir))
    total = a.count() or 1
    got = a.groupBy("split").agg(F.count("*").alias("n_pairs"), F.countDistinct("group_id").alias("n_groups"))
    targets = table(spark, sf_dir, "split_targets").select(F.col("split_name").alias("split"), "target_share")
    return targets.join(got, "split", "full_outer").select("split", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), (F.coalesce("n_pairs", F.lit(0)) / F.lit(total)).alias("share"), "target_share")
