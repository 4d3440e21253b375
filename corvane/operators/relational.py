"""Relational building blocks: predicates, joins, aggregates, windows, pages and sets, as functions of DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from corvane.functions.text import half_up

OPEN_RIGHTS = ("open_license", "public_domain", "permission_recorded")


def public_source() -> Column:
    """Rows of sources that anyone may search: flagged, public and with cleared rights; nulls are not."""
    return F.coalesce(F.col("public_search_allowed") & (F.col("access_status") == "public") & F.col("rights_status").isin(*OPEN_RIGHTS), F.lit(False))


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every given value; a value of None filters nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), [(k, v) for k, v in wanted.items() if v is not None], df)


def facet_filter(df: DataFrame, vocabulary: dict[str, tuple], **wanted) -> DataFrame:
    """Like `optional`, but a value outside the column's vocabulary is ignored."""
    return optional(df, **{k: v for k, v in wanted.items() if k in vocabulary and v in vocabulary[k]})


def any_contains(columns: list[str], text: str) -> Column:
    """Whether one of the columns holds `text`, case aside; its % and _ are ordinary characters."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(text))), F.lit(False)) for c in columns])


def facets(df: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, n) of several columns in one pass; nulls are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return df.select(pairs).select("x.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`; make the order total."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_each(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key with their rank. Spark prunes to n rows a key before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50, most: int = 200, clamp: bool = True) -> DataFrame:
    """One page of `df`; sizes are held between 1 and `most`, and with `clamp` a page past the end is the last one."""
    size, number = min(max(1, size), most), max(1, number)
    if clamp:
        number = min(number, max(1, -(-df.count() // size)))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows to append: of `new`, the first of each key that `old` doesn't hold; null keys never match."""
    return latest(new, keys, order).join(old.select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, refresh: list[str], keep: list[str]) -> DataFrame:
    """Old and new rows by key: `refresh` columns come from the new row where there is one, `keep` columns stay; `change` says what happened."""
    o, n = old.select(key, *[F.col(c).alias(f"o_{c}") for c in refresh + keep], F.lit(True).alias("had")), new.select(key, *[F.col(c).alias(f"n_{c}") for c in refresh + keep], F.lit(True).alias("has"))
    j = o.join(n, key, "full_outer")
    differs = reduce(lambda a, b: a | b, [~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")) for c in refresh])
    change = F.when(F.col("had").isNull(), "inserted").when(F.col("has").isNull(), "kept").when(differs, "refreshed").otherwise("same")
    return j.select(key, *[F.when(F.col("has"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in refresh], *[F.when(F.col("had"), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c) for c in keep], change.alias("change"))


def overlap_counts(df: DataFrame, form: str, source: str) -> DataFrame:
    """(left_source, right_source, forms, pairs): forms two sources share and the pairs of rows behind them, which are never built."""
    n = df.where(F.col(form).isNotNull() & F.col(source).isNotNull()).groupBy(F.col(source).alias("source"), F.col(form).alias("form")).agg(F.count("*").alias("n"))
    a, b = (n.select("form", F.col("source").alias(f"{s}_source"), F.col("n").alias(f"{s}_n")) for s in ("left", "right"))
    return a.join(b, "form").where("left_source < right_source").groupBy("left_source", "right_source").agg(F.count("*").alias("forms"), F.sum(F.col("left_n") * F.col("right_n")).alias("pairs"))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of every rule that doesn't hold; a rule that is null doesn't."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(p, F.lit(False)), F.lit(name)) for name, p in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.col(key).alias("row_key"), F.explode(broken).alias("rule"))


def reconcile(observed: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(name, expected, observed, matches) of the counts (name, observed)."""
    want = observed.sparkSession.createDataFrame(list(expected.items()), "name string, expected long")
    return want.join(observed, "name", "left").select("name", "expected", F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("expected") == F.coalesce("observed", F.lit(0))).alias("matches"))


def streaks(days: DataFrame, key: str, day: str) -> DataFrame:
    """(key, first_day, last_day, days): runs of consecutive days; repeated days count once."""
    d = days.select(key, F.to_date(day).alias("d")).where("d is not null").distinct()
    n = F.row_number().over(W.partitionBy(key).orderBy("d"))
    return d.withColumn("island", F.date_sub("d", n)).groupBy(key, "island").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("days")).drop("island")


def bursts(df: DataFrame, key: str, ts: str, seconds: int, order: str, slice_seconds: int = 3600) -> DataFrame:
    """Each row with `recent`: earlier rows of its key within the last `seconds`, itself not among them, and `since` the one before in seconds.

    A key's rows are worked on by slices of time, each with the last `seconds` of the slice before it, so that a key with
    most of the rows isn't one task; what precedes a slice is known from the slices' last times. Rows without a time have
    no place in the order: their results are null.
    """
    width = max(seconds, slice_seconds) * 1_000_000
    rows = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_b", F.floor(F.col("_t") / width))
    carried = rows.where(F.col("_t") >= (F.col("_b") + 1) * width - seconds * 1_000_000).select(key, order, "_t", (F.col("_b") + 1).alias("_b"), F.lit(True).alias("_carried"))
    last = rows.groupBy(key, "_b").agg(F.max("_t").alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(W.partitionBy(key).orderBy("_b"))).drop("_last")  # a row per slice with rows
    w = W.partitionBy(key, "_b").orderBy("_t")
    before = F.lag("_t").over(W.partitionBy(key, "_b").orderBy("_t", order))
    all_ = rows.unionByName(carried, allowMissingColumns=True).withColumn("recent", F.count("*").over(w.rangeBetween(-seconds * 1_000_000, 0)) - 1).withColumn("_p", before).where("_carried is null")
    known = last.withColumnRenamed(key, "_k").withColumnRenamed("_b", "_lb")
    out = all_.join(known, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_lb")), "left")
    timed = F.col("_t").isNotNull()
    return out.select(*df.columns, F.when(timed, F.col("recent")).alias("recent"), ((F.col("_t") - F.coalesce("_p", "_before")) / 1e6).alias("since"))


def reliability(events: DataFrame, key: str, order: list[Column], outcome: str, weight: str, last: int = 100, prior: float = 5.0) -> DataFrame:
    """(key, n, score): (prior / 2 + sum of outcome times weight) / (prior + sum of weights) over the latest `last` events, three digits."""
    recent = top_each(events, [key], order, last)
    return recent.groupBy(key).agg(F.count("*").alias("n"), half_up((F.lit(prior * 0.5) + F.sum(F.col(outcome) * F.col(weight))) / (F.lit(prior) + F.sum(weight)), 3).alias("score"))
