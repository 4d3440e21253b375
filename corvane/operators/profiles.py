"""Source profiles, bucketed pair proposal, scored relationships; alignment of two texts by a length-based dynamic program."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from corvane.functions.text import half_up, script_of, set_jaccard, shingle_sketch, sketch_jaccard, words

UNITS, CHARS = 120, 40_000


def profiles(units: DataFrame, source: str, text: str, order: list[str]) -> DataFrame:
    """One row a source: (source, units, chars, digest, script, numbers, sketch).

    Of each source the first UNITS units in `order` count, until CHARS characters are reached (the unit that crosses is
    kept): profiles are samples by definition. Null units count nothing.
    """
    w = W.partitionBy("source").orderBy(*order)
    first = units.where(F.col(text).isNotNull() & F.col(source).isNotNull()).select(F.col(source).alias("source"), F.col(text).alias("text"), *[F.col(c) for c in order if c not in (source, text)])
    first = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= UNITS)
    first = first.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < CHARS)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")  # UNITS rows at most
    p = first.groupBy("source").agg(F.count("*").alias("units"), F.sum(F.length("text")).alias("chars"), body.alias("body"))
    return p.select("source", "units", "chars", F.sha2("body", 256).alias("digest"), script_of("body").alias("script"), F.array_distinct(F.slice(F.regexp_extract_all("body", F.lit(r"(\d{1,4})"), 1), 1, 400)).alias("numbers"), shingle_sketch(words("body")).alias("sketch"))


MOST = 40


def _members(keys: DataFrame, item: str, kind: str, key: str) -> DataFrame:
    """Distinct (item, kind, key) without nulls."""
    return keys.select(F.col(item).alias("item"), F.col(kind).alias("kind"), F.col(key).alias("key")).where("key is not null and item is not null").distinct()


def bucket_pairs(keys: DataFrame, item: str, kind: str, key: str, least: int = 2, most: int | None = MOST) -> DataFrame:
    """(left, right, kinds) of items that share a bucket of `least` to `most` members; left < right, kinds sorted.

    Pairs of larger buckets are quadratic in their members, so those come from bucket_members instead; with `most` None all
    buckets are paired.
    """
    k = _members(keys, item, kind, key)
    n = F.col("n")
    ok = k.groupBy("kind", "key").agg(F.count("*").alias("n")).where(n >= least if most is None else n.between(least, most)).select("kind", "key")
    held = k.join(ok, ["kind", "key"])
    both = held.withColumnRenamed("item", "left").join(held.withColumnRenamed("item", "right"), ["kind", "key"]).where(F.col("left") < F.col("right"))
    return both.groupBy("left", "right").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def bucket_members(keys: DataFrame, item: str, kind: str, key: str, most: int = MOST) -> DataFrame:
    """(kind, key, item, representative) of the buckets of more than `most` members, whole; the representative is the least item.

    Two items are a pair of such a bucket if they have the same kind and key here: nothing is lost beside bucket_pairs, and
    the rows are as many as the members.
    """
    k = _members(keys, item, kind, key)
    large = k.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("item").alias("representative")).where(F.col("n") > most).drop("n")
    return k.join(large, ["kind", "key"]).select("kind", "key", "item", "representative")


def score_pairs(pairs: DataFrame, p: DataFrame, least: float = 0.35) -> DataFrame:
    """(left, right, signals, confidence, relation) of pairs with two signals or more and enough confidence.

    Signals and weights: equal digests .6, sketches at .55 or more .45 (at .12 or more .2), shared numbers at .25 .15, lengths
    within .6 .1, equal scripts .1; confidence is their sum, .99 at most.
    """
    a, b = (p.select(*[F.col(c).alias(f"{s}_{c}" if c != "source" else s) for c in p.columns]) for s in ("left", "right"))
    j = pairs.join(a, "left").join(b, "right").withColumn("jac", sketch_jaccard("left_sketch", "right_sketch")).withColumn("num", set_jaccard("left_numbers", "right_numbers"))
    ratio = F.least("left_chars", "right_chars") / F.greatest("left_chars", "right_chars", F.lit(1))
    rules = ((F.col("left_digest") == F.col("right_digest"), "digest", 0.6), (F.col("jac") >= 0.55, "sketch_strong", 0.45), (F.col("jac").between(0.12, 0.5499999), "sketch_weak", 0.2), (F.col("num") >= 0.25, "numbers", 0.15), (ratio >= 0.6, "length", 0.1), (F.col("left_script") == F.col("right_script"), "script", 0.1))
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("signal"), F.lit(x).alias("weight"))) for c, n, x in rules]), lambda x: x.isNotNull())
    total = F.aggregate("found", F.lit(0.0), lambda s, x: s + x["weight"])
    out = j.withColumn("found", found).withColumn("confidence", half_up(F.least(F.lit(0.99), total), 4)).where((F.size("found") >= 2) & (F.col("confidence") >= least))
    has = lambda n: F.exists("found", lambda x: x["signal"] == n)
    relation = F.when(has("digest"), "duplicate").when(has("sketch_strong"), "alternate_edition").when(F.col("left_script") != F.col("right_script"), "transliteration").otherwise("parallel_text")
    return out.select("left", "right", F.array_join(F.transform("found", lambda x: x["signal"]), ",").alias("signals"), "confidence", relation.alias("relation"))


def bands(sketch: Column, n: int = 8) -> Column:
    """The first n values of a sketch as bucket keys."""
    return F.transform(F.slice(sketch, 1, n), lambda x: x.cast("string"))


def family(path: Column) -> Column:
    """title: the file name without endings and numbers, unless that says nothing; then folder:, then path:."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))
    root = F.regexp_replace(stem, r"([-_ ]*([0-9]+[a-z]?|copy|final|draft|v[0-9]+))+$", "")
    folder = F.try_element_at(F.split(path, "/"), F.lit(-2))
    return F.when((F.length(root) >= 4) & ~root.isin("text", "document", "file", "scan", "page"), F.concat(F.lit("title:"), root)).when(folder != "", F.concat(F.lit("folder:"), F.lower(folder))).otherwise(F.concat(F.lit("path:"), F.lower(path)))


# ---- alignment


MERGE, SKIP, EPS = 0.3, 0.9, 1e-12
#: The moves (units taken left, right), in the order in which they reach a place when places are worked on row by
#: row; of equal costs the first to arrive stays.
MOVES = ((2, 1), (1, 2), (1, 1), (1, 0), (0, 1))


def numbers(text: str) -> frozenset[str]:
    return frozenset(re.findall(r"\d{1,4}", text))


def _units(texts: list[str]) -> list[tuple[int, frozenset[str]]]:
    """Length and numbers of every unit, and behind them those of every two neighbours joined by a blank."""
    one = [(max(len(x), 1), numbers(x)) for x in texts]
    return [*one, *((len(x) + 1 + len(y), p[1] | q[1]) for x, y, p, q in zip(texts, texts[1:], one, one[1:]))]


def pair_cost(left: tuple[int, frozenset[str]], right: tuple[int, frozenset[str]], ratio: float) -> float:
    """Relative difference of lengths at the expected ratio (left by right), less half the overlap of numbers; not below 0."""
    (n, a), (m, b) = left, right
    cost = abs(n - m * ratio) / max(n, m * ratio)
    return max(0.0, cost - (0.5 * round(len(a & b) / len(a | b), 4) if a and b else 0.0))


def align(left: list[str], right: list[str]) -> list[tuple[list[int], list[int], float]]:
    """The cheapest sequence of moves through both sides: (left places, right places, confidence), confidence being 1 less the move's cost.

    Both sides empty give no rows. Null units count as empty. Equal costs: see MOVES.
    """
    left, right = [x or "" for x in left], [x or "" for x in right]
    ratio = (sum(map(len, left)) or 1) / (sum(map(len, right)) or 1)
    rows, columns, lu, ru = len(left) + 1, len(right) + 1, _units(left), _units(right)
    best = [[float("inf")] * columns for _ in range(rows)]
    came: list[list[tuple[int, int, float]]] = [[(0, 0, 0.0)] * columns for _ in range(rows)]
    best[0][0] = 0.0
    for i in range(rows):
        for j in range(columns):
            for a, b in MOVES:
                if i < a or j < b or best[i - a][j - b] == float("inf"):
                    continue
                cost = SKIP
                if a and b:
                    cost = pair_cost(lu[i - a if a == 1 else len(left) + i - a], ru[j - b if b == 1 else len(right) + j - b], ratio) + (MERGE if a + b > 2 else 0)
                if best[i - a][j - b] + cost < best[i][j] - EPS:
                    best[i][j], came[i][j] = best[i - a][j - b] + cost, (a, b, cost)
    out, i, j = [], len(left), len(right)
    while i or j:
        a, b, cost = came[i][j]
        out.append((list(range(i - a, i)), list(range(j - b, j)), round(max(0.0, min(1.0, 1 - cost)), 4)))
        i, j = i - a, j - b
    return out[::-1]


def sections(units: list[str], chunk: int = 10) -> list[list[int]]:
    """Places of the units by section: from heading to heading where there are two at least, else runs of `chunk`."""
    heads = [k for k, u in enumerate(units) if 0 < len(u.strip()) <= 90 and u.strip()[-1] not in ".!?…"]
    cuts = sorted({0, *heads}) if len(heads) >= 2 else list(range(0, len(units), chunk))
    return [list(range(a, b)) for a, b in zip(cuts, [*cuts[1:], len(units)])]


def align_hierarchy(left: list[str], right: list[str]) -> list[dict]:
    """Rows (level, parent, n, left, right, confidence): sections aligned by their whole text, then the units of aligned sections."""
    ls, rs = sections(left), sections(right)
    rows: list[dict] = []
    for n, (a, b, c) in enumerate(align(["\n".join(left[k] for k in s) for s in ls], ["\n".join(right[k] for k in s) for s in rs])):
        lu, ru = [k for s in a for k in ls[s]], [k for s in b for k in rs[s]]
        rows.append({"level": "section", "parent": -1, "n": n, "left": lu, "right": ru, "confidence": c})
        for m, (x, y, d) in enumerate(align([left[k] for k in lu], [right[k] for k in ru])):
            rows.append({"level": "unit", "parent": n, "n": m, "left": [lu[k] for k in x], "right": [ru[k] for k in y], "confidence": d})
    return rows


def align_pairs(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, level, parent, n, left, right, confidence): alignment of the two unit arrays of every row; null arrays count as empty."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            rows = [{"key": k} | r for k, x, y in zip(b["key"], b["left"], b["right"]) for r in align_hierarchy(list(x if x is not None else []), list(y if y is not None else []))]
            yield pd.DataFrame(rows, columns=["key", "level", "parent", "n", "left", "right", "confidence"])

    rows = df.select(F.col(key).alias("key"), F.col(left).alias("left"), F.col(right).alias("right"))
    return rows.mapInPandas(run, f"key {kind}, level string, parent int, n int, left array<int>, right array<int>, confidence double").withColumnRenamed("key", key)
