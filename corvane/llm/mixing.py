"""Problem 8: sources mixed to target shares of the tokens, by hierarchical budgeting.

The sources are the leaves of a tree domain - language - source; a source's domain and language are those of most of its
tokens. A budget of tokens comes down the tree by the weights (sums of target shares); no node gets more than it can give
under the caps on repeats, and what it can't take goes to its siblings by weight before it goes to its parent's. Each leaf's
budget is met from seeded epochs: whole epochs first, then a prefix of the next one in an order drawn from the seed.

The prefix needs no sort of a whole source: tokens are summed per slice of the order, slices before the cut are taken whole,
and only the slice that holds the cut is sorted.

Defined results: the budget is what all listed sources hold once, unless given; documents without a token, with a null source
or of a source that isn't listed aren't selected; a null or negative cap or share counts as 0; repeated targets of one source
are added up and its largest cap holds; a source that can't reach its share under its cap is reported as too small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from corvane.llm.tokens import NAME, encoded
from corvane.session import ship, stage, table

SEED = 17
SLICES = 4096


def fill(budget: float, weights: list[float], caps: list[float]) -> list[float]:
    """`budget` shared out by weight, nobody getting more than their cap; what is left over is nobody's."""
    out, open_ = [0.0] * len(weights), [k for k, w in enumerate(weights) if w > 0 and caps[k] > 0]
    left = min(budget, sum(caps[k] for k in open_))
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if out[k] + left * weights[k] / total >= caps[k]]
        if not full:
            for k in open_:
                out[k] += left * weights[k] / total
            break
        for k in full:
            left -= caps[k] - out[k]
            out[k] = caps[k]
        open_ = [k for k in open_ if k not in full]
    return out


def budgets(leaves: list[dict], budget: float) -> dict[str, float]:
    """Tokens of each source; leaves have path (domain, language, source), weight and cap."""

    def down(depth: int, rows: list[dict], amount: float) -> dict[str, float]:
        if depth == 3:
            return {rows[0]["path"][2]: amount}
        children: dict[str, list[dict]] = {}
        for r in rows:
            children.setdefault(r["path"][depth], []).append(r)
        names = sorted(children)
        parts = fill(amount, [sum(r["weight"] for r in children[n]) for n in names], [sum(r["cap"] for r in children[n] if r["weight"] > 0) for n in names])
        return {k: v for n, part in zip(names, parts) for k, v in down(depth + 1, children[n], part).items()}

    return down(0, leaves, budget) if leaves else {}


def _main(counts: DataFrame, column: str) -> DataFrame:
    """The value of `column` that most tokens of a source have (ties: the smaller)."""
    sums = counts.groupBy("source", F.coalesce(column, F.lit("")).alias("value")).agg(F.sum("n_tokens").alias("n"))
    return sums.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("x")).select("source", F.col("x.value").alias(column))


def mix(documents: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = SEED, name: str = NAME) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, repeats) of the selected documents, and the shares by source."""
    spark = documents.sparkSession
    ship(spark)
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    listed = documents.select("doc_id", "source", "lang", "genre", "text").join(wanted.select("source"), "source", "left_semi")
    counts = stage(encoded(listed, ["doc_id", "source", "lang", "genre"], "text", count=True, name=name).where("n_tokens > 0"))
    have = wanted.join(counts.groupBy("source").agg(F.sum("n_tokens").alias("available")), "source", "left").join(_main(counts, "genre"), "source", "left").join(_main(counts, "lang"), "source", "left").orderBy("source").collect()  # a row per listed source
    if budget is None:
        budget = float(sum(r.available or 0 for r in have))
    whole = sum(r.target_share for r in have) or 1.0
    leaves = [{"path": (r.genre or "", r.lang or "", r.source), "weight": r.target_share / whole, "cap": float((r.available or 0) * r.max_repeats)} for r in have]
    given = budgets(leaves, budget)
    plan = []
    for r in have:
        amount, available = given.get(r.source, 0.0), r.available or 0
        epochs = min(int(amount // available), r.max_repeats) if available else 0
        rest = amount - epochs * available if epochs < r.max_repeats else 0.0
        plan.append((r.source, epochs, rest, r.target_share / whole, r.max_repeats, available, available * r.max_repeats < budget * r.target_share / whole - 1e-6))
    plan = F.broadcast(spark.createDataFrame(plan, "source string, epochs long, rest double, target_share double, max_repeats int, available long, too_small boolean"))  # a row per listed source
    at = F.pmod(F.xxhash64(F.lit(seed), "epochs", "doc_id"), F.lit(1 << 40))
    drawn = counts.join(plan.select("source", "epochs", "rest"), "source").withColumn("at", at).withColumn("slice", F.shiftright("at", 28).cast("int"))
    slices = drawn.groupBy("source", "slice").agg(F.sum("n_tokens").alias("n"))
    before = slices.select("source", "slice", "n", (F.sum("n").over(W.partitionBy("source").orderBy("slice")) - F.col("n")).alias("before"))  # SLICES rows a source
    placed = drawn.join(before, ["source", "slice"])
    inside = F.col("before") + F.col("n") <= F.col("rest")
    cut = (F.col("before") < F.col("rest")) & ~inside
    sure = placed.where(~cut).withColumn("take", inside.cast("long"))
    run = F.sum("n_tokens").over(W.partitionBy("source").orderBy("at", "doc_id")) + F.col("before")
    edge = placed.where(cut).withColumn("take", (run - F.col("n_tokens") / 2 <= F.col("rest")).cast("long"))
    picked = sure.unionByName(edge).select("doc_id", "source", "n_tokens", (F.col("epochs") + F.col("take")).alias("repeats")).where("repeats > 0")
    used = picked.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
    total = F.sum("actual_tokens").over(W.partitionBy())  # a row per listed source
    shares = plan.join(used, "source", "left").fillna(0, ["actual_tokens", "n_docs", "most_repeats"]).select("source", "target_share", F.coalesce(F.col("actual_tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("actual_share"), "actual_tokens", "available", "max_repeats", "most_repeats", "n_docs", "too_small")
    return picked, shares


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): the selected documents and how often each comes."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every listed source, and whether it is too small for its share under its cap."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]
