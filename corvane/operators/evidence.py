"""Evidence for queries: typing, gold status, isolation from held-out items, order, and what a run over all queries finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.operators.relational import top_each
from corvane.operators.search import contained

#: Classes of evidence with their scores; all but the last may propose a translation.
CLASSES = {"approved_parallel_pair": 12, "attested_public_example": 8, "direct_dictionary": 6, "usage_support_only": 3}


def blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def evidence_class(exact: Column) -> Column:
    """Class of a pair (status, ru_text, lak_text) that holds a query; `exact`: the query is its whole Russian side.

    Reviewed memory first, then what has both sides, as a dictionary entry where the query is all there is on one; a pair
    that lacks a side proves no translation."""
    both = ~blank("ru_text") & ~blank("lak_text")
    return F.when(both & (F.col("status") == "approved"), "approved_parallel_pair").when(both & exact, "direct_dictionary").when(both, "attested_public_example").otherwise("usage_support_only")


def held_out(pairs: DataFrame) -> DataFrame:
    """(answer): both sides of the pairs of split test, lower-cased."""
    t = pairs.where("split = 'test'")
    return t.select(F.explode(F.array(F.lower(F.trim("lak_text")), F.lower(F.trim("ru_text")))).alias("answer")).where("answer <> ''").distinct()


def isolated(pairs: DataFrame) -> DataFrame:
    """The pairs that are no held-out item and repeat neither side of one. Null sides repeat nothing."""
    out = pairs.where(~F.col("split").eqNullSafe("test"))
    for side in ("lak_text", "ru_text"):
        out = out.withColumn("answer", F.lower(F.trim(side))).join(held_out(pairs), "answer", "left_anti").drop("answer")
    return out


def gathered(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query, pair_id, class, can_propose, gold, ocr): the isolated pairs whose Russian side holds a query's words in a row.

    queries: (query), any number of rows of which repeated, null and wordless ones count once or not at all."""
    kept = isolated(pairs).dropDuplicates(["id"])
    forms = queries.select(F.lower(F.trim("query")).alias("form")).where("form <> ''").distinct()
    found = contained(forms, kept.select("id", F.col("ru_text").alias("text")))
    e = found.join(kept.select("id", "status", "ru_text", "lak_text", "source_type"), "id")
    e = e.withColumn("class", evidence_class(F.lower(F.trim("ru_text")) == F.col("form")))
    return e.select(F.col("form").alias("query"), F.col("id").alias("pair_id"), "class", (F.col("class") != "usage_support_only").alias("can_propose"), (F.col("class") == "approved_parallel_pair").alias("gold"), F.coalesce(F.col("source_type") == "archive", F.lit(False)).alias("ocr"))


def score(c: str = "class") -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv]), F.col(c))


def ordered(evidence: DataFrame, most: int, ocr_last: bool) -> DataFrame:
    """The first `most` rows of each query: gold, what may propose, (scans last,) the class's score, then the pair's id."""
    by = [F.desc("gold"), F.desc("can_propose"), *([F.asc("ocr")] if ocr_last else []), F.desc(score()), F.col("pair_id")]
    return top_each(evidence, ["query"], by, most)


def run_classes(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query, class): the best class that each query finds, `none` without evidence."""
    best = evidence.groupBy("query").agg(F.max(F.struct(score().alias("score"), "class"))["class"].alias("class"))
    all_ = queries.select(F.lower(F.trim("query")).alias("query")).where("query <> ''").distinct()
    return all_.join(best, "query", "left").select("query", F.coalesce("class", F.lit("none")).alias("class"))
