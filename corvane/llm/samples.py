"""The labelled language samples that models are fitted to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def labelled(samples: DataFrame, most: int) -> list[tuple[str, str]]:
    """(lang, text) of at most `most` samples of each language, the first by sample_id."""
    order = Window.partitionBy("lang").orderBy("sample_id", "sample_text")
    rows = samples.where("sample_text is not null").select("lang", "sample_text", "sample_id", F.row_number().over(order).alias("n_")).where(F.col("n_") <= most)
    return [(r.lang, r.sample_text) for r in rows.orderBy("sample_id", "sample_text").collect()]
