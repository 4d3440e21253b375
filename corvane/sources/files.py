"""Readers and writers: JSON lines with digests and rules, literals embedded in pages, quoted CSV, TSV, splits, manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the lines that parse and hold every required field, and (line, reason) of the others. Blank lines are skipped; .gz is read too."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select("line", F.from_json("line", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    missing = F.filter(F.array(*[F.when(F.col(f"r.{c}").isNull(), F.lit(f"missing {c}")) for c in required]), lambda x: x.isNotNull()) if required else F.array().cast("array<string>")
    reason = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "no JSON").when(F.size(missing) > 0, F.array_join(missing, ", "))
    marked = parsed.withColumn("reason", reason)
    return marked.where("reason is null").select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]), marked.where("reason is not null").select("line", "reason")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row as JSON with its keys in order; nulls are written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def embedded_json(page: Column, name: str) -> Column:
    """The JSON literal assigned to `name` in a page's script: from the first bracket after the name to the closing one before `;`; null if there is none."""
    found = F.regexp_extract(page, rf"(?s)\b{re.escape(name)}\s*=\s*([\[{{].*?[\]}}])\s*;", 1)
    return F.nullif(found, F.lit(""))


def overlay(base: DataFrame, extra: DataFrame, key: str, columns: list[str], expected: int | None = None) -> DataFrame:
    """`base` with the columns of `extra` where the key matches; fails unless every key of `extra` occurs once and matches (and there are `expected` of them)."""
    n, keys = extra.agg(F.count("*"), F.countDistinct(key)).first()
    hit = extra.join(base.select(key).distinct(), key, "left_semi").count()
    if n != keys or hit != n or (expected is not None and n != expected):
        raise ValueError(f"overlay of {n} rows has {keys} keys, of which {hit} match; expected {expected}")
    return base.join(extra.select(key, *columns), key, "left")


def write_jsonl(df: DataFrame, path: str, gz: bool = False) -> None:
    """One JSON object a line, fields in the order of the columns, nulls written."""
    out = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    out.write.option("compression", "gzip" if gz else "none").text(path)


def quoted(c: str) -> Column:
    """A value in quotes, quotes doubled, null as the empty string."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(df: DataFrame) -> DataFrame:
    """(line): every row with all values quoted."""
    return df.select(F.concat_ws(",", *map(quoted, df.columns)).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a byte order mark and a header in every part, all values quoted."""
    df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).withColumnRenamed(df.columns[0], "﻿" + df.columns[0]).write.csv(path, header=True, quoteAll=True, escape='"', nullValue=None, emptyValue="")


def tsv_lines(df: DataFrame) -> DataFrame:
    """(line): every row by tabs; tabs and line ends within values become blanks."""
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\\t\\r\\n]", " ") for c in df.columns]
    return df.select(F.concat_ws("\t", *clean).alias("line"))


def by_split(df: DataFrame, split: str, names: dict[str, str]) -> DataFrame:
    """Rows with `part` (the split's exported name); rows of other splits are left out. Written with partitionBy("part") it is one folder a split."""
    out = None
    for k, v in names.items():
        out = F.when(F.col(split) == k, v) if out is None else out.when(F.col(split) == k, v)
    return df.withColumn("part", out).where("part is not null")


def write_artifacts(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write every table as gzipped JSON lines; the manifest (name, rows, digest), digest being over the rows' sorted digests' sum."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        write_jsonl(df, f"{path}/{name}", gz=True)
        n, h = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
        rows.append((name, n, f"{int(h or 0) & (2**128 - 1):032x}"))
    return spark.createDataFrame(rows, "name string, rows long, digest string")


def template(spark: SparkSession, rows: int, columns: list[str]) -> DataFrame:
    """Numbered empty rows to fill in."""
    return spark.range(1, rows + 1).select(F.col("id").alias("n"), *[F.lit("").alias(c) for c in columns])
