"""Corpus search: tiers, alias expansion, order, senses, spans and explanations; concordance windows; the word-form index."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from corvane.functions.text import field_tier, has_token, norm_query, query_tokens, record_tier, script_of
from corvane.session import stage

TEXT_FIELDS = ("text", "gloss", "source", "variety", "record_id", "alt_text", "translation_en")
META_FIELDS = ("gloss", "source", "variety", "record_id", "translation_en")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def search(records: DataFrame, q: str, aliases: list[str] | None = None, kind: str | None = None, source: str | None = None, variety: str | None = None, last_source: str | None = None, nfkc: bool = True) -> DataFrame:
    """Records that match, with `tier` (0 the phrase or an alias as a whole word, 1 all words of one field) and `late` (of
    the source that comes last). Order by late, tier, pos.

    records: kind, pos and TEXT_FIELDS. An empty query matches everything with tier 0. With aliases, metadata matches come
    with tier 1, and only running texts are shown unless kind is lexicon.
    """
    phrase, wanted = norm_query(q), query_tokens(norm_query(q))
    for name, value in (("kind", kind), ("source", source), ("variety", variety)):
        records = records.where(F.col(name) == value) if value else records
    forms = [norm_query(a) for a in aliases or [] if norm_query(a)]
    if not phrase:
        tier = F.lit(0)
    elif forms:
        held = F.lit(False)
        for form in forms:
            held = held | has_token("text", form, nfkc)
        tier = F.when(held, 0).when(record_tier(list(META_FIELDS), phrase, wanted, nfkc) >= 0, 1).otherwise(-1)
        records = records if kind == "lexicon" else records.where("kind = 'text'")
    else:
        tier = record_tier(list(TEXT_FIELDS), phrase, wanted, nfkc)
    late = F.coalesce((F.col("source") == last_source).cast("int"), F.lit(0)) if last_source else F.lit(0)
    return records.withColumn("tier", tier).where("tier >= 0").withColumn("late", late)


def senses(records: DataFrame, aliases: list[str], late_source: str, most: int = 8) -> DataFrame:
    """(late, n, gloss): the first `most` different glosses of dictionary rows that hold an alias form, in corpus order, by whether the source is the late one."""
    held = F.lit(False)
    for a in aliases:
        held = held | has_token("text", norm_query(a))
    rows = records.where("kind = 'lexicon' and gloss <> ''").where(held).withColumn("late", F.coalesce(F.col("source") == late_source, F.lit(False)))
    first = rows.groupBy("late", "gloss").agg(F.min("pos").alias("pos"))
    return first.withColumn("n", F.row_number().over(W.partitionBy("late").orderBy("pos"))).where(F.col("n") <= most).select("late", "n", "gloss")


@lru_cache(4096)
def _search_form(ch: str) -> str:
    """`norm` of one character."""
    return unicodedata.normalize("NFKC", ch).lower().translate({ord("ё"): "е", ord("i"): "Ӏ", ord("і"): "Ӏ", ord("ӏ"): "Ӏ"}).lower()


def spans_of(text: str | None, forms: list[str], whole_words: bool) -> list[tuple[int, int]]:
    """The places (in characters of the text) that occurrences of the forms cover, as stretches.

    Each form is a pattern over the text's search form, with or without word borders; the characters behind its matches are
    marked, and the stretches of marked characters are the spans, so overlapping and touching matches are one.
    """
    pieces = [_search_form(ch) for ch in text or ""]
    line, owner = "".join(pieces), np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])
    before, after = (r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])") if whole_words else ("", "")
    marked = np.zeros(len(pieces), bool)
    for form in set(filter(None, forms)):
        for m in regex.finditer(before + regex.escape(form) + after, line):
            marked[owner[m.start()] : owner[m.end() - 1] + 1] = True
    border = np.flatnonzero(np.diff(marked, prepend=False, append=False))
    return list(zip(border[::2].tolist(), border[1::2].tolist()))


def highlight(text: str | None, phrase: str, wanted: list[str], forms: list[str]) -> list[tuple[int, int]]:
    """Spans to show: alias forms, else the phrase, else all words of a query of two or more."""
    if forms:
        return spans_of(text, forms, True) or (spans_of(text, [phrase], False) if phrase else [])
    return (spans_of(text, [phrase], False) if phrase else []) or (spans_of(text, wanted, True) if phrase and len(wanted) > 1 else [])


def highlighted(c: Column, q: str, aliases: list[str] | None = None) -> Column:
    """Spans of one text column, for the rows of a page."""
    phrase, wanted, forms = norm_query(q), query_tokens(norm_query(q)), [norm_query(a) for a in aliases or []]

    @F.pandas_udf(SPANS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"start": a, "end": b} for a, b in highlight(x, phrase, wanted, forms)])

    return run(c)


def explained(q: str, aliases: list[str] | None = None) -> Column:
    """The first field, in their order, that explains a match whose text shows nothing; alias if only the expansion does."""
    phrase, wanted = norm_query(q), query_tokens(norm_query(q))
    fields = META_FIELDS if aliases else TEXT_FIELDS
    found = [F.when(field_tier(f, phrase, wanted) >= 0, f) for f in fields]
    return F.coalesce(*found, F.lit("alias") if aliases else F.lit(None).cast("string"))


# ---- word forms


def word_forms(docs: DataFrame, least_sources: int = 2) -> DataFrame:
    """(form, sources, occurrences, script, confidence) of forms that at least `least_sources` sources attest.

    Words are counted per form and source first, so a frequent form costs one row a source in the second step. Null sources
    and texts attest nothing.
    """
    words = docs.where("source is not null").select("source", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")).alias("form"))
    tally = words.groupBy("form", "source").agg(F.count("*").alias("n"))
    forms = tally.groupBy("form").agg(F.count("*").alias("sources"), F.sum("n").alias("occurrences")).where(F.col("sources") >= least_sources)
    confidence = F.when(F.col("sources") >= 5, "high").when(F.col("sources") >= 3, "medium").otherwise("low")
    return forms.select("form", "sources", "occurrences", script_of("form").alias("script"), confidence.alias("confidence"))


def contained(forms: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (form, id): the words of `forms` (form) stand one after the other in a text of `texts` (id, text).

    Forms are joined on their rarest word only, and the padded line of words is then searched for the whole form.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    f = forms.select("form", words("form").alias("w")).distinct()
    lines = texts.select("id", words("text").alias("w")).where("id is not null")
    tokens = lines.select("id", F.explode(F.array_distinct("w")).alias("token"))
    n = tokens.groupBy("token").agg(F.count("*").alias("n"))
    each = f.select("form", padded("w").alias("phrase"), F.explode("w").alias("token"))
    rarest = stage(each.join(n, "token").groupBy("form", "phrase").agg(F.min(F.struct("n", "token"))["token"].alias("token")))
    near = tokens.join(rarest, "token").select("form", "phrase", "id")
    return near.join(lines.select("id", padded("w").alias("line")), "id").where(F.col("line").contains(F.col("phrase"))).select("form", "id").distinct()


def windows(text: str | None, form: str, most: int = 4, before: int = 90, after: int = 120) -> list[str]:
    """Up to `most` windows of whole words around a form, with ellipses where text goes on."""
    line, out, at = text or "", [], 0
    low = line.lower()
    while form and len(out) < most and (k := low.find(form, at)) >= 0:
        at = end = k + len(form)
        if (k and (low[k - 1].isalpha() or low[k - 1].isnumeric())) or (end < len(low) and (low[end].isalpha() or low[end].isnumeric())):
            continue
        a, b = max(0, k - before), min(len(line), end + after)
        while 0 < a < k and not line[a - 1].isspace():
            a += 1
        while end < b < len(line) and not line[b].isspace():
            b -= 1
        cut = " ".join(line[a:b].split())
        out.append(("… " if a else "") + cut + (" …" if b < len(line) else ""))
        at = max(at, b)
    return out


def concordance(docs: DataFrame, key: str, text: str, form: str, most: int = 4) -> DataFrame:
    """(key, n, snippet) of the texts that hold `form` as a word; texts are searched in the JVM, windows cut in Python."""
    low = form.lower()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, s) for k, x in zip(b["key"], b["text"]) for n, s in enumerate(windows(x, low, most), 1)]
            yield pd.DataFrame(rows, columns=["key", "n", "snippet"]).astype({"n": "int32"})

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.contains(F.lower("text"), F.lit(low)))
    return rows.mapInPandas(run, f"key {kind}, n int, snippet string").withColumnRenamed("key", key)


def snippet_quality(snippet: Column, form: str) -> Column:
    """A score for a snippet: length, sentence end and Cyrillic count for it, damaged words, digits and odd signs against it."""
    s = F.coalesce(snippet, F.lit(""))
    damaged = F.regexp_count(s, F.lit(r"[A-Za-z][\x{0400}-\x{04FF}]|[\x{0400}-\x{04FF}][A-Za-z]"))
    score = F.when(F.length(s).between(40, 260), 3).otherwise(0) + F.when(s.rlike("[.!?…]"), 1).otherwise(0) + F.when(F.regexp_count(s, F.lit(r"[\x{0400}-\x{04FF}]")) > F.length(s) / 2, 3).otherwise(0)
    return (score - 3 * damaged - F.regexp_count(s, F.lit(r"\d{3,}")) - F.regexp_count(s, F.lit(r"[|_~^=<>]")) + F.when(F.contains(F.lower(s), F.lit(form)), 1).otherwise(-4)).cast("int")
