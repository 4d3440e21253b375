"""Russian inflection: a Porter-style stemmer as an Arrow function over distinct words, and what is built on it."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

#: Endings by class, after the public Porter stemmer for Russian, with two nouns' endings more; results depend on
#: the values, not on their order, since the longest ending that fits is cut.
VOWELS = "аеиоуыэюя"
GERUND = "ившись ывшись ивши ывши ив ыв"
GERUND_AFTER_A = "вшись вши в"
REFLEXIVE = "ся сь"
ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею"
PARTICIPLE_FIRST, PARTICIPLE_THEN = "ем нн вш ющ щ", "ивш ывш ующ"
VERB = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
VERB_AFTER_A = "ла на ете йте ли й л ем н ло но ет ны ть ешь нно"
NOUN = "иями ями ами ией иям ием иях ию ью ия ья ев ов ие ье еи ии ей ой ий й ям ем ам ом о у ах ях ы ь ю я а евы овы е и"


class _Endings:
    """Endings of one class; the longest that fits is cut."""

    def __init__(self, endings: str) -> None:
        self.endings = tuple(sorted(endings.split(), key=len, reverse=True))

    def cut(self, tail: str, after_a: bool = False) -> str:
        for e in self.endings:
            if tail.endswith(e):
                rest = tail[: len(tail) - len(e)]
                return tail if after_a and not rest.endswith(("а", "я")) else rest
        return tail


CLASSES = {name: _Endings(value) for name, value in (("gerund", GERUND), ("gerund_a", GERUND_AFTER_A), ("reflexive", REFLEXIVE), ("adjective", ADJECTIVE), ("participle", PARTICIPLE_FIRST), ("participle_2", PARTICIPLE_THEN), ("verb", VERB), ("verb_a", VERB_AFTER_A), ("noun", NOUN))}


def _inflected(tail: str) -> str:
    """The tail without the endings of the first class that applies."""
    c = CLASSES
    for name, after_a in (("gerund", False), ("gerund_a", True)):
        if (short := c[name].cut(tail, after_a)) != tail:
            return short
    tail = c["reflexive"].cut(tail)
    if (short := c["adjective"].cut(tail)) != tail:
        return c["participle_2"].cut(c["participle"].cut(short))
    for name, after_a in (("verb", False), ("verb_a", True), ("noun", False)):
        if (short := c[name].cut(tail, after_a)) != tail:
            return short
    return tail


@lru_cache(100_000)
def stem(word: str) -> str:
    """Stem of one word; words under four letters, without a Cyrillic letter, or without anything after the first vowel stay."""
    word = unicodedata.normalize("NFKC", word or "").lower().replace("ё", "е")
    at = next((k for k, ch in enumerate(word) if ch in VOWELS), len(word))
    if len(word) < 4 or not re.search("[а-я]", word) or at >= len(word) - 1:
        return word
    out = word[: at + 1] + _inflected(word[at + 1 :]).removesuffix("и")
    out = out.removesuffix("ость").removesuffix("ейше")
    out = (out[:-1] if out.endswith("нн") else out).removesuffix("ь")
    return out or word


def russian_words(text: str | None) -> list[str]:
    return re.findall("[а-я]+", unicodedata.normalize("NFKC", text or "").lower().replace("ё", "е"))


def key_of(text: str | None) -> str:
    """Stems of the Cyrillic words, joined by blanks."""
    return " ".join(map(stem, russian_words(text)))


@F.pandas_udf(T.StringType())
def stem_key(s: pd.Series) -> pd.Series:
    return s.map(key_of)


def contains_form(text: Column, query: str) -> Column:
    """Whether the stems of `query` occur in the text one after the other; false for a query without Cyrillic words."""
    key = key_of(query)
    if not key:
        return F.lit(False)
    return F.concat(F.lit(" "), stem_key(text), F.lit(" ")).contains(f" {key} ")


def resolve(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query, alias, place, match) for the rows (query) by the alias map (priority, key, ord, alias), keys in search form.

    The exact key of the first map that has it wins, with that key's aliases in their order; else all aliases of keys with the
    same stems, once each, in order of map and place; match is exact or inflection, place counts from 1. Queries without an
    alias have no row. Equal places are ordered by alias.
    """
    q = queries.select("query").where("query is not null").distinct().withColumn("stem", stem_key("query"))
    known = aliases.where("alias is not null and key is not null")
    keys = known.select("key").distinct().withColumn("stem", stem_key("key"))  # each key is stemmed once
    at = F.struct("priority", "ord")
    exact = q.join(known, q["query"] == known["key"]).select("query", "priority", "ord", "alias")
    first = exact.groupBy("query").agg(F.min("priority").alias("priority"))
    exact = exact.join(first, ["query", "priority"]).groupBy("query", "alias").agg(F.min(at).alias("at")).withColumn("match", F.lit("exact"))
    loose = q.where("stem <> ''").join(first, "query", "left_anti").join(keys, "stem").join(known, "key").groupBy("query", "alias").agg(F.min(at).alias("at")).withColumn("match", F.lit("inflection"))
    place = F.row_number().over(W.partitionBy("query").orderBy("at", "alias"))
    return exact.unionByName(loose).select("query", "alias", place.alias("place"), "match")
