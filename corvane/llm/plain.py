"""Problem 5: one plain form for texts that look the same (script-aware repair).

Plain form: letters composed (NFC), ordinary spaces, no invisible and no full-width characters, every palochka U+04C0, and no
word that mixes look-alike letters of another script. A word's dominant script is the one that owns letters which no other
script could stand for; look-alikes of other scripts are replaced by that script's letters. Only words of mixed script are
touched, so Roman numerals and foreign words that stand alone stay. A word's readings are looked up in the corpus vocabulary;
where none occurs there, the plain form forbids the mixed word all the same, and the likeliest reading is taken in a step of
its own (see `decided`).

Defined results: a null text has a null plain form and is never reported; an empty text is its own plain form.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corvane.session import ship, stage, table

PALOCHKA = "Ӏ"
#: Letters of two scripts that look alike, Latin under Cyrillic and Latin under Greek.
PAIRS_CYRILLIC = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
}
PAIRS_GREEK = {"ο": "o", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ι": "i", "α": "a"}
#: Consonants that a palochka follows, and what is typed instead of it.
BEFORE_PALOCHKA = "кптцчхг"
STAND_INS = "Il1|ІіiӀӏ"

_TO_LATIN = {"cyrl": PAIRS_CYRILLIC, "grek": PAIRS_GREEK, "latn": {}}
#: Rare Cyrillic letters are read as Latin, but a Latin letter never stands for one of them.
_LATIN_TO_CYRILLIC = {v: k for k, v in PAIRS_CYRILLIC.items() if k not in "іјѕһԁԛԝІЈЅ"}
_LATIN_TO_GREEK = {v: k for k, v in PAIRS_GREEK.items()}

#: Java and Python read this alike; texts that it doesn't match are in plain form. It may match more than needed.
SUSPECT = (
    r"[\p{M}\p{Cf}\p{Zs}&&[^ ]]|[\u034f\u115f\u1160\u2028\u2029\u3164\uffa0\u1100-\u11ff\uf900-\ufaff\uff01-\uff5e\u04cf\u0406\u0456\u0370-\u03ff\u1f00-\u1fff\u2126\u212a\u212b]"
    r"|[\u0400-\u052f][A-Za-z|1\u00c0-\u02af\u1e00-\u1eff]|[A-Za-z\u00c0-\u02af\u1e00-\u1eff][\u0400-\u052f]"
)
_INVISIBLE = regex.compile(r"[\p{Cf}\u034f\u115f\u1160\u3164\uffa0\u180b-\u180f\ufe00-\ufe0f\U000E0100-\U000E01EF]+")
_SPACES = regex.compile(r"[\p{Zs}\u2028\u2029]")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_WORD = regex.compile(r"[\p{L}\p{M}|1]*\p{L}[\p{L}\p{M}|1]*")
_MIXED = regex.compile(r"\p{Cyrillic}[\p{Latin}\p{Greek}|1ІіӏӀ]|[\p{Latin}][\p{Cyrillic}\p{Greek}]|[\p{Greek}][\p{Latin}\p{Cyrillic}]|[іІӏ]|\p{M}", 0)
_STAND_IN = regex.compile(rf"(?i:(?<=[{BEFORE_PALOCHKA}]\p{{M}}*))(?:[Il|ІіiӀӏ]|1(?!\d))")
_SCRIPTS = (("cyrl", regex.compile(r"\p{Cyrillic}")), ("latn", regex.compile(r"\p{Latin}")), ("grek", regex.compile(r"\p{Greek}")))


def _script(ch: str) -> str:
    for name, pattern in _SCRIPTS:
        if pattern.match(ch):
            return name
    return ""


def _move(ch: str, script: str, to: str) -> str | None:
    """`ch` as the look-alike letter of script `to`; None if there is none."""
    base, marks = unicodedata.normalize("NFD", ch)[0], unicodedata.normalize("NFD", ch)[1:]
    latin = base if script == "latn" else _TO_LATIN[script].get(base)
    if latin is None:
        return None
    out = latin if to == "latn" else (_LATIN_TO_CYRILLIC if to == "cyrl" else _LATIN_TO_GREEK).get(latin)
    return None if out is None else unicodedata.normalize("NFC", out + marks)


def _as(word: str, to: str) -> str | None:
    """`word` with every letter in script `to`, or None."""
    out = []
    for ch in word:
        s = _script(ch)
        if s and s != to:
            ch = PALOCHKA if ch == PALOCHKA and to == "latn" else _move(ch, s, to)
            if ch is None:
                return None
            if ch == PALOCHKA:
                ch = "I"
        out.append(ch)
    return "".join(out)


def readings(word: str) -> list[str]:
    """The single-script readings of one word, the likeliest first; [word] if it needs no repair or allows none."""
    if not _MIXED.search(word):
        return [word]
    counts = Counter(filter(None, map(_script, word)))
    if counts["cyrl"] and _ANY_STAND_IN.search(word):
        fixed = _STAND_IN.sub(PALOCHKA, word)
        if counts["cyrl"] > 1 and not any(_script(c) == "latn" and c not in "Ili" and _move(c, "latn", "cyrl") is None for c in fixed):
            fixed = regex.sub(r"(?<=\p{Cyrillic})[Il|i](?=\p{Cyrillic})", PALOCHKA, fixed)
        own = Counter(filter(None, map(_script, fixed)))
        if own["cyrl"] >= own["latn"] or all(_script(c) != "latn" or _move(c, "latn", "cyrl") for c in fixed):
            word = fixed
    word = word.replace("ӏ", PALOCHKA)
    letters = [(c, _script(c)) for c in word if _script(c)]
    counts = Counter(s for _, s in letters)
    if len(counts) < 2:
        return [word]
    owners = {s for c, s in letters if c == PALOCHKA or all(_move(c, s, t) is None for t in ("latn", "cyrl") if t != s)}
    order = sorted(counts, key=lambda s: (s not in owners, -counts[s], s == "grek", s))
    found = [r for r in (_as(word, s) for s in order if s != "grek" or s in owners) if r is not None]
    if len(owners) == 1:
        found = found[:1]
    return found or [word]


_ANY_STAND_IN = regex.compile(rf"[{STAND_INS}]")


def squash(text: str) -> str:
    """The steps of the plain form that look at single characters."""
    text = _INVISIBLE.sub("", text.translate(_WIDE))
    return unicodedata.normalize("NFC", _SPACES.sub(" ", text))


def plain_text(text: str, chosen: dict[str, str] | None = None) -> str:
    """The plain form of one text; `chosen` gives the reading of words that allow several."""
    return _WORD.sub(lambda m: (chosen or {}).get(m[0]) or readings(m[0])[0], squash(text)).replace("ӏ", PALOCHKA)


#: Letters that plain texts of one script are made of; texts of other characters are looked at closely.
_SAFE = [frozenset(chr(c) for c in (*range(32, 127), 9, 10, 13, 0xA7, 0xAB, 0xBB, *range(0x2010, 0x2028), *range(0xC0, 0x180), 0x194, 0x263, *range(0x1E00, 0x1F00)) if chr(c) not in {"|"}),
         frozenset(chr(c) for c in (*range(32, 65), *range(91, 97), 9, 10, 13, 0xA7, 0xAB, 0xBB, *range(0x2010, 0x2028), *range(0x410, 0x450), 0x401, 0x451, 0x4C0) if chr(c) not in "1")]


def is_plain(text: str) -> bool:
    """Whether the characters alone show that a text is in plain form; False says nothing."""
    held = set(text)
    return held <= _SAFE[1] or held <= _SAFE[0]


def reduce_text(text: str) -> str:
    """The reduced form of one text; see `reduced`."""
    if is_plain(text):
        text = text.lower()
    else:
        text = plain_text(text).lower()
    return _RUNS.sub(" ", text.replace("ӏ", PALOCHKA)).strip()


_RUNS = regex.compile(r"[^\p{L}\p{Nd}]+")


@F.pandas_udf(T.StringType())
def _plain_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else plain_text(x))


def plain(text: str | Column) -> Column:
    """Plain form of a text column. Texts that need no repair never leave the JVM: the Python step gets null for them."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_plain_udf(F.when(c.rlike(SUSPECT), c)), c)


def reduced(text: str | Column) -> Column:
    """Plain form, lower case (palochka U+04C0), each run of anything but letters and digits one blank, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(plain(text)), "ӏ", PALOCHKA), r"[^\p{L}\p{Nd}]+", " "))


@cache
def _odd(word: str) -> bool:
    return readings(word) != [word]


@F.pandas_udf(T.StructType([T.StructField("squashed", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))]))
def _look_udf(s: pd.Series) -> pd.DataFrame:
    """Each text after the steps that look at single characters, and its words that need repair."""
    squashed = [squash(t) for t in s]
    return pd.DataFrame({"squashed": squashed, "words": [sorted({w for w in _WORD.findall(t) if _MIXED.search(w) and _odd(w)}) for t in squashed]})


@F.pandas_udf(T.ArrayType(T.StringType()))
def _readings_udf(s: pd.Series) -> pd.Series:
    return s.map(readings)


@F.pandas_udf(T.StringType())
def _chosen_udf(squashed: pd.Series, words: pd.Series, chosen: pd.Series) -> pd.Series:
    out = []
    for t, w, c in zip(squashed, words, chosen):
        if w is not None and len(w):
            to = dict(zip(w, c))
            t = _WORD.sub(lambda m: to.get(m[0], m[0]), t)  # noqa: B023
        out.append(t.replace("ӏ", PALOCHKA))
    return pd.Series(out, dtype=object)


def decided(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, text, plain, step) of the rows of `df` whose text may need repair; all others are in plain form.

    The words to repair are gathered over all rows, and their single-script readings are looked up in the vocabulary: the words
    of all rows that need no repair, without regard to case. Step `vocabulary`: a word is replaced by the reading that is most
    frequent there. Step `definition`: where none is, the plain form allows no mixed word all the same, so the likeliest
    reading is taken. A row's step is the last one that any of its words needs, `characters` if only single characters are
    replaced, `none` if nothing is. Words and readings stay distributed; only rows that hold such words are joined.
    """
    ship(df.sparkSession)
    base = df.select(*keys, F.col(text).alias("text")).where("text is not null")
    looked = stage(base.where(F.col("text").rlike(SUSPECT)).select(*keys, "text", _look_udf("text").alias("x"), F.monotonically_increasing_id().alias("rid")).select(*keys, "text", "rid", "x.*"))
    words = stage(looked.select(F.explode("words").alias("word")).distinct().select("word", F.posexplode(_readings_udf("word")).alias("k", "reading")))
    tokens = base.select("text").unionByName(looked.where("text <> squashed").select(F.col("squashed").alias("text"))).select(F.explode(F.split("text", r"[^\p{L}\p{M}|1]+")).alias("token"))
    wanted = words.select(F.lower("reading").alias("low")).distinct()
    counted = tokens.groupBy("token").agg(F.count("*").alias("n")).withColumn("low", F.lower("token"))
    known = counted.join(wanted, "low", "left_semi")
    known = known.join(words.select(F.col("word").alias("token")).distinct(), "token", "left_anti").groupBy("low").agg(F.sum("n").alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.col("k")).alias("k"), "reading")
    best = words.withColumn("low", F.lower("reading")).join(known, "low", "left").groupBy("word").agg(F.max(order).alias("x")).select("word", F.col("x.reading").alias("reading"), (F.col("x.n") > 0).alias("known"))
    picks = looked.select("rid", F.explode("words").alias("word")).join(stage(best), "word").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("word", "reading", "known"))).alias("c"))  # words of one row
    told = looked.drop("words").join(picks, "rid", "left")
    step = F.when(F.exists("c", lambda c: ~c["known"]), "definition").when(F.col("c").isNotNull(), "vocabulary").when(F.col("text") != F.col("plain"), "characters").otherwise("none")
    return told.select(*keys, "text", "c", _chosen_udf("squashed", F.col("c.word"), F.col("c.reading")).alias("plain")).select(*keys, "text", "plain", step.alias("step"))


def repair(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, text, plain, step) of every row of `df` with a text; see `decided`."""
    rest = df.select(*keys, F.col(text).alias("text")).where("text is not null").where(~F.col("text").rlike(SUSPECT))
    return rest.select(*keys, "text", F.col("text").alias("plain"), F.lit("none").alias("step")).unionByName(decided(df, keys, text))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_key, text) of the three tables with texts in the language."""
    parts = (("segments", "id", "text_original"), ("gold_set", "id", "lak_text"), ("pcmlbe_parallel", "record_id", "lak_cyrillic"))
    out = None
    for name, key, text in parts:
        part = table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), F.col(key).alias("row_key"), F.col(text).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_key) of texts that aren't equal to their plain form, once per key."""
    return decided(texts(spark, sf_dir), ["table_name", "row_key"], "text").where("text <> plain and row_key is not null").select("table_name", "row_key").distinct()


def p5_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_key, plain) of every text, once per key and text."""
    return repair(texts(spark, sf_dir), ["table_name", "row_key"], "text").select("table_name", "row_key", "plain").distinct()


def p5_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, step, n_texts): how many texts need which step at last; see `decided`."""
    return repair(texts(spark, sf_dir), ["table_name", "row_key"], "text").groupBy("table_name", "step").agg(F.count("*").alias("n_texts"))
