"""Dictionary synthesis: rows of several sources to entries, senses, forms, relations and search terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from corvane.functions.text import stable_id, without_marks

#: glosses' words that find nothing, and weights of search terms by kind.
STOP = ("и", "в", "на", "с", "к", "по", "из", "от", "для", "что", "как", "это", "или", "не", "the", "and", "of", "to", "a", "in")
WEIGHTS = {"headword": 100, "form": 88, "gloss_phrase": 70, "gloss_word": 55}


def headword(c: Column) -> tuple[Column, Column]:
    """(word, homonym number): a closing number or Roman numeral is the homonym's."""
    word = F.trim(F.regexp_replace(c, r"\s*(?:[0-9]+|\(?[IVX]+\)?)\s*$", ""))
    roman = F.regexp_extract(c, r"\(?([IVX]+)\)?\s*$", 1)
    number = F.try_to_number(F.nullif(F.regexp_extract(c, r"([0-9]+)\s*$", 1), F.lit("")), F.lit("999")).cast("int")
    values = F.create_map(*[x for k, v in enumerate(("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"), 1) for x in (F.lit(v), F.lit(k))])
    return word, F.coalesce(number, F.try_element_at(values, roman))


def sense_parts(c: Column) -> Column:
    """Senses of a gloss: parts between numbered marks such as `1.` or `2)`, else the whole; empty parts are dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?:^|\s)\d+[.)]\s*"), lambda x: F.trim(x)), lambda x: x != "")


def gloss_candidates(c: Column) -> Column:
    """Single words a sense may be looked up by: cut before a dash, split at stops and numbers, labels in brackets dropped."""
    head = F.element_at(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)|\[[^\]]*\]", " "), r"\s[-–—]\s"), 1)
    parts = F.transform(F.split(head, r"[.;,0-9]+"), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (F.length(x) <= 80) & ~x.contains(" ")))


def gloss_words(c: Column) -> Column:
    """Words of a gloss of three letters and more that aren't stop words."""
    w = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: (F.length(x) >= 3) & ~x.isin(*STOP))
    return F.array_distinct(w)


def paradigm(word: Column, tail: Column) -> Column:
    """Forms of a paradigm: `-ending` is added to the headword, other words stand for themselves."""
    parts = F.filter(F.transform(F.split(F.coalesce(tail, F.lit("")), r"[,;]\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: F.when(x.startswith("-"), F.concat(word, F.substring(x, 2, 1000))).otherwise(x)))


def synthesize(rows: DataFrame) -> dict[str, DataFrame]:
    """entries, senses, forms and terms of rows (source_id, ref, headword, gloss, forms); rows without a headword give none.

    Entries are told apart by source, reference and headword; a repeated one counts once. A term's weight is the largest
    of its kinds'."""
    word, number = headword(F.col("headword"))
    base = rows.withColumn("word", word).withColumn("homonym", number).where("word <> ''").withColumn("entry_id", stable_id("lex", "source_id", "ref", "headword"))
    entries = base.withColumn("n", F.row_number().over(W.partitionBy("entry_id").orderBy("gloss", "forms"))).where("n = 1").drop("n")
    senses = entries.select("entry_id", F.posexplode(sense_parts(F.col("gloss"))).alias("n", "sense"))
    forms = entries.select("entry_id", F.explode(paradigm(F.col("word"), F.col("forms"))).alias("form")).unionByName(entries.select("entry_id", F.col("word").alias("form"))).distinct()
    w = WEIGHTS
    terms = entries.select("entry_id", F.lower("word").alias("term"), F.lit(w["headword"]).alias("weight"))
    terms = terms.unionByName(forms.select("entry_id", F.lower("form").alias("term"), F.lit(w["form"]).alias("weight")))
    terms = terms.unionByName(senses.select("entry_id", F.explode(gloss_candidates(F.col("sense"))).alias("term"), F.lit(w["gloss_phrase"]).alias("weight")))
    terms = terms.unionByName(senses.select("entry_id", F.explode(gloss_words(F.col("sense"))).alias("term"), F.lit(w["gloss_word"]).alias("weight")))
    terms = terms.groupBy("entry_id", "term").agg(F.max("weight").alias("weight"))
    return {"entries": entries.select("entry_id", "source_id", "ref", "word", "homonym", without_marks("word").alias("search_form"), "gloss"), "senses": senses, "forms": forms, "terms": terms}


def lookup(terms: DataFrame, entries: DataFrame, q: str, stem_of=None, stem_column: str | None = None) -> DataFrame:
    """(entry_id, word, match_level, weight): entries found by a term, exact 3, by stem 2, by prefix 1; the best term of each."""
    q = q.lower().strip()
    stem = stem_of(q) if stem_of else ""
    by_stem = (F.col(stem_column) == stem) & F.lit(bool(stem)) if stem_column else F.lit(False)
    level = F.when(F.col("term") == q, 3).when(by_stem, 2).when(F.col("term").startswith(q), 1)
    found = terms.withColumn("match_level", level).where("match_level is not null")
    best = found.groupBy("entry_id").agg(F.max(F.struct("match_level", "weight")).alias("x")).select("entry_id", "x.match_level", "x.weight")
    return best.join(entries.select("entry_id", "word", "homonym"), "entry_id").orderBy(F.desc("match_level"), F.desc("weight"), "word", F.asc_nulls_first("homonym"), "entry_id")


def relations(forms: DataFrame, links: DataFrame, whole: str) -> DataFrame:
    """(form, lemma, features, entry_id): links (entry_id, source, form, lemma, features) of forms; a link of source `whole` holds for all forms of its entry, another one for its own form only. Of repeated ones the one with features stays."""
    j = forms.join(links.withColumnRenamed("form", "of"), "entry_id").where((F.col("source") == whole) | (F.col("of") == F.col("form")))
    n = F.row_number().over(W.partitionBy("form", "lemma").orderBy((F.size(F.coalesce("features", F.array().cast("array<string>"))) > 0).desc(), "entry_id", "of"))
    return j.withColumn("n", n).where("n = 1").select("form", "lemma", "features", "entry_id")


#: Grammar labels that show a part of speech, and labels that are stripped from a translation's beginning.
PARTS_OF_SPEECH = (("N", r"м\.|ж\.|ср\.|мн\."), ("ADJ", r"прил\."), ("V", r"гл\.|сов\.|несов\."), ("ADV", r"нареч\."), ("NUM", r"числит\."), ("PRON", "мест"))
LABELS = r"м\.|ж\.|ср\.|мн\.|прил\.|нареч\.|гл\.|сов\.|несов\.|мест\.?|числит\.|предл\.|союз|межд\.|част\.|вводн\.\s*сл\.|предлог|частица|нескл\.?"
#: Endings of a title that mark an edition.
EDITIONS = r"copy|final|draft|corrected|uncorrected|ocr|scan|scanned|clean|new|old|orig|original|edit|edited|ru|rus|russian|lak|eng|en|lat|latin|cyr|cyrillic|translit|transliteration|perevod|v[0-9]+|[0-9]{4}"


def part_of_speech(c: Column) -> Column:
    """By the first label of the list that begins a word; null without one. Word borders are those of Unicode."""
    low, out = F.lower(c), None
    for name, labels in PARTS_OF_SPEECH:
        here = low.rlike(rf"(^|[^\p{{L}}])({labels})")
        out = F.when(here, name) if out is None else out.when(here, name)
    return out


def without_labels(c: Column) -> Column:
    """The text without the grammar labels at its beginning, however many."""
    return F.regexp_replace(c, rf"(?iu)^(({LABELS})\s*,?\s*)+", "")


def editions(slug: Column) -> Column:
    """struct(normalized, base, root, markers) of a title's slug: edition endings are cut from the end, then a letter after the
    number, then the number for the root; markers name what was cut, the last first."""
    tail = F.regexp_extract(slug, rf"((?:-(?:{EDITIONS}))+)$", 1)
    cut = F.substring(slug, F.lit(1), F.length(slug) - F.length(tail))
    base = F.regexp_replace(cut, r"([0-9]+)[a-z]$", "$1")
    root = F.regexp_replace(base, r"[-_ ]?[0-9]+$", "")
    marks = F.reverse(F.filter(F.split(tail, "-"), lambda x: x != ""))
    letter = F.when(base != cut, F.array(F.lit("edition-letter"))).otherwise(F.array().cast("array<string>"))
    return F.struct(slug.alias("normalized"), base.alias("base"), F.when(root == "", base).otherwise(root).alias("root"), F.concat(marks, letter).alias("markers"))
