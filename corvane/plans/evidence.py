"""Queries: evidence ladder, gathering, export rows and evaluation runs; profiles of titles, marks and languages; workspace order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corvane.functions import text as X
from corvane.operators import evidence as E, lexicon as L, search as S
from corvane.plans.registry import query
from corvane.session import stage, table as t


def _gathered(spark, d):
    prompts = t(spark, d, "gold_set").select(F.col("prompt_ru").alias("query"))
    return prompts, stage(E.gathered(prompts, t(spark, d, "parallel_pairs")))


W_ = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
SAFE_SQL = """held as (select distinct answer from (select unnest([lower(trim(lak_text)), lower(trim(ru_text))]) as answer from parallel_pairs where split = 'test') where answer <> ''),
 safe as (select * from parallel_pairs p where split is distinct from 'test' and not exists (select 1 from held where answer = lower(trim(p.lak_text))) and not exists (select 1 from held where answer = lower(trim(p.ru_text))))"""
GATHERED_SQL = f"""with {SAFE_SQL},
 q as (select distinct lower(trim(prompt_ru)) as query, ' ' || array_to_string({W_.format("prompt_ru")}, ' ') || ' ' as phrase from gold_set where trim(prompt_ru) <> ''),
 l as (select distinct on (id) *, ' ' || array_to_string({W_.format("ru_text")}, ' ') || ' ' as line from safe order by id),
 m as (select query, id as pair_id, coalesce(source_type = 'archive', false) as ocr, coalesce(trim(ru_text) <> '' and trim(lak_text) <> '', false) as two, status, lower(trim(ru_text)) = query as exact from q join l on contains(line, phrase) where trim(phrase) <> ''),
 e as (select *, class <> 'usage_support_only' as can_propose, class = 'approved_parallel_pair' as gold, case class when 'approved_parallel_pair' then 12 when 'attested_public_example' then 8 when 'direct_dictionary' then 6 else 3 end as score
  from (select query, pair_id, ocr, case when two and status = 'approved' then 'approved_parallel_pair' when two and exact then 'direct_dictionary' when two then 'attested_public_example' else 'usage_support_only' end as class from m))"""


@query("B3_evidence_ladder", GATHERED_SQL + " select query, pair_id, class, can_propose, gold, ocr from e")
def b3(spark, d):
    return _gathered(spark, d)[1]


@query("B7_gathered_evidence", GATHERED_SQL + " select query, pair_id, class, rank from (select *, row_number() over (partition by query order by gold desc, can_propose desc, score desc, pair_id) as rank from e) where rank <= 25")
def b7(spark, d):
    """Reviewed memory first, then the rest by class; 25 a query."""
    return E.ordered(_gathered(spark, d)[1], 25, ocr_last=False).select("query", "pair_id", "class", "rank")


@query("L9_evidence_cards", GATHERED_SQL + " select query, pair_id, rank from (select *, row_number() over (partition by query order by gold desc, can_propose desc, ocr, score desc, pair_id) as rank from e) where rank <= 4")
def l9(spark, d):
    return E.ordered(_gathered(spark, d)[1], 4, ocr_last=True).select("query", "pair_id", "rank")


RUN_SQL = GATHERED_SQL + ", b as (select query, arg_max(class, score) as class, max(score) as score from e group by 1), r as (select q.query, coalesce(b.class, 'none') as class from (select distinct query from q) q left join b using (query))"


@query("B15_evaluation_run", RUN_SQL + " select 'retrieval_only' as config, count(*) as items, count(*) filter (where class <> 'none') as with_evidence, count(*) filter (where class = 'approved_parallel_pair') as with_gold, count(*) filter (where class in ('none', 'usage_support_only')) as abstained, case when count(*) = 0 then 0.0 else floor(count(*) filter (where class <> 'none') * 1.0::double / count(*) * 10000 + 0.5) / 10000 end as evidence_coverage from r")
def b15(spark, d):
    """One row for a run over all prompts; held-out items never come back as evidence. Rates of an empty run are 0."""
    r, n = E.run_classes(*_gathered(spark, d)), F.count("*")
    seen, gold, none = F.count_if(F.col("class") != "none"), F.count_if(F.col("class") == "approved_parallel_pair"), F.count_if(F.col("class").isin("none", "usage_support_only"))
    rate = F.when(n == 0, 0.0).otherwise(F.floor(seen / n * 10000 + 0.5) / 10000.0)
    return r.agg(F.lit("retrieval_only").alias("config"), n.alias("items"), seen.alias("with_evidence"), gold.alias("with_gold"), none.alias("abstained"), rate.alias("evidence_coverage"))


@query("A18_class_breakdown", RUN_SQL + " select class, count(*) as n from r group by 1")
def a18_classes(spark, d):
    return E.run_classes(*_gathered(spark, d)).groupBy("class").agg(F.count("*").alias("n"))


@query("B14_export_rows", f"with {SAFE_SQL} select id, direction, ru_text, lak_text, split from safe where status = 'approved'")
def b14(spark, d):
    """Approved pairs that repeat no held-out answer; which of them may be shown is a business rule and left out."""
    return E.isolated(t(spark, d, "parallel_pairs").where("status is not null")).where("status = 'approved'").select("id", "direction", "ru_text", "lak_text", "split")


@query("L11_workspace_order", "with n as (select document_id as id, sum(length(text_original)) as chars from segments group by 1), k as (select title, count(*) - 1 as same from corpus_documents group by 1) select id, bucket, relations from (select c.id, c.source_id, coalesce(c.title, '') as label, case when starts_with(coalesce(c.title, ''), '.') or regexp_matches(lower(coalesce(c.title, '')), '^(thumbs\\.db|desktop\\.ini)$') then 3 when coalesce(chars, 0) = 0 then 2 when coalesce(same, 0) = 0 then 1 else 0 end::int as bucket, coalesce(same, 0) as relations from corpus_documents c left join n using (id) left join k on k.title = c.title) order by bucket, relations desc, coalesce(source_id, ''), label, id limit 100")
def l11(spark, d):
    """The first page of 100: files of the system last, before them those without text and those without relations; binary order of names."""
    chars = t(spark, d, "segments").groupBy(F.col("document_id").alias("id")).agg(F.sum(F.length("text_original")).alias("chars"))
    docs = t(spark, d, "corpus_documents").select("id", "source_id", "title")
    same = docs.where("title is not null").groupBy("title").agg((F.count("*") - 1).alias("same"))
    label = F.coalesce("title", F.lit(""))
    bucket = F.when(label.startswith(".") | F.lower(label).rlike(r"^(thumbs\.db|desktop\.ini)$"), 3).when(F.coalesce("chars", F.lit(0)) == 0, 2).when(F.coalesce("same", F.lit(0)) == 0, 1).otherwise(0)
    rows = docs.join(chars, "id", "left").join(same, "title", "left").select("id", "source_id", label.alias("label"), bucket.alias("bucket"), F.coalesce("same", F.lit(0)).alias("relations"))
    return rows.orderBy("bucket", F.desc("relations"), F.coalesce("source_id", F.lit("")), "label", "id").limit(100).select("id", "bucket", "relations")


# ---- profiles


#: Marks of the language's spelling, one of them of mixed script, and frequent Russian words.
MARKERS = ("къ", "кь", "кӏ", "гъ", "гь", "гӏ", "хъ", "хь", "хӏ", "цӏ", "чӏ", "тӏ", "пӏ", "ссa", "сса", "ттт", "ӏ")
RUSSIAN = ("и", "в", "не", "на", "что", "с", "по", "как", "это", "для", "был", "была", "было", "от", "до", "же", "они", "она", "но", "я", "мы", "вы", "к", "у", "за", "из", "о", "при", "так", "все", "еще", "уже", "его", "ее", "их")
MARKS = (".", ",", ";", ":", "!", "?", "—", "«", "»", '"', "(", ")", "-")


def occurrences(c: Column, piece: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(piece)))) / len(piece)


def _each(sql: str, pieces) -> str:
    return " + ".join(f"(length({sql}) - length(replace({sql}, '{p}', ''))) // {len(p)}" for p in pieces)


@query("F19_language_ladder", f"with x as (select doc_id, lower(text) as t, greatest(length(text), 1) as n from documents where text is not null), r as (select doc_id, floor(({_each('t', MARKERS)}) * 1000.0::double / n * 10000 + 0.5) / 10000 as lak, floor(len(list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w in ({', '.join(repr(w) for w in RUSSIAN)}))) * 1000.0::double / n * 10000 + 0.5) / 10000 as ru from x) select doc_id, lak, ru, case when lak >= 1 and lak >= ru * 2 then 'lak' when ru >= 1 and ru > lak then 'russian' when lak > 0 and lak > ru then 'lak' when ru > 0 then 'russian' else 'undetermined' end as language from r")
def f19_ladder(spark, d):
    """Rates per 1000 characters of all markers (overlapping ones each count) and of frequent Russian words, and the language they speak for."""
    low = F.col("t")
    x = t(spark, d, "documents").where("text is not null").select("doc_id", F.lower("text").alias("t"), F.greatest(F.length("text"), F.lit(1)).alias("n"))
    hits = sum((occurrences(low, m) for m in MARKERS[1:]), occurrences(low, MARKERS[0]))
    words = F.size(F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w.isin(*RUSSIAN)))
    r = x.select("doc_id", X.half_up(hits * 1000.0 / F.col("n"), 4).alias("lak"), X.half_up(words * F.lit(1000.0) / F.col("n"), 4).alias("ru"))
    lak, ru = F.col("lak"), F.col("ru")
    language = F.when((lak >= 1) & (lak >= ru * 2), "lak").when((ru >= 1) & (ru > lak), "russian").when((lak > 0) & (lak > ru), "lak").when(ru > 0, "russian").otherwise("undetermined")
    return r.select("doc_id", "lak", "ru", language.alias("language"))


def mark_profile(c: Column) -> Column:
    """Shares of the thirteen marks among all of them, four digits; zeros where there are none."""
    counts = F.array(*[occurrences(c, m) for m in MARKS])
    return X.let(counts, lambda k: X.let(F.aggregate(k, F.lit(0.0), lambda s, v: s + v), lambda n: F.transform(k, lambda v: F.when(n > 0, F.floor(v / n * 10000 + 0.5) / 10000.0).otherwise(0.0))))


def mark_similarity(a: Column, b: Column) -> Column:
    """Cosine of two profiles, four digits; 0 where one has no marks."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    na, nb = dot(a, a), dot(b, b)
    return F.when((na > 0) & (nb > 0), X.half_up(dot(a, b) / (F.sqrt(na) * F.sqrt(nb)), 4)).otherwise(0.0)


_COUNTS = ", ".join(f"(length(text) - length(replace(text, '{m}', '')))::double" for m in MARKS)


@query("F20_mark_similarity", f"with c as (select doc_id, [{_COUNTS}] as k from documents where text is not null), p as (select doc_id, list_transform(k, lambda v: case when list_sum(k) > 0 then floor(v / list_sum(k) * 10000 + 0.5) / 10000 else 0.0::double end) as p from c), j as (select a.doc_id, a.p as x, b.p as y from p a join p b on b.doc_id = a.doc_id + 1) select doc_id, case when list_sum(x) > 0 and list_sum(y) > 0 then floor(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) * 10000 + 0.5) / 10000 else 0.0 end as similarity from j")
def f20_similarity(spark, d):
    """Cosine of the mark profiles of each document and the one with the next number."""
    p = t(spark, d, "documents").where("text is not null").select("doc_id", mark_profile(F.col("text")).alias("p"))
    j = p.withColumnRenamed("p", "x").join(p.select((F.col("doc_id") - 1).alias("doc_id"), F.col("p").alias("y")), "doc_id")
    return j.select("doc_id", mark_similarity(F.col("x"), F.col("y")).alias("similarity"))


@query("F14_source_paths", r"with p as (select id, list_filter(string_split(concat_ws('/', source_id, source_file), '/'), lambda x: x <> '') as parts from corpus_documents), f as (select id, coalesce(parts[-1], '') as file, parts[1:len(parts) - 1] as dirs from p) select id, file, lower(regexp_extract(file, '\.[^.]+$')) as ext, regexp_replace(file, '\.[^.]+$', '') as stem, array_to_string(dirs, '/') as folder, coalesce(dirs[-1], '') as folder_name from f")
def f14_paths(spark, d):
    """File, stem, ending, folder and the folder's name; an empty path has empty parts."""
    p = t(spark, d, "corpus_documents").select("id", F.filter(F.split(F.concat_ws("/", "source_id", "source_file"), "/"), lambda x: x != "").alias("parts"))
    f = p.select("id", F.coalesce(F.try_element_at("parts", F.lit(-1)), F.lit("")).alias("file"), F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0))).alias("dirs"))
    return f.select("id", "file", F.lower(F.regexp_extract("file", r"\.[^.]+$", 0)).alias("ext"), F.regexp_replace("file", r"\.[^.]+$", "").alias("stem"), F.array_join("dirs", "/").alias("folder"), F.coalesce(F.try_element_at("dirs", F.lit(-1)), F.lit("")).alias("folder_name"))


@query("F15_editions")
def f15_editions(spark, d):
    """(id, normalized, base, root, markers) of titles, see `lexicon.editions`."""
    return t(spark, d, "corpus_documents").where("title is not null").select("id", L.editions(X.slug("title")).alias("e")).select("id", "e.*")


@query("F28_form_profiles", f"with w as (select source, unnest({W_.format('text')}) as form from documents where source is not null), n as (select form, count(distinct source) as sources, count(*) as occurrences from w group by 1 having count(distinct source) >= 2), c as (select *, len(regexp_extract_all(form, '[؀-ۿ]')) as ar, len(regexp_extract_all(form, '[Ѐ-ӿ]')) as cy, len(regexp_extract_all(form, '[A-Za-z]')) as la from n where length(form) between 2 and 40 and regexp_full_match(form, '[\\p{{L}}]+')) select form, sources, occurrences, case when ar > cy and ar > la then 'arabic' when cy > 2 * la then 'cyrillic' when la > 2 * cy then 'latin' when cy > 0 or la > 0 then 'mixed' else 'unknown' end as script, case when sources >= 5 then 'high' when sources >= 3 then 'medium' else 'low' end as confidence, case when cy = 0 then 'none' when contains(form, 'ӏ') then 'palochka' when regexp_matches(form, 'къ|кь|гъ|гь|хъ|хь') then 'digraph' else 'plain' end as marker from c")
def f28_profiles(spark, d):
    """Publishable forms: letters only, 2 to 40, of two sources or more; their script, confidence by sources, and what their spelling shows."""
    f = S.word_forms(t(spark, d, "documents")).where(F.length("form").between(2, 40) & F.col("form").rlike(r"^\p{L}+$"))
    marker = F.when(~F.col("form").rlike(r"[\x{0400}-\x{04FF}]"), "none").when(F.contains("form", F.lit("ӏ")), "palochka").when(F.col("form").rlike("къ|кь|гъ|гь|хъ|хь"), "digraph").otherwise("plain")
    return f.select("form", "sources", "occurrences", "script", "confidence", marker.alias("marker"))


@query("A6_object_sets", "select source_id, string_agg(distinct coalesce(genre, '-') || ':' || coalesce(script, '-'), '|' order by coalesce(genre, '-') || ':' || coalesce(script, '-')) as objects from corpus_documents group by 1")
def a6_sets(spark, d):
    """The distinct objects themselves, in order; their number is bounded by the genres and scripts there are."""
    one = F.concat(F.coalesce("genre", F.lit("-")), F.lit(":"), F.coalesce("script", F.lit("-")))
    return t(spark, d, "corpus_documents").groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set(one)), "|").alias("objects"))


@query("E6_parts_of_speech", r"""select id, case when regexp_matches(x, '(^|[^\p{L}])(м\.|ж\.|ср\.|мн\.)') then 'N' when regexp_matches(x, '(^|[^\p{L}])прил\.') then 'ADJ' when regexp_matches(x, '(^|[^\p{L}])(гл\.|сов\.|несов\.)') then 'V' when regexp_matches(x, '(^|[^\p{L}])нареч\.') then 'ADV' when regexp_matches(x, '(^|[^\p{L}])числит\.') then 'NUM' when regexp_matches(x, '(^|[^\p{L}])мест') then 'PRON' end as pos,
 trim(regexp_replace(ru_text, '^((м\.|ж\.|ср\.|мн\.|прил\.|нареч\.|гл\.|сов\.|несов\.|мест\.?|числит\.|предл\.|союз|межд\.|част\.|вводн\.\s*сл\.|предлог|частица|нескл\.?)\s*,?\s*)+', '', 'i')) as rest from (select id, ru_text, lower(ru_text) as x from parallel_pairs where ru_text is not null)""")
def e6(spark, d):
    return t(spark, d, "parallel_pairs").where("ru_text is not null").select("id", L.part_of_speech(F.col("ru_text")).alias("pos"), F.trim(L.without_labels(F.col("ru_text"))).alias("rest"))
