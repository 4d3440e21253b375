"""Queries: source profiles, pair proposal, alignment, retrieval of evidence, decontamination by equal answers."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from corvane.functions import text as X
from corvane.operators import profiles as P, relational as R, search as S
from corvane.operators.shared import ranked, shared_words
from corvane.plans.registry import query
from corvane.session import ship, stage, table as t


def _profiles(spark, d):
    return P.profiles(t(spark, d, "segments").distinct(), "document_id", "text_original", ["ordinal", "id", "imported_at"])


@query("I1_profiles")
def i1(spark, d):
    ship(spark)
    p = _profiles(spark, d)
    return p.select("source", "units", "chars", "digest", "script", F.size("numbers").alias("numbers"), F.size("sketch").alias("hashes"))


def _batches(spark, d):
    return t(spark, d, "segments").where("document_id is not null and import_batch_id is not null").select("id", F.lit("batch").alias("kind"), F.concat_ws("|", "import_batch_id", "document_id").alias("key"))


@query("I2_bucket_pairs", "with k as (select distinct id, 'batch' as kind, import_batch_id || '|' || document_id as key from segments where document_id is not null and import_batch_id is not null), ok as (select key from k group by 1 having count(*) between 2 and 40) select a.id as \"left\", b.id as \"right\" from k a join k b using (key) join ok using (key) where a.id < b.id group by 1, 2")
def i2(spark, d):
    """Pairs of the buckets of 2 to 40 members; I2_bucket_members has the larger ones."""
    return P.bucket_pairs(_batches(spark, d), "id", "kind", "key").select("left", "right")


@query("I2_bucket_members", "with k as (select distinct id, import_batch_id || '|' || document_id as key from segments where document_id is not null and import_batch_id is not null and id is not null), big as (select key, min(id) as representative from k group by 1 having count(*) > 40) select key, id, representative from k join big using (key)")
def i2_members(spark, d):
    """The buckets of more than 40 members, a row a member, which stand for all their pairs."""
    return P.bucket_members(_batches(spark, d), "id", "kind", "key").select("key", F.col("item").alias("id"), "representative")


@query("I3_scored_pairs")
def i3(spark, d):
    """Every pair of every bucket is scored, however many documents share it."""
    ship(spark)
    p = stage(_profiles(spark, d))
    doc = t(spark, d, "corpus_documents").select(F.col("id").alias("source"), "source_id", "title")
    keys = p.select("source", F.lit("digest").alias("kind"), F.col("digest").alias("key"))
    keys = keys.unionByName(p.select("source", F.lit("band").alias("kind"), F.explode(P.bands(F.col("sketch"))).alias("key")))
    keys = keys.unionByName(doc.select("source", F.lit("title").alias("kind"), F.lower("title").alias("key"))).unionByName(doc.select("source", F.lit("folder").alias("kind"), F.col("source_id").alias("key")))
    return P.score_pairs(P.bucket_pairs(keys, "source", "kind", "key", most=None), p)


@query("I5_input_digest", "select sha256(string_agg(id || ':' || coalesce(content_hash, ''), chr(10) order by id)) as digest, count(*) as rows from corpus_documents")
def i5(spark, d):
    """One digest for a table of fixed size; for a growing one, digests per group are digested again."""
    rows = t(spark, d, "corpus_documents").select(F.struct("id", F.concat("id", F.lit(":"), F.coalesce("content_hash", F.lit(""))).alias("x")).alias("r"))
    all_ = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["x"]), "\n")
    return rows.agg(F.sha2(all_, 256).alias("digest"), F.count("*").alias("rows"))


@query("I7_corroborating_spellings", "with a as (select distinct unnest(list_filter(regexp_split_to_array(lower(lak_text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 4 and regexp_matches(x, '[Ѐ-ӿ]'))) as form from parallel_pairs), b as (select document_id, unnest(list_filter(regexp_split_to_array(lower(text_normalized), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 4)) as form from segments) select document_id, count(distinct a.form) as forms from a join b on a.form = b.form group by 1")
def i7(spark, d):
    w = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 4)
    a = t(spark, d, "parallel_pairs").select(F.explode(w("lak_text")).alias("form")).where(F.col("form").rlike(r"[\x{0400}-\x{04FF}]")).distinct()
    b = t(spark, d, "segments").select("document_id", F.explode(w("text_normalized")).alias("form")).distinct()
    return b.join(a, "form").groupBy("document_id").agg(F.count("*").alias("forms"))


@query("I8_families", "select id, case when contains(id, 'tales') then 'narrative' when contains(id, 'songs') then 'verse' when contains(id, 'grammar') or contains(id, 'wordlist') then 'reference' else 'other' end as family from corpus_sources")
def i8(spark, d):
    i = F.col("id")
    return t(spark, d, "corpus_sources").select("id", F.when(i.contains("tales"), "narrative").when(i.contains("songs"), "verse").when(i.contains("grammar") | i.contains("wordlist"), "reference").otherwise("other").alias("family"))


@query("F16_family_keys", "with p as (select id, string_split(concat_ws('/', source_id, source_file), '/') as parts, lower(concat_ws('/', source_id, source_file)) as path from corpus_documents), r as (select id, path, lower(parts[-2]) as folder, regexp_replace(lower(regexp_replace(parts[-1], '\\.[^.]*$', '')), '([-_ ]*([0-9]+[a-z]?|copy|final|draft|v[0-9]+))+$', '') as root from p) select id, case when length(root) >= 4 and root not in ('text', 'document', 'file', 'scan', 'page') then 'title:' || root when folder <> '' then 'folder:' || folder else 'path:' || path end as family from r")
def f16(spark, d):
    return t(spark, d, "corpus_documents").select("id", P.family(F.concat_ws("/", "source_id", "source_file")).alias("family"))


@query("U4_set_jaccard", "with w as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as k, lead(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) over (partition by source order by doc_id) as l from documents where text is not null) select doc_id, case when len(k) > 0 and len(l) > 0 then floor(len(list_intersect(k, l)) * 1.0::double / len(list_distinct(list_concat(k, l))) * 10000 + 0.5) / 10000 else 0.0 end as jaccard from w where l is not null")
def u4(spark, d):
    k = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    w = t(spark, d, "documents").where("text is not null").select("doc_id", "source", k.alias("k")).withColumn("l", F.lead("k").over(W.partitionBy("source").orderBy("doc_id")))
    return w.where("l is not null").select("doc_id", X.set_jaccard("k", "l").alias("jaccard"))


@query("G4_alignment")
def g4(spark, d):
    """Sentences of both sides of every pair, aligned by length; all of them, though the work is the product of the two numbers."""
    ship(spark)
    pairs = t(spark, d, "parallel_pairs").select("id", X.sentences("ru_text").alias("a"), X.sentences("lak_text").alias("b"))
    return P.align_pairs(pairs, "id", "a", "b")


@query("G6_alignment_tree")
def g6(spark, d):
    rows = g4(spark, d)
    kids = rows.where("level = 'unit'").groupBy("id", F.col("parent").alias("n")).agg(F.array_sort(F.collect_list(F.struct("n", "left", "right", "confidence"))).alias("units"))
    return rows.where("level = 'section'").join(kids, ["id", "n"], "left").select("id", "n", "confidence", F.size(F.coalesce("units", F.array().cast("array<struct<n:int,left:array<int>,right:array<int>,confidence:double>>"))).alias("units"))


@query("A21_cardinalities")
def a21(spark, d):
    shape = F.concat(F.size("left").cast("string"), F.lit(":"), F.size("right").cast("string"))
    return g4(spark, d).where("level = 'unit'").groupBy(shape.alias("cardinality")).agg(F.count("*").alias("n"))


# ---- evidence


PROMPT_SQL = "select id, list_filter(regexp_split_to_array(lower(prompt_ru), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as k from gold_set"


def retrieved(spark, d, pairs=None, **how):
    """Pairs whose Russian side shares words with a task's prompt, see `shared_words`; 3 for the whole prompt, 1 a word.

    pairs: (id, text, kind) where not all pairs are listed alike.
    """
    q = t(spark, d, "gold_set").select("id", F.col("prompt_ru").alias("text"))
    p = t(spark, d, "parallel_pairs").select("id", F.col("ru_text").alias("text"), F.lit(1).alias("kind")) if pairs is None else pairs
    return shared_words(q, p, whole=3, **how)


EVIDENCE_SQL = "with q as (select id as task_id, len(k) as n, unnest(k) as w from (select id, list_distinct(list_filter(regexp_split_to_array(lower(prompt_ru), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as k from gold_set)), p as (select id as pair_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(ru_text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) as w from parallel_pairs), e as (select task_id, pair_id, count(*) as hits, count(*) + case when count(*) = max(n) then 3 else 0 end as score from q join p using (w) group by 1, 2)"


@query("B1_evidence_retrieval", EVIDENCE_SQL + " select task_id, pair_id, hits, score, rank from (select *, row_number() over (partition by task_id order by score desc, pair_id) as rank from e) where rank <= 4")
def b1(spark, d):
    return ranked(retrieved(spark, d, most=4)).withColumnsRenamed({"query": "task_id", "id": "pair_id"})


@query("B8_evidence_classes", EVIDENCE_SQL + ", g as (select task_id, max(score) as best, count(*) as n from e group by 1) select id as task_id, coalesce(n, 0) as n, case when best is null then 'no_evidence' when best >= 5 then 'exact' when best >= 4 then 'supported' else 'usage' end as class, best is null or best < 4 as abstain from gold_set left join g on g.task_id = id")
def b8(spark, d):
    g = retrieved(spark, d).select(F.col("id").alias("task_id"), "best", "n")
    all_ = t(spark, d, "gold_set").select(F.col("id").alias("task_id")).join(g, "task_id", "left")
    b = F.col("best")
    return all_.select("task_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(b.isNull(), "no_evidence").when(b >= 5, "exact").when(b >= 4, "supported").otherwise("usage").alias("class"), (b.isNull() | (b < 4)).alias("abstain"))


@query("B5_held_out_answers", "with h as (select distinct lower(lak_text) as k from parallel_pairs where split = 'test' and lak_text <> '') select id from parallel_pairs p where split is distinct from 'test' and not exists (select 1 from h where k = lower(p.lak_text)) and not exists (select 1 from h where k = lower(p.ru_text))")
def b5(spark, d):
    p = t(spark, d, "parallel_pairs").select("id", "split", F.lower("lak_text").alias("a"), F.lower("ru_text").alias("b"))
    held = p.where("split = 'test' and a <> ''").select("a").distinct()
    rest = p.where(~F.col("split").eqNullSafe("test"))
    return rest.join(held, "a", "left_anti").join(held.withColumnRenamed("a", "b"), "b", "left_anti").select("id")


@query("B6_exact_memory", "select g.id as task_id, min(p.id) as pair_id from gold_set g join parallel_pairs p on lower(trim(p.lak_text)) = lower(trim(g.lak_text)) where p.status = 'approved' group by 1")
def b6(spark, d):
    g = t(spark, d, "gold_set").select(F.col("id").alias("task_id"), F.lower(F.trim("lak_text")).alias("k"))
    p = t(spark, d, "parallel_pairs").where("status = 'approved'").select(F.col("id").alias("pair_id"), F.lower(F.trim("lak_text")).alias("k"))
    return g.join(p, "k").groupBy("task_id").agg(F.min("pair_id").alias("pair_id"))


@query("J13_inverted_index", "with w as (select distinct doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as token from documents) select token, doc_id, n from (select token, doc_id, row_number() over (partition by token order by doc_id) as n from w) where n <= 12")
def j13(spark, d):
    w = t(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != ""))).alias("token"))
    return R.top_each(w, ["token"], [F.col("doc_id")], 12).select("token", "doc_id", F.col("rank").alias("n"))


@query("J18_alias_containment", "with a as (select distinct lower(lak_text) as form from gold_set where lak_text is not null and not regexp_matches(lak_text, '[^\\p{L}]')), w as (select distinct id, unnest(list_filter(regexp_split_to_array(lower(text_normalized), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as form from segments) select form, count(*) as segments from w join a using (form) group by 1")
def j18(spark, d):
    a = t(spark, d, "gold_set").where(F.col("lak_text").isNotNull() & ~F.col("lak_text").rlike(r"[^\p{L}]")).select(F.lower("lak_text").alias("form")).distinct()
    w = t(spark, d, "segments").select("id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text_normalized"), r"[^\p{L}\p{N}]+"), lambda x: x != ""))).alias("form")).distinct()
    return w.join(a, "form").groupBy("form").agg(F.count("*").alias("segments"))


@query("J18_alias_containment_whole", "with a as (select distinct lower(lak_text) as form, list_filter(regexp_split_to_array(lower(lak_text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from gold_set where lak_text is not null), l as (select distinct id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text_normalized), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' as line from segments where id is not null) select form, count(distinct id) as segments from a join l on contains(line, ' ' || array_to_string(w, ' ') || ' ') where len(w) > 0 group by 1")
def j18_whole(spark, d):
    """All aliases, also those of several words and those with hyphens or stops, by the segments that hold their words in a row."""
    a = t(spark, d, "gold_set").where("lak_text is not null").select(F.lower("lak_text").alias("form")).distinct()
    held = S.contained(a, t(spark, d, "segments").select("id", F.col("text_normalized").alias("text")))
    return held.groupBy("form").agg(F.count("*").alias("segments"))
