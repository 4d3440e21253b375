"""Queries: reading and writing files, dictionary synthesis, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import russian as RU
from corvane.operators import lexicon as L, relational as R
from corvane.plans.registry import query
from corvane.session import scratch, ship, stage, table as t
from corvane.sources import files as S
from corvane.streaming import ingest as I


@query("SC3_overlay", "select d.id, s.title as source_title from corpus_documents d left join corpus_sources s on s.id = d.source_id")
def sc3(spark, d):
    docs = t(spark, d, "corpus_documents").select("id", "source_id")
    held = docs.select("source_id").distinct()
    src = t(spark, d, "corpus_sources").select(F.col("id").alias("source_id"), F.col("title").alias("source_title")).join(held, "source_id", "left_semi")
    return S.overlay(docs, src, "source_id", ["source_title"]).select("id", "source_title")


@query("SC5_jsonl_round_trip", "select id, prompt_ru, lak_text, priority::bigint as priority, is_gold from gold_set")
def sc5(spark, d):
    path = scratch(spark)
    S.write_jsonl(t(spark, d, "gold_set").select("id", "prompt_ru", "lak_text", F.col("priority").cast("long").alias("priority"), "is_gold"), path)
    return S.read_jsonl(spark, path, "id string, prompt_ru string, lak_text string, priority long, is_gold boolean", ("id",))[0]


@query("SC6_gzip_round_trip", "select record_id, lak_cyrillic, license from pcmlbe_parallel where lak_cyrillic is not null")
def sc6(spark, d):
    path = scratch(spark)
    S.write_jsonl(t(spark, d, "pcmlbe_parallel").select("record_id", "lak_cyrillic", "license"), path, gz=True)
    return S.read_jsonl(spark, path, "record_id string, lak_cyrillic string, license string", ("record_id", "lak_cyrillic"))[0]


@query("SC7_ordered_scan", "select id, kind, priority from gold_set where kind = 'spelling' order by priority desc, id limit 20 offset 20")
def sc7(spark, d):
    return t(spark, d, "gold_set").where("kind = 'spelling'").select("id", "kind", "priority").orderBy(F.desc("priority"), "id").offset(20).limit(20)


@query("SK1_json_export", "select count(*) as lines from corpus_sources")
def sk1(spark, d):
    path = scratch(spark)
    t(spark, d, "corpus_sources").write.json(path)
    return spark.read.text(path).agg(F.count("*").alias("lines"))


@query("SK2_csv_lines", "select '\"' || id || '\",\"' || replace(coalesce(title, ''), '\"', '\"\"') || '\",\"' || replace(coalesce(author, ''), '\"', '\"\"') || '\"' as line from corpus_documents")
def sk2(spark, d):
    return S.csv_lines(t(spark, d, "corpus_documents").select("id", "title", "author"))


@query("SK3_jsonl_lines", "select to_json({'id': id, 'direction': direction, 'ru_text': ru_text, 'lak_text': lak_text, 'lineage': {'source_type': source_type, 'source_provenance': source_provenance}})::varchar as line from parallel_pairs")
def sk3(spark, d):
    p = t(spark, d, "parallel_pairs")
    return p.select(F.to_json(F.struct("id", "direction", "ru_text", "lak_text", F.struct("source_type", "source_provenance").alias("lineage")), {"ignoreNullFields": "false"}).alias("line"))


@query("SK4_tsv_lines", "select doc_id::varchar || chr(9) || regexp_replace(coalesce(text, ''), '[\\t\\r\\n]', ' ', 'g') as line from documents")
def sk4(spark, d):
    return S.tsv_lines(t(spark, d, "documents").select("doc_id", "text"))


@query("SK5_split_export", "select case split when 'dev' then 'validation' else split end as part, count(*) as n from parallel_pairs where split in ('train', 'dev', 'test') group by 1")
def sk5(spark, d):
    path = scratch(spark)
    S.by_split(t(spark, d, "parallel_pairs").select("id", "split", "ru_text", "lak_text"), "split", {"train": "train", "dev": "validation", "test": "test"}).write.partitionBy("part").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("part").cast("string").alias("part")).agg(F.count("*").alias("n"))


@query("SK6_artifacts", "select 'sources' as name, count(*) as rows from corpus_sources union all select 'documents', count(*) from corpus_documents")
def sk6(spark, d):
    m = S.write_artifacts({"sources": t(spark, d, "corpus_sources"), "documents": t(spark, d, "corpus_documents")}, scratch(spark))
    return m.select("name", "rows")


@query("SK8_resumable_ingest", "select count(*) as rows, count(distinct id) as ids from (select distinct id from segments)")
def sk8(spark, d):
    """A file stream taken in with a checkpoint; a second run finds nothing new."""
    path = scratch(spark)
    src = t(spark, d, "segments").select("id", "document_id", "text_original", "imported_at")
    src.repartition(4).write.parquet(f"{path}/in")
    for _ in range(2):
        I.ingest(I.stream(spark, f"{path}/in", src.schema, files=2), f"{path}/out", f"{path}/state", ["id"])
    return spark.read.parquet(f"{path}/out").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"))


@query("SK10_template", "select i as n, '' as ru_text, '' as lak_text from range(1, 501) r(i)")
def sk10(spark, d):
    return S.template(spark, 500, ["ru_text", "lak_text"])


@query("ST1_windowed_counts", "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n from events group by 1, 2")
def st1(spark, d):
    """Tumbling windows over the event stream; the watermark lets all late rows of this replay in, and a last row far ahead closes every window."""
    path = scratch(spark)
    e = t(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.write.parquet(f"{path}/in")
    e.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).select("ts", F.lit("end").alias("event_type")).write.parquet(f"{path}/end")
    out = None
    for part in ("in", "end"):  # the second run closes the windows of the first
        s = I.windowed_counts(I.stream(spark, f"{path}/{{in,end}}" if part == "end" else f"{path}/in*", e.schema), "ts", "event_type", "1 hour", late="100 days")
        out = I.run_to_table(s, f"{path}/out", f"{path}/state")
    return out.where("event_type <> 'end'").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


# ---- dictionary


def lexicon(spark, d):
    """Dictionary rows from the parallel pairs: the first Lak word, the Russian text as gloss, the other Lak words as forms."""
    p, w = t(spark, d, "parallel_pairs").where("lak_text <> ''"), F.split("lak_text", " ")
    return L.synthesize(p.select(F.col("source_type").alias("source_id"), F.col("id").alias("ref"), F.element_at(w, 1).alias("headword"), F.col("ru_text").alias("gloss"), F.array_join(F.slice(w, 2, F.size(w)), ", ").alias("forms")))


@query("E2_entries")
def e2(spark, d):
    ship(spark)
    return lexicon(spark, d)["entries"]


@query("E3_gloss_terms", "select id, w as term from (select id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(ru_text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3 and x not in ('и','в','на','с','к','по','из','от','для','что','как','это','или','не','the','and','of','to','a','in')))) as w from parallel_pairs)")
def e3(spark, d):
    return t(spark, d, "parallel_pairs").select("id", F.explode(L.gloss_words(F.col("ru_text"))).alias("term"))


@query("E4_senses", "select id, x as candidate from (select id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(ru_text, '[.;,0-9]+'), lambda v: lower(trim(v))), lambda v: v <> '' and length(v) <= 80 and not contains(v, ' ')))) as x from parallel_pairs where ru_text is not null and not regexp_matches(ru_text, '[()\\[\\]]|\\s[-–—]\\s'))")
def e4(spark, d):
    p = t(spark, d, "parallel_pairs").where(F.col("ru_text").isNotNull() & ~F.col("ru_text").rlike(r"[()\[\]]|\s[-–—]\s"))
    return p.select("id", F.explode(L.gloss_candidates(F.col("ru_text"))).alias("candidate"))


@query("E4_sense_candidates", "with s as (select id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(ru_text, ''), '(?:^|\\s)[0-9]+[.)]\\s*'), lambda x: trim(x)), lambda x: x <> '')) as sense from parallel_pairs), h as (select id, regexp_split_to_array(regexp_replace(sense, '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'), '\\s[-–—]\\s')[1] as head from s) select distinct id, unnest(list_filter(list_transform(regexp_split_to_array(head, '[.;,0-9]+'), lambda v: lower(trim(v))), lambda v: v <> '' and length(v) <= 80 and not contains(v, ' '))) as candidate from h")
def e4_whole(spark, d):
    """Candidates of every sense of all glosses: numbered marks part senses, labels in brackets and what follows a dash are dropped."""
    p = t(spark, d, "parallel_pairs").select("id", F.explode(L.sense_parts(F.col("ru_text"))).alias("sense"))
    return p.select("id", F.explode(L.gloss_candidates(F.col("sense"))).alias("candidate")).distinct()


@query("E7_terms")
def e7(spark, d):
    ship(spark)
    return lexicon(spark, d)["terms"].groupBy("weight").agg(F.count("*").alias("n"))


@query("E12_conflicting_hashes", "select id, count(distinct content_hash) as hashes from segments group by 1 having count(distinct content_hash) > 1")
def e12(spark, d):
    return t(spark, d, "segments").groupBy("id").agg(F.countDistinct("content_hash").alias("hashes")).where("hashes > 1")


@query("E9_bundle_rules", "select id as row_key, rule from (select id, unnest([case when coalesce(regexp_full_match(content_hash, '[0-9a-f]{40}'), false) then null else 'digest' end, case when document_id is not null then null else 'document' end, case when coalesce(ordinal >= 0, false) then null else 'ordinal' end]) as rule from segments) where rule is not null")
def e9(spark, d):
    rules = {"digest": F.col("content_hash").rlike("^[0-9a-f]{40}$"), "document": F.col("document_id").isNotNull(), "ordinal": F.col("ordinal") >= 0}
    return R.violations(t(spark, d, "segments"), "id", rules)


@query("E11_referential", "select 'pair' as kind, pair_id as row_key, count(*) as n from pair_adjudications where not exists (select 1 from parallel_pairs p where p.id = pair_id) group by 2 union all select 'task', task_id, count(*) from validation_votes where not exists (select 1 from gold_set g where g.id = task_id) group by 2")
def e11(spark, d):
    out = []
    for kind, child, key, parent in (("pair", "pair_adjudications", "pair_id", "parallel_pairs"), ("task", "validation_votes", "task_id", "gold_set")):
        lost = t(spark, d, child).join(t(spark, d, parent).select(F.col("id").alias(key)), key, "left_anti")
        out.append(lost.groupBy(F.col(key).alias("row_key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "row_key", "n"))
    return out[0].unionByName(out[1])


@query("E14_published_counts", "with w as (select source, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as form from documents where source is not null), p as (select distinct source, form from w), ok as (select form from p group by 1 having count(*) >= 2) select s.id, coalesce(n, 0) as forms from corpus_sources s left join (select source, count(*) as n from p join ok using (form) group by 1) c on c.source = s.id")
def e14(spark, d):
    w = t(spark, d, "documents").where("source is not null").select("source", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")).alias("form")).distinct()
    ok = w.groupBy("form").agg(F.count("*").alias("k")).where("k >= 2").select("form")
    n = w.join(ok, "form").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("forms"))
    return t(spark, d, "corpus_sources").select("id").join(n, "id", "left").select("id", F.coalesce("forms", F.lit(0)).alias("forms"))


@query("Q6_dictionary_search")
def q6(spark, d):
    ship(spark)
    lex = lexicon(spark, d)
    terms = stage(lex["terms"].withColumn("stem", RU.stem_key("term")))
    return L.lookup(terms, lex["entries"], "кувшином", RU.key_of, "stem")


@query("B13_import_validation", "select id as row_key, rule from (select id, unnest([case when coalesce(ru_text <> '', false) then null else 'ru_text' end, case when coalesce(lak_text <> '', false) then null else 'lak_text' end, case when coalesce(direction in ('ru2lak', 'lak2ru'), false) then null else 'direction' end, case when coalesce(split in ('train', 'dev', 'test'), false) then null else 'split' end]) as rule from parallel_pairs) where rule is not null")
def b13(spark, d):
    rules = {"ru_text": F.col("ru_text") != "", "lak_text": F.col("lak_text") != "", "direction": F.col("direction").isin("ru2lak", "lak2ru"), "split": F.col("split").isin("train", "dev", "test")}
    return R.violations(t(spark, d, "parallel_pairs"), "id", rules)
