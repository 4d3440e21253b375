"""Queries: dictionary and catalogue joins, orders, snippets, evidence bundles and retrieval composed of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from corvane.functions import text as X
from corvane.operators import lexicon as L, profiles as P, relational as R, search as S
from corvane.operators.shared import ranked, shared_words
from corvane.plans.exchange import lexicon
from corvane.plans.intelligence import EVIDENCE_SQL, retrieved
from corvane.plans.registry import query
from corvane.plans.texts import records
from corvane.session import scratch, table as t
from corvane.sources import files

PUBLIC = "coalesce(s.public_search_allowed and s.access_status = 'public' and s.rights_status in ('open_license','public_domain','permission_recorded'), false)"
WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _words(c: str):
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


@query("SC2_embedded_literals", "select id, title as name from corpus_sources")
def sc2(spark, d):
    """Titles written into the scripts of pages and read out of them again."""
    s = t(spark, d, "corpus_sources")
    page = F.concat(F.lit("<html><script>var STATS = {\"n\": 1}; const DATA = "), F.to_json(F.struct("id", F.col("title").alias("name")), {"ignoreNullFields": "false"}), F.lit(";</script></html>"))
    return s.select(F.from_json(files.embedded_json(page, "DATA"), "id string, name string").alias("r")).select("r.*")


@query("SC4_file_digests", "select 3::bigint as files, true as right_length")
def sc4(spark, d):
    path = scratch(spark)
    t(spark, d, "corpus_sources").repartition(3).write.json(path)
    return files.file_digests(spark, f"{path}/*.json").agg(F.count("*").alias("files"), F.bool_and((F.length("sha256") == 64) & (F.col("bytes") > 0)).alias("right_length"))


@query("J2_term_join", f"with w as (select id as entry_id, source_id, unnest(list_distinct({WORDS.format('title')})) as term from corpus_documents), l as (select document_id as entry_id, count(distinct f) as forms from (select document_id, unnest({WORDS.format('text_normalized')}) as f from segments) group by 1), n as (select document_id as entry_id, string_agg(distinct section, '|' order by section) as sections from segments group by 1) select term, entry_id, source_id, title as source_title, coalesce(forms, 0) as forms, coalesce(sections, '') as sections from w join corpus_sources s on s.id = w.source_id left join l using (entry_id) left join n using (entry_id)")
def j2(spark, d):
    """Search terms (of titles) to their entries and those to their sources; what an entry fans out to is aggregated on each side first."""
    w = t(spark, d, "corpus_documents").select(F.col("id").alias("entry_id"), "source_id", F.explode(F.array_distinct(_words("title"))).alias("term"))
    seg = t(spark, d, "segments").where("document_id is not null").withColumnRenamed("document_id", "entry_id")
    forms = seg.select("entry_id", F.explode(_words("text_normalized")).alias("f")).distinct().groupBy("entry_id").agg(F.count("*").alias("forms"))
    sections = seg.groupBy("entry_id").agg(F.array_join(F.array_sort(F.collect_set("section")), "|").alias("sections"))
    sources = t(spark, d, "corpus_sources").select(F.col("id").alias("source_id"), F.col("title").alias("source_title"))
    found = w.join(sources, "source_id").join(forms, "entry_id", "left").join(sections, "entry_id", "left")
    return found.select("term", "entry_id", "source_id", "source_title", F.coalesce("forms", F.lit(0)).alias("forms"), F.coalesce("sections", F.lit("")).alias("sections"))


@query("J2_dictionary_terms")
def j2_whole(spark, d):
    """All search terms with their entry, its source, and the entry's senses and forms, each aggregated before the join.

    An entry whose source isn't among corpus_sources has no title; one without senses has an empty list.
    """
    lex = lexicon(spark, d)
    source = t(spark, d, "corpus_sources").select(F.col("id").alias("source_id"), F.col("title").alias("source_title"))
    senses = lex["senses"].groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "sense"))), lambda x: x["sense"]).alias("senses"))
    forms = lex["forms"].groupBy("entry_id").agg(F.array_sort(F.collect_set("form")).alias("forms"))
    entries = lex["entries"].select("entry_id", "source_id", "word").join(source, "source_id", "left").join(senses, "entry_id", "left").join(forms, "entry_id", "left")
    none = F.array().cast("array<string>")
    return lex["terms"].join(entries, "entry_id").select("term", "weight", "entry_id", "word", "source_id", "source_title", F.coalesce("senses", none).alias("senses"), F.coalesce("forms", none).alias("forms"))


@query("J14_votes_with_weights", "with w as (select contributor_id, 0.3 + least(1.0::double, count(*) / 100.0::double) as weight from validation_votes where not flagged_spam group by 1) select v.task_id, count(*) as votes, floor(sum(w.weight) * 100 + 0.5) / 100 as weight from validation_votes v join w using (contributor_id) where not v.flagged_spam group by 1")
def j14(spark, d):
    v = t(spark, d, "validation_votes").where(~F.col("flagged_spam"))
    w = v.groupBy("contributor_id").agg((F.lit(0.3) + F.least(F.lit(1.0), F.count("*") / 100.0)).alias("weight"))
    return v.join(w, "contributor_id").groupBy("task_id").agg(F.count("*").alias("votes"), X.half_up(F.sum("weight"), 2).alias("weight"))


@query("J15_left_conditional", "select s.id, count(d.doc_id) as docs, coalesce(sum(case when d.lang = 'lbe' then d.n_chars else 0 end), 0)::bigint as lak_chars from corpus_sources s left join documents d on d.source = s.id group by 1")
def j15(spark, d):
    n = t(spark, d, "documents").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("docs"), F.sum(F.when(F.col("lang") == "lbe", F.col("n_chars")).otherwise(0)).alias("lak_chars"))
    return t(spark, d, "corpus_sources").select("id").join(n, "id", "left").select("id", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("lak_chars", F.lit(0)).alias("lak_chars"))


@query("L1_search_order", "with x as (select doc_id, case when coalesce(source = 'doma-reader', false) then 1 else 0 end as late from documents where contains(lower(translate(lower(coalesce(text, '')), 'ёiіӏ', 'еӀӀӀ')), 'вечер')) select doc_id from x order by late, doc_id limit 40")
def l1(spark, d):
    r = records(spark, d).where(X.field_tier("text", "вечер", ["вечер"], nfkc=False) >= 0)
    late = F.coalesce((F.col("source") == "doma-reader").cast("int"), F.lit(0))
    return r.orderBy(late, "pos").limit(40).select(F.col("pos").alias("doc_id"))


@query("L3_unclamped_page", "select id from gold_set order by id limit 25 offset 1000000")
def l3(spark, d):
    return R.page(t(spark, d, "gold_set").select("id"), [F.col("id")], 40_001, 25, clamp=False)


@query("L7_dictionary_order", "select id, split_part(lak_text, ' ', 1) as word from parallel_pairs where lak_text <> '' order by (lower(split_part(lak_text, ' ', 1)) = 'бувну') desc, head_version desc, word, id limit 60")
def l7(spark, d):
    w = t(spark, d, "parallel_pairs").where("lak_text <> ''").withColumn("word", F.element_at(F.split("lak_text", " "), 1))
    return w.orderBy((F.lower("word") == "бувну").desc(), F.desc("head_version"), "word", "id").limit(60).select("id", "word")


@query("L8_evidence_order", EVIDENCE_SQL + ", r as (select e.*, p.provenance = 'human' as human, row_number() over (partition by task_id order by coalesce(p.provenance = 'human', false) desc, score desc, pair_id) as place from e join parallel_pairs p on p.id = e.pair_id) select task_id, pair_id, place from r where place <= 3")
def l8(spark, d):
    """Pairs of human origin first; a pair with repeated rows is listed for each."""
    kind = F.when(F.col("provenance") == "human", 1).otherwise(2)
    p = t(spark, d, "parallel_pairs").where("id is not null").select("id", F.col("ru_text").alias("text"), kind.alias("kind"))
    return ranked(retrieved(spark, d, p, most=3, each=True)).select(F.col("query").alias("task_id"), F.col("id").alias("pair_id"), F.col("rank").alias("place"))


@query("F5_record_tier")
def f5(spark, d):
    return records(spark, d).select("pos", X.record_tier(list(S.TEXT_FIELDS), "вечер", ["вечер"]).alias("tier")).where("tier >= 0")


@query("F22_sketch_jaccard", f"with w as (select doc_id, source, {WORDS.format('text')} as k from documents where text is not null), s as (select doc_id, source, list_distinct(list_transform(range(1, len(k) - 3), lambda i: ('0x' || substr(sha1(array_to_string(k[i:i+4], ' ')), 1, 8))::bigint)) as h from w where len(k) >= 5), b as (select doc_id, source, list_slice(list_sort(h), 1, 512) as h from s), p as (select doc_id, h, lead(h) over (partition by source order by doc_id) as g from b), u as (select doc_id, h, g, list_slice(list_sort(list_distinct(list_concat(h, g))), 1, 512) as l from p where g is not null) select doc_id, floor(len(list_intersect(l, list_intersect(h, g))) * 1.0::double / len(l) * 10000 + 0.5) / 10000 as jaccard from u")
def f22(spark, d):
    s = t(spark, d, "documents").where("text is not null").select("doc_id", "source", X.shingle_sketch(_words("text")).alias("h")).where(F.size("h") > 0)
    p = s.withColumn("g", F.lead("h").over(W.partitionBy("source").orderBy("doc_id"))).where("g is not null")
    return p.select("doc_id", X.sketch_jaccard("h", "g").alias("jaccard"))


@query("F28_publishable_forms", "with w as (select source, unnest(" + WORDS.format("text") + ") as form from documents where source is not null), n as (select form, count(distinct source) as sources from w group by 1 having count(distinct source) >= 2) select form, sources from n where length(form) between 2 and 40 and regexp_full_match(form, '[\\p{L}]+')")
def f28(spark, d):
    return S.word_forms(t(spark, d, "documents")).where(F.length("form").between(2, 40) & F.col("form").rlike(r"^\p{L}+$")).select("form", "sources")


@query("F32_snippet_quality")
def f32(spark, d):
    c = S.concordance(t(spark, d, "documents"), "doc_id", "text", "вечер")
    return c.select("doc_id", "n", S.snippet_quality(F.col("snippet"), "вечер").alias("quality"))


@query("F33_page_locators", "select id, source_provenance, try_cast(nullif(regexp_extract(source_provenance, '; *(?:p|с)\\. *([0-9]+)', 1), '') as bigint) as page from parallel_pairs where source_provenance is not null")
def f33(spark, d):
    n = F.nullif(F.regexp_extract("source_provenance", r"; *(?:p|с)\. *([0-9]+)", 1), F.lit(""))
    return t(spark, d, "parallel_pairs").where("source_provenance is not null").select("id", "source_provenance", F.try_to_number(n, F.lit("999999999")).cast("long").alias("page"))


@query("E5_headwords", r"select id, trim(regexp_replace(title, '\s*(?:[0-9]+|\(?[IVX]+\)?)\s*$', '')) as word, coalesce(case when length(regexp_extract(title, '([0-9]+)\s*$', 1)) between 1 and 3 then regexp_extract(title, '([0-9]+)\s*$', 1)::int end, nullif(list_position(['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X'], regexp_extract(title, '\(?([IVX]+)\)?\s*$', 1)), 0)) as homonym from corpus_documents where title is not null")
def e5(spark, d):
    word, number = L.headword(F.col("title"))
    return t(spark, d, "corpus_documents").where("title is not null").select("id", word.alias("word"), number.alias("homonym"))


@query("E8_form_relations", "with p as (select id as entry_id, source_type as source, string_split(lower(lak_text), ' ') as w from parallel_pairs where lak_text <> ''), f as (select distinct entry_id, unnest(w) as form from p) select form, w[1] as lemma, min(entry_id) as entry_id from f join p using (entry_id) where source = 'lesson' or w[1] = form group by 1, 2")
def e8(spark, d):
    """Forms of pairs related to the headword of their pair; a source type's whole paradigm counts for lessons only."""
    p = t(spark, d, "parallel_pairs").where("lak_text <> ''").select(F.col("id").alias("entry_id"), F.col("source_type").alias("source"), F.split(F.lower("lak_text"), " ").alias("w"))
    forms = p.select("entry_id", F.explode("w").alias("form"))
    links = p.select("entry_id", "source", F.col("w")[0].alias("form"), F.col("w")[0].alias("lemma"), F.array("source").alias("features"))
    return L.relations(forms.distinct(), links, "lesson").select("form", "lemma", "entry_id")


@query("E10_task_examples", f"with w as (select distinct g.id, unnest({WORDS.format('g.text_normalized')}) as form from segments g), q as (select id as task_id, lower(lak_text) as form, priority from gold_set where lak_text <> ''), m as (select task_id, w.id, row_number() over (partition by task_id order by w.id) as n, count(*) over (partition by task_id) as total, priority from q join w using (form)) select task_id, array_to_string(list(id order by id), '|') as examples, max(least(100, greatest(1, floor(priority * 6 + log10(total + 1) * 10 + 0.5)))::bigint) as score from m where n <= 3 group by 1")
def e10(spark, d):
    w = t(spark, d, "segments").select("id", F.explode(F.array_distinct(_words("text_normalized"))).alias("form")).distinct()
    q = t(spark, d, "gold_set").where("lak_text <> ''").select(F.col("id").alias("task_id"), F.lower("lak_text").alias("form"), "priority")
    return _task_examples(q.join(w, "form"))


@query("E10_task_examples_whole", f"with l as (select distinct id, ' ' || array_to_string({WORDS.format('text_normalized')}, ' ') || ' ' as line from segments where id is not null), q as (select id as task_id, {WORDS.format('lak_text')} as w, priority from gold_set where lak_text <> ''), f as (select distinct task_id, priority, id from q join l on contains(line, ' ' || array_to_string(w, ' ') || ' ') where len(w) > 0), m as (select *, row_number() over (partition by task_id order by id) as n, count(*) over (partition by task_id) as total from f) select task_id, array_to_string(list(id order by id), '|') as examples, max(least(100, greatest(1, floor(priority * 6 + log10(total + 1) * 10 + 0.5)))::bigint) as score from m where n <= 3 group by 1")
def e10_whole(spark, d):
    """Examples also of the tasks whose text is of several words: segments that hold those words in a row."""
    q = t(spark, d, "gold_set").where("lak_text <> ''").select(F.col("id").alias("task_id"), F.lower("lak_text").alias("form"), "priority")
    held = S.contained(q.select("form"), t(spark, d, "segments").select("id", F.col("text_normalized").alias("text")))
    return _task_examples(q.join(held, "form"))


def _task_examples(m):
    """Three examples and the score of each task of `m` (task_id, id, priority)."""
    n = m.groupBy("task_id").agg(F.count("*").alias("total"))
    top = R.top_each(m, ["task_id"], [F.col("id")], 3).join(n, "task_id")
    score = F.least(F.lit(100), F.greatest(F.lit(1), F.floor(F.max("priority") * 6 + F.log10(F.max("total") + 1) * 10 + 0.5)))
    return top.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_list("id")), "|").alias("examples"), score.cast("long").alias("score"))


@query("E13_catalogue_projection", "select id, lower(concat_ws(' ', title, creator_credit, rights_status)) as search_text, access_status = 'public' as open from corpus_sources")
def e13(spark, d):
    return t(spark, d, "corpus_sources").select("id", F.lower(F.concat_ws(" ", "title", "creator_credit", "rights_status")).alias("search_text"), (F.col("access_status") == "public").alias("open"))


@query("Q10_form_occurrences", f"with w as (select g.id, g.document_id, unnest({WORDS.format('g.text_normalized')}) as form from segments g) select form, count(*) as occurrences, count(distinct document_id) as documents from w where form in ('бувну', 'ва', 'ца', 'хъинну') group by 1")
def q10(spark, d):
    w = t(spark, d, "segments").select("document_id", F.explode(_words("text_normalized")).alias("form")).where(F.col("form").isin("бувну", "ва", "ца", "хъинну"))
    return w.groupBy("form").agg(F.count("*").alias("occurrences"), F.countDistinct("document_id").alias("documents"))


@query("Q12_queue_with_contexts", "with v as (select task_id, value, created_at, id, row_number() over (partition by task_id order by created_at desc, id desc, value, loaded_at) as n from (select distinct task_id, value, created_at, id, loaded_at from validation_votes)), q as (select id, priority, kind from gold_set) select q.id, q.priority, v.n, v.value from q join v on v.task_id = q.id where v.n <= 10")
def q12(spark, d):
    v = t(spark, d, "validation_votes").select("task_id", "value", "created_at", "id", "loaded_at").distinct()
    top = R.top_each(v, ["task_id"], [F.desc("created_at"), F.desc("id"), F.asc_nulls_last("value"), F.col("loaded_at")], 10)
    q = t(spark, d, "gold_set").select(F.col("id").alias("task_id"), "priority")
    return top.join(q, "task_id").select(F.col("task_id").alias("id"), "priority", F.col("rank").alias("n"), "value")


@query("Q15_evidence_bundles", EVIDENCE_SQL + ", h as (select distinct lower(lak_text) as k from parallel_pairs where split = 'test' and lak_text <> ''), o as (select e.* from e join parallel_pairs p on p.id = e.pair_id where not exists (select 1 from h where k = lower(p.lak_text))), r as (select *, row_number() over (partition by task_id order by score desc, pair_id) as n from o) select task_id, count(*) as shown, max(score) as best, case when max(score) >= 5 then 'high' when max(score) >= 4 then 'medium' else 'low' end as confidence from r where n <= 4 group by 1")
def q15(spark, d):
    """Evidence of a task without held-out answers, the four best, and how sure they make it."""
    p = t(spark, d, "parallel_pairs").where("id is not null").select("id", F.col("ru_text").alias("text"), "split", F.lower("lak_text").alias("k"))
    held = p.where("split = 'test' and k <> ''").select("k", F.lit(0).alias("held")).distinct()
    open_ = p.join(held, "k", "left").select("id", "text", F.coalesce("held", F.lit(1)).alias("kind"))
    best = F.col("top")[0]["score"]
    top = retrieved(spark, d, open_, most=4, each=True).where(F.size("top") > 0)
    return top.select(F.col("id").alias("task_id"), F.size("top").cast("long").alias("shown"), best.alias("best"), F.when(best >= 5, "high").when(best >= 4, "medium").otherwise("low").alias("confidence"))


@query("Q16_contributor_overview", "select contributor_id, count(*) as votes, count(distinct task_id) as tasks, count(distinct created_at::date) as days, floor(avg(time_to_vote_ms) + 0.5)::bigint as mean_ms from validation_votes group by 1")
def q16(spark, d):
    return t(spark, d, "validation_votes").groupBy("contributor_id").agg(F.count("*").alias("votes"), F.countDistinct("task_id").alias("tasks"), F.countDistinct(F.to_date("created_at")).alias("days"), F.floor(F.avg("time_to_vote_ms") + 0.5).alias("mean_ms"))


@query("B2_reverse_retrieval", f"with q as (select id as task_id, unnest(list_distinct({WORDS.format('lak_text')})) as w from gold_set), p as (select id as pair_id, unnest(list_distinct({WORDS.format('lak_text')})) as w from parallel_pairs), e as (select task_id, pair_id, count(*) as hits from q join p using (w) group by 1, 2) select task_id, pair_id, hits, n from (select *, row_number() over (partition by task_id order by hits desc, pair_id) as n from e) where n <= 4")
def b2(spark, d):
    q = t(spark, d, "gold_set").select("id", F.col("lak_text").alias("text"))
    p = t(spark, d, "parallel_pairs").select("id", F.col("lak_text").alias("text"), F.lit(1).alias("kind"))
    return ranked(shared_words(q, p, most=4)).select(F.col("query").alias("task_id"), F.col("id").alias("pair_id"), "hits", F.col("rank").alias("n"))


@query("B4_evidence_isolation", "with h as (select distinct lower(trim(x)) as k from (select lak_text as x from parallel_pairs where split = 'test' union all select ru_text from parallel_pairs where split = 'test') where x <> '') select id from segments where text_original is not null and not exists (select 1 from h where k = lower(trim(text_original)))")
def b4(spark, d):
    p = t(spark, d, "parallel_pairs").where("split = 'test'").select(F.explode(F.array("lak_text", "ru_text")).alias("x")).where("x <> ''").select(F.lower(F.trim("x")).alias("k")).distinct()
    return t(spark, d, "segments").where("text_original is not null").select("id", F.lower(F.trim("text_original")).alias("k")).join(p, "k", "left_anti").select("id")


@query("B9_coverage", EVIDENCE_SQL + " select id as task_id, count(e.pair_id) as evidence, count(e.pair_id) filter (where score >= 4) as strong, min(e.pair_id) filter (where score >= 4) as suggested from gold_set left join e on e.task_id = id group by 1")
def b9(spark, d):
    p = t(spark, d, "parallel_pairs").where("id is not null").select("id", F.col("ru_text").alias("text"), F.lit(1).alias("kind"))
    e = retrieved(spark, d, p).select(F.col("id").alias("task_id"), F.col("n").alias("evidence"), "strong", F.col("first").alias("suggested"))
    tasks = t(spark, d, "gold_set").groupBy(F.col("id").alias("task_id")).agg(F.count("*").alias("rows"))
    times = lambda c: F.coalesce(F.col(c) * F.col("rows"), F.lit(0)).alias(c)
    return tasks.join(e, "task_id", "left").select("task_id", times("evidence"), times("strong"), "suggested")


@query("B12_queue_counts", "select p.id, count(a.id) as rows, count(distinct a.adjudicator_id) as people, count(*) filter (where a.decision = 'reject') as rejected from parallel_pairs p left join pair_adjudications a on a.pair_id = p.id group by 1")
def b12(spark, d):
    a = t(spark, d, "pair_adjudications").groupBy(F.col("pair_id").alias("id")).agg(F.count("*").alias("rows"), F.countDistinct("adjudicator_id").alias("people"), F.count_if(F.col("decision") == "reject").alias("rejected"))
    j = t(spark, d, "parallel_pairs").select("id").join(a, "id", "left")
    return j.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "people", "rejected")])


@query("G1_sections", "with l as (select doc_id, string_split(regexp_replace(text, '\\r', '', 'g'), chr(10)) as x from documents where text is not null), u as (select doc_id, generate_subscripts(x, 1) as n, unnest(x) as line from l), h as (select doc_id, n, trim(line) <> '' and length(trim(line)) <= 90 and not regexp_matches(trim(line), '[.!?…]$') as head from u) select doc_id, count(*) as units, count(*) filter (where head) as heads, case when count(*) filter (where head) >= 2 then count(*) filter (where head) + (case when bool_or(head and n = 1) then 0 else 1 end) else (count(*) + 9) // 10 end::bigint as sections from h group by 1")
def g1(spark, d):
    """Sections of every document: from heading to heading where there are two at least, else runs of ten lines."""
    lines = t(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\\r", ""), "\\n")).alias("n", "line"))
    h = lines.select("doc_id", "n", X.is_heading("line").alias("head"))
    heads = F.count_if("head")
    g = h.groupBy("doc_id").agg(F.count("*").alias("units"), heads.alias("heads"), F.bool_or(F.col("head") & (F.col("n") == 0)).alias("first"))
    return g.select("doc_id", "units", "heads", F.when(F.col("heads") >= 2, F.col("heads") + F.when(F.col("first"), 0).otherwise(1)).otherwise(F.floor((F.col("units") + 9) / 10)).cast("long").alias("sections"))


@query("G5_new_alignments_only")
def g5(spark, d):
    """Pairs without an adjudication are aligned; those that people decided on are left alone."""
    p = t(spark, d, "parallel_pairs").join(t(spark, d, "pair_adjudications").select(F.col("pair_id").alias("id")), "id", "left_anti")
    return P.align_pairs(p.select("id", X.sentences("ru_text").alias("a"), X.sentences("lak_text").alias("b")), "id", "a", "b").where("level = 'unit'").groupBy("id").agg(F.count("*").alias("units"))


@query("I6_confidence_merge", "select coalesce(a.id, b.id) as id, greatest(coalesce(a.c, 0), coalesce(b.c, 0)) as confidence from (select source_id as id, 0.5::double as c from corpus_documents where source_id is not null group by 1) a full join (select source as id, max(target_share) as c from mix_targets group by 1) b on a.id = b.id")
def i6(spark, d):
    a = t(spark, d, "corpus_documents").where("source_id is not null").select(F.col("source_id").alias("id")).distinct().withColumn("a", F.lit(0.5))
    b = t(spark, d, "mix_targets").groupBy(F.col("source").alias("id")).agg(F.max("target_share").alias("b"))
    return a.join(b, "id", "full_outer").select("id", F.greatest(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))).alias("confidence"))


@query("E15_resumable_stages", "select 2::bigint as runs, count(*) as forms from (select form from (select distinct source, unnest(" + WORDS.format("text") + ") as form from documents where source is not null) group by 1 having count(*) >= 2)")
def e15(spark, d):
    """A stage's table lies under the digest of its input; a second run with the same input reads it and computes nothing."""
    docs = t(spark, d, "documents")
    key = docs.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(F.xxhash64("doc_id", "source", "text").cast("decimal(38,0)")).cast("string")), 256)).first()[0]
    path = scratch(spark, f"forms-{key[:32]}")
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    for _ in range(2):
        if not made.getFileSystem(spark._jsc.hadoopConfiguration()).exists(made):
            S.word_forms(docs).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).agg(F.lit(2).cast("long").alias("runs"), F.count("*").alias("forms"))
