"""Queries: scans, predicates, joins, aggregates, windows, pages and sets over the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from corvane.operators import relational as R
from corvane.operators.profiles import CHARS, UNITS
from corvane.plans.registry import query
from corvane.session import table as t

PUBLIC = "coalesce(s.public_search_allowed and s.access_status = 'public' and s.rights_status in ('open_license','public_domain','permission_recorded'), false)"


@query("P1_equality_filters", "select doc_id, source, lang from documents where lang = 'ru' and genre = 'tale'")
def p1_equality(spark, d):
    return R.optional(t(spark, d, "documents"), lang="ru", genre="tale").select("doc_id", "source", "lang")


@query("P2_optional_filters", "select id, status, split from parallel_pairs where status = 'approved'")
def p2_optional(spark, d):
    return R.optional(t(spark, d, "parallel_pairs"), status="approved", split=None).select("id", "status", "split")


@query("P3_facet_filters", "select id, rights_status, access_status from corpus_sources where access_status = 'public'")
def p3_facets(spark, d):
    allowed = {"rights_status": (*R.OPEN_RIGHTS, "unknown", "restricted"), "access_status": ("public", "restricted", "authenticated")}
    return R.facet_filter(t(spark, d, "corpus_sources"), allowed, rights_status="no such right", access_status="public").select("id", "rights_status", "access_status")


@query("P4_substring_literal", "select id, source_provenance from parallel_pairs where contains(lower(source_provenance), 'p. 1')")
def p4_substring(spark, d):
    return t(spark, d, "parallel_pairs").where(F.contains(F.lower("source_provenance"), F.lit("p. 1"))).select("id", "source_provenance")


@query("P5_prefix_filters", "select distinct id, title from corpus_documents where starts_with(title, 'О') or starts_with(title, 'V') or starts_with(title, 'Ч')")
def p5_prefix(spark, d):
    starts = F.exists(F.array(*map(F.lit, "ОVЧ")), lambda v: F.col("title").startswith(v))
    return t(spark, d, "corpus_documents").where(starts).select("id", "title").distinct()


@query("P6_ilike_columns", "select id from corpus_documents where title ilike '%eagle%' or author ilike '%eagle%' or source_file ilike '%eagle%'")
def p6_ilike(spark, d):
    return t(spark, d, "corpus_documents").where(R.any_contains(["title", "author", "source_file"], "Eagle")).select("id")


@query("P7_array_membership", "select id, kind from gold_set where list_contains(options, 'uncertain') or kind = 'dialect'")
def p7_array(spark, d):
    return t(spark, d, "gold_set").where(F.array_contains("options", "uncertain") | (F.col("kind") == "dialect")).select("id", "kind")


@query("P8_public_sources", f"select s.id from corpus_sources s where {PUBLIC}")
def p8_public(spark, d):
    return t(spark, d, "corpus_sources").where(R.public_source()).select("id")


@query("P12_exclusion", "select doc_id from documents where source is not null and source not in (select id from corpus_sources where access_status = 'restricted')")
def p12_exclusion(spark, d):
    out = t(spark, d, "corpus_sources").where("access_status = 'restricted'").select(F.col("id").alias("source"))
    return t(spark, d, "documents").where("source is not null").join(out, "source", "left_anti").select("doc_id")


@query("P13_projection", "select id, title, creator_credit is not null as credited, date_part('year', created_at)::bigint as year from corpus_sources")
def p13_projection(spark, d):
    return t(spark, d, "corpus_sources").select("id", "title", F.col("creator_credit").isNotNull().alias("credited"), F.year("created_at").cast("long").alias("year"))


@query("P14_case_columns", "select doc_id, case when n_chars < 200 then 'short' when n_chars < 800 then 'medium' when n_chars is null then 'none' else 'long' end as band from documents")
def p14_case(spark, d):
    n = F.col("n_chars")
    return t(spark, d, "documents").select("doc_id", F.when(n < 200, "short").when(n < 800, "medium").when(n.isNull(), "none").otherwise("long").alias("band"))


@query("P15_haystack", "select id from corpus_sources where contains(lower(concat_ws(' ', id, title, creator_credit, canonical_url, rights_status)), 'tales')")
def p15_haystack(spark, d):
    hay = F.lower(F.concat_ws(" ", "id", "title", "creator_credit", "canonical_url", "rights_status"))
    return t(spark, d, "corpus_sources").where(hay.contains("tales")).select("id")


@query(
    "P17_row_rules",
    """select id as row_key, rule from (
      select id, unnest([case when coalesce(title <> '', false) then null else 'title' end,
        case when coalesce(regexp_full_match(content_hash, '[0-9a-f]{64}'), false) then null else 'digest' end,
        case when coalesce(regexp_full_match(year, '[0-9]{4}'), false) then null else 'year' end,
        case when coalesce(script in ('Cyrl','Latn'), false) then null else 'script' end]) as rule from corpus_documents) where rule is not null""",
)
def p17_rules(spark, d):
    rules = {"title": F.col("title") != "", "digest": F.col("content_hash").rlike("^[0-9a-f]{64}$"), "year": F.col("year").rlike("^[0-9]{4}$"), "script": F.col("script").isin("Cyrl", "Latn")}
    return R.violations(t(spark, d, "corpus_documents"), "id", rules)


@query("P16_allowed_values", "select 'rights_status' as \"column\", rights_status as value, count(*) as n from corpus_sources where rights_status not in ('open_license','public_domain','permission_recorded') group by 2 union all select 'access_status', access_status, count(*) from corpus_sources where access_status <> 'public' group by 2")
def p16_values(spark, d):
    s = t(spark, d, "corpus_sources")
    allowed = {"rights_status": R.OPEN_RIGHTS, "access_status": ("public",)}
    parts = [s.where(~F.col(c).isin(*v)).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("column"), "value", "n") for c, v in allowed.items()]
    return parts[0].unionByName(parts[1])


@query("P18_declared_counts", "select 'corpus_sources' as name, 30::bigint as expected, (select count(*) from corpus_sources) as observed, (select count(*) from corpus_sources) = 30 as matches union all select 'languages', 5, (select count(distinct lang) from language_samples), (select count(distinct lang) from language_samples) = 5")
def p18_counts(spark, d):
    seen = t(spark, d, "corpus_sources").agg(F.count("*").alias("observed")).select(F.lit("corpus_sources").alias("name"), "observed")
    seen = seen.unionByName(t(spark, d, "language_samples").agg(F.countDistinct("lang").alias("observed")).select(F.lit("languages").alias("name"), "observed"))
    return R.reconcile(seen, {"corpus_sources": 30, "languages": 5})


# ---- joins


def chain(spark, d):
    """Segments with their document and their public source. Sources and documents are of fixed size."""
    src = t(spark, d, "corpus_sources").where(R.public_source()).select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), "rights_status")
    doc = t(spark, d, "corpus_documents").select(F.col("id").alias("document_id"), "source_id", F.col("title").alias("document_title"), "genre", "variety", "script")
    return t(spark, d, "segments").join(doc.join(src, "source_id"), "document_id")


CHAIN = f"segments g join corpus_documents c on g.document_id = c.id join corpus_sources s on c.source_id = s.id where {PUBLIC}"


@query("J1_star_chain", f"select g.id, c.source_id, c.genre, g.ordinal from {CHAIN}")
def j1(spark, d):
    return chain(spark, d).select("id", "source_id", "genre", "ordinal")


@query("J1_tpch_chain", "select r_name, n_name, count(*) as lines, count(distinct c_custkey) as customers from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by 1, 2")
def j1_tpch(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey").join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    per = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_nationkey", "c_custkey").agg(F.sum("n").alias("n")).groupBy("c_nationkey").agg(F.sum("n").alias("lines"), F.count("*").alias("customers"))
    return per.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "lines", "customers")


@query("J4_semi_join", "select id from corpus_documents d where exists (select 1 from segments g where g.document_id = d.id and g.language_code = 'av')")
def j4(spark, d):
    return t(spark, d, "corpus_documents").join(t(spark, d, "segments").where("language_code = 'av'").select(F.col("document_id").alias("id")), "id", "left_semi").select("id")


@query("J5_anti_join", "select id from gold_set g where not exists (select 1 from validation_votes v where v.task_id = g.id)")
def j5(spark, d):
    return t(spark, d, "gold_set").join(t(spark, d, "validation_votes").select(F.col("task_id").alias("id")), "id", "left_anti").select("id")


@query("J6_not_in", "select id from parallel_pairs where id not in (select pair_id from pair_adjudications where pair_id is not null)")
def j6(spark, d):
    return t(spark, d, "parallel_pairs").join(t(spark, d, "pair_adjudications").where("pair_id is not null").select(F.col("pair_id").alias("id")), "id", "left_anti").select("id")


@query("J7_update_from", "select d.id, d.title, coalesce(g.n, 0) as segments from corpus_documents d left join (select document_id, count(*) as n from segments group by 1) g on g.document_id = d.id where coalesce(g.n, 0) is distinct from 0")
def j7(spark, d):
    n = t(spark, d, "segments").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    return t(spark, d, "corpus_documents").join(n, "id", "left").select("id", "title", F.coalesce("n", F.lit(0)).alias("segments")).where(~F.col("segments").eqNullSafe(0))


@query("J8_same_form_pairs", "select distinct a.record_id, b.id from pcmlbe_parallel a join segments b on lower(a.lak_cyrillic) = lower(b.text_original) where a.lak_cyrillic <> '' and b.legacy_record_id is distinct from a.record_id")
def j8(spark, d):
    a = t(spark, d, "pcmlbe_parallel").where("lak_cyrillic <> ''").select("record_id", F.lower("lak_cyrillic").alias("form"))
    b = t(spark, d, "segments").select("id", "legacy_record_id", F.lower("text_original").alias("form"))
    return a.join(b, "form").where(~F.col("legacy_record_id").eqNullSafe(F.col("record_id"))).select("record_id", "id").distinct()


@query("J9_overlap_counts", "with n as (select source, w as form, count(*) as n from (select source, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as w from documents where source is not null) group by 1, 2) select a.source as left_source, b.source as right_source, count(*) as forms, sum(a.n * b.n)::bigint as pairs from n a join n b on a.form = b.form and a.source < b.source group by 1, 2")
def j9(spark, d):
    w = t(spark, d, "documents").where("source is not null").select("source", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")).alias("form"))
    return R.overlap_counts(w, "form", "source")


@query("J11_left_interpretation", "select v.id, v.task_id, g.kind, g.priority from validation_votes v left join gold_set g on g.id = v.task_id")
def j11(spark, d):
    g = t(spark, d, "gold_set").select(F.col("id").alias("task_id"), "kind", "priority")
    return t(spark, d, "validation_votes").join(g, "task_id", "left").select("id", "task_id", "kind", "priority")


@query("J12_keyed_lookup", "select s.id, s.title, t.target_share from corpus_sources s join mix_targets t on t.source = s.id")
def j12(spark, d):
    return t(spark, d, "corpus_sources").join(t(spark, d, "mix_targets").withColumnRenamed("source", "id"), "id").select("id", "title", "target_share")


@query("J16_lateral_unnest", "select g.id, o.option, o.place::bigint as place from (select id, unnest(options) as option, generate_subscripts(options, 1) as place from gold_set) g, lateral (select g.option, g.place) o")
def j16(spark, d):
    return t(spark, d, "gold_set").select("id", F.posexplode("options").alias("p", "option")).select("id", "option", (F.col("p") + 1).cast("long").alias("place"))


@query("J17_scalar_counts", "select d.id, (select count(*) from segments g where g.document_id = d.id) as n_segments, (select count(*) from documents x where x.source = d.source_id) as n_texts from corpus_documents d")
def j17(spark, d):
    a = t(spark, d, "segments").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("a"))
    b = t(spark, d, "documents").groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("b"))
    return t(spark, d, "corpus_documents").join(a, "id", "left").join(b, "source_id", "left").select("id", F.coalesce("a", F.lit(0)).alias("n_segments"), F.coalesce("b", F.lit(0)).alias("n_texts"))


@query("J19_latest_per_key", "select pair_id, pair_version, decision, split from (select *, row_number() over (partition by pair_id order by pair_version desc, created_at desc, loaded_at desc, id desc) as n from pair_adjudications) where n = 1")
def j19(spark, d):
    a = t(spark, d, "pair_adjudications")
    return R.latest(a, ["pair_id"], [F.desc("pair_version"), F.desc("created_at"), F.desc("loaded_at"), F.desc("id")]).select("pair_id", "pair_version", "decision", "split")


# ---- aggregates


@query("A1_facet_counts", "select 'lang' as facet, lang as value, count(*) as n from documents where lang is not null group by 2 union all select 'genre', genre, count(*) from documents where genre is not null group by 2 union all select 'source', source, count(*) from documents where source is not null group by 2")
def a1(spark, d):
    return R.facets(t(spark, d, "documents"), "lang", "genre", "source")


@query("A2_array_facets", "select o as option, count(*) as n from (select unnest(options) as o from gold_set) group by 1")
def a2(spark, d):
    return t(spark, d, "gold_set").select(F.explode("options").alias("option")).groupBy("option").agg(F.count("*").alias("n"))


@query("A3_conditional_counts", "select source_type, count(*) as n, count(*) filter (where status = 'approved') as approved, count(*) filter (where is_private) as private, count(*) filter (where split is null) as unsplit from parallel_pairs group by 1")
def a3(spark, d):
    return t(spark, d, "parallel_pairs").groupBy("source_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if("is_private").alias("private"), F.count_if(F.col("split").isNull()).alias("unsplit"))


@query("A4_exact_distinct", "select count(distinct contributor_id) as contributors, count(distinct task_id) as tasks, count(distinct value) as spellings from validation_votes")
def a4(spark, d):
    return t(spark, d, "validation_votes").agg(F.countDistinct("contributor_id").alias("contributors"), F.countDistinct("task_id").alias("tasks"), F.countDistinct("value").alias("spellings"))


@query("A5_distinct_arrays", "select source_id, coalesce(array_to_string(list_sort(list(distinct genre) filter (where genre is not null)), '|'), '') as genres, count(distinct variety) as varieties from corpus_documents group by 1")
def a5(spark, d):
    return t(spark, d, "corpus_documents").groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("genre")), "|").alias("genres"), F.countDistinct("variety").alias("varieties"))


@query("A6_distinct_objects", "select source_id, count(*) as objects from (select distinct source_id, genre, script from corpus_documents) group by 1")
def a6(spark, d):
    return t(spark, d, "corpus_documents").groupBy("source_id").agg(F.size(F.collect_set(F.struct("genre", "script"))).cast("long").alias("objects"))


@query("A8_length_totals", "select lang, source, count(*) as n, sum(length(text))::bigint as chars from documents group by 1, 2")
def a8(spark, d):
    return t(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("A9_conditional_sums", "select date_trunc('month', created_at)::date::varchar as month, count(distinct contributor_id) filter (where not flagged_spam) as active, sum(case when flagged_spam then 1 else 0 end)::bigint as flagged, count(*) as votes from validation_votes group by 1")
def a9(spark, d):
    return t(spark, d, "validation_votes").groupBy(F.to_date(F.date_trunc("month", "created_at")).cast("string").alias("month")).agg(F.countDistinct(F.when(~F.col("flagged_spam"), F.col("contributor_id"))).alias("active"), F.sum(F.when(F.col("flagged_spam"), 1).otherwise(0)).alias("flagged"), F.count("*").alias("votes"))


@query("A11_rounded_averages", "select kind, floor(avg(priority) * 1000 + 0.5) / 1000 as mean_priority from gold_set group by 1")
def a11(spark, d):
    return t(spark, d, "gold_set").groupBy("kind").agg((F.floor(F.avg("priority") * 1000 + 0.5) / 1000.0).alias("mean_priority"))


@query("A12_gold_hits", "select v.contributor_id, count(*) as n_gold, count(*) filter (where lower(trim(v.value)) = lower(g.gold_answer)) as hits from validation_votes v join gold_set g on g.id = v.task_id where g.is_gold and not v.flagged_spam group by 1")
def a12(spark, d):
    g = t(spark, d, "gold_set").where("is_gold").select(F.col("id").alias("task_id"), "gold_answer")
    return t(spark, d, "validation_votes").where(~F.col("flagged_spam")).join(g, "task_id").groupBy("contributor_id").agg(F.count("*").alias("n_gold"), F.count_if(F.lower(F.trim("value")) == F.lower("gold_answer")).alias("hits"))


@query("A13_bands", "select (case when n_chars is null then -1 else n_chars // 250 end)::bigint as band, count(*) as n from documents group by 1")
def a13(spark, d):
    return t(spark, d, "documents").groupBy(F.when(F.col("n_chars").isNull(), -1).otherwise(F.floor(F.col("n_chars") / 250)).cast("long").alias("band")).agg(F.count("*").alias("n"))


@query("A14_ranges", "select document_id, min(ordinal)::bigint as lo, max(ordinal)::bigint as hi, min(language_code) as code from segments group by 1")
def a14(spark, d):
    return t(spark, d, "segments").groupBy("document_id").agg(F.min("ordinal").cast("long").alias("lo"), F.max("ordinal").cast("long").alias("hi"), F.min("language_code").alias("code"))


@query("A15_option_lists", "select kind, array_to_string(list_sort(list(distinct o)), '|') as options from (select kind, unnest(options) as o from gold_set) group by 1")
def a15(spark, d):
    return t(spark, d, "gold_set").select("kind", F.explode("options").alias("o")).groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set("o")), "|").alias("options"))


@query("A16_first_matching_family", "select coalesce(case when contains(id, 'tales') then 'tales' end, case when contains(id, 'songs') then 'songs' end, case when contains(id, 'grammar') then 'grammar' end, 'other') as family, count(*) as n, count(*) filter (where access_status = 'public') as public from corpus_sources group by 1")
def a16(spark, d):
    family = F.coalesce(*[F.when(F.col("id").contains(x), x) for x in ("tales", "songs", "grammar")], F.lit("other"))
    return t(spark, d, "corpus_sources").groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.count_if(F.col("access_status") == "public").alias("public"))


@query("A18_run_summary", "select direction, count(*) as n, count(*) filter (where abstained) as abstained, case when count(*) = 0 then 0.0 else floor(count(*) filter (where abstained) * 1.0::double / count(*) * 10000 + 0.5) / 10000 end as rate from parallel_pairs group by 1")
def a18(spark, d):
    n, a = F.count("*"), F.count_if("abstained")
    return t(spark, d, "parallel_pairs").groupBy("direction").agg(n.alias("n"), a.alias("abstained"), F.when(n == 0, 0.0).otherwise(F.floor(a / n * 10000 + 0.5) / 10000.0).alias("rate"))


@query("A19_dataset_card", "select 'status' as facet, status as value, count(*) as n from parallel_pairs where status is not null group by 2 union all select 'split', split, count(*) from parallel_pairs where split is not null group by 2 union all select 'variety', variety, count(*) from parallel_pairs where variety is not null group by 2 union all select 'direction', direction, count(*) from parallel_pairs where direction is not null group by 2")
def a19(spark, d):
    return R.facets(t(spark, d, "parallel_pairs"), "status", "split", "variety", "direction")


@query("A20_reconciliation", "select 'documents' as name, 400::bigint as expected, count(*) as observed, count(*) = 400 as matches from corpus_documents union all select 'orphans', 0, count(*), count(*) = 0 from segments g where not exists (select 1 from corpus_documents d where d.id = g.document_id)")
def a20(spark, d):
    docs = t(spark, d, "corpus_documents")
    lost = t(spark, d, "segments").join(docs.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    seen = docs.agg(F.count("*").alias("observed")).select(F.lit("documents").alias("name"), "observed").unionByName(lost.agg(F.count("*").alias("observed")).select(F.lit("orphans").alias("name"), "observed"))
    return R.reconcile(seen, {"documents": 400, "orphans": 0})


@query("A22_daily_totals", "select contributor_id, created_at::date::varchar as day, count(*) as n from validation_votes group by 1, 2")
def a22(spark, d):
    return t(spark, d, "validation_votes").groupBy("contributor_id", F.to_date("created_at").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("A23_first_preferred", "select source_id, id from (select source_id, id, row_number() over (partition by source_id order by (author is not null) desc, (editor is not null) desc, id) as n from corpus_documents) where n = 1")
def a23(spark, d):
    return R.latest(t(spark, d, "corpus_documents"), ["source_id"], [F.col("author").isNotNull().desc(), F.col("editor").isNotNull().desc(), F.col("id")]).select("source_id", "id")


# ---- windows, order, pages, sets


@query("W1_first_units", "select document_id, id, n from (select document_id, id, row_number() over (partition by document_id order by paragraph nulls last, ordinal nulls last, id, imported_at) as n from (select distinct document_id, id, paragraph, ordinal, imported_at from segments)) where n <= 120")
def w1(spark, d):
    rows = t(spark, d, "segments").select("document_id", "id", "paragraph", "ordinal", "imported_at").distinct()
    return R.top_each(rows, ["document_id"], [F.asc_nulls_last("paragraph"), F.asc_nulls_last("ordinal"), F.col("id"), F.col("imported_at")], 120).select("document_id", "id", F.col("rank").alias("n"))


def _running_length(spark, d, chars):
    """Units of each document until `chars` characters are reached; the unit that crosses is kept."""
    rows = t(spark, d, "segments").select("document_id", "id", "ordinal", "content_hash", "text_original").distinct()
    first = R.top_each(rows, ["document_id"], [F.col("ordinal"), F.col("id"), F.col("content_hash")], UNITS)  # so a window holds UNITS rows at most
    w = W.partitionBy("document_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    return first.withColumn("before", F.coalesce(F.sum(F.length("text_original")).over(w), F.lit(0))).where(F.col("before") < chars).select("document_id", "id")


@query("W2_running_length", "select document_id, id from (select document_id, id, coalesce(sum(length(text_original)) over (partition by document_id order by n rows between unbounded preceding and 1 preceding), 0) as before from (select document_id, id, text_original, row_number() over (partition by document_id order by ordinal nulls first, id, content_hash) as n from (select distinct document_id, id, ordinal, content_hash, text_original from segments)) where n <= 120) where before < 4000")
def w2(spark, d):
    """Up to 4,000 characters, as the SQL has it; W2_running_length_whole goes up to the reference's bound."""
    return _running_length(spark, d, 4000)


@query("W2_running_length_whole", "select document_id, id from (select document_id, id, coalesce(sum(length(text_original)) over (partition by document_id order by n rows between unbounded preceding and 1 preceding), 0) as before from (select document_id, id, text_original, row_number() over (partition by document_id order by ordinal nulls first, id, content_hash) as n from (select distinct document_id, id, ordinal, content_hash, text_original from segments)) where n <= 120) where before < 40000")
def w2_whole(spark, d):
    return _running_length(spark, d, CHARS)


@query("W3_page_with_total", "select id, title, total from (select id, title, count(*) over () as total from corpus_documents) order by id limit 25 offset 50")
def w3(spark, d):
    docs = t(spark, d, "corpus_documents")
    total = docs.agg(F.count("*").alias("total"))
    return R.page(docs.select("id", "title"), [F.col("id")], 3, 25, clamp=False).crossJoin(F.broadcast(total))


@query("W4_distinct_on", "select distinct on (source_id) source_id, id, year from corpus_documents order by source_id, year nulls last, id")
def w4(spark, d):
    return R.latest(t(spark, d, "corpus_documents"), ["source_id"], [F.asc_nulls_last("year"), F.col("id")]).select("source_id", "id", "year")


@query("W5_rank_percentile", "with c as (select contributor_id, count(*) as n from validation_votes group by 1), r as (select *, row_number() over (order by n desc, contributor_id) as rank, count(*) over () as total from c) select a.contributor_id, a.n, a.rank, floor((1 - (a.rank - 1) * 1.0::double / greatest(a.total, 1)) * 100 + 0.5)::bigint as percentile, coalesce(string_agg(b.contributor_id, ',' order by b.rank), '') as neighbours from r a left join r b on b.rank between a.rank - 2 and a.rank + 2 and b.rank <> a.rank group by 1, 2, 3, 4")
def w5(spark, d):
    c = t(spark, d, "validation_votes").groupBy("contributor_id").agg(F.count("*").alias("n"))
    # ranks over all rows without one task for all: counts of larger values first, then the order among equals
    per = c.groupBy("n").agg(F.count("*").alias("same"))
    above = per.withColumn("above", F.sum("same").over(W.orderBy(F.desc("n"))) - F.col("same"))  # a row per distinct count
    rank = F.col("above") + F.row_number().over(W.partitionBy("n").orderBy("contributor_id"))
    total = c.agg(F.count("*").alias("total"))
    r = c.join(above, "n").crossJoin(F.broadcast(total)).select("contributor_id", "n", rank.cast("long").alias("rank"), "total")
    # each row is a neighbour of four ranks
    near = r.select(F.explode(F.array(*[F.col("rank") + k for k in (-2, -1, 1, 2)])).alias("rank"), F.struct(F.col("rank").alias("at"), F.col("contributor_id").alias("id")).alias("x"))
    near = near.groupBy("rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["id"]), ",").alias("neighbours"))
    percentile = F.floor((1 - (F.col("rank") - 1) / F.greatest("total", F.lit(1))) * 100 + 0.5)
    return r.join(near, "rank", "left").select("contributor_id", "n", "rank", percentile.alias("percentile"), F.coalesce("neighbours", F.lit("")).alias("neighbours"))


@query("W6_streaks", "select contributor_id, min(d)::varchar as first_day, max(d)::varchar as last_day, count(*) as days from (select contributor_id, d, d - (row_number() over (partition by contributor_id order by d))::int as island from (select distinct contributor_id, created_at::date as d from validation_votes)) group by contributor_id, island")
def w6(spark, d):
    s = R.streaks(t(spark, d, "validation_votes"), "contributor_id", "created_at")
    return s.select("contributor_id", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "days")


@query("W6_current_streak", "with v as (select distinct contributor_id, created_at::date as d from validation_votes where contributor_id is not null), today as (select max(d) as d from v), i as (select contributor_id, max(d) as last_day, count(*) as days from (select *, d - (row_number() over (partition by contributor_id order by d))::int as island from v where d is not null) group by contributor_id, island) select contributor_id, coalesce(max(case when last_day >= today.d - 1 then days end), 0)::bigint as streak from (select distinct contributor_id from v) left join i using (contributor_id), today group by 1")
def w6_current(spark, d):
    """Days in a row up to the table's last day or the day before it; 0 where the last run ended earlier."""
    v = t(spark, d, "validation_votes").where("contributor_id is not null")
    today = v.agg(F.max(F.to_date("created_at")).alias("today"))
    runs = R.streaks(v, "contributor_id", "created_at").crossJoin(F.broadcast(today)).where(F.col("last_day") >= F.date_sub("today", 1))
    now = runs.groupBy("contributor_id").agg(F.max("days").alias("streak"))
    return v.select("contributor_id").distinct().join(now, "contributor_id", "left").select("contributor_id", F.coalesce("streak", F.lit(0)).alias("streak"))


@query("W7_trailing_bursts", "select event_id, count(*) over (partition by user_id order by ts range between interval 300 seconds preceding and current row) - 1 as recent from events")
def w7(spark, d):
    return R.bursts(t(spark, d, "events"), "user_id", "ts", 300, "event_id").select("event_id", "recent")


@query("W8_minimum_interval", "select event_id from (select event_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events) where gap < 600000000")
def w8(spark, d):
    return R.bursts(t(spark, d, "events"), "user_id", "ts", 300, "event_id").where("since < 600").select("event_id")


@query("W9_daily_place", "select id, row_number() over (partition by contributor_id, created_at::date order by created_at, id, loaded_at) as place from (select distinct id, contributor_id, created_at, loaded_at from validation_votes)")
def w9(spark, d):
    rows = t(spark, d, "validation_votes").select("id", "contributor_id", "created_at", "loaded_at").distinct()
    return rows.select("id", F.row_number().over(W.partitionBy("contributor_id", F.to_date("created_at")).orderBy("created_at", "id", "loaded_at")).cast("long").alias("place"))


@query("W10_latest_n", "select contributor_id, id, n from (select contributor_id, id, row_number() over (partition by contributor_id order by created_at desc, id desc, loaded_at desc) as n from (select distinct contributor_id, id, created_at, loaded_at from validation_votes)) where n <= 5")
def w10(spark, d):
    rows = t(spark, d, "validation_votes").select("contributor_id", "id", "created_at", "loaded_at").distinct()
    return R.top_each(rows, ["contributor_id"], [F.desc("created_at"), F.desc("id"), F.desc("loaded_at")], 5).select("contributor_id", "id", F.col("rank").alias("n"))


@query("L2_clamped_page", "select doc_id, lang from documents order by doc_id limit 50 offset (select ((count(*) - 1) // 50) * 50 from documents)")
def l2(spark, d):
    return R.page(t(spark, d, "documents").select("doc_id", "lang"), [F.col("doc_id")], 10**9, 50)


@query("L4_catalogue_order", "select row_number() over (order by (author is null), author, id) as place, id, author from corpus_documents")
def l4(spark, d):
    docs = t(spark, d, "corpus_documents").select("id", "author")  # a table of fixed size
    return docs.select(F.row_number().over(W.orderBy(F.col("author").isNull(), F.asc_nulls_last("author"), "id")).cast("long").alias("place"), "id", "author")


@query("L5_form_sorts", "with w as (select source, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as form from documents) select form, count(distinct source) as sources, count(*) as occurrences from w group by 1 order by sources desc, occurrences desc, form limit 100")
def l5(spark, d):
    w = t(spark, d, "documents").select("source", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")).alias("form"))
    per = w.groupBy("form", "source").agg(F.count("*").alias("n")).groupBy("form").agg(F.count("source").alias("sources"), F.sum("n").alias("occurrences"))
    return per.orderBy(F.desc("sources"), F.desc("occurrences"), "form").limit(100)


@query("L6_script_rank", "select title, case when regexp_matches(title, '^[А-Яа-яЁёӀӏ]') then 0 when regexp_matches(title, '[А-Яа-яЁёӀӏ]') then 1 else 2 end::bigint as script_rank from corpus_documents")
def l6(spark, d):
    rank = F.when(F.col("title").rlike("^[А-Яа-яЁёӀӏ]"), 0).when(F.col("title").rlike("[А-Яа-яЁёӀӏ]"), 1).otherwise(2)
    return t(spark, d, "corpus_documents").select("title", rank.cast("long").alias("script_rank"))


@query("L10_queue_order", "select id from gold_set order by priority desc, kind, id limit 200")
def l10(spark, d):
    return t(spark, d, "gold_set").orderBy(F.desc("priority"), "kind", "id").limit(200).select("id")


@query("L12_seeded_pick", "with v as (select distinct contributor_id, task_id from validation_votes), r as (select contributor_id, task_id, row_number() over (partition by contributor_id order by -priority nulls first, md5(concat_ws('|', contributor_id, task_id)), task_id) as n from v join (select id as task_id, priority from gold_set) using (task_id)) select contributor_id, task_id from r where n = 1")
def l12(spark, d):
    """One task per contributor and priority order, ties broken by a hash of both, the same in every run."""
    votes = t(spark, d, "validation_votes").select("contributor_id", "task_id").distinct()
    g = t(spark, d, "gold_set").select(F.col("id").alias("task_id"), "priority")
    key = F.struct((-F.col("priority")).alias("p"), F.md5(F.concat_ws("|", "contributor_id", "task_id").cast("binary")).alias("h"), "task_id")
    return votes.join(g, "task_id").groupBy("contributor_id").agg(F.min(key).alias("x")).select("contributor_id", F.col("x.task_id").alias("task_id"))


@query("L13_first_seen_values", "select source_id, array_to_string(list_slice(list(genre order by pos), 1, 3), '|') as genres from (select source_id, genre, min(id) as pos from corpus_documents where genre is not null group by 1, 2) group by 1")
def l13(spark, d):
    first = t(spark, d, "corpus_documents").where("genre is not null").groupBy("source_id", "genre").agg(F.min("id").alias("pos"))
    return first.groupBy("source_id").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "genre"))), lambda x: x["genre"]), 1, 3), "|").alias("genres"))


@query("U1_union_distinct", "select source as id from documents where source is not null union select source_id from corpus_documents where source_id is not null union select source from mix_targets")
def u1(spark, d):
    a = t(spark, d, "documents").where("source is not null").select(F.col("source").alias("id"))
    b = t(spark, d, "corpus_documents").where("source_id is not null").select(F.col("source_id").alias("id"))
    return a.unionByName(b).unionByName(t(spark, d, "mix_targets").select(F.col("source").alias("id"))).distinct()


@query("U2_heterogeneous_union", "select 'segment' as kind, id, text_original as text, language_code as lang from segments union all select 'task', id, lak_text, null from gold_set union all select 'pair', id, lak_text, null from parallel_pairs")
def u2(spark, d):
    a = t(spark, d, "segments").select(F.lit("segment").alias("kind"), "id", F.col("text_original").alias("text"), F.col("language_code").alias("lang"))
    b = t(spark, d, "gold_set").select(F.lit("task").alias("kind"), "id", F.col("lak_text").alias("text"))
    c = t(spark, d, "parallel_pairs").select(F.lit("pair").alias("kind"), "id", F.col("lak_text").alias("text"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("U3_first_wins", "select content_hash, id from (select content_hash, id, row_number() over (partition by content_hash order by id) as n from segments) where n = 1")
def u3(spark, d):
    return t(spark, d, "segments").groupBy("content_hash").agg(F.min("id").alias("id"))


@query("U5_set_difference", "select id from parallel_pairs p where status = 'approved' or exists (select 1 from pair_adjudications a where a.pair_id = p.id)")
def u5(spark, d):
    pairs = t(spark, d, "parallel_pairs").select("id", "status")
    judged = t(spark, d, "pair_adjudications").select(F.col("pair_id").alias("id")).distinct().withColumn("judged", F.lit(True))
    return pairs.join(judged, "id", "left").where("status = 'approved' or judged").select("id")


@query("SK7_insert_new", "with n as (select record_id, min(lak_cyrillic) as lak_cyrillic from pcmlbe_parallel group by 1) select record_id, lak_cyrillic from n where not exists (select 1 from segments g where g.legacy_record_id = n.record_id and g.language_code = 'lbe')")
def sk7(spark, d):
    old = t(spark, d, "segments").where("language_code = 'lbe'").select(F.col("legacy_record_id").alias("record_id"))
    new = t(spark, d, "pcmlbe_parallel").select("record_id", "lak_cyrillic")
    return R.insert_new(old, new, ["record_id"], [F.asc_nulls_last("lak_cyrillic")])


@query("SK9_upsert", "with o as (select id, status, split from parallel_pairs), n as (select id, max(resulting_status) as status, max(split) as split from (select pair_id as id, resulting_status, split from pair_adjudications) group by 1) select coalesce(o.id, n.id) as id, case when n.id is not null then n.status else o.status end as status, case when o.id is not null then o.split else n.split end as split, case when o.id is null then 'inserted' when n.id is null then 'kept' when o.status is distinct from n.status then 'refreshed' else 'same' end as change from o full join n on o.id = n.id")
def sk9(spark, d):
    old = t(spark, d, "parallel_pairs").select("id", "status", "split")
    new = t(spark, d, "pair_adjudications").groupBy(F.col("pair_id").alias("id")).agg(F.max("resulting_status").alias("status"), F.max("split").alias("split"))
    return R.upsert(old, new, "id", ["status"], ["split"])


#: Votes' weights in thousandths: 0.3 and the contributor's reliability from 0 to 1, by their last 100 votes on tasks with a
#: gold answer; contributors without any count as 0.5.
WEIGHTS_SQL = """with gold as (select id, max(lower(trim(gold_answer))) as answer from gold_set where gold_answer is not null group by 1),
 last as (select v.contributor_id, case when lower(trim(v.value)) = g.answer then 1.0 else 0.0 end::double as outcome, row_number() over (partition by contributor_id order by created_at desc, v.id desc, loaded_at desc) as n
  from validation_votes v join gold g on g.id = v.task_id where not flagged_spam and contributor_id is not null),
 rel as (select contributor_id, floor((2.5 + sum(outcome)) / (5.0 + count(*)) * 1000 + 0.5)::bigint as score from last where n <= 100 group by 1),
 w as (select task_id, lower(trim(value)) as value, count(*) as n, sum(300 + greatest(0, least(1000, coalesce(score, 500))))::bigint as thousandths
  from validation_votes left join rel using (contributor_id) where not flagged_spam and task_id is not null group by 1, 2),
 h as (select task_id, value, n, (thousandths + 5) // 10 as hundredths from w),
 shares as (select *, floor(hundredths * 1000.0::double / sum(hundredths) over (partition by task_id) + 0.5) / 1000 as share from h)"""


def weighted_shares(spark, d):
    """(task_id, value, n, weight, share): each vote weighs 0.3 and its contributor's reliability; a value's weight is rounded to two
    digits before the total is made, its share to three. Sums are made in whole thousandths, so their order doesn't matter."""
    gold = t(spark, d, "gold_set").where("gold_answer is not null").groupBy(F.col("id").alias("task_id")).agg(F.max(F.lower(F.trim("gold_answer"))).alias("answer"))
    votes = t(spark, d, "validation_votes").where(~F.col("flagged_spam"))
    outcome = F.when(F.lower(F.trim("value")) == F.col("answer"), 1.0).otherwise(0.0)
    known = votes.where("contributor_id is not null").join(gold, "task_id").withColumn("outcome", outcome).withColumn("weight", F.lit(1.0))
    score = R.reliability(known, "contributor_id", [F.desc("created_at"), F.desc("id"), F.desc("loaded_at")], "outcome", "weight").select("contributor_id", F.round(F.col("score") * 1000).cast("long").alias("score"))
    each = F.lit(300) + F.greatest(F.lit(0), F.least(F.lit(1000), F.coalesce("score", F.lit(500))))
    w = votes.where("task_id is not null").join(score, "contributor_id", "left").groupBy("task_id", F.lower(F.trim("value")).alias("value")).agg(F.count("*").alias("n"), F.sum(each).alias("thousandths"))
    h = w.withColumn("hundredths", F.expr("(thousandths + 5) div 10"))
    share = F.floor(F.col("hundredths") * F.lit(1000.0) / F.sum("hundredths").over(W.partitionBy("task_id")) + 0.5) / 1000.0
    return h.select("task_id", "value", "n", (F.col("hundredths") / 100.0).alias("weight"), share.alias("share"))


@query("A10_weighted_shares", WEIGHTS_SQL + " select task_id, value, n, hundredths / 100.0::double as weight, share from shares")
def a10(spark, d):
    return weighted_shares(spark, d)


@query("A17_shrunk_reliability", "with e as (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) select user_id, count(*) as n, floor((2.5 + sum(case when value > 50 then 1.0 else 0.0 end::double)) / (5.0 + count(*)) * 1000 + 0.5) / 1000 as score from e where n <= 100 group by 1")
def a17(spark, d):
    e = t(spark, d, "events").withColumn("outcome", F.when(F.col("value") > 50, 1.0).otherwise(0.0)).withColumn("weight", F.lit(1.0))
    return R.reliability(e, "user_id", [F.desc("ts"), F.desc("event_id")], "outcome", "weight")


@query("V1_consensus_shares", WEIGHTS_SQL + ", r as (select *, row_number() over (partition by task_id order by hundredths desc, value nulls last) as k from shares), p as (select task_id, sum(n)::bigint as votes, max(case when k = 1 then value end) as top, max(case when k = 1 then share end) as first, coalesce(max(case when k = 2 then share end), 0) as second from r group by 1) select task_id, top, votes, case when votes >= 3 and first >= 0.67 then 'consensus' when votes >= 3 and second >= 0.25 then 'disputed' else 'open' end as outcome from p")
def v1(spark, d):
    """Three votes or more: the top value's weighted share of .67 makes consensus, else the next one's of .25 a dispute; equal weights by value."""
    r = weighted_shares(spark, d).withColumn("k", F.row_number().over(W.partitionBy("task_id").orderBy(F.desc("weight"), F.asc_nulls_last("value"))))
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    p = r.groupBy("task_id").agg(F.sum("n").alias("votes"), at(1, "value").alias("top"), at(1, "share").alias("first"), F.coalesce(at(2, "share"), F.lit(0.0)).alias("second"))
    enough = F.col("votes") >= 3
    return p.select("task_id", "top", "votes", F.when(enough & (F.col("first") >= 0.67), "consensus").when(enough & (F.col("second") >= 0.25), "disputed").otherwise("open").alias("outcome"))


@query("B10_version_heads", "select pair_id, max(pair_version)::bigint as head, count(distinct pair_version) as versions from pair_adjudications group by 1")
def b10(spark, d):
    return t(spark, d, "pair_adjudications").groupBy("pair_id").agg(F.max("pair_version").cast("long").alias("head"), F.countDistinct("pair_version").alias("versions"))


@query("B11_first_adjudication", "select pair_id, pair_version, id from (select *, row_number() over (partition by pair_id, pair_version order by created_at, id, loaded_at) as n from pair_adjudications) where n = 1")
def b11(spark, d):
    return R.latest(t(spark, d, "pair_adjudications"), ["pair_id", "pair_version"], [F.col("created_at"), F.col("id"), F.col("loaded_at")]).select("pair_id", "pair_version", "id")
