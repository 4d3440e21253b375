"""Queries: text functions, stemming, search, word forms and concordances."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from corvane.functions import russian as RU, text as X
from corvane.operators import relational as R, search as S
from corvane.plans.registry import query
from corvane.session import ship, table as t

TOK = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def records(spark, d):
    """Documents as search records: pages of running text and dictionary entries."""
    kind = F.when(F.col("genre").isin("dictionary", "grammar"), "lexicon").otherwise("text")
    none = F.lit(None).cast("string")
    return t(spark, d, "documents").select(kind.alias("kind"), "text", F.col("genre").alias("gloss"), "source", F.col("lang").alias("variety"), F.col("doc_id").cast("string").alias("record_id"), none.alias("alt_text"), none.alias("translation_en"), F.col("doc_id").alias("pos"))


@query("A7_wordform_index", f"with w as (select source, unnest({TOK.format('text')}) as form from documents where source is not null), p as (select form, source, count(*) as n from w group by 1, 2), f as (select form, count(*) as sources, sum(n)::bigint as occurrences from p group by 1 having count(*) >= 2) select form, sources, occurrences, case when sources >= 5 then 'high' when sources >= 3 then 'medium' else 'low' end as confidence from f")
def a7(spark, d):
    return S.word_forms(t(spark, d, "documents")).select("form", "sources", "occurrences", "confidence")


@query("F2_tokens", f"select id, array_to_string({TOK.format('text_normalized')}, ' ') as tokens from segments where text_normalized is not null")
def f2(spark, d):
    return t(spark, d, "segments").where("text_normalized is not null").select("id", F.array_join(F.filter(F.split(F.lower("text_normalized"), r"[^\p{L}\p{N}]+"), lambda x: x != ""), " ").alias("tokens"))


@query("F1_norm")
def f1(spark, d):
    return t(spark, d, "segments").select("id", X.norm("text_original").alias("norm"), X.lak_form("text_original").alias("store_form"), X.form_key("text_original").alias("form_key"))


@query("F3_whole_word", "select id from segments where contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(translate(lower(text_normalized), 'ёiіӏ', 'еӀӀӀ')), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ', ' бувну ')")
def f3(spark, d):
    return t(spark, d, "segments").where(X.has_token("text_normalized", "бувну", nfkc=False)).select("id")


@query("F4_field_tier", f"with s as (select id, lower(translate(lower(coalesce(prompt_ru, '')), 'ёiіӏ', 'еӀӀӀ')) as x from gold_set) select id, (case when contains(regexp_replace(x, '\\s+', ' ', 'g'), 'на к') then 0 when len(list_filter(regexp_split_to_array(x, '[^\\p{{L}}\\p{{N}}]+'), lambda v: v = 'на')) > 0 and len(list_filter(regexp_split_to_array(x, '[^\\p{{L}}\\p{{N}}]+'), lambda v: v = 'к')) > 0 then 1 else -1 end)::bigint as tier from s")
def f4(spark, d):
    return t(spark, d, "gold_set").select("id", X.field_tier("prompt_ru", "на к", ["на", "к"], nfkc=False).cast("long").alias("tier"))


@query("F6_match_spans")
def f6(spark, d):
    return t(spark, d, "gold_set").where(X.field_tier("prompt_ru", "для", ["для"]) >= 0).select("id", S.highlighted(F.col("prompt_ru"), "для").alias("spans"))


@query("F7_explanations")
def f7(spark, d):
    found = S.search(records(spark, d), "словари", aliases=["бувну"])
    return found.select("record_id", "tier", S.explained("словари", ["бувну"]).alias("field"))


@query("F8_spellings")
def f8(spark, d):
    return t(spark, d, "pcmlbe_parallel").where("lak_cyrillic is not null").select("record_id", F.explode(X.lak_variants("lak_cyrillic")).alias("spelling")).distinct()


@query("F9_stable_ids", "select distinct id, 'seg_' || substr(sha256(coalesce(document_id, '') || chr(0) || coalesce(source_segment_ref, '')), 1, 32) as stable from segments")
def f9(spark, d):
    return t(spark, d, "segments").select("id", X.stable_id("seg", "document_id", "source_segment_ref").alias("stable")).distinct()


@query("F10_rolling_hash", "select id, list_reduce(list_prepend(0::bigint, list_transform(string_split(id, ''), lambda c: unicode(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296) as h from corpus_sources")
def f10(spark, d):
    return t(spark, d, "corpus_sources").select("id", X.rolling_hash("id").alias("h"))


@query("F11_canonical_digest")
def f11(spark, d):
    df = t(spark, d, "corpus_documents")
    return df.select("id", F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("digest"))


@query("F12_hash32", "select id, ('0x' || substr(sha1(id), 1, 8))::bigint as h from corpus_documents")
def f12(spark, d):
    return t(spark, d, "corpus_documents").select("id", X.hash32("id").alias("h"))


@query("F13_slugs")
def f13(spark, d):
    return t(spark, d, "corpus_documents").select("id", X.slug("title").alias("slug"))


@query("F14_path_parts", "select id, regexp_extract(canonical_url, '([^/]*)/?$', 1) as file, regexp_extract(canonical_url, '^https?://([^/]+)', 1) as host from corpus_sources where canonical_url is not null")
def f14(spark, d):
    return t(spark, d, "corpus_sources").where("canonical_url is not null").select("id", F.regexp_extract("canonical_url", "([^/]*)/?$", 1).alias("file"), F.regexp_extract("canonical_url", "^https?://([^/]+)", 1).alias("host"))


@query("F15_title_variants", "select id, lower(title) as full, regexp_replace(lower(title), '([-_ ]+(copy|final|draft|v[0-9]+|[0-9]+|[a-z]))+$', '') as root from corpus_documents where title is not null")
def f15(spark, d):
    return t(spark, d, "corpus_documents").where("title is not null").select("id", F.lower("title").alias("full"), F.regexp_replace(F.lower("title"), "([-_ ]+(copy|final|draft|v[0-9]+|[0-9]+|[a-z]))+$", "").alias("root"))


@query("F17_words_with_marks")
def f17(spark, d):
    return t(spark, d, "segments").select("id", F.size(X.words("text_original")).alias("n_words"))


@query("F18_script_profile", "select id, case when regexp_matches(x, '[Ѐ-ӿ]') is null then 'unknown' else (with c as (select length(regexp_replace(x, '[^Ѐ-ӿ]', '', 'g')) as cy, length(regexp_replace(x, '[^A-Za-z]', '', 'g')) as la) select case when cy > 2 * la then 'cyrillic' when la > 2 * cy then 'latin' when cy > 0 or la > 0 then 'mixed' else 'unknown' end from c) end as script from (select id, coalesce(text_original, '') as x from segments)")
def f18(spark, d):
    return t(spark, d, "segments").select("id", X.script_of("text_original").alias("script"))


@query("F19_marker_rates", "select doc_id, floor((length(text) - length(replace(text, 'хь', ''))) / 2.0::double / length(text) * 1000 * 10000 + 0.5) / 10000 as rate from documents where length(text) > 0")
def f19(spark, d):
    hits = (F.length("text") - F.length(F.replace("text", F.lit("хь")))) / F.lit(2.0)
    return t(spark, d, "documents").where(F.length("text") > 0).select("doc_id", X.half_up(hits / F.length("text") * 1000, 4).alias("rate"))


@query("F20_punctuation_profile", "select doc_id, floor(case when p + c > 0 then c * 1.0::double / (p + c) else 0 end * 10000 + 0.5) / 10000 as comma_share from (select doc_id, length(text) - length(replace(text, '.', '')) as p, length(text) - length(replace(text, ',', '')) as c from documents where text is not null)")
def f20(spark, d):
    n = lambda m: (F.length("text") - F.length(F.replace("text", F.lit(m)))).cast("double")
    share = F.when(n(".") + n(",") > 0, n(",") / (n(".") + n(","))).otherwise(0.0)
    return t(spark, d, "documents").where("text is not null").select("doc_id", X.half_up(share, 4).alias("comma_share"))


@query("F21_shingle_sketch", f"with w as (select doc_id, {TOK.format('text')} as k from documents where text is not null), h as (select doc_id, unnest(list_transform(range(1, len(k) - 3), lambda i: ('0x' || substr(sha1(array_to_string(k[i:i+4], ' ')), 1, 8))::bigint)) as v from w where len(k) >= 5), r as (select doc_id, v, row_number() over (partition by doc_id order by v) as n from (select distinct doc_id, v from h)) select doc_id, count(*) as hashes, sum(v)::bigint as total from r where n <= 512 group by 1")
def f21(spark, d):
    k = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    s = t(spark, d, "documents").where("text is not null").select("doc_id", X.shingle_sketch(k).alias("s")).where(F.size("s") > 0)
    return s.select("doc_id", F.size("s").cast("long").alias("hashes"), F.aggregate("s", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("F23_heading_keys")
def f23(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).where(X.is_heading("line"))
    keys = lines.select("doc_id", "pos", X.slug(F.array_join(F.slice(X.tokens("line"), 1, 6), " ")).alias("key")).where("key <> ''")
    first = keys.groupBy("doc_id", "key").agg(F.min("pos").alias("pos"))
    return R.top_each(first, ["doc_id"], [F.col("pos"), F.col("key")], 30).select("doc_id", "key", "rank")


@query("F24_number_tokens", "select doc_id, count(*) as numbers, sum(x::bigint)::bigint as total from (select doc_id, unnest(list_slice(regexp_extract_all(text, '[0-9]{1,4}'), 1, 400)) as x from documents) group by 1")
def f24(spark, d):
    n = t(spark, d, "documents").select("doc_id", F.explode(F.slice(F.regexp_extract_all("text", F.lit("([0-9]{1,4})"), 1), 1, 400)).alias("x"))
    return n.groupBy("doc_id").agg(F.count("*").alias("numbers"), F.sum(F.col("x").cast("long")).alias("total"))


@query("F25_sentences", "with s as (select doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '([^.!?…]+[.!?…]+(?:[\"»)]+)?\\s*|[^.!?…]+$)', 1), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') as x from documents) select doc_id, unnest(range(len(x)))::int as n, unnest(x) as sentence from s")
def f25(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(X.sentences("text")).alias("n", "sentence"))


@query("F26_headings", "select doc_id, trim(text) <> '' and length(trim(text)) <= 90 and not regexp_matches(trim(text), '[.!?…]$') as heading from (select doc_id, coalesce(text, '') as text from documents)")
def f26(spark, d):
    return t(spark, d, "documents").select("doc_id", X.is_heading("text").alias("heading"))


@query("F27_without_marks")
def f27(spark, d):
    return t(spark, d, "segments").select("id", X.without_marks("text_original").alias("plain"))


@query("F29_years", "select id, case when y between 1500 and 2100 then y end as year from (select id, try_cast(nullif(regexp_extract(year, '[0-9]{4}'), '') as bigint) as y from corpus_documents)")
def f29(spark, d):
    y = F.try_to_number(F.nullif(F.regexp_extract("year", "[0-9]{4}", 0), F.lit("")), F.lit("9999")).cast("long")
    return t(spark, d, "corpus_documents").select("id", F.when(y.between(1500, 2100), y).alias("year"))


@query("F34_iso_weeks", "select id, strftime(created_at, '%G-W%V') as week from validation_votes")
def f34(spark, d):
    week = F.concat(F.expr("extract(yearofweek from created_at)").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("created_at").cast("string"), 2, "0"))
    return t(spark, d, "validation_votes").select("id", week.alias("week"))


@query("F35_as_of_dates", "select event_type, count(*) filter (where ts >= timestamp '2024-01-24 00:00:00' and ts < timestamp '2024-01-31 00:00:00') as week, count(*) filter (where date_trunc('month', ts) = timestamp '2024-01-01 00:00:00') as month from events group by 1")
def f35(spark, d):
    ts = F.col("ts").cast("timestamp")
    as_of = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    return t(spark, d, "events").groupBy("event_type").agg(F.count_if((ts >= as_of - F.expr("interval 7 days")) & (ts < as_of)).alias("week"), F.count_if(F.date_trunc("month", ts) == F.to_timestamp(F.lit("2024-01-01 00:00:00"))).alias("month"))


@query("F36_half_up", "select event_id, floor(value * 100 + 0.5) / 100 as two, greatest(0.0::double, least(1.0::double, value / 100)) as unit, floor(log10(value + 1) * 1000 + 0.5) / 1000 as lg from events where value >= 0")
def f36(spark, d):
    v = F.col("value")
    return t(spark, d, "events").where("value >= 0").select("event_id", X.half_up(v, 2).alias("two"), X.clamp01(v / 100).alias("unit"), X.half_up(F.log10(v + 1), 3).alias("lg"))


@query("F37_arrays", "select id, len(options)::bigint as n, options[1] as first, list_contains(options, gold_answer) as known, array_to_string(list_sort(list_distinct(options)), '|') as sorted from gold_set")
def f37(spark, d):
    o = F.col("options")
    return t(spark, d, "gold_set").select("id", F.size(o).cast("long").alias("n"), F.get(o, F.lit(0)).alias("first"), F.array_contains(o, F.col("gold_answer")).alias("known"), F.array_join(F.array_sort(F.array_distinct(o)), "|").alias("sorted"))


@query("F38_json", "select id, json_extract_string(context, '$.source') as source, json_extract_string(context, '$.note') as note from gold_set")
def f38(spark, d):
    c = F.from_json("context", "source string, note string")
    return t(spark, d, "gold_set").select("id", c["source"].alias("source"), c["note"].alias("note"))


@query("F39_null_functions", "select id, coalesce(author, editor, 'unknown') as name, nullif(script, 'Cyrl') as other_script, author is distinct from editor as differs, greatest(coalesce(length(author), 0), coalesce(length(editor), 0))::bigint as longest from corpus_documents")
def f39(spark, d):
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    return t(spark, d, "corpus_documents").select("id", F.coalesce("author", "editor", F.lit("unknown")).alias("name"), F.nullif("script", F.lit("Cyrl")).alias("other_script"), (~F.col("author").eqNullSafe(F.col("editor"))).alias("differs"), F.greatest(n("author"), n("editor")).cast("long").alias("longest"))


@query("F40_clipping", "select doc_id, case when length(text) > 80 then substr(text, 1, 80) || '…' else text end as clipped from documents")
def f40(spark, d):
    return t(spark, d, "documents").select("doc_id", X.clip("text", 80).alias("clipped"))


@query("F41_group_ids", "select distinct source_id, 'g' || substr(sha256(source_id), 1, 12) as group_id from corpus_documents where source_id is not null")
def f41(spark, d):
    return t(spark, d, "corpus_documents").where("source_id is not null").select("source_id", F.concat(F.lit("g"), F.substring(F.sha2("source_id", 256), 1, 12)).alias("group_id")).distinct()


# ---- stems and aliases


@query("M2_stem_keys")
def m2(spark, d):
    ship(spark)
    return t(spark, d, "parallel_pairs").select("id", RU.stem_key("ru_text").alias("key"))


@query("M3_inflected_search")
def m3(spark, d):
    ship(spark)
    return t(spark, d, "parallel_pairs").where(RU.contains_form(F.col("ru_text"), "кувшинами")).select("id")


@query("M4_alias_resolution")
def m4(spark, d):
    """Aliases of all words of the task prompts from the pairs' words at equal places, in the pairs' order: exact, else by stem."""
    ship(spark)
    both = t(spark, d, "parallel_pairs").select("id", F.posexplode(F.arrays_zip(X.tokens("ru_text").alias("key"), X.tokens("lak_text").alias("alias"))).alias("n", "x"))
    aliases = both.select(F.lit(0).alias("priority"), F.struct("id", "n").alias("ord"), F.col("x")["key"].alias("key"), F.col("x")["alias"].alias("alias")).where("key is not null and alias is not null")
    aliases = aliases.groupBy("priority", "key", "alias").agg(F.min("ord").alias("ord"))  # repeated ones before they are joined
    queries = t(spark, d, "gold_set").select(F.explode(X.tokens("prompt_ru")).alias("query"))
    return RU.resolve(queries, aliases)


# ---- search


Q1_SQL = """with s as (select doc_id, source, lower(translate(lower(coalesce(text, '')), 'ёiіӏ', 'еӀӀӀ')) as x,
  [lower(translate(lower(coalesce(v, '')), 'ёiіӏ', 'еӀӀӀ')) for v in [genre, source, lang, doc_id::varchar]] as meta from documents),
 k as (select doc_id, case when contains(regexp_replace(x, '\\s+', ' ', 'g'), 'горной вечер') then 0
   when list_contains(regexp_split_to_array(x, '[^\\p{L}\\p{N}]+'), 'горной') and list_contains(regexp_split_to_array(x, '[^\\p{L}\\p{N}]+'), 'вечер') then 1 else -1 end as tier,
   case when coalesce(source = 'doma-reader', false) then 1 else 0 end as late from s)
 select doc_id as pos, tier::bigint as tier, late::bigint as late from k where tier >= 0"""


@query("Q1_search", Q1_SQL)
def q1(spark, d):
    found = S.search(records(spark, d), "горной  вечер", last_source="doma-reader", nfkc=False)
    return found.select("pos", F.col("tier").cast("long").alias("tier"), F.col("late").cast("long").alias("late"))


@query("Q1_search_with_aliases")
def q1_aliases(spark, d):
    found = S.search(records(spark, d), "вечер", aliases=["бувну", "цӀусса"], last_source="doma-reader")
    return R.page(found.select("pos", "kind", "tier", "late"), [F.col("late"), F.col("tier"), F.col("pos")], 1, 50)


@query("Q2_senses")
def q2(spark, d):
    return S.senses(records(spark, d), ["бувну", "ва", "ца"], "doma-reader")


@query("Q3_page_with_spans")
def q3(spark, d):
    found = R.page(S.search(records(spark, d), "вечер"), [F.col("late"), F.col("tier"), F.col("pos")], 1, 20)
    return found.select("pos", "tier", S.highlighted(F.col("text"), "вечер").alias("spans"))


@query("Q4_lookup", f"with w as (select source, unnest({TOK.format('text')}) as form from documents where source is not null), f as (select form, count(distinct source) as n from w group by 1 having count(distinct source) >= 2) select 'source' as kind, id as name, (select count(*) from corpus_sources where contains(lower(title), 'tales')) as total from (select id from corpus_sources where contains(lower(title), 'tales') order by title, id limit 3) union all select 'form', form, (select count(*) from f where starts_with(form, 'бу')) from (select form from f where starts_with(form, 'бу') order by n desc, form limit 3)")
def q4(spark, d):
    src = t(spark, d, "corpus_sources").where(F.contains(F.lower("title"), F.lit("tales")))
    forms = S.word_forms(t(spark, d, "documents")).where(F.col("form").startswith("бу"))
    out = []
    for kind, df, name, order in (("source", src, "id", [F.col("title"), F.col("id")]), ("form", forms, "form", [F.desc("sources"), F.col("form")])):
        total = df.agg(F.count("*").alias("total"))
        out.append(df.orderBy(*order).limit(3).select(F.lit(kind).alias("kind"), F.col(name).alias("name")).crossJoin(F.broadcast(total)))
    return out[0].unionByName(out[1])


@query("Q5_word_occurrences", f"with w as (select g.id, unnest({TOK.format('g.text_normalized')}) as form, c.source_id from segments g join corpus_documents c on g.document_id = c.id join corpus_sources s on s.id = c.source_id where coalesce(s.public_search_allowed and s.access_status = 'public' and s.rights_status in ('open_license','public_domain','permission_recorded'), false)) select id, form, source_id from w where starts_with(form, 'бив')")
def q5(spark, d):
    from corvane.plans.sources import chain

    w = chain(spark, d).select("id", "source_id", F.explode(F.filter(F.split(F.lower("text_normalized"), r"[^\p{L}\p{N}]+"), lambda x: x != "")).alias("form"))
    return w.where(F.col("form").startswith("бив")).select("id", "form", "source_id")


@query("Q7_public_facets", "select c.genre, c.script, count(*) as segments, count(distinct c.id) as documents from segments g join corpus_documents c on g.document_id = c.id join corpus_sources s on c.source_id = s.id where coalesce(s.public_search_allowed and s.access_status = 'public' and s.rights_status in ('open_license','public_domain','permission_recorded'), false) group by 1, 2")
def q7(spark, d):
    from corvane.plans.sources import chain

    return chain(spark, d).groupBy("genre", "script").agg(F.count("*").alias("segments"), F.countDistinct("document_id").alias("documents"))


@query("Q8_browse_page", f"with w as (select g.document_id, g.id, unnest({TOK.format('g.text_normalized')}) as form from segments g), n as (select form, count(distinct document_id) as docs from w group by 1), p as (select form, docs from n order by docs desc, case when regexp_matches(form, '^[а-яёӏ]') then 0 else 1 end, form limit 50) select p.form, p.docs, count(*) as occurrences, count(distinct w.id) as segments from p join w on w.form = p.form group by 1, 2")
def q8(spark, d):
    w = t(spark, d, "segments").select("document_id", "id", F.explode(F.filter(F.split(F.lower("text_normalized"), r"[^\p{L}\p{N}]+"), lambda x: x != "")).alias("form"))
    n = w.groupBy("form", "document_id").agg(F.lit(1)).groupBy("form").agg(F.count("*").alias("docs"))
    rank = F.when(F.col("form").rlike("^[а-яёӏ]"), 0).otherwise(1)
    top = n.orderBy(F.desc("docs"), rank, "form").limit(50)  # the page comes first, so the counts are made for its forms only
    return w.join(F.broadcast(top), "form").groupBy("form", "docs").agg(F.count("*").alias("occurrences"), F.countDistinct("id").alias("segments"))


@query("Q9_form_detail", f"with w as (select distinct g.id, g.document_id, unnest({TOK.format('g.text_normalized')}) as form from segments g) select c.source_id, count(*) as segments, count(distinct w.document_id) as documents from w join corpus_documents c on c.id = w.document_id where form = 'бувну' group by 1")
def q9(spark, d):
    w = t(spark, d, "segments").where(F.array_contains(F.split(F.lower("text_normalized"), r"[^\p{L}\p{N}]+"), "бувну")).select("id", "document_id").distinct()
    c = t(spark, d, "corpus_documents").select(F.col("id").alias("document_id"), "source_id")
    return w.join(c, "document_id").groupBy("source_id").agg(F.count("*").alias("segments"), F.countDistinct("document_id").alias("documents"))


@query("Q11_segment_tokens", f"select id, n::bigint as n, form from (select id, unnest(k) as form, generate_subscripts(k, 1) as n from (select distinct id, {TOK.format('text_normalized')} as k from segments where section = 'A'))")
def q11(spark, d):
    k = F.filter(F.split(F.lower("text_normalized"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return t(spark, d, "segments").where("section = 'A'").select("id", k.alias("k")).distinct().select("id", F.posexplode("k").alias("n", "form")).select("id", (F.col("n") + 1).cast("long").alias("n"), "form")


@query("Q13_catalogue", "select s.id, s.title, s.rights_status, count(c.id) as documents from corpus_sources s left join corpus_documents c on c.source_id = s.id where s.access_status = 'public' group by s.id, s.title, s.rights_status order by s.title is null, s.title, s.id limit 25")
def q13(spark, d):
    n = t(spark, d, "corpus_documents").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("documents"))
    s = R.optional(t(spark, d, "corpus_sources"), access_status="public").join(n, "id", "left").select("id", "title", "rights_status", F.coalesce("documents", F.lit(0)).alias("documents"))
    return s.orderBy(F.col("title").isNull(), "title", "id").limit(25)


@query("Q14_form_sources")
def q14(spark, d):
    """Sources of a form with at most three snippets each, the best first."""
    ship(spark)
    docs = t(spark, d, "documents")
    found = S.concordance(docs, "doc_id", "text", "бувну", 5).join(docs.select("doc_id", "source"), "doc_id")
    scored = found.withColumn("quality", S.snippet_quality(F.col("snippet"), "бувну")).where("quality >= 4")
    return R.top_each(scored, ["source"], [F.desc("quality"), F.col("doc_id"), F.col("n")], 3).select("source", "rank", "doc_id", "snippet", "quality")


@query("F31_concordance")
def f31(spark, d):
    ship(spark)
    return S.concordance(t(spark, d, "documents"), "doc_id", "text", "вечер")
