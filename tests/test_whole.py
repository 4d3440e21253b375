"""Queries that must do the whole job: each case fails where a part of the rows is cut off."""

import itertools

from pyspark.sql import functions as F

from corvane.operators import profiles as P
from corvane.plans.exchange import lexicon
from corvane.plans.registry import QUERIES


def folder(spark, path, **tables):
    """Tables (rows, schema) as a data folder."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_large_buckets_are_given_out_whole(spark):
    rows = [(f"i{k}", "t", "small") for k in range(3)] + [(f"j{k:02d}", "t", "big") for k in range(41)] + [("j00", "t", "big"), ("x", "t", None)]
    keys = spark.createDataFrame(rows, "i string, k string, v string")
    got = P.bucket_members(keys, "i", "k", "v").collect()
    assert sorted((r.kind, r.key, r.item, r.representative) for r in got) == [("t", "big", f"j{k:02d}", "j00") for k in range(41)]
    assert P.bucket_pairs(keys, "i", "k", "v", most=None).count() == 3 + 41 * 40 // 2


def test_i2_pairs_and_members_make_all_pairs(spark, tmp_path):
    rows = [(f"s{k:03d}", "d1", "b") for k in range(45)] + [(f"t{k}", "d2", "b") for k in range(4)] + [("u", None, "b")]
    d = folder(spark, tmp_path, segments=(rows, "id string, document_id string, import_batch_id string"))
    pairs = {(r.left, r.right) for r in QUERIES["I2_bucket_pairs"](spark, d).collect()}
    held = {}
    for r in QUERIES["I2_bucket_members"](spark, d).collect():
        held.setdefault(r.key, []).append(r.id)
    pairs |= {p for ids in held.values() for p in itertools.combinations(sorted(ids), 2)}
    assert pairs == {(a, b) for (a, x, _), (b, y, _) in itertools.combinations(sorted(rows[:-1]), 2) if x == y}


def test_i3_scores_a_digest_shared_by_over_40_documents(spark, tmp_path):
    docs = [f"d{k:02d}" for k in range(45)]
    text = "one two three four five six seven eight"
    d = folder(
        spark,
        tmp_path,
        segments=([(f"s{x}", x, text, 0, None) for x in docs], "id string, document_id string, text_original string, ordinal int, imported_at string"),
        corpus_documents=([(x, None, None) for x in docs], "id string, source_id string, title string"),
    )
    got = {(r.left, r.right): r.relation for r in QUERIES["I3_scored_pairs"](spark, d).collect()}
    assert got == {p: "duplicate" for p in itertools.combinations(docs, 2)}


PAIRS = "id string, source_type string, ru_text string, lak_text string"


def test_all_words_of_a_pair_are_forms(spark, tmp_path):
    words = ["барз", "бур", "махъ", "ца", "хъинну", "бувну", "ва"]
    d = folder(spark, tmp_path, parallel_pairs=([("p1", "lesson", "кувшин", " ".join(words)), ("p2", "book", "дом", "къатта"), ("p3", "book", None, None)], PAIRS))
    assert {r.weight: r.n for r in QUERIES["E7_terms"](spark, d).collect()} == {100: 2, 88: 6, 70: 2}
    got = {(r.form, r.lemma) for r in QUERIES["E8_form_relations"](spark, d).collect()}
    assert got == {(w, "барз") for w in words} | {("къатта", "къатта")}
    assert [(r.word, r.match_level) for r in QUERIES["Q6_dictionary_search"](spark, d).collect()] == [("барз", 2)]
    terms = {r.term for r in lexicon(spark, d)["terms"].collect()}
    assert set(words) | {"къатта", "кувшин", "дом"} == terms


def test_w2_keeps_units_up_to_40000_characters(spark, tmp_path):
    rows = [("a", f"a{k:03d}", k, "h", "x" * 1000) for k in range(60)] + [("b", f"b{k:03d}", k, "h", "x") for k in range(130)] + [("c", "c0", 0, "h", "x" * 50_000), ("c", "c1", 1, "h", "x"), ("d", "d0", 0, "h", None)]
    d = folder(spark, tmp_path, segments=(rows, "document_id string, id string, ordinal int, content_hash string, text_original string"))
    got = {tuple(r) for r in QUERIES["W2_running_length_whole"](spark, d).collect()}
    assert got == {("a", f"a{k:03d}") for k in range(40)} | {("b", f"b{k:03d}") for k in range(120)} | {("c", "c0"), ("d", "d0")}


def test_aliases_of_several_words_are_found(spark, tmp_path):
    segments = [("s1", "Барз бур хъинну."), ("s2", "бур барз"), ("s3", "барз, бур"), ("s3", "барз, бур"), ("s4", "абарз бур"), ("s5", None), ("s6", "къатта-бур")]
    gold = [("t1", "барз бур", 0.5), ("t2", "Барз", 0.5), ("t3", "къатта-бур", 0.5), ("t4", "барз нет", 0.5), ("t5", None, 0.5), ("t6", "...", 0.5)]
    d = folder(spark, tmp_path, segments=(segments, "id string, text_normalized string"), gold_set=(gold, "id string, lak_text string, priority double"))
    assert {(r.form, r.segments) for r in QUERIES["J18_alias_containment_whole"](spark, d).collect()} == {("барз бур", 2), ("барз", 3), ("къатта-бур", 1)}
    got = {r.task_id: (r.examples, r.score) for r in QUERIES["E10_task_examples_whole"](spark, d).collect()}
    assert got == {"t1": ("s1|s3", 8), "t2": ("s1|s2|s3", 9), "t3": ("s6", 6)}


def test_j2_joins_terms_to_entries_sources_senses_and_forms(spark, tmp_path):
    pairs = [("p1", "s1", "1. слово 2. речь", "махъ бур"), ("p2", "none", None, "барз"), ("p3", "s1", "x", None)]
    d = folder(spark, tmp_path, parallel_pairs=(pairs, PAIRS), corpus_sources=([("s1", "Title"), ("s2", "Other")], "id string, title string"))
    got = {(r.term, r.weight, r.word, r.source_title, tuple(r.senses), tuple(r.forms)) for r in QUERIES["J2_dictionary_terms"](spark, d).collect()}
    rest = ("махъ", "Title", ("слово", "речь"), ("бур", "махъ"))
    assert got == {(t, w, *rest) for t, w in (("махъ", 100), ("бур", 88), ("слово", 70), ("речь", 70))} | {("барз", 100, "барз", None, (), ("барз",))}


def test_e4_takes_senses_brackets_and_dashes(spark, tmp_path):
    pairs = [("p1", "s", "1. слово (уст.), речь 2. обещание", "x"), ("p2", "s", "дом — большой дом", "x"), ("p3", "s", "[разг.] луна", "x"), ("p4", "s", "пить — пить воду 2) есть", "x"), ("p5", "s", None, "x")]
    d = folder(spark, tmp_path, parallel_pairs=(pairs, PAIRS))
    got = {(r.id, r.candidate) for r in QUERIES["E4_sense_candidates"](spark, d).collect()}
    assert got == {("p1", "слово"), ("p1", "речь"), ("p1", "обещание"), ("p2", "дом"), ("p3", "луна"), ("p4", "пить"), ("p4", "есть")}


def test_evidence_is_typed_isolated_and_ordered(spark):
    from corvane.operators import evidence as E

    pair = lambda i, ru, lak, status="pending", split=None, source="book": (i, ru, lak, status, split, source)
    rows = [pair("a", "Старый дом", "къатта", "approved"), pair("b", "дом", "къат"), pair("c", "у дома дом", "x", source="archive"), pair("d", "дом и сад", None), pair("e", "дом", "held", "approved", "test"), pair("f", "чужой дом", " HELD ", "approved"), pair("g", "домик", "y"), pair("a", "Старый дом", "къатта", "approved"), pair("h", None, None)]
    pairs = spark.createDataFrame(rows, "id string, ru_text string, lak_text string, status string, split string, source_type string").withColumn("class", F.lit("clash")).withColumn("query", F.lit(1))
    queries = spark.createDataFrame([("Дом ",), ("дом",), (None,), ("",), ("?!",), ("нет такого",)], "query string")
    got = E.gathered(queries, pairs)
    # a held-out item and what repeats one of its sides are gone: e, f and b, whose Russian side is e's
    assert {(r.query, r.pair_id): (r["class"], r.can_propose, r.gold) for r in got.collect()} == {("дом", "a"): ("approved_parallel_pair", True, True), ("дом", "c"): ("attested_public_example", True, False), ("дом", "d"): ("usage_support_only", False, False)}
    assert [r.pair_id for r in E.ordered(got, 2, True).orderBy("rank").collect()] == ["a", "c"]
    assert {r.query: r["class"] for r in E.run_classes(queries, got).collect()} == {"дом": "approved_parallel_pair", "?!": "none", "нет такого": "none"}
    assert E.gathered(queries.limit(0), pairs).count() == E.gathered(queries, pairs.limit(0)).count() == 0


def test_labels_and_editions(spark):
    from corvane.operators import lexicon as L

    rows = ["м., мн. дом, изба", "прил. старый", "гл. сов. идти", "совет дома", "числит. два", None, ""]
    got = [(r.p, r.w) for r in spark.createDataFrame(list(enumerate(rows)), "n int, x string").orderBy("n").select(L.part_of_speech(F.col("x")).alias("p"), L.without_labels(F.col("x")).alias("w")).collect()]
    assert got == [("N", "дом, изба"), ("ADJ", "старый"), ("V", "идти"), (None, "совет дома"), ("NUM", "два"), (None, None), (None, "")]
    titles = ["war-1a-final-copy", "war-1a", "tales", "2020", "songs-ru-1999"]
    e = [tuple(r.e) for r in spark.createDataFrame(list(enumerate(titles)), "n int, x string").orderBy("n").select(L.editions(F.col("x")).alias("e")).collect()]
    assert e == [("war-1a-final-copy", "war-1", "war", ["copy", "final", "edition-letter"]), ("war-1a", "war-1", "war", ["edition-letter"]), ("tales", "tales", "tales", []), ("2020", "2020", "2020", []), ("songs-ru-1999", "songs", "songs", ["1999", "ru"])]


def test_queries_that_find_nothing_in_the_test_tables(spark, tmp_path):
    d = folder(
        spark,
        tmp_path,
        segments=([("s1", "0" * 40, "d", 1), ("s1", "1" * 40, "d", 1), ("s2", "short", None, -1), ("s3", None, "d", None)], "id string, content_hash string, document_id string, ordinal int"),
        gold_set=([("g1", " Къатта "), ("g2", None), ("g3", "x")], "id string, lak_text string"),
        parallel_pairs=([("p2", "къатта", "approved"), ("p1", "КЪАТТА", "approved"), ("p3", "x", "pending")], "id string, lak_text string, status string"),
        pair_adjudications=([("p1",), ("lost",), ("lost",), (None,)], "pair_id string"),
        validation_votes=([("g1",), ("gone",)], "task_id string"),
    )
    rows = lambda name: {tuple(r) for r in QUERIES[name](spark, d).collect()}
    assert rows("E12_conflicting_hashes") == {("s1", 2)}
    assert rows("E9_bundle_rules") == {("s2", "digest"), ("s2", "document"), ("s2", "ordinal"), ("s3", "digest"), ("s3", "ordinal")}
    assert rows("E11_referential") == {("pair", "lost", 2), ("pair", None, 1), ("task", "gone", 1)}
    assert rows("B6_exact_memory") == {("g1", "p1")}
