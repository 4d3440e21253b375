"""Core functions and operators against hand expectations, brute force and properties."""

import datetime
import itertools
import json
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corvane.functions import russian as RU, text as X
from corvane.operators import lexicon as L, profiles as P, relational as R, search as S
from corvane.operators.graph import components
from corvane.plans.registry import QUERIES
from corvane.sources import files
from corvane.streaming import ingest

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


# ---- text


def test_search_form(spark):
    assert X.norm_query("  где   ты  ") == "где ты" and X.norm_query("ЁЖ") == "еж"
    assert one(spark, X.norm("t"), t="ЁЖ Ｉ чIал") == X.norm_query("ЁЖ Ｉ чIал")
    assert one(spark, X.tokens("t"), t="Где ты живешь? (ж.)") == ["где", "ты", "живешь", "ж"]
    assert one(spark, X.tokens("t"), t=None) == [] and X.query_tokens("") == []


@pytest.mark.parametrize("text, q, tier", [("Где ты живешь?", "где ты", 0), ("Где ты живешь?", "ты где", 1), ("Где он живет?", "ты где", -1), ("Тыква где-то там", "ты где", -1), ("Тыква", "ты", 0), (None, "ты", -1), ("ты", "", -1)])
def test_field_tier(spark, text, q, tier):
    assert one(spark, X.field_tier("t", X.norm_query(q), X.query_tokens(q)), t=text) == tier


def test_store_form_and_spellings(spark):
    assert one(spark, X.lak_form("t"), t=" ХАНИЧА ") == "ханича"
    assert one(spark, X.lak_form("t"), t="дакI") == one(spark, X.lak_form("t"), t="дак1") == "дакӀ"
    got = one(spark, X.lak_variants("t"), t="дакI")
    assert len(got) == len(set(got)) <= 9 and {"дакӀ", "дакӏ", "дак1"} <= set(got)


def test_hashes_and_shapes(spark):
    h = 0
    for ch in "мах ъ1":
        h = (h * 31 + ord(ch)) % 2**32
    assert one(spark, X.rolling_hash("t"), t="мах ъ1") == h
    assert one(spark, X.slug("t"), t="Étude № 5 — Война") == "etude-no-5-воина"
    assert one(spark, X.script_of("t"), t="мир world") == "mixed" and one(spark, X.script_of("t"), t=None) == "unknown"
    assert one(spark, X.clip("t", 3), t="abcd") == "abc…" and one(spark, X.clip("t", 4), t="abcd") == "abcd"
    assert len(one(spark, X.sentences("t"), t="Один. Два! Три? Четыре")) == 4 and one(spark, X.sentences("t"), t="  ") == []
    assert one(spark, X.number_tokens("t"), t="12345 и 6") == ["1234", "5", "6"]
    assert one(spark, X.shingle_sketch(F.col("t")), t=["a", "b", "c", "d"]) == [] and len(one(spark, X.shingle_sketch(F.col("t")), t=list("abcdefg"))) == 3


def test_normal_form_short_cut_is_right(spark):
    texts = ["plain", "мир «так» — ё й", "ﬁ ½ Ｉ", "й", "…№²", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    import unicodedata

    for form in ("NFC", "NFKC", "NFD", "NFKD"):
        for r in df.select("t", X.normal_form("t", form).alias("x")).collect():
            assert r.x == (None if r.t is None else unicodedata.normalize(form, r.t))


# ---- inflection


def test_stems():
    assert len({RU.stem(w) for w in ("слово", "слова", "слову", "словом", "словами", "словах")}) == 1
    assert RU.stem("дом") == "дом" and RU.stem("") == "" and RU.stem("abcd") == "abcd"
    assert RU.stem("ёлками") == RU.stem("елка") and RU.key_of("В 5 лесах!") == f"в {RU.stem('лесах')}"


def test_inflected_containment_and_aliases(spark):
    text = "Значение слова приводится в словаре."
    assert one(spark, RU.contains_form(F.col("t"), "словами"), t=text) and not one(spark, RU.contains_form(F.col("t"), "123"), t=text)
    aliases = spark.createDataFrame([(0, "слово", 0, "махъ"), (1, "слово", 0, "другой"), (1, "слова", 1, "калима"), (0, None, 0, "x")], "priority int, key string, ord int, alias string")
    q = spark.createDataFrame([("слово",), ("словами",), ("нет",), (None,), ("слово",)], "query string")
    got = {(r.query, r.alias, r.place, r.match) for r in RU.resolve(q, aliases).collect()}
    assert got == {("слово", "махъ", 1, "exact"), ("словами", "махъ", 1, "inflection"), ("словами", "другой", 2, "inflection"), ("словами", "калима", 3, "inflection")}
    many = [(k // 3_000_000, "слово", k % 3_000_000, f"a{k}") for k in (2, 1_500_000, 3_000_001)]  # places of a million and more
    got = [r.alias for r in RU.resolve(q.where("query = 'словами'"), spark.createDataFrame(many, "priority int, key string, ord int, alias string")).orderBy("place").collect()]
    assert got == ["a2", "a1500000", "a3000001"]


# ---- search


RECORDS = "kind string, text string, gloss string, source string, variety string, record_id string, alt_text string, translation_en string, pos long"


def _records(spark):
    rows = [("text", "где ты живешь", "g1", "new"), ("text", "ты и где", "g2", "new"), ("lexicon", "барз", "луна", "new"), ("lexicon", "барз бур", "луна", "old"), ("text", "барз бур", None, "old"), ("text", None, "где ты", None)]
    return spark.createDataFrame([(k, t, g, s, "std", f"r{n}", None, None, n) for n, (k, t, g, s) in enumerate(rows)], RECORDS)


def test_search_tiers_order_and_aliases(spark):
    r = _records(spark)
    got = [(x.pos, x.tier) for x in S.search(r, "где ты").orderBy("tier", "pos").collect()]
    assert got == [(0, 0), (5, 0), (1, 1)]
    swapped = {x.pos for x in S.search(r, "ты  ГДЕ").collect()}
    assert swapped == {0, 1, 5}  # word order changes tiers, not the set
    assert [x.pos for x in S.search(r, "луна", aliases=["барз"], last_source="old").orderBy("late", "tier", "pos").collect()] == [4]
    assert {x.pos for x in S.search(r, "луна", aliases=["барз"], kind="lexicon").collect()} == {2, 3}
    assert S.search(r, "").count() == 6 and S.search(r.limit(0), "где").count() == 0
    assert [(x.late, x.gloss) for x in S.senses(r, ["барз"], "old").orderBy("late").collect()] == [(False, "луна"), (True, "луна")]


def test_spans():
    assert S.highlight("Где ты живешь?", "где ты", ["где", "ты"], []) == [(0, 6)]
    assert S.highlight("барз бур", "луна", ["луна"], ["барз"]) == [(0, 4)]
    assert S.highlight("барзы", "луна", ["луна"], ["барз"]) == [] and S.highlight(None, "x", ["x"], []) == []
    assert S.spans_of("аа аа", ["а"], False) == [(0, 2), (3, 5)]


def test_pages_are_a_prefix(spark):
    df = spark.range(95)
    pages = [[r.id for r in R.page(df, [F.col("id")], n, 30).collect()] for n in (1, 2, 3, 4)]
    assert sum(pages, []) == list(range(95)) and R.page(df, [F.col("id")], 99, 30).count() == 5 and R.page(df, [F.col("id")], 99, 30, clamp=False).count() == 0


def test_word_forms_need_two_sources(spark):
    df = spark.createDataFrame([("a", "x y x"), ("b", "x"), ("a", None), (None, "y"), ("b", "")], "source string, text string")
    got = {r.form: (r.sources, r.occurrences, r.confidence) for r in S.word_forms(df).collect()}
    assert got == {"x": (2, 3, "low")}
    for r in QUERIES["A7_wordform_index"](spark, SF).collect():
        assert r.occurrences >= r.sources >= 2


def test_windows():
    text = "начало " * 30 + "вечер был тих. " + "конец " * 40
    (w,) = S.windows(text, "вечер")
    assert w.startswith("… начало") and w.endswith("конец …") and " вечер " in w
    assert S.windows("вечером", "вечер") == [] and S.windows(None, "x") == [] and S.windows("x", "") == []


# ---- relations


@settings(max_examples=8, deadline=None)
@given(edges=st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_against_brute_force(spark, edges):
    parent = list(range(31))

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").coalesce(2)).collect()}
    assert got == {n: find(n) for e in edges for n in e}


def test_a_chain_is_one_component(spark):
    got = components(spark.createDataFrame([(k, k + 1) for k in range(300)] + [(None, 5)], "a long, b long").coalesce(2))
    assert got.count() == 301 and got.select("component").distinct().count() == 1


def test_latest_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", "k"), (2, "b", None), (3, None, "z")], "id int, x string, y string")
    new = spark.createDataFrame([(2, "b", "n"), (3, "c", "n"), (4, None, "n")], "id int, x string, y string")
    got = {(r.id, r.x, r.y, r.change) for r in R.upsert(old, new, "id", ["x"], ["y"]).collect()}
    assert got == {(1, "a", "k", "kept"), (2, "b", None, "same"), (3, "c", "z", "refreshed"), (4, None, "n", "inserted")}
    twice = new.unionByName(new)
    assert [r.id for r in R.insert_new(old, twice, ["id"], [F.col("x")]).collect()] == [4]
    assert R.latest(old.limit(0), ["id"], [F.col("x")]).count() == 0


def test_streaks_bursts_and_reliability(spark):
    day = lambda n: datetime.datetime(2024, 1, n, 12)
    df = spark.createDataFrame([("u", day(n)) for n in (1, 2, 2, 3, 7)] + [("v", None)], "k string, t timestamp")
    assert {(r.k, r.days) for r in R.streaks(df, "k", "t").collect()} == {("u", 3), ("u", 1)}
    e = spark.createDataFrame([("u", k, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=40 * k)) for k in range(12)], "k string, n int, t timestamp")
    got = {r.n: (r.recent, r.since) for r in R.bursts(e, "k", "t", 300, "n").collect()}
    assert got[0] == (0, None) and got[3] == (3, 40.0) and got[11] == (7, 40.0)
    rng = random.Random(9)
    many = [(rng.choice("uv"), k, rng.randint(0, 40_000)) for k in range(600)]
    e = spark.createDataFrame([(k, n, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)) for k, n, s in many] + [(None, 900, None)], "k string, n int, t timestamp")
    got = {r.n: (r.recent, r.since) for r in R.bursts(e, "k", "t", 300, "n").collect()}
    for k, n, s in many:
        prior = [x for j, m, x in many if j == k and (x, m) < (s, n)]
        assert got[n] == (sum(j == k and s - 300 <= x <= s and m != n for j, m, x in many), s - max(prior) if prior else None)
    assert got[900] == (None, None)
    v = spark.createDataFrame([("u", k, 1.0, 1.0) for k in range(150)], "k string, n int, o double, w double")
    r = R.reliability(v, "k", [F.desc("n")], "o", "w").first()
    assert r.n == 100 and r.score == 0.976


def test_rules_facets_and_overlaps(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), (None, 3)], "k string, n int")
    assert {(r.row_key, r.rule) for r in R.violations(df, "k", {"positive": F.col("n") > 0, "named": F.col("k").isNotNull()}).collect()} == {("b", "positive"), (None, "named")}
    assert {(r.facet, r.value, r.n) for r in R.facets(df, "k", "n").collect()} == {("k", "a", 1), ("k", "b", 1), ("n", "1", 1), ("n", "3", 1)}
    w = spark.createDataFrame([("x", "s1")] * 3 + [("x", "s2")] * 2 + [("y", "s2"), (None, "s1")], "f string, s string")
    assert [tuple(r) for r in R.overlap_counts(w, "f", "s").collect()] == [("s1", "s2", 1, 6)]
    kept = R.facet_filter(df, {"k": ("a",)}, k="zzz", n=5)
    assert kept.count() == 3  # a value outside the vocabulary and a column without one are ignored


# ---- profiles and alignment


def test_bucket_pairs_and_scores(spark):
    rows = [(f"i{k}", "t", "small") for k in range(3)] + [(f"j{k:02d}", "t", "big") for k in range(41)] + [("i0", "u", "again"), ("i1", "u", "again"), ("i0", "t", None)]
    got = {(r.left, r.right): r.kinds for r in P.bucket_pairs(spark.createDataFrame(rows, "i string, k string, v string"), "i", "k", "v").collect()}
    assert got == {("i0", "i1"): ["t", "u"], ("i0", "i2"): ["t"], ("i1", "i2"): ["t"]}
    units = spark.createDataFrame([(s, n, f"слово номер {n} и ещё много других слов тут" if s != "c" else "anders") for s in "abc" for n in range(30)], "s string, n int, t string")
    p = P.profiles(units, "s", "t", ["n"])
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "left string, right string")
    (r,) = P.score_pairs(pairs, p).collect()
    assert (r.left, r.right, r.relation) == ("a", "b", "duplicate") and r.confidence <= 0.99


def test_alignment():
    left, right = ["Раз два три.", "Четыре 44 пять.", "Шесть."], ["One two three.", "Four 44 five.", "Six."]
    got = P.align(left, right)
    assert [(a, b) for a, b, _ in got] == [([0], [0]), ([1], [1]), ([2], [2])] and P.align(left, right) == got
    cover = P.align(["a" * 10] * 4, ["b" * 12])
    assert sorted(k for a, _, _ in cover for k in a) == [0, 1, 2, 3] and any(not (a and b) for a, b, _ in cover)
    assert P.align([], []) == [] and P.align(["x"], []) == [([0], [], 0.1)] and P.align([None], [""])[0][:2] == ([0], [0])
    rows = P.align_hierarchy(["Heading", "A text.", "Second", "More text."], ["Kopf", "Ein Text.", "Zwei", "Mehr Text."])
    assert sum(r["level"] == "section" for r in rows) == 2
    assert P.sections([]) == [] and [len(s) for s in P.sections(["A text."] * 25)] == [10, 10, 5]


def _forward(left, right):
    """Alignment by filling cells forward: a cell is replaced only by a cheaper arrival."""
    ratio = (sum(map(len, left)) or 1) / (sum(map(len, right)) or 1)
    best, came = {(0, 0): 0.0}, {}
    for i in range(len(left) + 1):
        for j in range(len(right) + 1):
            for a, b in ((1, 1), (1, 2), (2, 1), (1, 0), (0, 1)):
                if i + a <= len(left) and j + b <= len(right):
                    n, m = max(1, len(" ".join(left[i : i + a]))), max(1, len(" ".join(right[j : j + b])))
                    cost = 0.9 if not (a and b) else abs(n - m * ratio) / max(n, m * ratio) + (0.3 if a + b > 2 else 0)
                    if best[i, j] + cost < best.get((i + a, j + b), 9e9) - 1e-12:
                        best[i + a, j + b], came[i + a, j + b] = best[i, j] + cost, (a, b)
    i, j, out = len(left), len(right), []
    while i or j:
        a, b = came[i, j]
        i, j = i - a, j - b
        out.append((list(range(i, i + a)), list(range(j, j + b))))
    return out[::-1]


def test_alignment_resolves_ties_by_arrival():
    rng = random.Random(5)
    cases = [([4, 4], [9, 4, 9])] + [([rng.choice((3, 4, 9)) for _ in range(rng.randint(1, 5))], [rng.choice((3, 4, 9)) for _ in range(rng.randint(1, 5))]) for _ in range(1500)]
    for a, b in cases:
        left, right = ["x" * n for n in a], ["y" * n for n in b]
        assert [r[:2] for r in P.align(left, right)] == _forward(left, right), (a, b)


def test_spans_cover_matches():
    assert S.spans_of("Ёлка, елка и ёлки", ["елка"], True) == [(0, 4), (6, 10)]
    assert S.spans_of("abcd", ["ab", "bc", "cd"], False) == [(0, 4)] and S.spans_of("abab", ["ab"], False) == [(0, 4)]
    assert S.spans_of("кӀура КIУРА", [X.norm_query("кӀура")], True) == [(0, 5), (6, 11)]
    assert S.spans_of(None, ["a"], True) == S.spans_of("", [""], False) == S.spans_of("aa", ["a"], True) == []
    assert S.spans_of("ﬁne", [X.norm_query("fi")], False) == [(0, 1)]


def test_family_keys(spark):
    paths = ("books/Chronicle-1.txt", "books/Chronicle-1a.txt", "x/Chronicle_final.pdf")
    assert {one(spark, P.family(F.col("t")), t=t) for t in paths} == {"title:chronicle"}
    assert one(spark, P.family(F.col("t")), t="War/scan-3.pdf") == "folder:war" and one(spark, P.family(F.col("t")), t="7.pdf") == "path:7.pdf"


# ---- dictionary


def test_dictionary_synthesis(spark):
    rows = [("s", "1", "махъ II", "1. слово, речь; 2. обещание", "-рал, -рану, махъру"), ("s", "1", "махъ II", "1. слово, речь; 2. обещание", "-рал, -рану, махъру"), ("s", "2", None, "x", None), ("s", "3", "барз", None, None)]
    d = L.synthesize(spark.createDataFrame(rows, "source_id string, ref string, headword string, gloss string, forms string"))
    e = {r.word: r for r in d["entries"].collect()}
    assert set(e) == {"махъ", "барз"} and e["махъ"].homonym == 2 and e["барз"].homonym is None
    assert [r.sense for r in d["senses"].orderBy("n").collect()] == ["слово, речь;", "обещание"]
    assert {r.form for r in d["forms"].collect()} == {"махъ", "махърал", "махърану", "махъру", "барз"}
    t = {r.term: r.weight for r in d["terms"].collect()}
    assert t["махъ"] == 100 and t["махърал"] == 88 and t["слово"] == 70 and t["обещание"] == 70
    found = L.lookup(d["terms"], d["entries"], "реч").collect()
    assert [(r.word, r.match_level) for r in found] == [("махъ", 1)]


def test_relations(spark):
    forms = spark.createDataFrame([("e", "a"), ("e", "b"), ("f", "c")], "entry_id string, form string")
    links = spark.createDataFrame([("e", "whole", "a", "L", []), ("f", "other", "c", "M", ["pl"]), ("f", "other", "zz", "N", None)], "entry_id string, source string, form string, lemma string, features array<string>")
    assert {(r.form, r.lemma) for r in L.relations(forms, links, "whole").collect()} == {("a", "L"), ("b", "L"), ("c", "M")}


# ---- files and streams


def test_jsonl_rules(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n{bad\n', encoding="utf-8")
    good, bad = files.read_jsonl(spark, str(tmp_path / "in.jsonl"), "a long, b string", ("a", "b"))
    assert [tuple(r) for r in good.collect()] == [(1, "x")]
    assert {r.reason for r in bad.collect()} == {"missing b", "no JSON"}


def test_lines_and_pages(spark):
    df = spark.createDataFrame([('say "hi"', None, "a\tb\r\nc")], "x string, y string, z string")
    assert files.csv_lines(df).first().line == '"say ""hi""","","a\tb\r\nc"'
    assert files.tsv_lines(df).first().line == 'say "hi"\t\ta b  c'
    page = '<script>var STATS = {"n": 1}; const DATA = [[1, "x;y"], [2, "z"]];</script>'
    assert json.loads(one(spark, files.embedded_json(F.col("t"), "DATA"), t=page)) == [[1, "x;y"], [2, "z"]]
    assert one(spark, files.embedded_json(F.col("t"), "NONE"), t=page) is None


def test_overlay_fails_closed(spark):
    base = spark.createDataFrame([("a",), ("b",)], "k string")
    extra = spark.createDataFrame([("a", 1)], "k string, v int")
    assert {(r.k, r.v) for r in files.overlay(base, extra, "k", ["v"], 1).collect()} == {("a", 1), ("b", None)}
    for wrong in (extra.unionByName(extra), spark.createDataFrame([("z", 1)], "k string, v int")):
        with pytest.raises(ValueError):
            files.overlay(base, wrong, "k", ["v"])


def test_resumed_ingest_equals_one_run(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randint(1, 60), f"t{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "id int, t string")
    src = str(tmp_path / "in")
    df.limit(120).repartition(3).write.parquet(src)
    run = lambda: ingest.ingest(ingest.stream(spark, src, df.schema, files=1), str(tmp_path / "out"), str(tmp_path / "state"), ["id"])
    run()
    df.subtract(df.limit(120)).write.mode("append").parquet(src)
    run()
    run()
    got = [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted({i for i, _ in rows})


def test_sessions(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    df = spark.createDataFrame([("u", at(m)) for m in (0, 10, 20, 90)] + [("end", at(9000))], "k string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("end", at(99000))], "k string, ts timestamp").write.mode("append").parquet(str(tmp_path / "in2"))
    for part in ("in", "in*"):
        s = ingest.sessions(ingest.stream(spark, str(tmp_path / part), df.schema), "ts", "k")
        out = ingest.run_to_table(s, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.n for r in out.where("k = 'u'").collect()) == [1, 3]


# ---- all queries against their SQL


def test_queries_equal_their_sql(spark):
    import glob
    import os

    import duckdb

    from corvane.plans.registry import ORACLE

    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")

    def canon(v):
        if v is None or v != v:
            return None
        return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)

    wrong = []
    for name, f in QUERIES.items():
        df = f(spark, SF)
        columns = sorted(df.columns)
        got = sorted(map(repr, (tuple(canon(r[c]) for c in columns) for r in df.collect())))
        if name in ORACLE:
            rel = db.execute(ORACLE[name])
            names = [c[0] for c in rel.description]
            want = sorted(map(repr, (tuple(canon(dict(zip(names, r))[c]) for c in columns) for r in rel.fetchall())))
            if sorted(names) != columns or got != want:
                wrong.append(name)
    assert not wrong


def test_facet_sums_are_the_total(spark):
    n = sum(r.n for r in QUERIES["A1_facet_counts"](spark, SF).where("facet = 'genre'").collect())
    assert n == spark.read.parquet(f"{SF}/documents.parquet").where("genre is not null").count()


def test_pair_keys_do_not_depend_on_order(spark):
    rows = [(f"i{k}", "t", f"v{k // 3}") for k in range(12)]
    for p in itertools.islice(itertools.permutations(rows), 0, 3):
        got = P.bucket_pairs(spark.createDataFrame(list(p), "i string, k string, v string"), "i", "k", "v")
        assert all(r.left < r.right for r in got.collect()) and got.count() == 12
