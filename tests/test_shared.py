"""Retrieval by shared words: the SQL's rows on crowded and on odd tables, without a shuffled row for each pair of texts that share a word."""

import random
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corvane.operators import shared
from corvane.plans.registry import ORACLE, QUERIES

NAMES = ["B1_evidence_retrieval", "B8_evidence_classes", "L8_evidence_order", "B2_reverse_retrieval", "B9_coverage", "Q15_evidence_bundles"]
GOLD = pa.schema([("id", pa.string()), ("prompt_ru", pa.string()), ("lak_text", pa.string())])
PAIRS = pa.schema([("id", pa.string()), ("ru_text", pa.string()), ("lak_text", pa.string()), ("provenance", pa.string()), ("split", pa.string())])


def _same(spark, at, name, gold, pairs):
    pq.write_table(pa.Table.from_pylist(gold, GOLD), at / "gold_set.parquet")
    pq.write_table(pa.Table.from_pylist(pairs, PAIRS), at / "parallel_pairs.parquet")
    with duckdb.connect() as c:
        for t in ("gold_set", "parallel_pairs"):
            c.execute(f"create view {t} as from read_parquet('{at}/{t}.parquet')")
        want = c.execute(ORACLE[name]).fetchall()
    return Counter(map(tuple, QUERIES[name](spark, str(at)).collect())) == Counter(want) and len(want) > 0


def _shuffled(spark):
    """Records that the session's stages wrote for a shuffle so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.mark.parametrize("name", NAMES)
def test_frequent_words_make_no_rows(spark, tmp_path, name):
    gold = [dict(id=f"t{k}", prompt_ru=f"и слово{k % 40}", lak_text=f"ва махъ{k % 40}") for k in range(400)]
    pairs = [dict(id=f"p{k}", ru_text=f"И, слово{k % 97}!", lak_text=f"Ва махъ{k % 97}", provenance=["human", "x", None][k % 3], split=["train", "test"][k % 50 == 0]) for k in range(1500)]
    before = _shuffled(spark)
    assert _same(spark, tmp_path, name, gold, pairs)
    assert _shuffled(spark) - before < 20_000  # 600,000 pairs share a word


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables(spark, tmp_path, monkeypatch, name):
    """Repeated and null ids, null, empty and wordless texts; several blocks of texts and slices of queries."""
    monkeypatch.setattr(shared, "BLOCK", 200)
    monkeypatch.setattr(shared, "WORTH", 20)
    r = random.Random(3)
    some = lambda n: None if r.random() < 0.05 else f"i{r.randrange(n)}"
    text = lambda n: r.choice([None, "", " ?!"]) if r.random() < 0.08 else " ".join(r.choice("абвгдежзик") for _ in range(r.randint(1, n)))
    gold = [dict(id=some(30), prompt_ru=text(4), lak_text=text(4)) for _ in range(40)]
    pairs = [dict(id=some(60), ru_text=text(6), lak_text=text(3), provenance=r.choice(["human", "x", None]), split=r.choice(["test", "train", "train", None])) for _ in range(80)]
    assert _same(spark, tmp_path, name, gold, pairs)
