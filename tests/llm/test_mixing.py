import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from textgate.llm import mixing
from tests.llm.conftest import SCHEMA, prose, row


@pytest.fixture(scope="module")
def uneven(spark):
    rows = [row(i, prose(i, 30 + i % 50), source="hot" if i % 2 else f"s{i % 10}") for i in range(400)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def weights(found):
    return {r.source: r.weight for r in found.select("source", "weight").distinct().collect()}


def test_repetition_limit(uneven):
    found = mixing.mix(uneven, repeat_limit=2.0, block_tokens=500)
    uses = Counter(r.doc_id for r in found.select("row.doc_id").collect())
    assert set(uses) == set(range(400)) and set(uses.values()) == {1, 2}
    used = {r.source: r.t for r in found.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    total, w = sum(used.values()), weights(found)
    assert sum(w.values()) == pytest.approx(1) and all(abs(used[s] / total - w[s]) < 0.02 for s in w)


def test_entropy_against_bisection(uneven):
    own = {r.source: r.n for r in uneven.groupBy("source").agg(F.sum(mixing.tokens(F.col("text"))).alias("n")).collect()}
    total = sum(own.values())

    def entropy(a):
        x = {s: (n / total) ** a for s, n in own.items()}
        z = sum(x.values())
        return -sum(v / z * math.log(v / z) for v in x.values()), {s: v / z for s, v in x.items()}

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid)[0] >= 1.6 else (low, mid)
    found = weights(mixing.mix(uneven, repeat_limit=None, target_entropy=1.6))
    assert found == pytest.approx(entropy(low)[1], abs=1e-6)


def test_budget_takes_permuted_rows_once(uneven):
    found = mixing.mix(uneven, repeat_limit=None, target_entropy=1.5, budget=3000.0, block_tokens=300).collect()
    spent = defaultdict(int)
    for r in found:
        spent[r.source] += r.n_tokens
    assert max(Counter(r.row.doc_id for r in found).values()) == 1
    for r in found:
        assert spent[r.source] <= r.weight * 3000 + 1e-6 and spent[r.source] > r.weight * 3000 - 80 and 0 <= r.position <= 1


def test_odd_rows(odd, odd_rows, none):
    found = mixing.mixed(odd)
    assert found.columns == odd.columns
    assert {str(r.doc_id) for r in found.collect()} == {str(r[0]) for r in odd_rows} and found.count() >= len(odd_rows)
    assert mixing.mixed(none).count() == 0
    assert mixing.mixed(odd.where("source = 'c'")).count() == 1


def test_tokens_of_scripts_without_blanks(spark):
    texts = {"": 1, " \t ": 1, "a b  c": 3, "中文": 2, "中文 ab 字": 4, "ab中cd": 3, "ภาษา ไทย": 7, "ひら カナ": 4, "한국어 말": 2, "x": 1}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.n for r in df.select("text", mixing.tokens(F.col("text")).alias("n")).collect()} == texts


def test_stretches_of_blocks_change_nothing(uneven, monkeypatch):
    def found():
        rows = mixing.mix(uneven, repeat_limit=None, target_entropy=1.5, budget=3000.0, block_tokens=50).collect()
        return sorted((r.row.doc_id, r.epoch, r.block, r.position) for r in rows)

    whole = found()
    monkeypatch.setattr(mixing, "BLOCKS_AT_ONCE", 3)
    assert found() == whole and whole
