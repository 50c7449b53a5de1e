import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F
from textgate.llm import language_id, quality, registry
from tests.llm.conftest import prose

SMALL = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = registry.op8_language_id(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "n_chars")
    right = got.where("held_out").join(docs, "doc_id").where("n_chars > 50").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_quality_held_out_accuracy(spark):
    got = registry.op6_quality(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    right = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.95


def test_quality_from_positives_alone():
    import numpy as np

    good = np.stack([quality.statistics(prose(i, 150)) for i in range(80)])
    bad = np.stack([quality.statistics(" ".join(w + "***" for w in prose(i, 150).split())) for i in range(100, 130)])
    mixed = np.vstack([np.stack([quality.statistics(prose(i, 150)) for i in range(200, 270)]), bad])
    model = quality.train(good, np.ones(len(good), int), mixed)
    assert 0.4 < model.prior <= 0.99
    assert model.score(good).mean() > 0.5 > model.score(bad).mean()


def test_folds_on_odd_rows(spark, folder, odd_rows):
    by_id = sorted(((r.doc_id or 0, r.held_out, r.lang_pred) for r in registry.op8_language_id(spark, folder).collect()), key=str)
    assert len(by_id) == len(odd_rows)
    for i, held, lang in by_id:
        if i:
            assert held == (zlib.crc32(str(i).encode()) % 4 == 2)
        if i in (6, 7, 8, 10):
            assert lang == "und"
    scores = registry.op6_quality(spark, folder).collect()
    assert len(scores) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scores)


def test_empty_tables(spark, bare_folder, odd):
    assert registry.op8_language_id(spark, bare_folder).collect() == []
    assert registry.op6_quality(spark, bare_folder).collect() == []
    untaught = language_id.identify(odd, language_id.train([])).collect()
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in untaught)


def plain_grams(text):
    """2-, 3- and 4-grams of the marked text by plain slices."""
    marked = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    marked = " ".join(marked.split())
    marked = f" {marked} " if marked else " "
    found = []
    for n in (2, 3, 4):
        found += [marked[i : i + n] for i in range(len(marked) - n + 1) if " " not in marked[i + 1 : i + n - 1]]
    return found


@pytest.mark.parametrize("piece", [1, 2, 3, 5, 7, 64, 1 << 20])
def test_pieces_of_a_text_have_its_own_grams(monkeypatch, piece):
    texts = [prose(3, 40), "a", " a ", "--", "ab, cd!  e 中文字 ñandú ΣΑΣ x", "x " * 30, "y" * 50, " \n\t", "é. É"]
    for text in texts:
        whole = list(language_id.buckets(text))
        assert sum(map(len, whole)) == (len(plain_grams(text)) if any(c.isalpha() for c in text) else 0)
        monkeypatch.setattr(language_id, "PIECE_CHARS", piece)
        parts = list(language_id.buckets(text))
        monkeypatch.undo()
        assert sorted(np.concatenate(parts) if parts else []) == sorted(np.concatenate(whole) if whole else [])


def drawn(n, junk, seed):
    """Statistics of clean and junk texts, and which are clean."""
    texts = [prose(seed + i, 60 + i % 90) for i in range(n)]
    bad = np.arange(n) % 100 < 100 * junk
    return [" ".join(w + "#!"[j % 2] * (1 + j % 3) for j, w in enumerate(t.split())) if b else t for t, b in zip(texts, bad, strict=True)], ~bad


@pytest.mark.parametrize("junk", [0.1, 0.3, 0.5])
def test_prior_from_positives_and_unlabelled_text(junk):
    good, _ = drawn(300, 0, 10_000)
    texts, clean = drawn(1000, junk, 20_000)
    model = quality.train(np.stack([quality.statistics(t) for t in good]), np.ones(300, int), np.stack([quality.statistics(t) for t in texts]))
    assert abs(model.prior - (1 - junk)) < 0.08
    assert ((model.score(np.stack([quality.statistics(t) for t in texts])) >= 0.5) == clean).mean() > 0.95


def test_fit_over_tasks_is_the_fit_in_memory(spark):
    """All unlabelled rows count, a repeated id counts once among the positives, and labels 0 are not used."""
    texts, clean = drawn(400, 0.25, 30_000)
    docs = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1])] * 50 + [(None, "x")]
    labels = [(i, int(c)) for i, c in enumerate(clean) if i < 200] + [(1, int(clean[1])), (None, 1), (3, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    model = quality.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    x = np.stack([quality.statistics(t).astype(np.float32).astype(float) for i, t in docs if i is not None])
    order = sorted((str(i) for i in range(200) if clean[i]))
    own = quality.train(np.stack([quality.statistics(texts[int(i)]).astype(np.float32).astype(float) for i in order]), np.ones(len(order), int), x)
    assert np.allclose(model.weights, own.weights, atol=1e-6) and abs(model.prior - own.prior) < 1e-9
    assert model.slope == 1.0 and model.shift == 0.0
