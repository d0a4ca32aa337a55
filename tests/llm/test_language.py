"""Mixtures against a search over all shares, held-out accuracy, and odd rows."""

import zlib

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from frameglass.llm import language


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.fit(docs)


def test_trigrams():
    buckets, counts = language.trigrams("Aé, 1a")
    data = b" a\xc3\xa9 a "
    expected = {}
    for i in range(len(data) - 2):
        code = int.from_bytes(data[i : i + 3], "big")
        b = (code * 2654435761 % 2**32) >> 17
        expected[b] = expected.get(b, 0) + 1
    assert dict(zip(buckets.tolist(), counts.tolist())) == expected


def test_long_texts_are_counted_whole(monkeypatch):
    text = odd.sentence(3, 400)
    whole = language.trigrams(text)
    monkeypatch.setattr(language, "_CHUNK", 17)
    assert all((a == b).all() for a, b in zip(whole, language.trigrams(text)))


def test_shares_are_the_likeliest(docs, model):
    by_lang = {r.lang: r.text for r in docs.filter("n_chars > 1500").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    text = by_lang["en"][:900] + " " + by_lang["fr"][:400]
    got = dict(model.shares(text))
    assert set(got) == {"en", "fr"} and abs(sum(got.values()) - 1) < 1e-9
    buckets, counts = language.trigrams(text)
    p = model.p[[model.names.index(n) for n in ("en", "fr")]][:, buckets]
    grid = np.linspace(0.005, 0.995, 199)
    best = max(grid, key=lambda a: counts @ np.log(a * p[0] + (1 - a) * p[1]))
    assert got["en"] == pytest.approx(best, abs=0.02)
    for lang, t in by_lang.items():
        assert model.shares(t)[0][0] == lang and model.shares(t, penalty=1e9) == [(lang, 1.0)]


def test_held_out_accuracy(docs):
    got = language.predictions(odd.clashing(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert set(out.doc_id) == {i for i in got.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (out.lang_pred == out.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_held_out_labels_teach_nothing(docs):
    shuffled = docs.withColumn("lang", F.when(language.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    a, b = language.predictions(docs), language.predictions(shuffled)
    assert a.exceptAll(b).count() == 0


def test_sample_bound(docs):
    small = language.fit(docs, sample_docs=40)
    assert small.names == language.fit(docs).names


def test_odd_rows(spark, docs, model):
    df = odd.clashing(odd.docs(spark))
    got = {r.doc_id: r for r in language.predictions(df.drop("lang_pred", "score", "languages").withColumn("lang", F.lit("en"))).collect()}
    assert len(got) == len(odd.TEXTS)
    for i, t, *_ in odd.rows():
        letters = any(c.isalpha() for c in t or "")
        assert got[i].lang_pred == ("en" if letters else "und") and (got[i].score > 0) == letters
    unlabelled = language.predictions(odd.docs(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert language.predictions(odd.docs(spark).limit(0)).count() == 0
    kept = language.keep_known(df.withColumn("lang", F.lit("en")), min_score=0.5)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, t, *_ in odd.rows() if any(c.isalpha() for c in t or "")}


def test_each_text_is_inferred_once(spark):
    """A filter on the result stays above it: one evaluation in the plan of the kept rows."""
    df = spark.createDataFrame([(i, "the cat sat on the mat", "en") for i in range(40)], "doc_id long, text string, lang string")
    plan = language.keep_known(df, min_score=0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
