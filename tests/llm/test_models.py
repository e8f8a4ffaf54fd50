"""Quality classifier and language ID: held-out accuracy, exact code lengths and odd inputs."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from corpusloom.llm import langid, quality
from pyspark.sql import functions as F

ODD = [(1, None), (2, ""), (3, "  \n "), (4, "12 34 !!"), (5, "the " * 50_000), (6, "É"), (6, "É"), (None, "the of and")]


def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, score string")


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_quality_on_held_out_rows(spark, d):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.score_documents(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    got = quality.score_documents(odd(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(1, None)], "doc_id long, quality int"))
    assert quality.score_documents(docs, model).first().score == 0.5


def test_scores_do_not_depend_on_neighbours():
    model = quality.train(["good words here", "bad!! bad!! bad!!"] * 20, [1, 0] * 20)
    alone = quality.score_texts(pa.array(["good words"]), model)
    among = quality.score_texts(pa.array(["bad!!", None, "good words", ""]), model)
    assert alone[0] == among[2] and among[0] < 0.5 < among[2]


def test_held_out_rows_never_teach(spark):
    rows = [(i, f"w{i}", i % 2) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    held = {r.doc_id for r in docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()}
    flipped = labels.withColumn("quality", F.when(F.col("doc_id").isin(*held), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = langid.fit(docs)
    rows = langid.identify(docs, trees).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98
    got = {r.doc_id: r for r in langid.identify(odd(spark), trees).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 4)) and got[5].lang_pred == "en"
    assert langid.identify(odd(spark), trees).count() == len(ODD) and langid.identify(docs.limit(0), trees).count() == 0


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs, langid.fit(docs)).first().lang_pred == "und"


def coded(text):
    return b" " * langid.ORDER + b"".join(b" " + w.encode() for w in text.lower().split())


def brute_bits(train, text):
    counts = defaultdict(Counter)
    for b in map(coded, train):
        for i in range(langid.ORDER, len(b)):
            for k in range(langid.ORDER + 1):
                counts[b[i - k : i]][b[i]] += 1
    total, b = 0.0, coded(text)
    for i in range(langid.ORDER, len(b)):
        for k in range(langid.ORDER, -1, -1):
            seen = counts.get(b[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if b[i] in seen:
                total += math.log2((n + d) / seen[b[i]])
                break
            total += math.log2((n + d) / d)
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    texts = {"a": ["the cat sat on the mat", "", "thé end"], "b": ["der Hund saß auf der Matte ß", "x"], "c": ["x"]}
    trees = langid.train(texts)
    asked = ["the dog sat on it", "", "der 中 matte", "q", "thé thé x", " a b  c ab abc abcd abcde\nthe abcdef "]
    bits = langid.text_bits(*langid.words_of(pa.array([t.lower() for t in asked])), trees)
    for j, text in enumerate(asked):
        for i, name in enumerate(trees.languages):
            assert abs(bits[j, i] - brute_bits(texts[name], text)) < 1e-3


def test_one_frequent_language_and_repeated_ids_bound_the_sample(spark):
    rows = [(i % 400, f"text number {i}", "en") for i in range(1200)] + [(9, f"again {i}", "en") for i in range(600)] + [(i, f"texte numéro {i}", "fr") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = langid.fit(docs, 20)
    assert trees.languages == ("en", "fr") and langid.fit(docs, 20, 1).languages == ("en",)
    again = langid.fit(docs.repartition(7), 20)
    assert all((a == b).all() for a, b in zip(trees.bits, again.bits, strict=True))
    got = langid.identify(docs, trees).collect()
    assert len(got) == len(rows) and all(r.lang_pred in ("en", "fr") for r in got)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    texts, y = ["a bb a bb bb", "ccc dd", "", "bb bb"], np.array([1.0, 0.0, 1.0, 0.0])
    row, bucket, share = quality.shares(texts, 64)
    assert np.allclose(np.bincount(row, weights=share, minlength=4), [1, 1, 0, 1])
    ids, where = np.unique(bucket, return_inverse=True)
    w = quality.Weights(rng.standard_normal((64, 3)), rng.standard_normal(3), 0.3)
    _, by_vectors, by_out, by_bias = quality.loss_and_gradient(w, row, ids, where, share, y)
    loss = lambda: quality.loss_and_gradient(w, row, ids, where, share, y)[0]
    for place, got in [((w.vectors, (ids[k], d)), by_vectors[k, d]) for k in range(0, len(ids), 3) for d in range(3)] + [((w.out, d), by_out[d]) for d in range(3)]:
        array, at = place
        held = array[at]
        array[at] = held + 1e-5
        up = loss()
        array[at] = held - 1e-5
        down = loss()
        array[at] = held
        assert abs((up - down) / 2e-5 - got) < 1e-6
    w.bias += 1e-5
    up = loss()
    w.bias -= 2e-5
    assert abs((up - loss()) / 2e-5 - by_bias) < 1e-6


def brute_score(text, model):
    """A score from the definition: words, their hashed subwords' shares of the log-odds, one marker for each repeated word."""
    words = (text or "").split()
    if not words:
        return 1 / (1 + math.exp(-model.bias))
    values = []
    for i, w in enumerate(words):
        _, buckets = quality.subwords(pa.array([w]), len(model.weights))
        values.append(float(np.mean(model.weights[buckets])))
        if i and words[i - 1] == w:
            values.append(float(model.weights[-1]))
    return 1 / (1 + math.exp(-(sum(values) / len(values) + model.bias)))


def test_scores_are_those_of_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.score_documents(docs, model).collect():
        assert abs(r.score - brute_score(text[r.doc_id], model)) < 1e-5
