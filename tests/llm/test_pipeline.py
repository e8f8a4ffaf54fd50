"""The stages one after the other against brute force on the small documents."""

import corpus_pipeline
import pytest
from corpusloom.llm import langid, quality
from pyspark.sql import functions as F
from test_duplicates import brute_components, brute_repeats
from test_tokens_and_media import check_packed


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name.replace(" ", "_"))
        stage(spark, docs, sf).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_filters_drop_what_they_reject_and_nothing_else(spark, sf, stages):
    before, after = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    model = quality.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r.doc_id for r in quality.score_documents(before, model).filter("predicted = 1").collect()}
    good, bad = ({i for i in texts(before) if labels.get(i) == q} for q in (1, 0))
    assert set(texts(after)) == kept and len(good - kept) <= 2 and len(bad - kept) >= 0.8 * len(bad)
    before, after = stages[1]
    judged = langid.identify(before, langid.fit(before)).filter("lang_pred <> 'und' AND score >= 0.5")
    assert set(texts(after)) == {r.doc_id for r in judged.collect()}
    assert all(a.columns == b.columns for b, a in stages[:-1])


def test_one_document_of_each_group_stays(stages):
    before, after = (texts(df) for df in stages[2])
    want, _ = brute_components(before, 5, 80)
    assert set(after) == set(want.values()) and all(after[i] == before[i] for i in after)


def test_repeats_go(stages):
    before, after = (texts(df) for df in stages[3])
    want = brute_repeats(before)
    assert after == {i: before[i] if want[i][1] == 0 else want[i][2] for i in before}
    assert stages[3][1].filter(F.col("n_chars") != F.length("text")).count() == 0


def test_packing_holds_all(stages):
    before = texts(stages[4][0])
    order = sorted(before)
    number = {i: k for k, i in enumerate(order)}
    rows = [type(r)(**{**r.asDict(), "doc_id": number[r.doc_id]}) for r in stages[4][1].collect()]
    check_packed(rows, [before[i] for i in order], 1024)


def test_run_is_the_stages(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert got.drop("sequence_id", "offset").exceptAll(stages[-1][1].drop("sequence_id", "offset")).count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, length string"


def prose(k, n=60):
    return " ".join(f"{w}{k}" if i % 9 == 0 else w for i, w in enumerate(["the", "quick", "fox", "of", "a", "house", "and", "all"] * (n // 8 + 1)) if i < n)


@pytest.fixture(scope="module")
def odd_stages(spark, sf, tmp_path_factory):
    rows = [(i, prose(i), "en", "s", 1) for i in range(40)] + [(100 + i, f"le chat {i} est sur la maison des {i} rois", "fr", None, None) for i in range(40)]
    rows += [(1, prose(1), "en", "s", 1), (1, prose(1), "en", "s", 1), (300, prose(2), None, "s", 1), (None, prose(3), "en", "s", 1), (301, None, "en", "s", 0), (302, "", None, None, None), (303, " \n\t", "en", "s", 3), (None, None, None, None, None)]
    rows += [(400, " ".join(f"long{i} words{i % 7}" for i in range(20_000)), "en", "s", 1), (401, prose(50) + " " + prose(50), "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 0.25, "own", "x") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(40)] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    folder = str(tmp_path_factory.mktemp("odd"))
    labels.write.parquet(f"{folder}/labels.parquet")
    labels.limit(0).write.parquet(f"{folder}/none/labels.parquet")
    return docs, folder


def test_odd_rows_pass_through_every_stage(odd_stages, tmp_path):
    docs, folder = odd_stages
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(docs.sparkSession, docs, f"{folder}/none" if k == 0 else folder).write.parquet(str(tmp_path / name.replace(" ", "_")))
        out = docs.sparkSession.read.parquet(str(tmp_path / name.replace(" ", "_")))
        before, after = docs.collect(), out.collect()
        if k < 4:
            assert out.columns == docs.columns and all((r.score, r.kept, r.length) == (0.25, "own", "x") for r in after)
        if k == 0:
            assert len(after) == len(before)  # nothing to learn from
        if k == 1:
            assert {r.text for r in before if not (r.text or "").strip()}.isdisjoint({r.text for r in after}) and len(after) >= 80
        if k == 2:
            kept = [r.doc_id for r in after]
            assert kept.count(1) == 1 and 300 not in kept and kept.count(None) == 1
        if k == 3:
            assert len(after) == len(before)
        if k == 4:
            assert {r.doc_id for r in before} == {r.doc_id for r in after} and all(1 <= r.length <= 1024 for r in after)
        docs = out


def test_empty_tables_pass_through_every_stage(odd_stages, tmp_path):
    docs, folder = odd_stages
    docs = docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for labels in (folder, f"{folder}/none"):
            out = stage(docs.sparkSession, docs, labels)
            assert out.count() == 0 and (k == 4 or out.columns == docs.columns)
