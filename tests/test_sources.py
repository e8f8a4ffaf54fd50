import numpy as np
from corpusloom.operators import bm25
from corpusloom.plans import ingest
from corpusloom.sources import files, tables
from corpusloom.streaming.ingest import ingest_batch, ingest_stream


def test_text_folder(spark, tmp_path):
    (tmp_path / "ocr.txt").write_bytes("正文\r\n内容".encode() + b"\xff")
    (tmp_path / "doc +1.MD").write_text("# 标题\n正文", encoding="utf-8")
    (tmp_path / "blank.txt").write_text("　 \n")
    (tmp_path / "note.xyz").write_text("x")
    got = {r.source: r.text for r in files.read_text_folder(spark, str(tmp_path)).collect()}
    assert got == {"ocr.txt": "正文\n内容", "doc +1.MD": "# 标题\n正文"}


def test_failing_parser_is_an_error_row(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"ok")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    good, bad = files.read_parsed_folder(spark, str(tmp_path), {"pdf": lambda b: b.decode("ascii")})
    assert [tuple(r) for r in good.collect()] == [("a.pdf", "ok")]
    assert [r.source for r in bad.collect()] == ["b.pdf"] and "UnicodeDecodeError" in bad.first().error


def test_testset(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"question": "q", "answer": "a", "gold_id": "s::1"}]')
    r = files.read_testset(spark, str(tmp_path / "t.json")).first()
    assert (r.question, r.gold_id, r.gold_source) == ("q", "s::1", None)


def test_publish_moves_the_pointer_after_all_tables(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x y. " * 10), ("b", "z")], "source string, text string")
    root = str(tmp_path / "index")
    stats = ingest.rebuild(docs, root).first()
    assert (stats.doc_files, stats.chunks, stats.reused) == (2, 2, 0)
    index = tables.read_index(spark, root)
    assert index["chunks"].count() == index["embeddings"].count() == 2 and index["corpus_stats"].first().n_docs == 2
    ingest.rebuild(docs.limit(0), root)
    assert tables.read_index(spark, root)["chunks"].count() == 0 and index["chunks"].count() == 2


def test_index_published_by_chunk_is_read_as_postings(spark, tmp_path):
    root, chunks = tmp_path / "index", spark.createDataFrame([("a", "x y x"), ("b", "x"), ("c", None)], "chunk_id string, text string")
    index = bm25.build_index(chunks)
    for held in (index.tables(), {"postings": index[0], "term_stats": index[1], "corpus_stats": index[2]}):
        version = tables.publish_index({"chunks": chunks, "embeddings": chunks.select("chunk_id"), **held}, str(root))
        assert (root / version / "forward").exists() == ("forward" in held) != (root / version / "postings").exists()
        postings = tables.read_index(spark, str(root))["postings"]
        assert postings.columns == index[0].columns
        assert sorted(tuple(r) for r in postings.collect()) == [("x", "a", 2, 3), ("x", "b", 1, 1), ("y", "a", 1, 3)]
    twice = bm25.build_index(chunks.unionByName(chunks))
    assert set(twice.tables()) == {"postings", "term_stats", "corpus_stats"}
    assert {r.term: r.df for r in twice[1].collect()} == {"x": 2, "y": 1}


def test_cache_tables(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "model string, text_key string, embedding array<float>"
    assert tables.read_cache(spark, path, schema).count() == 0
    tables.write_cache(spark.createDataFrame([("m", "k", [1.0])], schema), path)
    assert tables.read_cache(spark, path, schema).first().text_key == "k"


def test_stream_encodes_only_new_texts(spark, tmp_path):
    folder, calls = tmp_path / "in", tmp_path / "calls"
    calls.mkdir()

    def encoder(texts):
        import uuid

        (calls / uuid.uuid4().hex).write_text("\n".join(texts))
        return np.ones((len(texts), 2))

    for batch in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(t, t) for t in batch], "source string, text string").coalesce(1).write.mode("append").parquet(str(folder))
        ingest_stream(spark, str(folder), str(tmp_path / "chunks"), str(tmp_path / "cache"), str(tmp_path / "cp"), "m", encoder).awaitTermination()
    encoded = sorted(t for f in calls.iterdir() for t in f.read_text().split("\n"))
    assert encoded == ["a", "b", "c"]
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 4


def test_replayed_batch_loses_nothing(spark, tmp_path):
    chunks, cache = str(tmp_path / "chunks"), str(tmp_path / "cache")
    first = spark.createDataFrame([("1", "a"), ("2", "b")], "source string, text string")
    second = spark.createDataFrame([("3", "b"), ("4", "c")], "source string, text string")
    for rows, number in ((first, 0), (first, 0), (second, 1), (second, 1)):
        ingest_batch(rows, number, chunks, cache, "m", lambda texts: np.ones((len(texts), 2)))
    assert spark.read.parquet(cache).count() == 3 and spark.read.parquet(chunks).count() == 4
