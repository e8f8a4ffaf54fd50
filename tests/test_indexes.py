"""Pruned, approximate and growing indexes against exhaustive search and rebuilds; model slots, bucketed caches, page text."""

import os
import random
import uuid
from itertools import takewhile

import numpy as np
import pytest
from corpusloom.operators import ann, augment, blockmax, bm25, clean, embedding, prompt, retrieve, vectors
from corpusloom.operators.models import Loaded, Tokens
from corpusloom.plans import ingest
from corpusloom.sources.segments import SegmentedIndex
from corpusloom.sources.tables import read_bucketed_cache, write_bucketed_cache
from corpusloom.streaming.stateful import PROVIDER, first_texts, ingest_with_state
from pyspark.sql import functions as F

WORDS = ["the", "of", *(f"w{i}" for i in range(60))]


def texts(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choices(WORDS, weights=[60, 30, *(60 / (i + 1) for i in range(60))], k=r.randrange(0, 60))) for _ in range(n)]


def chunk_rows(spark, corpus):
    return spark.createDataFrame(list(corpus.items()), "chunk_id long, text string").repartition(3)


def hits(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 400])
def test_blockmax_gives_the_exhaustive_rows_from_fewer_postings(spark, k):
    corpus = dict(enumerate([*texts(1, 300), "w7 w7 w7 w8", "w7 w7 w7 w8"]))
    asked = spark.createDataFrame([(1, "w7 w8 w8"), (2, "the of the w3"), (3, "nowhere"), (4, "w59"), (5, "")], "query_id int, question string")
    index = bm25.build_index(chunk_rows(spark, corpus))
    found, work = blockmax.search(asked, blockmax.build_blocks(index, 4), k, seeds=2)
    assert hits(found) == hits(bm25.search(asked, index, k))
    held = {r.query_id: r for r in work.collect()}
    posted = {r.term: r["count"] for r in index[0].groupBy("term").count().collect()}
    assert set(held) == {1, 2, 4} and held[1].postings == posted["w7"] + posted["w8"]
    assert all(r.postings_scored <= r.postings and r.windows_scored <= r.windows for r in held.values())
    if k == 1:
        assert held[1].postings_scored < held[1].postings / 2


def test_blockmax_with_negative_weights(spark):
    corpus = {i: "a b" if i < 50 else "c" for i in range(60)}
    asked = spark.createDataFrame([(1, "a"), (2, "a c")], "query_id int, question string")
    index = bm25.build_index(chunk_rows(spark, corpus))
    assert index[1].filter("idf < 0").count() > 0
    found, _ = blockmax.search(asked, blockmax.build_blocks(index, 2), 12, seeds=1)
    assert hits(found) == hits(bm25.search(asked, index, 12))


# --------------------------------------------------------------------------------------------------- approximate search


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((20, dim))
    return (centers[rng.integers(0, 20, n)] + 0.3 * rng.standard_normal((n, dim))).astype(np.float32)


def vector_rows(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [float(x) for x in r]) for i, r in enumerate(rows)], "chunk_id long, embedding array<float>").repartition(4)


def test_few_lists_find_most_of_clustered_vectors(spark):
    v = vector_rows(spark, [*clustered(3000, 18), None, np.zeros(18), *[clustered(1, 18)[0]] * 500])
    asked = v.filter("chunk_id % 50 = 0 AND embedding IS NOT NULL").withColumnRenamed("chunk_id", "query_id")
    index = ann.build(v, ann.fit(v, 10, sample=1500))
    found = ann.search(asked, index, 10, block=40)
    rows = ann.recall(found, vectors.vector_topk(asked, v, 10)).collect()
    assert sum(r.n_found for r in rows) >= 0.9 * sum(r.n_true for r in rows) and len(rows) == asked.count()
    assert sum(index.sizes.values()) == 3501 and index.quantizer.probes < len(index.quantizer.centroids) / 2
    assert max(r.n_scored for r in found.collect()) < 3501


def test_all_lists_give_the_exact_rows(spark):
    v = vector_rows(spark, clustered(400, 6, 3))
    asked = v.filter("chunk_id < 20").withColumnRenamed("chunk_id", "query_id")
    index = ann.build(v, ann.fit(v, 5))
    assert hits(ann.search(asked, index, 5, probes=10**6, depth=400)) == hits(vectors.vector_topk(asked, v, 5))


def test_a_search_reads_the_probed_lists_only(spark, capsys):
    v = vector_rows(spark, clustered(500, 8, 4))
    index = ann.build(v, ann.fit(v, 5))
    ann.search(v.filter("chunk_id = 3").withColumnRenamed("chunk_id", "query_id"), index, 5, probes=2).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [list#" in plan and "codes" not in plan.split("ReadSchema: struct<chunk_id:bigint,embedding")[1].split("\n")[0]


def test_no_vectors_have_no_index(spark):
    v = spark.createDataFrame([(1, None)], "chunk_id long, embedding array<float>")
    assert ann.fit(v) is None


# -------------------------------------------------------------------------------------------------------- growing index


def as_chunks(spark, held):
    """Two chunks of every source's text."""
    rows = [(f"{s}::{i}", s, part) for s, t in held.items() for i, part in enumerate((t[: len(t) // 2], t[len(t) // 2 :]))]
    return spark.createDataFrame(rows, "chunk_id string, source string, text string").repartition(3)


def assert_like_rebuilt(spark, index, held):
    chunks = as_chunks(spark, held)
    asked = spark.createDataFrame([(1, "w7 w8"), (2, "the w3 w9")], "query_id int, question string")
    want, got = bm25.build_index(chunks), index.index()
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(got[0], "term", "chunk_id", "tf", "dl") == rows(want[0], "term", "chunk_id", "tf", "dl")
    assert rows(got[1], "term", "df", "idf") == rows(want[1], "term", "df", "idf") and got[2].first() == want[2].first()
    assert hits(bm25.search(asked, got, 10)) == hits(bm25.search(asked, want, 10))
    assert rows(index.live("chunks"), "chunk_id", "source", "text") == rows(chunks, "chunk_id", "source", "text")


def test_segments_are_like_a_rebuild(spark, tmp_path):
    index, held = SegmentedIndex(spark, str(tmp_path / "index")), {f"s{i}": t for i, t in enumerate(texts(5, 30))}
    source = lambda *names: spark.createDataFrame([(n,) for n in names], "source string")
    assert index.commit(as_chunks(spark, held)) and not index.commit(as_chunks(spark, held))
    assert_like_rebuilt(spark, index, held)
    # one changed, one new, one unchanged, one given and deleted, one unknown
    fresh = {"s3": "w7 w8 new", "new": "w9 w9", "s4": held["s4"], "s5": "gone"}
    assert index.commit(as_chunks(spark, fresh), source("s5", "s6", "nobody", None))
    held = {k: v for k, v in (held | fresh).items() if k not in ("s5", "s6")}
    assert_like_rebuilt(spark, index, held)
    # a deleted source comes back; another goes
    assert index.commit(as_chunks(spark, {"s5": "w7 again"}), source("new"))
    held = {k: v for k, v in (held | {"s5": "w7 again"}).items() if k != "new"}
    assert_like_rebuilt(spark, index, held)
    before = index.manifest()
    index.merge()
    assert len(before[1]) == 3 and len(index.manifest()[1]) == 1 and index.table("removed").count() == 0
    assert_like_rebuilt(spark, index, held)
    assert index.commit(None, source("s7")) and not index.commit(None, source("s7")) and not index.commit()
    held.pop("s7")
    assert_like_rebuilt(spark, index, held)


def test_segments_keep_a_row_a_chunk_and_shuffle_no_postings(spark, tmp_path):
    index, held = SegmentedIndex(spark, str(tmp_path / "index")), {f"s{i}": t for i, t in enumerate(texts(6, 20))}
    index.commit(as_chunks(spark, held))
    index.commit(as_chunks(spark, {"s1": "w7 w7 w8", "s2": "w9"}))
    got = index.index()
    assert index.live("postings").count() == 40 and got.forward.count() == 40
    # two sources that share an id, and one whose rows share one
    index.commit(spark.createDataFrame([("s3::0", "t", "w7 w9"), ("u::0", "u", "w8 w8"), ("u::0", "u", "w8 w9")], "chunk_id string, source string, text string"))
    got = index.index()
    assert got.forward is None and sorted(map(tuple, got[0].filter("chunk_id = 'u::0'").collect())) == [("w8", "u::0", 3, 2), ("w9", "u::0", 1, 2)]
    index.merge()
    merged = index.index()
    assert sorted(map(tuple, merged[0].collect())) == sorted(map(tuple, got[0].collect())) and merged[2].first() == got[2].first()


def test_documents_are_chunked_into_a_growing_index(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    docs = lambda **held: spark.createDataFrame(list(held.items()), "source string, text string")
    assert ingest.update(index, docs(a="甲句。" * 400, b="b text", c="c text"))
    assert not ingest.update(index, docs(a="甲句。" * 400, b="b text"))
    assert ingest.update(index, docs(b="new text", c=" "), docs(a="").select("source"))
    assert [(r.chunk_id, r.text) for r in index.live("chunks").collect()] == [("b::0", "new text")]
    want = bm25.build_index(ingest.chunked(docs(b="new text")))
    assert sorted(map(tuple, index.index()[1].collect())) == sorted(map(tuple, want[1].collect()))


def test_a_commit_without_its_manifest_does_not_count(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    index.commit(as_chunks(spark, {"a": "w1 w2"}))
    index._publish, publish = lambda *_: (_ for _ in ()).throw(RuntimeError("lost")), index._publish
    with pytest.raises(RuntimeError):
        index.commit(as_chunks(spark, {"b": "w3"}))
    index._publish = publish
    assert_like_rebuilt(spark, index, {"a": "w1 w2"})
    index.commit(as_chunks(spark, {"b": "w3"}))
    assert_like_rebuilt(spark, index, {"a": "w1 w2", "b": "w3"})


# ------------------------------------------------------------------------------------------------------ keyed stream state


def test_texts_are_encoded_once_whatever_the_batch(spark, tmp_path):
    folder = lambda name: str(tmp_path / name)

    def arrive(rows):
        spark.createDataFrame(rows, "source string, text string").coalesce(1).write.mode("append").parquet(folder("in"))

    def run():
        before = spark.conf.get(PROVIDER, None)
        for q in ingest_with_state(spark, folder("in"), folder("chunks"), folder("cache"), folder("checkpoint"), "m", files_per_batch=1):
            q.awaitTermination()
        assert spark.conf.get(PROVIDER, None) == before
        cache = spark.read.parquet(folder("cache"))
        assert {r.model for r in cache.select("model").distinct().collect()} == {"m"} and cache.filter("embedding IS NULL").count() == 0
        return spark.read.parquet(folder("chunks")).count(), sorted(r.text_key for r in cache.collect())

    arrive([("a", "one"), ("b", "two"), ("c", "one")])
    arrive([("d", "two"), ("e", "three")])
    n, keys = run()
    assert n == 5 and len(keys) == len(set(keys)) == 3
    assert run() == (n, keys)  # nothing new
    arrive([("f", "one"), ("g", "four")])  # a late duplicate
    assert run()[0] == 7 and len(run()[1]) == 4


def test_keys_that_are_kept_for_good_need_no_python(spark, tmp_path):
    spark.createDataFrame([("k", "t")], "text_key string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text_key string, text string").parquet(str(tmp_path / "in"))
    plan = lambda keep_ms: first_texts(stream, keep_ms)._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate [text_key" in plan(None) and "Python" not in plan(None) and "TransformWithState" in plan(1000)


# ---------------------------------------------------------------------------------------------------------- model slots


def notes(folder, what):
    return [open(f"{folder}/{f}").read() for f in os.listdir(folder) if f.startswith(what)]


def test_models_are_loaded_once_a_worker_and_stopped_at_their_limit(spark, tmp_path):
    folder = str(tmp_path)

    def noted(folder, what):  # workers do not see this module
        with open(f"{folder}/{what}-{uuid.uuid4().hex}", "w") as f:
            f.write(str(os.getpid()))

    def load():
        noted(folder, "load")

        def stream(text):
            try:
                while True:
                    noted(folder, "token")
                    yield text[:1] * 100
            finally:
                noted(folder, "closed")

        return stream

    model = Tokens(Loaded(f"model-{folder}", load))
    chunks = spark.createDataFrame([(i, c) for i, c in enumerate("abcdefgh")] + [(8, "a")], "chunk_id long, text string").repartition(6)
    out, cache = augment.enrich_cached(chunks, None, model, "{chunk}", limit=250)
    assert {r.text for r in out.collect()} == {c + augment.ENRICH_NOTE + c * 250 for c in "abcdefgh"} and cache.count() == 8
    loads = notes(folder, "load")
    assert len(loads) == len(set(loads))  # no process twice, however many tasks it ran
    assert len(notes(folder, "token")) == 8 * 18 and len(notes(folder, "closed")) == 8  # 1800 characters, then closed


def test_generators_that_end_by_themselves(spark):
    model = Tokens(lambda text: iter(["<think>", "x" * 50, "</think>", text.upper(), ""]))
    assert model.said("q") == "<think>" + "x" * 50 + "</think>Q" and model.said(None) is None and model.said("q", 0) == "<think>"
    prompts = spark.createDataFrame([(1, "q"), (2, None)], "query_id int, prompt string")
    assert {r.query_id: r.answer for r in prompt.answers(prompts, model, 3).collect()} == {1: model.said("q"), 2: None}


def test_loaded_models_fit_every_slot(spark):
    hits = spark.createDataFrame([(1, "a", 1, "q", "xx"), (1, "b", 2, "q", "xxx")], "query_id int, chunk_id string, rank int, question string, text string")
    scorer = Loaded("text length", lambda: lambda q, t: t.str.len().astype(float))
    assert [r.chunk_id for r in retrieve.rerank(hits, 1, scorer, batch=True).collect()] == ["b"]
    encoder = Loaded("one number", lambda: lambda texts: np.array([[len(t)] for t in texts]))
    assert [list(r.e) for r in hits.select(embedding.encode(F.col("text"), encoder, normalize=False).alias("e")).collect()] == [[2.0], [3.0]]


# ------------------------------------------------------------------------------------------------------ bucketed caches

CACHE = "model string, text_key string, embedding array<float>"


def test_a_bucketed_cache_is_joined_where_it_lies(spark, tmp_path):
    path = str(tmp_path / "cache")
    held = spark.range(2000).select(F.lit("m").alias("model"), F.sha1(F.col("id").cast("string")).alias("text_key"), F.array(F.col("id").cast("float")).alias("embedding"))
    write_bucketed_cache(held, path, 8)
    cache = read_bucketed_cache(spark, path, CACHE, 8)
    chunks = spark.range(1990, 2010).selectExpr("id AS chunk_id", "CAST(id AS STRING) AS text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keyed = chunks.withColumn("text_key", F.sha1("text"))
        for df in (embedding.cache_misses(keyed, cache, "m"), embedding.prune_cache(cache, keyed, "m")):
            assert df.count() == 10
            between = list(takewhile(lambda line: "SortMergeJoin" not in line, above(df._jdf.queryExecution().executedPlan().toString(), "bucketed_")))
            assert between and not [line for line in between if "Exchange" in line]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    encoded, after = embedding.encode_cached(chunks, cache, "m", lambda texts: np.array([[-1.0]] * len(texts)), normalize=False)
    assert sorted((r.chunk_id, r.embedding[0], r.reused) for r in encoded.collect()) == [(i, float(i) if i < 2000 else -1.0, i < 2000) for i in range(1990, 2010)]
    assert after.count() == 20 and read_bucketed_cache(spark, str(tmp_path / "none"), CACHE, 8).count() == 0


def above(plan, mark):
    """Lines of a plan from the parent of the last one with ``mark`` up to the root."""
    lines = plan.split("\n")
    at = max(i for i, line in enumerate(lines) if mark in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    out, least = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < least:
            out.append(line)
            least = depth(line)
    return out


# ------------------------------------------------------------------------------------------------------------ page text


def test_two_columns_are_read_one_after_the_other(spark):
    words = []
    for line in range(12):
        for k in range(2):
            words.append((1, 10.0 + 60 * k, 60.0 + 60 * k, 20.0 * line + k, 400.0, f"l{line}.{k}"))
            words.append((1, 210.0 + 60 * k, 260.0 + 60 * k, 20.0 * line + k, 400.0, f"r{line}.{k}"))
    words += [(2, 10.0, 390.0, 5.0, 400.0, "title"), (2, 210.0, 300.0, 30.0, 400.0, "b"), (2, 10.0, 100.0, 31.0, 400.0, "a"), (3, 1.0, 2.0, 0.0, 400.0, "same"), (3, 1.0, 2.0, 0.0, 400.0, "same")]
    df = spark.createDataFrame(words, "page int, x0 double, x1 double, top double, page_width double, text string").repartition(3)
    got = {r.page: (r.n_columns, r.text) for r in clean.page_text(df, ["page"]).collect()}
    side = lambda s: "\n".join(f"{s}{i}.0 {s}{i}.1" for i in range(12))
    assert got == {1: (2, side("l") + "\n" + side("r")), 2: (1, "title\na b"), 3: (1, "same same")}


def test_exact_search_finds_what_the_codes_miss(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(rng.normal(size=(1500, 32)))]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asked = v.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    index = ann.build(v, ann.fit(v, 5))
    want = hits(vectors.vector_topk(asked, v, 5))
    assert hits(ann.search(asked, index, 5, probes=2, depth=6)) != want
    for block in (1024, 7):
        assert hits(ann.search(asked, index, 5, probes=2, depth=6, exact=True, block=block)) == want


def test_blockmax_in_blocks_of_questions_and_window_by_window(spark):
    corpus = {i: " ".join(f"w{(i * j) % 9}" for j in range(1, 3 + i % 7)) for i in range(90)}
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i}") for i in range(7)], "query_id long, question string")
    index = bm25.build_index(chunk_rows(spark, corpus))
    blocks = blockmax.build_blocks(index, 4)
    whole, parts = (blockmax.search(asked, blocks, 5, seeds=2, block=n) for n in (1000, 3))
    assert hits(whole[0]) == hits(parts[0]) == hits(bm25.search(asked, index, 5))
    assert sorted(map(tuple, whole[1].collect())) == sorted(map(tuple, parts[1].collect()))
    known = blockmax.gathered(blocks, __import__("pandas").DataFrame({"term": ["w1", "w2"]}))
    assert known.groupBy("window").count().filter("count > 1").count() == 0  # one row a window, for whatever number of questions
