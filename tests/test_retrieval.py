import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from compare import TABLES, assert_same
from corpusloom import queries
from corpusloom.functions.text import tokens
from corpusloom.operators import _count, augment, bm25, chunk_quality, embedding, evaluate, prompt, retrieve, vectors
from corpusloom.sources.tables import materialize
from pyspark.sql import functions as F

CORPUS = {"a": "x y z x", "b": "x q", "c": "x y", "d": "w w w"}


def brute_bm25(corpus, question):
    docs = {k: v.split() for k, v in corpus.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if r < 0 else r for t, r in raw.items()}
    out = {}
    for k, d in docs.items():
        tf = Counter(d)
        out[k] = sum(idf.get(t, 0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in question.split())
    return out


def chunks_of(spark, corpus):
    return spark.createDataFrame(list(corpus.items()), "chunk_id string, text string")


def test_bm25_scores_with_floor_repeats_and_padding(spark):
    chunks = chunks_of(spark, CORPUS)
    queries = spark.createDataFrame([(1, "x x y nothere"), (2, "nothere")], "query_id int, question string")
    got = bm25.search(queries, bm25.build_index(chunks), 4, store=chunks).collect()
    want = brute_bm25(CORPUS, "x x y")
    for r in got:
        if r.query_id == 1:
            assert abs(r.score - want[r.chunk_id]) < 1e-6
    order = sorted(CORPUS, key=lambda k: (-round(want[k], 9), k))
    assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1] == order
    assert [(r.chunk_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 2] == [(k, 0.0) for k in "abcd"]


def test_negative_scores_stand_behind_fillers(spark):
    corpus = {"a": "x", "b": "x", "c": "y"}
    chunks = chunks_of(spark, corpus)
    queries = spark.createDataFrame([(1, "x")], "query_id int, question string")
    got = bm25.search(queries, bm25.build_index(chunks), 3, store=chunks).orderBy("rank").collect()
    want = brute_bm25(corpus, "x")
    assert [r.chunk_id for r in got] == sorted(corpus, key=lambda k: (-round(want[k], 9), k))


def test_fillers_are_all_that_is_needed(spark):
    """Hits of negative score do not use up the chunks that fillers come from."""
    chunks = spark.createDataFrame([(i, "a b" if i < 50 else "c") for i in range(60)], "chunk_id int, text string").repartition(3)
    queries = spark.createDataFrame([(1, "a"), (2, "c"), (3, "a c"), (4, "")], "query_id int, question string")
    got = bm25.search(queries, bm25.build_index(chunks), 4, store=chunks).collect()
    assert [(r.chunk_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1] == [(i, 0.0) for i in range(50, 54)]
    assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 2] == [50, 51, 52, 53]
    assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 4] == [0, 1, 2, 3]
    deep = bm25.search(queries, bm25.build_index(chunks), 55, store=chunks).filter("query_id = 1").orderBy("rank").collect()
    want = brute_bm25({i: "a b" if i < 50 else "c" for i in range(60)}, "a")
    assert [r.chunk_id for r in deep] == sorted(want, key=lambda i: (-round(want[i], 9), i))[:55]


def test_vector_topk_in_blocks_with_ties_and_large_k(spark):
    rng = np.random.default_rng(0)
    rows = rng.standard_normal((40, 5)).astype(np.float32)
    rows[7] = rows[3]
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "chunk_id int, embedding array<float>").repartition(3)
    q = v.filter("chunk_id < 10").withColumnRenamed("chunk_id", "query_id")
    got = vectors.vector_topk(q, v, 100, block=3).collect()
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    assert len(got) == 400
    for i in range(10):
        scores = np.round(unit @ unit[i], 9)
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == sorted(range(40), key=lambda j: (-scores[j], j))


def ranked(spark, ids):
    return spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], "query_id int, chunk_id string, rank int")


def test_rrf(spark):
    assert [r.chunk_id for r in retrieve.rrf_fuse(ranked(spark, "abc"), ranked(spark, "bda")).orderBy("rank").collect()] == list("badc")
    assert [r.chunk_id for r in retrieve.rrf_fuse(ranked(spark, "xy"), ranked(spark, "")).orderBy("rank").collect()] == list("xy")


def test_stitch(spark):
    def run(a, b):
        return spark.createDataFrame([(a, b)], "a string, b string").select(retrieve.stitch(F.col("a"), F.col("b")).alias("r")).first().r

    assert run("前文内容。中间重叠片段。", "中间重叠片段。后文内容。") == "前文内容。中间重叠片段。后文内容。"
    assert run("abcde", "abcde") == "abcde\n\nabcde" and run("x", "") == "x\n\n"


def window(texts, chapters=None):
    return [{"idx": i + 1, "text": t, "chapter": (chapters or ["C1"] * len(texts))[i], "section": None} for i, t in enumerate(texts)]


def test_expansion_walk():
    w = window(["甲" * 100, "乙" * 50, "丙" * 100])
    assert retrieve.expand("乙" * 50, 2, w, 300, 120, 4) == (1, 2)  # upward first
    assert retrieve.expand("# 乙", 2, window(["甲" * 100, "# 乙", "丙" * 200]), 300, 120, 4) == (2, 3)
    assert retrieve.expand("乙" * 300, 2, w, 300, 120, 4) is None
    assert retrieve.expand("乙" * 50, 2, window(["甲", "乙" * 50, "丙"], ["C2", "C1", "C2"]), 300, 120, 4) is None
    assert retrieve.expand("乙", 2, window(["甲", "乙", "丙"], [None] * 3), 300, 120, 4) == (1, 3)


def test_expand_short_hits(spark):
    chunks = spark.createDataFrame([(f"bk::{i}", "bk", i, t, "C1", None) for i, t in ((1, "甲" * 100), (2, "乙" * 50), (3, "丙" * 400))], "chunk_id string, source string, idx int, text string, chapter string, section string")
    hits = chunks.withColumns({"query_id": F.lit(1), "rank": F.col("idx")})
    got = {r.idx: r for r in retrieve.expand_short_hits(hits, chunks, 300, 120, 4).collect()}
    assert got[3].expanded is False and got[3].text == "丙" * 400
    assert got[2].text == "甲" * 100 + "\n\n" + "乙" * 50 and got[2].expanded_span == [1, 2]


def test_rerank_keeps_fused_order_among_equals(spark):
    hits = spark.createDataFrame([(1, "a", 2, "q w", "q"), (1, "b", 1, "q w", "w"), (1, "c", 3, "q w", "q w")], "query_id int, chunk_id string, rank int, question string, text string")
    assert [r.chunk_id for r in retrieve.rerank(hits, 2).orderBy("rank").collect()] == ["c", "b"]
    assert [r.chunk_id for r in retrieve.rerank(hits, 2, None).orderBy("rank").collect()] == ["b", "a"]
    assert [r.chunk_id for r in retrieve.rerank(hits, 1, lambda q, t: t.str.len().astype(float), batch=True).collect()] == ["c"]


def test_encode_cached_encodes_only_misses(spark):
    chunks = spark.createDataFrame([("1", "aa"), ("2", "bbb"), ("3", "cccc")], "chunk_id string, text string")
    cache = spark.createDataFrame([("m", "bbb", [99.0]), ("other", "aa", [1.0])], "model string, t string, embedding array<float>").select("model", F.sha1("t").alias("text_key"), "embedding")
    length = lambda texts: np.array([[len(t)] for t in texts])
    got, after = embedding.encode_cached(chunks, cache, "m", length, normalize=False)
    assert {r.chunk_id: (list(r.embedding), r.reused) for r in got.collect()} == {"1": ([2.0], False), "2": ([99.0], True), "3": ([4.0], False)}
    again, _ = embedding.encode_cached(chunks, after, "m", length, normalize=False)
    assert again.filter("NOT reused").count() == 0


def test_prompt_never_reads_values_as_templates(spark):
    queries = spark.createDataFrame([(1, "q {context}"), (2, "none")], "query_id int, question string")
    hits = spark.createDataFrame([(1, 2, "s", "t2", None, None), (1, 1, "s", "{question}", None, None)], "query_id int, rank int, source string, text string, chapter string, section string")
    got = {r.query_id: r for r in prompt.build_prompts(queries, hits, "C {context} Q {question}").collect()}
    assert got[1].prompt == "C [来源:s] {question}\n\n[来源:s] t2 Q q {context}" and got[1].sources == ["s"] and got[1].retrieved_sources == ["s", "s"]
    assert got[2].prompt == "C (无) Q none" and got[2].sources == []
    assert prompt.answers(prompt.build_prompts(queries, hits), lambda s: s, 0).first().answer == prompt.EMPTY_INDEX


def test_flags(spark):
    cases = {"x" * 59: ["short"], "x" * 60: [], "x" * 1141: ["long"], "x" * 1140: [], "ab\n" * 30: ["table"], "1" * 25 + "x" * 75: [], "1" * 26 + "x" * 74: ["table"], "²" * 30 + "x" * 70: ["table"], "": ["short"]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", chunk_quality.flags(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in rows} == cases


def test_corpus_stats_of_nothing(spark):
    assert tuple(chunk_quality.corpus_stats(spark.createDataFrame([], "source string, text string")).first()) == (0,) * 6


def test_parse_qa(spark):
    cases = {"问题: 四个字吗\n答案: a\nb": ("四个字吗", "a\nb"), "问题：宽冒号吗": ("宽冒号吗", ""), "问题: 三个字": None, "答案: x": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", evaluate.parse_qa(F.col("t")).alias("q")).collect()
    assert {r.t: tuple(r.q) if r.q else None for r in rows} == cases
    assert spark.createDataFrame([("问题：宽冒号吗",)], "t string").select(evaluate.parse_qa(F.col("t"), wide_colon=False).alias("q")).first().q is None


def test_metrics(spark):
    ranks = spark.createDataFrame([("s", i, r) for i, r in enumerate([1, 4, 5, None])], "stage string, query_id int, rank int")
    r = evaluate.metrics(ranks, 4).first()
    assert (r.hit_at_1, r.hit_at_k, r.mrr, r.found, r.n) == (0.25, 0.5, round((1 + 0.25 + 0.2) / 4, 6), 3, 4)


def test_full_ranks_of_scores_and_of_vectors_agree(spark):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.standard_normal((30, 4)).astype(np.float32))], "chunk_id int, embedding array<float>").repartition(3)
    testset = v.filter("chunk_id < 8").select(F.col("chunk_id").alias("query_id"), "embedding", (F.col("chunk_id") + 11).alias("gold_id"))
    scores = vectors.vector_topk(testset, v, 30).withColumn("variant", F.lit("v"))
    counted = {r.query_id: r["rank"] for r in evaluate.full_ranks(scores, testset, ["variant"]).collect()}
    assert {r.query_id: r["rank"] for r in vectors.gold_ranks(testset, v, block=3).collect()} == counted


def test_variants_are_encoded_anew_and_ranked_over_all_chunks(spark):
    table = "表1 blood\n\n| name | low |\n| --- | --- |\n| sodium | 135 |"
    texts = {0: table, 1: "sodium of other things", 2: "blood", 3: "sodium low low", 4: None}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    testset = spark.createDataFrame([(7, "low: sodium 135 blood", 0)], "query_id long, question string, gold_id long")
    variants = {"original": F.col("text"), "tables": augment.augment_tables(F.col("text")), "nothing of gold": F.when(F.col("chunk_id") == 0, "").otherwise(F.col("text"))}
    seen = []
    got = {r.variant: r["rank"] for r in evaluate.variant_ranks(testset, chunks, variants).collect()}
    for name, text in variants.items():
        held = {r.chunk_id: r.t for r in chunks.filter("text IS NOT NULL").select("chunk_id", text.alias("t")).collect()}
        v = embedding.normalized(embedding.hashing_encoder([*held.values(), "low: sodium 135 blood"]).astype(float))
        scores = np.round(v[:-1] @ v[-1], 6)
        seen.append(held[0])
        assert got[name] == 1 + int((scores > scores[list(held).index(0)]).sum())
    assert len(set(seen)) == 3 and got["nothing of gold"] > 1


def test_default_encoder_hashes_the_tokens_of_the_pattern(monkeypatch):
    import random
    import re
    import zlib

    from corpusloom.functions.text import WORD

    monkeypatch.setattr(_count, "BYTES", 999)
    monkeypatch.setattr(embedding, "TEXTS", 100)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1é表、 \n\u3000\x1f|:-\U0001f600\u0300") for _ in range(rng.randrange(60))) for _ in range(500)] + ["", " ", "x" * 3000]
    token = re.compile(rf"[{re.sub(r'.x.([0-9a-f]+).', lambda m: chr(int(m[1], 16)), WORD)}]+|\S")
    for dim in (64, 16):
        expected = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for t in token.findall(text):
                h = zlib.crc32(t.encode())
                expected[i, h % dim] += 1 if h >> 31 else -1
        assert (embedding.hashing_encoder(texts, dim) == expected).all()
    assert embedding.hashing_encoder([]).shape == (0, 64)


def test_vectors_of_whole_numbers_are_ranked_as_by_floats(monkeypatch):
    rng = np.random.default_rng(3)
    unit = lambda counts: vectors.unit(pd.Series(list(embedding.normalized(counts.astype(float)))))
    for i, (most, few, products, rows_at) in enumerate([(1, 64, 1 << 20, 4096), (3, 0, 5000, 64), (60, 64, 5000, 64), (3000, 1, 1 << 20, 4096), (40_000, 64, 100, 4096)]):
        for name, value in (("FEW", few), ("PRODUCTS", products), ("ROWS", rows_at)):
            monkeypatch.setattr(vectors, name, value)
        rows = rng.integers(-most, most + 1, (2000, 64)).astype(np.int32)
        rows[::7] = 0
        rows[1::5, 8:] = 0  # many ties, which floats settle
        asked = np.zeros((150, 64), np.int32)
        for q in asked:
            q[rng.choice(64, rng.integers(0, 8), replace=False)] = rng.integers(-2, 3)
        asked[:40], asked[120:] = rows[:40], asked[50:80]
        u, a = unit(rows), unit(asked)
        least = np.round((a * u[rng.integers(0, 2000, 150)]).sum(axis=1), 9)
        held = vectors._Outranked(asked, least)
        got = held.higher(rows[:700]) + held.higher(rows[700:])
        assert (got == [np.count_nonzero(np.round((u * q).sum(axis=1), 9) > x) for q, x in zip(a, least, strict=True)]).all(), i


def test_default_encoder_is_ranked_without_writing_vectors(spark, sf, monkeypatch):
    variants = {"original": F.col("text"), "none": F.lit(None).cast("string")}
    told = materialize(queries.order_tables(spark, sf).select(F.col("l_orderkey").alias("chunk_id"), "text"))
    testset = told.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.substring("text", 1, 90).alias("question"), F.col("chunk_id").alias("gold_id"))
    testset = testset.unionByName(spark.createDataFrame([(-1, None, 20), (-2, "", 40), (-3, "x", -9)], testset.schema))
    by_floats = evaluate.variant_ranks(testset, told, variants, lambda texts: embedding.hashing_encoder(texts)).collect()
    monkeypatch.setattr(vectors, "gold_ranks", None)
    assert sorted(evaluate.variant_ranks(testset, told, variants).collect()) == sorted(by_floats)
    gold = told.join(testset, F.col("gold_id") == F.col("chunk_id")).select("query_id", "question", F.col("text").alias("gold"))
    in_blocks = vectors.counted_gold_ranks(gold, told.select("text"), block=10).collect()
    assert {(r.query_id, r["rank"]) for r in in_blocks} == {(r.query_id, r["rank"]) for r in by_floats if r.variant == "original"} and len(in_blocks) > 10
    assert vectors.counted_gold_ranks(gold.limit(0), told.select("text")).count() == 0


def test_encoders_compared_by_stage_on_literal_gold(spark, sf):
    rows = {(r.model, r.stage): r for r in queries.compare_encoders_by_stage(spark, sf).collect()}
    n = queries.gold(spark, sf).count()
    assert set(rows) == {(m, s) for m in ("hashing", "hashing-16") for s in ("vector", "hybrid", "reranked")} and {r.n for r in rows.values()} == {n}
    for m in ("hashing", "hashing-16"):
        assert rows[m, "hybrid"].found == rows[m, "reranked"].found > 0
    assert rows["hashing", "vector"].mrr != rows["hashing-16", "vector"].mrr
    ranks = queries.full_ranks_by_variant(spark, sf).groupBy("variant").count().collect()
    assert {(r.variant, r["count"]) for r in ranks} == {("original", n), ("tables", n)}


def test_literal_pairs_are_those_of_brute_force(spark):
    import random

    rng = random.Random(4)
    word = lambda: rng.choice(["aa", "b", "cc,", "d.", "é", "ff"])
    docs = [(i, rng.choice([" ", "\n", "  ", "　"]).join(word() for _ in range(rng.randrange(0, 40)))) for i in range(60)] + [(99, None)]
    passages = [(k, t[a : a + n]) for k, (t, a, n) in enumerate((rng.choice(docs[:60])[1], rng.randrange(20), rng.randrange(0, 70)) for _ in range(120))] + [(500, "nowhere at all"), (501, None)]
    want = sorted((p, d) for p, said in passages if said for d, t in docs if t and said in t)
    asked, texts = spark.createDataFrame(passages, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in evaluate.literal_pairs(asked, texts).collect()) == want and len(want) > 100
    assert evaluate.literal_pairs(asked.limit(0), texts).count() == 0


def test_runs_of_words_have_one_hash_wherever_they_stand():
    import random
    import re

    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", "é", "中", "ab", "ba", ".", "xxxxx"]) + rng.choice([" ", "\n", "　", " \t"]) for _ in range(rng.randrange(14))) for _ in range(600)]
    texts += [" " + t.rstrip() for t in texts] + [None, "", " "]
    words = [re.findall(r"[^ \n　\t]+", t or "") for t in texts]
    runs = [[tuple(w[i : i + 3]) for i in range(len(w) - 2)] for w in words]
    got = _count.run_hashes(pa.array([None, *texts], pa.string()).slice(1), 3).to_pylist()
    assert [len(g) for g in got] == [len(r) for r in runs]
    pairs = {(x, h) for r, g in zip(runs, got, strict=True) for x, h in zip(r, g, strict=True)}
    assert len(pairs) == len({x for x, _ in pairs}) == len({h for _, h in pairs}) > 300


def test_default_tokens_are_counted_without_a_pattern_as_by_the_pattern(spark, monkeypatch):
    monkeypatch.setattr(_count, "BYTES", 999)
    every = [chr(c) for c in (*range(0x3100), *range(0xFF00, 0x10100))]
    texts = [lead + between.join(every[i : i + 4000]) for i in range(0, len(every), 4000) for lead, between in (("a", ""), ("", "b"))]
    rows = list(enumerate([*texts, None, "", " ", "no no  yes", "é\u024f\u0250 中中"]))
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").unionByName(spark.sql("SELECT -1L AS chunk_id, CAST(X'61FF62C361E4B8' AS STRING) AS text"))
    chunks = materialize(chunks)
    fast, plain = bm25.counted_rows(chunks), bm25.counted_rows(chunks, tokenizer=lambda t: tokens(t))
    assert "regexp_extract_all" not in fast._jdf.queryExecution().toString() and fast.columns == plain.columns
    assert {r.chunk_id: r for r in fast.collect()} == {r.chunk_id: r for r in plain.collect()}
    for a, b in zip(bm25.build_index(chunks), bm25.build_index(chunks, tokenizer=lambda t: tokens(t)), strict=True):
        found, wanted = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()) for df in (a, b))
        assert found == wanted  # sums of floats depend on their order
    stretches = list(_count.slices(pa.array(["x" * 600, None, "y" * 399, "z", "w" * 5000, "v"]), 999))
    assert stretches == [(0, 3), (3, 1), (4, 1), (5, 1)]


def test_blocks_of_questions_do_not_change_hits(spark):
    chunks = spark.createDataFrame([(f"c{i:02}", " ".join(f"t{(i * k) % 11}" for k in range(1, 9))) for i in range(40)], "chunk_id string, text string")
    asked = spark.createDataFrame([(f"q{i}", f"t{i} t{i + 1} t{i} unseen") for i in range(9)] + [("none", "zzz")], "query_id string, question string")
    index = bm25.build_index(chunks)
    for store in (None, chunks.select("chunk_id")):
        whole, parts = (sorted(map(tuple, bm25.search(asked, index, 5, store=store, block=n).collect())) for n in (1000, 2))
        assert whole == parts and {r[0] for r in whole} == ({f"q{i}" for i in range(9)} | ({"none"} if store is not None else set()))
    v = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(30)], "chunk_id int, embedding array<float>")
    q = v.filter("chunk_id < 7").withColumnRenamed("chunk_id", "query_id")
    assert sorted(map(tuple, vectors.vector_topk(q, v, 3).collect())) == sorted(map(tuple, vectors.vector_topk(q, v, 3, block=2).collect()))


def test_a_test_set_draws_until_enough_are_usable(spark):
    chunks = spark.createDataFrame([(f"c{i}", "s", f"{i} " + "x" * 300) for i in range(60)], "chunk_id string, source string, text string")

    def picky(passages):
        return passages.map(lambda p: f"问题: number {p.split()[0]}\n答案: a" if int(p.split()[0]) % 9 == 0 else "no")

    got = evaluate.make_testset(chunks, 5, 3, picky)
    usable = [f"c{i}" for i in range(0, 60, 9)]
    order = [r.chunk_id for r in evaluate.sample_passages(chunks, 3).orderBy("sample_key").collect() if r.chunk_id in usable]
    assert sorted(r.gold_id for r in got.collect()) == sorted(order[:5])
    assert evaluate.make_testset(chunks, 50, 3, picky).count() == len(usable)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_windows_chunks_are_gathered_once_and_not_for_every_hit(spark):
    chunks = spark.range(100).selectExpr("concat('s', id % 2) AS source", "cast(id div 2 AS int) AS idx", "concat('t', id) AS text", "cast(NULL AS string) AS chapter", "cast(NULL AS string) AS section")
    wanted = chunks.select("source", "idx").unionByName(chunks.filter("idx = 31").select("source", "idx"))  # two hits of one chunk
    rows = retrieve.context_window(wanted, chunks, 3).collect()
    assert len(rows) == 102
    for r in rows:
        assert [w.idx for w in r.window] == list(range(max(0, r.idx - 3), min(49, r.idx + 3) + 1))
        assert [w.text for w in r.window] == [f"t{2 * w.idx + int(r.source[1])}" for w in r.window]


def test_terms_are_counted_without_a_shuffle(spark):
    chunks = spark.createDataFrame([(1, "b a b"), (2, None), (3, "a")], "chunk_id long, text string")
    index = bm25.build_index(chunks)
    assert "Exchange" not in plan_of(index[0])
    assert sorted(map(tuple, index[0].collect())) == [("a", 1, 1, 3), ("a", 3, 1, 1), ("b", 1, 2, 3)]
    assert index[2].first().asDict() == {"n_docs": 3, "avgdl": 4 / 3}


def test_rows_that_share_an_id_are_one_chunk_of_the_postings(spark):
    chunks = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "a a x y z"), (3, "q r s")], "chunk_id long, text string")
    index = bm25.build_index(chunks)
    assert sorted(map(tuple, index[0].filter("chunk_id = 1").collect())) == [("a", 1, 2, 2), ("b", 1, 1, 2), ("c", 1, 1, 2)]
    assert [r.chunk_id for r in bm25.search(spark.createDataFrame([(7, "c")], "query_id long, question string"), index, 3).collect()] == [1]


def test_search_gives_the_same_by_postings_and_by_chunks(spark):
    chunks = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7, i % 11 + 3))) for i in range(60)], "chunk_id long, text string")
    asked = spark.createDataFrame([(f"q{i}", f"w{i} w{i + 2} w{i}") for i in range(9)], "query_id string, question string")
    index = bm25.build_index(chunks)
    by_chunks, by_postings = (sorted(map(tuple, bm25.search(asked, x, 5).collect())) for x in (index, tuple(index)))
    assert by_chunks == by_postings and len(by_chunks) > 30


def test_gold_ranks_round_scores_at_the_limit_and_multiply_equal_questions_once(spark):
    rng = np.random.default_rng(3)
    v = np.repeat(rng.integers(-2, 3, (80, 4)), 3, axis=0)  # equal scores, and copies
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)]
    table = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, rows[i % 9][1], 2 * i) for i in range(60)], "query_id long, embedding array<float>, gold_id long")
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    s = np.round(u @ u.T, 9)
    want = {i: int((s[i % 9] > s[i % 9, 2 * i]).sum()) + 1 for i in range(60)}
    for block in (None, 7):
        assert {r.query_id: r["rank"] for r in vectors.gold_ranks(asked, table, block=block).collect()} == want


def test_gold_ranks_of_a_thousand_blocks_join_their_gold_once(spark):
    v = spark.range(3000).selectExpr("id AS chunk_id", "array(cast(id % 7 AS float), cast(1 AS float)) AS embedding")
    plan = plan_of(vectors.gold_ranks(v.selectExpr("chunk_id AS query_id", "embedding", "chunk_id AS gold_id"), v))
    assert plan.count("MapInPandas") == 1  # 1,024 questions a job made three


def test_hybrid_search_takes_tables_as_they_are(spark, sf, tmp_path):
    for name in TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    table = "| st. | {0} |\n| --- | --- |\n| ung {0} | eit |\n| ach | {0} |"
    rows = [(i, "s", f"sodium text w{i}\n\n" + table.format(f"w{i % 5}") if i % 2 else f"plain w{i % 5} ung text") for i in range(40)]
    (tmp_path / "documents.parquet").unlink()
    (tmp_path / "benchmark.parquet").unlink()
    spark.createDataFrame(rows, "doc_id long, source string, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    asked = [(i, f"ung w{i} ach eit") for i in range(5)]
    spark.createDataFrame(asked, "item_id long, text string").toPandas().to_parquet(tmp_path / "benchmark.parquet")
    assert_same(queries.retrieve_hybrid(spark, str(tmp_path)), queries.ORACLES["retrieve_hybrid"], str(tmp_path))
