import math
import random

from corpusloom.functions.text import let
from corpusloom.operators import _pack, bm25, chunking, segment
from pyspark.sql import functions as F


def texts(text, size=500, overlap=80):
    return [c.text for c in _pack.chunks(text, size, overlap)]


def test_long_text_without_terminators_is_cut():
    out = texts("句" * 1200)
    assert len(out) >= 3 and all(len(c) <= 500 for c in out) and "".join(out) == "句" * 1200


def test_short_and_blank_texts():
    assert texts("短文本") == ["短文本"] and texts("  \n ") == [] and _pack.chunks(None, 500, 80) == []


def test_heading_stays_with_its_text():
    out = texts("## 第一节概述\n\n" + "概述" * 5 + "\n\n## 第二节分类\n\n" + "分类" * 5, 200, 20)
    assert any("第一节概述" in c and "概述概述" in c for c in out)


def test_big_sections_apart_and_small_ones_together():
    big = texts("## 甲节\n\n" + "甲。" * 150 + "\n\n## 乙节\n\n" + "乙。" * 150, 500, 40)
    assert not any("甲。" in c and "乙。" in c for c in big)
    small = texts("## 【参考范围】\n\n正常。\n\n## 【临床意义】\n\n升高。", 500, 20)
    assert len(small) == 1 and "参考范围" in small[0] and "临床意义" in small[0]


def test_chapters_never_merge():
    out = texts("# 第一章 甲\n\n## 末节\n\n短。\n\n# 第二章 乙\n\n短。", 500, 20)
    assert len(out) == 2


def table(rows):
    head = ["表1-1 示例表", "", "[表格]", "| 名称 | 单位 | 范围 |", "| --- | --- | --- |"]
    return "\n".join(head + [f"| 项目{i} | g/L | {i}-{i + 1} |" for i in range(rows)])


def test_small_table_is_atomic_and_large_one_repeats_its_header():
    assert len(texts(table(4), 500, 40)) == 1
    out = texts(table(60), 300, 20)
    assert len(out) >= 2 and all("| 名称 | 单位 | 范围 |" in c for c in out)


def test_table_with_header_but_no_rows_disappears():
    assert _pack.table_parts("[表格]\n| " + "长" * 100 + " |\n| --- |", 50) == []


def test_rows_of_the_first_group_are_as_many_as_lines_above_them():
    parts = _pack.table_parts("题\n说明\n[表格]\n| a |\n| - |\n" + "\n".join(f"| {i:08d} |" for i in range(12)), 60)
    assert [p.count("\n| 0") for p in parts] == [5, 5, 2]


def test_chapter_section_and_breadcrumb():
    found = _pack.chunks("# 第二章 白细胞疾病\n\n引言。\n\n## 第一节 概述\n\n" + "正文。" * 100, 200, 20)
    assert (found[0].chapter, found[0].section) == ("第二章 白细胞疾病", None)
    assert found[1].section == "第一节 概述" and found[1].text.startswith("【第二章 白细胞疾病】\n")


def test_overlap_repeats_whole_sentences_only():
    out = texts("\n" + "".join(f"第{i:02d}句话。" for i in range(40)), 60, 14)
    assert out[1].startswith(out[0][-12:]) and len(out[0]) <= 60


def test_blocks_and_captions_as_columns_agree_with_the_helper(spark):
    cases = ["a\n\n表1 x\n\n| h |\n| 1 |\n\n# t\n\nb", "表1 x\n\n表2 y\n\n[表格]\n| 1 |", "# a\nb\n\n　\n\n#b\n\n# c", ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: [(b.kind, b.text) for b in r.b] for r in df.select("i", let(chunking.split_blocks(F.col("t")), chunking.merge_captions).alias("b")).collect()}
    assert got == {i: list(_pack.captioned(_pack.blocks(c))) for i, c in enumerate(cases)}


def test_ids_are_contiguous_and_parsed_back(spark):
    df = chunking.chunk_documents(spark.createDataFrame([("a::b.txt", "句" * 2500), ("n", None)], "source string, text string"))
    rows = df.select("idx", "chunk_id", chunking.parse_id(F.col("chunk_id")).alias("p")).orderBy("idx").collect()
    assert [r.idx for r in rows] == [0, 1, 2] and all(r.p.source == "a::b.txt" and r.p.idx == r.idx for r in rows)
    bad = spark.createDataFrame([("bad",), ("x::y",)], "c string").select(chunking.parse_id(F.col("c")).alias("p")).collect()
    assert all(r.p.source is None and r.p.idx is None for r in bad)


def test_sentences(spark):
    df = spark.createDataFrame([("甲。乙！ 丙?\n　丁.x;",)], "t string").select(chunking.split_sentences(F.col("t")).alias("s"))
    assert df.first().s == ["甲。", "乙！", "丙?", "丁.x;"]


def giant_rows():
    head = "intro text。\n\n表1 列\n\n[表格]\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n"
    chapters = "".join(f"# 第{n}章 {n}题\n\n" + "开头句子。" * 30 + f"\n\n## 节{n}\n\n" + "内容！" * 90 + "\n\n短。\n\n## 又\n\n短" + "\n\n   " for n in "一二三四")
    same = "# 第一章 甲\n\n## 末\n\n短。\n\n# 第一章 甲\n\n## 再\n\n短。\n\n# 第二章 乙\n\n# 第三章 丙\n\n尾。"
    return {"giant": head + chapters, "same name": same, "plain": "  一行 ", "bare heading": "# 第一章 甲", "heading only": "# 第一章 甲\n\n# 第二章 乙\n", "blank": " \n\n ", "null": None, "caption at the end": "正文。\n\n表2 末\n\n# 第一章 甲\n\n[表格]\n| x |", "long line": "句。" * 900}


def test_giant_documents_are_chunked_like_others(spark):
    df = spark.createDataFrame(list(giant_rows().items()), "source string, text string")
    rows = lambda out: sorted(map(tuple, out.select("chunk_id", "source", "idx", "text", "chapter", "section").collect()))
    for size, overlap in ((500, 80), (60, 20), (2000, 0)):
        assert rows(chunking.chunk_giants(df, chunk_size=size, overlap=overlap)) == rows(chunking.chunk_documents(df, chunk_size=size, overlap=overlap))


def test_chapters_of_one_book_are_dealt_over_tasks(spark):
    book = "".join(f"# 第{n}章 题{k}\n\n" + f"第{k}句。" * 200 + "\n\n" for k, n in enumerate("一二三四五六七八九十" * 20))
    df = spark.createDataFrame([("book", book)], "source string, text string")
    parts = df.select("source", F.posexplode(chunking.chapter_parts(F.col("text"), 500)).alias("part", "blocks"))
    assert parts.count() == 200 and parts.repartition(8, "source", "part").select(F.spark_partition_id().alias("p")).distinct().count() == 8
    want = [c.text for c in _pack.chunks(book, 500, 80)]
    assert [r.text for r in chunking.chunk_giants(df, chunk_size=500, overlap=80).orderBy("idx").collect()] == want


def test_chapters_are_packed_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(chunking, "PARTS", 3)
    held = {f"{name} {i}": t for name, t in giant_rows().items() for i in range(4)}
    df = spark.createDataFrame(list(held.items()), "source string, text string").coalesce(1)
    rows = lambda out: sorted(map(tuple, out.select("chunk_id", "source", "idx", "text", "chapter", "section").collect()))
    assert rows(chunking.chunk_giants(df, chunk_size=60, overlap=20)) == rows(chunking.chunk_documents(df, chunk_size=60, overlap=20))


def brute_words(run, counts, longest):
    total = sum(counts.values())
    weight = lambda n: round(1_000_000 * (math.log(n) - math.log(total)))
    best = {len(run): (0, len(run))}
    for i in range(len(run) - 1, -1, -1):
        ways = [(weight(1) + best[i + 1][0], i + 1)] + [(weight(counts[run[i:j]]) + best[j][0], j) for j in range(i + 1, min(len(run), i + longest) + 1) if run[i:j] in counts]
        best[i] = max(ways)
    out, i = [], 0
    while i < len(run):
        out.append(run[i : best[i][1]])
        i = best[i][1]
    return out


def test_segmentation_takes_the_best_path(spark):
    counts = {"检验": 40, "检验结果": 9, "结果": 30, "分析": 25, "果分": 50, "的": 200, "临床检验": 3, "一" * 30: 900}
    dictionary = spark.createDataFrame(list(counts.items()), "word string, n long")
    rng = random.Random(0)
    runs = ["临床检验结果分析的检验", "未知词检验", "一" * 30, *("".join(rng.choice("检验结果分析的临床") for _ in range(rng.randrange(1, 40))) for _ in range(60))]
    rows = [(i, f"Hb {r}, g/L {r}") for i, r in enumerate(runs)] + [(-1, None), (-2, " "), (-3, "abc 12")]
    got = {r.chunk_id: r.tokens for r in segment.segment(spark.createDataFrame(rows, "chunk_id long, text string").repartition(3), dictionary).collect()}
    assert len(got) == len(rows) and got[-1] == got[-2] == [] and got[-3] == ["abc", "12"]
    for i, r in enumerate(runs):
        words = brute_words(r, counts, segment.LONGEST)
        assert got[i] == ["Hb", *words, ",", "g", "/", "L", *words]


def test_segmented_texts_are_indexed(spark):
    chunks = spark.createDataFrame([(1, "检验结果"), (2, "结果分析"), (3, "分析")], "chunk_id long, text string")
    dictionary = segment.learn(spark.createDataFrame([("结果 结果 分析 分析 检验",)], "text string"), tokenizer=lambda t: F.split(t, " "))
    assert {r.word for r in dictionary.collect()} == {"结果", "分析"}
    posted, _, _ = bm25.build_index(segment.segment(chunks, dictionary), text_col="tokens", tokenizer=lambda t: t)
    assert {(r.term, r.chunk_id) for r in posted.collect()} == {("检", 1), ("验", 1), ("结果", 1), ("结果", 2), ("分析", 2), ("分析", 3)}
