from pathlib import Path

import pandas as pd
import pytest
from compare import assert_same
from corpusloom.functions import text as T
from corpusloom.index_queries import ORACLES, QUERIES
from corpusloom.operators import augment, clean
from pyspark.sql import functions as F


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expression(F.col("t")).alias("r")).first().r


def long_books(sf, folder):
    """The given tables with other documents: a short text and two of more than a thousand lines, one of them under a page rule."""
    texts = [(0, "src1", 3), (1, "src1", 1015), (2, "src2", 1003)]
    rows = [(i, "\n".join(f"line {n} of book {i}" for n in range(k)), "en", source) for i, source, k in texts]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).to_parquet(folder / "documents.parquet")
    for table in Path(sf).iterdir():
        if table.name != "documents.parquet":
            (folder / table.name).symlink_to(table)
    return str(folder)


def test_strip_and_lines_are_unicode_aware(spark):
    assert one(spark, "　 a b \n\x1c", T.strip) == "a b"
    assert one(spark, "a\r\nb\x0bc d\n", T.split_lines) == ["a", "b", "c", "d"]


def test_split_pages_drops_the_preamble(spark):
    text = "前言\n===== 第 3 页 =====\na\nb\n===== 第4页 =====\n===== 第 5 页 =====\nc"
    got = one(spark, text, clean.split_pages)
    assert [(p.page_no, list(p.lines)) for p in got] == [(3, ["a", "b"]), (4, []), (5, ["c"])]


def test_page_edges(spark):
    cases = {
        ("12",): [], ("38一第二章", "x"): ["x"], ("第二章" + "长" * 27, "x"): ["x"], ("第二章" + "长" * 28, "x"): ["第二章" + "长" * 28, "x"],
        ("", "x", "561", ""): ["", "x", ""], ("x", "1234"): ["x", "1234"], (): [],
    }
    for lines, kept in cases.items():
        assert one(spark, list(lines), clean.strip_page_edges, "array<string>") == kept


def test_a_page_loses_its_own_number_however_long(spark):
    text = "".join(f"===== 第 {n} 页 =====\n{n}第一章\nbody {n}\n\n{last}\n" for n, last in ((999, 999), (1000, 1000), (1001, 1234), (20000, "20000 ")))
    got = clean.clean_pages(spark.createDataFrame([("s", text)], "source string, text string")).first().pages
    assert [(p.page_no, p.changed, p.body) for p in got] == [(999, True, "body 999"), (1000, True, "body 1000"), (1001, True, "body 1001\n\n1234"), (20000, True, "body 20000")]


@pytest.mark.parametrize("name", ["clean_pages", "clean_text", "cleaning_stats", "heading_context"])
def test_books_of_more_than_a_thousand_pages_are_those_of_the_sql(spark, sf, tmp_path, name):
    folder = long_books(sf, tmp_path)
    assert_same(QUERIES[name](spark, folder), ORACLES[name], folder)


def test_running_headers_anywhere(spark):
    assert one(spark, ["12第三章贫血的检验", "见第三章。", "a"], clean.drop_running_headers, "array<string>") == ["见第三章。", "a"]


def test_references(spark):
    got = one(spark, "a\n## 参考文献\n[1] x\n##参考文献\n[2]\n# B\nb\n# 参考文献\n[3]", clean.strip_references)
    assert (got.text, got.removed) == ("a\n# B\nb", 3)
    got = one(spark, "a\n## 参考文献\n# B", clean.strip_references)
    assert (got.text, got.removed) == ("a\n# B", 1)


def test_references_of_any_mixture_of_lines(spark):
    import random
    import re

    rng = random.Random(2)
    kinds = ["a", "", "## 参考文献", "##参考文献 ", "# B", "#\u3000C", "#no", "## 参考文献 x", "\u3000", "b\r"]
    texts = ["\n".join(rng.choice(kinds) for _ in range(rng.randrange(9))) for _ in range(400)] + ["\n".join(kinds * 3000)]

    def naive(text):
        out, inside, n = [], False, 0
        for line in text.split("\n"):
            if re.search(r"^#{1,6}\s*参考文献\s*\Z", line):
                inside, n = True, n + 1
            elif re.search(r"^#{1,6}\s", line):
                inside = False
            if not inside:
                out.append(line)
        return "\n".join(out), n

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clean.strip_references(F.col("t")).alias("r")).collect()
    assert [(r.r.text, r.r.removed) for r in rows] == [naive(r.t) for r in rows]


def test_tables_to_markdown(spark):
    kind = "array<array<string>>"
    assert one(spark, [["a", None], ["x\ny ", "b", "c"], ["", " "]], clean.table_to_markdown, kind) == "| a |  |  |\n| --- | --- | --- |\n| x y | b | c |"
    assert one(spark, [["", None]], clean.table_to_markdown, kind) == ""


def test_html(spark):
    html = '<div>a <120</div><table class="x"><tr><th>h</th></tr><tr><td><b>1</b></td></tr></table>\n\n\n\n<p>z</p><TABLE></TABLE>'
    assert one(spark, html, clean.html_to_text) == "a <120\n[表格]\n| h |\n| --- |\n| 1 |\n\nz"


def test_detect_columns(spark):
    def boxes(n_left, n_right, n_over):
        return [(0.0, 40.0)] * n_left + [(60.0, 90.0)] * n_right + [(10.0, 90.0)] * n_over

    cases = {"a": boxes(20, 19, 0), "b": boxes(20, 20, 0), "c": boxes(47, 47, 6), "d": boxes(47, 48, 5), "e": boxes(30, 10, 0)}
    rows = [(k, x0, x1, 100.0) for k, v in cases.items() for x0, x1 in v]
    got = {r.k: r.n_columns for r in clean.detect_columns(spark.createDataFrame(rows, "k string, x0 double, x1 double, page_width double"), ["k"]).collect()}
    assert got == {"a": 1, "b": 2, "c": 1, "d": 2, "e": 1}


def test_linearize_and_augment(spark):
    block = "表1 血\n[表格]\n| 项 | 值 | 注 |\n| --- | --- | --- |\n| 钠 | 140 | |\n| | | |\n| 钾 | 4 | x |"
    assert one(spark, block, augment.linearize_table) == "表1 血\n钠:140\n钾:4、x"
    assert one(spark, "| 只 | 一行 |", augment.linearize_table) == "只:一行"
    assert one(spark, "没有表", augment.augment_tables) == "没有表"
    assert one(spark, "表1 血\n\n| a | b |\n| 1 | 2 |", augment.augment_tables).endswith("【表格说明】\n表1 血\n1:2")


def test_thoughts_and_generated_text(spark):
    assert one(spark, "<think>a\nb</think> x <think></think>", augment.strip_think) == "x"
    assert one(spark, "x<think>y", augment.strip_think) == ""
    assert one(spark, "  " + "z" * 500, lambda c: augment.cut_generated(c, 10)) == "z" * 10


def test_enrich_uses_and_prunes_the_cache(spark):
    chunks = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b"), ("4", "bad")], "chunk_id string, text string")
    cache = spark.createDataFrame([("default", "a"), ("default", "zz"), ("other", "b")], "generator string, k string").select("generator", F.sha1("k").alias("text_key"), F.lit("kept").alias("generated"))
    out, after = augment.enrich_cached(chunks, cache, lambda s: s.map(lambda p: None if "bad" in p else f"<think>t</think>gen {p[-1]}"), "{n}{chunk}")
    rows = {r.chunk_id: r for r in out.collect()}
    assert rows["1"].text.endswith("【检索增强】\nkept") and rows["1"].reused and not rows["2"].reused
    assert rows["2"].text == rows["3"].text == "b\n\n【检索增强】\ngen b" and rows["4"].text == "bad" and not rows["4"].enriched
    assert after.count() == 2


def test_strip_takes_the_white_space_of_the_pattern_and_looks_at_no_pattern(spark):
    import re

    from corpusloom.functions.text import SPACE, WHITE, strip
    from pyspark.sql import functions as F

    space = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\u" + m[1].zfill(4), SPACE) + "]")
    assert set(WHITE) == {chr(c) for c in range(0x10000) if space.match(chr(c))}
    texts = [f"{c}a{c}b{c}" for c in WHITE] + ["", WHITE, "é\u200b ", "\u3000\n表 1\t\x1f", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s"))
    assert all(r.s == (None if r.t is None else r.t.strip(WHITE)) for r in got.collect())
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()
