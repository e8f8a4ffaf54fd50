"""URL filters, license scans and the Bloom filter."""

import duckdb
import numpy as np
import pytest
from compare import assert_same
from corpusloom.llm import bloom, licenses, queries, url_filter
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)


URLS = [
    ("http://A.Example.ORG/es/x", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("https://example.org/en/12?q#f", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://x.com/fr", "x.com", "/fr", None, "allow"),
    ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com/de/?a", "x.com", "/de/", "com/de/", "block"),
    ("http://com?/de/", "com", "", None, "allow"),
    ("mailto:a@b", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://É.ORG/#x://y", "É.org", "/", "org/", "allow"),
    ("a://x.org?y", "x.org", "", None, "allow"),
    ("http://www.bad.net/p/?utm_source=z&b=2&a=1", "www.bad.net", "/p/", None, "block"),
]


def test_rules_and_list(spark):
    rows = [(i, u, "mine") for i, (u, *_) in enumerate(URLS)] + [(0, URLS[0][0], "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://bad.net:443/p?a=1&b=2&ref=q",), (None,), ("nothing",), ("http://org.net/",)], "url string")
    got = url_filter.filter_urls(pages, listed).orderBy("page_id").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:]


def test_no_pages_and_no_list(spark):
    pages, none = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string"), spark.createDataFrame([], "url string")
    assert [r.verdict for r in url_filter.filter_urls(pages, none).collect()] == ["allow"]
    assert url_filter.filter_urls(pages.limit(0), pages).count() == 0


def test_native_plan(spark, sf):
    plan = queries.QUERIES["op1_url_filter"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bloom_split_is_exact_even_when_full(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    listed = spark.range(0, 2000, 3).select(F.col("id").cast("string").alias("k"))
    for most in (18, 1):
        hits, rest = bloom.split(df, "k", listed, 667, max_log2=most)
        assert {int(r.k) for r in hits.collect()} == set(range(0, 2000, 3)) and rest.count() == 2001 - 667


def test_bloom_rejects_most_others(spark):
    listed = spark.range(5000).select(F.xxhash64("id").alias("h"))
    blocks = bloom.collect_hashed(listed, "h", 5000)
    inside = np.array([r.h for r in listed.collect()]).view(np.uint64)
    outside = np.array([r.h for r in spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h")).collect()]).view(np.uint64)
    assert bloom.may_hold(blocks, inside).all() and bloom.may_hold(blocks, outside).mean() < 0.02
    log2 = bloom.log2_blocks(5000)
    flagged = bloom.probe(spark.range(10_000, 30_000), "id", bloom.build(spark.range(5000), "id", log2), log2, "m")
    assert flagged.filter("m").count() < 400


def test_license_spellings(spark):
    known = spark.createDataFrame(licenses.KNOWN, "license_id string, text string")
    mit = licenses.KNOWN[0][1]
    docs = {
        1: mit, 2: "Copyright (c) 2019 Someone\n\n" + mit.upper().replace("\n", "\n\n").replace("SUBLICENSE", "SUB-LICENSE"),
        3: "words\nLicenced  under the *Apache Licence* v2.0\nmore", 4: mit + " and more", 5: None, 6: "", 7: "!!! ...",
        8: "Released under the MIT License.\nreleased under the MIT license\nLicensed under CC BY-NC 4.0.",
    }
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), known).collect()}
    assert got[1].whole_license == got[2].whole_license == "MIT"
    assert got[3].licenses == ["Apache-2.0"] and got[3].whole_license is None and got[3].n_license_lines == 1
    assert got[4].whole_license is None and all(got[i].licenses == [] and got[i].text_digest is None for i in (5, 6, 7))
    assert got[8].licenses == ["CC-BY-NC-4.0", "MIT"] and got[8].n_license_lines == 3


def test_full_license_texts(spark, tmp_path):
    known = licenses.known_texts()
    full = {i: t for i, t in known if len(t) > 900}
    assert {"MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0"} <= set(full)
    want = [(i, t.replace("\n\n", "\n \n")) for i, t in full.items()] + [("Apache-2.0", full["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 Someone Else"))]
    mit = licenses.KNOWN[1][1]
    for line in (
        "Copyright (c) The Regents of the University of California, 1998", "Copyright (c) Facebook, Inc. and its affiliates.", "# Copyright Facebook, Inc. and its affiliates.",
        "© The Very Long Name of a Holder, Limited", "Copyright: nobody", " " * 24 + "Copyright (c) 2019 Someone", " *" * 30 + " Copyright Someone", "\t" * 25 + "Portions (c)" + " " * 30 + "2019 Someone", "(c) The Regents of the University of California, 1998", "COPYRIGHT 2001-2005 BY SOMEONE",
    ):
        want += [("MIT", "MIT License\n\n" + line + "\n\n" + mit), ("BSD-3-Clause", line + "\n" + full["BSD-3-Clause"])]
    # lines wrapped before a word that starts like a copyright line
    want += [("MIT", mit.replace(" " + w, "\n" + w)) for w in ("copyright notice", "COPYRIGHT HOLDERS")] + [("BSD-3-Clause", full["BSD-3-Clause"].replace(" copyright", "\ncopyright").replace(" COPYRIGHT", "\nCOPYRIGHT"))]
    want += [("GPL-3.0", full["GPL-3.0"].replace(" copyright ", "\ncopyright ")), (None, "(c) the third item\nof a list"), (None, "Copyright (c) Facebook, Inc.")]
    docs = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs, spark.createDataFrame(known, "license_id string, text string")).collect()}
    assert [(n, got[n].whole_license) for n in range(len(want))] == [(n, i) for n, (i, _) in enumerate(want)]
    assert got[len(want) - 2].text_digest is not None and got[len(want) - 1].text_digest is None
    # the query's SQL says the same of these texts
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    said = con.execute("SELECT doc_id, text_digest, whole_license, licenses, n_license_lines FROM (" + queries.ORACLES["op9_license_scan"] + ")").fetchall()
    assert sorted(said) == sorted(tuple(r) for r in queries.QUERIES["op9_license_scan"](spark, str(tmp_path)).select("doc_id", "text_digest", "whole_license", "licenses", "n_license_lines").collect())


def test_license_scan_of_nothing_and_of_repeated_rows(spark):
    known = spark.createDataFrame(licenses.KNOWN, "license_id string, text string")
    docs = spark.createDataFrame([(1, "x\nReleased under the MIT License."), (1, "x\nReleased under the MIT License."), (None, "y")], "doc_id long, text string")
    assert licenses.scan(docs, known).count() == 3 and licenses.scan(docs.limit(0), known).count() == 0
    assert licenses.scan(docs, known.limit(0)).filter("size(licenses) > 0").count() == 0


def test_licenses_are_found_row_by_row_and_alike_with_a_long_list(spark):
    known = spark.createDataFrame(licenses.KNOWN, "license_id string, text string")
    one = "a\nReleased under the MIT License."
    rows = [(1, one, "x"), (1, one, "y"), (1, "no notice", "z"), (None, one + "\n" + one, None), (None, None, None), (2, "", ""), (3, "Licensed under CC0 1.0.", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    few, many = ([tuple(r) for r in licenses.scan(docs, known, max_broadcast=n).collect()] for n in (1000, 0))
    assert sorted(few, key=repr) == sorted(many, key=repr)
    found = sorted(((r[0], tuple(r[3]), r[4]) for r in few), key=repr)
    assert found == sorted([(1, ("MIT",), 1), (1, ("MIT",), 1), (1, (), 0), (None, ("MIT",), 2), (None, (), 0), (2, (), 0), (3, ("CC0-1.0",), 1)], key=repr)
