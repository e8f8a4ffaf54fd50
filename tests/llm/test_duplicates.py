"""Near-dedup, fingerprints and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from corpusloom.llm import fingerprints, near_dedup, substring
from corpusloom.llm.components import components
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, set_key string, variant string"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(docs, width, percent):
    sets = {i: shingles(t, width) for i, t in docs.items() if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: find(i) for i in sets}, sets


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "own", "own") for i, t in docs.items()], SCHEMA).repartition(5)


def near_copies(seed=3, n=150):
    """A group of copies with few to many edits, so that many pairs lie on either side of the threshold, and loners."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(40)}" for _ in range(150)]
    docs = {}
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(150)] = f"x{rng.random()}"
        docs[1000 + i] = " ".join(copy)
    docs |= {i: " ".join(f"y{rng.random()}" for _ in range(rng.randrange(1, 30))) for i in range(40)}
    return docs


def odd_texts():
    long = " ".join(f"t{i % 977} u{i}" for i in range(30_000))
    return {1: None, 2: "", 3: " \t\n", 4: "one", 5: "ONE", 6: "one two three", 7: "One two\x0bthree ", 8: "one two", 9: long, 10: long + " end", 11: "É a b c d", 12: "é a b c d", None: "one"}


@pytest.mark.parametrize("docs,width", [(near_copies(), 4), (odd_texts(), 4), (odd_texts(), 5)])
def test_near_dedup_finds_all_links(spark, docs, width):
    want, sets = brute_components(docs, width, 80)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, docs), width).collect()}
    assert len(got) == len(docs)
    for i, r in got.items():
        if i is not None:
            assert (r.component_id, r.n_shingles, r.kept) == (want[i], len(sets[i]), want[i] == i)
    if None in got:
        assert got[None].component_id is None and got[None].kept


def test_prefix_filter_alone_finds_all_links(spark):
    docs = near_copies(5, 60)
    want, _ = brute_components(docs, 4, 80)
    df = frame(spark, docs)
    classes = near_dedup.features(df).select("set_key", "doc_id", F.col("n_shingles").alias("n"), "lanes").dropDuplicates(["set_key"])
    rest = classes.select("set_key", F.col("set_key").alias("root"))
    linked = near_dedup.confirm(near_dedup.open_pairs(rest, classes, df, 4, 80), classes, df, 4, 80)
    ids = {r.set_key: r.doc_id for r in classes.collect()}
    groups = {}
    for r in components(linked).collect():
        groups.setdefault(r.root, set()).add(ids[r.node])
    expected = {}
    for i, c in want.items():
        if i in ids.values():
            expected.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_keep_one_keeps_columns_and_one_row_an_id(spark):
    docs = frame(spark, near_copies(4, 30))
    twice = docs.unionByName(docs.filter("doc_id % 3 = 0"))
    want, _ = brute_components(near_copies(4, 30), 5, 80)
    got = near_dedup.keep_one(twice, 5)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))
    assert near_dedup.keep_one(docs.limit(0), 5).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    one, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, one, "x"), (5, one, "y"), (5, other, "z"), (5, other, "z"), (7, other, "w"), (8, None, "v"), (None, one, "u"), (None, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((tuple(r) for r in near_dedup.keep_one(docs, 5).collect()), key=repr)
    assert got == sorted([(3, one, "x"), (5, other, "z"), (8, None, "v"), (None, one, "u"), (None, None, "t")], key=repr)


def test_super_minhash_estimates_with_low_variance():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 150).astype(np.uint64)
        y = np.concatenate([x[:100], rng.integers(0, 2**63, 50).astype(np.uint64)])
        sig = near_dedup.super_minhash(np.concatenate([x, y]), np.array([0, 150, 300]))
        errors.append((sig[0] == sig[1]).mean() - 100 / 200)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045


def test_signature_of_a_very_large_set_is_that_of_its_parts(monkeypatch):
    elements = np.arange(1, 501, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = near_dedup.super_minhash(elements, np.array([0, 500]))
    monkeypatch.setattr(near_dedup, "ELEMENTS", 77)
    assert (near_dedup._signature(elements, np.array([0, 500])) == whole).all()


def test_agreeing_counts_equal_lanes(spark):
    a = np.arange(128, dtype=np.uint8)
    b = a.copy()
    b[::3] ^= 0x80
    df = spark.createDataFrame([([int(x) for x in a.view(np.int64)], [int(x) for x in b.view(np.int64)])], "a array<long>, b array<long>")
    assert df.select(near_dedup.agreeing(F.col("a"), F.col("b")).alias("n")).first().n == int((a == b).sum())


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {1000 + i: 1000 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_lose_no_pair_before_verification():
    """Of pairs whose sets are as unlike as linked ones may be, all agree in AGREE positions or more (76 of 102 expected)."""
    rng, least = np.random.default_rng(0), near_dedup.POSITIONS
    for size, pairs in ((5, 1500), (45, 1500), (900, 150)):
        shared = size * 8 // 9 + (size * 8 % 9 > 0)  # 100 * shared >= 80 * union with two sets of this size
        assert 100 * shared >= 80 * (2 * size - shared)
        held = rng.integers(0, 2**63, (pairs, 2 * size - shared)).astype(np.uint64)
        both = np.concatenate([held[:, :size], held[:, size - shared :]], axis=1).ravel()
        values = near_dedup.super_minhash(both, np.arange(2 * pairs + 1) * size).reshape(pairs, 2, -1)
        low = values.astype(np.uint64) & np.uint64(0xFF)
        least = min(least, int((low[:, 0] == low[:, 1]).sum(axis=1).min()))
    assert least >= near_dedup.AGREE


# -------------------------------------------------------------------------------------------------------- fingerprints


def test_fingerprints_of_edits_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 4)
    rng = random.Random(1)
    docs = {7 * i * i: " ".join(f"v{rng.randrange(10_000)}é" for _ in range(300)) for i in range(40)} | {3: None, 5: "", 8: "a b", 9: "A  b", 2000: "x " * 4000, 2001: " ".join(f"w{i}" for i in range(40_000))}
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(frame(spark, docs)).collect()}
    order = sorted(docs)
    for k, i in enumerate(order):
        text, following = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        x, y, z = (shingles(t, 5) for t in (text, edited, following))
        for value, other in ((got[i].near_edited, y), (got[i].near_next, z)):
            exact = len(x & other) / len(x | other) if x | other else 1.0
            assert abs(value - exact) < 0.2
    assert got[8].fingerprint == got[9].fingerprint and len(got[8].fingerprint) == 128 and got[3].fingerprint == got[5].fingerprint == ""


def test_fingerprints_of_repeated_rows_null_ids_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = fingerprints.fingerprint_documents(df).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 2
    assert fingerprints.fingerprint_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("per_range", [3, 10**6])
def test_next_documents_of_far_and_frequent_ids(spark, monkeypatch, per_range):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", per_range)
    far = [-(2**62) - 5, -(2**63), 2**62 + 9, 2**63 - 1]
    rows = [(i, f"text {i}") for i in [*far, *range(30)]] + [(7, f"again {i}") for i in range(40)] + [(None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tied = df.withColumn("tie", F.xxhash64("text"))
    got = [tuple(r) for r in fingerprints.with_next(tied, "doc_id", ["text"], fingerprints.range_bounds(df, "doc_id"), "tie").drop("tie").collect()]
    assert sorted(r[:2] for r in got if r[0] is not None) == sorted(r for r in rows if r[0] is not None) and len(got) == len(rows)
    assert [r[2] for r in got if r[0] is None] == [None, None]
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], hashed[r[1]]))
    assert {(i, t): n for i, t, n in got if i is not None} == {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    if per_range == 3:  # no range has much more than its share, though one id has more than half of all rows
        bounds = sorted(df.agg(F.percentile_approx("doc_id", [k / 20 for k in range(1, 20)])).first()[0])
        spread = F.pmod(F.xxhash64("text"), F.lit(1000)) / 1000
        held = F.struct(F.lit(bounds).alias("all"), F.lit(bounds[::4]).alias("every"))
        sizes = df.filter("doc_id is not null").groupBy(fingerprints._range(F.col("doc_id"), spread, held, 4).alias("b")).count().collect()
        assert max(r["count"] for r in sizes) < 20


def test_densified_values_fill_all_bins(spark):
    text = " ".join(f"q{i}" for i in range(24))  # 20 shingles in 128 bins
    same = spark.createDataFrame([(text,)], "t string").select(fingerprints.as_text(fingerprints.fingerprint(F.col("t"))).alias("f")).first().f
    assert len(same) == 128 and len(set(same)) > 6


# ----------------------------------------------------------------------------------------------------- substring dedup


def brute_repeats(docs, width=13):
    first = {}
    for i in sorted(k for k in docs if k is not None):
        w = words(docs[i])
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, t in docs.items():
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def passages(seed, n=60):
    rng = random.Random(seed)
    shared = [[f"s{rng.randrange(30)}" for _ in range(rng.randrange(5, 60))] for _ in range(8)]
    docs = {}
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += [f"r{rng.randrange(4)}"] * rng.choice([0, 0, 14, 30])
            parts += [f"u{rng.random()}" for _ in range(rng.randrange(20))] + (rng.choice(shared) if rng.random() < 0.7 else [])
        docs[i * 3] = "  ".join(parts)
    docs[1], docs[4], docs[200], docs[201] = None, "", docs[3], docs[3]
    docs[None] = docs[6]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_removed_as_by_brute_force(spark, seed):
    docs = passages(seed)
    got = {r.doc_id: r for r in substring.remove_repeats(frame(spark, docs)).collect()}
    assert {i: (r.n_words, r.n_removed, r.text) for i, r in got.items()} == brute_repeats(docs)
    assert got[3].variant == "own"


def test_repeats_with_layout_other_widths_repeated_rows_and_nothing(spark):
    docs = {1: "a b\nc d", 2: "x a b c", 3: "y\n\nz"}
    got = {r.doc_id: (r.text, r.n_removed) for r in substring.remove_repeats(frame(spark, docs), width=3, keep_layout=True).collect()}
    assert got == {1: ("a b\nc d", 0), 2: ("x", 3), 3: ("y\n\nz", 0)}
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "z a b c"), (2, "q a b c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring.remove_repeats(twice, width=3).collect()) == [(1, 0), (1, 0), (1, 0), (2, 3)]
    assert substring.remove_repeats(frame(spark, docs).limit(0)).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    vocabulary = substring.mix(np.arange(1, 13, dtype=np.uint64))
    text = vocabulary[rng.integers(0, 12, 4000)]
    passage = vocabulary[rng.integers(0, 12, 40)]
    for at in (100, 1500, 2600, 3960):
        text[at : at + 40] = passage
    row = (np.arange(4000) >= 2000).astype(np.int64)
    first, anchor, own = substring.anchors(text, row)
    by_window: dict[int, set[int]] = {}
    for a, w in zip(anchor.tolist(), own.tolist(), strict=True):
        by_window.setdefault(w, set()).add(a)
    assert all(len(a) == 1 for a in by_window.values()) and len(by_window) < len(first)


def test_symbols_cover_what_they_say():
    names, first, last, lo, hi = substring.symbols(substring.mix(np.arange(1, 200, dtype=np.uint64)), np.zeros(199, np.int64))
    assert (lo <= first).all() and (hi >= last).all() and (last - first >= 2).all() and len(np.unique(names)) == len(names)


@pytest.mark.parametrize("lower", [False, True])
@pytest.mark.parametrize("filled", [False, True])
@pytest.mark.parametrize("start", [0, 1, 7])
def test_words_split_like_the_pattern(lower, filled, start):
    from corpusloom.llm.common import words_of

    texts = [" a\x0bb\x1cc  d ", None, "", "\u00a0x\u2003y z", "Z z É", "The cat THE Cat"] * 3
    texts = [t or "" for t in texts] if filled else texts
    codes, offsets, distinct = words_of(pa.array(texts).slice(start, 8), lower)
    listed = distinct.to_pylist()
    assert len(set(listed)) == len(listed)
    want = [words((t or "").translate(LOWER) if lower else t) for t in texts[start : start + 8]]
    assert [[listed[c] for c in codes[i:j]] for i, j in zip(offsets[:-1], offsets[1:])] == want


@pytest.mark.parametrize("limit", [40, 1000, 10**9])
def test_features_do_not_depend_on_slices(spark, monkeypatch, limit):
    """Batches above and below the slice size, with nulls and repeated rows, give the sets of brute force."""
    from corpusloom.llm import common

    docs = near_copies(6, 20) | odd_texts()
    want = {i: len(shingles(t, 4)) for i, t in docs.items()}
    texts = pa.array([t for t in docs.values()], pa.string())
    got = []
    for start, stop in common.slices(texts, limit):
        elements, offsets = near_dedup.shingle_sets(texts.slice(start, stop - start), 4)
        got += np.diff(offsets).tolist()
    assert got == list(want.values())
