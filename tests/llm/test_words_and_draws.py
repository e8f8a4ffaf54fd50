"""Collocations, rank-array BPE and resampling against brute force and the vocabulary's own library."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from corpusloom.llm import collocations, common, queries, rank_array, resampling
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

JSON = P.path("byte_bpe_50k.json")
LETTERS = st.text(st.sampled_from("aB.\n\t \x0bé!"), max_size=30)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), LETTERS), max_size=6))
def test_mapped_words_are_words_of_parts(texts):
    codes, offsets, distinct, part = common.mapped_words(pa.array(texts, pa.string()), collocations.TABLE)
    words, got = distinct.to_pylist(), []
    for i, j in zip(offsets[:-1], offsets[1:], strict=True):
        pieces = {}
        for c, p in zip(codes[i:j].tolist(), part[i:j].tolist(), strict=True):
            pieces.setdefault(p, []).append(words[c])
        got.append(list(pieces.values()))
    want = [[w for w in (re.findall(r"[^\x20\x09]+", s) for s in re.split(r"[.,;:!?\x0A-\x0D]", lower(t))) if w] for t in texts]
    assert got == want and list(part) == sorted(part)
    sliced = common.mapped_words(pa.array([None, "zz", *texts], pa.string()).slice(2), collocations.TABLE)
    assert sliced[2].to_pylist() == words and sliced[1].tolist() == offsets.tolist()


# -------------------------------------------------------------------------------------------------------- collocations


def brute_collocations(rows, least=10, percent=50, top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    counts[lang or "und", tuple(w[i : i + n])] += 1
    frequent = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= least}
    found = {}
    for (lang, p), a in frequent.items():
        if any(q[0] == lang and len(q[1]) > len(p) and any(q[1][i : i + len(p)] == p for i in range(len(q[1]))) and 100 * f >= percent * a for q, f in frequent.items()):
            continue
        score, k = min((1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    out = []
    for lang, rows in found.items():
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def little_corpus(seed, n=120):
    r = random.Random(seed)
    words = ["The", "cat", "sat", "on", "é", "mat", "x" * 30, "a\u0085b", "\x01"]
    texts = [None, "", " \t ", ".,;", "The cat sat. " * 40, "on on on on " * 15]
    texts += ["".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ". ", "\n", ",", "  "]) for _ in range(r.randrange(1, 25))) for _ in range(n)]
    return [(r.choice([None, i, 7]), t, r.choice(["en", "de", None])) for i, t in enumerate(texts)]


def mined(spark, rows, hashing=None, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "text AS phrase", "1 AS n", "2L AS fp").repartition(5)
    return sorted(tuple(r) for r in collocations.collocations(df, hashing=hashing, **more).collect())


@pytest.mark.parametrize("hashing", [None, collocations.Hashing(base=1, bits=2)], ids=["as it is", "colliding"])
def test_collocations_are_those_of_brute_force(spark, hashing):
    rows = little_corpus(1)
    want = brute_collocations(rows)
    assert len({len(r[2].split(" ")) for r in want}) == 2 and mined(spark, rows, hashing) == want


def test_collocations_ties_repeats_and_limits(spark):
    rows = little_corpus(2, 40) * 3 + [(9, "b a c\nb a\na c", "en")] * 40
    assert mined(spark, rows, least=5, percent=80, top=3) == brute_collocations(rows, 5, 80, 3)
    assert mined(spark, rows[:4]) == [] and mined(spark, []) == []


def test_fingerprints_follow_the_algebra():
    h = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for hashing in (collocations.Hashing(), collocations.Hashing(base=3)):
        one, two, three = hashing.runs(h, (1, 2, 3))
        want = [(int(a) * hashing.base**2 + int(b) * hashing.base + int(c)) % 2**64 for a, b, c in zip(h, h[1:], h[2:], strict=False)]
        assert (one == h).all() and three.tolist() == want
        assert (hashing.rest(three, h[:-2], 2) == two[1:]).all() and (hashing.rest(three, two[:-1], 1) == h[2:]).all()
        assert [len(x) for x in hashing.runs(h[:1], (1, 2, 3))] == [1, 0, 0]


# ------------------------------------------------------------------------------------------------------ rank-array BPE

TEXTS = ["", None, " ", "it's 12,3 o'clock!!  \n\n x", "É ñ ß 中文 　y", "<|endoftext|>", "b <|endoftext|><|endoftext|>c <|endoft", "\x01 z", "tab\there \r\n", "the " * 30000, "ab1" * 400, " " * 500 + "z", "🙂🙂 ok", "͸\U0001fae8 Ᲊx Ⱟ́a", "x" * 700 + " y", "a"]


def test_rank_array_gives_the_librarys_ids_and_texts(spark):
    tok = Tokenizer.from_file(JSON)
    rows = [(i if i else None, t, "own") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string").repartition(3)
    got = rank_array.encode_documents(df, JSON)
    assert got.columns == ["doc_id", "id_bytes", "ids", "decoded"] and got.count() == len(rows)
    for r in got.withColumn("again", rank_array.decode(got["id_bytes"], JSON)).collect():
        want = tok.encode(TEXTS[r.doc_id or 0] or "", add_special_tokens=False).ids
        assert r.ids == want and np.frombuffer(r.id_bytes, "<u4").tolist() == want
        assert r.decoded == r.again == tok.decode(want, skip_special_tokens=False)
    assert rank_array.encode_documents(df.limit(0), JSON).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(st.sampled_from("abéth  .\n'sl0"), max_size=120)), max_size=8))
def test_rank_array_on_any_text(texts):
    tok, encoder = Tokenizer.from_file(JSON), rank_array.held(JSON)
    flat, rows = encoder.encode(pa.array(texts, pa.string()))
    assert [flat[i:j].tolist() for i, j in zip(rows[:-1], rows[1:], strict=True)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.decode(flat, rows).to_pylist() == texts


def test_short_and_long_words_agree():
    v, r = rank_array.held(JSON).vocabulary, random.Random(3)
    for n in (1, 2, 5, 17, 48):
        words = [bytes(r.choice(b"aabehinorst \xc3\xa9") for _ in range(n)) for _ in range(60)]
        assert [x.tolist() for x in v.short(np.frombuffer(b"".join(words), np.uint8).reshape(60, n))] == [v.long(w).tolist() for w in words]


def test_any_ids_decode_as_the_librarys():
    ids = np.random.default_rng(0).integers(0, 50257, 4000).astype("<u4")
    assert rank_array.held(JSON).decode(ids, np.array([0, 4000])).to_pylist() == [Tokenizer.from_file(JSON).decode(ids.tolist(), skip_special_tokens=False)]


def test_a_long_word_takes_little_more_than_linear_time():
    word, began = "".join(random.Random(1).choice("abcdefgh") for _ in range(200_000)), time.time()
    flat, _ = rank_array.Encoder(JSON).encode(pa.array([word]))
    assert time.time() - began < 30 and flat.tolist() == Tokenizer.from_file(JSON).encode(word, add_special_tokens=False).ids


def test_rank_array_query(spark, sf):
    tok = Tokenizer.from_file(JSON)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op12_rank_array_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# ---------------------------------------------------------------------------------------------------------- resampling


def brute_draw(rows, target, percent=10, least=20, longest=1, buckets=10_000, seed="2024"):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    feats = lambda t: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for w in (words(t),) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(b for _, x in rows for b in feats(x)), Counter(b for x in target for b in feats(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, x in rows:
        f = feats(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append([i, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=repr)


def draw_rows(seed, n=300):
    r = random.Random(seed)
    words = ["Aa", "b", "c9", "é", " x", "d"]
    texts = [None, "", "...", "a " * 5000] + ["".join(r.choice(words) + r.choice(" ,\t-") for _ in range(r.randrange(60))) for _ in range(n)]
    return [(None if i % 50 == 9 else i, t) for i, t in enumerate(texts)]


def resampled(spark, rows, target, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS buckets", "2 AS rank").repartition(4)
    held = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), **more)
    return sorted(map(tuple, held.collect()), key=repr)


TARGET = ["b b c9 b", None, "", "é b"]


@pytest.mark.parametrize("more", [{}, {"longest": 3, "percent": 33, "buckets": 50}, {"percent": 100, "least_words": 0}, {"percent": 0}])
def test_draw_is_that_of_brute_force(spark, more):
    rows = draw_rows(1)
    kinds = {"least_words": "least"}
    assert resampled(spark, rows, TARGET, **more) == brute_draw(rows, TARGET, **{kinds.get(k, k): v for k, v in more.items()})


def test_draw_with_repeated_rows_and_nothing(spark):
    rows = draw_rows(2, 60) + [(5, "b c9 " * 20)] * 150 + [(5, "d d " * 20)] * 20
    assert resampled(spark, rows, TARGET, percent=40) == brute_draw(rows, TARGET, percent=40)
    assert resampled(spark, [], TARGET) == [] and resampled(spark, rows[:30], []) == brute_draw(rows[:30], [])


def test_brackets_widen_until_they_hold_the_cutoff(spark):
    scores = [random.Random(4).randrange(-50, 50) for _ in range(500)] + [7] * 300
    df = spark.createDataFrame([(s,) for s in scores], "score long").repartition(3)
    for wanted in (1, 2, 250, 400, 799, 800):
        for margin in (0.0, 1e-9, 0.3):
            assert resampling.cutoff(df, len(scores), wanted, margin) == sorted(scores, reverse=True)[wanted - 1]
