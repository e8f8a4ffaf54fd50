"""Packing, byte-level BPE and media columns: exact round trips and brute force."""

import base64
import hashlib
import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from corpusloom.llm import bpe, media, packing, pretokens, queries
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, " ", "a", "it's 12,3 o'clock!!  \n\n x", "É ñ ß 中文 \u00a0\u3000y", "<|endoftext|> a", "\x01 z", "tab\there \r\n", "the " * 3000, "x" * 700 + " y", "ab1" * 400, " " * 500 + "z", "🙂🙂 ok", "a_b __ c.\nNext line, and more."]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, length string").repartition(3)


# ------------------------------------------------------------------------------------------------------------- packing


def naive_bfd(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            min(fits)[0] -= n
        else:
            bins.append([capacity - n])
    return sorted(b[0] for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_histogram_packing_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan, n_bins = packing.best_fit_decreasing(counts, 20)
    filled = {}
    for p in plan:
        for k in range(p.count):
            where, offset = p.first_bin + k // p.per_bin, p.offset + k % p.per_bin * p.length
            filled.setdefault(where, []).append((offset, p.length))
    for b in filled.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
    assert n_bins == len(filled) and sorted(20 - sum(n for _, n in b) for b in filled.values()) == naive_bfd(lengths, 20)


def check_packed(rows, texts, capacity):
    tok = Tokenizer.from_file(JSON)
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got))) and sum(r.length for r in got) == len(ids)
        at = 0
        for r in got:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    for b in by_bin.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_bin)


def test_packing_whole_texts(spark):
    rng = random.Random(0)
    texts = TEXTS + [" ".join(rng.choice(["the", "thandly,", "of"]) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    rows = packing.pack_documents(frame(spark, texts), JSON, 64).collect()
    n = check_packed(rows, texts, 64)
    assert n == len(naive_bfd([r.length for r in rows], 64))


def test_only_first_pieces_are_short(spark):
    tok, capacity = Tokenizer.from_file(JSON), 16
    texts = ["", *[" ".join(["the"] * n) for n in (1, 14, 15, 16, 17, 30, 31, 32, 47, 48, 200)]]
    lengths = {i: [] for i in range(len(texts))}
    for r in packing.pieces(frame(spark, texts), JSON, capacity).orderBy("doc_id", "piece").collect():
        lengths[r.doc_id].append(r.length)
    sizes = [len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    assert {n % capacity for n in sizes if n > capacity} >= {0, 1}
    for i, n in enumerate(sizes):
        assert lengths[i] == [(n - 1) % capacity + 1] + [capacity] * ((n - 1) // capacity)
    check_packed(packing.pack_documents(frame(spark, texts), JSON, capacity).collect(), texts, capacity)


def test_packing_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    texts = ["a b"] * 40 + ["the " * n for n in range(30)]
    df = spark.createDataFrame([(None if i < 20 else i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    rows = packing.pack_documents(df, JSON, 16).collect()
    seen = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    ends = {}
    for where, offset, length in seen:
        assert ends.get(where, 0) == offset
        ends[where] = offset + length
    assert max(ends.values()) <= 16 and len(ends) == len(naive_bfd([r.length for r in rows], 16))


def test_packing_repeated_rows_null_ids_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    rows = packing.pack_documents(df, JSON).collect()
    assert len(rows) == 4 and len({r.sequence_id for r in rows}) == 1 and len({r.offset for r in rows}) == 4
    assert packing.pack_documents(df.limit(0), JSON).count() == 0


def test_remembered_words_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    ids, tok = packing.Ids(JSON), Tokenizer.from_file(JSON)
    for _ in range(2):
        flat, at = ids.of(pa.array(TEXTS))
        for i, t in enumerate(TEXTS):
            assert flat[at[i] : at[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids


# ----------------------------------------------------------------------------------------------------------------- BPE


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def long_words(seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(5000)), "a" * 5001, "".join(rng.choice("ab") for _ in range(3000)), "https://www.example.com/a?b=c&d=e_f-g/" + "=-" * 70]


def mixtures(n=300, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "B", "é", "'s", "'", " ", "  ", "\n", "\t", "1", "22", ".", "_", "中", "\u3000", "\x1c", "don't"]) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_pretokens_are_the_matches_of_the_pattern():
    texts = TEXTS + long_words() + mixtures()
    for pattern in (P.PATTERN, r"\S+|\s"):
        for start in (0, 5):
            codes, offsets, distinct = pretokens.pretokens(pa.array(texts, pa.string()).slice(start), pattern)
            listed = distinct.to_pylist()
            assert len(set(listed)) == len(listed)
            assert [[listed[c] for c in codes[i:j]] for i, j in zip(offsets[:-1], offsets[1:])] == [regex.findall(pattern, t or "") for t in texts[start:]]


@pytest.mark.parametrize("most", [None, 40, 0])
def test_bpe_encodes_and_decodes(spark, monkeypatch, most):
    """With all, some and none of the frequent words remembered; slices of a few hundred bytes for one of them."""
    enc, _ = encoding()
    texts = TEXTS + long_words() + mixtures(60)
    if most is not None:
        monkeypatch.setattr(bpe, "REMEMBERED", most)
        monkeypatch.setattr(bpe.Encoding.remember, "__defaults__", (most,))
    rows = bpe.encode_documents(frame(spark, texts), RANKS, P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert list(r.ids) == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        assert bytes(r.id_bytes) == np.array(r.ids, "<u4").tobytes()
    ids = spark.createDataFrame([(i, enc.encode_ordinary(t or "")) for i, t in enumerate(texts)] + [(-1, [50_000, 999_999, None, 0])], "i int, ids array<int>")
    for r in bpe.Encoding(spark, RANKS, P.PATTERN).decode(ids).collect():
        assert bytes(r.decoded) == ((texts[r.i] or "").encode() if r.i >= 0 else enc.decode_bytes([50_000, 0]))
    assert bpe.encode_documents(frame(spark).limit(0), RANKS, P.PATTERN).count() == 0


def test_bpe_of_repeated_rows_null_ids_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "the end", "x"), (1, "the end", "y"), (None, "the end", "z"), (None, None, None)], "doc_id long, text string, ids string")
    rows = bpe.encode_documents(df, RANKS, P.PATTERN).collect()
    assert len(rows) == 4 and sorted(len(r.ids) for r in rows) == [0, 2, 2, 2]


def test_heaps_are_folds(spark):
    """Words of all lengths by either way, with ranks that fall from one step to the next and inside one."""
    for extra in ([b"bc", b"abc", b"ab", b"cab", b"bcab", b"cc", b"aa", b"aaaa", b"ca", b"abca"], [b"aba", b"ab", b"bab", b"ba", b"abab"]):
        tokens = [bytes([b]) for b in range(256)] + extra
        ranks, ids = bpe.Ranks(spark, tokens), {t: i for i, t in enumerate(tokens)}
        least = {ids[t[:k]] << 32 | ids[t[k:]]: i << bpe.TOKEN_BITS | i for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
        rng = random.Random(0)
        words = sorted({"abab"} | {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(300)})
        df = spark.createDataFrame([(w, list(w.encode())) for w in words], "w string, b array<int>").withColumn("r", ranks.literal)
        library = tiktoken.Encoding("small", pat_str=r"\S+", mergeable_ranks=ids, special_tokens={})
        for r in df.select("w", ranks.fold(F.col("r"), F.col("b")).alias("f")).collect():
            assert r.f == bpe.by_heap(list(r.w.encode()), least.get) == library.encode_ordinary(r.w), r.w


def test_a_long_word_takes_little_more_than_linear_time(spark):
    enc, _ = encoding()
    words, began = ["".join(random.Random(n).choice("abcdefgh") for _ in range(n)) for n in (200, 257, 300, 200_000)], time.time()
    for r in bpe.encode_documents(frame(spark, words), RANKS, P.PATTERN).collect():
        assert list(r.ids) == enc.encode_ordinary(words[r.doc_id]) and bytes(r.decoded) == words[r.doc_id].encode()
    assert time.time() - began < 60


def test_bpe_query(spark, sf):
    enc, _ = encoding()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op8_bpe(spark, sf).collect():
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


# --------------------------------------------------------------------------------------------------------------- media


def test_media_round_trip(spark):
    rows = {r.doc_id: r for r in media.media_features(frame(spark)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r, stored = rows[i], media.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert len(r.frame_offsets) == -(-len(payload) // 1152) and r.duration_us == len(r.frame_offsets) * 36_000
    assert rows[0].feature == rows[1].feature and media.media_features(frame(spark).limit(0)).count() == 0


def test_parser_finds_frames_again_and_counts_broken_ones():
    payload = bytes(range(256)) * 9
    data = media.encode(payload)
    clean = media.parse(data)
    assert clean.table == "Xing" and clean.table_frames == len(clean.offsets) == 2 and clean.broken == clean.skipped == 0
    second = clean.offsets[1]
    noisy = media.parse(data[:second] + b"\xff\xfbjunk\xff" + data[second:])
    assert len(noisy.offsets) == 1 and noisy.offsets[0] == second + 7 or len(noisy.offsets) == 2
    assert noisy.skipped >= 7
    broken = bytearray(data)
    broken[second + 8] ^= 1  # side information
    assert media.parse(bytes(broken)).broken == 1
    assert media.parse(b"no audio at all \xff\xff").offsets == [] and media.parse(b"").offsets == []
    cut = media.parse(data[:-400])
    assert len(cut.offsets) == 1 and cut.skipped > 0


def test_headers_of_other_layers():
    assert media.header(b"\xff\xfb\x90\x00").length == 417 and media.header(b"\xff\xfb\x92\x00").length == 418  # 128 kbit/s, 44.1 kHz
    assert media.header(b"\xff\xf3\x80\x00").length == 208 and media.header(b"\xff\xf3\x80\x00").samples == 576  # MPEG-2, 64 kbit/s, 22.05 kHz
    assert media.header(b"\xff\xff\x94\x00").length == (12 * 288000 // 48000) * 4 and media.header(b"\xff\xfd\xa4\x00").samples == 1152
    assert media.header(b"\xff\xfb\xf0\x00") is None and media.header(b"\xff\xfb\x0c\x00") is None and media.header(b"ab") is None


def bit_crc(bits):
    """The format's checksum, one bit at a time."""
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ int(b) else 0)) & 0xFFFF
    return crc


def bits_of(raw):
    return "".join(f"{b:08b}" for b in raw)


def test_checksums_of_layers_one_and_two():
    # (header, what the checksum covers): Layer I mono and joint stereo; Layer II mono with two of 27 subbands in use, joint stereo, and few subbands
    high, low = [4] * 11 + [3] * 12 + [2] * 4, [4] * 2 + [3] * 6
    cases = [
        (b"\xff\xfe\x94\xc0", "1010" * 32), (b"\xff\xfe\x94\x50", "0110" * (8 + 8 + 24)),
        (b"\xff\xfc\x54\xc0", "".join("1".zfill(n) if k in (0, 20) else "0" * n for k, n in enumerate(high)) + "10" * 2),
        (b"\xff\xfc\x84\x40", "".join(("1".zfill(n) if k in (3, 5) else "0" * n) * (2 if k < 4 else 1) for k, n in enumerate(high)) + "11" * 4),
        (b"\xff\xfc\x10\xc0", "".join("1".zfill(n) if k == 7 else "0" * n for k, n in enumerate(low)) + "01"),
    ]
    for head, covered in cases:
        h = media.header(head)
        rest = covered + "01" * 4 * h.length
        body = int(rest[: 8 * (h.length - 6)], 2).to_bytes(h.length - 6, "big")
        frame = head + bit_crc(bits_of(head[2:]) + covered).to_bytes(2, "big") + body
        assert media.protected_bits(frame, h) == len(covered)
        got = media.parse(frame * 3)
        assert (len(got.offsets), got.checked, got.broken) == (3, 3, 0), head
        wrong = bytearray(frame)
        wrong[6] ^= 0x80
        assert media.parse(frame + bytes(wrong) + frame).broken == 1


def test_tags_of_every_version():
    frame = b"\xff\xfb\x90\x00" + bytes(413)

    def tag(major, flags, body):
        return b"ID3" + bytes((major, 0, flags)) + media._syncsafe(len(body)) + body

    long = b"\3" + b"x" * 200
    for raw, want in (
        (tag(2, 0, b"TT2\0\0\4\0abc" + b"TXX\0\0\5\0k\0vw" + bytes(9)), {"TT2": "abc", "k": "vw"}),
        (tag(3, 0, b"TIT2\0\0\0\x07\0\0\1" + "é!".encode("utf-16") + b"APIC\0\0\0\2\0\0zz" + b"TPE1\0\0\0\2\0\0\0z"), {"TIT2": "é!", "TPE1": "z"}),
        (tag(3, 0x40, b"\0\0\0\6" + bytes(6) + b"TALB\0\0\0\3\0\0\0ab"), {"TALB": "ab"}),
        (tag(4, 0, b"TIT2" + media._syncsafe(len(long)) + b"\0\0" + long + b"TPE1\0\0\0\3\0\0\3" + "é".encode()), {"TIT2": "x" * 200, "TPE1": "é"}),
        (tag(4, 0x10, b"TIT2\0\0\0\2\0\0\0a") + b"3DI" + bytes(7), {"TIT2": "a"}),
    ):
        got = media.parse(raw + frame * 2)
        assert got.tags == want and len(got.offsets) == 2 and got.skipped == 0
    last = b"TAG" + b"Title".ljust(30, b"\0") + b"Who".ljust(30) + bytes(30) + b"1999" + b"said".ljust(28, b"\0") + b"\0\x07\x11"
    assert media.parse(frame * 2 + last).tags == {"v1.title": "Title", "v1.artist": "Who", "v1.year": "1999", "v1.comment": "said", "v1.track": "7"}


def test_seek_points():
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    table = bytearray(frame)
    table[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 9999, 3, 3, 2, 2, 1)
    table[62:68] = struct.pack(">HHH", 208, 209, 210)
    assert media.parse(bytes(table) + frame * 3).seek == [416, 834, 1254]
    got = media.parse(media.encode(bytes(576 * 40)))
    assert len(got.seek) == 100 and got.seek == sorted(got.seek) and got.seek[50] <= got.offsets[10]


def test_vbri_table_and_mixed_rates():
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    table = bytearray(frame)
    table[36:40], table[46:54] = b"VBRI", struct.pack(">II", 9999, 3)
    got = media.parse(bytes(table) + frame * 3)
    assert (got.table, got.table_frames, got.table_bytes, len(got.offsets)) == ("VBRI", 3, 9999, 3)
    assert got.duration_us == 3 * 1152 * 1_000_000 // 44100


def test_first_column_names(spark, sf):
    got = queries.op10_media(spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_us", "frame_offsets"]
    assert got.filter("duration_us <= 0 OR size(frame_offsets) = 0").count() == 0
    assert got.filter(F.length("payload_sha256") != 64).count() == 0
