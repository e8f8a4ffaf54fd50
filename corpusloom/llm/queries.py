"""The registered queries of the training-data operators, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, fingerprints, langid, licenses, media, near_dedup, packing, quality, rank_array, resampling, substring, url_filter
from .common import table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file, which every machine has at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged; the list has the URLs of pages whose document is labelled toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    listed = pages.join(toxic, "page_id", "left_semi").select("url")
    return url_filter.filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict", "canonical_url", "listed")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score_documents(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.fit(documents))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, lists=False)
    return coded.select("doc_id", F.floor(F.octet_length("id_bytes") / 4).alias("n_tokens"), F.sha2("id_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(licenses.known_texts(), "license_id string, text string")
    found = licenses.scan(table(spark, sf_dir, "documents"), known)
    return found.withColumn("licenses", F.array_join("licenses", ","))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = rank_array.encode_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), lists=False)
    return coded.select("doc_id", F.floor(F.octet_length("id_bytes") / 4).alias("n_tokens"), F.sha2("id_bytes", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the words of the benchmark's passages."""
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_SITE = r"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CANONICAL_URL = rf"""
WITH p AS (SELECT page_id, url, coalesce({_SITE}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{url_filter.TRACKING}'))), '&') AS params FROM p),
c AS (SELECT *, CASE WHEN regexp_replace(host, '^www\.|:(80|443)$', '', 'g') <> '' THEN regexp_replace(host, '^www\.|:(80|443)$', '', 'g') || regexp_replace(path, '/+$', '') || CASE WHEN params <> '' THEN '?' || params ELSE '' END END AS canonical_url FROM q)
"""
_RULE = "CASE " + " ".join(
    f"WHEN (host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '/{start}') THEN '{{{i}}}'"
    for i, (site, start) in sorted(((i, (t.partition("/")[0], t.partition("/")[2])) for i, (_, t) in enumerate(url_filter.RULES)), key=lambda r: -sum(map(len, r[1])))
) + " END"

_MARKED = " OR ".join(f"regexp_matches(l, '{p}')" for p in licenses.MARKED_LINE) + " OR (regexp_matches(l, '{}') AND NOT regexp_matches(l, '{}') AND NOT regexp_matches(l, '{}'))".format(*licenses.NAMED_LINE)
_SPELT = f"array_to_string(list_transform(string_split(lower(text), chr(10)), lambda l: CASE WHEN {_MARKED} THEN '' ELSE l END), chr(10))"
for _pattern, _one in licenses.SPELLINGS:
    _SPELT = f"regexp_replace({_SPELT}, '{_pattern}', '{_one.replace('$1', chr(92) + '1')}', 'g')"
_SPELT = rf"regexp_replace({_SPELT}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
_FLAT = r"trim(regexp_replace({}, '[ \n]+', ' ', 'g'))"
_KNOWN = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in licenses.known_texts())

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Counts of one to three words, the least-scoring cut, triples against the pairs inside them.
_COLLOCATIONS = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), spot AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f1 AS (SELECT lang, w[i] AS x, count(*) AS f FROM spot GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY 1),
f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM spot WHERE i < len(w) GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM spot WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
longer AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
two AS (SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, l.f AS l, r.f AS r, 1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f) AS score FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f1 r ON r.lang = c.lang AND r.x = c.y
  LEFT JOIN longer g ON g.lang = c.lang AND g.x = c.x AND g.y = c.y WHERE g.f IS NULL OR 100 * g.f < {collocations.PERCENT} * c.f),
cuts AS (SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z AS phrase, c.f AS a, l1.f AS l1, r1.f AS r1, l2.f AS l2, r2.f AS r2, 1000000::HUGEINT * c.f * c.f // (l1.f::HUGEINT * r1.f) AS s1, 1000000::HUGEINT * c.f * c.f // (l2.f::HUGEINT * r2.f) AS s2
  FROM f3 c JOIN f1 l1 ON l1.lang = c.lang AND l1.x = c.x JOIN f2 r1 ON r1.lang = c.lang AND r1.x = c.y AND r1.y = c.z JOIN f2 l2 ON l2.lang = c.lang AND l2.x = c.x AND l2.y = c.y JOIN f1 r2 ON r2.lang = c.lang AND r2.x = c.z),
c AS (SELECT lang, phrase, a, l, r, score FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {collocations.TOP}"""

#: CRC-32 of distinct words, byte by byte, by a table that eight shifts make for each byte.
_RESAMPLING = rf"""WITH steps AS (SELECT list(list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT k, unnest(w) AS x FROM d), g AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
v AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM e UNION SELECT x FROM g)),
u AS (SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % {resampling.BUCKETS} AS bucket FROM v, steps),
s AS (SELECT bucket, count(*) AS s FROM e JOIN u USING (x) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM g JOIN u USING (x) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + {resampling.BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + {resampling.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT k, sum(gain)::BIGINT AS total FROM e JOIN u USING (x) JOIN gain USING (bucket) GROUP BY 1),
o AS (SELECT k, doc_id, len(w)::BIGINT AS n_features, coalesce(floor(total / len(w)), 0)::BIGINT AS weight FROM d LEFT JOIN m USING (k)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM o),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= {resampling.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {resampling.PERCENT} * n // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (k)"""

#: SQL of the queries that SQL can express; the others are tested against brute force, round trips and held-out rows.
ORACLES: dict[str, str] = {
    "op1_url_filter": _CANONICAL_URL + f""", l AS (SELECT DISTINCT canonical_url FROM c WHERE page_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND canonical_url IS NOT NULL),
r AS (SELECT *, {_RULE.format(*[t for _, t in url_filter.RULES])} AS rule, {_RULE.format(*[v for v, _ in url_filter.RULES])} AS says, canonical_url IS NOT NULL AND canonical_url IN (SELECT canonical_url FROM l) AS listed FROM c)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, canonical_url, listed FROM r""",
    "op2_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS x FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, v.b FROM reach r JOIN ways v ON v.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN comp USING (doc_id)""",
    "op7_substring_dedup": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13), k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM p),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS low FROM k), g AS (SELECT doc_id, list(i) AS starts FROM f WHERE low < doc_id GROUP BY 1),
r AS (SELECT doc_id, w, CASE WHEN starts IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_has_any(starts, range(i - 12, i + 1))) END AS kept FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM r""",
    "op9_license_scan": f"""WITH known AS (SELECT license_id, md5({_FLAT.format("t")}) AS digest FROM (SELECT license_id, {_SPELT} AS t FROM (VALUES {_KNOWN}) v(license_id, text)) WHERE {_FLAT.format("t")} <> ''),
digests AS (SELECT digest, min(license_id) AS license_id FROM known GROUP BY 1), d AS (SELECT row_number() OVER () AS k, doc_id, {_SPELT} AS t FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
whole AS (SELECT k, doc_id, CASE WHEN {_FLAT.format("t")} <> '' THEN md5({_FLAT.format("t")}) END AS digest FROM d),
lines AS (SELECT k, {_FLAT.format("l")} AS l FROM (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d)),
hits AS (SELECT k, license_id, count(*) AS n FROM lines JOIN digests ON digest = md5(l) WHERE l <> '' GROUP BY 1, 2),
ids AS (SELECT k, license_id, n FROM hits UNION ALL SELECT k, license_id, 0 FROM whole JOIN digests USING (digest)),
found AS (SELECT k, array_to_string(list_sort(list_distinct(list(license_id))), ',') AS licenses, sum(n) AS n FROM ids GROUP BY 1)
SELECT w.doc_id, w.digest AS text_digest, g.license_id AS whole_license, coalesce(f.licenses, '') AS licenses, coalesce(f.n, 0)::BIGINT AS n_license_lines FROM whole w LEFT JOIN digests g USING (digest) LEFT JOIN found f USING (k)""",
    "op11_collocations": _COLLOCATIONS,
    "op13_resampling": _RESAMPLING,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_near_dedup": op2_near_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_packing": op6_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_bpe": op8_bpe,
    "op9_license_scan": op9_license_scan,
    "op10_media": op10_media,
    "op11_collocations": op11_collocations,
    "op12_rank_array_bpe": op12_rank_array_bpe,
    "op13_resampling": op13_resampling,
    "pipeline": pipeline,
}
