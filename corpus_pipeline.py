"""From raw documents to packed token sequences: five stages, each one operator over all that the stage before kept.

Defined cases: a null or empty text is scored by the bias alone and then dropped by language ID, as it has no letter; with
no labelled row every document passes the first stage, with no language to learn from none passes the second; a row without
id is no copy of another and neither loses nor removes passages; repeated rows count as one document; extra columns are
carried up to the last stage, under any name that does not start with ``__`` and is not n_words or n_removed; an empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from corpusloom.llm import langid, near_dedup, packing, quality, substring
from corpusloom.llm.common import cut
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Five-word shingles, a likeness of 0.8 or more.
SHINGLE, PERCENT = 5, 80
#: Text bytes that are tokenized at a time: Python workers keep what a stage took, and the stages share them.
PACK_BYTES = 700_000
#: Least probability of the predicted language.
LEAST_SHARE = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.score_column(F.col("text"), model) >= 0.5)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is told apart from the others."""
    trees = langid.fit(docs)
    judged = docs.withColumn("__l", langid.language_column(F.col("text"), trees))
    return judged.filter((F.col("__l.lang_pred") != langid.UNKNOWN) & (F.col("__l.score") >= LEAST_SHARE)).drop("__l")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, the document with the least id."""
    return near_dedup.keep_one(docs, SHINGLE, PERCENT)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that an earlier document has; a text that loses none keeps its layout."""
    done = substring.remove_repeats(docs, keep_layout=True)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), slice_bytes=PACK_BYTES)


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("near-dedup", one_of_each_group),
    ("substring dedup", without_repeats),
    ("best-fit packing", packed),
]

#: Learned models and pieces of a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
