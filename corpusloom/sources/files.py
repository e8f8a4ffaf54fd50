"""Folders of documents, test sets and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from corpusloom.functions.text import is_blank, unix_newlines
from corpusloom.sources.tables import materialize
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = ("txt", "md")


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    return files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("source"), F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)\z", 1)).alias("suffix"), "content")


def read_text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text) of the .txt and .md files right in ``folder``: UTF-8 without its bad bytes, blank files left out."""

    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    texts = _listed(spark, folder).filter(F.col("suffix").isin(*TEXT_SUFFIXES)).select("source", unix_newlines(F.pandas_udf(decode, "string")("content")).alias("text"))
    return texts.filter(~is_blank(F.col("text")))


def read_parsed_folder(spark: SparkSession, folder: str, parsers: dict[str, Callable[[bytes], str]]) -> tuple[DataFrame, DataFrame]:
    """((source, text), (source, error)) of files whose suffix has a parser; a file that fails is an error row, no more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source, suffix, content in zip(pdf["source"], pdf["suffix"], pdf["content"], strict=True):
                try:
                    rows.append((source, parsers[suffix](bytes(content)), None))
                except Exception as e:  # noqa: BLE001  any parser failure is a row of the errors table
                    rows.append((source, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source", "text", "error"])

    parsed = materialize(_listed(spark, folder).filter(F.col("suffix").isin(*parsers)).mapInPandas(run, "source string, text string, error string"))
    good = parsed.filter("error IS NULL").select("source", unix_newlines(F.col("text")).alias("text")).filter(~is_blank(F.col("text")))
    return good, parsed.filter("error IS NOT NULL").select("source", "error")


TESTSET = "question string, answer string, gold_id string, gold_source string"


def read_testset(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions with gold ids."""
    rows = spark.read.schema(TESTSET).option("multiLine", True).json(path)
    return rows.withColumn("query_id", F.sha1(F.concat_ws("\n", "question", "gold_id")))


def write_testset(testset: DataFrame, path: str) -> None:
    """Questions with gold ids as one JSON array, in order of question and gold id (a test set is small)."""
    fields = [f.split()[0] for f in TESTSET.split(", ")]
    rows = testset.select(*[F.col(c).cast("string").alias(c) for c in fields])
    ordered = F.array_sort(F.collect_list(F.struct("question", "gold_id", *[c for c in fields if c not in ("question", "gold_id")])))
    rows.agg(F.to_json(F.transform(ordered, lambda r: F.struct(*[r[c].alias(c) for c in fields]))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """An answers report, as JSON lines."""
    df.write.mode("overwrite").json(path)
