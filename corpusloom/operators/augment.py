"""Text added to chunks: tables as sentences, and generated text kept in a cache by content key."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from corpusloom.functions.text import let, split_lines, strip, text_key
from corpusloom.operators.chunking import merge_captions, split_blocks
from corpusloom.operators.models import Tokens, as_batch
from corpusloom.sources.tables import materialize
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
TABLE_NOTE, ENRICH_NOTE = "\n\n【表格说明】\n", "\n\n【检索增强】\n"
OPEN, CLOSE = "<think>", "</think>"


def linearize_table(block: Column) -> Column:
    """A table block as lines ``first cell:other cells``, under its caption; '' without usable rows."""
    lines = F.filter(F.transform(split_lines(block), strip), lambda s: (s != "") & ~s.startswith("[表格]"))

    def cells(line: Column) -> Column:
        return F.transform(F.split(F.btrim(line, F.lit("|")), r"\|"), strip)

    def sentence(row: Column) -> Column:
        filled = F.filter(row, lambda c: c != "")
        return let(filled, lambda f: F.when(F.size(f) > 1, F.concat(F.get(f, F.lit(0)), F.lit(":"), F.array_join(F.slice(f, F.lit(2), F.size(f)), "、"))).otherwise(F.get(f, F.lit(0))))

    def text(ls: Column) -> Column:
        caption = strip(F.array_join(F.filter(ls, lambda s: ~s.startswith("|")), " "))
        rows = F.filter(F.transform(F.filter(ls, lambda s: s.startswith("|")), cells), lambda r: F.exists(r, lambda c: ~c.rlike(r"^-*\z")))

        def said(rs: Column) -> Column:
            data = F.when(F.size(rs) > 1, F.slice(rs, F.lit(2), F.size(rs))).otherwise(rs)
            sentences = F.filter(F.transform(data, sentence), lambda s: s.isNotNull())
            return F.when(F.size(rs) == 0, "").otherwise(F.array_join(F.concat(F.filter(F.array(caption), lambda c: c != ""), sentences), "\n"))

        return let(rows, said)

    return let(lines, text)


def augment_tables(text: Column) -> Column:
    """The chunk with its tables as sentences after it; unchanged without any."""
    tables = F.filter(let(split_blocks(text), merge_captions), lambda b: b["kind"] == "table")
    said = F.filter(F.transform(tables, lambda b: linearize_table(b["text"])), lambda s: s != "")
    return let(said, lambda s: F.when(F.size(s) > 0, F.concat(text, F.lit(TABLE_NOTE), F.array_join(s, "\n"))).otherwise(text))


def enrich_prompt(template: str, text: Column, questions: int = 3) -> Column:
    """``template`` with ``{n}`` and ``{chunk}`` filled in; what the chunk holds is never read as a template."""
    parts = template.replace("{n}", str(questions)).split("{chunk}")
    pieces: list[Column] = [F.lit(parts[0])]
    for p in parts[1:]:
        pieces += [text, F.lit(p)]
    return F.concat(*pieces)


def strip_think(text: Column) -> Column:
    """Closed thoughts are taken out; with one left open nothing remains."""
    out = F.regexp_replace(text, rf"(?s){OPEN}.*?{CLOSE}", "")
    return strip(F.when(out.contains(OPEN), "").otherwise(out))


def most_said(limit: int) -> int:
    """Characters after which a generator is stopped: thoughts go before the part that is kept."""
    return max(6 * limit, 1800)


def cut_generated(raw: Column, limit: int = 400, stopped: bool = False) -> Column:
    """What is kept of generated text: no more than the generator may say, without thoughts, at most ``limit`` characters.

    A generator that was ``stopped`` at its limit said its last token in full.
    """
    return strip(F.substring(strip_think(raw if stopped else F.substring(raw, 1, most_said(limit))), 1, limit))


def enrich_cached(chunks: DataFrame, cache: DataFrame | None, generate: Callable[[pd.Series], pd.Series] | Tokens, template: str, generator: str = "default", questions: int = 3, limit: int = 400) -> tuple[DataFrame, DataFrame]:
    """(chunks with ``text`` enriched, ``enriched`` and ``reused``; the cache pruned to the keys of this run).

    Each distinct text that the cache lacks is generated once; a null or empty outcome leaves the chunk as it is and is
    not cached. Only keys and distinct misses are shuffled. A generator of ``Tokens`` is stopped when it has said enough.
    """
    spark = chunks.sparkSession
    keyed = chunks.withColumn("text_key", text_key(F.col("text")))
    schema = "generator string, text_key string, generated string"
    known = (cache.select("generator", "text_key", "generated") if cache is not None else spark.createDataFrame([], schema)).filter(F.col("generator") == generator).select("text_key", "generated").dropDuplicates(["text_key"])
    missing = keyed.select("text_key", "text").dropDuplicates(["text_key"]).join(known, "text_key", "left_anti")
    stopped = isinstance(generate, Tokens)
    made = F.pandas_udf(as_batch(generate, most_said(limit)), "string")(enrich_prompt(template, F.col("text"), questions))
    new = materialize(missing.select("text_key", made.alias("raw"))).select("text_key", cut_generated(F.col("raw"), limit, stopped).alias("generated")).filter("generated <> ''")
    both = known.withColumn("reused", F.lit(True)).unionByName(new.withColumn("reused", F.lit(False)))
    joined = keyed.join(both, "text_key", "left")
    text = F.when(F.col("generated").isNotNull(), F.concat("text", F.lit(ENRICH_NOTE), "generated")).otherwise(F.col("text"))
    out = joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in chunks.columns], F.col("generated").isNotNull().alias("enriched"), F.coalesce("reused", F.lit(False)).alias("reused"))
    pruned = both.drop("reused").join(keyed.select("text_key"), "text_key", "left_semi").select(F.lit(generator).alias("generator"), "text_key", "generated")
    return out, pruned
