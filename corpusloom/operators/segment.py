"""Dictionary segmentation of unspaced text: a lattice of known words and its best path.

A dictionary is learned from a corpus, or given, as (word, n). Runs of a script that is written without spaces become
lattices: every substring that is a known word is an edge with the logarithm of its share as weight, and every character
alone is one with the least weight. The path with the greatest sum of weights is found by a fold from the run's end
(of equal sums the one with the longer first word). Weights are whole millionths, so sums are exact.

Each distinct run is segmented once: its substrings are joined to the dictionary, so no dictionary is broadcast or held in a
task, and the words are joined back to the texts. Text between the runs takes the default tokenizer. Null texts have no tokens.
"""

from __future__ import annotations

from corpusloom.functions.text import SPACE, WORD, let, tokens
from corpusloom.sources.tables import materialize
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of Han characters; longest known word that is looked for; least number of a learned word.
RUN, LONGEST, LEAST, MILLION = r"[\x{3400}-\x{9fff}]+", 24, 2, 1_000_000


def learn(texts: DataFrame, text_col: str = "text", least: int = LEAST, longest: int = LONGEST, tokenizer=tokens) -> DataFrame:
    """(word, n) of the tokens that occur ``least`` times or more and have at most ``longest`` characters."""
    words = texts.select(F.explode(tokenizer(F.col(text_col))).alias("word")).filter(F.length("word") <= longest)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def weighted(dictionary: DataFrame) -> DataFrame:
    """(word, weight, unknown): whole millionths of ln(n / all), and of ln(1 / all) for what is not listed."""
    total = dictionary.agg(F.sum("n").alias("all"))
    share = lambda x: F.round(MILLION * (F.log(x) - F.log("all"))).cast("long")
    return dictionary.join(F.broadcast(total), how="cross").select("word", share(F.col("n")).alias("weight"), share(F.lit(1)).alias("unknown"))


def _routes(n: Column, edges: Column) -> Column:
    """Of each position from 0 to n, (score, next) of the best way to the end; ``edges`` has (stop, weight) by position."""

    def step(state: Column, i: Column) -> Column:
        ways = F.transform(F.get(edges, i), lambda e: F.struct((e["weight"] + F.get(state, e["stop"] - i - 1)["score"]).alias("score"), e["stop"].alias("next")))
        return F.concat(F.array(F.array_max(ways)), state)

    return F.aggregate(F.sequence(n - 1, F.lit(0), F.lit(-1)), F.array(F.struct(F.lit(0).cast("long").alias("score"), n.alias("next"))), step)


def _words(run: Column, routes: Column) -> Column:
    """The words along the best way."""

    def step(state: Column, i: Column) -> Column:
        stop = F.get(routes, i)["next"]
        more = F.struct(stop.alias("at"), F.concat(state["words"], F.array(F.substring(run, i + 1, stop - i))).alias("words"))
        return F.when(i == state["at"], more).otherwise(state)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("words"))
    return F.aggregate(F.sequence(F.lit(0), F.length(run) - 1), start, step, lambda s: s["words"])


def segment_runs(runs: DataFrame, dictionary: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(run, words) of distinct, non-empty ``runs``."""
    listed = materialize(weighted(dictionary))
    least = listed.agg(F.coalesce(F.min("unknown"), F.lit(0)).alias("weight"))
    starts = runs.select("run", F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("start"))
    parts = starts.select("run", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("start")))).alias("size"))
    found = parts.select("run", "start", (F.col("start") + F.col("size")).alias("stop"), F.substring("run", F.col("start") + 1, F.col("size")).alias("word")).join(listed, "word").select("run", "start", "stop", "weight")
    alone = starts.join(F.broadcast(least), how="cross").select("run", "start", (F.col("start") + 1).alias("stop"), "weight")
    at = found.unionByName(alone).groupBy("run", "start").agg(F.collect_list(F.struct("stop", "weight")).alias("ways"))
    lattice = at.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("start", "ways"))).alias("l"))
    words = let(F.transform("l", lambda x: x["ways"]), lambda edges: let(_routes(F.length("run"), edges), lambda r: _words(F.col("run"), r)))
    return lattice.select("run", words.alias("words"))


def segment(texts: DataFrame, dictionary: DataFrame, id_col: str = "chunk_id", text_col: str = "text", run: str = RUN, longest: int = LONGEST) -> DataFrame:
    """``texts`` with ``tokens``; ids are distinct. BM25 takes them by ``text_col="tokens", tokenizer=lambda t: t``."""
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(rf"{run}|[{WORD}]+|[^{SPACE}]"), F.lit(0))
    split = materialize(texts.select(id_col, F.posexplode(pieces).alias("at", "run")))
    unspaced = split.filter(F.col("run").rlike(rf"^(?:{run})\z"))
    words = segment_runs(unspaced.select("run").distinct(), dictionary, longest)
    joined = split.join(words, "run", "left").select(id_col, F.struct("at", F.coalesce("words", F.array("run")).alias("words")).alias("p"))
    made = joined.groupBy(id_col).agg(F.array_sort(F.collect_list("p")).alias("p")).select(id_col, F.flatten(F.transform("p", lambda x: x["words"])).alias("tokens"))
    return texts.join(made, id_col, "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
