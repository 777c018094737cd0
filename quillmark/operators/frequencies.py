"""Most frequent words, relative frequencies, z-scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import text as T


def exploded(corpus: DataFrame, tokenize: Callable[[str], Column] = T.tokens_plain, key: str = "label", text: str = "text") -> DataFrame:
    """``(key, word)``, one row for each token."""
    return corpus.select(key, F.explode(tokenize(text)).alias("word"))


def counted(words: DataFrame, key: str = "label") -> DataFrame:
    """``(key, word, n)``: what everything below needs; tokens are counted before they are shuffled or written."""
    return words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame, n: int = 100) -> DataFrame:
    """``(word, n)``: the n most frequent words, ties by alphabet. The result has n rows, so it may be broadcast."""
    return counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def relative(counts: DataFrame, features: DataFrame, key: str = "label") -> DataFrame:
    """``(key, word, f)`` for every key and feature; 0 where a word is missing, and everywhere if a key has no words."""
    totals = counts.groupBy(key).agg(F.sum("n").alias("total"))
    vocabulary = features.select("word")
    # counts of features by key as one map per key: the grid is built from small rows, not from a join of all with all
    held = counts.join(F.broadcast(vocabulary), "word").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("held"))
    every = vocabulary.agg(F.array_sort(F.collect_set("word")).alias("words"))
    grid = totals.join(held, key, "left").crossJoin(F.broadcast(every)).select(key, "total", "held", F.explode("words").alias("word"))
    got = F.coalesce(F.try_element_at("held", F.col("word")), F.lit(0))
    return grid.select(key, "word", (got / F.greatest("total", F.lit(1))).alias("f"))


def z_scores(freq: DataFrame, key: str = "label") -> DataFrame:
    """``(key, word, z)`` with the population deviation; words that are the same everywhere drop out."""
    stats = freq.groupBy("word").agg(F.avg("f").alias("mean"), F.stddev_pop("f").alias("sd"), F.min("f").alias("low"), F.max("f").alias("high"))
    used = stats.filter("high > low")
    return freq.join(F.broadcast(used), "word").select(key, "word", ((F.col("f") - F.col("mean")) / F.col("sd")).alias("z"))


def constant_words(freq: DataFrame) -> DataFrame:
    return freq.groupBy("word").agg(F.min("f").alias("low"), F.max("f").alias("high")).filter("high = low").select("word")


def vectors(z: DataFrame, value: str = "z", key: str = "label", term: str = "word") -> DataFrame:
    """One row for each key with its values in the order of the terms."""
    packed = F.array_sort(F.collect_list(F.struct(term, value)))
    return z.groupBy(key).agg(F.transform(packed, lambda x: x[value]).alias("v"))


def ranked_first_seen(terms: DataFrame, n: int, term: str = "term", order: tuple[str, ...] = ("label", "pos")) -> DataFrame:
    """The n most frequent terms, ties by where they occur first."""
    first = F.min(F.struct(*order)).alias("first")
    top = terms.groupBy(term).agg(F.count(F.lit(1)).alias("n"), first).orderBy(F.desc("n"), "first").limit(n)
    return top.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).select("idx", term, "n")
