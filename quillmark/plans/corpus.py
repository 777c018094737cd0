"""Canonical views on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.session import spread, table
from quillmark.sources.sinks import slices

#: A sample needs so many Latin words, or so many Han characters; chunks have so many words.
LEAST, SIZES = 200, {"1k": 100, "2k": 200, "4k": 400}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(grp, work, label, text)``: a group's texts of a work in order of their ids. One work of one group is one sample."""
    d = table(spark, sf_dir, "documents").filter("text is not null and grp is not null and work is not null")
    packed = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    whole = d.groupBy("grp", "work").agg(F.array_join(F.transform(packed, lambda x: x["text"]), "\n").alias("text"))
    return spread(whole.select("grp", "work", F.concat("grp", F.lit("/"), "work").alias("label"), "text"), "label")


def corpus(spark: SparkSession, sf_dir: str, lang: str = "en", least: int = LEAST) -> DataFrame:
    """The samples that have enough words of a language; shares of few words are mostly chance, and a sample without any has none."""
    return samples(spark, sf_dir).filter(F.regexp_count("text", F.lit(T.WORD if lang == "en" else T.HAN)) >= least)


def chunks(spark: SparkSession, sf_dir: str, scale: str = "1k") -> DataFrame:
    """The corpus in chunks; a tenth of the words that the scale is named for."""
    return slices(corpus(spark, sf_dir), SIZES[scale])
