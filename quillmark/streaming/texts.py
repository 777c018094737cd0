"""Texts as they arrive: the batch plans over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmark.functions import text as T


def documents(spark: SparkSession, path: str, schema: StructType, files_each: int = 100) -> DataFrame:
    """Parquet files of documents as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def statistics(stream: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each text; stateless, so it appends."""
    lang = T.language(text)
    return stream.filter(F.col(text).isNotNull()).select(key, lang.alias("lang"), F.length(text).alias("n_chars"), F.size(T.tokens(text, lang)).alias("n_tokens"), F.size(T.sentences(text)).alias("n_sentences"))


def volume(stream: DataFrame, time: str = "loaded_at", late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Texts and characters by source and day; rows later than the watermark are left out, state is dropped behind it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
