"""Places for language models: entities, dependencies, keywords, sentiment. Without a model the fallbacks are the results.

A model is a function from a list of texts to a list of results; it is loaded once in each Python worker by its loader, which returns
None where its library isn't installed. Models see Arrow batches of one column, never single rows, and only the texts of their language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import text as T
from quillmark.operators import documents

ENTITY = "array<struct<text:string,label:string,start:int,end:int>>"
DEPENDENCY = "array<struct<text:string,pos:string,dep:string,head_text:string,head_pos:string,head_i:int,token_i:int,sent_id:int,sent_i:int>>"
KEYWORD = "array<struct<term:string,weight:double>>"
MOOD = "struct<label:string,score:double,raw:string>"

Model = Callable[[list[str]], list]
Loader = Callable[[], Model | None]
#: Loader by task and language; without one the fallback counts. Add to it to plug a model in.
LOADERS: dict[tuple[str, str], Loader] = {}
#: Libraries that known models come from.
LIBRARIES = ("spacy", "jieba", "snownlp", "vaderSentiment", "docx", "PyPDF2", "matplotlib", "wordcloud")


@lru_cache(maxsize=None)
def _loaded(loader: Loader) -> Model | None:
    """One model for each worker and loader."""
    return loader()


def installed() -> dict[str, bool]:
    """Which of the libraries can be imported here."""
    return {x: find_spec(x) is not None for x in LIBRARIES}


def applied(text: Column | str, lang: Column, task: str, schema: str, fallback: Column) -> Column:
    """What the models of a task give for each text by its language, and the fallback where there is no model or it gives nothing."""
    out = fallback
    for (name, code), loader in LOADERS.items():
        if name != task:
            continue

        def make(load: Loader) -> Column:
            @F.pandas_udf(schema)
            def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                model = _loaded(load)
                for s in batches:
                    got = model([x for x in s if x is not None]) if model else []
                    results = iter(got)
                    rows = [next(results, None) if x is not None else None for x in s]
                    yield pd.DataFrame([r or {} for r in rows]) if schema.startswith("struct") else pd.Series(rows)

            return run(F.when(lang == code, F.col(text) if isinstance(text, str) else text))

        out = F.when(lang == code, F.coalesce(make(loader), fallback)).otherwise(out)
    return out


def _model_language(text: Column | str, lang: Column | None) -> Column:
    """The language whose model reads a text: a text without one, or of another one, is read as English."""
    lang = T.language(text) if lang is None else lang
    return F.when(lang.isin("en", "zh"), lang).otherwise("en")


def entities(text: Column | str, lang: Column | None = None) -> Column:
    return applied(text, _model_language(text, lang), "entities", ENTITY, F.array().cast(ENTITY))


def dependencies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, dependencies)``: a text of one language as a whole; a mixed one sentence by sentence, each with the model of its language,
    places counted from 0 in each sentence. A sentence that is mixed itself is Chinese as soon as it holds a Han character."""
    none = F.array().cast(DEPENDENCY)
    base = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), T.language(text).alias("lang"))
    whole = base.filter("lang <> 'mixed'").select("key", applied("text", F.col("lang"), "dependencies", DEPENDENCY, none).alias("dependencies"))
    mixed = base.filter("lang = 'mixed'")
    one = mixed.select("key", F.posexplode(T.sentences("text")).alias("sent", "s")).withColumn("l", T.language("s"))
    lang = F.when(F.col("l") != "mixed", F.col("l")).when(F.col("s").rlike(T.HAN), "zh").otherwise("en")
    read = one.select("key", "sent", applied("s", lang, "dependencies", DEPENDENCY, none).alias("d"))
    numbered = read.select("key", "sent", F.transform("d", lambda x: x.withField("sent_id", F.col("sent")).withField("sent_i", x["token_i"])).alias("d"))
    joined = numbered.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sent", "d"))), lambda x: x["d"])).alias("dependencies"))
    return whole.unionByName(mixed.select("key").join(joined, "key", "left").select("key", F.coalesce("dependencies", none).alias("dependencies")))


def sentence_groups(tokens: DataFrame, key: str = "key", order: str = "at", sent: str = "sent_id") -> DataFrame:
    """Add ``group``: which run of equal sentence ids a token belongs to, from 0; a missing id counts as 0."""
    w = Window.partitionBy(key).orderBy(order)
    now = F.coalesce(F.col(sent), F.lit(0))
    return tokens.withColumn("_new", F.coalesce((now != F.lag(now).over(w)).cast("int"), F.lit(0))).withColumn("group", F.sum("_new").over(w)).drop("_new")


def edges(tokens: DataFrame) -> DataFrame:
    """``(key, group, child, head, label)`` of grouped tokens ``(key, group, at, text, dep, head_text, head_i, token_i, sent_i)``.

    ``child`` and ``head`` count from 0 within the group. The head is the token that ``head_i`` names; without that the token with the
    head's text that lies nearest to ``sent_i``, the earlier of two. Roots, and tokens that would be their own head, have no edge.
    """
    place = (F.row_number().over(Window.partitionBy("key", "group").orderBy("at")) - 1).alias("place")
    t = tokens.select("*", place, F.count(F.lit(1)).over(Window.partitionBy("key", "group")).alias("size"))
    child = t.filter("dep is null or dep <> 'ROOT'")
    by_id = t.select("key", "group", F.col("token_i").alias("head_i"), F.col("place").alias("by_id")).groupBy("key", "group", "head_i").agg(F.min("by_id").alias("by_id"))
    named = child.join(by_id, ["key", "group", "head_i"], "left")
    by_text = t.select("key", "group", F.col("text").alias("head_text"), F.col("place").alias("there"))
    missing = named.filter("by_id is null").join(by_text, ["key", "group", "head_text"]).filter("token_i is null or there <> token_i")
    middle = F.coalesce(F.col("sent_i"), F.floor(F.col("size") / 2).cast("int"))
    found = missing.groupBy("key", "group", "place").agg(F.min_by("there", F.struct(F.abs(F.col("there") - middle).alias("d"), "there")).alias("by_text"))
    out = named.join(found, ["key", "group", "place"], "left").withColumn("head", F.coalesce("by_id", "by_text"))
    return out.filter("head is not null and head <> place").select("key", "group", F.col("place").alias("child"), "head", F.coalesce("dep", F.lit("")).alias("label"))


def syntax(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 15) -> DataFrame:
    """``(key, lang, ner, keywords, dependencies, sentiment, pos_tags)``: everything about the syntax of each text."""
    a = documents.analysed(docs, key, text)
    words = documents.keywords(documents.term_counts(a), k).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term", "n"))), lambda x: F.struct(x["term"].alias("term"), x["n"].cast("double").alias("weight"))).alias("counted"))
    counted = F.coalesce("counted", F.array().cast(KEYWORD))
    plain = F.struct(documents.mood(F.col("score")).alias("label"), F.col("score"), F.lit("lexicon").alias("raw"))
    full = a.join(words, "key", "left").join(documents.sentiment(a).select("key", "score"), "key").join(dependencies(docs, key, text), "key")
    return full.select("key", "lang", entities("text", F.col("lang")).alias("ner"), applied("text", F.col("lang"), "keywords", KEYWORD, counted).alias("keywords"), "dependencies", applied("text", F.col("lang"), "sentiment", MOOD, plain).alias("sentiment"), F.transform("tokens", lambda t: F.struct(t["text"], t["pos"])).alias("pos_tags"))
