"""Per-document analyses: statistics, readability, sentiment, keywords, concordance, alignment by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import text as T
from quillmark.functions import words as W


def analysed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Language, tokens and sentences of each text, computed once; an empty text is zh without tokens."""
    t = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return t.withColumn("lang", T.language("text")).withColumn("tokens", T.tokens("text", F.col("lang"))).withColumn("sentences", T.sentences("text"))


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`basic` without building tokens: only mixed texts, whose runs follow rules of their own, are taken apart."""
    t = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), T.language(text).alias("lang"))
    n = F.when(F.col("lang") == "en", F.regexp_count("text", F.lit(T.WORD_JOINED))).when(F.col("lang") == "zh", F.regexp_count("text", F.lit(rf"{T.HAN}|[\p{{L}}\p{{N}}_]"))).otherwise(F.size(T.tokens_mixed("text")))
    return t.select("key", "lang", F.length("text").cast("bigint").alias("n_chars"), T.nonspace_length("text").cast("bigint").alias("n_chars_no_space"), n.cast("bigint").alias("n_tokens"), F.size(T.sentences("text")).cast("bigint").alias("n_sentences"))


def basic(a: DataFrame) -> DataFrame:
    return a.select("key", "lang", F.length("text").cast("bigint").alias("n_chars"), F.length(F.regexp_replace("text", r"[\s\p{Z}\x1c-\x1f\x85]+", "")).cast("bigint").alias("n_chars_no_space"), F.size("tokens").cast("bigint").alias("n_tokens"), F.size("sentences").cast("bigint").alias("n_sentences"))


def meaningful(a: DataFrame) -> DataFrame:
    """``(key, pos, term)``: tokens that are neither marks nor stop words, by lemma where there is one."""
    t = a.select("key", F.posexplode("tokens").alias("pos", "t")).filter(~T.is_mark("t.text") & ~F.col("t.is_stop"))
    return t.select("key", "pos", F.coalesce(F.nullif("t.lemma", F.lit("")), F.col("t.text")).alias("term"))


def term_lists(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, term, n, first)`` of each text, where terms are cut out without the other fields of a token.

    ``first`` orders terms by where they occur first.
    """
    t = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), T.language(text).alias("lang"))
    en = F.filter(F.transform(T._all("text", T.WORD_JOINED), F.lower), lambda x: ~x.isin(W.EN_STOP))
    zh = F.filter(T._all("text", rf"{T.HAN}|[\p{{L}}\p{{N}}_]"), lambda x: ~(x.rlike(T.HAN) & x.isin(W.ZH_STOP)))
    kept = F.filter(T.tokens_mixed("text"), lambda x: ~T.is_mark(x["text"]) & ~x["is_stop"])
    mixed = F.transform(kept, lambda x: F.coalesce(F.nullif(x["lemma"], F.lit("")), x["text"]))
    terms = t.select("key", F.posexplode(F.when(F.col("lang") == "en", en).when(F.col("lang") == "zh", zh).otherwise(mixed)).alias("pos", "term"))
    return terms.groupBy("key", "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def term_counts(a: DataFrame) -> DataFrame:
    return meaningful(a).groupBy("key", "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def keywords(counts: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent terms of each document, ties by first occurrence, from its :func:`term_lists` or :func:`term_counts`."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k).select("key", "rank", "term", "n")


def pos_counts(a: DataFrame) -> DataFrame:
    return a.select("key", F.explode("tokens").alias("t")).groupBy("key", F.col("t.pos").alias("pos")).agg(F.count(F.lit(1)).alias("n"))


def ease_label(x: Column) -> Column:
    return F.when(x >= 90, "very easy").when(x >= 70, "easy").when(x >= 60, "standard").when(x >= 50, "fairly hard").when(x >= 30, "hard").otherwise("very hard")


def readability_en(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Flesch ease and Flesch-Kincaid grade, unrounded; the label goes by the unrounded score."""
    w = T._all("text", T.WORD_JOINED)
    base = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    n = base.select("key", F.size(w).alias("words"), F.greatest(F.size(T.sentences("text")), F.lit(1)).alias("sentences"), F.aggregate(F.transform(w, T.syllable_count), F.lit(0), lambda a, x: a + x).alias("syllables"))
    m = n.select("key", (F.col("words") / F.col("sentences")).alias("sentence_length"), (F.col("syllables") / F.greatest("words", F.lit(1))).alias("syllables_per_word"))
    ease = 206.835 - 1.015 * F.col("sentence_length") - 84.6 * F.col("syllables_per_word")
    return m.select("key", ease.alias("flesch_ease"), (0.39 * F.col("sentence_length") + 11.8 * F.col("syllables_per_word") - 15.59).alias("flesch_kincaid"), "sentence_length", "syllables_per_word", ease_label(ease).alias("label"))


def readability_zh(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Characters per sentence and per token, distinct tokens, score between 0 and 100."""
    base = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    t = F.transform(T.tokens_zh("text"), lambda x: x["text"])
    n = base.select("key", T.nonspace_length("text").alias("chars"), F.greatest(F.size(T.sentences("text")), F.lit(1)).alias("s"), F.size(t).alias("t"), F.size(F.array_distinct(t)).alias("d"))
    m = n.select("key", (F.col("chars") / F.col("s")).alias("sentence_length"), (F.col("chars") / F.greatest("t", F.lit(1))).alias("token_length"), (F.col("d") / F.greatest("t", F.lit(1))).alias("richness"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - (F.col("sentence_length") - 15) * 2 - (1 - F.col("richness")) * 30))
    return m.withColumn("score", score).withColumn("level", F.when(score >= 80, "easy").when(score >= 60, "medium").when(score >= 40, "fairly hard").otherwise("hard"))


def _share(tokens: Column, lang: Column) -> Column:
    lemma = lambda t: F.coalesce(F.nullif(t["lemma"], F.lit("")), t["text"])
    kept = F.transform(F.filter(tokens, lambda t: ~T.is_mark(t["text"])), lemma)
    count = lambda xs: F.size(F.filter(kept, lambda w: w.isin(xs)))
    value = F.when(lang == "zh", count(W.ZH_POSITIVE) - count(W.ZH_NEGATIVE)).otherwise(count(W.EN_POSITIVE) - count(W.EN_NEGATIVE))
    return value / F.greatest(F.size(kept), F.lit(1))


def mood(score: Column) -> Column:
    return F.when(score > 0.15, "positive").when(score < -0.15, "negative").otherwise("neutral")


def sentiment(a: DataFrame) -> DataFrame:
    s = _share(F.col("tokens"), F.col("lang"))
    return a.select("key", s.alias("score"), mood(s).alias("label"))


def sentiment_by_sentence(a: DataFrame) -> DataFrame:
    one = a.select("key", F.posexplode("sentences").alias("at", "sentence")).withColumn("lang", T.language("sentence"))
    s = _share(T.tokens("sentence", F.col("lang")), F.col("lang"))
    return one.select("key", (F.col("at") + 1).alias("no"), s.alias("score"), mood(s).alias("label"))


def concordance(a: DataFrame, keyword: str, window: int = 6, case_sensitive: bool = False, regex: bool = False) -> DataFrame:
    """Each token that the keyword is found in, or in its lemma in English, with the tokens around it joined without blanks."""
    if not keyword.strip():
        return a.sparkSession.createDataFrame([], "key bigint, position int, `left` string, keyword string, `right` string")
    quoted = keyword if regex else "\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    pattern = ("" if case_sensitive else "(?iu)") + quoted
    t = a.filter(T.strip("text") != "").select("key", "lang", F.transform("tokens", lambda x: x["text"]).alias("w"), "tokens").select("key", "lang", "w", F.posexplode("tokens").alias("position", "t"))
    hit = F.col("t.text").rlike(pattern) | ((F.col("lang") == "en") & F.col("t.lemma").rlike(pattern))
    start = F.greatest(F.col("position") - window, F.lit(0))
    left = F.array_join(F.slice("w", start + 1, F.col("position") - start), "")
    right = F.array_join(F.slice("w", F.col("position") + 2, F.lit(window)), "")
    return t.filter(hit).select("key", "position", left.alias("left"), F.col("t.text").alias("keyword"), right.alias("right"))


def concordance_table(lines: DataFrame) -> DataFrame:
    """One printed line for each hit, left contexts flush right; nothing is cut."""
    width = lines.agg(F.max(F.length("left")).alias("width"))
    padded = F.concat(F.repeat(F.lit(" "), F.col("width") - F.length("left")), F.col("left"))
    return lines.crossJoin(F.broadcast(width)).select("key", "position", F.concat(padded, F.lit("  ["), "keyword", F.lit("]  "), "right").alias("line"))


def align_by_place(texts: DataFrame, key: str, zh: str, en: str) -> DataFrame:
    """Sentences of two texts paired by number, kept if the ratio of characters to words lies between 0.3 and 4.

    What counts as unmatched is what lies behind as many sentences as there are pairs, whichever these are.
    """
    s = texts.select(F.col(key).alias("key"), T.sentences(zh).alias("z"), T.sentences(en).alias("e"))
    n = F.least(F.size("z"), F.size("e"))
    z, e = F.slice("z", 1, n), F.slice("e", 1, n)
    words = lambda x: F.greatest(F.size(F.filter(F.split(x, r"[\s\p{Z}]+"), lambda w: w != "")), F.lit(1))
    both = F.zip_with(z, e, lambda a, b: F.struct(a.alias("zh"), b.alias("en"), (T.nonspace_length(a) / words(b)).alias("ratio")))
    pairs = F.filter(both, lambda p: (p["ratio"] > 0.3) & (p["ratio"] < 4.0))
    rest = lambda c: F.slice(c, F.size("pairs") + 1, F.greatest(F.size(c), F.lit(1)))
    return s.withColumn("pairs", pairs).select("key", F.transform("pairs", lambda p: F.struct(p["zh"], p["en"])).alias("pairs"), rest("z").alias("unmatched_zh"), rest("e").alias("unmatched_en"))


def batch(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: counts and the five most frequent terms, or an error where there is no text."""
    terms = term_lists(docs, key, text)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "first"))
    top = terms.withColumn("rank", rank).groupBy("key").agg(F.count(F.lit(1)).alias("unique_terms"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", F.concat_ws(":", "term", "n").alias("s"))))), lambda x: x["s"]), ";").alias("top_terms"))
    good = counts(docs, key, text).join(top, "key", "left").withColumn("status", F.lit("ok")).withColumn("error", F.lit(""))
    bad = docs.filter(F.col(text).isNull()).select(F.col(key).alias("key"), F.lit("error").alias("status"), F.lit("no text").alias("error"))
    return good.unionByName(bad, allowMissingColumns=True).withColumn("unique_terms", F.coalesce("unique_terms", F.when(F.col("status") == "ok", F.lit(0)))).withColumn("top_terms", F.coalesce("top_terms", F.when(F.col("status") == "ok", F.lit(""))))


def segments(text_rows: DataFrame, lang: str = "en", size: int = 1000, key: str = "label") -> DataFrame:
    """``(key, segment_no, text, n_chars)``: whole sentences gathered until a weight is reached; a small rest joins the last.

    A sentence weighs three for each word in English and its characters in Chinese. Sentences are joined without blanks.
    """
    weight = (lambda s: 3 * F.size(F.filter(F.split(s, r"[\s\p{Z}]+"), lambda w: w != ""))) if lang == "en" else (lambda s: T.nonspace_length(s))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("w"))

    def step(acc: Column, s: Column) -> Column:
        joined, w = F.concat(acc["open"], s), acc["w"] + weight(s)
        full = w >= size
        return F.struct(F.when(full, F.array_append(acc["done"], joined)).otherwise(acc["done"]).alias("done"), F.when(full, F.lit("")).otherwise(joined).alias("open"), F.when(full, F.lit(0)).otherwise(w).alias("w"))

    def finish(acc: Column) -> Column:
        n = F.size(acc["done"])
        small = (n > 0) & (T.nonspace_length(acc["open"]) < size // 3)
        merged = F.concat(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.get(acc["done"], n - 1), acc["open"])))
        return F.when(acc["open"] == "", acc["done"]).when(small, merged).otherwise(F.array_append(acc["done"], acc["open"]))

    cut = text_rows.select(key, F.aggregate(T.sentences("text"), state, step, finish).alias("s"))
    return cut.select(key, F.posexplode("s").alias("segment_no", "text")).select(key, "segment_no", "text", T.nonspace_length("text").cast("bigint").alias("n_chars"))
