"""All queries on the test tables by name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import authorship, clustering, documents, fingerprint, frequencies, inference, metrics, models, pairs, sensitivity
from quillmark.plans import corpus as C
from quillmark.plans import oracle
from quillmark.session import checkpoint, spread, table
from quillmark.sources import files, results, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Decimals that results of floating-point sums are compared to.
DIGITS = 6


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to six decimals, counts as bigint, so that engines with other sums and types agree."""
    out = []
    for c, t in df.dtypes:
        x = F.col(c)
        out.append(F.round(x, DIGITS).alias(c) if t == "double" and c not in keep else x.cast("bigint").alias(c) if t in ("int", "smallint") else F.transform(x, lambda v: F.round(v, DIGITS)).alias(c) if t == "array<double>" else x)
    return df.select(*out)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    # text is costly to take apart, so a table of few row groups is spread over all cores first
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def _analysed(spark: SparkSession, sf: str) -> DataFrame:
    return documents.analysed(_docs(spark, sf))


def _doc(df: DataFrame) -> DataFrame:
    return rounded(df.withColumnRenamed("key", "doc_id"))


# ---- languages, tokens, sentences ------------------------------------------------------------------------------------


@query
def lang_detect(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).filter("text is not null").select("doc_id", T.language("text").alias("detected"))


def _token_query(pattern: str) -> Query:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        t = _docs(spark, sf).filter("text is not null").select("doc_id", F.posexplode(T.tokens_plain("text", pattern)).alias("pos", "token"))
        return rounded(t)

    return f


QUERIES["tok_stylometry"] = _token_query(T.WORD)
QUERIES["tok_control"] = _token_query(T.WORD_MARKED)


def _tokens_of(make: Callable) -> Query:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        t = _docs(spark, sf).filter("text is not null").select("doc_id", F.posexplode(make("text")).alias("pos", "t"))
        return rounded(t.select("doc_id", "pos", F.col("t.text").alias("token"), F.col("t.pos").alias("kind"), F.col("t.lemma").alias("lemma"), F.col("t.is_stop").alias("is_stop")))

    return f


QUERIES["tok_en"] = _tokens_of(T.tokens_en)
QUERIES["tok_zh"] = _tokens_of(T.tokens_zh)
QUERIES["tok_mixed"] = _tokens_of(T.tokens_mixed)


@query
def punct_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Which blank-separated pieces of all texts hold neither letter nor digit."""
    w = _docs(spark, sf).filter("text is not null").select(F.explode(F.split("text", "[ \n\r\t]+")).alias("piece")).filter("piece <> ''")
    return w.filter(T.is_mark("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


@query
def sent_split(spark: SparkSession, sf: str) -> DataFrame:
    s = _docs(spark, sf).filter("text is not null").select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))
    return rounded(s)


@query
def syllables(spark: SparkSession, sf: str) -> DataFrame:
    w = _docs(spark, sf).filter("text is not null").select(F.explode(T.tokens_plain("text")).alias("word")).distinct()
    return rounded(w.select("word", T.syllable_count("word").alias("syllables")))


@query
def char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    g = _docs(spark, sf).filter("text is not null").select(F.explode(T.ngrams("text", 4, "en")).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query
def word_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    b = _docs(spark, sf).filter("text is not null").select(F.explode(T.bigrams(T.word_list(T.tokens_en("text")))).alias("bigram"))
    return b.groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


@query
def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.chunks(spark, sf, "1k").select("label", "chunk_no", "text"))


@query
def segment_text(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(documents.segments(C.corpus(spark, sf), "en").select("label", "segment_no", "text", "n_chars"))


@query
def segment_text_zh(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(documents.segments(C.corpus(spark, sf, "zh"), "zh").select("label", "segment_no", "text", "n_chars"))


@query
def work_stems(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "segments").select("label").distinct()
    return rounded(s.select("label", F.substring_index("label", "/", 1).alias("grp"), T.work_of("label").alias("work"), T.chunk_number("label").alias("chunk_no")))


# ---- documents -------------------------------------------------------------------------------------------------------


@query
def basic_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _doc(documents.counts(_docs(spark, sf)))


@query
def term_freq(spark: SparkSession, sf: str) -> DataFrame:
    return _doc(documents.term_lists(_docs(spark, sf)).select("key", "term", "n"))


@query
def pos_dist(spark: SparkSession, sf: str) -> DataFrame:
    return _doc(documents.pos_counts(_analysed(spark, sf)))


@query
def keywords_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _doc(documents.keywords(documents.term_lists(_docs(spark, sf))))


@query
def batch_report(spark: SparkSession, sf: str) -> DataFrame:
    return _doc(documents.batch(_docs(spark, sf)).select("key", "status", "error", "lang", "n_chars", "n_tokens", "n_sentences", "unique_terms", "top_terms"))


@query
def readability_en(spark: SparkSession, sf: str) -> DataFrame:
    return _doc(documents.readability_en(_docs(spark, sf)))


@query
def readability_zh(spark: SparkSession, sf: str) -> DataFrame:
    return _doc(documents.readability_zh(_docs(spark, sf)).select("key", "sentence_length", "token_length", "richness", "score", "level"))


@query
def sentiment_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return _doc(documents.sentiment(_analysed(spark, sf)))


@query
def sentiment_by_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return _doc(documents.sentiment_by_sentence(_analysed(spark, sf)))


KEYWORD = "lantern"


@query
def kwic_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _doc(documents.concordance(_analysed(spark, sf), KEYWORD))


@query
def kwic_table(spark: SparkSession, sf: str) -> DataFrame:
    return _doc(documents.concordance_table(documents.concordance(_analysed(spark, sf), KEYWORD)))


@query
def align_by_place(spark: SparkSession, sf: str) -> DataFrame:
    """The sides of each bitext as texts, paired by number."""
    a = table(spark, sf, "alignments").dropDuplicates(["bitext_id"])
    side = lambda x: F.array_join(F.concat(F.coalesce(F.col(f"pairs.{x}"), F.array().cast("array<string>")), F.coalesce(f"unmatched_{x}", F.array().cast("array<string>"))), "\n")
    p = documents.align_by_place(a.select("bitext_id", side("zh").alias("zh"), side("en").alias("en")), "bitext_id", "zh", "en")
    return p.select(F.col("key").alias("bitext_id"), F.size("pairs").cast("bigint").alias("n_pairs"), F.array_join(F.transform("pairs", lambda x: F.concat_ws("|", x["zh"], x["en"])), "\n").alias("pairs"), F.size("unmatched_zh").cast("bigint").alias("left_zh"), F.size("unmatched_en").cast("bigint").alias("left_en"))


@query
def rtf_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts wrapped as RTF and read back."""
    d = _docs(spark, sf).filter("text is not null")
    wrapped = F.concat(F.lit("{\\rtf1\\ansi "), F.regexp_replace("text", "\r\n|\r|\n", "\\\\par "), F.lit("}"))
    return d.select("doc_id", files.rich_text(wrapped).alias("plain"))


@query
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as pages with a hidden script, read back by the page reader."""
    @F.pandas_udf("string")
    def read(x: pd.Series) -> pd.Series:
        return x.map(files.page)

    d = _docs(spark, sf).filter("text is not null")
    page = F.concat(F.lit("<html><body><script>var x = 1;</script><p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></body></html>"))
    return d.select("doc_id", read(page).alias("plain"))


# ---- what figures and summaries show -----------------------------------------------------------------------------------


@query
def figure_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    return results.figure_data("top_terms", documents.term_lists(_docs(spark, sf)).select("term", "n"))


@query
def figure_word_cloud(spark: SparkSession, sf: str) -> DataFrame:
    return results.figure_data("word_cloud", documents.term_lists(_docs(spark, sf)).select("term", "n"))


@query
def figure_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(results.figure_data("kinds", documents.pos_counts(_analysed(spark, sf))))


@query
def figure_moods(spark: SparkSession, sf: str) -> DataFrame:
    return _doc(results.figure_data("moods", documents.sentiment_by_sentence(_analysed(spark, sf))))


@query
def figure_similarities(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(results.figure_data("similarities", _authors(spark, sf)[1]))


@query
def language_names(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).filter("text is not null").select("doc_id", results.language_name(T.language("text")).alias("language"))


@query
def unmarked_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without hidden sentence numbers, which are put before every other line here first."""
    d = _docs(spark, sf).filter("text is not null")
    return d.select("doc_id", results.unmarked(F.concat(F.lit("\x00[1]\x00"), F.replace("text", F.lit("\n"), F.lit("\n\x00[27]\x00")))).alias("text"))


@query
def basic_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return documents.counts(_docs(spark, sf)).select(F.col("key").alias("doc_id"), results.basic_summary().alias("summary"))


@query
def syntax(spark: SparkSession, sf: str) -> DataFrame:
    """Entities, keywords, dependencies and sentiment of each text by the fallbacks: no model is installed."""
    s = models.syntax(_docs(spark, sf))
    return rounded(s.select(F.col("key").alias("doc_id"), "lang", F.size("ner").alias("entities"), F.size("dependencies").alias("dependencies"), F.try_element_at("keywords", F.lit(1))["term"].alias("first_keyword"), F.col("sentiment.label").alias("mood"), F.size("pos_tags").alias("tokens")))


@query
def history_latest(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "history").dropDuplicates(["id"])
    return sinks.latest(h, "ts").select("id", "lang", "sentiment_label", F.round("sentiment_score", DIGITS).alias("sentiment_score"))


# ---- frequencies and Delta -------------------------------------------------------------------------------------------


def _words(spark: SparkSession, sf: str, tokenize: Callable = T.tokens_plain) -> DataFrame:
    return frequencies.exploded(C.corpus(spark, sf), tokenize)


def _counted(texts: DataFrame, tokenize: Callable = T.tokens_plain) -> DataFrame:
    """Counts by label and word, made once: they feed the vocabulary, the shares and the scores."""
    return checkpoint(frequencies.counted(frequencies.exploded(texts, tokenize)))


def _freq(spark: SparkSession, sf: str, n: int = 100, tokenize: Callable = T.tokens_plain) -> DataFrame:
    counts = _counted(C.corpus(spark, sf), tokenize)
    return frequencies.relative(counts, frequencies.most_frequent(counts, n))


def _z(spark: SparkSession, sf: str, n: int = 100, tokenize: Callable = T.tokens_plain) -> DataFrame:
    return frequencies.z_scores(checkpoint(_freq(spark, sf, n, tokenize)))


def _vectors(spark: SparkSession, sf: str, n: int = 100, tokenize: Callable = T.tokens_plain) -> DataFrame:
    return frequencies.vectors(_z(spark, sf, n, tokenize))


def _vectors_of(counts: DataFrame, n: int = 100) -> DataFrame:
    return frequencies.vectors(frequencies.z_scores(checkpoint(frequencies.relative(counts, frequencies.most_frequent(counts, n)))))


def _delta(spark: SparkSession, sf: str, n: int = 100, tokenize: Callable = T.tokens_plain) -> DataFrame:
    return pairs.delta(_vectors(spark, sf, n, tokenize))


@query
def mfw_top100(spark: SparkSession, sf: str) -> DataFrame:
    return frequencies.most_frequent(frequencies.counted(_words(spark, sf)))


@query
def rel_freq(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_freq(spark, sf))


@query
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_z(spark, sf))


@query
def dropped_features(spark: SparkSession, sf: str) -> DataFrame:
    """Of the 500 most frequent words those that every sample uses alike; each sample gets as many copies of one more word as it has words."""
    alike = C.corpus(spark, sf).select("label", F.concat("text", F.repeat(F.lit(" zzalike"), F.regexp_count("text", F.lit(T.WORD)))).alias("text"))
    counts = _counted(alike)
    return frequencies.constant_words(frequencies.relative(counts, frequencies.most_frequent(counts, 500)))


@query
def delta_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_delta(spark, sf))


@query
def delta_control(spark: SparkSession, sf: str) -> DataFrame:
    """Delta with the tokenizer that keeps apostrophes."""
    return rounded(_delta(spark, sf, 100, lambda t: T.tokens_plain(t, T.WORD_MARKED)))


@query
def delta_groups_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The square matrix between groups, as rows of a wide table turned to long form again."""
    # counted by group: the texts of a group are never joined
    counts = checkpoint(frequencies.counted(frequencies.exploded(C.corpus(spark, sf), key="grp").withColumnRenamed("grp", "label")))
    wide = sinks.matrix_wide(checkpoint(pairs.delta(_vectors_of(counts))))
    cells = [F.struct(F.lit(c).alias("lb"), F.col(f"`{c}`").alias("d")) for c in wide.columns[1:]]
    return rounded(wide.select("la", F.explode(F.array(*cells)).alias("c")).select("la", "c.lb", "c.d"))


@query
def delta_within_cross(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.within_across_of_moments(pairs.delta_moments(_vectors(spark, sf))))


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.predictions(pairs.delta_nearest(_vectors(spark, sf)))


@query
def nn_loo(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_predicted(spark, sf))


@query
def nn_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.accuracy(_predicted(spark, sf)))


@query
def nn_structure(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.structure(_predicted(spark, sf)))


def _competition(vectors: DataFrame) -> DataFrame:
    return metrics.competition_in_cells(vectors, ["v"], pairs.mean_absolute)


@query
def signal_competition(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_competition(_vectors(spark, sf)))


@query
def signal_wins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.wins(_competition(_vectors(spark, sf))))


@query
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.orphans(C.corpus(spark, sf).select("label"))


@query
def delta_excl_same_story(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.effect_of_moments(pairs.delta_moments(_vectors(spark, sf), other_work=True)).drop("sd_same", "sd_cross"))


@query
def mfw_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """The competition for four numbers of words on three scales of chunks."""
    out = None
    for scale in C.SIZES:
        counts = _counted(C.chunks(spark, sf, scale))
        for n in (50, 100, 200, 500):
            one = metrics.wins(_competition(_vectors_of(counts, n))).select(F.lit(scale).alias("scale"), F.lit(n).alias("top_n"), "*")
            out = one if out is None else out.unionByName(one)
    return rounded(out)


@query
def cluster_merges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clustering.cluster(_vectors(spark, sf), "average"))


@query
def linkage_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Merge heights for all four linkages, and how many works form a cluster of their own."""
    labels, x = clustering.labelled(_vectors(spark, sf))
    out = None
    for linkage, (tree, leaves) in zip(clustering.LINKAGES, clustering.trees(spark, labels, x, clustering.LINKAGES)):
        one = tree.agg(F.count(F.lit(1)).alias("merges"), F.max("height").alias("top")).withColumn("linkage", F.lit(linkage)).crossJoin(clustering.exact_works(tree, leaves).agg(F.count(F.lit(1)).alias("exact_works")))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


# ---- fingerprints ----------------------------------------------------------------------------------------------------


def _lists(spark: SparkSession, sf: str, lang: str = "en") -> DataFrame:
    return fingerprint.kept_lists(C.corpus(spark, sf, lang), lang)


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoint(fingerprint.features(_lists(spark, sf)))


def _vocabulary(kind: str, lang: str) -> Query:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(fingerprint.vocabulary(_lists(spark, sf, lang), kind))

    return f


def _shares(kind: str, lang: str) -> Query:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        lists = _lists(spark, sf, lang)
        return rounded(fingerprint.shares(lists, kind, fingerprint.vocabulary(lists, kind)).select("label", "term", "f"))

    return f


def _of_lists(make: Callable[[DataFrame, str], DataFrame], lang: str) -> Query:
    return lambda spark, sf: rounded(make(_lists(spark, sf, lang), lang))


for _lang, _tail in (("en", ""), ("zh", "_zh")):
    for _kind, _short in (("function_words", "func"), ("char_ngrams", "char4"), ("word_bigrams", "bigram"), ("punctuation", "punct")):
        QUERIES[f"vocab_{_short}{_tail}"] = _vocabulary(_kind, _lang)
        QUERIES[f"feat_{_short}{_tail}"] = _shares(_kind, _lang)
    QUERIES[f"feat_wordlen{_tail}"] = _of_lists(lambda x, lang: x.select("label", F.posexplode(fingerprint.word_lengths(lang)).alias("bin", "f")), _lang)
    QUERIES[f"feat_sentlen{_tail}"] = _of_lists(lambda x, lang: fingerprint.sentence_stats(x), _lang)
    QUERIES[f"feat_ttr_hapax{_tail}"] = _of_lists(lambda x, lang: fingerprint.richness(x), _lang)


@query
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    c = fingerprint.centroids(_features(spark, sf), F.substring_index("label", "/", 1))
    return rounded(c.select("grp", "members", "sent_mean", "ttr", "hapax", F.element_at("word_length", 3).alias("three_letters"), F.element_at("function_words", 1).alias("first_function_word")))


@query
def fp_dim_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fingerprint.pair_scores(_features(spark, sf)))


@query
def fp_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fingerprint.similarities(_features(spark, sf)))


@query
def feature_scores(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    g = F.substring_index("label", "/", 1)
    return rounded(fingerprint.to_centroid(f, fingerprint.centroids(f, g), g))


@query
def fp_same_cross_d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.effect_of_moments(fingerprint.moments(_features(spark, sf))).drop("sd_same", "sd_cross").withColumn("effect", metrics.effect_label("cohens_d")))


@query
def d_excl_same_story(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.effect_of_moments(fingerprint.moments(_features(spark, sf), other_work=True)).drop("sd_same", "sd_cross"))


@query
def sample_diffs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fingerprint.similarity_differences(_features(spark, sf)))


@query
def wilcoxon_stats(spark: SparkSession, sf: str) -> DataFrame:
    w = inference.wilcoxon(checkpoint(fingerprint.similarity_differences(_features(spark, sf))))
    return rounded(w.drop("p"))  # wilcoxon_p has it: SQL can't say it


@query
def wilcoxon_p(spark: SparkSession, sf: str) -> DataFrame:
    w = inference.wilcoxon(checkpoint(fingerprint.similarity_differences(_features(spark, sf))))
    return rounded(w.select("n", "p"))


def _story_differences(spark: SparkSession, sf: str) -> DataFrame:
    c = C.chunks(spark, sf, "1k").select("label", "text")
    return metrics.story_differences_in_cells(fingerprint.features(checkpoint(fingerprint._lists(c, "en"))), fingerprint.COLUMNS, fingerprint.likeness())


@query
def story_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """By work, over chunks: similarity within groups minus across."""
    return rounded(_story_differences(spark, sf))


@query
def story_wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.wilcoxon(checkpoint(_story_differences(spark, sf))).drop("p"))


@query
def equal_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.equal_chunks(C.chunks(spark, sf, "1k").select("label")))


@query
def equal_chunk_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Competition and effect size on equal numbers of chunks."""
    c = C.chunks(spark, sf, "1k").select("label", "text")
    kept = checkpoint(metrics.equal_chunks(c.select("label")))
    # vectors are those of all chunks, pairs only those of kept ones
    vectors = checkpoint(_vectors_of(_counted(c)).join(kept.select("label"), "label", "left_semi"))
    effect = metrics.effect_of_moments(pairs.delta_moments(vectors)).drop("sd_same", "sd_cross")
    return rounded(metrics.wins(_competition(vectors)).crossJoin(effect))


#: Draws of the resampling tests.
DRAWS = 10_000


def _halves(spark: SparkSession, sf: str) -> DataFrame:
    d = checkpoint(pairs.delta_differences(_vectors(spark, sf)))
    return d.select(F.col("label").alias("id"), (F.pmod(F.length("label"), F.lit(2)) == 0).alias("own"), F.round("diff", DIGITS).alias("x"))


@query
def permutation_md5(spark: SparkSession, sf: str) -> DataFrame:
    """Do differences of samples with labels of even length lie above those of the others? 10,000 draws by md5."""
    return inference.permutation_md5(checkpoint(_halves(spark, sf)), DRAWS)


@query
def permutation_seeded(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the shuffles of one seeded generator, one after the other in one task."""
    side = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(F.col("own") == flag, F.struct("id", "x")))), lambda v: v["x"])
    one = _halves(spark, sf).agg(side(True).alias("own"), side(False).alias("other"))
    return rounded(one.select(inference.permuted("own", "other").alias("p_value")))


def _interval(draws: DataFrame) -> DataFrame:
    return rounded(draws.agg(F.count(F.lit(1)).alias("valid"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high")))


@query
def bootstrap_md5(spark: SparkSession, sf: str) -> DataFrame:
    """95 % interval of Cohen's d from 10,000 resamples of the works."""
    return _interval(inference.bootstrap_in_blocks(_vectors(spark, sf), ["v"], pairs.mean_absolute, DRAWS))


@query
def bootstrap_seeded(spark: SparkSession, sf: str) -> DataFrame:
    return _interval(inference.bootstrap_in_blocks(_vectors(spark, sf), ["v"], pairs.mean_absolute, DRAWS, exact=True))


@query
def weight_variants(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sensitivity.table(spark))


def _by_variant(spark: SparkSession, sf: str) -> DataFrame:
    lists = lambda scale: checkpoint(fingerprint._lists(C.chunks(spark, sf, scale).select("label", "text"), "en"))
    return sensitivity.over_scales({scale: checkpoint(fingerprint.features(lists(scale))) for scale in C.SIZES})


@query
def weight_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """38 weight variants on three scales of chunks: 114 rows."""
    return rounded(_by_variant(spark, sf))


@query
def weight_sensitivity_works(spark: SparkSession, sf: str) -> DataFrame:
    """The variants on whole works."""
    return rounded(sensitivity.over_scales({"works": _features(spark, sf)}).drop("scale"))


@query
def weight_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sensitivity.summary(_by_variant(spark, sf)))


def _authors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return authorship.analysed(checkpoint(authorship.as_cases(C.samples(spark, sf))))


@query
def two_author(spark: SparkSession, sf: str) -> DataFrame:
    """For each group and language: does its longest sample resemble its second longest more than those of three other groups?"""
    return rounded(_authors(spark, sf)[0])


@query
def author_similarities(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_authors(spark, sf)[1])


@query
def author_validation(spark: SparkSession, sf: str) -> DataFrame:
    return authorship.validated(authorship.as_cases(C.samples(spark, sf)))


ORACLE = {k: v for k, v in oracle.sql().items() if k in QUERIES}
