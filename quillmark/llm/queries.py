"""The queries pN_... of the ten training-data problems, and SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bitext, encoding, grouping, leakage, neighbours, reading, sentences, splitting, tokenizing, truncation
from quillmark.session import checkpoint, once_per_key, spread, table


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = once_per_key(table(spark, sf_dir, "segments"), "segment_id", "label", "text", order="arrived_at")
    return splitting.split_oversized(once)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No text of at most 1,200 code points can have more non-blank ones: those rows need not be shuffled.
    long = table(spark, sf_dir, "segments").filter(F.length("text") > splitting.LIMIT)
    once = once_per_key(long, "segment_id", "text", order="arrived_at")
    return splitting.split_oversized(once).filter(F.size("pieces") > 1).select("segment_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every segment, with how many predictions its sample feeds."""
    pieces = _pieces(spark, sf_dir).select("segment_id", "label", F.explode("pieces").alias("p")).select("segment_id", F.col("label").alias("sample"), "p.*")
    fed = table(spark, sf_dir, "nn_predictions").groupBy("sample").agg(F.countDistinct("pred_id").alias("n_predictions"))
    return pieces.join(fed, "sample", "left").withColumn("n_predictions", F.coalesce("n_predictions", F.lit(0)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = once_per_key(table(spark, sf_dir, "sentences"), "sentence_id", "text", order="arrived_at")
    return once.select("sentence_id", F.explode(sentences.sentence_ends("text")).alias("end_pos"))


def p2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence in order, with its text."""
    once = once_per_key(table(spark, sf_dir, "sentences"), "sentence_id", "text", "lang", order="arrived_at")
    found = once.withColumn("ends", sentences.sentence_ends("text"))
    at = found.select("*", F.posexplode("ends").alias("at", "end_pos"))
    start = F.when(F.col("at") == 0, F.lit(0)).otherwise(F.get("ends", F.col("at") - 1))
    unit = F.regexp_replace(F.substring("text", start + 1, F.col("end_pos") - start), r"^[\s\p{Z}\x85\ufeff]+", "")
    return at.select("sentence_id", (F.col("at") + 1).alias("sentence_no"), "end_pos", "lang", unit.alias("sentence"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once_per_key(table(spark, sf_dir, "history"), "id", "input_text", order="arrived_at").filter("input_text is not null").select(F.col("id").alias("history_id"), F.col("input_text").alias("text"))


def _levels(texts: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of every text of history."""
    scale = reading.learn_scale(table(spark, sf_dir, "reading_levels"))
    return texts.withColumn("r", reading.reading_level(texts, scale, "text")).select("history_id", "text", "r.score", "r.level")


def p3_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spread(_history(spark, sf_dir), "history_id"), spark, sf_dir).drop("text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a wrongly decoded text has the level of its garbage; such texts are another problem's cases. They are looked for among the
    # texts of this level only, by the statistics of all texts.
    texts = checkpoint(spread(_history(spark, sf_dir), "history_id"))
    counts = encoding.corpus_counts(texts.select("text").union(_paths(spark, sf_dir).select("text")))
    hard = checkpoint(_levels(texts, spark, sf_dir).filter("level = 4").select("history_id", "text"))
    odd = F.col("text").rlike(NOT_ASCII)
    return hard.filter(~odd).select("history_id").union(encoding.wrongly_decoded(hard.filter(odd), counts).filter("not damaged").select("history_id"))


FEATURES = 50


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar other vectors of every usable vector."""
    once = once_per_key(table(spark, sf_dir, "feature_vectors"), "vec_id", "function_word_freq", order="arrived_at")
    return neighbours.most_similar(once, "vec_id", "function_word_freq", FEATURES)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = p4_neighbours(spark, sf_dir)
    return near.select(F.least("query", "neighbour").alias("vec_a"), F.greatest("query", "neighbour").alias("vec_b")).distinct()


def _bitexts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bitexts once with both sides as lists in order; pairs of sentences that translate one another."""
    once = once_per_key(table(spark, sf_dir, "alignments"), "bitext_id", "pairs", "unmatched_zh", "unmatched_en", order="arrived_at")
    side = lambda name: F.concat(F.coalesce(F.col(f"pairs.{name}"), F.array().cast("array<string>")), F.coalesce(f"unmatched_{name}", F.array().cast("array<string>")))
    texts = checkpoint(spread(once.select("bitext_id", side("zh").alias("zh"), side("en").alias("en")), "bitext_id"))
    # the word list counts as short documents; its wrong entries are outvoted by the texts
    words = table(spark, sf_dir, "glossary").select(F.array_repeat("zh_term", 3).alias("zh"), F.array_repeat("en_term", 3).alias("en"))
    learnt = texts.select("zh", "en").union(words)
    vectors = bitext.learn(learnt, vectors=bitext.learn(learnt))
    return texts, texts.select("bitext_id", F.explode(bitext.translations(texts, vectors)).alias("p")).select("bitext_id", "p.zh_no", "p.en_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bitexts(spark, sf_dir)[1]


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences without a counterpart: side, number and text."""
    texts, pairs = _bitexts(spark, sf_dir)
    pairs = checkpoint(pairs)
    out = None
    for lang in ("zh", "en"):
        every = texts.select("bitext_id", F.posexplode(lang).alias("at", "sentence")).select("bitext_id", F.lit(lang).alias("side"), (F.col("at") + 1).alias("no"), "sentence")
        left = every.join(pairs.select("bitext_id", F.col(f"{lang}_no").alias("no")).distinct(), ["bitext_id", "no"], "left_anti").select("bitext_id", "side", "no", "sentence")
        out = left if out is None else out.union(left)
    return out


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.must_share(grouping.tied(table(spark, sf_dir, "nn_predictions")))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.split_related(grouping.tied(table(spark, sf_dir, "nn_predictions")))


#: Only texts with other than ASCII characters can show that they were wrongly decoded.
NOT_ASCII = "[^\\x00-\\x7f]"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once_per_key(table(spark, sf_dir, "batch_items"), "item_id", "path", order="arrived_at").filter("path is not null").select("item_id", F.col("path").alias("text"))


def _read_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-null text of history and path of batch_items once, with what its bytes say when read anew."""
    rows = _history(spark, sf_dir).select(F.lit("history").alias("tbl"), F.col("history_id").alias("row_id"), "text")
    paths = _paths(spark, sf_dir).select(F.lit("batch_items"), F.col("item_id").cast("string"), "text")
    # written out once: the statistics and the search both read it
    texts = checkpoint(spread(rows.union(paths), "row_id"))
    counts = encoding.corpus_counts(texts)
    return encoding.wrongly_decoded(texts.filter(F.col("text").rlike(NOT_ASCII)), counts)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_anew(spark, sf_dir).filter("damaged").select("tbl", "row_id")


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged texts and what could be recovered; ``whole`` where no character is lost."""
    return _read_anew(spark, sf_dir).filter("damaged").select("tbl", "row_id", "restored", (~F.col("restored").rlike("[\ufffd\x80-\x9f]")).alias("whole"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(docs, "doc_id").select("doc_id", tokenizing.token_ids("text").alias("ids"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return leakage.leaked(leakage.leaks(docs, table(spark, sf_dir, "eval_items"))).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.find_cut(table(spark, sf_dir, "documents")).filter("cut").select("doc_id")


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts: all its documents, blank ones included, and the cut ones."""
    docs = table(spark, sf_dir, "documents")
    cut = truncation.find_cut(docs).filter("cut").groupBy("source").agg(F.count(F.lit(1)).alias("n_cut"))
    total = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"))
    n = F.coalesce("n_cut", F.lit(0))
    return total.join(cut, total["source"].eqNullSafe(cut["source"]), "left").select(total["source"], "n_documents", n.alias("n_cut"), (n / F.col("n_documents")).alias("share_cut"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_sentences, p3_found, p3_levels, p4_found, p4_neighbours, p5_found, p5_unmatched, p6_found, p6_splits, p7_found, p7_restored, p8_ids, p9_found, p10_found, p10_sources)}

ORACLE: dict[str, str] = {
    "p1_found": r"""SELECT DISTINCT segment_id FROM segments
        WHERE segment_id IS NOT NULL AND length(regexp_replace(text, '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')) > 1200""",
}
