"""Is a text by a known author? The text's segments against the known author and up to three control authors, many cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import text as T
from quillmark.operators import documents, inference
from quillmark.operators import fingerprint as P
from quillmark.operators.metrics import cohens_d, effect_label
from quillmark.session import checkpoint

#: Non-blank characters that the questioned text needs; controls that count.
LEAST, CONTROLS = 3_000, 3


def validated(cases: DataFrame, least: int = LEAST) -> DataFrame:
    """``(case, lang, error)`` from ``cases(case, role, text)`` with roles A (questioned), B (known), C1, C2 ... (controls); error is null
    for a case that can be analysed.

    A must have enough characters, B some, and one control at least some; A must not be of mixed language, and no other text that is
    used may be of another language. Blank controls don't count, of the others the first three.
    """
    full = cases.withColumn("full", F.coalesce(T.strip("text") != "", F.lit(False)))
    order = F.row_number().over(Window.partitionBy("case", "full", F.col("role").startswith("C")).orderBy("role"))
    t = full.withColumn("used", F.col("full") & (~F.col("role").startswith("C") | (order <= CONTROLS)))
    of = lambda role, x: F.max(F.when(F.col("role") == role, x))
    one = t.withColumn("l", T.language("text")).groupBy("case").agg(
        F.coalesce(of("A", T.nonspace_length("text")), F.lit(0)).alias("n_a"),
        F.coalesce(of("B", F.col("full")), F.lit(False)).alias("b"),
        F.count(F.when(F.col("used") & F.col("role").startswith("C"), 1)).alias("n_c"),
        of("A", F.col("l")).alias("lang"),
        F.collect_set(F.when(F.col("used"), F.col("l"))).alias("langs"),
    )
    other = F.filter("langs", lambda x: (x != F.col("lang")) & (x != "mixed"))
    error = (
        F.when(F.col("n_a") < least, F.format_string(f"the questioned text has %d characters, {least} are needed", F.col("n_a")))
        .when(~F.col("b"), "the known author has no text")
        .when(F.col("n_c") < 1, "no control author")
        .when(F.col("lang") == "mixed", "mixed languages can't be analysed")
        .when(F.size(other) > 0, F.concat(F.lit("texts in different languages: "), F.array_join(F.array_sort(F.array_union(F.array("lang"), other)), ", ")))
    )
    return one.select("case", "lang", error.alias("error"))


def used(cases: DataFrame) -> DataFrame:
    """The texts of each case that count."""
    t = cases.filter(F.coalesce(T.strip("text") != "", F.lit(False)))
    order = F.row_number().over(Window.partitionBy("case", F.col("role").startswith("C")).orderBy("role"))
    return t.withColumn("at", order).filter(~F.col("role").startswith("C") | (F.col("at") <= CONTROLS)).select("case", "role", "text")


def vocabularies(lists: DataFrame, kind: str) -> DataFrame:
    """``(case, terms)``: each case's most frequent terms of a kind over its whole texts, ties by first occurrence."""
    occ = P.occurrences(lists, kind).select("label.case", F.struct("label.role", "pos").alias("at"), "term")
    n = occ.groupBy("case", "term").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("n"), "first"))
    top = n.withColumn("idx", rank).filter(F.col("idx") <= P.SIZES[kind])
    return top.groupBy("case").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "term"))), lambda x: x["term"]).alias("terms"))


def segment_features(texts: DataFrame, lang: str) -> DataFrame:
    """All eight dimensions of each segment, ``label(case, role, no)``, over the vocabulary of its case."""
    whole = texts.select(F.struct("case", "role").alias("label"), "text")
    cut = documents.segments(whole, lang).select(F.struct("label.case", "label.role", F.col("segment_no").alias("no")).alias("label"), "text")
    full, lists = checkpoint(P._lists(whole, lang)), checkpoint(P._lists(cut, lang))
    out = lists.select("label", P.word_lengths(lang).alias("word_length")).join(P.sentence_stats(lists), "label").join(P.richness(lists), "label")
    none = F.array().cast("array<double>")
    for kind in P.SIZES:
        held = P.occurrences(lists, kind).groupBy("label", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("held"))
        v = vocabularies(full, kind)
        both = lists.select("label", F.size(kind).alias("total"), F.col("label.case").alias("case")).join(v, "case", "left").join(held, "label", "left")
        share = F.transform("terms", lambda t: F.coalesce(F.try_element_at("held", t), F.lit(0)) / F.greatest(F.col("total"), F.lit(1)))
        out = out.join(both.select("label", F.coalesce(share, none).alias(kind)), "label")
    return out


def similarities(feats: DataFrame) -> DataFrame:
    """``(case, ref, no, sim)``: each segment of A against the mean features of B and of every control of its case."""
    centres = P.centroids(feats.filter("label.role <> 'A'"), F.struct("label.case", "label.role"))
    c = centres.select(F.col("grp.case").alias("case"), F.col("grp.role").alias("ref"), *(F.col(x).alias("c_" + x) for x in P.COLUMNS))
    a = feats.filter("label.role = 'A'").withColumn("case", F.col("label.case"))
    return P.against(a.join(c, "case")).select("case", "ref", F.col("label.no").alias("no"), P.weighted().alias("sim"))


def analysed(cases: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The verdict on each case, and the similarities it rests on.

    Per case: mean and population deviation of the similarities to B; the same of the controls, their means averaged and their
    variances averaged; Wilcoxon's p of B's similarity less the mean of the controls' by segment; the largest permutation p over the
    controls; Cohen's d; how strongly that speaks for B. A case that can't be analysed has an error and nothing else.
    """
    checked = checkpoint(validated(cases, least))
    texts = checkpoint(used(cases).join(checked.filter("error is null").select("case", "lang"), "case"))
    parts = [segment_features(texts.filter(F.col("lang") == lang), lang) for lang in ("en", "zh")]
    sims = checkpoint(similarities(checkpoint(parts[0].unionByName(parts[1]))))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("no", "sim"))), lambda x: x["sim"])
    by = checkpoint(sims.groupBy("case", "ref").agg(F.avg("sim").alias("mean"), F.coalesce(F.stddev_pop("sim"), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n"), in_order.alias("sims")))
    b, c = by.filter("ref = 'B'"), by.filter("ref <> 'B'")
    both = c.join(b.select("case", F.col("sims").alias("own")), "case").withColumn("p", inference.permuted("own", "sims"))
    control = both.groupBy("case").agg(F.max("p").alias("p_permutation"), F.avg("mean").alias("mean_controls"), F.sqrt(F.avg(F.col("sd") * F.col("sd"))).alias("sd_controls"), F.sum("n").alias("n_controls"), F.max("mean").alias("top"))
    diff = sims.groupBy("case", "no").agg((F.max(F.when(F.col("ref") == "B", F.col("sim"))) - F.avg(F.when(F.col("ref") != "B", F.col("sim")))).alias("diff"))
    w = inference.wilcoxon(diff, by=("case",)).select("case", F.col("p").alias("p_wilcoxon"))
    d = cohens_d(F.col("mean"), F.col("mean_controls"), F.col("sd"), F.col("sd_controls"), F.col("n"), F.col("n_controls"))
    scored = b.join(control, "case").join(w, "case", "left").withColumn("p_wilcoxon", F.coalesce("p_wilcoxon", F.lit(1.0))).withColumn("cohens_d", d)
    one = scored.select("case", F.col("n").alias("n_segments"), F.col("mean").alias("mean_b"), F.col("sd").alias("sd_b"), "mean_controls", "sd_controls", "p_wilcoxon", "p_permutation", "cohens_d", P.verdict(F.col("mean") >= F.col("top"), F.col("p_wilcoxon"), F.col("cohens_d")).alias("verdict"))
    return checked.join(one, "case", "left"), sims


def summary(verdicts: DataFrame) -> DataFrame:
    """``(case, summary)``: a few lines on each case, or its error."""
    line = lambda name, a, b: F.concat(F.lit(f"A - {name}  similarity: "), F.format_string("%.4f ± %.4f", F.col(a), F.col(b)))
    number = lambda pattern, c: F.format_string(pattern, F.col(c))
    lines = F.concat_ws("\n", line("B", "mean_b", "sd_b"), line("controls", "mean_controls", "sd_controls"), number("Wilcoxon p = %.4f", "p_wilcoxon"), number("permutation p = %.4f", "p_permutation"), number("Cohen's d = %.3f", "cohens_d"), F.concat(F.lit("effect: "), effect_label("cohens_d")), F.concat(F.lit("verdict: "), "verdict"))
    return verdicts.select("case", F.when(F.col("error").isNull(), lines).otherwise(F.col("error")).alias("summary"))


#: What goes with every verdict.
CAUTION = "The analysis rests on text statistics alone and is no legal evidence. More text and better matched controls make it more reliable."


def as_cases(samples: DataFrame) -> DataFrame:
    """Cases from ``(grp, label, text)``: a group's longest sample in a language is questioned, its second is the known author's, the
    longest samples of the next three groups are controls. A group's samples are ranked, never joined."""
    t = samples.select("grp", "label", "text", T.language("text").alias("lang"), T.nonspace_length("text").alias("n")).filter("lang <> 'mixed'")
    rank = t.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "lang").orderBy(F.desc("n"), "label"))).filter("rank <= 2")
    name: Column = F.concat_ws("|", "grp", "lang")
    # one row for each group and language, whose texts are looked up after
    first = rank.filter("rank = 1")
    w = Window.partitionBy("lang").orderBy("grp")
    near = checkpoint(first.select("grp", "lang", *(F.lead("label", k).over(w).alias(f"C{k}") for k in (1, 2, 3))))
    controls = near.select(name.alias("case"), F.explode(F.map_from_arrays(F.array(*map(F.lit, ("C1", "C2", "C3"))), F.array("C1", "C2", "C3"))).alias("role", "label")).filter("label is not null")
    return rank.select(name.alias("case"), F.when(F.col("rank") == 1, "A").otherwise("B").alias("role"), "text").unionByName(controls.join(first.select("label", "text"), "label").select("case", "role", "text"))
