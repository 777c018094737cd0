"""Result files with fixed names, headers and formats, and the report of an experiment."""

from __future__ import annotations

import math
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.sources import sinks

# Headers of the result files.
HEADERS = {
    "nn_predictions": ["sample", "true_group", "nn_sample", "nn_group", "hit"],
    "signal_competition": ["work", "group_a", "group_b", "cross_translator_dist", "same_translator_dist", "winner"],
    "fingerprint_pairs": ["sample_a", "sample_b", "pair_type", "similarity"],
    "story_level_tests": ["scale", "n_stories", "mean_diff", "wilcoxon_w", "p_value", "rank_biserial_r"],
    "d_bootstrap_ci": ["scale", "n_stories", "n_iter", "d_observed", "ci_low", "ci_high"],
    "equal_chunk_robustness": ["scale", "n_stories", "kept_chunks", "wins_original", "wins_translator", "ties", "sign_test_p", "cohens_d"],
    "weight_sensitivity": ["variant", "scale", "within", "between", "d", "competition_wins", "knn_acc", "knn_baseline"],
    "same_story_exclusion_d": ["scale", "d_excl_same_story", "delta_within_excl", "delta_between_excl", "delta_ratio_excl"],
    "nn_structure_proportions": ["scale", "n_chunks", "nn_same_story_other_trans", "nn_same_story_any", "knn_acc"],
}
SIX, ONE = "%.6f", "%.1f"
FORMATS = {"wilcoxon_w": ONE} | {c: SIX for c in ("cross_translator_dist", "same_translator_dist", "similarity", "mean_diff", "p_value", "rank_biserial_r", "d_observed", "ci_low", "ci_high", "sign_test_p", "cohens_d", "within", "between", "d", "knn_acc", "knn_baseline", "d_excl_same_story", "delta_within_excl", "delta_between_excl", "delta_ratio_excl", "nn_same_story_other_trans", "nn_same_story_any")}


def nn_predictions(pred: DataFrame) -> DataFrame:
    return pred.select(F.col("label").alias("sample"), "true_group", F.col("nn_label").alias("nn_sample"), "nn_group", "hit").orderBy("sample")


def signal_competition(comp: DataFrame) -> DataFrame:
    return comp.select("work", F.col("g1").alias("group_a"), F.col("g2").alias("group_b"), F.col("cross").alias("cross_translator_dist"), F.col("same").alias("same_translator_dist"), "winner").orderBy("work", "group_a", "group_b")


def fingerprint_pairs(sims: DataFrame) -> DataFrame:
    kind = F.when(F.substring_index("la", "/", 1) == F.substring_index("lb", "/", 1), "same").otherwise("cross")
    return sims.select(F.col("la").alias("sample_a"), F.col("lb").alias("sample_b"), kind.alias("pair_type"), F.col("sim").alias("similarity")).orderBy("sample_a", "sample_b")


def weight_sensitivity(rows: DataFrame) -> DataFrame:
    return rows.select("variant", "scale", "within", "between", F.col("cohens_d").alias("d"), "competition_wins", F.col("knn_accuracy").alias("knn_acc"), "knn_baseline")


def write(name: str, rows: DataFrame, folder: str) -> str:
    """``folder/name.csv`` with its fixed header; a table that lacks a column of it is refused before anything is written."""
    header = HEADERS[name]
    missing = [c for c in header if c not in rows.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    path = os.path.join(folder, f"{name}.csv")
    sinks.table_csv(rows, path, header, {c: f for c, f in FORMATS.items() if c in header})
    return path


def write_checked(name: str, rows: DataFrame, folder: str, expected: DataFrame, key: str = "scale", tolerance: float = 5e-4) -> str:
    """The same, but nothing is written where a value differs from a reference value by more than ``tolerance``."""
    numbers = [c for c, t in expected.dtypes if c != key and t in ("double", "float", "int", "bigint")]
    e = expected.select(F.col(key).alias("_k"), *(F.col(c).alias("_" + c) for c in numbers))
    off = rows.join(e, rows[key] == e["_k"], "right").filter(" or ".join(f"`{c}` is null or abs(`{c}` - `_{c}`) > {tolerance}" for c in numbers)).select("_k").first()
    if off is not None:
        raise ValueError(f"{name}: {key} {off['_k']} differs from its reference values")
    return write(name, rows, folder)


def matrices(edges_of: dict[str, DataFrame], folder: str) -> list[str]:
    """``delta_matrix_{scale}.csv`` for every scale."""
    paths = [os.path.join(folder, f"delta_matrix_{scale}.csv") for scale in edges_of]
    for path, edges in zip(paths, edges_of.values()):
        sinks.matrix_csv(edges, path)
    return paths


def control_set(edges: DataFrame, predictions: DataFrame, competition: DataFrame, sims: DataFrame, folder: str) -> list[str]:
    """The four files of a run, below the folder of its scale."""
    sinks.matrix_csv(edges, path := os.path.join(folder, "delta_matrix.csv"))
    return [path, write("nn_predictions", nn_predictions(predictions), folder), write("signal_competition", signal_competition(competition), folder), write("fingerprint_pairs", fingerprint_pairs(sims), folder)]


# ---- names, cleaning, summaries --------------------------------------------------------------------------------------


def scale_label(size: Column | int) -> Column:
    """1500 words are "1.5k"."""
    k = (F.lit(size) if isinstance(size, int) else size) / 1000
    return F.concat(F.regexp_replace(F.regexp_replace(k.cast("decimal(20,6)").cast("string"), "0+$", ""), r"\.$", ""), F.lit("k"))


def language_name(lang: Column | str, shown: str = "en") -> Column:
    """The name of a language code; an unknown code is its own name."""
    c = F.col(lang) if isinstance(lang, str) else lang
    names = {"en": {"zh": "Chinese", "en": "English", "mixed": "Chinese and English"}, "zh": {"zh": "中文", "en": "英文", "mixed": "中英混合"}}[shown]
    out = c
    for code, name in names.items():
        out = F.when(c == code, name).otherwise(out)
    return out


def unmarked(text: Column | str) -> Column:
    """Without the hidden numbers of sentences, which stand between NUL characters."""
    return F.regexp_replace(text, "\x00\\[[0-9]+\\]\x00", "")


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def one_decimal(n: Column, d: Column) -> Column:
    """n / d to one decimal as a correctly rounded print of the double gives it: what decides a tie is on which side of it the double
    lies, and an exact tie goes to the even digit. In whole numbers, since formatting in the JVM rounds the shortest decimal instead."""
    d = F.greatest(d, F.lit(1)).cast("bigint")
    n = n.cast("bigint")
    b, rest = F.floor((10 * n - F.pmod(10 * n, d)) / d), F.pmod(10 * n, d)
    x = n / d
    k = (53 - F.floor(F.log2(F.when(x > 0, x).otherwise(1.0)))).cast("int")
    side = 20 * (x * F.pow(F.lit(2.0), k)).cast("bigint") - (2 * b + 1) * F.pow(F.lit(2.0), k).cast("bigint")
    up = F.when(2 * rest != d, 2 * rest > d).otherwise((side > 0) | (side == 0) & (b % 2 == 1))
    out = b + up.cast("bigint")
    return F.concat(F.floor(out / 10).cast("string"), F.lit("."), (out % 10).cast("string"))


def basic_summary(shown: str = "en") -> Column:
    mean = F.when(F.col("n_sentences") > 0, one_decimal(F.col("n_tokens"), F.col("n_sentences"))).otherwise("0")
    return _lines(F.concat(F.lit("language: "), language_name("lang", shown)), F.format_string("characters: %d (without blanks %d)", "n_chars", "n_chars_no_space"), F.format_string("tokens: %d", "n_tokens"), F.format_string("sentences: %d", "n_sentences"), F.concat(F.lit("tokens a sentence: "), mean))


def readability_summary(lang: str = "en") -> Column:
    if lang == "en":
        return _lines(F.format_string("Flesch ease: %.2f (%s)", "flesch_ease", "label"), F.format_string("Flesch-Kincaid grade: %.2f", "flesch_kincaid"), F.format_string("words a sentence: %.2f", "sentence_length"), F.format_string("syllables a word: %.2f", "syllables_per_word"))
    return _lines(F.format_string("characters a sentence: %.2f", "sentence_length"), F.format_string("characters a word: %.2f", "token_length"), F.format_string("richness: %.3f", "richness"), F.format_string("score: %.1f/100 (%s)", "score", "level"))


def alignment_summary() -> Column:
    return _lines(F.format_string("pairs: %d", F.size("pairs")), F.format_string("Chinese left over: %d", F.size("unmatched_zh")), F.format_string("English left over: %d", F.size("unmatched_en")))


# ---- layouts of single results ---------------------------------------------------------------------------------------


def layouts(kind: str, rows: DataFrame) -> DataFrame:
    """The table of a result as it is exported: basic, syntax, alignment, batch or kwic, with the columns of its layout."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if kind == "basic":
        return rows.select(F.explode("tokens").alias("t")).select(F.col("t.text").alias("token"), F.col("t.pos").alias("pos"), F.col("t.lemma").alias("lemma"), F.when(F.col("t.is_stop"), "yes").otherwise("no").alias("stop_word"))
    if kind == "syntax":
        return rows.select(F.explode("dependencies").alias("d")).select(*(F.col(f"d.{c}").alias(c) for c in ("text", "pos", "dep", "head_text", "head_pos")))
    if kind == "alignment":
        return rows.select(F.posexplode("pairs").alias("at", "p")).select((F.col("at") + 1).alias("no"), F.col("p.zh").alias("zh"), F.col("p.en").alias("en"))
    if kind == "batch":
        ok = F.col("status") == "ok"
        put = lambda c: F.when(ok, none(c)).otherwise("")
        return rows.select("filename", F.when(ok, F.col("lang")).otherwise("ERROR").alias("lang"), *(put(c).alias(c) for c in ("char_count", "word_count", "sentence_count", "unique_words")), F.when(ok, none("top_words")).otherwise(none("error")).alias("top_words"))
    if kind == "kwic":
        return rows.select("left", "keyword", "right", "position")
    raise ValueError(f"unknown layout {kind}")


def export_result(kind: str, rows: DataFrame, path: str, summary: str = "") -> None:
    """One result as txt, csv, json or docx by the ending of ``path``; a text file opens with the summary."""
    ending = Path(path).suffix.lower().lstrip(".")
    shaped = rows if kind in ("readability", "fingerprint") else layouts(kind, rows)
    if ending == "txt":
        if kind == "kwic":
            body = [r["line"] for r in _kwic_lines(shaped).toLocalIterator()]
            lines = [f"{len(body)} hits", "", *body] if body else ["no hits"]
        elif kind == "alignment":
            lines = [x for r in shaped.toLocalIterator() for x in (f"[{r['no']}] {r['zh']}", f"    {r['en']}", "")]
        else:
            lines = ["\t".join("" if x is None else str(x) for x in r) for r in shaped.toLocalIterator()]
        sinks._write(path, "\n".join([*([summary, ""] if summary else []), *lines]))
    else:
        sinks.export(shaped, path, ending)


def _kwic_lines(rows: DataFrame) -> DataFrame:
    width = rows.agg(F.coalesce(F.max(F.length("left")), F.lit(0)).alias("width"))
    return rows.crossJoin(F.broadcast(width)).select(F.concat(F.repeat(F.lit(" "), F.col("width") - F.length("left")), "left", F.lit("  ["), "keyword", F.lit("]  "), "right").alias("line"))


# ---- report ----------------------------------------------------------------------------------------------------------

#: A ratio of the mean Delta across groups to that within that is no higher is a warning.
LEAST_RATIO = 1.1

_WORDS = {
    "en": {
        "no_signal": "Pairs of one group are no more alike ({same_mean:.4f}) than pairs of two groups ({cross_mean:.4f}): nothing speaks for a signal of the groups.",
        "significant": "Pairs of one group are significantly more alike than pairs of two (Wilcoxon p={p_wilcoxon:.4f}, permutation p={p_perm:.4f}, d={d:.3f}, {effect} effect): the groups can be told apart.",
        "not_significant": "Pairs of one group are more alike ({same_mean:.4f}) than pairs of two ({cross_mean:.4f}), but not significantly (Wilcoxon p={p_wilcoxon:.4f}, permutation p={p_perm:.4f}, d={d:.3f}).",
        "warning": "> Check: the ratio of Delta across groups to that within is {ratio}, not above 1.1. Delta doesn't separate the groups; chunks may be too short or texts too much alike, so this is no proof that the groups don't differ.",
        "nn_above": "The nearest neighbour is of the same group for {accuracy:.1%}, above the largest group's share of {baseline:.1%}.",
        "nn_below": "The nearest neighbour is of the same group for {accuracy:.1%}, not above the largest group's share of {baseline:.1%}.",
        "no_pairs": "No work is in two groups; the signals weren't compared.",
        "sign_significant": "Sign test significant (p={sign_p:.4f}): the signal of the {leader} is stronger ({wins_original} to {wins_translator}).",
        "sign_not": "Sign test not significant (p={sign_p:.4f}): {wins_original} wins of the original, {wins_translator} of the group.",
        "original": "original",
        "translator": "group",
        "heading": "Conclusion",
    },
    "zh": {
        "no_signal": "同组样本对的相似度（{same_mean:.4f}）不高于异组样本对（{cross_mean:.4f}），没有组别信号的证据。",
        "significant": "同组样本对显著比异组更相似（Wilcoxon p={p_wilcoxon:.4f}，置换 p={p_perm:.4f}，d={d:.3f}，{effect}），各组可以区分。",
        "not_significant": "同组样本对（{same_mean:.4f}）比异组（{cross_mean:.4f}）更相似，但不显著（Wilcoxon p={p_wilcoxon:.4f}，置换 p={p_perm:.4f}，d={d:.3f}）。",
        "warning": "> 注意：异组与同组 Delta 之比为 {ratio}，不超过 1.1，Delta 未能区分各组；切片可能太短或文本太相近，不能据此断定各组没有差别。",
        "nn_above": "最近邻同组的比例为 {accuracy:.1%}，高于最大组所占的 {baseline:.1%}。",
        "nn_below": "最近邻同组的比例为 {accuracy:.1%}，不高于最大组所占的 {baseline:.1%}。",
        "no_pairs": "没有两组共有的作品，未作信号比较。",
        "sign_significant": "符号检验显著（p={sign_p:.4f}）：{leader}的信号更强（{wins_original} 比 {wins_translator}）。",
        "sign_not": "符号检验不显著（p={sign_p:.4f}）：原文胜 {wins_original} 次，组别胜 {wins_translator} 次。",
        "original": "原文",
        "translator": "组别",
        "heading": "结论",
    },
}


def significant(p_wilcoxon: float, p_perm: float, same: float, cross: float) -> bool:
    """Both tests must pass and the difference must point the right way."""
    return max(p_wilcoxon, p_perm) < 0.05 and same > cross


def conclusions(stats: dict, lang: str = "en") -> dict[str, str]:
    """The sentences of a report by its numbers: ``main``, ``nn``, ``signals``, and ``warning``, which may be empty."""
    w = _WORDS["zh" if lang == "zh" else "en"]
    s = dict(stats)
    same, cross = s["same_mean"], s["cross_mean"]
    s["effect"] = next(name for name, least in (("large", 0.8), ("medium", 0.5), ("small", 0.2), ("negligible", 0.0)) if abs(s["d"]) >= least)
    main = "no_signal" if same <= cross else "significant" if significant(s["p_wilcoxon"], s["p_perm"], same, cross) else "not_significant"
    ratio = s["delta_across"] / s["delta_within"] if s["delta_within"] > 0 else math.inf
    sound = math.isfinite(ratio) and ratio > LEAST_RATIO
    s["ratio"] = f"{ratio:.2f}" if math.isfinite(ratio) else "inf"
    s["leader"] = w["original" if s["wins_original"] >= s["wins_translator"] else "translator"]
    signals = "no_pairs" if s["wins_original"] + s["wins_translator"] == 0 else "sign_significant" if s["sign_p"] < 0.05 else "sign_not"
    return {"main": w[main].format(**s), "nn": w["nn_above" if s["accuracy"] > s["baseline"] else "nn_below"].format(**s), "signals": w[signals].format(**s), "warning": "" if sound else w["warning"].format(**s)}


def report(stats: dict, groups: dict[str, int], orphans: list[str], lang: str = "en") -> str:
    """A report in Markdown; the numbers and tables are the same in both languages, the conclusions follow from the numbers."""
    c = conclusions(stats, lang)
    s = stats
    ratio = s["delta_across"] / s["delta_within"] if s["delta_within"] > 0 else math.inf
    shown = ", ".join(f"`{x}`" for x in orphans[:20]) + (" ..." if len(orphans) > 20 else "")
    lines = [
        "# Experiment", "", "## Samples", "",
        f"- Groups: {len(groups)} (" + ", ".join(f"`{g}`: {n}" for g, n in groups.items()) + ")",
        f"- Samples: {sum(groups.values())}", "",
        "## Delta", "", "| | within | across |", "| --- | --- | --- |", f"| mean | {s['delta_within']:.4f} | {s['delta_across']:.4f} |", "",
        f"- Ratio: {ratio:.2f}" if math.isfinite(ratio) else "- Ratio: inf", *(["", c["warning"]] if c["warning"] else []), "",
        "## Nearest neighbours", "", f"- Accuracy: {s['accuracy']:.4f}; largest group: {s['baseline']:.4f}", "", c["nn"], "",
        "## Competing signals", "", f"- Works in one group only: {len(orphans)}" + (f" - {shown}" if orphans else ""), f"- Wins: {s['wins_original']} original, {s['wins_translator']} group; sign test p = {s['sign_p']:.4f}", "", c["signals"], "",
        "## Fingerprints", "", "| | same group | two groups |", "| --- | --- | --- |", f"| mean | {s['same_mean']:.4f} | {s['cross_mean']:.4f} |", "",
        f"- Wilcoxon p = {s['p_wilcoxon']:.4f}; permutation p = {s['p_perm']:.4f}; d = {s['d']:.3f}", "",
        f"## {_WORDS['zh' if lang == 'zh' else 'en']['heading']}", "", c["main"], "",
    ]
    return "\n".join(lines)


def sensitivity_section(summary: list[dict], scheme: str = "all") -> str:
    """What is appended to a report on the weight variants: the range of each measure for each scale, and whether the findings hold."""
    n = max((r["variants"] for r in summary), default=0)
    stable = bool(summary) and min(r["min_cohens_d"] for r in summary) > 0 and min(r["min_competition_wins"] for r in summary) > max(r["competition_pairs"] for r in summary) / 2
    rows = [f"| {r['scale']} | {r['variants']} | {r['min_cohens_d']:.3f} | {r['max_cohens_d']:.3f} | {r['min_competition_wins']}-{r['max_competition_wins']}/{r['competition_pairs']} | {r['min_knn_accuracy']:.4f} | {r['max_knn_accuracy']:.4f} | {r['knn_baseline']:.4f} |" for r in summary]
    end = "Both findings hold under every variant." if stable else "The findings don't hold under every variant."
    return "\n".join(["", "## Weight sensitivity", "", f"- Scheme `{scheme}`: {n} variants, {len(summary)} scales", "", "| scale | variants | d least | d most | wins of the original | accuracy least | accuracy most | largest group |", "| --- | --- | --- | --- | --- | --- | --- | --- |", *rows, "", end, ""])


def append(path: str, section: str) -> None:
    """Add to the end of a report; what is there stays as it is."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(section)


# ---- figures ---------------------------------------------------------------------------------------------------------


def figure_data(kind: str, rows: DataFrame, k: int | None = None) -> DataFrame:
    """What a figure shows, as a table: ``word_cloud`` (120 terms), ``top_terms`` (20), ``kinds`` (8 kinds of token with their share),
    ``moods`` (score and colour of each sentence), ``similarities`` (mean and deviation for each author)."""
    if kind in ("word_cloud", "top_terms"):
        n = k or (120 if kind == "word_cloud" else 20)
        first = ["first"] if "first" in rows.columns else []
        return rows.groupBy("term").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in first)).orderBy(F.desc("n"), *first, "term").limit(n).select("term", "n")
    if kind == "kinds":
        top = rows.groupBy("pos").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pos").limit(k or 8)
        total = top.agg(F.sum("n").alias("total"))
        return top.crossJoin(F.broadcast(total)).select("pos", "n", (F.col("n") / F.col("total")).alias("share"))
    if kind == "moods":
        return rows.select("key", "no", "score", F.when(F.col("score") > 0.15, "green").when(F.col("score") < -0.15, "red").otherwise("grey").alias("colour"))
    if kind == "similarities":
        return rows.groupBy("case", "ref").agg(F.avg("sim").alias("mean"), F.coalesce(F.stddev_pop("sim"), F.lit(0.0)).alias("sd"))
    raise ValueError(f"unknown figure {kind}")


def bar_figure(rows: DataFrame, path: str, name: str, value: str, title: str = "") -> None:
    """A bar chart as PNG, where a plotting library is installed; the table must be as small as a figure."""
    try:
        from matplotlib.figure import Figure
    except ImportError as e:
        raise ValueError("writing PNG needs matplotlib") from e
    data = rows.select(name, value).toPandas()
    fig = Figure(figsize=(8, 4.5))
    ax = fig.subplots()
    ax.bar(range(len(data)), data[value])
    ax.set_xticks(range(len(data)), [str(x) for x in data[name]], rotation=45, ha="right")
    ax.set_title(title)
    fig.tight_layout()
    fig.savefig(path, dpi=300)

