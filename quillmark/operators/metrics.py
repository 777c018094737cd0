"""Measures on edge tables ``(la, lb, d)``: neighbours, groups, competing signals, effect sizes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import text as T
from quillmark.operators.pairs import fold_cells, groups, symmetric, works
from quillmark.session import checkpoint


def with_groups(edges: DataFrame) -> DataFrame:
    """Add group and work of both ends, from labels ``group/work``."""
    group = lambda c: F.substring_index(c, "/", 1)
    return edges.select("*", group("la").alias("ga"), group("lb").alias("gb"), T.work_of("la").alias("wa"), T.work_of("lb").alias("wb"))


def within_across(edges: DataFrame, value: str = "d") -> DataFrame:
    """Mean, sample deviation and count of pairs within and across groups."""
    g = with_groups(edges)
    return g.groupBy((F.col("ga") == F.col("gb")).alias("same_group")).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n"))


def cohens_d(m1: Column, m2: Column, s1: Column, s2: Column, n1: Column, n2: Column) -> Column:
    """Difference of means over the pooled deviation; 0 where that vanishes."""
    both = (n1 > 1) & (n2 > 1)
    pooled = F.sqrt(F.when(both, ((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / F.greatest(n1 + n2 - 2, F.lit(1))).otherwise((s1 * s1 + s2 * s2) / 2))
    return F.when(pooled < 1e-12, 0.0).otherwise((m1 - m2) / F.when(pooled < 1e-12, 1.0).otherwise(pooled))


def group_effect(edges: DataFrame, value: str) -> DataFrame:
    """One row: means within and across groups and Cohen's d of within against across."""
    g = with_groups(edges).withColumn("same", F.col("ga") == F.col("gb"))
    s, c = F.when(F.col("same"), F.col(value)), F.when(~F.col("same"), F.col(value))
    one = g.agg(F.avg(s).alias("mean_same"), F.avg(c).alias("mean_cross"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("sd_same"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sd_cross"), F.count(s).alias("n_same"), F.count(c).alias("n_cross"))
    d = cohens_d(*(F.col(x) for x in ("mean_same", "mean_cross", "sd_same", "sd_cross", "n_same", "n_cross")))
    return one.select("mean_same", "mean_cross", "n_same", "n_cross", d.alias("cohens_d"))


def effect_of_moments(moments: DataFrame) -> DataFrame:
    """The same from ``(same, n, s, q)``, as blocks of pairs send them."""
    put = lambda c, flag: F.coalesce(F.sum(F.when(F.col("same") == flag, F.col(c))), F.lit(0))
    one = moments.agg(*(put(c, flag).alias(f"{c}{int(flag)}") for c in "nsq" for flag in (True, False)))
    mean = lambda k: F.when(F.col(f"n{k}") > 0, F.col(f"s{k}") / F.greatest(F.col(f"n{k}"), F.lit(1)))
    sd = lambda k: F.when(F.col(f"n{k}") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col(f"n{k}")) / F.greatest(F.col(f"n{k}") - 1, F.lit(1))))).otherwise(0.0)
    m = one.select(mean(1).alias("mean_same"), mean(0).alias("mean_cross"), sd(1).alias("sd_same"), sd(0).alias("sd_cross"), F.col("n1").alias("n_same"), F.col("n0").alias("n_cross"))
    d = cohens_d(*(F.col(x) for x in ("mean_same", "mean_cross", "sd_same", "sd_cross", "n_same", "n_cross")))
    return m.select("mean_same", "mean_cross", "sd_same", "sd_cross", "n_same", "n_cross", d.alias("cohens_d"))


def within_across_of_moments(moments: DataFrame) -> DataFrame:
    n, s, q = (F.col(c) for c in "nsq")
    sd = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / F.greatest(n - 1, F.lit(1))))).otherwise(0.0)
    return moments.filter("n > 0").select(F.col("same").alias("same_group"), (s / n).alias("mean"), sd.alias("sd"), "n")


def effect_label(d: Column | str) -> Column:
    size = F.abs(d)
    return F.when(size >= 0.8, "large").when(size >= 0.5, "medium").when(size >= 0.2, "small").otherwise("negligible")


def nearest(edges: DataFrame, value: str = "d") -> DataFrame:
    """Each label's nearest other label; ties, to 12 decimals, go to the label that comes first."""
    both = symmetric(edges, value)
    return both.groupBy("label").agg(F.min(F.struct(F.round(value, 12).alias("d"), "other")).alias("m")).select("label", F.col("m.other").alias("nn_label"), F.col("m.d").alias("d"))


def predictions(near: DataFrame) -> DataFrame:
    """Groups of each label and of its nearest, from :func:`nearest` or its counterpart in blocks."""
    group = lambda c: F.substring_index(c, "/", 1)
    return near.select("label", group("label").alias("true_group"), "nn_label", group("nn_label").alias("nn_group"), (group("label") == group("nn_label")).alias("hit"), "d")


def accuracy(pred: DataFrame) -> DataFrame:
    """One row for each group: hits and size, with the overall accuracy and the share of the largest group."""
    by = pred.groupBy("true_group").agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy()  # as many rows as there are groups
    return by.select("true_group", "hits", "total", (F.sum("hits").over(w) / F.sum("total").over(w)).alias("accuracy"), (F.max("total").over(w) / F.sum("total").over(w)).alias("baseline"))


def structure(pred: DataFrame) -> DataFrame:
    same = T.work_of("label") == T.work_of("nn_label")
    return pred.agg(F.count(F.lit(1)).alias("n"), F.avg((same & ~F.col("hit")).cast("double")).alias("same_work_other_group"), F.avg(same.cast("double")).alias("same_work"), F.avg(F.col("hit").cast("double")).alias("same_group"))


def orphans(labels: DataFrame) -> DataFrame:
    """Works that only one group has."""
    g, w = F.substring_index("label", "/", 1).alias("grp"), T.work_of("label").alias("work")
    return labels.select(g, w).distinct().groupBy("work").agg(F.count(F.lit(1)).alias("groups")).filter("groups < 2").select("work")


def competition(edges: DataFrame, value: str = "d") -> DataFrame:
    """For each work and two groups that both have it: do the two versions lie closer than other works of the same group?"""
    g = with_groups(edges)
    same_work = g.filter("wa = wb and ga <> gb").select("wa", F.least("ga", "gb").alias("g1"), F.greatest("ga", "gb").alias("g2"), F.col(value).alias("x"))
    cross = same_work.groupBy(F.col("wa").alias("work"), "g1", "g2").agg(F.avg("x").alias("cross"))
    within = g.filter("ga = gb and wa <> wb").select("ga", F.explode(F.array("wa", "wb")).alias("w"), F.col(value).alias("x")).groupBy(F.col("ga").alias("g"), F.col("w").alias("work")).agg(F.avg("x").alias("within"))
    return decided(cross, within).select("work", "g1", "g2", "cross", "within_1", "within_2", "same", "winner")


def competing_sums(rows: DataFrame, columns: list[str], compare: Callable[[dict, dict], np.ndarray], names: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(g, work, n, *names)`` of pairs with other works of a group, ``(work, g1, g2, n, *names)`` of pairs of one work in two groups:
    numbers of pairs and sums of what is compared, in parts. Only rows of one group and rows of one work meet."""

    def inside(ka: np.ndarray, kb: np.ndarray, a: dict, b: dict, one: bool) -> dict[str, np.ndarray]:
        wa, wb = works(ka), works(kb)
        other = wa[:, None] != wb[None, :]
        v = np.where(other[..., None], compare(a, b), 0.0)
        w, n, s = (wa, other.sum(1), v.sum(1)) if one else (np.r_[wa, wb], np.r_[other.sum(1), other.sum(0)], np.concatenate([v.sum(1), v.sum(0)]))
        return {"g": np.full(len(w), groups(ka[:1])[0], object), "work": w, "n": n} | {c: s[:, k] for k, c in enumerate(names)}

    def between(ka: np.ndarray, kb: np.ndarray, a: dict, b: dict, one: bool) -> dict[str, np.ndarray]:
        held, code = np.unique(np.r_[groups(ka), groups(kb)].astype(str), return_inverse=True)
        ga, gb = code[: len(ka)], code[len(ka) :]
        i, j = np.nonzero((ga[:, None] != gb[None, :]) & (np.triu(np.ones((len(ka), len(kb)), bool), 1) if one else True))
        pair, at = np.unique(np.minimum(ga[i], gb[j]) * len(held) + np.maximum(ga[i], gb[j]), return_inverse=True)
        v = compare(a, b)[i, j]
        out = {"work": np.full(len(pair), works(ka[:1])[0], object), "g1": held[pair // len(held)].astype(object), "g2": held[pair % len(held)].astype(object), "n": np.bincount(at, minlength=len(pair))}
        return out | {c: np.bincount(at, v[:, k], len(pair)) for k, c in enumerate(names)}

    rows = checkpoint(rows.select("label", *columns))
    sums = ", ".join(f"{c} double" for c in names)
    within = fold_cells(rows, "label", columns, F.substring_index("label", "/", 1), inside, f"g string, work string, n bigint, {sums}").filter("n > 0")
    return within, fold_cells(rows, "label", columns, T.work_of("label"), between, f"work string, g1 string, g2 string, n bigint, {sums}")


def competition_in_cells(rows: DataFrame, columns: list[str], compare: Callable[[dict, dict], np.ndarray]) -> DataFrame:
    """:func:`competition` of ``rows(label, *columns)`` without edges."""
    within, cross = competing_sums(rows, columns, compare, ["s"])
    mean = (F.sum("s") / F.sum("n")).alias
    return decided(cross.groupBy("work", "g1", "g2").agg(mean("cross")), within.groupBy("g", "work").agg(mean("within"))).select("work", "g1", "g2", "cross", "within_1", "within_2", "same", "winner")


def decided(cross: DataFrame, within: DataFrame, *by: str) -> DataFrame:
    """Whether the distance across (work, g1, g2) or the mean of those within (g, work) is smaller, for each ``by``."""
    a = within.select(*by, F.col("g").alias("g1"), "work", F.col("within").alias("within_1"))
    b = within.select(*by, F.col("g").alias("g2"), "work", F.col("within").alias("within_2"))
    both = cross.join(a, [*by, "g1", "work"], "left").join(b, [*by, "g2", "work"], "left").filter("within_1 is not null or within_2 is not null")
    mean = F.when(F.col("within_1").isNull(), F.col("within_2")).when(F.col("within_2").isNull(), F.col("within_1")).otherwise((F.col("within_1") + F.col("within_2")) / 2)
    c, s = F.round("cross", 12), F.round("same", 12)
    return both.withColumn("same", mean).withColumn("winner", F.when(c < s, "original").when(c > s, "translator").otherwise("tie"))


def sign_test(k: Column, n: Column) -> Column:
    """Two-sided sign test of the smaller number of wins k among n, exact; 1 for no comparison."""
    term = F.aggregate(F.sequence(F.lit(0), F.greatest(k, F.lit(0))), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")), lambda acc, i: F.struct((acc["t"] * (n - i) / (i + 1)).alias("t"), (acc["s"] + acc["t"]).alias("s")), lambda acc: acc["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * term / F.pow(F.lit(2.0), n)))


def wins(comp: DataFrame) -> DataFrame:
    one = comp.agg(*(F.count(F.when(F.col("winner") == w, 1)).alias(f"wins_{w}") for w in ("original", "translator", "tie")))
    k, n = F.least("wins_original", "wins_translator"), F.col("wins_original") + F.col("wins_translator")
    return one.withColumn("p_value", sign_test(k, n))


def story_differences(edges: DataFrame, value: str) -> DataFrame:
    """For each work with pairs within and across groups: mean similarity within minus across."""
    g = with_groups(edges).filter("wa = wb")
    same = F.col("ga") == F.col("gb")
    return g.groupBy(F.col("wa").alias("work")).agg(F.avg(F.when(same, F.col(value))).alias("same"), F.avg(F.when(~same, F.col(value))).alias("cross")).filter("same is not null and cross is not null").withColumn("diff", F.col("same") - F.col("cross"))


def story_differences_in_cells(rows: DataFrame, columns: list[str], compare: Callable[[dict, dict], np.ndarray]) -> DataFrame:
    """:func:`story_differences` of ``rows(label, *columns)`` without edges: only rows of one work are compared."""

    def fold(ka: np.ndarray, kb: np.ndarray, a: dict, b: dict, one: bool) -> dict[str, np.ndarray]:
        v = compare(a, b)[..., 0]
        pair = np.triu(np.ones(v.shape, bool), 1) if one else np.ones(v.shape, bool)
        same = groups(ka)[:, None] == groups(kb)[None, :]
        cells = [v[pair & same], v[pair & ~same]]
        return {"work": works(ka[:1]), "n1": np.array([len(cells[0])]), "s1": np.array([cells[0].sum()]), "n0": np.array([len(cells[1])]), "s0": np.array([cells[1].sum()])}

    t = fold_cells(rows, "label", columns, T.work_of("label"), fold, "work string, n1 bigint, s1 double, n0 bigint, s0 double").groupBy("work").agg(*(F.sum(c).alias(c) for c in ("n1", "s1", "n0", "s0")))
    return t.filter("n1 > 0 and n0 > 0").select("work", (F.col("s1") / F.col("n1")).alias("same"), (F.col("s0") / F.col("n0")).alias("cross")).withColumn("diff", F.col("same") - F.col("cross"))


def sample_differences(edges: DataFrame, value: str) -> DataFrame:
    """For each label: mean similarity to its own group minus that to the others."""
    both = symmetric(edges, value)
    same = F.substring_index("label", "/", 1) == F.substring_index("other", "/", 1)
    return both.groupBy("label").agg((F.avg(F.when(same, F.col(value))) - F.avg(F.when(~same, F.col(value)))).alias("diff")).filter("diff is not null")


def equal_chunks(labels: DataFrame) -> DataFrame:
    """Of works in at least two groups the first k chunks of each group, k being the fewest that a group has."""
    g = labels.select("label", F.substring_index("label", "/", 1).alias("grp"), T.work_of("label").alias("work"), T.chunk_number("label").alias("no"))
    cells = g.groupBy("work", "grp").agg(F.count(F.lit(1)).alias("n")).groupBy("work").agg(F.min("n").alias("k"), F.count(F.lit(1)).alias("groups")).filter("groups >= 2")
    rank = F.row_number().over(Window.partitionBy("work", "grp").orderBy("no", "label"))
    return g.withColumn("rank", rank).join(cells, "work").filter("rank <= k").select("label", "grp", "work", "k")


def restricted(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges between kept labels."""
    a, b = kept.select(F.col("label").alias("la")), kept.select(F.col("label").alias("lb"))
    return edges.join(a, "la", "left_semi").join(b, "lb", "left_semi")
