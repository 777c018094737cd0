"""Eight-dimension fingerprints: vocabularies, features, similarities, centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions import words as W
from quillmark.operators import frequencies as Q
from quillmark.operators.pairs import block_pairs, differences, moments_in_blocks, sums_by_row, totals_by_value
from quillmark.session import checkpoint, free_shuffles

DIMENSIONS = tuple(W.WEIGHTS)
SIZES = {"function_words": 50, "char_ngrams": 100, "word_bigrams": 50, "punctuation": 20}


def function_words(lang: str = "en") -> list[str]:
    return W.EN_FUNCTION if lang == "en" else W.ZH_FUNCTION


def marks(lang: str) -> list[str]:
    """Marks that count for a language; an unknown language has those of zh."""
    return sorted(set(W.EN_MARKS if lang == "en" else W.ZH_MARKS))


def _held(corpus: DataFrame, lang: str) -> DataFrame:
    """Per label what is costly to find again: words in one string, sentence lengths."""
    tok = T.tokens_en if lang == "en" else T.tokens_zh
    lengths = F.filter(F.transform(T.sentences("text"), lambda s: F.size(T.word_list(tok(s), lang))), lambda n: n > 0)
    return corpus.select("label", "text", T.word_list(tok("text"), lang).alias("words")).select("label", "text", F.size("words").alias("n"), F.array_join("words", "\n").alias("joined"), lengths.alias("lengths"))


def _lists_of(held: DataFrame, lang: str, func: list[str] | None = None) -> DataFrame:
    """The lists from :func:`_held`."""
    func = func or function_words(lang)
    w = F.col("words")
    return (
        # no word has a line end
        held.select("label", "text", "lengths", F.when(F.col("n") > 0, F.split("joined", "\n")).otherwise(F.array().cast("array<string>")).alias("words"))
        .select(
            "label",
            "words",
            F.filter(w, lambda x: F.array_contains(F.array(*map(F.lit, func)), x)).alias("function_words"),
            T.ngrams("text", 4, lang).alias("char_ngrams"),
            T.bigrams(w).alias("word_bigrams"),
            F.regexp_extract_all("text", F.lit("[" + "".join("\\" + m for m in marks(lang)) + "]"), F.lit(0)).alias("punctuation"),
            "lengths",
        )
    )


def _lists(corpus: DataFrame, lang: str, func: list[str] | None = None) -> DataFrame:
    """Per label the lists that all features count: words, function words, n-grams, bigrams, marks, sentence lengths."""
    return _lists_of(_held(corpus, lang), lang, func)


def kept_lists(corpus: DataFrame, lang: str, func: list[str] | None = None) -> DataFrame:
    """:func:`_lists` from texts and words that are written once; the lists themselves, many times as large, are made where they are counted."""
    held = checkpoint(_held(corpus, lang))
    free_shuffles(held.sparkSession)
    return _lists_of(held, lang, func)


def occurrences(lists: DataFrame, kind: str) -> DataFrame:
    return lists.select("label", F.posexplode(kind).alias("pos", "term"))


def vocabulary(lists: DataFrame, kind: str, n: int | None = None) -> DataFrame:
    """The most frequent terms of a kind, ties by first occurrence: ``(idx, term, n)``."""
    return Q.ranked_first_seen(occurrences(lists, kind), n or SIZES[kind])


def shares(lists: DataFrame, kind: str, vocab: DataFrame) -> DataFrame:
    """``(label, idx, term, f)``: share of each vocabulary term among all terms of the kind; 0 without any."""
    counts = occurrences(lists, kind).join(F.broadcast(vocab.select("term")), "term").groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("held"))
    every = vocab.agg(F.array_sort(F.collect_list(F.struct("idx", "term"))).alias("terms"))
    grid = lists.select("label", F.size(kind).alias("total")).join(held, "label", "left").crossJoin(F.broadcast(every)).select("label", "total", "held", F.explode("terms").alias("t"))
    f = F.coalesce(F.try_element_at("held", F.col("t.term")), F.lit(0)) / F.greatest("total", F.lit(1))
    return grid.select("label", F.col("t.idx").alias("idx"), F.col("t.term").alias("term"), f.alias("f"))


def word_lengths(lang: str = "en") -> Column:
    """Shares of word lengths: ten classes for English, four for Chinese; empty without words."""
    bins = 10 if lang == "en" else 4
    n = F.size("words")
    share = lambda k: F.size(F.filter("words", lambda w: F.least(F.length(w), F.lit(bins)) == k)) / F.greatest(n, F.lit(1))
    return F.when(n > 0, F.array(*[share(k) for k in range(1, bins + 1)])).otherwise(F.array().cast("array<double>"))


def _mean(xs: str) -> Column:
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(xs), F.lit(1))).otherwise(0.0)


def _deviation(xs: str) -> Column:
    m = _mean(xs)
    return F.when(F.size(xs) > 1, F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.greatest(F.size(xs) - 1, F.lit(1)))).otherwise(0.0)


def richness(lists: DataFrame) -> DataFrame:
    """``(label, ttr, hapax)``: distinct words and words that occur once, as shares of all words."""
    per = lists.select("label", F.explode("words").alias("w")).groupBy("label", "w").agg(F.count(F.lit(1)).alias("n"))
    r = per.groupBy("label").agg((F.count(F.lit(1)) / F.sum("n")).alias("ttr"), (F.count(F.when(F.col("n") == 1, 1)) / F.sum("n")).alias("hapax"))
    return lists.select("label").join(r, "label", "left").select("label", F.coalesce("ttr", F.lit(0.0)).alias("ttr"), F.coalesce("hapax", F.lit(0.0)).alias("hapax"))


def sentence_stats(lists: DataFrame) -> DataFrame:
    return lists.select("label", _mean("lengths").alias("sent_mean"), _deviation("lengths").alias("sent_sd"))


def features(lists: DataFrame, lang: str = "en", vocabularies: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row for each label with all eight dimensions; each feature is computed once, not once per pair."""
    out = lists.select("label", word_lengths(lang).alias("word_length")).join(sentence_stats(lists), "label").join(richness(lists), "label")
    for kind in SIZES:
        vocab = (vocabularies or {}).get(kind)
        vocab = checkpoint(vocabulary(lists, kind)) if vocab is None else vocab
        packed = shares(lists, kind, vocab).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "f"))), lambda x: x["f"]).alias(kind))
        out = out.join(packed, "label", "left").withColumn(kind, F.coalesce(kind, F.array().cast("array<double>")))
    free_shuffles(lists.sparkSession)  # those of the vocabularies
    return out


COLUMNS = ["word_length", "function_words", "char_ngrams", "word_bigrams", "punctuation", "sent_mean", "sent_sd", "ttr", "hapax"]


def scalar_likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    top = np.maximum(np.abs(x)[:, None], np.abs(y)[None, :])
    return np.where(top < 1e-12, 1.0, np.maximum(0.0, 1 - np.abs(x[:, None] - y[None, :]) / np.where(top < 1e-12, 1.0, top)))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """0 for a vector of zeros, 0.5 where a side has no entries at all."""
    if x.shape[1] == 0 or y.shape[1] == 0:
        return np.full((len(x), len(y)), 0.5)
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    both = nx[:, None] * ny[None, :]
    return np.where(both > 0, x @ y.T / np.where(both > 0, both, 1.0), 0.0)


def dimension_scores(a: dict, b: dict) -> np.ndarray:
    parts = {k: cosine(a[k], b[k]) for k in ("word_length", *SIZES)}
    parts["sentence_stats"] = (scalar_likeness(a["sent_mean"], b["sent_mean"]) + scalar_likeness(a["sent_sd"], b["sent_sd"])) / 2
    parts["ttr"], parts["hapax"] = scalar_likeness(a["ttr"], b["ttr"]), scalar_likeness(a["hapax"], b["hapax"])
    return np.stack([parts[k] for k in DIMENSIONS], -1)


def pair_scores(feats: DataFrame) -> DataFrame:
    """``(la, lb, eight scores)`` for all pairs; weights come after, so that variants share the scores."""
    return block_pairs(feats, "label", COLUMNS, dimension_scores, list(DIMENSIONS))


def weighted(weights: dict[str, float] | None = None) -> Column:
    """The weighted sum in the fixed order of the dimensions; a missing weight is 0."""
    weights = W.WEIGHTS if weights is None else weights
    total = F.lit(0.0)
    for d in DIMENSIONS:
        total = total + F.col(d) * float(weights.get(d, 0.0))
    return total


def similarities(feats: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    return pair_scores(feats).select("la", "lb", weighted(weights).alias("sim"))


def likeness(weights: dict[str, float] | None = None) -> Callable[[dict, dict], np.ndarray]:
    """The weighted sum of the scores of rows a and b, in the fixed order of the dimensions."""
    w = W.WEIGHTS if weights is None else weights

    def total(a: dict, b: dict) -> np.ndarray:
        scores, out = dimension_scores(a, b), 0.0
        for k, d in enumerate(DIMENSIONS):
            out = out + scores[..., k] * float(w.get(d, 0.0))
        return out[..., None]

    return total


def moments(feats: DataFrame, weights: dict[str, float] | None = None, other_work: bool = False) -> DataFrame:
    """``(same, n, s, q)`` of the similarities of all pairs, folded in blocks."""
    return moments_in_blocks(feats, "label", COLUMNS, likeness(weights), other_work)


def likeness_totals(x: np.ndarray) -> np.ndarray:
    """For each value the sum of its likeness to all other values, none of which is negative: the smaller over the larger."""
    order = np.argsort(x, kind="stable")
    v = x[order]
    zeros = int((v < 1e-12).sum())
    inverse = np.zeros(len(v))
    inverse[zeros:] = 1 / v[zeros:]
    before, after = np.r_[0.0, np.cumsum(v)[:-1]], np.r_[np.cumsum(inverse[::-1])[::-1][1:], 0.0]
    got = before * inverse + v * after
    got[:zeros] += zeros - 1
    out = np.empty(len(v))
    out[order] = got
    return out


def similarity_differences(feats: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``(label, diff)`` as :func:`quillmark.operators.metrics.sample_differences` gives for all pairs, without the pairs.

    The cosines of a row with all others sum to its product with the sum of all unit vectors; likenesses follow from sorted values. Only
    pairs within a group are compared.
    """
    w = W.WEIGHTS if weights is None else weights
    kinds = ["word_length", *SIZES]
    scalars = [("sent_mean", w.get("sentence_stats", 0.0) / 2), ("sent_sd", w.get("sentence_stats", 0.0) / 2), ("ttr", w.get("ttr", 0.0)), ("hapax", w.get("hapax", 0.0))]
    rows = checkpoint(feats.select(F.monotonically_increasing_id().alias("id"), "label", *COLUMNS))
    n = rows.count()

    def units(b: pd.DataFrame, kind: str) -> np.ndarray:
        x = np.stack([np.asarray(v, float) for v in b[kind]])
        size = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"kind": kinds, "v": [units(b, k).sum(0) for k in kinds]})

    parts = rows.select(*kinds).mapInPandas(summed, "kind string, v array<double>").select("kind", F.posexplode("v").alias("pos", "x")).groupBy("kind", "pos").agg(F.sum("x").alias("x"))
    sums: dict[str, list[float]] = {k: [] for k in kinds}
    for r in parts.orderBy("kind", "pos").collect():  # as many numbers as a row has
        sums[r["kind"]].append(r["x"])

    def cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                total = np.zeros(len(b))
                for k in kinds:
                    u = units(b, k)
                    total += float(w.get(k, 0.0)) * (u @ np.array(sums[k]) - (u * u).sum(1) if u.shape[1] else np.full(len(b), 0.5 * (n - 1)))
                yield pd.DataFrame({"id": b["id"], "s": total})

    values = rows.select("id", F.posexplode(F.array(*(F.col(c) for c, _ in scalars))).alias("pos", "x"))
    shares = [x for _, x in scalars]
    alike = totals_by_value(values, lambda pos, x: likeness_totals(x) * float(shares[pos]))
    every = rows.select("id", *kinds).mapInPandas(cosines, "id bigint, s double").unionByName(alike).groupBy("id").agg(F.sum("s").alias("s"))
    own = sums_by_row(rows, "label", COLUMNS, likeness(w), F.substring_index("label", "/", 1))
    return differences(rows.select("id", "label"), every, own)


def centroids(feats: DataFrame, group: Column) -> DataFrame:
    """Element-wise means by group."""
    g = feats.withColumn("grp", group)
    out = g.groupBy("grp").agg(*(F.avg(c).alias(c) for c in ("sent_mean", "sent_sd", "ttr", "hapax")), F.count(F.lit(1)).alias("members"))
    for kind in ("word_length", *SIZES):
        each = g.select("grp", F.posexplode(kind).alias("i", "x")).groupBy("grp", "i").agg(F.avg("x").alias("x"))
        out = out.join(each.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(kind)), "grp", "left").withColumn(kind, F.coalesce(kind, F.array().cast("array<double>")))
    return out


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def cosine_column(a: Column, b: Column) -> Column:
    na, nb = _norm(a), _norm(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    ok = (na > 0) & (nb > 0)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.5).when(~ok, 0.0).otherwise(dot / F.when(ok, na * nb).otherwise(1.0))


def likeness_column(a: Column, b: Column) -> Column:
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top < 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.when(top < 1e-12, 1.0).otherwise(top)))


def against(joined: DataFrame) -> DataFrame:
    """Add the eight scores of each row's features against those of a centroid in columns ``c_...``."""
    score = {k: cosine_column(F.col(k), F.col("c_" + k)) for k in ("word_length", *SIZES)}
    like = lambda x: likeness_column(F.col(x), F.col("c_" + x))
    score |= {"sentence_stats": (like("sent_mean") + like("sent_sd")) / 2, "ttr": like("ttr"), "hapax": like("hapax")}
    keep = [c for c in joined.columns if c not in COLUMNS and not c.startswith("c_")]
    return joined.select(*keep, *(score[d].alias(d) for d in DIMENSIONS))


def to_centroid(feats: DataFrame, centres: DataFrame, group: Column) -> DataFrame:
    """Eight scores and the weighted total of each label against the centroid of its own group."""
    c = centres.select("grp", *(F.col(x).alias("c_" + x) for x in COLUMNS))
    return against(feats.withColumn("grp", group).join(c, "grp")).select("label", "grp", *DIMENSIONS).withColumn("total", weighted())


def verdict(highest: Column, p: Column, d: Column) -> Column:
    """How strongly the tests support the same author."""
    return F.when(highest & (p < 0.01) & (d > 0.8), "strong").when(highest & (p < 0.10) & (d > 0.3), "support").when(highest & (p < 0.10) & (d > 0.2), "weak").otherwise("uncertain")
