"""Rank tests, permutation and bootstrap."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from quillmark.functions import text as T
from quillmark.operators.metrics import cohens_d
from quillmark.operators.pairs import fold_blocks, groups, works
from quillmark.session import checkpoint


def signed_ranks(diffs: DataFrame, value: str = "diff", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean ranks of the absolute non-zero differences. The differences are one per work or label, few enough to sort."""
    nz = diffs.filter(F.col(value) != 0).select(*by, F.col(value).alias("d"), F.round(F.abs(value), 12).alias("a"))
    w = Window.partitionBy(*by).orderBy("a")
    return nz.select(*by, "d", (F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, "a")) - 1) / 2).alias("rank"))


@F.udf(DoubleType())
def p_two_sided(z: float | None) -> float | None:
    """p of a z value; a single number for each test, so a plain function is enough."""
    return None if z is None else min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def wilcoxon(diffs: DataFrame, value: str = "diff", by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each ``by``: W+ and W-, z by normal approximation without corrections, two-sided p (1 below three differences), r."""
    r = signed_ranks(diffs, value, by)
    plus, minus = F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("rank"))), F.lit(0.0))
    one = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), plus.alias("w_plus"), minus.alias("w_minus"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    z = F.when(n >= 3, (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.when(n >= 3, sd).otherwise(1.0)).otherwise(0.0)
    total = F.col("w_plus") + F.col("w_minus")
    p = F.when(n < 3, 1.0).otherwise(p_two_sided("z"))
    return one.withColumn("z", z).withColumn("p", p).withColumn("r", F.when(total > 0, (F.col("w_plus") - F.col("w_minus")) / F.when(total > 0, total).otherwise(1.0)).otherwise(0.0))


def permutation(own: list[float], others: list[float], n: int = 10_000, seed: int = 42) -> float:
    """One-sided permutation p of the difference of means, with a generator of its own; 1 if a side is empty."""
    if not own or not others:
        return 1.0
    rng, pool, k = random.Random(seed), [*own, *others], len(own)
    seen = sum(own) / k - sum(others) / len(others)
    hits = 0
    for _ in range(n):
        rng.shuffle(pool)
        hits += sum(pool[:k]) / k - sum(pool[k:]) / len(others) >= seen
    return (hits + 1) / (n + 1)


@F.pandas_udf(DoubleType())
def permuted(own: pd.Series, other: pd.Series) -> pd.Series:
    """p of :func:`permutation` for two lists of values."""
    return pd.Series([permutation(list(a), list(b)) for a, b in zip(own, other)])


def _unit(seed: int, *parts: Column) -> Column:
    """A reproducible number in [0, 2^32) from md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


#: Steps of md5: how far each turns, what it adds, which word it reads; the state that it starts with.
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_READ = [*range(16), *((5 * i + 1) % 16 for i in range(16, 32)), *((3 * i + 5) % 16 for i in range(32, 48)), *(7 * i % 16 for i in range(48, 64))]
_STATE = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _heads(words: np.ndarray) -> np.ndarray:
    """The first eight hex digits of md5 as a number, for each column of a block of 16 words."""
    a, b, c, d = (np.full(words.shape[1], x) for x in _STATE)
    for i in range(64):
        f = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
        f += a
        f += words[_READ[i]]
        f += _ADDED[i]
        turned = f << np.uint32(_TURNS[i])
        turned |= f >> np.uint32(32 - _TURNS[i])
        turned += b
        a, b, c, d = d, turned, b, c
    return (a + _STATE[0]).byteswap()


def md5_heads(prefixes: list[bytes], ends: list[bytes], step: int = 8_192) -> Iterator[np.ndarray]:
    """For each prefix the first eight hex digits of md5 of prefix and end, as numbers, for all ends. What fits a block of md5 is
    computed for many ends at once."""
    blocks: dict[int, tuple[np.ndarray, list[int]]] = {}
    for prefix in prefixes:
        k = len(prefix)
        if k not in blocks:
            rows = np.zeros((len(ends), 64), np.uint8)
            long = []
            for i, e in enumerate(ends):
                if k + len(e) > 55:
                    long.append(i)
                    continue
                rows[i, k : k + len(e)] = np.frombuffer(e, np.uint8)
                rows[i, k + len(e)] = 0x80
                rows[i, 56:58] = divmod(8 * (k + len(e)), 256)[::-1]
            blocks[k] = np.ascontiguousarray(rows.view("<u4").T), long
        words, long = blocks[k]
        head = np.frombuffer(prefix.ljust(-(-k // 4) * 4, b"\0"), "<u4") if k <= 55 else np.zeros(0, np.uint32)
        out = np.empty(len(ends), np.uint32)
        for lo in range(0, len(ends), step):
            w = words[:, lo : lo + step].copy()
            w[: len(head)] |= head[:, None]
            out[lo : lo + step] = _heads(w)
        for i in long:
            out[i] = int(hashlib.md5(prefix + ends[i]).hexdigest()[:8], 16)
        yield out


def permutation_md5(values: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``values(id, own, x)``: the test with draws ordered by md5, all draws in parallel. One row.

    Every task holds the values, one for each work or label, and makes whole draws; no row is written for a value in a draw.
    """
    t = values.select("id", "own", "x").toArrow().to_pydict()
    order = sorted(range(len(t["id"])), key=lambda i: str(t["id"][i]))
    spark = values.sparkSession
    x, own = np.array([t["x"][i] for i in order], float), np.array([t["own"][i] for i in order], bool)
    sent = spark.sparkContext.broadcast(([str(t["id"][i]).encode() for i in order], x, own))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x, own = sent.value
        k, rank = int(own.sum()), np.arange(len(ids), dtype=np.uint64)
        seen = round(float(x[own].mean() - x[~own].mean()), 12) if 0 < k < len(ids) else None
        total = x.sum()
        for b in batches:
            hits = 0
            if seen is not None:
                for heads in md5_heads([f"{seed}|{i}|".encode() for i in b["id"]], ids):
                    first = x[np.argpartition((heads.astype(np.uint64) << np.uint64(32)) | rank, k - 1)[:k]].sum()
                    hits += round(float(first / k - (total - first) / (len(ids) - k)), 12) >= seen
            yield pd.DataFrame({"hits": [hits], "draws": [len(b)]})

    each = spark.range(0, n if order else 0, 1, max(1, spark.sparkContext.defaultParallelism)).mapInPandas(draw, "hits bigint, draws bigint")
    return each.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("draws"), F.lit(0)).alias("draws")).select("hits", "draws", ((F.col("hits") + 1) / (F.col("draws") + 1)).alias("p_value"))


def pair_sums(edges: DataFrame, value: str) -> DataFrame:
    """Counts, sums and sums of squares by two works and whether the groups are the same: all that resampling works needs."""
    x = F.col(value)
    return edges.groupBy(F.least("wa", "wb").alias("s1"), F.greatest("wa", "wb").alias("s2"), (F.col("ga") == F.col("gb")).alias("same")).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))


#: Works whose sums by pair are held in each task as a matrix: six of WORKS squared numbers, 200 MB at most.
WORKS = 2_000


def bootstrap(edges: DataFrame, value: str, n: int = 10_000, seed: int = 20260818, exact: bool = False) -> DataFrame:
    """``(draw, d)``: Cohen's d of ``n`` resamples of the works, for each draw where it is defined.

    A work drawn c times counts c times in each of its pairs. Draws come from md5, so that any engine can repeat them, or with
    ``exact`` from one seeded generator, one after the other. Up to ``WORKS`` works the sums by pair of works are a matrix in each task;
    beyond that they are joined with the draws.
    """
    sums = checkpoint(pair_sums(edges, value))
    names = sums.select(F.explode(F.array("s1", "s2")).alias("w")).distinct()
    if names.count() > WORKS:
        if exact:
            raise ValueError(f"more than {WORKS} works have no exact draws")
        return bootstrap_joined(sums, n, seed)
    works = sorted((r["w"] for r in names.collect()), key=lambda x: x.encode())
    at = {w: i for i, w in enumerate(works)}
    t = sums.toArrow().to_pydict()
    m = np.zeros((6, len(works), len(works)))
    for a, b, same, *x in zip(t["s1"], t["s2"], t["same"], t["n"], t["s"], t["q"]):
        for k in range(3):
            m[3 * (not same) + k, at[a], at[b]] += x[k]
    spark = edges.sparkSession
    sent = spark.sparkContext.broadcast(m)

    def one(ids: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        n1, s1, q1, n0, s0, q0 = (((counts @ x) * counts).sum(1) for x in sent.value)
        with np.errstate(invalid="ignore", divide="ignore"):
            v1, v0 = (np.maximum(0.0, (q - s * s / k) / (k - 1)) for k, s, q in ((n1, s1, q1), (n0, s0, q0)))
            pooled = np.sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2))
            d = np.where(pooled < 1e-12, 0.0, (s1 / n1 - s0 / n0) / pooled)
        keep = (n1 >= 2) & (n0 >= 2)
        return pd.DataFrame({"draw": ids[keep], "d": d[keep]})

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, k = random.Random(seed), len(works)
        for b in batches:
            ids = b["id"].to_numpy()
            for lo in range(0, len(ids), 500):
                part = ids[lo : lo + 500]
                counts = np.zeros((len(part), k))
                for row, i in enumerate(part):
                    picks = rng.choices(range(k), k=k) if exact else [int(hashlib.md5(f"{seed}|{i}|{slot}".encode()).hexdigest()[:8], 16) % k for slot in range(1, k + 1)]
                    np.add.at(counts[row], picks, 1.0)
                yield one(part, counts)

    ids = spark.range(0, n, 1, 1 if exact else max(1, spark.sparkContext.defaultParallelism))
    return ids.mapInPandas(draw, "draw bigint, d double")


def work_counts(spark: SparkSession, k: int, n: int, seed: int, exact: bool) -> list[bytes]:
    """For each of k works how often every draw has it, as compressed 16-bit numbers: on average a number takes a quarter of a byte."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, slots = random.Random(seed), [str(slot).encode() for slot in range(1, k + 1)]
        for b in batches:
            ids = b["id"].tolist()
            for lo in range(0, len(ids), 100):
                part = ids[lo : lo + 100]
                picks = (np.array(rng.choices(range(k), k=k)) for _ in part) if exact else (x % np.uint32(k) for x in md5_heads([f"{seed}|{i}|".encode() for i in part], slots))
                counts = np.stack([np.bincount(x, minlength=k) for x in picks]).astype("<u2")
                yield pd.DataFrame({"lo": [part[0]], "n": [len(part)], "counts": [zlib.compress(counts.tobytes(), 1)]})

    ids = spark.range(0, n, 1, 1 if exact else max(1, spark.sparkContext.defaultParallelism))
    t = ids.mapInPandas(draw, "lo bigint, n bigint, counts binary").toArrow().to_pydict()
    every = np.empty((n, k), "<u2")
    for lo, m, c in zip(t["lo"], t["n"], t["counts"]):
        every[lo : lo + m] = np.frombuffer(zlib.decompress(c), "<u2").reshape(m, k)
    return [zlib.compress(np.ascontiguousarray(every[:, w]).tobytes(), 1) for w in range(k)]


#: Rows in a block of the bootstrap; draws that are weighed at a time.
ROWS, DRAWN = 1_024, 500


def bootstrap_in_blocks(rows: DataFrame, columns: list[str], compare: Callable[[dict, dict], np.ndarray], n: int = 10_000, seed: int = 20260818, exact: bool = False, block: int = ROWS) -> DataFrame:
    """:func:`bootstrap` of ``rows(label, *columns)`` without edges, for any number of works, exact draws too.

    The task that has a block of pairs sums it by works and weighs the sums by all draws, so it sends six numbers for each draw. What
    every task holds is how often each draw has each work.
    """
    rows = checkpoint(rows.select("label", *columns))
    spark = rows.sparkSession
    names = sorted(r["w"] for r in rows.select(T.work_of("label").alias("w")).distinct().collect()) if rows.count() > 1 else []
    sent = spark.sparkContext.broadcast((np.array(names, object), work_counts(spark, len(names), n, seed, exact) if names else []))

    def fold(ka: np.ndarray, kb: np.ndarray, a: dict, b: dict, one: bool) -> pd.DataFrame:
        names, counts = sent.value

        def by_work(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            code = np.searchsorted(names, works(keys))
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
            return order, first, np.stack([np.frombuffer(zlib.decompress(counts[w]), "<u2") for w in code[order][first]], 1)

        v = compare(a, b)[..., 0]
        pair = np.triu(np.ones(v.shape, bool), 1) if one else np.ones(v.shape, bool)
        same = groups(ka)[:, None] == groups(kb)[None, :]
        (oa, fa, ca), (ob, fb, cb) = by_work(ka), by_work(kb)
        out = {"draw": np.arange(n)}
        for flag in (1, 0):
            keep = pair & (same == bool(flag))
            for name, x in (("n", keep.astype(float)), ("s", v * keep), ("q", v * v * keep)):
                m = np.add.reduceat(np.add.reduceat(x[np.ix_(oa, ob)], fa, axis=0), fb, axis=1)
                out[f"{name}_{flag}"] = np.concatenate([((ca[lo : lo + DRAWN].astype(float) @ m) * cb[lo : lo + DRAWN]).sum(1) for lo in range(0, n, DRAWN)])
        return pd.DataFrame(out)

    names_of = [f"{c}_{k}" for k in (1, 0) for c in "nsq"]
    parts = fold_blocks(rows, "label", columns, fold, "draw bigint, " + ", ".join(f"{c} double" for c in names_of), block, T.work_of("label"))
    return effects_of_draws(parts.groupBy("draw").agg(*(F.sum(c).alias(c) for c in names_of)))


def effects_of_draws(t: DataFrame) -> DataFrame:
    """``(draw, d)``: Cohen's d of each draw's numbers, sums and sums of squares within (1) and across (0) groups, where it is defined."""
    t = t.filter("n_1 >= 2 and n_0 >= 2")
    var = lambda k: F.greatest(F.lit(0.0), (F.col(f"q_{k}") - F.col(f"s_{k}") * F.col(f"s_{k}") / F.col(f"n_{k}")) / (F.col(f"n_{k}") - 1))
    d = cohens_d(F.col("s_1") / F.col("n_1"), F.col("s_0") / F.col("n_0"), F.sqrt(var(1)), F.sqrt(var(0)), F.col("n_1"), F.col("n_0"))
    return t.select("draw", d.alias("d"))


def bootstrap_joined(sums: DataFrame, n: int, seed: int) -> DataFrame:
    """The draws by md5 as joins, for any number of works."""
    works = sums.select(F.explode(F.array("s1", "s2")).alias("w")).distinct()
    listed = works.agg(F.array_sort(F.collect_set("w")).alias("all"))
    draws = listed.crossJoin(sums.sparkSession.range(n).withColumnRenamed("id", "draw")).select("draw", "all", F.explode(F.sequence(F.lit(1), F.size("all"))).alias("slot"))
    picked = draws.select("draw", F.element_at("all", (_unit(seed, F.col("draw"), F.col("slot")) % F.size("all")).cast("int") + 1).alias("w")).groupBy("draw", "w").agg(F.count(F.lit(1)).alias("c"))
    a, b = (picked.select("draw", F.col("w").alias(s), F.col("c").alias(c)) for s, c in (("s1", "c1"), ("s2", "c2")))
    weight = F.col("c1") * F.col("c2")
    joined = sums.join(a, "s1").join(b, ["draw", "s2"])
    put = lambda c, same: F.sum(F.when(F.col("same") == same, weight * F.col(c)).otherwise(0))
    return effects_of_draws(joined.groupBy("draw").agg(*(put(c, same).alias(f"{c}_{int(same)}") for c in "nsq" for same in (True, False))))
