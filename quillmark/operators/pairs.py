"""All unordered pairs of labelled vectors, in blocks: as edges, or folded where a task has its block."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.session import checkpoint

#: Rows in a block; rows that a task of :func:`fold_blocks` holds of each side.
BLOCK, HELD = 512, 4_096
#: Decimals to which values count as equal.
TIES = 12


def fold_blocks(rows: DataFrame, key: str, columns: list[str], fold: Callable[[np.ndarray, np.ndarray, dict, dict, bool], pd.DataFrame], schema: str, block: int = BLOCK, by: Column | None = None) -> DataFrame:
    """What ``fold(keys a, keys b, columns a, columns b, whether b is a)`` gives for every two blocks of rows.

    The work is quadratic, but it runs in tasks of bounded size. Rows are shuffled and written once, packed by block; a task reads two
    parts of the blocks and compares those of one with those of the other, so nothing that is sent grows with the square. Keys are
    sorted by code points within a block. Rows of one ``by`` are in one block.
    """
    rows = checkpoint(rows.select(key, *columns))
    n = rows.count()
    blocks = max(1, -(-n // block))
    own = F.pmod(F.xxhash64(F.col(key) if by is None else by), F.lit(blocks)).cast("int")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.drop_duplicates(key)
        d = d.iloc[np.argsort(d[key].map(lambda x: x.encode()).to_numpy(), kind="stable")]
        held = {c: np.stack([np.asarray(x, float) for x in d[c]]) if isinstance(d[c].iloc[0], (list, np.ndarray)) else d[c].to_numpy(float) for c in columns}
        return pd.DataFrame({"own": [int(pdf["own"].iloc[0])], "data": [pickle.dumps((d[key].to_numpy(object), held), 5)]})

    # a task holds at most HELD rows of each part, or one block; where there are few blocks, parts are smaller so that all cores have some
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = min(blocks, max(-(-blocks // max(1, HELD // block)), math.ceil(2 * math.sqrt(cores))))
    packed = rows.withColumn("own", own).groupBy("own").applyInPandas(pack, "own int, data binary")
    packed = checkpoint(packed.repartitionById(parts, F.pmod("own", F.lit(parts))))
    a, b = (packed.select(F.col("own").alias(f"own_{x}"), F.col("data").alias(x)) for x in "ab")
    # every two blocks once, and as many for each two parts in one order as in the other
    i, j = F.col("own_a"), F.col("own_b")
    met = a.join(b.hint("shuffle_replicate_nl"), (i == j) | ((i < j) == (F.pmod(i + j, F.lit(2)) == 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for bi, bj, one, two in zip(pdf["own_a"], pdf["own_b"], pdf["a"], pdf["b"]):
                (ka, a), (kb, b) = (pickle.loads(x) for x in ((one, two) if bi <= bj else (two, one)))
                yield fold(ka, kb, a, b, bi == bj)

    return met.select("own_a", "own_b", "a", "b").mapInPandas(run, schema)


def fold_cells(rows: DataFrame, key: str, columns: list[str], cell: Column, fold: Callable[[np.ndarray, np.ndarray, dict, dict, bool], dict[str, np.ndarray]], schema: str, block: int = BLOCK) -> DataFrame:
    """What ``fold(keys a, keys b, columns a, columns b, whether b is a)`` gives for pairs of rows of one cell: other pairs never meet.

    The work is quadratic in a cell only. Many small cells are one task; a cell of more than ``block`` rows is compared by blocks.
    """
    rows = checkpoint(rows.select(key, *columns).withColumn("cell", cell))
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    large = checkpoint(sizes.filter(F.col("n") > block).select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    buckets = max(1, -(-rows.count() // (4 * block)))
    # at most as many large cells as there are blocks
    placed = rows.join(F.broadcast(large), "cell", "left").withColumn("own", F.pmod(F.xxhash64(key), F.coalesce("blocks", F.lit(1))).cast("int"))
    small = F.col("blocks").isNull()
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")).select(F.when(small, F.pmod(F.xxhash64("cell"), F.lit(buckets))).alias("bucket"), F.when(~small, F.col("cell")).alias("one"), F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "cell", key, *columns)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        pdf = pdf.drop_duplicates(["cell", "own", key]).sort_values(["cell", "own", key], kind="stable")
        keys, cells, own = (pdf[c].to_numpy() for c in (key, "cell", "own"))
        held = {c: np.stack([np.asarray(x, float) for x in pdf[c]]) if isinstance(pdf[c].iloc[0], (list, np.ndarray)) else pdf[c].to_numpy(float) for c in columns}
        part = lambda at: (keys[at], {c: x[at] for c, x in held.items()})
        out = []
        if bi != bj:
            (ka, a), (kb, b) = part(own == bi), part(own == bj)
            if len(ka) and len(kb):
                out.append(fold(ka, kb, a, b, False))
        else:
            ends = np.flatnonzero(np.r_[cells[1:] != cells[:-1], True]) + 1
            for lo, hi in zip(np.r_[0, ends[:-1]], ends):
                k, a = part(slice(lo, hi))
                out.append(fold(k, k, a, a, True))
        out = [o for o in out if len(o[names[0]])]
        return pd.DataFrame({x: np.concatenate([o[x] for o in out]) for x in names}) if out else pd.DataFrame(columns=names)

    return met.groupBy("bucket", "one", "bi", "bj").applyInPandas(run, schema)


def sums_by_row(rows: DataFrame, key: str, columns: list[str], compare: Callable[[dict, dict], np.ndarray], cell: Column, block: int = BLOCK) -> DataFrame:
    """``(key, n, s)``: number and sum of each row's values with the other rows of its cell; rows without others have n = 0."""

    def fold(ka: np.ndarray, kb: np.ndarray, a: dict, b: dict, one: bool) -> dict[str, np.ndarray]:
        v = compare(a, b)[..., 0]
        if one:
            v = v.copy()
            np.fill_diagonal(v, 0.0)
            return {key: ka, "n": np.full(len(ka), len(ka) - 1), "s": v.sum(1)}
        return {key: np.r_[ka, kb], "n": np.r_[np.full(len(ka), len(kb)), np.full(len(kb), len(ka))], "s": np.r_[v.sum(1), v.sum(0)]}

    return fold_cells(rows, key, columns, cell, fold, f"{key} string, n bigint, s double", block).groupBy(key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def absolute_totals(x: np.ndarray) -> np.ndarray:
    """For each value the sum of its absolute differences from all values."""
    order = np.argsort(x, kind="stable")
    v = x[order]
    before, k = np.r_[0.0, np.cumsum(v)[:-1]], np.arange(len(v))
    out = np.empty(len(v))
    out[order] = k * v - before + (v.sum() - before - v) - (len(v) - 1 - k) * v
    return out


def totals_by_value(values: DataFrame, totals: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """``(id, s)`` from ``(id, pos, x)``: what ``totals(pos, values of that pos)`` gives each row, summed over pos. A task holds the numbers of one pos."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": pdf["id"], "s": totals(int(pdf["pos"].iloc[0]), pdf["x"].to_numpy(float))})

    return values.groupBy("pos").applyInPandas(run, "id bigint, s double").groupBy("id").agg(F.sum("s").alias("s"))


def differences(rows: DataFrame, every: DataFrame, own: DataFrame) -> DataFrame:
    """``(label, diff)``: mean value with the own group less that with all others, from ``rows(id, label)``, sums over all other rows
    ``every(id, s)`` and over the own group ``own(label, n, s)``; only where there are both."""
    others = F.lit(rows.count() - 1) - F.col("n")
    t = rows.join(every.withColumnRenamed("s", "total"), "id").join(own, "label").filter((F.col("n") > 0) & (others > 0))
    return t.select("label", (F.col("s") / F.col("n") - (F.col("total") - F.col("s")) / others).alias("diff"))


def delta_differences(vectors: DataFrame) -> DataFrame:
    """``(label, diff)`` as :func:`quillmark.operators.metrics.sample_differences` gives for all pairs, without the pairs: the sum of a value's
    distances from all others follows from sorted values, so only pairs within a group are compared."""
    rows = checkpoint(vectors.select(F.monotonically_increasing_id().alias("id"), "label", "v"))
    width = F.size("v")
    every = totals_by_value(rows.select("id", F.posexplode("v").alias("pos", "x")), lambda pos, x: absolute_totals(x))
    every = rows.select("id", width.alias("w")).join(every, "id", "left").select("id", F.coalesce(F.col("s") / F.greatest("w", F.lit(1)), F.lit(0.0)).alias("s"))
    own = sums_by_row(rows, "label", ["v"], mean_absolute, F.substring_index("label", "/", 1))
    return differences(rows.select("id", "label"), every, own)


def _later(ka: np.ndarray, kb: np.ndarray) -> np.ndarray:
    return np.array([x.encode() > y.encode() for x, y in zip(ka, kb)], bool)


def block_pairs(rows: DataFrame, key: str, columns: list[str], compare: Callable[[dict, dict], np.ndarray], names: list[str], block: int = BLOCK) -> DataFrame:
    """``(la, lb, *names)`` with la < lb for all pairs of keys. ``compare`` returns values by rows a and b."""
    schema = "la string, lb string, " + ", ".join(f"{x} double" for x in names)

    def edges(keys_a: np.ndarray, keys_b: np.ndarray, a: dict, b: dict, same: bool) -> pd.DataFrame:
        values = compare(a, b)
        i, j = np.meshgrid(np.arange(len(keys_a)), np.arange(len(keys_b)), indexing="ij")
        keep = (i < j) if same else np.ones_like(i, bool)
        ka, kb = keys_a[i[keep]], keys_b[j[keep]]
        swap = _later(ka, kb)
        out = {"la": np.where(swap, kb, ka), "lb": np.where(swap, ka, kb)}
        return pd.DataFrame(out | {name: values[..., k][keep] for k, name in enumerate(names)})

    return fold_blocks(rows, key, columns, edges, schema, block)


def least_of(values: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nearest b of each a, its value, nearest a of each b, its value) of one block; ties go to the first. A row isn't its own neighbour."""
    v = np.round(values, TIES)
    if same:
        v = v.copy()
        np.fill_diagonal(v, np.inf)
    at, ta = v.argmin(1), v.argmin(0)
    return at, v[np.arange(len(v)), at], ta, v[ta, np.arange(v.shape[1])]


def nearest_in_blocks(rows: DataFrame, key: str, columns: list[str], compare: Callable[[dict, dict], np.ndarray], block: int = BLOCK) -> DataFrame:
    """``(label, nn_label, d)``: each row's nearest other row. A block sends one candidate for each of its rows, no edges."""

    def fold(ka: np.ndarray, kb: np.ndarray, a: dict, b: dict, same: bool) -> pd.DataFrame:
        at, va, ta, vb = least_of(compare(a, b)[..., 0], same)
        out = [pd.DataFrame({"label": ka, "other": kb[at], "d": va})]
        if not same:
            out.append(pd.DataFrame({"label": kb, "other": ka[ta], "d": vb}))
        got = pd.concat(out)
        return got[np.isfinite(got["d"])]

    near = fold_blocks(rows, key, columns, fold, "label string, other string, d double", block)
    return near.groupBy("label").agg(F.min(F.struct("d", "other")).alias("m")).select("label", F.col("m.other").alias("nn_label"), F.col("m.d").alias("d"))


def moments_in_blocks(rows: DataFrame, key: str, columns: list[str], compare: Callable[[dict, dict], np.ndarray], other_work: bool = False, block: int = BLOCK) -> DataFrame:
    """``(same, n, s, q)``: number, sum and sum of squares of all pairs within and across groups, from labels ``group/work``.

    With ``other_work`` only pairs of different works count. A block sends two rows.
    """

    def fold(ka: np.ndarray, kb: np.ndarray, a: dict, b: dict, one: bool) -> pd.DataFrame:
        v = compare(a, b)[..., 0]
        keep = np.triu(np.ones_like(v, bool), 1) if one else np.ones_like(v, bool)
        if other_work:
            keep &= works(ka)[:, None] != works(kb)[None, :]
        same = groups(ka)[:, None] == groups(kb)[None, :]
        cells = [(flag, v[keep & (same == flag)]) for flag in (True, False)]
        return pd.DataFrame([(flag, len(x), float(x.sum()), float((x * x).sum())) for flag, x in cells], columns=["same", "n", "s", "q"])

    parts = fold_blocks(rows, key, columns, fold, "same boolean, n bigint, s double, q double", block)
    return parts.groupBy("same").agg(*(F.sum(c).alias(c) for c in "nsq"))


def groups(labels: np.ndarray) -> np.ndarray:
    return np.array([x.split("/", 1)[0] for x in labels], object)


def works(labels: np.ndarray) -> np.ndarray:
    """The work in ``group/work__chunk001``, as :func:`quillmark.functions.text.work_of` has it."""
    import re

    return np.array([re.sub(r"__chunk[0-9]+$", "", re.sub("^[^/]*/", "", x)) for x in labels], object)


def mean_absolute(a: dict, b: dict) -> np.ndarray:
    x, y = a["v"], b["v"]
    if x.shape[1] == 0:
        return np.zeros((len(x), len(y), 1))
    return np.stack([np.abs(row - y).mean(1) for row in x])[..., None]


def delta(vectors: DataFrame, key: str = "label") -> DataFrame:
    """``(la, lb, d)``: Burrows' Delta, the mean absolute difference of z-scores."""
    return block_pairs(vectors, key, ["v"], mean_absolute, ["d"])


def delta_nearest(vectors: DataFrame, key: str = "label") -> DataFrame:
    return nearest_in_blocks(vectors, key, ["v"], mean_absolute)


def delta_moments(vectors: DataFrame, key: str = "label", other_work: bool = False) -> DataFrame:
    return moments_in_blocks(vectors, key, ["v"], mean_absolute, other_work)


def symmetric(edges: DataFrame, *values: str) -> DataFrame:
    """Both orientations, each pair once: ``(label, other, ...)``."""
    there = edges.select(F.col("la").alias("label"), F.col("lb").alias("other"), *values)
    back = edges.select(F.col("lb").alias("label"), F.col("la").alias("other"), *values)
    return there.unionByName(back)
