"""Problem 6: train, validation and test splits that keep related records together.

Method: components by parallel hooking and shortcutting over a parent table, all as joins; then bitsets of the reachable
split totals over the sizes of the components and their multiplicities, exchanges and, where those may not be the closest, a search over
the totals of all smaller splits choose which components make up each split.

Cases: a null or blank group name is taken from ``sample`` before ``/``; a row with neither group nor work is a component of its
own; rows sent again count once; an empty table gives an empty result. Names are the same apart from letter case, full- or
half-width form, blanks, hyphens and underscores.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillmark.session import checkpoint, once_per_key

#: The first filling is exact up to so many rows; beyond that it counts sizes in units of total / RESOLUTION rows.
RESOLUTION = 1 << 24


def widths() -> tuple[str, str]:
    """Full- and half-width characters and what they stand for, by rule from the Unicode decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in (*range(0xFF01, 0xFFEF), 0x3000) if unicodedata.decomposition(chr(c)).startswith(("<wide>", "<narrow>"))]
    pairs = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def same_name(col: Column | str) -> Column:
    """A form that is equal for names that count as the same; null where nothing is left."""
    plain = F.lower(F.translate(col, *widths()))
    return F.nullif(F.regexp_replace(plain, r"[\s\p{Z}\x85\-­‐‑﹣_]+", ""), F.lit(""))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for each node of an edge table; a component's name is its smallest node.

    Each round hooks every root on its smallest neighbour, shortcuts the parent table by joining it with itself until it
    is flat, and contracts the edges; the number of roots in a component at least halves, so rounds grow with the
    logarithm of the largest component. Nothing but the answers "is there an edge left" reaches the driver.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null").distinct()
    e = checkpoint(e)
    found = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    e = e.filter("a <> b")
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("parent")))
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            parent = checkpoint(parent.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
            settled = parent.filter("moved").isEmpty()
            parent = parent.select("node", "parent")
            if settled:
                break
        found = checkpoint(found.join(parent.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
        pa, pb = (parent.select(F.col("node").alias(x), F.col("parent").alias("p" + x)) for x in "ab")
        e = checkpoint(e.join(pa, "a").join(pb, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return found


def tied(predictions: DataFrame) -> DataFrame:
    """Each prediction once with its group as stored and its group and work in comparable form."""
    once = once_per_key(predictions, "pred_id", "sample", "true_group", order="arrived_at")
    group = F.coalesce(same_name("true_group"), same_name(F.when(F.instr("sample", "/") > 0, F.substring_index("sample", "/", 1))))
    work = same_name(F.regexp_extract("sample", r"^[^/]*/(.*?)(?:__chunk.*)?$", 1))
    row = F.concat(F.lit("r:"), F.col("pred_id").cast("string"))
    g, w = F.concat(F.lit("g:"), group), F.concat(F.lit("w:"), work)
    return once.select("pred_id", "true_group", F.coalesce(g, w, row).alias("a"), F.coalesce(w, g, row).alias("b"))


def closest_totals(sizes: list[tuple[int, int]], shares: tuple[float, ...] = (0.8, 0.1, 0.1), resolution: int = RESOLUTION) -> list[dict[int, int]]:
    """How many components of each size go to each split, from (size, how many there are).

    The deviation is the least there is, at any size. A plan comes first: the second and further splits are filled one after the other
    with the subset whose total is closest to the share, in the order of the shares and in the reverse, and then components are
    exchanged between splits while that brings the totals closer. It stands if it is as close as the sizes' common divisor lets
    any plan be; else all totals that could lead to a closer one are searched (:func:`_closest`). The first split takes the rest. Beyond ``resolution``
    rows the filling counts in units of total / resolution rows; the exchanges, the test and the search are exact.
    Multiplicities are split into powers of two, so a bitset has a step for each of them only.
    """
    total = sum(s * n for s, n in sizes)
    exact = [Fraction(str(x)) for x in shares]
    if total == 0:
        return [{} for _ in shares]
    unit = max(1, -(-total // resolution))

    def fill(order: list[int]) -> list[dict[int, int]]:
        left = dict(sizes)
        out: list[dict[int, int]] = [{} for _ in shares]
        for k in order:
            goal = exact[k] * total
            most = int(goal * 2) // unit + 1
            items = _binary(left.items())
            scaled = [max(1, round(size * n / unit)) for size, n in items]
            reach, mask = [1], (1 << (most + 1)) - 1
            for x in scaled:
                reach.append((reach[-1] | reach[-1] << x) & mask)
            aim = int(round(goal / unit))
            low = (reach[-1] & ((1 << (aim + 1)) - 1)).bit_length() - 1
            above = reach[-1] >> (aim + 1)
            high = aim + (above & -above).bit_length() if above else low
            at = min((low, high), key=lambda x: (abs(x * unit - goal), x))
            for (size, n), x, before in zip(reversed(items), reversed(scaled), reversed(reach[:-1])):
                if not before >> at & 1:
                    at -= x
                    out[k][size] = out[k].get(size, 0) + n
                    left[size] -= n
        out[0] = {s: n for s, n in left.items() if n}
        return _exchanged(out, exact, total)

    rest = list(range(1, len(shares)))
    return _closest(sizes, min((fill(rest), fill(rest[::-1])), key=lambda x: _deviation(x, exact, total)), exact, total)


def _binary(sizes: Iterable[tuple[int, int]], splits: int = 1) -> list[tuple[int, int]]:
    """(size, how many at once): multiplicities in powers of two, one of each for every split to be filled, large sizes first."""
    out: list[tuple[int, int]] = []
    for size, n in sorted(sizes, reverse=True):
        part = 1
        while n > 0:
            for _ in range(splits):
                if n > 0:
                    out.append((size, min(part, n)))
                    n -= part
            part *= 2
    return out


def _deviation(plan: list[dict[int, int]], exact: list[Fraction], total: int) -> Fraction:
    return sum((abs(x * total - sum(s * n for s, n in p.items())) for x, p in zip(exact, plan)), Fraction(0))


def _least(sums: np.ndarray, goals: np.ndarray, left: int, unit: int, scale: int) -> np.ndarray:
    """The least deviation (times ``scale``) of each row of split totals, if ``left`` more rows could be shared out in any pieces of ``unit`` rows."""
    gap, step = goals - sums * scale, unit * scale
    down = np.maximum(gap // step, 0)  # pieces up to the goal, not beyond
    rest = gap - down * step
    spare = left // unit - down.sum(1)
    one_more = np.sort(np.abs(rest - step) - np.abs(rest), axis=1)  # what a piece more costs; a second one costs a whole piece
    k = sums.shape[1]
    more = np.concatenate([np.zeros((len(sums), 1), int), np.cumsum(one_more, axis=1)], 1)
    over = np.clip(spare, 0, k)
    return np.abs(rest).sum(1) + more[np.arange(len(sums)), over] + (np.abs(spare) - over) * step


def _closest(sizes: list[tuple[int, int]], plan: list[dict[int, int]], exact: list[Fraction], total: int) -> list[dict[int, int]]:
    """The closest plan there is: ``plan``, or a closer one from a search over the totals of all splits but the first.

    Totals that no rest could bring closer than ``plan`` are dropped at each step, equal ones are kept once.
    """
    scale = int(np.lcm.reduce([x.denominator for x in exact]))
    goals = np.array([int(x * total * scale) for x in exact])
    items, k = _binary(sizes, len(exact) - 1), len(exact)
    left = [*np.cumsum([s * n for s, n in items][::-1])[::-1].tolist(), 0]
    unit = [*np.gcd.accumulate([s for s, _ in items][::-1])[::-1].tolist(), 1]
    best = int(_deviation(plan, exact, total) * scale)
    layers = [np.zeros((1, k - 1), np.int64)]
    if best <= int(_least(np.zeros((1, k), int), goals, total, unit[0], scale)[0]):
        return plan
    for at, (size, n) in enumerate(items):
        x, had = size * n, layers[-1]
        new = np.concatenate([had, *(had + x * np.eye(k - 1, dtype=np.int64)[i] for i in range(k - 1))])
        sums = np.column_stack([total - left[at + 1] - new.sum(1), new])
        new = new[_least(sums, goals, left[at + 1], unit[at + 1], scale) < best]
        if not len(new):
            return plan
        layers.append(np.unique(new, axis=0))
    ends = layers[-1]
    end = ends[int(np.argmin(np.abs(goals - np.column_stack([total - ends.sum(1), ends]) * scale).sum(1)))]
    out: list[dict[int, int]] = [{} for _ in exact]
    for (size, n), had in zip(reversed(items), reversed(layers[:-1])):
        # the item went to the first split, or to one whose total without it was reached before
        steps = np.vstack([np.zeros(k - 1, np.int64), size * n * np.eye(k - 1, dtype=np.int64)])
        which = next(i for i, x in enumerate(steps) if (had == end - x).all(1).any())
        end = end - steps[which]
        out[which][size] = out[which].get(size, 0) + n
    return out


def _exchanged(plan: list[dict[int, int]], exact: list[Fraction], total: int) -> list[dict[int, int]]:
    """Move a component, or swap two, between two splits while that brings the totals closer."""
    sums = [sum(s * n for s, n in p.items()) for p in plan]
    best = _deviation(plan, exact, total)
    while best > 0:
        found = None
        for a in range(len(plan)):
            for b in range(len(plan)):
                if a == b:
                    continue
                # how much had best go from a to b
                want = min((round(sums[a] - exact[a] * total), round(exact[b] * total - sums[b])), key=abs)
                mine, theirs = sorted(s for s, n in plan[a].items() if n), np.array([0, *sorted(s for s, n in plan[b].items() if n)])
                for s in mine:
                    k = int(np.searchsorted(theirs, s - want))
                    for back in theirs[max(0, k - 1) : k + 2].tolist():
                        x = s - back
                        d = best - sum(abs(exact[i] * total - sums[i]) for i in (a, b)) + abs(exact[a] * total - sums[a] + x) + abs(exact[b] * total - sums[b] - x)
                        if d < best and (found is None or d < found[0]):
                            found = (d, a, b, s, back)
        if found is None:
            break
        best, a, b, s, back = found
        for size, one, two in ((s, a, b), (back, b, a)):
            if size:
                plan[one][size] -= 1
                plan[two][size] = plan[two].get(size, 0) + 1
        sums[a] -= s - back
        sums[b] += s - back
    return [{s: n for s, n in p.items() if n} for p in plan]


def split_related(rows: DataFrame, key: str = "pred_id", names: tuple[str, ...] = ("train", "validation", "test"), shares: tuple[float, ...] = (0.8, 0.1, 0.1)) -> DataFrame:
    """``(key, component, split)`` for rows with tie columns a and b. All rows of a component get the same split.

    The driver sees how many components there are of each size: at most sqrt(2 x rows) numbers. Components of one size are
    ranked in range partitions, so no task holds all components of a size.
    """
    spark = rows.sparkSession
    found = checkpoint(components(rows))
    member = checkpoint(rows.select(key, F.col("a").alias("node")).join(found, "node").select(key, "component"))
    size = member.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    ranked = checkpoint(size.repartitionByRange("size", "component").select("*", F.spark_partition_id().alias("part")))
    sizes = sorted((r["size"], r["n"]) for r in ranked.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect())
    plan = closest_totals(sizes, shares)
    bounds = []
    for s, _ in sizes:
        lo = 0
        for k in [*range(1, len(names)), 0]:
            n = plan[k].get(s, 0)
            if n:
                bounds.append((s, lo, lo + n, names[k]))
                lo += n
    before = ranked.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")).select("size", "part", (F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n")).alias("before"))
    place = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("size", "part").orderBy("component"))).join(before, ["size", "part"]).withColumn("at", F.col("before") + F.col("rank") - 1)
    schema = T.StructType([T.StructField("size", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("split", T.StringType())])
    chosen = spark.createDataFrame(bounds, schema)
    split = place.join(chosen, (place["size"] == chosen["size"]) & (place["at"] >= chosen["lo"]) & (place["at"] < chosen["hi"])).select("component", "split")
    return member.join(split, "component").select(key, "component", "split")


def must_share(rows: DataFrame, group: str = "true_group") -> DataFrame:
    """Pairs of different stored group names whose rows are in one component."""
    names = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min("a").alias("node"))
    named = checkpoint(names.join(components(rows), "node").select("component", F.col(group).alias("name")))
    other = named.select("component", F.col("name").alias("group_b"))
    return named.withColumnRenamed("name", "group_a").join(other, "component").filter("group_a < group_b").select("group_a", "group_b")
