"""Problem 9: evaluation texts that leak into a training corpus.

Method: a distributed positional inverted index. Both sides are reduced to tokens (words, single characters of scripts
without blanks) without case, width and punctuation; the index holds, for every run of three tokens in a document that is rare
among the distinct passages of the test items, its places; of a passage with too few rare runs it holds all runs. The lists of
these runs are intersected by passage and document; documents
with enough of them are aligned with the passage token by token, and the share of the passage that lies in dense stretches of the
alignment, and the share of its telling runs (those with names and figures) there, decide.

Cases: instruction and question lines are no part of a passage; null and empty documents hold nothing; items shorter than three
tokens can't leak; equal documents under different ids each count; an item that equals another leaks wherever it does, however many are equal.
The test items are small and are broadcast only while their runs, which are counted, number fewer than ``BROADCAST_RUNS``.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.grouping import widths
from quillmark.session import checkpoint, spread

RUN = 3
#: A run of tokens tells passages apart if no more distinct passages than this have it; how many of them, and which share of an item's, a
#: document must have at like offsets before it is aligned; how far offsets may drift apart.
RARE_ITEMS, LEAST_RUNS, LEAST_RUN_SHARE, DRIFT = 2, 3, 0.08, 64
#: A passage with a smaller share of rare runs than this is searched by all of its runs.
FEW_SHARE = 0.2
#: The share of a passage, its density in the covered stretches and the share of telling runs there; the widest gap.
SHARE, DENSITY, TELLING, GAP = 0.4, 0.55, 0.45, 8
BROADCAST_RUNS = 2_000_000
#: Ids of the documents to be aligned are broadcast up to this number, so that only their texts leave the scan.
BROADCAST_IDS = 4_000_000
#: A line that stands beside so many different longer lines is an instruction.
COMMON_LINE = 3

_TOKEN = r"[0-9⺀-ヿ㐀-鿿豈-﫿฀-๿]|[a-zÀ-ɏͰ-ӿ֐-෿Ḁ-῿]+"


def tokens(text: Column | str) -> Column:
    """Lower-case words, single wide characters and figures digit by digit, without punctuation and width forms."""
    plain = F.lower(F.translate(text, *widths()))
    return F.regexp_extract_all(F.coalesce(plain, F.lit("")), F.lit(_TOKEN), F.lit(0))


def passages(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(key, tokens)``: each item without instruction lines and without a closing question.

    A passage that many items hold, with one question or several, is no instruction: it is the longest line, or stands beside the
    same longest line in all of them.
    """
    lines = items.select(F.col(key).alias("k"), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("at", "line")).filter(F.trim("line") != "")
    packed = lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l")).select("k", F.transform("l", lambda x: x["line"]).alias("whole"))
    asks = lambda x: F.element_at(x, -1).rlike(r"[?？]\s*$") & (F.size(x) > 1)
    told = lambda x: F.when(asks(x), F.slice(x, 1, F.size(x) - 1)).otherwise(x)
    longest = F.array_max(F.transform("body", lambda x: F.struct(F.length(x).alias("n"), x.alias("line"))))["line"]
    bodies = checkpoint(packed.withColumn("body", told(F.col("whole"))).withColumn("longest", longest))
    beside = bodies.select("longest", F.explode("body").alias("line")).filter("line != longest")
    common = beside.groupBy("line").agg(F.countDistinct("longest").alias("n")).filter(F.col("n") >= COMMON_LINE).select("line", F.lit(True).alias("common"))
    split = bodies.select("k", "longest", (F.size("body") == 1).alias("alone"), F.posexplode("whole").alias("at", "line")).join(common, "line", "left")
    kept = split.filter(F.col("common").isNull() | (F.col("line") == F.col("longest")) & ~F.col("alone"))
    left = kept.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l")).select("k", F.transform("l", lambda x: x["line"]).alias("left"))
    return left.select(F.col("k").alias(key), tokens(F.array_join(told(F.col("left")), "\n")).alias("tokens"))


def _runs(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each run of tokens: its hash and place."""
    long = df.filter(F.size("tokens") >= RUN)
    hashes = F.transform(F.sequence(F.lit(1), F.size("tokens") - RUN + 1), lambda i: F.xxhash64(*[F.element_at("tokens", i + k) for k in range(RUN)]))
    return long.select(*keep, F.posexplode(hashes).alias("at", "run"))


def align(item: list[str], doc: list[str], telling: set[int], near: list[int]) -> tuple[float, float, float]:
    """Share of the item in dense stretches, density there, share of the telling runs there that are met whole."""
    n = len(item)
    best = (0.0, 0.0, 0.0)
    near = sorted(near)
    # places far from each other are different occurrences
    groups: list[list[int]] = []
    for p in near:
        if groups and p - groups[-1][-1] <= n + 20:
            groups[-1].append(p)
        else:
            groups.append([p])
    for g in groups:
        window = doc[max(0, g[0] - n - 10) : g[-1] + n + 10]
        blocks = [b for b in SequenceMatcher(None, item, window, autojunk=False).get_matching_blocks() if b.size >= 2 or b.size == 1 and len(item[b.a]) > 3]
        spans: list[list[int]] = []  # first, end, matched; a gap is bridged on both sides
        last = None
        for b in blocks:
            if last is not None and b.a - last.a - last.size <= GAP and b.b - last.b - last.size <= GAP:
                spans[-1][1] = b.a + b.size
                spans[-1][2] += b.size
            else:
                spans.append([b.a, b.a + b.size, b.size])
            last = b
        hit = {b.a + k for b in blocks for k in range(b.size)}
        good = [s for s in spans if s[1] - s[0] >= min(6, n) and s[2] >= DENSITY * (s[1] - s[0])]
        cover = [p for s in good for p in range(s[0], s[1])]
        if not cover:
            continue
        inside = set(cover)
        told = [p for p in telling if all(p + k in inside for k in range(RUN))]
        met = sum(all(p + k in hit for k in range(RUN)) for p in told)
        got = (len(cover) / n, sum(p in hit for p in cover) / len(cover), met / len(told) if told else 0.0)
        best = max(best, got, key=lambda x: (x[0] * (x[2] >= TELLING), x))
    return best


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """``(doc_key, item_key, share, density, telling)`` for every document that holds enough of an item's passage."""
    # items with the same passage are searched as one
    parts = checkpoint(passages(items, item_key, text).groupBy("tokens").agg(F.min(item_key).alias("item"), F.collect_set(item_key).alias("items")))
    runs = checkpoint(_runs(parts, "item"))
    rare = runs.groupBy("run").agg(F.countDistinct("item").alias("items")).filter(F.col("items") <= RARE_ITEMS)
    telling = runs.join(rare.select("run", F.lit(1).alias("rare")), "run", "left")
    few = telling.groupBy("item").agg(F.count("rare").alias("n"), F.count(F.lit(1)).alias("all")).filter(F.col("n") < F.greatest(F.lit(LEAST_RUNS), FEW_SHARE * F.col("all"))).select("item", F.lit(1).alias("few"))
    terms = checkpoint(telling.join(few, "item", "left").filter("rare = 1 or few = 1").select("run", "item", F.col("at").alias("item_at")))
    side = F.broadcast(terms) if terms.count() <= BROADCAST_RUNS else terms
    read = spread(docs.select(F.col(doc_key).alias("doc"), F.col(text).alias("text")), "doc").select("doc", tokens("text").alias("tokens"))
    postings = _runs(read, "doc").join(side, "run")
    # intersect by offset: buckets overlap by half, so places that drift by less than that share one
    bucket = F.floor((F.col("at") - F.col("item_at")) / (DRIFT // 2))
    near = postings.withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
    met = near.groupBy("doc", "item", "bucket").agg(F.countDistinct("item_at").alias("runs"), F.collect_set("at").alias("at"))
    own = terms.groupBy("item").agg(F.collect_set("item_at").alias("telling"))
    enough = met.join(own, "item").filter(F.col("runs") >= F.greatest(F.least(F.lit(LEAST_RUNS), SHARE * F.size("telling")), LEAST_RUN_SHARE * F.size("telling")))
    found = checkpoint(enough.groupBy("doc", "item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("places"), F.first("telling").alias("telling")))
    told = parts.select("item", F.col("tokens").alias("item_tokens"))
    ids = found.select("doc").distinct()
    ids = F.broadcast(ids) if found.count() <= BROADCAST_IDS else ids
    texts = spread(docs.select(F.col(doc_key).alias("doc"), F.col(text).alias("doc_text")).join(ids, "doc", "left_semi"), "doc").select("doc", tokens("doc_text").alias("doc_tokens"))
    pairs = found.join(told, "item").join(texts, "doc").select("doc", "item", "places", "item_tokens", "telling", "doc_tokens")

    @F.pandas_udf("struct<share:double,density:double,telling:double>")
    def compare(item: pd.Series, doc: pd.Series, tell: pd.Series, near: pd.Series) -> pd.DataFrame:
        rows = [align(list(a), list(b), set(c), list(d)) for a, b, c, d in zip(item, doc, tell, near)]
        return pd.DataFrame(rows, columns=["share", "density", "telling"])

    scored = pairs.select("doc", "item", compare("item_tokens", "doc_tokens", "telling", "places").alias("m"))
    return scored.join(parts.select("item", "items"), "item").select(F.col("doc").alias(doc_key), F.explode("items").alias(item_key), "m.*")


def leaked(scored: DataFrame) -> DataFrame:
    return scored.filter((F.col("share") >= SHARE) & (F.col("density") >= DENSITY) & (F.col("telling") >= TELLING))
