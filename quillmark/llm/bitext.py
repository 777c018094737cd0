"""Problem 5: which sentences of a bilingual document translate one another.

Method: cross-lingual term vectors by singular value decomposition. Sentences at about the same place of the two sides of all
documents give counts of which terms occur together; the deviation of these counts from chance is decomposed, so terms
that translate one another get like vectors. A sentence is the weighted sum of its terms. Within a document, windows of one to
three consecutive sentences are matched with windows of the other side: the most similar first, if by margin (similarity against the
mean of each one's nearest), in any order; sentences left over join a match if they make it better.

Cases: null lists are empty; null and blank sentences keep their number and match nothing; documents with an empty side have no
pairs; sentences with equal terms count once in a margin and are told apart by place; a long document is searched in blocks of rows. Statistics count all documents, in
tables of a fixed number of hashed terms, so what is broadcast (vectors, about 8 MB) doesn't grow with the data.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed terms of each side and dimensions kept; how far apart, in sentences, places may lie when terms are counted.
TERMS, RANK, REACH = 4096, 256, 2
#: Least similarity of a match of single sentences (of the first round, of the second) and of merged ones, least margin, and
#: what a further sentence must add.
FIRST_COS, LEAST_COS, MERGED_COS, LEAST_MARGIN, ADDS = 0.50, 0.62, 0.66, 1.05, 0.06
BLOCK = 256
#: What the similarity of two windows loses if both have figures and no value is the same.
DIFFERS = 0.3

_HAN = re.compile("[㐀-鿿豈-﫿]+")
_LATIN = re.compile(r"[^\W\d_㐀-鿿豈-﫿]+|\d+(?:\.\d+)?")
_SYLLABLE = re.compile(r"[^aeiou]*[aeiou]")
_NUMBER = re.compile(r"\d+(?:\.\d+)?")
#: A figure with its unit; full-width forms are replaced before.
_FIGURE = re.compile(r"(\d{1,3}(?:,\d{3})+(?![\d])|\d+)(\.\d+)?(?:\s*(万亿|亿|万|千|百|(?:hundred|thousand|million|billion|trillion)(?![a-z])))?", re.I)
_UNITS = {"百": 2, "千": 3, "万": 4, "亿": 8, "万亿": 12, "hundred": 2, "thousand": 3, "million": 6, "billion": 9, "trillion": 12}
_NARROW = str.maketrans("０１２３４５６７８９，．", "0123456789,.")


def figures(text: str | None) -> set[Decimal]:
    """The values of the figures in a text, whatever their width, separators and units (3,000, ３０００; 300万, 3 million)."""
    out: list[Decimal] = []
    end, last = -1, 0
    for m in _FIGURE.finditer((text or "").translate(_NARROW)):
        unit = _UNITS.get((m[3] or "").lower(), 0)
        value = Decimal(m[1].replace(",", "") + (m[2] or "")).scaleb(unit)
        if m.start() == end and unit < last:  # 3亿5000万
            out[-1] += value
        else:
            out.append(value)
        end, last = m.end(), unit
    return set(out)


def _h(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) & (TERMS - 1)


def zh_terms(text: str | None) -> list[int]:
    """Characters, pairs of characters and figures of a Chinese sentence."""
    out = []
    for run in _HAN.findall(text or ""):
        out += [_h(c) for c in run]
        out += [_h(run[i : i + 2]) for i in range(len(run) - 1)]
    out += [_h("#" + x) for x in _NUMBER.findall(text or "")]
    return out


def en_terms(text: str | None) -> list[int]:
    """Words and pairs of words; of capitalised words also their syllables, since names are written down by sound."""
    out, last = [], ""
    for k, w in enumerate(_LATIN.findall(text or "")):
        low = w.lower()
        if low[0].isdigit():
            out.append(_h("#" + low))
        else:
            out.append(_h(low))
            out.append(_h(last + " " + low))
            if w[0].isupper() and k:
                out += [_h("~" + s) for s in _SYLLABLE.findall(low)]
            elif w[0].isupper():
                out += [_h("~" + s) for s in _SYLLABLE.findall(low)]
        last = low
    return out


def _counts(sentences: list, terms) -> np.ndarray:
    out = np.zeros((len(sentences), TERMS), np.float32)
    for i, s in enumerate(sentences):
        if s:
            np.add.at(out[i], terms(s), 1.0)
    return np.minimum(out, 2.0)


def cooccurrence(zh: list, en: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Term counts of Chinese sentences with those of the English ones at about the same place."""
    if not zh or not en:
        return
    e = _counts(en, en_terms)
    for lo in range(0, len(zh), BLOCK):
        part = zh[lo : lo + BLOCK]
        z = _counts(part, zh_terms)
        near = np.zeros((len(part), TERMS), np.float32)
        for i in range(len(part)):
            mid = (lo + i + 0.5) * len(en) / len(zh)
            a, b = max(0, int(mid) - REACH), min(len(en), int(mid) + REACH + 1)
            near[i] = e[a:b].sum(0)
        yield z, near


def matched(zh: list, en: list, vectors: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Term counts of the windows that earlier vectors match."""
    found = match_windows(zh, en, *vectors, least=FIRST_COS)
    for lo in range(0, len(found), BLOCK):
        part = found[lo : lo + BLOCK]
        yield _counts(["\n".join(zh[i] for i in a) for a, _ in part], zh_terms), _counts(["\n".join(en[j] for j in b) for _, b in part], en_terms)


def learn(documents: DataFrame, zh: str = "zh", en: str = "en", vectors: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the hashed terms of both sides, from all documents with lists of sentences ``zh`` and ``en``.

    With ``vectors`` of an earlier round the pairs that these match are counted instead of sentences at about the same place.

    Tasks send sparse partial sums, which are added by blocks of rows; the sum has a fixed size and is decomposed on the driver.
    """
    rows_of = 64
    sent = documents.sparkSession.sparkContext.broadcast(vectors)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((TERMS, TERMS), np.float32)
        hold: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if hold:
                z, e = np.concatenate([a for a, _ in hold]), np.concatenate([b for _, b in hold])
                r, c = np.flatnonzero(z.any(0)), np.flatnonzero(e.any(0))
                total[np.ix_(r, c)] += z[:, r].T @ e[:, c]
                hold.clear()

        for b in batches:
            for zs, es in zip(b["zh"], b["en"]):
                zs, es = (list(x) if x is not None else [] for x in (zs, es))
                for pair in cooccurrence(zs, es) if sent.value is None else matched(zs, es, sent.value):
                    hold.append(pair)
                    if sum(len(a) for a, _ in hold) >= BLOCK:
                        flush()
        flush()
        for k in range(0, TERMS, rows_of):
            part = total[k : k + rows_of].ravel()
            at = np.flatnonzero(part).astype(np.int32)
            if len(at):
                yield pd.DataFrame({"block": [k // rows_of], "at": [at.tobytes()], "n": [part[at].tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(rows_of * TERMS, np.float64)
        for at, n in zip(pdf["at"], pdf["n"]):
            total[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.float32)
        at = np.flatnonzero(total).astype(np.int32)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "at": [at.tobytes()], "n": [total[at].astype(np.float32).tobytes()]})

    schema = "block int, at binary, n binary"
    sums = documents.select(F.col(zh).alias("zh"), F.col(en).alias("en")).mapInPandas(partial, schema).groupBy("block").applyInPandas(add, schema)
    c = np.zeros((TERMS, TERMS), np.float32)
    for r in sums.toLocalIterator():  # at most TERMS / rows_of rows
        flat = c[r["block"] * rows_of : (r["block"] + 1) * rows_of].reshape(-1)
        flat[np.frombuffer(bytes(r["at"]), np.int32)] = np.frombuffer(bytes(r["n"]), np.float32)
    return decompose(c)


def decompose(c: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Term vectors from counts: deviation from chance, randomised singular value decomposition with a fixed seed."""
    total = max(1.0, float(c.sum()))
    r, k = c.sum(1), c.sum(0)
    x = np.empty_like(c)
    for lo in range(0, TERMS, BLOCK):
        expected = np.outer(r[lo : lo + BLOCK], k) / total
        x[lo : lo + BLOCK] = np.maximum(0.0, (c[lo : lo + BLOCK] - expected) / np.sqrt(expected + 1.0))
    x /= np.sqrt(np.maximum(1.0, r))[:, None] ** 0.5
    x /= np.sqrt(np.maximum(1.0, k))[None, :] ** 0.5
    rng = np.random.default_rng(7)
    q = x @ rng.standard_normal((TERMS, rank + 16)).astype(np.float32)
    for _ in range(2):
        q, _ = np.linalg.qr(q)
        q = x @ (x.T @ q)
    q, _ = np.linalg.qr(q)
    u, s, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    root = np.sqrt(s[:rank])
    a, b = (q @ u[:, :rank]) * root, vt[:rank].T * root
    # the direction says what a term means, its rareness how much it weighs
    a, b = _unit(a) * _rareness(r), _unit(b) * _rareness(k)
    return a.astype(np.float32), b.astype(np.float32)


def _rareness(n: np.ndarray) -> np.ndarray:
    return (np.log1p(n.sum() / np.maximum(n, 1.0)) * (n > 0))[:, None]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=-1, keepdims=True))


def _windows(v: np.ndarray, most: int = 3) -> tuple[np.ndarray, list[tuple[int, int]]]:
    parts, spans = [v], [(i, i + 1) for i in range(len(v))]
    for n in range(2, most + 1):
        if len(v) >= n:
            parts.append(sum(v[k : len(v) - n + 1 + k] for k in range(n)))
            spans += [(i, i + n) for i in range(len(v) - n + 1)]
    return np.concatenate(parts), spans


def _top(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a the k most similar rows of b, in blocks."""
    k = min(k, len(b))
    ids, sims = np.empty((len(a), k), np.int64), np.empty((len(a), k), np.float32)
    for lo in range(0, len(a), 2048):
        s = a[lo : lo + 2048] @ b.T
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        val = np.take_along_axis(s, at, 1)
        order = np.argsort(-val, axis=1, kind="stable")
        ids[lo : lo + 2048], sims[lo : lo + 2048] = np.take_along_axis(at, order, 1), np.take_along_axis(val, order, 1)
    return ids, sims


def _distinct(spans: list[tuple[int, int]], terms: list[tuple[int, ...]]) -> tuple[list[int], list[list[int]]]:
    """The first of the windows that have the same terms in the same sentences, and all of them, in order of place."""
    copies: dict[tuple, list[int]] = {}
    for w, (a, b) in enumerate(spans):
        copies.setdefault(tuple(terms[a:b]), []).append(w)
    return [c[0] for c in copies.values()], list(copies.values())


def _by_place(a: list[int], b: list[int], place_a: list[float], place_b: list[float], free_a, free_b) -> Iterator[tuple[float, int, int]]:
    """Pairs of a window of ``a`` and one of ``b``, both in order of place, the closest first; what is no longer free is left out."""

    def nearest(i: int, lo: int, hi: int) -> None:
        while lo >= 0 and not free_b(b[lo]):
            lo -= 1
        while hi < len(b) and not free_b(b[hi]):
            hi += 1
        x = place_a[i]
        below = x - place_b[b[lo]] if lo >= 0 else 9.0
        above = place_b[b[hi]] - x if hi < len(b) else 9.0
        if lo >= 0 and below <= above:
            heapq.heappush(heap, (below, i, b[lo], lo - 1, hi))
        elif hi < len(b):
            heapq.heappush(heap, (above, i, b[hi], lo, hi + 1))

    heap: list[tuple[float, int, int, int, int]] = []
    at = [place_b[w] for w in b]
    for i in a:
        if free_a(i):
            k = bisect_left(at, place_a[i])
            nearest(i, k - 1, k)
    while heap:
        d, i, j, lo, hi = heapq.heappop(heap)
        if free_a(i):
            if free_b(j):
                yield d, i, j
            if free_a(i):
                nearest(i, lo, hi)


def match(zh: list, en: list, zv: np.ndarray, ev: np.ndarray) -> list[tuple[int, int]]:
    """Numbers, from 1, of sentences that translate one another, wholly or in part."""
    return sorted((i + 1, j + 1) for a, b in match_windows(zh, en, zv, ev) for i in a for j in b)


def match_windows(zh: list, en: list, zv: np.ndarray, ev: np.ndarray, least: float = LEAST_COS) -> list[tuple[list[int], list[int]]]:
    """Sets of sentences, by place from 0, that translate one another as a whole."""
    if not zh or not en:
        return []
    tz, te = [zh_terms(s) for s in zh], [en_terms(s) for s in en]
    z = np.stack([zv[t].sum(0) if t else np.zeros(zv.shape[1], np.float32) for t in tz])
    e = np.stack([ev[t].sum(0) if t else np.zeros(ev.shape[1], np.float32) for t in te])
    zn, en_n = [figures(s) for s in zh], [figures(s) for s in en]
    wz, sz = _windows(z)
    we, se = _windows(e)
    # equal windows are compared once
    dz, cz = _distinct(sz, [tuple(t) for t in tz])
    de, ce = _distinct(se, [tuple(t) for t in te])
    uz, ue = _unit(wz[dz]), _unit(we[de])
    lz, le = (np.array([x[w][1] - x[w][0] for w in d]) for x, d in ((sz, dz), (se, de)))
    single_z, single_e = int((lz == 1).sum()), int((le == 1).sum())  # they come first
    # margins against the mean of the nearest single sentences, so that windows are told from chance likeness
    k = 4
    nz, ne = _top(uz, ue[:single_e], k)[1].mean(1), _top(ue, uz[:single_z], k)[1].mean(1)
    scored = []
    for lo, hi, width in [*((x, min(x + BLOCK, single_z), len(ue)) for x in range(0, single_z, BLOCK)), *((x, min(x + BLOCK, len(uz)), single_e) for x in range(single_z, len(uz), BLOCK))]:
        sims = uz[lo:hi] @ ue[:width].T
        enough = sims >= np.where(lz[lo:hi, None] + le[None, :width] == 2, least, MERGED_COS)
        if min(single_z, single_e) > 2:
            enough &= 2 * sims >= LEAST_MARGIN * np.maximum(1e-6, nz[lo:hi, None] + ne[None, :width])
        for a, b in zip(*(x.tolist() for x in np.nonzero(enough))):
            na, nb = set().union(*zn[slice(*sz[dz[lo + a]])]), set().union(*en_n[slice(*se[de[b]])])
            sim = float(sims[a, b])
            if na and nb and not na & nb:
                sim -= DIFFERS
                if sim < (least if lz[lo + a] + le[b] == 2 else MERGED_COS) or min(single_z, single_e) > 2 and 2 * sim < LEAST_MARGIN * float(nz[lo + a] + ne[b]):
                    continue
            scored.append((-(sim - ADDS * int(lz[lo + a] + le[b] - 2)), lo + a, b))
    scored.sort()
    of_z, of_e = [-1] * len(zh), [-1] * len(en)
    place_z, place_e = [a / len(zh) for a, _ in sz], [a / len(en) for a, _ in se]
    free_z = lambda w: all(of_z[i] < 0 for i in range(*sz[w]))
    free_e = lambda w: all(of_e[j] < 0 for j in range(*se[w]))
    out: list[tuple[list[int], list[int]]] = []
    for _, x, y in scored:
        for _, a, b in _by_place(cz[x], ce[y], place_z, place_e, free_z, free_e):
            ra, rb = range(*sz[a]), range(*se[b])
            for i in ra:
                of_z[i] = len(out)
            for j in rb:
                of_e[j] = len(out)
            out.append((list(ra), list(rb)))
    # sentences left over join a match that they make better
    for side, of, mine, other in (("z", of_z, z, e), ("e", of_e, e, z)):
        for i in range(len(of)):
            if of[i] >= 0 or not mine[i].any():
                continue
            best, at = ADDS, -1
            for k2, (a, b) in enumerate(out):
                own, opp = (a, b) if side == "z" else (b, a)
                if len(opp) > 1:
                    continue
                target = _unit(other[opp].sum(0))
                base = mine[own].sum(0)
                gain = float(_unit(base + mine[i]) @ target - _unit(base) @ target)
                if gain > best and float(_unit(mine[i]) @ target) > 0.3 and float(_unit(base + mine[i]) @ target) > MERGED_COS:
                    best, at = gain, k2
            if at >= 0:
                (out[at][0] if side == "z" else out[at][1]).append(i)
                of[i] = at
    return out


def translations(documents: DataFrame, vectors: tuple[np.ndarray, np.ndarray], zh: str = "zh", en: str = "en") -> Column:
    """A column with the numbers of the sentences that translate one another."""
    sent = documents.sparkSession.sparkContext.broadcast(vectors)

    @F.pandas_udf("array<struct<zh_no:int,en_no:int>>")
    def found(z: pd.Series, e: pd.Series) -> pd.Series:
        zv, ev = sent.value
        lists = lambda x: list(x) if x is not None else []
        return pd.Series([[{"zh_no": i, "en_no": j} for i, j in match(lists(a), lists(b), zv, ev)] for a, b in zip(z, e)])

    return found(F.col(zh), F.col(en))
