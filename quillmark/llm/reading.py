"""Problem 3: how demanding a text is, on the scale of graded sample texts.

Method: classic readability formulas (Flesch-Kincaid, Gunning fog, SMOG, Coleman-Liau, ARI, FORCAST, shares of long words), from
clause length and syllables counted by hyphenation-style rules; for Chinese their counterparts from clause length, unbroken runs and the
share of bookish characters. Sentences come from the operator of problem 2. The samples only say at which values a formula
passes from one level to the next; no words are learnt from them. A sentence gets the median of its grade estimates, a text the median of
its sentences weighted slightly by their length. Length is counted by clause, so neither run-on sentences of easy words
nor a few hard or easy sentences decide.

The samples that the boundaries are fitted on are bounded (``LABELLED`` rows); they are a fixed table.

Cases: null and blank texts and texts without letters have no level; a text in another alphabet is measured like English by
what letters it has; a mixed text by each sentence's own script; very long texts are measured whole; without samples of all four levels
in a script its sentences aren't measured.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import sentences

LABELLED = 2_000
#: A sentence weighs as its length to this power: one run-on sentence is still about one sentence.
WEIGHT = 0.25
#: Grades at an estimate's lowest typical value, its three boundaries between levels, its highest typical value.
GRADES = (1.0, 1.5, 2.5, 3.5, 4.0)

_WORD = re.compile(r"[^\W\d_㐀-鿿]+(?:['’-][^\W\d_㐀-鿿]+)*")
_HAN = re.compile("[㐀-鿿]")
#: Where a clause ends; what "and then" strings together are clauses of their own.
_CLAUSE = re.compile(r"[，、；：,;:—]+|\b(?:and|but) then\b")
_VOWELS = re.compile(r"[aeiouyäöüéèêàâîïôûáíóúñ]+")
_SPLIT = re.compile(r"(?:ia(?!n\b|l\b|ge\b)|io(?!n|us)|eo(?!us)|ua|uo|ui(?=t)|[aeiou]ing|iu|ier\b|ean\b|ology|isation|ization)")

# Fixed values, closed classes of Chinese: function words of the literary language, endings of abstract nouns, everyday particles and
# pronouns, and further function words that break up runs.
LITERARY = set("之其而者也夫盖乎矣焉乃以于所则亦岂孰遂故且莫既曰余吾尔皆尝谓哉耳或弗勿兮惟")
ABSTRACT = set("性论化制系义构诸")
EVERYDAY = set("的了着过们吗呢吧啊这那个是在有没我你他她它")
FUNCTION = EVERYDAY | LITERARY | set("不和都就还又把被让对从给向为一二三四五六七八九十两几上下里中来去到很只与及因由虽然可但如若")
_BREAK = re.compile(rf"[^㐀-鿿]+|[{''.join(sorted(FUNCTION))}]+")


@lru_cache(maxsize=1 << 16)
def syllables(word: str) -> int:
    """Syllables by rule: vowel groups, less silent endings, plus vowels that are spoken apart."""
    w = word.lower()
    n = len(_VOWELS.findall(w))
    if n > 1:
        if re.search(r"[^aeiouyl]e$|[^aeiou]le$", w) and not re.search(r"[^aeiou]le$", w):
            n -= 1
        elif re.search(r"(?<![td])ed$", w) or re.search(r"(?<![sxz])(?<!ch)(?<!sh)es$", w) and re.search(r"[^aeiouscgz]es$", w):
            n -= 1
        elif re.search(r"ely$|eful$|eless$|ement", w):
            n -= 1
    n += len(_SPLIT.findall(w[1:])) if n > 1 else 0
    return max(1, n)


def units(text: str | None) -> Iterator[tuple[str, str, list[str]]]:
    """(script, sentence, its words or characters) for each sentence."""
    a = 0
    for b in sentences.ends(text):
        s = text[a:b]
        a = b
        han, words = _HAN.findall(s), _WORD.findall(s)
        if len(han) > 2 * len(words):
            yield "zh", s, han
        elif words:
            yield "en", s, words


def estimates(script: str, sentence: str, words: list[str]) -> list[float]:
    """Raw values of the formulas for one sentence."""
    n = len(words)
    letter = _HAN if script == "zh" else _WORD
    clause = n / max(1, sum(letter.search(c) is not None for c in _CLAUSE.split(sentence)))
    if script == "zh":
        bookish = sum(c in LITERARY or c in ABSTRACT for c in words) / n
        everyday = sum(c in EVERYDAY for c in words) / n
        runs = [len(r) for r in _BREAK.split(sentence) if r]
        long = sum(r for r in runs if r >= 5) / n
        return [
            0.39 * clause + 118 * (bookish + long / 4),
            0.4 * (clause + 100 * bookish),
            1.043 * (30 * bookish) ** 0.5 + 3.1291 + 0.1 * clause,
            100 * bookish,
            100 * (bookish - everyday) + 0.5 * clause,
            clause + 10 * clause * (bookish - everyday),
            sum(runs) / max(1, len(runs)) + 20 * bookish,
            100 * (long + 2 * bookish),
        ]
    syl = [syllables(w) for w in words]
    letters, per = sum(map(len, words)), sum(syl) / n
    hard = sum(s >= 3 for s in syl)
    return [
        0.39 * clause + 11.8 * per - 15.59,
        0.4 * (clause + 100 * hard / n),
        1.043 * (30 * hard / n * min(1.0, n / 8)) ** 0.5 + 3.1291,
        5.88 * letters / n - 15.8,
        4.71 * letters / n + 0.5 * clause - 21.43,
        20 - 15 * sum(s == 1 for s in syl) / n,
        100 * sum(len(w) > 6 for w in words) / n + clause,
        100 * sum(len(w) > 9 for w in words) / n + clause,
    ]


def median(values: list[float]) -> float:
    v = sorted(values)
    k = len(v) // 2
    return v[k] if len(v) % 2 else (v[k - 1] + v[k]) / 2


def weighted_median(values: list[float], weights: list[float]) -> float:
    half, run = sum(weights) / 2, 0.0
    for v, w in sorted(zip(values, weights)):
        run += w
        if run >= half:
            return v
    return max(values)


def grade(x: float, at: list[float]) -> float:
    """An estimate on the scale of the samples: between the boundaries in proportion."""
    k = bisect_right(at, x)
    if k == 0 or k == len(at):
        return GRADES[0 if k == 0 else -1]
    return GRADES[k - 1] + (GRADES[k] - GRADES[k - 1]) * (x - at[k - 1]) / (at[k] - at[k - 1])


class Scale:
    """At which values each formula passes from level to level, from graded samples."""

    def __init__(self, samples: list[tuple[int, str]]) -> None:
        points: dict[str, list[list[list[float]]]] = {"en": [[], [], [], []], "zh": [[], [], [], []]}
        for level, text in samples:
            us = list(units(text))
            for script in points:
                rows = [(estimates(s, t, w), len(w) ** WEIGHT) for s, t, w in us if s == script]
                if rows and 2 * len(rows) >= len(us):
                    points[script][level - 1].append([weighted_median([r[k] for r, _ in rows], [w for _, w in rows]) for k in range(len(rows[0][0]))])
        self.at: dict[str, list[list[float]]] = {}
        for script, by in points.items():
            if all(by):
                self.at[script] = []
                for k in range(len(by[0][0])):
                    v = [[row[k] for row in rows] for rows in by]
                    cuts = [self._cut(sum(v[:j], []), sum(v[j:], []), 0.0) for j in (1, 2, 3)]
                    at = sorted([median(v[0]), *cuts, median(v[3])])
                    self.at[script].append([x + i * 1e-9 for i, x in enumerate(at)])
        scored = [(level, s) for level, text in samples if (s := self.score(text)) is not None]
        self.cuts = [self._cut([s for x, s in scored if x <= k], [s for x, s in scored if x > k], k + 0.5) for k in (1, 2, 3)]

    @staticmethod
    def _cut(low: list[float], high: list[float], fallback: float) -> float:
        """The boundary between levels with the fewest errors, the middle of the widest gap among equals."""
        if not low or not high:
            return fallback
        at = sorted({*low, *high})
        best = min(((sum(x >= c for x in low) + sum(x < c for x in high), -(b - a), c) for a, b in zip(at, at[1:]) for c in [(a + b) / 2]), default=(0, 0, fallback))
        return best[2]

    def score(self, text: str | None) -> float | None:
        """A text's place on the scale; null without letters."""
        values, weights = [], []
        for script, sentence, words in units(text):
            at = self.at.get(script)
            if at is not None:
                values.append(median([grade(x, a) for x, a in zip(estimates(script, sentence, words), at)]))
                weights.append(len(words) ** WEIGHT)
        return weighted_median(values, weights) if values else None

    def level(self, score: float | None) -> int | None:
        return None if score is None else 1 + sum(score >= c for c in self.cuts)


def learn_scale(samples: DataFrame, key: str = "sample_id", level: str = "level", text: str = "text") -> Scale:
    rows = samples.filter(F.col(text).isNotNull() & F.col(level).between(1, 4)).orderBy(key).limit(LABELLED).select(level, text).collect()
    return Scale([(int(r[0]), r[1]) for r in rows])


def reading_level(texts: DataFrame, scale: Scale, text: str = "text") -> Column:
    """A column with ``score`` and ``level`` of each text."""
    sent = texts.sparkSession.sparkContext.broadcast(scale.__dict__)

    @F.pandas_udf("struct<score:double,level:int>")
    def measure(batch: pd.Series) -> pd.DataFrame:
        own = Scale.__new__(Scale)
        own.__dict__.update(sent.value)
        scores = [own.score(t) for t in batch]
        return pd.DataFrame({"score": pd.array(scores, dtype="Float64"), "level": pd.array([own.level(s) for s in scores], dtype="Int32")})

    return measure(F.col(text))
