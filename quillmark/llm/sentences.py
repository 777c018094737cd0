"""Problem 2: sentence boundaries across languages and scripts.

Method: semi-Markov dynamic programming. Every end mark, line break and (in Thai) blank is a possible end; the best sequence
of whole spans between them is selected. A span's score joins what a local rule can't see at once: whether quotations and
brackets are balanced in it, whether it opens with a quotation that the next clause reports, its closing word
(abbreviation, title, initial, ordinal), the opening word of what follows, and its length.

Cases: null and blank texts give no end; a text without any mark is one sentence; a mark without a word (a stray "!") belongs to
the span that scores best with it; an unclosed quotation costs once and doesn't swallow the rest; one that is surely closed is
never broken up, however many sentences it holds. Positions count code points.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations, speech verbs and number words, by what may follow them.
NEVER_END = set("mr mrs ms dr prof st capt col gen lt sgt rev hon messrs mme mlle mgr sr sra srta dña don hr fr frl dipl ing z.b d.h u.a i.e e.g cf vs z d bzw vgl p.ej डॉ श्री د أ".split())
BEFORE_NUMBER = set("no nos nr vol vols p pp pág págs pag art sec secs ch chap fig figs approx ca c cap núm n° bd s op ver v".split())
MAY_END = set("etc usw ltd inc co corp bros jr a.m p.m am pm u.s u.k b.c a.d".split())
ORDINAL_BEFORE = set("am im vom zum beim bis seit der den dem des das die ab".split())
ORDINAL_AFTER = set("januar februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts".split())
PARTICLES = set("de van von der den del della di da dos du la le el al ibn bin ter ten zu".split())
SAID = r"(?:said|says|say|cried|cries|asked|asks|shouted|replied|answered|whispered|called|muttered|added|told|exclaimed|murmured|yelled|remarked|observed|repeated|wrote|begged|warned|demanded|sighed)"
SAID_HAN = r"(?:说|问|喊|道|叫|答|嚷|嘟囔|吼|劝|骂|回应|說|問|答)"
SAID_OTHER = r"(?:कहा|बोला|बोली|बोले|पूछा|चिल्लाया|قال|قالت|سأل|سألت|صاح|صاحت|هتف)"

OPEN, CLOSE = "“‘«„‚「『（(【《〈〔[{‹", "”’»””」』）)】》〉〕]}›"
_HAN = r"぀-ヿ㐀-鿿豈-﫿"
_END = re.compile(r"(?:[.!?…。！？｡؟।॥۔‼⁇⁈⁉]|(?<=[^\W\d_])\.)+")
_HEAD = re.compile(r"(?:#+\s.*|(?:chapter|part|book|section|act|scene|canto|kapitel|teil|buch|chapitre|partie|livre|capítulo|parte|libro)\s+[\w.-]+(?:\s*[:.–—-].*)?|第\s*[\d〇零一二三四五六七八九十百千两]+\s*[章回卷节節部篇幕].*|[ivxlc]+\.?|[^\w\s]*\s*\d+\s*[^\w\s]*|(?:prologue|epilogue|preface|foreword|introduction|contents|序|序言|前言|后记|尾声|楔子|目录))", re.I)
_REPORT = re.compile(rf"[\s,—–-]*(?:[\w'’.-]+\s+){{1,7}}?{SAID}\b(?!\s*[:：])")
_REPORT_HAN = re.compile(rf"[\s，,]*[^。！？!?；;：:“”「」『』\n]{{0,24}}?{SAID_HAN}(?![：:“「]|[^。！？!?；;，,：:“”「」\n]{{0,12}}[：:][“「])")
_REPORT_OTHER = re.compile(rf"[\s,،]*[^.!?।؟“”«»\n]{{0,60}}?{SAID_OTHER}")
_LOWER_WORD = re.compile(r"[^\W\d_]+")
_THAI_SHORT = re.compile(r"(?:[ก-ฮ]\.)+")
#: Characters that a span may have free of cost; each further LONG cost 1.
LONG = 400


def _space(ch: str) -> bool:
    return ch.isspace() or ch in "​﻿"


def _word_before(text: str, dot: int) -> str:
    """The word that a dot closes, with inner dots ("i.e", "p.m")."""
    a = dot
    while a > 0 and (text[a - 1].isalnum() or text[a - 1] in ".°" or unicodedata.category(text[a - 1])[0] == "M"):
        a -= 1
    word = text[a:dot].lstrip(".")
    head, _, tail = word.rpartition(".")
    # "scale.Capt" lacks a blank; "p.m" doesn't
    return tail if len(head.rpartition(".")[2]) > 2 else word


def _is_thai(ch: str) -> bool:
    return "฀" <= ch <= "๿"


def _is_han(ch: str) -> bool:
    return "぀" <= ch <= "ヿ" or "㐀" <= ch <= "鿿" or "豈" <= ch <= "﫿"


def _states(text: str) -> tuple[list[int], dict[int, int]]:
    """For each place in the text a number for what quotations and brackets are open there; and closers' openers."""
    places: list[int] = []
    opener: dict[int, int] = {}
    stack: list[str] = []
    ids: dict[tuple[str, ...], int] = {(): 0}
    out = [0]
    pairs = dict(zip(CLOSE, OPEN))
    pairs["”"] = "“„"
    pairs["“"] = "„"
    pairs["»"] = "«"
    for i, ch in enumerate(text):
        if ch == '"':
            if stack and stack[-1] == '"':
                stack.pop()
                opener[i] = places.pop()
            else:
                stack.append('"')
                places.append(i)
        elif ch == "“" and stack and stack[-1] == "„":
            stack.pop()
            opener[i] = places.pop()
        elif ch in "’'":
            if ch == "’" and stack and stack[-1] == "‘" and not (i + 1 < len(text) and text[i + 1].isalpha() and text[i + 1].isascii()):
                stack.pop()
                opener[i] = places.pop()
        elif ch in OPEN:
            stack.append(ch)
            places.append(i)
        elif ch in pairs and stack and stack[-1] in pairs[ch]:
            stack.pop()
            opener[i] = places.pop()
        if len(stack) > 12:
            del stack[0], places[0]
        out.append(ids.setdefault(tuple(stack), len(ids)))
    return out, opener


def _whole(text: str, opener: dict[int, int]) -> list[int]:
    """For each place in the text how many quotations and brackets that are surely closed later are open there.

    Pairs that may be chance aren't sure: apostrophes, straight marks that look the wrong way, »reversed« guillemets, "b)" in a list.
    """
    change = [0] * (len(text) + 2)
    for b, a in opener.items():
        before, last = text[a - 1 : a], text[b - 1]
        if text[b] == "’" and last.isalnum() and not _is_han(last):
            continue
        if text[b] == '"' and (_space(text[a + 1]) or _space(last)):
            continue
        if text[a] == "«" and (before.isalnum() or before and before in ".!?…"):
            continue
        if text[b] == ")" and re.search(r"(?:^|[\n\r])[^\S\n\r]*\w{1,3}$", text[max(0, b - 9) : b]):
            continue
        change[a + 1] += 1
        change[b + 1] -= 1
    return list(accumulate(change))


def _led_in(text: str, at: int) -> bool:
    """Whether a clause leads into the quotation or bracket that opens at ``at``, so that it stands within a sentence."""
    k = at - 1
    while k >= 0 and text[k] in " \t\xa0\u202f\u3000":
        k -= 1
    return k >= 0 and (text[k].isalnum() or text[k] in ",:;，：；、—–")


def _reported(text: str, at: int, inner: str) -> bool:
    """Whether the clause from ``at`` on reports the quotation before it, over further quotations if need be."""
    rest = text[at : at + 400]
    if inner == "." and not _is_han(rest.lstrip()[:1] or " "):
        return rest.lstrip()[:1].islower()
    while m := re.match(r"\s*[“「『«]([^”」』»]*[.!?…。！？,，])\s*[”」』»]", rest):
        rest = rest[m.end() :]
    if "\n\n" in rest[:3]:
        return False
    s = rest.lstrip()
    if not s:
        return False
    if s[0] in "と":
        return True
    if _is_han(s[0]):
        return bool(_REPORT_HAN.match(rest))
    if s[0].isascii() and s[0].isalpha() or s[0].isalpha() and s[0].islower():
        line = re.split(r"[.!?…。！？“”«»\n]", s, maxsplit=1)[0]
        return s[0].islower() or bool(_REPORT.match(line))
    return bool(_REPORT_OTHER.match(rest))


def _closing(text: str, a: int, b: int, nxt: int, spaced: bool) -> float:
    """Score of an end mark run text[a:b] (closers already behind it) with the next word at nxt."""
    marks = text[a:b]
    ch = text[nxt] if nxt < len(text) else ""
    if not ch:
        return 4.0
    lower = ch.islower()
    if any(c in "。！？｡؟।॥۔" for c in marks):
        return 4.0
    if "…" in marks or marks.count(".") > 1 and set(marks) == {"."}:
        return -6.0 if lower or ch in ",，、;；:" else 4.0
    if "!" in marks or "?" in marks:
        return 4.0 if spaced or not (ch.isalnum() and ch.isascii()) or ch.isupper() else -4.0
    # a single dot
    word = _word_before(text, a)
    low = word.lower()
    if ch in ",;:，；：、":
        return -8.0
    if not spaced and ch.isascii() and ch.isalnum() and not ch.isupper():
        return -8.0
    if not spaced and ch.isdigit():
        return -8.0
    first = (_LOWER_WORD.match(text, nxt) or [""])[0]
    if low in NEVER_END or len(word) == 1 and word.isalpha() and (word.isupper() or not word.isascii() or low in ("z", "d", "p", "s")) and not _is_han(word):
        # the pronoun I and a figure's letter may close a sentence, a title or an initial may not
        return -8.0 if low != "p" and low != "s" or not ch.isupper() else 1.0
    if low in BEFORE_NUMBER:
        return -8.0 if ch.isdigit() or lower else 1.0
    if low in MAY_END or re.fullmatch(r"(?:\w\.)+\w", low):
        if first.lower() in MAY_END:
            return -8.0
        if ch.isdigit() and not word.isascii():
            return -8.0
        return (2.0 if _named(text, nxt) else -8.0) if lower else 2.0
    if word.isdigit() and len(word) <= 2 and spaced and ch.isalpha():
        k = a - len(word)
        before = _word_before(text, len(text[:k].rstrip())).lower()
        if first.lower() in ORDINAL_AFTER or before in ORDINAL_BEFORE and (lower or first.lower() in ORDINAL_AFTER or before in ("am", "im", "vom", "zum")):
            return -8.0
    if lower:
        return 2.0 if _named(text, nxt) else -3.0
    return 4.0


def _named(text: str, at: int) -> bool:
    """Whether a name with a small particle ("de Sara") stands at ``at``."""
    m = re.match(r"(\w+)\s+[A-ZÀ-Þ]", text[at : at + 40])
    return bool(m) and m[1] in PARTICLES


def ends(text: str | None) -> list[int]:
    """The end of each sentence, in code points from the start, in order."""
    if text is None:
        return []
    n = len(text)
    stop = n
    while stop > 0 and _space(text[stop - 1]):
        stop -= 1
    begin = 0
    while begin < stop and _space(text[begin]):
        begin += 1
    if begin >= stop:
        return []
    state, opener = _states(text)

    def after(p: int) -> int:
        while p < n and _space(text[p]):
            p += 1
        return p

    # possible ends: place -> (score, whether a quotation or bracket closes there)
    cand: dict[int, tuple[float, bool]] = {}
    for m in _END.finditer(text, begin, stop):
        a, b = m.span()
        closed = b
        while closed < stop and (text[closed] in CLOSE or text[closed] == '"' and state[closed + 1] < state[closed] or text[closed] in "“" and state[closed + 1] != state[closed] and state[closed] and state[closed + 1] < state[closed]):
            closed += 1
        # French closes with a blank before the mark
        k = closed
        while k < stop and text[k] in "   ":
            k += 1
        if k > closed and k < stop and text[k] == "»":
            closed = k + 1
        nxt = after(closed)
        spaced = nxt > closed
        score = _closing(text, a, b, nxt, spaced)
        if closed > b:
            ch = text[nxt] if nxt < stop else ""
            last = text[closed - 1]
            own = opener.get(closed - 1, -1)
            if not ch:
                score = 4.0
            elif ch in ",，、;；:：" or ch == "的" or last in "》〉】" and "\n" not in text[closed:nxt]:
                score = -8.0
            elif ch.islower() and not (text[b - 1] == "." and _named(text, nxt)):
                score = -8.0
            elif ch in "—–-" and text[nxt + 1 : nxt + 2].islower():
                score = -8.0
            elif last in "）)]〕】" and own >= 0 and _led_in(text, own):
                score = -8.0
            elif last not in "）)]〕】》〉" and own >= 0 and not _led_in(text, own) and _reported(text, closed, text[b - 1]):
                score = -8.0
            else:
                score = 4.0
        elif nxt < stop and text[nxt] in "—–" and text[nxt + 1 : nxt + 2].islower():
            score = -8.0
        cand[closed] = (score, closed > b)
    lines = [(m.start(), m.end()) for m in re.finditer(r"[^\S\n\r  \x85]*(?:\r\n|[\n\r  \x85])\s*", text) if begin < m.start() < stop]
    starts = [begin, *[b for _, b in lines]]
    blocks_open = [text[s:e].rstrip() for s, e in zip(starts, [*[a for a, _ in lines], stop])]
    marked = [bool(re.search(r"[.!?…。！？؟।][\"”’»」』）)\]]*$", x)) for x in blocks_open]
    for k, (a, b) in enumerate(lines):
        gap = text[a:b]
        p = a
        while p > begin and _space(text[p - 1]):
            p -= 1
        blank = len(re.findall(r"\r\n|[\n\r  \x85]", gap)) > 1
        line = blocks_open[k]
        prev, nxt = text[p - 1], text[b] if b < stop else ""
        have = cand.get(p)
        if blank:
            score = 6.0
        elif _HEAD.fullmatch(line.strip()) and len(line) <= 60:
            score = 6.0
        elif have is not None:
            score = have[0] + (1.0 if have[0] > 0 else 0.0)
        elif prev in ",，、;；:：—–-（(“「":
            score = -6.0
        elif _is_han(prev) or _is_han(nxt):
            score = 4.0
        elif _is_thai(prev):
            score = -6.0 if nxt.isdigit() or _THAI_SHORT.match(text, b) else 4.0
        elif nxt.islower() or nxt.isdigit():
            score = -6.0
        elif nxt.isupper() and not marked[k] and (k + 1 >= len(marked) or not marked[k + 1]) and not any(marked[max(0, k - 1) : k]):
            score = 3.0  # lines of verse: neither this one nor its neighbours close with a mark
        elif have is None and nxt and not nxt.isalpha() and not prev.isalnum():
            score = 1.0
        else:
            score = -3.0
        if have is None or score > have[0] or blank:
            cand[p] = (score, have[1] if have else False)
    if any(map(_is_thai, text)):
        for m in re.finditer(r"[^\S\n\r]+", text):
            a, b = m.span()
            if a <= begin or b >= stop or a in cand:
                continue
            prev, nxt = text[a - 1], text[b]
            if not (_is_thai(prev) or _is_thai(nxt)) or prev.isdigit() or nxt.isdigit() or prev in ".,;:" or nxt in "ๆฯ" or _THAI_SHORT.match(text, b) or not (_is_thai(prev) and (_is_thai(nxt) or nxt in OPEN or nxt.isalpha())):
                continue
            cand[a] = (3.0, False)
    cand[stop] = (4.0, cand.get(stop, (0, False))[1])
    # a break in a closed quotation would cost more than any end or shorter span is worth, so none is tried there
    whole = _whole(text, opener)
    places = sorted(p for p in cand if p > begin and (cand[p][0] > -7.5 and not whole[p] or p == stop))
    # dynamic programme over spans; of those longer than LONG only the best of each state can win, since all cost alike by length
    best: list[float] = [0.0]
    back: list[int] = [-1]
    at = [begin, *places]
    begins = [begin, *[after(p) for p in places]]
    far: dict[int, int] = {}
    far_top, passed = -1, 0

    def gain(i: int) -> float:
        return best[i] + begins[i] / LONG

    for j in range(1, len(at)):
        p = at[j]
        local = cand[p][0]
        while passed < j and p - begins[passed] > LONG:
            k = far.get(state[begins[passed]], -1)
            if k < 0 or gain(passed) >= gain(k):
                far[state[begins[passed]]] = passed
            if far_top < 0 or gain(passed) >= gain(far_top):
                far_top = passed
            passed += 1
        top, arg = -1e18, j - 1
        for i in [*range(j - 1, passed - 1, -1), *sorted({far_top, far.get(state[p], -1)} - {-1}, reverse=True)]:
            s = begins[i]
            value = best[i] + local
            if state[s] != state[p]:
                value -= 12.0
            size = p - s
            if size > LONG:
                value -= (size - LONG) / LONG
            if size < 3 and not any(c.isalnum() for c in text[s:p]):
                value -= 6.0
            if value > top:
                top, arg = value, i
        best.append(top)
        back.append(arg)
    out: list[int] = []
    j = len(at) - 1
    while j > 0:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def sentence_ends(text: Column | str) -> Column:
    """A column with the ends of the sentences of a text, ``array<bigint>``; null and blank texts have none."""

    @F.pandas_udf("array<bigint>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(ends)

    return found(text)
