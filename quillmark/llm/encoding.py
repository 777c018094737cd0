"""Problem 7: text that was decoded with the wrong character encoding.

Method: noisy-channel decoding. Under each wrong decoder a text is turned back into its bytes; characters that stand for lost
bytes become wildcards. A Viterbi search over that byte lattice chooses, place by place, between keeping the characters as
they are and reading the bytes in the encoding they were written in, and scores both readings by the frequencies of
characters, character pairs and words in the whole corpus. A text is damaged where reading the bytes anew is likelier
by far; twice damaged texts are decoded again.

Corpus statistics count all rows, in tables of a fixed number of hashed cells, so what is broadcast (6.8 MB) doesn't grow.

Cases: null, empty and plain ASCII texts are never damaged; a damaged spot that is all a quotation holds only mentions the
characters and is left alone; a spot whose bytes are lost is damaged but keeps its replacement characters in the result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ONE, TWO, WORDS, BLOCK = 1 << 16, 1 << 19, 1 << 18, 1 << 13
_WORD = re.compile(r"[^\W\d_]*[^\W\d_a-zA-Z぀-ヿ㐀-鿿’][^\W\d_]*(?:[’'][^\W\d_]+)*|[^\W\d_]+’[^\W\d_]+")
LOST = "�"
#: A quotation of at most so many characters that is all wrong characters mentions them; a longer one is a damaged quotation.
MENTION = 24
#: Cost of taking a spot to be damaged: little where the bytes form UTF-8, which chance hardly does, or where the same channel
#: damaged another spot of the text. Cost of a wildcard, of a byte that is missing without a trace; the least gain.
ENTER_UTF8, ENTER, ENTER_AGAIN, WILD, MISSING, GAIN = 1.0, 3.0, 0.5, 1.0, 5.0, 1.5
_SHORT_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{1,2}")
_RUN_UTF8 = re.compile(rb"(?:[\xe0-\xef][\x80-\xbf]{2}.?){3}|(?:[\xe0-\xef][\x80-\xbf]{2}){2}", re.S)
_RUN_GB = re.compile(rb"(?:[\x81-\xfe][\x40-\xfe]){2}")
_WIDE = re.compile("[ᄀ-ᇿ⺀-㄰ㄱ-鿿ꥠ-꥿가-힯\ue000-\uf8ff豈-﫿＀-￮]")
_QUOTES = {"“": "”", '"': '"', "「": "」", "『": "』", "«": "»", "„": "“", "'": "'", "‘": "’", "《": "》", "`": "`"}


def _pair(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    return (a * 1000003 + b * 7919 + (a >> 3) * 31) & (TWO - 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def count_units(texts: pd.Series) -> np.ndarray:
    """Counts of characters, character pairs and non-ASCII words in hashed cells."""
    out = np.zeros(ONE + TWO + WORDS, np.int64)
    for t in texts:
        if not t:
            continue
        c = _codes("\n" + t)
        out[:ONE] += np.bincount(c & (ONE - 1), minlength=ONE) if len(c) > 5000 else 0
        if len(c) <= 5000:
            np.add.at(out, c & (ONE - 1), 1)
        np.add.at(out, ONE + _pair(c[:-1], c[1:]), 1)
        if not t.isascii():
            for w in _WORD.findall(t):
                out[ONE + TWO + (zlib.crc32(w.lower().encode("utf-8", "replace")) & (WORDS - 1))] += 1
    return out


def corpus_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """The statistics of all rows: partial sums in the tasks, whole sums by block of cells, one array at the end."""
    n = ONE + TWO + WORDS

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n, np.int64)
        for b in batches:
            total += count_units(b["t"])
        for k in range(0, n, BLOCK):
            part = total[k : k + BLOCK]
            if part.any():
                yield pd.DataFrame({"block": [k // BLOCK], "counts": [part.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(x, np.int64) for x in pdf["counts"]), np.zeros(BLOCK, np.int64))
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "counts": [total.tobytes()]})

    schema = "block int, counts binary"
    blocks = texts.select(F.col(text).alias("t")).mapInPandas(partial, schema).groupBy("block").applyInPandas(add, schema)
    out = np.zeros(n, np.int64)
    for r in blocks.collect():  # at most n / BLOCK rows of a fixed size
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out


# ---- wrong decoders: character to bytes ------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def _single(codec: str) -> dict[str, bytes]:
    out = {}
    for b in range(256):
        c = bytes([b])
        try:
            out[c.decode(codec)] = c
        except UnicodeDecodeError:
            pass
        if b >= 0x80:
            out.setdefault(chr(b), c) if codec in ("cp1252", "cp1251", "cp1250") and b < 0xA0 else None
    if codec == "cp1252":
        for b in range(0xA0, 0x100):
            out.setdefault(chr(b), bytes([b]))
    return out


@lru_cache(maxsize=1 << 17)
def _bytes(codec: str, ch: str) -> bytes | None:
    if codec in ("cp1252", "cp1251", "cp1250", "cp437", "cp850", "mac_roman"):
        return _single(codec).get(ch)
    try:
        return ch.encode(codec)
    except UnicodeEncodeError:
        return None


#: Wrong decoder and the encodings that a text may have been written in.
CHANNELS = (("cp1252", ("utf-8", "gb18030")), ("gb18030", ("utf-8",)), ("cp437", ("utf-8", "cp1252")), ("cp1251", ("utf-8", "gb18030")), ("cp932", ("utf-8", "gb18030")), ("mac_roman", ("cp1252", "utf-8")), ("big5hkscs", ("gb18030", "utf-8")), ("utf-8", ("gb18030", "cp1252")), ("cp1250", ("utf-8",)), ("cp850", ("cp1252", "utf-8")), ("euc_kr", ("gb18030", "utf-8")))


class Model:
    """Likelihoods from the corpus counts, and the search."""

    def __init__(self, counts: np.ndarray) -> None:
        self.one, self.two, self.words = counts[:ONE].astype(float), counts[ONE : ONE + TWO].astype(float), counts[ONE + TWO :].astype(float)
        self.total = max(1.0, self.one.sum())
        self._lp: dict[str, float] = {}
        self._seen: dict[tuple[bytes, bytes], list[str]] = {}
        self._token: dict[tuple[str, frozenset], tuple[str, float, tuple[str, str] | None]] = {}
        high = [bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0x100)]
        self.latin = [c for c in high if c and self.one[ord(c)] > 0]

    def lp(self, a: str, b: str) -> float:
        key = a + b
        v = self._lp.get(key)
        if v is None:
            x, y = ord(a), ord(b)
            p = 0.7 * self.two[_pair(x, y)] / (self.one[x & (ONE - 1)] + 5.0) + 0.3 * self.one[y & (ONE - 1)] / self.total + 1e-9
            if 0x80 <= y < 0xA0 or 0xE000 <= y < 0xF900 or y == 0xFFFD:
                p *= 0.01
            v = self._lp[key] = float(np.log(p))
            if len(self._lp) > 1_000_000:
                self._lp.clear()
        return v

    def word(self, w: str) -> float:
        return float(self.words[zlib.crc32(w.lower().encode("utf-8", "replace")) & (WORDS - 1)])

    def plain(self, text: str, before: str = "\n") -> float:
        s = 0.0
        for ch in text:
            s += self.lp(before, ch)
            before = ch
        return s

    def _reads(self, right: str, data: list[int], i: int) -> Iterator[tuple[int, list[str], float]]:
        """Ways to read a character at byte i: (next byte, candidates, cost). -1 stands for a lost byte."""
        n = len(data)
        b = data[i]
        if 0 <= b < 0x80:
            yield i + 1, [chr(b)], 0.0
            return
        if right == "cp1252":
            if b < 0:
                yield i + 1, self.latin, WILD
            else:
                c = bytes([b]).decode("cp1252", "ignore") or chr(b)
                yield i + 1, [c], 0.0
        elif right == "utf-8":
            if b < 0:
                # a lost lead byte: two-byte characters by their second byte, or nothing to go by
                if i + 1 < n and 0x80 <= data[i + 1] < 0xC0:
                    yield i + 2, [c for c in (bytes([lead, data[i + 1]]).decode("utf-8") for lead in range(0xC2, 0xC6)) if self.one[ord(c)] > 0], WILD + 1
                    if i + 2 < n and 0x80 <= data[i + 2] < 0xC0:
                        yield i + 3, self._known([bytes([lead, data[i + 1], data[i + 2]]) for lead in (0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEF)]), WILD
                yield i + 1, [LOST], WILD + 2
                return
            size = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
            if not size:
                if 0x80 <= b < 0xC0:
                    yield i + 1, [LOST], MISSING + 3  # the rest of a character whose start is missing
                return
            j = i + 1
            while j < min(n, i + size) and (data[j] == -1 or 0x80 <= data[j] < 0xC0):
                j += 1
            part = data[i:j]
            if len(part) == size and min(part) >= 0:
                try:
                    yield j, [bytes(part).decode("utf-8")], 0.0
                except UnicodeDecodeError:
                    pass
            elif size <= 3 and (len(part) == size or len(part) == size - 1):
                short = len(part) < size
                for at in ([part.index(-1)] if -1 in part else [1, 2][: size - 1] if short else []):
                    full = part[:at] + [-1] + part[at:] if short and -1 not in part else part
                    if full.count(-1) != 1 or len(full) != size:
                        continue
                    found = self._known([bytes([*full[:at], x, *full[at + 1 :]]) for x in range(0x80, 0xC0)])
                    if found:
                        yield j, found, MISSING if short else WILD
                if part.count(-1) > 1 or short and -1 in part:
                    yield j, [LOST], WILD + 2
            elif size == 3 and len(part) == 1 and (j >= n or data[j] < 0x80 or data[j] >= 0xC0):
                yield j, [LOST], MISSING + 3
        else:
            if b < 0:
                yield i + 1, [LOST], WILD
                return
            if i + 1 < n and data[i + 1] >= 0:
                if data[i + 1] in range(0x30, 0x3A) and i + 3 < n and min(data[i + 2 : i + 4]) >= 0:
                    try:
                        yield i + 4, [bytes(data[i : i + 4]).decode("gb18030")], 0.0
                    except UnicodeDecodeError:
                        pass
                try:
                    yield i + 2, [bytes(data[i : i + 2]).decode("gb18030")], 0.0
                except UnicodeDecodeError:
                    pass
            elif i + 1 < n and data[i + 1] == -1:
                yield i + 2, [LOST], WILD

    def _known(self, options: list[bytes]) -> list[str]:
        """The characters among the options, which differ in one byte, that the corpus has."""
        key = (options[0], options[-1])
        out = self._seen.get(key)
        if out is not None:
            return out
        out = self._seen[key] = []
        for o in options:
            try:
                c = o.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if self.one[ord(c[0]) & (ONE - 1)] > 0:
                out.append(c)
        return out

    def search(self, text: str, wrong: str, right: str, enter: float, spaced: bool) -> tuple[float, str, int] | None:
        """Best reading of ``text`` with spots decoded anew: (gain over leaving it, the reading, characters read anew)."""
        edge = " " if spaced else "\n"
        data: list[int] = []
        starts: dict[int, int] = {}
        for k, ch in enumerate(text):
            starts[len(data)] = k
            if ch == LOST:
                data.append(-1)
                continue
            if ch >= "\x80" and wrong == "utf-8" and right == "cp1252":
                b = None
            else:
                b = _bytes(wrong, ch)
            if b is None:
                data.append(-2)
            else:
                data.extend(b)
        n = len(data)
        starts[n] = len(text)
        # place -> {(damaged, last character): (score, parent, emitted, decoded units)}; all states are kept: they are bounded by the
        # readings of one character
        beams: list[dict | None] = [None] * (n + 1)
        beams[0] = {(False, edge): (0.0, None, "", 0)}
        for i in range(n):
            here = beams[i]
            if not here:
                continue
            k = starts.get(i)
            reads = None  # the same for all states
            for (damaged, last), (score, _, _, units) in here.items():
                me = (i, damaged, last)
                if k is not None:
                    ch = text[k]
                    j = i + (1 if data[i] < 0 else len(_bytes(wrong, ch)))
                    if not damaged:
                        self._put(beams, j, False, ch, score + self.lp(last, ch), me, ch, units)
                if data[i] == -2 or not damaged and k is None or not damaged and 0 <= data[i] < 0x80 and not (wrong in ("gb18030", "cp932", "big5hkscs") and k is None):
                    continue
                if reads is None:
                    reads = [r for r in self._reads(right, data, i) if -2 not in data[i : r[0]]]
                for j, options, cost in reads:
                    base = score - cost - (0.0 if damaged else enter)
                    done = units + (1 if cost == 0 and options[0] >= "\x80" else 0) if options else units
                    for c in options:
                        s = base + self.lp(last, c[-1])
                        self._put(beams, j, True, c[-1], s, me, c, done)
                        if j in starts:
                            self._put(beams, j, False, c[-1], s, me, c, done)
        end = [(v[0] + (self.lp(key[1], edge) if spaced else 0.0), key, v) for key, v in (beams[n] or {}).items()]
        if not end:
            return None
        top, _, best = max(end, key=lambda x: x[0])
        out, node = [], best
        while node[1] is not None:
            out.append(node[2])
            i, damaged, last = node[1]
            node = beams[i][(damaged, last)]
        reading = "".join(reversed(out))
        return top - self.plain(text, edge) - (self.lp(text[-1], edge) if spaced else 0.0), reading, best[3]

    @staticmethod
    def _put(beams: list, j: int, damaged: bool, last: str, score: float, parent: tuple, out: str, units: int) -> None:
        d = beams[j]
        if d is None:
            d = beams[j] = {}
        old = d.get((damaged, last))
        if old is None or old[0] < score:
            d[(damaged, last)] = (score, parent, out, units)

    def _words(self, text: str) -> float:
        return sum(float(np.log(self.word(w) + 0.3)) for w in _WORD.findall(text))

    def _fits(self, part: str, wrong: str, right: str) -> bool:
        """A quick test whether reading the bytes anew could give text at all."""
        if right == "cp1252" and LOST * 2 in part:
            return False  # any letters at all could stand for several lost bytes in a row
        if wrong == "utf-8":
            return LOST in part and (not _WIDE.search(part) if right == "cp1252" else len(part) > 2)
        wide = _WIDE.search(part) is not None
        if wide != (wrong in ("gb18030", "cp932", "big5hkscs", "euc_kr")):
            return False
        if wide:
            data = part.replace(LOST, "\x1a").encode(wrong, "ignore").replace(b"\x1a", b"\x80")
            if right == "utf-8":
                # wide characters among Latin letters, a few beside figures, or one or two by themselves may be letters of two bytes; in
                # Chinese text nearly any two bytes look so
                few = len(part) < 3 or bool(re.search("[A-Za-z]", part)) or bool(re.search("[0-9]", part)) and len(_WIDE.findall(part)) < 8
                return bool(_RUN_UTF8.search(data)) or few and bool(_SHORT_UTF8.search(data))
            return len(data) > 3 and self._likelier(part, data)
        data = b"".join(b"\x80" if ch == LOST else _bytes(wrong, ch) or b"?" for ch in part)
        if right == "utf-8":
            return bool(_SHORT_UTF8.search(data))
        if right == "gb18030":
            return bool(_RUN_GB.search(data)) and self._likelier(part, data)
        return True

    def _likelier(self, part: str, data: bytes) -> bool:
        read = [c for c in data.decode("gb18030", "ignore") if c >= "\x80"]
        was = [c for c in part if c >= "\x80"]
        mean = lambda x: sum(float(np.log(self.one[ord(c) & (ONE - 1)] + 0.5)) for c in x) / max(1, len(x))
        return len(read) > 1 and mean(read) > mean(was) + 0.7

    def restore_part(self, part: str, again: frozenset = frozenset()) -> tuple[str, float, tuple[str, str] | None]:
        """The likeliest reading of a stretch of text, its gain and the channel; 0 where it is best left alone."""
        known = self._token.get((part, again))
        if known is not None:
            return known
        best, gain, channel = part, 0.0, None
        spaced = not _WIDE.search(part) or bool(re.search("[A-Za-z]", part))
        for wrong, rights in CHANNELS:
            for right in rights:
                if not self._fits(part, wrong, right):
                    continue
                enter = ENTER_AGAIN if (wrong, right) in again else ENTER_UTF8 if right == "utf-8" else ENTER
                found = self.search(part, wrong, right, enter, spaced)
                if found is None or found[1] == part:
                    continue
                g, reading, units = found
                if LOST not in part and not units:
                    continue
                if right == "utf-8" and wrong == "cp1252" and units:
                    # twice damaged: what reads badly after one decoding may read well after the next
                    second = self.search(reading, wrong, right, 0.0, spaced)
                    if second is not None and second[0] > 0 and second[2]:
                        g, reading = g + second[0], second[1]
                g += max(-6.0, min(6.0, self._words(reading) - self._words(part)))
                if wrong == "utf-8" and right == "cp1252" and any(self.word(w) < 3 for w in _WORD.findall(reading)):
                    continue
                if g > gain:
                    best, gain, channel = reading, g, (wrong, right)
        if gain < GAIN:
            best, gain, channel = part, 0.0, None
        if len(self._token) > 200_000:
            self._token.clear()
        if len(part) <= 80:
            self._token[(part, again)] = (best, gain, channel)
        return best, gain, channel

    def restore(self, text: str | None, rounds: int = 3) -> tuple[bool, str | None]:
        """Whether a text is damaged, and the text as far as it can be restored."""
        if not text or text.isascii():
            return False, text
        damaged = False
        out, again = text, frozenset()
        for _ in range(rounds):
            pieces, used, at = [], set(), 0
            for part in self._parts(out):
                start, at = at, at + len(part)
                if not part or part.isascii():
                    pieces.append(part)
                    continue
                reading, gain, channel = self.restore_part(part, again)
                if gain > 0 and not self._mentioned(out, start, part, reading):
                    pieces.append(reading)
                    used.add(channel)
                else:
                    pieces.append(part)
            if not used and not again:
                # spots too weak alone may agree on a channel
                again = self._agreed(out)
                if again:
                    continue
            if not used:
                break
            damaged, out, again = True, "".join(pieces), again | used
        if not damaged:
            # nothing restores it, but these never stand in text that was decoded rightly
            damaged = any(not _quoted(text, m.start(), m.end()) for m in _BAD.finditer(text))
        return damaged, out

    def _agreed(self, text: str) -> frozenset:
        parts = {p for p in self._parts(text) if not p.isascii() and not _WIDE.search(p)}
        if len(parts) > 1:
            for channel in (("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252")):
                one = frozenset({channel})
                gains = [g for p in parts for _, g, c in [self.restore_part(p, one)] if g > 0 and c == channel]
                if len(gains) > 1 and sum(gains) - (ENTER - ENTER_AGAIN) >= GAIN:
                    return one
        return frozenset()

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """Stretches that one channel damaged as a whole or not at all: words, sentences, runs of one kind of script."""
        for part in _PARTS.split(text):
            if part and _ODD.search(part) and _WIDE.search(part):
                yield from _RUNS.findall(part)
            elif part:
                yield part

    @staticmethod
    def _mentioned(text: str, at: int, part: str, reading: str) -> bool:
        """Whether all that changed is the whole of a quotation."""
        a = 0
        while a < min(len(part), len(reading)) and part[a] == reading[a]:
            a += 1
        b = 0
        while b < min(len(part), len(reading)) - a and part[-1 - b] == reading[-1 - b]:
            b += 1
        return _quoted(text, at + a, at + len(part) - b)


_PARTS = re.compile(r"([ \n\r\t]+|(?<=[。！？])(?=[㐀-鿿“「])|[/\\])")
#: Characters that no wide script and no plain typography uses, and runs with and without wide characters.
_ODD = re.compile(f"[^\x00-\x7f“”‘’…—–·£°€½\ufffd{_WIDE.pattern[1:-1]}]")
_RUNS = re.compile(f"[{_WIDE.pattern[1:-1]}\ufffd]+|[^{_WIDE.pattern[1:-1]}]+")
_BAD = re.compile("[\x80-\x84\x86-\x9f\ufffd]+|锟斤拷")


def _quoted(text: str, a: int, b: int) -> bool:
    return 0 < a and b < len(text) and b - a <= MENTION and _QUOTES.get(text[a - 1]) == text[b]


def wrongly_decoded(texts: DataFrame, counts: np.ndarray, text: str = "text") -> DataFrame:
    """Add ``damaged`` and ``restored`` to a table of texts; ``counts`` come from :func:`corpus_counts`."""
    if {"damaged", "restored"} & set(texts.columns):
        raise ValueError("the input has a column damaged or restored already")
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf("struct<damaged:boolean,restored:string>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(sent.value)
        for s in batches:
            rows = [model.restore(t) for t in s]
            yield pd.DataFrame({"damaged": [d for d, _ in rows], "restored": [r for _, r in rows]})

    return texts.withColumn("_read", look(F.col(text))).select(*texts.columns, "_read.damaged", "_read.restored")
