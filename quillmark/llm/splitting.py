"""Problem 1: cut oversized texts at natural boundaries, with overlap.

Method: a recursive hierarchy of separators (section, paragraph, sentence, word, character). A span that is too large is
split at the coarsest level that occurs in it, and its parts are split again while they are too large; the parts are then
packed greedily into pieces, each of which repeats the last ``overlap`` code points of the piece before.

Cases: a null text gives no piece; an empty or blank text gives one piece that is the text itself; a text within the limit
gives one piece without going through Python; a text without any boundary is cut between characters, but never before a
combining mark, a joiner or a variation selector unless a whole piece holds nothing else. Columns of the input stay as they
are; the result comes in one array column whose name is checked against the input's.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 100
#: The code points with the Unicode property White_Space, as a Java and Python character class.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = "array<struct<piece_no:int,start_pos:bigint,end_pos:bigint,n_chars:int,text:string>>"

_CLOSE = "\"'”’»›)\\]}）】》〉」』〕"
_S = f"[{SPACES}]"
#: Ends of units from coarse to fine; a boundary lies behind the white space that follows the unit.
_LEVELS = tuple(
    re.compile(x)
    for x in (
        rf"(?:\r\n|\n|\r){_S}*(?:\r\n|\n|\r)(?=(?:\#|第.{{1,6}}[章回卷节]|(?i:chapter|part|section)\b))",
        rf"(?:\r\n|\n|\r)[ \t\u3000]*(?:\r\n|\n|\r){_S}*|\u2029{_S}*",
        rf"(?:\r\n|\n|\r|\u2028|\x85){_S}*",
        rf"(?:[.!?…]+[{_CLOSE}]*{_S}+)|(?:[。！？｡؟।॥]+…*[{_CLOSE}]*{_S}*)",
        rf"{_S}+|[，、；：,;]+[{_CLOSE}]*{_S}*",
    )
)


def nonspace(col: Column | str) -> Column:
    """How many code points of a text aren't white space (Unicode property White_Space)."""
    return F.length(F.regexp_replace(col, f"[{SPACES}]+", ""))


def _glued(ch: str) -> bool:
    """Whether a character belongs to the one before it: marks, the joiner, variation selectors, skin tones."""
    return ch == "\u200d" or "\ufe00" <= ch <= "\ufe0f" or "\U0001f3fb" <= ch <= "\U0001f3ff" or unicodedata.category(ch) in ("Mn", "Me", "Mc")


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece; starts lie ``overlap`` before the end of the piece before."""
    space = np.fromiter((c.isspace() and c not in "\x1c\x1d\x1e\x1f" for c in text), bool, len(text))
    seen = np.concatenate(([0], np.cumsum(~space)))
    total = int(seen[-1])
    if total <= limit:
        return [(0, len(text))]
    overlap = max(0, min(overlap, limit // 2))
    most = limit - overlap
    marks = [np.fromiter((m.end() for m in level.finditer(text)), np.int64) for level in _LEVELS]

    def parts(lo: int, hi: int, level: int) -> Iterator[int]:
        """Ends of the smallest units that have to be told apart."""
        if seen[hi] - seen[lo] <= most:
            yield hi
        elif level < len(marks):
            at = marks[level]
            ends = at[np.searchsorted(at, lo, "right") : np.searchsorted(at, hi, "left")]
            for end in [*ends.tolist(), hi]:
                yield from parts(lo, end, level + 1)
                lo = end
        else:
            while seen[hi] - seen[lo] > most:
                end = int(np.searchsorted(seen, seen[lo] + most, "left"))
                back = end
                while back > lo + 1 and (_glued(text[back]) or text[back - 1] == "\u200d"):
                    back -= 1
                lo = back if back > lo + 1 else end
                yield lo
            yield hi

    out: list[tuple[int, int]] = []
    start = end = 0
    for unit in parts(0, len(text), 0):
        if seen[unit] - seen[start] > limit and end > start and seen[end] > seen[out[-1][1] if out else 0]:
            out.append((start, end))
            start = max(0, end - overlap)
        end = unit
    out.append((start, end))
    return out


def split_oversized(df: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, out: str = "pieces") -> DataFrame:
    """Add ``out``: the pieces of ``text``. ``end_pos - start_pos`` counts code points, ``n_chars`` non-blank ones.

    Texts within the limit stay in the JVM; only the others go to Python, in Arrow batches.
    """
    if out in df.columns:
        raise ValueError(f"the input has a column {out} already")

    @F.pandas_udf(PIECE)
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list | None:
            if t is None:
                return None
            n = lambda x: sum(not c.isspace() or c in "\x1c\x1d\x1e\x1f" for c in x)
            return [{"piece_no": k, "start_pos": a, "end_pos": b, "n_chars": n(t[a:b]), "text": t[a:b]} for k, (a, b) in enumerate(cut_points(t, limit, overlap), 1)]

        return texts.map(one)

    size = nonspace(text)
    whole = F.array(F.struct(F.lit(1).alias("piece_no"), F.lit(0).cast("bigint").alias("start_pos"), F.length(text).cast("bigint").alias("end_pos"), size.alias("n_chars"), F.col(text).alias("text")))
    # Arrow evaluates a UDF for all rows of a batch, even below a CASE; a null costs it nothing.
    return df.withColumn(out, F.coalesce(cut(F.when(size > limit, F.col(text))), F.when(F.col(text).isNotNull(), whole.cast(PIECE))))
