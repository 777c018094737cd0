"""Column functions on text: languages, tokens, sentences, chunks. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import words as W

HAN = "[一-鿿]"
WORD = "[A-Za-z]+"
WORD_MARKED = "[A-Za-z']+"
WORD_JOINED = "[A-Za-z]+(?:[-'][A-Za-z]+)*"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column | str) -> Column:
    """Without white space at either end, Unicode white space and separators included."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")


def nonspace_length(text: Column | str) -> Column:
    return F.length(F.regexp_replace(text, r"[\s\p{Z}\x1c-\x1f\x85]+", ""))


def language(text: Column | str) -> Column:
    """zh, en or mixed by counts of Han and Latin letters; zh without either."""
    han, latin = F.regexp_count(_c(text), F.lit(HAN)), F.regexp_count(_c(text), F.lit("[A-Za-z]"))
    both = (han > 0) & (latin > 0)
    return F.when(both & (F.least(han, latin) / F.greatest(han, latin) >= 0.2), "mixed").when(latin > han, "en").otherwise("zh")


def is_mark(token: Column | str) -> Column:
    """A token without any letter, digit or underscore."""
    return ~_c(token).rlike(r"[\p{L}\p{N}_]")


def _all(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(0))


def tokens_plain(text: Column | str, pattern: str = WORD) -> Column:
    """Lower-case Latin words; the pattern is the extension point for other tokenizers."""
    return F.transform(_all(text, pattern), F.lower)


def _token(t: Column, kind: str | Column, lemma: Column, stop: Column, lang: str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(t.alias("text"), kind.alias("pos"), lemma.alias("lemma"), stop.alias("is_stop"), F.lit(lang).alias("lang"))


def tokens_en(text: Column | str) -> Column:
    return F.transform(_all(text, WORD_JOINED), lambda t: _token(t, "WORD", F.lower(t), F.lower(t).isin(W.EN_STOP), "en"))


def tokens_zh(text: Column | str) -> Column:
    """One token for each Han character and for each other letter, digit or underscore."""
    return F.transform(_all(text, rf"{HAN}|[\p{{L}}\p{{N}}_]"), lambda t: _token(t, "x", F.lit(""), t.rlike(HAN) & t.isin(W.ZH_STOP), "zh"))


def tokens_mixed(text: Column | str) -> Column:
    """Runs of Han, of Latin and of figures, each by its own rule. A run of Latin has words only after its first letter."""
    runs = _all(text, rf"{HAN}+|[A-Za-z][A-Za-z\s.,;:!?'\"-]*|\p{{Nd}}+(?:\.\p{{Nd}}+)*")
    figure = lambda r: F.array(_token(r, "NUM", r, F.lit(False), "en"))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(HAN), tokens_zh(r)).when(r.rlike(r"^\p{Nd}"), figure(r)).otherwise(tokens_en(r))))


def tokens(text: Column | str, lang: Column | None = None) -> Column:
    """Tokens by language, that of the text unless given."""
    lang = language(text) if lang is None else lang
    return F.when(lang == "zh", tokens_zh(text)).when(lang == "en", tokens_en(text)).otherwise(tokens_mixed(text))


def _alternatives(xs: list[str]) -> str:
    return "|".join(map(re.escape, xs))


_UP, _LOW = r"\p{Lu}", r"[\p{L}&&[^\p{Lu}]]"
_ALONE = r"(?<!\p{L})"
#: Where a sentence ends: each full stop decides by its own surroundings, so one pattern says it all.
SENTENCE_END = (
    r"[。！？!?]|\.(?![ \t]*\p{Nd})"
    rf"(?<!{_ALONE}(?i:{_alternatives(W.TITLES)})\.)"
    rf"(?:(?<!{_ALONE}(?i:{_alternatives(W.ABBREVIATIONS)})\.)(?<!{_ALONE}{_UP}\.)(?!(?<={_ALONE}{_LOW}\.)[ \t]*\p{{L}}\.)(?<!\p{{L}}\.{_LOW}\.)"
    rf"|(?=[ \t]*{_UP})(?!(?<={_ALONE}{_UP}\.)[ \t]*\p{{L}}\.))"
)


def sentences(text: Column | str) -> Column:
    """Sentences in order; line ends close one too, blank pieces are dropped."""
    marked = F.regexp_replace(strip(text), SENTENCE_END, "$0\u0001")
    return F.filter(F.transform(F.split(marked, "[\n\u0001]"), strip), lambda s: s != "")


def chunks(text: Column | str, size: int) -> Column:
    """Pieces of ``size`` words that end with a word; a last piece of less than half of that is dropped, text behind it too."""
    if size <= 0:
        raise ValueError("size must be positive")
    ends = F.filter(F.split(_c(text), r"(?<=[A-Za-z])(?![A-Za-z])", -1), lambda p: p.rlike("[A-Za-z]$"))

    def cut(pieces: Column) -> Column:
        n = F.size(pieces)
        rest = n % size
        count = (F.floor(n / size) + F.when((rest > 0) & (2 * rest >= size), 1).otherwise(0)).cast("int")
        at = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.array_join(F.slice(pieces, (k - 1) * size + 1, size), ""))

    return bound(ends, cut)


def ngrams(text: Column | str, n: int = 4, lang: str = "en") -> Column:
    """Runs of n characters of the letters (en), or of what isn't a mark or blank (zh)."""
    drop = r"[^\p{L}]" if lang == "en" else "[" + re.escape(W.EN_MARKS + W.ZH_MARKS) + r"\x00-\x20]"
    clean = F.regexp_replace(text, drop, "")
    letters = F.filter(F.split(F.lower(clean) if lang == "en" else clean, ""), lambda c: c != "")
    none = F.array().cast("array<string>")
    return bound(letters, lambda cs: F.when(F.size(cs) >= n, F.transform(F.sequence(F.lit(0), F.size(cs) - n), lambda i: F.concat(*[F.get(cs, i + k) for k in range(n)]))).otherwise(none))


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by a bar."""
    none = F.array().cast("array<string>")
    return bound(words, lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit("|"), b))).otherwise(none))


def syllable_count(word: Column | str) -> Column:
    w = F.lower(word)
    w = F.when((F.length(w) > 2) & w.endswith("e"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.greatest(F.regexp_count(w, F.lit("[aeiouy]+")), F.lit(1))


def work_of(label: Column | str) -> Column:
    """The work in ``group/work__chunk001``."""
    return F.regexp_replace(F.regexp_replace(label, "^[^/]*/", ""), r"__chunk\d+$", "")


def chunk_number(label: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(label, r"__chunk(\d+)$", 1).try_cast("int"), F.lit(0))


def word_list(tok: Column, lang: str = "en") -> Column:
    """The texts of tokens that aren't marks, in lower case for English."""
    kept = F.filter(tok, lambda t: ~is_mark(t["text"]))
    return F.transform(kept, lambda t: F.lower(t["text"]) if lang == "en" else t["text"])
