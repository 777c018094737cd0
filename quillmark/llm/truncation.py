"""Problem 10: text cut off by field limits.

Method: the vocabulary of the whole corpus as a trie, held as a table of prefixes; a text whose final token is an unknown
proper prefix of known words is cut in mid-word. That is combined with how the text ends (a closed sentence, an open
quotation, a heading, a list, a signature, a closing line) and with length evidence: a source that cuts at a fixed number of
characters or bytes has far more open ends at that length than elsewhere. Everything is JVM-side; nothing is broadcast.

Cases: null, empty and blank texts, and texts without any letter or digit, are never cut; a mark put behind the cut (``...``,
``…``, ``[...]``) doesn't hide it, and an ellipsis that closes sentences elsewhere in the corpus doesn't make a cut; rows under
new ids are rows of their own; a null source is a source of its own in the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.session import checkpoint

#: How many open ends of one length a source needs, and which share of its open ends, to count as a limit.
LIMIT_ROWS, LIMIT_SHARE = 5, 0.04

_WS = r"[\s\p{Z}\x85﻿​]"
#: Letters of the scripts that put blanks between words, as plain ranges, which Java tests far faster than properties.
_LATIN = r"[A-Za-zÀ-ÖØ-öø-\u0DFF\u0E80-\u1FFF]"
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_WORD = rf"{_LATIN}+(?:['’-]{_LATIN}+)*"
#: A mark that may have been put behind a cut; the closers of a sentence; pictures stand for marks in odd texts.
_MARK = rf"(?:{_WS}*(?:\[(?:\.\.\.|…)\]|\((?:\.\.\.|…)\)|(?<!…)…(?!…)|(?<!\.)\.\.\.(?!\.)))$"
_CLOSED = r"(?:[.!?。！？…؟।॥‼⁇⁈⁉‽]|[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{200D}\x{FE0F}])[\"'”’»」』）)\]】》〉]*$"

# Words that close a signature or a text. A line by itself that is one of these shapes is no cut.
_SEASON = r"(?:spring|summer|autumn|fall|winter|january|february|march|april|may|june|july|august|september|october|november|december|\d{2,4}|[春夏秋冬][天日季]?|[年月日])"
_CLOSING = "|".join(
    (
        r"[^\p{L}\p{N}]+",  # a rule of stars or dashes
        r"[—–\-=*~·•＊].*[—–\-=*~·•＊]",  # — end of part 3 —
        r"[（(\[【].*[）)\]】]",
        r"(?:the end|fin|ende|finis|end|to be continued|全文完|全书完|完|终|未完待续|待续|（完）)",
        rf"[\p{{L}}\p{{N}} ,.'’·，、-]{{0,60}}[,，]\s*{_SEASON}",
        rf"\p{{Lu}}[\p{{L}}'’-]*(?: \p{{Lu}}[\p{{L}}'’-]*)*,? {_SEASON}",
        r"[\p{IsHan}·]{1,12}\s*[记书译识题撰谨]",
        r"[—–-]{1,2}\s*\p{Lu}[\p{L} .'’-]{0,40}",
        r"[—–]{1,2}\s*[\p{IsHan}·]{1,12}",
    )
)
_LISTED = "|".join(
    (
        r"(?:\d{1,3}|[a-z]|[ivx]{1,5}|[一二三四五六七八九十]{1,3}|[①-⑳])[.)、）．:：]\s*[^.!?。！？]{1,40}",
        r"[-*•·–▪◦]\s+[^.!?。！？]{1,60}",
        r"(?:\p{Lu}[\p{L}]*(?: \p{L}+)?|[\p{IsHan}]{1,4})[:：]\s*[^.!?。！？“”]{1,60}(?:[,，、][^.!?。！？“”]{1,30}){1,8}",
        r"(?:#+\s*.{1,60}|(?:chapter|part|book|section|act|scene|appendix)\s+[\w.-]+(?:\s*[:.–—-]\s*.{1,50})?|第\s*[\d〇零一二三四五六七八九十百千两]+\s*[章回卷节部篇幕].{0,30})",
    )
)


def _whole(pattern: str) -> str:
    return rf"(?iu)^(?:{pattern})$"


def _ends(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """How each text ends, and the text itself."""
    blanks = F.lit(_BLANKS)
    # patterns only look at the tail; what precedes it can't decide, and texts may be very long
    mark = F.regexp_extract(F.substring("t", -12, 12), _MARK, 0)
    line = F.ltrim(F.substring_index(F.translate("body", "\r\u2028\u2029\x85", "\n\n\n\n"), "\n", -1), blanks)
    return (
        docs.select(F.col(text).alias("text"), F.col(key).alias("key"), F.col(source).alias("source"), F.rtrim(text, blanks).alias("t"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"))
        .withColumn("tail", F.substring("t", -120, 120))
        .withColumn("mark", mark)
        .withColumn("body", F.rtrim(F.substring("t", F.lit(1), F.length("t") - F.length("mark")), blanks))
        .withColumn("line", line)
        .withColumn("end", F.substring("body", -60, 60))
        .select(
            "text",
            "key",
            "source",
            "chars",
            "bytes",
            F.col("t").rlike(r"[\p{L}\p{N}]").alias("speaks"),
            (F.col("mark") != "").alias("marked"),
            F.col("tail").rlike(r"\[(?:\.\.\.|…)\]$|[\s\p{Z}](?:…|\.\.\.)$").alias("set_off"),
            F.col("end").rlike(_CLOSED).alias("closed_before"),
            F.col("tail").rlike(_CLOSED).alias("closed"),
            F.col("tail").rlike(r"\x{FFFD}$").alias("broken"),
            F.col("tail").rlike(r"\d[.]$").alias("figure"),
            F.col("tail").rlike(r"\p{IsHan}[^.!?。！？\n]{0,40}\d[.]$").alias("han_figure"),
            F.col("tail").rlike(r"(?:^|[.!?。！？…\n”])[\s\p{Z}]*“[^“”]{1,100}[!?！？]”$").alias("bare_quote"),
            (F.length(F.regexp_replace("line", "[^“「『«]+", "")) > F.length(F.regexp_replace("line", "[^”」』»]+", ""))).alias("open_quote"),
            ((F.length("line") < F.length("body")) & (F.length("line") <= 120) & F.col("line").rlike(_whole(_CLOSING))).alias("closing_line"),
            ((F.length("line") <= 200) & F.col("line").rlike(_whole(_LISTED))).alias("list_line"),
            F.lower(F.regexp_extract("end", rf"({_WORD})$", 1)).alias("token"),
            F.substring("body", -1, 1).alias("last"),
        )
    )


#: Kinds of rows that one pass over the corpus gives.
END, WORD, ELLIPSIS = 0, 1, 2


def one_pass(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``(kind, token, n, ...)``: how each text ends, with its final token; every word of the corpus but the final one of each text, which
    may be a fragment, with a blank or comma behind it if one follows; words and Han characters before an ellipsis that closes a
    sentence within a text. Words are counted before they are shuffled.
    """
    ends = _ends(docs.filter(F.col(text).isNotNull()), key, text, source)
    low = F.lower("text")
    words = F.regexp_extract_all(low, F.lit(rf"{_WORD}[ ,]?"), F.lit(0))
    before = F.regexp_extract_all(low, F.lit(rf"({_WORD}|\p{{IsHan}})(?:\.{{3}}|…+)(?={_WS}*[^{_WS[1:-1]}.…])"), F.lit(1))
    none = F.array().cast("array<string>")
    lists = ends.withColumn("words", words).withColumn("before", F.when(F.col("text").contains("...") | F.col("text").contains("…"), before).otherwise(none))
    kinds = F.array(
        F.struct(F.lit(END).alias("kind"), F.array("token").alias("tokens")),
        F.struct(F.lit(WORD).alias("kind"), F.when(F.size("words") > 1, F.slice("words", 1, F.size("words") - 1)).otherwise(none).alias("tokens")),
        F.struct(F.lit(ELLIPSIS).alias("kind"), F.col("before").alias("tokens")),
    )
    of_end = [c for c in ends.columns if c not in ("text", "token")]
    rows = lists.select(*of_end, F.explode(kinds).alias("k")).select(*of_end, "k.kind", F.explode("k.tokens").alias("token"))
    return rows.groupBy("kind", "token", *(F.when(F.col("kind") == END, F.col(c)).alias(c) for c in of_end)).agg(F.count(F.lit(1)).alias("n"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """``(word, n, goes_on)``: each known word, how often it occurs and how often its sentence goes on after it."""
    word = F.rtrim(F.col("token"), F.lit(" ,"))
    return rows.filter(F.col("kind") == WORD).groupBy(word.alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("token").endswith(" ") | F.col("token").endswith(","), F.col("n")).otherwise(0)).alias("goes_on"))


def trie(words: DataFrame) -> DataFrame:
    """``(prefix, words)``: for each proper prefix of a known word how many words go on from it."""
    long = words.filter(F.length("word") > 1)
    step = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i)))
    return long.select(step.alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("words"))


def find_cut(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(key, source, cut, reason)`` for each non-blank text."""
    rows = checkpoint(one_pass(docs, key, text, source))
    is_open: Column = F.col("marked") & ~F.col("closed_before") | ~F.col("closed") & ~F.col("closing_line")
    ends = rows.filter((F.col("kind") == END) & F.col("speaks")).drop("kind", "n").withColumn("open", is_open)
    # length evidence, by characters and by bytes
    for unit in ("chars", "bytes"):
        at = F.count(F.when(F.col("open"), 1)).alias("here")
        counts = ends.groupBy("source", unit).agg(at).filter("here > 0")
        total = F.sum("here").over(Window.partitionBy("source"))
        limits = counts.withColumn("all", total).filter((F.col("here") >= LIMIT_ROWS) & (F.col("here") >= LIMIT_SHARE * F.col("all"))).select(F.col("source").alias("s"), F.col(unit).alias("u"), F.lit(True).alias(f"at_{unit}"))
        ends = ends.join(limits, ends["source"].eqNullSafe(limits["s"]) & (ends[unit] == limits["u"]), "left").drop("s", "u")
    words = vocabulary(rows)
    known = words.select(F.col("word").alias("token"), F.col("n").alias("known"), "goes_on")
    deeper = trie(words).select(F.col("prefix").alias("token"), F.col("words").alias("deeper"))
    ellipses = rows.filter(F.col("kind") == ELLIPSIS).select(F.col("token").alias("before"), F.col("n").alias("ellipses"))
    # only tokens that end some text are looked up
    tokens = ends.filter("token <> ''").select("token").distinct().join(known, "token", "left").join(deeper, "token", "left")
    before = F.when(F.col("token") == "", F.col("last")).otherwise(F.col("token"))
    full = ends.join(tokens, "token", "left").withColumn("before", before).join(ellipses, "before", "left")
    limit = F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))
    fragment = (F.col("token") != "") & F.col("known").isNull() & F.col("deeper").isNotNull()
    # a known word that neither a sentence of the corpus nor a longer word goes on from may well close a text
    goes_on = F.col("known").isNull() | (F.col("goes_on") > 0) | F.col("deeper").isNotNull()
    usual_ellipsis = F.coalesce("ellipses", F.lit(0)) > 0
    reason = (
        F.when(F.col("broken"), "broken character")
        .when(F.col("marked") & ~F.col("closed_before"), F.when(fragment, "word and mark").when(F.col("set_off"), "mark set off").when(limit, "mark at limit").when(~usual_ellipsis, "mark in mid-sentence"))
        .when(F.col("marked"), None)
        .when(F.col("closed"), F.when(F.col("han_figure"), "figure").when(F.col("open_quote"), "open quotation").when(limit & (F.col("figure") | F.col("bare_quote")), "closed at limit"))
        .when(F.col("closing_line"), None)
        .when(F.col("list_line") & ~F.col("open_quote"), F.when(fragment, "word in list").when(limit, "list at limit"))
        .when(fragment, "word")
        .when(goes_on | limit | F.col("open_quote"), "sentence")
    )
    return full.select(F.col("key").alias(key), "source", reason.isNotNull().alias("cut"), reason.alias("reason"))
