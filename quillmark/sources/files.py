"""Texts from files of many kinds, grouped corpora, matrices, histories."""

from __future__ import annotations

import io
import re
import zipfile
import warnings
from collections.abc import Callable, Iterable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text as X

#: Files beyond this many bytes are an error row.
LARGEST = 10 * 1024 * 1024
# The order in which encodings are tried.
ENCODINGS = ("utf-8", "gbk", "gb2312", "gb18030", "utf-16", "big5", "latin-1")
HISTORY = T.StructType([T.StructField(n, T.DoubleType() if n == "sentiment_score" else T.StringType()) for n in ("id", "timestamp", "input_text", "lang", "basic_summary", "tokens_preview", "freq_preview", "ner_preview", "keywords_preview", "sentiment_label", "sentiment_score")])


def encoding_of(data: bytes) -> str:
    """The first encoding in which all of the file can be read."""
    for name in ENCODINGS:
        try:
            data.decode(name)
            return name
        except (UnicodeDecodeError, UnicodeError):
            continue
    return "latin-1"


def plain(data: bytes) -> str:
    return data.decode(encoding_of(data), "replace").replace("\r\n", "\n").replace("\r", "\n")


class _Page(HTMLParser):
    """Text of a page. What lies in a skipped element is lost up to the end tag of one that can end it; ``meta`` and ``link``
    start such a stretch too, though they have no end tag."""

    # Elements without text, those of them that an end tag closes, and those that end a line.
    SKIP, ENDS = {"script", "style", "noscript", "meta", "link"}, {"script", "style", "noscript"}
    BREAK = {"p", "br", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "header", "footer"}

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.hidden = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden = self.hidden or tag in self.SKIP

    def handle_endtag(self, tag: str) -> None:
        if tag in self.ENDS:
            self.hidden = False
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            self.out.append(data.strip() + " ")


def page(data: bytes | str) -> str:
    p = _Page()
    p.feed(plain(data) if isinstance(data, bytes) else data)
    p.close()
    return re.sub(r" {2,}", " ", re.sub(r"\n{3,}", "\n\n", "".join(p.out))).strip()


def word_document(data: bytes) -> str:
    """Paragraphs of a .docx, then the cells of its tables, blank ones left out."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    parts = [text(p) for p in body.findall(f"{w}p")] if body is not None else []
    parts += [text(c) for c in body.iter(f"{w}tc")] if body is not None else []
    return "\n".join(x for x in parts if x.strip())


#: What goes from RTF, in this order, and what stands in its place. Line ends of the source stay, those that control words stand for don't.
RICH = ((r"\\[a-zA-Z]+[0-9]*", ""), (r"[\\{}]", ""), (r"\n{3,}", "\n\n"), (r" {2,}", " "))


def rich_text(col: Column | str) -> Column:
    """RTF to text: control words and braces go, the rest stays; one chain of replacements in the JVM."""
    t = F.col(col) if isinstance(col, str) else col
    for pattern, put in RICH:
        t = F.regexp_replace(t, pattern, put)
    return X.strip(t)


def _rich(data: bytes) -> str:
    t = data.decode("latin-1").replace("\r\n", "\n").replace("\r", "\n")
    for pattern, put in RICH:
        t = re.sub(pattern, put, t)
    return t.strip()


def _pdf(data: bytes) -> str:
    """Pages that have text, joined by blank lines, where a PDF library is installed."""
    try:
        from PyPDF2 import PdfReader
    except ImportError as e:
        raise ValueError("reading PDF needs PyPDF2") from e
    return pages(p.extract_text() for p in PdfReader(io.BytesIO(data)).pages)


def pages(texts: Iterable[str | None]) -> str:
    return "\n\n".join(t for t in texts if t)


#: Reader by lower-case extension; add to it for further kinds.
READERS: dict[str, Callable[[bytes], str]] = {x: plain for x in (".txt", ".text", ".md", ".json", ".csv", ".xml")} | {".html": page, ".htm": page, ".rtf": _rich, ".docx": word_document, ".pdf": _pdf}


def read_files(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """``(path, text, status, error, label)`` for every file; what can't be read is an error row, not a failure."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    readers = dict(READERS)

    @F.pandas_udf("struct<text:string,error:string>")
    def decode(ext: pd.Series, size: pd.Series, content: pd.Series) -> pd.DataFrame:
        def one(e: str, n: int, data: bytes | None) -> tuple[str | None, str | None]:
            if n > LARGEST:
                return None, f"larger than {LARGEST} bytes"
            if e not in readers:
                return None, f"unknown kind {e or '(none)'}"
            try:
                return readers[e](bytes(data or b"")), None
            except Exception as err:  # noqa: BLE001 - any fault of a file is that file's error
                return None, f"{type(err).__name__}: {err}"

        return pd.DataFrame([one(*x) for x in zip(ext, size, content)], columns=["text", "error"])

    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    # the bytes of files that are too large never leave the scan
    content = F.when(F.col("length") <= LARGEST, F.col("content"))
    out = files.select("path", decode(ext, F.col("length"), content).alias("r"))
    label = F.when(F.col("r.error").isNull(), F.concat(F.lit("read, "), F.format_number(X.nonspace_length("r.text"), 0), F.lit(" characters"))).otherwise(F.col("r.error"))
    return out.select("path", F.col("r.text").alias("text"), F.when(F.col("r.error").isNull(), "ok").otherwise("error").alias("status"), F.coalesce("r.error", F.lit("")).alias("error"), label.alias("label"))


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """``(p, text)`` of the UTF-8 text files in a folder, whole and with every line end as one character."""
    t = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return t.select(F.col("path").alias("p"), F.regexp_replace(F.decode("content", "UTF-8"), r"\r\n?", "\n").alias("text"))


def flat_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(label, text)`` of the text files in a folder."""
    return _texts(spark, path).select(F.regexp_extract("p", r"([^/]+)\.txt$", 1).alias("label"), "text")


def grouped_corpus(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """``(grp, work, label, text)`` from folders of text files; at least two groups with at least two texts each."""
    t = _texts(spark, path.rstrip("/") + "/*/")
    part = lambda k: F.regexp_extract("p", r"([^/]+)/([^/]+)\.txt$", k)
    # texts beside the group folders are not theirs
    steps = lambda x: [y for y in re.sub("^[A-Za-z0-9]+:", "", x).split("/") if y]
    deep = F.size(F.filter(F.split(F.regexp_replace("p", "^[A-Za-z0-9]+:", ""), "/"), lambda y: y != ""))
    c = t.filter(deep == len(steps(path)) + 2).select(part(1).alias("grp"), part(2).alias("stem"), "text")
    out = c.select("grp", F.regexp_replace("stem", r"__chunk\d+$", "").alias("work"), F.concat_ws("/", "grp", "stem").alias("label"), "text")
    if check:
        stray = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path").limit(20).collect()
        if stray:
            warnings.warn(f"texts outside groups are left out: {', '.join(r['path'].rsplit('/', 1)[-1] for r in stray)}", stacklevel=2)
        s = out.groupBy("grp").count().agg(F.count(F.lit(1)).alias("groups"), F.min("count").alias("least")).first()
        if s["groups"] < 2 or s["least"] < 2:
            raise ValueError(f"{s['groups']} groups, the smallest with {s['least']} texts: two of two are needed")
    return out


def matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """Edges ``(la, lb, d)`` from a square table with labels in its first row and column."""
    wide = spark.read.option("header", True).csv(path)
    first, *labels = wide.columns
    if not labels:
        raise ValueError("no columns")
    quoted = [F.col(f"`{c}`") for c in labels]
    # the table must be square and full; it has as many rows as columns, few enough to look at
    rows = [r[0] for r in wide.select(F.when(sum((c.cast("double").isNull().cast("int") for c in quoted), F.lit(0)) == 0, F.col(f"`{first}`"))).collect()]
    if sorted(map(str, rows)) != sorted(labels):
        raise ValueError("the matrix isn't square and full")
    cells = F.explode(F.arrays_zip(F.array(*map(F.lit, labels)).alias("lb"), F.array(*[c.cast("double") for c in quoted]).alias("d")))
    long = wide.select(F.col(f"`{first}`").alias("la"), cells.alias("c")).select("la", "c.lb", "c.d")
    return long.filter("la < lb")


def pair_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("la string, lb string, sim double").csv(path)


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """``(label, shown)`` from two columns below a header; blank rows are left out."""
    return spark.read.option("header", True).schema("label string, shown string").csv(path).filter("trim(coalesce(label, '')) <> '' and trim(coalesce(shown, '')) <> ''")


def shown(rows: DataFrame, mapping: DataFrame, column: str = "label") -> DataFrame:
    """Replace labels that the mapping has."""
    m = mapping.withColumnRenamed("label", "_k")
    return rows.join(m, rows[column] == m["_k"], "left").withColumn(column, F.coalesce("shown", column)).drop("_k", "shown")


def history(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a history file; an unreadable file has none."""
    try:
        rows = spark.read.schema(HISTORY).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
        return rows.filter("id is not null")
    except Exception:  # noqa: BLE001 - a missing history is an empty one
        return spark.createDataFrame([], HISTORY)
