"""Results as files: matrices, tables, slices, histories."""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import text as T
from quillmark.operators.clustering import matrix_of

BOM = "﻿"
KEPT = 200


def _write(path: str, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(text.encode("utf-8"))


def table_csv(rows: DataFrame, path: str, columns: list[str], formats: dict[str, str] | None = None) -> None:
    """One file with a mark and a header. Rows stream to the driver; for large tables write a folder with ``df.write.csv``."""
    formats = formats or {}
    shaped = rows.select(*(F.format_string(formats[c], c).alias(c) if c in formats else F.when(F.col(c), 1).otherwise(0).alias(c) if t == "boolean" else F.col(c) for c, t in rows.select(*columns).dtypes))
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(columns)
    w.writerows(shaped.toLocalIterator())
    _write(path, BOM + out.getvalue())


def matrix_csv(edges: DataFrame, path: str, value: str = "d") -> None:
    """A square table: empty corner, six decimals, zero diagonal."""
    labels, m = matrix_of(edges, value)
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(["", *labels])
    for x, row in zip(labels, m):
        w.writerow([x, *(f"{v:.6f}" for v in row)])
    _write(path, BOM + out.getvalue())


def matrix_wide(edges: DataFrame, value: str = "d") -> DataFrame:
    """The same as a table, for as many labels as a row may have columns."""
    labels = sorted({r[0] for r in edges.select("la").union(edges.select("lb")).distinct().collect()})
    there = edges.select("la", "lb", value)
    back = edges.select(F.col("lb"), F.col("la"), value)
    return there.union(back).groupBy("la").pivot("lb", labels).agg(F.first(value)).na.fill(0.0)


def word_list(features: DataFrame, path: str) -> None:
    _write(path, "".join(r["word"] + "\n" for r in features.orderBy(F.desc("n"), "word").toLocalIterator()))


def guard(path: str) -> Path:
    """Refuse to clean places that hold more than results."""
    p = Path(path).resolve()
    if p in (Path("/"), Path.home(), Path.cwd()) or len(p.parts) < 3 or p in Path.cwd().parents:
        raise ValueError(f"won't clean {p}")
    return p


def clean(path: str) -> None:
    p = guard(path)
    if p.exists():
        shutil.rmtree(p)
    p.mkdir(parents=True)


def slices(corpus: DataFrame, size: int) -> DataFrame:
    """``(grp, work, chunk_no, label, text)``: the corpus in pieces of so many words."""
    out = corpus.select("grp", "work", "label", F.posexplode(T.chunks("text", size)).alias("at", "chunk"))
    return out.select("grp", "work", (F.col("at") + 1).alias("chunk_no"), F.concat("label", F.format_string("__chunk%03d", F.col("at") + 1)).alias("label"), F.col("chunk").alias("text"))


def write_slices(corpus: DataFrame, size: int, path: str, mode: str = "overwrite") -> None:
    """One folder for each group; the write is distributed."""
    guard(path)
    slices(corpus, size).write.mode(mode).partitionBy("grp").parquet(path)


def write_slice_files(corpus: DataFrame, size: int, path: str) -> int:
    """One text file for each piece below its group's folder, written where the piece is; the path must be shared."""

    def put(rows: list) -> list[int]:
        n = 0
        for r in rows:
            folder = os.path.join(path, r["grp"])
            os.makedirs(folder, exist_ok=True)
            with open(os.path.join(folder, f"{r['label'].split('/', 1)[-1]}.txt"), "w", encoding="utf-8") as f:
                f.write(r["text"])
            n += 1
        return [n]

    return sum(slices(corpus, size).rdd.mapPartitions(put).collect())


def entry(text: str, lang: str, **previews: str | float) -> dict:
    """A history entry with an id of its own and the time."""
    from datetime import datetime

    return {"id": uuid.uuid4().hex[:12], "timestamp": datetime.now().isoformat(timespec="seconds"), "input_text": text, "lang": lang} | previews


def latest(entries: DataFrame, order: str = "timestamp", n: int = KEPT) -> DataFrame:
    """The last n entries. Taking the top n needs no sort of all rows."""
    return entries.orderBy(F.desc(order), F.desc("id")).limit(n)


def ranked(entries: DataFrame, order: str, by: str, n: int) -> DataFrame:
    return entries.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), "id"))).filter(F.col("rank") <= n)


def add_to_history(path: str, new: dict) -> None:
    """Put an entry in front and keep the newest."""
    p = Path(path)
    try:
        old = json.loads(p.read_text("utf-8"))
    except (OSError, ValueError):
        old = []
    _write(path, json.dumps([new, *old][:KEPT], ensure_ascii=False, indent=1))


def clear_history(path: str) -> None:
    _write(path, "[]")


def export(rows: DataFrame, path: str, kind: str) -> None:
    """A result as txt, csv or json; a Word file needs python-docx."""
    if kind == "csv":
        table_csv(rows, path, rows.columns)
    elif kind == "json":
        _write(path, "[" + ",\n".join(rows.toJSON().toLocalIterator()) + "]")
    elif kind == "txt":
        _write(path, "".join("\t".join(str(x) for x in r) + "\n" for r in rows.toLocalIterator()))
    elif kind == "docx":
        try:
            import docx
        except ImportError as e:
            raise ValueError("writing Word files needs python-docx") from e
        d = docx.Document()
        for r in rows.toLocalIterator():
            d.add_paragraph("\t".join(str(x) for x in r))
        d.save(path)
    else:
        raise ValueError(f"unknown kind {kind}")
