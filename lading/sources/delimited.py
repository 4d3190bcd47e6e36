"""Delimited text as rows of cells: delimiter, header and encoding are found per file."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row of any extracted table: the cells keep the order of the columns.
CELLS = "doc_id string, table_ix int, sheet_name string, row_number int, cells array<struct<pos:int,header:string,value:string>>"
DELIMITERS = ",;\t|"


def decode(raw: bytes) -> str:
    """By byte order mark, else UTF-8, else Windows-1252; NUL and NBSP become spaces."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            text = raw[len(mark) :].decode(name, "replace")
            break
    else:
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = raw.decode("cp1252", "replace")
    text = text.replace("\0", " ").replace("\xa0", " ")
    if any(s in text for s in ("Ã", "Â", "â€")):  # UTF-8 that was read as Windows-1252
        try:
            fixed = text.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return text
        return fixed if sum(map(fixed.count, "ÃÂ")) < sum(map(text.count, "ÃÂ")) else text
    return text


def headers(names: list[str]) -> list[tuple[int, str]]:
    """Places and names of columns that have one; repeated names are numbered from 2, whatever their case."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = (n or "").strip()
        if n:
            k = seen[n.lower()] = seen.get(n.lower(), 0) + 1
            out.append((i, n if k == 1 else f"{n}_{k}"))
    return out


def table_rows(lines: list[list[str]], first_row: int = 2) -> list[tuple[int, list[dict]]]:
    """Numbered rows of cells under the first line's headers; blank cells are null and blank rows go."""
    if not lines:
        return []
    columns = headers(lines[0])
    out = []
    for k, line in enumerate(lines[1:], first_row):
        cells = [{"pos": i, "header": h, "value": (line[i].strip() or None) if i < len(line) and line[i] is not None else None} for i, h in columns]
        if any(c["value"] for c in cells):
            out.append((k, cells))
    return out


def parse(text: str) -> list[tuple[int, list[dict]]]:
    """Rows are numbered as records from the header on; empty lines are no records, records of blank cells count."""
    head = text.lstrip("\r\n").split("\n", 1)[0]
    delimiter = max(DELIMITERS, key=head.count)
    return table_rows([r for r in csv.reader(io.StringIO(text), delimiter=delimiter, skipinitialspace=True) if r])


def read_cells(files: DataFrame) -> DataFrame:
    """``files(path, content)``, as Spark's binaryFile source gives them, to rows of cells."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, 0, "CSV", n, cells) for p, c in zip(b["path"], b["content"], strict=True) for n, cells in parse(decode(bytes(c or b"")))]
            yield pd.DataFrame(out, columns=["doc_id", "table_ix", "sheet_name", "row_number", "cells"])

    return files.select("path", "content").mapInPandas(rows, CELLS)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_cells(spark.read.format("binaryFile").load(path))


def long_cells(rows: DataFrame) -> DataFrame:
    """A row per cell, for header mapping."""
    return rows.select("doc_id", "table_ix", "row_number", F.explode("cells").alias("c")).select("doc_id", "table_ix", "row_number", "c.pos", "c.header", "c.value")
