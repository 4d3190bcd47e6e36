"""Spreadsheets (xlsx) as rows of cells, read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

from lading.sources.delimited import CELLS, headers

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
HEADER_ROWS = 30
# Words of headers that mark a header row.
KNOWN = frozenset("pol pod poe origin origen destination destino carrier naviera currency moneda container contenedor equipment freetime transittime validfrom validto vigencia expiracion effective expiry commodity remarks agente agent".split())


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(raw: bytes) -> list[tuple[str, list[tuple[int, list[str | None]]]]]:
    """Name and numbered rows of each sheet."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    strings = []
    if "xl/sharedStrings.xml" in z.namelist():
        strings = ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", NS)]
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", NS):
        target = targets[s.get(REL)].lstrip("/")
        rows = []
        for r in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{{{NS['m']}}}row"):
            cells: list[str | None] = []
            for c in r.findall("m:c", NS):
                at = _column(c.get("r"))
                cells += [None] * (at + 1 - len(cells))
                v = c.find("m:v", NS)
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
                elif v is not None and v.text is not None:
                    cells[at] = strings[int(v.text)] if c.get("t") == "s" else v.text
            rows.append((int(r.get("r") or len(rows) + 1), cells))
        out.append((s.get("name"), rows))
    return out


def _readable(raw: bytes | None) -> list[tuple[str, list[tuple[int, list[str | None]]]]]:
    """The sheets of a file; a null one, or what is no workbook, has none."""
    try:
        return sheets(bytes(raw or b""))
    except (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError, ValueError, AttributeError):
        return []


def header_row(rows: list[tuple[int, list[str | None]]]) -> int | None:
    """Place of the first row with two known headers, else of the first with three cells."""
    known = lambda cells: sum(re.sub("[^a-z0-9]", "", (c or "").lower()) in KNOWN or bool(re.match(r"^(20|40|45)", (c or "").strip())) for c in cells)
    top = rows[:HEADER_ROWS]
    return next((i for i, (_, c) in enumerate(top) if known(c) >= 2), next((i for i, (_, c) in enumerate(top) if sum(bool((x or "").strip()) for x in c) >= 3), None))


def read_cells(files: DataFrame) -> DataFrame:
    """``files(path, content)`` to rows of cells; sheets without a header row give none, and neither do null contents and files
    that can't be read as a workbook."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                for k, (name, lines) in enumerate(_readable(content)):
                    at = header_row(lines)
                    if at is None:
                        continue
                    columns = headers([c or "" for c in lines[at][1]])
                    for n, line in lines[at + 1 :]:
                        cells = [{"pos": i, "header": h, "value": ((line[i] or "").strip() or None) if i < len(line) else None} for i, h in columns]
                        if any(c["value"] for c in cells):
                            out.append((path, k, name, n, cells))
            yield pd.DataFrame(out, columns=["doc_id", "table_ix", "sheet_name", "row_number", "cells"])

    return files.select("path", "content").mapInPandas(rows, CELLS)
