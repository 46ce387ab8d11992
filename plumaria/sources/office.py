"""Word and Excel files as rows of typed blocks, from their own XML: one row for each file, errors as rows too.

Blocks: type heading, paragraph, list or table; text and level; items and ordered; rows of cells. Files come from `binaryFile`, so any store that Spark reads
will do. PDF pages enter as the span and word tables of `operators.layout`; reading these from bytes needs a PDF library or a text recogniser, which are not part of this package.
"""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumaria.functions.text import HEADING_STYLE, STYLES

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Rows kept of a sheet, names that make no heading of their own, built-in date formats of Excel.
MOST_ROWS, GENERIC, DATE_FORMATS = 5000, {"sheet", "sheet1", "hoja", "hoja1", "libro1"}, {*range(14, 23), *range(45, 48)}
BLOCK = "struct<type:string,text:string,level:int,items:array<string>,ordered:boolean,rows:array<array<string>>>"
SCHEMA = f"source string, status string, error string, title string, author string, sheets int, warnings array<string>, blocks array<{BLOCK}>"


def block(kind: str, text: str | None = None, level: int | None = None, items: list[str] | None = None, ordered: bool | None = None, rows: list[list[str]] | None = None) -> dict:
    return {"type": kind, "text": text, "level": level, "items": items, "ordered": ordered, "rows": rows}


def _core(z: zipfile.ZipFile) -> dict:
    if "docProps/core.xml" not in z.namelist():
        return {}
    return {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in ElementTree.fromstring(z.read("docProps/core.xml"))}


def _style_level(name: str) -> int | None:
    name = name.strip().lower()
    if number := re.match(HEADING_STYLE, name):
        return sorted((1, int(number[1]), 6))[1]
    return STYLES.get(name)


def _list_kind(name: str, numbered: bool) -> str | None:
    s = name.lower()
    for kind, marks in (("ordered", ("number", "número", "numero")), ("bullet", ("bullet", "viñeta", "vineta", "list"))):
        if any(m in s for m in marks):
            return kind
    return "bullet" if numbered else None


def _said(node) -> str:
    ends = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    return "".join(e.text or "" if e.tag == f"{W}t" else ends.get(e.tag, "") for e in node.iter())


def docx_blocks(data: bytes) -> dict:
    """The body in its true order; list items that follow each other make one list while their kind stays."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        core, names = _core(z), {}
        if "word/styles.xml" in z.namelist():
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                named = style.find(f"{W}name")
                names[style.get(f"{W}styleId")] = "" if named is None else named.get(f"{W}val", "")
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    out: list[dict] = []
    for node in body:
        if node.tag == f"{W}tbl":
            rows = [[re.sub(r"\s+", " ", "\n".join(_said(p) for p in cell.iter(f"{W}p"))).strip() for cell in row.findall(f"{W}tc")] for row in node.findall(f"{W}tr")]
            if any(any(r) for r in rows):
                out.append(block("table", rows=rows))
        elif node.tag == f"{W}p":
            text = _said(node).strip()
            style, numbered = node.find(f"{W}pPr/{W}pStyle"), node.find(f"{W}pPr/{W}numPr") is not None
            name = "" if style is None else names.get(style.get(f"{W}val"), style.get(f"{W}val", ""))
            if not text:
                continue
            if level := _style_level(name):
                out.append(block("heading", text, level))
            elif kind := _list_kind(name, numbered):
                if out and out[-1]["type"] == "list" and out[-1]["ordered"] == (kind == "ordered"):
                    out[-1]["items"].append(text)
                else:
                    out.append(block("list", items=[text], ordered=kind == "ordered"))
            else:
                out.append(block("paragraph", text))
    return {"title": core.get("title"), "author": core.get("creator"), "sheets": None, "warnings": [], "blocks": out}


def trimmed(rows: list[list[str]]) -> list[list[str]]:
    """Without empty columns at the right and empty rows at the ends."""
    width = max((j + 1 for r in rows for j, c in enumerate(r) if c), default=0)
    held = [i for i, r in enumerate(rows) if any(r)]
    return [(r + [""] * width)[:width] for r in rows[held[0] : held[-1] + 1]] if held else []


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def xlsx_blocks(data: bytes, most: int | None = MOST_ROWS) -> dict:
    """A table for each sheet, under its name where there are several or the name says something; `most` rows of a sheet, or all."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        core, files = _core(z), set(z.namelist())
        strings = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")] if "xl/sharedStrings.xml" in files else []
        dates: list[bool] = []
        if "xl/styles.xml" in files:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{S}numFmt") if re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
            xfs = styles.find(f"{S}cellXfs")
            dates = [int(x.get("numFmtId", 0)) in own | DATE_FORMATS for x in (xfs if xfs is not None else ())]
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(f"{R}id")]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet")]

        def shown(c) -> str:
            """The cell as text, by the kind that its XML states: numbers with six digits, dates in ISO form without a midnight."""
            kind, raw = c.get("t", "n"), c.findtext(f"{S}v") or ""
            if kind == "inlineStr":
                raw = "".join(t.text or "" for t in c.iter(f"{S}t"))
            elif raw and kind == "s":
                raw = strings[int(raw)]
            elif raw and kind == "b":
                raw = "Sí" if raw == "1" else "No"
            elif raw and kind == "n":
                x, style = float(raw), int(c.get("s", 0))
                if style < len(dates) and dates[style]:
                    raw = (datetime(1899, 12, 30) + timedelta(seconds=round(x * 86400))).isoformat().removesuffix("T00:00:00")
                else:
                    raw = f"{x:.0f}" if x == round(x) else f"{x:g}"
            return raw.strip()

        blocks, warnings = [], []
        for name, file in sheets:
            rows: list[list[str]] = []
            for _, row in ElementTree.iterparse(z.open(f"xl/{file}")):
                if row.tag != f"{S}row":
                    continue
                at = int(row.get("r", len(rows) + 1)) - 1
                if most is not None and at >= most:
                    warnings.append(f"{name}: {most} rows kept")
                    break
                cells: dict[int, str] = {}
                for c in row.findall(f"{S}c"):
                    cells[_column(c.get("r", "")) if c.get("r") else len(cells)] = shown(c)
                rows += [[] for _ in range(at - len(rows))]
                rows.append([cells.get(j, "") for j in range(max(cells, default=-1) + 1)])
                row.clear()
            if rows := trimmed(rows):
                if len(sheets) > 1 or name.lower() not in GENERIC:
                    blocks.append(block("heading", name, 2))
                blocks.append(block("table", rows=rows))
        if not blocks:
            blocks, warnings = [block("paragraph", "The workbook has no data.")], [*warnings, "empty workbook"]
    return {"title": core.get("title"), "author": core.get("creator"), "sheets": len(sheets), "warnings": warnings, "blocks": blocks}


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of the documents under a folder; `~$` files of Office are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{pdf,docx,xlsx,doc,xls,PDF,DOCX,XLSX}").load(path)
    return files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))


def office_documents(files: DataFrame, most: int | None = MOST_ROWS) -> DataFrame:
    """A row for each of files (path, content). status: ok, or failed with what was wrong; old and other formats fail. most: rows kept of a sheet, None for all."""
    readers = {".docx": docx_blocks, ".xlsx": lambda data: xlsx_blocks(data, most)}

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                row = {"source": path, "status": "failed", "error": None, "title": None, "author": None, "sheets": None, "warnings": [], "blocks": []}
                ending = re.search(r"\.\w+$|$", path.lower())[0]
                try:
                    if ending in (".doc", ".xls"):
                        raise ValueError(f"old format: save it again as {ending}x")
                    if ending not in readers:
                        raise ValueError(f"no reader for {ending or 'files without an ending'}")
                    row |= readers[ending](data.as_py()) | {"status": "ok"}
                except Exception as e:  # one bad file must not end the others
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    return files.select("path", "content").mapInArrow(read, SCHEMA)
