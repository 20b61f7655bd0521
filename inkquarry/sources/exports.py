"""Files that Spark has no writer for: workbooks, PNG images, and binary files written by the tasks."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sheet's name has at most 31 characters.
SHEET_NAME = 31
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
MAIN, RELATIONS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
WORKBOOK_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def sheet_names(names: list[str]) -> list[str]:
    """At most 31 characters each, without those a sheet's name can't have; a number tells equal ones apart."""
    found: list[str] = []
    for name in names:
        base = "".join("_" if c in "[]:*?/\\" else c for c in name) or "sheet"
        short, k = base[:SHEET_NAME], 1
        while short.lower() in (x.lower() for x in found):
            k += 1
            short = f"{base[: SHEET_NAME - len(str(k)) - 1]}_{k}"
        found.append(short)
    return found


def _sheet(rows: list[list]) -> str:
    def cell(v) -> str:
        if v is None:
            return "<c/>"
        return f'<c t="n"><v>{v!r}</v></c>' if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    return f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>{"".join(f"<row>{"".join(map(cell, r))}</row>" for r in rows)}</sheetData></worksheet>'


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """An .xlsx file of named sheets of rows; without any, one empty sheet."""
    sheets = sheets or {"empty": []}
    names, n = sheet_names(list(sheets)), range(1, len(sheets) + 1)
    parts = {
        "[Content_Types].xml": f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{WORKBOOK_TYPE}.sheet.main+xml"/>{"".join(f"<Override PartName={quoteattr(f'/xl/worksheets/sheet{k}.xml')} ContentType={quoteattr(f'{WORKBOOK_TYPE}.worksheet+xml')}/>" for k in n)}</Types>',
        "_rels/.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>{"".join(f"<sheet name={quoteattr(name)} sheetId={quoteattr(str(k))} r:id={quoteattr(f'r{k}')}/>" for k, name in zip(n, names))}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{"".join(f"<Relationship Id={quoteattr(f'r{k}')} Type={quoteattr(f'{RELATIONS}/worksheet')} Target={quoteattr(f'worksheets/sheet{k}.xml')}/>" for k in n)}</Relationships>',
    } | {f"xl/worksheets/sheet{k}.xml": _sheet(rows) for k, rows in zip(n, sheets.values())}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of height x width x 3 pixels in the order blue, green, red."""
    height, width, _ = pixels.shape
    rows = np.zeros((height, 1 + 3 * width), dtype=np.uint8)
    rows[:, 1:] = pixels[:, :, ::-1].reshape(height, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def write_files(files: DataFrame, folder: str) -> int:
    """Writes each row's content under its name below a folder that all tasks reach (any file system that Arrow knows); the number of files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as afs

        fs, root = afs.FileSystem.from_uri(folder) if "://" in folder else (afs.LocalFileSystem(), folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{root.rstrip('/')}/{name}"
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    done = files.where("content is not null").select("name", "content").mapInArrow(write, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
