"""Sheets of workbooks (OOXML): a reader over Spark's binary files, and a writer of a workbook a partition.

A workbook is a zip of XML parts. Cells are read one after the other, so memory holds the file, its shared strings and
some thousand rows. Values are text until the schema casts them, by the names in the header row.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the format's parts and namespaces.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
BOOK_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"

ROWS_AT_ONCE = 10_000


def _tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def column_name(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _unescaped(text: str) -> str:
    """Characters that XML can't hold are written as _xHHHH_."""
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, e in ElementTree.iterparse(part):
            if e.tag == _tag("si"):
                # Runs of text, without the phonetic ones.
                out.append(_unescaped("".join(t.text or "" for r in e if r.tag in (_tag("t"), _tag("r")) for t in ([r] if r.tag == _tag("t") else r.findall(_tag("t"))))))
                e.clear()
    return out


def sheet_path(book: zipfile.ZipFile, sheet: str | int) -> str:
    """The part of a sheet by its name or place."""
    sheets = [(e.get("name"), e.get(f"{{{DOCUMENT}}}id")) for e in ElementTree.parse(book.open("xl/workbook.xml")).getroot().iter(_tag("sheet"))]
    if isinstance(sheet, str) and sheet not in dict(sheets):
        raise ValueError(f"no sheet {sheet!r} among {[n for n, _ in sheets]}")
    key = dict(sheets)[sheet] if isinstance(sheet, str) else sheets[sheet][1]
    target = next(e.get("Target") for e in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot() if e.get("Id") == key)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def rows_of(content: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet as text; cells that are not there or hold an error are null, trailing ones are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        with book.open(sheet_path(book, sheet)) as part:
            for _, e in ElementTree.iterparse(part):
                if e.tag != _tag("row"):
                    continue
                row: list[str | None] = []
                for c in e:
                    at = column_number(c.get("r")) if c.get("r") else len(row)
                    row += [None] * (at + 1 - len(row))
                    kind, v = c.get("t", "n"), c.find(_tag("v"))
                    if kind == "inlineStr":
                        row[at] = _unescaped("".join(t.text or "" for t in c.iter(_tag("t"))))
                    elif v is None or v.text is None or kind == "e":
                        row[at] = "" if kind == "str" and v is not None else None
                    elif kind == "s":
                        row[at] = shared[int(v.text)]
                    elif kind == "b":
                        row[at] = "true" if v.text == "1" else "false"
                    else:
                        row[at] = _unescaped(v.text) if kind == "str" else v.text
                yield row
                e.clear()


def read_sheets(spark: SparkSession, path: str, schema: str, sheet: str | int = 0, pattern: str = "*.xlsx") -> DataFrame:
    """The rows below the header of a sheet of each workbook under a path, in columns of the schema by their names in the header.
    A column that a sheet lacks is null, and so is a value that isn't of its type; other columns are ignored. Whole numbers may be written as 3.0."""
    fields = T.StructType.fromDDL(schema).fields
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                rows = rows_of(content, sheet)
                places = {n: i for i, n in reversed(list(enumerate(next(rows, []))))}
                held: list[list] = [[] for _ in names]
                for row in rows:
                    for out, n in zip(held, names):
                        i = places.get(n)
                        out.append(row[i] if i is not None and i < len(row) else None)
                    if len(held[0]) >= ROWS_AT_ONCE:
                        yield _table(held, names)
                        held = [[] for _ in names]
                yield _table(held, names)

    def _table(held: list[list], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array(v, pa.string()) for n, v in zip(names, held)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("content")
    text = files.mapInArrow(run, ", ".join(f"`{n}` string" for n in names))

    def typed(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType):
            # Exact where the text is whole; 3.0 and 1E3 go through a number.
            return F.coalesce(c.try_cast(f.dataType), F.when(c.try_cast("double") % 1 == 0, c.try_cast("double").try_cast(f.dataType))).alias(f.name)
        return c.try_cast(f.dataType).alias(f.name)

    return text.select(*(typed(f) for f in fields))


def _cell(at: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    # Line ends and what XML can't hold are written as numbers, and so is what looks like one.
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", str(value))
    text = re.sub("[\x00-\x08\x0b-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text)
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def workbook_bytes(names: list[str], rows: Iterator[tuple], sheet: str = "Sheet1") -> tuple[bytes, int]:
    """(a workbook of one sheet with a header, its rows). Rows go into the zip as they come."""
    out = io.BytesIO()
    n = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{BOOK_TYPE}"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{SHEET_TYPE}"/></Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{RELATIONS}"><Relationship Id="rId1" Type="{DOCUMENT}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{DOCUMENT}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{RELATIONS}"><Relationship Id="rId1" Type="{DOCUMENT}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with book.open("xl/worksheets/sheet1.xml", "w") as part:
            part.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            for n, row in enumerate(_with_header(names, rows)):
                cells = "".join(_cell(f"{column_name(i)}{n + 1}", v) for i, v in enumerate(row))
                part.write(f'<row r="{n + 1}">{cells}</row>'.encode("utf-8", "replace"))
            part.write(b"</sheetData></worksheet>")
    return out.getvalue(), n


def _with_header(names: list[str], rows: Iterator[tuple]) -> Iterator[tuple]:
    yield tuple(names)
    yield from rows


def write_sheets(df: DataFrame, path: str, sheet: str = "Sheet1", most: int = 1_000_000) -> DataFrame:
    """Writes each partition as workbooks of at most `most` rows into a folder that the executors share, and returns file and rows of each.

    A workbook is written under a hidden name and then renamed, so no half-written one is ever read. Its name is of the partition and its place, so a task that is repeated
    replaces what it wrote before. Values other than numbers and booleans are text; nulls are missing cells."""
    names = df.columns
    plain = (T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType, T.StringType)
    rows = df.select(*(F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else F.col(f"`{f.name}`").cast("string") for f in df.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        system.create_dir(root, recursive=True)
        stream = (tuple(c[i] for c in columns) for b in batches for columns in [[c.to_pylist() for c in b.columns]] for i in range(b.num_rows))
        first = next(stream, None)
        k = 0
        while first is not None:
            taken = [first]

            def part(n: int = most) -> Iterator[tuple]:
                yield taken.pop()
                for _ in range(n - 1):
                    row = next(stream, None)
                    if row is None:
                        return
                    yield row

            data, n = workbook_bytes(names, part(), sheet)
            name = f"part-{TaskContext.get().partitionId():05d}-{k:03d}.xlsx"
            hidden = f"{root}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as out:
                out.write(data)
            system.move(hidden, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": pa.array([name]), "rows": pa.array([n], pa.int64())})
            first, k = next(stream, None), k + 1

    done = rows.mapInArrow(run, "file string, rows long").collect()
    return df.sparkSession.createDataFrame(done, "file string, rows long")
