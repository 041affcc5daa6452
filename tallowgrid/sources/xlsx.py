"""A data source for .xlsx workbooks, on the standard library: sheets of plain cells.

``spark.dataSource.register(XlsxSource)``, then ``spark.read.format("tallowgrid_xlsx")`` with a schema
and the options ``path`` (of any store that Arrow opens) and ``sheet`` (1 by default); ``write_xlsx`` makes a workbook of one sheet. A
sheet is one partition: the format is a compressed stream and can't be split.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, StructType

from tallowgrid.sources.files import open_file

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REF = re.compile(r"([A-Z]+)\d+")


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def read_cells(content: bytes, sheet: int = 1):
    """Rows of a sheet as dicts of column number to text; empty cells are absent."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in root.findall("m:si", _NS)]
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
            for _, row in ElementTree.iterparse(f):
                if not row.tag.endswith("}row"):
                    continue
                cells = {}
                for i, c in enumerate(row.findall("m:c", _NS)):
                    ref = _REF.fullmatch(c.get("r", ""))
                    at = column_number(ref[1]) if ref else i
                    kind, v = c.get("t"), c.find("m:v", _NS)
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif v is not None and v.text is not None:
                        cells[at] = shared[int(v.text)] if kind == "s" else v.text
                yield cells
                row.clear()


def write_xlsx(df: DataFrame, most: int = 1_048_575) -> bytes:
    """A workbook of a small table: a sheet holds at most ``most`` rows, and more is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("more rows than a sheet holds")

    def cell(r: int, c: int, v) -> str:
        ref = f'r="{column_letters(c)}{r}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {ref} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c {ref}><v>{v!r}</v></c>"
        return f'<c {ref} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(values)) + "</row>" for r, values in enumerate([df.columns, *rows], 1))
    ns, rel = _NS["m"], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


class XlsxReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.sheet = schema, options.get("path"), int(options.get("sheet", 1))
        if not self.path:
            raise ValueError("the option path is missing")

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        with open_file(self.path) as f:
            rows = read_cells(f.read(), self.sheet)
        head = {name: at for at, name in next(rows, {}).items()}

        def value(text, kind):
            if text is None:
                return None
            if isinstance(kind, (DoubleType, FloatType)):
                return float(text)
            if isinstance(kind, (IntegerType, LongType)):
                return int(float(text)) if "." in text or "e" in text.lower() else int(text)
            return text in ("1", "true", "TRUE") if isinstance(kind, BooleanType) else text

        for cells in rows:
            yield tuple(value(cells.get(head.get(f.name, -1)), f.dataType) for f in self.schema)


class XlsxSource(DataSource):
    @classmethod
    def name(cls):
        return "tallowgrid_xlsx"

    def schema(self):
        raise ValueError("give a schema: types are not inferred")

    def reader(self, schema):
        return XlsxReader(schema, self.options)
