"""The text of Word and Excel files, by the standard library. Helpers for single files inside tasks."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_paragraphs(data: bytes) -> list[str]:
    """Body paragraphs that aren't blank; tables aren't read."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p") if body is not None else []:
        marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
        text = "".join(n.text or "" if n.tag == f"{_W}t" else marks.get(n.tag, "") for n in p.iter())
        if text.strip():
            out.append(text)
    return out


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_rows(data: bytes) -> list[list[str | None]]:
    """Cells of the first sheet as literal text; a missing cell is None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = ET.fromstring(z.read("xl/workbook.xml")).find(f"{_S}sheets")[0].get(f"{_R}id")
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels if r.get("Id") == sheet).lstrip("/")
        root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    rows: list[list[str | None]] = []
    for row in root.iter(f"{_S}row"):
        cells: dict[int, str] = {}
        for i, c in enumerate(row.findall(f"{_S}c")):
            value, at = c.find(f"{_S}v"), _column(c.get("r") or "") if c.get("r") else i
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
            elif value is not None and value.text is not None:
                cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
        rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def _safe(text: object) -> str:
    """Escaped, without characters that XML can't hold."""
    t = re.sub("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]", "", str(text))
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_xlsx(title: str, rows: list[list]) -> bytes:
    """A workbook with one sheet; numbers stay numbers, None is an empty cell."""
    def cell(v: object) -> str:
        if v is None or v == "":
            return "<c/>"
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{_safe(v)}</t></is></c>'

    data = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    return _zip({
        "[Content_Types].xml": f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{main}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_S[1:-1]}" xmlns:r="{_DOC}"><sheets><sheet name="{_safe(title)[:31]}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_DOC}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_S[1:-1]}"><sheetData>{data}</sheetData></worksheet>',
    })


def write_docx(paragraphs: list[tuple[str, str]]) -> bytes:
    """A document of (style, text) paragraphs."""
    def para(style: str, text: str) -> str:
        kind = f'<w:pPr><w:pStyle w:val="{_safe(style)}"/></w:pPr>' if style else ""
        return f'<w:p>{kind}<w:r><w:t xml:space="preserve">{_safe(text)}</w:t></w:r></w:p>'

    body = "".join(para(s, t) for s, t in paragraphs)
    return _zip({
        "[Content_Types].xml": f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>',
    })
