"""Writes small workbooks: inputs of tests and of the workbook queries. Cells are values, or formulas as text from '='."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from typing import Any
from xml.sax.saxutils import escape, quoteattr

from gridspark.grammar import col_letters, parse_a1
from gridspark.model import BLANK, ERROR_TEXT, GridError, to_serial

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _cell(ref: str, v: Any, raw: bool) -> str:
    if raw:
        return v
    if v is BLANK or v is None:
        return f'<c r="{ref}"/>'
    if isinstance(v, str) and v.startswith("="):
        return f'<c r="{ref}"><f>{escape(v[1:])}</f><v>0</v></c>'
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    if isinstance(v, str):
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    if isinstance(v, GridError):
        return f'<c r="{ref}" t="e"><v>{ERROR_TEXT[v.kind]}</v></c>'
    style = 3 if isinstance(v, dt.timedelta) else 2 if isinstance(v, dt.time) else 1
    return f'<c r="{ref}" s="{style}"><v>{to_serial(v)!r}</v></c>'


def workbook(sheets: dict[str, dict[str, Any]], *, names: str = "", calc: str = "", strings: list[str] | None = None, raw: dict[str, dict[str, str]] | None = None) -> bytes:
    """sheets: by name, cells by address. names: XML of definedName elements; calc: a calcPr element; raw: cells as XML."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        n = len(sheets)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets>{f"<definedNames>{names}</definedNames>" if names else ""}{calc}</workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{NS}"><cellXfs>' + "".join(f'<xf numFmtId="{k}"/>' for k in (0, 14, 21, 46)) + "</cellXfs></styleSheet>")
        if strings is not None:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NS}">' + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>")
        for i, (name, cells) in enumerate(sheets.items(), 1):
            rows: dict[int, list[tuple[int, str]]] = {}
            for ref, v in cells.items():
                r, c = parse_a1(ref)
                rows.setdefault(r, []).append((c, _cell(f"{col_letters(c)}{r}", v, False)))
            for ref, xml in (raw or {}).get(name, {}).items():
                r, c = parse_a1(ref)
                rows.setdefault(r, []).append((c, xml))
            body = "".join(f'<row r="{r}">' + "".join(x for _, x in sorted(rows[r])) + "</row>" for r in sorted(rows))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{NS}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
