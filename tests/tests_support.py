"""Office files for tests."""

import io
import zipfile

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def paragraph(text, style=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def docx():
    table = f"<w:tbl><w:tr><w:tc>{paragraph('a|b')}</w:tc><w:tc>{paragraph('c')}</w:tc></w:tr><w:tr><w:tc>{paragraph('1')}</w:tc></w:tr></w:tbl>"
    body = paragraph("Acta", "Heading1") + paragraph("uno", "ListBullet") + paragraph("dos", "ListBullet") + paragraph("tres", "ListNumber") + table + paragraph("fin")
    return packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def xlsx():
    cells = '<row r="2"><c r="A2" t="inlineStr"><is><t> x </t></is></c><c r="C2"><v>2.0</v></c></row><row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3"><v>0.1234567</v></c></row><row r="4"/>'
    return packed({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Hoja1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{cells}</sheetData></worksheet>",
    })
