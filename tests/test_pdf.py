import zipfile
import zlib

import pytest

from folioworks.sources import readers
from folioworks.sources.pdf import pdf_markdown, pdf_text


def make_pdf(pages, compress=True, objects_in_stream=False, extra=(), info="", annots=""):
    """A PDF whose pages hold the given content streams."""
    body, n = [], len(pages)
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(n))
    plain = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count {n} /Resources << /Font << /F1 3 0 R /F2 4 0 R /F3 5 0 R >> >> >>",
             3: "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 4: "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>",
             5: "<< /Type /Font /Subtype /Type0 /BaseFont /X /ToUnicode 6 0 R >>", 7: f"<< {info} >>"}
    for i in range(n):
        plain[10 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R {annots if i == 0 else ''} >>"
    cmap = b"begincmap 1 beginbfchar <0001> <0416> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange endcmap"
    streams = {6: cmap} | {11 + 2 * i: p.encode("cp1252") for i, p in enumerate(pages)}
    if objects_in_stream:
        parts, at = [], []
        for k, v in plain.items():
            at.append(f"{k} {len(' '.join(parts)) + bool(parts)}")
            parts.append(v)
        head = " ".join(at) + " "
        data = zlib.compress((head + " ".join(parts)).encode())
        body.append(f"90 0 obj << /Type /ObjStm /N {len(plain)} /First {len(head)} /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream endobj\n")
    else:
        body += [f"{k} 0 obj\n{v}\nendobj\n".encode() for k, v in plain.items()]
    for k, v in streams.items():
        data = zlib.compress(v) if compress else v
        body.append(f"{k} 0 obj << /Length {len(data)} {'/Filter /FlateDecode' if compress else ''} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n")
    return b"%PDF-1.7\n" + b"".join(body) + b"".join(extra) + b"trailer << /Root 1 0 R /Info 7 0 R >>\n%%EOF"


ONE = "BT /F2 16 Tf 50 700 Td (Incident \\(draft\\)) Tj /F1 10 Tf 0 -20 Td [(host) -300 (k\\351) 20 (y)] TJ 0 -12 Td <68690A> Tj ET"
TWO = "BT /F3 10 Tf 1 0 0 1 50 600 Tm <0001000200030004> Tj ET BT /F1 10 Tf 1 0 0 1 50 580 Tm (last line) Tj T* (more) ' ET"


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("packed", [True, False])
def test_pages(compress, packed):
    text, pages = pdf_text(make_pdf([ONE, TWO], compress, packed))
    assert pages == 2 and text == "Incident (draft)\nhost kéy\nhi\n\nЖabc\nlast line\nmore"


def test_structure_and_details():
    annots = "/Annots [<< /Subtype /Link /A << /URI (https://a.test/x) >> >> << /Subtype /Widget /T (owner) /V (Ann) >> << /Subtype /Text /Contents (check this) >> << /Subtype /Widget /T (e) /V () >>]"
    file = b"95 0 obj << /Type /Filespec /F (a.bin) /EF << /F 96 0 R >> >> endobj 96 0 obj << /Length 3 >>\nstream\nabc\nendstream endobj\n"
    md = pdf_markdown(make_pdf([ONE, TWO], extra=[file], info="/Title (Brief) /Author <FEFF0416> /Subject ()", annots=annots))
    assert md.startswith("### 📋 Document Metadata\n- **Title:** Brief\n- **Author:** Ж\n\n---\n\n### 📎 Embedded File Attachments\n- `a.bin` (3 bytes)\n\n---\n\n<!-- Page 1 -->\n**Incident (draft)**\nhost kéy\nhi")
    assert "**Interactive Form Inputs:**\n- **owner:** Ann\n" in md and "- <https://a.test/x>" in md and "> check this" in md and "<!-- Page 2 -->\nЖabc" in md


def test_broken_files():
    whole = make_pdf([ONE, TWO])
    assert pdf_text(whole.replace(b"/FlateDecode", b"/JBIG2Decode")) == (None, 2)  # pages that can't be read give no text
    for bad in (b"", b"plain text", b"PK\3\4"):
        with pytest.raises(ValueError, match="PDF"):
            pdf_text(bad)
    with pytest.raises(ValueError, match="encrypted"):
        pdf_text(whole.replace(b"/Root", b"/Encrypt 9 0 R /Root"))
    for cut in range(20, len(whole), 37):  # never an endless loop, never another error
        try:
            pdf_text(whole[:cut])
        except ValueError:
            pass


def test_a_folder_of_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make_pdf([ONE, TWO]))
    (tmp_path / "broken.pdf").write_bytes(b"no pdf")
    (tmp_path / "empty.pdf").write_bytes(make_pdf([""]))
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "broken.docx").write_bytes(b"PK")
    (tmp_path / "c.bin").write_bytes(b"x")
    got = {r.name: (r.text, r.page_count, r.paragraph_count, r.char_count, r.error) for r in readers.inspect_documents(readers.read_folder(spark, str(tmp_path))).collect()}
    assert got == {
        "a.pdf": ("Incident (draft)\nhost kéy\nhi\n\nЖabc\nlast line\nmore", 2, None, 49, None), "empty.pdf": (None, 1, None, 0, None),
        "broken.pdf": (None, None, None, None, "PDF file is malformed or unreadable"), "broken.docx": (None, None, None, None, "DOCX file is malformed or unreadable"),
        "b.docx": ("one\n\ntwo", None, 3, 8, None), "c.bin": (None, None, None, None, "no inspector for this file"),
    }
    files = readers.read_folder(spark, str(tmp_path), ("pdf",))
    rich = {r.name: r.t for r in files.select("name", readers.binary_text()("name", "content").alias("t")).collect()}
    assert rich["broken.pdf"] is None and "**Incident (draft)**" in rich["a.pdf"]
