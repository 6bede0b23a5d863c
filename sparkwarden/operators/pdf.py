"""A report as PDF: plain pages of text, written without any library."""

from __future__ import annotations

import textwrap
import zlib

WIDTH, HEIGHT, MARGIN, SIZE, LEADING = 595, 842, 56, 10, 14


def _escaped(line: str) -> bytes:
    return line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def _page(lines: list[str], title: str | None) -> bytes:
    out = [b"BT /F1 %d Tf %d TL %d %d Td" % (SIZE, LEADING, MARGIN, HEIGHT - MARGIN)]
    if title:
        out.append(b"/F2 14 Tf (%s) Tj T* T* /F1 %d Tf" % (_escaped(title), SIZE))
    out += [b"(%s) Tj T*" % _escaped(line) for line in lines]
    return b"\n".join([*out, b"ET"])


def document(text: str, title: str = "Moderation report") -> bytes:
    """``text`` on as many A4 pages as it takes, in a fixed-width font; characters beyond Windows' Latin are shown as ``?``."""
    wide = int((WIDTH - 2 * MARGIN) / (SIZE * 0.6))
    lines = [part for line in text.split("\n") for part in textwrap.wrap(line, wide, drop_whitespace=False, replace_whitespace=False) or [""]]
    most = (HEIGHT - 2 * MARGIN) // LEADING - 2
    pages = [lines[lo : lo + most] for lo in range(0, len(lines), most)]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding /WinAnsiEncoding >>"]
    kids = []
    for i, own in enumerate(pages):
        body = zlib.compress(_page(own, title if i == 0 else None))
        kids.append(b"%d 0 R" % (len(objects) + 1))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents %d 0 R >>" % (WIDTH, HEIGHT, len(objects) + 2))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    out, at = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % x for x in at)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
