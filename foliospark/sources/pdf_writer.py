"""Small paged documents from placed texts: what the reader is checked against, and a sink for fragments.

A file is written front to back and holds one page at a time; fonts carry a map
from their codes to characters, so any text comes back as it was.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field


@dataclass
class Text:
    text: str
    x: float
    y: float
    size: float = 10.0
    font: str = "Helvetica"
    mcid: int | None = None
    tag: str | None = None


@dataclass
class Page:
    texts: list[Text] = field(default_factory=list)
    width: float = 595.0
    height: float = 842.0
    links: list[tuple[tuple[float, float, float, float], str]] = field(default_factory=list)


def _number(v: float) -> str:
    return f"{v:.6f}".rstrip("0").rstrip(".")


def _string(s: str) -> bytes:
    """A text string: ASCII as it is, else UTF-16 behind its mark."""
    b = s.encode("ascii") if s.isascii() else b"\xfe\xff" + s.encode("utf-16-be", "replace")
    return b"<" + b.hex().encode() + b">"


def _name(s: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if 33 <= c < 127 and c not in b"#()<>[]{}/%" else b"#%02x" % c for c in s.encode())


def _content(page: Page, fonts: dict[str, int], codes: dict[str, int]) -> bytes:
    out = []
    for t in page.texts:
        font = fonts.setdefault(t.font, len(fonts))
        shown = "".join(f"{codes.setdefault(c, len(codes) + 1):04x}" for c in t.text)
        show = f"BT /F{font} {_number(t.size)} Tf 1 0 0 1 {_number(t.x)} {_number(t.y)} Tm <{shown}> Tj ET"
        if t.tag or t.mcid is not None:
            mark = b"BDC" if t.mcid is not None else b"BMC"
            info = b" << /MCID %d >>" % t.mcid if t.mcid is not None else b""
            out.append(_name(t.tag or "Span") + info + b" " + mark + b" " + show.encode() + b" EMC")
        else:
            out.append(show.encode())
    return b"\n".join(out)


def _to_unicode(codes: dict[str, int]) -> bytes:
    rows = [f"<{n:04x}> <{c.encode('utf-16-be', 'surrogatepass').hex()}>" for c, n in codes.items()]
    return "\n".join(f"{len(rows[i : i + 100])} beginbfchar {' '.join(rows[i : i + 100])} endbfchar" for i in range(0, len(rows), 100)).encode()


def write(pages: Iterable[Page], info: dict[str, str] | None = None, compress: bool = True) -> bytes:
    """The file of the pages, in memory."""
    return b"".join(stream(pages, info, compress))


def stream(pages: Iterable[Page], info: dict[str, str] | None = None, compress: bool = True) -> Iterator[bytes]:
    """The file in parts, as the pages come: objects first, then the page tree, the table of places and the trailer."""
    places: dict[int, int] = {}
    at = 0
    fonts: dict[str, int] = {}
    codes: dict[str, int] = {}
    # numbers known from the start: 1 catalogue, 2 page tree, 3 resources, 4 information
    number, kids = 5, []

    def part(b: bytes) -> bytes:
        nonlocal at
        at += len(b)
        return b

    def obj(n: int, body: bytes) -> bytes:
        places[n] = at
        return part(b"%d 0 obj " % n + body + b" endobj\n")

    def stream_object(n: int, data: bytes) -> bytes:
        data, kind = (zlib.compress(data), b"/Filter /FlateDecode ") if compress else (data, b"")
        return obj(n, b"<< " + kind + b"/Length %d >> stream\n" % len(data) + data + b"\nendstream")

    yield part(b"%PDF-1.7\n")
    for p in pages:
        content, page = number, number + 1
        number += 2
        yield stream_object(content, _content(p, fonts, codes))
        links = []
        for box, uri in p.links:
            rect = " ".join(map(_number, box)).encode()
            yield obj(number, b"<< /Type /Annot /Subtype /Link /Rect [" + rect + b"] /A << /S /URI /URI " + _string(uri) + b" >> >>")
            links.append(b"%d 0 R" % number)
            number += 1
        annots = b"/Annots [" + b" ".join(links) + b"] " if links else b""
        yield obj(page, b"<< /Type /Page /Parent 2 0 R /Resources 3 0 R " + annots + f"/MediaBox [0 0 {_number(p.width)} {_number(p.height)}] /Contents {content} 0 R >>".encode())
        kids.append(b"%d 0 R" % page)
    names = []
    unicode = number
    yield stream_object(unicode, _to_unicode(codes))
    number += 1
    for f, i in fonts.items():
        yield obj(number, b"<< /Type /Font /Subtype /Type0 /BaseFont " + _name(f) + b" /Encoding /Identity-H /ToUnicode %d 0 R >>" % unicode)
        names.append(b"/F%d %d 0 R" % (i, number))
        number += 1
    yield obj(3, b"<< /Font << " + b" ".join(names) + b" >> >>")
    yield obj(2, b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(kids))
    yield obj(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    yield obj(4, b"<< " + b" ".join(_name(k) + b" " + _string(v) for k, v in (info or {}).items()) + b" >>")
    start = at
    table = [b"0000000000 65535 f \n", *(b"%010d 00000 n \n" % places[i] for i in range(1, number))]
    yield part(b"xref\n0 %d\n" % number + b"".join(table) + b"trailer << /Size %d /Root 1 0 R /Info 4 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (number, start))
