"""Bytes of pages to text."""

from __future__ import annotations

import codecs
import re

_HEADER = re.compile(r"(?i);\s*charset\s*=\s*[\"']?([^;\"'\s]+)")
_META = re.compile(rb"(?is)<meta\b[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.\-]+)")
#: Labels that the web's encodings share with stricter ones of Python.
ALIASES = {"iso-8859-1": "windows-1252", "latin1": "windows-1252", "ascii": "windows-1252", "us-ascii": "windows-1252", "shift_jis": "cp932", "gb2312": "gb18030", "gbk": "gb18030", "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "x-sjis": "cp932", "iso-8859-9": "windows-1254"}
PRESCAN = 1024


def _codec(label: str) -> str | None:
    label = label.strip().lower()
    try:
        return codecs.lookup(ALIASES.get(label, label)).name
    except LookupError:
        return None


def header_charset(content_type: str | None) -> str | None:
    """The charset that a Content-Type header names."""
    found = _HEADER.search(content_type or "")
    return _codec(found[1]) if found else None


def meta_charset(body: bytes) -> str | None:
    """The charset declared within the first bytes; UTF-16 can't be declared this way and means UTF-8."""
    found = _META.search(re.sub(rb"(?s)<!--.*?-->", b"", body[:PRESCAN]))
    name = _codec(found[1].decode("ascii")) if found else None
    return "utf-8" if name and name.startswith("utf-16") else name


def decode_html(body: bytes, content_type: str | None = None) -> str:
    """Text of a page: by byte order mark, header, being UTF-8, declaration, or as windows-1252; bad bytes become U+FFFD."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    if name := header_charset(content_type):
        return body.decode(name, "replace")
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode(meta_charset(body) or "windows-1252", "replace")
