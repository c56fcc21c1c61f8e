"""Whether a PDF can be opened, has pages, and its first page can be read.

Objects are found by their marks, those of compressed object streams included, and later ones
replace earlier ones, as incremental updates do; offsets in the file aren't relied on, so files
with a broken cross-reference table pass as they do in readers that repair them. The page tree is
followed from the catalog. Of the first page, the content streams have to be there and, if they are
deflated, to inflate. Contents of encrypted files and in other encodings are taken as they are.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd

from .udfs import arrow_function

_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b(.*?)\bendobj\b", re.DOTALL)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")


def _inflated(data: bytes) -> bytes:
    return zlib.decompressobj().decompress(data)


def _number(head: bytes, key: bytes) -> int:
    found = re.search(rb"/" + key + rb"\s+(\d+)", head)
    if not found:
        raise ValueError(f"no {key.decode()}")
    return int(found[1])


def objects(content: bytes) -> dict[int, bytes]:
    """Bodies of the objects by number."""
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
    for body in list(found.values()):
        if re.search(rb"/Type\s*/ObjStm\b", body[:400]) and (m := _STREAM.match(body)):
            inner = _inflated(m[2]) if b"/FlateDecode" in m[1] else m[2]
            first = _number(m[1], b"First")
            numbers = [int(x) for x in inner[:first].split()][: 2 * _number(m[1], b"N")]
            starts = [first + at for at in numbers[1::2]]
            for number, at, end in zip(numbers[::2], starts, [*starts[1:], len(inner)]):
                found.setdefault(number, inner[at:end])
    return found


def _references(body: bytes, key: bytes) -> list[int]:
    """Numbers of the objects that a key refers to, one or a list."""
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R\b)", body)
    return [int(n) for n in _REFERENCE.findall(m[1])] if m else []


def first_page(held: dict[int, bytes]) -> tuple[int, bytes]:
    """Number of pages, and the first one's body."""
    catalog = next((b for b in reversed(held.values()) if re.search(rb"/Type\s*/Catalog\b", b)), None)
    roots = _references(catalog, b"Pages") if catalog else []
    if not roots or roots[0] not in held:
        raise ValueError("no page tree")
    stack, met, pages, first = [roots[0]], set(), 0, b""
    while stack:
        number = stack.pop()
        if number in met or number not in held:
            continue
        met.add(number)
        body = held[number]
        if re.search(rb"/Kids\b", body):
            kids = _references(body, b"Kids")
            stack += reversed(kids)
        elif re.search(rb"/Type\s*/Page\b", body):
            first = body if not pages else first
            pages += 1
    return pages, first


def _readable(held: dict[int, bytes], page: bytes, encrypted: bool) -> bool:
    for number in _references(page, b"Contents"):
        m = _STREAM.match(held.get(number, b""))
        if not m:
            if number in held and re.match(rb"\s*\[", held[number]):
                continue  # a list of streams
            return False
        if b"/FlateDecode" in m[1] and not encrypted:
            try:
                _inflated(m[2])
            except zlib.error:
                return False
    return True


def problem(content: bytes | None) -> str | None:
    """Why a file is rejected; None for one that can be read."""
    if content is None or not content.startswith(b"%PDF-"):
        return "invalid_pdf_signature"
    try:
        held = objects(content)
        pages, page = first_page(held)
        if not pages:
            return "pdf_no_pages"
        return None if _readable(held, page, b"/Encrypt" in content) else "pdf_unreadable"
    except (ValueError, IndexError, zlib.error):
        return "pdf_validation_error"


@arrow_function("string")
def pdf_problem(contents: pd.Series) -> pd.Series:
    return pd.Series([problem(None if c is None else bytes(c)) for c in contents], dtype=object)
