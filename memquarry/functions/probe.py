"""Whether a picture's own metadata says that it is a screenshot: the texts of PNG chunks
and the comment of an EXIF block. Binary layouts are walked by an Arrow-batched UDF over
the first bytes of each file; anything malformed says nothing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes read, the first bytes of a PNG, and the EXIF tags of the block of details and of the comment.
BYTES, PNG, DETAILS, COMMENT, WORD = 256 * 1024, b"\x89PNG\r\n\x1a\n", 0x8769, 0x9286, "screenshot"
_sizes = {3: 2, 4: 4, 5: 8, 10: 8}


def exif_comment(tiff: bytes) -> Iterator[str]:
    order = {b"II": "<", b"MM": ">"}[tiff[:2]]

    def entry(at: int, wanted: int) -> tuple[int, int, int] | None:
        """(type, count, value) of a tag in the directory at a place."""
        (n,) = struct.unpack_from(order + "H", tiff, at)
        rows = (struct.unpack_from(order + "HHII", tiff, at + 2 + 12 * i) for i in range(n))
        return next((r[1:] for r in rows if r[0] == wanted), None)

    details = entry(8, DETAILS)
    comment = entry(details[2], COMMENT) if details and details[0] == 4 else None
    if comment:
        size = _sizes.get(comment[0], 1) * comment[1]
        value = tiff[comment[2] : comment[2] + size]
        if len(value) == size >= 8:
            wide = value.startswith(b"UNICODE")
            yield value[8 : 8 + (size - 8) // 2 * 2].decode("utf-16-le" if order == "<" else "utf-16-be", "replace") if wide else value[8:].decode("latin-1")


def png_texts(data: bytes) -> Iterator[str]:
    at = len(PNG)
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            return
        key, _, rest = body.partition(b"\0")
        try:
            if kind == b"tEXt":
                yield from (key.decode("latin-1"), rest.decode("latin-1"))
            elif kind == b"zTXt":
                yield from (key.decode("latin-1"), zlib.decompress(rest[1:]).decode("utf-8", "replace"))
            elif kind == b"iTXt":
                text = rest[2:].split(b"\0", 2)[2]
                yield from (key.decode("latin-1"), (zlib.decompress(text) if rest[:1] == b"\1" else text).decode("utf-8", "replace"))
            elif kind == b"eXIf":
                yield from exif_comment(body)
        except (ValueError, KeyError, IndexError, zlib.error, struct.error):
            pass
        at += 12 + size


def jpeg_texts(data: bytes) -> Iterator[str]:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        if data[at + 1] == 1 or 0xD0 <= data[at + 1] <= 0xD9:  # marks without a length
            at += 2
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        if size < 2:
            return
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            yield from exif_comment(data[at + 10 : at + 2 + size])
        at += 2 + size


def says_screenshot(data: bytes | None) -> bool:
    data = bytes(data or b"")
    texts = png_texts(data) if data.startswith(PNG) else jpeg_texts(data) if data.startswith(b"\xff\xd8\xff") else ()
    try:
        return any(WORD in t.replace("\0", "").lower() for t in texts)
    except (KeyError, struct.error):
        return False


def _says(content: pd.Series) -> pd.Series:
    return content.map(says_screenshot)


def screenshot_hint(content: Column) -> Column:
    return F.pandas_udf(_says, "boolean")(F.substring(content, 1, BYTES))
