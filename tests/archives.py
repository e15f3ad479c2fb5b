"""Writes small archives in the layouts that the readers expect."""

import bz2
import struct
from pathlib import Path


def write_articles(path: Path, lang: str, articles: list[tuple[str, str]], version: int = 1, image_ns: str = "", template_ns: str = "") -> None:
    """Bodies two to a block; titles in the given order, the second index in reverse."""
    path.parent.mkdir(parents=True, exist_ok=True)
    out = bytearray(256)
    records = []
    for at in range(0, len(articles), 2):
        begin, block = len(out), b""
        for title, body in articles[at : at + 2]:
            raw = body.encode()
            records.append((title, begin, len(block), len(raw)))
            block += raw
        out += bz2.compress(block)
    titles_pos, offsets = len(out), []
    for title, begin, pos, length in records:
        offsets.append(len(out) - titles_pos)
        out += struct.pack("<qii", begin, pos, length) + title.encode() + b"\0"
    first = len(out)
    out += struct.pack(f"<{len(offsets)}i", *offsets)
    second = len(out)
    out += struct.pack(f"<{len(offsets)}i", *offsets[::-1])
    out[:256] = struct.pack("<2sIqqqBc32s32s160s", lang.encode(), len(records), titles_pos, first, second, version, b"\0", image_ns.encode(), template_ns.encode(), b"")
    path.write_bytes(out)


def write_images(path: Path, lang: str, images: list[tuple[str, bytes]]) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    out, places = bytearray(32), []
    for _, data in images:
        places.append((len(out), len(data)))
        out += data
    titles_pos, offsets = len(out), []
    for (name, _), place in zip(images, places):
        offsets.append(len(out) - titles_pos)
        out += struct.pack("<qI", *place) + name.encode() + b"\0"
    index = len(out)
    out += struct.pack(f"<{len(offsets)}i", *offsets)
    out[:32] = struct.pack("<2sIqq10s", lang.encode(), len(images), titles_pos, index, b"")
    path.write_bytes(out)
