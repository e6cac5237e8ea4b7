"""What photo files say of themselves: the orientation of JPEG and TIFF files, and the preview pictures inside raw files.

All functions take read(at, n), which gives up to n bytes from a place of the file, and look at few of them.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

Read = Callable[[int, int], bytes]

# TIFF tags, the sizes of TIFF's number types, and the second word of TIFF-like headers (plain, and of two raw families).
COMPRESSION, STRIPS, ORIENTATION, STRIP_SIZES, SUB_FILES, JPEG_AT, JPEG_SIZE, JPEG_INSIDE = 0x103, 0x111, 0x112, 0x117, 0x14A, 0x201, 0x202, 0x2E
SIZES = {1: 1, 3: 2, 4: 4, 7: 1, 13: 4}
MAGIC = (42, 0x4F52, 0x5352, 0x55)
FUJI = b"FUJIFILMCCD-RAW"
#: Directories of a file that are looked at, and bytes of a JPEG's head.
MOST_DIRECTORIES, HEAD = 64, 1 << 18


def _directory(read: Read, order: str, at: int) -> tuple[dict[int, tuple[int, int, int]], int]:
    """Entries of the TIFF directory at a place, tag -> (type, count, place of the value), and the next directory's place."""
    n = struct.unpack(order + "H", read(at, 2))[0]
    raw, sizes = read(at + 2, 12 * n + 4), {}
    for k in range(n):
        tag, kind, count = struct.unpack(order + "HHI", raw[12 * k : 12 * k + 8])
        inside = SIZES.get(kind, 8) * count <= 4
        place = at + 2 + 12 * k + 8
        sizes[tag] = (kind, count, place if inside else struct.unpack(order + "I", raw[12 * k + 8 : 12 * k + 12])[0])
    return sizes, struct.unpack(order + "I", raw[12 * n : 12 * n + 4])[0] if len(raw) >= 12 * n + 4 else 0


def _numbers(read: Read, order: str, entry: tuple[int, int, int] | None) -> list[int]:
    if entry is None or entry[0] not in (1, 3, 4, 13) or entry[1] > 4096:
        return []
    kind, count, at = entry
    return list(struct.unpack(order + {1: "B", 3: "H", 4: "I", 13: "I"}[kind] * count, read(at, SIZES[kind] * count)))


def tiff_directories(read: Read) -> Iterator[tuple[str, dict[int, tuple[int, int, int]]]]:
    """(byte order, entries) of the directories of a TIFF-like file, those inside others included; nothing if it is no such file."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8 or struct.unpack(order + "H", head[2:4])[0] not in MAGIC:
        return
    waiting, seen = [struct.unpack(order + "I", head[4:8])[0]], set()
    while waiting and len(seen) < MOST_DIRECTORIES:
        at = waiting.pop(0)
        if at <= 0 or at in seen:
            continue
        seen.add(at)
        try:
            entries, following = _directory(read, order, at)
            inner = _numbers(read, order, entries.get(SUB_FILES))
        except struct.error:  # it reaches over the file's end
            continue
        yield order, entries
        waiting += [following, *inner]


def jpeg_size(read: Read, at: int = 0) -> tuple[int, int] | None:
    """Width and height of the JPEG at a place; None if there is none, or one of the lossless kind that holds sensor data."""
    if read(at, 2) != b"\xff\xd8":
        return None
    at += 2
    for _ in range(256):
        head = read(at, 9)
        if len(head) < 4 or head[0] != 0xFF:
            return None
        kind, size = head[1], struct.unpack(">H", head[2:4])[0]
        if kind in (0xC0, 0xC1, 0xC2) and len(head) == 9:
            height, width = struct.unpack(">HH", head[5:9])
            return width, height
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) or kind in (0xD9, 0xDA):
            return None
        at += 1 if kind == 0xFF else 2 + size  # fill bytes, or a segment
    return None


def _tiff_orientation(read: Read) -> int | None:
    for order, entries in tiff_directories(read):
        found = _numbers(read, order, entries.get(ORIENTATION))
        return found[0] if found and 1 <= found[0] <= 8 else None
    return None


def _jpeg_orientation(read: Read, at: int = 0) -> int | None:
    at += 2
    for _ in range(256):
        head = read(at, 10)
        if len(head) < 4 or head[0] != 0xFF or head[1] in (0xD9, 0xDA):
            return None
        size = struct.unpack(">H", head[2:4])[0]
        if head[1] == 0xE1 and head[4:10] == b"Exif\0\0":
            begin, end = at + 10, at + 2 + size
            return _tiff_orientation(lambda k, n: read(begin + k, max(0, min(n, end - begin - k))))
        at += 2 + size
    return None


def orientation(read: Read) -> int:
    """EXIF orientation, 1 to 8, of a JPEG or TIFF-like file; 1 where it has none or can't be told."""
    try:
        return (_jpeg_orientation(read) if read(0, 2) == b"\xff\xd8" else _tiff_orientation(read)) or 1
    except struct.error:
        return 1


def _places(read: Read) -> Iterator[tuple[int, int]]:
    """Where pictures may lie in a raw file: (place, bytes)."""
    if read(0, len(FUJI)) == FUJI:
        yield struct.unpack(">II", read(84, 8))
    for order, entries in tiff_directories(read):
        at, size = _numbers(read, order, entries.get(JPEG_AT)), _numbers(read, order, entries.get(JPEG_SIZE))
        if len(at) == len(size) == 1:
            yield at[0], size[0]
        strips, sizes = _numbers(read, order, entries.get(STRIPS)), _numbers(read, order, entries.get(STRIP_SIZES))
        if len(strips) == len(sizes) == 1 and _numbers(read, order, entries.get(COMPRESSION)) in ([6], [7]):
            yield strips[0], sizes[0]
        if JPEG_INSIDE in entries:
            yield entries[JPEG_INSIDE][2], entries[JPEG_INSIDE][1]


def preview(read: Read) -> bytes | None:
    """The largest ordinary JPEG inside a raw file, with the file's orientation if it has none of its own; None if there is none."""
    best = None
    try:
        for at, size in _places(read):
            if found := jpeg_size(read, at):
                best = max(best or (0, 0, 0), (found[0] * found[1], size, at))
    except struct.error:
        pass
    if best is None or best[1] <= 0:
        return None
    raw = read(best[2], best[1])
    turn = orientation(read)
    if turn == 1 or _jpeg_orientation(lambda k, n: raw[k : k + n]):
        return raw
    directory = b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, ORIENTATION, 3, 1, turn, 0, 0)
    return raw[:2] + b"\xff\xe1" + struct.pack(">H", 8 + len(directory)) + b"Exif\0\0" + directory + raw[2:]
