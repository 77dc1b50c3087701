"""The number of pages of a PDF file, from its page tree alone: nothing else in the file is parsed or validated."""

from __future__ import annotations

import mmap
import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\s\0]+\d{1,5}[\s\0]+obj\b")
_ROOT = re.compile(rb"/Root[\s\0]+(\d+)[\s\0]+\d+[\s\0]+R")
_COUNT = re.compile(rb"/Count[\s\0]+(\d+)(?:[\s\0]+\d+[\s\0]+(R)\b)?")
_PAGES = re.compile(rb"/Pages[\s\0]+(\d+)[\s\0]+\d+[\s\0]+R")
_TREE = re.compile(rb"/Type[\s\0]*/Pages\b")
_LEAF = re.compile(rb"/Type[\s\0]*/Page(?![A-Za-z])")
_ENCRYPTED = re.compile(rb"/Encrypt[\s\0]+\d+[\s\0]+\d+[\s\0]+R")


def _number(head: bytes, key: bytes) -> int:
    found = re.search(key + rb"[\s\0]+(\d+)", head)
    if not found:
        raise ValueError(f"object stream without {key.decode()}")
    return int(found[1])


def _packed(head: bytes, data: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, body) of the objects of an object stream."""
    if b"/FlateDecode" in head:
        inflate = zlib.decompressobj()
        data = inflate.decompress(data)
    n, first = _number(head, b"/N"), _number(head, b"/First")
    numbers = [int(x) for x in data[:first].split()[: 2 * n]]
    starts = [first + x for x in numbers[1::2]]
    for number, a, b in zip(numbers[::2], starts, [*starts[1:], len(data)], strict=True):
        yield number, data[a:b]


def objects(data) -> dict[int, bytes]:
    """The body of each object, up to its stream; what stands later in the file replaces what stood before."""
    held: dict[int, bytes] = {}
    found = list(_OBJECT.finditer(data))
    for m, after in zip(found, [x.start() for x in found[1:]] + [len(data)], strict=True):
        end = data.find(b"endobj", m.end(), after)
        stop = end if end >= 0 else after
        at = data.find(b"stream", m.end(), stop)
        head = bytes(data[m.end() : at if at >= 0 else stop])
        held[int(m[1])] = head
        if at >= 0 and re.search(rb"/Type[\s\0]*/ObjStm\b", head):
            begin = at + 6 + (2 if data[at + 6 : at + 8] == b"\r\n" else 1)
            try:
                held.update(_packed(head, bytes(data[begin:after])))
            except (zlib.error, ValueError):
                continue  # an encrypted or broken stream: its objects are missing
    return held


def page_count(path: str) -> int:
    """Raises ValueError for what is no PDF, or has no page tree that can be read."""
    with open(path, "rb") as f:
        try:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        except ValueError:
            raise ValueError("not a PDF: empty file") from None
        with data:
            if data.find(b"%PDF-", 0, 1024) < 0:
                raise ValueError("not a PDF: no header")
            held = objects(data)
            roots = [int(m[1]) for m in _ROOT.finditer(data)]
            encrypted = _ENCRYPTED.search(data) is not None
    for root in reversed(roots):  # the last trailer first
        tree = _PAGES.search(held.get(root, b""))
        count = tree and _COUNT.search(held.get(int(tree[1]), b""))
        if count:
            if not count[2]:
                return int(count[1])
            number = re.match(rb"[\s\0]*(\d+)", held.get(int(count[1]), b""))
            if number:
                return int(number[1])
    # without a readable root: the largest tree, or else the pages themselves
    counts = [int(m[1]) for body in held.values() if _TREE.search(body) and (m := _COUNT.search(body)) and not m[2]]
    pages = max(counts, default=sum(bool(_LEAF.search(body)) for body in held.values()))
    if not pages:
        raise ValueError("no page tree" + (": the file is encrypted" if encrypted else ""))
    return pages
