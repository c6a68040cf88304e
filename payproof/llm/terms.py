"""Words of letters, digits and everything beyond ASCII, taken from the UTF-8 bytes of a text with A-Z in lower case."""
from __future__ import annotations

import re
from collections.abc import Iterator

INK = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BLOCK = 4 << 20                     # bytes folded at once


def folded(text: bytes, gap: re.Pattern = GAP, table: bytes = INK) -> Iterator[bytes]:
    """The text with every other byte a space, in blocks that end between words: a long text is never held twice."""
    at = 0
    while at < len(text):
        cut = gap.search(text, at + BLOCK)
        stop = cut.start() if cut else len(text)
        yield text[at:stop].translate(table)
        at = stop
